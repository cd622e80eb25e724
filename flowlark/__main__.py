"""python -m flowlark capture.pcap [--config FILE] [--filter TEXT] [--count N] [--export-json F] [--export-csv F] [--alerts F] [--expired F] [--samples F] [--prometheus F] [--top N]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from flowlark.operators import ticks
from flowlark.plans import options, run

SINKS = {"export_json": "flows_json", "export_csv": "flows_csv", "alerts": "alerts", "expired": "expired", "samples": "samples", "prometheus": "prometheus"}


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="flowlark", description=__doc__)
    a.add_argument("pcap")
    a.add_argument("--config")
    a.add_argument("--filter")
    a.add_argument("--count", type=int)
    a.add_argument("--top", type=int, default=0)
    for name in SINKS:
        a.add_argument("--" + name.replace("_", "-"))
    n = a.parse_args(args)
    o = options.load(n.config, {"filter": n.filter, "count": n.count})
    spark = SparkSession.builder.appName("flowlark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run.run(spark, n.pcap, o, {SINKS[k]: getattr(n, k) for k in SINKS if getattr(n, k)})))
    if n.top:
        ticks.top_flows_total(run.packets(run.read(spark, n.pcap, o)), n.top).show(n.top, truncate=False)


if __name__ == "__main__":
    main()
