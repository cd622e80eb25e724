"""Sinks: distributed folders, and single files in the exact export formats.

Single files are streamed through the driver row by row, as such a file is one
stream by nature; folders are written by all tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.operators import capture


def by_bytes(flows: DataFrame) -> DataFrame:
    return flows.orderBy(F.desc("bytes_total"), "protocol", "a_ip", "a_port", "b_ip", "b_port")


def flow_json(flows: DataFrame, path: str) -> int:
    """All flows as one pretty-printed JSON array, largest first."""
    n = 0
    with open(path, "w") as f:
        f.write("[")
        for r in capture.json_rows(by_bytes(flows)).toLocalIterator():
            body = json.dumps(json.loads(r["json"]), indent=2).replace("\n", "\n  ")
            f.write(("," if n else "") + "\n  " + body)
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def flow_csv(flows: DataFrame, path: str) -> int:
    """All flows as CSV with a header, largest first."""
    n = 0
    with open(path, "w") as f:
        f.write(capture.CSV_HEADER + "\n")
        for r in capture.csv_lines(by_bytes(flows)).toLocalIterator():
            f.write(r["line"] + "\n")
            n += 1
    return n


def jsonl(rows: DataFrame, path: str) -> int:
    """Rows as JSON lines, nulls kept, in the order of the rows."""
    n = 0
    with open(path, "w") as f:
        for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            f.write(r["j"] + "\n")
            n += 1
    return n


def folder(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("overwrite").format(kind).save(path)
