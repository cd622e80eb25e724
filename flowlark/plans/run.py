"""A capture run: source, filter, and the sinks that are asked for."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.functions import decode
from flowlark.operators import anomaly, capture, detail, flow, sinks, ticks
from flowlark.plans.bpf import compile_filter
from flowlark.plans.options import Options
from flowlark.sources.pcap import PcapSource


def read(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """Parsed frames of the pcap files at path, as captured: what the filter keeps, numbered over all files, the first count of it."""
    spark.dataSource.register(PcapSource)
    parsed = decode.parse(spark.read.format("pcap").load(path)).where(compile_filter(options.filter, frames=True))
    return capture.first_packets(capture.numbered(parsed), options.count)


def packets(parsed: DataFrame) -> DataFrame:
    return decode.as_packets(parsed)


def everything(parsed: DataFrame) -> DataFrame:
    """All frames in the shape of packets, for what counts them all: those that are of no flow have no ports."""
    ends = {"src_ip": F.col("src_addr"), "dst_ip": F.col("dst_addr")}
    return parsed.withColumns(ends).select("id", "ts_us", "proto", "src_ip", "src_port", "dst_ip", "dst_port", "wire_len", "is_fragment")


def _us(seconds: float) -> int:
    return int(seconds * 1_000_000)


def flows(p: DataFrame, options: Options) -> DataFrame:
    """The flows that are in the table at the end, each with its current generation only."""
    a = options.analysis
    live = flow.live_packets(p, _us(options.flow.timeout_secs), options.flow.max_flows)
    return flow.full_table(live, a.rtt, a.retrans, a.out_of_order)


def alerts(p: DataFrame, options: Options) -> DataFrame:
    s, q = options.syn_flood, options.port_scan
    floods = anomaly.flood_alerts(p, _us(s.window_secs), s.syn_threshold, s.unique_src_threshold, _us(s.cooldown_secs))
    scans = anomaly.scan_alerts(p, _us(q.window_secs), q.unique_ports_threshold, q.unique_hosts_threshold, _us(q.cooldown_secs))
    return anomaly.describe(floods, scans).orderBy("id", F.desc("kind")).drop("id")


def tick_stats(parsed: DataFrame, options: Options) -> DataFrame:
    return ticks.tick_stats(everything(parsed), options.stats.interval_ms * 1000, _us(options.flow.timeout_secs))


def run(spark: SparkSession, path: str, options: Options, out: dict[str, str]) -> dict[str, int]:
    """Write what out asks for (flows_json, flows_csv, alerts, expired, prometheus, samples); counts by name, and packets and parse_errors."""
    began = time.monotonic()
    parsed = read(spark, path, options).persist()
    p = packets(parsed).persist()
    total = ticks.capture_summary(parsed).first()
    done = {"packets": total["packets"], "parse_errors": total["parse_errors"]}
    if "flows_json" in out:
        done["flows_json"] = sinks.flow_json(flows(p, options), out["flows_json"])
    if "flows_csv" in out:
        done["flows_csv"] = sinks.flow_csv(flows(p, options), out["flows_csv"])
    if "alerts" in out:
        done["alerts"] = sinks.jsonl(alerts(p, options), out["alerts"])
    if "expired" in out:
        done["expired"] = sinks.jsonl(flow.gone(p, _us(options.flow.timeout_secs), options.flow.max_flows).orderBy("ts"), out["expired"])
    if "samples" in out:
        done["samples"] = sinks.jsonl(detail.summary(capture.sample(parsed, options.web.sample_rate)).orderBy("id"), out["samples"])
    if "prometheus" in out:
        with open(out["prometheus"], "w") as f:
            f.write(ticks.prometheus_text(tick_stats(parsed, options), uptime_secs=time.monotonic() - began).first()["text"])
        done["prometheus"] = 1
    p.unpersist()
    parsed.unpersist()
    return done
