"""SYN floods and port scans over sliding windows with cooldowns."""

from __future__ import annotations

from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.net import address_kind, endpoint_text, ip_text

SYN_FLOOD = {"window_us": 5_000_000, "syns": 200, "sources": 50, "cooldown_us": 10_000_000}
PORT_SCAN = {"window_us": 10_000_000, "ports": 25, "hosts": 10, "cooldown_us": 30_000_000}
LEAST_WINDOW_US = 100_000


def syn_only() -> Column:
    return F.col("flags").bitwiseAND(0x12) == 0x02


def flood_input(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("proto") == 6) & syn_only()).select("id", "ts_us", "src_ip", "dst_ip", "dst_port")


def scan_input(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("proto") == 17) | ((F.col("proto") == 6) & syn_only())).select("id", "ts_us", "src_ip", "dst_ip", "dst_port")


def _sliding(window_us: int, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(-max(window_us, LEAST_WINDOW_US), 0)


def flood_candidates(packets: DataFrame, window_us: int, syns: int, sources: int, **_: int) -> DataFrame:
    """SYN packets at which the window to a target holds enough SYNs from enough sources, were there no cooldown.

    The window is by time, so packets of the same microsecond count each other.
    """
    w = _sliding(window_us, "dst_ip", "dst_port")
    rows = flood_input(packets).withColumn("n_syns", F.count("*").over(w)).withColumn("n_sources", F.array_size(F.collect_set("src_ip").over(w)).cast("long"))
    return rows.where((F.col("n_syns") >= syns) & (F.col("n_sources") >= sources))


def scan_candidates(packets: DataFrame, window_us: int, ports: int, hosts: int, **_: int) -> DataFrame:
    """Packets at which a source has reached enough ports or hosts in the window, were there no cooldown."""
    w = _sliding(window_us, "src_ip")
    rows = scan_input(packets)
    for out, col in (("n_ports", "dst_port"), ("n_hosts", "dst_ip")):
        rows = rows.withColumn(out, F.array_size(F.collect_set(col).over(w)).cast("long"))
    return rows.where((F.col("n_ports") >= ports) | (F.col("n_hosts") >= hosts))


def _can_fire(rows: DataFrame, keys: list[str], window_us: int, **least: int) -> DataFrame:
    """The keys whose packets of two neighbouring spans of a window's length reach at least one of the least numbers of distinct values (or of packets: id).

    Every window lies in two such spans, so no other key can fire. Hash
    aggregates only: no task holds a window. A key's times must not go back.
    """
    span = F.floor(F.col("ts_us") / max(window_us, LEAST_WINDOW_US))
    out = None
    for c, n in least.items():
        seen = rows.select(*keys, span.alias("s"), F.col(c).alias("v")).distinct().groupBy(*keys, "s").agg(F.count("*").alias("n"))
        near = seen.select(*keys, "n", F.explode(F.array("s", F.col("s") + 1)).alias("s")).groupBy(*keys, "s").agg(F.sum("n").alias("n"))
        can = near.where(F.col("n") >= n).select(*keys)
        out = can if out is None else out.unionByName(can)
    return out.distinct()


class SlidingKey:
    """One key's window and cooldown: counts of distinct values kept up to date as events come and go."""

    def __init__(self, window_us: int, cooldown_us: int, values: int) -> None:
        self.window, self.cooldown = max(window_us, LEAST_WINDOW_US), max(cooldown_us, 0)
        self.until: int | None = None
        self.events: deque = deque()
        self.seen = [Counter() for _ in range(values)]

    def add(self, ts: int, values: tuple) -> tuple[int, ...] | None:
        """Events and distinct values in the window, or None in a cooldown (the event is not kept then)."""
        if self.until is not None and self.until > ts:
            return None
        self.events.append((ts, values))
        for c, v in zip(self.seen, values, strict=True):
            c[v] += 1
        while ts - self.events[0][0] > self.window:
            for c, v in zip(self.seen, self.events.popleft()[1], strict=True):
                c[v] -= 1
                if not c[v]:
                    del c[v]
        return len(self.events), *map(len, self.seen)

    def fire(self, ts: int) -> None:
        self.until = ts + self.cooldown


def _alerts(rows: DataFrame, keys: list[str], values: list[str], window_us: int, cooldown_us: int, fires) -> DataFrame:
    """A fold per key over its packets in order; rows must be cut to keys that can fire.

    Rows are dealt by a hash of the keys, not by the keys: where a join before this
    is by the same keys Spark takes its exchange for ours, and adaptive execution may
    then turn that join into one that reads a key's rows in several tasks.
    """
    kinds = {k: address_kind(rows, k) for k in keys}
    rows = rows.select(*keys, "id", "ts_us", *[F.col(v).alias(f"v_{v}") for v in values]).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "id")
    n = len(keys)
    names = ["id", "ts_us", *keys, "n1", "n2"]
    types = [pa.binary() if kinds.get(c) == "binary" else pa.int64() for c in names]

    def run(batches):
        at, state = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for key, i, ts, vals in zip(zip(*cols[:n], strict=True), cols[n], cols[n + 1], zip(*cols[n + 2 :], strict=True), strict=True):
                if key != at:
                    at, state = key, SlidingKey(window_us, cooldown_us, len(values))
                got = state.add(ts, vals)
                if got is not None and fires(got):
                    state.fire(ts)
                    out.append((i, ts, *key, *got[-2:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def flood_alerts(packets: DataFrame, window_us: int, syns: int, sources: int, cooldown_us: int) -> DataFrame:
    """id, ts_us, dst_ip, dst_port, n1 = SYNs, n2 = sources of each alert. Targets that never fire without cooldown are left out first."""
    rows = flood_input(packets)
    can = _can_fire(rows, ["dst_ip", "dst_port"], window_us, id=syns).join(_can_fire(rows, ["dst_ip", "dst_port"], window_us, src_ip=sources), ["dst_ip", "dst_port"], "left_semi")
    return _alerts(rows.join(can, ["dst_ip", "dst_port"], "left_semi"), ["dst_ip", "dst_port"], ["src_ip"], window_us, cooldown_us, lambda g: g[0] >= syns and g[1] >= sources)


def scan_alerts(packets: DataFrame, window_us: int, ports: int, hosts: int, cooldown_us: int) -> DataFrame:
    """id, ts_us, src_ip, n1 = ports, n2 = hosts of each alert."""
    rows = scan_input(packets)
    can = _can_fire(rows, ["src_ip"], window_us, dst_port=ports, dst_ip=hosts)
    return _alerts(rows.join(can, "src_ip", "left_semi"), ["src_ip"], ["dst_port", "dst_ip"], window_us, cooldown_us, lambda g: g[1] >= ports or g[2] >= hosts)


def describe(floods: DataFrame, scans: DataFrame) -> DataFrame:
    """id, ts, kind, description of all alerts; at one packet floods come first."""
    kind = address_kind(floods, "dst_ip")
    a = floods.select("id", (F.col("ts_us") / 1e6).alias("ts"), F.lit("syn_flood").alias("kind"), F.format_string("SYN flood suspected: %d syns, %d sources to %s", "n1", "n2", endpoint_text(F.col("dst_ip"), F.col("dst_port"), kind)).alias("description"))
    b = scans.select("id", (F.col("ts_us") / 1e6).alias("ts"), F.lit("port_scan").alias("kind"), F.format_string("Port scan suspected: %d ports, %d hosts from %s", "n1", "n2", ip_text(F.col("src_ip"), kind)).alias("description"))
    return a.unionByName(b)
