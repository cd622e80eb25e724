"""Per-interval throughput, top flows, and what is derived from them. Ticks are event-time windows aligned to the epoch."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.net import address_kind, mbps, pps, prometheus_label
from flowlark.operators.flow import KEY, active_flows, with_key


def tick_of(interval_us: int):
    return F.floor(F.col("ts_us") / interval_us).cast("long")


def tick_stats(packets: DataFrame, interval_us: int = 1_000_000, timeout_us: int = 60_000_000) -> DataFrame:
    """tick, packets, bytes, mbps, pps, active_flows, drops (Spark drops none).

    packets may hold frames of any kind, all of which count; active_flows is the
    size of the flow table at the tick's end, under the exact timeout rule.
    """
    secs = F.lit(interval_us / 1e6)
    total = packets.groupBy(tick_of(interval_us).alias("tick")).agg(F.count("*").alias("packets"), F.sum("wire_len").cast("long").alias("bytes"))
    flows = active_flows(packets, timeout_us, interval_us).withColumnRenamed("tick", "t")
    # a tick without a flow's packet has as many flows as the one before it, but for those that ended: both have a row of their own
    out = total.join(flows, F.col("tick") == F.col("t"), "full").withColumn("tick", F.coalesce("tick", "t"))
    out = out.withColumn("active_flows", F.coalesce(F.last("active_flows", ignorenulls=True).over(Window.orderBy("tick")), F.lit(0)))
    return out.where("packets is not null").select("tick", "packets", "bytes", F.round(mbps(F.col("bytes"), secs), 6).alias("mbps"), F.round(pps(F.col("packets"), secs), 6).alias("pps"), "active_flows", F.lit(0).cast("long").alias("dispatch_drops"))


def dense_ticks(ticks: DataFrame) -> DataFrame:
    """tick_stats with a row of zeros for each interval without packets."""
    span = ticks.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("tick"))
    return span.join(ticks, "tick", "left").na.fill(0)


def tick_deltas(packets: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    rows = with_key(packets).withColumn("tick", tick_of(interval_us))
    return rows.groupBy("tick", *KEY).agg(F.sum("wire_len").cast("long").alias("delta_bytes"), F.count("*").alias("delta_packets"))


def top_flows(packets: DataFrame, n: int, interval_us: int = 1_000_000) -> DataFrame:
    """The n flows with most bytes in each tick, ties by key; baselines start anew each tick."""
    w = Window.partitionBy("tick").orderBy(F.desc("delta_bytes"), *KEY)
    return tick_deltas(packets, interval_us).where("delta_bytes > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_flows_total(packets: DataFrame, n: int) -> DataFrame:
    """The n flows with most bytes in all: a partial top per task, then one of n rows each."""
    flows = with_key(packets).groupBy(*KEY).agg(F.sum("wire_len").cast("long").alias("bytes_total"))
    return flows.orderBy(F.desc("bytes_total"), *KEY).limit(n)


def top_flows_carry(packets: DataFrame, n: int, interval_us: int = 1_000_000) -> DataFrame:
    """As top_flows, but bytes of flows that were not reported carry over to the next tick.

    Which flows are reported depends on all flows of all ticks before: one fold
    over the per-tick sums in order, with the unreported flows as state, in a heap
    so that a tick costs what it brings and reports, not what is unreported.
    """
    deltas = tick_deltas(packets, interval_us).select("tick", *KEY, "delta_bytes")
    ip = address_kind(deltas, "a_ip")
    schema = f"tick long, proto int, a_ip {ip}, a_port long, b_ip {ip}, b_port long, delta_bytes long, rank int"
    kind = pa.binary() if ip == "binary" else pa.int64()
    types = [pa.int64(), pa.int32(), kind, pa.int64(), kind, pa.int64(), pa.int64(), pa.int32()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def plain(c):
        return c.to_numpy().tolist() if pa.types.is_integer(c.type) and not c.null_count else c.to_pylist()

    def run(batches):
        import gc
        from heapq import heapify, heappop, heappush

        gc.disable()  # the state is millions of tuples without cycles
        at, owed, heap, rows = None, {}, [], []  # the heap has an entry for each sum that a flow had since it was reported; only its last counts

        def report():
            nonlocal heap
            rank = 0
            while heap and rank < n:
                v, k = heappop(heap)
                if owed.get(k) == -v:
                    del owed[k]
                    rank += 1
                    rows.append((at, *k, -v, rank))
            if len(heap) > 2 * len(owed) + 1000:
                heap = [(-v, k) for k, v in owed.items() if v > 0]
                heapify(heap)

        for b in batches:
            for tick, p, ai, ap, bi, bp, v in zip(*map(plain, b.columns), strict=True):
                if tick != at:
                    if at is not None:
                        report()
                    at = tick
                k = (p, ai, ap, bi, bp)
                owed[k] = v = owed.get(k, 0) + v
                if v > 0:
                    heappush(heap, (-v, k))
            if len(rows) > 1000:
                yield batch(rows)
                rows = []
        if at is not None:
            report()
        gc.enable()
        if rows:
            yield batch(rows)

    return deltas.repartition(1).sortWithinPartitions("tick").mapInArrow(run, schema)


def space_saving(packets: DataFrame, n: int, interval_us: int = 1_000_000) -> DataFrame:
    """Per tick, the SpaceSaving sketch's candidates (capacity max(4n, 16), weight bytes): flow, count, error bound.

    An exact top n is cheaper in Spark; this is for callers that want the sketch.
    """
    capacity = max(4 * n, 16)
    names = ["tick", *KEY, "estimate", "error"]
    rows = with_key(packets).withColumn("tick", tick_of(interval_us)).select("tick", F.col("proto").cast("long").alias("proto"), *KEY[1:], "wire_len", "id")
    ip = address_kind(rows, "a_ip")
    types = [pa.binary() if ip == "binary" and c in ("a_ip", "b_ip") else pa.int64() for c in names]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches):
        at, counts, errors, out = None, {}, {}, []

        def close():
            return [(at, *k, c, errors[k]) for k, c in counts.items()]

        for b in batches:
            for tick, p, ai, ap, bi, bp, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tick != at:
                    out += close()
                    at, counts, errors = tick, {}, {}
                k = (p, ai, ap, bi, bp)
                if k in counts:
                    counts[k] += v
                elif len(counts) < capacity:
                    counts[k], errors[k] = v, 0
                else:
                    least = min(counts, key=lambda x: (counts[x], x))
                    e = counts.pop(least)
                    errors.pop(least)
                    counts[k], errors[k] = e + v, e
            if len(out) > 1000:
                yield batch(out)
                out = []
        out += close()
        if out:
            yield batch(out)

    schema = ", ".join(f"{c} {ip if c in ('a_ip', 'b_ip') else 'long'}" for c in names)
    return rows.repartition("tick").sortWithinPartitions("tick", "id").drop("id").mapInArrow(run, schema)


def candidate_deltas(packets: DataFrame, candidates: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """Exact per-tick bytes of candidate flows only (a semi-join)."""
    keys = candidates.select("tick", *KEY).distinct()
    return tick_deltas(packets, interval_us).join(keys, ["tick", *KEY], "left_semi")


def kernel_deltas(stats: DataFrame) -> DataFrame:
    """Interval counts from cumulative ones (tick, drops, if_drops): never negative, 0 at the first."""
    w = Window.orderBy("tick")  # one row a tick
    d = lambda c: F.coalesce(F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)), F.lit(0)).alias(f"{c}_delta")
    return stats.select("tick", "drops", "if_drops", d("drops"), d("if_drops"))


def capture_summary(packets: DataFrame) -> DataFrame:
    """Packets, bytes, parse errors and the share parsed."""
    bad = F.count_if(F.col("parse_error").isNotNull()) if "parse_error" in packets.columns else F.lit(0).cast("long")
    out = packets.agg(F.count("*").alias("packets"), F.coalesce(F.sum("wire_len"), F.lit(0)).cast("long").alias("bytes"), bad.alias("parse_errors"))
    return out.withColumn("parsed_percent", F.when(F.col("packets") > 0, F.round((F.col("packets") - F.col("parse_errors")) * 100.0 / F.col("packets"), 4)).otherwise(0.0))


def dashboard_ticks(packets: DataFrame, n: int = 10, interval_us: int = 1_000_000, timeout_us: int = 60_000_000) -> DataFrame:
    """tick_stats with the tick's top flows as an array ordered by rank."""
    top = top_flows(packets, n, interval_us).groupBy(F.col("tick").alias("t")).agg(F.sort_array(F.collect_list(F.struct("rank", *KEY, "delta_bytes", "delta_packets"))).alias("top_flows"))
    return tick_stats(packets, interval_us, timeout_us).join(top, F.col("tick") == F.col("t"), "left").drop("t")


# The metrics are ours; the format is Prometheus text 0.0.4: name, kind, column of the ticks, help.
METRICS = (
    ("capture_packets_total", "counter", "packets", "Packets captured in all ticks."),
    ("capture_bytes_total", "counter", "bytes", "Bytes captured in all ticks."),
    ("flow_active", "gauge", "active_flows", "Flows in the table at the end of the last tick."),
    ("dispatch_drops_total", "counter", "dispatch_drops", "Packets dropped between capture and flow table."),
    ("kernel_drops_total", "counter", "drops_delta", "Packets dropped by the kernel."),
    ("kernel_if_drops_total", "counter", "if_drops_delta", "Packets dropped by the interface."),
)


def prometheus_text(ticks: DataFrame, version: str = "1", uptime_secs: float = 0.0) -> DataFrame:
    """One row: totals over the ticks (gauges: the last) as Prometheus text. Kernel drops are those of kernel_deltas(), if joined, else 0."""
    total = lambda kind, c: F.lit(0) if c not in ticks.columns else F.max_by(c, "tick") if kind == "gauge" else F.sum(c)
    agg = ticks.agg(*[F.coalesce(total(kind, c), F.lit(0)).cast("string").alias(name) for name, kind, c, _ in METRICS])
    head = lambda name, kind, text: F.lit(f"# HELP flowlark_{name} {text}\n# TYPE flowlark_{name} {kind}\nflowlark_{name}")
    lines = [F.concat(head("build_info", "gauge", "Version of the running program."), F.lit('{version="'), prometheus_label(F.lit(version)), F.lit('"} 1'))]
    lines.append(F.concat(head("uptime_seconds", "gauge", "Seconds since the run began."), F.lit(f" {uptime_secs:.3f}")))
    lines += [F.concat(head(name, kind, text), F.lit(" "), F.col(name)) for name, kind, _, text in METRICS]
    return agg.select(F.concat(*[F.concat(x, F.lit("\n")) for x in lines]).alias("text"))
