"""Packet samples, the packet store, formatted lines, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.net import address_kind, clock_text, endpoint_text, fixed, flags_text, protocol_text


def sample(packets: DataFrame, every: int) -> DataFrame:
    """Packets whose id is a multiple of every; 0 takes none."""
    return packets.where(F.col("id") % every == 0) if every > 0 else packets.limit(0)


def first_packets(packets: DataFrame, count: int) -> DataFrame:
    """The first count packets by id; 0 takes all."""
    return packets.where(F.col("id") <= count) if count > 0 else packets


#: Frames of a file that are numbered in one go.
SPAN = 65_536


def numbered(frames: DataFrame) -> DataFrame:
    """frames (file, id) with id counted from 1 over all files, in the order of their names, without gaps (so, after a filter, of what it kept).

    Counts by file and span of ids are added up (a row per span), and rows are
    numbered within their span, so that one file is many tasks' work.
    """
    at = F.floor((F.col("id") - 1) / SPAN).cast("long")
    rows = frames.withColumns({"f_": F.coalesce("file", F.lit("")), "s_": at})
    spans = rows.groupBy(F.col("f_").alias("o_f"), F.col("s_").alias("o_s")).agg(F.count("*").alias("n"))
    before = Window.orderBy("o_f", "o_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("o_f", "o_s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_n"))
    rows = rows.join(offsets, (F.col("f_") == F.col("o_f")) & (F.col("s_") == F.col("o_s")))
    nth = F.row_number().over(Window.partitionBy("f_", "s_").orderBy("id"))
    return rows.withColumn("id", (F.col("o_n") + nth).cast("long")).select(*frames.columns)


def summary(packets: DataFrame) -> DataFrame:
    """id, time, length, protocol, src, dst, info."""
    tcp, kind = F.col("proto") == 6, address_kind(packets, "src_ip")
    info = F.when(tcp, F.format_string("%s seq=%d ack=%d len=%d", flags_text(F.col("flags")), "seq", "ack", "payload_len")).otherwise(F.format_string("len=%d", "payload_len"))
    return packets.select("id", clock_text(F.col("ts_us")).alias("time"), F.col("wire_len").alias("len"), protocol_text(F.col("proto")).alias("protocol"), endpoint_text(F.col("src_ip"), F.col("src_port"), kind).alias("src"), endpoint_text(F.col("dst_ip"), F.col("dst_port"), kind).alias("dst"), info.alias("info"))


def store(packets: DataFrame, capacity: int) -> DataFrame:
    """The last capacity ids; of rows with one id the last by time stands."""
    top = packets.agg(F.max("id").alias("top"))
    rows = packets.join(F.broadcast(top), F.col("id") > F.col("top") - capacity).drop("top")  # one row
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in packets.columns if c != "id"]), "ts_us").alias("p")).select("id", "p.*")


def lookup(packets: DataFrame, ids: list[int], capacity: int) -> DataFrame:
    return store(packets, capacity).where(F.col("id").isin(ids))


def latest_frames(frames: DataFrame) -> DataFrame:
    """One row per frame_seq."""
    return frames.dropDuplicates(["frame_seq"])


def csv_lines(flows: DataFrame) -> DataFrame:
    """Flows as CSV lines: times with six decimals, rates and round trips with three, nulls empty."""
    t = lambda c: F.coalesce(fixed(F.col(c), 6), F.lit(""))
    m = lambda c: F.coalesce(fixed(F.col(c), 3), F.lit(""))
    n = lambda c: F.col(c).cast("string")
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = [n("protocol"), n("a_ip"), n("a_port"), n("b_ip"), n("b_port"), t("first_seen"), t("last_seen"), t("duration_secs"), n("packets_a_to_b"), n("packets_b_to_a"), n("bytes_a_to_b"), n("bytes_b_to_a"), n("packets_total"), n("bytes_total"), m("avg_bps"), e("tcp_state"), e("client"), n("retransmissions"), n("out_of_order"), m("rtt_last_ms"), m("rtt_min_ms"), m("rtt_ewma_ms"), n("rtt_samples")]
    return flows.select(F.concat_ws(",", *cols).alias("line"))


# The columns of the CSV export.
CSV_HEADER = "protocol,endpoint_a_ip,endpoint_a_port,endpoint_b_ip,endpoint_b_port,first_seen,last_seen,duration_secs,packets_a_to_b,packets_b_to_a,bytes_a_to_b,bytes_b_to_a,packets_total,bytes_total,avg_bps,tcp_state,client,retransmissions,out_of_order,rtt_last_ms,rtt_min_ms,rtt_ewma_ms,rtt_samples"


def json_rows(flows: DataFrame) -> DataFrame:
    """Flows as JSON objects with nested endpoints, nulls kept."""
    end = lambda s: F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")).alias(f"endpoint_{s}")
    rest = [c for c in flows.columns if c not in ("protocol", "a_ip", "a_port", "b_ip", "b_port")]
    return flows.select(F.to_json(F.struct("protocol", end("a"), end("b"), *rest), {"ignoreNullFields": "false"}).alias("json"))


def frames_per_tick(ticks: DataFrame, samples: DataFrame, alerts: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """Each tick with its samples and alerts as arrays."""
    s = samples.groupBy(F.floor(F.col("ts_us") / interval_us).cast("long").alias("st")).agg(F.sort_array(F.collect_list(F.struct("id", "ts_us", "wire_len"))).alias("samples"))
    a = alerts.groupBy(F.floor(F.col("ts") * 1e6 / interval_us).cast("long").alias("at")).agg(F.sort_array(F.collect_list(F.struct("id", "kind", "description"))).alias("alerts"))
    return ticks.join(s, F.col("tick") == F.col("st"), "left").join(a, F.col("tick") == F.col("at"), "left").drop("st", "at")
