"""The packets view: one TCP or UDP packet per row of the events table, and the frames it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs in Spark and in DuckDB alike. IPv4 addresses are unsigned integers, times microseconds.
PACKETS_SQL = """
WITH base AS (
 SELECT event_id, event_type, CAST(user_id AS BIGINT) AS u, (user_id%10=3) AS scan,
  CAST(floor(value) AS BIGINT)%200 AS payload_len,
  (event_id%3=2 AND user_id%10<>3) AS rev, event_id%16 AS k FROM events),
b2 AS (SELECT *, 167772160+u AS client_ip, 2886729728+(CASE WHEN scan THEN (event_id*7)%16 ELSE u%4 END) AS server_ip,
  49152+u%4096 AS client_port,
  CASE WHEN scan THEN 1000+event_id%64 WHEN event_type='click' THEN 443 WHEN event_type='view' THEN 80
       WHEN event_type='purchase' THEN 8443 WHEN event_type='signup' THEN 53 ELSE 22 END AS server_port,
  CASE WHEN event_type='signup' THEN 17 ELSE 6 END AS proto FROM base)
SELECT event_id AS id, 1704067200000000+event_id*10000 AS ts_us, proto,
  CASE WHEN rev THEN server_ip ELSE client_ip END AS src_ip, CASE WHEN rev THEN server_port ELSE client_port END AS src_port,
  CASE WHEN rev THEN client_ip ELSE server_ip END AS dst_ip, CASE WHEN rev THEN client_port ELSE server_port END AS dst_port,
  CASE WHEN proto=17 THEN 0 WHEN scan THEN 2 WHEN rev THEN CASE WHEN k=5 THEN 18 WHEN k=7 THEN 17 ELSE 16 END
       ELSE CASE WHEN k IN (0,3) THEN 2 WHEN k=7 THEN 17 WHEN k=6 THEN 4 ELSE 24 END END AS flags,
  CASE WHEN proto=17 THEN 0 ELSE ((event_id-CASE WHEN event_id%5=0 THEN 900 ELSE 0 END)*1460+4290000000+CASE WHEN rev THEN 1234567890 ELSE 0 END)%4294967296 END AS seq,
  CASE WHEN proto=17 THEN 0 ELSE ((event_id-CASE WHEN event_id%4=0 THEN 600 ELSE 0 END)*1460+4290000000+CASE WHEN rev THEN 0 ELSE 1234567890 END)%4294967296 END AS ack,
  CASE WHEN proto=17 THEN 42 ELSE 54 END+payload_len AS wire_len, payload_len
FROM b2
"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts_us, proto, src_ip, src_port, dst_ip, dst_port, flags, seq, ack, wire_len, payload_len."""
    return spark.sql(PACKETS_SQL.replace("FROM events)", "FROM {events})"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def _hex(x: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(x.cast("long")), digits, "0"))


#: Link header, in hex, of each link type that frames() can make; None stands for no header.
LINK_HEADERS = {1: "ffffffffffff0011223344550800", 113: "0000000100060011223344550000" + "0800", 0: "02000000", 108: "00000002", 101: ""}


def frames(packets: DataFrame, link_type: int = 1, vlan: int | None = None) -> DataFrame:
    """The IPv4 frames of packets: id, ts_us, wire_len, cap_len, link_type, data (payloads are filled with 'A')."""
    head = LINK_HEADERS[link_type]
    if vlan is not None:
        head = head[:24] + "8100" + f"{vlan:04x}" + head[24:]
    lit = F.lit
    udp = F.col("proto") == 17
    l4 = F.when(udp, F.concat(_hex(F.col("payload_len") + 8, 4), lit("0000"))).otherwise(F.concat(_hex(F.col("seq"), 8), _hex(F.col("ack"), 8), lit("50"), _hex(F.col("flags"), 2), lit("ffff00000000")))
    ip_len = F.col("payload_len") + F.when(udp, 28).otherwise(40)
    data = F.unhex(F.concat(lit(head + "4500"), _hex(ip_len, 4), _hex(F.col("id") % 65536, 4), lit("400040"), _hex(F.col("proto"), 2), lit("0000"), _hex(F.col("src_ip"), 8), _hex(F.col("dst_ip"), 8), _hex(F.col("src_port"), 4), _hex(F.col("dst_port"), 4), l4, F.repeat(lit("41"), F.col("payload_len").cast("int"))))
    out = packets.select("id", "ts_us", lit(link_type).alias("link_type"), data.alias("data"))
    return out.select("id", "ts_us", F.octet_length("data").cast("long").alias("wire_len"), F.octet_length("data").alias("cap_len"), "link_type", "data")
