"""Synthetic flows for memory and throughput tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_flows(spark: SparkSession, count: int) -> DataFrame:
    """One TCP packet per flow i: 10.x.y.z port 1024 + i % 48000 to 172.16.y.z port 80 (distinct keys may be fewer)."""
    i = F.col("id")
    src = F.lit(10 << 24) + i.bitwiseAND(0xFFFFFF)
    dst = F.lit((172 << 24) + (16 << 16)) + i.bitwiseAND(0xFFFF)
    zero = F.lit(0).cast("long")
    return spark.range(count).select("id", (i * 1000).alias("ts_us"), F.lit(6).alias("proto"), src.alias("src_ip"), (i % 48000 + 1024).alias("src_port"), dst.alias("dst_ip"), F.lit(80).cast("long").alias("dst_port"), F.lit(2).alias("flags"), zero.alias("seq"), zero.alias("ack"), F.lit(60).cast("long").alias("wire_len"), zero.alias("payload_len"))
