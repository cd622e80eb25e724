"""Decoded packets as summaries and layer trees."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.functions import decode
from flowlark.functions.net import clock_text, flags_text, hex_dump
from flowlark.functions.payloads import with_names


def _v6_batch(addr: pa.Array) -> pa.Array:
    return pa.array([None if a is None else str(ipaddress.IPv6Address(a)) for a in addr.to_pylist()], pa.string())


def address_text(addr: Column) -> Column:
    """Dotted quad, or the shortest IPv6 form (RFC 5952), which needs a batch function."""
    v4 = F.concat_ws(".", *[decode.uint(addr, i, 1).cast("string") for i in range(4)])
    v6 = F.arrow_udf(_v6_batch, "string")(F.when(F.octet_length(addr) == 16, addr))
    return F.when(F.octet_length(addr) == 4, v4).otherwise(v6)


def _end(addr: str, port: str) -> Column:
    text = F.when(F.col("ip_version") == 6, F.concat(F.lit("["), F.col(addr), F.lit("]"))).otherwise(F.col(addr))
    return F.when(F.col(port).isNull(), F.col(addr)).otherwise(F.concat(text, F.lit(":"), F.col(port).cast("string")))


def named(parsed: DataFrame) -> DataFrame:
    """Parsed frames with dns, sni, and addresses as text (src, dst)."""
    return with_names(parsed).withColumn("src", address_text(F.col("src_addr"))).withColumn("dst", address_text(F.col("dst_addr")))


def summary(parsed: DataFrame) -> DataFrame:
    """id, time, len, protocol, src, dst, info. TLS and DNS take the place of TCP and UDP; parse errors are in info."""
    rows = named(parsed)
    kind = F.col("l4_kind")
    protocol = F.when(F.col("parse_error").isNotNull(), "error").when(F.col("sni").isNotNull(), "TLS").when(F.col("dns").isNotNull(), "DNS").when(kind == "icmpv6", "ICMPv6").when(kind.isNotNull(), F.upper(kind))
    protocol = protocol.when(F.col("ip_version").isNotNull(), decode.ip_protocol_text(F.col("proto"))).when(F.col("ether_type").isNotNull(), decode.ether_type_text(F.col("ether_type"))).otherwise(F.col("link_kind"))
    tcp = F.concat(F.lit("["), flags_text(F.col("flags")), F.lit("]"), F.format_string(" seq=%d ack=%d win=%d len=%d", "seq", "ack", "window", "payload_len"))
    echo = F.when(F.col("echo_id").isNotNull(), F.format_string(" id=0x%04x seq=%d", "echo_id", "echo_seq")).otherwise("")
    info = F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(F.col("sni").isNotNull(), F.concat(F.lit("ClientHello "), F.col("sni"))).when(F.col("dns").isNotNull(), F.col("dns.summary"))
    info = info.when(kind == "tcp", tcp).when(kind == "udp", F.format_string("len=%d", "payload_len")).when(kind.isNotNull(), F.concat(F.col("icmp_text"), echo)).when(F.col("is_fragment"), "fragment").otherwise("")
    return rows.select("id", clock_text(F.col("ts_us")).alias("time"), F.col("wire_len").alias("len"), protocol.alias("protocol"), F.coalesce(_end("src", "src_port"), F.col("eth_src"), F.lit("")).alias("src"), F.coalesce(_end("dst", "dst_port"), F.col("eth_dst"), F.lit("")).alias("dst"), info.alias("info"))


def _layer(name: str, there: Column, **fields: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v")) for k, v in fields.items()])
    return F.when(there, F.struct(F.lit(name).alias("name"), pairs.alias("fields")))


def detail(parsed: DataFrame, payload_bytes: int = 256) -> DataFrame:
    """id, ts_us, layers (name and ordered fields) and the hex dump of the first payload_bytes bytes of the frame."""
    c = F.col
    rows = named(parsed)
    ok = c("parse_error").isNull()
    layers = F.array_compact(F.array(
        _layer("Ethernet", ok & (c("link_kind") == "ethernet"), dst=c("eth_dst"), src=c("eth_src"), type=decode.ether_type_text(c("ether_type"))),
        _layer("Linux cooked", ok & (c("link_kind") == "linux_sll"), packet_type=c("sll_packet_type"), address=c("sll_address"), type=decode.ether_type_text(c("ether_type"))),
        _layer("Loopback", ok & c("link_kind").isin("null", "loop"), family=c("loop_family")),
        _layer("VLAN", ok & c("vlan_id").isNotNull(), id=c("vlan_id"), priority=c("vlan_priority"), dei=c("vlan_dei")),
        _layer("IPv4", c("ip_version") == 4, src=c("src"), dst=c("dst"), protocol=decode.ip_protocol_text(c("proto")), ttl=c("ip_ttl"), total_length=c("ip_total_length"), id=c("ip_id"), fragment_offset=c("ip_fragment_offset"), dscp=c("ip_dscp"), ecn=c("ip_ecn"), checksum=F.format_string("0x%04x", c("ip_checksum"))),
        _layer("IPv6", c("ip_version") == 6, src=c("src"), dst=c("dst"), next_header=decode.ip_protocol_text(c("proto")), hop_limit=c("ip_ttl"), payload_length=c("ip6_payload_length"), traffic_class=c("ip6_traffic_class"), flow_label=c("ip6_flow_label")),
        _layer("TCP", c("l4_kind") == "tcp", src_port=c("src_port"), dst_port=c("dst_port"), seq=c("seq"), ack=c("ack"), flags=flags_text(c("flags")), window=c("window"), checksum=F.format_string("0x%04x", c("checksum")), urgent=c("urgent")),
        _layer("UDP", c("l4_kind") == "udp", src_port=c("src_port"), dst_port=c("dst_port"), length=c("udp_length"), checksum=F.format_string("0x%04x", c("checksum"))),
        _layer("ICMP", c("l4_kind").isin("icmp", "icmpv6"), type=c("icmp_text"), code=c("icmp_code"), echo_id=c("echo_id"), echo_seq=c("echo_seq")),
        _layer("TLS", c("sni").isNotNull(), server_name=c("sni")),
        _layer("DNS", c("dns").isNotNull(), id=F.format_string("0x%04x", c("dns.id")), flags=c("dns.flags"), rcode=c("dns.rcode"), questions=F.array_join(F.transform(c("dns.questions"), lambda q: F.concat_ws(" ", q["name"], q["type"])), "; "), records=F.array_join(F.transform(c("dns.records"), lambda r: F.concat_ws(" ", r["name"], r["type"], r["data"])), "; ")),
    ))
    return rows.select("id", "ts_us", layers.alias("layers"), hex_dump(F.substring("data", 1, payload_bytes)).alias("hex_dump"))
