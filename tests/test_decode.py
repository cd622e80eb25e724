"""Byte vectors for the decoders."""

import struct

import pytest
from pyspark.sql import functions as F

from flowlark.functions import decode, net, payloads
from flowlark.sources.packets import LINK_HEADERS


def one(spark, data, link=101):
    df = spark.createDataFrame([(1, 0, len(data), link, bytearray(data))], "id long, ts_us long, wire_len long, link_type int, data binary")
    return decode.parse(df).first()


def v4(proto, body, total=None, ihl=5, frag=0):
    return struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, 20 + len(body) if total is None else total, 7, frag, 64, proto, 0, bytes([192, 168, 1, 10]), bytes([192, 168, 1, 20])) + b"\0" * (4 * ihl - 20) + body


def tcp(flags=2, seq=1000, ack=0, data=b""):
    return struct.pack(">HHIIBBHHH", 1234, 80, seq, ack, 0x50, flags, 1024, 0, 0) + data


def v6(nxt, body):
    return struct.pack(">IHBB", 0x60000000, len(body), nxt, 64) + b"\x20\x01" + b"\0" * 14 + b"\x20\x02" + b"\0" * 14 + body


@pytest.mark.parametrize("link", [1, 113, 0, 108, 101])
def test_every_link_type(spark, link):
    r = one(spark, bytes.fromhex(LINK_HEADERS[link]) + v4(6, tcp(data=b"abc")), link)
    assert (r.parse_error, r.ip_version, r.l4_kind, r.src_port, r.dst_port, r.seq, r.flags, r.payload_len, bytes(r.payload)) == (None, 4, "tcp", 1234, 80, 1000, 2, 3, b"abc")


def test_missing_transport_is_not_an_error(spark):
    r = one(spark, v4(6, b""))
    assert r.parse_error is None and r.l4_kind is None and r.proto == 6


def test_errors(spark):
    assert one(spark, b"\0" * 13, 1).parse_error == "packet too short: need 14 bytes, got 13"
    assert one(spark, b"", 101).parse_error == "packet too short: need 1 bytes, got 0"
    assert "unsupported" in one(spark, b"abc", 147).parse_error
    eth = bytes.fromhex(LINK_HEADERS[1])
    assert "version" in one(spark, eth + b"\x65" + b"\0" * 30, 1).parse_error
    assert "length" in one(spark, b"\x44" + b"\0" * 30).parse_error
    assert one(spark, b"\x10" + b"\0" * 30).ip_version is None


def test_padding_and_options(spark):
    r = one(spark, v4(17, struct.pack(">HHHH", 5, 53, 10, 0) + b"xy", ihl=6, total=34) + b"padding")
    assert (r.l4_kind, r.udp_length, bytes(r.payload), r.ip_header_len) == ("udp", 10, b"xy", 24)


def test_fragments_have_no_transport(spark):
    r = one(spark, v4(6, tcp(), frag=2))
    assert r.is_fragment and r.l4_kind is None and r.ip_fragment_offset == 16


def test_ipv6_extensions(spark):
    r = one(spark, v6(0, bytes([6, 0]) + b"\0" * 6 + tcp()))
    assert (r.ip_version, r.proto, r.l4_kind, r.src_port) == (6, 6, "tcp", 1234)
    r = one(spark, v6(44, struct.pack(">BBHI", 6, 0, 8 << 3, 1) + tcp()))
    assert (r.proto, r.l4_kind, r.is_fragment) == (44, None, True)
    r = one(spark, v6(0, bytes([6, 9]) + b"\0" * 6))
    assert r.parse_error is None and r.l4_kind is None
    r = one(spark, v6(58, struct.pack(">BBHHH", 128, 0, 0, 0x1234, 10)))
    assert (r.l4_kind, r.icmp_text, r.echo_id, r.echo_seq) == ("icmpv6", "echo_request", 0x1234, 10)


def test_vlan(spark):
    h = bytes.fromhex("ffffffffffff001122334455" + "8100" + "a064" + "0800")
    r = one(spark, h + v4(6, tcp()), 1)
    assert (r.vlan_priority, r.vlan_dei, r.vlan_id, r.l4_kind) == (5, False, 100, "tcp")
    r = one(spark, bytes.fromhex("ffffffffffff001122334455" + "8100" + "0001" + "8100" + "0002" + "0800") + v4(6, tcp()), 1)
    assert r.parse_error is None and r.ip_version is None


def dns_query(name=b"\x07example\x03com\x00"):
    return struct.pack(">6H", 0x1234, 0x0100, 1, 0, 0, 0) + name + struct.pack(">HH", 1, 1)


def test_dns():
    q = payloads.parse_dns(dns_query())
    assert (q["id"], q["response"], q["questions"][0]["name"], q["summary"]) == (0x1234, False, "example.com", "id=0x1234 Q example.com A")
    r = struct.pack(">6H", 1, 0x8180, 1, 1, 0, 0) + dns_query()[12:] + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    got = payloads.parse_dns(r)
    assert got["records"][0] == {"section": "answer", "name": "example.com", "type": "A", "class": "IN", "ttl": 60, "data": "1.2.3.4"}
    assert payloads.parse_dns(r[:-1]) is None
    for bad in (b"\xc0\x0c", b"\xc0\xff", b"\xc0\x20", b"\x07exam"):
        assert payloads.parse_dns(struct.pack(">6H", 1, 0x0100, 1, 0, 0, 0) + bad) is None
    assert payloads.parse_dns(b"short") is None
    assert payloads.dns_name(b"\0", 0) == (".", 1)


def hello(host=b"example.com", version=0x0301):
    sni = struct.pack(">HBH", len(host) + 3, 0, len(host)) + host
    ext = struct.pack(">HH", 0, len(sni)) + sni if host else b""
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    hs = b"\x01" + len(body).to_bytes(3, "big") + body
    return struct.pack(">BHH", 0x16, version, len(hs)) + hs


def test_sni():
    assert payloads.parse_sni(hello()) == "example.com"
    assert payloads.parse_sni(hello(version=0x0304)) == "example.com"
    for bad in (hello(b""), hello()[:-1], hello(b"bad_host"), hello(b"-a.com"), hello(version=0x0305), b"", b"\x17\x03\x01\0\0"):
        assert payloads.parse_sni(bad) is None


def test_hex_dump(spark):
    df = spark.createDataFrame([(bytearray(b"0123456789abcdefXY\x00"),), (bytearray(),)], "d binary")
    a, b = (r[0] for r in df.select(net.hex_dump(F.col("d"))).collect())
    assert a.split("\n") == ["0000  30 31 32 33 34 35 36 37  38 39 61 62 63 64 65 66  |0123456789abcdef|", "0010  58 59 00" + " " * 42 + "|XY.|"] and b == ""


def test_shards_are_the_same_in_both_directions(spark):
    from flowlark.operators import flow

    rows = [(1, 0, 6, 1, 10, 2, 20, 0, 0, 0, 1, 0), (2, 0, 6, 2, 20, 1, 10, 0, 0, 0, 1, 0)]
    df = spark.createDataFrame(rows, "id long, ts_us long, proto int, src_ip long, src_port long, dst_ip long, dst_port long, flags int, seq long, ack long, wire_len long, payload_len long")
    assert flow.with_key(df).select(net.stable_shard(F.struct(*flow.KEY), 8)).distinct().count() == 1
