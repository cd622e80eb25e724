"""Whole runs over pcap files, summaries and layer trees."""

import json
import struct

import pytest

from flowlark.functions import decode
from flowlark.operators import capture, detail, flow
from flowlark.plans import options, run
from flowlark.sources import pcap
from flowlark.sources.packets import LINK_HEADERS, frames, packets


@pytest.mark.parametrize("link", [1, 113, 0, 101])
def test_one_packet_without_transport(spark, tmp_path, link):
    ip = bytes.fromhex("450000140000000040060000c0a8010ac0a80114")
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes([(1_000_123, 60, bytes.fromhex(LINK_HEADERS[link]) + ip)], link))
    done = run.run(spark, str(tmp_path / "a.pcap"), options.load(), {"flows_json": str(tmp_path / "f.json")})
    assert done == {"packets": 1, "parse_errors": 0, "flows_json": 0} and json.loads((tmp_path / "f.json").read_text()) == []


def test_all_sinks(spark, sf_dir, tmp_path):
    p = packets(spark, sf_dir)
    rows = [(r.ts_us, r.wire_len, bytes(r.data)) for r in frames(p).orderBy("id").collect()]
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes([*rows, (rows[-1][0], 5, b"short")]))
    names = {k: str(tmp_path / k) for k in ("flows_json", "flows_csv", "alerts", "expired", "samples", "prometheus")}
    o = options.load(None, {"flow": {"timeout_secs": 2.0}, "port_scan": {"unique_ports_threshold": 4, "unique_hosts_threshold": 4}, "web": {"sample_rate": 50}})
    done = run.run(spark, str(tmp_path / "a.pcap"), o, names)
    flows = flow.remaining(p, 2_000_000).count()
    assert (done["packets"], done["parse_errors"], done["flows_json"], done["flows_csv"]) == (1001, 1, flows, flows)
    table = json.loads((tmp_path / "flows_json").read_text())
    assert [f["bytes_total"] for f in table] == sorted((f["bytes_total"] for f in table), reverse=True) and {"ip", "port"} == set(table[0]["endpoint_a"])
    csv = (tmp_path / "flows_csv").read_text().splitlines()
    assert csv[0] == capture.CSV_HEADER and all(len(x.split(",")) == 23 for x in csv)
    found = [json.loads(x) for x in (tmp_path / "alerts").read_text().splitlines()]
    assert found and {"ts", "kind", "description"} == set(found[0]) and found[0]["kind"] == "port_scan"
    assert done["expired"] == flow.expired(p, 2_000_000).count() and done["samples"] == 20
    assert "flowlark_capture_packets_total 1001" in (tmp_path / "prometheus").read_text()


def test_summary_and_layers(spark):
    v6 = struct.pack(">IHBB", 0x60000000, 8, 58, 64) + bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex("fe800000000000000000000000000002") + struct.pack(">BBHHH", 128, 0, 0, 0x1234, 10)
    dns = struct.pack(">6H", 7, 0x0100, 1, 0, 0, 0) + b"\x01a\x00" + struct.pack(">HH", 1, 1)
    udp = struct.pack(">HHHH", 4000, 53, 8 + len(dns), 0) + dns
    v4 = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 7, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + udp
    df = spark.createDataFrame([(1, 0, 99, 101, bytearray(v6)), (2, 0, 99, 101, bytearray(v4)), (3, 0, 2, 1, bytearray(b"xx"))], "id long, ts_us long, wire_len long, link_type int, data binary")
    parsed = decode.parse(df)
    a, b, c = detail.summary(parsed).orderBy("id").collect()
    assert (a.protocol, a.src, a.dst, a.info) == ("ICMPv6", "2001:db8::1", "fe80::2", "echo_request id=0x1234 seq=10")
    assert (b.protocol, b.src, b.dst, b.info) == ("DNS", "10.0.0.1:4000", "10.0.0.2:53", "id=0x0007 Q a A")
    assert c.protocol == "error" and "too short" in c.info
    rows = detail.detail(parsed, 16).orderBy("id").collect()
    assert [[x.name for x in r.layers] for r in rows] == [["IPv6", "ICMP"], ["IPv4", "UDP", "DNS"], []]
    assert dict((f.k, f.v) for f in rows[1].layers[0].fields)["src"] == "10.0.0.1" and rows[0].hex_dump.count("\n") == 0


def _captured(tmp_path, name, rows):
    (tmp_path / name).write_bytes(pcap.pcap_bytes(rows, 101))


def _tcp4(a, b, flags, seq, ack):
    return bytes.fromhex("4500002800000000400600000a0000010a000002") + struct.pack(">HHIIBBHHH", a, b, seq, ack, 0x50, flags, 1024, 0, 0)


def _back(frame):
    return frame[:12] + frame[16:20] + frame[12:16] + frame[20:]


def _tcp6(frame):
    head = struct.pack(">IHBB", 0x60000000, 20, 6, 64)
    return head + bytes.fromhex("20010db8" + "00" * 11 + "01") + bytes.fromhex("20010db8" + "00" * 11 + "02") + frame[20:]


def test_one_session_over_two_files(spark, tmp_path):
    first = [(1_000_000, 40, _tcp4(1000, 80, 2, 0, 0)), (1_100_000, 40, _back(_tcp4(80, 1000, 18, 0, 1))), (1_200_000, 40, _tcp4(1000, 80, 16, 1, 1))]
    then = [(9_000_000, 40, _tcp4(1000, 80, 17, 1, 1)), (9_100_000, 40, _back(_tcp4(80, 1000, 17, 1, 2))), (9_200_000, 40, _tcp4(1000, 80, 16, 2, 2))]
    (tmp_path / "in").mkdir()
    _captured(tmp_path, "in/a.000001.pcap", first)
    _captured(tmp_path, "in/a.000002.pcap", then)
    parsed = run.read(spark, str(tmp_path / "in"), options.load())
    assert [r.id for r in parsed.orderBy("ts_us").collect()] == [1, 2, 3, 4, 5, 6]
    r = flow.full_table(run.packets(parsed)).collect()
    assert len(r) == 1 and (r[0].first_seen, r[0].last_seen, r[0].tcp_state, r[0].client, r[0].packets_total) == (1.0, 9.2, "closed", "a_to_b", 6)
    few = run.read(spark, str(tmp_path / "in"), options.load(None, {"count": 4}))
    assert few.count() == 4 and few.agg({"ts_us": "max"}).first()[0] == 9_000_000


def test_a_run_counts_what_its_filter_keeps(spark, tmp_path):
    icmp = bytes.fromhex("4500001c000000004001000001010101020202020800000000010002")
    rows = [(1_000_000 + 1000 * i, 40, x) for i, x in enumerate([_tcp4(1000, 80, 2, 0, 0), icmp, _tcp6(_tcp4(1000, 80, 2, 0, 0)), icmp, b"\x45"])]
    _captured(tmp_path, "a.pcap", rows)
    go = lambda text, **o: run.run(spark, str(tmp_path / "a.pcap"), options.load(None, {"filter": text, **o}), {"flows_json": str(tmp_path / "f"), "prometheus": str(tmp_path / "p"), "samples": str(tmp_path / "s")})
    done = go("icmp")
    assert (done["packets"], done["flows_json"], done["samples"]) == (2, 0, 2) and "flowlark_capture_packets_total 2\n" in (tmp_path / "p").read_text()
    done = go("ip6")
    table = json.loads((tmp_path / "f").read_text())
    assert (done["packets"], done["flows_json"]) == (1, 1) and table[0]["endpoint_a"] == {"ip": "2001:db8::1", "port": 1000} and table[0]["endpoint_b"]["ip"] == "2001:db8::2"
    done = go("", count=4)
    assert (done["packets"], done["flows_json"]) == (4, 2) and "flowlark_flow_active 2\n" in (tmp_path / "p").read_text()
    assert go("not tcp")["packets"] == 3


def test_a_cap_on_flows_puts_out_the_oldest(spark, tmp_path):
    rows = [(1_000_000 + 500_000 * i, 40, _tcp4(1000 + i, 80, 2, 0, 0)) for i in range(10)]
    _captured(tmp_path, "a.pcap", [*rows, (6_100_000, 40, _tcp4(1000, 80, 16, 1, 1))])
    done = run.run(spark, str(tmp_path / "a.pcap"), options.load(None, {"flow": {"max_flows": 3}}), {"flows_json": str(tmp_path / "f"), "expired": str(tmp_path / "e")})
    live = {x["endpoint_a"]["port"]: x["packets_total"] for x in json.loads((tmp_path / "f").read_text())}
    out = [json.loads(x) for x in (tmp_path / "e").read_text().splitlines()]
    assert done["flows_json"] == len(live) == 3 and live == {1000: 1, 1008: 1, 1009: 1}
    assert {x["reason"] for x in out} == {"eviction"} and sorted(x["a_port"] for x in out) == list(range(1000, 1008))
