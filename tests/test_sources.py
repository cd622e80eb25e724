"""pcap files, filters, options and streams."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from flowlark.operators import anomaly, flow
from flowlark.plans import options
from flowlark.plans.bpf import compile_filter
from flowlark.sources import pcap
from flowlark.sources.packets import frames, packets
from flowlark.sources.synthetic import synthetic_flows
from flowlark.streaming import live


def test_byte_orders_and_nanoseconds():
    rows = [(1_000_123, 60, b"abc")]
    assert [r[1:] for r in pcap.read_pcap(pcap.pcap_bytes(rows, 113))] == [(1, 1_000_123, 60, 3, 113, b"abc")]
    big = struct.pack(">IHHiIII", pcap.NANOS, 2, 4, 0, 0, 65535, 1) + struct.pack(">IIII", 1, 123_456, 3, 60) + b"abc"
    assert [r[1:3] for r in pcap.read_pcap(big)] == [(1, 1_000_123)]
    assert list(pcap.read_pcap(big[:-1])) == []
    with pytest.raises(ValueError):
        list(pcap.read_pcap(b"x" * 30))


def test_round_trip(spark, sf_dir, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    f = frames(packets(spark, sf_dir)).repartition(3)
    f.write.format("pcap").mode("overwrite").save(str(tmp_path / "out"))
    back = spark.read.format("pcap").load(str(tmp_path / "out"))
    assert back.count() == f.count()
    assert {(r.ts_us, bytes(r.data)) for r in back.collect()} == {(r.ts_us, bytes(r.data)) for r in f.collect()}
    other = pcap.records(spark.read.format("binaryFile").load(str(tmp_path / "out/*.pcap")))
    assert other.count() == f.count()


@pytest.mark.parametrize("cut", [0, 1, 20])
def test_large_files_are_split_between_records(spark, sf_dir, tmp_path, cut):
    spark.dataSource.register(pcap.PcapSource)
    rows = [(r.ts_us, r.wire_len, bytes(r.data)) for r in frames(packets(spark, sf_dir)).orderBy("id").collect()]
    whole = pcap.pcap_bytes(rows)
    (tmp_path / "a.pcap").write_bytes(whole[: len(whole) - cut])
    (tmp_path / "b.pcap").write_bytes(pcap.pcap_bytes(rows[:3]))
    parts = pcap.splits(str(tmp_path / "a.pcap"), 20_000)
    assert len(parts) > 5 and parts[0][::2] == (24, 0) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    one = spark.read.format("pcap").load(str(tmp_path))
    many = spark.read.format("pcap").option("splitMb", 0.02).load(str(tmp_path))
    assert one.rdd.getNumPartitions() == 2 and many.rdd.getNumPartitions() == len(parts) + 1
    got = sorted((r.file, r.id, r.ts_us, bytes(r.data)) for r in many.collect())
    assert got == sorted((r.file, r.id, r.ts_us, bytes(r.data)) for r in one.collect()) and len(got) == len(rows) + 3 - bool(cut)


def test_rotation(tmp_path):
    path = str(tmp_path / "cap.pcap")
    for n in (90, 91):
        (tmp_path / f"cap.{n:06d}.pcap").write_bytes(b"")
    out = pcap.Rotation(path, 1, 1 << 20, 2)
    for i in range(800):
        out.write(i * 1_000_000, 4130, b"\0" * 4130)
    out.close()
    found = out.existing()
    assert len(found) == 2 and found[0][0] > 91 and found[1][0] == found[0][0] + 1 and not os.path.exists(path)
    assert os.path.getsize(found[0][1]) >= 1 << 20


def test_filters(spark, sf_dir):
    p = packets(spark, sf_dir)
    n = lambda text: p.where(compile_filter(text)).count()
    assert n("") == p.count() and n("tcp") + n("udp") == p.count() and n("not tcp") == n("udp")
    assert n("tcp port 443") == p.where("proto = 6 and (src_port = 443 or dst_port = 443)").count()
    assert n("src net 10.0.0.0/8 and dst portrange 1000-2000") == p.where("src_ip between 167772160 and 184549375 and dst_port between 1000 and 2000").count()
    assert n("less 60 or greater 200") == p.where("wire_len <= 60 or wire_len >= 200").count()
    for bad in ("tcp port", "foo", "(tcp", "tcp)"):
        with pytest.raises(ValueError):
            compile_filter(bad)


def test_options(tmp_path):
    f = tmp_path / "o.toml"
    f.write_text("[flow]\ntimeout_secs = 5\n[stats]\ntop_flows = 3\n")
    o = options.load(str(f), {"stats": {"top_flows": 7}})
    assert (o.flow.timeout_secs, o.flow.max_flows, o.stats.top_flows) == (5, 100_000, 7)
    for bad in ({"nope": 1}, {"output": {"rotate_mb": 1}}, {"output": {"rotate_mb": 1, "keep_files": 2}}, {"web": {"tick_ms": 5}}):
        with pytest.raises(ValueError):
            options.load(None, bad)


def test_synthetic(spark):
    r = synthetic_flows(spark, 5).collect()
    assert (r[3].src_ip, r[3].src_port, r[3].dst_ip, r[3].dst_port) == ((10 << 24) + 3, 1027, (172 << 24) + (16 << 16) + 3, 80)


@pytest.fixture
def stream(spark, tmp_path):
    p = packets(spark, "/root/testdata/sf0.01").where("id <= 4000")
    p.where("id <= 2000").coalesce(1).write.parquet(str(tmp_path / "in"))
    p.where("id > 2000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return p, spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_ticks(spark, stream):
    p, s = stream
    got = drained(live.ticks(s), "ticks", "complete")
    assert got.agg(F.sum("packets"), F.sum("bytes")).first() == p.agg(F.count("*"), F.sum("wire_len")).first()


def test_stream_alerts(spark, stream):
    p, s = stream
    o = anomaly.PORT_SCAN | {"ports": 5, "hosts": 5}
    got = sorted(r.id for r in drained(live.scan_alerts(s, **o), "scans").collect())
    assert got and got == sorted(r.id for r in anomaly.scan_alerts(p, **o).collect())


def test_stream_sessions_jsonl(spark, stream, tmp_path):
    p, s = stream
    q = live.write_jsonl(live.sessions(s, "2 seconds", "1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    batch = {(r.a_ip, r.a_port, r.b_ip, r.b_port, r.first_us) for r in flow.counters(flow.session_generations(p, 2_000_000), "generation").collect()}
    assert rows and all((r["a_ip"], r["a_port"], r["b_ip"], r["b_port"], r["first_us"]) in batch for r in rows)


def test_stream_of_pcap_files(spark, sf_dir, tmp_path):
    spark.dataSource.register(pcap.PcapSource)
    rows = [(r.ts_us, r.wire_len, bytes(r.data)) for r in frames(packets(spark, sf_dir)).limit(50).collect()]
    (tmp_path / "a.pcap").write_bytes(pcap.pcap_bytes(rows))
    got = drained(spark.readStream.format("pcap").load(str(tmp_path)), "caps")
    assert got.count() == 50
