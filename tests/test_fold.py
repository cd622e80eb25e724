"""Closed forms and windows against a plain fold over packets in order."""

import time
from collections import defaultdict, deque

from flowlark.operators import anomaly, flow, ticks
from flowlark.sources.packets import packets


def signed(x):
    x %= 1 << 32
    return x - (1 << 32) if x >= 1 << 31 else x


def fold(rows):
    """Per TCP flow: state, client, retransmissions, out of order, round trips in ms."""
    out = {}
    for p in rows:
        if p.proto != 6:
            continue
        forth = (p.src_ip, p.src_port) <= (p.dst_ip, p.dst_port)
        key = (p.src_ip, p.src_port, p.dst_ip, p.dst_port) if forth else (p.dst_ip, p.dst_port, p.src_ip, p.src_port)
        d = 0 if forth else 1
        f = out.setdefault(key, {"state": "unknown", "client": None, "re": 0, "oo": 0, "rtt": [], "max": [None, None], "acked": [None, None], "wait": [deque(maxlen=128), deque(maxlen=128)]})
        syn, ack, fin, rst = p.flags & 2, p.flags & 16, p.flags & 1, p.flags & 4
        if rst:
            f["state"] = "reset"
        elif syn and not ack:
            f["state"] = "syn_sent"
            f["client"] = f["client"] or ("a_to_b" if d == 0 else "b_to_a")
        elif syn:
            f["state"] = "syn_ack"
        elif fin:
            f["state"] = "closed" if f["state"] == "fin_wait" else "fin_wait"
        elif ack and f["state"] not in ("reset", "closed", "fin_wait"):
            f["state"] = "established"
        if ack:
            q = f["wait"][1 - d]
            while q and signed(q[0][0] - p.ack) <= 0:
                f["rtt"].append(max(p.ts_us - q.popleft()[1], 0) / 1000)
            f["acked"][1 - d] = p.ack
        n = p.payload_len + bool(syn) + bool(fin)
        if n:
            end = (p.seq + n) % (1 << 32)
            top = f["max"][d]
            if top is None or signed(end - top) > 0:
                f["max"][d] = end
                f["wait"][d].append((end, p.ts_us))
            elif f["acked"][d] is not None and signed(end - f["acked"][d]) <= 0:
                f["re"] += 1
            else:
                f["oo"] += 1
    return out


def test_tcp_analytics(spark, sf_dir):
    p = packets(spark, sf_dir)
    want = fold(p.orderBy("id").collect())
    keyed = flow.with_key(p)
    k = lambda r: (r.a_ip, r.a_port, r.b_ip, r.b_port)
    states = {k(r): (r.tcp_state, r.client) for r in flow.tcp_state(keyed).collect()}
    assert states == {key: (f["state"], f["client"]) for key, f in want.items()}
    seen = {k(r): (r.retransmissions, r.out_of_order) for r in flow.retransmissions(keyed).collect()}
    assert seen == {key: (f["re"], f["oo"]) for key, f in want.items()}
    rtt = {k(r): r for r in flow.rtt(keyed).collect()}
    for key, f in want.items():
        if f["rtt"]:
            e = f["rtt"][0]
            for x in f["rtt"][1:]:
                e = 0.875 * e + 0.125 * x
            r = rtt[key]
            assert (r.rtt_samples, r.rtt_min_ms, r.rtt_last_ms) == (len(f["rtt"]), min(f["rtt"]), f["rtt"][-1]) and abs(r.rtt_ewma_ms - e) < 1e-9
        else:
            assert key not in rtt


def test_handshake(spark):
    rows = [(1, 1_000_000, 6, 1, 1000, 2, 80, 2, 1000, 0, 54, 0), (2, 1_001_000, 6, 2, 80, 1, 1000, 18, 5000, 1001, 54, 0), (3, 1_002_000, 6, 1, 1000, 2, 80, 16, 1001, 5001, 54, 0)]
    df = spark.createDataFrame(rows, "id long, ts_us long, proto int, src_ip long, src_port long, dst_ip long, dst_port long, flags int, seq long, ack long, wire_len long, payload_len long")
    r = flow.full_table(df).first()
    assert (r.tcp_state, r.client, r.rtt_samples, r.rtt_min_ms, r.rtt_last_ms, r.rtt_ewma_ms) == ("established", "a_to_b", 2, 1.0, 1.0, 1.0)
    assert (r.packets_a_to_b, r.packets_b_to_a, r.bytes_total) == (2, 1, 162)


def naive_alerts(rows, key, values, window, cooldown, fires):
    events, until, out = defaultdict(list), {}, []
    for p in rows:
        k = key(p)
        if until.get(k, -1) > p.ts_us:
            continue
        events[k] = [e for e in [*events[k], p] if p.ts_us - e.ts_us <= window]
        got = [len({v(e) for e in events[k]}) for v in values]
        if fires(len(events[k]), got):
            until[k] = p.ts_us + cooldown
            out.append(p.id)
    return out


def test_alerts(spark):
    p = packets(spark, "/root/testdata/sf0.01")
    o = anomaly.PORT_SCAN
    want = naive_alerts(anomaly.scan_input(p).orderBy("id").collect(), lambda e: e.src_ip, [lambda e: e.dst_port, lambda e: e.dst_ip], o["window_us"], o["cooldown_us"], lambda n, g: g[0] >= o["ports"] or g[1] >= o["hosts"])
    assert want and sorted(r.id for r in anomaly.scan_alerts(p, **o).collect()) == want
    f = anomaly.SYN_FLOOD | {"syns": 6, "sources": 5}
    want = naive_alerts(anomaly.flood_input(p).orderBy("id").collect(), lambda e: (e.dst_ip, e.dst_port), [lambda e: e.src_ip], f["window_us"], f["cooldown_us"], lambda n, g: n >= f["syns"] and g[0] >= f["sources"])
    assert want and sorted(r.id for r in anomaly.flood_alerts(p, **f).collect()) == want


def test_alerts_when_the_join_before_the_fold_turns_into_a_broadcast(spark, tmp_path):
    p = packets(spark, "/root/testdata/sf0.01")
    p.repartition(8, "id").write.parquet(str(tmp_path / "p"))
    cut = spark.read.parquet(str(tmp_path / "p"))  # a key's packets are in all tasks of the scan
    f, o = anomaly.SYN_FLOOD | {"syns": 6, "sources": 5}, anomaly.PORT_SCAN
    # as for large tables whose join turns out small
    late = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    want = [sorted(anomaly.flood_alerts(p, **f).collect()), sorted(anomaly.scan_alerts(p, **o).collect())]
    was = {k: spark.conf.get(k, None) for k in late}
    for k, v in late.items():
        spark.conf.set(k, v)
    try:
        got = [sorted(anomaly.flood_alerts(cut, **f).collect()), sorted(anomaly.scan_alerts(cut, **o).collect())]
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(want) and got == want


def test_eviction_without_a_cap_is_the_exact_timeout(spark, sf_dir):
    p = packets(spark, sf_dir)
    one = {(r.ts_us, r.a_ip, r.a_port, r.b_ip, r.b_port) for r in flow.evictions(p, 2_000_000, 0).collect()}
    rows = flow.exact_generations(p, 2_000_000).where("expired_us is not null")
    assert one and one == {(r.expired_us, r.a_ip, r.a_port, r.b_ip, r.b_port) for r in rows.collect()}


def test_eviction_cap(spark, sf_dir):
    got = flow.evictions(packets(spark, sf_dir), 0, 50).collect()
    assert got and {r.reason for r in got} == {"eviction"}


def test_carry_over(spark):
    rows = [(1, 100, 10), (2, 200, 9), (3, 1_000_100, 5), (4, 1_000_200, 5)]
    ports = {1: 1, 2: 2, 3: 1, 4: 2}
    df = spark.createDataFrame([(i, t, 17, 1, ports[i], 2, 9, 0, 0, 0, n, 0) for i, t, n in rows], "id long, ts_us long, proto int, src_ip long, src_port long, dst_ip long, dst_port long, flags int, seq long, ack long, wire_len long, payload_len long")
    got = [(r.tick, r.a_port, r.delta_bytes) for r in ticks.top_flows_carry(df, 1).orderBy("tick").collect()]
    assert got == [(0, 1, 10), (1, 2, 14)]


def test_carry_over_costs_no_more_as_unreported_flows_pile_up(spark):
    rows = spark.range(80_000).selectExpr("id", "id * 50000 ts_us", "17 proto", "id src_ip", "1L src_port", "1000000L dst_ip", "9L dst_port", "0 flags", "0L seq", "0L ack", "60 + id % 7 wire_len", "0L payload_len")
    at = time.monotonic()
    got = ticks.top_flows_carry(rows, 1).collect()  # 4,000 ticks of 20 new flows, of which one is reported
    assert time.monotonic() - at < 40
    assert len(got) == 4000 and [r.a_ip for r in sorted(got)] == [7 * i + 6 for i in range(4000)]


def test_space_saving_keeps_heavy_flows(spark, sf_dir):
    p = packets(spark, sf_dir)
    exact = {(r.tick, r.a_ip, r.a_port, r.b_ip, r.b_port): r.delta_bytes for r in ticks.tick_deltas(p).collect()}
    got = ticks.space_saving(p, 10).collect()
    for r in got:
        true = exact[r.tick, r.a_ip, r.a_port, r.b_ip, r.b_port]
        assert r.estimate - r.error <= true <= r.estimate
