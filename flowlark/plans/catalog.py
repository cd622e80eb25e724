"""The registered queries of the packet and flow engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowlark.functions import decode, net, payloads
from flowlark.operators import anomaly, capture, flow, ticks
from flowlark.plans import fold_sql
from flowlark.plans.bpf import compile_filter
from flowlark.sources.packets import PACKETS_SQL, frames, packets
from flowlark.sources.synthetic import synthetic_flows as synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TIMEOUT_US = 5_000_000
FLOOD = anomaly.SYN_FLOOD | {"syns": 6, "sources": 5}
SCAN = anomaly.PORT_SCAN


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {_KEYED}, {sql.strip()}"
        return f

    return add


# SQL shared by the oracles.
_KEYED = """
kp AS (
 SELECT *, CASE WHEN fwd THEN 0 ELSE 1 END AS dir, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port,
   CASE WHEN fwd THEN dst_ip ELSE src_ip END AS b_ip, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port,
   CASE WHEN flags & 4 <> 0 THEN 'R' WHEN flags & 18 = 2 THEN 'S' WHEN flags & 2 <> 0 THEN 'B' WHEN flags & 1 <> 0 THEN 'F' WHEN flags & 16 <> 0 THEN 'A' END AS kind
 FROM (SELECT *, (src_ip * 65536 + src_port <= dst_ip * 65536 + dst_port) AS fwd FROM packets))"""
_K = "proto, a_ip, a_port, b_ip, b_port"


def _ip(c: str) -> str:
    return f"concat_ws('.', ({c} >> 24) & 255, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"


def _proto(c: str = "proto") -> str:
    return f"CASE WHEN {c} = 6 THEN 'tcp' ELSE 'udp' END"


def _counted(source: str, extra: str = "") -> str:
    return f"""SELECT {_K}{extra}, arg_min(ts_us, id) AS first_us, arg_max(ts_us, id) AS last_us,
   count(*) FILTER (WHERE dir = 0) AS packets_a_to_b, count(*) FILTER (WHERE dir = 1) AS packets_b_to_a,
   CAST(coalesce(sum(wire_len) FILTER (WHERE dir = 0), 0) AS BIGINT) AS bytes_a_to_b, CAST(coalesce(sum(wire_len) FILTER (WHERE dir = 1), 0) AS BIGINT) AS bytes_b_to_a
   FROM {source} GROUP BY ALL"""


_SNAPSHOT = f"""{_proto()} AS protocol, {_ip('a_ip')} AS a_ip, a_port, {_ip('b_ip')} AS b_ip, b_port, first_us / 1e6 AS first_seen, last_us / 1e6 AS last_seen,
 greatest(last_us - first_us, 0) / 1e6 AS duration_secs, packets_a_to_b, packets_b_to_a, bytes_a_to_b, bytes_b_to_a, packets_a_to_b + packets_b_to_a AS packets_total, bytes_a_to_b + bytes_b_to_a AS bytes_total,
 CASE WHEN last_us > first_us THEN round((bytes_a_to_b + bytes_b_to_a) * 8 / ((last_us - first_us) / 1e6), 3) ELSE 0.0 END AS avg_bps"""
_FLOWS = f"f AS ({_counted('kp')})"
_STATE = f"""
st0 AS (SELECT *, max(CASE WHEN kind IN ('R', 'S', 'B') THEN id END) OVER (PARTITION BY {_K}) AS at_ FROM kp WHERE proto = 6),
st AS (SELECT {_K}, count(*) FILTER (WHERE kind = 'F' AND (at_ IS NULL OR id > at_)) AS nf, count(*) FILTER (WHERE kind = 'A' AND (at_ IS NULL OR id > at_)) AS nk,
  max(CASE WHEN id = at_ THEN kind END) AS r, arg_min(dir, id) FILTER (WHERE kind = 'S') AS cd FROM st0 GROUP BY ALL),
tcp AS (SELECT {_K}, CASE WHEN nf % 2 = 1 THEN 'fin_wait' WHEN nf > 0 THEN 'closed' WHEN r = 'R' THEN 'reset' WHEN nk > 0 THEN 'established' WHEN r = 'S' THEN 'syn_sent' WHEN r = 'B' THEN 'syn_ack' ELSE 'unknown' END AS tcp_state,
  CASE cd WHEN 0 THEN 'a_to_b' WHEN 1 THEN 'b_to_a' END AS client FROM st)"""
_SEGMENTS = f"""
s0 AS (SELECT *, payload_len + CASE WHEN flags & 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN flags & 1 <> 0 THEN 1 ELSE 0 END AS seq_len FROM kp WHERE proto = 6),
s1 AS (SELECT *, (seq + seq_len) % 4294967296 AS fin_, CASE WHEN flags & 16 <> 0 THEN ack END AS acked FROM s0),
s2 AS (SELECT *, first_value(CASE WHEN dir = 0 THEN CASE WHEN seq_len > 0 THEN fin_ END ELSE acked END IGNORE NULLS) OVER w AS b0,
  first_value(CASE WHEN dir = 1 THEN CASE WHEN seq_len > 0 THEN fin_ END ELSE acked END IGNORE NULLS) OVER w AS b1 FROM s1
  WINDOW w AS (PARTITION BY {_K} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s3 AS (SELECT *, CASE WHEN seq_len > 0 THEN (fin_ - CASE WHEN dir = 0 THEN b0 ELSE b1 END + 2147483648 + 4294967296) % 4294967296 - 2147483648 END AS ue,
  (acked - CASE WHEN dir = 0 THEN b1 ELSE b0 END + 2147483648 + 4294967296) % 4294967296 - 2147483648 AS ua FROM s2),
s4 AS (SELECT *, CASE WHEN dir = 0 THEN max(CASE WHEN dir = 0 THEN ue END) OVER w ELSE max(CASE WHEN dir = 1 THEN ue END) OVER w END AS most,
  CASE WHEN dir = 0 THEN last_value(CASE WHEN dir = 1 THEN ua END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN dir = 0 THEN ua END IGNORE NULLS) OVER w END AS peer FROM s3
  WINDOW w AS (PARTITION BY {_K} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sg AS (SELECT *, CASE WHEN seq_len > 0 THEN CASE WHEN most IS NULL OR ue > most THEN 'advanced' WHEN ue <= peer THEN 'retransmission' ELSE 'out_of_order' END END AS status FROM s4),
ro AS (SELECT {_K}, count(*) FILTER (WHERE status = 'retransmission') AS retransmissions, count(*) FILTER (WHERE status = 'out_of_order') AS out_of_order FROM sg GROUP BY ALL)"""
_RTT = f"""
rs AS (SELECT s.proto, s.a_ip, s.a_port, s.b_ip, s.b_port, s.id AS seg, min(a.id) AS ackid, s.ts_us AS sent FROM sg s JOIN sg a
  ON s.proto = a.proto AND s.a_ip = a.a_ip AND s.a_port = a.a_port AND s.b_ip = a.b_ip AND s.b_port = a.b_port AND a.dir <> s.dir AND a.id > s.id AND a.ua >= s.ue
  WHERE s.status = 'advanced' GROUP BY ALL),
rm AS (SELECT rs.*, greatest(p.ts_us - sent, 0) / 1000 AS ms FROM rs JOIN packets p ON p.id = rs.ackid),
rl AS (SELECT {_K}, list(ms ORDER BY ackid, seg) AS l FROM rm GROUP BY ALL),
rt AS (SELECT {_K}, l[-1] AS rtt_last_ms, list_min(l) AS rtt_min_ms, list_reduce(l, lambda a, x: 0.875 * a + 0.125 * x) AS rtt_ewma_ms, len(l) AS rtt_samples FROM rl)"""


def _keys() -> list[Column]:
    return [F.col(c) for c in flow.KEY]


@query(f"{_FLOWS} SELECT {_SNAPSHOT} FROM f")
def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.flow_table(packets(spark, sf_dir)).orderBy(F.desc("bytes_total"), "protocol", "a_ip", "a_port", "b_ip", "b_port")


@query(f"{_FLOWS} SELECT {_SNAPSHOT}, CAST(NULL AS DOUBLE) AS rtt_ewma_ms, CAST(0 AS BIGINT) AS retransmissions, CAST(0 AS BIGINT) AS out_of_order FROM f")
def flow_table_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flow.full_table(packets(spark, sf_dir), False, False, False)
    return out.drop("tcp_state", "client", "rtt_last_ms", "rtt_min_ms", "rtt_samples")


@query(f"{_STATE} SELECT {_K}, tcp_state FROM tcp")
def flow_tcp_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.tcp_state(flow.with_key(packets(spark, sf_dir))).select(*flow.KEY, "tcp_state")


@query(f"{_STATE} SELECT {_K}, client FROM tcp WHERE client IS NOT NULL")
def flow_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.tcp_state(flow.with_key(packets(spark, sf_dir))).where("client is not null").select(*flow.KEY, "client")


@query(f"{_SEGMENTS} SELECT * FROM ro")
def tcp_retrans_ooo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.retransmissions(flow.with_key(packets(spark, sf_dir)))


@query(f"{_SEGMENTS}, {_RTT} SELECT {_K}, rtt_samples, rtt_min_ms, rtt_last_ms FROM rt")
def tcp_rtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.rtt(flow.with_key(packets(spark, sf_dir))).select(*flow.KEY, "rtt_samples", "rtt_min_ms", "rtt_last_ms")


@query(f"{_SEGMENTS}, {_RTT} SELECT {_K}, round(rtt_ewma_ms, 6) AS rtt_ewma_ms FROM rt")
def tcp_rtt_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.rtt(flow.with_key(packets(spark, sf_dir))).select(*flow.KEY, F.round("rtt_ewma_ms", 6).alias("rtt_ewma_ms"))


@query(f"""{_FLOWS}, {_STATE}, {_SEGMENTS}, {_RTT} SELECT {_SNAPSHOT}, tcp_state, client, coalesce(retransmissions, 0) AS retransmissions, coalesce(out_of_order, 0) AS out_of_order,
 rtt_last_ms, rtt_min_ms, round(rtt_ewma_ms, 6) AS rtt_ewma_ms, coalesce(rtt_samples, 0) AS rtt_samples FROM f LEFT JOIN tcp USING ({_K}) LEFT JOIN ro USING ({_K}) LEFT JOIN rt USING ({_K})""")
def flow_table_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.full_table(packets(spark, sf_dir)).withColumn("rtt_ewma_ms", F.round("rtt_ewma_ms", 6))


@query(f"""g0 AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY {_K} ORDER BY id) AS gap FROM kp),
g AS (SELECT *, CAST(count(*) FILTER (WHERE gap > {TIMEOUT_US}) OVER (PARTITION BY {_K} ORDER BY id) AS BIGINT) AS generation FROM g0),
f AS ({_counted('g', ', generation')}) SELECT {_SNAPSHOT}, generation FROM f""")
def flow_expired_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.session_generations(packets(spark, sf_dir), TIMEOUT_US)
    return flow.snapshot(flow.counters(rows, "generation"))


_EXACT = f"""inst AS (WITH RECURSIVE r(p_us) AS (SELECT min(ts_us) FROM packets UNION ALL SELECT (SELECT min(ts_us) FROM packets p WHERE p.ts_us >= r.p_us + 1000000) FROM r WHERE r.p_us IS NOT NULL)
  SELECT r.p_us, (SELECT min(id) FROM packets p WHERE p.ts_us = r.p_us) AS p_id FROM r WHERE r.p_us IS NOT NULL),
e0 AS (SELECT *, lead(id) OVER (PARTITION BY {_K} ORDER BY id) AS next_id FROM kp),
e1 AS (SELECT e0.*, i.p_us, i.p_id FROM e0 ASOF LEFT JOIN inst i ON e0.ts_us + {TIMEOUT_US} < i.p_us),
e2 AS (SELECT *, CASE WHEN p_us IS NOT NULL AND (next_id IS NULL OR p_id < next_id) THEN p_us END AS expired_us FROM e1),
e AS (SELECT *, CAST(coalesce(count(expired_us) OVER (PARTITION BY {_K} ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation FROM e2),
ee AS (SELECT {_K}, generation, max(expired_us) AS expired_us FROM e GROUP BY ALL),
f AS ({_counted('e', ', generation')})"""


@query(f"{_EXACT} SELECT {_SNAPSHOT}, generation, expired_us / 1e6 AS ts, 'timeout' AS reason FROM f JOIN ee USING ({_K}, generation) WHERE expired_us IS NOT NULL")
def flow_expired_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.expired(packets(spark, sf_dir), TIMEOUT_US)


@query(f"{_EXACT} SELECT {_SNAPSHOT}, generation FROM f JOIN ee USING ({_K}, generation) WHERE expired_us IS NULL")
def flow_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.remaining(packets(spark, sf_dir), TIMEOUT_US)


@query(fold_sql.evictions(60_000_000, 500))
def flow_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.evictions(packets(spark, sf_dir), 60_000_000, 500)


_TICK = "t AS (SELECT *, ts_us // 1000000 AS tick FROM kp)"
_DELTA = f"{_TICK}, d AS (SELECT tick, {_K}, CAST(sum(wire_len) AS BIGINT) AS delta_bytes, count(*) AS delta_packets FROM t GROUP BY ALL)"


# lives of flows in ticks, and how many are in the table at a tick's end
_ACTIVE = f"""{_EXACT}, {_TICK}, lv AS (SELECT min(ts_us) // 1000000 AS t0, max(expired_us) // 1000000 AS t1 FROM e GROUP BY {_K}, generation),
a AS (SELECT tick, count(*) FILTER (WHERE t0 <= tick AND (t1 IS NULL OR t1 > tick)) AS active_flows FROM (SELECT DISTINCT tick FROM t), lv GROUP BY tick)"""


@query(f"""{_ACTIVE}
SELECT t.tick, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes, round(sum(wire_len) * 8 / 1.0 / 1e6, 6) AS mbps, round(count(*) / 1.0, 6) AS pps, any_value(active_flows) AS active_flows, CAST(0 AS BIGINT) AS dispatch_drops
FROM t JOIN a USING (tick) GROUP BY t.tick""")
def tick_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.tick_stats(packets(spark, sf_dir), timeout_us=TIMEOUT_US)


@query(f"{_DELTA} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tick ORDER BY delta_bytes DESC, {_K}) AS INTEGER) AS rank FROM d WHERE delta_bytes > 0) WHERE rank <= 10")
def tick_top_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.top_flows(packets(spark, sf_dir), 10)


@query(f"{_TICK}, {fold_sql.carry_over(10)}")
def tick_top_flows_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.top_flows_carry(packets(spark, sf_dir), 10)


@query(f"SELECT_ AS (SELECT 1) SELECT {_K}, CAST(sum(wire_len) AS BIGINT) AS bytes_total FROM kp GROUP BY ALL ORDER BY bytes_total DESC, {_K} LIMIT 10")
def top_flows_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.top_flows_total(packets(spark, sf_dir), 10)


@query(f"{_TICK}, {fold_sql.space_saving(40)}")
def spacesaving_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.space_saving(packets(spark, sf_dir), 10)


@query(f"{_DELTA}, c AS (SELECT DISTINCT tick, {_K} FROM t WHERE wire_len > 200) SELECT d.* FROM d SEMI JOIN c USING (tick, {_K})")
def candidate_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    large = flow.with_key(p.where("wire_len > 200")).withColumn("tick", ticks.tick_of(1_000_000))
    return ticks.candidate_deltas(p, large)


@query(f"""m AS (SELECT id, ts_us, src_ip, dst_ip, dst_port FROM packets WHERE proto = 6 AND flags & 18 = 2),
c AS (SELECT *, count(*) OVER w AS n_syns, len(list_distinct(list(src_ip) OVER w)) AS n_sources FROM m WINDOW w AS (PARTITION BY dst_ip, dst_port ORDER BY ts_us RANGE BETWEEN {FLOOD['window_us']} PRECEDING AND CURRENT ROW))
SELECT id, n_syns, CAST(n_sources AS BIGINT) AS n_sources FROM c WHERE n_syns >= {FLOOD['syns']} AND n_sources >= {FLOOD['sources']}""")
def syn_flood_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.flood_candidates(packets(spark, sf_dir), **FLOOD).select("id", "n_syns", "n_sources")


@query(f"""m AS (SELECT id, ts_us, src_ip, dst_ip, dst_port FROM packets WHERE proto = 17 OR (proto = 6 AND flags & 18 = 2)),
c AS (SELECT *, len(list_distinct(list(dst_port) OVER w)) AS n_ports, len(list_distinct(list(dst_ip) OVER w)) AS n_hosts FROM m WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {SCAN['window_us']} PRECEDING AND CURRENT ROW))
SELECT id, CAST(n_ports AS BIGINT) AS n_ports, CAST(n_hosts AS BIGINT) AS n_hosts FROM c WHERE n_ports >= {SCAN['ports']} OR n_hosts >= {SCAN['hosts']}""")
def port_scan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.scan_candidates(packets(spark, sf_dir), **SCAN).select("id", "n_ports", "n_hosts")


@query(f"{fold_sql.floods(**FLOOD)} SELECT * FROM floods")
def syn_flood_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.flood_alerts(packets(spark, sf_dir), **FLOOD)


@query(f"{fold_sql.scans(**SCAN)} SELECT * FROM scans")
def port_scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.scan_alerts(packets(spark, sf_dir), **SCAN)


@query(f"""{fold_sql.floods(**FLOOD)}, {fold_sql.scans(**SCAN)}
SELECT id, ts_us / 1e6 AS ts, 'syn_flood' AS kind, concat('SYN flood suspected: ', n1, ' syns, ', n2, ' sources to ', {_ip('dst_ip')}, ':', dst_port) AS description FROM floods
UNION ALL SELECT id, ts_us / 1e6, 'port_scan', concat('Port scan suspected: ', n1, ' ports, ', n2, ' hosts from ', {_ip('src_ip')}) FROM scans""")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return anomaly.describe(anomaly.flood_alerts(p, **FLOOD), anomaly.scan_alerts(p, **SCAN))


@query("x AS (SELECT 1) SELECT id, wire_len FROM packets WHERE (proto = 6 AND (src_port = 443 OR dst_port = 443)) OR (proto = 17 AND dst_port = 53 AND NOT (src_ip = 167772161 OR dst_ip = 167772161))")
def packet_filter_bpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).where(compile_filter("tcp port 443 or (udp dst port 53 and not host 10.0.0.1)")).select("id", "wire_len")


@query("x AS (SELECT 1) SELECT id, ts_us, wire_len FROM packets WHERE id % 100 = 0")
def packet_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.sample(packets(spark, sf_dir), 100).select("id", "ts_us", "wire_len")


@query("x AS (SELECT max(id) AS top FROM packets) SELECT id, ts_us, proto, src_ip, dst_ip, wire_len FROM packets, x WHERE id > top - 2000")
def packet_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.store(packets(spark, sf_dir), 2000).select("id", "ts_us", "proto", "src_ip", "dst_ip", "wire_len")


@query(f"""x AS (SELECT *, ts_us % 86400000000 AS d, concat_ws(',', CASE WHEN flags & 2 <> 0 THEN 'SYN' END, CASE WHEN flags & 16 <> 0 THEN 'ACK' END, CASE WHEN flags & 1 <> 0 THEN 'FIN' END, CASE WHEN flags & 4 <> 0 THEN 'RST' END, CASE WHEN flags & 8 <> 0 THEN 'PSH' END, CASE WHEN flags & 32 <> 0 THEN 'URG' END) AS fl FROM packets)
SELECT id, printf('%02d:%02d:%02d.%06d', d // 3600000000, d // 60000000 % 60, d // 1000000 % 60, d % 1000000) AS time, wire_len AS len, {_proto()} AS protocol,
 concat({_ip('src_ip')}, ':', src_port) AS src, concat({_ip('dst_ip')}, ':', dst_port) AS dst, CASE WHEN proto = 6 THEN printf('%s seq=%d ack=%d len=%d', fl, seq, ack, payload_len) ELSE printf('len=%d', payload_len) END AS info FROM x""")
def packet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.summary(packets(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str, link_type: int = 1, vlan: int | None = None) -> DataFrame:
    return decode.parse(frames(packets(spark, sf_dir), link_type, vlan))


@query("x AS (SELECT 1) SELECT id, 'ethernet' AS link_kind, 'ff:ff:ff:ff:ff:ff' AS eth_dst, '00:11:22:33:44:55' AS eth_src, 'IPv4' AS ether_type FROM packets")
def parse_ethernet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("id", "link_kind", "eth_dst", "eth_src", decode.ether_type_text(F.col("ether_type")).alias("ether_type"))


@query("x AS (SELECT 1) SELECT id, CAST(20 AS INTEGER) AS ip_header_len, CAST(payload_len + CASE WHEN proto = 17 THEN 28 ELSE 40 END AS INTEGER) AS ip_total_length, CAST(id % 65536 AS INTEGER) AS ip_id, true AS ip_df, CAST(64 AS INTEGER) AS ip_ttl, proto, src_ip, dst_ip FROM packets")
def parse_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = decode.address_number
    return _parsed(spark, sf_dir).select("id", "ip_header_len", "ip_total_length", "ip_id", "ip_df", "ip_ttl", "proto", ip(F.col("src_addr")).alias("src_ip"), ip(F.col("dst_addr")).alias("dst_ip"))


@query("""x AS (SELECT id, 17664 + payload_len + CASE WHEN proto = 17 THEN 28 ELSE 40 END + id % 65536 + 16384 + 16384 + proto + (src_ip >> 16) + (src_ip & 65535) + (dst_ip >> 16) + (dst_ip & 65535) AS s FROM packets),
y AS (SELECT id, (s >> 16) + (s & 65535) AS s FROM x) SELECT id, (s >> 16) + (s & 65535) = 65535 AS checksum_ok FROM y""")
def ipv4_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("id", decode.ipv4_checksum_ok(F.col("data"), F.col("net_at"), F.col("ip_header_len")).alias("checksum_ok"))


@query("x AS (SELECT 1) SELECT id, src_port, dst_port, seq, ack, flags, CAST(20 AS INTEGER) AS tcp_header_len, payload_len FROM packets WHERE proto = 6")
def parse_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("l4_kind = 'tcp'").select("id", "src_port", "dst_port", "seq", "ack", "flags", "tcp_header_len", "payload_len")


@query("x AS (SELECT 1) SELECT id, src_port, dst_port, CAST(payload_len + 8 AS INTEGER) AS udp_length, payload_len FROM packets WHERE proto = 17")
def parse_udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).where("l4_kind = 'udp'").select("id", "src_port", "dst_port", "udp_length", "payload_len")


@query("x AS (SELECT 1) SELECT id, CAST(5 AS INTEGER) AS vlan_priority, CAST(100 AS INTEGER) AS vlan_id, src_port, dst_port FROM packets")
def parse_vlan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, 1, 5 << 13 | 100).select("id", "vlan_priority", "vlan_id", "src_port", "dst_port")


@query("x AS (SELECT 1) SELECT id, 'host' AS sll_packet_type, '00:11:22:33:44:55' AS sll_address, src_port, dst_port FROM packets")
def parse_sll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, 113).select("id", "sll_packet_type", "sll_address", "src_port", "dst_port")


@query("x AS (SELECT 1) SELECT id, CAST(2 AS BIGINT) AS loop_family, src_port, dst_port FROM packets")
def parse_loopback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, 0).select("id", "loop_family", "src_port", "dst_port")


@query("x AS (SELECT 1) SELECT id, 'raw_ip' AS link_kind, src_port, dst_port, payload_len FROM packets")
def parse_raw_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, 101).select("id", "link_kind", "src_port", "dst_port", "payload_len")


def _v6(p: DataFrame, fragment: bool = False) -> DataFrame:
    """The packets' transport over IPv6 behind a hop-by-hop header (and a later fragment's header for every third id)."""
    v4 = frames(p, 101)
    l4 = F.substring("data", F.lit(21), F.octet_length("data") - 20)
    nxt = F.lower(F.lpad(F.hex(F.col("proto").cast("long")), 2, "0"))
    ext = F.concat(nxt, F.lit("00" * 7))
    frag = F.concat(F.lit("2c"), F.lit("00" * 7), nxt, F.lit("000010" + "00000001"))
    ext = F.when((F.col("id") % 3 == 0) & F.lit(fragment), frag).otherwise(ext)
    body = F.concat(F.unhex(ext), l4)
    size = F.lower(F.lpad(F.hex(F.octet_length(body).cast("long")), 4, "0"))
    addr = lambda c: F.concat(F.lit("20010db8" + "00" * 8), F.lower(F.lpad(F.hex(F.col(c)), 8, "0")))
    rows = v4.join(p.select("id", "proto", "src_ip", "dst_ip"), "id")
    return rows.withColumn("data", F.concat(F.unhex(F.concat(F.lit("60000000"), size, F.lit("0040"), addr("src_ip"), addr("dst_ip"))), body))


@query("""x AS (SELECT 1) SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 44 ELSE proto END AS INTEGER) AS next_header, id % 3 = 0 AS is_fragment, CASE WHEN id % 3 <> 0 THEN src_port END AS src_port, CASE WHEN id % 3 <> 0 THEN payload_len END AS payload_len FROM packets""")
def parse_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.parse(_v6(packets(spark, sf_dir), True).select("id", "ts_us", "wire_len", "link_type", "data")).select("id", F.col("proto").alias("next_header"), "is_fragment", "src_port", "payload_len")


@query("x AS (SELECT 1) SELECT id, CASE WHEN id % 2 = 0 THEN 'echo_request' ELSE 'time_exceeded' END AS icmp_text, CASE WHEN id % 2 = 0 THEN CAST(id % 65536 AS INTEGER) END AS echo_id, CASE WHEN id % 2 = 0 THEN 10 END AS echo_seq FROM packets")
def parse_icmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lower(F.lpad(F.hex(F.col("id") % 65536), 4, "0"))
    icmp = F.concat(F.lit("45000024000040004001000001010101020202"), F.lit("02"), F.when(F.col("id") % 2 == 0, "0800").otherwise("0b00"), F.lit("0000"), h, F.lit("000a"), F.lit("41" * 8))
    rows = packets(spark, sf_dir).select("id", F.lit(101).alias("link_type"), F.unhex(icmp).alias("data"))
    return decode.parse(rows).select("id", "icmp_text", "echo_id", "echo_seq")


@query("""x AS (SELECT 1) SELECT CASE WHEN id % 4 = 0 THEN 'packet too short: need 14 bytes, got 10' WHEN id % 4 = 1 THEN 'packet too short: need 20 bytes, got 6' WHEN id % 4 = 2 THEN 'invalid header: unsupported link type 999' END AS parse_error, count(*) AS n FROM packets GROUP BY ALL""")
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 4
    rows = frames(packets(spark, sf_dir)).withColumn("data", F.when(k == 0, F.substring("data", 1, 10)).when(k == 1, F.substring("data", 1, 20)).otherwise(F.col("data"))).withColumn("link_type", F.when(k == 2, 999).otherwise(F.col("link_type")))
    return decode.parse(rows).groupBy("parse_error").agg(F.count("*").alias("n"))


@query("""x AS (SELECT 1) SELECT id, CAST(id % 65536 AS INTEGER) AS dns_id, printf('id=0x%04x R NOERROR Q=1 A=1 NS=0 AR=0', id % 65536) AS summary, concat('h', id % 10, '.example.com') AS name, concat('10.0.0.', id % 256) AS answer FROM packets WHERE proto = 17""")
def dns_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda x, n: F.lower(F.lpad(F.hex(x.cast("long")), n, "0"))
    name = F.concat(F.lit("0268"), h(F.col("id") % 10 + 48, 2), F.lit("076578616d706c6503636f6d00"))
    msg = F.concat(h(F.col("id") % 65536, 4), F.lit("81800001000100000000"), name, F.lit("00010001"), F.lit("c00c000100010000003c00040a0000"), h(F.col("id") % 256, 2))
    rows = packets(spark, sf_dir).where("proto = 17").select("id", payloads.dns(F.unhex(msg)).alias("dns"))
    return rows.select("id", F.col("dns.id").alias("dns_id"), "dns.summary", F.col("dns.questions")[0]["name"].alias("name"), F.col("dns.records")[0]["data"].alias("answer"))


@query("x AS (SELECT 1) SELECT id, CASE WHEN id % 5 <> 0 THEN concat('h', id % 10, '.example.com') END AS sni FROM packets WHERE proto = 6 AND dst_port = 443")
def tls_sni(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.lower(F.hex(F.col("id") % 10 + 48))
    host = F.concat(F.lit("68"), digit, F.lit(b".example.com".hex()))
    ext = F.concat(F.lit("000000130011" + "00000e"), host)
    body = F.concat(F.lit("0303" + "00" * 32 + "00" + "00021301" + "0100" + "0017"), ext)
    hello = F.concat(F.lit("16030100" + "46" + "01000042"), body)
    cut = F.when(F.col("id") % 5 == 0, F.substring(hello, 1, 60)).otherwise(hello)
    rows = packets(spark, sf_dir).where("proto = 6 and dst_port = 443").select("id", F.unhex(cut).alias("payload"))
    return rows.select("id", payloads.sni(F.col("payload")).alias("sni"))


@query(f"""x AS (SELECT {_K}, count(*) AS n FROM kp GROUP BY ALL) SELECT CAST(1 AS BIGINT) AS shards_per_flow, count(*) AS flows FROM x""")
def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow.with_key(packets(spark, sf_dir)).withColumn("shard", net.stable_shard(F.struct(*flow.KEY), 4))
    return rows.groupBy(*flow.KEY).agg(F.count_distinct("shard").alias("shards_per_flow")).groupBy("shards_per_flow").agg(F.count("*").alias("flows"))


@query(f"""x AS (SELECT {_K}, count(*) AS n FROM kp WHERE id % 4 IN (1, 3) GROUP BY ALL)
SELECT 'ends' AS by, count(*) AS groups, CAST(1 AS BIGINT) AS most_shards, true AS in_range FROM x UNION ALL SELECT 'bytes', 1, 1, true UNION ALL SELECT 'unknown link', 1, 1, true""")
def shard_routing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of which a quarter is cut after ten equal bytes, and a quarter of an unknown link type (those go to shard 0)."""
    k, p = F.col("id") % 4, packets(spark, sf_dir)
    rows = frames(p).withColumns({"data": F.when(k == 0, F.substring("data", 1, 10)).otherwise(F.col("data")), "link_type": F.when(k == 2, 999).otherwise(F.col("link_type"))})
    known = F.col("link_type").isin(*decode.LINK_TYPES)
    shard = net.frame_shard(*[F.col(c) for c in ("src_addr", "src_port", "dst_addr", "dst_port", "proto", "data")], known, 4)
    parsed = decode.parse(rows).select("id", shard.alias("shard"), F.when(~known, "unknown link").when(F.col("src_addr").isNull(), "bytes").otherwise("ends").alias("by"))
    keyed = parsed.join(flow.with_key(p).select("id", *flow.KEY), "id")
    group = F.when(F.col("by") == "ends", F.struct(*flow.KEY))
    shards = keyed.groupBy("by", group.alias("of")).agg(F.count_distinct("shard").alias("n"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
    fits = (F.col("lo") >= 0) & (F.col("hi") <= F.when(F.col("by") == "unknown link", 0).otherwise(3))
    return shards.groupBy("by").agg(F.count("*").alias("groups"), F.max("n").alias("most_shards"), F.min(fits).alias("in_range"))


def _kernel_stats(p: DataFrame) -> DataFrame:
    return p.groupBy(ticks.tick_of(1_000_000).alias("tick")).agg(F.max(F.floor(F.col("id") / 97)).cast("long").alias("drops"), F.lit(0).cast("long").alias("if_drops"))


@query("""x AS (SELECT ts_us // 1000000 AS tick, max(id // 97) AS drops, CAST(0 AS BIGINT) AS if_drops FROM packets GROUP BY 1)
SELECT tick, drops, if_drops, CAST(coalesce(greatest(drops - lag(drops) OVER (ORDER BY tick), 0), 0) AS BIGINT) AS drops_delta, CAST(0 AS BIGINT) AS if_drops_delta FROM x""")
def kernel_drop_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.kernel_deltas(_kernel_stats(packets(spark, sf_dir)))


@query("x AS (SELECT 1) SELECT count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS parse_errors, 100.0::DOUBLE AS parsed_percent FROM packets")
def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks.capture_summary(_parsed(spark, sf_dir))


def _metric(name: str, kind: str, text: str, value: str) -> str:
    return f"'# HELP flowlark_{name} {text}', chr(10), '# TYPE flowlark_{name} {kind}', chr(10), 'flowlark_{name}', {value}, chr(10)"


@query(f"""{_ACTIVE}, g AS (SELECT arg_max(active_flows, tick) AS n FROM a), s AS (SELECT count(*) AS p, sum(wire_len) AS b, max(id // 97) - min(last_id // 97) AS d
  FROM (SELECT *, first_value(id) OVER (ORDER BY tick, id DESC) AS last_id FROM t))
SELECT concat({_metric('build_info', 'gauge', 'Version of the running program.', """'{version="1"} 1'""")}, {_metric('uptime_seconds', 'gauge', 'Seconds since the run began.', "' 2.500'")},
 {_metric('capture_packets_total', 'counter', 'Packets captured in all ticks.', "' ', p")}, {_metric('capture_bytes_total', 'counter', 'Bytes captured in all ticks.', "' ', b")},
 {_metric('flow_active', 'gauge', 'Flows in the table at the end of the last tick.', "' ', n")},
 {_metric('dispatch_drops_total', 'counter', 'Packets dropped between capture and flow table.', "' 0'")},
 {_metric('kernel_drops_total', 'counter', 'Packets dropped by the kernel.', "' ', d")}, {_metric('kernel_if_drops_total', 'counter', 'Packets dropped by the interface.', "' 0'")}) AS text FROM s, g""")
def prometheus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    drops = ticks.kernel_deltas(_kernel_stats(p)).select("tick", "drops_delta", "if_drops_delta")
    return ticks.prometheus_text(ticks.tick_stats(p, timeout_us=TIMEOUT_US).join(drops, "tick", "left"), uptime_secs=2.5)


@query("""x AS (SELECT range AS i FROM range(100000)), y AS (SELECT DISTINCT 167772160 + (i & 16777215) AS s, 1024 + i % 48000 AS sp, 2886729728 + (i & 65535) AS d FROM x) SELECT count(*) AS flows, CAST(100000 * 60 AS BIGINT) AS bytes FROM y""")
def synthetic_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = flow.flow_table(synthetic(spark, 100_000))
    return table.agg(F.count("*").alias("flows"), F.sum("bytes_total").cast("long").alias("bytes"))


@query(f"""{_FLOWS}, {_STATE}, {_SEGMENTS}, {_RTT}, o AS (SELECT {_SNAPSHOT}, tcp_state, client, coalesce(retransmissions, 0) AS re, coalesce(out_of_order, 0) AS oo, rtt_last_ms AS l, rtt_min_ms AS m, coalesce(rtt_samples, 0) AS n FROM f LEFT JOIN tcp USING ({_K}) LEFT JOIN ro USING ({_K}) LEFT JOIN rt USING ({_K}))
SELECT concat(protocol, ',', a_ip, ',', a_port, ',', b_ip, ',', b_port, ',', printf('%.6f', first_seen), ',', printf('%.6f', last_seen), ',', printf('%.6f', duration_secs), ',', packets_a_to_b, ',', packets_b_to_a, ',', bytes_a_to_b, ',', bytes_b_to_a, ',', packets_total, ',', bytes_total, ',', printf('%.3f', avg_bps), ',',
 coalesce(tcp_state, ''), ',', coalesce(client, ''), ',', re, ',', oo, ',', coalesce(printf('%.3f', l), ''), ',', coalesce(printf('%.3f', m), ''), ',,', n) AS line FROM o""")
def flow_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.csv_lines(flow.full_table(packets(spark, sf_dir)).withColumn("rtt_ewma_ms", F.lit(None).cast("double")))


@query(f"""{_FLOWS}, o AS (SELECT {_SNAPSHOT} FROM f) SELECT protocol, a_ip, a_port, b_ip, b_port, bytes_total FROM o""")
def flow_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = capture.json_rows(flow.flow_table(packets(spark, sf_dir)))
    got = lambda p, t: F.get_json_object("json", p).cast(t)
    return rows.select(got("$.protocol", "string").alias("protocol"), got("$.endpoint_a.ip", "string").alias("a_ip"), got("$.endpoint_a.port", "long").alias("a_port"), got("$.endpoint_b.ip", "string").alias("b_ip"), got("$.endpoint_b.port", "long").alias("b_port"), got("$.bytes_total", "long").alias("bytes_total"))

@query(f"""{_FLOWS}, {_STATE}, {_SEGMENTS}, {_RTT}, o AS (SELECT {_SNAPSHOT}, tcp_state, client, coalesce(retransmissions, 0) AS re, coalesce(out_of_order, 0) AS oo, rtt_last_ms AS l, rtt_min_ms AS m, rtt_ewma_ms AS e, coalesce(rtt_samples, 0) AS n FROM f LEFT JOIN tcp USING ({_K}) LEFT JOIN ro USING ({_K}) LEFT JOIN rt USING ({_K}))
SELECT concat(protocol, ',', a_ip, ',', a_port, ',', b_ip, ',', b_port, ',', printf('%.6f', first_seen), ',', printf('%.6f', last_seen), ',', printf('%.6f', duration_secs), ',', packets_a_to_b, ',', packets_b_to_a, ',', bytes_a_to_b, ',', bytes_b_to_a, ',', packets_total, ',', bytes_total, ',', printf('%.3f', avg_bps), ',',
 coalesce(tcp_state, ''), ',', coalesce(client, ''), ',', re, ',', oo, ',', coalesce(printf('%.3f', l), ''), ',', coalesce(printf('%.3f', m), ''), ',', coalesce(printf('%.3f', e), ''), ',', n) AS line FROM o""")
def flow_csv_export_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns; flow_csv_export leaves rtt_ewma_ms empty, as its SQL does."""
    return capture.csv_lines(flow.full_table(packets(spark, sf_dir)))


@query(ORACLES["flow_table_full"].removeprefix(f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {_KEYED}, "))
def flow_json_export_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the full table, read back from its JSON."""
    table = flow.full_table(packets(spark, sf_dir))
    rest = [c for c in table.columns if c not in ("protocol", *flow.KEY)]
    end = lambda s: StructType([StructField(k, table.schema[f"{s}_{k}"].dataType) for k in ("ip", "port")])
    schema = StructType([table.schema["protocol"], StructField("endpoint_a", end("a")), StructField("endpoint_b", end("b")), *[table.schema[c] for c in rest]])
    j = capture.json_rows(table).select(F.from_json("json", schema).alias("j"))
    keys = [F.col("j.protocol"), *[F.col(f"j.endpoint_{s}.{k}").alias(f"{s}_{k}") for s in "ab" for k in ("ip", "port")]]
    return j.select(*keys, *[F.col(f"j.{c}") for c in rest]).withColumn("rtt_ewma_ms", F.round("rtt_ewma_ms", 6))


@query("""x AS (SELECT 1) SELECT id, string_agg(printf('%04x', k * 16), ',' ORDER BY k) AS offsets, max(CASE WHEN k = 0 THEN '  ff ff ff ff ff ff 00 11  22 33 44 55 08 00 45 00  |........"3DU..E.|' END) AS first_line
FROM (SELECT id, unnest(range((wire_len + 15) // 16)) AS k FROM packets) GROUP BY id""")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(packets(spark, sf_dir)).select("id", F.split(net.hex_dump(F.col("data")), "\n").alias("l"))
    return rows.select("id", F.array_join(F.transform("l", lambda x: F.substring(x, 1, 4)), ",").alias("offsets"), F.substring(F.col("l")[0], 5, 100).alias("first_line"))


@query(f"""{_ACTIVE}, d AS (SELECT tick, {_K}, CAST(sum(wire_len) AS BIGINT) AS delta_bytes, count(*) AS delta_packets FROM t GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tick ORDER BY delta_bytes DESC, {_K}) AS INTEGER) AS rank FROM d),
n AS (SELECT tick, count(*) AS packets, CAST(sum(wire_len) AS BIGINT) AS bytes FROM t GROUP BY tick)
SELECT tick, packets, bytes, active_flows, rank, {_K}, delta_bytes, delta_packets FROM n JOIN a USING (tick) JOIN r USING (tick) WHERE rank <= 10""")
def dashboard_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ticks.dashboard_ticks(packets(spark, sf_dir), timeout_us=TIMEOUT_US)
    return rows.select("tick", "packets", "bytes", "active_flows", F.explode("top_flows").alias("f")).select("tick", "packets", "bytes", "active_flows", "f.*")


@query(f"""{_ACTIVE} SELECT t.tick, count(*) AS packets, any_value(active_flows) AS active_flows, string_agg(concat(id, ':', ts_us, ':', wire_len), ',' ORDER BY id) AS samples FROM t JOIN a USING (tick) GROUP BY t.tick""")
def frames_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    found = anomaly.describe(anomaly.flood_alerts(p, **FLOOD), anomaly.scan_alerts(p, **SCAN))
    rows = capture.frames_per_tick(ticks.tick_stats(p, timeout_us=TIMEOUT_US), capture.sample(p, 1), found)
    return rows.select("tick", "packets", "active_flows", F.array_join(F.transform("samples", lambda x: F.concat_ws(":", x["id"], x["ts_us"], x["wire_len"])), ",").alias("samples"))


def _v6_text(c: str) -> str:
    return f"printf('2001:db8::%x:%x', {c} >> 16, {c} & 65535)"


@query(f"""k6 AS (SELECT * REPLACE (payload_len + CASE WHEN proto = 17 THEN 28 ELSE 40 END AS wire_len) FROM kp), f AS ({_counted('k6')})
SELECT {_SNAPSHOT.replace(_ip('a_ip'), _v6_text('a_ip')).replace(_ip('b_ip'), _v6_text('b_ip'))} FROM f""")
def flow_table_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets over IPv6: addresses of 16 bytes order, group and print as such."""
    rows = _v6(packets(spark, sf_dir)).select("id", "ts_us", "wire_len", "link_type", "data")
    return flow.flow_table(decode.as_packets(decode.parse(rows)))


@query(f"""{_SEGMENTS}, {_STATE} SELECT {_v6_text('a_ip')} AS a_ip, a_port, {_v6_text('b_ip')} AS b_ip, b_port, tcp_state, client, retransmissions, out_of_order FROM tcp JOIN ro USING ({_K})""")
def flow_table_v6_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _v6(packets(spark, sf_dir)).select("id", "ts_us", "wire_len", "link_type", "data")
    table = flow.full_table(decode.as_packets(decode.parse(rows)), track_rtt=False)
    return table.where("protocol = 'tcp'").select("a_ip", "a_port", "b_ip", "b_port", "tcp_state", "client", "retransmissions", "out_of_order")


def _in_files(frames_: DataFrame) -> DataFrame:
    """The frames as three capture files, one after another, whose records count from 1 each."""
    part = F.ntile(3).over(Window.orderBy("id"))
    rows = frames_.withColumn("file", F.concat(F.lit("cap."), F.lpad(part.cast("string"), 6, "0"), F.lit(".pcap")))
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("id")).cast("long"))


@query(ORACLES["flow_table_full"].removeprefix(f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {_KEYED}, "))
def flow_table_three_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows whose packets are spread over rotated captures: one numbering, so first and last, states and round trips are those of the whole."""
    rows = capture.numbered(_in_files(frames(packets(spark, sf_dir))))
    return flow.full_table(decode.as_packets(decode.parse(rows))).withColumn("rtt_ewma_ms", F.round("rtt_ewma_ms", 6))


@query("""x AS (SELECT id, row_number() OVER (ORDER BY id) AS n, wire_len FROM packets WHERE proto = 17) SELECT n AS id, wire_len FROM x WHERE n <= 100""")
def captured_and_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, numbering and count of a run: the first hundred of what the filter keeps."""
    parsed = decode.parse(_in_files(frames(packets(spark, sf_dir)))).where(compile_filter("udp", frames=True))
    return capture.first_packets(capture.numbered(parsed.select("file", "id", "wire_len")), 100).select("id", "wire_len")


@query("""x AS (SELECT 1) SELECT id FROM packets WHERE CASE id % 3 WHEN 2 THEN true WHEN 1 THEN proto = 17 AND (src_port = 53 OR dst_port = 53) ELSE proto = 6 AND src_ip BETWEEN 167772160 AND 167772415 END""")
def frame_filter_bpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4, IPv6 and ICMP frames under one filter, before any of them is a flow's packet."""
    p = packets(spark, sf_dir)
    cols = ("id", "ts_us", "wire_len", "link_type", "data")
    icmp = F.unhex(F.lit("4500001c0000400040010000" + "01010101" + "02020202" + "0800000000010002"))
    rows = frames(p.where("id % 3 = 0"), 101).select(*cols).unionByName(_v6(p.where("id % 3 = 1")).select(*cols))
    rows = rows.unionByName(frames(p.where("id % 3 = 2"), 101).withColumn("data", icmp).select(*cols))
    text = "icmp or (ip6 and udp port 53 and not host 2001:db9::1) or (ip and tcp and src net 10.0.0.0/24)"
    return decode.parse(rows).where(compile_filter(text, frames=True)).select("id")


@query("""x AS (SELECT id, id % 65536 AS g, id // 65536 % 65536 AS h FROM packets)
SELECT id, CASE id % 6 WHEN 0 THEN '::' WHEN 1 THEN '::1' WHEN 2 THEN printf('2001:db8:0:1::%x', CASE WHEN g = 0 THEN 1 ELSE g END) WHEN 3 THEN concat('::ffff:10.', g // 256, '.', g % 256, '.7')
 WHEN 4 THEN printf('fe80::%x:0:0:1', 1 + g % 65535) ELSE '1:2:3:4:5:6:7:8' END AS text FROM x""")
def ipv6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero groups at the start, in the middle and nowhere, two runs of them, and mapped IPv4."""
    k, g = F.col("id") % 6, F.col("id") % 65536
    h = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    z = F.lit
    digits = F.when(k == 0, z("0" * 32)).when(k == 1, z("0" * 31 + "1")).when(k == 2, F.concat(z("20010db800000001" + "0" * 12), h(F.when(g == 0, 1).otherwise(g))))
    digits = digits.when(k == 3, F.concat(z("0" * 20 + "ffff0a"), h(g), z("07"))).when(k == 4, F.concat(z("fe80" + "0" * 12), h(1 + g % 65535), z("0" * 8 + "0001"))).otherwise(z("".join(f"{i:04x}" for i in range(1, 9))))
    return packets(spark, sf_dir).select("id", net.ip_text(F.unhex(digits), net.BYTES).alias("text"))


@query(f"{_FLOWS} SELECT {_SNAPSHOT} FROM f")
def decoded_flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to flows: decode every header, then aggregate."""
    return flow.flow_table(decode.as_packets(_parsed(spark, sf_dir)))
