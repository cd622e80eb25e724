"""SQL of the queries that are folds in packet order: recursive tables that step by alert, by instant, by tick or by packet.

Each is what follows the tables packets and kp in a WITH RECURSIVE. They are
written for checking, on times that do not decrease, and not for scale.
"""

from __future__ import annotations

KEY = "proto, a_ip, a_port, b_ip, b_port"


def alerts(name: str, rows: str, keys: str, values: tuple[str, str], window_us: int, cooldown_us: int, fires: str) -> str:
    """Tables ending in one called name, a row an alert: id, ts_us, keys, n1, n2 (fires is a condition on n, n1 and n2).

    A cooldown that outlasts the window leaves nothing of what came before it, so a
    key's next alert is the first at which the packets since the cooldown's end suffice.
    """
    assert cooldown_us > window_us
    return f"""
{name}_in AS ({rows}),
{name}_near AS MATERIALIZED (SELECT {', '.join(f'e.{k}' for k in keys.split(', '))}, e.id, e.ts_us, p.ts_us AS then_us, p.v1, p.v2
  FROM {name}_in e JOIN {name}_in p USING ({keys}) WHERE p.id <= e.id AND e.ts_us - p.ts_us <= {window_us}),
{name}_step AS (
 SELECT DISTINCT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ts_us, {keys}, CAST(0 AS BIGINT) AS n1, CAST(0 AS BIGINT) AS n2, CAST(0 AS BIGINT) AS until
 FROM {name}_in
 UNION ALL
 SELECT id, ts_us, {keys}, n1, n2, ts_us + {cooldown_us} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS nth FROM (
   SELECT w.id, w.ts_us, {', '.join(f'w.{k}' for k in keys.split(', '))}, count(*) AS n, {values[0]} AS n1, {values[1]} AS n2
   FROM {name}_step s JOIN {name}_near w USING ({keys}) WHERE w.ts_us >= s.until AND w.then_us >= s.until GROUP BY ALL) WHERE {fires})
 WHERE nth = 1),
{name} AS (SELECT id, ts_us, {keys}, n1, n2 FROM {name}_step WHERE id IS NOT NULL)"""


def floods(window_us: int, syns: int, sources: int, cooldown_us: int) -> str:
    rows = "SELECT id, ts_us, dst_ip, dst_port, src_ip AS v1, NULL AS v2 FROM packets WHERE proto = 6 AND flags & 18 = 2"
    return alerts("floods", rows, "dst_ip, dst_port", ("count(*)", "count(DISTINCT w.v1)"), window_us, cooldown_us, f"n1 >= {syns} AND n2 >= {sources}")


def scans(window_us: int, ports: int, hosts: int, cooldown_us: int) -> str:
    rows = "SELECT id, ts_us, src_ip, dst_port AS v1, dst_ip AS v2 FROM packets WHERE proto = 17 OR flags & 18 = 2"
    return alerts("scans", rows, "src_ip", ("count(DISTINCT w.v1)", "count(DISTINCT w.v2)"), window_us, cooldown_us, f"n1 >= {ports} OR n2 >= {hosts}")


def evictions(timeout_us: int, max_flows: int) -> str:
    """The step is a prune instant: the table's flows and the packets since the last one, then what goes."""
    return f"""
inst AS (
 SELECT CAST(1 AS BIGINT) AS j, min(ts_us) AS p_us FROM packets
 UNION ALL
 SELECT j + 1, (SELECT min(ts_us) FROM packets p WHERE p.ts_us >= i.p_us + 1000000) AS p_us FROM inst i WHERE p_us IS NOT NULL),
stops AS (SELECT i.j, p.ts_us, min(p.id) AS p_id FROM inst i JOIN packets p ON p.ts_us = i.p_us GROUP BY ALL),
seg AS MATERIALIZED (
 SELECT i.j, {KEY}, min(k.ts_us) AS first_us, max(k.ts_us) AS last_us, count(*) AS packets, sum(wire_len) AS bytes, max(id) AS last_id
 FROM kp k ASOF JOIN stops i ON k.id <= i.p_id GROUP BY ALL),
live AS (
 SELECT CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS p_id, CAST(NULL AS BIGINT) AS ts_us, 'none' AS reason, {KEY},
  first_us, last_us, packets, CAST(bytes AS BIGINT) AS bytes, last_id FROM seg WHERE false
 UNION ALL SELECT 0, NULL, NULL, 'none', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0
 UNION ALL
 SELECT j, p_id, ts_us, CASE WHEN late THEN 'timeout' WHEN age <= n - {max_flows} AND {max_flows} > 0 THEN 'eviction' END,
  {KEY}, first_us, last_us, packets, bytes, last_id
 FROM (
  SELECT *, count(*) FILTER (WHERE NOT late) OVER () AS n, row_number() OVER (PARTITION BY late ORDER BY last_us, last_id) AS age FROM (
   SELECT a.j, a.p_id, a.ts_us, m.* EXCLUDE (j), {timeout_us} > 0 AND a.ts_us - last_us > {timeout_us} AS late FROM (
    SELECT j, {KEY}, min(first_us) AS first_us, max(last_us) AS last_us, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes,
     max(last_id) AS last_id FROM (
     SELECT j + 1 AS j, {KEY}, first_us, last_us, packets, bytes, last_id FROM live WHERE reason IS NULL
     UNION ALL SELECT s.j, {KEY}, first_us, last_us, packets, bytes, last_id FROM seg s WHERE s.j = (SELECT max(j) + 1 FROM live)) GROUP BY ALL) m
   JOIN stops a ON a.j = m.j)))
SELECT p_id, ts_us, reason, {KEY}, first_us, last_us, packets, bytes FROM live WHERE reason IN ('timeout', 'eviction')"""


def carry_over(n: int) -> str:
    """The step is a tick: what was not reported before and the tick's own bytes, then the n largest (follows a table t of packets with tick)."""
    return f"""
nth AS (SELECT tick, row_number() OVER (ORDER BY tick) AS j FROM (SELECT DISTINCT tick FROM t)),
own AS MATERIALIZED (SELECT j, tick, {KEY}, sum(wire_len) AS v FROM t JOIN nth USING (tick) GROUP BY ALL),
owed AS (
 SELECT j, {KEY}, CAST(v AS BIGINT) AS v, row_number() OVER (ORDER BY v DESC, {KEY}) AS rank FROM own WHERE j = 1
 UNION ALL
 SELECT j, {KEY}, v, row_number() OVER (ORDER BY v DESC, {KEY}) FROM (
  SELECT j, {KEY}, CAST(sum(v) AS BIGINT) AS v FROM (
   SELECT j + 1 AS j, {KEY}, v FROM owed WHERE rank > {n}
   UNION ALL SELECT j, {KEY}, v FROM own WHERE j = (SELECT max(j) + 1 FROM owed)) GROUP BY ALL)
 WHERE j <= (SELECT max(j) FROM nth))
SELECT tick, {KEY}, v AS delta_bytes, CAST(rank AS INTEGER) AS rank FROM owed JOIN nth USING (j) WHERE rank <= {n}"""


def space_saving(capacity: int) -> str:
    """The step is a packet of each tick (follows a table t of packets with tick)."""
    same = " AND ".join(f"s.{k.strip()} = p.{k.strip()}" for k in KEY.split(","))
    pick = ", ".join(f"CASE WHEN fresh THEN p_{k.strip()} ELSE {k.strip()} END AS {k.strip()}" for k in KEY.split(","))
    ours = ", ".join(f"s.{k.strip()}" for k in KEY.split(","))
    theirs = ", ".join(f"p.{k.strip()} AS p_{k.strip()}" for k in KEY.split(","))
    return f"""
pk AS MATERIALIZED (SELECT tick, row_number() OVER (PARTITION BY tick ORDER BY id) AS j, {KEY}, CAST(wire_len AS BIGINT) AS w FROM t),
sk AS (
 SELECT j, tick, {KEY}, w AS estimate, CAST(0 AS BIGINT) AS error FROM pk WHERE j = 1
 UNION ALL
 SELECT j + 1, tick, {pick}, CASE WHEN fresh THEN w + least WHEN hit THEN w + estimate ELSE estimate END, CASE WHEN fresh THEN least ELSE error END FROM (
  SELECT *, z = 1 OR (opens AND full_) AS fresh, CASE WHEN full_ THEN estimate ELSE 0 END AS least FROM (
   SELECT *, NOT known AND age = 1 AS opens, held >= {capacity} AS full_ FROM (
    SELECT s.*, p.w, {theirs}, {same} AS hit, bool_or({same}) OVER (PARTITION BY s.tick) AS known, count(*) OVER (PARTITION BY s.tick) AS held,
     row_number() OVER (PARTITION BY s.tick ORDER BY s.estimate, {ours}) AS age
    FROM sk s JOIN pk p ON p.tick = s.tick AND p.j = s.j + 1)), (VALUES (0), (1)) AS zs(z)
  WHERE z = 0 OR (opens AND NOT full_))),
ends AS (SELECT tick, max(j) AS j FROM pk GROUP BY tick)
SELECT tick, CAST(proto AS BIGINT) AS proto, a_ip, a_port, b_ip, b_port, estimate, error FROM sk JOIN ends USING (tick, j)"""
