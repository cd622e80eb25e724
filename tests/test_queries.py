"""Every registered query gives what DuckDB gives."""

import duckdb
import pytest
from pyspark.sql import functions as F

from flowlark.functions import net
from flowlark.operators import flow
from flowlark.plans import catalog, fold_sql
from flowlark.sources.packets import PACKETS_SQL, packets

#: Folds whose thresholds the smallest table does not reach.
LARGER = ("syn_flood_alerts", "port_scan_alerts", "alerts", "tick_top_flows_carry", "spacesaving_candidates", "flow_eviction")


def same(sf_dir, sql, got):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    want, got = con.sql(sql).df(), got.toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    want, got = (d[cols].sort_values(cols).reset_index(drop=True) for d in (want, got))
    assert len(want) == len(got)
    for c in cols:
        assert ((want[c] == got[c]) | (want[c].isna() & got[c].isna())).all(), c
    return want


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    same(sf_dir, catalog.ORACLES[name], catalog.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", LARGER)
def test_folds_match_sql_where_they_have_rows(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert len(same(sf_dir, catalog.ORACLES[name], catalog.QUERIES[name](spark, sf_dir)))


def test_full_csv_export_matches_sql_where_a_round_trip_is_a_tie(spark):
    same("/root/testdata/sf0.01", catalog.ORACLES["flow_csv_export_full"], catalog.QUERIES["flow_csv_export_full"](spark, "/root/testdata/sf0.01"))


def test_decimals_are_those_of_printf(spark):
    values = [0.0, 0.0625, 0.1875, 0.0005, 1.0005, 2.0015, 12840.3125, -0.0625, 1e15 + 0.125, 1e22, None]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(net.fixed(F.col("v"), 3).alias("t")).collect()]
    assert got == [duckdb.execute("select printf('%.3f', ?::double)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize(("timeout_us", "max_flows"), [(2_000_000, 0), (1_200_000, 100), (0, 40)])
def test_evictions_under_timeout_and_cap(spark, timeout_us, max_flows):
    sf_dir = "/root/testdata/sf0.01"
    sql = f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {catalog._KEYED}, {fold_sql.evictions(timeout_us, max_flows)}"
    want = same(sf_dir, sql, flow.evictions(packets(spark, sf_dir), timeout_us, max_flows))
    assert set(want.reason) == {why for why, used in (("timeout", timeout_us), ("eviction", max_flows)) if used}


def test_all_queries_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
