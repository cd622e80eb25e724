import re
from collections import Counter, defaultdict

import duckdb
import pytest

from flowlark.llm import catalog, linededup, mixing


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for view in ("documents", "pages", "embeddings"):
        con.sql(f"create view {view} as select * from '{sf_dir}/{view}.parquet'")
    want = sorted(con.sql(catalog.ORACLES[name]).fetchall(), key=str)
    cols = [d[0] for d in con.sql(catalog.ORACLES[name]).description]
    assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).select(*cols).collect()), key=str) == want


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([10, 1000], [5, 2]) == [20, 1495]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mix(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        taken, size, target = Counter(), Counter(), {}
        for r in rows:
            taken[r.source] += r.taken
            size[r.source] += r.size
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size and r.copies * r.size >= r.taken
        assert size == {r.source: r.source_size for r in rows}
        assert all(taken[s] == int(target[s]) for s in target)
        again = mixing.mix(df.repartition(3)).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(no_docs).count() == 0


def brute_lines(rows, ratio, least):
    pages, total = defaultdict(set), Counter()
    for k, (_, s, t) in enumerate(rows):
        total[s] += 1
        for x in (t or "").split("\n"):
            if x.strip(" "):
                pages[s, x.strip(" ")].add(k)
    drop = {k for k, v in pages.items() if len(v) >= least and len(v) > ratio * total[k[0]]}
    return sorted(((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in drop)) for i, s, t in rows), key=str)


def test_lines(spark, docs, odd_docs, no_docs):
    rows = [(i, "h" if i % 3 else None, f"menu {i % 2}\n body {i}\n\n  menu\nmenu ") for i in range(40)] + [(99, "h", None), (98, "z", "")]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, source string, text string, n_lines int, host string")
    for most in (0, 1000):
        got = linededup.drop_boilerplate(df, max_ratio=0.3, min_pages=3, broadcast_lines=most)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows, 0.3, 3)
        assert got.columns.count("n_lines") == 1 and got.where("n_dropped > 0").count() == 40
    for d in (docs, odd_docs):
        rows = [(r.doc_id, r.source, r.text) for r in d.collect()]
        got = linededup.drop_boilerplate(d, min_pages=2).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute_lines(rows, 0.1, 2)
    assert linededup.drop_boilerplate(no_docs).count() == 0


def test_word_count(spark):
    from pyspark.sql import functions as F

    texts = ["a b\tc", "", None, "  x\x1cy z  ", " \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
