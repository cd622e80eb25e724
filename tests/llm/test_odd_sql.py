"""The SQL of the pair operators and of the archives says the same on odd rows as the operators do."""

import duckdb

from flowlark.llm import catalog


def _same(spark, name, folder):
    con = duckdb.connect()
    for table in folder.glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}/*.parquet'")
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted((tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*cols).collect()), key=str) == want
    return [dict(zip(cols, r, strict=True)) for r in want]


def test_documents(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = _same(spark, "op9_ngram_jaccard_join", tmp_path)
    assert len(rows) == odd_docs.count() and any(r["n_links"] for r in rows)


def test_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [-1.0, 0.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [nan, 1.0, 0.0]), (10, [inf, 1.0, 0.0]), (11, [1.0, 0.0]), (3, [1.0, 0.01, 0.0]), (None, [0.0, 0.0, 1.0]), (12, [0.0, 0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = _same(spark, "op10_embedding_near_dedup", tmp_path)
    assert sorted(r["n_links"] for r in got) == [0] * 8 + [1] * 2 + [3] * 4


def test_pages(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, None, ""), (None, "u", big), (7, "u", "x" * 1000), (None, "u", "y" * 2000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = _same(spark, "op3_warc_archives", tmp_path)
    assert sorted(str(r["page_id"]) for r in got if r["record_type"] == "revisit") == ["1", "None"]
