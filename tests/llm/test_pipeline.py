from collections import Counter

import corpus_pipeline as cp
from flowlark.llm import catalog, mixing


def test_stages(spark, docs, sf_dir, tmp_path):
    at, kept = docs, {}
    for name, stage in cp.STAGES:
        out = stage(spark, at, sf_dir)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert new.columns == docs.columns
        kept[name] = (at, new)
        at = new
    before, after = kept["toxicity"]
    toxic = {r.doc_id for r in catalog.QUERIES["op4_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - toxic
    before, after = kept["line_dedup"]
    assert after.count() == before.count()
    before, after = kept["ngram_jaccard_join"]
    assert after.select("doc_id").distinct().count() == after.count() <= before.count()
    before, after = kept["mix_sources"]
    copies = Counter(r.doc_id for r in after.collect())
    assert copies == {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    before, after = kept["bpe"]
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in before.collect())


def test_one_row_of_each_group_whatever_its_doc_id(spark, sf_dir, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (2, a + " more", "s"), (None, a + " else", "s"), (None, c, "s"), (None, c + " tail", "s"), (None, c, "s"), (3, b, "s"), (4, "", "s"), (4, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "docs"))
    out = dict(cp.STAGES)["ngram_jaccard_join"](spark, spark.read.parquet(str(tmp_path / "docs")), sf_dir)
    got = [tuple(r)[:2] for r in out.collect()]
    assert (1, a) in got and (1, b) in got and len(got) == 4
    assert sum(i is None and t.startswith("c0") for i, t in got) == 1 and sum(i == 4 for i, _ in got) == 1


def test_odd_documents_pass_through(spark, odd_docs, no_docs, sf_dir, tmp_path):
    for k, at in enumerate((odd_docs, no_docs)):
        for name, stage in cp.STAGES:
            stage(spark, at, sf_dir).write.parquet(str(tmp_path / f"{k}{name}"))
            at = spark.read.parquet(str(tmp_path / f"{k}{name}"))


def test_eleven_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11)) and len(cp.STAGES) == 5
