import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.llm import bpe
from flowlark.llm.catalog import word_vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(word_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def same(docs, library, chars):
    path = word_vocabulary()
    got = bpe.decode(bpe.encode(docs, path, chars), path).collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    have = [(r.doc_id, np.frombuffer(bytes(r.ids), dtype="<u4").tolist(), r.decoded) for r in got]
    assert sorted([h[:2] for h in have], key=key) == sorted(want, key=key)
    for _, ids, text in have:
        assert text == library.decode(ids, skip_special_tokens=False)


def test_as_the_library_does(docs, library):
    same(docs, library, 32_000_000)


def test_many_blocks(docs, library):
    same(docs.where("doc_id < 60"), library, 5_000)


def test_odd_rows(odd_docs, no_docs, library):
    same(odd_docs, library, 1_000)
    assert bpe.encode(no_docs, word_vocabulary()).count() == 0


def test_null_ids_and_extra_columns(spark, library):
    df = spark.createDataFrame([(1, None, "a"), (2, bytearray(), "b")], "doc_id long, ids binary, decoded string")
    assert [r.decoded for r in bpe.decode(df, word_vocabulary()).orderBy("doc_id").collect()] == [None, ""]
    assert bpe.decode(df.withColumn("x", F.lit(1)), word_vocabulary()).columns == ["doc_id", "ids", "x", "decoded"]


def test_reads_that_differ_are_an_error():
    """Other words of the same number in the second read are noticed."""
    from types import SimpleNamespace

    from flowlark.llm import wordblocks as w

    def rows(words):
        block = w._Block()
        block.add(1, words, False, 10)
        return [*w._word_rows(0, block, *block.close(1))], [*w._doc_rows(0, block, *block.close(1))]

    def met(words, docs):
        found, texts = rows(words)[0], rows(docs)[1]
        lines = [(b, 0, p, w._signed(w.checksum(t)), t, b"", None, None, None, None) for b, p, t, _ in found]
        lines += [(b, 1, c, check, None, None, ids, lens, flags, stream) for b, c, check, ids, lens, flags, stream in texts]
        columns = [SimpleNamespace(to_pylist=lambda x=x: list(x)) for x in zip(*lines, strict=True)]
        return list(w.joined([SimpleNamespace(columns=columns)], lambda a, b: a))

    assert len(met(["a", "b"], ["a", "b"])) == 1
    with pytest.raises(ValueError):
        met(["a", "b"], ["a", "c"])
