"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), calls one operator, and works on all that
the stage before it kept; it is written as Parquet and read again before the
next. All but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm import bpe, linededup, mixing, ngramjoin, toxicity
from flowlark.llm.catalog import word_vocabulary
from flowlark.llm.common import materialise, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of at least 0.7 go; the classifier learns from the labelled documents of sf_dir."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="toxicity_").where(F.col("toxicity_") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents are taken out; documents stay, n_chars follows the text."""
    clean = linededup.drop_boilerplate(docs)
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return clean.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard of 0.8 or more on five-word grams, that with the least doc_id stays (nulls last, then the least hash of its columns), once.

    A row is told apart by its doc_id and a hash of all its columns, so a repeated or null doc_id neither links rows nor
    drops them, and rows that agree in all columns are one.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    key = ngramjoin.text_key(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")), *(others or [F.lit(0)]))
    rows = docs.withColumn("row_", key)
    found = ngramjoin.groups(rows.select(F.col("row_").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text")))
    kept = found.where("key = component").select(F.col("key").alias("row_")).distinct()
    return rows.join(kept, "row_", "left_semi").dropDuplicates(["row_"]).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for (the one at the cut is taken whole): 0, 1 or 2 rows."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")).agg(F.max("copies").alias("copies")).where("copies > 0")
    size = mixing.word_count(F.col("text"))
    rows = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (size == F.col("m_size")))
    return rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: 32-bit little-endian) and the text they decode to, a row per row."""
    path = word_vocabulary()
    out = bpe.decode(bpe.encode(docs, path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("mix_sources", mix_to_weights),
    ("bpe", encode_and_decode),
]

#: The first stage's classifier has no SQL; tests hold the other stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
