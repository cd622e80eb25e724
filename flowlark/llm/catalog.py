"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm import bpe, embeddings, fingerprints, linededup, lm, mixing, ngramjoin, pii, toxicity, warc
from flowlark.llm.common import materialise, table


def word_vocabulary() -> str:
    """The public word vocabulary that the registered queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = word_vocabulary()
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.with_revisits(table(spark, sf_dir, "pages"))
    archives = materialise(warc.write_archives(pages), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_warc_archives": op3_warc_archives,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_personal_data": op8_personal_data,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLES: dict[str, str] = {
    "op3_warc_archives": warc.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_line_dedup": linededup.SQL,
    "op9_ngram_jaccard_join": ngramjoin.SQL,
    "op10_embedding_near_dedup": embeddings.SQL,
}
