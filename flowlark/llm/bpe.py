"""BPE encoding and decoding with a distinct-word table.

Texts are split at ASCII blanks, which never stand inside a token of the word
vocabulary, so a text's ids are the ids of its words in turn. Each distinct word
is encoded once, in the one task its hash leads to; its ids go back to the
blocks of documents that have it and join the documents by position. Decoding
joins the ids to the table of pieces (id, piece) on the id: the table has the
vocabulary's size and an entry for every id, so each task holds it whole and a
batch's ids meet their pieces in one gather.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlark.llm.common import bounded_batches, shuffle_partitions, trimmed
from flowlark.llm.wordblocks import BLOCK_CHARS, block_docs, block_words, checksum, joined, meet, record_batch


def _tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str) -> list[str]:
    """The piece of each id, from 0 on."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    by_id = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i, "") for i in range(max(by_id) + 1)]


def _check(path: str) -> str:
    spec = Path(path).read_text(encoding="utf-8")
    parsed = json.loads(spec)
    if parsed.get("decoder") is not None or parsed.get("post_processor") is not None or max(parsed["model"]["vocab"].values()) > 65_535:
        raise ValueError("a word vocabulary of at most 65,536 ids without decoder and post-processor is needed")
    return spec


def encode(docs: DataFrame, path: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (binary: 32-bit little-endian unsigned integers) of each whole text, one row per row of docs.

    A null or blank text has no ids; a null doc_id stays null; repeated rows
    each get a row; other columns are ignored. docs has to be a plain read of a
    table, as it is read twice and must give the same tasks the same rows.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(_check(path))  # the size of the vocabulary file
    parts = max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    schema = "block long, part int, check long, a binary, b binary"

    @trimmed
    def words(batches):
        tok = _tokenizer(spec.value)
        at, known = None, {}
        for batch in batches:
            out = []
            for block, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, known = part, {}
                found = text.decode().split("\n")
                new = [w for w in found if w not in known]
                for w, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, dtype="<u2").tobytes()
                got = [known[w] for w in found]
                check = int(np.uint64(checksum(text)).view(np.int64))
                out.append((block, part, check, np.fromiter(map(len, got), dtype="<u4", count=len(got)).tobytes(), b"".join(got)))
            if out:
                yield record_batch(out, schema)

    def build(a, b):
        sizes = np.frombuffer(b"".join(a), dtype="<u4").astype(np.int64) // 2
        return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(b), dtype="<u2")

    @trimmed
    def assemble(batches):
        for (sizes, starts, flat), ids, flags, n_words, at in joined(batches, build):
            size = sizes[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            got = flat[np.repeat(starts[at] - (ends - size), size) + np.arange(total)].astype("<u4")
            words_end = np.cumsum(n_words)
            ends = np.concatenate(([0], ends))
            doc_end = ends[words_end]
            doc_start = ends[words_end - n_words]
            raw = got.tobytes()
            out = [raw[4 * a : 4 * z] for a, z in zip(doc_start.tolist(), doc_end.tolist(), strict=True)]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256], pa.int64(), mask=(flags[i : i + 256] & 2).astype(bool)), pa.array(out[i : i + 256], pa.binary())], names=["doc_id", "ids"])

    found = block_words(docs, parts, chars=chars).select("block", "part", "words").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(words, schema)
    return meet(found, block_docs(docs, parts, chars=chars), parts).mapInArrow(assemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for: their pieces in turn, a space between (as the library decodes without a decoder).

    Null ids give a null text, no ids an empty one. An id outside the vocabulary is an error.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    table = spark.sparkContext.broadcast(pieces(path))  # one row an id: the size of the vocabulary
    df = encoded.select([F.col(f"`{c}`") for c in encoded.columns if c != out])
    i = df.columns.index(ids)

    @trimmed
    def run(batches):
        piece = pa.array(table.value, pa.string())
        for b in batches:
            blobs = b.column(i).to_pylist()
            sizes = np.fromiter((len(x or b"") // 4 for x in blobs), dtype=np.int64, count=len(blobs))
            found = piece.take(pa.array(np.frombuffer(b"".join(x or b"" for x in blobs), dtype="<u4")))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), found)
            texts = pc.if_else(b.column(i).is_null(), None, pc.binary_join(lists, " "))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))
