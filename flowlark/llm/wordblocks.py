"""Distinct-word tables for texts too many to shuffle word by word.

A task reads its share of the documents as blocks of bounded size. A block has a
list of its distinct words and, per document, the positions of its words in that
list. The lists are dealt by a hash of the word (so that all blocks' copies of a
word meet and it is handled once), what was found for the words goes back to the
blocks, and joins the documents by position. Only distinct words per block are
shuffled, and packed: a row holds all words of one block and one hash part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import bounded_batches, materialise, trimmed, words_of

BLOCK_CHARS = 32_000_000
CHUNK_WORDS = 65_536

WORDS_SCHEMA = "block long, part int, words binary, counts binary"
DOCS_SCHEMA = "block long, chunk int, check long, ids binary, lens binary, flags binary, stream binary"


def pack_ints(a: np.ndarray) -> bytes:
    """Non-negative 32-bit integers, byte planes apart, compressed."""
    planes = a.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Block:
    def __init__(self) -> None:
        from collections import defaultdict

        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.ids: list[int] = []
        self.flags: list[bool] = []
        self.seqs: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int, words: list[str], flag: bool, chars: int) -> None:
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.seqs.append(np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words)))
        self.chars += chars

    def close(self, parts: int):
        """Words ordered by part (then by first use), where each part starts, and all documents' positions in that order."""
        words = list(self.index)
        part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        flat = place[np.concatenate(self.seqs)] if words else np.zeros(0, dtype=np.int64)
        return [words[i] for i in order], part[order], flat


def _blocks(batches, split, chars: int):
    """Blocks of consecutive rows: (block number, block). Columns: partition, id, text, flag."""
    n, now, where = 0, _Block(), 0
    for b in batches:
        for p, i, text, flag in zip(*(c.to_pylist() for c in b.columns), strict=True):
            where = p
            now.add(i, split(text), flag, len(text))
            if now.chars >= chars:
                yield (where << 24) | n, now
                n, now = n + 1, _Block()
    if now.ids:
        yield (where << 24) | n, now


def _base(docs: DataFrame, flag) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.spark_partition_id().alias("p"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(flag, F.lit(False)).alias("flag"))


TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def record_batch(rows: list[tuple], schema: str):
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def checksum(blob: bytes) -> int:
    """A hash of one part's words; the sum over a block's parts (with wrapping) tells whether two reads gave the same words."""
    return xxhash.xxh64_intdigest(blob)


def _signed(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _cuts(part: np.ndarray):
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(cuts, [*cuts[1:], len(part)], strict=True)


def _word_rows(block: int, now: _Block, words, part, flat):
    """(block, part, words, counts) for each part that has words."""
    sizes = np.fromiter(map(len, now.seqs), dtype=np.int64, count=len(now.seqs))
    counts = np.bincount(flat, weights=np.repeat(np.array(now.flags), sizes), minlength=len(words)).astype("<i4")
    for a, z in _cuts(part):
        yield block, int(part[a]), "\n".join(words[a:z]).encode(), counts[a:z].tobytes()


def _doc_rows(block: int, now: _Block, words, part, flat):
    """(block, chunk, check, ids, lens, flags, stream) for chunks of documents."""
    check = _signed(sum(checksum("\n".join(words[a:z]).encode()) for a, z in _cuts(part)))
    sizes = np.fromiter(map(len, now.seqs), dtype=np.int64, count=len(now.seqs))
    ends = np.cumsum(sizes)
    a, chunk = 0, 0
    while a < len(sizes):
        start = ends[a] - sizes[a]
        z = max(a + 1, int(np.searchsorted(ends, start + CHUNK_WORDS, side="right")))
        null = np.array([i is None for i in now.ids[a:z]], dtype=np.uint8)
        ids = np.array([i or 0 for i in now.ids[a:z]], dtype="<i8")
        yield block, chunk, check, ids.tobytes(), sizes[a:z].astype("<i4").tobytes(), (np.array(now.flags[a:z], dtype=np.uint8) | (null << 1)).tobytes(), pack_ints(flat[start : ends[z - 1]])
        a, chunk = z, chunk + 1


def _in_batches(rows, schema: str, most: int):
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield record_batch(held, schema)
            held = []
    if held:
        yield record_batch(held, schema)


def block_words(docs: DataFrame, parts: int, split=words_of, flag=None, chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per block and part: its words joined by newlines, and how often each is in flagged documents."""

    @trimmed
    def run(batches):
        for block, now in _blocks(batches, split, chars):
            yield from _in_batches(_word_rows(block, now, *now.close(parts)), WORDS_SCHEMA, 64)

    return _base(docs, F.lit(False) if flag is None else flag).mapInArrow(run, WORDS_SCHEMA)


def block_docs(docs: DataFrame, parts: int, split=words_of, flag=None, chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of a block's documents: ids, word counts, flags, and the words' positions in the block's list, in chunks.

    Must see the same rows in the same tasks as block_words did: docs has to be
    a plain read of a table. What joins the two checks that the words agree.
    """

    @trimmed
    def run(batches):
        for block, now in _blocks(batches, split, chars):
            yield from _in_batches(_doc_rows(block, now, *now.close(parts)), DOCS_SCHEMA, 1)

    return _base(docs, F.lit(False) if flag is None else flag).mapInArrow(run, DOCS_SCHEMA)


def block_tables(docs: DataFrame, parts: int, split=words_of, flag=None, chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """What block_words and block_docs give, from one read of docs, written to the shared folder (about half the size of the texts)."""
    schema = WORDS_SCHEMA + ", " + DOCS_SCHEMA.partition(", ")[2]

    @trimmed
    def run(batches):
        for block, now in _blocks(batches, split, chars):
            words, part, flat = now.close(parts)
            yield from _in_batches(((*r, *[None] * 6) for r in _word_rows(block, now, words, part, flat)), schema, 64)
            yield from _in_batches(((r[0], None, None, None, *r[1:]) for r in _doc_rows(block, now, words, part, flat)), schema, 1)

    both = materialise(_base(docs, F.lit(False) if flag is None else flag).mapInArrow(run, schema), "blocks")
    return both.where("part is not null").select("block", "part", "words", "counts"), both.where("part is null").select("block", "chunk", "check", "ids", "lens", "flags", "stream")


def meet(found: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Bring what was found for each (block, part) to its block's documents: one exchange by block, words before documents.

    found has block, part, check (the checksum() of the words, signed), and binary columns a and b.
    """
    left = found.select("block", F.lit(0).alias("kind"), F.col("part").alias("at"), "check", "a", "b", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "lens", "flags", "stream")])
    right = docs.select("block", F.lit(1).alias("kind"), F.col("chunk").alias("at"), "check", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "ids", "lens", "flags", "stream")
    return left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "kind", "at")


def joined(batches, build):
    """Over rows of meet(): yields (build(a parts, b parts), ids, flags, sizes, positions) for each chunk of documents."""
    at, a, b, table, total = None, [], [], None, 0
    for batch in batches:
        for block, kind, _, check, x, y, ids, lens, flags, stream in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != at:
                at, a, b, table, total = block, [], [], None, 0
            if kind == 0:
                a.append(x)
                b.append(y)
                total += check
                continue
            if table is None:
                if _signed(total) != check:
                    raise ValueError("two reads of the documents differ; write them as a table first")
                table = build(a, b)
                a, b = [], []
            yield table, np.frombuffer(ids, dtype="<i8"), np.frombuffer(flags, dtype=np.uint8), np.frombuffer(lens, dtype="<i4").astype(np.int64), unpack_ints(stream)
