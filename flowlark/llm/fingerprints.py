"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where pieces end: a piece ends
wherever the hash has at least ``k`` trailing zero bits, so that boundaries
depend on the bytes around them alone and those of block size 2**(k+1) are a
subset of those of 2**k; a piece without a boundary is cut after four block
sizes. Each piece gives one 12-bit token (two characters). The fingerprint is
``k:tokens at k:tokens at k+1``; k is the least with 2**k >= length / 64. Two fingerprints are compared at a block size both have, by the
insert/delete distance of their token sequences.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlark.llm.common import bounded_batches, shuffle_partitions

WINDOW = 7
MAX_PIECES = 64
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_MULT = np.uint32(0x9E3779B1)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the seven bytes that end at each position (zeros stand before the first)."""
    x = np.zeros(len(data) + WINDOW - 1, dtype=np.uint32)
    x[WINDOW - 1 :] = data
    x += np.uint32(1)
    h = np.zeros(len(data), dtype=np.uint32)
    for i in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += x[i : i + len(data)]
    h ^= h >> np.uint32(15)
    h *= _MULT
    h ^= h >> np.uint32(13)
    return h


def _tokens(h: np.ndarray, ends: np.ndarray) -> str:
    """One token a piece, from the sum of its positions' mixed hashes."""
    starts = np.empty(len(ends), dtype=np.int64)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    mixed = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    sums = np.add.reduceat(mixed, starts, dtype=np.uint32)
    sums ^= sums >> np.uint32(16)
    sums *= np.uint32(0xC2B2AE35)
    sums >>= np.uint32(20)
    out = np.empty((len(sums), 2), dtype=np.uint8)
    out[:, 0] = _CHARS[sums >> np.uint32(6)]
    out[:, 1] = _CHARS[sums & np.uint32(63)]
    return out.tobytes().decode("ascii")


def fingerprint(data: bytes) -> str:
    """The fingerprint of the whole of data; '0::' for none."""
    if not data:
        return "0::"
    h = _rolling(np.frombuffer(data, dtype=np.uint8))
    k = (-(-len(h) // MAX_PIECES) - 1).bit_length()  # 2**k >= length / 64: 64 pieces at most are expected
    at = np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)
    while len(at) > 4 * MAX_PIECES:  # a short pattern repeated, with a boundary in it
        k += 1
        at = at[(h[at] & np.uint32((1 << k) - 1)) == 0]
    nxt = at[(h[at] & np.uint32((2 << k) - 1)) == 0]
    return f"{k}:{_tokens(h, _close(at, len(h), 4 << k))}:{_tokens(h, _close(nxt, len(h), 8 << k))}"


def _close(ends: np.ndarray, n: int, longest: int) -> np.ndarray:
    """ends with the last position added, and with cuts in pieces longer than the longest allowed (a pattern without a boundary)."""
    if not len(ends) or ends[-1] != n - 1:
        ends = np.append(ends, n - 1)
    before = np.concatenate(([-1], ends[:-1]))
    long = np.flatnonzero(ends - before > longest)
    if not len(long):
        return ends
    return np.unique(np.concatenate([ends, *(np.arange(before[i] + longest, ends[i], longest) for i in long)]))


def _ratio(a: str, b: str) -> float:
    """1 - insert/delete distance / total length, in tokens of two characters (bit-parallel LCS)."""
    if a == b:
        return 1.0
    n, m = len(a) // 2, len(b) // 2
    if not n or not m:
        return 0.0
    where: dict[str, int] = {}
    for i in range(n):
        t = a[2 * i : 2 * i + 2]
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << n) - 1
    s = full
    for i in range(0, 2 * m, 2):
        p = where.get(b[i : i + 2])
        if p is not None:
            u = s & p
            s = ((s + u) | (s - u)) & full
    return 2.0 * (n - s.bit_count()) / (n + m)


def likeness(a: str, b: str) -> float:
    """From 0 (nothing in common, or no block size in common) to 1 (equal fingerprints)."""
    if a == b:
        return 1.0
    ka, a1, a2 = a.split(":")
    kb, b1, b2 = b.split(":")
    d = int(ka) - int(kb)
    if d == 0:
        return max(_ratio(a1, b1), _ratio(a2, b2))
    if d == 1:
        return _ratio(a1, b2)
    if d == -1:
        return _ratio(a2, b1)
    return 0.0


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df plus the fingerprint of each whole text (null counts as empty). Equal texts get equal fingerprints."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            fps = [fingerprint((t or "").encode()) for t in b.column(i).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.string())], names=[*b.schema.names, out])

    df = df.select([F.col(f"`{c}`") for c in df.columns if c != out])
    i = df.columns.index(text)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


_PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, nxt: str) -> str:
    h = len(text) // 2
    return text[: len(text) - h] + nxt[:h]


def _compare(batches):
    """Rows come sorted by (bucket, borrowed, descending doc_id): each meets its successor; a borrowed row only closes its bucket."""
    names = [x.split()[0] for x in _PAIR_SCHEMA.split(", ")]
    held = None  # bucket, doc_id, text, fingerprint
    for b in batches:
        out: list[tuple] = []
        for bucket, borrowed, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fp = fingerprint(text.encode())
            if held is not None:
                if held[0] != bucket:
                    raise ValueError("a bucket ended without the row that follows it")
                raw = _edit(held[2], text).encode()
                efp = fingerprint(raw)
                out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), held[3], efp, likeness(held[3], efp), likeness(held[3], fp)))
            held = None if borrowed else (bucket, doc_id, text, fp)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)
    if held is not None:
        raise ValueError("a bucket ended without the row that follows it")


def _range_of(col, cuts: list[int]):
    """How many of the sorted cuts are <= col: a search in two levels, as an expression."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)
    count = lambda a: F.array_size(F.filter(a, lambda c: c <= col))
    top = count(F.lit([g[0] for g in groups]))
    fine = count(F.element_at(F.array(*[F.lit(g) for g in groups]), F.greatest(top, F.lit(1))))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * step + fine)


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, whose second half is taken from the next document.

    The next document is the next in descending doc_id, that of the last is the
    first. Rows with equal doc_id follow each other by text hash; a null doc_id
    comes last; a null text is empty; an empty table gives no rows; other columns
    are ignored. There is no global sort: doc_ids fall in ranges cut at
    approximate quantiles, each range borrows the first row of the range that
    follows it, and a range is streamed once, holding one row at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = buckets or 4 * shuffle_partitions(spark)
    cuts = (base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20_000)).first()[0] or []) if n > 1 else []
    base = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(_range_of(F.col("doc_id"), sorted(set(cuts)))).cast("int"))
    tops = {r["bucket"]: r["top"] for r in base.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    if not tops:
        return spark.createDataFrame([], _PAIR_SCHEMA)
    order = sorted(tops, reverse=True)
    # what follows a range is the next lower one; what follows the lowest is the highest. One row a range: at most n + 1 rows.
    lend = [(order[(i + 1) % len(order)], tops[order[(i + 1) % len(order)]], b) for i, b in enumerate(order)]
    lent = F.broadcast(spark.createDataFrame(lend, "owner int, top long, borrower int"))
    own = F.struct("bucket", F.lit(False).alias("borrowed"))
    loan = F.struct(F.col("borrower").alias("bucket"), F.lit(True).alias("borrowed"))
    rows = base.join(lent, (F.col("bucket") == F.col("owner")) & F.col("doc_id").eqNullSafe(F.col("top")), "left")
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("borrower").isNull(), F.array(own)).otherwise(F.array(own, loan))).alias("at"))
    rows = rows.select(F.col("at.bucket").alias("bucket"), F.col("at.borrowed").alias("borrowed"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "borrowed", F.desc_nulls_last("doc_id"), "tie", "text")
    return rows.select("bucket", "borrowed", "doc_id", "text").mapInArrow(_compare, _PAIR_SCHEMA)
