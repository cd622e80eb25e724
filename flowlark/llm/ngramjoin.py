"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.bucketjoin import grouped, key_id, members, resolve, row_key, verify
from flowlark.llm.common import WORD_RE, bounded_batches, materialise, release, trimmed, words_of

N = 5
SIMILARITY = 0.8
RECALL = 0.999
MAX_HASHES = 128
#: A task remembers the hashes of so many words.
CACHE = 300_000


def bands_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which some number of bands, with at most `most` hashes, reaches the recall at the threshold."""
    for rows in range(most, 0, -1):
        p = similarity**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-p))) if p < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(text: str, n: int = N, hashes: dict | None = None) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's word n-grams; a text of fewer words has one gram of all, a blank one none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - k + 1 + i]
    return np.unique(_mix(out + np.uint64(k)))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**64, count, dtype=np.uint64)


def band_keys(grams: np.ndarray, bands: int, rows: int, perm) -> np.ndarray:
    """One 64-bit key a band."""
    a, b = perm
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[s : s + 2048, None] * a + b).min(0))
    key = np.zeros(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        key = _mix((key + row) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return key.view(np.int64)


def linked(payloads: list[bytes], similarity: float = SIMILARITY) -> np.ndarray:
    """Matrix of Jaccard >= similarity between sets (sorted 64-bit hashes)."""
    sets = [np.frombuffer(p, dtype=np.uint64) for p in payloads]
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if m <= 3:
        both = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size.astype(np.int64))
        both = np.full((m, m), float((n == m).sum()))
        use = (n > 1) & (n < m)  # grams of one set match nothing, grams of all sets match everywhere
        place = np.cumsum(use) - 1
        keep = use[col]
        row, col = row[keep], place[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for a in range(0, int(use.sum()), 4096):
            s, e = np.searchsorted(col, (a, a + 4096))
            x = np.zeros((m, 4096), dtype=np.float32)
            x[row[s:e], col[s:e] - a] = 1
            both += x @ x.T
    union = size[:, None] + size[None, :] - both
    return both >= similarity * union - 1e-9


def groups(rows: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """key, n_grams, class_key, links, component: one row per row of rows (key from row_key() with a hash of the text in its tie, text).

    Rows with equal n-gram sets are one class (class_key: its least key). Links
    are pairs with Jaccard >= similarity found by banding at the given recall and
    verified on whole sets; links counts linked other rows, copies included;
    component is the least key reachable by links. Sets are made twice: for the
    signatures of every row, and for the rows that stand for a class in a shared
    bucket, whose texts are all that moves.
    """
    bounded_batches(rows.sparkSession)
    bands, width = bands_rows(similarity, recall)
    rows = rows.select("key", "text")

    @trimmed
    def sign(batches):
        hashes, perm = _Hashes(), _permutations(bands * width)
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = shingles(t, n, hashes)
                out.append((k, len(g), hashlib.blake2b(g.tobytes(), digest_size=16).digest(), band_keys(g, bands, width, perm) if len(g) else None))
            cols = list(zip(*out, strict=True))
            types = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "n_grams", "hash", "buckets"])

    @trimmed
    def sets(batches):
        hashes = _Hashes()
        for b in batches:
            grams = [shingles(t, n, hashes).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], names=["key", "payload"])

    signed = materialise(rows.mapInArrow(sign, "key binary, n_grams long, hash binary, buckets array<long>"), "signatures")
    classes = signed.groupBy("hash").agg(F.min("key").alias("key"), F.count("*").alias("weight"), F.first("buckets").alias("buckets"), F.first("n_grams").alias("n_grams"))
    classes = materialise(classes, "classes")
    at = materialise(members(classes.where("buckets is not null").select("key", "buckets", (F.col("n_grams") * 8).alias("bytes"))), "members")
    # the texts meet the narrow table of members by key, whose every row is of one text: equal keys are repeated rows
    texts = rows.join(at.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    items = classes.select("key", "weight", "buckets").join(texts.mapInArrow(sets, "key binary, payload binary"), "key")
    links, parts = resolve(verify(at, items, lambda p: linked(p, similarity)))
    release(at)
    known = grouped(classes, links, parts)
    return signed.select("key", "n_grams", F.col("hash").alias("s_hash")).join(known, F.col("s_hash") == F.col("hash")).select("key", "n_grams", "class_key", "links", "component")


def text_key(doc_id: Column, text: Column, *more: Column) -> Column:
    """row_key() of a document; more columns tell apart rows that agree in both."""
    tie = F.md5(text.cast("binary"))
    return row_key(doc_id.cast("long"), F.md5(F.concat(tie, F.to_json(F.struct(*more))).cast("binary")) if more else tie)


def near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, n_grams, class_id, n_links, component_id, kept: one row per row of docs.

    Documents with equal n-gram sets are one class (class_id: its least doc_id).
    Links are pairs with Jaccard >= similarity found by banding at the given
    recall and verified on whole sets; n_links counts linked other documents,
    copies included; component_id is the least doc_id reachable by links; kept
    marks the row of component_id whose text (by MD5) is the least of its
    component's, repeats of that row included. Texts without words, null ones
    too, are one class without links to others. A document is a row: a repeated
    doc_id neither links rows nor hides links, and null doc_ids come last, so
    that an id of null is that of a group without any doc_id. Extra columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = groups(docs.select(text_key(F.col("doc_id"), text).alias("key"), text.alias("text")), n, similarity, recall)
    return out.select(key_id(F.col("key")).alias("doc_id"), "n_grams", key_id(F.col("class_key")).alias("class_id"), F.col("links").alias("n_links"), key_id(F.col("component")).alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


#: All pairs that share a gram, exactly: the operator's result where its recall is whole.
SQL = f"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS tie, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w FROM documents),
s AS (SELECT r, doc_id, tie, list_sort(list_distinct([array_to_string(w[i : i + least({N}, len(w)) - 1], ' ') for i in range(1, greatest(len(w) - {N} + 1, least(len(w), 1)) + 1)])) AS g FROM p),
h AS MATERIALIZED (SELECT r, doc_id, tie, len(g) AS n_grams, md5(array_to_string(g, chr(10))) AS k, g FROM s),
k AS MATERIALIZED (SELECT k, any_value(g) AS g, any_value(n_grams) AS n, count(*) AS weight, min(doc_id) AS class_id FROM h GROUP BY k),
f AS MATERIALIZED (SELECT k, n, unnest(g) AS gram FROM k),
j AS (SELECT a.k AS a, b.k AS b, a.n + b.n - count(*) AS whole, count(*) AS common FROM f a JOIN f b ON a.gram = b.gram AND a.k < b.k AND a.n <= b.n / {SIMILARITY} + 1 AND b.n <= a.n / {SIMILARITY} + 1 GROUP BY a.k, a.n, b.k, b.n),
y AS (SELECT a, b FROM j WHERE common >= {SIMILARITY} * whole - 1e-9),
l AS MATERIALIZED (SELECT a, b FROM y UNION ALL SELECT b, a FROM y),
reach AS (SELECT k AS a, k AS b FROM k UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT l.a, sum(k.weight) AS links FROM l JOIN k ON l.b = k.k GROUP BY l.a),
m AS (SELECT a, min(b) AS part FROM reach GROUP BY a),
d AS (SELECT h.doc_id, h.n_grams, k.class_id, k.weight - 1 + coalesce(n.links, 0) AS n_links,
             min(h.doc_id) OVER (PARTITION BY m.part) AS component_id, rank() OVER (PARTITION BY m.part ORDER BY h.doc_id NULLS LAST, h.tie) = 1 AS kept
      FROM h JOIN k ON h.k = k.k JOIN m ON h.k = m.a LEFT JOIN n ON h.k = n.a)
SELECT doc_id, n_grams, class_id, n_links::BIGINT AS n_links, component_id, kept FROM d
"""
