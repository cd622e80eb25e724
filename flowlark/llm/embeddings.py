"""Embedding near-dedup by Euclidean p-stable hashing, with exact cosine checks.

Vectors scaled to length one are projected on Gaussian directions, quantised, and
bucketed by several projections a table. A bucket holds a bounded number of
unrelated vectors; before a vector moves, sketches of 128 bits (signs of further
projections) are compared within the bucket, and only vectors with a partner that
is near by its sketch are checked exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.bucketjoin import grouped, key_id, members, plausible, resolve, row_key, verify
from flowlark.llm.common import bounded_batches, materialise, release, trimmed

COSINE = 0.9
RECALL = 0.95
WIDTH = 2.5
#: A bucket is expected to hold so many unrelated vectors, whose sketches are compared: more make fewer tables.
STRAY = 128
SKETCH_BITS = 128
#: A pair at the threshold is this many standard deviations within the sketches' bound.
SKETCH_DEVIATIONS = 4.5


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection agrees for two points at a distance."""
    t = width / distance
    phi = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(count: int, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(projections a table, tables): enough projections that few unrelated vectors (at a right angle) share
    a bucket however many there are, and the tables that reach the recall for pairs at the threshold itself.
    Projections grow with the logarithm of the number of vectors, tables with a power of it (about 0.27)."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(count, 2) / STRAY) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def sketch_bound(cosine: float = COSINE) -> int:
    """The bits in which sketches of a pair at the threshold differ at most, but for one pair in about 300,000."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH_BITS * p + SKETCH_DEVIATIONS * math.sqrt(SKETCH_BITS * p * (1 - p)))


def linked(payloads: list[bytes], cosine: float = COSINE, kind: str = "<f8") -> np.ndarray:
    """Matrix of cosine >= the threshold, in double precision; vectors of different length never link."""
    m = len(payloads)
    out = np.zeros((m, m), dtype=bool)
    sizes = np.array([len(p) for p in payloads])
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        x = np.stack([np.frombuffer(payloads[i], dtype=kind) for i in at]).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        out[np.ix_(at, at)] = x @ x.T >= cosine * norm[:, None] * norm[None, :]
    return out


class Projections:
    """Bucket keys and sketches of vectors, with directions drawn once per number of components."""

    def __init__(self, k: int, tables: int, width: float) -> None:
        self.k, self.tables, self.width, self.drawn = k, tables, width, {}

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, d = unit.shape
        if d not in self.drawn:
            r = np.random.default_rng(d)
            shape = (self.tables * self.k, d)
            self.drawn[d] = r.standard_normal(shape), r.uniform(0, self.width, shape[0]), r.integers(1, 2**63, (self.tables, self.k), dtype=np.uint64) | np.uint64(1), r.standard_normal((SKETCH_BITS, d))
        a, shift, mult, signs = self.drawn[d]
        q = np.floor((unit @ a.T + shift) / self.width).astype(np.int64).view(np.uint64).reshape(n, self.tables, self.k)
        h = (q * mult).sum(2, dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h.view(np.int64), np.packbits(unit @ signs.T > 0, axis=1)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding).

    Vectors with equal components are one class and link with each other; other
    links are pairs that share a bucket and have cosine >= the threshold. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing. component_id is the least vec_id reachable by links, null where no
    row of the group has one; a row without links is its own. kept is vec_id =
    component_id. A row is a vector: repeated and null vec_ids count each; extra
    columns are ignored. Vectors of floats move as floats; cosines are taken in
    doubles either way.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "<f4" if single else "<f8"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    k, tables = plan(base.count(), cosine, recall, width)
    schema = "vec_id long, hash binary, buckets array<long>, sketch binary, payload binary"
    types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())

    @trimmed
    def sign(batches):
        project = Projections(k, tables, width)
        for b in batches:
            out: list[list] = [b.column(0).to_pylist(), *([None] * b.num_rows for _ in range(4))]
            lists = b.column(1)
            flat = lists.values.to_numpy(zero_copy_only=False)  # a null component is no number
            starts = np.asarray(lists.offsets)
            size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(starts))
            for d in np.unique(size[size > 0]):
                at = np.flatnonzero(size == d)
                for part in np.array_split(at, -(-len(at) * tables * k // 4_000_000)):
                    x = flat[starts[part][:, None] + np.arange(d)].astype(np.float64)
                    top = np.abs(x).max(1)
                    good = np.isfinite(top) & (top > 0)
                    part, x, top = part[good], x[good], top[good]
                    unit = x / top[:, None]
                    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
                    buckets, sketches = project(unit)
                    # doubles are scaled so that no product over- or underflows, by an exact power of two, so that cosines keep their bits
                    raw = x.astype("<f4") if single else np.ldexp(x, -np.frexp(top)[1][:, None])
                    for i, p, s, v in zip(part.tolist(), buckets, sketches, raw, strict=True):
                        payload = v.tobytes()
                        out[1][i], out[2][i], out[3][i], out[4][i] = hashlib.blake2b(payload, digest_size=16).digest(), p, s.tobytes(), payload
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    signed = materialise(base.mapInArrow(sign, schema), "vectors")
    one = ("buckets", "sketch", "payload")
    classes = signed.where("hash is not null").groupBy("hash").agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id")).alias("least"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in one])
    classes = materialise(classes.select("hash", row_key(F.col("least.vec_id"), F.hex("hash")).alias("key"), "weight", *one), "classes")
    shared = members(classes.select("key", "buckets", F.octet_length("payload").alias("bytes"), "sketch"), carry=("sketch",))
    at = plausible(shared, sketch_bound(cosine))
    links, parts = resolve(verify(at, classes.select("key", "weight", "buckets", "payload"), lambda p: linked(p, cosine, kind)))
    known = grouped(classes, links, parts)
    rows = signed.select("vec_id", F.col("hash").alias("v_hash")).join(known, F.col("v_hash") == F.col("hash"), "left")
    part = F.when(F.col("class_key").isNull(), F.col("vec_id")).otherwise(key_id(F.col("component")))
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), part.alias("component_id"), F.col("vec_id").eqNullSafe(part).alias("kept"))


#: All pairs, exactly: the operator's result where its recall is whole.
SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT r, x, len(x) AS d FROM v
      WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r <> b.r AND a.d = b.d WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a),
c AS (SELECT reach.a, min(v.vec_id) AS least FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a),
o AS (SELECT vec_id, coalesce(links, 0) AS n_links, CASE WHEN n.a IS NULL THEN vec_id ELSE c.least END AS component_id
      FROM v LEFT JOIN n ON v.r = n.a LEFT JOIN c ON v.r = c.a)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""
