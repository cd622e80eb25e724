"""Similarity join over hash buckets without listing a bucket's pairs.

Items come with a unique binary key and one bucket per hash table. Items that
share a bucket are verified together: a bucket is cut in blocks of bounded rows
and bytes, every pair of blocks is a tile, a tile is one small all-against-all on
the items' payloads, and all that leaves it is a count per item and the least
item it is connected to. So a bucket of any size is spread over many tasks, and
rows grow with items times blocks. Buckets with the same members in several
tables are kept once; a pair that meets in several buckets counts in the first
table where it does.

Keys order as (doc_id, tie), so that the least key of a component is that of its
least doc_id; rows of equal doc_id are told apart by the tie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import bounded_batches, materialise, release, shuffle_partitions, trimmed

#: Most items of a block, and the payload bytes of a block (one item may have more).
TILE = 512
TILE_BYTES = 8 << 20
TILE_KEYS = ("band", "bucket", "lo", "hi")
_TILE_SCHEMA = "key binary, band int, bucket long, lo int, hi int, own int"


def row_key(row_id: Column, tie: Column) -> Column:
    """25 bytes that order as (id with null last, tie): the id's with its sign bit flipped, and a hash of 16 (as hexadecimal digits)."""
    eight = F.lpad(F.hex(row_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.unhex(F.concat(F.when(row_id.isNull(), F.lit("01" + 16 * "0")).otherwise(F.concat(F.lit("00"), eight)), tie))


def key_id(key: Column) -> Column:
    """The id in a row_key()."""
    bits = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(F.substring(key, 1, 1) == F.unhex(F.lit("00")), bits.cast("long"))


def members(keyed: DataFrame, tile: int | None = None, tile_bytes: int = TILE_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, band, bucket, lo, hi, own and the carried columns: a row for each tile of each item that shares a bucket.

    keyed: key binary (unique), buckets array<long> (one a band), bytes long
    (the payload's size). Null buckets are skipped.
    """
    tile = tile or TILE
    one = keyed.select("key", "bytes", *carry, F.posexplode("buckets").alias("band", "bucket")).where("bucket is not null")
    # keys are unique, so that two independent XORs tell sets of members apart
    sizes = one.groupBy("band", "bucket").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
    )
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / tile_bytes)).cast("int")
    first = sizes.where("n > 1").groupBy("x", "y", "n").agg(F.min(F.struct("band", "bucket", blocks.alias("blocks"))).alias("f")).select("f.*")
    rows = one.drop("bytes").join(first, ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", "band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *carry)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each tile in one task, its rows by key."""
    bounded_batches(rows.sparkSession)
    return rows.repartition(shuffle_partitions(rows.sparkSession), *TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "key")


def _tiles(batches):
    """(tile, rows by key) of batches whose first columns are those of TILE_KEYS; rows are (own, key, ...)."""
    tile, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tile != row[:4]:
                if len(held) > 1:
                    yield tile, held
                tile, held = row[:4], []
            held.append(row[4:])
    if len(held) > 1:
        yield tile, held


def plausible(rows: DataFrame, most: int) -> DataFrame:
    """The rows of members() that have a partner in their tile whose sketch (binary, carried) differs in at most so many bits."""

    @trimmed
    def run(batches):
        out: list[tuple] = []
        for tile, held in _tiles(batches):
            own, keys, sketches = zip(*held, strict=True)
            bits = np.frombuffer(b"".join(sketches), dtype="<u8").reshape(len(held), -1)
            far = np.zeros((len(held), len(held)), dtype=np.uint16)
            for word in bits.T:
                far += np.bitwise_count(word[:, None] ^ word[None, :])
            near = far <= most
            np.fill_diagonal(near, False)
            if tile[2] != tile[3]:
                side = np.array(own)
                near &= side[:, None] != side[None, :]
            out += [(keys[i], *tile, own[i]) for i in np.flatnonzero(near.any(1))]
            if len(out) > 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    types = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["key", *TILE_KEYS, "own"]
    _batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    return _dealt(rows.select(*TILE_KEYS, "own", "key", "sketch")).mapInArrow(run, _TILE_SCHEMA)


def verify(rows: DataFrame, items: DataFrame, linked: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """key, links, root: per tile and linked item, the weight of its links there and the least key it is connected to.

    rows: those of members(). items: key, weight long, buckets, payload binary.
    linked(payloads) gives the symmetric matrix of true links.
    """

    def solve(tile, held):
        own, keys, weights, buckets, payloads = zip(*held, strict=True)
        m = linked(list(payloads))
        np.fill_diagonal(m, False)
        if not m.any():
            return []
        root = np.arange(len(held))
        while True:
            new = np.minimum(root, np.where(m, root[None, :], len(held)).min(1))
            if (new == root).all():
                break
            root = new
        if tile[2] != tile[3]:  # two blocks: pairs inside one of them count in its own tile
            side = np.array(own)
            m &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(m))
        links = np.zeros(len(held), dtype=np.int64)
        if len(i):
            k, weight = np.array(buckets, dtype=np.int64), np.array(weights, dtype=np.int64)
            for a in range(0, len(i), 20_000):
                p, q = i[a : a + 20_000], j[a : a + 20_000]
                new = (k[p] == k[q]).argmax(1) == tile[0]
                np.add.at(links, p[new], weight[q[new]])
                np.add.at(links, q[new], weight[p[new]])
        return [(keys[a], int(links[a]), keys[root[a]]) for a in np.flatnonzero((links > 0) | (root < np.arange(len(held))))]

    @trimmed
    def run(batches):
        out: list[tuple[bytes, int, bytes]] = []
        for tile, held in _tiles(batches):
            out += solve(tile, held)
            if len(out) > 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    _batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["key", "links", "root"])
    both = rows.join(items, "key").select(*TILE_KEYS, "own", "key", "weight", "buckets", "payload")
    return _dealt(both).mapInArrow(run, "key binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """key and component (the least key reachable) of every key in edges (key, root) but the components' own: alternating large and small stars.

    Each round is a few joins on edges, written to the shared folder; rounds grow
    with the logarithm of the longest path. A hub's edges are joined, never
    gathered: the least neighbours come to the join in an exchange of their own
    (their key is made anew), so that both sides are exchanges, which is what
    adaptive execution needs to deal one key's edges over many tasks.
    """
    anew = lambda c: F.concat(F.col(c), F.lit(b"")).alias("k")
    now = edges.select(F.greatest("key", "root").alias("a"), F.least("key", "root").alias("b")).where("a <> b").distinct()
    now = materialise(now, "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    was = mark(now)
    while was[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(anew("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.select(anew("a"), "m"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        release(now, large)
        now, mk = after, mark(after)
        if mk == was:
            break
        was = mk
    return now.select(F.col("a").alias("key"), F.col("b").alias("component"))


def resolve(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From verify()'s rows: links per key, and component per key."""
    found = materialise(found, "links")
    return found.groupBy("key").agg(F.sum("links").alias("links")), components(found.select("key", "root"))


def grouped(classes: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """hash, key, links, component of every class (hash, key, weight): links count other rows, copies too."""
    links, parts = links.withColumnsRenamed({"key": "l_key"}), parts.withColumnsRenamed({"key": "p_key"})
    known = classes.select("hash", "key", "weight").join(links, F.col("key") == F.col("l_key"), "left").join(parts, F.col("key") == F.col("p_key"), "left")
    return known.select("hash", F.col("key").alias("class_key"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "key").alias("component"))
