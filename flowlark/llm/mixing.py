"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are sorted by
key in ranges of equal key width, the ranges' token sums are turned into offsets,
and a document's prefix sum is its range's offset plus the sum inside the range.
A source is taken whole as often as its target allows and the rest is cut at
exactly the budget. Text is dropped before anything moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.llm.common import WORD_RE

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
#: The recipe (a row per source) is worked out on the driver; more sources than this are an error.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares of total * sum(sizes) by weight; none above most times its size, the excess reshared by weight.

    The sources that are capped are the first in the order of cap / weight, up
    to the first whose cap is not below its share of what is left.
    """
    todo = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    left, weight = total * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for k, i in enumerate(todo):
        cap = most * sizes[i]
        if weight > 0 and left / weight * weights[i] <= cap:
            for j in todo[k:]:
                out[j] = left / weight * weights[j]
            return out
        out[i] = float(cap)
        left -= cap
        weight -= weights[i]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies: one row per row of docs.

    size counts words; taken is how many words the mix takes of the document,
    repeats counted: whole passes over the source, plus, in the order of the
    keys, what fits in the rest of the target, the last document cut. copies is
    the number of times it is in the mix, the cut one counted whole. Sources are
    ordered by code point with null last and weigh weights in turn. A null text
    has size 0, a null doc_id sorts by an empty key, repeated rows count each;
    reruns agree, as keys are MD5 of the doc_id as text.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, 3))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    by_source = ranges.groupBy("source").agg(F.sum("sum").alias("source_size"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in found]
    goals = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], total, most)
    recipe = [(r["source"], s, g, math.floor(g)) for r, s, g in zip(found, sizes, goals, strict=True)]
    recipe = F.broadcast(spark.createDataFrame(recipe, "src string, source_size long, target double, budget long"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most 4,096 ranges a source
    offsets = ranges.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("sum").over(up_to), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    rows = rows.join(recipe, F.col("source").eqNullSafe(F.col("src")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes.cast("long"))
    rows = rows.withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_size") - F.col("offset") - F.col("inside"))
    partly = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + partly).alias("taken"), (F.col("passes") + (F.col("rest") > 0).cast("long")).alias("copies"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY (source IS NULL), source) AS i
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, i) AS k,
         1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM s),
c AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         weights - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_ FROM o),
f AS (SELECT min(k) AS k0 FROM c WHERE left_ / weight_ * w <= cap),
r AS (
  SELECT c.source, c.source_size, CASE WHEN f.k0 IS NULL OR c.k < f.k0 THEN c.cap ELSE g.left_ / g.weight_ * c.w END AS target
  FROM c CROSS JOIN f LEFT JOIN c g ON g.k = f.k0),
p AS (
  SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN (budget // source_size) * size
       + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END AS taken
FROM p
"""
