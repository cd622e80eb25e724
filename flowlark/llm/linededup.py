"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host if more than max_ratio of the host's pages have
it. Lines are counted once a page, as MD5 of the line without outer spaces;
blank lines are never counted or dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import materialise

MAX_RATIO = 0.1
#: A line on one page only is no repeat, however few pages the host has.
MIN_PAGES = 2
#: Up to so many boilerplate lines (32-byte hashes) in all, the hosts' lists are broadcast; beyond, they are joined by host,
#: where AQE splits a hot host's pages.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    return F.md5(F.trim(line).cast("binary"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (MD5), pages, total: the lines on more than max_ratio of the host's pages, and on min_pages at least."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _key))
    counts = pages.select(F.col(host).alias("host"), F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("t_host")).agg(F.count("*").alias("total"))
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host")))
    return found.where(F.col("pages") > F.lit(max_ratio) * F.col("total")).select("host", "line", "pages", "total")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with the host's boilerplate lines taken out of text, plus n_lines and n_dropped.

    Pages whose host is null form a host of their own. A null text stays null
    (no lines), an empty one is one blank line; repeated rows are pages each;
    other columns pass. A host has at most (lines a page on average) / max_ratio
    boilerplate lines, so its list is bounded however many pages it has.
    """
    found = materialise(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    lists = found.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__drop"))
    if found.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    rows = pages.join(lists, F.col(f"`{host}`").eqNullSafe(F.col("__host")), "left")
    lines = F.split(text, "\n")
    # the page's own boilerplate first, by a hash set: each line is then looked for among the few that the page has
    rows = rows.withColumn("__hit", F.when(F.col("__drop").isNotNull(), F.array_intersect(F.transform(lines, _key), "__drop")))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__hit"), _key(x)))
    rows = rows.withColumn("__lines", F.coalesce(F.array_size(lines), F.lit(0))).withColumn("__kept", F.when(F.array_size("__hit") > 0, kept))
    n = F.when(F.col("__kept").isNull(), 0).otherwise(F.col("__lines") - F.array_size("__kept"))
    clean = F.when(n > 0, F.array_join("__kept", "\n")).otherwise(F.col(f"`{text}`"))
    out = {text: clean, "n_lines": F.col("__lines").cast("long"), "n_dropped": n.cast("long")}
    return rows.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")], out["n_lines"].alias("n_lines"), out["n_dropped"].alias("n_dropped"))


SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM p WHERE text IS NOT NULL),
c AS (SELECT source, trim(line, ' ') AS k, count(DISTINCT r) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM p GROUP BY ALL),
b AS (SELECT c.source, k FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= {MIN_PAGES} AND pages > {MAX_RATIO} * total),
k AS (SELECT l.r, count(*) AS n_lines, count(*) FILTER (WHERE b.k IS NOT NULL) AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.k IS NULL) AS kept
      FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.k GROUP BY l.r)
SELECT p.doc_id, p.source, CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE p.text END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM p LEFT JOIN k ON p.r = k.r
"""
