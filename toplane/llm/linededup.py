"""Line dedup by site-relative frequency, in DataFrame functions only.

For each host, the pages that hold a line are divided by the host's pages; a
line of more than `max_ratio` of them, and of `min_pages` at least, is
boilerplate of that host and goes from its documents.  Lines are split at \\n
and compared whole (by two 64-bit hashes); blank ones are always kept.

A host has fewer such lines than its mean lines a page / max_ratio, so the list
of a host is bounded.  The lists are written to the shared folder first, so the
join with the documents is planned on their measured size: broadcast below
Spark's own threshold, else a sort-merge join, whose hot hosts adaptive
execution splits.

A null text stays null; an empty one has one blank line.  A null host is a host
of its own.  A line that a page repeats counts once for the page, and repeated
rows are pages of their own.  A document of nothing but boilerplate stays, with
an empty text.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import stored, table

#: A line in more than this share of a host's pages, and in so many pages at least, is boilerplate.
MAX_RATIO, MIN_PAGES = 0.1, 5


def host_of(url_col: str) -> Column:
    """The host part of a URL, lower case."""
    return F.lower(F.expr(f"try_parse_url(`{url_col}`, 'HOST')"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): for each host that has any, the marks of its boilerplate lines."""
    inner = docs.select(host.alias("host"), F.col(text_col).alias("text"))
    pages = inner.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    marks = F.transform(F.filter(F.array_distinct(lines_of(F.col("text"))), lambda x: ~blank(x)), mark)
    counts = inner.select("host", F.explode(marks).alias("m")).groupBy("host", F.col("m.a").alias("a"), F.col("m.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    both = counts.join(pages, counts["host"].eqNullSafe(pages["host"])).select(counts["host"], "a", "b", "n", "n_pages")
    return both.filter(F.col("n") > F.lit(max_ratio) * F.col("n_pages")).groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad"))


def drop_boilerplate(docs: DataFrame, host_col: str | Column = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines cut out of the text, and columns n_lines and n_dropped."""
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    bad = stored(boilerplate(docs, host, text_col, max_ratio, min_pages)).select(F.col("host").alias("__host"), F.col("bad").alias("__bad"))
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda x: blank(x) | ~F.array_contains(F.col("__bad"), mark(x)))
    out = docs.join(bad, host.eqNullSafe(F.col("__host")), "left").withColumn("__kept", F.when(F.col("__bad").isNull(), lines).otherwise(kept))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0).cast("bigint")).otherwise(size(lines))
    n_kept = F.when(F.col(text_col).isNull(), F.lit(0).cast("bigint")).otherwise(size("__kept"))
    columns = [F.when(F.col(text_col).isNotNull(), F.array_join("__kept", "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH lines AS (SELECT doc_id, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
pages AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line) l
  JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE l.n >= {MIN_PAGES} AND l.n > CAST({MAX_RATIO} AS DOUBLE) * p.n_pages),
each AS (
  SELECT doc_id, source, string_split(text, chr(10))[i] AS line, i
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(*) FILTER (b.line IS NOT NULL) AS n_dropped,
         coalesce(string_agg(e.line, chr(10) ORDER BY i) FILTER (b.line IS NULL), '') AS text
  FROM each e LEFT JOIN bad b ON e.source IS NOT DISTINCT FROM b.source AND e.line = b.line GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
