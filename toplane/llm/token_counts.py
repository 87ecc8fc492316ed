"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Each document is encoded whole under a tiktoken vocabulary; only its length
goes on.  The histogram (one row per distinct length) is aggregated with
map-side sums; op1_token_counts() writes it once, so no document is encoded twice.  Suffix sums over it answer, for any context limit L: how many
documents have at least L tokens, the total, the total when each document is
cut at L tokens, and any quantile.

The suffix sums are taken inside ranges of lengths, and the ranges' own totals
(a few hundred rows) are summed apart, so that no single task orders all
lengths.  Null and empty texts have length 0, long ones are encoded whole; repeated rows each count; an
empty table has an empty histogram.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, keyed, named, stored, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths that share a range of the suffix sums.
RANGE = 64

_encodings: dict[str, object] = {}


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(name: str = VOCABULARY):
    """The tiktoken encoding of a rank file (by name, or an absolute path), made once in each process."""
    if name not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def with_lengths(docs: DataFrame, keys: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The key columns and n_tokens of each row."""
    inner, names, where = keyed(docs, keys, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(x.as_py() or "")) for x in batch.column(where)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), n], names=[*names, "n_tokens"])

    return named(in_batches(inner, count, extended(inner.select(*names).schema, "n_tokens bigint")), names, keys, "n_tokens")


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): one row per distinct length."""
    return lengths.groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram: n_docs, docs_ge (documents of L tokens or more), tokens_ge
    (their tokens), docs_total, tokens_total, tokens_truncated (the total if each document is cut at L).
    """
    part = F.floor(F.col("n_tokens") / RANGE).alias("part")
    ranges = hist.groupBy(part).agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("part", (F.sum("d").over(above) - F.col("d")).alias("docs_after"), (F.sum("t").over(above) - F.col("t")).alias("tokens_after"), F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).join(ranges, "part")
    out = out.withColumn("docs_ge", F.col("docs_after") + F.sum("n_docs").over(inside)).withColumn("tokens_ge", F.col("tokens_after") + F.sum(F.col("n_tokens") * F.col("n_docs")).over(inside))
    cut = F.col("tokens_total") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")
    return out.select("n_tokens", "n_docs", "docs_ge", "tokens_ge", "docs_total", "tokens_total", cut.alias("tokens_truncated"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_total, docs_over (longer than it), tokens_total, tokens_truncated.

    The answer is read off the suffix sums of the first length above the limit.
    An empty histogram gives zeros.
    """
    over = F.col("n_tokens") > limit
    first = F.min_by(F.struct("docs_ge", "tokens_ge"), F.when(over, F.col("n_tokens")))
    z = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"), first.alias("f"))
    return out.select(z(F.col("d")).alias("docs_total"), z(F.col("f.docs_ge")).alias("docs_over"), z(F.col("t")).alias("tokens_total"), (z(F.col("t")) - z(F.col("f.tokens_ge")) + z(F.col("f.docs_ge")) * limit).alias("tokens_truncated"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length L such that at least q of the documents have L tokens or fewer (null if none)."""
    at_most = F.col("docs_total") - F.col("docs_ge") + F.col("n_docs")
    return sums.filter(at_most >= F.col("docs_total") * F.lit(q)).agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix sums at every distinct length, with the share of documents no longer than it."""
    # the histogram is read twice and written once, so that no text is encoded again
    sums = suffix_sums(stored(histogram(with_lengths(table(spark, sf_dir, "documents"), []))))
    return sums.withColumn("share_at_most", (F.col("docs_total") - F.col("docs_ge") + F.col("n_docs")) / F.col("docs_total"))
