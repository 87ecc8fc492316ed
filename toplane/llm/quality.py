"""Quality rules by host: failure rates under an empirical beta prior.

Each document is held against RULES.  Their failures are counted by host; for
each rule, the hosts' rates are shrunk towards a beta prior whose two parameters
come from the hosts' own mean and variance (by moments).  A host's limit follows
from the prior that the other hosts give: DEVIATIONS of its standard deviations
above its mean, but LEAST_LIMIT to MOST_LIMIT.  A host whose shrunk rate exceeds
the limit of any rule loses its documents.  Host verdicts go back to the
documents by a join on the host.

Words are the runs of `[^\\x20\\x09-\\x0D]+`.  base_failed: fewer than 20 words,
or more than 30 in 100 of them inside 8-word windows that the text holds twice.

A null text has no words, and so fails the base rules.  Long texts are measured
whole.  A null host is a host of its own.  Repeated rows each count and each
give a row.  With fewer than two hosts, or no variance between them, the prior
is the mean with the weight of PRIOR_WEIGHT documents; a single host has
MOST_LIMIT as its limit.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, keyed, named, stored, table
from toplane.llm.textops import NOT_NEWLINE, SPACED_PATTERN, SPACED_WORD, _table, byte_hashes, chunks, gram_hashes, owners, segments, sql_words, sums_by

SYMBOLS = _table(b"#*$%&|<>")
#: Bytes that begin a code point.
LEADING = _table([*range(0x80), *range(0xC0, 0x100)])
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Between these shares of failing documents a host's limit lies, DEVIATIONS above what the other hosts make likely.
LEAST_LIMIT, MOST_LIMIT, DEVIATIONS = 0.25, 0.5, 3.0
PRIOR_WEIGHT = 10.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a document fails, by name: too few words or too many repeated ones; more than a symbol for each ten words; words of
#: fewer than 3 or more than 12 code points in the mean; more repeated lines than one for each ten words.
RULES = {
    "base": f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lengths": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)",
    "lines": "10 * n_dup_lines > n_words",
}


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys stand there more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys stand somewhere before as well."""
    out = repeated(keys)
    if out.any():
        at = np.flatnonzero(out)
        _, first = np.unique(keys[at], return_index=True)
        out[at[first]] = False
    return out


def stats_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns STATS of each text."""
    mark = np.arange(1, len(offsets), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    starts, ends, at = segments(data, offsets, SPACED_WORD)
    words = byte_hashes(data, starts, ends)
    chars = sums_by(SPACED_WORD[data] & LEADING[data], offsets)
    symbols = sums_by(SYMBOLS[data], offsets)

    first, last, lines_at = segments(data, offsets, NOT_NEWLINE)
    line_doc = owners(lines_at)
    has_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    dup_lines = np.zeros(len(first), bool)
    dup_lines[has_word] = later(byte_hashes(data, first[has_word], last[has_word]) ^ mark[line_doc[has_word]])

    doc = owners(at)
    grams = gram_hashes(words, WINDOW)
    whole = doc[: len(grams)] == doc[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    where = np.flatnonzero(whole)
    twice = where[repeated(grams[where] ^ mark[doc[where]])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return [np.diff(at), chars, symbols, sums_by(dup_lines, lines_at), sums_by(np.cumsum(cover)[:-1] > 0, at)]


def document_stats(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns of each row, the columns STATS, and base_failed."""
    inner, names, where = keyed(docs, keys, text_col)
    schema = extended(inner.select(*names).schema, ", ".join(f"{name} bigint" for name in STATS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [stats_of(data, offsets) for _, _, data, offsets in chunks(batch.column(where))] or [[np.zeros(0, np.int64)] * 5]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True))], names=schema.names)

    return named(in_batches(inner, scan, schema), names, keys, *STATS, F.expr(RULES["base"]).alias("base_failed"))


def host_verdicts(stats: DataFrame, host_col: str, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n_docs, failed, rates, limits, host_kept): for each rule, its failures, their rate shrunk by the prior of all hosts, and the limit by that of the others."""
    n = len(rules)
    hosts = stats.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.array(*(F.sum(F.expr(rule).cast("bigint")) for rule in rules.values())).alias("failed"))
    rate = lambda i: F.col("failed")[i] / F.col("n_docs")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), *(F.sum(rate(i)).alias(f"one_{i}") for i in range(n)), *(F.sum(rate(i) * rate(i)).alias(f"two_{i}") for i in range(n)))

    def moments(many, one, two):
        mean = one / F.greatest(many, F.lit(1))
        return mean, F.greatest(F.when(many > 1, (two - many * mean * mean) / (many - 1)).otherwise(0.0), F.lit(0.0))

    # the sums are one row by construction
    both = hosts.crossJoin(F.broadcast(sums))
    rates, limits = [], []
    for i in range(n):
        mean, variance = moments(F.col("hosts"), F.col(f"one_{i}"), F.col(f"two_{i}"))
        weight = F.when((variance > 1e-12) & (mean * (1 - mean) > variance), mean * (1 - mean) / variance - 1).otherwise(F.lit(PRIOR_WEIGHT))
        rates.append((F.col("failed")[i] + mean * weight) / (F.col("n_docs") + weight))
        others, spread = moments(F.col("hosts") - 1, F.col(f"one_{i}") - rate(i), F.col(f"two_{i}") - rate(i) * rate(i))
        limits.append(F.when(F.col("hosts") > 1, F.least(F.lit(MOST_LIMIT), F.greatest(F.lit(LEAST_LIMIT), others + DEVIATIONS * F.sqrt(spread)))).otherwise(F.lit(MOST_LIMIT)))
    kept = F.forall(F.arrays_zip("rates", "limits"), lambda x: x["rates"] <= x["limits"])
    return both.select("host", "n_docs", "failed", F.array(*rates).alias("rates"), F.array(*limits).alias("limits")).withColumn("host_kept", kept)


def judge(docs: DataFrame, keys: list[str], host_col: str = "source", text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """The key columns of each row, STATS, base_failed, host_rates (by rule, in their order), kept.

    The documents' statistics are written once; the host table joins them
    without moving the texts again.
    """
    names = [f"own_{i}" for i in range(len(keys))]
    inner = docs.select(*(docs[k].alias(n) for n, k in zip(names, keys, strict=True)), docs[host_col].alias("host"), docs[text_col].alias("text"))
    stats = stored(document_stats(inner, [*names, "host"]))
    hosts = host_verdicts(stats, "host", rules).select(F.col("host").alias("of"), "rates", "host_kept")
    out = stats.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left")
    return named(out, names, keys, *STATS, "base_failed", F.col("rates").alias("host_rates"), (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    rates = (F.round(F.col("host_rates")[i], 6).alias(f"rate_{name}") for i, name in enumerate(RULES))
    return out.select("doc_id", *STATS, "base_failed", *rates, "kept")


def _sql_hosts() -> str:
    """hosts(host, rate_<rule>..., host_kept) from the table stats, as host_verdicts() says."""
    n, f = range(len(RULES)), [f"CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS DOUBLE) AS f{i}" for i, rule in enumerate(RULES.values())]
    mean = "{one} / greatest({many}, 1)"
    spread = "greatest(CASE WHEN {many} > 1 THEN ({two} - {many} * ({mean}) * ({mean})) / ({many} - 1) ELSE 0 END, 0)"

    def moments(many: str, one: str, two: str) -> tuple[str, str]:
        of = mean.format(one=one, many=many)
        return of, spread.format(many=many, two=two, mean=of)

    prior, limits = [], []
    for i in n:
        m, v = moments("hosts", f"one{i}", f"two{i}")
        prior += [f"{m} AS m{i}", f"{v} AS v{i}"]
        m, v = moments("(hosts - 1)", f"(one{i} - x{i})", f"(two{i} - x{i} * x{i})")
        limits.append(f"CASE WHEN hosts > 1 THEN least({MOST_LIMIT}, greatest({LEAST_LIMIT}, {m} + {DEVIATIONS} * sqrt({v}))) ELSE {MOST_LIMIT} END AS limit{i}")
    weight = "(CASE WHEN v{i} > 1e-12 AND m{i} * (1 - m{i}) > v{i} THEN m{i} * (1 - m{i}) / v{i} - 1 ELSE {least} END)"
    weights = [weight.format(i=i, least=PRIOR_WEIGHT) for i in n]
    return f"""
failed AS (SELECT host, CAST(count(*) AS DOUBLE) AS n_docs, {", ".join(f)} FROM stats GROUP BY host),
shares AS (SELECT *, {", ".join(f"f{i} / n_docs AS x{i}" for i in n)} FROM failed),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, {", ".join(f"sum(x{i}) AS one{i}, sum(x{i} * x{i}) AS two{i}" for i in n)} FROM shares),
priors AS (SELECT *, {", ".join(prior)}, {", ".join(limits)} FROM shares CROSS JOIN sums),
rated AS (SELECT *, {", ".join(f"(f{i} + m{i} * {w}) / (n_docs + {w}) AS rate_{name}" for i, (name, w) in enumerate(zip(RULES, weights, strict=True)))} FROM priors),
hosts AS (SELECT *, {" AND ".join(f"rate_{name} <= limit{i}" for i, name in enumerate(RULES))} AS host_kept FROM rated)"""


#: Lines and windows are compared whole.
ORACLE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {sql_words("text", SPACED_PATTERN)} AS w FROM documents),
lines AS (
  SELECT r, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines
  FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{SPACED_PATTERN}') GROUP BY r, line)
  GROUP BY r),
places AS MATERIALIZED (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM docs)),
twice AS (SELECT r, i FROM places JOIN (SELECT r, g FROM places GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
words AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS k FROM twice) GROUP BY r),
stats AS MATERIALIZED (
  SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN lines USING (r) LEFT JOIN words USING (r)),{_sql_hosts()}
SELECT doc_id, {", ".join(STATS)}, {RULES["base"]} AS base_failed, {", ".join(f"round(rate_{name}, 6) AS rate_{name}" for name in RULES)},
       NOT ({RULES["base"]}) AND host_kept AS kept
FROM stats JOIN hosts ON stats.host IS NOT DISTINCT FROM hosts.host
"""
