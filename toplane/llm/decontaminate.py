"""Benchmark decontamination: a broadcast hash set of the normalised test n-grams.

Words are the runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became lower
case.  A window is ten consecutive words of an item; an item with fewer words,
but not none, is one window.  The windows of `max_items_bytes` of item text are
one broadcast (20 bytes a window, and the items' words); a larger benchmark goes
in blocks, one scan of the documents for each, whose hits are written before the
next block is read.  Every block sees the documents' own texts, and the hits are
brought together by a number that each row is given and stored with.  A window
that the set knows is verified byte for byte.

Nulls and empty texts have no words: no hit.  Long texts are scanned whole.
Repeated rows each give a row, whatever their keys.  Items that are equal in
text all count; so does an item without an id, under the id `null`.  An empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, keyed, named, stored, table
from toplane.llm.textops import LOWER, NORMAL_PATTERN, NORMAL_WORD, byte_hashes, chunks, gram_hashes, segments, sql_words

WINDOW = 10
#: Above this many bytes of item text, the items go in blocks of that size.
MAX_ITEMS_BYTES = 8 << 20
#: What a scan adds to the key columns.
HITS = "n_words bigint, hit_words array<struct<first:bigint,words:bigint>>, hit_bytes array<struct<first:bigint,bytes:bigint>>, items array<string>"


class Windows(NamedTuple):
    """Windows of one length in words: their hashes in order, the item of each, and where its words lie in `words` (a space between two)."""

    hashes: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: bytes
    items: list[str]

    def found(self, h: int, words: bytes) -> set[str]:
        """The items that hold a window of these words."""
        at = int(np.searchsorted(self.hashes, np.uint64(h)))
        out = set()
        while at < len(self.hashes) and int(self.hashes[at]) == h:
            if self.words[self.first[at] : self.last[at]] == words:
                out.add(self.items[self.item[at]])
            at += 1
        return out


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[int, Windows]:
    """By length in words."""
    made: dict[int, list] = {}
    texts, size = [], 0
    for k, (_, text) in enumerate(items):
        raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        starts, ends, _ = segments(raw, np.array([0, len(raw)]), NORMAL_WORD)
        if not len(starts):
            continue
        n = min(window, len(starts))
        grams = gram_hashes(byte_hashes(raw, starts, ends), n)
        lengths = ends - starts
        first = size + np.cumsum(lengths + 1) - lengths - 1
        made.setdefault(n, []).append((grams, np.full(len(grams), k, np.int32), first[: len(grams)], (first + lengths)[n - 1 :]))
        texts.append(b" ".join(raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) + b" ")
        size += len(texts[-1])
    words, names = b"".join(texts), ["null" if i is None else str(i) for i, _ in items]
    out = {}
    for n, parts in made.items():
        hashes, item, first, last = map(np.concatenate, zip(*parts, strict=True))
        by = np.argsort(hashes, kind="stable")
        out[n] = Windows(hashes[by], item[by], first[by].astype(np.int32), last[by].astype(np.int32), words, names)
    return out


def scan(batches: Iterator[pa.RecordBatch], windows: dict[int, Windows], keys: int = 0, where: int = 0) -> Iterator[pa.RecordBatch]:
    """`keys` columns, with a text at `where` → these columns, n_words, hit words as runs (first word, words), hit bytes as runs, items."""
    known = {n: found.hashes for n, found in windows.items()}
    small = {n: np.zeros(1 << 20, bool) for n in known}
    for n, hashes in known.items():
        small[n][(hashes >> np.uint64(44)).astype(np.int64)] = True
    for batch in batches:
        n_words, runs, spans, items = [], [], [], []
        for lo, hi, data, offsets in chunks(batch.column(where)):
            raw = LOWER[data]
            starts, ends, at = segments(raw, offsets, NORMAL_WORD)
            words = byte_hashes(raw, starts, ends)
            n_words += np.diff(at).tolist()
            hits: dict[int, list] = {}
            for n, hashes in known.items():
                grams = gram_hashes(words, n)
                maybe = np.flatnonzero(small[n][(grams >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(hashes, grams[maybe]), len(hashes) - 1)
                maybe = maybe[hashes[place] == grams[maybe]]
                doc = np.searchsorted(at, maybe, "right") - 1
                fits = maybe + n <= at[doc + 1]
                for i, d in zip(maybe[fits].tolist(), doc[fits].tolist(), strict=True):
                    found = windows[n].found(int(grams[i]), b" ".join(raw[starts[k] : ends[k]].tobytes() for k in range(i, i + n)))
                    if found:
                        hits.setdefault(d, []).append((i, i + n, found))
            for d in range(hi - lo):
                mine = sorted(hits.get(d, []), key=lambda x: x[:2])
                merged: list[list[int]] = []
                for a, b, _ in mine:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                runs.append([{"first": int(a - at[d]), "words": int(b - a)} for a, b in merged])
                spans.append([{"first": int(starts[a] - offsets[d]), "bytes": int(ends[b - 1] - starts[a])} for a, b in merged])
                items.append(sorted(set().union(*(x for _, _, x in mine))) if mine else [])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(keys)),
                pa.array(n_words, pa.int64()),
                pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=[*batch.schema.names[:keys], "n_words", "hit_words", "hit_bytes", "items"],
        )


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """The items, in blocks whose text is at most `limit` bytes (one item at least)."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        more = len((row["text"] or "").encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += more
    if block:
        yield block


def find_hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_items_bytes: int = MAX_ITEMS_BYTES) -> DataFrame:
    """For each row of docs: its key columns, n_words, hit_words, hit_bytes and items.

    hit_words and hit_bytes are the merged runs of hit words (in words, and in
    bytes of the text's UTF-8); items the ids of the items that occur.
    """
    inner, names, where = keyed(docs, keys, text_col)
    n, hits = len(keys), ["n_words", "hit_words", "hit_bytes", "items"]
    blocks = item_blocks(benchmark, item_col, item_text_col, max_items_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(windows_of(first or [], window))
        return named(in_batches(inner, lambda it: scan(it, sent.value, n, where), extended(inner.select(*names).schema, HITS)), names, keys, *hits)
    # the rows' numbers are written with them, so that every scan sees the same ones
    rows = stored(inner.withColumn("row", F.monotonically_increasing_id()))
    text = rows.columns[where]
    found = hits_by_row(rows.select("row", F.col(text).alias("text")), chain([first, second], blocks), window)
    counted = in_batches(rows.select("row", *names, F.col(text).alias("of")), lambda it: scan(it, {}, n + 1, n + 1), extended(rows.select("row", *names).schema, HITS)).select("row", *names, "n_words")
    both = counted.join(found.drop("n_words"), "row", "left")
    some = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in hits[1:]]
    return named(both, names, keys, "n_words", *some)


def hits_by_row(rows: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """row, n_words, hit_words, hit_bytes and items of the rows (row, text) that any block of items hits.  One block is in memory at a time."""
    schema = extended(rows.select("row").schema, HITS)
    both = None
    for block in blocks:
        sent = rows.sparkSession.sparkContext.broadcast(windows_of(block, window))
        part = stored(in_batches(rows, lambda it, sent=sent: scan(it, sent.value, 1, 1), schema).filter(F.size("hit_words") > 0))
        sent.destroy()
        both = part if both is None else both.unionByName(part)
    run = F.transform(F.arrays_zip("hit_words", "hit_bytes"), lambda x: F.struct(x["hit_words"]["first"].alias("first"), x["hit_words"]["words"].alias("words"), x["hit_bytes"]["first"].alias("at"), x["hit_bytes"]["bytes"].alias("bytes")))
    grouped = both.withColumn("runs", run).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = grouped.withColumn("runs", merge_runs("runs"))
    return merged.select(
        "row",
        "n_words",
        F.transform("runs", lambda x: F.struct(x["first"].alias("first"), x["words"].alias("words"))).alias("hit_words"),
        F.transform("runs", lambda x: F.struct(x["at"].alias("first"), x["bytes"].alias("bytes"))).alias("hit_bytes"),
        "items",
    )


def merge_runs(runs):
    """Sorted (first, words, at, bytes) runs with those whose words overlap or touch joined, bytes between them included."""

    def joined(a, b):
        words = F.greatest(a["first"] + a["words"], b["first"] + b["words"]) - a["first"]
        size = F.greatest(a["at"] + a["bytes"], b["at"] + b["bytes"]) - a["at"]
        return F.struct(a["first"].alias("first"), words.alias("words"), a["at"].alias("at"), size.alias("bytes"))

    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        runs,
        F.array().cast("array<struct<first:bigint,words:bigint,at:bigint,bytes:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (last(done)["first"] + last(done)["words"] >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last(done), x))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def remove_hits(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.5, text_col: str = "text", **kw) -> DataFrame:
    """docs without what the benchmark holds: hit spans are cut out, and a
    document of which more than `max_share` of the words are hit is dropped.
    The columns are those of docs.
    """
    names = docs.columns
    window = kw.get("window", WINDOW)
    blocks = item_blocks(benchmark, kw.get("item_col", "item_id"), kw.get("item_text_col", "text"), kw.get("max_items_bytes", MAX_ITEMS_BYTES))
    where = names.index(text_col)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        sent = docs.sparkSession.sparkContext.broadcast(windows_of(first, window))
        return in_batches(docs, lambda it: _scan_and_cut(it, sent.value, where, max_share), docs.schema)
    # every block sees the text as it was; spans and shares are judged once, over all blocks' hits
    own = [f"c{i}" for i in range(len(names))]
    rows = stored(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()))
    found = hits_by_row(rows.select("row", F.col(own[where]).alias("text")), chain([first, second], blocks), window)
    both = rows.join(found, "row", "left").select(*own, "n_words", "hit_words", "hit_bytes")
    return in_batches(both, lambda it: _cut_joined(it, names, where, max_share), docs.schema)


def _scan_and_cut(batches: Iterator[pa.RecordBatch], windows: dict, where: int, max_share: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (found,) = scan(iter([batch]), windows, 0, where)
        yield _cut(batch, found, where, max_share)


def _cut_joined(batches: Iterator[pa.RecordBatch], names: list[str], where: int, max_share: float) -> Iterator[pa.RecordBatch]:
    """As _scan_and_cut(), where n_words, hit_words and hit_bytes follow the columns; they are null for rows without a hit."""
    for batch in batches:
        n = len(names)
        yield _cut(pa.RecordBatch.from_arrays(batch.columns[:n], names=names), pa.RecordBatch.from_arrays(batch.columns[n:], names=batch.schema.names[n:]), where, max_share)


def _cut(batch: pa.RecordBatch, found: pa.RecordBatch, where: int, max_share: float) -> pa.RecordBatch:
    texts = batch.column(where)
    hit, total, spans = found.column("hit_words").to_pylist(), found.column("n_words").to_pylist(), found.column("hit_bytes").to_pylist()
    keep, cut = [], {}
    for i, runs in enumerate(hit):
        keep.append(not runs or sum(r["words"] for r in runs) <= max_share * total[i])
        if runs and keep[-1]:
            raw, at, left = texts[i].as_py().encode(), 0, []
            for r in spans[i]:
                left.append(raw[at : r["first"]])
                at = r["first"] + r["bytes"]
            cut[i] = b"".join([*left, raw[at:]]).decode()
    if cut:
        texts = pa.array([cut.get(i, x) for i, x in enumerate(texts.to_pylist())], texts.type)
    columns = [texts if k == where else batch.column(k) for k in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda a, x: a + x["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"))


#: Windows as strings of words with a space between two, compared whole.
ORACLE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {sql_words("text", NORMAL_PATTERN, lower=True)} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {sql_words("text", NORMAL_PATTERN, lower=True)} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
hits AS MATERIALIZED (SELECT r, i, n, item FROM places JOIN windows USING (n, g)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
