"""Suffix-array dedup of byte strings that repeat anywhere in a corpus.

A byte goes if some LENGTH-byte string over it also starts elsewhere (in any
text, this one included; never across texts).

Buckets.  A suffix's bucket is its anchor: the least ANCHOR-byte hash among the
first LENGTH bytes, leftmost among equals.  Suffixes that agree on LENGTH bytes
agree on their anchor and on how far it is away.  Neighbouring suffixes of one
text with one anchor are a block.  An anchor that stands there once has no
repeats; where all blocks of an anchor are equal byte for byte, all their
suffixes repeat.  Only these counts move for most of the corpus.

The rest is sorted, one batch of whole buckets at a time, over the distinct
blocks' bytes: by the first PERIOD bytes, then, for longer ties, by the ranks
of a difference-cover sample.  The cover {0, 1, 3} modulo 7 has, for any two
positions, one shift below 7 that brings both into the sample; its ranks come
beforehand by prefix doubling over the sample.  Neighbours in suffix order that
agree on LENGTH bytes repeat.  Memory is bounded by the batch: a bucket of more
than `max_blocks` distinct blocks is split by the bytes that come next to the
anchor, into suffixes that hold so many of them before it and those that hold
so many after it.  Parts that agree are one again, and what is still too large
is split further, until a bucket's suffixes agree in all their bytes; then it
has one part.

Blocks are equal where a 64-bit hash of their anchor and one of their content
agree; within a bucket, bytes are compared.  Long texts are taken whole, in
pieces of one text at least.

Null texts are empty; texts shorter than LENGTH keep all.  Repeated rows repeat
each other.  Rows are known by (doc_id, hash of the text), so a null or repeated
doc_id is as good as another.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm.shared import extended, in_batches, stored, table
from toplane.llm.textops import U64, chunks, mix, owners, prefix_hashes, powers, span_hashes

LENGTH, ANCHOR = 200, 64
PERIOD, COVER = 7, (0, 1, 3)
#: Distinct blocks of a bucket that are sorted together, and block bytes of a batch of buckets.
MAX_BLOCKS, BATCH_BYTES = 2000, 1 << 20
#: SHIFT[a, b]: the shift that brings positions a and b (modulo PERIOD) into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def anchors(data: np.ndarray, sums: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the string of `size` bytes at each place, and the anchor's place for each start of `length` bytes."""
    n = len(data) - size + 1
    _, down = powers(len(data) + 1)
    grams = mix((sums[size:] - sums[:n]) * down[:n])
    bits = U64(max(int(n).bit_length(), 1))
    least = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
    window, have = length - size + 1, 1
    while 2 * have <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
    return grams, (least & ((U64(1) << bits) - U64(1))).astype(np.int64)


def blocks_of(data: np.ndarray, offsets: np.ndarray, length: int, size: int, content: bool = True) -> tuple[np.ndarray, ...]:
    """(text, first start, last start + 1, anchor's hash, block's hash, bytes from the first start to the anchor) of the blocks; starts are places in data."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(data) < length:
        return none
    sums = prefix_hashes(data)
    grams, anchor = anchors(data, sums, length, size)
    starts = len(data) - length + 1
    doc = owners(offsets)[:starts]
    whole = np.arange(starts) + length <= offsets[doc + 1]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    # starts that don't hold a whole string end a text, so they end its last block
    at = np.flatnonzero(new & whole)
    if not len(at):
        return none
    run = np.cumsum(new) - 1
    ends = np.bincount(run[whole], minlength=run[-1] + 1)[run[at]] + at
    away = anchor[at] - at
    own = content_hashes(sums, at, ends + length - 1, away, ends - at) if content else np.zeros(0, np.uint64)
    return doc[at], at, ends, grams[anchor[at]], own, away


def content_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray, away: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the bytes of blocks, where their anchor is and how many starts they have."""
    return span_hashes(sums, first, last) + mix(away.astype(np.uint64) * U64(0x632BE59BD9B4E019) + starts.astype(np.uint64))


#: A block's first start, how far its anchor is from there, and its number of starts share a long.
PLACE_BITS = 20
BLOCKS = "h bigint, bh bigint, at bigint"


def find_anchors(inner: DataFrame, length: int, size: int) -> DataFrame:
    """text → h, the anchors of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(blocks_of(data, offsets, length, size, False)[3].view(np.int64))], names=["h"])

    return in_batches(inner.select("text"), run, "h bigint")


def find_blocks(inner: DataFrame, length: int, size: int) -> DataFrame:
    """row, text → row and the blocks: anchor h, content bh, at (first start in bytes << PLACE_BITS | its distance to the anchor << 10 | starts)."""
    if not 0 <= length - size < 1 << 10:
        raise ValueError("length must be size or more, by less than 1024")
    schema = extended(inner.select("row").schema, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column("text")):
                doc, first, last, h, bh, away = blocks_of(data, offsets, length, size)
                at = (first - offsets[doc]) << PLACE_BITS | away << 10 | (last - first)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc + lo)), pa.array(h.view(np.int64)), pa.array(bh.view(np.int64)), pa.array(at)], names=schema.names)

    return in_batches(inner.select("row", "text"), run, schema)


def ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64) + 1


def suffix_order(text: np.ndarray, offsets: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in order of (bucket, suffix up to its block's end, ties beyond `depth` as they come).

    text: the blocks' bytes one after the other; a block's end sorts before any byte.
    Returns the order and, by start, the group of those that agree on PERIOD bytes.
    """
    n = len(text)
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][block]
    symbols = np.concatenate([text.astype(np.uint64) + U64(1), np.zeros(PERIOD, np.uint64)])
    head = np.zeros(n, np.uint64)
    place = np.arange(n)
    for k in range(PERIOD):
        head = (head << U64(9)) | np.where(place + k < end, symbols[k : n + k], U64(0))

    # ranks of the sample: names of PERIOD bytes first, then twice the depth each time
    inside = (place - offsets[block]) % PERIOD
    sample = np.flatnonzero(np.isin(inside, COVER))
    rank = np.zeros(n + 1, np.int64)
    rank[sample] = ranks(head[sample])
    reach = PERIOD
    while reach < depth:
        after = sample + reach
        beyond = np.where(after < end[sample], rank[np.minimum(after, n)], 0)
        rank[sample] = ranks(rank[sample] * (len(sample) + 2) + beyond)
        reach *= 2

    _, names = np.unique(head[starts], return_inverse=True)
    _, group = np.unique(bucket * (len(starts) + 1) + names, return_inverse=True)
    residue = inside[starts]
    wide = np.int64(len(sample) + 2)
    # place within the group: for each residue, how many of its suffixes in the group come before
    before = np.zeros(len(starts), np.int64)
    members = [np.flatnonzero(residue == a) for a in range(PERIOD)]
    for a in range(PERIOD):
        for shift in np.unique(SHIFT[a]).tolist():
            to = np.minimum(starts[members[a]] + shift, n)
            own = np.where(to < end[starts[members[a]]], rank[to], 0)
            ordered = np.sort(group[members[a]] * wide + own)
            for b in np.flatnonzero(SHIFT[a] == shift).tolist():
                x = members[b]
                to = np.minimum(starts[x] + shift, n)
                other = np.where(to < end[starts[x]], rank[to], 0)
                before[x] += np.searchsorted(ordered, group[x] * wide + other) - np.searchsorted(ordered, group[x] * wide)
    return np.lexsort((before, group)), group


def repeats_in(text: np.ndarray, offsets: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Which starts agree on `length` bytes with another start of their bucket."""
    order, group = suffix_order(text, offsets, starts, bucket, length)
    out = np.zeros(len(starts), bool)
    steps = np.arange(length)
    pairs = np.flatnonzero(group[order[1:]] == group[order[:-1]])
    for lo in range(0, len(pairs), 5_000):
        at = pairs[lo : lo + 5_000]
        x, y = order[at], order[at + 1]
        same = at[(text[starts[x][:, None] + steps] == text[starts[y][:, None] + steps]).all(1)]
        out[order[same]] = out[order[same + 1]] = True
    return out


def runs(flags: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last + 1) of the runs of flagged places that follow each other."""
    where = np.flatnonzero(flags)
    if not len(where):
        return (np.zeros(0, np.int64),) * 3
    new = np.ones(len(where), bool)
    new[1:] = (owner[where[1:]] != owner[where[:-1]]) | (at[where[1:]] != at[where[:-1]] + 1)
    first = where[new]
    last = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
    return owner[first], at[first], at[last] + 1


FOUND = "h bigint, bh bigint, lo int, hi int"


def sort_buckets(blocks: DataFrame, length: int) -> DataFrame:
    """Distinct blocks (h, bh, starts, bytes) → runs of starts (lo to hi - 1) that repeat in another block of the bucket, or further on in this one."""
    rows = blocks.select("h", "bh", "starts", "bytes").repartition("h").sortWithinPartitions("h")

    def work(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(part).combine_chunks()
        text, offsets = b"".join(t.column("bytes").to_pylist()), np.zeros(len(t) + 1, np.int64)
        h, bh, n = (t.column(c).to_numpy() for c in ("h", "bh", "starts"))
        np.cumsum(n + length - 1, out=offsets[1:])
        owner = np.repeat(np.arange(len(t)), n)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        bucket = np.unique(h, return_inverse=True)[1][owner]
        flags = repeats_in(np.frombuffer(text, np.uint8), offsets, offsets[owner] + inside, bucket, length)
        who, lo, hi = runs(flags, owner, inside)
        yield pa.RecordBatch.from_arrays([pa.array(h[who]), pa.array(bh[who]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["h", "bh", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                if size < BATCH_BYTES:
                    # as much as fits, at least one row
                    lengths = np.cumsum(batch.column("starts").to_numpy().astype(np.int64) + length - 1)
                    take = max(1, int(np.searchsorted(lengths, BATCH_BYTES - size, "right")))
                else:
                    last = kept[-1].column("h")[-1].as_py()
                    take = int((batch.column("h").to_numpy() == last).sum())  # the rest of the last bucket
                    lengths = None
                if take:
                    part = batch.slice(0, take)
                    kept.append(part)
                    size += int((part.column("starts").to_numpy().astype(np.int64) + length - 1).sum())
                    batch = batch.slice(take)
                if batch.num_rows and size >= BATCH_BYTES and batch.column("h")[0].as_py() != kept[-1].column("h")[-1].as_py():
                    yield from work(kept)
                    kept, size = [], 0
                elif batch.num_rows and take == 0:
                    raise ValueError("buckets out of order")
                elif batch.num_rows and size < BATCH_BYTES:
                    size = max(size, BATCH_BYTES)  # the next row would not fit: finish its bucket only
        if kept:
            yield from work(kept)

    return in_batches(rows, run, FOUND)


PART = "h bigint, bh bigint, lo int, h2 bigint, bh2 bigint, away int, starts int, bytes binary"


def split_blocks(blocks: DataFrame, length: int, size: int, least: int, most: int) -> DataFrame:
    """Blocks (h, bh, away, starts, bytes), whose starts are `least` to `most` bytes before their anchor → their parts (see PART).

    Starts near the anchor hold at least length - size - middle bytes after it,
    the others more than `middle` bytes before it; these bytes make the part's bucket.
    """
    middle = (least + most) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bh, away, starts = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "bh", "away", "starts"))
            for lo, hi, data, offsets in chunks(batch.column("bytes")):
                sums = prefix_hashes(data)
                anchor = offsets[:-1] + away[lo:hi]
                far = np.clip(away[lo:hi] - middle, 0, starts[lo:hi])  # starts further away than the middle come first
                for who, first, n, key in (
                    (np.flatnonzero(far > 0), np.zeros(hi - lo, np.int64), far, lambda x: span_hashes(sums, anchor[x] - middle - 1, anchor[x]) ^ U64(1)),
                    (np.flatnonzero(far < starts[lo:hi]), far, starts[lo:hi] - far, lambda x: span_hashes(sums, anchor[x] + size, anchor[x] + length - middle)),
                ):
                    at, count = offsets[who] + first[who], n[who]
                    end, dist = at + count + length - 1, away[lo + who] - first[who]
                    bucket = mix(key(who) + h[lo + who].view(np.uint64) * U64(0x9E3779B97F4A7C15))
                    body = [data[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist(), strict=True)]
                    columns = (h[lo + who], bh[lo + who], first[who].astype(np.int32), bucket.view(np.int64), content_hashes(sums, at, end, dist, count).view(np.int64), dist.astype(np.int32), count.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(body, pa.binary())], names=["h", "bh", "lo", "h2", "bh2", "away", "starts", "bytes"])

    return in_batches(blocks.select("h", "bh", "away", "starts", "bytes"), run, PART)


def repeats_among(blocks: DataFrame, length: int, size: int, max_blocks: int, ranges: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Distinct blocks (h, bh, away, starts, bytes) → FOUND, splitting buckets that are too large.  ranges: of the distances to the anchor, one for each kind of part."""
    kinds = stored(blocks.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > max_blocks).select("h"))
    if kinds.isEmpty():
        return sort_buckets(blocks, length)
    found = sort_buckets(blocks.join(kinds, "h", "left_anti"), length)
    large = blocks.join(kinds, "h", "left_semi")
    for least, most in ranges or ((0, length - size),):
        # a bucket's starts all lie in one of the ranges
        inside = large.filter((F.col("away") - F.col("starts") + 1 >= least) & (F.col("away") <= most)) if ranges else large
        if least == most:
            continue  # all bytes agree: such a bucket has one distinct block, and is never too large
        parts = stored(split_blocks(inside, length, size, least, most))
        equal = parts.groupBy("h2", "bh2").agg(F.count(F.lit(1)).alias("times"), F.first("starts").alias("hi")).filter("times > 1").select(F.col("h2").alias("h"), F.col("bh2").alias("bh"), F.lit(0).alias("lo"), "hi")
        middle = (least + most) // 2
        distinct = stored(parts.dropDuplicates(["h2", "bh2"]).select(F.col("h2").alias("h"), F.col("bh2").alias("bh"), "away", "starts", "bytes"))
        below = repeats_among(distinct, length, size, max_blocks, ((least, middle), (middle + 1, most))).union(equal)
        back = parts.select("h", "bh", F.col("lo").alias("at"), "h2", "bh2").join(below.toDF("h2", "bh2", "lo", "hi"), ["h2", "bh2"])
        found = found.union(back.select("h", "bh", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")))
    return found


def repeated_spans(inner: DataFrame, length: int = LENGTH, size: int = ANCHOR, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """row, text → row and runs of starts (lo to hi - 1) whose strings of `length` bytes also start elsewhere.

    `row` is a hash of (doc_id, text).
    """
    # counts are combined before they move; they are written, as are the spans below, so that adaptive execution may split the joins at hot anchors
    often = find_anchors(inner, length, size).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    often = stored(often)
    repeats = stored(find_blocks(inner, length, size).join(often, "h").select("row", "h", "bh", "at"))
    kinds = stored(repeats.groupBy("h", "bh").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at")).alias("one")))
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h")
    wanted = kinds.join(mixed, "h").groupBy("one.row").agg(F.collect_list(F.struct("h", "bh", "one.at")).alias("wanted"))
    body = stored(cut_out(inner.join(wanted, "row").select(*inner.columns, "wanted"), length).dropDuplicates(["h", "bh"]))
    equal = kinds.filter("times > 1").select("h", "bh", F.lit(0).alias("lo"), starts_of(F.col("one.at")).cast("int").alias("hi"))
    found = stored(repeats_among(body, length, size, max_blocks).union(equal).groupBy("h", "bh").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    first = F.shiftright("at", PLACE_BITS)
    return repeats.join(found, ["h", "bh"]).select("row", first.alias("first"), F.explode("spans").alias("s")).select("row", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi")).alias("hi"))


def starts_of(at):
    return at.bitwiseAND(F.lit((1 << 10) - 1))


def cut_out(cut: DataFrame, length: int) -> DataFrame:
    """(wanted blocks, text) → h, bh, away, starts, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for wanted, text in zip(batch.column("wanted"), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                for w in wanted.as_py():
                    first, away, n = w["at"] >> PLACE_BITS, w["at"] >> 10 & (1 << 10) - 1, w["at"] & (1 << 10) - 1
                    rows.append((w["h"], w["bh"], away, n, raw[first : first + n + length - 1]))
                    size += n + length
                if size >= BATCH_BYTES:
                    yield cut_rows(rows)
                    rows, size = [], 0
            yield cut_rows(rows)

    return in_batches(cut, run, "h bigint, bh bigint, away int, starts int, bytes binary")


def cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns, kinds = list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names=["h", "bh", "away", "starts", "bytes"])


def merged(spans: list[dict], length: int) -> list[list[int]]:
    """The bytes that runs of starts cover, as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + length - 1) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def remove_repeats(docs: DataFrame, keys: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The key columns of each row, n_bytes, removed (maximal runs: first byte, bytes) and kept (the bytes that are left)."""
    names = [f"key_{i}" for i in range(len(keys))]
    # one projection for all uses, so that the texts are dealt out by row once
    inner = docs.select(*(F.col(k).alias(n) for n, k in zip(names, keys, strict=True)), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(inner, length, size, max_blocks).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    both = inner.join(spans, "row", "left").select(*names, "spans", "text")
    schema = extended(both.select(*names).schema, "n_bytes bigint, removed array<struct<first:bigint,bytes:bigint>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for found, text in zip(batch.column("spans").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                cover, at, left = merged(found or [], length), 0, []
                for a, b in cover:
                    left.append(raw[at:a])
                    at = b
                n.append(len(raw))
                removed.append([{"first": a, "bytes": b - a} for a, b in cover])
                kept.append(b"".join([*left, raw[at:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))), pa.array(kept, pa.binary())], names=schema.names)

    out = in_batches(both, run, schema)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "n_bytes", "removed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["bytes"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every LENGTH-byte string of every document by its md5, from overlapping pieces of the text in hexadecimal digits (two a byte).
ORACLE = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, o, substr(h, 2 * o + 1, {2 * (1024 + LENGTH - 1)}) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH} + 1, 1024)) AS o FROM docs)),
strings AS MATERIALIZED (
  SELECT r, o + i AS p, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS m
  FROM (SELECT r, o, h, unnest(range(0, length(h) // 2 - {LENGTH} + 1)) AS i FROM pieces)),
twice AS (SELECT r, p FROM strings WHERE m IN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM twice),
spans AS MATERIALIZED (
  SELECT r, min(p) AS lo, max(p) + {LENGTH} AS hi
  FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM marked) GROUP BY r, run),
kept AS (
  SELECT r, string_agg(substr(h, 2 * s.lo + 1, 2 * (s.hi - s.lo)), '' ORDER BY s.lo) AS h
  FROM (
    SELECT r, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM spans WINDOW w AS (PARTITION BY r ORDER BY lo)
    UNION ALL SELECT r, max(hi), length(any_value(h)) // 2 FROM spans JOIN docs USING (r) GROUP BY r) s
  JOIN docs USING (r) GROUP BY r),
cut AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(docs.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, docs.h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)
"""
