"""Matrices as long tables, and the few products that the models are made of.

A matrix is (row, column, value); an absent cell is 0, so cells of value 0 are
never kept.  Similarities are (i, j, sim), scores (uid, iid, score).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER, ITEM = "uid", "iid"
#: Scores that differ by less than this are equal in a ranking: sums depend on their order beyond it.
DIGITS = 9


def ranked(df: DataFrame, part: str, item: str, score: str, k: int | None = None) -> DataFrame:
    """df with `rank` from 1 on for each part, by score; ties go to the larger item.  Rows beyond rank k are dropped.

    The rank's bound stands right above the window, so Spark cuts each side of the shuffle to k rows a part.
    """
    window = Window.partitionBy(part).orderBy(F.desc(F.round(score, DIGITS)), F.desc(item))
    out = df.withColumn("rank", F.row_number().over(window))
    return out if k is None else out.filter(F.col("rank") <= k)


def top_k_ranks(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(uid, iid, rank) of the stored cells; users with fewer than k keep all; negatives are ranked too."""
    return ranked(scores.filter("score <> 0"), USER, ITEM, "score", k).select(USER, ITEM, "rank")


def top_k_values(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores.filter("score <> 0"), USER, ITEM, "score", k).select(USER, ITEM, "score")


def top_k_neighbours(sim: DataFrame, k: int | None) -> DataFrame:
    """The k largest cells of each row i."""
    return ranked(sim.filter("sim <> 0"), "i", "j", "sim", k).select("i", "j", "sim")


def top_k_absolute(sim: DataFrame, n: int) -> DataFrame:
    """The n cells of the whole matrix that are largest in absolute value."""
    return sim.orderBy(F.desc(F.round(F.abs("sim"), DIGITS)), F.desc("i"), F.desc("j")).limit(n)


def norms(matrix: DataFrame, by: str, kind: str, value: str = "value", name: str = "norm") -> DataFrame:
    v = F.col(value)
    total = {"l1": F.sum(F.abs(v)), "l2": F.sqrt(F.sum(v * v)), "count": F.count(F.lit(1)), "sum": F.sum(v), "mean": F.avg(v), "max": F.max(v)}[kind]
    return matrix.groupBy(by).agg(total.alias(name))


def normalised(matrix: DataFrame, by: str, kind: str = "l1", value: str = "value") -> DataFrame:
    """Each row divided by its norm; the windows share the shuffle of what follows on the same key."""
    v = F.col(value)
    each = Window.partitionBy(by)
    norm = F.sum(F.abs(v)).over(each) if kind == "l1" else F.sqrt(F.sum(v * v).over(each))
    return matrix.withColumn(value, v / norm)


def cooccurrences(matrix: DataFrame, key: str, thing: str, value: Column | None = None, columns: tuple[str, ...] = ("value",), keep: Column | None = None, name: str = "sim") -> DataFrame:
    """(i, j, name): sum over the key of value(a, b) for the pairs of things that share it, without the diagonal.

    `value` and `keep` may use the columns suffixed _a and _b.
    """
    a, b = (matrix.select(F.col(key).alias("__key"), F.col(thing).alias(t), *(F.col(c).alias(f"{c}_{s}") for c in columns)) for t, s in (("i", "a"), ("j", "b")))
    value = F.col("value_a") * F.col("value_b") if value is None else value
    both = a.join(b, "__key").filter(F.col("i") != F.col("j"))
    if keep is not None:
        both = both.filter(keep)
    return both.groupBy("i", "j").agg(F.sum(value).alias(name))


#: Pairs that one task joins and sums.
PAIRS = 2_000_000


def symmetric_counts(matrix: DataFrame, key: str = USER, thing: str = ITEM, name: str = "n") -> DataFrame:
    """(i, j, n): how many keys hold both things; each pair is joined and summed once, then mirrored.

    Where most pairs of things don't occur, joins and sums are dealt out by the
    number of pairs, PAIRS a task; else the sums hold no more than all pairs of
    things, in as many parts as the session shuffles to.
    """
    a, b = matrix.select(F.col(key).alias("__key"), F.col(thing).alias("i")), matrix.select(F.col(key).alias("__key"), F.col(thing).alias("j"))
    sizes = matrix.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()
    things, pairs = matrix.select(thing).distinct().count(), int(sizes[0])
    if pairs < things * (things - 1) // 2 and pairs > PAIRS:
        # most pairs of things are seen once or never: sums before the shuffle would hold nearly all of a task's pairs
        n = max(-(-pairs // PAIRS), matrix.sparkSession.sparkContext.defaultParallelism)
        both = a.repartition(n, "__key").join(b.repartition(n, "__key").hint("merge"), "__key").filter(F.col("i") < F.col("j")).select("i", "j").repartition(n, "i", "j")
    else:
        both = a.join(b, "__key").filter(F.col("i") < F.col("j"))
    half = both.groupBy("i", "j").agg(F.count(F.lit(1)).alias(name))
    return half.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p"), name).select("p.i", "p.j", name)


def scaled(df: DataFrame, factors: DataFrame, on: str, factor_key: str, factor: str, value: str, how: str = "divide") -> DataFrame:
    """A column divided (or multiplied) by the factor of its row or column; Spark broadcasts the factors where their size allows."""
    other = factors.select(F.col(factor_key).alias(on), F.col(factor).alias("__factor"))
    joined = df.join(other, on)
    by = F.col(value) / F.col("__factor") if how == "divide" else F.col(value) * F.col("__factor")
    return joined.withColumn(value, by).drop("__factor")


def applied(history: DataFrame, sim: DataFrame) -> DataFrame:
    """(uid, iid, score): history (uid, iid, value) times similarities (i, j, sim)."""
    rows = history.select(USER, F.col(ITEM).alias("i"), "value").join(sim, "i")
    return rows.groupBy(USER, F.col("j").alias(ITEM)).agg(F.sum(F.col("value") * F.col("sim")).alias("score")).filter("score <> 0")


def added(*matrices: DataFrame) -> DataFrame:
    """Sum of (uid, iid, score) tables."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy(USER, ITEM).agg(F.sum("score").alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Vectors that are sent at once, in bytes, and cells of a product that are held at once.
BLOCK_BYTES, TILE_ROWS, TILE_COLUMNS = 32 << 20, 256, 4096


def unit_rows(vectors: list) -> np.ndarray:
    out = np.array(vectors, np.float64)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def vector_blocks(vectors: DataFrame, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of at most `limit` bytes (one vector at least), the larger ids first."""
    ids, rows, size = [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-np.array(ids, np.int64), kind="stable")
        return np.array(ids, np.int64)[order], unit_rows(rows)[order]

    for i, v in vectors.toLocalIterator():
        row = np.array(v, np.float64)
        if ids and size + row.nbytes > limit:
            yield block()
            ids, rows, size = [], [], 0
        ids.append(i)
        rows.append(row)
        size += row.nbytes
    if ids:
        yield block()


def nearest_in_block(ids: np.ndarray, units: np.ndarray, others: np.ndarray, other_units: np.ndarray, k: int, itself: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sim) of the k nearest others of each id, ties to the larger one; with `itself`, equal ids count as well."""
    best, named = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
    for a in range(0, len(others), TILE_COLUMNS):
        part = others[a : a + TILE_COLUMNS]
        sim = units @ other_units[a : a + TILE_COLUMNS].T
        score = np.round(sim, DIGITS)
        score[(sim == 0) if itself else (sim == 0) | (ids[:, None] == part[None, :])] = -np.inf
        each = np.arange(len(ids))
        for _ in range(min(k, len(part))):
            # the first of equals has the larger id
            at = score.argmax(axis=1)
            best = np.hstack([best, np.where(score[each, at] > -np.inf, sim[each, at], -np.inf)[:, None]])
            named = np.hstack([named, part[at][:, None]])
            score[each, at] = -np.inf
        order = np.lexsort((-named, -np.round(best, DIGITS)), axis=-1)[:, :k]
        best, named = np.take_along_axis(best, order, 1), np.take_along_axis(named, order, 1)
    row, column = np.nonzero(best > -np.inf)
    return ids[row], named[row, column], best[row, column]


def nearest_vectors(vectors: DataFrame, k: int, limit: int = BLOCK_BYTES, among: DataFrame | None = None) -> DataFrame:
    """(i, j, sim): the k nearest by cosine of every vector (id, array) among all others, or among the vectors (id, array) of another table.

    One scan of all vectors for each block of at most `limit` bytes of those that they are held against.
    Null vectors are left out; a vector of norm 0 has no neighbours and is none.
    """
    spark, itself = vectors.sparkSession, among is not None

    def as_known(df: DataFrame) -> DataFrame:
        return df.toDF("i", "v").filter("i is not null and v is not null").select(F.col("i").cast("bigint").alias("i"), F.col("v").cast("array<double>").alias("v"))

    known = as_known(vectors)
    left = known.repartition(max(1, -(-known.count() // 1024)))

    def scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        others, units = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(lo, TILE_ROWS)
                i, j, sim = nearest_in_block(tile.column("i").to_numpy(), unit_rows(tile.column("v").to_pylist()), others, units, k, itself)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sim)], names=["i", "j", "sim"])

    out = None
    for block in vector_blocks(known if among is None else as_known(among), limit):
        sent = spark.sparkContext.broadcast(block)
        part = left.mapInArrow(lambda it, sent=sent: scan(it, sent), "i bigint, j bigint, sim double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "i bigint, j bigint, sim double")
    return top_k_neighbours(out, k)


#: Rows of a block of sparse rows on either side, columns that are multiplied at once, and blocks that one task holds of the other side.
LEFT_ROWS, RIGHT_ROWS, DENSE_COLUMNS, RIGHT_BLOCKS = 2048, 4096, 512, 16
_PACKED = ("ids", "counts", "items", "weights", "times")


def packed_rows(cells: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Sparse rows (id, i, w, t) as blocks of at most so many rows, in binary columns, and how many partitions they are in; a block's rows are in no other."""
    n = max(1, -(-cells.select("id").distinct().count() // rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("id", "i", "w", "t")] for b in batches if b.num_rows]
        if not parts:
            return
        ids, items, weights, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        starts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
        for lo in range(0, len(starts) - 1, rows):
            at = starts[lo : lo + rows + 1]
            cut = slice(at[0], at[-1])
            block = (ids[at[:-1]], np.diff(at), items[cut], weights[cut], times[at[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in block], names=list(_PACKED))

    cells = cells.select(F.col("id").cast("bigint").alias("id"), F.col("i").cast("bigint").alias("i"), F.col("w").cast("double").alias("w"), F.col("t").cast("double").alias("t")).dropna()
    return cells.repartition(n, "id").sortWithinPartitions("id").mapInArrow(pack, ", ".join(f"{c} binary" for c in _PACKED)), n


def unpacked(row: list) -> tuple[np.ndarray, ...]:
    """(ids, row of each cell, items, weights, times)."""
    ids, counts, items, weights, times = (np.frombuffer(v, t) for v, t in zip(row, (np.int64, np.int64, np.int64, np.float64, np.float64), strict=True))
    return ids, np.repeat(np.arange(len(ids)), counts), items, weights, times


def block_product(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], decay: float | None) -> np.ndarray:
    """Inner products of all rows of two blocks, 0 where they don't count: common columns that many hold by dense products, others cell by cell."""
    out = np.zeros((len(a[0]), len(b[0])))
    common = np.intersect1d(a[2], b[2])
    sides = []
    for _, rows, items, weights, _ in (a, b):
        at = np.searchsorted(common, items)
        at[at == len(common)] = 0
        kept = np.flatnonzero(common[at] == items) if len(common) else np.zeros(0, np.int64)
        kept = kept[np.argsort(at[kept], kind="stable")]
        first = np.searchsorted(at[kept], np.arange(len(common) + 1))
        sides.append((rows[kept], at[kept], weights[kept], first))
    (ra, ca, wa, fa), (rb, cb, wb, fb) = sides
    many = np.diff(fa) * np.diff(fb) * 8 > out.size
    hot = np.flatnonzero(many)
    for lo in range(0, len(hot), DENSE_COLUMNS):
        some, place = hot[lo : lo + DENSE_COLUMNS], np.full(len(common), -1)
        place[some] = np.arange(len(some))
        dense = []
        for r, c, w, n in ((ra, ca, wa, len(a[0])), (rb, cb, wb, len(b[0]))):
            here = place[c] >= 0
            m = np.zeros((n, len(some)))
            m[r[here], place[c[here]]] = w[here]
            dense.append(m)
        out += dense[0] @ dense[1].T
    for c in np.flatnonzero(~many):
        x, y = slice(fa[c], fa[c + 1]), slice(fb[c], fb[c + 1])
        out[np.ix_(ra[x], rb[y])] += np.outer(wa[x], wb[y])
    _, p, q = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    out[p, q] = 0
    if decay is not None:
        ta, tb = a[4], b[4]
        middle = (min(ta.min(), tb.min()) + max(ta.max(), tb.max())) / 2
        if abs(decay) * max(np.abs(ta - middle).max(), np.abs(tb - middle).max()) < 300:
            out *= np.exp(decay * (middle - ta))[:, None]
            out *= np.exp(decay * (tb - middle))[None, :]
        else:
            live = np.nonzero(out)
            out[live] *= np.exp(decay * (tb[live[1]] - ta[live[0]]))
        out[ta[:, None] == tb[None, :]] = 0
    return out


def keep_best(best: np.ndarray, named: np.ndarray, product: np.ndarray, others: np.ndarray) -> None:
    """The k best of each row of the product join those that are kept (-inf: none), by score to nine digits, ties to the larger id."""
    k = best.shape[1]
    for lo in range(0, len(product), TILE_ROWS):
        s, own, ids = product[lo : lo + TILE_ROWS], best[lo : lo + TILE_ROWS], named[lo : lo + TILE_ROWS]
        least = np.round(own[:, -1], DIGITS)
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh) and s.shape[1] > k:
            least[fresh] = np.round(np.partition(s[fresh], s.shape[1] - k, axis=1)[:, s.shape[1] - k], DIGITS)
        # what rounds to the k-th score or more, and is a cell at all
        r, c = np.nonzero(s >= np.maximum(least - 1e-9 - 1e-12 * np.abs(np.where(np.isinf(least), 0, least)), 5e-324)[:, None])
        if not len(r):
            continue
        old = np.nonzero(own > -np.inf)
        rows, scores, names = np.concatenate([old[0], r]), np.concatenate([own[old], s[r, c]]), np.concatenate([ids[old], others[c]])
        order = np.lexsort((-names, -np.round(scores, DIGITS), rows))
        rows, scores, names = rows[order], scores[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        own[rows[kept], place[kept]], ids[rows[kept], place[kept]] = scores[kept], names[kept]


def nearest_rows(left: DataFrame, right: DataFrame, k: int, decay: float | None = None) -> DataFrame:
    """(u, v, sim): for each row of the left the k rows of the right with the largest inner product, itself left out.

    Both sides are cells (id, i, w, t), distinct by (id, i), with weights above
    0; rows without a common column are no pair.  With a decay, products are
    multiplied by exp(decay * (t of v - t of u)), and rows of the same t are no
    pair.  All pairs are looked at, in products of blocks, so that only the k
    best of a row and a part of the right side are ever stored.
    """
    a, _ = packed_rows(left, LEFT_ROWS)
    b, n = packed_rows(right, RIGHT_ROWS)
    # read again by each task that meets them
    a, b = a.persist(), b.persist().coalesce(max(1, -(-n // RIGHT_BLOCKS)))
    both = a.toDF(*(f"a_{c}" for c in _PACKED)).crossJoin(b.toDF(*(f"b_{c}" for c in _PACKED)).hint("shuffle_replicate_nl"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = block = best = named = None

        def done() -> pa.RecordBatch:
            row, column = np.nonzero(best > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(block[0][row]), pa.array(named[row, column]), pa.array(best[row, column])], names=["u", "v", "sim"])

        for batch in batches:
            for n in range(batch.num_rows):
                cells = [batch.column(c)[n].as_buffer() for c in range(batch.num_columns)]
                own = cells[0].to_pybytes()
                if own != key:
                    if key is not None:
                        yield done()
                    # the batch's memory isn't kept
                    key, block = own, unpacked([c.to_pybytes() for c in cells[: len(_PACKED)]])
                    best, named = np.full((len(block[0]), k), -np.inf), np.zeros((len(block[0]), k), np.int64)
                other = unpacked(cells[len(_PACKED) :])
                keep_best(best, named, block_product(block, other, decay), other[0])
        if key is not None:
            yield done()

    return ranked(both.mapInArrow(scan, "u bigint, v bigint, sim double"), "u", "v", "sim", k).select("u", "v", "sim")


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec): the mean of all arrays (id, array) of an id, place by place; nulls are left out."""
    each = vectors.toDF("id", "v").filter("id is not null and v is not null").select("id", F.posexplode("v").alias("place", "x"))
    means = each.groupBy("id", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("all")).select("id", F.transform("all", lambda p: p["x"]).alias("vec"))


def assigned_clusters(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(i, j, sim): for every vector (id, array) the nearest of the centres (id, array) by cosine."""
    return nearest_vectors(vectors, 1, among=centres)


def row_set_nonzero(matrix: DataFrame, row: int, to: float = 0.0, by: str = USER, value: str = "value") -> DataFrame:
    """The matrix with all stored cells of a row set to one value; set to 0, they are stored no more."""
    out = matrix.withColumn(value, F.when(F.col(by) == row, F.lit(float(to))).otherwise(F.col(value)))
    return out.filter(F.col(value) != 0)
