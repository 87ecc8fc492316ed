"""Factorisations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, USER, Interactions, to_matrix
from toplane.operators.models.base import Algorithm, FactorModel, SimilarityModel, scores_of
from toplane.operators.models.linear import dense, gram, item_index
from toplane.plans.algebra import dot

#: Pairs that one key's system is summed over in one place; longer histories go in parts.
PART = 10_000


def as_factors(spark, ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(id, vec), sent as Arrow buffers: no object for each number."""
    ids, vectors = np.asarray(ids, np.int64), np.ascontiguousarray(vectors, np.float64)
    ends = pa.array(np.arange(len(ids) + 1) * vectors.shape[1], pa.int32() if vectors.size < 1 << 31 else pa.int64())
    cells = (pa.ListArray if vectors.size < 1 << 31 else pa.LargeListArray).from_arrays(ends, pa.array(vectors.ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array(ids), "vec": cells}), "id bigint, vec array<double>")


def projected(x: DataFrame, items: DataFrame) -> DataFrame:
    """(id, vec) of users: the sum over their items of value * vec."""
    each = x.select(USER, ITEM, "value").join(items, x[ITEM] == items["id"]).select(USER, F.posexplode("vec").alias("k", "v"), "value")
    cells = each.groupBy(USER, "k").agg(F.sum(F.col("v") * F.col("value")).alias("v"))
    return cells.groupBy(F.col(USER).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("vec"))


class SVD(FactorModel):
    """The leading singular vectors, from the items' Gram matrix; scores are U S S V'."""

    def __init__(self, num_components: int = 100, seed: int = 42) -> None:
        self.num_components, self.seed = num_components, seed

    def _fit(self, x) -> None:
        items = item_index(x)
        values, vectors = np.linalg.eigh(dense(gram(x), items))
        k = min(self.num_components, len(items))
        values, vectors = np.sqrt(np.clip(values[::-1][:k], 0, None)), vectors[:, ::-1][:, :k]
        spark = x.sparkSession
        self.item_factors_ = as_factors(spark, items, vectors * values).persist()
        # X V is U S
        self.user_factors_ = projected(x, as_factors(spark, items, vectors)).persist()


class NMF(FactorModel):
    """Non-negative factors by multiplicative updates; each round is two sums over the pairs, users staying in Spark."""

    def __init__(self, num_components: int = 100, seed: int = 42, alpha: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 30) -> None:
        self.num_components, self.seed, self.alpha, self.l1_ratio, self.max_iter = num_components, seed, alpha, l1_ratio, max_iter

    def _fit(self, x) -> None:
        items, k = item_index(x), self.num_components
        rng = np.random.default_rng(self.seed)
        spark = x.sparkSession
        h = rng.random((k, len(items))) + 0.1
        l1, l2 = self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio)
        history = x.groupBy(USER).agg(F.collect_list(ITEM).alias("items"), F.collect_list(F.col("value").cast("double")).alias("values")).persist()

        def solved(rows, h, rounds=8):
            """Users' weights for the given item factors; they start alike and need no state."""
            hht = h @ h.T
            for u, own, values in rows:
                at = np.searchsorted(items, own)
                top = h[:, at] @ values
                w = np.full(k, max(float(np.mean(values)), 1e-3))
                for _ in range(rounds):
                    w = w * np.maximum(top - l1, 0) / (hht @ w + l2 * w + 1e-12)
                yield u, at, values, w

        for _ in range(self.max_iter):
            sent = spark.sparkContext.broadcast(h)

            def sums(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                h = sent.value
                wtx, wtw = np.zeros_like(h), np.zeros((k, k))
                for frame in frames:
                    for _, at, values, w in solved(zip(frame[USER], frame["items"], frame["values"], strict=True), h):
                        wtx[:, at] += np.outer(w, values)
                        wtw += np.outer(w, w)
                yield pd.DataFrame({"wtx": [wtx.tobytes()], "wtw": [wtw.tobytes()]})

            # one small row for each partition
            parts = history.coalesce(64).mapInPandas(sums, "wtx binary, wtw binary").collect()
            wtx = sum(np.frombuffer(p["wtx"]).reshape(h.shape) for p in parts)
            wtw = sum(np.frombuffer(p["wtw"]).reshape(k, k) for p in parts)
            h = h * np.maximum(wtx - l1, 0) / (wtw @ h + l2 * h + 1e-12)
        sent = spark.sparkContext.broadcast(h)

        def users(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = list(solved(zip(frame[USER], frame["items"], frame["values"], strict=True), sent.value))
                yield pd.DataFrame({"id": [r[0] for r in rows], "vec": [r[3] for r in rows]})

        self.user_factors_ = history.mapInPandas(users, "id bigint, vec array<double>").persist()
        self.item_factors_ = as_factors(spark, items, h.T).persist()
        history.unpersist()


class _ItemToItem(SimilarityModel):
    """Similarities are inner products of the items' factors, all of them, without the diagonal."""

    model: type[FactorModel]

    def __init__(self, num_components: int = 100, seed: int = 42) -> None:
        self.num_components, self.seed = num_components, seed

    def _fit(self, x) -> None:
        inner = self.model(self.num_components, self.seed)
        inner._fit(x)
        f = inner.item_factors_
        a, b = f.select(F.col("id").alias("i"), F.col("vec").alias("u")), f.select(F.col("id").alias("j"), F.col("vec").alias("v"))
        # items are a checked number (see linear.MAX_ITEMS), and the model is dense by definition
        self.similarity_ = a.crossJoin(F.broadcast(b)).filter("i <> j").select("i", "j", dot(F.col("u"), F.col("v")).alias("sim")).filter("sim <> 0").persist()


class NMFItemToItem(_ItemToItem):
    model = NMF


class SVDItemToItem(_ItemToItem):
    model = SVD


class WeightedMatrixFactorization(Algorithm):
    """Alternating least squares with confidences; users are solved anew from the history they are predicted for.

    A key's normal equations are summed from parts of at most PART pairs each,
    so a popular item is no hot group.
    """

    binary = False
    CONFIDENCES = ("minimal", "log-scaling")

    def __init__(self, confidence_scheme: str = "minimal", alpha: float = 40, epsilon: float = 1e-8, num_components: int = 100, regularization: float = 0.01, iterations: int = 20, seed: int = 42) -> None:
        if confidence_scheme not in self.CONFIDENCES:
            raise ValueError(f"confidence_scheme must be one of {self.CONFIDENCES}")
        self.confidence_scheme, self.alpha, self.epsilon = confidence_scheme, alpha, epsilon
        self.num_components, self.regularization, self.iterations, self.seed = num_components, regularization, iterations, seed

    def _input(self, x: Interactions | DataFrame) -> DataFrame:
        r = F.col("value").cast("double")
        c = F.lit(float(self.alpha)) * (r if self.confidence_scheme == "minimal" else F.log(1 + r / F.lit(float(self.epsilon))))
        return to_matrix(x).select(USER, ITEM, c.alias("c"))

    def _gram(self, factors: DataFrame) -> np.ndarray:
        k = self.num_components

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, k))
            for frame in frames:
                if len(frame):
                    y = np.stack(frame["vec"])
                    total += y.T @ y
            yield pd.DataFrame({"g": [total.tobytes()]})

        return sum(np.frombuffer(r["g"]).reshape(k, k) for r in factors.coalesce(64).mapInPandas(part, "g binary").collect())

    def _solve(self, x: DataFrame, own: str, other: str, factors: DataFrame) -> DataFrame:
        """(id, vec) of the own side, given the other side's."""
        k, lam, yty = self.num_components, self.regularization, self._gram(factors)
        parts = x.groupBy(own).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
        rows = x.join(parts, own).select(F.col(own).alias("id"), F.pmod(F.xxhash64(other), F.col("parts")).alias("part"), F.col(other).alias("__o"), "c")
        rows = rows.join(factors.select(F.col("id").alias("__o"), "vec"), "__o").select("id", "part", "c", "vec")

        def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[int, pa.RecordBatch]]:
            """(id, rows) of equal keys in a row within a batch."""
            for batch in batches:
                if batch.num_rows:
                    own = [batch.column(c).to_numpy() for c in keys]
                    at = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in own], 0)))
                    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), batch.num_rows], strict=True):
                        yield int(own[0][lo]), batch.slice(lo, hi - lo)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row for each part of a key in each batch."""
            for batch in batches:
                ids, a, b = [], [], []
                vec, c = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, k), batch.column("c").to_numpy()
                lo = 0
                for key, rows in runs([batch], ["id", "part"]):
                    y, w = vec[lo : lo + rows.num_rows], c[lo : lo + rows.num_rows]
                    ids.append(key)
                    a.append((y.T @ (y * w[:, None])).tobytes())
                    b.append((y.T @ (1 + w)).tobytes())
                    lo += rows.num_rows
                    if len(ids) * k * k > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["id", "a", "b"])
                        ids, a, b = [], [], []
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["id", "a", "b"])

        def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The systems of keys, whose parts come one after the other, also from batch to batch."""
            ready, last, a, b = [], None, None, None

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([i for i, _ in ready]), pa.array([v for _, v in ready], pa.list_(pa.float64()))], names=["id", "vec"])

            for key, rows in runs(batches, ["id"]):
                if key != last:
                    if last is not None:
                        ready.append((last, np.linalg.solve(yty + a + lam * np.eye(k), b)))
                    last, a, b = key, np.zeros((k, k)), np.zeros(k)
                for x, y in zip(rows.column("a"), rows.column("b"), strict=True):
                    a = a + np.frombuffer(x.as_buffer()).reshape(k, k)
                    b = b + np.frombuffer(y.as_buffer())
                if len(ready) >= 10_000:
                    yield out()
                    ready.clear()
            if last is not None:
                ready.append((last, np.linalg.solve(yty + a + lam * np.eye(k), b)))
                yield out()

        sums = rows.repartition("id", "part").sortWithinPartitions("id", "part").mapInArrow(summed, "id bigint, a binary, b binary")
        return sums.repartition("id").sortWithinPartitions("id").mapInArrow(solved, "id bigint, vec array<double>")

    def _fit(self, x) -> None:
        x = x.persist()
        k, seed = self.num_components, self.seed
        # a start that depends on the item's id alone
        noise = [((F.pmod(F.xxhash64(F.col(ITEM), F.lit(seed), F.lit(j)), F.lit(1_000_003)) / F.lit(1_000_003.0)) - 0.5) * 0.02 for j in range(k)]
        items = x.select(ITEM).distinct().select(F.col(ITEM).alias("id"), F.array(*noise).alias("vec"))
        for _ in range(self.iterations):
            users = self._solve(x, USER, ITEM, items).persist()
            items = self._solve(x, ITEM, USER, users).persist()
            items.count()
            users.unpersist()
        self.item_factors_ = items
        x.unpersist()

    def _predict(self, x) -> DataFrame:
        # counted before they are scored
        users = self._solve(x, USER, ITEM, self.item_factors_).persist()
        return scores_of(users, self.item_factors_, FactorModel.max_broadcast_bytes)


WMF = WeightedMatrixFactorization
