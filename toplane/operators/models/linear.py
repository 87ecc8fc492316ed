"""Linear item models.  Gram matrices are summed in Spark; the dense algebra has items squared cells by definition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, USER, to_matrix
from toplane.operators.models.base import SimilarityModel
from toplane.plans.algebra import applied, scaled, top_k_absolute

#: Items beyond which a dense items x items matrix is refused: 8 bytes a cell, some three of them.
MAX_ITEMS = 20_000


def item_index(x: DataFrame) -> np.ndarray:
    """The items that occur, in order; their number is checked before they are collected."""
    items = x.select(ITEM).distinct()
    if items.count() > MAX_ITEMS:
        raise ValueError(f"a dense model of more than {MAX_ITEMS} items: filter items first")
    return np.array(sorted(r[0] for r in items.collect()), np.int64)


def products(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, j, n): sum over users of x_ui * y_uj."""
    a, b = x.select(USER, F.col(ITEM).alias("i"), F.col("value").alias("a")), y.select(USER, F.col(ITEM).alias("j"), F.col("value").alias("b"))
    return a.join(b, USER).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("n"))


def gram(x: DataFrame) -> DataFrame:
    """(i, j, n) of x'x; each pair is summed once and mirrored."""
    a, b = x.select(USER, F.col(ITEM).alias("i"), F.col("value").alias("a")), x.select(USER, F.col(ITEM).alias("j"), F.col("value").alias("b"))
    half = a.join(b, USER).filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).cast("double").alias("n"))
    both = half.select("i", "j", "n", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("k"))
    return both.select(F.when(F.col("k") == 0, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(F.col("k") == 0, F.col("j")).otherwise(F.col("i")).alias("j"), "n")


def dense(cells: DataFrame, items: np.ndarray) -> np.ndarray:
    """A checked number of items squared, read in Arrow batches."""
    out = np.zeros((len(items), len(items)))
    t = cells.select("i", "j", "n").toArrow()
    out[np.searchsorted(items, t.column("i").to_numpy()), np.searchsorted(items, t.column("j").to_numpy())] = t.column("n").to_numpy()
    return out


def as_similarity(spark, matrix: np.ndarray, items: np.ndarray) -> DataFrame:
    rows, columns = np.nonzero(matrix)
    return spark.createDataFrame(pd.DataFrame({"i": items[rows], "j": items[columns], "sim": matrix[rows, columns]}))


class EASE(SimilarityModel):
    """Closed-form item weights: B = I - P diag(1 / diag P), P = (X'X + l2 I)^-1."""

    def __init__(self, l2: float = 1e3, alpha: float = 0, density: float | None = None) -> None:
        self.l2, self.alpha, self.density = l2, alpha, density

    def _weights(self, x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        items = item_index(x)
        p = np.linalg.inv(dense(gram(x), items) + self.l2 * np.eye(len(items)))
        b = -p / np.diag(p)[None, :]
        np.fill_diagonal(b, 0)
        return b, items

    def _finish(self, b: np.ndarray, items: np.ndarray, x: DataFrame) -> None:
        sim = as_similarity(x.sparkSession, b, items)
        if self.alpha:
            counts = x.groupBy(ITEM).agg(F.pow(F.count(F.lit(1)), F.lit(float(self.alpha))).alias("c"))
            sim = scaled(sim, counts, "j", ITEM, "c", "sim").select("i", "j", "sim")
        if self.density:
            sim = top_k_absolute(sim, int(self.density * len(items) ** 2))
        self.similarity_ = sim.persist()

    def _fit(self, x) -> None:
        b, items = self._weights(x)
        self._finish(b, items, x)


class EASE_XY(EASE):
    """EASE from a matrix X to another Y: fit(X, Y)."""

    def _fit(self, x, y) -> None:
        y = to_matrix(y, binary=True)
        items = item_index(x.select(ITEM).union(y.select(ITEM)))
        p = np.linalg.inv(dense(gram(x), items) + self.l2 * np.eye(len(items)))
        b = p @ dense(products(x, y), items)
        b = b - p * (np.diag(b) / np.diag(p))[None, :]
        np.fill_diagonal(b, 0)
        self._finish(b, items, x)


class SLIM(SimilarityModel):
    """Elastic-net regressions of each item on the others, by coordinate descent on the Gram matrix."""

    def __init__(self, l1_reg: float = 5e-4, l2_reg: float = 5e-5, fit_intercept: bool = True, ignore_neg_weights: bool = True, max_iter: int = 100, tol: float = 1e-6) -> None:
        self.l1_reg, self.l2_reg, self.fit_intercept, self.ignore_neg_weights = l1_reg, l2_reg, fit_intercept, ignore_neg_weights
        self.max_iter, self.tol = max_iter, tol

    def _fit(self, x) -> None:
        spark = x.sparkSession
        items = item_index(x)
        n = x.select(USER).distinct().count()
        g = dense(gram(x), items) / n
        if self.fit_intercept:
            mean = np.diag(g).copy()
            g = g - np.outer(mean, mean)
        # items squared cells, checked in item_index
        sent = spark.sparkContext.broadcast((g, items))
        l1, l2, clip, rounds, tol = self.l1_reg, self.l2_reg, self.ignore_neg_weights, self.max_iter, self.tol

        def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, items = sent.value
            curve = np.diag(g) + l2
            for frame in frames:
                for t in np.searchsorted(items, frame[ITEM].to_numpy()):
                    w, left = np.zeros(len(items)), g[:, t].copy()
                    for _ in range(rounds):
                        most = 0.0
                        for i in np.flatnonzero((np.abs(left) > l1) | (w != 0)):
                            if i == t or curve[i] <= 0:
                                continue
                            pull = left[i] + g[i, i] * w[i]
                            new = np.sign(pull) * max(abs(pull) - l1, 0) / curve[i]
                            if clip:
                                new = max(new, 0.0)
                            if new != w[i]:
                                left -= g[:, i] * (new - w[i])
                                most = max(most, abs(new - w[i]))
                                w[i] = new
                        if most < tol:
                            break
                    at = np.flatnonzero(w)
                    yield pd.DataFrame({"i": items[at], "j": np.full(len(at), items[t]), "sim": w[at]})

        self.similarity_ = x.select(ITEM).distinct().mapInPandas(solve, "i bigint, j bigint, sim double").persist()


class DAMIBCover(SimilarityModel):
    """Shared accounts: of a user's similarities to an item only the largest count, while they raise the score over n ** p."""

    AGGREGATIONS = ("adj", "sum", "avg")

    def __init__(self, algorithm: SimilarityModel | None = None, p: float = 0.75, agg: str = "adj") -> None:
        if agg not in self.AGGREGATIONS:
            raise ValueError(f"agg must be one of {self.AGGREGATIONS}")
        self.algorithm, self.p, self.agg = algorithm, p, agg

    def _fit(self, x) -> None:
        self.algorithm.fit(x)
        self.similarity_ = self.algorithm.similarity_

    def _predict(self, x) -> DataFrame:
        rows = x.select(USER, F.col(ITEM).alias("i")).join(self.similarity_, "i")
        # a list has at most one entry for each item of the user's history
        each = rows.groupBy(USER, F.col("j").alias(ITEM)).agg(F.sort_array(F.collect_list("sim"), asc=False).alias("sims"))
        p = F.lit(float(self.p))
        start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(False).alias("done"))

        def step(s, v):
            now = F.when(s["n"] == 0, F.lit(float("-inf"))).otherwise(s["total"] / F.pow(s["n"], p))
            grows = ~s["done"] & ((s["total"] + v) / F.pow(s["n"] + 1, p) >= now)
            return F.struct(F.when(grows, s["total"] + v).otherwise(s["total"]).alias("total"), F.when(grows, s["n"] + 1).otherwise(s["n"]).alias("n"), (~grows).alias("done"))

        best = F.aggregate("sims", start, step)
        score = {"sum": best["total"], "avg": best["total"] / best["n"], "adj": best["total"] / F.pow(best["n"], p)}[self.agg]
        return each.select(USER, ITEM, score.alias("score")).filter("score <> 0")


__all__ = ["DAMIBCover", "EASE", "EASE_XY", "SLIM", "applied"]
