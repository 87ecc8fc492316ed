"""Metrics of ranked scores against held-out pairs.

`evaluate` ranks once, at the largest K, and takes every metric from that one
frame by conditional sums; the metric classes are views of it.  Users without
held-out pairs don't count; users without scores count with 0.
"""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, USER, Interactions, to_matrix
from toplane.plans.algebra import top_k_ranks

#: Weight that an item's inverse propensity does not exceed.
IPS_CAP = 10_000.0


def truth_of(y: Interactions | DataFrame) -> DataFrame:
    return to_matrix(y, binary=True).select(USER, ITEM) if isinstance(y, Interactions) or "value" in y.columns else y.select(USER, ITEM).distinct()


def check_shapes(a, b) -> None:
    if isinstance(a, Interactions) and isinstance(b, Interactions) and a.shape != b.shape:
        raise AssertionError(f"shapes differ: {a.shape}, {b.shape}")


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ideal(n: Column) -> Column:
    """Sum of the discounts of the first n ranks."""
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, j: s + discount(j))


def hits(truth: DataFrame, ranks: DataFrame) -> DataFrame:
    """(uid, iid, rank) of held-out pairs that were ranked."""
    return truth.join(ranks, [USER, ITEM])


def per_user(truth: DataFrame, ranks: DataFrame, ks: list[int], weights: DataFrame | None = None) -> DataFrame:
    """(uid, n_truth, and for each K hits_K, dcg_K, first_K[, ips_K]): one pass over the ranked frame, whatever the metrics."""
    sizes = truth.groupBy(USER).agg(F.count(F.lit(1)).alias("n_truth"))
    found = hits(truth, ranks)
    if weights is not None:
        found = found.join(weights, ITEM, "left")
    sums = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [F.sum(F.when(inside, 1).otherwise(0)).alias(f"hits_{k}"), F.sum(F.when(inside, discount(F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}"), F.min(F.when(inside, F.col("rank"))).alias(f"first_{k}")]
        if weights is not None:
            sums.append(F.sum(F.when(inside, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)).alias(f"ips_{k}"))
    found = found.groupBy(USER).agg(*sums)
    out = sizes.join(found, USER, "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) if not c.startswith("first") else F.col(c) for c in found.columns if c != USER]
    return out.select(USER, "n_truth", *filled)


#: Listwise scores of one user from the columns of per_user.
LISTWISE = {
    "PrecisionK": lambda k: F.col(f"hits_{k}") / F.lit(float(k)),
    "RecallK": lambda k: F.col(f"hits_{k}") / F.col("n_truth"),
    "CalibratedRecallK": lambda k: F.col(f"hits_{k}") / F.least("n_truth", F.lit(k)),
    "DCGK": lambda k: F.col(f"dcg_{k}") * F.lit(1.0),
    "NDCGK": lambda k: F.col(f"dcg_{k}") / ideal(F.least("n_truth", F.lit(k))),
    "ReciprocalRankK": lambda k: F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0)),
    "HitK": lambda k: F.col(f"hits_{k}") * F.lit(1.0),
    "DiscountedGainK": lambda k: F.col(f"dcg_{k}") * F.lit(1.0),
    "IPSHitRateK": lambda k: F.col(f"ips_{k}") * F.lit(1.0),
}
ELEMENTWISE = ("HitK", "DiscountedGainK", "IPSHitRateK")


def evaluate(truth: Interactions | DataFrame, scores: DataFrame, metrics: list[tuple[str, int]], propensity: DataFrame | None = None) -> DataFrame:
    """One row with a column Name_K for each listwise or elementwise metric, all from one ranking."""
    truth = truth_of(truth)
    ks = sorted({k for _, k in metrics})
    ranks = top_k_ranks(scores.join(truth.select(USER).distinct(), USER, "left_semi"), ks[-1])
    users = per_user(truth, ranks, ks, propensity if any(m == "IPSHitRateK" for m, _ in metrics) else None)
    return users.agg(*(F.avg(LISTWISE[m](k)).alias(f"{m}_{k}") for m, k in metrics))


class Metric(ABC):
    """calculate(y_true, y_pred), then value and results."""

    def __init__(self) -> None:
        self.scores_: DataFrame | None = None

    @property
    def name(self) -> str:
        return type(self).__name__

    def calculate(self, y_true: Interactions | DataFrame, y_pred: DataFrame, shape: tuple[int, int] | None = None) -> None:
        self.shape_ = y_true.shape if isinstance(y_true, Interactions) else shape
        self.truth_ = truth_of(y_true)
        self._calculate(y_pred.join(self.truth_.select(USER).distinct(), USER, "left_semi"))

    @property
    def num_users(self) -> int:
        return self.truth_.select(USER).distinct().count()

    @property
    def num_items(self) -> int:
        if self.shape_ is None:
            raise ValueError("this metric needs the shape of the data")
        return self.shape_[1]

    @abstractmethod
    def _calculate(self, y_pred: DataFrame) -> None: ...

    @property
    @abstractmethod
    def results(self) -> DataFrame: ...

    @property
    @abstractmethod
    def value(self) -> float: ...


class MetricTopK(Metric):
    def __init__(self, K: int) -> None:
        super().__init__()
        self.K = K

    @property
    def name(self) -> str:
        return f"{type(self).__name__}_{self.K}"

    def _weights(self) -> DataFrame | None:
        return None

    def _calculate(self, y_pred: DataFrame) -> None:
        self.y_pred_ = y_pred
        self.ranks_ = top_k_ranks(y_pred, self.K)


class ListwiseMetricK(MetricTopK):
    """One score a user; the value is their mean."""

    @property
    def results(self) -> DataFrame:
        users = per_user(self.truth_, self.ranks_, [self.K], self._weights())
        return users.select(F.col(USER).alias("user_id"), LISTWISE[type(self).__name__](self.K).alias("score"))

    @property
    def value(self) -> float:
        return self.results.agg(F.avg("score")).first()[0] or 0.0


class ElementwiseMetricK(ListwiseMetricK):
    """A score for each ranked item; the value is the mean over users of their sums."""

    def _element(self, hit: Column) -> Column:
        return F.when(hit, 1.0).otherwise(0.0)

    @property
    def results(self) -> DataFrame:
        marked = self.ranks_.join(self.truth_.withColumn("__hit", F.lit(True)), [USER, ITEM], "left")
        weights = self._weights()
        if weights is not None:
            marked = marked.join(weights, ITEM, "left")
        rows = marked.select(F.col(USER).alias("user_id"), F.col(ITEM).alias("item_id"), self._element(F.col("__hit").isNotNull()).alias("score"))
        # users without any score have K empty places
        none = self.truth_.select(USER).distinct().join(self.ranks_.select(USER).distinct(), USER, "left_anti")
        empty = none.select(F.col(USER).alias("user_id"), F.explode(F.array_repeat(F.lit(None).cast("bigint"), self.K)).alias("item_id"), F.lit(0.0).alias("score"))
        return rows.unionByName(empty)

    @property
    def value(self) -> float:
        users = per_user(self.truth_, self.ranks_, [self.K], self._weights())
        return users.agg(F.avg(LISTWISE[type(self).__name__](self.K))).first()[0] or 0.0


class PrecisionK(ListwiseMetricK):
    pass


class RecallK(ListwiseMetricK):
    pass


class CalibratedRecallK(ListwiseMetricK):
    pass


class DCGK(ListwiseMetricK):
    pass


class NDCGK(ListwiseMetricK):
    pass


class ReciprocalRankK(ListwiseMetricK):
    pass


class HitK(ElementwiseMetricK):
    pass


class DiscountedGainK(ElementwiseMetricK):
    def _element(self, hit: Column) -> Column:
        return F.when(hit, discount(F.col("rank"))).otherwise(0.0)


class FittedMetric:
    """Needs fit(data) before calculate."""

    fitted_ = False

    def _check(self) -> None:
        if not self.fitted_:
            raise AssertionError(f"{type(self).__name__} must be fitted first")


def propensity_weights(x: Interactions | DataFrame) -> DataFrame:
    """(iid, weight): all interactions by the item's, at most IPS_CAP."""
    counts = to_matrix(x).groupBy(ITEM).agg(F.sum("value").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    # one row by construction
    return counts.crossJoin(F.broadcast(total)).select(ITEM, F.least(F.col("total") / F.col("c"), F.lit(IPS_CAP)).alias("weight"))


class IPSHitRateK(FittedMetric, ElementwiseMetricK):
    """Hits weighted by the inverse of the item's share of interactions."""

    def fit(self, x: Interactions | DataFrame) -> None:
        self.weights_ = propensity_weights(x)
        self.fitted_ = True

    def _weights(self) -> DataFrame:
        self._check()
        return self.weights_

    def _element(self, hit: Column) -> Column:
        return F.when(hit, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)


class GlobalMetricK(MetricTopK):
    @property
    def results(self) -> DataFrame:
        return self.truth_.sparkSession.createDataFrame([(float(self.value),)], "score double")


class CoverageK(GlobalMetricK):
    """Share of the items that some user with held-out pairs was recommended."""

    @property
    def value(self) -> float:
        return self.ranks_.select(ITEM).distinct().count() / self.num_items


class IntraListDiversityK(FittedMetric, ListwiseMetricK):
    """Mean Jaccard distance of the features of two items of a list; 0 for lists of one."""

    def fit(self, features: DataFrame) -> None:
        """features: (iid, fid) pairs."""
        self.features_ = features.select(ITEM, "fid").distinct()
        self.fitted_ = True

    @property
    def results(self) -> DataFrame:
        self._check()
        sets = self.features_.groupBy(ITEM).agg(F.collect_set("fid").alias("f"))
        rows = self.ranks_.join(sets, ITEM, "left").select(USER, ITEM, F.coalesce("f", F.array().cast("array<bigint>")).alias("f"))
        a, b = rows.select(USER, F.col(ITEM).alias("i"), F.col("f").alias("fi")), rows.select(USER, F.col(ITEM).alias("j"), F.col("f").alias("fj"))
        # lists hold K items at most, so a user has K * K / 2 pairs at most
        pairs = a.join(b, USER).filter("i < j")
        union = F.size(F.array_union("fi", "fj"))
        apart = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("fi", "fj")) / union)
        found = pairs.groupBy(USER).agg(F.avg(apart).alias("score"))
        return self.truth_.select(USER).distinct().join(found, USER, "left").select(F.col(USER).alias("user_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


class PercentileRanking(Metric):
    """Mean place of held-out items in their users' lists, in percent; unscored items stand half way down the rest."""

    def _calculate(self, y_pred: DataFrame) -> None:
        self.ranks_ = top_k_ranks(y_pred)

    @property
    def results(self) -> DataFrame:
        return self.truth_.sparkSession.createDataFrame([(float(self.value),)], "score double")

    def places(self) -> DataFrame:
        """(uid, iid, place): in percent."""
        n = F.lit(float(self.num_items))
        deepest = self.ranks_.groupBy(USER).agg(F.max("rank").alias("deepest"))
        rows = self.truth_.join(self.ranks_, [USER, ITEM], "left").join(deepest, USER, "left")
        missed = ((F.coalesce("deepest", F.lit(1)) - 1) / n + 1) / 2
        return rows.select(USER, ITEM, (100 * F.when(F.col("rank").isNotNull(), (F.col("rank") - 1) / n).otherwise(missed)).alias("place"))

    @property
    def value(self) -> float:
        return self.places().agg(F.avg("place")).first()[0] or 0.0


METRICS = {c.__name__: c for c in (PrecisionK, RecallK, CalibratedRecallK, DCGK, NDCGK, ReciprocalRankK, HitK, DiscountedGainK, IPSHitRateK, CoverageK, IntraListDiversityK, PercentileRanking)}


def _value(cls, y_true, y_pred: DataFrame, k: int) -> float:
    metric = cls(k)
    metric.calculate(y_true, y_pred)
    return metric.value


dcg_k, ndcg_k, recall_k, calibrated_recall_k, precision_k = (functools.partial(_value, c) for c in (DCGK, NDCGK, RecallK, CalibratedRecallK, PrecisionK))
__all__ = [*METRICS, "METRICS", "Window", "evaluate", "per_user"]
