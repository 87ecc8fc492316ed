"""Popularity and random scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, USER
from toplane.operators.models.base import Algorithm, active_users, parts_for
from toplane.operators.splits import hashed
from toplane.plans.algebra import ranked


class Popularity(Algorithm):
    """Every active user gets the K items with the most users, scored by their share of the largest count."""

    def __init__(self, K: int = 200) -> None:
        self.K = K

    def _fit(self, x) -> None:
        counts = x.groupBy(ITEM).agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), F.desc(ITEM)).limit(self.K)
        most = counts.agg(F.max("n").alias("most"))
        # one row by construction
        self.scores_ = top.crossJoin(F.broadcast(most)).select(ITEM, (F.col("n") / F.col("most")).alias("score"))

    def _predict(self, x) -> DataFrame:
        # at most K rows
        return active_users(x).crossJoin(F.broadcast(self.scores_)).select(USER, ITEM, "score")


class Random(Algorithm):
    """The K items with the largest hash of (user, item, seed), scored by that hash; K=None scores all items."""

    def __init__(self, K: int | None = 200, seed: int = 42, use_only_interacted_items: bool = True, num_items: int | None = None) -> None:
        self.K, self.seed, self.use_only_interacted_items, self.num_items = K, seed, use_only_interacted_items, num_items

    def _fit(self, x) -> None:
        if self.use_only_interacted_items:
            self.items_ = x.select(ITEM).distinct()
        else:
            n = self.num_items if self.num_items is not None else x.agg(F.max(ITEM)).first()[0] + 1
            self.items_ = x.sparkSession.range(n).withColumnRenamed("id", ITEM)

    def _predict(self, x) -> DataFrame:
        draw = (hashed(F.col(USER) * 1009 + F.col(ITEM) * 9176 + F.col(USER) * F.col(ITEM) * 31, self.seed) + 1) / F.lit(1000004)
        # users times items is what the model is asked for when K is None; else only K a user are kept
        # users are dealt out so that a task ranks CELLS cells (or one user) at once; items are ids only
        users = active_users(x)
        n = users.count() * self.items_.count()
        scores = users.repartition(parts_for(n), USER).crossJoin(F.broadcast(self.items_)).withColumn("score", draw)
        return scores if self.K is None else ranked(scores, USER, ITEM, "score", self.K).select(USER, ITEM, "score")
