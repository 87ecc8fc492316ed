"""Filters on raw logs.  Each takes one pass; their order matters; no k-core is iterated."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toplane.operators.interactions import dense_index


class Filter(ABC):
    @abstractmethod
    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that stay."""

    def apply_all(self, *frames: DataFrame) -> list[DataFrame]:
        return [self.apply(df) for df in frames]


class _CountFilter(Filter):
    """Keeps the keys whose number of (distinct) others lies within bounds."""

    def __init__(self, least: int | None, most: int | None, key: str, other: str, count_duplicates: bool) -> None:
        self.least, self.most, self.key, self.other, self.count_duplicates = least, most, key, other, count_duplicates

    def apply(self, df: DataFrame) -> DataFrame:
        pairs = df.select(self.key, self.other)
        # distinct pairs first, then counts: both sums combine before they move
        counts = (pairs if self.count_duplicates else pairs.distinct()).groupBy(self.key).agg(F.count(F.lit(1)).alias("__n"))
        if self.least is not None:
            counts = counts.filter(F.col("__n") >= self.least)
        if self.most is not None:
            counts = counts.filter(F.col("__n") <= self.most)
        return df.join(counts.select(self.key), self.key, "left_semi").select(*df.columns)


class MinUsersPerItem(_CountFilter):
    def __init__(self, min_users_per_item: int, item_ix: str, user_ix: str, count_duplicates: bool = False) -> None:
        super().__init__(min_users_per_item, None, item_ix, user_ix, count_duplicates)


class MinItemsPerUser(_CountFilter):
    def __init__(self, min_items_per_user: int, item_ix: str, user_ix: str, count_duplicates: bool = False) -> None:
        super().__init__(min_items_per_user, None, user_ix, item_ix, count_duplicates)


class MaxItemsPerUser(_CountFilter):
    def __init__(self, max_items_per_user: int, item_ix: str, user_ix: str, count_duplicates: bool = False) -> None:
        super().__init__(None, max_items_per_user, user_ix, item_ix, count_duplicates)


class _TopItems(Filter):
    def __init__(self, n: int, item_ix: str) -> None:
        self.n, self.item_ix = n, item_ix

    def _worth(self):
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        best = df.groupBy(self.item_ix).agg(self._worth().alias("__w")).orderBy(F.desc("__w"), F.asc(self.item_ix)).limit(self.n)
        return df.join(best.select(self.item_ix), self.item_ix, "left_semi").select(*df.columns)


class NMostPopular(_TopItems):
    """The N items with the most events; ties go to the smaller item."""

    def _worth(self):
        return F.count(F.lit(1))


class NMostRecent(_TopItems):
    """The N items with the latest last event; ties go to the smaller item."""

    def __init__(self, n: int, item_ix: str, timestamp_ix: str) -> None:
        super().__init__(n, item_ix)
        self.timestamp_ix = timestamp_ix

    def _worth(self):
        return F.max(self.timestamp_ix)


class MinRating(Filter):
    """Rows of at least this rating, without the rating column."""

    def __init__(self, min_rating: float, rating_ix: str = "rating") -> None:
        self.min_rating, self.rating_ix = min_rating, rating_ix

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.rating_ix) >= self.min_rating).drop(self.rating_ix)


class Deduplicate(Filter):
    """The first row of each pair: by time if there is one, ties (or all) by the `order` columns, else by the other columns."""

    def __init__(self, item_ix: str, user_ix: str, timestamp_ix: str | None = None, order: list[str] | None = None) -> None:
        self.item_ix, self.user_ix, self.timestamp_ix, self.order = item_ix, user_ix, timestamp_ix, order

    def apply(self, df: DataFrame) -> DataFrame:
        order = [self.timestamp_ix] if self.timestamp_ix else []
        order += self.order or [c for c in df.columns if c not in (self.item_ix, self.user_ix, self.timestamp_ix)]
        window = Window.partitionBy(self.user_ix, self.item_ix).orderBy(*(order or [self.item_ix]))
        return df.withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__n")


__all__ = ["Deduplicate", "Filter", "MaxItemsPerUser", "MinItemsPerUser", "MinRating", "MinUsersPerItem", "NMostPopular", "NMostRecent", "dense_index"]
