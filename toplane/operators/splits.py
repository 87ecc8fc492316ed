"""Splitters: one interaction table becomes an (in, out) pair.

Random ones order ids by an integer hash of (id, seed), so that any engine can
say which side a row falls on.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toplane.operators.interactions import EVENT, TIME, USER, Interactions, dense_index

#: Largest difference that unset time bounds stand for.
FOREVER = 2**31 - 1


def hashed(column: Column | str, seed: int) -> Column:
    """A repeatable pseudo-random integer below 1000003, for ids of any size."""
    column = F.col(column) if isinstance(column, str) else column
    return (column % F.lit(1000003) * F.lit(7919) + F.lit(seed * 104729)) % F.lit(1000003)


class Splitter(ABC):
    @abstractmethod
    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        """The two parts."""


class UserSplitter(Splitter):
    """Two given sets of users; users in neither are lost."""

    def __init__(self, users_in: Iterable | DataFrame, users_out: Iterable | DataFrame) -> None:
        self.users_in, self.users_out = users_in, users_out

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        return data.users_in(self.users_in), data.users_in(self.users_out)


class StrongGeneralizationSplitter(Splitter):
    """floor(n * in_frac) users in hash order; up to `tries` orders until the share of distinct pairs is near enough."""

    def __init__(self, in_frac: float = 0.7, seed: int = 42, error_margin: float = 0.01, tries: int = 5) -> None:
        self.in_frac, self.seed, self.error_margin, self.tries = in_frac, seed, error_margin, tries

    def users(self, data: Interactions, seed: int) -> DataFrame:
        """(uid, place): the users' places in the hash order."""
        users = data.active_users.withColumn("__h", hashed(USER, seed))
        return dense_index(users, ["__h", USER], "place").drop("__h")

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        pairs = data.df.groupBy(USER).agg(F.countDistinct("iid").alias("__n")).persist()
        total, n_users = pairs.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
        cut = int(n_users * self.in_frac)
        for k in range(self.tries):
            places = self.users(data, self.seed + k)
            chosen = places.filter(F.col("place") < cut).select(USER)
            inside = pairs.join(chosen, USER, "left_semi").agg(F.sum("__n")).first()[0] or 0
            if not total or abs(inside / total - self.in_frac) < self.error_margin:
                break
        pairs.unpersist()
        return data.users_in(chosen), data.users_not_in(chosen)


class UserInteractionTimeSplitter(Splitter):
    """Users whose last event is before t, and the others."""

    def __init__(self, t: float) -> None:
        self.t = t

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        data._needs_times()
        early = data.df.groupBy(USER).agg(F.max(TIME).alias("__last")).filter(F.col("__last") < self.t).select(USER)
        return data.users_in(early), data.users_not_in(early)


class FractionInteractionSplitter(Splitter):
    """Of each user's n events, the first ceil(n * in_frac) in hash order."""

    def __init__(self, in_frac: float = 0.7, seed: int = 42) -> None:
        self.in_frac, self.seed = in_frac, seed

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        each = Window.partitionBy(USER)
        place = F.row_number().over(each.orderBy(hashed(EVENT, self.seed), EVENT))
        marked = data.df.withColumn("__inside", place <= F.ceil(F.count(F.lit(1)).over(each) * F.lit(self.in_frac)))
        return data._with(marked.filter("__inside").drop("__inside")), data._with(marked.filter("not __inside").drop("__inside"))


class TimestampSplitter(Splitter):
    """[t - delta_in, t) and [t, t + delta_out)."""

    def __init__(self, t: float, delta_out: float | None = None, delta_in: float | None = None) -> None:
        self.t, self.delta_out, self.delta_in = t, delta_out, delta_in

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        before, after = data.timestamps_lt(self.t), data.timestamps_gte(self.t)
        if self.delta_in is not None:
            before = before.timestamps_gte(self.t - self.delta_in)
        if self.delta_out is not None:
            after = after.timestamps_lt(self.t + self.delta_out)
        return before, after


class MostRecentSplitter(Splitter):
    """Each user's last n events go out; for a negative n, all but the first |n|."""

    def __init__(self, n: int) -> None:
        self.n = n

    def split(self, data: Interactions) -> tuple[Interactions, Interactions]:
        data._needs_times()
        each = Window.partitionBy(USER)
        if self.n >= 0:
            out = F.row_number().over(each.orderBy(F.desc(TIME), F.desc(EVENT))) <= self.n
        else:
            out = F.row_number().over(each.orderBy(TIME, EVENT)) > -self.n
        marked = data.df.withColumn("__out", out)
        return data._with(marked.filter("not __out").drop("__out")), data._with(marked.filter("__out").drop("__out"))
