"""What all recommenders share."""

from __future__ import annotations

import inspect
import logging
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, TIME, USER, Interactions, to_matrix
from toplane.plans.algebra import applied, dot, top_k_neighbours

log = logging.getLogger("toplane")


class NotFittedError(ValueError):
    pass


class Algorithm(ABC):
    """fit(data) and predict(data); parameters are the constructor's arguments, kept under their names."""

    #: Whether data goes in as a 0/1 matrix; else as it is.
    binary = True

    @classmethod
    def param_names(cls) -> list[str]:
        return sorted(p for p in inspect.signature(cls.__init__).parameters if p not in ("self", "args", "kwargs"))

    def get_params(self) -> dict:
        return {p: getattr(self, p) for p in self.param_names()}

    def set_params(self, **params):
        for k, v in params.items():
            if k not in self.param_names():
                raise ValueError(f"{type(self).__name__} has no parameter {k}")
            setattr(self, k, v)
        return self

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def identifier(self) -> str:
        return f"{self.name}({','.join(f'{k}={v}' for k, v in self.get_params().items())})"

    def __str__(self) -> str:
        return self.name

    def _input(self, x: Interactions | DataFrame):
        return to_matrix(x, binary=True) if self.binary else to_matrix(x)

    def fit(self, x: Interactions | DataFrame, *args) -> Algorithm:
        self._fit(self._input(x), *args)
        self.fitted_ = True
        return self

    def predict(self, x: Interactions | DataFrame) -> DataFrame:
        if not getattr(self, "fitted_", False):
            raise NotFittedError(f"{self.name} must be fitted first")
        return self._predict(self._input(x))

    def users_without(self, x: Interactions | DataFrame, scores: DataFrame) -> int:
        """How many users have a history but no scores; a job, so it is for the caller to ask."""
        n = to_matrix(x).select(USER).distinct().join(scores.select(USER).distinct(), USER, "left_anti").count()
        if n:
            log.warning("%s has no recommendations for %d users with a history", self.name, n)
        return n

    @abstractmethod
    def _fit(self, x, *args) -> None: ...

    @abstractmethod
    def _predict(self, x) -> DataFrame: ...


class Timed:
    """Takes interactions with times."""

    def _input(self, x):
        if not isinstance(x, Interactions):
            raise TypeError(f"{self.name} needs interactions, not {type(x).__name__}")
        if not x.has_timestamps:
            raise ValueError(f"{self.name} needs timestamps")
        return x


class SimilarityModel(Algorithm):
    """Items' similarities; scores are history times similarities."""

    similarity_: DataFrame

    def _predict(self, x) -> DataFrame:
        return applied(x, self.similarity_)


class TopKSimilarityModel(SimilarityModel):
    def __init__(self, K: int = 200) -> None:
        self.K = K

    def _keep(self, sim: DataFrame, k: int | None = -1) -> None:
        self.similarity_ = top_k_neighbours(sim, self.K if k == -1 else k).persist()


class FactorModel(Algorithm):
    """Users' and items' vectors (id, vec); scores are inner products, for the users of the predict input that were trained."""

    user_factors_: DataFrame
    item_factors_: DataFrame
    #: Items' vectors are sent to all executors below this many bytes; above, blocks of items meet blocks of users.
    max_broadcast_bytes = 256 << 20

    def _predict(self, x) -> DataFrame:
        users = self.user_factors_.join(x.select(USER).distinct(), self.user_factors_["id"] == F.col(USER), "left_semi")
        return scores_of(users, self.item_factors_, self.max_broadcast_bytes)


#: Cells (user, item) of a dense result, or pairs, that one task holds at once.
CELLS = 2_000_000


def parts_for(cells: int, each: int = CELLS) -> int:
    """Partitions for so many cells: what a task holds stays the same as the input grows."""
    return max(1, -(-cells // each))


def scores_of(users: DataFrame, items: DataFrame, max_bytes: int) -> DataFrame:
    """All inner products of (id, vec) tables, as (uid, iid, score).

    This is a dense result by definition.  Items are a stated set of a checked
    size; if they are larger than max_bytes, they go in blocks, one pass of the
    users for each.  Users are dealt out so that a task has CELLS of it at most
    (or one user), also where a ranking by user follows; they are counted first.
    """
    n, width = items.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    users = users.repartition(parts_for(users.count() * n), "id")
    blocks = max(1, -(-(n * ((width or 0) * 8 + 16)) // max_bytes))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = users.select(F.col("id").alias(USER), F.col("vec").alias("u")).crossJoin(F.broadcast(part.select(F.col("id").alias(ITEM), F.col("vec").alias("v"))))
        rows = rows.select(USER, ITEM, dot(F.col("u"), F.col("v")).alias("score")).filter("score <> 0")
        out = rows if out is None else out.unionByName(rows)
    return out


def active_users(x: Interactions | DataFrame) -> DataFrame:
    return (x.df if isinstance(x, Interactions) else x).select(USER).distinct()


def times_of(x: Interactions) -> DataFrame:
    """(uid, iid, ts): the last time of each pair."""
    return x.df.groupBy(USER, ITEM).agg(F.max(TIME).alias(TIME))
