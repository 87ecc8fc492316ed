"""The interaction table: events of users on items, with or without times.

An `Interactions` wraps a DataFrame of `uid, iid, interactionid[, ts]` and a
shape.  It is a multiset: a pair may occur many times.  Every selection gives a
new object, keeps event ids and never shrinks the shape.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USER, ITEM, TIME, EVENT = "uid", "iid", "ts", "interactionid"


@dataclass(frozen=True)
class Properties:
    num_users: int
    num_items: int
    has_timestamps: bool


def dense_index(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with 0..n-1 in the given total order: ranges are numbered apart and offset by the ranges before.

    Only one count for each partition meets in one place.  The persisted frame
    holds on to its bounds: what a lost executor held is dealt out again by the
    same ones, so numbers neither change nor repeat.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).persist()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # as many rows as ranged has partitions
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, (place + F.col("__offset") - 1).cast("bigint")).drop("__part", "__offset")


def as_frame(spark: SparkSession, values: Iterable | DataFrame, name: str) -> DataFrame:
    """Distinct ids as a one-column DataFrame."""
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).cast("bigint").alias(name)).distinct()
    return spark.createDataFrame([(int(x),) for x in set(values)], f"{name} bigint")


class Interactions:
    """Events of users on items."""

    def __init__(self, df: DataFrame, item_ix: str, user_ix: str, timestamp_ix: str | None = None, shape: tuple[int, int] | None = None, interaction_ix: str | None = None, validate: bool = True) -> None:
        columns = [F.col(user_ix).cast("bigint").alias(USER), F.col(item_ix).cast("bigint").alias(ITEM)]
        if timestamp_ix is not None:
            columns.append(F.col(timestamp_ix).cast("double").alias(TIME))
        self.has_timestamps = timestamp_ix is not None
        if interaction_ix is not None:
            df = df.select(F.col(interaction_ix).cast("bigint").alias(EVENT), *columns)
        else:
            kept = df.select(*columns)
            order = ([TIME] if self.has_timestamps else []) + [USER, ITEM]
            df = dense_index(kept, order, EVENT)
        self.df = df.select(EVENT, USER, ITEM, *([TIME] if self.has_timestamps else []))
        self._shape = tuple(shape) if shape else None
        if shape and validate:
            users, items = self._largest()
            if users > shape[0] or items > shape[1]:
                raise ValueError(f"ids need a shape of at least {(users, items)}, not {tuple(shape)}")

    @classmethod
    def _of(cls, df: DataFrame, shape, has_timestamps: bool) -> Interactions:
        out = cls.__new__(cls)
        out.df, out._shape, out.has_timestamps = df, shape, has_timestamps
        return out

    def _with(self, df: DataFrame) -> Interactions:
        # a selection has the shape of what it was taken from
        out = self._of(df, self._shape, self.has_timestamps)
        if self._shape is None:
            out._parent = self
        return out

    def _largest(self) -> tuple[int, int]:
        row = self.df.agg(F.max(USER), F.max(ITEM)).first()
        return tuple(0 if x is None else int(x) + 1 for x in row)

    @property
    def shape(self) -> tuple[int, int]:
        if self._shape is None:
            parent = getattr(self, "_parent", None)
            self._shape = parent.shape if parent is not None else self._largest()
        return self._shape

    @property
    def properties(self) -> Properties:
        return Properties(*self.shape, self.has_timestamps)

    # ---- matrices as (uid, iid, value) tables

    @property
    def values(self) -> DataFrame:
        return self.df.groupBy(USER, ITEM).agg(F.count(F.lit(1)).alias("value"))

    @property
    def binary_values(self) -> DataFrame:
        return self.indices.withColumn("value", F.lit(1))

    @property
    def indices(self) -> DataFrame:
        return self.df.select(USER, ITEM).distinct()

    @property
    def last_timestamps(self) -> DataFrame:
        self._needs_times()
        return self.df.groupBy(USER, ITEM).agg(F.max(TIME).alias("value"))

    @property
    def timestamps(self) -> DataFrame:
        self._needs_times()
        return self.df.select(USER, ITEM, TIME)

    def _needs_times(self) -> None:
        if not self.has_timestamps:
            raise AttributeError("these interactions have no timestamps")

    def get_timestamp(self, interaction_id: int) -> float:
        self._needs_times()
        row = self.df.filter(F.col(EVENT) == interaction_id).select(TIME).first()
        if row is None:
            raise KeyError(interaction_id)
        return row[0]

    # ---- selections

    def _by_time(self, condition: Column) -> Interactions:
        self._needs_times()
        return self._with(self.df.filter(condition))

    def timestamps_gt(self, t: float) -> Interactions:
        return self._by_time(F.col(TIME) > t)

    def timestamps_gte(self, t: float) -> Interactions:
        return self._by_time(F.col(TIME) >= t)

    def timestamps_lt(self, t: float) -> Interactions:
        return self._by_time(F.col(TIME) < t)

    def timestamps_lte(self, t: float) -> Interactions:
        return self._by_time(F.col(TIME) <= t)

    def users_in(self, users: Iterable | DataFrame) -> Interactions:
        return self._with(self.df.join(as_frame(self.df.sparkSession, users, USER), USER, "left_semi"))

    def users_not_in(self, users: Iterable | DataFrame) -> Interactions:
        return self._with(self.df.join(as_frame(self.df.sparkSession, users, USER), USER, "left_anti"))

    def items_in(self, items: Iterable | DataFrame) -> Interactions:
        return self._with(self.df.join(as_frame(self.df.sparkSession, items, ITEM), ITEM, "left_semi"))

    def interactions_in(self, events: Iterable | DataFrame) -> Interactions:
        return self._with(self.df.join(as_frame(self.df.sparkSession, events, EVENT), EVENT, "left_semi"))

    def indices_in(self, pairs: DataFrame | Iterable[tuple[int, int]], check: bool = True) -> Interactions:
        """Events of the listed pairs; a pair listed twice gives its events twice, a pair without events is a KeyError."""
        if not isinstance(pairs, DataFrame):
            pairs = self.df.sparkSession.createDataFrame([(int(u), int(i)) for u, i in pairs], f"{USER} bigint, {ITEM} bigint")
        if check and (missing := pairs.join(self.df, [USER, ITEM], "left_anti").first()):
            raise KeyError(tuple(missing))
        return self._with(self.df.join(pairs.select(USER, ITEM), [USER, ITEM]))

    def eliminate_timestamps(self) -> Interactions:
        return self._of(self.df.drop(TIME), self.shape, False)

    def copy(self) -> Interactions:
        return self._with(self.df)

    def union(self, other: Interactions) -> Interactions:
        """All events of both, numbered anew: the other's ids come after this one's."""
        if self.shape != other.shape:
            raise ValueError(f"shapes differ: {self.shape}, {other.shape}")
        if self.has_timestamps != other.has_timestamps:
            raise ValueError("only one of the two has timestamps")
        both = self.df.withColumn("__side", F.lit(0)).unionByName(other.df.withColumn("__side", F.lit(1)))
        out = dense_index(both.withColumnRenamed(EVENT, "__old"), ["__side", "__old", USER, ITEM], EVENT)
        return self._of(out.drop("__side", "__old"), self.shape, self.has_timestamps)

    __add__ = union

    # ---- histories, one row per user

    def binary_item_history(self) -> DataFrame:
        return self.df.groupBy(USER).agg(F.array_sort(F.collect_set(ITEM)).alias("items"))

    def interaction_history(self) -> DataFrame:
        return self.df.groupBy(USER).agg(F.array_sort(F.collect_list(EVENT)).alias("interactions"))

    def _sorted_history(self, name: str, field: str) -> DataFrame:
        self._needs_times()
        events = F.array_sort(F.collect_list(F.struct(TIME, EVENT, ITEM)))
        return self.df.groupBy(USER).agg(F.transform(events, lambda x: x[field]).alias(name))

    def sorted_interaction_history(self) -> DataFrame:
        return self._sorted_history("interactions", EVENT)

    def sorted_item_history(self) -> DataFrame:
        """Items in order of (time, event id)."""
        return self._sorted_history("items", ITEM)

    # ---- counts

    @property
    def active_users(self) -> DataFrame:
        return self.df.select(USER).distinct()

    @property
    def active_items(self) -> DataFrame:
        return self.df.select(ITEM).distinct()

    @property
    def num_active_users(self) -> int:
        return self.active_users.count()

    @property
    def num_active_items(self) -> int:
        return self.active_items.count()

    @property
    def num_interactions(self) -> int:
        return self.df.count()

    @property
    def density(self) -> float:
        return self.indices.count() / (self.shape[0] * self.shape[1])

    # ---- files

    def save(self, prefix: str) -> None:
        """Parquet at the prefix, and the properties as JSON text beside it."""
        self.df.write.mode("overwrite").parquet(f"{prefix}.parquet")
        text = self.df.sparkSession.createDataFrame([(json.dumps(asdict(self.properties)),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{prefix}_properties")

    @classmethod
    def load(cls, spark: SparkSession, prefix: str) -> Interactions:
        row = Properties(**json.loads(spark.read.text(f"{prefix}_properties").first()[0]))
        return cls._of(spark.read.parquet(f"{prefix}.parquet"), (row.num_users, row.num_items), row.has_timestamps)

    @classmethod
    def from_matrix(cls, matrix: DataFrame, shape: tuple[int, int] | None = None) -> Interactions:
        """A cell of value c becomes c events without times."""
        events = matrix.filter("value >= 1").select(USER, ITEM, F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))).alias("__k"))
        return cls(events, ITEM, USER, shape=shape, validate=False)


def to_matrix(x: Interactions | DataFrame | tuple | list, binary: bool = False):
    """(uid, iid, value) tables of whatever is given, through tuples and lists."""
    if isinstance(x, (tuple, list)):
        return type(x)(to_matrix(y, binary) for y in x)
    if isinstance(x, Interactions):
        return x.binary_values if binary else x.values
    if isinstance(x, DataFrame):
        return to_binary(x) if binary else x
    raise TypeError(f"no matrix can be made of {type(x).__name__}")


def to_binary(matrix: DataFrame) -> DataFrame:
    return matrix.filter("value <> 0").select(USER, ITEM, F.lit(1).alias("value"))


def frame_to_matrix(df: DataFrame, item_ix: str, user_ix: str, value_ix: str | None = None) -> DataFrame:
    """Sums of the value column (ones without it) by pair."""
    value = F.lit(1) if value_ix is None else F.col(value_ix)
    return df.groupBy(F.col(user_ix).cast("bigint").alias(USER), F.col(item_ix).cast("bigint").alias(ITEM)).agg(F.sum(value).alias("value"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
