"""Filters on scores, before they are ranked.  A filtered cell is gone, not 0."""

from __future__ import annotations

import functools
from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import DataFrame

from toplane.operators.interactions import ITEM, USER, as_frame


class PostFilter(ABC):
    @abstractmethod
    def apply(self, scores: DataFrame) -> DataFrame:
        """The cells that stay."""

    def apply_all(self, *scores: DataFrame) -> list[DataFrame]:
        return [self.apply(s) for s in scores]


def _checked(items: Iterable[int] | DataFrame, num_items: int | None):
    if isinstance(items, DataFrame):
        return items
    items = list(items)
    if not items:
        raise ValueError("no items were given")
    if num_items is not None and max(items) >= num_items:
        raise ValueError(f"item {max(items)} is outside of {num_items} items")
    return items


class ExcludeItems(PostFilter):
    def __init__(self, items: Iterable[int] | DataFrame, num_items: int | None = None) -> None:
        self.items = _checked(items, num_items)

    def apply(self, scores: DataFrame) -> DataFrame:
        return scores.join(as_frame(scores.sparkSession, self.items, ITEM), ITEM, "left_anti").select(*scores.columns)


class SelectItems(PostFilter):
    def __init__(self, items: Iterable[int] | DataFrame, num_items: int | None = None) -> None:
        self.items = _checked(items, num_items)

    def apply(self, scores: DataFrame) -> DataFrame:
        return scores.join(as_frame(scores.sparkSession, self.items, ITEM), ITEM, "left_semi").select(*scores.columns)


class Postprocessor:
    """Filters in order."""

    def __init__(self) -> None:
        self.filters: list[PostFilter] = []

    def add_filter(self, filter_: PostFilter, index: int | None = None) -> None:
        self.filters.insert(len(self.filters) if index is None else index, filter_)

    def process(self, scores: DataFrame) -> DataFrame:
        return functools.reduce(lambda s, f: f.apply(s), self.filters, scores)

    def process_many(self, *scores: DataFrame) -> list[DataFrame]:
        return [self.process(s) for s in scores]


def without_history(scores: DataFrame, history: DataFrame) -> DataFrame:
    """Scores of pairs that the input doesn't hold."""
    return scores.join(history.select(USER, ITEM).distinct(), [USER, ITEM], "left_anti").select(*scores.columns)
