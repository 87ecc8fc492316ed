"""Samplers of positives and negatives for the trained models, on numpy arrays, and what they draw from, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array: one search for each, however many are known."""
    if not len(known):
        return np.zeros(np.shape(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def unigram_distribution(counts: np.ndarray) -> np.ndarray:
    """Item probabilities by count to the power of 3/4."""
    p = np.asarray(counts, float) ** 0.75
    return p / p.sum()


def unigram_probabilities(events: DataFrame, item: str = "iid") -> DataFrame:
    """(item, p): unigram_distribution() over a table of events."""
    weights = events.groupBy(item).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(0.75)).alias("w"))
    # the total is one row by construction
    return weights.crossJoin(F.broadcast(weights.agg(F.sum("w").alias("total")))).select(item, (F.col("w") / F.col("total")).alias("p"))


def _in_order(user: str, time: list[str]) -> Window:
    return Window.partitionBy(user).orderBy(*time)


def skipgram_counts(events: DataFrame, window: int, user: str = "uid", item: str = "iid", time: list[str] | None = None) -> DataFrame:
    """(focus, context, n): items of a user at most `window` places apart, both ways; an item is no context of itself."""
    w = _in_order(user, time or ["ts"])
    near = F.array(*(F.lead(item, k).over(w) for k in range(1, window + 1)))
    pairs = events.select(F.col(item).alias("a"), near.alias("near")).select("a", F.explode("near").alias("b")).filter("b is not null and b <> a")
    # counted one way before they are mirrored
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))

    def way(focus: str, context: str) -> Column:
        return F.struct(F.col(focus).alias("focus"), F.col(context).alias("context"))

    return counts.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p"), "n").groupBy("p.focus", "p.context").agg(F.sum("n").alias("n"))


def next_items(events: DataFrame, user: str = "uid", item: str = "iid", time: list[str] | None = None) -> DataFrame:
    """(user, item, target, place): each event's item, the one after it, and its place from 1 on; the last event has no target and is left out."""
    w = _in_order(user, time or ["ts"])
    return events.select(user, F.col(item).alias("item"), F.lead(item).over(w).alias("target"), F.row_number().over(w).cast("bigint").alias("place")).filter("target is not null")


class PositiveNegativeSampler:
    """Batches of (users, positives, negatives).

    With `exact`, negatives are none of the user's items; else they only differ
    from the positive that they go with.
    """

    def __init__(self, num_negatives: int = 1, batch_size: int = 100, replace: bool = True, exact: bool = False, distribution: str = "uniform", seed: int = 42) -> None:
        if distribution not in ("uniform", "unigram"):
            raise ValueError("distribution must be uniform or unigram")
        self.num_negatives, self.batch_size, self.replace, self.exact, self.distribution = num_negatives, batch_size, replace, exact, distribution
        self.rng = np.random.default_rng(seed)

    def negatives(self, users: np.ndarray, positives: np.ndarray, known: set[int], num_items: int, p: np.ndarray | None) -> np.ndarray:
        shape = (len(users), self.num_negatives)
        draw = (lambda n: self.rng.integers(0, num_items, n)) if p is None else (lambda n: self.rng.choice(num_items, n, p=p))
        out = draw(shape)
        for _ in range(20):
            bad = found(users[:, None] * num_items + out, self._known) if self.exact else out == positives[:, None]
            if not bad.any():
                return out
            out[bad] = draw(int(bad.sum()))
        # what still clashes is drawn from the items that are allowed
        for r, c in zip(*np.nonzero(found(users[:, None] * num_items + out, self._known) if self.exact else out == positives[:, None]), strict=True):
            allowed = np.ones(num_items, bool)
            own = self._known[slice(*np.searchsorted(self._known, [users[r] * num_items, (users[r] + 1) * num_items]))] - users[r] * num_items if self.exact else positives[r : r + 1]
            allowed[own] = False
            if p is not None:
                allowed &= p > 0
            if not allowed.any():
                raise ValueError(f"user {users[r]} has no item left for a negative")
            left = np.flatnonzero(allowed)
            out[r, c] = self.rng.choice(left, p=None if p is None else p[left] / p[left].sum())
        return out

    def sample(self, users: np.ndarray, items: np.ndarray, num_items: int, sample_size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(users)
        size = n if sample_size is None else sample_size
        if not self.replace and size > n:
            raise ValueError("a sample without replacement can't be larger than the data")
        order = self.rng.integers(0, n, size) if self.replace and sample_size is not None else self.rng.permutation(n)[:size]
        p = unigram_distribution(np.bincount(items, minlength=num_items)) if self.distribution == "unigram" else None
        self._known = users * num_items + items
        if (self._known[1:] <= self._known[:-1]).any():
            self._known = np.unique(self._known)
        for lo in range(0, size, self.batch_size):
            at = order[lo : lo + self.batch_size]
            yield users[at], items[at], self.negatives(users[at], items[at], set(), num_items, p)


class BootstrapSampler(PositiveNegativeSampler):
    """As many positives as there are pairs, with replacement."""

    def sample(self, users, items, num_items, sample_size=None):
        yield from super().sample(users, items, num_items, len(users) if sample_size is None else sample_size)


class WarpSampler(PositiveNegativeSampler):
    """Exact negatives, several a positive."""

    def __init__(self, num_negatives: int = 20, batch_size: int = 100, seed: int = 42) -> None:
        super().__init__(num_negatives, batch_size, exact=True, seed=seed)


class SequenceBatches:
    """Batches of (users, padded items[, padded targets, negatives]); pad is num_items."""

    def __init__(self, pad: int, batch_size: int = 500, seed: int = 42) -> None:
        self.pad, self.batch_size, self.rng = pad, batch_size, np.random.default_rng(seed)

    def sample(self, users: np.ndarray, histories: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = sorted(self.rng.permutation(len(users)).tolist(), key=lambda i: -len(histories[i]))
        for lo in range(0, len(order), self.batch_size):
            at = order[lo : lo + self.batch_size]
            width = max(len(histories[i]) for i in at)
            out = np.full((len(at), width), self.pad)
            for r, i in enumerate(at):
                out[r, : len(histories[i])] = histories[i]
            yield users[at], out


class SequencePositivesTargetsNegatives(SequenceBatches):
    """Targets are the next items; negatives differ from the target."""

    def __init__(self, num_negatives: int, pad: int, batch_size: int = 500, seed: int = 42) -> None:
        super().__init__(pad, batch_size, seed)
        self.num_negatives = num_negatives

    def sample(self, users, histories):
        for u, x in super().sample(users, histories):
            positives, targets = x[:, :-1], x[:, 1:]
            negatives = self.rng.integers(0, self.pad, (*targets.shape, self.num_negatives))
            clash = negatives == targets[..., None]
            negatives[clash] = (negatives[clash] + 1) % self.pad
            yield u, positives, targets, negatives


def spot_collisions(users: np.ndarray, negatives: np.ndarray, known: np.ndarray, num_items: int) -> np.ndarray:
    """Which negatives are known pairs; known holds user * num_items + item."""
    return np.isin(users[:, None] * num_items + negatives, known)
