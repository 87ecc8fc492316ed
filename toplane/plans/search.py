"""Hyper-parameter searches: grids, and a small tree-structured Parzen estimator."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class GridSearchInfo:
    """All combinations of the listed values."""

    grid: dict[str, list]

    def points(self) -> Iterator[dict]:
        names = sorted(self.grid)
        for values in itertools.product(*(self.grid[n] for n in names)):
            yield dict(zip(names, values, strict=True))


@dataclass(frozen=True)
class Choice:
    """One of the options; an option that is a dict of spaces opens those spaces."""

    options: tuple

    def draw(self, rng):
        return self.options[int(rng.integers(len(self.options)))]


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, rng):
        lo, hi = (math.log(self.low), math.log(self.high)) if self.log else (self.low, self.high)
        return self.make(rng.uniform(lo, hi))

    def inner(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def make(self, x: float):
        value = min(max(math.exp(x) if self.log else x, self.low), self.high)
        return int(round(value)) if self.whole else value


@dataclass(frozen=True)
class Normal:
    mean: float
    sd: float

    def draw(self, rng):
        return float(rng.normal(self.mean, self.sd))


def choice(*options) -> Choice:
    return Choice(tuple(options[0]) if len(options) == 1 and isinstance(options[0], (list, tuple)) else options)


def uniform(low: float, high: float) -> Uniform:
    return Uniform(low, high)


def loguniform(low: float, high: float) -> Uniform:
    return Uniform(low, high, log=True)


def uniformint(low: int, high: int) -> Uniform:
    return Uniform(low, high, whole=True)


def randint(high: int) -> Uniform:
    return Uniform(0, high - 1, whole=True)


@dataclass
class HyperoptInfo:
    """A space (or a Choice of spaces) with a limit on time, on trials, or on both."""

    space: dict | Choice
    timeout: float | None = None
    max_evals: int | None = None
    seed: int = 42
    warm_up: int = 8
    history: list = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.timeout is None and self.max_evals is None:
            raise ValueError("a timeout or a number of trials is needed")

    def run(self, loss: Callable[[dict], float]) -> dict:
        """Calls loss on points until a limit is reached; returns the best one (the first of equals)."""
        rng, began = np.random.default_rng(self.seed), time.monotonic()
        while (self.max_evals is None or len(self.history) < self.max_evals) and (not self.history or self.timeout is None or time.monotonic() - began < self.timeout):
            point = self._next(rng)
            self.history.append((loss(point), point))
        return min(self.history, key=lambda x: x[0])[1]

    def _draw(self, rng) -> dict:
        space = self.space.draw(rng) if isinstance(self.space, Choice) else self.space
        return {k: v.draw(rng) if hasattr(v, "draw") else v for k, v in space.items()}

    def _next(self, rng) -> dict:
        if len(self.history) < self.warm_up:
            return self._draw(rng)
        ordered = sorted(self.history, key=lambda x: x[0])
        cut = max(2, len(ordered) // 4)
        good, bad = [p for _, p in ordered[:cut]], [p for _, p in ordered[cut:]]
        tries = [self._near(good, rng) for _ in range(24)]
        return max(tries, key=lambda p: self._density(p, good) - self._density(p, bad))

    def _spaces(self, point: dict) -> dict:
        if not isinstance(self.space, Choice):
            return self.space
        return next(s for s in self.space.options if set(s) == set(point))

    def _near(self, good: list[dict], rng) -> dict:
        base = good[int(rng.integers(len(good)))]
        out = {}
        for k, s in self._spaces(base).items():
            if isinstance(s, Uniform):
                lo, hi = s.inner(s.low), s.inner(s.high)
                out[k] = s.make(rng.normal(s.inner(base[k]), (hi - lo) / 5)) if base[k] > 0 or not s.log else s.draw(rng)
            elif isinstance(s, Normal):
                out[k] = float(rng.normal(base[k], s.sd / 3))
            elif isinstance(s, Choice):
                out[k] = s.draw(rng) if rng.random() < 0.3 else base[k]
            else:
                out[k] = s
        return out

    def _density(self, point: dict, points: list[dict]) -> float:
        total = 0.0
        like = [p for p in points if set(p) == set(point)]
        total += math.log((len(like) + 0.5) / (len(points) + 1))
        for k, s in self._spaces(point).items():
            if isinstance(s, (Uniform, Normal)):
                width = (s.inner(s.high) - s.inner(s.low)) / 5 if isinstance(s, Uniform) else s.sd / 3
                x = [s.inner(p[k]) if isinstance(s, Uniform) else p[k] for p in like]
                at = s.inner(point[k]) if isinstance(s, Uniform) else point[k]
                total += math.log(sum(math.exp(-0.5 * ((at - v) / max(width, 1e-12)) ** 2) for v in x) / max(len(x), 1) + 1e-6)
            elif isinstance(s, Choice):
                total += math.log((sum(p[k] == point[k] for p in like) + 0.5) / (len(like) + 0.5 * len(s.options)))
        return total
