"""Decay functions as column expressions, with their allowed ranges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log(base: float, x: Column) -> Column:
    return F.log(x) / F.log(F.lit(float(base)))


@dataclass(frozen=True)
class Decay:
    """name, alpha and, for those over a bounded range, whether they need the largest distance n."""

    name: str
    alpha: float

    def __post_init__(self) -> None:
        if self.name not in _RULES:
            raise ValueError(f"unknown decay function {self.name}")
        allowed, _, _ = _RULES[self.name]
        if not allowed(self.alpha):
            raise ValueError(f"{self.alpha} is out of range for {self.name} decay")

    @property
    def bounded(self) -> bool:
        return _RULES[self.name][1]

    def __call__(self, x: Column, n: Column | None = None) -> Column:
        if self.bounded and n is None:
            raise ValueError(f"{self.name} decay needs the largest distance")
        return _RULES[self.name][2](x.cast("double"), None if n is None else n.cast("double"), float(self.alpha))


def checked(x: Column, n: Column) -> Column:
    """x, or an error where it is larger than n."""
    return F.when(x > n, F.raise_error(F.lit("a distance is larger than the range"))).otherwise(x)


_RULES: dict[str, tuple[Callable, bool, Callable]] = {
    "exponential": (lambda a: 0 <= a <= 1, False, lambda x, n, a: F.exp(-F.lit(a) * x)),
    "convex": (lambda a: 0 < a <= 1, False, lambda x, n, a: F.pow(F.lit(a), x)),
    "concave": (lambda a: 0 < a <= 1, True, lambda x, n, a: F.lit(1.0) - F.pow(F.lit(a), F.lit(1.0) - x / n)),
    "log": (lambda a: a > 1, True, lambda x, n, a: _log(a, F.lit(a - 1) * (F.lit(1.0) - x / n) + F.lit(1.0))),
    "linear": (lambda a: a >= 0, True, lambda x, n, a: F.greatest(F.lit(1.0) - F.lit(a) * x / n, F.lit(0.0))),
    "inverse": (lambda a: True, False, lambda x, n, a: F.when(x == 0, F.lit(1.0)).otherwise(F.lit(1.0) / x)),
    "none": (lambda a: True, False, lambda x, n, a: F.lit(1.0)),
}

DECAYS = tuple(_RULES)
