"""Names of algorithms and metrics."""

from __future__ import annotations

from toplane.functions.metrics import METRICS
from toplane.operators.models import baseline, factor, knn, linear, neural, sequential, timeaware


class Registry:
    def __init__(self, known: dict[str, type]) -> None:
        self._known = dict(known)

    def __contains__(self, key: str) -> bool:
        return key in self._known

    def __getitem__(self, key: str) -> type:
        return self._known[key]

    get = __getitem__

    def register(self, key: str, cls: type) -> None:
        if key in self._known:
            raise KeyError(f"{key} is registered already")
        self._known[key] = cls

    def names(self) -> list[str]:
        return sorted(self._known)


def _models() -> dict[str, type]:
    from toplane.operators.models.base import Algorithm

    return {n: c for m in (baseline, factor, knn, linear, neural, sequential, timeaware) for n, c in vars(m).items() if isinstance(c, type) and issubclass(c, Algorithm) and c.__module__ == m.__name__ and not n.startswith("_")}


ALGORITHM_REGISTRY = Registry(_models())
METRIC_REGISTRY = Registry(METRICS)
