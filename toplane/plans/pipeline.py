"""Experiments: for each algorithm search, train, predict, filter, and measure."""

from __future__ import annotations

import json
import os
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from toplane.functions.metrics import LISTWISE, FittedMetric, Metric, MetricTopK, evaluate, propensity_weights
from toplane.operators.interactions import Interactions
from toplane.operators.models.base import Algorithm
from toplane.operators.postprocess import Postprocessor, PostFilter, without_history
from toplane.operators.scenarios import Scenario
from toplane.plans.search import GridSearchInfo, HyperoptInfo


@dataclass
class MetricEntry:
    name: str
    K: int | None = None


@dataclass
class AlgorithmEntry:
    name: str
    params: dict = field(default_factory=dict)
    optimisation: GridSearchInfo | HyperoptInfo | None = None


class Pipeline:
    """Made by PipelineBuilder."""

    def __init__(self, results_directory, algorithms, metrics, full_training, validation_training, validation, test, post, optimisation_metric, remove_history, fit_data, algorithm_registry, metric_registry) -> None:
        self.results_directory, self.algorithms, self.metrics = results_directory, algorithms, metrics
        self.full_training, self.validation_training, self.validation, self.test = full_training, validation_training, validation, test
        self.post, self.optimisation_metric, self.remove_history, self.fit_data = post, optimisation_metric, remove_history, fit_data
        self.algorithm_registry, self.metric_registry = algorithm_registry, metric_registry
        self._results: dict[str, dict[str, float]] = {}
        self._searches: list[dict] = []

    def run(self) -> None:
        for entry in self.algorithms:
            params = self._optimised(entry) if entry.optimisation is not None else dict(entry.params)
            algorithm = self.algorithm_registry[entry.name](**params)
            self._train(algorithm, self.validation_training if _trains_on_validation(algorithm) else self.full_training)
            scores = self._scores(algorithm, self.test[0])
            self._results[algorithm.identifier] = self._measure(scores, self.test[1], self.metrics)

    def _train(self, algorithm: Algorithm, data: Interactions) -> None:
        if _trains_on_validation(algorithm):
            algorithm.fit(data, self.validation)
        else:
            algorithm.fit(data)

    def _scores(self, algorithm: Algorithm, given: Interactions) -> DataFrame:
        scores = algorithm.predict(given)
        if self.remove_history:
            scores = without_history(scores, given.df)
        return self.post.process(scores)

    def _measure(self, scores: DataFrame, truth: Interactions, entries: list[MetricEntry]) -> dict[str, float]:
        """All listwise metrics come from one ranking; the others have a job each on the kept scores."""
        together = [(e.name, e.K) for e in entries if e.name in LISTWISE]
        others = [e for e in entries if e.name not in LISTWISE]
        if others and together:
            scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
        out = {}
        if together:
            weights = propensity_weights(self._fit_for("IPSHitRateK") or self.full_training) if any(m == "IPSHitRateK" for m, _ in together) else None
            out |= evaluate(truth, scores, together, weights).first().asDict()
        for e in others:
            cls = self.metric_registry[e.name]
            metric: Metric = cls(e.K) if issubclass(cls, MetricTopK) else cls()
            if isinstance(metric, FittedMetric):
                if (data := self._fit_for(e.name)) is None:
                    raise ValueError(f"{e.name} needs data to be fitted on")
                metric.fit(data)
            metric.calculate(truth, scores)
            out[metric.name] = metric.value
        if others and together:
            scores.unpersist()
        return {(f"{e.name}_{e.K}" if e.K is not None else e.name): out[f"{e.name}_{e.K}" if e.K is not None else e.name] or 0.0 for e in entries}

    def _fit_for(self, name: str):
        return self.fit_data.get(name)

    def _optimised(self, entry: AlgorithmEntry) -> dict:
        goal, minimise = self.optimisation_metric

        def loss(params: dict) -> float:
            algorithm = self.algorithm_registry[entry.name](**{**entry.params, **params})
            self._train(algorithm, self.validation_training)
            (name, value), = self._measure(self._scores(algorithm, self.validation[0]), self.validation[1], [goal]).items()
            self._searches.append({"identifier": algorithm.identifier, "params": algorithm.get_params(), "algorithm": entry.name, name: value})
            return value if minimise else -value

        info = entry.optimisation
        if isinstance(info, GridSearchInfo):
            points = list(info.points())
            losses = [loss(p) for p in points]
            best = points[losses.index(min(losses))]
        else:
            best = info.run(loss)
        return {**entry.params, **best}

    def get_metrics(self, short: bool = False) -> pd.DataFrame:
        table = pd.DataFrame.from_dict(self._results, orient="index")
        return table.rename(index=lambda x: x.split("(")[0]) if short else table

    @property
    def optimisation_results(self) -> pd.DataFrame:
        return pd.DataFrame(self._searches)

    def get_num_users(self) -> int:
        return self.test[1].num_active_users

    def save_metrics(self) -> None:
        os.makedirs(self.results_directory, exist_ok=True)
        with open(os.path.join(self.results_directory, "results.json"), "w") as f:
            json.dump(self._results, f, indent=1)
        if self._searches:
            with open(os.path.join(self.results_directory, "optimisation_results.json"), "w") as f:
                json.dump(self._searches, f, indent=1, default=str)


def _trains_on_validation(algorithm: Algorithm) -> bool:
    return getattr(algorithm, "needs_validation", False)


class PipelineBuilder:
    """Collects what an experiment needs and checks it."""

    def __init__(self, folder_name: str = "experiment", base_path: str = ".") -> None:
        from toplane.plans.registry import ALGORITHM_REGISTRY, METRIC_REGISTRY

        self.results_directory = os.path.join(base_path, folder_name)
        self.algorithm_registry, self.metric_registry = ALGORITHM_REGISTRY, METRIC_REGISTRY
        self.algorithms: list[AlgorithmEntry] = []
        self.metrics: list[MetricEntry] = []
        self.post = Postprocessor()
        self.optimisation_metric: tuple[MetricEntry, bool] | None = None
        self.full_training = self.validation_training = self.validation = self.test = None
        self.remove_history = True
        self.fit_data: dict[str, object] = {}

    @staticmethod
    def _name(x, registry, what: str) -> str:
        name = x.__name__ if isinstance(x, type) else x
        if name not in registry:
            if isinstance(x, type):
                registry.register(name, x)
            else:
                raise ValueError(f"{what} {name} is not known")
        return name

    def add_metric(self, metric: str | type, K: int | list[int] | None = None, fit_data=None) -> None:
        name = self._name(metric, self.metric_registry, "metric")
        for k in K if isinstance(K, (list, tuple)) else [K]:
            entry = MetricEntry(name, k)
            if entry not in self.metrics:
                self.metrics.append(entry)
        if fit_data is not None:
            self.fit_data[name] = fit_data

    def add_algorithm(self, algorithm: str | type, grid: dict | None = None, params: dict | None = None, optimisation_info=None) -> None:
        name = self._name(algorithm, self.algorithm_registry, "algorithm")
        if grid and optimisation_info is not None:
            raise ValueError("give a grid or a search, not both")
        self.algorithms.append(AlgorithmEntry(name, params or {}, GridSearchInfo(grid) if grid else optimisation_info))

    def add_post_filter(self, filter_: PostFilter) -> None:
        self.post.add_filter(filter_)

    def set_optimisation_metric(self, metric: str | type, K: int | None = None, minimise: bool = False) -> None:
        self.optimisation_metric = (MetricEntry(self._name(metric, self.metric_registry, "metric"), K), minimise)

    def set_full_training_data(self, data: Interactions) -> None:
        self.full_training = data

    def set_validation_training_data(self, data: Interactions) -> None:
        self.validation_training = data

    def set_validation_data(self, data: tuple[Interactions, Interactions]) -> None:
        self._pair(data)
        self.validation = data

    def set_test_data(self, data: tuple[Interactions, Interactions]) -> None:
        self._pair(data)
        self.test = data

    @staticmethod
    def _pair(data) -> None:
        if not isinstance(data, tuple) or len(data) != 2:
            raise RuntimeError("an (in, out) pair is needed")

    def set_data_from_scenario(self, scenario: Scenario) -> None:
        self.full_training = scenario.full_training_data
        self.test = scenario.test_data
        if scenario.validation:
            self.validation_training, self.validation = scenario.validation_training_data, scenario.validation_data

    def _check(self) -> None:
        if not self.metrics:
            raise RuntimeError("no metric was added")
        if not self.algorithms:
            raise RuntimeError("no algorithm was added")
        if self.full_training is None or self.test is None:
            raise RuntimeError("training and test data are needed")
        searched = any(a.optimisation is not None for a in self.algorithms)
        trained = any(getattr(self.algorithm_registry[a.name], "needs_validation", False) for a in self.algorithms)
        if (searched or trained) and (self.validation is None or self.validation_training is None):
            raise RuntimeError("validation data are needed")
        if searched and self.optimisation_metric is None:
            raise RuntimeError("an optimisation metric is needed")
        parts = [self.full_training, *self.test, *((self.validation_training, *self.validation) if self.validation else ())]
        shapes = defaultdict(list)
        for p in parts:
            shapes[p.shape].append(p)
        if len(shapes) > 1:
            raise RuntimeError(f"shapes differ: {sorted(shapes)}")

    def build(self) -> Pipeline:
        self._check()
        return Pipeline(self.results_directory, self.algorithms, self.metrics, self.full_training, self.validation_training, self.validation, self.test, self.post, self.optimisation_metric, self.remove_history, self.fit_data, self.algorithm_registry, self.metric_registry)
