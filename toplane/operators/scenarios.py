"""Scenarios: train, validation and test parts for one way of evaluating."""

from __future__ import annotations

import logging
import math
from abc import ABC, abstractmethod

from toplane.operators.interactions import USER, Interactions
from toplane.operators.splits import FOREVER, FractionInteractionSplitter, MostRecentSplitter, StrongGeneralizationSplitter, TimestampSplitter, UserInteractionTimeSplitter

log = logging.getLogger("toplane")
Pair = tuple[Interactions, Interactions]


def matched(pair: Pair) -> Pair:
    """Both parts, with the users that have events in both."""
    a, b = pair
    users = a.active_users.join(b.active_users, USER, "left_semi")
    return a.users_in(users), b.users_in(users)


class Scenario(ABC):
    def __init__(self, validation: bool = False, seed: int = 42) -> None:
        self.validation, self.seed = validation, seed
        self.validation_splitter = StrongGeneralizationSplitter(0.8, seed)
        self._parts: dict[str, Interactions | Pair] = {}

    def split(self, data: Interactions) -> None:
        self._split(data)

    @abstractmethod
    def _split(self, data: Interactions) -> None:
        """Fills full_training, test and, if asked for, validation_training and validation."""

    def _get(self, name: str):
        if name not in self._parts:
            raise KeyError("split before data is asked for" if not self._parts else "this scenario was made without validation data")
        return self._parts[name]

    @property
    def full_training_data(self) -> Interactions:
        return self._get("full_training")

    @property
    def validation_training_data(self) -> Interactions:
        return self._get("validation_training")

    @property
    def validation_data(self) -> Pair | None:
        return matched(self._get("validation")) if self.validation else None

    @property
    def validation_data_in(self) -> Interactions:
        return matched(self._get("validation"))[0]

    @property
    def validation_data_out(self) -> Interactions:
        return matched(self._get("validation"))[1]

    @property
    def test_data(self) -> Pair:
        return matched(self._get("test"))

    @property
    def test_data_in(self) -> Interactions:
        return self.test_data[0]

    @property
    def test_data_out(self) -> Interactions:
        return self.test_data[1]

    def check_sizes(self, data: Interactions, least: float = 0.05, least_users: float = 0.01) -> list[str]:
        """Warnings about parts that hold a small share of the data; this runs jobs, so it is for the caller to ask."""
        total, users, said = data.num_interactions, data.num_active_users, []
        parts = {k: v for k, v in self._parts.items()}
        for name, part in parts.items():
            for side, x in zip(("in", "out"), part if isinstance(part, tuple) else (part,), strict=False):
                label = f"{name} {side}" if isinstance(part, tuple) else name
                if x.num_interactions < least * total:
                    said.append(f"{label} has less than {least:.0%} of the interactions")
                if x.num_active_users < least_users * users:
                    said.append(f"{label} has less than {least_users:.0%} of the users")
        for line in said:
            log.warning(line)
        return said


class WeakGeneralization(Scenario):
    """Each user's events are split at random."""

    def __init__(self, frac_data_in: float = 0.8, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        self.splitter = FractionInteractionSplitter(frac_data_in, seed)

    def _split(self, data: Interactions) -> None:
        train, out = self.splitter.split(data)
        self._parts = {"full_training": train, "test": (train.copy(), out)}
        if self.validation:
            inner, held = self.splitter.split(train)
            self._parts |= {"validation_training": inner, "validation": (inner.copy(), held)}


class StrongGeneralization(Scenario):
    """Test users are no training users; a share of their events is the input."""

    def __init__(self, frac_users_train: float = 0.8, frac_interactions_in: float = 0.8, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        self.users = StrongGeneralizationSplitter(frac_users_train, seed)
        self.events = FractionInteractionSplitter(frac_interactions_in, seed)

    def _split(self, data: Interactions) -> None:
        train, test = self.users.split(data)
        self._parts = {"full_training": train, "test": self.events.split(test)}
        if self.validation:
            inner, held = self.validation_splitter.split(train)
            self._parts |= {"validation_training": inner, "validation": self.events.split(held)}


def _check_times(t: float, t_validation: float | None, validation: bool) -> None:
    if validation and t_validation is None:
        raise Exception("a validation time is needed")
    if validation and not t_validation < t:
        raise AssertionError("the validation time must lie before t")


class Timed(Scenario):
    """Events before t are input and training, those from t on the output."""

    def __init__(self, t: float, t_validation: float | None = None, delta_out: float = FOREVER, delta_in: float = FOREVER, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        _check_times(t, t_validation, validation)
        self.at, self.at_validation = TimestampSplitter(t, delta_out, delta_in), TimestampSplitter(t_validation, delta_out, delta_in) if validation else None

    def _split(self, data: Interactions) -> None:
        train, out = self.at.split(data)
        self._parts = {"full_training": train, "test": (train.copy(), out)}
        if self.validation:
            inner, held = self.at_validation.split(train)
            self._parts |= {"validation_training": inner, "validation": (inner.copy(), held)}


class StrongGeneralizationTimed(Scenario):
    """Other users, and a point in time."""

    def __init__(self, frac_users_in: float, t: float, t_validation: float | None = None, delta_out: float = FOREVER, delta_in: float = FOREVER, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        _check_times(t, t_validation, validation)
        self.users = StrongGeneralizationSplitter(frac_users_in, seed)
        self.at, self.at_validation = TimestampSplitter(t, delta_out, delta_in), TimestampSplitter(t_validation, delta_out, delta_in) if validation else None

    def _split(self, data: Interactions) -> None:
        train, test = self.users.split(data)
        train, _ = self.at.split(train)
        self._parts = {"full_training": train, "test": self.at.split(test)}
        if self.validation:
            inner, held = self.validation_splitter.split(train)
            inner, _ = self.at_validation.split(inner)
            self._parts |= {"validation_training": inner, "validation": self.at_validation.split(held)}


class StrongGeneralizationTimedMostRecent(Scenario):
    """Users whose last event is before t train; the others' last n events are the output."""

    def __init__(self, t: float, t_validation: float | None = None, n_most_recent_out: int = 1, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        _check_times(t, t_validation, validation)
        if n_most_recent_out <= 0:
            raise ValueError("n_most_recent_out must be positive")
        self.at, self.at_validation = UserInteractionTimeSplitter(t), UserInteractionTimeSplitter(t_validation) if validation else None
        self.last = MostRecentSplitter(n_most_recent_out)

    def _split(self, data: Interactions) -> None:
        train, test = self.at.split(data)
        self._parts = {"full_training": train, "test": self.last.split(test)}
        if self.validation:
            inner, held = self.at_validation.split(train)
            self._parts |= {"validation_training": inner, "validation": self.last.split(held)}


def _tail(data: Interactions, n: float) -> Interactions:
    return data.copy() if math.isinf(n) else MostRecentSplitter(int(n)).split(data)[1]


class LastItemPrediction(Scenario):
    """Each user's last event is to be predicted from the (last n) events before."""

    def __init__(self, n_most_recent_in: float = math.inf, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        if n_most_recent_in == 0:
            raise ValueError("n_most_recent_in must not be 0")
        self.n_in, self.last = n_most_recent_in, MostRecentSplitter(1)

    def _split(self, data: Interactions) -> None:
        train, out = self.last.split(data)
        self._parts = {"full_training": train, "test": (_tail(train, self.n_in), out)}
        if self.validation:
            inner, held = self.last.split(train)
            self._parts |= {"validation_training": inner, "validation": (_tail(inner, self.n_in), held)}


class TimedLastItemPrediction(Scenario):
    """Training events lie before t; of users with an event in [t, t + delta_out) the last such event is predicted."""

    def __init__(self, t: float, t_validation: float | None = None, n_most_recent_in: float = math.inf, delta_out: float = FOREVER, validation: bool = False, seed: int = 42) -> None:
        super().__init__(validation, seed)
        _check_times(t, t_validation, validation)
        if n_most_recent_in == 0:
            raise ValueError("n_most_recent_in must not be 0")
        self.t, self.t_validation, self.n_in, self.delta_out = t, t_validation, n_most_recent_in, delta_out

    def _pair(self, data: Interactions, t: float) -> Pair:
        window = data.timestamps_gte(t).timestamps_lt(t + self.delta_out)
        known = data.timestamps_lt(t + self.delta_out).users_in(window.active_users)
        rest, out = MostRecentSplitter(1).split(known)
        return _tail(rest, self.n_in), out

    def _split(self, data: Interactions) -> None:
        train = data.timestamps_lt(self.t)
        self._parts = {"full_training": train, "test": self._pair(data, self.t)}
        if self.validation:
            self._parts |= {"validation_training": train.timestamps_lt(self.t_validation), "validation": self._pair(train, self.t_validation)}
