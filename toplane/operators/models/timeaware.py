"""Item neighbours that weigh events by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toplane.functions.decay import Decay
from toplane.operators.interactions import ITEM, TIME, USER, Interactions, to_matrix
from toplane.operators.models.base import Timed, TopKSimilarityModel, times_of
from toplane.operators.models.knn import binary_cosine, conditional_probability, cosine, pearson
from toplane.plans.algebra import applied, cooccurrences, scaled

DAY = 24 * 3600
SIMILARITIES = {"cosine": cosine, "conditional_probability": conditional_probability, "pearson": pearson}


def aged(x: Interactions, decay: float, name: str, interval: float) -> DataFrame:
    """(uid, iid, value): each pair's last time, decayed from the end of the log on; all 1 for a decay of 0."""
    if not decay:
        return to_matrix(x, binary=True).withColumn("value", F.col("value").cast("double"))
    rule = Decay(name, decay)
    last = times_of(x)
    ends = last.agg((F.max(TIME) + 1).alias("now"), F.min(TIME).alias("first"))
    # one row by construction
    rows = last.crossJoin(F.broadcast(ends))
    age = (F.col("now") - F.col(TIME)) / F.lit(float(interval))
    oldest = (F.col("now") - F.col("first")) / F.lit(float(interval))
    return rows.select(USER, ITEM, rule(age, oldest).alias("value")).filter("value <> 0")


class TARSItemKNN(Timed, TopKSimilarityModel):
    """Similarities of decayed values; histories are decayed too, from their own log's end."""

    binary = False

    def __init__(self, K: int = 200, fit_decay: float = 1 / DAY, predict_decay: float = 1 / DAY, decay_interval: int = 1, similarity: str = "cosine", decay_function: str = "exponential") -> None:
        super().__init__(K)
        if similarity not in SIMILARITIES:
            raise ValueError(f"similarity must be one of {tuple(SIMILARITIES)}")
        if decay_interval <= 0 or decay_interval != int(decay_interval):
            raise ValueError("decay_interval must be a positive whole number")
        for decay in (fit_decay, predict_decay):
            if decay:
                Decay(decay_function, decay)
        self.fit_decay, self.predict_decay, self.decay_interval = fit_decay, predict_decay, decay_interval
        self.similarity, self.decay_function = similarity, decay_function

    def _fit_matrix(self, x: Interactions) -> DataFrame:
        return aged(x, self.fit_decay, self.decay_function, self.decay_interval)

    def _predict_matrix(self, x: Interactions) -> DataFrame:
        return aged(x, self.predict_decay, self.decay_function, self.decay_interval)

    def _fit(self, x) -> None:
        self._keep(SIMILARITIES[self.similarity](self._fit_matrix(x)))

    def _predict(self, x) -> DataFrame:
        return applied(self._predict_matrix(x), self.similarity_)


class TARSItemKNNDing(TARSItemKNN):
    """Only the histories are decayed, exponentially."""

    def __init__(self, K: int = 200, predict_decay: float = 1 / DAY, similarity: str = "cosine") -> None:
        super().__init__(K, 0, predict_decay, similarity=similarity)


class TARSItemKNNLiu(TARSItemKNN):
    """Cosine with exponential decay."""

    def __init__(self, K: int = 200, fit_decay: float = 1 / DAY, predict_decay: float = 1 / DAY) -> None:
        super().__init__(K, fit_decay, predict_decay)


class TARSItemKNNVaz(TARSItemKNN):
    """Pearson with exponential decay."""

    def __init__(self, K: int = 200, fit_decay: float = 1 / DAY, predict_decay: float = 1 / DAY) -> None:
        super().__init__(K, fit_decay, predict_decay, similarity="pearson")


class TARSItemKNNLiu2012(TARSItemKNN):
    """A logarithmic weight of how far into the user's history the event lies, at fit and predict."""

    def __init__(self, K: int = 200, decay: float = 2.0) -> None:
        if decay <= 1:
            raise ValueError("decay must be larger than 1")
        super().__init__(K, 0, 0)
        self.decay = decay

    def _weights(self, x: Interactions) -> DataFrame:
        # the first time is of all events, the last one of the pairs' last times
        ends = x.df.groupBy(USER).agg(F.min(TIME).alias("first"), F.max(TIME).alias("last"))
        rows = times_of(x).join(ends, USER)
        way = F.when(F.col("last") != 0, (F.col(TIME) - F.col("first")) / F.col("last")).otherwise(F.lit(0.0))
        base = F.lit(float(self.decay))
        return rows.select(USER, ITEM, (F.log((base - 1) * way + 1) / F.log(base) + 1).alias("value"))

    _fit_matrix = _predict_matrix = _weights


#: Weight by window of the item's launch (rows) and of the event (columns).
LAUNCH_WEIGHTS = {
    3: [[0.7, 1.7, 2.7], [1.0, 2.0, 3.0], [1.3, 2.3, 3.3]],
    5: [[0.2, 1.2, 2.2, 3.2, 4.2], [0.4, 1.4, 2.4, 3.4, 4.4], [0.6, 1.6, 2.6, 3.6, 4.6], [0.8, 1.8, 2.8, 3.8, 4.8], [1.0, 2.0, 3.0, 4.0, 5.0]],
}


class TARSItemKNNLee(TARSItemKNN):
    """Weights by when an item was launched and when the event was; histories count as 0/1."""

    def __init__(self, K: int = 200, w: int = 5, similarity: str = "cosine") -> None:
        if w not in LAUNCH_WEIGHTS:
            raise ValueError("w must be 3 or 5")
        if similarity not in ("cosine", "pearson"):
            raise ValueError("similarity must be cosine or pearson")
        super().__init__(K, 0, 0, similarity=similarity)
        self.w = w

    def _window(self, value: Column, least: Column, most: Column) -> Column:
        """Number of the first split, counted from 0, that is not below the value."""
        width = (most - least) / F.lit(float(self.w))
        out = F.lit(self.w - 1)
        for k in reversed(range(self.w - 1)):
            out = F.when(F.ceil(least + F.lit(float(k + 1)) * width) >= value, F.lit(k)).otherwise(out)
        return out

    def _fit_matrix(self, x: Interactions) -> DataFrame:
        launch = x.df.groupBy(ITEM).agg(F.min(TIME).alias("launch"))
        # items of the shape without events count as launched at 0
        launches = launch.agg(F.min("launch").alias("l0"), F.max("launch").alias("l1"), F.count(F.lit(1)).alias("n"))
        missing = F.col("n") < F.lit(x.shape[1])
        launches = launches.select(F.when(missing, F.least("l0", F.lit(0.0))).otherwise(F.col("l0")).alias("l0"), F.when(missing, F.greatest("l1", F.lit(0.0))).otherwise(F.col("l1")).alias("l1"))
        ends = x.df.agg(F.min(TIME).alias("t0"), F.max(TIME).alias("t1"))
        # one row each by construction; a last time of 0 is an absent cell
        rows = times_of(x).filter(F.col(TIME) != 0).join(launch, ITEM).crossJoin(F.broadcast(launches)).crossJoin(F.broadcast(ends))
        row, column = self._window(F.col("launch"), F.col("l0"), F.col("l1")), self._window(F.col(TIME), F.col("t0"), F.col("t1"))
        weights = F.array(*(F.array(*(F.lit(v) for v in r)) for r in LAUNCH_WEIGHTS[self.w]))
        return rows.select(USER, ITEM, weights[row][column].alias("value"))


class TARSItemKNNCoocDistance(Timed, TopKSimilarityModel):
    """Sums of a decay of the time between two items' events, over users; histories count as 0/1.

    Pairs at the same time add nothing, and events at time 0 count as absent.
    """

    binary = False
    SIMILARITIES = ("cooc", "conditional_probability")

    def __init__(self, K: int = 200, fit_decay: float = 1 / DAY, decay_interval: int = 1, similarity: str = "cooc", decay_function: str = "exponential") -> None:
        super().__init__(K)
        if similarity not in self.SIMILARITIES:
            raise ValueError(f"similarity must be one of {self.SIMILARITIES}")
        if fit_decay:
            Decay(decay_function, fit_decay)
        self.fit_decay, self.decay_interval, self.similarity, self.decay_function = fit_decay, decay_interval, similarity, decay_function

    def _fit(self, x) -> None:
        last = times_of(x).filter(F.col(TIME) != 0)
        rule = Decay(self.decay_function if self.fit_decay else "none", self.fit_decay)
        ends = last.agg(((F.max(TIME) - F.min(TIME)) / F.lit(float(self.decay_interval))).alias("n"))
        # one row by construction
        rows = last.crossJoin(F.broadcast(ends))
        apart = F.abs(F.col(f"{TIME}_a") - F.col(f"{TIME}_b")) / F.lit(float(self.decay_interval))
        sim = cooccurrences(rows, USER, ITEM, value=rule(apart, F.col("n_a")), columns=(TIME, "n"), keep=F.col(f"{TIME}_a") != F.col(f"{TIME}_b"))
        if self.similarity == "conditional_probability":
            sim = scaled(sim, to_matrix(x, binary=True).groupBy(ITEM).agg(F.count(F.lit(1)).alias("c")), "i", ITEM, "c", "sim").select("i", "j", "sim")
        self._keep(sim)

    def _predict(self, x) -> DataFrame:
        return applied(to_matrix(x, binary=True), self.similarity_)


class TARSItemKNNXia(TARSItemKNNCoocDistance):
    """Co-occurrence with a concave, convex or linear decay, by days."""

    def __init__(self, K: int = 200, fit_decay: float = 0.5, decay_function: str = "concave", decay_interval: int = DAY) -> None:
        if decay_function not in ("concave", "convex", "linear"):
            raise ValueError("decay_function must be concave, convex or linear")
        super().__init__(K, fit_decay, decay_interval, "cooc", decay_function)


class TARSItemKNNHermann(Timed, TopKSimilarityModel):
    """Mean over common users of 1 / (time apart + time since the earlier of the two)."""

    binary = False

    def __init__(self, K: int = 200, decay_interval: int = 1) -> None:
        super().__init__(K)
        if decay_interval <= 0:
            raise ValueError("decay_interval must be positive")
        self.decay_interval = decay_interval

    def _fit(self, x) -> None:
        unit = F.lit(float(self.decay_interval))
        last = times_of(x)
        now = x.df.agg(((F.max(TIME) + 1) / unit).alias("now"))
        # one row by construction
        rows = last.filter(F.col(TIME) != 0).withColumn(TIME, F.col(TIME) / unit).crossJoin(F.broadcast(now))
        a, b = F.col(f"{TIME}_a"), F.col(f"{TIME}_b")
        one = F.when(a != b, 1 / (F.abs(a - b) + F.col("now_a") - F.least(a, b))).otherwise(F.lit(0.0))
        pairs = cooccurrences(rows, USER, ITEM, value=F.struct(one.alias("v"))["v"], columns=(TIME, "now"))
        # users at equal times count in the divisor
        counts = cooccurrences(rows, USER, ITEM, value=F.lit(1), columns=(TIME,), name="n")
        self._keep(pairs.join(counts, ["i", "j"]).select("i", "j", (F.col("sim") / F.col("n")).alias("sim")))

    def _predict(self, x) -> DataFrame:
        return applied(to_matrix(x, binary=True), self.similarity_)


__all__ = ["TARSItemKNN", "TARSItemKNNCoocDistance", "TARSItemKNNDing", "TARSItemKNNHermann", "TARSItemKNNLee", "TARSItemKNNLiu", "TARSItemKNNLiu2012", "TARSItemKNNVaz", "TARSItemKNNXia", "binary_cosine"]
