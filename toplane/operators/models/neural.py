"""Models trained by gradients.

Training holds the histories of at most MAX_EVENTS events (checked before they
are read) as one array of item numbers on the driver, about four bytes an event,
and scores held-out users block by block; the parameters go to the executors,
which score users batch by batch.

Prod2Vec and Prod2VecClustered hold parameters and similarities only on the
driver: Spark makes and shuffles the skip-gram pairs, one task takes the steps
as they come, and held-out users are scored where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toplane.functions import autograd as ag
from toplane.functions import losses
from toplane.functions.autograd import Optimiser, Var, var
from toplane.functions.samplers import BootstrapSampler, SequenceBatches, unigram_distribution
from toplane.operators.interactions import EVENT, ITEM, TIME, USER, Interactions
from toplane.operators.models.base import Algorithm, FactorModel, parts_for, scores_of
from toplane.operators.models.factor import as_factors
from toplane.plans.algebra import applied

#: Events that are read for training, at most: 0.8 GB on the driver.
MAX_EVENTS = 200_000_000
#: Cells of scores that are held at once, on the driver or in a task.
MAX_CELLS = 1 << 21
#: Skip-gram pairs that are sorted at once, similarities that are added up at once, and bytes of parameters in a row.
PAIRS, SUMS, BYTES = 1 << 20, 1 << 20, 1 << 20


class EarlyStop(Exception):
    pass


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-scores, 1, kind="stable")[:, :k]


def _recall(truth: np.ndarray, scores: np.ndarray, k: int = 50) -> float:
    found = np.take_along_axis(truth, _top(scores, k), 1).sum(1)
    return float((found / truth.sum(1)).mean())


def _precision(truth: np.ndarray, scores: np.ndarray, k: int = 10) -> float:
    return float((np.take_along_axis(truth, _top(scores, k), 1).sum(1) / k).mean())


def _ndcg(truth: np.ndarray, scores: np.ndarray, k: int = 50) -> float:
    found = np.take_along_axis(truth, _top(scores, k), 1)
    w = 1 / np.log2(np.arange(2, found.shape[1] + 2))
    best = np.array([w[: min(int(n), k)].sum() for n in truth.sum(1)])
    return float(((found * w).sum(1) / best).mean())


def _pairs(truth: np.ndarray, scores: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    rows, columns = np.nonzero(truth)
    return scores[rows, columns], scores[rows[:, None], rng.integers(0, truth.shape[1], (len(rows), n))]


def _bpr(truth: np.ndarray, scores: np.ndarray, rng: np.random.Generator) -> float:
    a, b = _pairs(truth, scores, 1, rng)
    return float(losses.bpr_loss(var(a), var(b[:, 0])).data)


def _warp(truth: np.ndarray, scores: np.ndarray, rng: np.random.Generator) -> float:
    a, b = _pairs(truth, scores, 20, rng)
    return float(losses.warp_loss(var(a), var(b), 1.9, truth.shape[1]).data)


class StoppingCriterion:
    """Keeps the best value; with stop_early it ends the training when that hasn't changed for a while."""

    FUNCTIONS = {"bpr": (_bpr, True), "warp": (_warp, True), "recall": (_recall, False), "ndcg": (_ndcg, False), "precision": (_precision, False)}

    def __init__(self, function, minimize: bool, stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.0) -> None:
        self.function, self.minimize, self.stop_early = function, minimize, stop_early
        self.max_iter_no_change, self.min_improvement = max_iter_no_change, min_improvement
        self.best_value = np.inf if minimize else -np.inf
        self.unchanged = 0

    @classmethod
    def create(cls, name: str, **kw) -> StoppingCriterion:
        if name not in cls.FUNCTIONS:
            raise ValueError(f"{name} is no stopping criterion")
        function, minimize = cls.FUNCTIONS[name]
        return cls(function, minimize, **kw)

    def value(self, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> float:
        """The function over all users, given block by block: means of users, or of pairs whose draws go on from block to block."""
        total, weight = self.sums(blocks, np.random.default_rng(42))
        return total / weight

    @property
    def drawn(self) -> bool:
        return self.function in (_bpr, _warp)

    def sums(self, blocks: Iterable[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> tuple[float, float]:
        """What value() divides."""
        total, weight = 0.0, 0.0
        for truth, scores in blocks:
            n = truth.sum() if self.drawn else len(truth)
            total += n * (self.function(truth, scores, rng) if self.drawn else self.function(truth, scores))
            weight += n
        return float(total), float(weight)

    def update(self, truth: np.ndarray, scores: np.ndarray) -> bool:
        return self.update_blocks([(truth, scores)])

    def update_blocks(self, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> bool:
        return self.update_value(self.value(blocks))

    def update_value(self, value: float) -> bool:
        gain = self.best_value - value if self.minimize else value - self.best_value
        if gain >= 0 and abs(gain) > self.min_improvement:
            self.best_value, self.unchanged = value, 0
            return True
        if self.stop_early:
            self.unchanged += 1
            if self.unchanged >= self.max_iter_no_change:
                raise EarlyStop
        return False


class TrainedModel(Algorithm):
    """Epochs of training and validation; keeps the best or the last parameters."""

    needs_validation = True
    binary = False

    def __init__(self, batch_size: int, max_epochs: int, learning_rate: float, stopping_criterion: str, stop_early: bool, max_iter_no_change: int, min_improvement: float, seed: int, keep_last: bool, predict_topK: int | None, validation_sample_size: int | None) -> None:
        self.batch_size, self.max_epochs, self.learning_rate = batch_size, max_epochs, learning_rate
        self.stopping_criterion, self.stop_early, self.max_iter_no_change, self.min_improvement = stopping_criterion, stop_early, max_iter_no_change, min_improvement
        self.seed, self.keep_last, self.predict_topK, self.validation_sample_size = seed, keep_last, predict_topK, validation_sample_size
        StoppingCriterion.create(stopping_criterion)

    def _input(self, x):
        if not isinstance(x, Interactions):
            raise TypeError(f"{self.name} needs interactions")
        return x

    def fit(self, x: Interactions, validation: tuple[Interactions, Interactions] | None = None) -> TrainedModel:
        if validation is not None and any(v.shape != x.shape for v in validation):
            raise AssertionError("shapes of training and validation data differ")
        self.num_users, self.num_items = x.shape
        self.rng = np.random.default_rng(self.seed)
        data = self._read(x)
        self.params = {}
        self._init(*data)
        stop = StoppingCriterion.create(self.stopping_criterion, stop_early=self.stop_early, max_iter_no_change=self.max_iter_no_change, min_improvement=self.min_improvement)
        held = self._validation(validation)
        best, latest = None, False
        self.losses_ = []
        try:
            for _ in range(self.max_epochs):
                self.losses_.append(float(np.mean(self._epoch(*data))))
                self._after_epoch()
                value, latest = None if held is None else self._value(stop, held), False
                if value is not None and stop.update_value(value):
                    best, latest = {k: p.data.copy() for k, p in self.params.items()}, True
        except EarlyStop:
            pass
        if best is not None and not latest and not self.keep_last:
            for k, p in self.params.items():
                p.data = best[k]
            self._after_epoch()
        self._finish(x)
        self.fitted_ = True
        return self

    def _fit(self, x, *args) -> None:
        raise NotImplementedError

    def _read(self, x: Interactions) -> tuple:
        """What _init() and _epoch() are given."""
        return read_histories(x)

    def _value(self, stop: StoppingCriterion, held) -> float | None:
        """The criterion over the held-out users; None without any."""
        return stop.value(self._blocks(*held))

    def _validation(self, validation):
        if validation is None:
            return None
        (users, histories), (others, outs) = read_histories(validation[0]), read_histories(validation[1])
        both, own, out = np.intersect1d(users, others, assume_unique=True, return_indices=True)
        if self.validation_sample_size and len(both) > self.validation_sample_size:
            at = np.searchsorted(both, np.sort(self.rng.choice(both, self.validation_sample_size, replace=False)))
            both, own, out = both[at], own[at], out[at]
        return (both, own, histories, out, outs) if len(both) else None

    def _blocks(self, users: np.ndarray, own: np.ndarray, histories: Sequence[np.ndarray], out: np.ndarray, outs: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(truth, scores) of users, at most MAX_CELLS cells at once."""
        size = max(1, MAX_CELLS // max(1, self.num_items))
        for lo in range(0, len(users), size):
            at = slice(lo, lo + size)
            yield _rows([outs[k] for k in out[at]], self.num_items), self._dense(users[at], [histories[k] for k in own[at]])

    def _after_epoch(self) -> None:
        """What depends on the parameters."""

    def _finish(self, x: Interactions) -> None:
        """Called once after training."""

    def _state(self) -> dict[str, np.ndarray]:
        return {k: p.data for k, p in self.params.items()}

    def _dense(self, users: np.ndarray, histories: list[np.ndarray]) -> np.ndarray:
        return self._score(self._state(), users, histories)

    def save(self, path: str) -> None:
        """The parameters and all that predict() needs, in one file."""
        own = {f"own:{k}": np.asarray(getattr(self, k)) for k in self._kept()}
        np.savez(path, **self._state(), **own)

    def _kept(self) -> list[str]:
        """Attributes that are saved beside the parameters."""
        return ["num_users", "num_items"]

    def load(self, path: str) -> TrainedModel:
        with np.load(path) as f:
            self.params = {k: Var(f[k]) for k in f.files if not k.startswith("own:")}
            for k in f.files:
                if k.startswith("own:"):
                    setattr(self, k[4:], f[k] if f[k].ndim else f[k].item())
        self._restore()
        self.fitted_ = True
        return self

    def _restore(self) -> None:
        """Called once after loading."""

    def _predict(self, x) -> DataFrame:
        spark = x.df.sparkSession
        keep = ("num_items", "num_users", "predict_topK", "batch_size", *self._needed)
        own = {k: getattr(self, k) for k in keep}
        sent = spark.sparkContext.broadcast((self._state(), own))
        cls = type(self)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, attributes = sent.value
            model = cls.__new__(cls)
            vars(model).update(attributes)
            for frame in frames:
                for lo in range(0, len(frame), 256):
                    part = frame.iloc[lo : lo + 256]
                    users = part[USER].to_numpy()
                    scores = model._score(state, users, [np.asarray(h, np.int64) for h in part["items"]])
                    if model.predict_topK:
                        scores = best_of(scores, model.predict_topK)
                    r, c = np.nonzero(scores)
                    yield pd.DataFrame({USER: users[r], ITEM: c.astype(np.int64), "score": scores[r, c]})

        return history_frame(x).mapInPandas(run, f"{USER} bigint, {ITEM} bigint, score double")

    _needed: tuple[str, ...] = ()


def history_frame(x: Interactions) -> DataFrame:
    """(uid, items) in order of time, else of event."""
    order = (TIME, EVENT) if x.has_timestamps else (EVENT,)
    events = F.array_sort(F.collect_list(F.struct(*order, ITEM)))
    return x.df.groupBy(USER).agg(F.transform(events, lambda e: e[ITEM]).alias("items"))


class Histories(Sequence):
    """Users' items in order, one after the other in one array; what a user has is a view of it."""

    def __init__(self, items: np.ndarray, counts: np.ndarray) -> None:
        self.items, self.ends = items, np.append(0, np.cumsum(counts, dtype=np.int64))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        if not 0 <= k < len(self):
            raise IndexError(k)
        return self.items[self.ends[k] : self.ends[k + 1]]


def read_histories(x: Interactions) -> tuple[np.ndarray, Histories]:
    """User ids in order, and their items in order of time, else of event.

    Executors sort the events and send item numbers only, one partition at a time.
    """
    if x.num_interactions > MAX_EVENTS:
        raise ValueError(f"more than {MAX_EVENTS} events to train on: sample users first")
    order = [F.asc_nulls_last(c) for c in (USER, *((TIME,) if x.has_timestamps else ()), EVENT)]
    kind = np.int32 if x.shape[1] < 1 << 31 else np.int64

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                users, items = (batch.column(c).to_numpy(zero_copy_only=False) for c in (USER, ITEM))
                at = np.flatnonzero(np.append(True, users[1:] != users[:-1]))
                row = (users[at], np.diff(np.append(at, len(users))), items.astype(kind))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=["users", "counts", "items"])

    events = x.df.repartition(USER).sortWithinPartitions(*order).select(USER, ITEM)
    parts = [tuple(np.frombuffer(v, t) for v, t in zip(row, (np.int64, np.int64, kind), strict=True)) for row in events.mapInArrow(packed, "users binary, counts binary, items binary").toLocalIterator()]
    if not parts:
        return np.zeros(0, np.int64), Histories(np.zeros(0, kind), np.zeros(0, np.int64))
    users, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    # a user is in one partition, in order, and may be in several of its batches
    ids, which = np.unique(users, return_inverse=True)
    total = np.bincount(which, counts, len(ids)).astype(np.int64)
    out, free, k = Histories(np.empty(int(total.sum()), kind), total), np.append(0, np.cumsum(total))[:-1], 0
    for _, n, items in parts:
        lo = 0
        for size in n.tolist():
            to = free[which[k]]
            out.items[to : to + size] = items[lo : lo + size]
            free[which[k]] += size
            lo, k = lo + size, k + 1
    return ids, out


def _pairs_of(users: np.ndarray, histories: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own = [np.unique(h) for h in histories]
    return np.repeat(users, [len(h) for h in own]), np.concatenate(own)


def _rows(histories: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros((len(histories), n))
    for r, h in enumerate(histories):
        out[r, h] = 1
    return out


class BPRMF(TrainedModel):
    """Factors that rank a user's items above others."""

    def __init__(self, num_components: int = 100, lambda_h: float = 0.0, lambda_w: float = 0.0, batch_size: int = 1000, max_epochs: int = 20, learning_rate: float = 0.01, stopping_criterion: str = "bpr", stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, seed: int = 42, keep_last: bool = False, predict_topK: int | None = None, validation_sample_size: int | None = None, sample_size: int | None = None) -> None:
        super().__init__(batch_size, max_epochs, learning_rate, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        self.num_components, self.lambda_h, self.lambda_w, self.sample_size = num_components, lambda_h, lambda_w, sample_size

    def _init(self, users, histories) -> None:
        sd = min(1 / np.sqrt(self.num_components), 0.05)
        self.params = {"w": Var(self.rng.normal(0, sd, (self.num_users, self.num_components))), "h": Var(self.rng.normal(0, sd, (self.num_items, self.num_components)))}
        self.optimiser = Optimiser(self.params, "adagrad", self.learning_rate)
        self.sampler = BootstrapSampler(1, self.batch_size, exact=True, seed=self.seed)

    def _epoch(self, users, histories):
        out = []
        for u, i, j in self.sampler.sample(*_pairs_of(users, histories), self.num_items, self.sample_size):
            if not (self.lambda_w or self.lambda_h):
                out.append(self._step(u, i, j[:, 0]))
                continue
            w, a, b = self.params["w"][u], self.params["h"][i], self.params["h"][j[:, 0]]
            loss = losses.bpr_loss((w * a).sum(1), (w * b).sum(1))
            total = loss
            if self.lambda_w:
                total = total + self.lambda_w * ((self.params["w"] ** 2).sum() + 1e-12) ** 0.5
            if self.lambda_h:
                total = total + self.lambda_h * ((self.params["h"] ** 2).sum() + 1e-12) ** 0.5
            total.backward()
            self.optimiser.step()
            out.append(float(loss.data))
        return out

    def _step(self, u: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
        """One step on the rows of the batch alone: the others' gradients are 0."""
        users, u = np.unique(u, return_inverse=True)
        items, ij = np.unique(np.concatenate([i, j]), return_inverse=True)
        own, others = Var(self.params["w"].data[users]), Var(self.params["h"].data[items])
        w, a, b = own[u], others[ij[: len(i)]], others[ij[len(i) :]]
        loss = losses.bpr_loss((w * a).sum(1), (w * b).sum(1))
        loss.backward()
        self.optimiser.step_rows({"w": (users, own.grad), "h": (items, others.grad)})
        return float(loss.data)

    def _score(self, state, users, histories):
        return state["w"][users] @ state["h"].T

    def _predict(self, x) -> DataFrame:
        spark = x.df.sparkSession
        users = as_factors(spark, np.arange(self.num_users), self.params["w"].data).join(x.active_users.withColumnRenamed(USER, "id"), "id", "left_semi")
        return scores_of(users, as_factors(spark, np.arange(self.num_items), self.params["h"].data), FactorModel.max_broadcast_bytes)


def skipgram_pairs(histories: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(focus, context) of items at most `window` places apart; an item is no context of itself."""
    focus, context = [], []
    for h in histories:
        for s in range(1, window + 1):
            focus += [h[:-s], h[s:]]
            context += [h[s:], h[:-s]]
    f, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (focus, context))
    keep = f != c
    return f[keep], c[keep]


class SkipgramPairs:
    """The pairs of skipgram_pairs(), worked out from their numbers: nothing is held for each of them."""

    def __init__(self, histories: Histories, window: int) -> None:
        self.histories, self.window = histories, window
        n = np.diff(histories.ends)
        self.before = np.append(0, np.cumsum(sum(2 * np.maximum(n - s, 0) for s in range(1, window + 1))))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(focus, context), an item with itself included."""
        user = np.searchsorted(self.before, numbers, "right") - 1
        first, left = self.histories.ends[user], numbers - self.before[user]
        n = self.histories.ends[user + 1] - first
        a, b, open_ = np.zeros_like(left), np.zeros_like(left), np.ones(len(left), bool)
        for s in range(1, self.window + 1):
            size = np.maximum(n - s, 0)
            here = open_ & (left < 2 * size)
            place, turned = left % np.maximum(size, 1), left >= size
            a, b = np.where(here, first + place + np.where(turned, s, 0), a), np.where(here, first + place + np.where(turned, 0, s), b)
            open_, left = open_ & ~here, np.where(here, left, left - 2 * size)
        return self.histories.items[a], self.histories.items[b]

    def numbers(self) -> np.ndarray:
        """The numbers of all pairs of different items."""
        total = int(self.before[-1])
        out, n = np.empty(total, np.int32 if total < 1 << 31 else np.int64), 0
        for lo in range(0, total, 1 << 18):
            some = np.arange(lo, min(lo + (1 << 18), total))
            f, c = self.of(some)
            kept = some[f != c]
            out[n : n + len(kept)] = kept
            n += len(kept)
        return out[:n]


def following(events: DataFrame, window: int) -> DataFrame:
    """(uid, interactionid, s, a, b): each event's item a and the item b of the user's event s places later, for s up to `window`."""
    each = Window.partitionBy(USER).orderBy(*(F.asc_nulls_last(c) for c in (TIME, EVENT) if c in events.columns))
    later = F.array(*(F.struct(F.lit(s).alias("s"), F.lead(ITEM, s).over(each).alias("b")) for s in range(1, window + 1)))
    rows = events.select(USER, EVENT, F.col(ITEM).alias("a"), later.alias("later"))
    return rows.select(USER, EVENT, "a", F.explode("later").alias("n")).select(USER, EVENT, "n.s", "a", "n.b").filter("a is not null and b is not null")


def shuffled_pairs(events: DataFrame, window: int, parts: int, seed: int) -> DataFrame:
    """(focus, context): the pairs of skipgram_pairs() in an order drawn by the seed, partition after partition."""
    ways = F.array(*(F.struct(F.col(f).alias("focus"), F.col(c).alias("context")) for f, c in ("ab", "ba")))
    rows = following(events, window).filter("a <> b").select(USER, EVENT, "s", F.posexplode(ways).alias("way", "p"))
    keyed = rows.select(F.xxhash64(F.lit(seed), USER, EVENT, "s", "way").alias("key"), "p.focus", "p.context")
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "focus", "context")


def in_batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """(2, size) arrays of focus and context, the last one of what is left."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("focus", "context")]))
        n += batch.num_rows
        if n >= size:
            some, left = np.concatenate(held, 1), n % size
            for lo in range(0, n - left, size):
                yield some[:, lo : lo + size]
            held, n = [some[:, n - left :].copy()], left
    if n:
        yield np.concatenate(held, 1)


def _added(n: int, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sums of the rows g by their numbers."""
    return np.stack([np.bincount(rows, g[:, c], n) for c in range(g.shape[1])], 1)


def skipgram_gradients(params: dict[str, Var], f: np.ndarray, c: np.ndarray, neg: np.ndarray) -> float:
    """The loss of a batch with negatives (n, k); the gradients stand at the parameters, as backward() would put them."""
    a, b = params["input"], params["output"]
    x, y, z = a.data[f], b.data[c], b.data[neg]
    near, far = (x * y).sum(1), (x[:, None] * z).sum(2)
    g_near, g_far = -ag._sig(-near)[:, None] / len(f), ag._sig(far)[:, :, None] / len(f)
    a.grad = _added(len(a.data), f, g_near * y + (g_far * z).sum(1))
    b.grad = _added(len(b.data), np.concatenate([c, neg.ravel()]), np.concatenate([g_near * x, (g_far * x[:, None]).reshape(-1, x.shape[1])]))
    return float((np.logaddexp(0, -near) + np.logaddexp(0, far).sum(1)).mean())


def pieces(arrays: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(place, value): the numbers of all arrays one after the other, at most BYTES in a row."""
    place = 0
    for flat in (np.ravel(x) for x in arrays):
        for lo in range(0, len(flat), BYTES // 8):
            yield pa.RecordBatch.from_arrays([pa.array([place + lo], pa.int64()), pa.array([flat[lo : lo + BYTES // 8].astype(float).tobytes()], pa.binary())], names=["place", "value"])
        place += len(flat)


def similar(first: np.ndarray, j: np.ndarray, sim: np.ndarray, counts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Scores of rows that hold counts[r] of the items each: sums of the similarities of their items, which for item i are those from first[i] on."""
    n = len(first) - 1
    out, rows, size = np.zeros(len(counts) * n), np.repeat(np.arange(len(counts)), counts), np.diff(first)[items]
    ends, lo = np.cumsum(size), 0
    while lo < len(items):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SUMS, "right")))
        own = size[lo:hi]
        at = np.arange(own.sum()) + np.repeat(first[items[lo:hi]] - (np.cumsum(own) - own), own)
        np.add.at(out, np.repeat(rows[lo:hi] * n, own) + j[at], sim[at])
        lo = hi
    return out.reshape(len(counts), n)


class Prod2Vec(TrainedModel):
    """Skip-gram embeddings of items; scores by the cosines of the K nearest."""

    def __init__(self, num_components: int = 300, num_negatives: int = 10, window_size: int = 2, stopping_criterion: str = "precision", K: int = 200, batch_size: int = 1000, learning_rate: float = 0.01, clipnorm: float = 1.0, max_epochs: int = 10, stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, seed: int = 42, keep_last: bool = False, distribution: str = "uniform", predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(batch_size, max_epochs, learning_rate, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        self.num_components, self.num_negatives, self.window_size, self.K, self.clipnorm, self.distribution = num_components, num_negatives, window_size, K, clipnorm, distribution

    def _read(self, x: Interactions) -> tuple[DataFrame, np.ndarray]:
        """The events, and how often each item occurs."""
        events = x.df.select(USER, *((TIME,) if x.has_timestamps else ()), EVENT, ITEM)
        if self.max_epochs > 1:
            events = events.persist(StorageLevel.DISK_ONLY)
        found, counts = events.filter(F.col(ITEM).isNotNull()).groupBy(ITEM).count().toArrow(), np.zeros(self.num_items, np.int64)
        counts[found[ITEM].to_numpy()] = found["count"].to_numpy()
        return events, counts

    def _init(self, events: DataFrame, counts: np.ndarray) -> None:
        sd = 1 / np.sqrt(self.num_components)
        self.params = {k: Var(self.rng.normal(0, sd, (self.num_items, self.num_components))) for k in ("input", "output")}
        self.optimiser = Optimiser(self.params, "adam", self.learning_rate, self.clipnorm)
        self.active_ = np.flatnonzero(counts)
        self.p_ = unigram_distribution(counts) if self.distribution == "unigram" else None
        self.events_ = events

    def _epoch(self, events: DataFrame, counts: np.ndarray) -> list[float]:
        """All steps in one task, which is sent the parameters and sends them back; they follow on each other."""
        seed, own = int(self.rng.integers(1 << 62)), self.optimiser
        size, negatives, items, p, lr, clip = self.batch_size, self.num_negatives, self.num_items, self.p_, self.learning_rate, self.clipnorm
        spark = events.sparkSession
        sent = spark.sparkContext.broadcast(({k: v.data for k, v in self.params.items()}, own.m, own.v, own.t))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data, m, v, t = sent.value
            params, rng, out = {k: Var(x) for k, x in data.items()}, np.random.default_rng(seed), []
            optimiser = Optimiser(params, "adam", lr, clip)
            optimiser.m, optimiser.v, optimiser.t = dict(m), dict(v), t
            for f, c in in_batches(batches, size):
                neg = rng.choice(items, (len(c), negatives), p=p)
                neg = np.where(neg == c[:, None], (neg + 1) % items, neg)
                out.append(skipgram_gradients(params, f, c, neg))
                optimiser.step()
            yield from pieces([*(x[k] for k in data for x in ({k: params[k].data}, optimiser.m, optimiser.v)), np.array([optimiser.t, np.mean(out or [0.0])])])

        parts = parts_for(2 * self.window_size * int(counts.sum()), PAIRS)
        total = 6 * items * self.num_components + 2
        rows = shuffled_pairs(events, self.window_size, parts, seed).select("focus", "context").coalesce(1).mapInArrow(train, "place bigint, value binary")
        state, n = np.empty(total), 0
        for place, value in rows.repartition(parts_for(8 * total, 16 * BYTES), "place").toLocalIterator():
            part = np.frombuffer(value)
            state[place : place + len(part)] = part
            n += len(part)
        sent.unpersist()
        if n == 0:
            return [0.0]
        if n != total:
            raise RuntimeError(f"{n} of {total} numbers came back from training")
        each = state[:-2].reshape(2, 3, items, self.num_components)
        for k, (data, m, v) in zip(self.params, each, strict=True):
            self.params[k].data, own.m[k], own.v[k] = data, m, v
        own.t = int(state[-2])
        return [float(state[-1])]

    def _after_epoch(self) -> None:
        self.sim_ = self._similarities()

    def _similarities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, sim), by i."""
        e = np.zeros_like(self.params["input"].data)
        e[self.active_] = self.params["input"].data[self.active_]
        return nearest(e, self.K)

    def _validation(self, validation) -> DataFrame | None:
        """(uid, own, out): the items of both sides, of the users that are on both."""
        if validation is None:
            return None
        given, out = (v.df.groupBy(USER).agg(F.sort_array(F.collect_set(ITEM)).alias(name)) for v, name in zip(validation, ("own", "out"), strict=True))
        held = given.join(out, USER)
        if self.validation_sample_size:
            both = validation[0].active_users.join(validation[1].active_users, USER)
            drawn = both.orderBy(F.xxhash64(F.lit(int(self.rng.integers(1 << 62))), USER), USER).limit(self.validation_sample_size)
            held = held.join(drawn, USER, "left_semi")
        self.held_ = held.persist(StorageLevel.DISK_ONLY) if self.max_epochs > 1 else held
        return self.held_

    def _value(self, stop: StoppingCriterion, held: DataFrame) -> float | None:
        """From sums over batches of users, made where they are; drawn criteria draw anew for each user, however they are dealt out."""
        i, j, sim = self.sim_
        items, criterion = self.num_items, self.stopping_criterion
        sent = held.sparkSession.sparkContext.broadcast((np.searchsorted(i, np.arange(items + 1)), j, sim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = StoppingCriterion.create(criterion)
            size = 1 if own.drawn else max(1, MAX_CELLS // max(1, items))
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    users, *sides = (batch.slice(lo, size).column(c) for c in (USER, "own", "out"))
                    (n, x), (m, y) = ((np.diff(s.offsets.to_numpy()), s.flatten().to_numpy()) for s in sides)
                    truth = np.zeros((len(users), items))
                    truth[np.repeat(np.arange(len(users)), m), y] = 1
                    total, weight = own.sums([(truth, similar(*sent.value, n, x))], np.random.default_rng([42, abs(users[0].as_py())]))
                    yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([weight])], names=["total", "weight"])

        total, weight = held.mapInArrow(run, "total double, weight double").agg(F.sum("total"), F.sum("weight")).first()
        sent.unpersist()
        return total / weight if weight else None

    def _dense(self, users, histories):
        i, j, sim = self.sim_
        own = [np.unique(h) for h in histories]
        return similar(np.searchsorted(i, np.arange(self.num_items + 1)), j, sim, np.array([len(h) for h in own], np.int64), np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64))

    def _finish(self, x) -> None:
        for kept in {"events_", "held_"} & set(vars(self)):
            vars(self).pop(kept).unpersist()
        self.i_, self.j_, self.s_ = self.sim_
        self._restore()

    def _kept(self):
        return [*super()._kept(), "i_", "j_", "s_"]

    def _restore(self) -> None:
        spark = SparkSession.active()
        self.similarity_ = spark.createDataFrame(pa.table({"i": self.i_, "j": self.j_, "sim": self.s_}), "i bigint, j bigint, sim double")

    def _predict(self, x) -> DataFrame:
        return applied(x.binary_values, self.similarity_)


def nearest(e: np.ndarray, k: int, allowed: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of each row with its k nearest others, by i; `allowed` gives the cells that count of some rows."""
    norm = np.linalg.norm(e, axis=1, keepdims=True)
    unit = np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)
    out, size = [], max(1, min(1024, MAX_CELLS // max(1, len(e))))
    for lo in range(0, len(e), size):
        s = unit[lo : lo + size] @ unit.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = 0
        if allowed is not None:
            s = np.where(allowed(slice(lo, lo + size)), s, 0)
        s = best_of(s, k)
        r, c = np.nonzero(s)
        out.append((r + lo, c, s[r, c]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def best_of(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, of equal ones those further right; 0 for the rest."""
    at = np.argsort(s, 1, kind="stable")[:, -min(k, s.shape[1]) :]
    out = np.zeros_like(s)
    np.put_along_axis(out, at, np.take_along_axis(s, at, 1), 1)
    return out


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 50) -> np.ndarray:
    """Cluster numbers, from k-means++ starts."""
    centres = [x[rng.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        far = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() else x[rng.integers(len(x))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.stack([((x - c) ** 2).sum(1) for c in centres], 1).argmin(1)
        new = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return own


class Prod2VecClustered(Prod2Vec):
    """As Prod2Vec, with neighbours only in the Kcl clusters that a cluster's items lead to most often."""

    def __init__(self, num_components: int = 300, num_negatives: int = 10, window_size: int = 2, stopping_criterion: str = "precision", K: int = 200, num_clusters: int = 5, Kcl: int = 2, batch_size: int = 1000, learning_rate: float = 0.01, clipnorm: float = 1.0, max_epochs: int = 10, stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, seed: int = 42, keep_last: bool = False, distribution: str = "uniform", predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(num_components, num_negatives, window_size, stopping_criterion, K, batch_size, learning_rate, clipnorm, max_epochs, stop_early, max_iter_no_change, min_improvement, seed, keep_last, distribution, predict_topK, validation_sample_size)
        self.num_clusters, self.Kcl = num_clusters, Kcl

    def transitions(self, cluster: np.ndarray) -> np.ndarray:
        """How often an item of a cluster (row) is followed by one of another or the same (column)."""
        k = self.num_clusters
        sent = self.events_.sparkSession.sparkContext.broadcast(cluster)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k * k, np.int64)
            for batch in batches:
                a, b = (sent.value[batch.column(c).to_numpy()] for c in "ab")
                out += np.bincount(a * k + b, minlength=k * k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(out)], names=["cell", "n"])

        out = np.zeros(k * k)
        for cell, n in following(self.events_, 1).select("a", "b").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
            out[cell] = n
        sent.unpersist()
        return out.reshape(k, k)

    def _similarities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.params["input"].data
        cluster = np.full(self.num_items, -1)
        cluster[self.active_] = kmeans(e[self.active_], self.num_clusters, np.random.default_rng(self.seed))
        counts = self.transitions(cluster)
        linked = np.zeros_like(counts, bool)
        for c in range(self.num_clusters):
            top = np.argsort(-counts[c], kind="stable")[: self.Kcl]
            linked[c, top[counts[c, top] > 0]] = True
        live = cluster >= 0
        return nearest(np.where(live[:, None], e, 0), self.K, lambda at: linked[cluster[at]][:, cluster] & live[at, None] & live[None, :])


class MultVAE(TrainedModel):
    """A variational auto-encoder of rows with a multinomial likelihood."""

    def __init__(self, batch_size: int = 500, max_epochs: int = 200, learning_rate: float = 1e-4, seed: int = 42, dim_bottleneck_layer: int = 200, dim_hidden_layer: int = 600, max_beta: float = 0.2, anneal_steps: int = 200_000, dropout: float = 0.5, stopping_criterion: str = "ndcg", stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, keep_last: bool = False, clamp_beta: bool = False, predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(batch_size, max_epochs, learning_rate, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        self.dim_bottleneck_layer, self.dim_hidden_layer, self.max_beta, self.anneal_steps, self.dropout, self.clamp_beta = dim_bottleneck_layer, dim_hidden_layer, max_beta, anneal_steps, dropout, clamp_beta

    def _init(self, users, histories) -> None:
        i, h, z = self.num_items, self.dim_hidden_layer, self.dim_bottleneck_layer
        sizes = {"q1": (i, h), "q2": (h, 2 * z), "p1": (z, h), "p2": (h, i)}
        for k, (a, b) in sizes.items():
            self.params[k] = Var(self.rng.normal(0, np.sqrt(2 / (a + b)), (a, b)))
            self.params[f"{k}b"] = Var(np.zeros(b))
        self.optimiser, self.steps = Optimiser(self.params, "adam", self.learning_rate), 0

    @property
    def beta(self) -> float:
        """Grows with the steps; past 1 it is max_beta (or never above it, with clamp_beta)."""
        grown = self.steps / self.anneal_steps if self.anneal_steps else 1.0
        return min(grown, self.max_beta) if self.clamp_beta else (grown if grown < 1 else self.max_beta)

    def _epoch(self, users, histories):
        order, out = self.rng.permutation(len(histories)), []
        z = self.dim_bottleneck_layer
        for lo in range(0, len(order), self.batch_size):
            x = _rows([histories[i] for i in order[lo : lo + self.batch_size]], self.num_items)
            p = self.params
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            unit = unit * (self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
            h = ag.tanh(var(unit) @ p["q1"] + p["q1b"]) @ p["q2"] + p["q2b"]
            mean, logvar = h[:, :z], h[:, z:]
            code = mean + ag.exp(0.5 * logvar) * self.rng.normal(size=mean.shape)
            logits = ag.tanh(code @ p["p1"] + p["p1b"]) @ p["p2"] + p["p2b"]
            loss = losses.vae_loss(logits, mean, logvar, x, self.beta)
            loss.backward()
            self.optimiser.step()
            self.steps += 1
            out.append(float(loss.data))
        return out

    _needed = ("dim_bottleneck_layer",)

    def _score(self, s, users, histories):
        x = _rows(histories, self.num_items)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        mean = (np.tanh(x @ s["q1"] + s["q1b"]) @ s["q2"] + s["q2b"])[:, : self.dim_bottleneck_layer]
        return np.tanh(mean @ s["p1"] + s["p1b"]) @ s["p2"] + s["p2b"]


def _layer_norm(x: Var, gain: Var, shift: Var) -> Var:
    centred = x - x.mean(1, keepdims=True)
    return centred * ((centred**2).mean(1, keepdims=True) + 1e-5) ** -0.5 * gain + shift


def swish(x: Var) -> Var:
    return x * ag.sigmoid(x)


def log_normal(x: Var, mean, logvar) -> Var:
    mean, logvar = var(mean), var(logvar)
    return -0.5 * (logvar + float(np.log(2 * np.pi)) + (x - mean) ** 2 * ag.exp(-logvar))


class RecVAE(TrainedModel):
    """A variational auto-encoder with a composite prior; encoder and decoder take turns."""

    #: Weights of the standard normal, the encoder before, and the wide normal.
    PRIOR = (3 / 20, 3 / 4, 1 / 10)

    def __init__(self, batch_size: int = 500, max_epochs: int = 200, learning_rate: float = 5e-4, n_enc_epochs: int = 3, n_dec_epochs: int = 1, seed: int = 42, dim_bottleneck_layer: int = 200, dim_hidden_layer: int = 600, gamma: float | None = 0.005, beta: float | None = None, dropout: float = 0.5, stopping_criterion: str = "ndcg", stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.0, keep_last: bool = False, predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(batch_size, max_epochs, learning_rate, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        self.n_enc_epochs, self.n_dec_epochs, self.dim_bottleneck_layer, self.dim_hidden_layer = n_enc_epochs, n_dec_epochs, dim_bottleneck_layer, dim_hidden_layer
        self.gamma, self.beta, self.dropout = gamma, beta, dropout

    def _init(self, users, histories) -> None:
        i, h, z = self.num_items, self.dim_hidden_layer, self.dim_bottleneck_layer
        glorot = lambda a, b: Var(self.rng.normal(0, np.sqrt(2 / (a + b)), (a, b)))
        for k in range(5):
            a = i if k == 0 else h
            self.params |= {f"e{k}": glorot(a, h), f"e{k}b": Var(np.zeros(h)), f"g{k}": Var(np.ones(h)), f"s{k}": Var(np.zeros(h))}
        self.params |= {"mu": glorot(h, z), "mub": Var(np.zeros(z)), "lv": glorot(h, z), "lvb": Var(np.zeros(z)), "d": glorot(z, i), "db": Var(np.zeros(i))}
        self.optimiser = Optimiser(self.params, "adam", self.learning_rate)
        self._remember()

    def _remember(self) -> None:
        self.before = {k: Var(p.data.copy()) for k, p in self.params.items() if not k.startswith("d")}

    @staticmethod
    def encode(p: dict[str, Var], x: Var) -> tuple[Var, Var]:
        done = None
        for k in range(5):
            h = (x if k == 0 else out) @ p[f"e{k}"] + p[f"e{k}b"]  # noqa: F821
            if done is not None:
                h = h + done
            out = _layer_norm(swish(h), p[f"g{k}"], p[f"s{k}"])
            done = out if done is None else done + out
        return out @ p["mu"] + p["mub"], out @ p["lv"] + p["lvb"]

    def _turn(self, histories, decoder: bool) -> list[float]:
        order, out = self.rng.permutation(len(histories)), []
        names = {k for k in self.params if k.startswith("d") == decoder}
        for lo in range(0, len(order), self.batch_size):
            x = _rows([histories[i] for i in order[lo : lo + self.batch_size]], self.num_items)
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            given = unit if decoder else unit * (self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout)
            mean, logvar = self.encode(self.params, var(given))
            code = mean + ag.exp(0.5 * logvar) * self.rng.normal(size=mean.shape)
            like = (ag.log_softmax(code @ self.params["d"] + self.params["db"]) * var(x)).sum(1)
            loss = -like.mean()
            if not decoder:
                old_mean, old_logvar = self.encode(self.before, var(unit))
                a, b, c = (float(np.log(w)) for w in self.PRIOR)
                zero = np.zeros(mean.shape)
                prior = ag.log_sum_exp([log_normal(code, zero, zero) + a, log_normal(code, old_mean.data, old_logvar.data) + b, log_normal(code, zero, zero + 10) + c])
                kl = (log_normal(code, mean, logvar) - prior).sum(1)
                weight = self.gamma * x.sum(1) if self.gamma else (self.beta or 1.0)
                loss = loss + (kl * weight).mean()
            loss.backward()
            self.optimiser.step(names)
            out.append(float(loss.data))
        return out

    def _epoch(self, users, histories):
        out = []
        for _ in range(self.n_enc_epochs):
            out += self._turn(histories, False)
        self._remember()
        for _ in range(self.n_dec_epochs):
            out += self._turn(histories, True)
        return out

    def _score(self, s, users, histories):
        x = _rows(histories, self.num_items)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        mean, _ = self.encode({k: Var(v) for k, v in s.items()}, var(x))
        return mean.data @ s["d"] + s["db"]


class _GRU4Rec(TrainedModel):
    """A gated recurrent net over histories; scores are its output after the last item."""

    def __init__(self, num_layers: int = 1, hidden_size: int = 100, num_components: int = 250, dropout: float = 0, learning_rate: float = 0.03, optimization_algorithm: str = "adagrad", clipnorm: float | None = 1.0, bptt: int = 1, batch_size: int = 512, max_epochs: int = 5, stopping_criterion: str = "recall", stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, seed: int = 42, keep_last: bool = False, predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(batch_size, max_epochs, learning_rate, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        if optimization_algorithm not in ("adagrad", "sgd"):
            raise ValueError("optimization_algorithm must be adagrad or sgd")
        self.num_layers, self.hidden_size, self.num_components, self.dropout = num_layers, hidden_size, num_components, dropout
        self.optimization_algorithm, self.clipnorm, self.bptt = optimization_algorithm, clipnorm, bptt

    _needed = ("num_layers", "hidden_size")

    def _init(self, users, histories) -> None:
        h = self.hidden_size
        make = lambda *shape: Var(self.rng.normal(0, np.sqrt(2 / sum(shape)), shape))
        self.params = {"emb": make(self.num_items + 1, self.num_components), "out": make(h, self.num_items), "outb": Var(np.zeros(self.num_items))}
        for layer in range(self.num_layers):
            self.params |= {f"w{layer}": make(self.num_components if layer == 0 else h, 3 * h), f"u{layer}": make(h, 3 * h), f"b{layer}": Var(np.zeros(3 * h))}
        self.optimiser = Optimiser(self.params, self.optimization_algorithm, self.learning_rate, self.clipnorm)

    def step(self, p: dict[str, Var], x: Var, states: list[Var]) -> list[Var]:
        h, out = self.hidden_size, []
        for layer, s in enumerate(states):
            a, b = x @ p[f"w{layer}"] + p[f"b{layer}"], s @ p[f"u{layer}"]
            r, z = ag.sigmoid(a[:, :h] + b[:, :h]), ag.sigmoid(a[:, h : 2 * h] + b[:, h : 2 * h])
            new = ag.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            x = z * s + (1 - z) * new
            out.append(x)
        return out

    def _epoch(self, users, histories):
        out, pad = [], self.num_items
        usable = [i for i, h in enumerate(histories) if len(h) > 1]
        for _, x in SequenceBatches(pad, self.batch_size, int(self.rng.integers(1 << 30))).sample(np.asarray(users)[usable], [histories[i] for i in usable]):
            states = [Var(np.zeros((len(x), self.hidden_size))) for _ in range(self.num_layers)]
            for lo in range(0, x.shape[1] - 1, self.bptt):
                states = [Var(s.data) for s in states]  # gradients go back through bptt steps only
                total = None
                for t in range(lo, min(lo + self.bptt, x.shape[1] - 1)):
                    new = self.step(self.params, self.params["emb"][x[:, t]], states)
                    live = np.flatnonzero(x[:, t + 1] != pad)
                    mask = (x[:, t + 1] != pad)[:, None].astype(float)
                    states = [n * mask + s * (1 - mask) for n, s in zip(new, states, strict=True)]
                    if len(live):
                        loss = self._loss(states[-1][live], x[live, t + 1])
                        total = loss if total is None else total + loss
                if total is not None:
                    total.backward()
                    self.optimiser.step()
                    out.append(float(total.data))
        return out or [0.0]

    def _score(self, s, users, histories):
        p = {k: Var(v) for k, v in s.items()}
        width = max((len(h) for h in histories), default=0)
        states = [Var(np.zeros((len(histories), self.hidden_size))) for _ in range(self.num_layers)]
        for t in range(width):
            items = np.array([h[t] if t < len(h) else self.num_items for h in histories])
            mask = (items != self.num_items)[:, None].astype(float)
            new = self.step(p, p["emb"][items], states)
            states = [Var(n.data * mask + o.data * (1 - mask)) for n, o in zip(new, states, strict=True)]
        return states[-1].data @ s["out"] + s["outb"]


class GRU4RecCrossEntropy(_GRU4Rec):
    """Against all items."""

    def _loss(self, h: Var, target: np.ndarray) -> Var:
        y = ag.log_softmax(h @ self.params["out"] + self.params["outb"])
        return -y[(np.arange(len(target)), target)].mean()


class GRU4RecNegSampling(_GRU4Rec):
    """Against drawn items, by bpr, bpr-max, top1 or top1-max."""

    def __init__(self, num_layers: int = 1, hidden_size: int = 100, num_components: int = 250, dropout: float = 0, loss_fn: str = "bpr", num_negatives: int = 50, learning_rate: float = 0.03, optimization_algorithm: str = "adagrad", clipnorm: float | None = 1.0, bptt: int = 1, batch_size: int = 512, max_epochs: int = 5, stopping_criterion: str = "recall", stop_early: bool = False, max_iter_no_change: int = 5, min_improvement: float = 0.01, seed: int = 42, keep_last: bool = False, predict_topK: int | None = None, validation_sample_size: int | None = None) -> None:
        super().__init__(num_layers, hidden_size, num_components, dropout, learning_rate, optimization_algorithm, clipnorm, bptt, batch_size, max_epochs, stopping_criterion, stop_early, max_iter_no_change, min_improvement, seed, keep_last, predict_topK, validation_sample_size)
        if loss_fn not in losses.LOSSES:
            raise ValueError(f"loss_fn must be one of {tuple(losses.LOSSES)}")
        self.loss_fn, self.num_negatives = loss_fn, num_negatives

    def _loss(self, h: Var, target: np.ndarray) -> Var:
        neg = self.rng.integers(0, self.num_items, (len(target), self.num_negatives))
        neg = np.where(neg == target[:, None], (neg + 1) % self.num_items, neg)
        out = self.params["out"].T
        a = (h * out[target]).sum(1) + self.params["outb"][target]
        b = (h[(slice(None), None)] * out[neg]).sum(2) + self.params["outb"][neg]
        if self.loss_fn == "bpr":
            return losses.bpr_loss(a[(slice(None), None)], b)
        return losses.LOSSES[self.loss_fn](a, b)
