"""Prod2Vec holds nothing for each event on the driver, and still does what a plain loop does."""

import numpy as np
import pyarrow as pa
import pytest

from toplane.functions import losses
from toplane.functions.autograd import Optimiser, Var
from toplane.operators.models import neural
from toplane.operators.models.base import parts_for
from toplane.plans import catalogue

MODELS = [lambda **kw: neural.Prod2Vec(num_components=4, K=5, **kw), lambda **kw: neural.Prod2VecClustered(num_components=4, K=5, num_clusters=3, **kw)]


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    train, given, out = catalogue._test(spark, sf_dir)
    shape = catalogue.im(catalogue.clicks(spark, sf_dir)).shape
    for x in (train, given, out):
        x._shape = shape
    return train, given, out


def test_pairs_are_shuffled_by_spark(spark, parts, monkeypatch):
    _, histories = neural.read_histories(parts[0])
    for window in (1, 3):
        want = sorted(zip(*(x.tolist() for x in neural.skipgram_pairs(histories, window)), strict=True))
        got = {}
        for seed in (1, 2):
            rows = neural.shuffled_pairs(parts[0].df, window, 5, seed)
            assert rows.rdd.getNumPartitions() == 5
            got[seed] = [(r["focus"], r["context"]) for r in rows.collect()]
            assert sorted(got[seed]) == want
            spark.conf.set("spark.sql.shuffle.partitions", "7")
            try:
                again = neural.shuffled_pairs(parts[0].df, window, 5, seed).select("focus", "context").coalesce(1)
                # the one task gets them in that order
                assert [tuple(r) for r in again.collect()] == got[seed]
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert got[1] != got[2]
        focus = np.array([f for f, _ in got[1]])
        # no part of the order is nearer to some items than another
        assert abs(focus[: len(focus) // 2].mean() - focus[len(focus) // 2 :].mean()) < 5 * focus.std() / np.sqrt(len(focus) / 4)


def test_batches_are_whole():
    rows = np.arange(23)
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[lo:hi]), pa.array(-rows[lo:hi])], names=["focus", "context"]) for lo, hi in ((0, 1), (1, 1), (1, 12), (12, 13), (13, 23))]
    got = list(neural.in_batches(batches, 5))
    assert [x.shape[1] for x in got] == [5, 5, 5, 5, 3]
    assert (np.concatenate(got, 1) == np.stack([rows, -rows])).all()
    assert not list(neural.in_batches([], 5))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    params = {k: Var(rng.normal(size=(9, 3))) for k in ("input", "output")}
    f, c, neg = rng.integers(0, 9, 40), rng.integers(0, 9, 40), rng.integers(0, 9, (40, 6))
    x = params["input"][f]
    loss = losses.skipgram_negative_sampling_loss((x * params["output"][c]).sum(1), (x[(slice(None), None)] * params["output"][neg]).sum(2))
    loss.backward()
    want = {k: p.grad for k, p in params.items()}
    assert neural.skipgram_gradients(params, f, c, neg) == pytest.approx(float(loss.data), rel=1e-12)
    assert all(np.allclose(params[k].grad, want[k], rtol=1e-12, atol=1e-15) for k in want)


def test_scores_are_sums_of_similarities(monkeypatch):
    rng = np.random.default_rng(3)
    sim = np.where(rng.random((7, 7)) < 0.5, rng.normal(size=(7, 7)), 0)
    i, j = np.nonzero(sim)
    own = [np.flatnonzero(rng.random(7) < 0.4) for _ in range(12)] + [np.zeros(0, np.int64)]
    want = np.array([sim[h].sum(0) for h in own])
    for limit in (1, 10, 1 << 20):
        monkeypatch.setattr(neural, "SUMS", limit)
        got = neural.similar(np.searchsorted(i, np.arange(8)), j, sim[i, j], np.array([len(h) for h in own]), np.concatenate(own))
        assert np.allclose(got, want)


@pytest.mark.parametrize("make", MODELS)
def test_no_events_reach_the_driver(parts, monkeypatch, make):
    """Steps of two epochs equal those of a plain loop over the same pairs; no history is read."""

    def refused(*_):
        raise AssertionError("events on the driver")

    monkeypatch.setattr(neural, "read_histories", refused)
    monkeypatch.setattr(neural, "BYTES", 64)
    monkeypatch.setattr(neural, "PAIRS", 2000)
    train, given, out = parts
    model = make(max_epochs=2, batch_size=500, keep_last=True, window_size=1).fit(train, (given, out))
    rng = np.random.default_rng(42)
    n = train.shape[1]
    params = {k: Var(rng.normal(0, 0.5, (n, 4))) for k in ("input", "output")}
    optimiser, means, events = Optimiser(params, "adam", 0.01, 1.0), [], train.num_interactions
    for _ in range(2):
        seed, each = int(rng.integers(1 << 62)), []
        f, c = np.array(neural.shuffled_pairs(train.df, 1, parts_for(2 * events, 2000), seed).select("focus", "context").collect()).T
        draws = np.random.default_rng(seed)
        for lo in range(0, len(f), 500):
            own = c[lo : lo + 500]
            neg = draws.integers(0, n, (len(own), 10))
            neg = np.where(neg == own[:, None], (neg + 1) % n, neg)
            x = params["input"][f[lo : lo + 500]]
            loss = losses.skipgram_negative_sampling_loss((x * params["output"][own]).sum(1), (x[(slice(None), None)] * params["output"][neg]).sum(2))
            loss.backward()
            optimiser.step()
            each.append(float(loss.data))
        means.append(np.mean(each))
    assert model.losses_ == pytest.approx(means, rel=1e-9)
    assert all(np.allclose(model.params[k].data, p.data, atol=1e-8) for k, p in params.items())
    assert not {"events_", "held_"} & set(vars(model))


@pytest.mark.parametrize("make", MODELS)
@pytest.mark.parametrize("name", list(neural.StoppingCriterion.FUNCTIONS))
def test_held_out_users_are_scored_where_they_are(parts, monkeypatch, make, name):
    train, given, out = parts
    model = make(max_epochs=1, stopping_criterion=name)
    model.num_users, model.num_items = train.shape
    model.rng, model.params = np.random.default_rng(1), {}
    model._init(*model._read(train))
    model._after_epoch()
    stop = neural.StoppingCriterion.create(name)
    got = model._value(stop, model._validation((given, out)))
    (users, histories), (others, outs) = neural.read_histories(given), neural.read_histories(out)
    assert (users == others).all()
    truth, scores = neural._rows(list(outs), train.shape[1]), model._dense(users, list(histories))
    if stop.drawn:
        sums = [stop.sums([(truth[r : r + 1], scores[r : r + 1])], np.random.default_rng([42, u])) for r, u in enumerate(users)]
        want = sum(t for t, _ in sums) / sum(w for _, w in sums)
    else:
        want = stop.value([(truth, scores)])
    assert got == pytest.approx(want, rel=1e-12)
    model.validation_sample_size = 10
    assert model._validation((given, out)).count() == min(10, len(users))
    assert model._value(stop, model._validation((given._with(given.df.limit(0)), out))) is None


def test_transitions_are_counted_where_the_events_are(parts):
    train = parts[0]
    model = MODELS[1](max_epochs=1)
    model.num_users, model.num_items = train.shape
    model.events_ = model._read(train)[0]
    cluster = np.random.default_rng(5).integers(0, 3, train.shape[1])
    want = np.zeros((3, 3))
    for h in neural.read_histories(train)[1]:
        np.add.at(want, (cluster[h[:-1]], cluster[h[1:]]), 1)
    assert (model.transitions(cluster) == want).all()


def test_without_pairs_nothing_is_learned(spark, parts):
    train = parts[0]
    for df in (train.df.limit(0), train.df.limit(1)):
        model = MODELS[0](max_epochs=2).fit(train._with(df))
        assert model.losses_ == [0.0, 0.0]
        assert model.predict(train).count() == 0
