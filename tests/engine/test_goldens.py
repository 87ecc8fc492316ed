"""Hand-computed cases of the data model, rankings, metrics and models."""

from math import exp, log2, sqrt

import numpy as np
import pytest

from toplane.functions import metrics as M
from toplane.operators import encode, filters, scenarios, splits
from toplane.operators.interactions import Interactions
from toplane.operators.models import baseline, factor, knn, linear, neural, sequential, timeaware
from toplane.plans import algebra

LOG = [(0, 0, 3), (0, 1, 2), (1, 2, 1), (1, 3, 4), (2, 0, 0), (2, 1, 1), (3, 2, 2), (3, 4, 4), (4, 0, 0), (4, 1, 1), (5, 2, 2)]


def im(spark, rows, shape=None):
    return Interactions(spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in rows], "uid bigint, iid bigint, ts double"), "iid", "uid", "ts", shape=shape)


def cells(df, row="i", column="j", value="sim"):
    return {(r[row], r[column]): r[value] for r in df.collect()}


def same(got, want, tol=1e-9):
    assert set(got) == set(want), (got, want)
    assert all(got[k] == pytest.approx(v, abs=tol) for k, v in want.items()), (got, want)


def test_data_model(spark):
    x = im(spark, [(0, 1, 3), (1, 1, 2), (1, 2, 1), (2, 3, 1), (1, 1, 4)])
    assert x.shape == (3, 4) and x.num_interactions == 5 and x.density == 4 / 12
    assert sorted(r["ts"] for r in x.timestamps_gt(2).df.collect()) == [3, 4]
    assert sorted(r["ts"] for r in x.timestamps_lte(2).df.collect()) == [1, 1, 2]
    assert x.timestamps_lt(2).shape == (3, 4)
    assert sorted(r["interactionid"] for r in x.df.collect()) == [0, 1, 2, 3, 4]
    assert cells(x.values, "uid", "iid", "value") == {(0, 1): 1, (1, 1): 2, (1, 2): 1, (2, 3): 1}
    with pytest.raises(ValueError):
        im(spark, [(5, 1, 1)], shape=(3, 3))
    with pytest.raises(KeyError):
        x.indices_in([(0, 3)])
    with pytest.raises(AttributeError):
        x.eliminate_timestamps().timestamps_gt(1)
    assert x.union(x).num_interactions == 10


def test_filters(spark):
    users = [0] * 5 + [1] * 4 + [2] * 3 + [3] * 2 + [1] * 3 + [4] * 3
    items = [0, 1, 2, 3, 4, 0, 1, 2, 3, 0, 1, 2, 0, 1, 5, 5, 5, 1, 1, 1]
    df = spark.createDataFrame([(u, i, t) for t, (u, i) in enumerate(zip(users, items, strict=True))], "u int, i int, t int")
    assert filters.Deduplicate("i", "u", "t").apply(df).count() == len(df.collect()) - 4
    assert {r["i"] for r in filters.NMostRecent(3, "i", "t").apply(df).collect()} == {0, 1, 5}
    assert {r["i"] for r in filters.NMostPopular(3, "i").apply(df).collect()} >= {0, 1}


def test_sessions(spark):
    views = spark.createDataFrame([(1, 0, 1), (1, 1, 5), (1, 2, 8), (2, 0, 1), (2, 1, 9), (3, 0, 1), (3, 1, 3), (5, 0, 1), (5, 1, 2)], "uid int, iid int, ts int")
    buys = spark.createDataFrame([(1, 0, 7), (2, 0, 5), (3, 0, 8), (5, 0, 9)], "uid int, iid int, ts int")
    a, b = encode.SessionPreprocessor("iid", "uid", "ts", 5).process_many(views, buys)
    assert a.shape == b.shape and a.num_active_users == 4 + 0 and a.num_interactions == 9
    with pytest.raises(KeyError):
        encode.SessionPreprocessor("iid", "uid", "ts").process(views.drop("ts"))


def test_splits_are_disjoint_and_whole(spark):
    rng = np.random.default_rng(42)
    x = im(spark, zip(rng.integers(0, 40, 600), rng.integers(0, 30, 600), rng.integers(0, 100, 600), strict=True))
    for s in (splits.FractionInteractionSplitter(0.7), splits.TimestampSplitter(50), splits.MostRecentSplitter(3), splits.MostRecentSplitter(-3), splits.UserInteractionTimeSplitter(98), splits.StrongGeneralizationSplitter(0.7)):
        a, b = ({r["interactionid"] for r in p.df.collect()} for p in s.split(x))
        assert not a & b and len(a | b) == 600, s
    for make in (lambda: scenarios.WeakGeneralization(0.8, validation=True), lambda: scenarios.Timed(60, 30, validation=True), lambda: scenarios.LastItemPrediction(validation=True)):
        scenario = make()
        scenario.split(x)
        a, b = scenario.test_data
        assert {r[0] for r in a.active_users.collect()} == {r[0] for r in b.active_users.collect()}
        assert scenario.validation_data is not None
    with pytest.raises(ValueError):
        scenarios.StrongGeneralizationTimedMostRecent(5, n_most_recent_out=0)


SCORES = [(0, 0, 0.3), (0, 2, 0.2), (0, 3, 0.1), (2, 1, 0.23), (2, 3, 0.3), (2, 4, 0.5)]
TRUTH = [(0, 0), (0, 2), (2, 0), (2, 1), (2, 3)]


def value(metric, truth, scores, shape=(10, 5), fit=None):
    if fit is not None:
        metric.fit(fit)
    metric.calculate(truth, scores, shape)
    return metric.value


def test_ranks_and_metrics(spark):
    counts = spark.createDataFrame([(2, 1, 1.0), (2, 3, 2.0), (2, 4, 1.0), (0, 0, 1.0), (0, 2, 1.0), (0, 4, 2.0)], "uid bigint, iid bigint, score double")
    assert cells(algebra.top_k_ranks(counts), "uid", "iid", "rank") == {(0, 0): 3, (0, 2): 2, (0, 4): 1, (2, 1): 3, (2, 3): 1, (2, 4): 2}
    p = spark.createDataFrame(SCORES, "uid bigint, iid bigint, score double")
    t = spark.createDataFrame(TRUTH, "uid bigint, iid bigint")
    more = spark.createDataFrame([*TRUTH, (3, 1)], "uid bigint, iid bigint")
    assert value(M.DCGK(2), t, p) == pytest.approx((1 + 2 / log2(3)) / 2)
    assert value(M.NDCGK(2), t, p) == pytest.approx(0.693426, abs=1e-6)
    assert value(M.NDCGK(3), t, p) == pytest.approx(0.765361, abs=1e-6)
    assert value(M.RecallK(2), t, p) == pytest.approx(2 / 3) and value(M.RecallK(2), more, p) == pytest.approx(4 / 9)
    assert value(M.PrecisionK(2), t, p) == 0.75 and value(M.PrecisionK(2), more, p) == 0.5
    assert value(M.ReciprocalRankK(2), t, p) == 0.75 and value(M.HitK(2), t, p) == 1.5
    assert value(M.DiscountedGainK(2), t, p) == pytest.approx((1 + 2 / log2(3)) / 2)
    assert value(M.CoverageK(2), t, p) == pytest.approx(4 / 5)
    as_matrix = t.selectExpr("uid", "iid", "1 as value")
    assert value(M.IPSHitRateK(2), t, p, fit=as_matrix) == pytest.approx(12.5 / 2)
    features = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], "iid bigint, fid bigint")
    assert value(M.IntraListDiversityK(2), t, p, fit=features) == pytest.approx(0.5)
    assert value(M.IntraListDiversityK(2), more, p, fit=features) == pytest.approx(1 / 3)
    with pytest.raises(AssertionError):
        value(M.IPSHitRateK(2), t, p)
    hit = M.HitK(2)
    hit.calculate(more, p)
    assert hit.results.count() == 6


def test_neighbours(spark):
    x = im(spark, [(0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)])
    s = 2 / sqrt(6)
    want = {(0, 1): 0.5, (1, 0): 0.5, (0, 2): s, (2, 0): s, (1, 2): s, (2, 1): s}
    same(cells(knn.ItemKNN(K=2).fit(x).similarity_), want)
    given = im(spark, [(0, 0, 1), (0, 1, 1)])
    same(cells(knn.ItemKNN(K=2).fit(x).predict(given), "uid", "iid", "score"), {(0, 0): 0.5, (0, 1): 0.5, (0, 2): 4 / sqrt(6)})
    d, f = sqrt(1 / 4 + 1 / 9), sqrt(2 / 4 + 1 / 9)
    normed = cells(knn.ItemKNN(K=2, normalize_X=True).fit(x).similarity_)
    assert normed[(0, 1)] == pytest.approx(1 / 9 / d / d) and normed[(0, 2)] == pytest.approx((1 / 9 + 1 / 4) / d / f)
    assert cells(linear.DAMIBCover(knn.ItemKNN(K=2), p=0, agg="sum").fit(x).predict(given), "uid", "iid", "score")[(0, 2)] == pytest.approx(4 / sqrt(6))


def test_kunn(spark):
    train = im(spark, [(0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)])
    got = cells(knn.KUNN(Ku=1, Ki=1).fit(train).knn_, "j", "i", "sim")
    assert got[(2, 0)] == pytest.approx((sqrt(2) + sqrt(3)) / 6)
    train = im(spark, [(0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)], shape=(5, 3))
    model = knn.KUNN(Ku=2, Ki=2).fit(train)
    near = model.user_similarities(model._input(im(spark, [(3, 0, 1), (3, 1, 1), (4, 1, 1), (4, 2, 1)], shape=(5, 3))))
    got = cells(near, "u", "v", "sim")
    assert got[(3, 1)] == pytest.approx(1 / sqrt(12)) and got[(3, 2)] == pytest.approx(2 / sqrt(18)) and (3, 0) not in got
    assert got[(4, 0)] == pytest.approx(1 / sqrt(12) + 1 / sqrt(16))


def test_pearson(spark):
    m = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (1, 0, 2), (1, 2, 2), (2, 1, 3), (2, 3, 3), (3, 0, 4), (3, 3, 4)], "uid bigint, iid bigint, value int")
    got = cells(knn.pearson(m))
    base = sqrt(4 / 3 * 4 / 3 + 1 / 9 + 25 / 9)
    assert got[(0, 2)] == pytest.approx((4 / 3 * 0.5 - 1 / 3 * 0.5) / (base * sqrt(0.5)))
    with pytest.raises(ValueError):
        knn.pearson(m.withColumn("value", m["value"] * 0 + 1))


def test_time_aware(spark):
    log = im(spark, [(0, 0, 1), (1, 0, 1), (2, 1, 1), (2, 2, 2), (1, 1, 3), (0, 2, 4)], shape=(3, 4))
    mirror = lambda d: d | {(j, i): v for (i, j), v in d.items()}
    same(cells(timeaware.TARSItemKNNHermann(K=2).fit(log).similarity_), mirror({(0, 1): 1 / 6, (0, 2): 1 / 7, (1, 2): 1 / 5}))
    xia = lambda f: cells(timeaware.TARSItemKNNXia(K=2, fit_decay=0.5, decay_function=f, decay_interval=1).fit(log).similarity_)
    same(xia("linear"), mirror({(0, 1): 2 / 3, (0, 2): 1 / 2, (1, 2): 5 / 6}))
    same(xia("convex"), mirror({(0, 1): 1 / 4, (0, 2): 1 / 8, (1, 2): 1 / 2}))
    same(xia("concave"), mirror({(0, 1): 1 - 0.5 ** (1 / 3), (1, 2): 1 - 0.5 ** (2 / 3)}) | {})
    later = im(spark, [(u, i, t + 1) for u, i, t in LOG])
    got = cells(timeaware.TARSItemKNNCoocDistance(K=2, fit_decay=0.5).fit(later).similarity_)
    same(got, mirror({(0, 1): 3 * exp(-0.5), (2, 3): exp(-1.5), (2, 4): exp(-1)}))
    weights = cells(timeaware.TARSItemKNNLee(w=3)._fit_matrix(im(spark, LOG)), "uid", "iid", "value")
    same(weights, {(0, 0): 1.7, (0, 1): 0.7, (1, 2): 0.7, (1, 3): 3.3, (2, 1): 0.7, (3, 2): 0.7, (3, 4): 3.3, (4, 1): 0.7, (5, 2): 0.7})
    liu = cells(timeaware.TARSItemKNNLiu2012()._fit_matrix(later), "uid", "iid", "value")
    assert liu[(0, 0)] == pytest.approx(log2(1.25) + 1) and liu[(1, 3)] == pytest.approx(log2(1.6) + 1) and liu[(0, 1)] == 1
    with pytest.raises(TypeError):
        timeaware.TARSItemKNN().fit(log.values)
    with pytest.raises(ValueError):
        timeaware.TARSItemKNN(decay_function="log")


def test_sequences(spark):
    x = im(spark, [(0, 2, 1), (0, 1, 2), (0, 0, 3), (0, 3, 4), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 4, 4)])
    got = cells(sequential.SequentialRules(K=5).fit(x).similarity_)
    want = {(0, 1): 1 / 2, (0, 2): 1 / 4, (0, 3): 1 / 2, (0, 4): 1 / 6, (1, 0): 1 / 2, (1, 2): 1 / 2, (1, 3): 1 / 4, (1, 4): 1 / 4, (2, 0): 1 / 4, (2, 1): 1 / 2, (2, 3): 1 / 6, (2, 4): 1 / 2}
    same(got, want)
    train = im(spark, [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 2, 1), (1, 3, 2)])
    given = im(spark, [(2, 1, 4), (2, 3, 5), (3, 2, 6), (3, 3, 7)])
    stan = sequential.STAN(K=2, interaction_decay=1, session_decay=1 / 5, distance_from_match_decay=1).fit(train)
    e = exp
    same(cells(stan.predict(given), "uid", "iid", "score"), {(2, 0): e(-12 / 5) / sqrt(6), (2, 2): e(-12 / 5) / sqrt(6) + e(-8 / 5) / 2, (3, 0): e(-19 / 5) / sqrt(6), (3, 1): e(-14 / 5) / sqrt(6), (3, 2): (e(-2) + e(-3)) / 2})


def test_linear_and_factor_models(spark):
    x = im(spark, [(0, 0, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1), (3, 2, 1)])
    got = cells(linear.EASE(l2=0.03).fit(x).similarity_)
    assert got[(2, 0)] == pytest.approx(1, abs=0.1) and got[(0, 2)] == pytest.approx(1, abs=0.1)
    y = im(spark, [(0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)])
    scores = cells(factor.WMF(num_components=3, iterations=2).fit(y).predict(y), "uid", "iid", "score")
    pairs = {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)}
    assert all(v == pytest.approx(float(k in pairs), abs=0.25) for k, v in scores.items())
    m = np.array([[0, 1, 1], [1, 0, 1], [1, 1, 1]], float)
    u, s, v = np.linalg.svd(m)
    got = cells(factor.SVD(num_components=3).fit(y).predict(y), "uid", "iid", "score")
    want = u @ np.diag(s**2) @ v
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    assert cells(factor.NMF(num_components=3, max_iter=4).fit(y).predict(y), "uid", "iid", "score")[(2, 2)] > 0.5
    assert linear.SLIM().fit(y).similarity_.filter("sim < 0").count() == 0


def test_popularity(spark):
    x = im(spark, [(u, i, 1) for i in range(1, 5) for u in range(i)])
    got = cells(baseline.Popularity(K=2).fit(x).predict(x), "uid", "iid", "score")
    assert got == {(u, i): i / 4 for u in range(4) for i in (3, 4)}


@pytest.mark.parametrize("make", [lambda: neural.BPRMF(num_components=4, max_epochs=4, batch_size=20), lambda: neural.Prod2Vec(num_components=4, max_epochs=4, K=3), lambda: neural.MultVAE(dim_bottleneck_layer=4, dim_hidden_layer=8, max_epochs=6, learning_rate=0.01), lambda: neural.RecVAE(dim_bottleneck_layer=4, dim_hidden_layer=8, max_epochs=3, learning_rate=0.01), lambda: neural.GRU4RecCrossEntropy(hidden_size=6, num_components=4, max_epochs=4, bptt=2), lambda: neural.GRU4RecNegSampling(hidden_size=6, num_components=4, max_epochs=3, num_negatives=3, loss_fn="top1-max")])
def test_trained_models_learn(spark, make):
    rng = np.random.default_rng(1)
    x = im(spark, [(u, (u % 2) * 5 + int(rng.integers(5)), t) for u in range(20) for t in range(6)], shape=(20, 10))
    model = make().fit(x, (x, x))
    assert model.losses_[-1] < model.losses_[0]
    assert model.predict(x).count() > 0


def test_gradients():
    from toplane.functions import autograd as ag
    from toplane.functions import losses

    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    for f in (lambda x, y: losses.bpr_loss(x[:, 0], y[:, 0]), lambda x, y: losses.bpr_max_loss(x[:, 0], y, 0.5), lambda x, y: losses.top1_max_loss(x[:, 0], y), lambda x, y: losses.vae_loss(x, y, y * 0.3, np.abs(a)), lambda x, y: losses.covariance_loss(x, y), lambda x, y: (neural._layer_norm(neural.swish(x), y[0], y[1]) ** 2).sum()):
        x, y = ag.Var(a), ag.Var(b)
        f(x, y).backward()
        for v, base in ((x, a), (y, b)):
            i = (1, 0)
            step = np.zeros_like(base)
            step[i] = 1e-6
            args = [(ag.Var(base + s * step) if v is x else ag.Var(a), ag.Var(base + s * step) if v is y else ag.Var(b)) for s in (1, -1)]
            slope = (f(*args[0]).data - f(*args[1]).data) / 2e-6
            assert (v.grad[i] if v.grad is not None else 0) == pytest.approx(slope, abs=1e-5)
