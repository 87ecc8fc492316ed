"""What must not grow with the tables: the driver's share of training, and a task's of a join or ranking."""

import numpy as np
import pytest

from toplane.functions import samplers
from toplane.functions.autograd import Optimiser, Var
from toplane.operators.models import base, factor, neural
from toplane.plans import algebra, catalogue


def test_histories_are_read_as_item_numbers(spark, sf_dir, monkeypatch):
    events = catalogue.im(catalogue.clicks(spark, sf_dir))
    rows = sorted((r["uid"], r["ts"], r["interactionid"], r["iid"]) for r in events.df.collect())

    def refused(*_):
        raise AssertionError("all events as objects on the driver")

    monkeypatch.setattr(type(events.df), "toPandas", refused)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # users are cut by batches
    try:
        users, histories = neural.read_histories(events)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert histories.items.nbytes == 4 * len(rows) and len(users) == len(histories)
    assert [(u, i) for u, h in zip(users.tolist(), histories, strict=True) for i in h.tolist()] == [(u, i) for u, _, _, i in rows]
    none = neural.read_histories(events._with(events.df.limit(0)))
    assert len(none[0]) == len(none[1]) == 0


def test_held_out_users_are_scored_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    truth, scores = (rng.random((57, 30)) < 0.2).astype(float), rng.normal(size=(57, 30))
    truth[:, 3] = 1
    for name in neural.StoppingCriterion.FUNCTIONS:
        stop = neural.StoppingCriterion.create(name)
        whole = stop.value([(truth, scores)])
        assert stop.value([(truth[lo : lo + 10], scores[lo : lo + 10]) for lo in range(0, 57, 10)]) == pytest.approx(whole, rel=1e-12)
    model = neural.BPRMF(num_components=4)
    model.num_items, model.params = 30, {"w": Var(rng.normal(size=(60, 4))), "h": Var(rng.normal(size=(30, 4)))}
    outs = neural.Histories(np.nonzero(truth)[1].astype(np.int32), truth.sum(1).astype(int))
    monkeypatch.setattr(neural, "MAX_CELLS", 300)
    blocks = list(model._blocks(np.arange(57), np.arange(57), outs, np.arange(57), outs))
    assert max(len(t) for t, _ in blocks) == 10
    assert (np.concatenate([t for t, _ in blocks]) == truth).all()
    assert np.allclose(np.concatenate([s for _, s in blocks]), model.params["w"].data[:57] @ model.params["h"].data.T)


def test_pairs_are_worked_out_from_their_numbers():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 6, n).astype(np.int32) for n in (5, 1, 0, 2, 9, 3)]
    histories = neural.Histories(np.concatenate(own), [len(h) for h in own])
    for window in (1, 2, 4):
        pairs = neural.SkipgramPairs(histories, window)
        got, want = pairs.of(pairs.numbers().astype(np.int64)), neural.skipgram_pairs(own, window)
        assert all((g == w).all() and len(g) == len(w) for g, w in zip(got, want, strict=True))


def test_steps_touch_the_rows_of_a_batch():
    rng = np.random.default_rng(4)
    start, g = rng.normal(size=(50, 3)), rng.normal(size=(4, 3))
    rows = np.array([3, 9, 20, 49])
    whole, part = ({"w": Var(start.copy())} for _ in range(2))
    a, b = Optimiser(whole, "adagrad", 0.1), Optimiser(part, "adagrad", 0.1)
    for _ in range(3):
        whole["w"].grad = np.zeros((50, 3))
        whole["w"].grad[rows] = g
        a.step()
        b.step_rows({"w": (rows, g)})
    assert (whole["w"].data == part["w"].data).all()
    with pytest.raises(ValueError):
        Optimiser(part, "adam").step_rows({"w": (rows, g)})
    known = np.array([2, 5, 7])
    assert samplers.found(np.array([[1, 2], [7, 8]]), known).tolist() == [[False, True], [True, False]]
    assert not samplers.found(np.array([1]), known[:0]).any()


def test_dense_scores_are_dealt_out_by_cells(spark, monkeypatch):
    monkeypatch.setattr(base, "CELLS", 40)
    rng = np.random.default_rng(6)
    users, items = rng.normal(size=(30, 3)), rng.normal(size=(8, 3))
    made = [factor.as_factors(spark, np.arange(len(v)), v) for v in (users, items)]
    monkeypatch.setattr(base, "parts_for", lambda cells, each=40, f=base.parts_for: f(cells, each))
    got = base.scores_of(*made, 1 << 20)
    assert got.rdd.getNumPartitions() == 6
    assert all(r["score"] == pytest.approx(users[r["uid"]] @ items[r["iid"]]) for r in got.collect()) and got.count() == 240


@pytest.mark.parametrize("decay", [None, 0.01, 2.0])
@pytest.mark.parametrize("share", [0.03, 0.5])
def test_nearest_rows_against_brute_force(spark, monkeypatch, decay, share):
    """Blocks of both kinds of columns, ties, rows of one time, rows without a common column."""
    for name, n in {"LEFT_ROWS": 7, "RIGHT_ROWS": 11, "DENSE_COLUMNS": 5, "RIGHT_BLOCKS": 2, "TILE_ROWS": 4}.items():
        monkeypatch.setattr(algebra, name, n)
    rng = np.random.default_rng(8)
    made = []
    for first, n in ((0, 40), (20, 60)):
        rows = {first + r: {int(c): float(rng.integers(1, 4)) for c in np.flatnonzero(rng.random(30) < share)} for r in range(n)}
        rows[first + 1], rows[first + 2] = rows[first].copy(), rows[first].copy()
        made.append({u: (own, float(u % 13) * 10) for u, own in rows.items()})
    left, right = made
    frames = [spark.createDataFrame([(u, c, w, t) for u, (own, t) in side.items() for c, w in own.items()], "id bigint, i bigint, w double, t double") for side in made]
    got = {(r["u"], r["v"]): r["sim"] for r in algebra.nearest_rows(*frames, 4, decay).collect()}
    want = {}
    for u, (own, t) in left.items():
        sims = [(sum(w * other[c] for c, w in own.items() if c in other) * (1 if decay is None else np.exp(decay * (s - t))), v) for v, (other, s) in right.items() if u != v and (decay is None or s != t)]
        for sim, v in sorted(((round(x, 9), v) for x, v in sims if x), reverse=True)[:4]:
            want[u, v] = sim
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x], rel=1e-9, abs=1e-9) for x in want)
    assert algebra.nearest_rows(frames[0].limit(0), frames[1], 4).count() == 0


@pytest.mark.parametrize("name", ["r_kunn", "r_stan"])
def test_user_neighbours_join_no_pairs_of_users(spark, tmp_path, name):
    """No step makes a row for each two users of an item: 600 users of one item would be 360,000."""
    rows = [(k, f"2024-01-{1 + k % 28:02d} 00:00:{k % 60:02d}", k % 600, "view", 1.0, '{"k": %d}' % (0 if k < 600 else k % 7)) for k in range(1200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props")
    df.write.parquet(f"{tmp_path}/events.parquet")
    out = catalogue.QUERIES[name](spark, str(tmp_path))
    out.collect()
    most, left = 0, [out._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        for kind in ("numOutputRows",):
            m = node.metrics().get(kind)
            most = max(most, m.get().value() if m.isDefined() else 0)
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            left.append(node.plan())
        left += [node.children().apply(k) for k in range(node.children().size())]
    assert 0 < most < 100_000


def test_pairs_of_things_are_dealt_out_by_their_number(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cells = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 400), rng.integers(0, 200, 400), strict=True)})
    df = spark.createDataFrame(cells, "uid bigint, iid bigint")
    own = {}
    for u, i in cells:
        own.setdefault(u, set()).add(i)
    want = {}
    for items in own.values():
        for i in items:
            for j in items - {i}:
                want[i, j] = want.get((i, j), 0) + 1
    for limit in (100, 1 << 40):
        monkeypatch.setattr(algebra, "PAIRS", limit)
        got = algebra.symmetric_counts(df)
        assert {(r["i"], r["j"]): r["n"] for r in got.collect()} == want
        if limit == 100:
            assert got.rdd.getNumPartitions() >= sum(want.values()) // 2 // limit > 4
    assert algebra.symmetric_counts(df.limit(0)).count() == 0


def test_random_ranks_a_bounded_number_of_cells(spark, monkeypatch):
    from toplane.operators.models import baseline

    x = spark.createDataFrame([(u, i) for u in range(60) for i in range(u % 3, 20, 3)], "uid bigint, iid bigint").selectExpr("uid", "iid", "1 as value")
    monkeypatch.setattr(baseline, "parts_for", lambda cells, each=100: base.parts_for(cells, each))
    got = baseline.Random(K=5, seed=1).fit(x).predict(x)
    assert got.rdd.getNumPartitions() == 12
    best = {}
    for u in range(60):
        draws = sorted((((u * 1009 + i * 9176 + u * i * 31) % 1000003 * 7919 + 104729) % 1000003, i) for i in range(20))
        best[u] = {i for _, i in draws[-5:]}
    rows = got.collect()
    assert len(rows) == 300 and all(r["iid"] in best[r["uid"]] for r in rows)


def test_least_squares_start_no_frame_for_each_key(spark, monkeypatch):
    """Systems are summed from parts and batches, and equal the plain ones."""
    rng = np.random.default_rng(10)
    cells = [(u, i, float(rng.integers(1, 4))) for u in range(12) for i in range(30) if u == 0 or rng.random() < 0.3]
    x = spark.createDataFrame(cells, "uid bigint, iid bigint, c double")
    vectors = rng.normal(size=(30, 3))
    monkeypatch.setattr(factor, "PART", 7)
    model = factor.WeightedMatrixFactorization(num_components=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # keys are cut by batches
    try:
        solved = model._solve(x, "uid", "iid", factor.as_factors(spark, np.arange(30), vectors))
        assert "FlatMapGroupsInPandas" not in solved._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: r["vec"] for r in solved.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 12
    for u in range(12):
        own = [(i, c) for v, i, c in cells if v == u]
        y, c = vectors[[i for i, _ in own]], np.array([c for _, c in own])
        want = np.linalg.solve(vectors.T @ vectors + y.T @ (y * c[:, None]) + 0.01 * np.eye(3), y.T @ (1 + c))
        assert np.allclose(got[u], want)
