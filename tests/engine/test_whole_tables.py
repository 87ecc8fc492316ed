"""Queries over all rows, and what the trained models draw from."""

from collections import Counter

import numpy as np
import pytest

from toplane.functions import samplers
from toplane.operators.models import neural
from toplane.plans import algebra, catalogue


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(11)
    made = rng.normal(size=(400, 8))
    made[50:90] = made[7]
    made[90:95] = -made[7]
    made[200] = 0
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(2000)[:400], made, strict=True)]
    return rows, spark.createDataFrame([*rows, (5000, None)], "vec_id bigint, embedding array<float>")


def nearest(rows, k):
    out = {}
    unit = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items() if v @ v}
    for i, u in unit.items():
        all_of_it = [(round(float(u @ v), 9), j) for j, v in unit.items() if j != i]
        for sim, j in sorted((x for x in all_of_it if x[0]), reverse=True)[:k]:
            out[i, j] = sim
    return out


@pytest.mark.parametrize("limit", [1 << 25, 64 * 37])
def test_nearest_vectors_against_brute_force(vectors, limit):
    rows, df = vectors
    got = {(r["i"], r["j"]): r["sim"] for r in algebra.nearest_vectors(df, 5, limit).collect()}
    want = nearest(rows, 5)
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x], abs=1e-8) for x in want)
    assert algebra.nearest_vectors(df.limit(0), 5).count() == 0


def test_emb_cosine_topk_searches_all(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert len(rows) > 300
    got = {(r["i"], r["j"]) for r in catalogue.QUERIES["emb_cosine_topk"](spark, sf_dir).collect()}
    assert got == set(nearest(rows, 5))


def by_sql(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for name in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("name", ["r_kunn", "r_stan"])
def test_user_models_predict_for_all(spark, sf_dir, name):
    got = {(r["uid"], r["iid"]): r["score"] for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    want = {(u, i): x for u, i, x in by_sql(sf_dir, catalogue.ORACLES[name])}
    # cells at the bound of 1e-6 may be on either side
    assert all(abs((got | want)[x]) < 2e-6 for x in set(got) ^ set(want))
    assert all(got[x] == pytest.approx(want[x], abs=2e-6) for x in set(got) & set(want))
    assert len({u % 15 for u, _ in got}) == 15


def test_samples_follow_the_library(spark, sf_dir):
    """The queries' pairs, targets and shares are those that the trained models draw from."""
    events = catalogue.im(catalogue.clicks(spark, sf_dir))
    users, histories = neural.read_histories(events)
    focus, context = neural.skipgram_pairs(histories, 2)
    pairs = {(r["focus"], r["context"]): r["n"] for r in catalogue.QUERIES["s_skipgram_pairs"](spark, sf_dir).collect()}
    assert pairs == Counter(zip(focus.tolist(), context.tolist(), strict=True))
    targets = sorted(tuple(r) for r in catalogue.QUERIES["s_seq_targets"](spark, sf_dir).select("uid", "item", "target").collect())
    drawn = []
    for u, x, y, _ in samplers.SequencePositivesTargetsNegatives(1, pad=10**6).sample(users, histories):
        r, c = np.nonzero(y < 10**6)
        drawn += zip(u[r].tolist(), x[r, c].tolist(), y[r, c].tolist(), strict=True)
    assert targets == sorted(drawn)
    items = np.concatenate(histories)
    p = samplers.unigram_distribution(np.bincount(items))
    assert all(r["p"] == pytest.approx(p[r["iid"]], abs=1e-6) for r in catalogue.QUERIES["s_unigram_dist"](spark, sf_dir).collect())


def test_clusters_rows_and_samples(spark):
    from toplane.functions import samplers
    from toplane.plans import algebra

    rows = [(1, [1.0, 0.0], 7), (2, [0.0, 2.0], 9), (3, [3.0, 1.0], 7), (4, None, 9), (5, [0.0, 0.0], None), (None, [1.0, 1.0], 9)]
    vectors = spark.createDataFrame(rows, "i bigint, v array<double>, label int")
    centres = algebra.mean_vectors(vectors.select("label", "v"))
    assert {r["id"]: r["vec"] for r in centres.collect()} == {7: [2.0, 0.5], 9: [0.5, 1.5]}
    assert {(r["i"], r["j"]) for r in algebra.assigned_clusters(vectors.select("i", "v"), centres).collect()} == {(1, 7), (2, 9), (3, 7)}
    assert algebra.assigned_clusters(vectors.select("i", "v").limit(0), centres).collect() == []

    cells = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0)], "uid int, iid int, value double")
    assert sorted(map(tuple, algebra.row_set_nonzero(cells, 1, 9.0).collect())) == [(1, 1, 9.0), (1, 2, 9.0), (2, 1, 4.0)]
    assert sorted(map(tuple, algebra.row_set_nonzero(cells, 1).collect())) == [(2, 1, 4.0)]

    events = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (1, 5, 3.0), (2, 6, 1.0)], "uid int, iid int, ts double")
    assert sorted(map(tuple, samplers.next_items(events).collect())) == [(1, 5, 6, 1), (1, 6, 5, 2)]
    assert sorted(map(tuple, samplers.skipgram_counts(events, 2).collect())) == [(5, 6, 2), (6, 5, 2)]
    assert {r["iid"]: round(r["p"], 9) for r in samplers.unigram_probabilities(events).collect()} == {5: 0.5, 6: 0.5}
