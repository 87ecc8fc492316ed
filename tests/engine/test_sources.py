"""Sources, saved models, samplers and ids of any size."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from toplane.functions.samplers import PositiveNegativeSampler
from toplane.operators.interactions import Interactions
from toplane.operators.models import neural
from toplane.operators.splits import StrongGeneralizationSplitter
from toplane.sources import datasets

SHOP = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n2020-01-01 00:00:00 UTC,view,1,2,,,1.5,7,s\n2020-01-01 00:00:10 UTC,cart,3,2,,,1.5,7,s\n2020-01-02 00:00:00 UTC,view,3,2,a.b,x,1.5,8,t\n"
CLICKS = "user_id,session_id,session_start,session_size,click_article_id,click_timestamp,click_environment,click_deviceGroup,click_os,click_country,click_region,click_referrer_type\n1,1,1000,2,5,2500,4,1,17,1,20,2\n2,1,1000,2,6,3500,4,1,17,1,20,2\n"
NEWS = '{"userId": "u", "id": "a", "time": 5}\n{"userId": "u", "time": 6}\n{"userId": "v", "id": "b", "time": 7, "x": 1}\n'


def tarred(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, raw in members:
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in members:
            z.writestr(name, raw)
    return out.getvalue()


def rows(df):
    return sorted(map(tuple, df.collect()))


def source(spark, folder, kind, name, **kw):
    return datasets.DATASETS[kind](spark, str(folder), name, use_default_filters=False, **kw)


def test_archives_hold_what_folders_hold(spark, tmp_path):
    (tmp_path / "shop.zip").write_bytes(zipped([("a/2020-Jan.csv", SHOP)]))
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "x.csv").write_text(SHOP)
    found = [rows(source(spark, tmp_path, "CosmeticsShop", n).read()) for n in ("shop.zip", "shop")]
    assert found[0] == found[1] == [(7, 1, 1577836800), (8, 3, 1577923200)]
    (tmp_path / "globo.zip").write_bytes(zipped([("clicks/clicks_hour_000.csv", CLICKS), ("articles.csv", "a,b\n1,2\n")]))
    (tmp_path / "globo").mkdir()
    (tmp_path / "globo" / "clicks_hour_000.csv").write_text(CLICKS)
    found = [rows(source(spark, tmp_path, "Globo", n).read()) for n in ("globo.zip", "globo")]
    assert found[0] == found[1] == [(1, 5, 2.5), (2, 6, 3.5)]
    (tmp_path / "week.tar.gz").write_bytes(tarred([("one_week/20170101", NEWS.encode())], "w:gz"))
    (tmp_path / "week").mkdir()
    (tmp_path / "week" / "20170101").write_text(NEWS)
    found = [rows(source(spark, tmp_path, "AdressaOneWeek", n).read()) for n in ("week.tar.gz", "week")]
    assert found[0] == found[1] == [("u", "a", 5), ("v", "b", 7)]
    inner = tarred([(f"training_set/mv_000000{k}.txt", f"{k}:\n11,4,2005-09-06\n12,3,2005-09-07\n".encode()) for k in (1, 2)])
    (tmp_path / "nf.tar.gz").write_bytes(tarred([("download/training_set.tar", inner), ("download/README", b"x")], "w:gz"))
    assert rows(source(spark, tmp_path, "Netflix", "nf.tar.gz").read()) == [("11", "1", 1125964800, 4.0), ("11", "2", 1125964800, 4.0), ("12", "1", 1126051200, 3.0), ("12", "2", 1126051200, 3.0)]


def test_long_members_come_in_parts(spark, tmp_path, monkeypatch):
    (tmp_path / "a.zip").write_bytes(zipped([("x.txt", "".join(f"{i}\n" for i in range(130_000)))]))
    df = datasets.archive_members(spark, str(tmp_path / "a.zip"))
    assert df.agg(F.count("line"), F.max("number"), F.sum(F.col("line").cast("bigint"))).first() == (130_000, 129_999, sum(range(130_000)))


def test_files_of_ratings(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t10\t5\t100\n1\t11\t3\t101\n2\t10\t4\t102\n")
    assert source(spark, tmp_path, "MovieLens100K", "u.data").load().num_interactions == 3
    (tmp_path / "users.dat").write_text("2 5 6\n0\n1 7\n")
    assert rows(source(spark, tmp_path, "CiteULike", "users.dat").read()) == [(0, 5), (0, 6), (2, 7)]
    with pytest.raises(FileNotFoundError):
        source(spark, tmp_path, "RetailRocket", "none.csv").load()


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(4)
    return Interactions(spark.createDataFrame([(int(u), int(i), float(t)) for t, (u, i) in enumerate(zip(rng.integers(0, 20, 200), rng.integers(0, 12, 200), strict=True))], "u bigint, i bigint, t double"), "i", "u", "t")


@pytest.mark.parametrize("make", [lambda: neural.BPRMF(num_components=4, max_epochs=1), lambda: neural.Prod2Vec(num_components=4, max_epochs=1, K=3), lambda: neural.MultVAE(dim_bottleneck_layer=4, dim_hidden_layer=6, max_epochs=1), lambda: neural.GRU4RecCrossEntropy(hidden_size=4, num_components=4, max_epochs=1)])
def test_loaded_models_predict_the_same(events, tmp_path, make):
    model = make().fit(events, (events, events))
    model.save(str(tmp_path / "m.npz"))
    again = make().load(str(tmp_path / "m.npz"))
    round_ = lambda df: sorted((r["uid"], r["iid"], round(r["score"], 9)) for r in df.collect())
    found = round_(model.predict(events))
    assert found and found == round_(again.predict(events))


def test_the_best_are_no_more_than_asked_for():
    assert neural.best_of(np.array([[1.0, 2, 2, 2], [0, 3, 1, 1]]), 2).tolist() == [[0, 0, 2, 2], [0, 3, 0, 1]]


def test_exact_negatives_of_users_who_know_nearly_all():
    users, items = np.repeat(np.arange(3), 49), np.tile(np.arange(49), 3)
    for distribution in ("uniform", "unigram"):
        s = PositiveNegativeSampler(num_negatives=2, exact=True, distribution=distribution)
        if distribution == "unigram":
            with pytest.raises(ValueError, match="no item left"):  # the only other item was never seen
                list(s.sample(users, items, 50))
        else:
            assert all((n == 49).all() for _, _, n in s.sample(users, items, 50))


def test_ids_of_any_size_are_split(spark):
    big = 2**60
    data = Interactions(spark.createDataFrame([(big + u, big + i) for u in range(10) for i in range(3)], "u bigint, i bigint"), "i", "u")
    a, b = StrongGeneralizationSplitter(0.5, error_margin=1.0).split(data)
    assert a.num_interactions + b.num_interactions == 30
