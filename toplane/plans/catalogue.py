"""Queries over the driver's tables, one for each operator, with the SQL that says the same.

`clicks` are the events (user, item from props.k, time), `purchases` the lines
of orders.  Floats are rounded to six digits on both sides, and rankings go by
scores rounded to nine, so that the order of sums can't change a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.functions import metrics as M
from toplane.functions import samplers
from toplane.operators import encode, filters, postprocess, scenarios, splits
from toplane.operators.interactions import Interactions
from toplane.operators.models import baseline, factor, knn, linear, neural, sequential, timeaware
from toplane.plans import algebra
from toplane.plans.pipeline import PipelineBuilder

#: 2024-01-24 and 2024-01-17, in seconds.
T, T_VALIDATION = 1706054400.0, 1705449600.0
DAY = 86400.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))").cast("double") / F.lit(1e6)


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("eid"), F.col("user_id").alias("uid"), F.get_json_object("props", "$.k").cast("bigint").alias("iid"), seconds("ts").alias("ts"), "event_type", "value")


def purchases(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return both.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("eid"), F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("iid"), seconds("o_orderdate").alias("ts"))


def im(df: DataFrame) -> Interactions:
    return Interactions(df, "iid", "uid", "ts", interaction_ix="eid")


CTES = {
    "clicks": "SELECT event_id AS eid, user_id AS uid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS iid, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS ts, event_type, value FROM events",
    "purchases": "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS eid, o_custkey AS uid, l_partkey AS iid, CAST(epoch_us(o_orderdate) AS DOUBLE) / 1e6 AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "b": "SELECT DISTINCT uid, iid FROM clicks",
    "lt": "SELECT uid, iid, max(ts) AS ts FROM clicks GROUP BY uid, iid",
    "ci": "SELECT iid, CAST(count(*) AS DOUBLE) AS c FROM b GROUP BY iid",
    "co": "SELECT x.iid AS i, y.iid AS j, CAST(count(*) AS DOUBLE) AS n FROM b x JOIN b y ON x.uid = y.uid AND x.iid <> y.iid GROUP BY x.iid, y.iid",
    # the flagship: deduplicated clicks, split in time
    "dd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, iid ORDER BY ts, eid) AS n FROM clicks) WHERE n = 1",
    "tr": f"SELECT uid, iid, ts, eid FROM dd WHERE ts < {T}",
    "te": f"SELECT uid, iid, ts, eid FROM dd WHERE ts >= {T}",
    "us": "SELECT DISTINCT uid FROM tr WHERE uid IN (SELECT uid FROM te)",
    "hist": "SELECT DISTINCT uid, iid FROM tr WHERE uid IN (SELECT uid FROM us)",
    "truth": "SELECT DISTINCT uid, iid FROM te WHERE uid IN (SELECT uid FROM us)",
    "trc": "SELECT iid, CAST(count(DISTINCT uid) AS DOUBLE) AS c FROM tr GROUP BY iid",
    "trco": "SELECT x.iid AS i, y.iid AS j, CAST(count(*) AS DOUBLE) AS n FROM tr x JOIN tr y ON x.uid = y.uid AND x.iid <> y.iid GROUP BY x.iid, y.iid",
    "sim": "SELECT i, j, s FROM (SELECT i, j, n / sqrt(a.c) / sqrt(e.c) AS s, row_number() OVER (PARTITION BY i ORDER BY round(n / sqrt(a.c) / sqrt(e.c), 9) DESC, j DESC) AS k FROM trco JOIN trc a ON a.iid = i JOIN trc e ON e.iid = j) WHERE k <= 20",
    "sc": "SELECT uid, j AS iid, sum(s) AS score FROM hist JOIN sim ON hist.iid = sim.i GROUP BY uid, j",
    "rec": "SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.uid = sc.uid AND h.iid = sc.iid)",
    "rkall": "SELECT uid, iid, score, row_number() OVER (PARTITION BY uid ORDER BY round(score, 9) DESC, iid DESC) AS rank FROM rec",
    "rk": "SELECT * FROM rkall WHERE rank <= 10",
    "hit": "SELECT t.uid, t.iid, r.rank FROM truth t JOIN rk r ON t.uid = r.uid AND t.iid = r.iid",
    "per": "SELECT t.uid, t.n, coalesce(h.h, 0) AS h, coalesce(h.d, 0.0) AS d, h.f FROM (SELECT uid, count(*) AS n FROM truth GROUP BY uid) t LEFT JOIN (SELECT uid, count(*) AS h, sum(1.0 / log2(CAST(rank AS DOUBLE) + 1)) AS d, min(rank) AS f FROM hit GROUP BY uid) h ON t.uid = h.uid",
}
NEEDS = {k: [x for x in CTES if x != k and __import__("re").search(rf"\b(FROM|JOIN) {x}\b", v)] for k, v in CTES.items()}


def sql(body: str, **more: str) -> str:
    """The body after the common tables that it uses, and tables of its own."""
    import re

    used: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS[name]:
            need(x)
        if name not in used:
            used.append(name)

    text = body + " " + " ".join(more.values())
    for name in CTES:
        if re.search(rf"\b(FROM|JOIN) {name}\b", text):
            need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in used] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(name: str, oracle: str | None = None, **more: str):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle, **more)
        return f

    return put


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


# ---- data model


@query("im_counts", "SELECT uid, iid, CAST(count(*) AS BIGINT) AS value FROM clicks GROUP BY uid, iid")
def _(s, d):
    return im(clicks(s, d)).values


@query("im_binary", "SELECT uid, iid, 1 AS value FROM b")
def _(s, d):
    return im(clicks(s, d)).binary_values


@query("im_last_ts", f"SELECT uid, iid, {R('ts')} AS value FROM lt")
def _(s, d):
    return im(clicks(s, d)).last_timestamps.select("uid", "iid", r6("value").alias("value"))


@query("im_ts_range", f"SELECT eid AS interactionid, uid, iid, {R('ts')} AS ts FROM clicks WHERE ts > {T_VALIDATION} AND ts >= {T_VALIDATION + 60} AND ts < {T} AND ts <= {T - 60}")
def _(s, d):
    x = im(clicks(s, d)).timestamps_gt(T_VALIDATION).timestamps_gte(T_VALIDATION + 60).timestamps_lt(T).timestamps_lte(T - 60)
    return x.df.withColumn("ts", r6("ts"))


@query("im_users_in", "SELECT eid AS interactionid, uid, iid FROM clicks WHERE uid IN (1, 3, 5, 8, 13)")
def _(s, d):
    return im(clicks(s, d)).users_in([1, 3, 5, 8, 13]).df.drop("ts")


@query("im_items_in", "SELECT eid AS interactionid, uid, iid FROM clicks WHERE iid IN (SELECT iid FROM clicks WHERE value > 300)")
def _(s, d):
    x = clicks(s, d)
    return im(x).items_in(x.filter("value > 300").select("iid")).df.drop("ts")


@query("im_indices_in", "SELECT eid AS interactionid, c.uid, c.iid FROM clicks c JOIN (SELECT uid, iid FROM clicks GROUP BY uid, iid HAVING count(*) >= 3) p ON c.uid = p.uid AND c.iid = p.iid")
def _(s, d):
    x = im(clicks(s, d))
    return x.indices_in(x.values.filter("value >= 3"), check=False).df.drop("ts")


@query("im_union", "SELECT uid, iid, CAST(count(*) AS BIGINT) AS value, CAST(max(k) AS BIGINT) AS last_side FROM (SELECT uid, iid, 0 AS k FROM tr UNION ALL SELECT uid, iid, 1 AS k FROM te) GROUP BY uid, iid")
def _(s, d):
    a, b = _split(s, d)
    shape = im(clicks(s, d)).shape
    a._shape = b._shape = shape
    both = a.union(b)
    return both.df.groupBy("uid", "iid").agg(F.count(F.lit(1)).alias("value"), big(F.max((F.col("ts") >= T).cast("int"))).alias("last_side"))


@query("im_density", f"SELECT {R('CAST((SELECT count(*) FROM b) AS DOUBLE) / ((SELECT max(uid) + 1 FROM b) * (SELECT max(iid) + 1 FROM b))')} AS density")
def _(s, d):
    x = im(clicks(s, d))
    return s.createDataFrame([(x.density,)], "density double").select(r6("density").alias("density"))


@query("im_sorted_history", "SELECT uid, string_agg(CAST(iid AS VARCHAR), ',' ORDER BY ts, eid) AS items FROM clicks GROUP BY uid")
def _(s, d):
    h = im(clicks(s, d)).sorted_item_history()
    return h.select("uid", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("im_active", "SELECT CAST(count(DISTINCT uid) AS BIGINT) AS num_active_users, CAST(count(DISTINCT iid) AS BIGINT) AS num_active_items, CAST(count(*) AS BIGINT) AS num_interactions FROM clicks")
def _(s, d):
    return im(clicks(s, d)).df.agg(F.countDistinct("uid").alias("num_active_users"), F.countDistinct("iid").alias("num_active_items"), F.count(F.lit(1)).alias("num_interactions"))


# ---- filters

_P = "SELECT eid, uid, iid FROM purchases WHERE "


def _filter(name: str, make: Callable[[], filters.Filter], condition: str, source=purchases, base: str = _P):
    @query(name, base + condition)
    def _(s, d):
        return make().apply(source(s, d).select("eid", "uid", "iid", "ts")).select("eid", "uid", "iid")


_filter("f_min_users_per_item", lambda: filters.MinUsersPerItem(31, "iid", "uid"), "iid IN (SELECT iid FROM purchases GROUP BY iid HAVING count(DISTINCT uid) >= 31)")
_filter("f_min_users_dups", lambda: filters.MinUsersPerItem(31, "iid", "uid", count_duplicates=True), "iid IN (SELECT iid FROM purchases GROUP BY iid HAVING count(*) >= 31)")
_filter("f_min_items_per_user", lambda: filters.MinItemsPerUser(40, "iid", "uid"), "uid IN (SELECT uid FROM purchases GROUP BY uid HAVING count(DISTINCT iid) >= 40)")
_filter("f_max_items_per_user", lambda: filters.MaxItemsPerUser(40, "iid", "uid"), "uid IN (SELECT uid FROM purchases GROUP BY uid HAVING count(DISTINCT iid) <= 40)")
_filter("f_n_most_popular", lambda: filters.NMostPopular(50, "iid"), "iid IN (SELECT iid FROM purchases GROUP BY iid ORDER BY count(*) DESC, iid LIMIT 50)")
_filter("f_n_most_recent", lambda: filters.NMostRecent(50, "iid", "ts"), "iid IN (SELECT iid FROM purchases GROUP BY iid ORDER BY max(ts) DESC, iid LIMIT 50)")


@query("f_min_rating", "SELECT eid, uid, iid FROM clicks WHERE value >= 100")
def _(s, d):
    return filters.MinRating(100, "value").apply(clicks(s, d).select("eid", "uid", "iid", "value"))


@query("f_deduplicate", "SELECT eid, uid, iid FROM dd")
def _(s, d):
    return filters.Deduplicate("iid", "uid", "ts", ["eid"]).apply(clicks(s, d)).select("eid", "uid", "iid")


@query(
    "f_chain",
    "SELECT eid, uid, iid FROM f2 WHERE uid IN (SELECT uid FROM f2 GROUP BY uid HAVING count(DISTINCT iid) >= 30)",
    f1="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, iid ORDER BY ts, eid) AS n FROM purchases) WHERE n = 1",
    f2="SELECT * FROM f1 WHERE iid IN (SELECT iid FROM f1 GROUP BY iid HAVING count(DISTINCT uid) >= 28)",
)
def _(s, d):
    x = purchases(s, d)
    for f in (filters.Deduplicate("iid", "uid", "ts", ["eid"]), filters.MinUsersPerItem(28, "iid", "uid"), filters.MinItemsPerUser(30, "iid", "uid")):
        x = f.apply(x)
    return x.select("eid", "uid", "iid")


# ---- encoding and sessions


@query("p_encode_value", "SELECT o_custkey AS raw, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS ix FROM (SELECT DISTINCT o_custkey FROM orders)")
def _(s, d):
    return encode.encode_ids([read(s, d, "orders")], "o_custkey")


@query("p_encode_first_seen", "SELECT iid AS raw, CAST(row_number() OVER (ORDER BY t, e, iid) - 1 AS BIGINT) AS ix FROM (SELECT iid, min(ts) AS t, arg_min(eid, (ts, eid)) AS e FROM clicks GROUP BY iid)")
def _(s, d):
    return encode.encode_ids([clicks(s, d)], "iid", first_seen=["ts", "eid"])


_SESSIONS = "SELECT eid, uid, ts, CAST(sum(new) OVER (PARTITION BY uid ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM clicks WINDOW w AS (PARTITION BY uid ORDER BY ts, eid))"


@query("p_sessionize", "SELECT eid, uid, session_seq FROM ss", ss=_SESSIONS)
def _(s, d):
    return encode.sessions(clicks(s, d), "uid", "ts", 21600, ["eid"]).select("eid", "uid", "session_seq")


@query("p_session_stats", f"SELECT uid, session_seq, CAST(count(*) AS BIGINT) AS n, {R('max(ts) - min(ts)')} AS seconds FROM ss GROUP BY uid, session_seq", ss=_SESSIONS)
def _(s, d):
    x = encode.sessions(clicks(s, d), "uid", "ts", 21600, ["eid"])
    return x.groupBy("uid", "session_seq").agg(F.count(F.lit(1)).alias("n"), r6(F.max("ts") - F.min("ts")).alias("seconds"))


# ---- splits and scenarios


def _sides(**parts: Interactions | None) -> DataFrame:
    out = None
    for name, x in parts.items():
        rows = x.df.select(F.lit(name).alias("part"), F.col("interactionid"), "uid", "iid")
        out = rows if out is None else out.unionByName(rows)
    return out


def _split_query(name: str, splitter: Callable[[], splits.Splitter], inside: str, outside: str, **more: str) -> None:
    row = "SELECT '{}' AS part, eid AS interactionid, uid, iid FROM {}"

    @query(name, row.format("in", inside) + " UNION ALL " + row.format("out", outside), **more)
    def _(s, d):
        a, b = splitter().split(im(clicks(s, d)))
        return _sides(**{"in": a, "out": b})


def _hash(c: str, seed: int) -> str:
    return f"(({c} * 7919 + {seed * 104729}) % 1000003)"


_split_query("x_timestamp", lambda: splits.TimestampSplitter(T), f"clicks WHERE ts < {T}", f"clicks WHERE ts >= {T}")
_split_query("x_timestamp_windowed", lambda: splits.TimestampSplitter(T, 2 * DAY, 7 * DAY), f"clicks WHERE ts < {T} AND ts >= {T - 7 * DAY}", f"clicks WHERE ts >= {T} AND ts < {T + 2 * DAY}")
_LATE = T + 6.5 * DAY
_split_query("x_user_time", lambda: splits.UserInteractionTimeSplitter(_LATE), "clicks WHERE uid IN (SELECT uid FROM e)", "clicks WHERE uid NOT IN (SELECT uid FROM e)", e=f"SELECT uid FROM clicks GROUP BY uid HAVING max(ts) < {_LATE}")
_split_query("x_most_recent", lambda: splits.MostRecentSplitter(3), "m WHERE n > 3", "m WHERE n <= 3", m="SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, eid DESC) AS n FROM clicks")
_split_query("x_most_recent_negative", lambda: splits.MostRecentSplitter(-20), "m WHERE n <= 20", "m WHERE n > 20", m="SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, eid) AS n FROM clicks")
_FRACTION = f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_hash('eid', 42)}, eid) <= ceil(count(*) OVER (PARTITION BY uid) * CAST(0.7 AS DOUBLE)) AS inside FROM clicks"
_split_query("x_fraction_hash", lambda: splits.FractionInteractionSplitter(0.7, 42), "m WHERE inside", "m WHERE NOT inside", m=_FRACTION)
_STRONG = f"SELECT uid FROM (SELECT uid, row_number() OVER (ORDER BY {_hash('uid', 42)}, uid) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT uid FROM clicks)) WHERE n <= floor(total * CAST(0.7 AS DOUBLE))"
_split_query("x_strong_hash", lambda: splits.StrongGeneralizationSplitter(0.7, 42, error_margin=1.0), "clicks WHERE uid IN (SELECT uid FROM g)", "clicks WHERE uid NOT IN (SELECT uid FROM g)", g=_STRONG)
_split_query("x_users", lambda: splits.UserSplitter([1, 2, 3, 5, 8], [13, 21, 34]), "clicks WHERE uid IN (1, 2, 3, 5, 8)", "clicks WHERE uid IN (13, 21, 34)")


def _scenario_query(name: str, make: Callable[[], scenarios.Scenario], train: str, inside: str, outside: str, **more: str) -> None:
    """Training rows, and test rows of users with both."""
    body = f"SELECT 'train' AS part, eid AS interactionid, uid, iid FROM ({train}) UNION ALL SELECT 'in', eid, uid, iid FROM ti WHERE uid IN (SELECT uid FROM tout) UNION ALL SELECT 'out', eid, uid, iid FROM tout WHERE uid IN (SELECT uid FROM ti)"

    @query(name, body, **more, ti=inside, tout=outside)
    def _(s, d):
        x = make()
        x.split(im(clicks(s, d)))
        a, b = x.test_data
        return _sides(**{"train": x.full_training_data, "in": a, "out": b})


def _frac(source: str, f: float) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_hash('eid', 42)}, eid) <= ceil(count(*) OVER (PARTITION BY uid) * CAST({f} AS DOUBLE)) AS inside FROM {source}"


def _users(f: float) -> str:
    return _STRONG.replace("0.7", str(f))


_scenario_query("c_weak", lambda: scenarios.WeakGeneralization(0.8), "SELECT * FROM m WHERE inside", "SELECT * FROM m WHERE inside", "SELECT * FROM m WHERE NOT inside", m=_frac("clicks", 0.8))


class _Strong(scenarios.StrongGeneralization):
    """One draw of users, whatever its share of pairs, so that SQL can follow it."""

    def __init__(self, *a, **kw) -> None:
        super().__init__(*a, **kw)
        self.users.error_margin = 1.0


class _StrongTimed(scenarios.StrongGeneralizationTimed):
    def __init__(self, *a, **kw) -> None:
        super().__init__(*a, **kw)
        self.users.error_margin = 1.0


_scenario_query("c_strong", lambda: _Strong(0.7, 0.8), "SELECT * FROM clicks WHERE uid IN (SELECT uid FROM g)", "SELECT * FROM m WHERE inside", "SELECT * FROM m WHERE NOT inside", g=_users(0.7), o="SELECT * FROM clicks WHERE uid NOT IN (SELECT uid FROM g)", m=_frac("o", 0.8))
_scenario_query("c_timed", lambda: scenarios.Timed(T), f"SELECT * FROM clicks WHERE ts < {T}", f"SELECT * FROM clicks WHERE ts < {T}", f"SELECT * FROM clicks WHERE ts >= {T}")
_scenario_query("c_strong_timed", lambda: _StrongTimed(0.7, T), f"SELECT * FROM clicks WHERE uid IN (SELECT uid FROM g) AND ts < {T}", f"SELECT * FROM o WHERE ts < {T}", f"SELECT * FROM o WHERE ts >= {T}", g=_users(0.7), o="SELECT * FROM clicks WHERE uid NOT IN (SELECT uid FROM g)")
_scenario_query("c_strong_timed_recent", lambda: scenarios.StrongGeneralizationTimedMostRecent(_LATE, n_most_recent_out=2), "SELECT * FROM clicks WHERE uid IN (SELECT uid FROM e)", "SELECT * FROM m WHERE n > 2", "SELECT * FROM m WHERE n <= 2", e=f"SELECT uid FROM clicks GROUP BY uid HAVING max(ts) < {_LATE}", m="SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, eid DESC) AS n FROM clicks WHERE uid NOT IN (SELECT uid FROM e)")
_scenario_query("c_last_item", lambda: scenarios.LastItemPrediction(5), "SELECT * FROM m WHERE n > 1", "SELECT * FROM m WHERE n BETWEEN 2 AND 6", "SELECT * FROM m WHERE n = 1", m="SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, eid DESC) AS n FROM clicks")
_scenario_query("c_timed_last_item", lambda: scenarios.TimedLastItemPrediction(T, n_most_recent_in=5, delta_out=2 * DAY), f"SELECT * FROM clicks WHERE ts < {T}", "SELECT * FROM m WHERE n BETWEEN 2 AND 6", "SELECT * FROM m WHERE n = 1", m=f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, eid DESC) AS n FROM clicks WHERE ts < {T + 2 * DAY} AND uid IN (SELECT uid FROM clicks WHERE ts >= {T} AND ts < {T + 2 * DAY})")


# ---- the flagship and its stages


def _split(s, d) -> tuple[Interactions, Interactions]:
    x = filters.Deduplicate("iid", "uid", "ts", ["eid"]).apply(clicks(s, d))
    return splits.TimestampSplitter(T).split(im(x))


def _test(s, d) -> tuple[Interactions, Interactions, Interactions]:
    """Training data, and the test pair of users with both."""
    train, out = _split(s, d)
    return (train, *scenarios.matched((train, out)))


def _recommended(s, d) -> tuple[DataFrame, DataFrame, Interactions]:
    """Scores without history, held-out pairs, training data."""
    train, given, out = _test(s, d)
    scores = knn.ItemKNN(K=20).fit(train).predict(given)
    return postprocess.without_history(scores, given.df), out.indices, train


@query("t_topk_ranks", "SELECT uid, iid, CAST(rank AS BIGINT) AS rank FROM rk")
def _(s, d):
    scores, _, _ = _recommended(s, d)
    return algebra.top_k_ranks(scores, 10).withColumn("rank", big("rank"))


@query("t_topk_values", f"SELECT uid, iid, {R('score')} AS score FROM rk")
def _(s, d):
    scores, _, _ = _recommended(s, d)
    return algebra.top_k_values(scores, 10).withColumn("score", r6("score"))


@query("j_cooccur", "SELECT i, j, CAST(n AS BIGINT) AS n FROM co")
def _(s, d):
    return algebra.symmetric_counts(im(clicks(s, d)).indices)


@query("j_cooccur_purchases", "SELECT x.iid AS i, y.iid AS j, CAST(count(*) AS BIGINT) AS n FROM p x JOIN p y ON x.uid = y.uid AND x.iid <> y.iid GROUP BY x.iid, y.iid HAVING count(*) >= 4", p="SELECT DISTINCT uid, iid FROM purchases")
def _(s, d):
    return algebra.symmetric_counts(im(purchases(s, d)).indices).filter("n >= 4")


@query("a_row_l1", f"SELECT uid, iid, {R('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY uid)')} AS value FROM clicks GROUP BY uid, iid")
def _(s, d):
    return algebra.normalised(im(clicks(s, d)).values, "uid").withColumn("value", r6("value"))


@query("j_apply_similarity", f"SELECT uid, iid, {R('score')} AS score FROM sc")
def _(s, d):
    train, given, _ = _test(s, d)
    return knn.ItemKNN(K=20).fit(train).predict(given).withColumn("score", r6("score"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """NDCG@10 of each user: item neighbours of the clicks before T, against those after."""
    scores, truth, _ = _recommended(s, d)
    users = M.per_user(truth, algebra.top_k_ranks(scores, 10), [10])
    return users.select("uid", r6(M.LISTWISE["NDCGK"](10)).alias("ndcg_10"))


_IDEAL = "list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda k: 1.0 / log2(CAST(k AS DOUBLE) + 1)))"
query("flagship", f"SELECT uid, {R(f'd / {_IDEAL}')} AS ndcg_10 FROM per")(flagship)


# ---- models: similarities and scores

_KEEP = "SELECT i, j, s FROM (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j DESC) AS k FROM {} WHERE s <> 0) WHERE k <= {}"


def _similarities(name: str, make: Callable[[], object], raw: str, k: int = 20, source: Callable = clicks, **more: str) -> None:
    @query(name, f"SELECT i, j, {R('s')} AS sim FROM top", **more, raw=raw, top=_KEEP.format("raw", k))
    def _(s, d):
        return make().fit(im(source(s, d))).similarity_.withColumn("sim", r6("sim"))


@query("r_popularity", f"SELECT u.uid, t.iid, {R('t.c / (SELECT max(c) FROM ci)')} AS score FROM (SELECT DISTINCT uid FROM clicks) u CROSS JOIN (SELECT * FROM ci ORDER BY c DESC, iid DESC LIMIT 20) t")
def _(s, d):
    x = im(clicks(s, d))
    return baseline.Popularity(K=20).fit(x).predict(x).withColumn("score", r6("score"))


@query("r_random_hash", f"SELECT uid, iid, {R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(score, 9) DESC, iid DESC) AS k FROM d) WHERE k <= 10", d="SELECT uid, iid, (((uid * 1009 + iid * 9176 + uid * iid * 31) * 7919 + 42 * 104729) % 1000003 + 1) / CAST(1000004 AS DOUBLE) AS score FROM (SELECT DISTINCT uid FROM clicks) CROSS JOIN (SELECT DISTINCT iid FROM clicks)")
def _(s, d):
    x = im(clicks(s, d))
    return baseline.Random(K=10).fit(x).predict(x).withColumn("score", r6("score"))


_similarities("r_itemknn_cosine", lambda: knn.ItemKNN(K=20), "SELECT i, j, n / sqrt(a.c) / sqrt(e.c) AS s FROM co JOIN ci a ON a.iid = i JOIN ci e ON e.iid = j")
_similarities("r_itemknn_condprob", lambda: knn.ItemKNN(K=20, similarity="conditional_probability"), "SELECT i, j, n / a.c AS s FROM co JOIN ci a ON a.iid = i")
_similarities("r_itemknn_popdiscount", lambda: knn.ItemKNN(K=20, similarity="conditional_probability", pop_discount=0.5), "SELECT i, j, n / a.c / pow(e.c, 0.5) AS s FROM co JOIN ci a ON a.iid = i JOIN ci e ON e.iid = j")
_WCOS = "SELECT x.iid AS i, y.iid AS j, sum(x.v * y.v) AS s FROM w x JOIN w y ON x.uid = y.uid AND x.iid <> y.iid GROUP BY x.iid, y.iid"


def _unit(v: str) -> str:
    return f"SELECT uid, iid, v / sqrt(sum(v * v) OVER (PARTITION BY iid)) AS v FROM {v}"


_similarities("r_itemknn_normx", lambda: knn.ItemKNN(K=20, normalize_X=True), _WCOS, v="SELECT uid, iid, 1.0 / count(*) OVER (PARTITION BY uid) AS v FROM b", w=_unit("v"))


@query("r_itemknn_normsim", f"SELECT i, j, {R('s / sum(s) OVER (PARTITION BY i)')} AS sim FROM top", raw="SELECT i, j, n / sqrt(a.c) / sqrt(e.c) AS s FROM co JOIN ci a ON a.iid = i JOIN ci e ON e.iid = j", top=_KEEP.format("raw", 20))
def _(s, d):
    return knn.ItemKNN(K=20, normalize_sim=True).fit(im(clicks(s, d))).similarity_.withColumn("sim", r6("sim"))


@query("r_pearson", f"SELECT i, j, {R('s')} AS sim FROM raw WHERE abs(s) >= 1e-6", v="SELECT uid, iid, v FROM (SELECT uid, iid, count(*) - avg(count(*)) OVER (PARTITION BY iid) AS v FROM clicks GROUP BY uid, iid) WHERE v <> 0", w=_unit("v"), raw=_WCOS)
def _(s, d):
    return knn.pearson(im(clicks(s, d)).values).filter("abs(sim) >= 1e-6").withColumn("sim", r6("sim"))


@query("r_itempnn_pdf", f"SELECT i, j, {R('s / sum(s) OVER (PARTITION BY i)')} AS p FROM raw", raw="SELECT i, j, n / sqrt(a.c) / sqrt(e.c) AS s FROM co JOIN ci a ON a.iid = i JOIN ci e ON e.iid = j")
def _(s, d):
    x = im(clicks(s, d)).binary_values
    model = knn.ItemPNN(K=20)
    return model.probabilities(model._similarities(x), x.select("iid").distinct()).select("i", "j", r6("p").alias("p"))


@query("r_itempnn")
def _(s, d):
    return knn.ItemPNN(K=20).fit(im(clicks(s, d))).similarity_.withColumn("sim", r6("sim"))


@query(
    "r_kunn",
    f"SELECT uid, iid, {R('sum(score)')} AS score FROM (SELECT * FROM bu UNION ALL SELECT * FROM bi) GROUP BY uid, iid HAVING abs(sum(score)) >= 1e-6",
    p="SELECT DISTINCT uid, iid FROM clicks",
    t=f"SELECT DISTINCT uid, iid FROM clicks WHERE ts < {T}",
    x="SELECT * FROM p",
    cu="SELECT uid, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY uid",
    cit="SELECT iid, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY iid",
    raw="SELECT y.iid AS i, z.iid AS j, sum(1.0 / (sqrt(cu.c) * sqrt(a.c) * sqrt(e.c))) AS s FROM t y JOIN t z ON y.uid = z.uid AND y.iid <> z.iid JOIN cu ON cu.uid = y.uid JOIN cit a ON a.iid = y.iid JOIN cit e ON e.iid = z.iid GROUP BY y.iid, z.iid",
    top=_KEEP.format("raw", 20),
    m="SELECT uid, iid FROM t UNION SELECT uid, iid FROM x",
    cm="SELECT uid, CAST(count(*) AS DOUBLE) AS c FROM m GROUP BY uid",
    us0="SELECT x.uid AS u, t.uid AS v, sum(1.0 / (sqrt(cm.c) * sqrt(cu.c) * sqrt(coalesce(cit.c, 0) + CASE WHEN o.uid IS NULL THEN 1 ELSE 0 END))) AS s FROM x JOIN t ON x.iid = t.iid AND x.uid <> t.uid JOIN cm ON cm.uid = x.uid JOIN cu ON cu.uid = t.uid LEFT JOIN cit ON cit.iid = x.iid LEFT JOIN t o ON o.uid = x.uid AND o.iid = x.iid GROUP BY x.uid, t.uid",
    un="SELECT u, v, s FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(s, 9) DESC, v DESC) AS k FROM us0) WHERE k <= 20",
    bu="SELECT u AS uid, t.iid, sum(s) / max(sqrt(cit.c)) AS score FROM un JOIN t ON t.uid = un.v JOIN cit ON cit.iid = t.iid GROUP BY u, t.iid",
    bi="SELECT m.uid, top.i AS iid, sum(top.s / sqrt(cm.c)) AS score FROM m JOIN cm ON cm.uid = m.uid JOIN top ON top.j = m.iid WHERE m.uid IN (SELECT uid FROM x) GROUP BY m.uid, top.i",
)
def _(s, d):
    x = clicks(s, d)
    model = knn.KUNN(Ku=20, Ki=20).fit(im(x.filter(F.col("ts") < T)))
    return model.predict(im(x)).filter("abs(score) >= 1e-6").withColumn("score", r6("score"))


_similarities(
    "r_seqrules",
    lambda: sequential.SequentialRules(K=20, max_steps=5),
    "SELECT x.iid AS i, y.iid AS j, sum(1.0 / (y.n - x.n)) / max(ci.c) AS s FROM q x JOIN q y ON x.uid = y.uid AND y.n BETWEEN x.n + 1 AND x.n + 5 AND x.iid <> y.iid JOIN ci ON ci.iid = x.iid GROUP BY x.iid, y.iid",
    q="SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY ts, eid) AS n FROM clicks",
)

_AGE = f"SELECT uid, iid, ((SELECT max(ts) + 1 FROM lt) - ts) / {DAY} AS x, ((SELECT max(ts) + 1 FROM lt) - (SELECT min(ts) FROM lt)) / {DAY} AS n FROM lt"


def _tars(name: str, decay: float, rule: str) -> None:
    _similarities(f"r_tars_{name}", lambda: timeaware.TARSItemKNN(K=20, fit_decay=decay, predict_decay=decay, decay_interval=int(DAY), decay_function={"exp": "exponential"}.get(name, name)), _WCOS, age=_AGE, v=f"SELECT uid, iid, {rule} AS v FROM age WHERE {rule} <> 0", w=_unit("v"))


_tars("exp", 0.1, "exp(-0.1 * x)")
_tars("log", 2.0, "ln(1.0 * (1.0 - x / n) + 1.0) / ln(2.0)")
_tars("linear", 0.5, "greatest(1.0 - 0.5 * x / n, 0.0)")
_tars("concave", 0.5, "(1.0 - pow(0.5, 1.0 - x / n))")
_tars("convex", 0.9, "pow(0.9, x)")
_tars("inverse", 1.0, "(CASE WHEN x = 0 THEN 1.0 ELSE 1.0 / x END)")


@query("r_ding", f"SELECT uid, j AS iid, {R('sum(v * s)')} AS score FROM pr JOIN top ON pr.iid = top.i GROUP BY uid, j", raw="SELECT i, j, n / sqrt(a.c) / sqrt(e.c) AS s FROM co JOIN ci a ON a.iid = i JOIN ci e ON e.iid = j", top=_KEEP.format("raw", 20), pr=f"SELECT uid, iid, exp(-CAST({1 / DAY!r} AS DOUBLE) * ((SELECT max(ts) + 1 FROM lt) - ts)) AS v FROM lt")
def _(s, d):
    x = im(clicks(s, d))
    return timeaware.TARSItemKNNDing(K=20).fit(x).predict(x).withColumn("score", r6("score"))


_similarities("r_liu2010", lambda: timeaware.TARSItemKNNLiu(K=20, fit_decay=1e-6, predict_decay=1e-6), _WCOS, v="SELECT uid, iid, exp(-1e-6 * ((SELECT max(ts) + 1 FROM lt) - ts)) AS v FROM lt", w=_unit("v"))
_similarities("r_vaz", lambda: timeaware.TARSItemKNNVaz(K=20, fit_decay=1e-6, predict_decay=1e-6), _WCOS, v0="SELECT uid, iid, exp(-1e-6 * ((SELECT max(ts) + 1 FROM lt) - ts)) AS v FROM lt", v="SELECT uid, iid, v - avg(v) OVER (PARTITION BY iid) AS v FROM v0", w=_unit("v"))
_similarities("r_liu2012", lambda: timeaware.TARSItemKNNLiu2012(K=20, decay=2.0), _WCOS, ends="SELECT uid, min(ts) AS f, max(ts) AS l FROM clicks GROUP BY uid", v="SELECT lt.uid, iid, ln((ts - f) / l + 1) / ln(2.0) + 1 AS v FROM lt JOIN ends ON ends.uid = lt.uid", w=_unit("v"))


def _lee(w: int) -> None:
    table = timeaware.LAUNCH_WEIGHTS[w]

    def window(x: str, lo: str, hi: str) -> str:
        return "CASE " + " ".join(f"WHEN ceil({lo} + {k + 1} * (({hi} - {lo}) / {float(w)})) >= {x} THEN {k}" for k in range(w - 1)) + f" ELSE {w - 1} END"

    cells = "CASE " + " ".join(f"WHEN a = {r} AND e = {c} THEN {table[r][c]}" for r in range(w) for c in range(w)) + " END"
    _similarities(
        f"r_lee{w}",
        lambda: timeaware.TARSItemKNNLee(K=20, w=w),
        _WCOS,
        la="SELECT iid, min(ts) AS l FROM clicks GROUP BY iid",
        lm="SELECT CASE WHEN count(*) < max(iid) + 1 THEN least(min(l), 0.0) ELSE min(l) END AS l0, CASE WHEN count(*) < max(iid) + 1 THEN greatest(max(l), 0.0) ELSE max(l) END AS l1 FROM la",
        tm="SELECT min(ts) AS t0, max(ts) AS t1 FROM clicks",
        wi=f"SELECT uid, lt.iid, {window('l', 'l0', 'l1')} AS a, {window('ts', 't0', 't1')} AS e FROM lt JOIN la ON la.iid = lt.iid CROSS JOIN lm CROSS JOIN tm WHERE ts <> 0",
        v=f"SELECT uid, iid, CAST({cells} AS DOUBLE) AS v FROM wi",
        w=_unit("v"),
    )


_lee(3)
_lee(5)
_PAIR = "FROM lt x JOIN lt y ON x.uid = y.uid AND x.iid <> y.iid"
_similarities("r_cooc_dist", lambda: timeaware.TARSItemKNNCoocDistance(K=20, fit_decay=0.1, decay_interval=int(DAY)), f"SELECT x.iid AS i, y.iid AS j, sum(exp(-0.1 * (abs(x.ts - y.ts) / {DAY}))) AS s {_PAIR} AND x.ts <> y.ts GROUP BY x.iid, y.iid")
_similarities("r_cooc_condprob", lambda: timeaware.TARSItemKNNCoocDistance(K=20, fit_decay=0.1, decay_interval=int(DAY), similarity="conditional_probability"), f"SELECT x.iid AS i, y.iid AS j, sum(exp(-0.1 * (abs(x.ts - y.ts) / {DAY}))) / max(ci.c) AS s {_PAIR} AND x.ts <> y.ts JOIN ci ON ci.iid = x.iid GROUP BY x.iid, y.iid")
_similarities("r_xia", lambda: timeaware.TARSItemKNNXia(K=20, fit_decay=0.5, decay_function="concave"), f"SELECT x.iid AS i, y.iid AS j, sum(1.0 - pow(0.5, 1.0 - (abs(x.ts - y.ts) / {DAY}) / n)) AS s {_PAIR} AND x.ts <> y.ts CROSS JOIN nn GROUP BY x.iid, y.iid", nn=f"SELECT (max(ts) - min(ts)) / {DAY} AS n FROM lt")
_similarities("r_hermann", lambda: timeaware.TARSItemKNNHermann(K=20, decay_interval=3600), f"SELECT x.iid AS i, y.iid AS j, sum(CASE WHEN x.ts <> y.ts THEN 1.0 / (abs(x.ts / 3600.0 - y.ts / 3600.0) + now - least(x.ts / 3600.0, y.ts / 3600.0)) ELSE 0.0 END) / count(*) AS s {_PAIR} CROSS JOIN nw GROUP BY x.iid, y.iid", nw="SELECT (max(ts) + 1) / 3600.0 AS now FROM clicks")


@query(
    "r_stan",
    f"SELECT s AS uid, iid, {R('sum(sim * exp(-1.0 * abs(pos - mt)))')} AS score FROM near JOIN tp ON tp.uid = near.v AND pos <> mt GROUP BY s, iid HAVING abs(sum(sim * exp(-1.0 * abs(pos - mt)))) >= 1e-6",
    a=f"SELECT uid, iid, max(ts) AS ts FROM clicks WHERE ts < {T} GROUP BY uid, iid",
    q="SELECT uid, iid, max(ts) AS ts FROM clicks GROUP BY uid, iid",
    tp="SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY ts, iid) AS pos, count(*) OVER (PARTITION BY uid) AS n, max(ts) OVER (PARTITION BY uid) AS l FROM a",
    qp="SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, iid DESC) AS rev, count(*) OVER (PARTITION BY uid) AS n, max(ts) OVER (PARTITION BY uid) AS l FROM q",
    pr="SELECT qp.uid AS s, tp.uid AS v, sum(exp(-CAST(0.1 AS DOUBLE) * (rev - 1)) / sqrt(CAST(qp.n * tp.n AS DOUBLE))) * exp(1e-6 * (max(tp.l) - max(qp.l))) AS sim, max(pos) AS mt FROM qp JOIN tp ON qp.iid = tp.iid AND qp.uid <> tp.uid AND qp.l <> tp.l GROUP BY qp.uid, tp.uid",
    near="SELECT s, v, sim, mt FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(sim, 9) DESC, v DESC) AS k FROM pr) WHERE k <= 20",
)
def _(s, d):
    x = clicks(s, d)
    model = sequential.STAN(K=20, interaction_decay=0.1, session_decay=1e-6, distance_from_match_decay=1).fit(im(x.filter(F.col("ts") < T)))
    return model.predict(im(x)).filter("abs(score) >= 1e-6").withColumn("score", r6("score"))


@query("r_ease_gram", "SELECT i, j, CAST(n AS BIGINT) AS n FROM co UNION ALL SELECT iid, iid, CAST(c AS BIGINT) FROM ci")
def _(s, d):
    return linear.gram(im(clicks(s, d)).binary_values).withColumn("n", big("n"))


@query("r_damib_zero", f"SELECT uid, iid, {R('score')} AS score FROM sc")
def _(s, d):
    # with p = 0 the cover is the wrapped model
    train, given, _ = _test(s, d)
    return linear.DAMIBCover(knn.ItemKNN(K=20), p=0, agg="sum").fit(train).predict(given).withColumn("score", r6("score"))


def _model(name: str, make: Callable[[], object], validated: bool = False) -> None:
    @query(name)
    def _(s, d):
        train, given, out = _test(s, d)
        shape = im(clicks(s, d)).shape
        for x in (train, given, out):
            x._shape = shape
        model = make()
        fitted = model.fit(train, (given, out)) if validated else model.fit(train)
        return algebra.top_k_values(fitted.predict(given), 10).withColumn("score", r6("score"))


_model("r_ease", lambda: linear.EASE(l2=50))
_model("r_slim", lambda: linear.SLIM())


@query(
    "r_damib",
    f"SELECT uid, iid, {R('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(score, 9) DESC, iid DESC) AS k FROM m) WHERE k <= 10",
    a="SELECT uid, j AS iid, s, row_number() OVER (PARTITION BY uid, j ORDER BY s DESC) AS k FROM hist JOIN sim ON hist.iid = sim.i",
    t="SELECT uid, iid, k, sum(s) OVER (PARTITION BY uid, iid ORDER BY k) AS t FROM a",
    g="SELECT uid, iid, k, t / pow(k, 0.75) AS v, CASE WHEN k = 1 OR t / pow(k, 0.75) >= lag(t) OVER (PARTITION BY uid, iid ORDER BY k) / pow(k - 1, 0.75) THEN 0 ELSE 1 END AS falls FROM t",
    m="SELECT uid, iid, max_by(v, k) AS score FROM (SELECT *, sum(falls) OVER (PARTITION BY uid, iid ORDER BY k) AS fallen FROM g) WHERE fallen = 0 GROUP BY uid, iid",
)
def _(s, d):
    train, given, _ = _test(s, d)
    model = linear.DAMIBCover(knn.ItemKNN(K=20)).fit(train)
    return algebra.top_k_values(model.predict(given), 10).withColumn("score", r6("score"))


_model("r_nmf", lambda: factor.NMF(num_components=8, max_iter=5))
_model("r_svd", lambda: factor.SVD(num_components=8))
_model("r_nmf_i2i", lambda: factor.NMFItemToItem(num_components=8))
_model("r_svd_i2i", lambda: factor.SVDItemToItem(num_components=8))
_model("r_wmf", lambda: factor.WeightedMatrixFactorization(num_components=8, iterations=2))
_model("r_bprmf", lambda: neural.BPRMF(num_components=8, max_epochs=2), True)
_model("r_p2v", lambda: neural.Prod2Vec(num_components=8, max_epochs=1, K=20), True)
_model("r_p2v_clustered", lambda: neural.Prod2VecClustered(num_components=8, max_epochs=1, K=20), True)
_model("r_multvae", lambda: neural.MultVAE(dim_bottleneck_layer=8, dim_hidden_layer=16, max_epochs=2), True)
_model("r_recvae", lambda: neural.RecVAE(dim_bottleneck_layer=8, dim_hidden_layer=16, max_epochs=1), True)
_model("r_gru_ce", lambda: neural.GRU4RecCrossEntropy(hidden_size=8, num_components=8, max_epochs=1), True)
_model("r_gru_ns", lambda: neural.GRU4RecNegSampling(hidden_size=8, num_components=8, max_epochs=1, num_negatives=5), True)


@query("r_ease_xy")
def _(s, d):
    train, given, out = _test(s, d)
    return algebra.top_k_values(linear.EASE_XY(l2=50).fit(given, out).predict(given), 10).withColumn("score", r6("score"))


# ---- metrics

_LISTWISE = {
    "precision": ("PrecisionK", "h / 10.0"),
    "recall": ("RecallK", "h / CAST(n AS DOUBLE)"),
    "calibrated_recall": ("CalibratedRecallK", "h / CAST(least(n, 10) AS DOUBLE)"),
    "dcg": ("DCGK", "d"),
    "ndcg": ("NDCGK", f"d / {_IDEAL}"),
    "rr": ("ReciprocalRankK", "coalesce(1.0 / f, 0.0)"),
    "hit": ("HitK", "CAST(h AS DOUBLE)"),
    "discounted_gain": ("DiscountedGainK", "d"),
}


def _metric_query(name: str, cls: str, score: str) -> None:
    @query(f"e_{name}", f"SELECT {R(f'avg({score})')} AS value FROM per")
    def _(s, d):
        scores, truth, _ = _recommended(s, d)
        return M.evaluate(truth, scores, [(cls, 10)]).select(r6(f"{cls}_10").alias("value"))

    if name not in ("hit", "discounted_gain"):

        @query(f"e_{name}_results", f"SELECT uid AS user_id, {R(score)} AS score FROM per")
        def _(s, d):
            scores, truth, _ = _recommended(s, d)
            metric = M.METRICS[cls](10)
            metric.calculate(truth, scores)
            return metric.results.select("user_id", r6("score").alias("score"))


for _n, (_c, _s) in _LISTWISE.items():
    _metric_query(_n, _c, _s)


@query("e_all", "SELECT " + ", ".join(f"{R(f'avg({s})')} AS {n}" for n, (_, s) in _LISTWISE.items()) + " FROM per")
def _(s, d):
    scores, truth, _ = _recommended(s, d)
    return M.evaluate(truth, scores, [(c, 10) for c, _ in _LISTWISE.values()]).select(*(r6(f"{c}_10").alias(n) for n, (c, _) in _LISTWISE.items()))


_TRUTH_USERS = "rk WHERE uid IN (SELECT uid FROM truth)"


@query("e_hit_results", f"SELECT r.uid AS user_id, r.iid AS item_id, CASE WHEN t.uid IS NULL THEN 0.0 ELSE 1.0 END + CAST(0.0 AS DOUBLE) AS score FROM (SELECT * FROM {_TRUTH_USERS}) r LEFT JOIN truth t ON t.uid = r.uid AND t.iid = r.iid UNION ALL SELECT uid, NULL, CAST(0.0 AS DOUBLE) FROM (SELECT DISTINCT uid FROM truth WHERE uid NOT IN (SELECT uid FROM rk)) CROSS JOIN range(10)")
def _(s, d):
    scores, truth, _ = _recommended(s, d)
    metric = M.HitK(10)
    metric.calculate(truth, scores)
    return metric.results.withColumn("score", r6("score"))


@query("e_coverage", f"SELECT {R(f'(SELECT count(DISTINCT iid) FROM {_TRUTH_USERS}) / CAST((SELECT max(iid) + 1 FROM clicks) AS DOUBLE)')} AS score")
def _(s, d):
    scores, truth, _ = _recommended(s, d)
    metric = M.CoverageK(10)
    metric.calculate(truth, scores, im(clicks(s, d)).shape)
    return metric.results.select(r6("score").alias("score"))


@query("e_percentile", f"SELECT {R('avg(100 * CASE WHEN r.rank IS NOT NULL THEN (r.rank - 1) / n ELSE ((coalesce(m.deep, 1) - 1) / n + 1) / 2 END)')} AS score FROM truth t LEFT JOIN rkall r ON r.uid = t.uid AND r.iid = t.iid LEFT JOIN (SELECT uid, max(rank) AS deep FROM rkall GROUP BY uid) m ON m.uid = t.uid CROSS JOIN (SELECT CAST(max(iid) + 1 AS DOUBLE) AS n FROM clicks)")
def _(s, d):
    scores, truth, _ = _recommended(s, d)
    metric = M.PercentileRanking()
    metric.calculate(truth, scores, im(clicks(s, d)).shape)
    return metric.results.select(r6("score").alias("score"))


@query("e_ips", f"SELECT {R('avg(v)')} AS value FROM (SELECT p.uid, coalesce(sum(w), 0.0) AS v FROM per p LEFT JOIN (SELECT hit.uid, coalesce(wt.w, 0.0) AS w FROM hit LEFT JOIN wt ON wt.iid = hit.iid) h ON h.uid = p.uid GROUP BY p.uid)", wt="SELECT iid, least((SELECT count(*) FROM tr) / CAST(count(*) AS DOUBLE), 10000.0) AS w FROM tr GROUP BY iid")
def _(s, d):
    scores, truth, train = _recommended(s, d)
    metric = M.IPSHitRateK(10)
    metric.fit(train)
    metric.calculate(truth, scores)
    return s.createDataFrame([(float(metric.value),)], "value double").select(r6("value").alias("value"))


@query(
    "e_ild",
    f"SELECT t.uid AS user_id, {R('coalesce(avg(x.dist), 0.0)')} AS score FROM (SELECT DISTINCT uid FROM truth) t LEFT JOIN (SELECT a.uid, CASE WHEN coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(sh.n, 0) = 0 THEN 0.0 ELSE 1 - coalesce(sh.n, 0) / CAST(coalesce(sa.n, 0) + coalesce(sb.n, 0) - coalesce(sh.n, 0) AS DOUBLE) END AS dist FROM rk a JOIN rk e ON a.uid = e.uid AND a.iid < e.iid LEFT JOIN sz sa ON sa.iid = a.iid LEFT JOIN sz sb ON sb.iid = e.iid LEFT JOIN shr sh ON sh.i = a.iid AND sh.j = e.iid) x ON x.uid = t.uid GROUP BY t.uid",
    fe="SELECT DISTINCT iid, CAST(value AS BIGINT) % 7 AS fid FROM clicks WHERE event_type = 'purchase' AND value > 200",
    sz="SELECT iid, count(*) AS n FROM fe GROUP BY iid",
    shr="SELECT x.iid AS i, y.iid AS j, count(*) AS n FROM fe x JOIN fe y ON x.fid = y.fid GROUP BY x.iid, y.iid",
)
def _(s, d):
    scores, truth, _ = _recommended(s, d)
    metric = M.IntraListDiversityK(10)
    # DuckDB rounds on casts, as bround does for whole numbers
    metric.fit(clicks(s, d).filter("event_type = 'purchase' and value > 200").select("iid", (F.rint("value").cast("bigint") % 7).alias("fid")))
    metric.calculate(truth, scores)
    return metric.results.select("user_id", r6("score").alias("score"))


# ---- post-processing and pipelines


@query("o_exclude", f"SELECT uid, iid, {R('score')} AS score FROM sc WHERE iid NOT IN (1, 2, 3, 50)")
def _(s, d):
    train, given, _ = _test(s, d)
    return postprocess.ExcludeItems([1, 2, 3, 50]).apply(knn.ItemKNN(K=20).fit(train).predict(given)).withColumn("score", r6("score"))


@query("o_select", f"SELECT uid, iid, {R('score')} AS score FROM sc WHERE iid IN (1, 2, 3, 50)")
def _(s, d):
    train, given, _ = _test(s, d)
    return postprocess.SelectItems([1, 2, 3, 50]).apply(knn.ItemKNN(K=20).fit(train).predict(given)).withColumn("score", r6("score"))


@query("o_remove_history", f"SELECT uid, iid, {R('score')} AS score FROM rec")
def _(s, d):
    return _recommended(s, d)[0].withColumn("score", r6("score"))


def _pipeline(s, d, grid: bool) -> DataFrame:
    train, given, out = _test(s, d)
    shape = im(clicks(s, d)).shape
    for x in (train, given, out):
        x._shape = shape
    b = PipelineBuilder()
    b.set_full_training_data(train)
    b.set_test_data((given, out))
    b.add_metric("NDCGK", 10)
    b.add_metric("RecallK", 10)
    if grid:
        b.set_validation_training_data(train)
        b.set_validation_data((given, out))
        b.set_optimisation_metric("NDCGK", 10)
        b.add_algorithm("ItemKNN", grid={"K": [10, 20]})
    else:
        b.add_algorithm("ItemKNN", params={"K": 20})
        b.add_algorithm("Popularity", params={"K": 100})
    p = b.build()
    p.run()
    rows = p.optimisation_results if grid else p.get_metrics(short=True).reset_index(names="algorithm")
    if grid:
        return s.createDataFrame([(int(r["params"]["K"]), float(r["NDCGK_10"])) for _, r in rows.iterrows()], "k bigint, ndcg_10 double").select("k", r6("ndcg_10").alias("ndcg_10"))
    return s.createDataFrame([(r["algorithm"], float(r["NDCGK_10"]), float(r["RecallK_10"])) for _, r in rows.iterrows()], "algorithm string, n double, r double").select("algorithm", r6("n").alias("ndcg_10"), r6("r").alias("recall_10"))


_POP_RANK = "SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY round(c / m, 9) DESC, iid DESC) AS rank FROM us CROSS JOIN trc CROSS JOIN (SELECT max(c) AS m FROM trc) WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.uid = us.uid AND h.iid = trc.iid)"


@query(
    "l_pipeline",
    f"SELECT 'ItemKNN' AS algorithm, {R(f'avg(d / {_IDEAL})')} AS ndcg_10, {R('avg(h / CAST(n AS DOUBLE))')} AS recall_10 FROM per UNION ALL SELECT 'Popularity', {R(f'avg(d / {_IDEAL})')}, {R('avg(h / CAST(n AS DOUBLE))')} FROM pper",
    prk=_POP_RANK,
    phit="SELECT t.uid, r.rank FROM truth t JOIN prk r ON t.uid = r.uid AND t.iid = r.iid WHERE r.rank <= 10",
    pper="SELECT t.uid, t.n, coalesce(h.h, 0) AS h, coalesce(h.d, 0.0) AS d FROM (SELECT uid, count(*) AS n FROM truth GROUP BY uid) t LEFT JOIN (SELECT uid, count(*) AS h, sum(1.0 / log2(CAST(rank AS DOUBLE) + 1)) AS d FROM phit GROUP BY uid) h ON t.uid = h.uid",
)
def _(s, d):
    return _pipeline(s, d, grid=False)


def _at(k: int) -> dict[str, str]:
    """The flagship's tables under names with a k, for k neighbours."""
    import re

    names = ("sc", "rec", "rkall", "rk", "hit", "per")
    own = {f"{n}{k}": re.sub(rf"\b({'|'.join(names)}|sim)\b", rf"\g<1>{k}", CTES[n]) for n in names}
    return {f"sim{k}": f"SELECT i, j, s FROM (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j DESC) AS k FROM sim) WHERE k <= {k}"} | own


@query("l_grid", " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS k, {R(f'avg(d / {_IDEAL})')} AS ndcg_10 FROM per{k}" for k in (10, 20)), **_at(10), **_at(20))
def _(s, d):
    return _pipeline(s, d, grid=True)


# ---- vectors and samples


@query("emb_cosine_topk", f"SELECT i, j, {R('s')} AS sim FROM top", e="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", raw="SELECT x.vec_id AS i, y.vec_id AS j, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) AS s FROM e x JOIN e y ON x.vec_id <> y.vec_id", top=_KEEP.format("raw", 5))
def _(s, d):
    return algebra.nearest_vectors(read(s, d, "embeddings").select("vec_id", "embedding"), 5).withColumn("sim", r6("sim"))


@query(
    "emb_cluster_assign",
    f"SELECT i AS vec_id, j AS cluster, {R('s')} AS sim FROM top",
    e="SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    ce="SELECT label, list(m ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS p FROM e) GROUP BY label, p) GROUP BY label",
    raw="SELECT x.vec_id AS i, CAST(y.label AS BIGINT) AS j, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) AS s FROM e x CROSS JOIN ce y",
    top=_KEEP.format("raw", 1),
)
def _(s, d):
    x = read(s, d, "embeddings")
    found = algebra.assigned_clusters(x.select("vec_id", "embedding"), algebra.mean_vectors(x.select("label", "embedding")))
    return found.select(F.col("i").alias("vec_id"), F.col("j").alias("cluster"), r6("sim").alias("sim"))


@query("x_row_set", "SELECT uid, iid, CAST(CASE WHEN uid = 3 THEN 2.0 ELSE count(*) END AS DOUBLE) AS value FROM clicks WHERE uid <> 5 GROUP BY uid, iid")
def _(s, d):
    return algebra.row_set_nonzero(algebra.row_set_nonzero(im(clicks(s, d)).values, 5), 3, 2.0).select("uid", "iid", F.col("value").cast("double").alias("value"))


@query("s_unigram_dist", f"SELECT iid, {R('pow(CAST(count(*) AS DOUBLE), 0.75) / sum(pow(CAST(count(*) AS DOUBLE), 0.75)) OVER ()')} AS p FROM clicks GROUP BY iid")
def _(s, d):
    return samplers.unigram_probabilities(clicks(s, d)).withColumn("p", r6("p"))


_POS = "SELECT uid, iid, row_number() OVER (PARTITION BY uid ORDER BY ts, eid) AS n FROM clicks"


@query("s_skipgram_pairs", "SELECT x.iid AS focus, y.iid AS context, CAST(count(*) AS BIGINT) AS n FROM q x JOIN q y ON x.uid = y.uid AND abs(x.n - y.n) BETWEEN 1 AND 2 AND x.iid <> y.iid GROUP BY x.iid, y.iid", q=_POS)
def _(s, d):
    return samplers.skipgram_counts(clicks(s, d), 2, time=["ts", "eid"])


@query("s_seq_targets", "SELECT uid, x.iid AS item, y.iid AS target, CAST(x.n AS BIGINT) AS place FROM q x JOIN q y USING (uid) WHERE y.n = x.n + 1", q=_POS)
def _(s, d):
    return samplers.next_items(clicks(s, d), time=["ts", "eid"])
