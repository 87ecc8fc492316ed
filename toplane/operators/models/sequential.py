"""Models of order: sequential rules and session neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toplane.operators.interactions import EVENT, ITEM, TIME, USER, Interactions
from toplane.operators.models.base import Algorithm, Timed, TopKSimilarityModel, times_of
from toplane.plans.algebra import applied, nearest_rows


class SequentialRules(Timed, TopKSimilarityModel):
    """Items that follow within max_steps events, by 1 / steps and the number of users of the first; predicts from the last item."""

    binary = False

    def __init__(self, K: int = 200, max_steps: int = 10) -> None:
        super().__init__(K)
        self.max_steps = max_steps

    def rules(self, x: Interactions) -> DataFrame:
        """(i, j, sim) over whole histories, repeats included; each event looks ahead by windows, so no pairs of a history are joined."""
        order = Window.partitionBy(USER).orderBy(TIME, EVENT)
        ahead = F.array(*(F.struct(F.lit(s).alias("gap"), F.lead(ITEM, s).over(order).alias("j")) for s in range(1, self.max_steps + 1)))
        pairs = x.df.select(F.col(ITEM).alias("i"), ahead.alias("ahead")).select("i", F.explode("ahead").alias("next")).select("i", "next.*").filter("j is not null and i <> j")
        counts = x.df.groupBy(F.col(ITEM).alias("i")).agg(F.countDistinct(USER).alias("c"))
        return pairs.groupBy("i", "j").agg(F.sum(F.lit(1.0) / F.col("gap")).alias("sim")).join(counts, "i").select("i", "j", (F.col("sim") / F.col("c")).alias("sim"))

    def _fit(self, x) -> None:
        self._keep(self.rules(x))

    def _predict(self, x) -> DataFrame:
        last = x.df.groupBy(USER).agg(F.max_by(ITEM, F.struct(TIME, EVENT)).alias(ITEM)).withColumn("value", F.lit(1.0))
        return applied(last, self.similarity_)


class STAN(Timed, Algorithm):
    """Neighbouring sessions by recency of the items in common and of the sessions, and distance from the last match."""

    binary = False

    def __init__(self, K: int = 200, interaction_decay: float = 1 / 3600, session_decay: float = 1 / 3600, distance_from_match_decay: float = 1) -> None:
        self.K = K
        self.interaction_decay, self.session_decay, self.distance_from_match_decay = interaction_decay, session_decay, distance_from_match_decay

    @staticmethod
    def positions(x: Interactions) -> DataFrame:
        """(uid, iid, pos, rev, n, last): place of each distinct item from either end, the session's length and last time."""
        each = Window.partitionBy(USER)
        rows = times_of(x)
        return rows.select(USER, ITEM, F.row_number().over(each.orderBy(TIME, ITEM)).alias("pos"), F.row_number().over(each.orderBy(F.desc(TIME), F.desc(ITEM))).alias("rev"), F.count(F.lit(1)).over(each).alias("n"), F.max(TIME).over(each).alias("last"))

    def _fit(self, x) -> None:
        self.sessions_ = self.positions(x).persist()

    def neighbours(self, x: Interactions) -> DataFrame:
        """(s, v, sim, items, match): the K nearest training sessions, their items in order, and the place of the last common one.

        Sessions that end at the same time are no neighbours.
        """
        mine = self.positions(x)
        weighted = mine.select(F.col(USER).alias("id"), F.col(ITEM).alias("i"), (F.exp(-F.lit(float(self.interaction_decay)) * (F.col("rev") - 1)) / F.sqrt("n")).alias("w"), F.col("last").alias("t"))
        theirs = self.sessions_.select(F.col(USER).alias("id"), F.col(ITEM).alias("i"), (1 / F.sqrt("n")).alias("w"), F.col("last").alias("t"))
        near = nearest_rows(weighted.filter("w > 0"), theirs, self.K, float(self.session_decay)).select(F.col("u").alias("s"), "v", "sim")
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", ITEM))), lambda p: p[ITEM])
        sessions, given = self.sessions_.groupBy(F.col(USER).alias("v")).agg(in_order.alias("items")), mine.groupBy(F.col(USER).alias("s")).agg(F.collect_list(ITEM).alias("own"))
        # sessions travel as one row each, to where their neighbour's sums are
        both = near.join(sessions, "v").repartition("s").join(given, "s")
        last = F.element_at(F.array_intersect("items", "own"), -1)
        return both.select("s", "v", "sim", "items", F.array_position("items", last).alias("match"))

    def _predict(self, x) -> DataFrame:
        rows = self.neighbours(x).select(F.col("s").alias(USER), "sim", "match", F.posexplode("items").alias("pos", ITEM)).withColumn("pos", F.col("pos") + 1).filter("pos <> match")
        far = F.exp(-F.lit(float(self.distance_from_match_decay)) * F.abs(F.col("pos") - F.col("match")))
        return rows.groupBy(USER, ITEM).agg(F.sum(F.col("sim") * far).alias("score"))
