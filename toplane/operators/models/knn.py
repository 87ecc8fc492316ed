"""Nearest neighbours of items, and of items and users together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toplane.operators.interactions import ITEM, USER, Interactions, to_matrix
from toplane.operators.models.base import Algorithm, TopKSimilarityModel
from toplane.plans.algebra import added, applied, cooccurrences, nearest_rows, normalised, norms, ranked, scaled, symmetric_counts, top_k_neighbours


def cosine(matrix: DataFrame, key: str = USER, thing: str = ITEM) -> DataFrame:
    """(i, j, sim): the things' cosines, without the diagonal.  Values are scaled first, so that one join sums them up."""
    return cooccurrences(normalised(matrix, thing, "l2"), key, thing)


def binary_cosine(pairs: DataFrame) -> DataFrame:
    """Cosines of 0/1 columns, from counts."""
    counts = pairs.groupBy(ITEM).agg(F.count(F.lit(1)).alias("c"))
    n = symmetric_counts(pairs).withColumn("sim", F.col("n").cast("double"))
    roots = counts.select(ITEM, F.sqrt("c").alias("r"))
    return scaled(scaled(n, roots, "i", ITEM, "r", "sim"), roots, "j", ITEM, "r", "sim").select("i", "j", "sim")


def conditional_probability(matrix: DataFrame, pop_discount: float = 0.0) -> DataFrame:
    """(i, j, sim): the sum over users of i of their value of j, by the users of i and by those of j to the power of pop_discount."""
    counts = matrix.groupBy(ITEM).agg(F.count(F.lit(1)).alias("c"))
    sim = cooccurrences(matrix, USER, ITEM, value=F.col("value_b").cast("double"))
    sim = scaled(sim, counts, "i", ITEM, "c", "sim")
    if pop_discount:
        sim = scaled(sim, counts.select(ITEM, F.pow("c", F.lit(float(pop_discount))).alias("d")), "j", ITEM, "d", "sim")
    return sim.select("i", "j", "sim")


def pearson(matrix: DataFrame) -> DataFrame:
    """Cosines after each item's mean over its users was taken off.  Values that are all 1 have no correlation: an error."""
    if not matrix.filter("value <> 1").head(1):
        raise ValueError("Pearson correlation needs values other than 0 and 1")
    mean = F.avg("value").over(Window.partitionBy(ITEM))
    return cosine(matrix.withColumn("value", F.col("value") - mean).filter("value <> 0"))


def _discount(pop_discount: float | None) -> float:
    pop_discount = pop_discount or 0.0
    if not 0 <= pop_discount <= 1:
        raise ValueError("pop_discount must lie between 0 and 1")
    return pop_discount


class ItemKNN(TopKSimilarityModel):
    """The K nearest items of each item, by cosine or conditional probability."""

    SIMILARITIES = ("cosine", "conditional_probability")

    def __init__(self, K: int = 200, similarity: str = "cosine", pop_discount: float | None = None, normalize_X: bool = False, normalize_sim: bool = False) -> None:
        super().__init__(K)
        if similarity not in self.SIMILARITIES:
            raise ValueError(f"similarity must be one of {self.SIMILARITIES}")
        if pop_discount and similarity == "cosine":
            raise ValueError("pop_discount goes with conditional probability only")
        self.similarity, self.pop_discount, self.normalize_X, self.normalize_sim = similarity, _discount(pop_discount), normalize_X, normalize_sim

    def _similarities(self, x: DataFrame) -> DataFrame:
        if self.normalize_X:
            x = normalised(x, USER)
        if self.similarity == "conditional_probability":
            return conditional_probability(x, self.pop_discount)
        return cosine(x) if self.normalize_X else binary_cosine(x)

    def _fit(self, x) -> None:
        sim = top_k_neighbours(self._similarities(x), self.K)
        if self.normalize_sim:
            sim = normalised(sim, "i", value="sim")
        self.similarity_ = sim.persist()


class ItemPNN(ItemKNN):
    """As ItemKNN, with neighbours drawn without replacement by a distribution over the similarities."""

    PDFS = ("empirical", "uniform", "softmax_empirical")

    def __init__(self, K: int = 200, similarity: str = "cosine", pop_discount: float | None = None, normalize_X: bool = False, normalize_sim: bool = False, pdf: str = "empirical", seed: int = 42) -> None:
        super().__init__(K, similarity, pop_discount, normalize_X, normalize_sim)
        if pdf not in self.PDFS:
            raise ValueError(f"pdf must be one of {self.PDFS}")
        self.pdf, self.seed = pdf, seed

    def probabilities(self, sim: DataFrame, items: DataFrame) -> DataFrame:
        """(i, j, sim, p) over the cells that may be drawn.

        The uniform and softmax distributions also weigh cells of similarity 0;
        such a draw adds no neighbour, so those cells stay implicit: their
        number counts in the sums.
        """
        n = items.count()
        each = Window.partitionBy("i")
        if self.pdf == "empirical":
            return sim.withColumn("p", F.col("sim") / F.sum("sim").over(each))
        if self.pdf == "uniform":
            return sim.withColumn("p", F.lit(1.0 / n))
        total = F.sum(F.exp("sim")).over(each) + (F.lit(n) - F.count(F.lit(1)).over(each))
        return sim.withColumn("p", F.exp("sim") / total)

    def _fit(self, x) -> None:
        sim, items = self._similarities(x), x.select(ITEM).distinct()
        p = self.probabilities(sim, items)
        # Gumbel keys: the K + 1 largest of log p + noise are a draw without replacement
        u = (F.pmod(F.xxhash64("i", "j", F.lit(self.seed)), F.lit(2**31 - 1)) + 1) / F.lit(float(2**31))
        keyed = p.withColumn("key", F.log("p") - F.log(-F.log(u)))
        drawn = ranked(keyed, "i", "j", "key", self.K)
        if self.pdf != "empirical":
            # the cells of similarity 0 take their share of the K draws
            n = items.count()
            rest = (F.lit(n) - F.count(F.lit(1)).over(Window.partitionBy("i"))) / F.lit(float(n))
            places = keyed.withColumn("places", F.ceil(F.lit(self.K) * (F.lit(1.0) - rest)))
            drawn = ranked(places, "i", "j", "key").filter(F.col("rank") <= F.least("places", F.lit(self.K)))
        sim = drawn.select("i", "j", "sim")
        if self.normalize_sim:
            sim = normalised(sim, "i", value="sim")
        self.similarity_ = sim.persist()


class KUNN(Algorithm):
    """Users' and items' neighbours in one score."""

    def __init__(self, Ku: int = 100, Ki: int = 100) -> None:
        self.Ku, self.Ki = Ku, Ki

    def _input(self, x: Interactions | DataFrame) -> DataFrame:
        return to_matrix(x, binary=True).select(USER, ITEM)

    def _fit(self, x) -> None:
        self.train_ = x.persist()
        per_user = x.groupBy(USER).agg(F.count(F.lit(1)).alias("cu"))
        per_item = x.groupBy(ITEM).agg(F.count(F.lit(1)).alias("ci"))
        self.item_counts_ = per_item
        rows = x.join(per_user, USER).join(per_item, ITEM)
        sim = cooccurrences(rows.select(USER, ITEM, "cu", "ci"), USER, ITEM, value=F.lit(1.0) / (F.sqrt("cu_a") * F.sqrt("ci_a") * F.sqrt("ci_b")), columns=("cu", "ci"))
        top = top_k_neighbours(sim, self.Ki)
        #: (j, i, sim): each item's neighbours point at it
        self.knn_ = top.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim").persist()

    def user_similarities(self, x: DataFrame) -> DataFrame:
        """(u, v, sim): the Ku nearest training users of each user to predict for."""
        both = self.train_.union(x).distinct()
        mixed = both.groupBy(USER).agg(F.count(F.lit(1)).alias("cm"))
        train_users = self.train_.groupBy(USER).agg(F.count(F.lit(1)).alias("cv"))
        only = x.join(self.train_, [USER, ITEM], "left_anti").select(USER, F.col(ITEM).alias("__i"), F.lit(1).alias("extra"))
        mine = x.join(mixed, USER).join(self.item_counts_, ITEM, "left").join(only.withColumnRenamed("__i", ITEM), [USER, ITEM], "left")
        weight = F.sqrt(F.coalesce("ci", F.lit(0)) + F.coalesce("extra", F.lit(0)))
        mine = mine.select(F.col(USER).alias("u"), ITEM, F.col("cm"), weight.alias("w"))
        theirs = self.train_.join(train_users, USER).select(F.col(USER).alias("id"), F.col(ITEM).alias("i"), (1 / F.sqrt("cv")).alias("w"), F.lit(0.0).alias("t"))
        # items that nobody was trained on are common to none
        mine = mine.filter("w > 0").select(F.col("u").alias("id"), F.col(ITEM).alias("i"), (1 / (F.sqrt("cm") * F.col("w"))).alias("w"), F.lit(0.0).alias("t"))
        return nearest_rows(mine, theirs, self.Ku)

    def _predict(self, x) -> DataFrame:
        near = self.user_similarities(x)
        per_item = self.item_counts_.select(ITEM, F.sqrt("ci").alias("r"))
        # a neighbour's items travel as one row, and are opened where the user's sums are
        own = self.train_.groupBy(F.col(USER).alias("v")).agg(F.collect_list(ITEM).alias("items"))
        opened = near.join(own, "v").repartition("u").select(F.col("u").alias(USER), F.explode("items").alias(ITEM), "sim")
        by_users = opened.groupBy(USER, ITEM).agg(F.sum("sim").alias("score"))
        by_users = scaled(by_users, per_item, ITEM, ITEM, "r", "score").select(USER, ITEM, "score")
        both = self.train_.join(x.select(USER).distinct(), USER, "left_semi").union(x).distinct()
        mixed = both.groupBy(USER).agg(F.count(F.lit(1)).alias("cm"))
        history = both.join(mixed, USER).select(USER, ITEM, (1 / F.sqrt("cm")).alias("value"))
        return added(by_users, applied(history, self.knn_)).filter("score <> 0")


__all__ = ["KUNN", "ItemKNN", "ItemPNN", "binary_cosine", "conditional_probability", "cosine", "norms", "pearson"]
