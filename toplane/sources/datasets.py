"""Public data sets of interactions, read lazily from files that lie at a path.

Nothing is downloaded.  Each source names its columns and default filters;
load() gives encoded interactions, read() the raw columns.
"""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.operators.encode import Preprocessor
from toplane.operators.filters import Filter, MinItemsPerUser, MinRating, MinUsersPerItem
from toplane.operators.interactions import Interactions


class Dataset(ABC):
    USER_IX = "user_id"
    ITEM_IX = "item_id"
    TIMESTAMP_IX: str | None = "timestamp"
    DEFAULT_FILENAME: str | None = None

    def __init__(self, spark: SparkSession, path: str = "data", filename: str | None = None, use_default_filters: bool = True) -> None:
        if not (filename or self.DEFAULT_FILENAME):
            raise ValueError(f"{type(self).__name__} has no default file name")
        self.spark, self.path, self.filename = spark, path, filename or self.DEFAULT_FILENAME
        self.preprocessor = Preprocessor(self.ITEM_IX, self.USER_IX, self.TIMESTAMP_IX)
        if use_default_filters:
            for f in self._default_filters():
                self.add_filter(f)

    @property
    def file_path(self) -> str:
        return os.path.join(self.path, self.filename)

    def _default_filters(self) -> list[Filter]:
        return []

    def add_filter(self, filter_: Filter, index: int | None = None) -> None:
        self.preprocessor.add_filter(filter_, index)

    def fetch_dataset(self, force: bool = False) -> None:
        """There is no network: the file must be there."""
        if "://" not in self.file_path and not os.path.exists(self.file_path):
            raise FileNotFoundError(f"{self.file_path} must be put there by hand")

    @abstractmethod
    def read(self) -> DataFrame:
        """The raw columns."""

    def load(self) -> Interactions:
        self.fetch_dataset()
        return self.preprocessor.process(self.read())

    # shorthands for default filters

    def _users(self, n: int, dup: bool = False) -> Filter:
        return MinUsersPerItem(n, self.ITEM_IX, self.USER_IX, count_duplicates=dup)

    def _items(self, n: int, dup: bool = False) -> Filter:
        return MinItemsPerUser(n, self.ITEM_IX, self.USER_IX, count_duplicates=dup)

    @property
    def archived(self) -> bool:
        return self.filename.endswith(ARCHIVES)

    def _archived_csv(self, schema: str, match: str = "") -> DataFrame:
        """The rows of the CSV files in an archive, each with a line of names first."""
        lines = archive_members(self.spark, self.file_path, match).filter("number > 0")
        return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")

    def _csv(self, schema: str, path: str | None = None, **options) -> DataFrame:
        return self.spark.read.csv(path or self.file_path, schema=schema, **options)


class DummyDataset(Dataset):
    """Uniform random events, from a seed."""

    DEFAULT_FILENAME = "dummy"

    def __init__(self, spark: SparkSession, path: str = "data", filename: str | None = None, use_default_filters: bool = True, seed: int = 42, num_users: int = 100, num_items: int = 20, num_interactions: int = 500, min_t: int = 0, max_t: int = 500) -> None:
        super().__init__(spark, path, filename, use_default_filters)
        self.seed, self.num_users, self.num_items, self.num_interactions, self.min_t, self.max_t = seed, num_users, num_items, num_interactions, min_t, max_t

    def _default_filters(self):
        return [self._users(2), self._items(2)]

    def fetch_dataset(self, force: bool = False) -> None:
        """Nothing to fetch."""

    def read(self) -> DataFrame:
        draw = lambda k, low, high: (F.pmod(F.xxhash64(F.col("id"), F.lit(self.seed), F.lit(k)), F.lit(high - low)) + low).cast("bigint")
        rows = self.spark.range(self.num_interactions)
        return rows.select(draw(0, 0, self.num_users).alias(self.USER_IX), draw(1, 0, self.num_items).alias(self.ITEM_IX), draw(2, self.min_t, self.max_t).alias(self.TIMESTAMP_IX))


class _MovieLens(Dataset):
    USER_IX, ITEM_IX, TIMESTAMP_IX, RATING_IX = "userId", "movieId", "timestamp", "rating"
    SCHEMA = "userId bigint, movieId bigint, rating double, timestamp bigint"
    OPTIONS: dict = {}

    def _default_filters(self):
        return [MinRating(4, self.RATING_IX), self._users(5), self._items(5)]

    def read(self) -> DataFrame:
        return self._csv(self.SCHEMA, **self.OPTIONS)


class MovieLens25M(_MovieLens):
    DEFAULT_FILENAME, OPTIONS = "ratings.csv", {"header": True}

    def _default_filters(self):
        return [MinRating(4, self.RATING_IX), self._users(5)]


class MovieLens100K(_MovieLens):
    DEFAULT_FILENAME, OPTIONS = "u.data", {"sep": "\t"}

    def _default_filters(self):
        return [MinRating(4, self.RATING_IX), self._users(5)]


class MovieLens1M(MovieLens100K):
    DEFAULT_FILENAME, OPTIONS = "ratings.dat", {"sep": "::"}


class MovieLens10M(MovieLens1M):
    pass


class Netflix(Dataset):
    """The cached CSV, or one file per movie (a line `id:`, then `user,rating,date`), in a folder or in an archive, itself inside another or not."""

    RATING_IX = "rating"
    DEFAULT_FILENAME = "netflix.csv"

    def _default_filters(self):
        return [MinRating(4, self.RATING_IX), self._items(5)]

    def read(self) -> DataFrame:
        if self.filename.endswith(".csv"):
            return self._csv("user_id string, item_id string, timestamp bigint, rating double", header=True)
        if self.archived:
            lines = archive_members(self.spark, self.file_path, "mv_").select(F.col("line").alias("value"), F.col("member").alias("file"))
        else:
            lines = self.spark.read.text(self.file_path).select("value", F.input_file_name().alias("file"))
        movie = lines.filter(F.col("value").endswith(":")).select("file", F.expr("rtrim(':', value)").alias("item_id"))
        rows = lines.filter(~F.col("value").endswith(":")).select("file", F.split("value", ",").alias("v"))
        # one row a file; joined as Spark finds best
        return rows.join(movie, "file").select(F.col("v")[0].alias("user_id"), "item_id", F.unix_timestamp(F.col("v")[2], "yyyy-MM-dd").alias("timestamp"), F.col("v")[1].cast("double").alias("rating")).dropna()


class AdressaOneWeek(Dataset):
    """JSON lines, in files or in an archive; rows with all three keys."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "userId", "id", "time"
    DEFAULT_FILENAME = "one_week"

    def _default_filters(self):
        return [self._items(3), self._users(5)]

    def read(self) -> DataFrame:
        schema = "userId string, id string, time bigint"
        if self.archived:
            return archive_members(self.spark, self.file_path).select(F.from_json("line", schema).alias("r")).select("r.*").dropna()
        return self.spark.read.json(self.file_path, schema=schema).dropna()


class CiteULike(Dataset):
    """A line per user: how many items, then the items; no times."""

    TIMESTAMP_IX = None
    DEFAULT_FILENAME = "users.dat"

    def _default_filters(self):
        return [self._items(3), self._users(5)]

    def read(self) -> DataFrame:
        # the line's number is the user: lines are numbered inside files in the order they are read
        from toplane.operators.interactions import dense_index

        lines = self.spark.read.text(self.file_path).withColumn("__at", F.monotonically_increasing_id())
        rows = dense_index(lines, ["__at"], self.USER_IX).select(self.USER_IX, F.split(F.trim("value"), r"\s+").alias("v"))
        items = F.slice("v", F.lit(2), F.size("v"))
        checked = F.when(F.size(items) == F.col("v")[0].cast("int"), items).otherwise(F.raise_error(F.lit("a line's count is wrong")))
        return rows.filter("v[0] <> ''").select(self.USER_IX, F.explode(checked).alias(self.ITEM_IX)).withColumn(self.ITEM_IX, F.col(self.ITEM_IX).cast("bigint"))


class _EventTypes(Dataset):
    EVENT_TYPE_IX = "event_type"
    ALLOWED: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, path: str = "data", filename: str | None = None, use_default_filters: bool = True, event_types: tuple[str, ...] = ("view",)) -> None:
        super().__init__(spark, path, filename, use_default_filters)
        if bad := [t for t in event_types if t not in self.ALLOWED]:
            raise ValueError(f"{bad} are none of {self.ALLOWED}")
        self.event_types = tuple(event_types)

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.EVENT_TYPE_IX).isin(*self.event_types))


class CosmeticsShop(_EventTypes):
    """CSV files of a shop's events, in a folder or in an archive."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "user_id", "product_id", "event_time"
    ALLOWED = ("view", "cart", "remove_from_cart", "purchase")
    DEFAULT_FILENAME = "events"

    def __init__(self, spark: SparkSession, path: str = "data", filename: str | None = None, use_default_filters: bool = True, event_types: tuple[str, ...] = ("view",), extra_cols: tuple[str, ...] = ()) -> None:
        super().__init__(spark, path, filename, use_default_filters, event_types)
        self.extra_cols = tuple(extra_cols)

    def _default_filters(self):
        return [self._users(50, True), self._items(3, True)]

    def read(self) -> DataFrame:
        schema = "event_time string, event_type string, product_id bigint, category_id bigint, category_code string, brand string, price double, user_id bigint, user_session string"
        df = self._typed(self._archived_csv(schema) if self.archived else self._csv(schema, header=True))
        return df.select(self.USER_IX, self.ITEM_IX, F.unix_timestamp(F.substring(self.TIMESTAMP_IX, 1, 19), "yyyy-MM-dd HH:mm:ss").alias(self.TIMESTAMP_IX), *self.extra_cols)


class Globo(Dataset):
    """CSV files of clicks by the hour, in a folder or in an archive; times in milliseconds."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "user_id", "click_article_id", "click_timestamp"
    DEFAULT_FILENAME = "clicks"

    def _default_filters(self):
        return [self._users(10, True), self._items(3, True)]

    def read(self) -> DataFrame:
        schema = "user_id bigint, session_id bigint, session_start bigint, session_size int, click_article_id bigint, click_timestamp bigint, click_environment int, click_deviceGroup int, click_os int, click_country int, click_region int, click_referrer_type int"
        df = self._archived_csv(schema, "clicks_hour") if self.archived else self._csv(schema, header=True, pathGlobFilter="clicks_hour*")
        return df.select(self.USER_IX, self.ITEM_IX, (F.col(self.TIMESTAMP_IX) / 1000).alias(self.TIMESTAMP_IX))


class RecsysChallenge2015(Dataset):
    """Sessions, times and items without a header."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "session", "item", "timestamp"
    DEFAULT_FILENAME = "yoochoose-clicks.dat"

    def _default_filters(self):
        return [self._users(5, True)]

    def read(self) -> DataFrame:
        df = self._csv("session bigint, timestamp string, item bigint, category string")
        return df.select("session", F.to_timestamp("timestamp").cast("double").alias("timestamp"), "item")


class RetailRocket(_EventTypes):
    """CSV of a shop's events; times in milliseconds."""

    USER_IX, ITEM_IX, TIMESTAMP_IX, EVENT_TYPE_IX = "visitorid", "itemid", "timestamp", "event"
    ALLOWED = ("view", "addtocart", "transaction")
    DEFAULT_FILENAME = "events.csv"

    def _default_filters(self):
        return [self._users(50, True), self._items(3, True)]

    def read(self) -> DataFrame:
        df = self._typed(self._csv("timestamp bigint, visitorid bigint, event string, itemid bigint, transactionid bigint", header=True))
        return df.select(self.USER_IX, self.ITEM_IX, (F.col("timestamp") / 1000).alias("timestamp"))


class ThirtyMusicSessions(Dataset):
    """Sessions of tracks; the place in the session is the time."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "sid", "tid", "position"

    def _default_filters(self):
        return [self._users(5), self._items(5)]

    def read(self) -> DataFrame:
        return self.spark.read.csv(self.file_path, header=True, inferSchema=False).select(*(F.col(c).cast("bigint").alias(c) for c in (self.USER_IX, self.ITEM_IX, self.TIMESTAMP_IX)))


class MillionSongDataset(Dataset):
    """Users, songs and counts; a count of n is n events."""

    USER_IX, ITEM_IX, TIMESTAMP_IX = "userId", "songId", None
    DEFAULT_FILENAME = "train_triplets.txt"

    def _default_filters(self):
        return [self._items(20), self._users(200)]

    def read(self) -> DataFrame:
        df = self._csv("userId string, songId string, n int", sep="\t")
        return df.select("userId", "songId", F.explode(F.sequence(F.lit(1), "n")).alias("__k")).drop("__k")


TasteProfile = MillionSongDataset


ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2")
#: Lines of a member that go on together.
LINES = 50_000


def archive_members(spark: SparkSession, path: str, match: str = "", encoding: str = "utf-8") -> DataFrame:
    """(member, number, line) of the text files in tar or zip archives at a path, and in archives inside these.

    Archives are spread over tasks; an archive is one row, so it may have 2 GB at
    most.  Its members' lines are read and passed on in parts, numbered from 0.
    """

    def texts(raw: io.BufferedIOBase, prefix: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
        if zipfile.is_zipfile(raw):
            with zipfile.ZipFile(raw) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        with z.open(name) as f:
                            yield from inside(f, prefix + name)
            return
        raw.seek(0)
        with tarfile.open(fileobj=raw) as t:
            for m in t:
                if m.isfile():
                    yield from inside(t.extractfile(m), prefix + m.name)

    def inside(f: io.BufferedIOBase, name: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
        if name.endswith(ARCHIVES):
            yield from texts(io.BytesIO(f.read()), f"{name}/")
        elif match in name.rsplit("/", 1)[-1]:
            yield name, f

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for name, f in texts(io.BytesIO(content), ""):
                    lines = enumerate(x.rstrip("\r\n") for x in io.TextIOWrapper(f, encoding))
                    while part := list(islice(lines, LINES)):
                        number, line = zip(*part, strict=True)
                        yield pd.DataFrame({"member": name, "number": number, "line": line})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, number bigint, line string")


DATASETS = {c.__name__: c for c in (AdressaOneWeek, CiteULike, CosmeticsShop, DummyDataset, Globo, MillionSongDataset, MovieLens100K, MovieLens10M, MovieLens1M, MovieLens25M, Netflix, RecsysChallenge2015, RetailRocket, ThirtyMusicSessions)}
