"""A training-corpus pipeline: five operators in a row, each on what its predecessor kept.

1 language ID: documents whose language the decoder can't tell go (no letter, or flagged as ambiguous);
  where no document names a language to learn from, only those without a letter
2 line dedup: lines that a source repeats over its documents are cut out
3 n-gram Jaccard join: one document of each group of near copies stays
4 benchmark decontamination: benchmark passages are cut out, documents made of them go
5 BPE encoding and decoding: tokens of what is left

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents (n_chars follows the text).  Empty tables, nulls
and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toplane.llm import bpe, decontaminate, jaccard, language, linededup
from toplane.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects `und` and ambiguous texts; the prediction replaces no column."""
    model = language.learn(docs, language.fold("doc_id", language.FOLDS) != 0)
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs.select(*COLUMNS), model, list(COLUMNS)).filter((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(linededup.drop_boilerplate(docs.select(*COLUMNS)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return as_documents(decontaminate.remove_hits(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs.select(*COLUMNS), ["doc_id"])


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("BPE encoding and decoding", encode),
]

#: Classifiers and merges can't be said in SQL: the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
