"""Tables that outlive their plan, and batches for Python workers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is made only where none is set in a session of one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="toplane-"))
    return _own[0]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it survives lost executors and is worked out once."""
    path = f"{shared_folder(df.sparkSession)}/toplane/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the batches that go to Python workers, where the session names no other limit.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow() in batches of a few MB, so that a worker's memory follows neither the rows of a partition nor their length.

    Workers live on after a task; what it has freed goes back to the system.
    """
    bounded(df.sparkSession)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def keyed(docs: DataFrame, keys: list[str], text_col: str) -> tuple[DataFrame, list[str], int]:
    """docs with its key columns and its text under names of our own, their names, and the text's place; a text that is a key too comes once."""
    names = [f"key_{i}" for i in range(len(keys))]
    columns = [docs[k].alias(n) for k, n in zip(keys, names, strict=True)]
    if text_col in keys:
        return docs.select(*columns), names, keys.index(text_col)
    return docs.select(*columns, docs[text_col].alias("text")), names, len(keys)


def named(out: DataFrame, names: list[str], keys: list[str], *rest) -> DataFrame:
    """The key columns under their own names again, then the rest."""
    return out.select(*(out[n].alias(k) for n, k in zip(names, keys, strict=True)), *rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with further columns."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
