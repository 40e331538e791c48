"""Helpers that several operators share: scratch tables in the cluster's shared folder, bounded broadcasts, columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An id set of at most so many rows (16 bytes each, under 40 MB as a hash table) may be broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows, and bytes of them, that go to a Python worker at once; a row that is larger goes alone.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 4 << 20
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS_PER_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_PER_BATCH}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset in local mode. On a
    cluster without it, ValueError: executors would write to folders that others don't see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _local_scratch()).rstrip("/")


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/terralode/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes stashed tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in ids (one column of that name, distinct). The id set is counted first and
    broadcast only if it is small; otherwise both sides are shuffled."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't in ids, a null key included; ids as for only_ids, written away first."""
    ids = stash(ids, "ids")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti")


def small_batches(df: DataFrame) -> DataFrame:
    """Lets Python workers get small batches, so that texts take little memory. The bounds are settings of the session,
    which Spark reads when a plan runs: they stay lowered for its later plans, whose results they don't change."""
    conf = df.sparkSession.conf
    for name, most in _BOUNDS.items():
        value = (conf.get(name) or "").lower().removesuffix("b")
        if not (value.isdigit() and 0 < int(value) <= most):
            conf.set(name, most)
    return df


def binary(c: str) -> Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(c).cast("binary")
