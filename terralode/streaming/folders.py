"""Where tables that end a lineage are written."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which executors share; a temporary one only where that is unset in local
    mode. On a cluster without it, ValueError: executors would write to folders that others don't see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or _own()).rstrip("/")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table in the shared folder and reads it back: the lineage ends there, and its size is known."""
    path = f"{shared_dir(df.sparkSession)}/terralode/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=1)
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
