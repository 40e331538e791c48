"""Exact percentiles of whole tables and of groups, without all values of any in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, column: str, shares: Sequence[float], keep: Callable[[DataFrame], DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """(*by, share, value): percentiles with linear interpolation, nulls aside; a group without values has none.

    Values are counted, dealt out by range of group and value and written by keep. The counts of the ranges (one row for
    each range of a group) say in which of them the wanted ranks lie; only within these values are summed up, so that a
    task holds one range."""
    by = list(by)
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    dealt = keep(counts.repartitionByRange(*by, "v").withColumn("__range", F.spark_partition_id()))
    ranges = dealt.groupBy(*by, "__range").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*by)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("m").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("m").over(w))
    # Ranks from 0: share * (n - 1), and the next.
    at = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("all") - 1)).alias("rank")) for s in shares)))
    wanted = ranges.select(*by, "__range", "before", "m", "all", at.alias("w")).select(*by, "__range", "before", "m", "w.share", "w.rank", F.explode(F.array(F.floor("w.rank"), F.least(F.floor("w.rank") + 1, F.col("all") - 1))).alias("place"))
    wanted = wanted.where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m")))
    picked = wanted.select(*by, "__range", "before").distinct()
    within = dealt.join(picked, [*by, "__range"]).withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "__range").orderBy("v")))
    found = wanted.select(*by, "__range", "share", "rank", "place").join(within.select(*by, "__range", "v", (F.col("end") - F.col("n")).alias("start"), "end"), [*by, "__range"])
    found = found.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("end")))
    low, high, part = F.min("v"), F.max("v"), F.first("rank") - F.floor(F.first("rank"))
    return found.groupBy(*by, "share").agg((low + part * (high - low)).alias("value"))


def percentile_row(df: DataFrame, columns: Sequence[str], shares: Sequence[float], keep: Callable[[DataFrame], DataFrame], default: float | None = None) -> DataFrame:
    """One row with the column p<per cent>_<column> for each column and share."""
    row = None
    for c in columns:
        found = percentiles(df, c, shares, keep)
        pick = lambda s: F.coalesce(F.max(F.when(F.col("share") == s, F.col("value"))), F.lit(default).cast("double"))
        one = found.agg(*(pick(float(s)).alias(f"p{round(s * 100)}_{c}") for s in shares))
        row = one if row is None else row.crossJoin(one)  # single rows
    return row
