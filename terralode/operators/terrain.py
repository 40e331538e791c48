"""Terrain composites on cell tables (row, col, value): positions, heights above streams, basins, classes, overviews."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.operators.grid import normalised
from terralode.operators.ranks import percentile_row

# Weights of the flood risk and of the drainage need.
FLOOD = {"twi": 0.30, "hand": 0.30, "curvature": 0.25, "tpi": 0.15}
DRAINAGE = {"distance": 0.30, "log_flow": 0.25, "hand": 0.20, "tpi": 0.25}


def moving(cells: DataFrame, radius: int) -> DataFrame:
    """Mean and population deviation of the square window around each cell, by sums that each cell sends along rows and
    then along columns: 2 * (2 * radius + 1) rows for a cell instead of its square."""
    v, around = F.col("value"), F.sequence(F.lit(-radius), F.lit(radius))
    sent = cells.select("row", F.explode(F.transform(around, lambda d: F.col("col") + d)).alias("col"), v.alias("s"), (v * v).alias("q"), F.lit(1).alias("n"))
    rows = sent.groupBy("row", "col").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    sent = rows.select(F.explode(F.transform(around, lambda d: F.col("row") + d)).alias("row"), "col", "s", "q", "n")
    both = sent.groupBy("row", "col").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return cells.join(both, ["row", "col"]).select("row", "col", "value", mean.alias("mean"), std.alias("std"))


def position_index(cells: DataFrame, radius: int = 10) -> DataFrame:
    """Deviations of a cell from the mean of its window; 0 where all are equal."""
    return moving(cells, radius).select("row", "col", "value", F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("tpi"))


def focal_mode(cells: DataFrame, radius: int) -> DataFrame:
    """The most frequent class of the window, ties to the smaller: counts by cell and class, combined before the shuffle."""
    around = F.sequence(F.lit(-radius), F.lit(radius))
    wide = cells.select("row", "col", F.explode(F.transform(around, lambda d: F.col("row") + d)).alias("r"), "value")
    wide = wide.select("r", F.explode(F.transform(around, lambda d: F.col("col") + d)).alias("c"), "value")
    counts = wide.groupBy("r", "c", "value").agg(F.count("*").alias("n"))
    mode = counts.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max(F.struct("n", (-F.col("value")).alias("v"))).alias("m"))
    return cells.select("row", "col").join(mode, ["row", "col"]).select("row", "col", (-F.col("m.v")).alias("mode"))


def overview(cells: DataFrame, factor: int = 2) -> DataFrame:
    """A coarser grid of the upper left cells of each block."""
    f = lambda c: F.floor(F.col(c) / factor).cast("long")
    return cells.groupBy(f("row").alias("row"), f("col").alias("col")).agg(F.min_by("value", F.struct("row", "col")).alias("value"))


def basins(flow: DataFrame, cell_ha: float, least_ha: float) -> DataFrame:
    """Areas of the cells that drain to the same outlet, from a certain area."""
    return flow.groupBy("outlet").agg(F.round(F.count("*") * cell_ha, 2).alias("area_ha"), F.count("*").alias("n")).where(F.col("area_ha") >= least_ha)


def percentile_bounds(cells: DataFrame, columns: list[str], keep, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row of exact percentiles (low_x, high_x) of each column, nulls aside."""
    row = percentile_row(cells, columns, [low, high], keep)
    return row.select(*(F.col(f"p{round(p * 100)}_{c}").alias(f"{n}_{c}") for c in columns for n, p in (("low", low), ("high", high))))


def composite(cells: DataFrame, weights: dict[str, float], inverted: tuple[str, ...]) -> Column:
    """0 to 100 from factors scaled between their percentiles; cells must have the bounds' columns."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        part = normalised(F.col(name), F.col(f"low_{name}"), F.col(f"high_{name}"))
        total = total + weight * (F.when(F.col(name).isNull(), 0.0).otherwise(1 - part) if name in inverted else part)
    return 100 * total


def flood_class(hand: Column, twi: Column, flow: Column, p35: Column, p55: Column, p99: Column) -> Column:
    """0 none, 1 medium, 2 high, 3 drainage; the later rules win; 255 for nodata."""
    sound = hand.isNotNull() & twi.isNotNull() & flow.isNotNull()
    rules = F.when((flow > p99) & (hand < 1), 3).when((hand < 0.8) & (twi > p55), 2).when((hand < 1.5) & (twi > p35), 1).otherwise(0)
    return F.when(sound, rules).otherwise(255)


def weighed(cells: DataFrame, weights: dict[str, float], inverted: tuple[str, ...], keep) -> DataFrame:
    """Cells with their composite of weighed factors, 0 to 100; null where any factor is."""
    sound = F.lit(True)
    for name in weights:
        sound = sound & F.col(name).isNotNull()
    bounds = percentile_bounds(cells.where(sound), list(weights), keep)
    scored = F.when(sound, composite(cells, weights, inverted))
    return cells.crossJoin(F.broadcast(bounds)).select("row", "col", scored.alias("score"))


def legacy_class(twi: Column, flow: Column, p50: Column) -> Column:
    """0 dry, 1 wet, 2 active drainage, 3 accumulation; the later rules win; 255 for nodata."""
    rules = F.when(flow > 5000, 3).when(flow > 1000, 2).when(twi >= p50, 1).otherwise(0)
    return F.when(twi.isNotNull() & flow.isNotNull(), rules).otherwise(255)


def height_above_stream(flow: DataFrame, accumulation: DataFrame, least: int, trace, keep) -> DataFrame:
    """(cell, hand): the height of a cell above the first stream cell down its path, streams being cells through which at
    least so many drain; null where the path meets none. flow has (cell, next, value), accumulation (cell, area)."""
    stream = accumulation.where(F.col("area") >= least).select("cell", F.lit(True).alias("stream"))
    marked = keep(flow.join(stream, "cell", "left"))
    ends = trace(marked.select("cell", F.when(F.col("stream").isNull(), F.col("next")).alias("next"), "value"), keep)
    base = marked.where("stream").select(F.col("cell").alias("outlet"), F.col("value").alias("base"))
    return marked.join(ends, "cell").join(base, "outlet", "left").select("cell", (F.col("value") - F.col("base")).alias("hand"))


def pour_zones(flow: DataFrame, points: DataFrame, trace, keep) -> DataFrame:
    """(cell, point): the pour point (cell) that the path of each cell meets first; cells whose path meets none are left out."""
    marks = points.select("cell", F.lit(True).alias("pours")).distinct()
    marked = keep(flow.join(marks, "cell", "left"))
    ends = trace(marked.select("cell", F.when(F.col("pours").isNull(), F.col("next")).alias("next"), "value"), keep)
    return ends.select("cell", F.col("outlet").alias("point")).join(marks.select(F.col("cell").alias("point")), "point", "left_semi").select("cell", "point")


def opened(cells: DataFrame, window: int) -> DataFrame:
    """(row, col, value, opened): the least height in a square of window by window cells, and of these the greatest. Squares are
    separable: both passes go along rows and then along columns, each by a sliding window of the sorted line, so that a task holds
    a line's window and no neighbourhood is sent about. Missing cells count for nothing; null values stay null. Cells must be unique."""
    half = window // 2
    along = lambda line, place: Window.partitionBy(line).orderBy(place).rangeBetween(-half, half)
    rows = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    rows = rows.withColumn("low", F.min("value").over(along("row", "col"))).withColumn("low", F.min("low").over(along("col", "row")))
    rows = rows.withColumn("opened", F.max("low").over(along("col", "row"))).withColumn("opened", F.max("opened").over(along("row", "col")))
    return rows.select("row", "col", "value", F.when(F.col("value").isNotNull(), F.col("opened")).alias("opened"))


def without_objects(cells: DataFrame, size: float, window: int = 7, slope: float = 5.0) -> DataFrame:
    """(row, col, value, removed): heights without what stands on the ground and is narrower than the window: a cell that rises above
    the opened surface more steeply than `slope` degrees over a cell's side takes that surface's height."""
    removed = F.coalesce(F.col("value") - F.col("opened") > size * math.tan(math.radians(slope)), F.lit(False))
    return opened(cells, window).select("row", "col", F.when(removed, F.col("opened")).otherwise(F.col("value")).alias("value"), removed.alias("removed"))
