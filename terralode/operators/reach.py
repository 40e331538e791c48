"""Lines within reach of other lines: what of a line lies in the buffer of another, without drawing the buffer."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralode.functions import geometry
from terralode.operators.spatial import join_boxes


def _segments(lines: DataFrame, key: str, line: str, side: str, grown: float) -> DataFrame:
    """(side_id, side_n, corners, side_box): the segments of lines, numbered, with boxes grown by a distance; a line of one point is that point."""
    points = F.col(line)
    ends = F.when(F.size(points) == 1, F.array(F.struct(F.get(points, 0).alias("a"), F.get(points, 0).alias("b")))).otherwise(geometry.sides(points))
    rows = lines.where(F.size(points) > 0).select(F.col(key).alias(f"{side}_id"), F.posexplode(ends).alias(f"{side}_n", "e"))
    c = {f"{side}{n}": F.col(f"e.{p}.{x}") for n, p, x in (("x1", "a", "x"), ("y1", "a", "y"), ("x2", "b", "x"), ("y2", "b", "y"))}
    low = lambda i: F.least(F.col(f"e.a.{i}"), F.col(f"e.b.{i}")) - grown
    high = lambda i: F.greatest(F.col(f"e.a.{i}"), F.col(f"e.b.{i}")) + grown
    box = F.struct(low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"))
    return rows.select(f"{side}_id", f"{side}_n", *(v.alias(k) for k, v in c.items()), box.alias(f"{side}_box"))


def spans(distance: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares (from, to) of right segments, columns (x1, y1, x2, y2), within a distance of left ones: all points within a
    distance of a segment are convex, so that it is one span, from the first entry into to the last exit from the two discs
    at its ends and the band between. NaN where there is none."""
    x, y, dx, dy = right[0], right[1], right[2] - right[0], right[3] - right[1]
    ux, uy = left[2] - left[0], left[3] - left[1]
    size, length = dx * dx + dy * dy, np.hypot(ux, uy)
    with np.errstate(divide="ignore", invalid="ignore"):
        starts, ends = [], []
        for px, py in ((left[0], left[1]), (left[2], left[3])):
            ox, oy = x - px, y - py
            half = ox * dx + oy * dy
            root = np.sqrt(half * half - size * (ox * ox + oy * oy - distance * distance))
            starts.append((-half - root) / size)
            ends.append((-half + root) / size)

        def slab(at: np.ndarray, by: np.ndarray, low, high) -> tuple[np.ndarray, np.ndarray]:
            one, two = (low - at) / by, (high - at) / by
            always = np.where((at >= low) & (at <= high), np.inf, np.nan)
            return np.where(by == 0, -always, np.minimum(one, two)), np.where(by == 0, always, np.maximum(one, two))

        ox, oy = x - left[0], y - left[1]
        s0, s1 = slab((ox * ux + oy * uy) / length, (dx * ux + dy * uy) / length, 0.0, length)
        w0, w1 = slab((oy * ux - ox * uy) / length, (dy * ux - dx * uy) / length, -distance, distance)
        low, high = np.maximum(s0, w0), np.minimum(s1, w1)
        real = low <= high
        starts.append(np.where(real, low, np.nan))
        ends.append(np.where(real, high, np.nan))
        return np.maximum(np.fmin.reduce(starts), 0.0), np.minimum(np.fmax.reduce(ends), 1.0)


def _spanned(distance: float, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = [c.to_numpy(zero_copy_only=False) for c in batch.columns[count:]]
            low, high = spans(distance, np.stack(corners[:4]), np.stack(corners[4:]))
            found = pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=[*batch.schema.names, "t0", "t1"])
            yield found.filter(pa.array(low < high))

    return run


def within_reach(left: DataFrame, right: DataFrame, l_id: str, r_id: str, distance: float, size: float, line: str = "line") -> DataFrame:
    """(l_id, r_id, length, x, y): what of each right line lies within a distance of a left line, its length and its centre; pairs that
    only touch are left out. Exact: buffers are round.

    Segments meet on tiles of their own size, the left ones grown by the distance; each pair comes once. The spans of a right
    segment near the segments of one left line are merged, as many as that line has there. size is the side of the smallest
    tiles, about a usual segment. Null and empty lines reach nothing; ids must be unique.
    """
    pairs = join_boxes(_segments(left, l_id, line, "l", distance), _segments(right, r_id, line, "r", 0.0), size, "l_box", "r_box")
    keys, corners = ["l_id", "r_id", "r_n"], [f"{side}{c}" for side in "lr" for c in ("x1", "y1", "x2", "y2")]
    pairs = pairs.select(*keys, *corners)
    schema = T.StructType([*pairs.schema.fields, T.StructField("t0", T.DoubleType()), T.StructField("t1", T.DoubleType())])
    merged = pairs.mapInArrow(_spanned(distance, len(keys)), schema).groupBy("l_id", "r_id", "r_n", "rx1", "ry1", "rx2", "ry2").agg(F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("spans"))

    def add(state: Column, s: Column) -> Column:
        low = F.greatest(s["t0"], state["end"])
        new = s["t1"] > low
        return F.struct(
            F.greatest(state["end"], s["t1"]).alias("end"), F.when(new, state["share"] + s["t1"] - low).otherwise(state["share"]).alias("share"),
            F.when(new, state["moment"] + (s["t1"] * s["t1"] - low * low) / 2).otherwise(state["moment"]).alias("moment"),
        )

    none = F.struct(F.lit(0.0).alias("end"), F.lit(0.0).alias("share"), F.lit(0.0).alias("moment"))
    rows = merged.withColumn("s", F.aggregate("spans", none, add))
    dx, dy = F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1")
    whole, share, moment = F.sqrt(dx * dx + dy * dy), F.col("s.share"), F.col("s.moment")
    sums = rows.groupBy("l_id", "r_id").agg(
        F.sum(whole * share).alias("length"), F.sum(whole * (F.col("rx1") * share + dx * moment)).alias("sx"), F.sum(whole * (F.col("ry1") * share + dy * moment)).alias("sy")
    )
    return sums.where("length > 0").select(F.col("l_id").alias(l_id), F.col("r_id").alias(r_id), "length", (F.col("sx") / F.col("length")).alias("x"), (F.col("sy") / F.col("length")).alias("y"))


def conflicts(layers: Mapping[str, DataFrame], kinds: list[tuple[str, str]], distance: float, size: float) -> DataFrame:
    """(kind, l_id, r_id, length, x, y) of pairs of named layers (id, line), kind being both names; an empty layer has none."""
    found = [within_reach(layers[a], layers[b].withColumnRenamed("id", "r_id"), "id", "r_id", distance, size).select(F.lit(f"{a}_{b}").alias("kind"), F.col("id").alias("l_id"), "r_id", "length", "x", "y") for a, b in kinds]
    return reduce(DataFrame.union, found)
