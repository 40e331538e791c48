"""Raster operators on cell tables (row, col, value): neighbourhoods, slope, flow and zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.functions import geometry
from terralode.functions.geometry import within
from terralode.operators.ranks import percentiles

# The flow codes, counter-clockwise from east, with their steps in rows (downwards) and columns.
D8 = {1: (0, 1), 2: (-1, 1), 4: (-1, 0), 8: (-1, -1), 16: (0, -1), 32: (1, -1), 64: (1, 0), 128: (1, 1)}
#: Steps of a path that are followed at most.
MOST_STEPS = 1 << 20
#: Cells of which whole rows of the grid are given to Python at once.
_GIVEN = 1 << 15
#: Rows and columns of a tile, and about how many cells one task gets of whole tiles.
_TILE, _DEALT = 64, 1 << 18


def with_neighbours(cells: DataFrame, steps: dict[str, tuple[int, int]]) -> DataFrame:
    """Each cell with the values of named neighbours (null where there is none). Cells are dealt out by tiles, those at an edge
    also to the tiles beside it, in as many parts as their number asks for; there every cell sends its value to those of
    the tile that look at it, and they are gathered by cell. So a task holds about _DEALT cells, however many its input has."""
    row, col = F.col("row"), F.col("col")
    tile = lambda r, c: F.struct(F.floor(r / _TILE).alias("tr"), F.floor(c / _TILE).alias("tc"))
    seen = F.array_distinct(F.array(tile(row, col), *(tile(row - dr, col - dc) for dr, dc in steps.values())))
    parts = max(1, -(-cells.count() // _DEALT))
    dealt = cells.select("row", "col", "value", F.explode(seen).alias("tile")).select("row", "col", "value", "tile.*").repartition(parts, "tr", "tc")
    sent = [F.struct(F.lit("").alias("from"), row, col, F.col("value"))]
    for name, (dr, dc) in steps.items():
        sent.append(F.struct(F.lit(name).alias("from"), (row - dr).alias("row"), (col - dc).alias("col"), F.col("value")))
    rows = dealt.select("tr", "tc", F.explode(F.array(*sent)).alias("s")).select("tr", "tc", "s.*")
    rows = rows.where(F.col("tr").eqNullSafe(F.floor(row / _TILE)) & F.col("tc").eqNullSafe(F.floor(col / _TILE)))
    own = F.max(F.when(F.col("from") == "", F.col("value"))).alias("value")
    around = [F.max(F.when(F.col("from") == name, F.col("value"))).alias(name) for name in steps]
    return rows.groupBy("tr", "tc", "row", "col").agg(F.count_if(F.col("from") == "").alias("here"), own, *around).where("here > 0").drop("here", "tr", "tc")


def _gradient(low: str, high: str, size: float) -> Column:
    """Central differences; one-sided at edges and beside missing cells, 0 where both are missing."""
    a, b, v = F.col(low), F.col(high), F.col("value")
    return F.coalesce((b - a) / (2 * size), (b - v) / size, (v - a) / size, F.lit(0.0))


def slope_aspect(cells: DataFrame, size: float) -> DataFrame:
    """Slope and aspect in degrees."""
    rows = with_neighbours(cells, {"north": (-1, 0), "south": (1, 0), "west": (0, -1), "east": (0, 1)})
    dx, dy = _gradient("west", "east", size), _gradient("north", "south", size)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    aspect = F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0))
    return rows.select("row", "col", "value", slope.alias("slope"), aspect.alias("aspect"))


def wetness(accumulation: Column, slope: Column, size: float) -> Column:
    """The topographic wetness index; slope in degrees."""
    return F.ln(F.greatest(accumulation * size, F.lit(1e-10)) / F.tan(F.greatest(F.radians(slope), F.lit(0.001))))


def d8_pointers(cells: DataFrame) -> DataFrame:
    """The code of the neighbour with the steepest drop (diagonals are longer); ties to the smaller code; 0 in a pit."""
    rows = with_neighbours(cells, {f"n{code}": step for code, step in D8.items()})
    drops = [F.struct(((F.col("value") - F.col(f"n{c}")) / (2**0.5 if dr and dc else 1.0)).alias("drop"), F.lit(-c).alias("code")) for c, (dr, dc) in D8.items()]
    best = F.array_max(F.filter(F.array(*drops), lambda d: d["drop"] > 0))
    return rows.select("row", "col", "value", F.coalesce(-best["code"], F.lit(0)).alias("code"))


def downstream(pointers: DataFrame) -> DataFrame:
    """(cell, next): packed cell ids and the cell each flows to; null in a pit."""
    pack = lambda r, c: F.shiftleft(r.cast("long"), 32) + c.cast("long")
    to = F.lit(None).cast("long")
    for code, (dr, dc) in D8.items():
        to = F.when(F.col("code") == code, pack(F.col("row") + dr, F.col("col") + dc)).otherwise(to)
    return pointers.select(pack(F.col("row"), F.col("col")).alias("cell"), to.alias("next"), "value")


def traced(flow: DataFrame, keep) -> DataFrame:
    """For each cell its outlet, the steps to it and the cells that drain through it (itself included), by doubling:
    after k rounds 2**k steps are known, so that the rounds are the logarithm of the longest path. keep writes a
    round's table away and reads it back (a checkpoint), which cuts the lineage. Paths of up to MOST_STEPS are followed;
    longer ones, and cells whose path runs into a circle, have no outlet, steps or area. Cells that have got to their outlet have nowhere
    to go, so they aren't joined by it: all of them would meet in one task. Joins are merged: a round's files are far smaller than the
    table, and it would be broadcast by their size."""
    state = keep(flow.select("cell", F.col("next").alias("jump"), F.coalesce("next", "cell").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("area")))
    rounds = 0
    while rounds < MOST_STEPS.bit_length() and not state.where("jump is not null").isEmpty():
        rounds += 1
        onward = state.select(F.col("cell").alias("jump"), F.col("jump").alias("jump2"), F.col("last").alias("last2"), F.col("steps").alias("steps2"))
        under = state.where("jump is not null")
        given = under.groupBy(F.col("jump").alias("cell")).agg(F.sum("area").alias("more"))
        moved = under.join(onward.hint("merge"), "jump", "left").select(
            "cell", F.col("jump2").alias("jump"), F.coalesce("last2", "last").alias("last"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), "area",
        )
        both = moved.union(state.where("jump is null").select(*moved.columns))
        state = keep(both.join(given.hint("merge"), "cell", "left").withColumn("area", F.col("area") + F.coalesce("more", F.lit(0))).drop("more"))
    ends = F.col("jump").isNull()
    return state.select("cell", *(F.when(ends, F.col(c)).alias(name) for c, name in (("last", "outlet"), ("steps", "steps"), ("area", "area"))))


def zonal(cells: DataFrame, zone: str, value: str, keep, threshold: float = 70.0, digits: int = 4) -> DataFrame:
    """min, max, mean, population deviation, median, 90th percentile, count, sum and cells above a threshold by zone.
    keep writes a table away and reads it back."""
    v = F.col(value)
    r = lambda c, name: F.round(c, digits).alias(name)
    sums = cells.where(v.isNotNull()).groupBy(zone).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), r(F.avg(v), "mean"), r(F.stddev_pop(v), "std"), F.count(v).alias("n"), r(F.sum(v), "sum"), F.count_if(v > threshold).alias("n_high"),
    )
    found = percentiles(cells, value, [0.5, 0.9], keep, [zone])
    pick = lambda s, name: r(F.max(F.when(F.col("share") == s, F.col("value"))), name)
    return sums.join(found.groupBy(zone).agg(pick(0.5, "median"), pick(0.9, "p90")), zone)


def normalised(value: Column, low: Column, high: Column) -> Column:
    """Clipped to a percentile range and scaled to 0..1; 0.5 where the range is flat, 0 for nodata."""
    scaled = F.when(high > low, (F.least(F.greatest(value, low), high) - low) / (high - low)).otherwise(F.lit(0.5))
    return F.when(value.isNull(), F.lit(0.0)).otherwise(scaled)


def paths(flow: DataFrame, starts: DataFrame, keep, most_steps: int = 5000) -> DataFrame:
    """(start, cell, steps): the cells on the path from each start (cell) of at most so many cells, by doubling: what
    is known of a path is repeated from where it has got to. A path that runs into a circle ends where it began to."""
    jump = keep(flow.where("next is not null").select("cell", F.col("next").alias("to")))
    found = keep(starts.select(F.col("cell").alias("start"), "cell", F.lit(0).cast("long").alias("steps")))
    size = 1
    while size < most_steps:
        onward = found.join(jump, "cell").select("start", F.col("to").alias("cell"), (F.col("steps") + size).alias("steps"))
        both = found.union(onward.where(F.col("steps") < most_steps)).groupBy("start", "cell").agg(F.min("steps").alias("steps"))
        if jump.isEmpty():
            break
        found = keep(both)
        jump = keep(jump.join(jump.select(F.col("cell").alias("to"), F.col("to").alias("further")), "to").select("cell", F.col("further").alias("to")))
        size *= 2
    return found


def profile_curvature(cells: DataFrame, size: float) -> DataFrame:
    """Curvature along the slope, by the partial quartic of a cell's eight neighbours (Zevenbergen and Thorne, 1987); null
    at edges, 0 on level ground."""
    steps = {f"z{3 * (dr + 1) + dc + 2}": (dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)}
    rows = with_neighbours(cells, steps)
    z = {k: F.col(f"z{k}") for k in range(1, 10) if k != 5} | {5: F.col("value")}
    d, e = ((z[4] + z[6]) / 2 - z[5]) / size**2, ((z[2] + z[8]) / 2 - z[5]) / size**2
    f, g, h = (-z[1] + z[3] + z[7] - z[9]) / (4 * size**2), (-z[4] + z[6]) / (2 * size), (z[2] - z[8]) / (2 * size)
    level = g * g + h * h
    curvature = F.when(level == 0, 0.0).otherwise(-2 * (d * g * g + e * h * h + f * g * h) / F.nullif(level, F.lit(0.0)))
    return rows.select("row", "col", "value", curvature.alias("curvature"))


def cropped(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int], ring: list[tuple[float, float]] | None = None) -> DataFrame:
    """Cells of a box of rows and columns (both ends included), and of these only those that lie in a ring of (col, row)
    corners if there is one, counted from the box's corner."""
    r, c = F.col("row"), F.col("col")
    out = cells.where(r.between(*rows) & c.between(*cols))
    if ring:
        out = out.where(within(c.cast("double"), r.cast("double"), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring))))
    return out.select((r - rows[0]).alias("row"), (c - cols[0]).alias("col"), "value")


def burned(segments: DataFrame, size: float = 1.0, *names: str) -> DataFrame:
    """(names, row, col): the cells of a grid that segments (x1, y1, x2, y2) touch, exactly; row 0 begins at y 0 and grows upwards. A
    segment is cut at the rows that it passes, and takes the columns between the two ends of each cut."""
    x1, y1, x2, y2 = (F.col(c) / size for c in ("x1", "y1", "x2", "y2"))
    turned = y1 > y2
    rows = segments.select(*names, F.when(turned, x2).otherwise(x1).alias("ax"), F.least(y1, y2).alias("ay"), F.when(turned, x1).otherwise(x2).alias("bx"), F.greatest(y1, y2).alias("by"))
    floor = lambda c: F.floor(c).cast("long")
    rows = rows.withColumn("row", F.explode(F.sequence(floor(F.col("ay")), floor(F.col("by")))))
    at = lambda y: F.when(y == F.col("ay"), F.col("ax")).when(y == F.col("by"), F.col("bx")).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)))
    low, high = at(F.greatest(F.col("ay"), F.col("row").cast("double"))), at(F.least(F.col("by"), F.col("row") + 1.0))
    flat = F.col("ay") == F.col("by")
    low, high = F.when(flat, F.col("ax")).otherwise(low), F.when(flat, F.col("bx")).otherwise(high)
    return rows.withColumn("col", F.explode(F.sequence(floor(F.least(low, high)), floor(F.greatest(low, high))))).select(*names, "row", "col").distinct()


def covered(polygons: DataFrame, key: str, rings: str, size: float = 1.0, touched: bool = True) -> DataFrame:
    """(key, row, col): the cells whose middle lies in a polygon (an array of rings, counted even and odd), and with touched also all
    those that a ring touches. Along the middle of each row the crossings of the rings, sorted, are the ends of spans of
    cells. Keys must be unique; null, empty and flat polygons cover no middle."""
    sides = polygons.select(F.col(key).alias("key"), F.explode(F.flatten(F.transform(F.col(rings), lambda ring: geometry.sides(ring, closed=True)))).alias("e"))
    edges = sides.select("key", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    low, high = F.least("y1", "y2") / size, F.greatest("y1", "y2") / size
    first, last = F.ceil(low - 0.5).cast("long"), F.ceil(high - 0.5).cast("long") - 1  # rows whose middle is in [low, high)
    rows = edges.withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    x = (F.col("x1") + (F.col("x2") - F.col("x1")) * ((F.col("row") + 0.5) * size - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))) / size
    spans = rows.groupBy("key", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))  # as many as edges meet a row of one polygon
    spans = spans.select("key", "row", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("i"), "xs")
    spans = spans.select("key", "row", F.ceil(F.get("xs", F.col("i")) - 0.5).cast("long").alias("c0"), (F.ceil(F.get("xs", F.col("i") + 1) - 0.5) - 1).cast("long").alias("c1")).where("c0 <= c1")
    inner = spans.select("key", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    cells = inner.union(burned(edges, size, "key")).distinct() if touched else inner
    return cells.select(F.col("key").alias(key), "row", "col")


def outlined(cells: DataFrame, label: str) -> DataFrame:
    """The edges (edge, key, ax, ay, bx, by) around the cells (row, col, label) of each label, in units of cells (a cell spans
    col to col + 1 and row to row + 1), with the inside on their left. Sides that two cells of a label share go, by counting."""
    at = lambda c, d: (F.col(c) + d).cast("double")
    corner = lambda dx, dy: F.struct(at("col", dx).alias("x"), at("row", dy).alias("y"))
    turns = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    sides = F.array(*(F.struct(corner(*p).alias("a"), corner(*q).alias("b")) for p, q in zip(turns, turns[1:])))
    rows = cells.select(F.col(label).alias("key"), F.explode(sides).alias("e"))
    low, high = F.least("e.a", "e.b"), F.greatest("e.a", "e.b")
    sole = rows.groupBy("key", low.alias("low"), high.alias("high")).agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    return sole.select(F.monotonically_increasing_id().alias("edge"), "key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def envelope(at: np.ndarray, height: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least of the parabolas height + (x - at) ** 2 at each wanted x; at and wanted ascend. Parabolas are put on a stack, from
    which those go that the next one undercuts wherever they were least."""
    tops, starts = [], []
    x, lift = at.tolist(), (height + at**2).tolist()
    for q in range(len(x)):
        start = -np.inf
        while tops:
            p = tops[-1]
            start = (lift[q] - lift[p]) / (2 * (x[q] - x[p]))
            if start > starts[-1]:
                break
            tops.pop()
            starts.pop()
            start = -np.inf
        tops.append(q)
        starts.append(start)
    own = np.array(tops)[np.searchsorted(starts, wanted, side="right") - 1]
    return height[own] + (wanted - at[own]) ** 2


def distances(cells: DataFrame, source: Column) -> DataFrame:
    """(row, col, distance): the exact straight distance, in cells, of each cell to the nearest source cell, however far; null
    if there is no source at all.

    Two passes. Along each column, windows carry the last source above and the next one below to every row of the grid, missing
    cells included, since sources are seen across them. Along each row the least of the parabolas that stand on these distances is
    taken: rows of the grid go to a task together, of about _GIVEN cells at once but at least one row. Cells must be unique.
    """
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    given = cells.select(row.alias("row"), col.alias("col"), F.when(source, row).alias("source"), F.lit(True).alias("here"))
    span = given.agg(F.min("col").alias("low"), F.max("col").alias("high")).first()
    if span.low is None:
        return given.select("row", "col", F.lit(None).cast("double").alias("distance"))
    grid = given.select("row").distinct().select("row", F.explode(F.sequence(F.lit(span.low), F.lit(span.high))).alias("col"), F.lit(None).cast("long").alias("source"), F.lit(False).alias("here"))
    cells_of = given.union(grid).groupBy("row", "col").agg(F.max("source").alias("source"), F.max("here").alias("here"))
    # Both frames grow from the front: Spark works one that shrinks towards the end out anew for each row.
    seen = lambda order: F.last("source", ignorenulls=True).over(Window.partitionBy("col").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gap = F.least(F.col("row") - seen(F.asc("row")), seen(F.desc("row")) - F.col("row"))
    both = cells_of.select("row", "col", "here", gap.cast("double").alias("gap"))

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "col"])
        at, x, here, gap = (rows[c].to_numpy() for c in ("row", "col", "here", "gap"))
        least = np.full(len(rows), np.nan)
        ends = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for i, j in zip(ends, ends[1:]):
            seen, wanted = np.flatnonzero(~np.isnan(gap[i:j])) + i, np.flatnonzero(here[i:j]) + i
            if len(seen):
                least[wanted] = np.sqrt(envelope(x[seen].astype(float), gap[seen] ** 2, x[wanted].astype(float)))
        return pd.DataFrame({"row": at[here], "col": x[here], "distance": least[here]})

    block = max(1, _GIVEN // (span.high - span.low + 1))
    found = both.groupBy(F.floor(F.col("row") / block)).applyInPandas(measured, "row long, col long, distance double")
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))
