"""Spatial joins by tiles: boxes and points meet on the integer tiles they touch, and the exact test follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.functions import geometry


def _tiles(df: DataFrame, min_x: Column, min_y: Column, max_x: Column, max_y: Column, size: float) -> DataFrame:
    cell = lambda c: F.floor(c / size).cast("long")
    return df.withColumn("tx", F.explode(F.sequence(cell(min_x), cell(max_x)))).withColumn("ty", F.explode(F.sequence(cell(min_y), cell(max_y))))


def _levelled(df: DataFrame, box: Column, size: float, levels: list[int], name: str) -> DataFrame:
    """Rows on the tiles of their own level, on which they touch four at most, and of all coarser ones in use."""
    side = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    rows = df.withColumn(name, _level(side, size)).withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("level") >= F.col(name))
    width = size * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(c / width).cast("long")
    rows = rows.withColumn("tx", F.explode(F.sequence(cell(box["min_x"]), cell(box["max_x"]))))
    return rows.withColumn("ty", F.explode(F.sequence(cell(box["min_y"]), cell(box["max_y"]))))


def _level(side: Column, size: float) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(side / size, F.lit(1e-9)))), F.lit(0)).cast("int")


def join_boxes(left: DataFrame, right: DataFrame, size: float, l_box: str = "box", r_box: str = "zone") -> DataFrame:
    """Pairs of rows whose boxes, structs (min_x, min_y, max_x, max_y), overlap or touch. A box lies on the tiles of a
    level whose tiles are as large as it, so that a large one takes four tiles and not thousands; a pair meets on the
    level of the larger box, and comes once: from the tile of its overlap's lower corner, which needs no distinct. size
    is the side of the smallest tiles. The levels in use, some dozens at most, are asked for first."""
    a, b = F.col(l_box), F.col(r_box)
    sides = lambda df, x: df.select(_level(F.greatest(x["max_x"] - x["min_x"], x["max_y"] - x["min_y"]), size).alias("level"))
    levels = sorted(r.level for r in sides(left, a).union(sides(right, b)).where("level is not null").distinct().collect()) or [0]
    one, two = _levelled(left, a, size, levels, "l_level"), _levelled(right, b, size, levels, "r_level")
    meet = (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])
    width = size * F.pow(F.lit(2.0), F.col("level"))
    first = (F.floor(F.greatest(a["min_x"], b["min_x"]) / width) == F.col("tx")) & (F.floor(F.greatest(a["min_y"], b["min_y"]) / width) == F.col("ty"))
    own = F.col("level") == F.greatest("l_level", "r_level")
    return one.join(two, ["level", "tx", "ty"]).where(own & meet & first).drop("level", "tx", "ty", "l_level", "r_level")


def overlap_area(a: Column, b: Column) -> Column:
    side = lambda low, high: F.greatest(F.least(a[high], b[high]) - F.greatest(a[low], b[low]), F.lit(0.0))
    return side("min_x", "max_x") * side("min_y", "max_y")


def points_in_boxes(points: DataFrame, zones: DataFrame, size: float, x: str = "x", y: str = "y", box: str = "zone") -> DataFrame:
    """Points with the zones, half-open boxes, that hold them."""
    z = F.col(box)
    tiled = _tiles(zones, z["min_x"], z["min_y"], z["max_x"], z["max_y"], size)
    placed = points.withColumn("tx", F.floor(F.col(x) / size).cast("long")).withColumn("ty", F.floor(F.col(y) / size).cast("long"))
    held = (F.col(x) >= z["min_x"]) & (F.col(x) < z["max_x"]) & (F.col(y) >= z["min_y"]) & (F.col(y) < z["max_y"])
    return placed.join(tiled, ["tx", "ty"]).where(held).drop("tx", "ty")


#: Tiles of a level along the side of one of the next.
_WIDER = 4
#: Different places on a tile from which on smaller tiles are taken, and how often their side is halved at most.
_CROWD, _HALVINGS = 256, 24


def _thinned(places: DataFrame, size: float) -> float:
    """size, halved until no tile holds more than _CROWD different places (x, y), so that what a point looks at doesn't
    grow with the table. Each halving counts the places of the tiles that are still too full."""
    own = lambda c: F.floor(F.col(c) / size).cast("long")
    for _ in range(_HALVINGS):
        most = places.groupBy(own("x"), own("y")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= _CROWD:
            break
        size /= 2
    return size


def _closest(left: DataFrame, pieces: DataFrame, l_id: str, r_id: str, size: float, keep) -> DataFrame:
    """(l_id, r_id, distance): the nearest piece (r_id, ax, ay, bx, by), at most `size` long, of each point, ties to the smaller
    id; null if there is none at all. Exact, at any distance.

    A point first looks at its own tile of width `size` and the eight around it: what it finds within `size` is nearer than all it
    doesn't see. The others descend a pyramid of occupied tiles from its top: on each level tiles are opened into those
    that they hold, and only those whose border is no farther than the nearest known piece of any (each tile names one) stay.
    So a lonely point compares itself with the pieces of some tiles, not with all of a wide one.

    Of pieces at one place only the least id can be named, and points at one place have the same answer: each place is looked
    at once, however many rows lie there.
    """
    pieces = pieces.groupBy("ax", "ay", "bx", "by").agg(F.min("r_id").alias("r_id"))
    points = left.select(F.col(l_id).alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    here = keep(points.where("x is not null and y is not null").select("x", "y").distinct().withColumn("l_id", F.monotonically_increasing_id()))
    low = lambda a, b: F.floor(F.least(a, b) / size).cast("long")
    high = lambda a, b: F.floor(F.greatest(a, b) / size).cast("long")
    tiled = pieces.withColumn("tx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("ty", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))
    tiled = keep(tiled)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    far = lambda x, y: F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
    distance = far(F.col("ax") + t * dx, F.col("ay") + t * dy)

    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    own = lambda c: F.floor(F.col(c) / size).cast("long")
    looks = here.withColumn("n", F.explode(around)).select("l_id", "x", "y", (own("x") + F.col("n.i")).alias("tx"), (own("y") + F.col("n.j")).alias("ty"))
    best = F.min(F.struct(distance.alias("distance"), "r_id")).alias("best")
    first = keep(here.join(looks.join(tiled, ["tx", "ty"]).groupBy("l_id").agg(best), "l_id", "left"))
    sure = F.coalesce(F.col("best.distance") <= size, F.lit(False))
    lonely = first.where(~sure).select("l_id", "x", "y", F.coalesce("best.distance", F.lit(float("inf"))).alias("most"))

    occupied = keep(tiled.groupBy("tx", "ty").agg(F.min(F.struct("ax", "ay")).alias("one")))
    edge = occupied.agg(F.min("tx").alias("x0"), F.max("tx").alias("x1"), F.min("ty").alias("y0"), F.max("ty").alias("y1")).first()
    levels = 0
    while edge.x0 is not None and max(edge.x1 - edge.x0, edge.y1 - edge.y0) >= _WIDER**levels:
        levels += 1

    def level(k: int) -> DataFrame:
        up = lambda c: F.floor(F.col(c) / _WIDER**k).cast("long")
        return occupied.groupBy(up("tx").alias("tx"), up("ty").alias("ty")).agg(F.min("one").alias("one"))

    def kept_tiles(rows: DataFrame, k: int) -> DataFrame:
        width = size * _WIDER**k
        off = lambda c, at: F.greatest(at * width - F.col(c), F.col(c) - (at + 1) * width, F.lit(0.0))
        least = F.sqrt(F.pow(off("x", F.col("tx")), 2) + F.pow(off("y", F.col("ty")), 2))
        most = F.least("most", F.min(far(F.col("one.ax"), F.col("one.ay"))).over(Window.partitionBy("l_id")))
        return rows.withColumn("most", most).where(least <= F.col("most") * (1 + 1e-12)).select("l_id", "x", "y", "most", "tx", "ty")

    tiles = kept_tiles(lonely.crossJoin(F.broadcast(level(levels))), levels)  # four tiles at most
    for k in reversed(range(levels)):
        parent = lambda c: F.floor(F.col(c) / _WIDER).cast("long")
        below = level(k).select(parent("tx").alias("px"), parent("ty").alias("py"), F.col("tx").alias("cx"), F.col("ty").alias("cy"), "one")
        opened = tiles.withColumnsRenamed({"tx": "px", "ty": "py"}).join(below, ["px", "py"])
        tiles = kept_tiles(opened.select("l_id", "x", "y", "most", F.col("cx").alias("tx"), F.col("cy").alias("ty"), "one"), k)
    rest = lonely.select("l_id").join(tiles.join(tiled, ["tx", "ty"]).groupBy("l_id").agg(best), "l_id", "left")
    both = keep(here.join(first.where(sure).select("l_id", "best").union(rest.select("l_id", "best")), "l_id").select("x", "y", "best"))
    return points.join(both, ["x", "y"], "left").select(F.col("point").alias(l_id), F.col("best.r_id").alias(r_id), F.col("best.distance").alias("distance"))


def nearest(left: DataFrame, right: DataFrame, l_id: str, r_id: str, size: float, keep) -> DataFrame:
    """For each left point (l_id, x, y; unique ids) the nearest right point (r_id, x, y) at any distance, ties to the smaller
    id: (l_id, r_id, distance); null for a point without coordinates, and if there is no right point. size is the side of the
    tiles, about the usual distance, which crowded ones make smaller; keep writes a table away and reads it back."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    there = right.where(x.isNotNull() & y.isNotNull()).select(F.col(r_id).alias("r_id"), x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"))
    size = _thinned(keep(there.select(F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()), size)
    return _closest(left, there, l_id, r_id, size, keep)


def nearest_lines(points: DataFrame, lines: DataFrame, l_id: str, r_id: str, size: float, keep) -> DataFrame:
    """For each point (l_id, x, y; unique ids) the nearest line (r_id, line) at any distance, as nearest has it. Segments are
    laid on tiles in pieces of at most `size`; a line of one point is that point, null and empty ones are none."""
    line = F.col("line")
    sides = F.when(F.size(line) == 1, F.array(F.struct(F.get(line, 0).alias("a"), F.get(line, 0).alias("b")))).otherwise(geometry.sides(line))
    rows = lines.where(F.size(line) > 0).select(F.col(r_id).alias("r_id"), F.explode(sides).alias("e"))
    size = _thinned(keep(rows.select("e.a.x", "e.a.y").distinct()), size)
    n = F.greatest(F.ceil(geometry.planar(F.col("e.a"), F.col("e.b")) / size), F.lit(1))
    rows = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda c, k: F.when(k == F.col("n"), F.col(f"e.b.{c}")).otherwise(F.col(f"e.a.{c}") + (F.col(f"e.b.{c}") - F.col(f"e.a.{c}")) * k / F.col("n"))
    k = F.col("k")
    return _closest(points, rows.select("r_id", at("x", k).alias("ax"), at("y", k).alias("ay"), at("x", k + 1).alias("bx"), at("y", k + 1).alias("by")), l_id, r_id, size, keep)


def random_points(zones: DataFrame, key: str, ring: str, n: int, seed: int, times: int = 3) -> DataFrame:
    """(key, k, x, y): up to n points in each ring, the first of times * n that a hash of seed, key and number places in its
    box; the same for the same seed, whatever the partitions."""
    box = geometry.bbox(F.col(ring))
    tried = zones.withColumn("box", box).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times * n - 1))))
    share = lambda axis: F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("k"), F.lit(axis)), F.lit(1 << 30)) / float(1 << 30)
    x = F.col("box.min_x") + share("x") * (F.col("box.max_x") - F.col("box.min_x"))
    y = F.col("box.min_y") + share("y") * (F.col("box.max_y") - F.col("box.min_y"))
    held = tried.select(key, "k", x.alias("x"), y.alias("y"), ring).where(geometry.within(F.col("x"), F.col("y"), F.col(ring)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("k"))
    return held.withColumn("k", first).where(F.col("k") <= n).select(key, "k", "x", "y")
