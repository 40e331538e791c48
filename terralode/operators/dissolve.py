"""Unions of polygons by key: edges are cut where they meet, those with an inside on both sides go, and the rest is
stitched into rings. All of it is joins and grouped sums, so that a key may hold any number of polygons. Both sides of a join grow
with the table: they are merged, as written tables take little room as files and would be broadcast by that size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralode.functions import geometry
from terralode.operators.grid import traced
from terralode.operators.spatial import join_boxes


def _middle(ring: Column) -> Column:
    """The middle of a ring's first side."""
    a, b = F.get(ring, 0), F.get(ring, 1)
    return geometry.point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def holds(rings: Column, x: Column, y: Column) -> Column:
    """Whether a polygon's rings, counted even and odd, hold a point."""
    return F.size(F.filter(rings, lambda ring: geometry.within(x, y, ring))) % 2 == 1


def turned(rings: Column) -> Column:
    """Rings turned so that the inside is on their left: outer ones counter-clockwise, holes clockwise. A ring is a hole if
    an odd number of the others hold it."""

    def one(ring: Column, i: Column) -> Column:
        m = _middle(ring)
        around = F.size(F.filter(rings, lambda other, j: (i != j) & geometry.within(m["x"], m["y"], other)))
        return F.when((geometry.signed_area(ring) > 0) == (around % 2 == 0), ring).otherwise(F.reverse(ring))

    return F.transform(rings, one)


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"), F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"))


def noded(edges: DataFrame, size: float, digits: int, keep) -> DataFrame:
    """Edges (key, ax, ay, bx, by) cut at all places where edges of the same key cross or touch them; repeated ones are one.
    Edges meet on tiles of their own size. The point where two cross is worked out alike for both."""
    near = 10.0**-digits
    names = ["ax", "ay", "bx", "by"]
    edges = keep(edges.distinct().withColumn("edge", F.monotonically_increasing_id()))
    boxed = edges.withColumn("box", _box(*map(F.col, names)))
    other = boxed.select(F.col("key").alias("its_key"), F.col("edge").alias("other"), *(F.col(c).alias(f"o{c}") for c in names), F.col("box").alias("zone"))
    pairs = join_boxes(boxed, other.hint("merge"), size).where((F.col("key").eqNullSafe(F.col("its_key"))) & (F.col("edge") != F.col("other")))
    ax, ay, bx, by, ox, oy, px, py = (F.col(c) for c in (*names, "oax", "oay", "obx", "oby"))
    dx, dy, ex, ey = bx - ax, by - ay, px - ox, py - oy
    length = F.sqrt(dx * dx + dy * dy)

    def touch(x: Column, y: Column) -> Column:
        """An end of the other edge that lies on this one, but not at its ends."""
        t = ((x - ax) * dx + (y - ay) * dy) / (length * length)
        off = F.abs((x - ax) * dy - (y - ay) * dx) / length
        return F.when((off <= near) & (t * length > near) & (t * length < length - near), F.struct(t.alias("t"), x.alias("x"), y.alias("y")))

    across = dx * ey - dy * ex
    t = ((ox - ax) * ey - (oy - ay) * ex) / F.nullif(across, F.lit(0.0))
    u = ((ox - ax) * dy - (oy - ay) * dx) / F.nullif(across, F.lit(0.0))
    first = F.struct(*map(F.col, names)) < F.struct(*(F.col(f"o{c}") for c in names))
    x = F.round(F.when(first, ax + t * dx).otherwise(ox + u * ex), digits)
    y = F.round(F.when(first, ay + t * dy).otherwise(oy + u * ey), digits)
    inner = (t * length > near) & (t * length < length - near) & (u * F.sqrt(ex * ex + ey * ey) > near) & ((1 - u) * F.sqrt(ex * ex + ey * ey) > near)
    crossing = F.when(inner, F.struct(t.alias("t"), x.alias("x"), y.alias("y")))
    cuts = pairs.select("edge", F.explode(F.array_compact(F.array(touch(ox, oy), touch(px, py), crossing))).alias("cut"))
    cuts = cuts.groupBy("edge").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))  # as many as edges meet this one
    ends = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    middle = F.transform(F.coalesce("cuts", F.expr("cast(array() as array<struct<t:double,x:double,y:double>>)")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    line = edges.join(cuts.hint("merge"), "edge", "left").select("key", F.explode(geometry.sides(F.concat(ends("ax", "ay"), middle, ends("bx", "by")))).alias("e"))
    parts = line.select("key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    return parts.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).distinct()


def outlines(polygons: DataFrame, key: str, rings: str, size: float, keep, digits: int = 6) -> DataFrame:
    """The edges (edge, key, ax, ay, bx, by) around the union of each key's polygons, with the inside on their left.

    Corners are put on a grid of 10 ** -digits, and gaps and slivers of ten times that don't count. An edge that comes in both
    directions has an inside on both sides and goes; of the others those go whose right side lies in a polygon of the
    same key. size is the side of the smallest tiles, about a usual edge. Null, empty and flat polygons have no part."""
    points = F.transform(F.col(rings), lambda ring: F.transform(ring, lambda p: geometry.point(F.round(p["x"], digits), F.round(p["y"], digits))))
    shapes = polygons.where(F.size(rings) > 0).select(F.col(key).alias("key"), points.alias("rings"))
    shapes = shapes.withColumn("rings", F.filter(F.transform("rings", geometry.repaired), lambda ring: ring.isNotNull())).where(F.size("rings") > 0)
    shapes = keep(shapes.withColumn("rings", turned(F.col("rings"))))
    sides = shapes.select("key", F.explode(F.flatten(F.transform("rings", lambda ring: geometry.sides(ring, closed=True)))).alias("e"))
    edges = sides.select("key", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    cut = noded(edges, size, digits, keep)
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    forth = a < b
    both = cut.groupBy("key", F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.max(forth).alias("forth"), F.max(~forth).alias("back")).where(~(F.col("forth") & F.col("back")))
    p, q = F.when(F.col("forth"), F.col("low")).otherwise(F.col("high")), F.when(F.col("forth"), F.col("high")).otherwise(F.col("low"))
    sole = keep(both.select("key", p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")).withColumn("edge", F.monotonically_increasing_id()))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    off = 10.0 * 10.0**-digits / F.sqrt(dx * dx + dy * dy)
    beside = sole.select("edge", "key", ((F.col("ax") + F.col("bx")) / 2 + dy * off).alias("x"), ((F.col("ay") + F.col("by")) / 2 - dx * off).alias("y"))
    beside = beside.withColumn("box", _box(F.col("x"), F.col("y"), F.col("x"), F.col("y")))
    others = shapes.select(F.col("key").alias("its_key"), F.col("rings").alias("its_rings"), geometry.bbox(F.flatten("rings")).alias("zone"))
    covered = join_boxes(beside, others.hint("merge"), size).where(F.col("key").eqNullSafe(F.col("its_key")) & holds(F.col("its_rings"), F.col("x"), F.col("y")))
    return sole.join(covered.select("edge").distinct().hint("merge"), "edge", "left_anti").select("edge", "key", "ax", "ay", "bx", "by")


def stitched(edges: DataFrame, keep) -> DataFrame:
    """(key, ring, points): the rings of outlines, inside on the left. Each edge leads to the one that leaves its end; where
    several do, to that most to the left, so that parts that touch at a corner come apart. Rings get the least of their
    edges as a name, and edges their place in the ring, by doubling: rounds are the logarithm of the longest ring. Corners on a straight line go."""
    edges = keep(edges)
    after = edges.select("key", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("edge").alias("next"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    pairs = edges.withColumn("key", F.col("key")).alias("e").join(after.alias("f").hint("merge"), F.col("e.key").eqNullSafe(F.col("f.key")) & (F.col("e.bx") == F.col("f.bx")) & (F.col("e.by") == F.col("f.by")))
    way = F.atan2(F.col("e.by") - F.col("ay"), F.col("e.bx") - F.col("ax"))
    turn = F.pmod(F.atan2(F.col("cy") - F.col("e.by"), F.col("cx") - F.col("e.bx")) - way + F.lit(3.141592653589793), F.lit(2 * 3.141592653589793))
    turn = F.when(turn > 6.283185307, 0.0).otherwise(turn)  # straight back is the last choice
    link = keep(pairs.groupBy("edge").agg(F.max_by("next", turn).alias("next")))
    state = link.select("edge", "next", F.least("edge", "next").alias("low"))
    while True:
        onward = state.select(F.col("edge").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"))
        more = keep(state.join(onward.hint("merge"), "next").select("edge", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("new")))
        state = more.drop("new")
        if more.where("new").isEmpty():
            break
    flow = link.join(state.select("edge", "low").hint("merge"), "edge").select(F.col("edge").alias("cell"), F.when(F.col("edge") != F.col("low"), F.when(F.col("next") != F.col("low"), F.col("next")).otherwise(F.col("low"))).alias("next"), F.lit(None).cast("double").alias("value"))
    places = traced(flow, keep).select(F.col("cell").alias("edge"), F.col("outlet").alias("ring"), "steps")
    corner = F.struct((F.col("steps") != 0).alias("late"), (-F.col("steps")).alias("place"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    rings = edges.join(places.hint("merge"), "edge").groupBy("key", "ring").agg(F.array_sort(F.collect_list(corner)).alias("corners"))
    points = rings.select("key", "ring", F.transform("corners", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("points"))
    n = F.size("points")
    bent = F.filter("points", lambda p, i: F.abs(geometry.left_of(F.get("points", F.pmod(i - 1, n)), p, F.get("points", F.pmod(i + 1, n)))) > 1e-9)
    return points.withColumn("points", bent)


def dissolved(polygons: DataFrame, key: str, rings: str, size: float, keep, digits: int = 6) -> DataFrame:
    """(key, ring, points) around the union of each key's polygons: outer rings turn counter-clockwise, holes clockwise."""
    return stitched(outlines(polygons, key, rings, size, keep, digits), keep).withColumnRenamed("key", key)


def parts(rings: DataFrame, key: str, size: float) -> DataFrame:
    """(key, ring, area) of each part of a dissolved table: an outer ring's area without the holes that lie in it. A hole
    belongs to the least outer ring that holds it."""
    area = geometry.signed_area(F.col("points"))
    rows = rings.select(F.col(key).alias("key"), "ring", "points", area.alias("area"), geometry.bbox(F.col("points")).alias("box"))
    outer, holes = rows.where("area > 0"), rows.where("area < 0")
    m = _middle(F.col("points"))
    around = outer.select(F.col("key").alias("its_key"), F.col("ring").alias("its_ring"), F.col("points").alias("its_points"), F.col("area").alias("its_area"), F.col("box").alias("zone"))
    held = join_boxes(holes.withColumn("m", m), around.hint("merge"), size).where(F.col("key").eqNullSafe(F.col("its_key")) & geometry.within(F.col("m.x"), F.col("m.y"), F.col("its_points")))
    gone = held.groupBy("ring").agg(F.min_by("its_ring", "its_area").alias("its_ring"), F.first("area").alias("area")).groupBy(F.col("its_ring").alias("ring")).agg(F.sum("area").alias("less"))
    return outer.join(gone.hint("merge"), "ring", "left").select(F.col("key").alias(key), "ring", (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"))
