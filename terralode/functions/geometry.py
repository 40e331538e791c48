"""Column functions on geometry. A point is a struct(x, y); a line or ring is an array of points."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres (a fixed value).
EARTH = 6_371_008.8


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out a single time: named in an expression several times, and in lambdas for each
    element, it would be worked out at each place."""
    return F.get(F.transform(F.array(value), use), 0)


def sides(points: Column, closed: bool = False) -> Column:
    """Neighbouring points as structs (a, b)."""
    n = F.size(points)
    after = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1) if closed else F.slice(points, 1, 0))
    count = n if closed else F.greatest(n - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, count), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def haversine(a: Column, b: Column) -> Column:
    """Metres on a sphere between points in degrees."""
    la, lb = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def line_length(points: Column, distance=planar) -> Column:
    """0 for one point."""
    return F.aggregate(sides(points), F.lit(0.0), lambda s, e: s + distance(e["a"], e["b"]))


def ring_area(points: Column) -> Column:
    """By the shoelace formula, whichever way the ring turns."""
    twice = F.aggregate(sides(points, closed=True), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(twice) / 2


def within(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the parity of the sides that a ray to the right crosses."""
    crossed = F.filter(
        sides(ring, closed=True),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def _half_plane(ring: Column, axis: str, bound: Column, above: bool) -> Column:
    """The part of a ring on one side of an axis-parallel line (a step of Sutherland and Hodgman's clipping)."""
    other = "y" if axis == "x" else "x"
    inside = (lambda p: p[axis] >= bound) if above else (lambda p: p[axis] <= bound)

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (bound - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        v = a[other] + t * (b[other] - a[other])
        crossing = point(bound, v) if axis == "x" else point(v, bound)
        return F.concat(F.when(inside(a) != inside(b), F.array(crossing)).otherwise(F.slice(F.array(b), 1, 0)), F.when(inside(b), F.array(b)).otherwise(F.slice(F.array(b), 1, 0)))

    return F.flatten(F.transform(sides(ring, closed=True), cut))


def clip_to_box(ring: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A ring's part in a box; an empty array if there is none."""
    for axis, bound, above in (("x", min_x, True), ("x", max_x, False), ("y", min_y, True), ("y", max_y, False)):
        ring = _half_plane(ring, axis, bound, above)
    return ring


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def wkt_line(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))


def middle(points: Column, distance=planar) -> Column:
    """The point half way along a line; of one point, that point; null of none."""
    half = line_length(points, distance) / 2

    def step(state: Column, e: Column) -> Column:
        d = distance(e["a"], e["b"])
        here = state["at"].isNull() & (state["run"] + d >= half)
        t = F.when(d == 0, 0.0).otherwise((half - state["run"]) / F.nullif(d, F.lit(0.0)))
        at = point(e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * t, e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * t)
        return F.struct((state["run"] + d).alias("run"), F.when(here, at).otherwise(state["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    last = F.get(points, F.size(points) - 1)
    return F.coalesce(F.aggregate(sides(points), start, step)["at"], point(last["x"], last["y"]))


def left_of(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies to the left of the way from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def signed_area(ring: Column) -> Column:
    """Positive for a ring that turns counter-clockwise."""
    return once(ring, lambda r: F.aggregate(sides(r, closed=True), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def repaired(ring: Column) -> Column:
    """A ring without repeated corners in a row (the closing one included) that turns counter-clockwise; null if it has
    fewer than three corners or no area."""

    def turned(kept: Column) -> Column:
        one = F.struct(kept.alias("ring"), signed_area(kept).alias("area"))
        return once(one, lambda k: F.when((F.size(k["ring"]) >= 3) & (k["area"] != 0), F.when(k["area"] < 0, F.reverse(k["ring"])).otherwise(k["ring"])))

    return once(ring, lambda r: once(F.filter(r, lambda p, i: p != F.get(r, F.pmod(i + 1, F.size(r)))), turned))


def clip_to_convex(ring: Column, zone: Column) -> Column:
    """A ring's part in a convex ring that turns counter-clockwise; an empty array if there is none. Parts of a ring that
    the zone cuts in two are joined along the zone's side, which leaves areas right."""

    def cut(state: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]

        def one(e: Column) -> Column:
            p, q = e["a"], e["b"]
            dp, dq = left_of(a, b, p), left_of(a, b, q)
            t = dp / F.nullif(dp - dq, F.lit(0.0))
            crossing = point(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"]))
            none = F.slice(F.array(q), 1, 0)
            return F.concat(F.when((dp >= 0) != (dq >= 0), F.array(crossing)).otherwise(none), F.when(dq >= 0, F.array(q)).otherwise(none))

        return F.flatten(F.transform(sides(state, closed=True), one))

    return F.aggregate(sides(zone, closed=True), ring, cut)


def part_in_convex(e: Column, zone: Column) -> Column:
    """The part of a segment (a, b) in a convex ring that turns counter-clockwise, as a struct (t0, t1) of shares of its
    length; t0 >= t1 where it lies outside."""
    p, q = e["a"], e["b"]

    def narrow(state: Column, side: Column) -> Column:
        dp, dq = left_of(side["a"], side["b"], p), left_of(side["a"], side["b"], q)
        t = dp / F.nullif(dp - dq, F.lit(0.0))
        enters, leaves, out = (dp < 0) & (dq >= 0), (dp >= 0) & (dq < 0), (dp < 0) & (dq < 0)
        low = F.when(out, F.lit(2.0)).when(enters, F.greatest(state["t0"], t)).otherwise(state["t0"])
        high = F.when(leaves, F.least(state["t1"], t)).otherwise(state["t1"])
        return F.struct(low.alias("t0"), high.alias("t1"))

    return F.aggregate(sides(zone, closed=True), F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")), narrow)


def length_in_convex(line: Column, zone: Column, distance=planar) -> Column:
    """The length of a line's parts in a convex ring that turns counter-clockwise."""

    def part(s: Column, e: Column) -> Column:
        t = part_in_convex(e, zone)
        return s + distance(e["a"], e["b"]) * F.greatest(t["t1"] - t["t0"], F.lit(0.0))

    return F.aggregate(sides(line), F.lit(0.0), part)


def centroid(ring: Column) -> Column:
    """The centre of a ring's area."""

    def whole(r: Column) -> Column:
        sums = F.aggregate(
            sides(r, closed=True), point(F.lit(0.0), F.lit(0.0)),
            lambda s, e: point(s["x"] + (e["a"]["x"] + e["b"]["x"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]), s["y"] + (e["a"]["y"] + e["b"]["y"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])),
        )
        both = F.struct(sums.alias("sums"), F.nullif(signed_area(r) * 6, F.lit(0.0)).alias("six"))
        return once(both, lambda b: point(b["sums"]["x"] / b["six"], b["sums"]["y"] / b["six"]))

    return once(ring, whole)


def nearest_on(p: Column, line: Column) -> Column:
    """The point of a line that is nearest to p, as a struct (d, x, y) with its distance; null of a line without segments."""

    def foot(p: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.least(F.greatest(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        at = once(t, lambda t: F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y")))
        return once(at, lambda f: F.struct(F.sqrt(F.pow(p["x"] - f["x"], F.lit(2)) + F.pow(p["y"] - f["y"], F.lit(2))).alias("d"), f["x"].alias("x"), f["y"].alias("y")))

    return once(p, lambda p: F.array_min(F.transform(sides(line), lambda e: foot(p, e))))


def simplified(points: Column, tolerance: float, least: int = 0) -> Column:
    """A line with no more corners than it needs to stay within a tolerance (Douglas and Peucker); lines of fewer than
    `least` corners stay as they are. A small loop in Python for each line, over batches."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def simplify(lines: pd.Series) -> pd.Series:
        def one(line) -> list | None:
            if line is None or len(line) < max(3, least):
                return line
            at = [(p["x"], p["y"]) for p in line]
            keep, todo = {0, len(at) - 1}, [(0, len(at) - 1)]
            while todo:
                i, j = todo.pop()
                (ax, ay), (bx, by) = at[i], at[j]
                length = math.hypot(bx - ax, by - ay)
                far, k = -1.0, -1
                for m in range(i + 1, j):
                    x, y = at[m]
                    d = abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else math.hypot(x - ax, y - ay)
                    if d > far:
                        far, k = d, m
                if far > tolerance:
                    keep.add(k)
                    todo += [(i, k), (k, j)]
            return [line[i] for i in sorted(keep)]

        return lines.map(one)

    return simplify(points)


def tile_bounds(x: Column, y: Column, z: Column) -> Column:
    """The web-Mercator extent of a map tile."""
    half = 20_037_508.342789244
    span = 2 * half / F.pow(F.lit(2.0), z)
    left, top = x * span - half, half - y * span
    return F.struct(left.alias("min_x"), (top - span).alias("min_y"), (left + span).alias("max_x"), top.alias("max_y"))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["max_x"] > b["min_x"]) & (a["min_x"] < b["max_x"]) & (a["max_y"] > b["min_y"]) & (a["min_y"] < b["max_y"])


def wkt_polygon(ring: Column) -> Column:
    """A ring as WKT, closed."""
    pairs = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    return F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))"))


def from_wkt(c: Column) -> Column:
    """The points of a WKT point, line or polygon without holes; null for anything else."""
    body = F.regexp_extract(c, r"^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*$", 1)
    pairs = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda t: point(F.get(F.split(t, r"\s+"), 0).try_cast("double"), F.get(F.split(t, r"\s+"), 1).try_cast("double")))
    return F.when(body != "", pairs)
