"""Overlays of any polygons: concave, with holes, of several parts. A polygon is an array of rings, of which those at an odd
depth are holes; rings don't cross themselves or one another, and may turn either way.

Edges are cut at vertical strips, so that a polygon of any size meets only what lies in the same strip; there a sweep from
slab to slab, between which no edge begins, ends or crosses, tells what lies inside by counting the edges below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralode.functions import geometry
from terralode.operators.spatial import join_boxes

#: Numbers of a table of edges by slabs that are worked on at once.
_TABLE = 1 << 20
#: Corners nearer than this are one; rings of less area are none.
_NEAR = 1e-9


def _sides(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda ring: geometry.sides(ring, closed=True)))


def _strips(df: DataFrame, key: str, sides: Column, width: float, upright: bool) -> DataFrame:
    """(key, strip, box, edges): the parts of sides in each vertical strip, from left to right; upright ones only if asked for."""
    a, b = F.col("e.a"), F.col("e.b")
    turned = F.col("e.a.x") > F.col("e.b.x")
    p, q = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
    rows = df.select(key, F.explode(sides).alias("e")).select(key, *(c.alias(n) for n, c in (("x1", p["x"]), ("y1", p["y"]), ("x2", q["x"]), ("y2", q["y"]))))
    rows = rows.where((F.col("x1") < F.col("x2")) | (F.lit(upright) & (F.col("y1") != F.col("y2"))))
    cell = lambda c: F.floor(c / width).cast("long")
    rows = rows.withColumn("strip", F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2")))))
    left, right = F.greatest(F.col("x1"), F.col("strip") * width), F.least(F.col("x2"), (F.col("strip") + 1) * width)
    at = lambda x, end: F.when(x == F.col(f"x{end}"), F.col(f"y{end}")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    cut = rows.select(key, "strip", F.struct(left.alias("x1"), at(left, 1).alias("y1"), right.alias("x2"), F.when(F.col("x1") == F.col("x2"), F.col("y2")).otherwise(at(right, 2)).alias("y2")).alias("c"))
    cut = cut.where((F.col("c.x1") < F.col("c.x2")) | F.lit(upright))
    low, high = F.least("c.y1", "c.y2"), F.greatest("c.y1", "c.y2")
    box = F.struct(F.min("c.x1").alias("min_x"), F.min(low).alias("min_y"), F.max("c.x2").alias("max_x"), F.max(high).alias("max_y"))
    return cut.groupBy(key, "strip").agg(box.alias("box"), F.collect_list("c").alias("edges"))


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places x where edges of a, (x1, y1, x2, y2) from left to right, cross edges of b."""
    sa, sb = (a[:, 3] - a[:, 1]) / (a[:, 2] - a[:, 0]), (b[:, 3] - b[:, 1]) / (b[:, 2] - b[:, 0])
    out = []
    for i in range(0, len(a), max(1, _TABLE // max(len(b), 1))):
        part = slice(i, i + max(1, _TABLE // max(len(b), 1)))
        steeper = sa[part, None] - sb[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = ((b[:, 1] - sb * b[:, 0])[None, :] - (a[part, 1] - sa[part] * a[part, 0])[:, None]) / steeper
        low, high = np.maximum(a[part, 0][:, None], b[None, :, 0]), np.minimum(a[part, 2][:, None], b[None, :, 2])
        out.append(x[(steeper != 0) & (x > low) & (x < high)])
    return np.concatenate(out) if out else np.zeros(0)


def slabs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Sweeps over what a spans: yields (left, right, edges, heights, in_a, in_b) for groups of slabs; edges are those of a and
    then b, for each slab by height, and in_a and in_b tell where each polygon is entered between an edge and the next."""
    low, high = a[:, 0].min(), a[:, 2].max()
    b = b[(b[:, 2] > low) & (b[:, 0] < high)]
    both, ours = np.concatenate([a, b]), np.arange(len(a) + len(b)) < len(a)
    xs = np.unique(np.concatenate([both[:, 0], both[:, 2], crossings(a, b)]))
    xs = xs[(xs >= low) & (xs <= high)]
    slope = (both[:, 3] - both[:, 1]) / (both[:, 2] - both[:, 0])
    step = max(1, _TABLE // len(both))
    for i in range(0, len(xs) - 1, step):
        left, right = xs[i : i + step + 1][:-1], xs[i + 1 : i + step + 1]
        middle = (left + right) / 2
        here = (both[:, 0, None] <= left) & (both[:, 2, None] >= right)
        height = np.where(here, both[:, 1, None] + (middle - both[:, 0, None]) * slope[:, None], np.inf)
        order = np.argsort(height, axis=0, kind="stable")
        height, mine, real = np.take_along_axis(height, order, 0), ours[order], np.take_along_axis(here, order, 0)
        yield left, right, order, height, np.cumsum(mine & real, 0) % 2 == 1, np.cumsum(~mine & real, 0) % 2 == 1


def common_area(a: np.ndarray, b: np.ndarray) -> float:
    """The area that two polygons' edges, from left to right and none upright, have in common."""
    area = 0.0
    for left, right, _, height, in_a, in_b in slabs(a, b):
        both = in_a[:-1] & in_b[:-1]
        high = np.where(both, height[1:], 0.0)
        area += float(((high - np.where(both, height[:-1], 0.0)).sum(0) * (right - left)).sum())
    return area


def length_inside(lines: np.ndarray, b: np.ndarray) -> float:
    """The length of segments within a polygon's edges; lines may be upright."""
    total = 0.0
    for x1, y1, x2, y2 in lines:
        near = b[(b[:, 2] >= x1) & (b[:, 0] <= x2)]
        if not len(near):
            continue
        dx, dy = x2 - x1, y2 - y1
        ex, ey = near[:, 2] - near[:, 0], near[:, 3] - near[:, 1]
        across = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((near[:, 0] - x1) * ey - (near[:, 1] - y1) * ex) / across
            ends = (np.concatenate([near[:, 0], near[:, 2]]) - x1) / dx if dx else np.zeros(0)
        ts = np.concatenate([t[across != 0], ends])
        ts = np.unique(np.concatenate([[0.0, 1.0], ts[(ts > 0) & (ts < 1)]]))
        middle = (ts[1:] + ts[:-1]) / 2
        mx, my = x1 + middle * dx, y1 + middle * dy
        under = (near[:, 0, None] <= mx) & (mx < near[:, 2, None]) & (near[:, 1, None] + (mx - near[:, 0, None]) * (ey / ex)[:, None] < my)
        total += float((ts[1:] - ts[:-1])[under.sum(0) % 2 == 1].sum()) * float(np.hypot(dx, dy))
    return total


def common_rings(a: np.ndarray, b: np.ndarray) -> list[list[tuple[float, float]]]:
    """The rings around what two polygons have in common: outer ones turn counter-clockwise, holes clockwise."""
    links: dict[tuple, list[tuple]] = {}
    key = lambda p: (round(p[0] / _NEAR), round(p[1] / _NEAR))

    def link(p: tuple, q: tuple) -> None:
        if key(p) != key(q):
            links.setdefault(key(p), []).append((p, q))

    both = np.concatenate([a, b[(b[:, 2] > a[:, 0].min()) & (b[:, 0] < a[:, 2].max())]])
    at = lambda e, x: e[3] if x == e[2] else e[1] + (x - e[0]) * (e[3] - e[1]) / (e[2] - e[0])
    before, border = [], None
    for lefts, rights, order, _, in_a, in_b in slabs(a, b):
        for s, (left, right) in enumerate(zip(lefts.tolist(), rights.tolist(), strict=True)):
            spans = [(both[order[i, s]], both[order[i + 1, s]]) for i in np.flatnonzero(in_a[:-1, s] & in_b[:-1, s])]
            uprights(link, left, before, [(at(low, left), at(high, left)) for low, high in spans])
            for low, high in spans:
                link((left, at(low, left)), (right, at(low, right)))
                link((right, at(high, right)), (left, at(high, left)))
            before, border = [(at(low, right), at(high, right)) for low, high in spans], right
    if border is not None:
        uprights(link, border, before, [])
    return stitched(links, key)


def uprights(link, x: float, west: list[tuple[float, float]], east: list[tuple[float, float]]) -> None:
    """Links along an upright line where only one side is within: upwards where that is the west."""
    ys = sorted({y for span in (*west, *east) for y in span})
    for low, high in zip(ys, ys[1:]):
        middle = (low + high) / 2
        w, e = (any(p <= middle <= q for p, q in spans) for spans in (west, east))
        if w and not e:
            link((x, low), (x, high))
        elif e and not w:
            link((x, high), (x, low))


def stitched(links: dict[tuple, list[tuple]], key) -> list[list[tuple[float, float]]]:
    """Rings of links that lead from corner to corner; where several leave a corner, the one most to the left is taken, where
    the inside is, so that rings that touch at a corner come apart. Corners on a straight line go."""
    rings = []
    while links:
        start = min(links)
        p, q = links[start].pop()
        if not links[start]:
            del links[start]
        ring = [p]
        while key(q) != start:
            choices = links[key(q)]
            way = np.arctan2(q[1] - ring[-1][1], q[0] - ring[-1][0])
            turn = [(np.arctan2(b[1] - a[1], b[0] - a[0]) - way + np.pi) % (2 * np.pi) for a, b in choices]
            k = int(np.argmax(turn))
            ring.append(q)
            q = choices.pop(k)[1]
            if not choices:
                del links[key(ring[-1])]
        slim = [c for i, c in enumerate(ring) if abs((c[0] - ring[i - 1][0]) * (ring[(i + 1) % len(ring)][1] - c[1]) - (c[1] - ring[i - 1][1]) * (ring[(i + 1) % len(ring)][0] - c[0])) > _NEAR]
        if len(slim) > 2 and abs(sum(c[0] * d[1] - d[0] * c[1] for c, d in zip(slim, slim[1:] + slim[:1], strict=True))) > _NEAR:
            rings.append(slim)
    return rings


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values
    table = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
    return [table[i:j] for i, j in zip(ends, ends[1:])]


def _measured(kernel, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            one, two = _arrays(columns[-2]), _arrays(columns[-1])
            found = [kernel(a, b) for a, b in zip(one, two, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(found, pa.float64())], names=[*names, "measure"])

    return run


def _overlaid(one: DataFrame, two: DataFrame, l_id: str, r_id: str, width: float, kernel) -> DataFrame:
    """(l_id, r_id, measure): pieces in the same strip whose boxes meet, measured and summed for each pair."""
    slim = lambda df, key, side: df.select(F.col(key).alias(f"{side}_id"), F.col("strip").alias(f"{side}_strip"), F.col("box").alias(f"{side}_box"), F.col("edges").alias(f"{side}_edges"))
    pairs = join_boxes(slim(one, l_id, "l"), slim(two, r_id, "r"), width, "l_box", "r_box").where("l_strip = r_strip").select("l_id", "r_id", "l_edges", "r_edges")
    schema = T.StructType([pairs.schema["l_id"], pairs.schema["r_id"], T.StructField("measure", T.DoubleType())])
    found = pairs.mapInArrow(_measured(kernel, ["l_id", "r_id"]), schema).groupBy("l_id", "r_id").agg(F.sum("measure").alias("measure"))
    return found.select(F.col("l_id").alias(l_id), F.col("r_id").alias(r_id), "measure")


def overlay_areas(parcels: DataFrame, zones: DataFrame, l_id: str, r_id: str, width: float, rings: str = "rings", zone: str = "zone_rings") -> DataFrame:
    """(l_id, r_id, area) of polygons (rings) and zones (zone_rings) that have an area in common. width is that of a strip: about
    that of the smaller polygons. Null, empty and flat polygons have none. Ids must be unique."""
    one = _strips(parcels, l_id, _sides(F.col(rings)), width, False)
    two = _strips(zones, r_id, _sides(F.col(zone)), width, False)
    return _overlaid(one, two, l_id, r_id, width, common_area).where("measure > 0").withColumnRenamed("measure", "area")


def overlay_lengths(lines: DataFrame, zones: DataFrame, l_id: str, r_id: str, width: float, line: str = "line", zone: str = "zone_rings") -> DataFrame:
    """(l_id, r_id, length) of lines and the zones in which parts of them lie."""
    one = _strips(lines, l_id, geometry.sides(F.col(line)), width, True)
    two = _strips(zones, r_id, _sides(F.col(zone)), width, False)
    return _overlaid(one, two, l_id, r_id, width, length_inside).where("measure > 0").withColumnRenamed("measure", "length")


def _edges(rings: list | None) -> np.ndarray:
    sides = [(p["x"], p["y"], q["x"], q["y"]) for ring in rings or [] for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p["x"] != q["x"]]
    return np.array([s if s[0] < s[2] else (*s[2:], *s[:2]) for s in sides], float).reshape(-1, 4)


def intersected(pairs: DataFrame, rings: str, zone: str, name: str = "common") -> DataFrame:
    """Adds the rings of what a row's two polygons have in common, an empty array if that is nothing, and whether that is all
    of the first (whole); cut parts come as rings of their own. A row's two polygons must fit into a task."""
    points = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
    one, two = pairs.columns.index(rings), pairs.columns.index(zone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            out, whole = [], []
            for a, b in zip(batch.column(one).to_pylist(), batch.column(two).to_pylist(), strict=True):
                a, b = _edges(a), _edges(b)
                met = len(a) and len(b)
                out.append([[{"x": x, "y": y} for x, y in ring] for ring in (common_rings(a, b) if met else [])])
                whole.append(bool(met and common_area(a, a) - common_area(a, b) <= _NEAR * common_area(a, a)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind), pa.array(whole, pa.bool_())], names=[*batch.schema.names, name, "whole"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, points), T.StructField("whole", T.BooleanType())]))


def clipped(rows: DataFrame, zone: DataFrame, key: str, rings: str = "rings", zone_rings: str = "zone_rings") -> DataFrame:
    """Polygons cut to a zone, a table of one row: (columns, common, whole), whole where they lie in it as they were. Null
    polygons and those of which nothing is in the zone are left out."""
    boxed = rows.where(F.col(rings).isNotNull()).withColumn("its_box", geometry.bbox(F.flatten(rings)))
    z = zone.select(F.col(zone_rings).alias("its_zone")).withColumn("zone_box", geometry.bbox(F.flatten("its_zone")))
    b, o = F.col("its_box"), F.col("zone_box")
    near = boxed.join(F.broadcast(z), (b["min_x"] <= o["max_x"]) & (o["min_x"] <= b["max_x"]) & (b["min_y"] <= o["max_y"]) & (o["min_y"] <= b["max_y"]))
    out = intersected(near, rings, "its_zone").where(F.size("common") > 0)
    return out.drop("its_box", "zone_box", "its_zone")


def even_odd_area(rings: Column) -> Column:
    """The area of a polygon whose outer rings turn one way and whose holes turn the other."""
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda s, ring: s + geometry.signed_area(ring)))
