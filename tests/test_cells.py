"""Cells that lines and polygons touch, rings around cells, and labels chosen in rounds, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralode.functions import geometry
from terralode.operators import dissolve, grid, labels
from terralode.streaming.folders import kept
from tests.test_planar import inside, star

P = "array<array<struct<x:double,y:double>>>"


def cells_on(x1, y1, x2, y2, n=20_000):
    return {(math.floor(y1 + (y2 - y1) * i / n), math.floor(x1 + (x2 - x1) * i / n)) for i in range(n + 1)}


def test_burned_lines_miss_no_cell(spark):
    r = random.Random(1)
    lines = [(i, *(r.uniform(-9, 9) for _ in range(4))) for i in range(40)] + [(90, 0.5, 0.5, 0.5, 5.5), (91, 0.5, 0.5, 5.5, 0.5), (92, 1.2, 1.2, 1.2, 1.2), (93, 0.9, 1.999, 2.5, 2.001)]
    df = spark.createDataFrame(lines, "id int, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for x in grid.burned(df, 1.0, "id").collect():
        got.setdefault(x.id, set()).add((x.row, x.col))
    for i, *line in lines:
        assert cells_on(*line) <= got[i] and len(got[i] - cells_on(*line)) <= 1  # sampling misses a cell cut at its very corner
    assert {(x.row, x.col) for x in grid.burned(df.where("id = 90"), 2.0).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_covered_cells(spark):
    r = random.Random(2)
    shapes = [(i, [star(r.random(), r.uniform(0, 9), r.uniform(0, 9), 8, 12, 0.4), star(r.random(), 0.3, 0.7, 2, 6, 0.6)]) for i in range(6)]
    rows = [(i, [[dict(x=x, y=y) for x, y in ring] for ring in rings]) for i, rings in shapes] + [(90, None), (91, [])]
    df = spark.createDataFrame(rows, f"id int, rings {P}")
    for touched in (False, True):
        got = [tuple(x) for x in grid.covered(df, "id", "rings", 1.0, touched).collect()]
        assert len(got) == len(set(got))
        for i, rings in shapes:
            want = {(y, x) for x in range(-20, 30) for y in range(-20, 30) if inside(rings, x + 0.5, y + 0.5)}
            if touched:
                want |= set().union(*(cells_on(*p, *q, 3000) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)))
            mine = {(y, x) for j, y, x in got if j == i}
            assert want <= mine and len(mine - want) <= (3 if touched else 0)


def test_rings_around_cells(spark):
    """Random labels: the rings' area is the number of cells, and they hold just these."""
    r = random.Random(3)
    cells = [(i, j, r.randint(0, 2)) for i in range(14) for j in range(17) if r.random() < 0.9]
    out = dissolve.stitched(grid.outlined(spark.createDataFrame(cells, "row int, col int, label int"), "label"), kept)
    out = out.withColumn("area", geometry.signed_area(F.col("points"))).collect()
    for label in range(3):
        mine = {(i, j) for i, j, k in cells if k == label}
        rings = [[(p.x, p.y) for p in x.points] for x in out if x.key == label]
        assert sum(x.area for x in out if x.key == label) == len(mine)
        assert {(i, j) for i in range(14) for j in range(17) if inside(rings, j + 0.5, i + 0.5)} == mine


@pytest.mark.parametrize("spread", [60, 1])
def test_labels_in_rounds(spark, spread):
    """Two crowded screens, ties of value, a null; spread 1 puts all labels on few spots."""
    r = random.Random(spread)
    rows = [(i % 2, i, r.choice(["area", "distance"]), float(r.randint(0, 5)), r.uniform(0, spread * 9), r.uniform(0, spread * 9)) for i in range(700)]
    df = spark.createDataFrame([*rows, (None, 1, "area", 1.0, 0.0, 0.0), (7, 2, "area", None, 0.0, 0.0)], "screen int, id int, kind string, value double, x double, y double")
    shown = {}
    for s, i, _, _, x, y in sorted(rows, key=lambda t: (t[2] != "area", -t[3], t[1])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 100 for _, a, b in shown.setdefault(s, [])):
            shown[s].append((i, x, y))
    got = {(x.screen, x.id) for x in labels.visible(df, "screen", 10.0, kept).collect()}
    assert got == {(s, i) for s, kept_ in shown.items() for i, _, _ in kept_}
    assert labels.visible(df.where("id < 0"), "screen", 10.0, kept).collect() == []


def test_ended_paths_are_not_joined_by_their_null(spark):
    """All cells that have got to their outlet would meet in one task: only those still under way look further down."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    flow = spark.range(9).select(F.col("id").alias("cell"), F.when(F.col("id") % 4 != 0, F.col("id") - 1).alias("next"), F.lit(0.0).alias("value"))
    got = {r.cell: (r.outlet, r.steps, r.area) for r in grid.traced(flow, noted).collect()}
    assert got == {i: (i // 4 * 4, i % 4, (9 if i == 8 else i // 4 * 4 + 4) - i) for i in range(9)}
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all(p.count("isnotnull(jump") >= 2 for p in rounds)


def test_neighbours_are_gathered_in_small_parts(spark, monkeypatch):
    """Across edges of tiles, holes, negative and null places: as by looking at each cell; and no task gets all cells of a large table."""
    rng = random.Random(3)
    rows = [(r, c, rng.random()) for r in range(-130, 140) for c in range(-70, 70) if rng.random() < 0.8] + [(None, None, 1.0), (5000, None, 2.0)]
    at = {(r, c): v for r, c, v in rows if r is not None and c is not None}
    monkeypatch.setattr(grid, "_DEALT", 2000, raising=False)
    steps = {f"n{code}": step for code, step in grid.D8.items()}
    found = grid.with_neighbours(spark.createDataFrame(rows, "row long, col long, value double").coalesce(1), steps)
    want = {(r, c, v, *(at.get((r + dr, c + dc)) if None not in (r, c) else None for dr, dc in steps.values())) for r, c, v in rows}
    got = [tuple(r) for r in found.select("row", "col", "value", *steps).collect()]
    assert len(got) == len(rows) and {x for x in got if None not in x[:2]} == {x for x in want if None not in x[:2]}
    assert sorted(x[2] for x in got if None in x[:2]) == [1.0, 2.0]
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(rows) / 3
