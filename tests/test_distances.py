"""Nearest points and lines at any distance, and the distance transform, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terralode.operators import grid, spatial
from terralode.streaming.folders import kept


@pytest.mark.parametrize("size", [0.5, 20.0])
def test_nearest_points_at_any_distance(spark, size):
    """Clusters far apart, copies and ties; a point without coordinates."""
    r = random.Random(1)
    right = [(i, r.gauss(500 * (i % 3), 3), r.gauss(-900 * (i % 2), 3)) for i in range(300)] + [(900, 10.0, 10.0), (901, 10.0, 10.0)]
    left = [(i, r.uniform(-3000, 3000), r.uniform(-3000, 3000)) for i in range(150)] + [(i, r.gauss(0, 5), r.gauss(0, 5)) for i in range(150, 300)] + [(300, 10.0, 10.0)]
    rows = [*left, (301, None, 1.0)]
    got = spatial.nearest(spark.createDataFrame(rows, "a int, x double, y double"), spark.createDataFrame([*right, (999, None, None)], "b int, x double, y double"), "a", "b", size, kept)
    got = {x.a: (x.b, x.distance) for x in got.collect()}
    want = {i: min((math.hypot(x - u, y - v), j) for j, u, v in right) for i, x, y in left}
    assert len(got) == len(rows) and got.pop(301) == (None, None)
    assert {i: b for i, (b, _) in got.items()} == {i: j for i, (_, j) in want.items()} and got[300] == (900, 0.0)
    assert all(got[i][1] == pytest.approx(d, abs=1e-9) for i, (d, _) in want.items())


def test_nearest_lines_at_any_distance(spark):
    r = random.Random(2)
    lines = [(i, [(r.uniform(-50, 50) + 400 * (i % 2), r.uniform(-50, 50)) for _ in range(r.randint(1, 4))]) for i in range(40)]
    left = [(i, r.uniform(-2000, 2000), r.uniform(-2000, 2000)) for i in range(80)] + [(i, r.uniform(-60, 60), r.uniform(-60, 60)) for i in range(80, 160)]

    def far(x, y, line):
        best = math.inf
        for (ax, ay), (bx, by) in zip(line, line[1:], strict=False) if len(line) > 1 else [(line[0], line[0])]:
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
        return best

    df = spark.createDataFrame([(i, [dict(x=x, y=y) for x, y in line]) for i, line in lines] + [(98, []), (99, None)], "b int, line array<struct<x:double,y:double>>")
    got = {x.a: (x.b, x.distance) for x in spatial.nearest_lines(spark.createDataFrame(left, "a int, x double, y double"), df, "a", "b", 15.0, kept).collect()}
    want = {i: min((far(x, y, line), j) for j, line in lines) for i, x, y in left}
    assert len(got) == len(left) and all(got[i][1] == pytest.approx(d) for i, (d, _) in want.items()) and sum(got[i][0] == j for i, (_, j) in want.items()) >= len(left) - 2


def test_nothing_is_near(spark):
    left, none = spark.createDataFrame([(1, 0.0, 0.0)], "a int, x double, y double"), spark.createDataFrame([], "b int, x double, y double")
    assert [tuple(r) for r in spatial.nearest(left, none, "a", "b", 1.0, kept).collect()] == [(1, None, None)]
    assert spatial.nearest(left.where("a > 1"), left.withColumnRenamed("a", "b"), "a", "b", 1.0, kept).collect() == []


def test_distance_transform(spark):
    """Sources far away and across missing cells; a grid without sources."""
    r = random.Random(3)
    cells = [(i, j, r.random() < 0.004) for i in range(-5, 60) for j in range(3, 90) if r.random() < 0.8]
    cells += [(200, 300, True), (200, 3, False)]
    df = spark.createDataFrame(cells, "row int, col int, wet boolean")
    got = {(x.row, x.col): x.distance for x in grid.distances(df, F.col("wet")).collect()}
    sources = [(i, j) for i, j, wet in cells if wet]
    assert len(got) == len(cells)
    assert all(got[i, j] == pytest.approx(min(math.hypot(i - p, j - q) for p, q in sources)) for i, j, _ in cells)
    assert {x.distance for x in grid.distances(df.where("not wet"), F.col("wet")).collect()} == {None}
    assert grid.distances(df.where("row > 999"), F.col("wet")).collect() == []


def test_each_place_is_looked_at_once(spark):
    """Rows at a few places aren't paired with each other: no table that is written holds more than the places."""
    sizes = []

    def counted(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    left = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 3).cast("double").alias("x"), F.lit(0.0).alias("y"))
    right = spark.range(2000).select(F.col("id").alias("b"), (F.col("id") % 4 * 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    got = spatial.nearest(left, right, "a", "b", 5.0, counted).collect()
    assert len(got) == 3000 and max(sizes) <= 4 and {r.b for r in got} == {0}
    lines = right.select("b", F.array(F.struct("x", "y"), F.struct((F.col("x") + 1).alias("x"), "y")).alias("line"))
    sizes.clear()
    assert {r.b for r in spatial.nearest_lines(left, lines, "a", "b", 5.0, counted).collect()} == {0} and max(sizes) <= 8


def test_crowded_tiles_get_smaller(spark):
    """Places that all lie on one tile are laid on smaller ones, with the same answers."""
    r = random.Random(3)
    places = spark.createDataFrame([(i, r.random(), r.random()) for i in range(2000)], "b int, x double, y double")
    assert spatial._thinned(places, 10.0) < 1.0
    points = [(i, r.random(), r.random()) for i in range(20)] + [(20, 50.0, 50.0)]
    got = {x.a: x.b for x in spatial.nearest(spark.createDataFrame(points, "a int, x double, y double"), places, "a", "b", 10.0, kept).collect()}
    there = places.collect()
    assert got == {i: min((math.hypot(x - p.x, y - p.y), p.b) for p in there)[1] for i, x, y in points}


def test_distance_frames_grow_from_the_front(spark):
    """A frame that shrinks towards the end is worked out anew for each row of a column: the square of its length."""
    cells = spark.range(400).select((F.col("id") % 200).alias("row"), F.floor(F.col("id") / 200).alias("col"), (F.col("id") % 150 == 0).alias("source"))
    out = grid.distances(cells, F.col("source"))
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {(x.row, x.col): x.distance for x in out.collect()}
    sources = [(k % 200, k // 200) for k in range(0, 400, 150)]
    assert got == {(k % 200, k // 200): pytest.approx(min(math.hypot(k % 200 - r, k // 200 - c) for r, c in sources)) for k in range(400)}
