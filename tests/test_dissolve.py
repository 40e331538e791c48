"""Unions of polygons against known shapes and counting on a grid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralode.functions import geometry
from terralode.operators import dissolve
from terralode.streaming.folders import kept
from tests.test_planar import inside, star

P = "array<array<struct<x:double,y:double>>>"


def ring(*corners):
    return [dict(x=float(x), y=float(y)) for x, y in corners]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def rings_of(spark, rows, size=2.0):
    df = spark.createDataFrame(rows, f"zone string, rings {P}")
    out = dissolve.dissolved(df, "zone", "rings", size, kept).withColumn("area", geometry.signed_area(F.col("points"))).collect()
    return {z: sorted((round(r.area, 6), len(r.points)) for r in out if r.zone == z) for z in {r.zone for r in out}}


def test_known_unions(spark):
    frame = [box(0, 0, 3, 3), list(reversed(box(1, 1, 1, 1)))]
    rows = [
        ("pair", [box(0, 0, 2, 2)]), ("pair", [list(reversed(box(2, 0, 2, 2)))]), ("tee", [box(0, 0, 4, 1)]), ("tee", [box(1, 1, 2, 1)]), ("cross", [box(0, 1, 3, 1)]), ("cross", [box(1, 0, 1, 3)]),
        ("corner", [box(0, 0, 1, 1)]), ("corner", [box(1, 1, 1, 1)]), ("hole", frame), ("filled", frame), ("filled", [box(1, 1, 1, 1)]), ("within", [box(0, 0, 9, 9)]), ("within", [box(2, 2, 1, 1)]),
        ("same", [box(0, 0, 2, 2)]), ("same", [box(0, 0, 2, 2)]), ("ring", [box(0, 0, 3, 1)]), ("ring", [box(0, 2, 3, 1)]), ("ring", [box(0, 0, 1, 3)]), ("ring", [box(2, 0, 1, 3)]),
        (None, [box(5, 5, 1, 1)]), ("none", None), ("none", []), ("flat", [ring((0, 0), (1, 1), (2, 2))]),
    ]
    got = rings_of(spark, rows)
    assert got == {
        "pair": [(8, 4)], "tee": [(6, 8)], "cross": [(5, 12)], "corner": [(1, 4), (1, 4)], "hole": [(-1, 4), (9, 4)], "filled": [(9, 4)], "within": [(81, 4)],
        "same": [(4, 4)], "ring": [(-1, 4), (9, 4)], None: [(1, 4)],
    }


@pytest.mark.parametrize("seed", range(2))
def test_stars_that_overlap(spark, seed):
    """Concave stars that cross at odd angles, by area and by what lies inside."""
    r = random.Random(seed)
    stars = [[star(r.random(), r.uniform(-12, 12), r.uniform(-12, 12), 7, 10, 0.5)] for _ in range(7)]
    df = spark.createDataFrame([("z", [ring(*s[0])]) for s in stars], f"zone string, rings {P}")
    got = [[(p.x, p.y) for p in x.points] for x in dissolve.dissolved(df, "zone", "rings", 4.0, kept).collect()]
    x, y = np.meshgrid(np.linspace(-20, 20, 801) + 0.0123, np.linspace(-20, 20, 801) + 0.0071)
    want = np.zeros(x.shape, bool)
    for s in stars:
        want |= inside(s, x, y)
    assert (inside(got, x, y) == want).mean() > 0.9999
    area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, g[1:] + g[:1], strict=True)) for g in got) / 2
    assert area == pytest.approx(want.sum() * (40 / 800) ** 2, rel=0.01)


def test_parts_and_holes(spark):
    """A ring of a thousand squares around a hole, an island in it, and a lone square."""
    n = 60
    rows = [("z", [box(x, y, 1, 1)]) for x in range(n) for y in range(n) if x in (0, n - 1) or y in (0, n - 1)]
    rows += [("z", [box(20, 20, 3, 3)]), ("z", [box(100, 100, 2, 2)])]
    rings = kept(dissolve.dissolved(spark.createDataFrame(rows, f"zone string, rings {P}"), "zone", "rings", 1.0, kept))
    assert sorted(len(r.points) for r in rings.collect()) == [4] * 4
    got = sorted(round(r.area, 6) for r in dissolve.parts(rings, "zone", 8.0).collect())
    assert got == [4, 9, n * n - (n - 2) ** 2] and math.isfinite(sum(got))


def test_no_table_that_grows_is_broadcast(spark):
    """Written tables take little room as files, and were sent whole to the driver by that size."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    rows = spark.range(30).select((F.col("id") % 2).alias("zone"), F.array(F.array(*(F.struct((F.col("id") % 6 * 4 + x).cast("double").alias("x"), (F.floor(F.col("id") / 6) * 4 + y).cast("double").alias("y")) for x, y in ((0, 0), (6, 0), (6, 4), (0, 4))))).alias("rings"))
    rings = noted(dissolve.dissolved(rows, "zone", "rings", 4.0, noted))
    noted(dissolve.parts(rings, "zone", 8.0))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
