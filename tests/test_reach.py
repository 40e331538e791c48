"""Lines near lines against points sampled along them."""

import math
import random

import numpy as np
import pytest

from terralode.operators import reach

LINES = "id int, line array<struct<x:double,y:double>>"


def apart(x, y, line):
    best = np.full(np.shape(x), np.inf)
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False) if len(line) > 1 else [(line[0], line[0])]:
        dx, dy = bx - ax, by - ay
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0.0
        best = np.minimum(best, np.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def near(one, two, distance, n=20_000):
    """Length and centre of what of line two is within a distance of line one."""
    length = sx = sy = 0.0
    t = (np.arange(n) + 0.5) / n
    for (ax, ay), (bx, by) in zip(two, two[1:], strict=False):
        x, y = ax + t * (bx - ax), ay + t * (by - ay)
        held = apart(x, y, one) <= distance
        piece = math.dist((ax, ay), (bx, by)) / n
        length, sx, sy = length + held.sum() * piece, sx + x[held].sum() * piece, sy + y[held].sum() * piece
    return (length, sx / length, sy / length) if length else None


def table(spark, lines):
    return spark.createDataFrame([(i, None if line is None else [dict(x=float(x), y=float(y)) for x, y in line]) for i, line in lines.items()], LINES)


def test_reach(spark):
    r = random.Random(1)
    line = lambda n: [(r.uniform(0, 60), r.uniform(0, 60)) for _ in range(n)]
    one = {i: line(r.randint(1, 4)) for i in range(12)} | {50: [(0, 10), (60, 10)], 51: [(5, 5), (5, 5)], 90: None, 91: []}
    two = {i: line(r.randint(2, 4)) for i in range(12)} | {60: [(0, 12), (60, 12)], 61: [(30, 0), (30, 60)], 62: [(0, 99), (1, 99)]}
    out = reach.within_reach(table(spark, one), table(spark, two).withColumnRenamed("id", "other"), "id", "other", 4.0, 10.0).collect()
    got = {(x.id, x.other): (x.length, x.x, x.y) for x in out}
    want = {(i, j): v for i, a in one.items() if a for j, b in two.items() if (v := near(a, b, 4.0))}
    big = {k for k, v in want.items() if v[0] > 0.1}
    assert big <= got.keys() and all(k in want or v[0] < 0.1 for k, v in got.items())
    assert all(got[k] == pytest.approx(want[k], abs=0.05) for k in big)
    assert got[50, 60] == pytest.approx((60, 30, 12)) and got[50, 61] == pytest.approx((8, 30, 10))


def test_kinds_and_empty_layers(spark):
    a, b, none = table(spark, {1: [(0, 0), (9, 0)]}), table(spark, {7: [(4, -9), (4, 9)]}), table(spark, {})
    kinds = [("canal", "camino"), ("canal", "drenaje"), ("camino", "drenaje")]
    out = reach.conflicts({"canal": a, "camino": b, "drenaje": none}, kinds, 1.0, 5.0).collect()
    assert [(x.kind, x.l_id, x.r_id, round(x.length, 9), x.x, round(x.y, 9)) for x in out] == [("canal_camino", 1, 7, 2.0, 4.0, 0.0)]
