"""Overlays of any polygons against counting on a fine grid and simple known cases."""

import math
import random

import numpy as np
import pytest

from terralode.operators import planar

P = "array<array<struct<x:double,y:double>>>"


def star(r, x, y, size, n, dent):
    """A concave ring around (x, y)."""
    return [(x + size * (1 if i % 2 else dent) * math.cos(2 * math.pi * i / n + r), y + size * (1 if i % 2 else dent) * math.sin(2 * math.pi * i / n + r)) for i in range(n)]


def edges(rings):
    return planar._edges([[dict(x=x, y=y) for x, y in ring] for ring in rings])


def inside(rings, x, y):
    odd = np.zeros(np.shape(x), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))
    return odd


def area(rings):
    return sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) for r in rings) / 2


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]


def test_known_cases():
    ring, hole = [SQUARE], [SQUARE, HOLE]
    shifted = [[(x + 2, y) for x, y in SQUARE]]
    assert planar.common_area(edges(ring), edges(ring)) == 16 and planar.common_area(edges(hole), edges(ring)) == 12
    assert planar.common_area(edges(hole), edges(hole)) == 12 and planar.common_area(edges(ring), edges(shifted)) == 8
    assert planar.common_area(edges(ring), edges([[(x + 4, y) for x, y in SQUARE]])) == 0  # they share a side only
    lines = np.array([(-1.0, 2.0, 5.0, 2.0), (2.0, -1.0, 2.0, 5.0), (0.5, 0.5, 0.5, 3.5)])
    assert [planar.length_inside(lines[i : i + 1], edges(hole)) for i in range(3)] == [2, 2, 3]
    rings = planar.common_rings(edges(hole), edges([[(0, -1), (2, -1), (2, 5), (0, 5)]]))
    assert len(rings) == 1 and area(rings) == 6 and len(rings[0]) == 8
    comb = [[(0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (3, 1), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)]]
    parts = planar.common_rings(edges(comb), edges([[(-1, 2), (6, 2), (6, 4), (-1, 4)]]))
    assert len(parts) == 3 and area(parts) == 3  # cut parts come apart
    within = planar.common_rings(edges([[(x * 3 - 4, y * 3 - 4) for x, y in SQUARE]]), edges(hole))
    assert sorted(round(area([r]), 9) for r in within) == [-4, 16]


@pytest.mark.parametrize("seed", range(6))
def test_stars_against_a_grid(seed):
    r = random.Random(seed)
    one = [star(r.random(), 0, 0, 10, 14, 0.5), star(r.random(), 0.5, 0.2, 3, 8, 0.7)]
    two = [star(r.random(), r.uniform(-6, 6), r.uniform(-6, 6), 9, 10, 0.4)]
    x, y = np.meshgrid(np.linspace(-20, 20, 1601) + 0.0123, np.linspace(-20, 20, 1601) + 0.0071)
    want = float((inside(one, x, y) & inside(two, x, y)).sum()) * (40 / 1600) ** 2
    got = planar.common_area(edges(one), edges(two))
    assert got == pytest.approx(planar.common_area(edges(two), edges(one))) and got == pytest.approx(want, abs=0.15)
    rings = planar.common_rings(edges(one), edges(two))
    assert area(rings) == pytest.approx(got) and (inside(rings, x, y) == (inside(one, x, y) & inside(two, x, y))).mean() > 0.99999
    a, b = (-15.0, r.uniform(-5, 5)), (15.0, r.uniform(-5, 5))
    t = (np.arange(200_000) + 0.5) / 200_000
    share = inside(one, a[0] + t * 30, a[1] + t * (b[1] - a[1])).mean() * math.dist(a, b)
    assert planar.length_inside(np.array([(*a, *b)]), edges(one)) == pytest.approx(share, abs=1e-3)


def test_small_tables_change_nothing(monkeypatch):
    one, two = [star(0.1, 0, 0, 10, 30, 0.5)], [star(0.7, 3, 1, 8, 22, 0.6)]
    want = planar.common_area(edges(one), edges(two)), planar.common_rings(edges(one), edges(two))
    monkeypatch.setattr(planar, "_TABLE", 7)
    assert planar.common_area(edges(one), edges(two)) == pytest.approx(want[0]) and planar.common_rings(edges(one), edges(two)) == want[1]


def test_strips_and_odd_rows(spark):
    """Sums over strips of any width; null, empty and flat polygons; clipping."""
    point = lambda ring: [dict(x=float(x), y=float(y)) for x, y in ring]
    stars = [(i, [point(star(i, 7 * i, 3 * i, 10, 14, 0.5)), point(star(i, 7 * i, 3 * i, 3, 8, 0.7))]) for i in range(6)]
    rows = [*stars, (90, None), (91, []), (92, [point([(0, 0), (5, 5), (10, 10)])])]
    left = spark.createDataFrame(rows, f"id int, rings {P}")
    right = spark.createDataFrame([(i, [point(star(0.3, 11 * i, 5, 9, 10, 0.4))]) for i in range(4)], f"zone int, zone_rings {P}")
    plain = {i: edges([[(p["x"], p["y"]) for p in ring] for ring in rings]) for i, rings in stars}
    zones = {r.zone: edges([[(p.x, p.y) for p in ring] for ring in r.zone_rings]) for r in right.collect()}
    want = {(i, z): a for i, e in plain.items() for z, f in zones.items() if (a := planar.common_area(e, f)) > 0}
    for width in (3.0, 50.0):
        got = {(r.id, r.zone): r.area for r in planar.overlay_areas(left, right, "id", "zone", width).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    lines = spark.createDataFrame([(1, point([(-20, 5), (60, 5)])), (2, point([(0, -20), (0, 30)])), (3, None)], "line_id int, line array<struct<x:double,y:double>>")
    got = {(r.line_id, r.zone): r.length for r in planar.overlay_lengths(lines, right, "line_id", "zone", 4.0).collect()}
    assert got.keys() >= {(1, 0), (1, 1), (2, 0)} and got[1, 1] == pytest.approx(planar.length_inside(np.array([(-20.0, 5.0, 60.0, 5.0)]), zones[1]))
    cut = planar.clipped(left, right.where("zone = 1"), "id").select("id", "whole", planar.even_odd_area(planar.F.col("common")).alias("area")).collect()
    assert {r.id: pytest.approx(r.area) for r in cut} == {i: a for (i, z), a in want.items() if z == 1} and not any(r.whole for r in cut)
    big = spark.createDataFrame([(1, [point([(-100, -100), (100, -100), (100, 100), (-100, 100)])])], f"zone int, zone_rings {P}")
    assert [r.whole for r in planar.clipped(left.where("id < 6"), big, "id").collect()] == [True] * 6
