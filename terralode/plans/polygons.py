"""Polygon queries: triangles that are parts, kites that are nations' zones, lines that are suppliers' canals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import geometry, numeric
from terralode.operators import dissolve, planar, reach, spatial
from terralode.plans.registry import query, read
from terralode.sources import kml
from terralode.streaming.folders import kept


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(geometry.point(x, y) for x, y in corners))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles that turn counter-clockwise. Keys are dealt out first: a file of so few bytes a row is one task's, and rings are work."""
    k = F.col("p_partkey")
    x, y = k * 37 % 1000, k * 91 % 1000
    return read(spark, sf_dir, "part").select("p_partkey").repartition("p_partkey").select("p_partkey", _ring((x, y), (x + 5 + k % 11, y + k % 3), (x + k % 4, y + 6 + k % 7)).alias("ring"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kites around the points of a coarse grid."""
    k = F.col("n_nationkey")
    x, y = k % 5 * 200 + 100, F.floor(k / 5) * 200 + 100
    return read(spark, sf_dir, "nation").select("n_nationkey", _ring((x - 90 - k % 7, y), (x, y - 80), (x + 95, y + k % 5), (x + k % 9, y + 90)).alias("zone_ring"))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave stars with a hole, around the points of a coarse grid; the hole's corners turn the other way."""
    k = F.col("n_nationkey")
    x, y = k % 5 * 200 + 100.3, F.floor(k / 5) * 200 + 100.7
    star = _ring((x - 90 - k % 7, y), (x - 20, y - 15), (x, y - 80), (x + 25, y - 12), (x + 95, y + k % 5), (x + 20, y + 18), (x + k % 9, y + 90), (x - 18, y + 22))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.array(star, _ring((x - 8, y), (x, y + 9), (x + 10, y), (x, y - 7))).alias("zone_rings"))


def canals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 53 % 1000, k * 29 % 1000
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", _ring((x, y), (x + 60 - k % 120, y + 40), (x + 90, y - 70 + k % 50)).alias("line"))


_RINGS = """
WITH pc AS (SELECT p_partkey AS id, unnest([0, 1, 2]) AS i, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y FROM part), pp AS (SELECT id, i, (CASE i WHEN 0 THEN x WHEN 1 THEN x + 5 + id % 11 ELSE x + id % 4 END)::DOUBLE AS x, (CASE i WHEN 0 THEN y WHEN 1 THEN y + id % 3 ELSE y + 6 + id % 7 END)::DOUBLE AS y FROM pc),
pe AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pp a JOIN pp b ON b.id = a.id AND b.i = (a.i + 1) % 3),
zc AS (SELECT n_nationkey AS z, unnest([0, 1, 2, 3]) AS i, n_nationkey % 5 * 200 + 100 AS x, n_nationkey // 5 * 200 + 100 AS y FROM nation),
zp AS (SELECT z, i, (CASE i WHEN 0 THEN x - 90 - z % 7 WHEN 1 THEN x WHEN 2 THEN x + 95 ELSE x + z % 9 END)::DOUBLE AS x, (CASE i WHEN 0 THEN y WHEN 1 THEN y - 80 WHEN 2 THEN y + z % 5 ELSE y + 90 END)::DOUBLE AS y FROM zc),
ze AS (SELECT a.z, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM zp a JOIN zp b ON b.z = a.z AND b.i = (a.i + 1) % 4),
cc AS (SELECT s_suppkey AS id, unnest([0, 1, 2]) AS i, s_suppkey * 53 % 1000 AS x, s_suppkey * 29 % 1000 AS y FROM supplier), cp AS (SELECT id, i, (CASE i WHEN 0 THEN x WHEN 1 THEN x + 60 - id % 120 ELSE x + 90 END)::DOUBLE AS x, (CASE i WHEN 0 THEN y WHEN 1 THEN y + 40 ELSE y - 70 + id % 50 END)::DOUBLE AS y FROM cc),
ce AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM cp a JOIN cp b ON b.id = a.id AND b.i = a.i + 1)
"""

#: The sides of the districts, and what of edges e (id, x1 .. y2) lies in the polygons of sides s: cut where they cross, kept by
#: the number of sides to the right of a part's middle.
_DISTRICTS = """
, dc AS (SELECT n_nationkey AS z, unnest(range(12)) AS i, n_nationkey % 5 * 200 + 100.3::DOUBLE AS x, n_nationkey // 5 * 200 + 100.7::DOUBLE AS y FROM nation),
dp AS (SELECT z, i, CASE WHEN i < 8 THEN 0 ELSE 1 END AS ring, x + [-90 - z % 7, -20, 0, 25, 95, 20, z % 9, -18, -8, 0, 10, 0][i + 1] AS x, y + [0, -15, -80, -12, z % 5, 18, 90, 22, 0, 9, 0, -7][i + 1] AS y FROM dc),
de AS (SELECT a.z, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM dp a JOIN dp b ON b.z = a.z AND b.ring = a.ring AND b.i = CASE a.i WHEN 7 THEN 0 WHEN 11 THEN 8 ELSE a.i + 1 END),
zb AS (SELECT z, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM dp GROUP BY 1)
"""
_KEPT = """
{n}p AS (SELECT e.*, {other}, s.x1 AS sx, s.y1 AS sy, s.x2 - s.x1 AS ex, s.y2 - s.y1 AS ey FROM {pairs}),
{n}c AS (SELECT id, z, x1, y1, x2, y2, ((sx - x1) * ey - (sy - y1) * ex) / ((x2 - x1) * ey - (y2 - y1) * ex) AS t, ((sx - x1) * (y2 - y1) - (sy - y1) * (x2 - x1)) / ((x2 - x1) * ey - (y2 - y1) * ex) AS u FROM {n}p WHERE (x2 - x1) * ey <> (y2 - y1) * ex),
{n}cut AS (SELECT id, z, x1, y1, x2, y2, t FROM {n}c WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT DISTINCT id, z, x1, y1, x2, y2, unnest([0.0, 1.0])::DOUBLE FROM {n}p),
{n}l AS (SELECT *, lead(t) OVER (PARTITION BY id, z, x1, y1, x2, y2 ORDER BY t) AS t2 FROM {n}cut),
{n}k AS (SELECT l.id, l.z, l.x1, l.y1, l.x2, l.y2, l.t, l.t2 FROM {n}l l JOIN {sides} s ON s.{key} = l.{key} WHERE l.t2 IS NOT NULL GROUP BY ALL
  HAVING count(*) FILTER ((s.y1 > l.y1 + (l.t + l.t2) / 2 * (l.y2 - l.y1)) <> (s.y2 > l.y1 + (l.t + l.t2) / 2 * (l.y2 - l.y1))
    AND l.x1 + (l.t + l.t2) / 2 * (l.x2 - l.x1) < s.x1 + (l.y1 + (l.t + l.t2) / 2 * (l.y2 - l.y1) - s.y1) / (s.y2 - s.y1) * (s.x2 - s.x1)) % 2 = 1)
"""
_COMMON = _RINGS + _DISTRICTS + """, pb AS (SELECT id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM pp GROUP BY 1), pz AS (SELECT id, z FROM pb JOIN zb ON pb.lx <= zb.hx AND zb.lx <= pb.hx AND pb.ly <= zb.hy AND zb.ly <= pb.hy), """ + _KEPT.format(
    n="a", other="pz.z AS z", pairs="pe e JOIN pz ON pz.id = e.id JOIN de s ON s.z = pz.z", sides="de", key="z"
) + ", " + _KEPT.format(n="b", other="pz.id AS id", pairs="de e JOIN pz ON pz.z = e.z JOIN pe s ON s.id = pz.id", sides="pe", key="id") + """,
u AS (SELECT id, z, x1 + t * (x2 - x1) AS ax, y1 + t * (y2 - y1) AS ay, x1 + t2 * (x2 - x1) AS bx, y1 + t2 * (y2 - y1) AS bb, false AS cut FROM ak UNION ALL SELECT id, z, x1 + t * (x2 - x1), y1 + t * (y2 - y1), x1 + t2 * (x2 - x1), y1 + t2 * (y2 - y1), true FROM bk),
o AS (SELECT id, z, sum(ax * bb - bx * ay) / 2 AS area, bool_or(cut) AS cut FROM u GROUP BY 1, 2)
"""  # fmt: skip


@query(_COMMON + "SELECT z AS zone, count(*) AS parcels, round(sum(area), 3) AS area FROM o WHERE area > 1e-6 GROUP BY 1")
def overlay_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of parcels in each concave district with its hole."""
    rows = parcels(spark, sf_dir).select("p_partkey", F.array("ring").alias("rings"))
    pairs = planar.overlay_areas(rows, districts(spark, sf_dir), "p_partkey", "n_nationkey", 32.0).where("area > 1e-6")
    return pairs.groupBy(F.col("n_nationkey").alias("zone")).agg(F.count("*").alias("parcels"), F.round(F.sum("area"), 3).alias("area"))


@query(_COMMON + """, soil(id, class) AS (SELECT p_partkey, 'S' || (1 + p_size % 4) FROM part)
SELECT z AS zone, class AS soil, round(sum(area) / 10000, 7) AS ha FROM o JOIN soil USING (id) WHERE area > 1e-6 GROUP BY 1, 2
""")
def soil_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hectares of each soil class in each district."""
    rows = parcels(spark, sf_dir).select("p_partkey", F.array("ring").alias("rings"))
    soils = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("S"), (F.col("p_size") % 4 + 1).cast("string")).alias("soil"))
    pairs = planar.overlay_areas(rows, districts(spark, sf_dir), "p_partkey", "n_nationkey", 32.0).where("area > 1e-6").join(soils, "p_partkey")
    return pairs.groupBy(F.col("n_nationkey").alias("zone"), "soil").agg(F.round(F.sum("area") / 10000, 7).alias("ha"))


@query(_RINGS + _DISTRICTS + ", " + _KEPT.format(n="a", other="s.z AS z", pairs="ce e, de s", sides="de", key="z") + """,
l AS (SELECT id, z, sum((t2 - t) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS m FROM ak GROUP BY 1, 2)
SELECT z AS zone, CASE WHEN s_nationkey % 5 = 0 THEN 'none' ELSE 'c' || s_nationkey END AS consortium, count(*) AS canals, round(sum(m) / 1000, 6) AS km FROM l JOIN supplier ON s_suppkey = id WHERE m > 1e-6 GROUP BY 1, 2
""")
def overlay_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres of canals in each concave district by consortium."""
    rows = canals(spark, sf_dir)
    pairs = planar.overlay_lengths(rows.select("s_suppkey", "line"), districts(spark, sf_dir), "s_suppkey", "n_nationkey", 64.0).where("length > 1e-6")
    name = F.coalesce(F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("c"), F.col("s_nationkey").cast("string"))), F.lit("none"))
    pairs = pairs.join(rows.select("s_suppkey", "s_nationkey"), "s_suppkey")
    return pairs.groupBy(F.col("n_nationkey").alias("zone"), name.alias("consortium")).agg(F.count("*").alias("canals"), F.round(F.sum("length") / 1000, 6).alias("km"))


@query(_RINGS + """
, c AS (SELECT id, sum(x1 * y2 - x2 * y1) / 2 AS area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS sy FROM pe GROUP BY 1), g AS (SELECT id, area, sx / (6 * area) AS cx, sy / (6 * area) AS cy FROM c),
f AS (SELECT g.id, x1, y1, x2, y2, cx, cy, greatest(least(((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 1), 0) AS t FROM g JOIN ce ON ce.id = 7),
d AS (SELECT id, min(sqrt((cx - x1 - t * (x2 - x1)) ** 2 + (cy - y1 - t * (y2 - y1)) ** 2)) AS d FROM f GROUP BY 1)
SELECT g.id AS p_partkey, round(area, 4) AS area, round(cx, 4) AS cx, round(cy, 4) AS cy, round(d, 4) AS gap, 3::INTEGER AS corners, true AS same FROM g JOIN d ON d.id = g.id
""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and centres of rings that were turned about and repeated corners, their distance from a canal, and WKT there and back."""
    ring = F.col("ring")
    odd = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.reverse(ring), F.slice(F.reverse(ring), 1, 1))).otherwise(F.concat(F.slice(ring, 1, 1), ring))
    rows = parcels(spark, sf_dir).select("p_partkey", geometry.repaired(odd).alias("ring"))
    line = canals(spark, sf_dir).where("s_suppkey = 7").select("line")  # a single row
    rows = rows.withColumns({"c": geometry.centroid(ring), "back": geometry.from_wkt(geometry.wkt_polygon(ring))})
    c, back = F.col("c"), F.col("back")
    return rows.crossJoin(F.broadcast(line)).select(
        "p_partkey", F.round(geometry.signed_area(ring), 4).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"), F.round(geometry.nearest_on(c, F.col("line"))["d"], 4).alias("gap"),
        F.size(ring).alias("corners"), (F.slice(back, 1, F.size(ring)) == ring).alias("same"),
    )


@query("""
WITH t AS (SELECT s_suppkey, s_suppkey % 16 AS x, s_suppkey * 7 % 16 AS y, 40075016.685578488 / 16 AS w FROM supplier)
SELECT s_suppkey, round(x * w - 20037508.342789244, 3) AS min_x, round(20037508.342789244 - (y + 1) * w, 3) AS min_y, (x + 1) * w - 20037508.342789244 > 0 AND x * w - 20037508.342789244 < 5e6 AND 20037508.342789244 - y * w > 0 AND 20037508.342789244 - (y + 1) * w < 5e6 AS meets FROM t
""")
def map_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of map tiles, and whether they share more than an edge with a box."""
    k = F.col("s_suppkey")
    box = geometry.tile_bounds(k % 16, k * 7 % 16, F.lit(4))
    area = F.struct(*(F.lit(v).alias(n) for n, v in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 5e6), ("max_y", 5e6))))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(box["min_x"], 3).alias("min_x"), F.round(box["min_y"], 3).alias("min_y"), geometry.boxes_overlap(box, area).alias("meets"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END::INTEGER AS vertices, CASE s_suppkey % 3 WHEN 0 THEN '<Point><coordinates>1.0,2.0</coordinates></Point>' WHEN 1 THEN '<LineString><coordinates>1.0,2.0 3.0,4.0 5.0,0.0</coordinates></LineString>'
  ELSE '<Polygon><outerBoundaryIs><LinearRing><coordinates>1.0,2.0 3.0,4.0 5.0,0.0 1.0,2.0</coordinates></LinearRing></outerBoundaryIs></Polygon>' END AS xml FROM supplier
""")
def kml_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, lines and polygons as KML, with the corners that they have."""
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "LineString").otherwise("Polygon")
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 2.0), (3.0, 4.0), (5.0, 0.0))))
    points = F.when(k % 3 == 0, F.slice(corners, 1, 1)).when(k % 3 == 1, corners).otherwise(F.concat(corners, F.slice(corners, 1, 1)))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), points.alias("points"))
    return rows.select("s_suppkey", F.size("points").alias("vertices"), kml.geometry_xml(F.col("kind"), F.col("points")).alias("xml"))


@query()
def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded points in the kite of each nation: of nine that lie in its box, the first that lie in it. SQL has no such
    random numbers; the tests look at what must hold."""
    return spatial.random_points(zones(spark, sf_dir), "n_nationkey", "zone_ring", 3, seed=7)


@query(_COMMON + "SELECT id AS p_partkey, round(area, 3) AS area, NOT cut AS whole FROM o WHERE z = 12 AND area > 1e-6")
def clipped_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels cut to one concave district with a hole: those inside as they are; null and disjoint ones are left out."""
    zone = districts(spark, sf_dir).where("n_nationkey = 12").select("zone_rings")  # a single row
    rows = parcels(spark, sf_dir).select("p_partkey", F.array("ring").alias("rings"))
    rows = rows.union(rows.limit(1).select("p_partkey", F.lit(None).cast("array<array<struct<x:double,y:double>>>")))
    out = planar.clipped(rows, zone, "p_partkey").withColumn("area", planar.even_odd_area(F.col("common"))).where("area > 1e-6")
    return out.select("p_partkey", F.round("area", 3).alias("area"), "whole")


@query("""
WITH a AS (SELECT p_partkey, p_size, abs((5 + p_partkey % 11) * (6 + p_partkey % 7) - p_partkey % 4 * (p_partkey % 3)) / 2.0 AS area FROM part)
SELECT p_size, count(*) AS parts, round(max(area), 4)::DOUBLE AS area, min(p_partkey) FILTER (area = top) AS largest FROM (SELECT *, max(area) OVER (PARTITION BY p_size) AS top FROM a) GROUP BY 1
""")
def largest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of polygons with several parts, the largest."""
    rows = parcels(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("area", geometry.ring_area(F.col("ring")))
    rows = rows.withColumn("area", F.round("area", 4))
    return rows.groupBy("p_size").agg(F.count("*").alias("parts"), F.max("area").alias("area"), F.max_by("p_partkey", F.struct("area", (-F.col("p_partkey")).alias("o"))).alias("largest"))


@query("""
WITH RECURSIVE b AS (SELECT p_size % 5 AS zone, p_partkey % 25 * 4 AS x0, p_partkey // 25 * 4 AS y0, p_partkey % 25 * 4 + CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE 4 END AS x1, p_partkey // 25 * 4 + CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 4 END AS y1, p_partkey % 11 = 0 AS hollow FROM part),
c AS (SELECT DISTINCT zone, x, y FROM (SELECT zone, x0, y0, hollow, unnest(range(x0, x1)) AS x, y1 FROM b), LATERAL (SELECT unnest(range(y0, y1)) AS y) WHERE NOT (hollow AND x = x0 + 1 AND y = y0 + 1)),
d(dir, nx, ny, ax, ay, qx, qy) AS (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)),
e AS (SELECT row_number() OVER (ORDER BY zone, x, y, dir) AS id, zone, dir, x + ax AS ax, y + ay AS ay, x + qx AS bx, y + qy AS ey FROM c JOIN d ON true WHERE NOT EXISTS (SELECT 1 FROM c n WHERE n.zone = c.zone AND n.x = c.x + nx AND n.y = c.y + ny)),
l AS (SELECT e.id, arg_min(f.id, (f.dir - e.dir + 7) % 4) AS next FROM e JOIN e f ON f.zone = e.zone AND f.ax = e.bx AND f.ay = e.ey GROUP BY 1),
w(begun, here) AS (SELECT id, next FROM l UNION ALL SELECT w.begun, l.next FROM w JOIN l ON l.id = w.here WHERE w.here > w.begun),
r AS (SELECT e.zone, count(*) AS rings FROM w JOIN e ON e.id = w.begun WHERE w.here = w.begun GROUP BY 1),
k(zone, x, y, px, py) AS (SELECT zone, x, y, x, y FROM c UNION SELECT k.zone, n.x, n.y, k.px, k.py FROM k JOIN d ON true JOIN c n ON n.zone = k.zone AND n.x = k.x + nx AND n.y = k.y + ny),
s AS (SELECT zone, px, py, count(*) AS n FROM k GROUP BY 1, 2, 3)
SELECT zone, (SELECT count(*) FROM c WHERE c.zone = r.zone)::DOUBLE AS area, (SELECT count(*) FROM e WHERE e.zone = r.zone)::DOUBLE AS perimeter, rings, (SELECT max(n) FROM s WHERE s.zone = r.zone)::DOUBLE AS largest FROM r
""")
def dissolved_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that touch, overlap and have holes, dissolved by zone: area, perimeter, rings and the largest part."""
    k = F.col("p_partkey")
    x, y = k % 25 * 4, F.floor(k / 25) * 4
    w, h = F.when(k % 3 == 0, 6).otherwise(4), F.when(k % 7 == 0, 5).otherwise(4)
    outer = _ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    hole = _ring((x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 2), (x + 1, y + 2))
    keys = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    rows = keys.select((F.col("p_size") % 5).alias("zone"), F.when(k % 11 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))
    rings = kept(dissolve.dissolved(rows, "zone", "rings", 4.0, kept))
    around = rings.groupBy("zone").agg(
        F.round(F.sum(geometry.signed_area(F.col("points"))), 3).alias("area"), F.round(F.sum(geometry.line_length(F.concat("points", F.slice("points", 1, 1)))), 3).alias("perimeter"), F.count("*").alias("rings"),
    )
    return around.join(dissolve.parts(rings, "zone", 8.0).groupBy("zone").agg(F.round(F.max("area"), 3).alias("largest")), "zone")


#: Spans of segments within 6 of others, by their ends' discs and the band between, merged for each pair of lines.
_WITHIN = """
WITH s(layer, id, n, x1, y1, x2, y2) AS (
  SELECT 'canal', s_suppkey, unnest([0, 1]), s_suppkey * 53 % 1000 + unnest([0.13, 60.27 - s_suppkey % 120]), s_suppkey * 29 % 1000 + unnest([0.41, 40.35]), s_suppkey * 53 % 1000 + unnest([60.27 - s_suppkey % 120, 90.53]), s_suppkey * 29 % 1000 + unnest([40.35, s_suppkey % 50 - 69.71]) FROM supplier
  UNION ALL SELECT 'camino', n_nationkey, 0, 3.7, n_nationkey * 40 + 9.3, 991.1, n_nationkey * 37 % 1000 + 21.9 FROM nation
  UNION ALL SELECT 'drenaje', n_nationkey, 0, n_nationkey * 40 + 11.7, 2.9, n_nationkey * 41 % 1000 + 17.3, 987.7 FROM nation),
p AS (SELECT l.layer || '_' || r.layer AS kind, l.id AS l_id, r.id AS r_id, r.n AS n, r.x1 AS rx, r.y1 AS ry, r.x2 - r.x1 AS dx, r.y2 - r.y1 AS dy, r.x1 - l.x1 AS ax, r.y1 - l.y1 AS ay, r.x1 - l.x2 AS bx, r.y1 - l.y2 AS bby, l.x2 - l.x1 AS ux, l.y2 - l.y1 AS uy
  FROM s l JOIN s r ON (l.layer, r.layer) IN (('canal', 'camino'), ('canal', 'drenaje'), ('camino', 'drenaje'))),
q AS (SELECT *, dx * dx + dy * dy AS a, sqrt(ux * ux + uy * uy) AS m FROM p),
d AS (SELECT *, (ax * dx + ay * dy) ** 2 - a * (ax * ax + ay * ay - 36) AS da, (bx * dx + bby * dy) ** 2 - a * (bx * bx + bby * bby - 36) AS db, (ax * ux + ay * uy) / m AS s0, (dx * ux + dy * uy) / m AS sd, (ay * ux - ax * uy) / m AS w0, (dy * ux - dx * uy) / m AS wd FROM q),
e AS (SELECT *, greatest(least(-s0 / sd, (m - s0) / sd), least((-6 - w0) / wd, (6 - w0) / wd)) AS c0, least(greatest(-s0 / sd, (m - s0) / sd), greatest((-6 - w0) / wd, (6 - w0) / wd)) AS c1 FROM d),
f AS (SELECT kind, l_id, r_id, n, rx, ry, dx, dy, sqrt(a) AS whole, greatest(0, list_min(list_filter([CASE WHEN da >= 0 THEN (-(ax * dx + ay * dy) - sqrt(greatest(da, 0))) / a END, CASE WHEN db >= 0 THEN (-(bx * dx + bby * dy) - sqrt(greatest(db, 0))) / a END, CASE WHEN c0 <= c1 THEN c0 END], lambda v: v IS NOT NULL))) AS t0,
  least(1, list_max(list_filter([CASE WHEN da >= 0 THEN (-(ax * dx + ay * dy) + sqrt(greatest(da, 0))) / a END, CASE WHEN db >= 0 THEN (-(bx * dx + bby * dy) + sqrt(greatest(db, 0))) / a END, CASE WHEN c0 <= c1 THEN c1 END], lambda v: v IS NOT NULL))) AS t1 FROM e WHERE da >= 0 OR db >= 0 OR c0 <= c1),
g AS (SELECT *, greatest(t0, coalesce(max(t1) OVER (PARTITION BY kind, l_id, r_id, n ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b0 FROM f WHERE t0 < t1),
h AS (SELECT kind, l_id, r_id, sum(whole * (t1 - b0)) AS length, sum(whole * (t1 - b0) * (rx + dx * (t1 + b0) / 2)) AS sx, sum(whole * (t1 - b0) * (ry + dy * (t1 + b0) / 2)) AS sy FROM g WHERE t1 > b0 GROUP BY 1, 2, 3)
"""


@query(_WITHIN + """
, v AS (SELECT o_orderkey % 120 AS col, o_orderkey // 120 AS "row", o_totalprice / 50 AS flow, (o_orderkey * 7 % 60) / 10.0 AS slope FROM orders), w AS (SELECT kind, l_id, r_id, length, sx / length AS x, sy / length AS y FROM h WHERE length > 1e-6),
z AS (SELECT w.*, coalesce(flow, 0) AS flow, coalesce(slope, 0) AS slope FROM w LEFT JOIN v ON v.col = floor(x / 10) AND v."row" = floor(y / 10))
SELECT kind, l_id, r_id, round(length, 5) AS length, round(x, 5) AS x, round(y, 5) AS y, CASE WHEN flow > 5000 OR slope < 0.5 THEN 'alta' WHEN flow > 2000 OR slope < 2 THEN 'media' ELSE 'baja' END AS severity FROM z WHERE flow > 1000 AND slope < 5
""")
def line_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where canals, roads and drains come within reach of each other: the centre of what lies in the buffer, with the flow
    and slope of the cell there; weak flow and steep ground are no conflict."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    x, y = k * 53 % 1000, k * 29 % 1000
    layers = {
        "canal": read(spark, sf_dir, "supplier").select(k.alias("id"), _ring((x + 0.13, y + 0.41), (x + 60.27 - k % 120, y + 40.35), (x + 90.53, y + (k % 50 - 69.71))).alias("line")),
        "camino": read(spark, sf_dir, "nation").select(n.cast("long").alias("id"), _ring((F.lit(3.7), n * 40 + 9.3), (F.lit(991.1), n * 37 % 1000 + 21.9)).alias("line")),
        "drenaje": read(spark, sf_dir, "nation").select(n.cast("long").alias("id"), _ring((n * 40 + 11.7, F.lit(2.9)), (n * 41 % 1000 + 17.3, F.lit(987.7))).alias("line")),
    }
    found = reach.conflicts(layers, [("canal", "camino"), ("canal", "drenaje"), ("camino", "drenaje")], 6.0, 64.0).where("length > 1e-6")
    o = F.col("o_orderkey")
    cells = read(spark, sf_dir, "orders").select((o % 120).alias("col"), F.floor(o / 120).alias("row"), (F.col("o_totalprice") / 50).alias("flow"), (o * 7 % 60 / 10.0).alias("slope"))
    placed = found.withColumns({"col": F.floor(F.col("x") / 10), "row": F.floor(F.col("y") / 10)}).join(cells, ["row", "col"], "left").fillna(0.0, ["flow", "slope"])
    rows = placed.where("flow > 1000 and slope < 5")
    return rows.select("kind", "l_id", "r_id", *(F.round(c, 5).alias(c) for c in ("length", "x", "y")), numeric.conflict_severity(F.col("flow"), F.col("slope")).alias("severity"))
