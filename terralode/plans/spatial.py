"""Spatial and raster queries. Cells, points and boxes derive from the driver's tables: an order is a cell of a grid of
200 columns, a part or supplier a point, a line item a reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import geometry, numeric
from terralode.operators import dissolve, grid, spatial
from terralode.plans.registry import query, read
from terralode.streaming.folders import kept

_CELLS = "SELECT o_orderkey // 200 AS \"row\", o_orderkey % 200 AS col, o_totalprice / 1000 AS value FROM orders"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.floor(key / 200).cast("long").alias("row"), (key % 200).alias("col"), (F.col("o_totalprice") / 1000).alias("value"))


_FLOW = f"""
WITH RECURSIVE c AS ({_CELLS}), d(code, dr, dc) AS (VALUES (1, 0, 1), (2, -1, 1), (4, -1, 0), (8, -1, -1), (16, 0, -1), (32, 1, -1), (64, 1, 0), (128, 1, 1)),
p AS (SELECT c."row", c.col, d.code, d.dr, d.dc, row_number() OVER (PARTITION BY c."row", c.col ORDER BY (c.value - n.value) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2::DOUBLE) ELSE 1 END DESC, code) AS k
  FROM c JOIN d ON true JOIN c n ON n."row" = c."row" + dr AND n.col = c.col + dc WHERE c.value > n.value),
f AS (SELECT c."row", c.col, p.code, c."row" + p.dr AS nr, c.col + p.dc AS nc FROM c LEFT JOIN p ON p."row" = c."row" AND p.col = c.col AND p.k = 1),
t AS (SELECT "row" AS r0, col AS c0, "row" AS r, col AS c, 0 AS steps FROM f UNION ALL SELECT r0, c0, f.nr, f.nc, steps + 1 FROM t JOIN f ON f."row" = t.r AND f.col = t.c WHERE f.nr IS NOT NULL)
"""


#: The rings around labelled cells lc (label, x, y), traced edge by edge with the inside on the left: lr (label, rings) and
#: lp (label, around), their length.
RINGS_OF_CELLS = """
, ld(dir, nx, ny, ax, ay, qx, qy) AS (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)),
le AS (SELECT row_number() OVER (ORDER BY lc.label, lc.x, lc.y, dir) AS id, lc.label, dir, lc.x + ax AS ax, lc.y + ay AS ay, lc.x + qx AS ex, lc.y + qy AS ey FROM lc JOIN ld ON true LEFT JOIN lc n ON n.label = lc.label AND n.x = lc.x + nx AND n.y = lc.y + ny WHERE n.label IS NULL),
ll AS (SELECT le.id, arg_min(f.id, (f.dir - le.dir + 7) % 4) AS next FROM le JOIN le f ON f.label = le.label AND f.ax = le.ex AND f.ay = le.ey GROUP BY 1),
lw(begun, here) AS (SELECT id, next FROM ll UNION ALL SELECT lw.begun, ll.next FROM lw JOIN ll ON ll.id = lw.here WHERE lw.here > lw.begun),
lr AS (SELECT label, count(*) AS rings FROM lw JOIN le ON le.id = lw.begun WHERE lw.here = lw.begun GROUP BY 1), lp AS (SELECT label, count(*)::DOUBLE AS around FROM le GROUP BY 1)
"""


def ringed(rows: DataFrame) -> DataFrame:
    """(label, rings, ring_area, perimeter) of labelled cells, from the rings around them."""
    rings = dissolve.stitched(grid.outlined(rows, "label"), kept)
    length = geometry.line_length(F.concat("points", F.slice("points", 1, 1)))
    return rings.groupBy(F.col("key").alias("label")).agg(F.count("*").alias("rings"), F.sum(geometry.signed_area(F.col("points"))).alias("ring_area"), F.sum(length).alias("perimeter"))


def traced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = grid.traced(grid.downstream(grid.d8_pointers(cells(spark, sf_dir))), kept)
    return flow.select(F.shiftright("cell", 32).alias("row"), F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)).alias("col"), F.shiftright("outlet", 32).alias("outlet_row"), F.col("outlet").bitwiseAND(F.lit(0xFFFFFFFF)).alias("outlet_col"), "steps", "area")


@query(_FLOW + """
, acc AS (SELECT r AS "row", c AS col, count(*) AS flow FROM t GROUP BY 1, 2),
nb AS (SELECT c."row", c.col, c.value, e.value AS east, w.value AS west, n.value AS north, s.value AS south FROM c
  LEFT JOIN c e ON e."row" = c."row" AND e.col = c.col + 1 LEFT JOIN c w ON w."row" = c."row" AND w.col = c.col - 1
  LEFT JOIN c n ON n."row" = c."row" - 1 AND n.col = c.col LEFT JOIN c s ON s."row" = c."row" + 1 AND s.col = c.col),
gr AS (SELECT *, coalesce((east - west) / 60, (east - value) / 30, (value - west) / 30, 0) AS dx, coalesce((south - north) / 60, (south - value) / 30, (value - north) / 30, 0) AS dy FROM nb),
g AS (SELECT "row", col, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope, degrees(atan2(-dy, dx)) AS a FROM gr)
SELECT "row", col, round(slope, 4) AS slope, round(a - 360 * floor(a / 360), 3) AS aspect, round(ln(greatest(flow * 30, 1e-10) / tan(greatest(radians(slope), 0.001))), 4) AS twi FROM g JOIN acc USING ("row", col)
""")
def grid_slope_aspect_twi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope, aspect, and wetness by the cells that drain through each."""
    flow = traced_cells(spark, sf_dir).select("row", "col", F.col("area").alias("flow"))
    rows = grid.slope_aspect(cells(spark, sf_dir), 30.0).join(flow, ["row", "col"])
    return rows.select("row", "col", F.round("slope", 4).alias("slope"), F.round("aspect", 3).alias("aspect"), F.round(grid.wetness(F.col("flow"), F.col("slope"), 30.0), 4).alias("twi"))


@query(_FLOW + """
SELECT r0 AS "row", c0 AS col, arg_max(r, steps) AS outlet_row, arg_max(c, steps) AS outlet_col, max(steps)::BIGINT AS steps FROM t GROUP BY 1, 2
""")
def d8_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced_cells(spark, sf_dir).drop("area")


@query(_FLOW + 'SELECT r AS "row", c AS col, count(*) AS accumulation FROM t GROUP BY 1, 2')
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced_cells(spark, sf_dir).select("row", "col", F.col("area").alias("accumulation"))


#: Concave stars with a hole on a grid of 200 by 200 cells, by their sides (zone, x1, y1, x2, y2), and the cells that each touches.
_TOUCHED = """
WITH zc AS (SELECT n_nationkey AS zone, unnest(range(12)) AS i, n_nationkey % 5 * 40 + 20.3::DOUBLE AS x, n_nationkey // 5 * 40 + 20.7::DOUBLE AS y FROM nation),
zp AS (SELECT zone, i, CASE WHEN i < 8 THEN 0 ELSE 1 END AS ring, x + [-21.13 - zone % 7, -5.21, 0.17, 6.41, 19.77, 5.53, zone % 9 + 0.29, -4.61, -4.37, 0.31, 5.09, 0.13][i + 1] AS x, y + [0.11, -4.19, -18.83, -3.47, zone % 5 + 0.23, 4.67, 22.91, 5.87, 0.19, 4.79, 0.37, -3.71][i + 1] AS y FROM zc),
ze AS (SELECT a.zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM zp a JOIN zp b ON b.zone = a.zone AND b.ring = a.ring AND b.i = CASE a.i WHEN 7 THEN 0 WHEN 11 THEN 8 ELSE a.i + 1 END),
zb AS (SELECT zone, floor(min(x))::BIGINT AS lx, floor(max(x))::BIGINT AS hx, floor(min(y))::BIGINT AS ly, floor(max(y))::BIGINT AS hy FROM zp GROUP BY 1),
zx AS (SELECT *, unnest(range(lx, hx + 1)) AS col FROM zb), zy AS (SELECT zone, col, unnest(range(ly, hy + 1)) AS "row" FROM zx),
touched AS (SELECT zone, "row", col FROM zy JOIN ze USING (zone) GROUP BY 1, 2, 3 HAVING count(*) FILTER ((y1 > "row" + 0.5) <> (y2 > "row" + 0.5) AND col + 0.5 < x1 + ("row" + 0.5 - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1
  OR bool_or(greatest(0, least((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), least(("row" - y1) / (y2 - y1), ("row" + 1 - y1) / (y2 - y1))) <= least(1, greatest((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), greatest(("row" - y1) / (y2 - y1), ("row" + 1 - y1) / (y2 - y1)))))
"""


@query(_TOUCHED + """
, c AS (SELECT l_partkey % 200 AS x, l_suppkey % 200 AS y, l_quantity * 2 AS v FROM lineitem)
SELECT zone, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(v), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, count(*) AS n, round(sum(v), 4) AS sum,
  count(*) FILTER (v > 70) AS n_high FROM c JOIN touched ON x = col AND y = "row" GROUP BY 1
""")
def zonal_stats_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of cells in concave polygons with a hole, all touched cells included, by polygon."""
    k = F.col("n_nationkey")
    x, y = k % 5 * 40 + 20.3, F.floor(k / 5) * 40 + 20.7
    star = [(x - 21.13 - k % 7, y + 0.11), (x - 5.21, y - 4.19), (x + 0.17, y - 18.83), (x + 6.41, y - 3.47), (x + 19.77, y + k % 5 + 0.23), (x + 5.53, y + 4.67), (x + k % 9 + 0.29, y + 22.91), (x - 4.61, y + 5.87)]
    hole = [(x - 4.37, y + 0.19), (x + 0.31, y + 4.79), (x + 5.09, y + 0.37), (x + 0.13, y - 3.71)]
    ring = lambda corners: F.array(*(geometry.point(a, b) for a, b in corners))
    zones = read(spark, sf_dir, "nation").select(k.alias("zone"), F.array(ring(star), ring(hole)).alias("rings"))
    readings = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("col"), (F.col("l_suppkey") % 200).alias("row"), (F.col("l_quantity") * 2).alias("v"))
    held = kept(readings.join(grid.covered(zones, "zone", "rings"), ["row", "col"]).select("zone", "v"))
    return grid.zonal(held, "zone", "v", kept)


_BOX = "{id} * 37 % 1000 AS x0, {id} * 91 % 1000 AS y0, {id} * 37 % 1000 + 5 + {id} % 11 AS x1, {id} * 91 % 1000 + 5 + {id} % 7 AS y1"


@query(f"""
WITH a AS (SELECT p_partkey, {_BOX.format(id="p_partkey")} FROM part), b AS (SELECT s_suppkey, {_BOX.format(id="s_suppkey")} FROM supplier)
SELECT p_partkey, s_suppkey, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)::DOUBLE AS area
FROM a JOIN b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1
""")
def spatial_join_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    def boxed(table: str, key: str, name: str) -> DataFrame:
        k = F.col(key)
        x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
        return read(spark, sf_dir, table).select(key, F.struct(x.alias("min_x"), y.alias("min_y"), (x + 5 + k % 11).alias("max_x"), (y + 5 + k % 7).alias("max_y")).alias(name))

    pairs = spatial.join_boxes(boxed("part", "p_partkey", "box"), boxed("supplier", "s_suppkey", "zone"), 16.0)
    return pairs.select("p_partkey", "s_suppkey", spatial.overlap_area(F.col("box"), F.col("zone")).alias("area"))


@query("""
WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS x, (c_custkey * 104729 % 1000)::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey AS sid, (s_suppkey * 7907 % 1000)::DOUBLE AS rx, (s_suppkey * 104723 % 1000)::DOUBLE AS ry FROM supplier),
d AS (SELECT id, sid, sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) AS distance FROM p, s),
b AS (SELECT id, sid, distance, row_number() OVER (PARTITION BY id ORDER BY distance, sid) AS k FROM d)
SELECT p.id AS c_custkey, b.sid AS s_suppkey, round(distance, 6) AS distance FROM p LEFT JOIN b ON b.id = p.id AND k = 1
""")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lambda t, k, a, b: read(spark, sf_dir, t).select(k, (F.col(k) * a % 1000).cast("double").alias("x"), (F.col(k) * b % 1000).cast("double").alias("y"))
    out = spatial.nearest(placed("customer", "c_custkey", 7919, 104729), placed("supplier", "s_suppkey", 7907, 104723), "c_custkey", "s_suppkey", 100.0, kept)
    return out.withColumn("distance", F.round("distance", 6))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1000)::DOUBLE AS x, (l_suppkey % 1000)::DOUBLE AS y FROM lineitem),
s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y))
SELECT l_orderkey, count(*)::INTEGER AS n_points, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0), 4) AS length, min(x) AS min_x, max(y) AS max_y FROM s GROUP BY 1
""")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.struct("l_linenumber", (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("points"))
    box = geometry.bbox(F.col("points"))
    return lines.select("l_orderkey", F.size("points").alias("n_points"), F.round(geometry.line_length(F.col("points")), 4).alias("length"), box["min_x"].alias("min_x"), box["max_y"].alias("max_y"))


@query("""
SELECT n_regionkey, min(c_acctbal) AS min_x, max(c_acctbal) AS max_x, min(c_custkey % 90) AS min_y, max(c_custkey % 90) AS max_y FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def bbox_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    y = F.col("c_custkey") % 90
    return rows.groupBy("n_regionkey").agg(F.min("c_acctbal").alias("min_x"), F.max("c_acctbal").alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


@query("""
WITH h AS (SELECT o_orderkey, greatest(least(floor((o_totalprice / 100 - 500 + 10000) * 10), 16777215), 0)::BIGINT AS code FROM orders)
SELECT o_orderkey, (code // 65536)::INTEGER AS r, (code // 256 % 256)::INTEGER AS g, (code % 256)::INTEGER AS b, (SELECT min(o_totalprice / 100 - 500) FROM orders) AS base FROM h
""")
def terrain_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100 - 500).alias("height"))
    r, g, b = numeric.terrain_rgb(F.col("height"))
    return rows.crossJoin(F.broadcast(rows.agg(F.min("height").alias("base")))).select("o_orderkey", r.alias("r"), g.alias("g"), b.alias("b"), "base")
