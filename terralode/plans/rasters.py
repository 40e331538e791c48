"""Raster queries: classes, composites, streams and paths on the grid of orders, and pixels that are line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import numeric
from terralode.operators import grid, spatial, terrain
from terralode.operators.ranks import percentile_row
from terralode.plans.registry import query, read
from terralode.plans.spatial import _CELLS, _FLOW, RINGS_OF_CELLS, cells, ringed, traced_cells
from terralode.streaming.folders import kept

_PIXELS = """
WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity / 10 END AS hand, l_extendedprice / 10000 AS twi, l_partkey::DOUBLE AS flow FROM lineitem)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    hand = F.when(c("l_linenumber") != 6, c("l_quantity") / 10)
    return read(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), hand.alias("hand"), (c("l_extendedprice") / 10_000).alias("twi"), c("l_partkey").cast("double").alias("flow"))


@query(_PIXELS + """
, q AS (SELECT quantile_cont(twi, 0.35) AS p35, quantile_cont(twi, 0.55) AS p55, quantile_cont(twi, 0.5) AS p50, quantile_cont(flow, 0.99) AS p99 FROM x WHERE hand IS NOT NULL),
c AS (SELECT CASE WHEN hand IS NULL THEN 255 WHEN flow > p99 AND hand < 1 THEN 3 WHEN hand < 0.8 AND twi > p55 THEN 2 WHEN hand < 1.5 AND twi > p35 THEN 1 ELSE 0 END AS class,
  CASE WHEN flow > 5000 THEN 3 WHEN flow > 1000 THEN 2 WHEN twi >= p50 THEN 1 ELSE 0 END AS legacy FROM x, q)
SELECT 'current' AS scheme, class::INTEGER AS class, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'legacy', legacy::INTEGER, count(*) FROM c GROUP BY 2
""")
def terrain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood classes by percentiles of valid pixels, and the older classes by fixed bounds."""
    rows = pixels(spark, sf_dir)
    q = percentile_row(rows.where("hand is not null"), ["twi"], [0.35, 0.5, 0.55], kept, 0.0).crossJoin(percentile_row(rows.where("hand is not null"), ["flow"], [0.99], kept, 0.0))
    at = rows.crossJoin(F.broadcast(q))
    c = F.col
    current = terrain.flood_class(c("hand"), c("twi"), c("flow"), c("p35_twi"), c("p55_twi"), c("p99_flow"))
    legacy = terrain.legacy_class(c("twi"), c("flow"), c("p50_twi"))
    both = at.select(F.explode(F.array(F.struct(F.lit("current").alias("scheme"), current.alias("class")), F.struct(F.lit("legacy").alias("scheme"), legacy.alias("class")))).alias("x")).select("x.*")
    return both.groupBy("scheme", "class").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT CASE WHEN l_linenumber = 5 THEN NULL ELSE -l_quantity / 2 END AS sar, l_discount * 8 - 0.2 AS ndvi, l_tax * 8 - 0.1 AS ndwi FROM lineitem),
c AS (SELECT CASE WHEN sar < -15 THEN 1 WHEN ndvi > 0.5 THEN 2 WHEN ndvi > 0.2 THEN 4 WHEN ndvi > -0.1 THEN 3 ELSE 0 END AS k, CASE WHEN ndwi > 0.3 THEN 'agua' WHEN ndvi > 0.5 THEN 'vegetacion_densa' WHEN ndvi > 0.2 THEN 'vegetacion_rala' ELSE 'suelo_desnudo' END AS v FROM x),
n AS (SELECT count(*) AS total FROM c), names(k, name) AS (VALUES (0, 'sin_clasificar'), (1, 'agua'), (2, 'vegetacion_densa'), (3, 'suelo_desnudo'), (4, 'vegetacion_rala'), (5, 'urbano'))
SELECT 'dynamic' AS scheme, name, count(c.k) AS pixeles, round(100.0 * count(c.k) / min(total) + 1e-9, 2)::DOUBLE AS porcentaje FROM names LEFT JOIN c ON c.k = names.k, n GROUP BY 2
UNION ALL SELECT 'index', v, count(*), round(100.0 * count(*) / min(total) + 1e-9, 2)::DOUBLE FROM c, n GROUP BY 2
""")
def class_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels and shares of each class, classes without any too."""
    c = F.col
    sar, ndvi, ndwi = F.when(c("l_linenumber") != 5, -c("l_quantity") / 2), c("l_discount") * 8 - 0.2, c("l_tax") * 8 - 0.1
    rows = read(spark, sf_dir, "lineitem").select(numeric.land_class(sar, ndvi).alias("k"), numeric.vegetation_class(ndvi, ndwi).alias("v"))
    names = spark.createDataFrame(list(enumerate(["sin_clasificar", "agua", "vegetacion_densa", "suelo_desnudo", "vegetacion_rala", "urbano"])), "k int, name string")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    counts = names.join(rows.groupBy("k").agg(F.count("*").alias("pixeles")), "k", "left").na.fill(0, ["pixeles"]).select(F.lit("dynamic").alias("scheme"), "name", "pixeles")
    both = counts.union(rows.groupBy("v").agg(F.count("*").alias("pixeles")).select(F.lit("index"), "v", "pixeles"))
    return both.crossJoin(total).select("scheme", "name", "pixeles", numeric.percent(c("pixeles"), c("total"), 2).alias("porcentaje"))


@query(_PIXELS + """
SELECT id, CASE WHEN hand IS NULL THEN -9999 ELSE hand END::DOUBLE AS stored, floor(least(greatest((twi - 2) / 6, 0), 1) * 255)::INTEGER AS linear, floor(least(greatest(ln(1 + flow) / 13, 0), 1) * 255)::INTEGER AS logarithmic,
  NOT coalesce(hand >= 1 AND hand < 2 OR hand >= 4, false) AS shown, 500000 + (id % 200) * 30.0 AS x, 6000000 - (id % 100) * 30.0 AS y FROM x
""")
def pixel_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodata, rescaled values, hidden ranges (the last one open-ended), and the place of a pixel and back."""
    c = F.col
    rows = pixels(spark, sf_dir)
    col, row = c("id") % 200, c("id") % 100
    x, y = numeric.pixel_to_world(col, row, 500_000.0, 6_000_000.0, 30.0)
    back = numeric.world_to_pixel(x, y, 500_000.0, 6_000_000.0, 30.0)
    hidden = numeric.in_ranges(c("hand"), [(0.0, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, None)], [1, 3])
    out = rows.where((back[0] == col) & (back[1] == row))
    return out.select("id", F.coalesce("hand", F.lit(-9999.0)).alias("stored"), numeric.rescaled(c("twi"), 2.0, 8.0).alias("linear"), numeric.log_rescaled(c("flow")).alias("logarithmic"), (~hidden).alias("shown"), x.alias("x"), y.alias("y"))


@query(f"""
WITH c AS ({_CELLS}) SELECT "row" - 2 AS "row", col - 50 AS col, value FROM c WHERE "row" BETWEEN 2 AND 5 AND col BETWEEN 50 AND 120 AND abs(col - 85) + 4 * abs("row" - 3) <= 40
""")
def cropped_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box whose centres lie in a polygon, with rows and columns from its corner."""
    ring = [(45.0, 3.0), (85.0, -7.0), (125.0, 3.0), (85.0, 13.0)]
    return grid.cropped(cells(spark, sf_dir), (2, 5), (50, 120), [(x + 1e-6 * (x - 85), y + 1e-6 * (y - 3)) for x, y in ring])


@query(_FLOW + """
, acc AS (SELECT r AS "row", c AS col, count(*) AS area FROM t GROUP BY 1, 2), s AS (SELECT "row", col FROM acc WHERE area >= 4),
first AS (SELECT t.r0, t.c0, arg_min(t.r, steps) AS r, arg_min(t.c, steps) AS c FROM t JOIN s ON s."row" = t.r AND s.col = t.c GROUP BY 1, 2)
SELECT c."row", c.col, round(c.value - b.value, 5) AS hand FROM c LEFT JOIN first ON first.r0 = c."row" AND first.c0 = c.col LEFT JOIN c b ON b."row" = first.r AND b.col = first.c
""")
def height_above_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights above the first stream cell downhill, streams being cells through which four drain."""
    flow = kept(grid.downstream(grid.d8_pointers(cells(spark, sf_dir))))
    out = terrain.height_above_stream(flow, grid.traced(flow, kept).select("cell", "area"), 4, grid.traced, kept)
    return out.select(F.shiftright("cell", 32).alias("row"), F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)).alias("col"), F.round("hand", 5).alias("hand"))


@query(_FLOW + """
, acc AS (SELECT r AS "row", c AS col, count(*) AS area FROM t GROUP BY 1, 2)
SELECT r0 AS start_row, c0 AS start_col, count(*) AS pasos, max(area * 25.5) AS acumulacion_max, round(avg(area * 25.5), 4) AS acumulacion_media FROM t JOIN acc ON acc."row" = t.r AND acc.col = t.c WHERE c0 % 20 = 0 GROUP BY 1, 2
""")
def runoff_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of rain from some cells: steps, and the greatest and mean flow along them."""
    flow = kept(grid.downstream(grid.d8_pointers(cells(spark, sf_dir))))
    area = grid.traced(flow, kept).select("cell", "area")
    low = F.col("start").bitwiseAND(F.lit(0xFFFFFFFF))
    starts = flow.select("cell").where(F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF)) % 20 == 0)
    rows = grid.paths(flow, starts, kept).join(area, "cell").groupBy("start").agg(F.count("*").alias("pasos"), F.max(F.col("area") * 25.5).alias("acumulacion_max"), F.round(F.avg(F.col("area") * 25.5), 4).alias("acumulacion_media"))
    return rows.select(F.shiftright("start", 32).alias("start_row"), low.alias("start_col"), "pasos", "acumulacion_max", "acumulacion_media")


@query(f"""
WITH c AS (SELECT "row", col, round(value)::DOUBLE AS z FROM ({_CELLS})),
n AS (SELECT c."row", c.col, c.z AS z5, a.z AS z1, b.z AS z2, d.z AS z3, e.z AS z4, f.z AS z6, g.z AS z7, h.z AS z8, i.z AS z9 FROM c LEFT JOIN c a ON a."row" = c."row" - 1 AND a.col = c.col - 1 LEFT JOIN c b ON b."row" = c."row" - 1 AND b.col = c.col
  LEFT JOIN c d ON d."row" = c."row" - 1 AND d.col = c.col + 1 LEFT JOIN c e ON e."row" = c."row" AND e.col = c.col - 1 LEFT JOIN c f ON f."row" = c."row" AND f.col = c.col + 1 LEFT JOIN c g ON g."row" = c."row" + 1 AND g.col = c.col - 1
  LEFT JOIN c h ON h."row" = c."row" + 1 AND h.col = c.col LEFT JOIN c i ON i."row" = c."row" + 1 AND i.col = c.col + 1),
p AS (SELECT *, ((z4 + z6) / 2 - z5) / 100 AS d, ((z2 + z8) / 2 - z5) / 100 AS e, (-z1 + z3 + z7 - z9) / 400 AS f, (-z4 + z6) / 20 AS g, (z2 - z8) / 20 AS h FROM n)
SELECT "row", col, round(CASE WHEN g * g + h * h = 0 THEN 0 ELSE -2 * (d * g * g + e * h * h + f * g * h) / (g * g + h * h) END, 5) AS curvature FROM p
""")
def profile_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = cells(spark, sf_dir).withColumn("value", F.round("value"))
    return grid.profile_curvature(whole, 10.0).select("row", "col", F.round("curvature", 5).alias("curvature"))


@query("""
WITH s AS (SELECT s_suppkey * 37 % 200 + 0.31 AS x1, s_suppkey * 91 % 200 + 0.47 AS y1, s_suppkey * 37 % 200 + s_suppkey % 23 - 11 + 0.83 AS x2, s_suppkey * 91 % 200 + s_suppkey % 17 - 8 + 0.19 AS y2 FROM supplier),
c AS (SELECT *, unnest(range(floor(least(x1, x2))::BIGINT, floor(greatest(x1, x2))::BIGINT + 1)) AS col FROM s), k AS (SELECT *, unnest(range(floor(least(y1, y2))::BIGINT, floor(greatest(y1, y2))::BIGINT + 1)) AS "row" FROM c)
SELECT DISTINCT "row", col FROM k WHERE greatest(0, least((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), least(("row" - y1) / (y2 - y1), ("row" + 1 - y1) / (y2 - y1)))
  <= least(1, greatest((col - x1) / (x2 - x1), (col + 1 - x1) / (x2 - x1)), greatest(("row" - y1) / (y2 - y1), ("row" + 1 - y1) / (y2 - y1)))
""")
def burned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 37 % 200, k * 91 % 200
    rows = read(spark, sf_dir, "supplier").select((x + 0.31).alias("x1"), (y + 0.47).alias("y1"), (x + k % 23 - 11 + 0.83).alias("x2"), (y + k % 17 - 8 + 0.19).alias("y2"))
    return grid.burned(rows)


@query(f"""
WITH c AS ({_CELLS}), s AS (SELECT "row", col FROM c WHERE value > 400), d AS (SELECT c."row", c.col, min(sqrt((c."row" - s."row") * (c."row" - s."row") + (c.col - s.col) * (c.col - s.col))) AS d FROM c, s GROUP BY 1, 2)
SELECT "row", col, round(d * 30, 4) AS distance FROM d
""")
def stream_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres to the nearest stream cell."""
    out = grid.distances(cells(spark, sf_dir), F.col("value") > 400)
    return out.select("row", "col", F.round(F.col("distance") * 30, 4).alias("distance"))


_WEIGHED = """
, q AS (SELECT {bounds} FROM x WHERE sound)
SELECT id, CASE WHEN sound THEN round(100 * ({score}), 3) END AS score FROM x, q
"""


def _normal(c: str, inverted: bool) -> str:
    share = f"CASE WHEN h_{c} > l_{c} THEN (least(greatest({c}, l_{c}), h_{c}) - l_{c}) / (h_{c} - l_{c}) ELSE 0.5 END"
    return f"(1 - {share})" if inverted else f"({share})"


def _weighed_sql(columns: str, weights: dict[str, float], inverted: tuple[str, ...]) -> str:
    bounds = ", ".join(f"quantile_cont({c}, 0.02) AS l_{c}, quantile_cont({c}, 0.98) AS h_{c}" for c in weights)
    score = " + ".join(f"{w} * {_normal(c, c in inverted)}" for c, w in weights.items())
    sound = " AND ".join(f"{c} IS NOT NULL" for c in weights)
    return f"WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, {columns} FROM lineitem), x AS (SELECT *, {sound} AS sound FROM r)" + _WEIGHED.format(bounds=bounds, score=score)


def _weighed(spark: SparkSession, sf_dir: str, columns: dict[str, Column], weights: dict[str, float], inverted: tuple[str, ...]) -> DataFrame:
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row")
    rows = read(spark, sf_dir, "lineitem").select(key, F.lit(0).alias("col"), *(c.alias(n) for n, c in columns.items()))
    return terrain.weighed(rows, weights, inverted, kept).select(F.col("row").alias("id"), F.round("score", 3).alias("score"))


@query(_weighed_sql("l_quantity AS twi, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice / 1000 END AS hand, l_discount - 0.05 AS curvature, l_tax - 0.04 AS tpi", terrain.FLOOD, ("hand", "curvature", "tpi")))
def flood_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetness, height above the stream, curvature and position, weighed; lower heights, hollows and dips are at risk."""
    c = F.col
    columns = {"twi": c("l_quantity"), "hand": F.when(c("l_linenumber") != 6, c("l_extendedprice") / 1000), "curvature": c("l_discount") - 0.05, "tpi": c("l_tax") - 0.04}
    return _weighed(spark, sf_dir, columns, terrain.FLOOD, ("hand", "curvature", "tpi"))


@query(_weighed_sql("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_suppkey::DOUBLE END AS distance, CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE ln(1 + l_partkey) END AS log_flow, l_extendedprice / 1000 AS hand, l_tax - 0.04 AS tpi", terrain.DRAINAGE, ("hand", "tpi")))
def drainage_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from drains, the logarithm of the flow, height above the stream and position, weighed."""
    c = F.col
    flow = F.when(c("l_partkey") % 10 != 0, F.log1p(c("l_partkey"))).otherwise(F.lit(0.0))
    columns = {"distance": F.when(c("l_linenumber") != 3, c("l_suppkey").cast("double")), "log_flow": flow, "hand": c("l_extendedprice") / 1000, "tpi": c("l_tax") - 0.04}
    return _weighed(spark, sf_dir, columns, terrain.DRAINAGE, ("hand", "tpi"))


@query("""
WITH p AS (SELECT user_id % 5 AS scene, value > 40 AS pred, event_type = 'view' OR value > 60 AS target, event_id % 9 <> 0 AS valid FROM events),
m AS (SELECT scene, count(*) FILTER (valid AND pred AND target) AS tp, count(*) FILTER (valid AND pred AND NOT target) AS fp, count(*) FILTER (valid AND NOT pred AND target) AS fn, count(*) FILTER (valid AND target) AS wet, count(*) FILTER (valid AND NOT target) AS dry FROM p GROUP BY 1),
r AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM m)
SELECT scene, round(tp / (tp + fp + fn + 1e-8), 4) AS iou, round(2 * p * r / (p + r + 1e-8), 4) AS f1, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN wet > 0 THEN least(dry / wet, 100) ELSE 100 END, 4)::DOUBLE AS pos_weight, CASE WHEN wet > 0 THEN greatest(1, dry // wet) ELSE 1 END AS copies FROM r
""")
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, precision and recall of masked predictions by scene, and how rare classes are weighed and repeated."""
    c = F.col
    rows = read(spark, sf_dir, "events").select((c("user_id") % 5).alias("scene"), (c("value") > 40).alias("pred"), ((c("event_type") == "view") | (c("value") > 60)).alias("target"), (c("event_id") % 9 != 0).alias("valid"))
    return numeric.segmentation(rows, "scene", c("pred"), c("target"), c("valid"))


@query(_FLOW + """
, acc AS (SELECT r AS "row", c AS col, count(*) AS area FROM t GROUP BY 1, 2), o AS (SELECT r0, c0, arg_max(r, steps) AS orow, arg_max(c, steps) AS ocol FROM t GROUP BY 1, 2),
lc AS (SELECT orow * 100000 + ocol AS label, acc."row" AS y, acc.col AS x, acc.area FROM acc JOIN o ON o.r0 = acc."row" AND o.c0 = acc.col WHERE area > 3)
""" + RINGS_OF_CELLS + """
SELECT label // 100000 AS outlet_row, label % 100000 AS outlet_col, count(*) AS stream_cells, max(area) AS most, any_value(rings) AS rings, count(*)::DOUBLE AS ring_area, any_value(around) AS perimeter FROM lc JOIN lr USING (label) JOIN lp USING (label) GROUP BY label
""")
def drainage_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells through which more than three drain, by the outlet that they run to, and the rings around them."""
    label = F.col("outlet_row") * 100000 + F.col("outlet_col")
    rows = kept(traced_cells(spark, sf_dir).where("area > 3").withColumn("label", label))
    counts = rows.groupBy("label", "outlet_row", "outlet_col").agg(F.count("*").alias("stream_cells"), F.max("area").alias("most"))
    return counts.join(ringed(rows), "label").drop("label")


@query(_FLOW + """
, pp AS (SELECT "row", col FROM c WHERE ("row" * 200 + col) % 97 = 0), m AS (SELECT r0, c0, arg_min(t.r, steps) AS pr, arg_min(t.c, steps) AS pc FROM t JOIN pp ON pp."row" = t.r AND pp.col = t.c GROUP BY 1, 2)
SELECT pr AS pour_row, pc AS pour_col, count(*) AS n, round(count(*) * 0.09, 2)::DOUBLE AS area_ha FROM m GROUP BY 1, 2
""")
def pour_point_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells whose water meets each pour point first."""
    flow = kept(grid.downstream(grid.d8_pointers(cells(spark, sf_dir))))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.shiftright("cell", 32) * 200 + low("cell")
    zones = terrain.pour_zones(flow, flow.where(key % 97 == 0).select("cell"), grid.traced, kept)
    out = zones.groupBy("point").agg(F.count("*").alias("n"))
    return out.select(F.shiftright("point", 32).alias("pour_row"), low("point").alias("pour_col"), "n", F.round(F.col("n") * 0.09, 2).alias("area_ha"))
