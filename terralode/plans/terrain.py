"""Terrain queries on the grid of orders (see spatial.cells)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.operators import terrain
from terralode.plans.registry import query
from terralode.plans.spatial import _CELLS, _FLOW, RINGS_OF_CELLS, cells, ringed, traced_cells
from terralode.streaming.folders import kept

_WINDOW = f"""
WITH c AS (SELECT "row", col, round(value)::DOUBLE AS value FROM ({_CELLS})),
w AS (SELECT a."row", a.col, a.value, avg(b.value) AS mean, stddev_pop(b.value) AS std FROM c a JOIN c b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3)
"""


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("value", F.round("value"))


@query(_WINDOW + 'SELECT "row", col, round(CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END, 4) AS tpi FROM w')
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.position_index(whole(spark, sf_dir), 2).select("row", "col", F.round("tpi", 4).alias("tpi"))


@query(f"""
WITH c AS (SELECT "row", col, floor(value) % 4 AS value FROM ({_CELLS})),
n AS (SELECT a."row", a.col, b.value, count(*) AS n FROM c a JOIN c b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3)
SELECT "row", col, arg_max(value, n * 10 - value)::DOUBLE AS mode FROM n GROUP BY 1, 2
""")
def focal_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = cells(spark, sf_dir).withColumn("value", (F.floor("value") % 4).cast("double"))
    return terrain.focal_mode(classes, 1)


@query(f"""
WITH c AS ({_CELLS}) SELECT "row" // 2 AS "row", col // 2 AS col, arg_min(value, "row" * 1000 + col) AS value FROM c GROUP BY 1, 2
""")
def grid_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.overview(cells(spark, sf_dir))


@query(_FLOW + """
, o AS (SELECT r0, c0, arg_max(r, steps) AS outlet_row, arg_max(c, steps) AS outlet_col FROM t GROUP BY 1, 2), lc AS (SELECT outlet_row * 100000 + outlet_col AS label, r0 AS y, c0 AS x FROM o)
""" + RINGS_OF_CELLS + """
SELECT outlet_row, outlet_col, count(*) AS n, round(count(*) * 0.09, 2)::DOUBLE AS area_ha, any_value(rings) AS rings, count(*)::DOUBLE AS ring_area, any_value(around) AS perimeter
FROM o JOIN lr ON lr.label = outlet_row * 100000 + outlet_col JOIN lp USING (label) GROUP BY 1, 2 HAVING count(*) * 0.09 >= 0.5
""")
def basin_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that drain to one outlet, from half a hectare on, with the rings around them."""
    flow = kept(traced_cells(spark, sf_dir).withColumn("outlet", F.struct("outlet_row", "outlet_col")).withColumn("label", F.col("outlet_row") * 100000 + F.col("outlet_col")))
    found = terrain.basins(flow, 0.09, 0.5).select("outlet.outlet_row", "outlet.outlet_col", "n", "area_ha").withColumn("label", F.col("outlet_row") * 100000 + F.col("outlet_col"))
    return found.join(ringed(flow), "label").drop("label")


@query(_FLOW + """
, o AS (SELECT r0 AS "row", c0 AS col, arg_max(r, steps) AS rr, arg_max(c, steps) AS cc FROM t GROUP BY 1, 2), acc AS (SELECT r AS "row", c AS col, count(*) AS flow FROM t GROUP BY 1, 2),
x AS (SELECT o."row", o.col, a.value - b.value AS hand, acc.flow::DOUBLE AS flow FROM o JOIN c a ON a."row" = o."row" AND a.col = o.col JOIN c b ON b."row" = rr AND b.col = cc JOIN acc ON acc."row" = o."row" AND acc.col = o.col),
q AS (SELECT quantile_cont(hand, 0.02) AS lh, quantile_cont(hand, 0.98) AS hh, quantile_cont(flow, 0.02) AS lf, quantile_cont(flow, 0.98) AS hf FROM x)
SELECT "row", col, round(hand, 5) AS hand, round(100 * (0.6 * (1 - CASE WHEN hh > lh THEN (least(greatest(hand, lh), hh) - lh) / (hh - lh) ELSE 0.5 END) + 0.4 * CASE WHEN hf > lf THEN (least(greatest(flow, lf), hf) - lf) / (hf - lf) ELSE 0.5 END), 3) AS risk FROM x, q
""")
def flood_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above the outlet and flow, scaled between their percentiles and weighed."""
    heights = cells(spark, sf_dir)
    flow = traced_cells(spark, sf_dir)
    outlet = heights.select(F.col("row").alias("outlet_row"), F.col("col").alias("outlet_col"), F.col("value").alias("base"))
    rows = flow.join(heights, ["row", "col"]).join(outlet, ["outlet_row", "outlet_col"])
    rows = rows.select("row", "col", (F.col("value") - F.col("base")).alias("hand"), F.col("area").cast("double").alias("flow"))
    bounds = terrain.percentile_bounds(rows, ["hand", "flow"], kept)
    risk = terrain.composite(rows, {"hand": 0.6, "flow": 0.4}, ("hand",))
    return rows.crossJoin(F.broadcast(bounds)).select("row", "col", F.round("hand", 5).alias("hand"), F.round(risk, 3).alias("risk"))


@query(f"""
WITH c AS (SELECT "row", col, value / 10 AS value FROM ({_CELLS})), a AS (SELECT c."row", c.col, any_value(c.value) AS value, min(n.value) AS low FROM c JOIN c n ON n."row" BETWEEN c."row" - 3 AND c."row" + 3 AND n.col BETWEEN c.col - 3 AND c.col + 3 GROUP BY 1, 2),
b AS (SELECT a."row", a.col, any_value(a.value) AS value, max(n.low) AS opened FROM a JOIN a n ON n."row" BETWEEN a."row" - 3 AND a."row" + 3 AND n.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY 1, 2)
SELECT "row", col, round(CASE WHEN value - opened > 30 * tan(radians(5)) THEN opened ELSE value END, 6) AS value, value - opened > 30 * tan(radians(5)) AS removed FROM b
""")
def off_terrain_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights without what is narrower than seven cells and rises more steeply than five degrees."""
    heights = cells(spark, sf_dir).withColumn("value", F.col("value") / 10)
    out = terrain.without_objects(heights, 30.0)
    return out.select("row", "col", F.round("value", 6).alias("value"), "removed")
