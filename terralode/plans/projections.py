"""Projections, measures on the ellipsoid, strict validators and changes between dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import geometry, numeric, projection, text
from terralode.plans.registry import query, read


def _place(key: str):
    k = F.col(key)
    return -63.5 + k * 37 % 1000 / 250.0, -32.5 - k * 91 % 1000 / 500.0


_SERIES = """
WITH f AS (SELECT 1 / 298.257223563 AS f), c AS (SELECT f / (2 - f) AS n FROM f),
k AS (SELECT n, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM c),
p AS (SELECT s_suppkey, -63.5 + s_suppkey * 37 % 1000 / 250.0::DOUBLE AS lon, -32.5 - s_suppkey * 91 % 1000 / 500.0::DOUBLE AS lat FROM supplier),
z AS (SELECT *, floor((lon + 180) / 6)::INTEGER AS zone, sin(radians(lat)) AS s, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS dl FROM p),
t AS (SELECT z.*, k.*, 0.5 * ln((1 + s) / (1 - s)) - e * 0.5 * ln((1 + e * s) / (1 - e * s)) AS q FROM z, k),
u AS (SELECT *, (exp(q) - exp(-q)) / 2 AS th FROM t),
x AS (SELECT *, atan2(th, cos(dl)) AS xi, 0.5 * ln((1 + sin(dl) / sqrt(1 + th * th)) / (1 - sin(dl) / sqrt(1 + th * th))) AS eta FROM u),
y AS (SELECT *, eta + a1 * cos(2 * xi) * (exp(2 * eta) - exp(-2 * eta)) / 2 + a2 * cos(4 * xi) * (exp(4 * eta) - exp(-4 * eta)) / 2 + a3 * cos(6 * xi) * (exp(6 * eta) - exp(-6 * eta)) / 2 AS e1,
  xi + a1 * sin(2 * xi) * (exp(2 * eta) + exp(-2 * eta)) / 2 + a2 * sin(4 * xi) * (exp(4 * eta) + exp(-4 * eta)) / 2 + a3 * sin(6 * xi) * (exp(6 * eta) + exp(-6 * eta)) / 2 AS n1 FROM x)
"""


@query(_SERIES + """
SELECT s_suppkey, round(500000 + 0.9996 * r * e1, 3) AS east, round(10000000 + 0.9996 * r * n1, 3) AS north, round(lon, 8) AS lon, round(lat, 8) AS lat, (32700 + zone + 1)::INTEGER AS epsg,
  round(0.01 * 111320 * cos(radians(lat)) * 0.02 * 111320 / 10000, 4) AS cell_ha FROM y
""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points to their zone's plane and back, the zone's code, and the area of a cell of some hundredths of a degree there."""
    lon, lat = _place("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"))
    central = projection.utm_central(F.col("lon"))
    rows = rows.withColumns(dict(zip(("east", "north"), projection.transverse_mercator(F.col("lon"), F.col("lat"), central), strict=True))).withColumn("central", central)
    back = projection.inverse_mercator(F.col("east"), F.col("north"), F.col("central"))
    return rows.select(
        "s_suppkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(back[0], 8).alias("lon"), F.round(back[1], 8).alias("lat"), numeric.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"),
        F.round(projection.degrees_area(F.lit(0.01), F.lit(0.02), F.col("lat")), 4).alias("cell_ha"),
    )


@query("""
WITH p AS (SELECT s_suppkey AS id, unnest([0, 1, 2]) AS i, -63.5 + s_suppkey * 37 % 1000 / 250.0::DOUBLE AS x, -32.5 - s_suppkey * 91 % 1000 / 500.0::DOUBLE AS y FROM supplier),
v AS (SELECT id, i, x + [0, 0.05 + id % 7 / 100.0, -0.02][i + 1] AS x, y + [0, 0.03, 0.01 + id % 5 / 100.0][i + 1] AS y FROM p), f AS (SELECT 1 / 298.257223563 AS f),
e AS (SELECT a.id, atan((1 - f) * tan(radians(a.y))) AS b1, atan((1 - f) * tan(radians(b.y))) AS b2, radians(b.x - a.x) / 2 AS dl, f FROM v a JOIN v b ON b.id = a.id AND b.i = a.i + 1, f),
s AS (SELECT *, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q, 2 * asin(sqrt(sin((b2 - b1) / 2) ** 2 + cos(b1) * cos(b2) * sin(dl) ** 2)) AS g FROM e)
SELECT id AS s_suppkey, round(sum(6378137.0 * (g - f / 2 * ((g - sin(g)) * (sin(p) * cos(q)) ** 2 / cos(g / 2) ** 2 + (g + sin(g)) * (cos(p) * sin(q)) ** 2 / sin(g / 2) ** 2))), 3) AS metres, 0.0::DOUBLE AS of_one_point FROM s GROUP BY 1
""")
def geodesic_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths on the ellipsoid of lines of three points, and of one."""
    k, (x, y) = F.col("s_suppkey"), _place("s_suppkey")
    line = F.array(geometry.point(x, y), geometry.point(x + 0.05 + k % 7 / 100.0, y + 0.03), geometry.point(x - 0.02, y + 0.01 + k % 5 / 100.0))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", line.alias("line"))
    return rows.select("s_suppkey", F.round(geometry.line_length(F.col("line"), projection.geodesic), 3).alias("metres"), geometry.line_length(F.slice("line", 1, 1), projection.geodesic).alias("of_one_point"))


@query("""
WITH d AS (SELECT c_custkey, lpad((20000000000 + c_custkey * 7919 % 10000000000)::VARCHAR, 11, '0')[1:10] AS d FROM customer),
w AS (SELECT *, 11 - (5 * d[1]::INT + 4 * d[2]::INT + 3 * d[3]::INT + 2 * d[4]::INT + 7 * d[5]::INT + 6 * d[6]::INT + 5 * d[7]::INT + 4 * d[8]::INT + 3 * d[9]::INT + 2 * d[10]::INT) % 11 AS r FROM d),
c AS (SELECT c_custkey, CASE r WHEN 11 THEN 0 WHEN 10 THEN 9 ELSE r END AS right_digit FROM w)
SELECT c_custkey, right_digit = c_custkey % 10 AS plain, right_digit = c_custkey % 10 AND c_custkey % 3 <> 0 AS dashed, NULL::BOOLEAN IS NOT NULL AS of_null, hex(encode(c_name)) AS bytes, c_custkey % 2 = 1 AS not_a_url FROM c JOIN customer USING (c_custkey)
""")
def strict_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax numbers with right and wrong digits, plain and with dashes in right and wrong places; bytes of data URLs."""
    k = F.col("c_custkey")
    digits = F.substring(F.lpad((k * 7919 % 10_000_000_000 + 20_000_000_000).cast("string"), 11, "0"), 1, 10)
    number = F.concat(digits, (k % 10).cast("string"))
    dashed = F.when(k % 3 == 0, F.concat(F.substring(number, 1, 3), F.lit("-"), F.substring(number, 4, 8))).otherwise(F.concat_ws("-", F.substring(number, 1, 2), F.substring(number, 3, 8), F.substring(number, 11, 1)))
    url = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("c_name").cast("binary")))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", text.is_cuit(number).alias("plain"), text.is_cuit(dashed).alias("dashed"), text.is_cuit(F.lit(None).cast("string")).alias("of_null"),
        F.hex(text.data_url_bytes(url)).alias("bytes"), text.data_url_bytes(F.when(k % 2 == 1, "file:x").otherwise(url)).isNull().alias("not_a_url"),
    )


@query("""
SELECT s_suppkey, round(0.0195 * (100 + s_suppkey % 900) ** 0.77 * greatest((s_suppkey % 50) / 1000.0, 0.0001) ** -0.385, 5) AS minutes FROM supplier
""")
def concentration_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that water takes along a course; level ground counts as a slope of a ten-thousandth."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(numeric.kirpich((k % 900 + 100).cast("double"), k % 50 / 1000.0), 5).alias("minutes"))


@query("""
WITH d AS (SELECT o_custkey AS zone, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), w AS (SELECT zone, day, (k * 37 % 1000) / 7.0 AS ha, (k * 91 % 1000) / 100.0 AS pct FROM d),
e AS (SELECT zone, min(day) AS a, max(day) AS b FROM w GROUP BY 1 HAVING count(*) > 1)
SELECT e.zone, a AS from_date, b AS to_date, round(y.ha - x.ha, 2) AS area_change, round(y.pct - x.pct, 2) AS share_change, CASE WHEN y.pct > x.pct + 1 THEN 'increasing' WHEN y.pct < x.pct - 1 THEN 'decreasing' ELSE 'stable' END AS trend
FROM e JOIN w x ON x.zone = e.zone AND x.day = a JOIN w y ON y.zone = e.zone AND y.day = b
""")
def water_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water of each zone on the first and the last day that could be read: changes of area and share, and the trend."""
    days = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("zone"), F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderkey").alias("k"))
    rows = days.select("zone", "day", (F.col("k") * 37 % 1000 / 7.0).alias("ha"), (F.col("k") * 91 % 1000 / 100.0).alias("pct"))
    return numeric.first_last_change(rows, "zone", "day", "ha", "pct")
