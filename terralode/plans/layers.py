"""Sources and sinks over whole tables: each query writes a table as files of a format in the shared folder and reads these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import geometry, numeric
from terralode.operators import canals, spatial
from terralode.operators import relational as R
from terralode.plans.registry import query, read
from terralode.sources import geojson, kml, tabular
from terralode.streaming.folders import kept, shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terralode/{name}-{uuid.uuid4().hex}"


@query("""
SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, 'Point' AS geometry_type, (c_custkey % 360 - 180)::DOUBLE AS x, (c_custkey % 180 - 90)::DOUBLE AS y FROM customer WHERE c_custkey % 360 - 180 BETWEEN -100 AND 50
""")
def geojson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by nation as FeatureCollections, one file each, read again within an envelope."""
    k = F.col("c_custkey")
    feature = geojson.feature_json(F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("segment")), F.lit("Point"), F.to_json(F.array(k % 360 - 180, k % 180 - 90)))
    rows = read(spark, sf_dir, "customer").select(F.concat_ws("-", "c_nationkey", F.floor(k / 1000)).alias("file"), feature.alias("json"))
    one = rows.groupBy("file").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("json"), ","), F.lit("]}")).alias("value"))
    folder = _folder(spark, "geojson")
    one.write.partitionBy("file").text(folder)
    found = geojson.read_features(spark, folder, (-100.0, -90.0, 50.0, 90.0))
    p = F.col("properties")
    return found.select(p["id"].cast("long").alias("c_custkey"), p["id"].alias("id"), p["segment"].alias("segment"), "geometry_type", F.col("box.min_x").alias("x"), F.col("box.min_y").alias("y"))


@query("""
SELECT s_suppkey, 'P' || (s_suppkey % 40) || ' · ' || s_name || ' · ' || (s_suppkey % 900) || ' m · Alta' AS nombre, 'Nación ' || s_nationkey AS folder, 'P' || (s_suppkey % 40) AS codigo, (s_suppkey % 900)::DOUBLE AS declarada, 'Alta' AS prioridad, 2::INTEGER AS corners FROM supplier
""")
def kml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canals by nation as KML folders, one file each, read and parsed again."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("P"), (k % 40).cast("string"), F.lit(" · "), "s_name", F.lit(" · "), (k % 900).cast("string"), F.lit(" m · Alta"))
    points = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((-k % 60, -k % 30), (-k % 60 - 1, -k % 30 - 1))))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Nación "), F.col("s_nationkey").cast("string")).alias("folder"), k.alias("ord"), kml.placemark_xml(name, points).alias("mark"))
    files = kml.folder_xml(rows, "folder", "ord", "mark").select(F.hash("folder").alias("file"), F.concat(F.lit("<kml><Document>"), "xml", F.lit("</Document></kml>")).alias("value"))
    folder = _folder(spark, "kml")
    files.write.partitionBy("file").text(folder)
    marks = kml.read_placemarks(spark, folder).where("geometry_type = 'LineString'").withColumn("n", canals.parsed_name(F.col("name")))
    key = F.regexp_extract("n.description", r"(\d+)$", 1).cast("long")
    return marks.select(key.alias("s_suppkey"), F.col("name").alias("nombre"), "folder", F.col("n.code").alias("codigo"), F.col("n.declared_m").alias("declarada"), F.col("n.priority").alias("prioridad"), F.size("points").alias("corners"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS cuit, coalesce(c_name, '') AS apellido, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE coalesce(c_mktsegment, '') END AS email, coalesce(regexp_replace(CAST(CAST(CAST(c_acctbal AS VARCHAR) AS DECIMAL(38,2)) AS VARCHAR), '0$', ''), '') AS hectareas FROM customer
""")
def csv_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as CSV uploads whose headers go by other names, read again: texts come back as they were, nulls as empty, and
    hectares with two digits at most, halves of their printed digits rounded away from zero, without exponents."""
    plain = F.regexp_replace(F.round("c_acctbal", 2).cast("decimal(38,2)").cast("string"), "0$", "")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Nro CUIT "), F.col("c_name").alias("Apellidos"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("Mail"), plain.alias("Has"))
    folder = _folder(spark, "uploads")
    as_is = {"header": True, "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**as_is).csv(folder)
    cells = tabular.read_uploads(spark, f"{folder}/*.csv").where("row_number >= 2")
    return cells.select(*(F.col("cells")[c].alias(c) for c in ("cuit", "apellido", "email", "hectareas")))


@query("""
WITH f AS (SELECT o_orderkey AS k, '{"type":"Feature","properties":{"id":' || o_orderkey || '},"geometry":{"type":"Point","coordinates":[' || (o_orderkey % 180) || ',1]}}' AS x, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT n + 1 AS place, CASE WHEN n = 1 THEN '' ELSE ',' END || x AS line FROM f
UNION ALL SELECT 1, '{"type":"FeatureCollection","metadata":{"schema_version":"1.0","generated_at":"2024-01-01T00:00:00Z","source":"orders"},"features":[' UNION ALL SELECT count(*) + 2, ']}' FROM f
""")
def features_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table as one stamped FeatureCollection in ordered parts, line by line with each line's place."""
    k = F.col("o_orderkey")
    json = F.concat(F.lit('{"type":"Feature","properties":{"id":'), k.cast("string"), F.lit('},"geometry":{"type":"Point","coordinates":['), (k % 180).cast("string"), F.lit(",1]}}"))
    rows = read(spark, sf_dir, "orders").select(k.alias("ord"), json.alias("json"))
    folder = _folder(spark, "features")
    geojson.write_features(rows, folder, schema_version="1.0", generated_at="2024-01-01T00:00:00Z", source="orders")
    return geojson.read_lines(spark, folder)


@query("""
WITH l AS (SELECT 't' || (p_size % 5) AS tipo, 'a' || (p_partkey % 3) AS area, p_name AS path, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.cog' END AS cog, p_partkey AS k FROM part)
SELECT tipo, CAST(NULL AS VARCHAR) AS area, arg_max(coalesce(cog, path), k) AS path FROM l WHERE tipo = 't1' GROUP BY 1 UNION ALL SELECT tipo, area, arg_max(coalesce(cog, path), k) FROM l WHERE tipo = 't2' AND area = 'a1' GROUP BY 1, 2
""")
def latest_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of a kind, and of a kind and area, its overview first."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), (F.col("p_size") % 5).cast("string")).alias("tipo"), F.concat(F.lit("a"), (k % 3).cast("string")).alias("area_id"), F.col("p_name").alias("path"), F.when(k % 2 == 0, F.concat("p_name", F.lit(".cog"))).alias("cog_path"), k.alias("created_at")
    )
    one = tabular.latest_layer(rows, "t1").select(F.lit("t1").alias("tipo"), F.lit(None).cast("string").alias("area"), "path")
    return one.union(tabular.latest_layer(rows, "t2", "a1").select(F.lit("t2"), F.lit("a1"), "path"))


@query("""
WITH m AS (SELECT c_custkey AS k, 'Esc. ' || c_mktsegment || ' ' || (c_custkey % 90) AS name FROM customer WHERE c_custkey % 4 <> 0), d AS (SELECT 'Esc. ' || c_mktsegment || ' ' || (c_custkey % 90) AS name, arg_min(c_custkey, c_custkey) AS k FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
i AS (SELECT m.*, row_number() OVER (PARTITION BY trim(regexp_replace(lower(m.name), '[^a-z0-9]+', '-', 'g'), '-') ORDER BY m.k) AS rn, d.k AS dk FROM m LEFT JOIN d ON d.name = m.name)
SELECT k AS ord, '{"type":"Feature","properties":{"id":"' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END || '","nombre":"Escuela ' || name[6:] || '","localidad":"' || coalesce('L' || (dk % 7), '') || '","ambito":"' || coalesce(CASE WHEN dk % 2 = 0 THEN 'Rural' ELSE '' END, '')
  || '","nivel":"' || coalesce('N' || (dk % 3), '') || '"},"geometry":{"type":"Point","coordinates":[' || (-(k % 60))::DOUBLE || ',' || (-(k % 30))::DOUBLE || ']}}' AS json FROM i
""")
def school_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schools with the labels of their descriptions, which another scan has by name; private labels never come out."""
    k, rows = F.col("c_custkey"), read(spark, sf_dir, "customer")
    name = F.concat(F.lit("Esc. "), "c_mktsegment", F.lit(" "), (k % 90).cast("string"))
    html = F.concat(
        F.lit("<b>Director:</b> X<br><b> localidad :</b> L"), (k % 7).cast("string"), F.lit(" <br/>"), F.when(k % 2 == 0, "<b>\u00c1mbito:</b>Rural<br>").otherwise(""), F.lit("<b>Nivel:</b> N"), (k % 3).cast("string"), F.lit("<br><b>Nivel:</b> otro<br>")
    )
    point = F.array(F.struct((-(k % 60)).cast("double").alias("x"), (-(k % 30)).cast("double").alias("y")))
    marks = rows.where(k % 4 != 0).select(k.alias("ord"), name.alias("name"), F.lit(None).cast("string").alias("description"), F.lit("Point").alias("geometry_type"), point.alias("points"))
    texts = rows.where(k % 3 != 0).select(k.alias("ord"), name.alias("name"), html.alias("description"))
    return canals.school_features(canals.schools(canals.described(marks, texts)))


@query("""
WITH c AS (SELECT s_suppkey AS k, 'N' || (s_suppkey % 90 + 1) AS codigo, CASE WHEN s_suppkey % 3 = 0 THEN 'relevado' ELSE 'propuesto' END AS estado, CASE WHEN s_suppkey % 4 = 0 THEN 'Media-Alta' END AS prioridad, 'Canal de la Nación ' || s_nationkey AS d, 'canal-de-la-nacion-' || s_nationkey AS slug FROM supplier),
i AS (SELECT *, lower(codigo) || '-' || slug AS base, row_number() OVER (PARTITION BY estado, codigo, slug ORDER BY k) AS rn FROM c)
SELECT estado, k AS ord, '{"id":"' || base || CASE WHEN rn > 1 THEN '-zona-' || (rn - 2) ELSE '' END || '","nombre":"' || codigo || ' · ' || d || CASE WHEN prioridad IS NULL THEN '' ELSE ' · MEDIA ALTA ★ x' END || '","codigo":"' || codigo || '"' || CASE WHEN prioridad IS NOT NULL THEN ',"prioridad":"Media-Alta"' WHEN estado = 'relevado' THEN '' ELSE ',"prioridad":null' END
  || ',"longitud_m":0.0,"featured":' || (prioridad IS NOT NULL) || ',"estado":"' || estado || '"}' AS json, (SELECT count(*) FROM c WHERE estado = 'relevado') AS relevados, (SELECT count(*) FROM c) AS total, 0::BIGINT AS failures FROM i
""")
def canal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of surveyed and proposed canals, with its counts and the names that couldn't be parsed."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("N"), (k % 90 + 1).cast("string"), F.lit(" · Canal de la Nación "), F.col("s_nationkey").cast("string"), F.when(k % 4 == 0, " · MEDIA ALTA ★ x").otherwise(""))
    point = F.array(F.struct(F.lit(-62.0).alias("x"), F.lit(-32.0).alias("y")))
    marks = read(spark, sf_dir, "supplier").select(
        F.when(k % 3 == 0, "relevado").otherwise("propuesto").alias("source"), k.alias("ord"), name.alias("name"), F.lit("Zona").alias("folder"), F.lit(None).cast("string").alias("style"), F.lit("LineString").alias("geometry_type"), point.alias("points")
    )
    both = canals.canals(marks.where("source = 'relevado'"), "relevado").union(canals.canals(marks.where("source = 'propuesto'"), "propuesto"))
    counts = canals.index_counts(both).crossJoin(canals.parse_failures(both))  # single rows
    return canals.canal_index(both).crossJoin(F.broadcast(counts)).select("estado", "ord", "json", "relevados", "total", "failures")


@query("""
WITH l AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'vt_' ELSE 'geo_' END || lower(p_brand) AS id, CASE p_partkey % 4 WHEN 0 THEN 'MULTIPOLYGON' WHEN 1 THEN 'LINESTRING' WHEN 2 THEN 'POINT' END AS geom FROM part)
SELECT id, CASE geom WHEN 'MULTIPOLYGON' THEN 'polygon' WHEN 'LINESTRING' THEN 'line' WHEN 'POINT' THEN 'point' ELSE 'unknown' END AS geometry_type, 'https://tiles/' || id || '/{z}/{x}/{y}' AS url, count(*) AS n, '#3b82f6' AS style FROM l WHERE id LIKE 'vt~_%' ESCAPE '~' AND geom IS NOT NULL GROUP BY 1, 2
""")
def tile_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector layers by prefix, with plain geometry types, their address and a style; layers without geometry are left out."""
    k = F.col("p_partkey")
    geom = F.when(k % 4 == 0, "MULTIPOLYGON").when(k % 4 == 1, "LINESTRING").when(k % 4 == 2, "POINT")
    rows = read(spark, sf_dir, "part").select(F.concat(F.when(k % 3 == 0, "vt_").otherwise("geo_"), F.lower("p_brand")).alias("id"), geom.alias("geom"))
    found = tabular.vector_layers(rows.where("geom is not null"), "id", "geom", "https://tiles/")
    return found.groupBy("id", "geometry_type", "url").agg(F.count("*").alias("n")).withColumn("style", F.lit("#3b82f6"))


@query("""
WITH z AS (SELECT c_custkey AS zone, (c_custkey % 100)::DOUBLE AS hci, (c_custkey * 37 % 1000) / 100.0 AS x, (c_custkey * 91 % 1000) / 100.0 AS y FROM customer WHERE c_custkey % 100 >= 50),
c AS (SELECT s_suppkey, (s_suppkey * 53 % 1000) / 100.0 AS x1, (s_suppkey * 29 % 1000) / 100.0 AS y1, (s_suppkey * 53 % 1000) / 100.0 + 0.02 AS x2, (s_suppkey * 29 % 1000) / 100.0 AS y2 FROM supplier),
d AS (SELECT zone, hci, min(sqrt((x - greatest(least(x, x2), x1)) ** 2 + (y - y1) ** 2)) * 111 AS km FROM z, c GROUP BY 1, 2)
SELECT zone, round(km, 2) AS gap_km, hci AS hci_score, CASE WHEN hci > 80 AND km > 5 THEN 'critico' WHEN hci > 60 AND km > 3 THEN 'alto' ELSE 'moderado' END AS severity FROM d WHERE km >= 2
""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of a high index whose centre is far from the nearest canal, with the gap's severity."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    zones = read(spark, sf_dir, "customer").where(c % 100 >= 50).select(c.alias("zone"), (c % 100).cast("double").alias("hci"), (c * 37 % 1000 / 100.0).alias("x"), (c * 91 % 1000 / 100.0).alias("y"))
    x, y = s * 53 % 1000 / 100.0, s * 29 % 1000 / 100.0
    lines = read(spark, sf_dir, "supplier").select(s.alias("canal"), F.array(geometry.point(x, y), geometry.point(x + 0.02, y)).alias("line"))
    near = spatial.nearest_lines(zones, lines, "zone", "canal", 0.25, kept)
    rows = zones.join(near, "zone").withColumn("km", F.col("distance") * 111).where("km >= 2")
    return rows.select("zone", F.round("km", 2).alias("gap_km"), F.col("hci").alias("hci_score"), numeric.gap_severity(F.col("hci"), F.col("km")).alias("severity"))


@query("""
WITH g AS (SELECT o_orderkey // 200 AS "row", o_orderkey % 200 AS col, o_totalprice AS value FROM orders), z AS (SELECT s_suppkey, s_suppkey * 37 % 250 + 0.5 AS x, s_suppkey % 40 + 0.25 AS y FROM supplier)
SELECT s_suppkey, coalesce(value, 0) AS sampled, value IS NULL AS outside FROM z LEFT JOIN g ON g.col = floor(x) AND g."row" = floor(y)
""")
def point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell under each point; 0 outside of the grid."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    cells = read(spark, sf_dir, "orders").select(F.floor(o / 200).cast("long").alias("row"), (o % 200).alias("col"), F.col("o_totalprice").alias("value"))
    points = read(spark, sf_dir, "supplier").select("s_suppkey", (k * 37 % 250 + 0.5).alias("x"), (k % 40 + 0.25).alias("y"))
    col, row = F.floor("x").cast("long"), F.floor("y").cast("long")
    return points.withColumn("row", row).withColumn("col", col).join(cells, ["row", "col"], "left").select("s_suppkey", F.coalesce("value", F.lit(0.0)).alias("sampled"), F.col("value").isNull().alias("outside"))


@query("""
WITH s AS (SELECT c_custkey % 25 AS zone, 'flood' AS tipo, c_custkey AS k, c_acctbal AS mean_score FROM customer)
SELECT n_name AS zona, tipo, max(k) AS latest, round(CAST(sum(CAST(mean_score AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(*) AS n FROM s JOIN nation ON n_nationkey = zone WHERE n_name LIKE 'NATION_1%' OR n_regionkey = 2 GROUP BY 1, 2
""")
def zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics with the attributes of their zone, of an area by name or by basin."""
    c = F.col("c_custkey")
    stats = read(spark, sf_dir, "customer").select((c % 25).alias("zone"), F.lit("flood").alias("tipo"), c.alias("at"), F.col("c_acctbal").alias("mean_score"))
    zones = R.prefix_or_equal(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), "n_name", F.col("n_regionkey").cast("string").alias("cuenca")), "n_name", "NATION_1%", "cuenca", "2")
    return stats.join(zones, "zone").groupBy(F.col("n_name").alias("zona"), "tipo").agg(F.max("at").alias("latest"), F.round(F.sum(F.col("mean_score").cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.count("*").alias("n"))


@query("""
SELECT scene_day, scenes, CAST(row_number() OVER (ORDER BY scene_day) AS INTEGER) AS place, clearest FROM (SELECT CAST(l_shipdate AS DATE) AS scene_day, count(DISTINCT l_partkey % 50) AS scenes, arg_min(l_orderkey * 10 + l_linenumber, l_discount * 1e12 + l_orderkey * 10 + l_linenumber) AS clearest FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount < 0.09 GROUP BY 1)
""")
def scene_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct days of scenes below a share of clouds, in order, with each day's clearest scene."""
    from pyspark.sql import Window

    c = F.col
    key = c("l_orderkey") * 10 + c("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").where((c("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (c("l_discount") < 0.09))
    days = rows.groupBy(F.to_date("l_shipdate").alias("scene_day")).agg(F.count_distinct(c("l_partkey") % 50).alias("scenes"), F.min_by(key, F.struct("l_discount", key)).alias("clearest"))
    return days.withColumn("place", F.row_number().over(Window.orderBy("scene_day")))  # a row for each day


@query("""
WITH f AS (SELECT s_suppkey AS k, '{"type":"Feature","properties":{"id":' || s_suppkey || '},"geometry":null}' AS x, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
SELECT n + 1 AS place, CASE WHEN n = 1 THEN '' ELSE ',' END || x AS line FROM f
UNION ALL SELECT 1, '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:5347"}},"metadata":{"schema_version":"1.0","generated_at":"2024-01-01T00:00:00Z","source":"suppliers"},"features":[' UNION ALL SELECT count(*) + 2, ']}' FROM f
""")
def features_with_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FeatureCollection that names its reference system."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(k.alias("ord"), F.concat(F.lit('{"type":"Feature","properties":{"id":'), k.cast("string"), F.lit('},"geometry":null}')).alias("json"))
    folder = _folder(spark, "crs")
    geojson.write_features(rows, folder, schema_version="1.0", generated_at="2024-01-01T00:00:00Z", source="suppliers", crs="EPSG:5347")
    return geojson.read_lines(spark, folder)
