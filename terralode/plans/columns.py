"""Queries that run the column functions on texts, numbers, dates and maps over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import maps, numeric, temporal, text
from terralode.plans.registry import query, read


@query("""
WITH c AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN '+54 351 ' || (5550000 + c_custkey % 9999) WHEN 1 THEN '0351-' || (5550000 + c_custkey % 9999) WHEN 2 THEN '123' WHEN 3 THEN '3515' || (550000 + c_custkey % 9999) WHEN 4 THEN NULL ELSE '+1 5551234567' END AS phone,
  CASE c_custkey % 5 WHEN 0 THEN 'a' || c_custkey || '@x.ar' WHEN 1 THEN 'a@@x' WHEN 2 THEN repeat('a', 250) || '@x.ar' WHEN 3 THEN NULL ELSE 'a@-x.ar' END AS mail FROM customer)
SELECT k, k % 6 IN (0, 1, 3) AS phone_ok, k % 5 = 0 AS mail_ok, '<a&b>' || k AS raw, '&lt;a&amp;b&gt;' || k AS escaped FROM c
""")
def text_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    near = (5_550_000 + k % 9999).cast("string")
    phone = F.when(k % 6 == 0, F.concat(F.lit("+54 351 "), near)).when(k % 6 == 1, F.concat(F.lit("0351-"), near)).when(k % 6 == 2, "123").when(k % 6 == 3, F.concat(F.lit("3515"), (550_000 + k % 9999).cast("string"))).when(k % 6 == 5, "+1 5551234567")
    mail = F.when(k % 5 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@x.ar"))).when(k % 5 == 1, "a@@x").when(k % 5 == 2, F.concat(F.lit("a" * 250), F.lit("@x.ar"))).when(k % 5 == 4, "a@-x.ar")
    raw = F.concat(F.lit("<a&b>"), k.cast("string"))
    return read(spark, sf_dir, "customer").select(k.alias("k"), text.is_phone(phone).alias("phone_ok"), text.is_email(mail).alias("mail_ok"), raw.alias("raw"), text.xml_escape(raw).alias("escaped"))


@query(r"""
SELECT p_partkey, CASE WHEN p_partkey % 2000 < 1000 THEN (p_partkey % 2000) || ' m' ELSE format('{:.1f} km', (p_partkey % 2000 + 0.2) / 1000) END AS distance, CASE WHEN p_partkey * 7 < 10000 THEN (p_partkey * 7) || ' m²' ELSE format('{:.1f} ha', (p_partkey * 7 + 0.2) / 10000) END AS area,
  CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 900) || ' m' ELSE (p_partkey % 900) || ' m · (' || (p_partkey % 900 + 5) || ' m declarada)' END AS length, '$ ' || format('{:,.2f}', p_size * 1000.25) AS money, 'Puntos ' || CASE WHEN p_size % 2 = 0 THEN 'Conflicto' ELSE 'Canal' END AS title,
  CASE WHEN p_size % 4 = 0 THEN 'III' WHEN p_size % 4 = 1 THEN 'VIII' WHEN p_size % 4 = 2 THEN 'I' END AS soil, 'b' AS last, 'x,y' AS checklist, 'zona_n_' || p_size || '_2024-01-02' AS file, CASE WHEN p_size % 2 = 0 THEN 'Escuela ' || p_size ELSE 'Capa ' || (p_partkey + 1) END AS feature,
  'Siembra directa' AS human FROM part
""")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    s = size.cast("string")
    soil = F.when(size % 4 == 0, " iiiws").when(size % 4 == 1, "VIII").when(size % 4 == 2, "i c").otherwise("x")
    properties = F.create_map(F.lit("nombre"), F.lit(" "), F.lit("name"), F.when(size % 2 == 0, F.concat(F.lit("Esc. "), s)))
    length = (k % 900).cast("double")
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.distance_text(k % 2000 + 0.2).alias("distance"), text.area_text(k * 7 + 0.2).alias("area"), text.length_text(length, F.when(k % 3 == 0, length + 0.4).otherwise(length + 5)).alias("length"),
        text.money_text(size * 1000.25).alias("money"), text.title_from_id(F.when(size % 2 == 0, "vt_puntos_conflicto").otherwise("vt_puntos_canal")).alias("title"), text.soil_class(soil).alias("soil"), text.last_segment(F.concat(F.lit("a/"), s, F.lit("/b/"))).alias("last"),
        F.array_join(text.checklist(F.lit(" x \n\r\n y\n")), ",").alias("checklist"), text.file_name(F.concat(F.lit("Zona Ñ "), s), F.lit("2024-01-02").cast("date")).alias("file"), text.feature_name(properties, k, "Capa").alias("feature"),
        text.humanised(F.lit("siembra_directa"), {"capacitacion": "Capacitación"}).alias("human"),
    )


@query("""
SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE), 0) AS safe, CASE WHEN l_linenumber = 2 THEN NULL ELSE round(l_quantity * 1234 / 10000, 1) END AS ha,
  round(round(least(greatest(100 * (0.40 * least(l_extendedprice / 10000, 1) + 0.30 * least(l_quantity / 10, 1) + 0.30 * CASE WHEN l_linenumber = 1 THEN 0 ELSE greatest(1 - l_partkey % 2000 / 1000, 0) END), 0), 100), 2) + 1e-9, 1) AS canal,
  CASE WHEN l_linenumber = 4 THEN 0 ELSE round(round(least(greatest(100 * (0.30 * least(l_extendedprice / 10000, 1) + 0.25 * greatest(1 - l_quantity / 5, 0) + 0.25 * least(greatest(l_discount * 100 / 15, 0), 1) + 0.20 * greatest(1 - l_suppkey % 900 / 500, 0)), 0), 100), 2) + 1e-9, 1) END AS road,
  CASE WHEN l_quantity * 2 > 80 AND l_partkey % 9 > 5 THEN 'critico' WHEN l_quantity * 2 > 60 AND l_partkey % 9 > 3 THEN 'alto' ELSE 'moderado' END AS gap, CASE WHEN l_linenumber = 5 THEN 0.5 ELSE round(least(l_quantity / 45, 1), 6) END AS share, round(ln(1 + l_extendedprice), 6) AS log_flow,
  CASE l_linenumber % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.75 WHEN 2 THEN 0.05 ELSE 0.4 END AS c, round(CASE l_linenumber % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.75 WHEN 2 THEN 0.05 ELSE 0.4 END * 50 * l_quantity / 360, 6) AS flow,
  CASE WHEN l_tax * 100 > l_discount * 100 + 1 THEN 'increasing' WHEN l_tax * 100 < l_discount * 100 - 1 THEN 'decreasing' ELSE 'stable' END AS trend FROM lineitem
""")
def numeric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant casts, priorities of canals, risks of roads, gaps, shares, runoff and trends."""
    c, n = F.col, F.col("l_linenumber")
    canal = numeric.canal_priority(c("l_extendedprice"), c("l_quantity"), F.when(n != 1, (c("l_partkey") % 2000).cast("double")))
    road = numeric.road_risk(c("l_extendedprice"), c("l_quantity"), F.when(n != 4, c("l_discount") * 100), (c("l_suppkey") % 900).cast("double"))
    cover = numeric.runoff_c(F.when(n % 4 == 0, 10).when(n % 4 == 1, 50).when(n % 4 == 2, 80).otherwise(77))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.safe_double(F.when(n == 3, "x").otherwise(c("l_quantity").cast("string"))).alias("safe"), numeric.hectares(F.when(n != 2, c("l_quantity") * 1234)).alias("ha"),
        F.round(canal + 1e-9, 1).alias("canal"), F.round(F.when(n == 4, 0.0).otherwise(road + 1e-9), 1).alias("road"), numeric.gap_severity(c("l_quantity") * 2, c("l_partkey") % 9).alias("gap"), F.round(numeric.zonal_share(F.when(n != 5, c("l_quantity")), 45.0), 6).alias("share"),
        F.round(F.log1p("l_extendedprice"), 6).alias("log_flow"), cover.alias("c"), F.round(numeric.rational_flow(cover, F.lit(50), c("l_quantity")), 6).alias("flow"), numeric.trend(c("l_discount") * 100, c("l_tax") * 100).alias("trend"),
    )


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, d - 10 AS low, d + 10 AS high, date_trunc('month', d)::DATE AS first, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE AS next, (d - INTERVAL 2 YEAR)::DATE AS back, d - 180 AS months_6, d - 720 AS months_24, CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE o_orderkey % 3 * 7 END::INTEGER AS days,
  strftime(d, '%Y-%m-%dT00:00:00Z') AS stamp, strftime(d, '%Y-%m-%d') AS day, CASE o_orderkey % 4 WHEN 0 THEN 'Ahora mismo' WHEN 1 THEN 'Hace 5 minutos' WHEN 2 THEN 'Hace 1 hora' ELSE 'Hace 2 dias' END AS ago, strftime(d, '%d/%m/%Y 00:00') AS moment FROM d
""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    (low, high), (first, after) = temporal.around(day, 10), temporal.month_bounds(day)
    back = temporal.months_back(day)
    moment = day.cast("timestamp")
    seconds = F.when(k % 4 == 0, 20).when(k % 4 == 1, 330).when(k % 4 == 2, 3600 + 9).otherwise(2 * 86_400 + 7)
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", low.alias("low"), high.alias("high"), first.alias("first"), after.alias("next"), temporal.years_back(day, 2).alias("back"), back[0].alias("months_6"), back[3].alias("months_24"),
        temporal.buffer_days(day, F.date_add(day, (k % 3 * 7).cast("int"))).alias("days"), temporal.iso_z(moment).alias("stamp"), temporal.day_of_epoch(F.unix_millis(moment)).alias("day"), temporal.ago_text(seconds).alias("ago"), text.moment_text(moment).alias("moment"),
    )


@query("""
WITH e AS (SELECT event_id, user_id % 4 AS m, value FROM events)
SELECT event_id, CASE m WHEN 0 THEN 'Feature' WHEN 1 THEN 'FeatureCollection' WHEN 2 THEN 'invalid' ELSE 'none' END AS kind, CASE WHEN m = 0 THEN round(value, 2) END AS nested, CASE WHEN m = 0 THEN 0 ELSE 7 END::BIGINT AS fallback, CASE WHEN m = 0 THEN 'inner' WHEN m = 1 THEN 'outer' END AS unwrapped FROM e
""")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON: kinds, nested values with a default, and properties within properties."""
    m = F.col("user_id") % 4
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.round("value", 2).alias("v"), F.struct(F.lit("inner").alias("name")).alias("source_properties")).alias("properties"), F.lit(0).alias("n")))
    body = F.when(m == 0, feature).when(m == 1, '{"type":"FeatureCollection","features":[],"properties":{"name":"outer"}}').when(m == 2, "{bad")
    rows = read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    path = lambda p: F.get_json_object("body", p)
    return rows.select(
        "event_id", maps.json_kind(F.col("body")).alias("kind"), path("$.properties.v").cast("double").alias("nested"), F.coalesce(path("$.n").cast("long"), F.lit(7)).alias("fallback"),
        F.coalesce(path("$.properties.source_properties.name"), path("$.properties.name")).alias("unwrapped"),
    )
