"""Queries on names, keys and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralode.functions import text
from terralode.plans.registry import query, read


@query("""
WITH d AS (SELECT c_custkey, lpad(CAST(2000000000 + c_custkey * 7919 AS VARCHAR), 10, '0') AS ten FROM customer),
s AS (SELECT *, 11 - (5*substring(ten,1,1)::INT + 4*substring(ten,2,1)::INT + 3*substring(ten,3,1)::INT + 2*substring(ten,4,1)::INT + 7*substring(ten,5,1)::INT
  + 6*substring(ten,6,1)::INT + 5*substring(ten,7,1)::INT + 4*substring(ten,8,1)::INT + 3*substring(ten,9,1)::INT + 2*substring(ten,10,1)::INT) % 11 AS r FROM d),
k AS (SELECT *, CASE r WHEN 11 THEN 0 WHEN 10 THEN 9 ELSE r END AS digit FROM s)
SELECT c_custkey, CAST(digit AS INTEGER) AS digit, substring(ten, 1, 2) || '-' || substring(ten, 3, 8) || '-' || digit AS cuit, digit = c_custkey % 10 AS valid FROM k
""")
def cuit_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = F.lpad((F.lit(2_000_000_000) + F.col("c_custkey") * 7919).cast("string"), 10, "0")
    rows = read(spark, sf_dir, "customer").select("c_custkey", ten.alias("ten")).withColumn("digit", text.cuit_check_digit(F.col("ten")))
    return rows.select("c_custkey", "digit", text.cuit(F.concat("ten", F.col("digit").cast("string"))).alias("cuit"), (F.col("digit") == F.col("c_custkey") % 10).alias("valid"))


@query("""
WITH b AS (SELECT p_partkey, trim(regexp_replace(lower(replace(replace(p_type || ' Ñandú ' || p_size, 'Ñ', 'N'), 'ú', 'u')), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
SELECT p_partkey, base, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n
""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = text.slug(F.concat("p_type", F.lit(" Ñandú "), F.col("p_size").cast("string")))
    rows = read(spark, sf_dir, "part").select("p_partkey", base.alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return rows.withColumn("k", k).select("p_partkey", "base", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'N' || (p_partkey % 90) || ' · ' ELSE '' END || p_name || ' · 1.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',5 m'
  || CASE WHEN p_partkey % 5 = 0 THEN ' (P' || (p_partkey % 40) || ')' ELSE '' END AS name FROM part)
SELECT p_partkey, coalesce(nullif(regexp_extract(name, '\\(([PN]\\d+[a-z]?)\\b', 1), ''), nullif(regexp_extract(name, '^([A-Z]{1,3}\\d{1,2}[A-Z]?)(\\s|$)', 1), '')) AS code,
  1000.5 + p_partkey % 1000 AS declared_m FROM n
""".replace("\\\\", "\\"))
def name_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat(
        F.when(key % 3 == 0, F.concat(F.lit("N"), (key % 90).cast("string"), F.lit(" · "))).otherwise(""), "p_name", F.lit(" · 1."), F.lpad((key % 1000).cast("string"), 3, "0"),
        F.lit(",5 m"), F.when(key % 5 == 0, F.concat(F.lit(" (P"), (key % 40).cast("string"), F.lit(")"))).otherwise(""),
    )
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    code = F.coalesce(text.bracket_code(F.col("name")), text.leading_code(F.col("name")))
    return rows.select("p_partkey", code.alias("code"), text.spanish_number(F.col("name")).alias("declared_m"))


@query("""
SELECT page_id, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
  len(regexp_extract_all(html, '<p>'))::INTEGER AS n_paragraphs, regexp_extract(url, '([^/]*)$', 1) AS last_part FROM pages
""")
def html_label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.nullif(F.regexp_extract(html, '<html lang="([a-z]+)"', 1), F.lit("")).alias("lang"), F.coalesce(text.trim_to_null(F.regexp_extract(html, "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit("<p>"), F.lit(0))).alias("n_paragraphs"), F.regexp_extract("url", "([^/]*)$", 1).alias("last_part"),
    )


@query("""
SELECT c_nationkey, c_custkey // 1000 AS part, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","properties":{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"},"geometry":{"type":"Point","coordinates":['
  || (c_custkey % 360 - 180) || ',' || (c_custkey % 180 - 90) || ']}}', ',' ORDER BY c_custkey) || ']}' AS body FROM customer GROUP BY 1, 2
""")
def geojson_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(key.alias("id"), F.col("c_mktsegment").alias("segment")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(key % 360 - 180, key % 180 - 90).alias("coordinates")).alias("geometry"),
    )
    # Pieces of a bounded size, in order: a nation may have any number of customers.
    rows = read(spark, sf_dir, "customer").select("c_nationkey", F.floor(key / 1000).cast("long").alias("part"), F.struct(key.alias("order"), F.to_json(feature).alias("json")).alias("f"))
    one = rows.groupBy("c_nationkey", "part").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda f: f["json"]), ","), F.lit("]}"))
    return one.select("c_nationkey", "part", body.alias("body"))
