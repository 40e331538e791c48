"""Queries on linked entities: nested children, unnested lists, polymorphic links, pivots, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import numeric
from terralode.operators.relational import top_per_group
from terralode.plans.registry import query, read


@query("""
SELECT r_regionkey, r_name, string_agg(n_name, '|' ORDER BY n_nationkey) AS nations, count(n_nationkey)::INTEGER AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with the list of their children, read in one join."""
    kids = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("kids"))
    rows = read(spark, sf_dir, "region").join(kids, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    names = F.array_join(F.transform("kids", lambda k: k["n_name"]), "|")
    return rows.select("r_regionkey", "r_name", names.alias("nations"), F.coalesce(F.size("kids"), F.lit(0)).alias("n"))


@query("""
SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1
""")
def lateral_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("parts"))


@query("""
WITH refs AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'otro' END AS kind, event_id % 40 AS ref FROM events),
e AS (SELECT 'customer' AS kind, c_custkey AS ref, c_name AS label FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
SELECT kind, coalesce(label, 'otro') AS label, count(*) AS n FROM refs LEFT JOIN e USING (kind, ref) GROUP BY 1, 2
""")
def polymorphic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by entity type and id, joined to the tagged union of the entities."""
    key = F.col("event_id") % 3
    refs = read(spark, sf_dir, "events").select(F.when(key == 0, "customer").when(key == 1, "supplier").otherwise("otro").alias("kind"), (F.col("event_id") % 40).alias("ref"))
    tagged = lambda t, k, name: read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("ref"), F.col(name).alias("label"))
    entities = tagged("customer", "c_custkey", "c_name").unionByName(tagged("supplier", "s_suppkey", "s_name"))
    linked = refs.groupBy("kind", "ref").agg(F.count("*").alias("n")).join(entities, ["kind", "ref"], "left")
    return linked.groupBy("kind", F.coalesce("label", F.lit("otro")).alias("label")).agg(F.sum("n").alias("n"))


@query("""
SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (WHERE c_mktsegment = 'NONE') AS none FROM customer GROUP BY 1
""")
def key_value_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["BUILDING", "AUTOMOBILE", "NONE"]
    wide = read(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", keys).count()
    return wide.select("c_nationkey", *(F.coalesce(F.col(k), F.lit(0)).alias(k.lower()) for k in keys))


@query("""
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last, round(max(top_total), 2) AS top_total FROM (
  SELECT *, sum(CASE WHEN rn <= 5 THEN o_totalprice END) OVER (PARTITION BY o_orderpriority) AS top_total FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)) GROUP BY 1
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    base = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    top = top_per_group(orders.select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return base.join(top.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("top_total")), "o_orderpriority")


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT month, n, n - lag(n) OVER (ORDER BY month) AS step, row_number() OVER (ORDER BY month DESC) AS back FROM m)
SELECT CAST(month AS DATE) AS month, n, step, round(100.0 * n / (SELECT sum(n) FROM m), 2)::DOUBLE AS share FROM x WHERE back <= 6
""")
def last_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six months with their change and share of all."""
    from pyspark.sql import Window

    monthly = read(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    total = monthly.agg(F.sum("n").alias("total"))
    w = Window.orderBy("month")  # a row for each month
    rows = monthly.withColumn("step", F.col("n") - F.lag("n").over(w)).orderBy(F.desc("month")).limit(6)
    return rows.crossJoin(F.broadcast(total)).select("month", "n", "step", numeric.percent(F.col("n"), F.col("total"), 2).alias("share"))


@query("""
SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn, round(avg(length(text)), 2) AS mean_chars FROM conversations WHERE text IS NOT NULL GROUP BY 1
""")
def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("text is not null")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))
