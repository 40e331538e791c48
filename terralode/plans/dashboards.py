"""Dashboards, reports and labels: small results of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralode.functions import geometry, numeric
from terralode.operators import labels
from terralode.operators import relational as R
from terralode.plans.registry import query, read
from terralode.streaming.folders import kept


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1), r AS (SELECT CASE WHEN o_totalprice >= 300000 THEN 'critico' WHEN o_totalprice >= 200000 THEN 'alto' WHEN o_totalprice >= 100000 THEN 'medio' ELSE 'bajo' END AS nivel
  FROM orders JOIN l ON l.o_custkey = orders.o_custkey AND d = o_orderdate), c AS (SELECT count(*) AS total FROM customer)
SELECT count(*) FILTER (nivel = 'bajo') AS bajo, count(*) FILTER (nivel = 'medio') AS medio, count(*) FILTER (nivel = 'alto') AS alto, count(*) FILTER (nivel = 'critico') AS critico, round(100.0 * count(*) FILTER (nivel <> 'bajo') / min(total), 2)::DOUBLE AS porcentaje_area_riesgo,
  (SELECT count(*) FROM supplier) AS conflictos_activos, (SELECT count(*) FROM events WHERE event_type = 'error') AS alertas_activas FROM r, c
""")
def risk_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of each zone's latest rows, the share of zones at risk, and counters of other tables."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    price = F.col("o_totalprice")
    level = F.when(price >= 300_000, "critico").when(price >= 200_000, "alto").when(price >= 100_000, "medio").otherwise("bajo")
    rows = R.latest_with_ties(orders, "o_custkey", "o_orderdate").select(level.alias("nivel"))
    levels = rows.agg(*(F.count_if(F.col("nivel") == n).alias(n) for n in ("bajo", "medio", "alto", "critico")))
    count = lambda t, name, where="true": read(spark, sf_dir, t).where(where).agg(F.count("*").alias(name))
    one = levels.crossJoin(count("customer", "total")).crossJoin(count("supplier", "conflictos_activos")).crossJoin(count("events", "alertas_activas", "event_type = 'error'"))
    risk = numeric.percent(F.col("medio") + F.col("alto") + F.col("critico"), F.col("total"), 2)
    return one.withColumn("porcentaje_area_riesgo", risk).drop("total")


@query("""
WITH t AS (SELECT n_name, count(*) AS basins, CAST(sum(coalesce(TRY_CAST(CASE WHEN s_suppkey % 7 = 0 THEN 'x' ELSE CAST(s_acctbal AS VARCHAR) END AS DECIMAL(18,2)), 0)) AS DOUBLE) AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT n_name AS zone, basins, area FROM t UNION ALL SELECT 'TOTAL', sum(basins)::BIGINT, round(sum(area), 2) FROM t
""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins and tolerant sums of areas by zone, with a total row."""
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    area = F.coalesce(F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal").cast("string")).otherwise("x").try_cast("decimal(18,2)"), F.lit(0))
    out = rows.rollup("n_name").agg(F.count("*").alias("basins"), F.sum(area).cast("double").alias("area"), F.grouping("n_name").alias("all"))
    return out.where("all = 0 or basins > 0").select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("n_name")).alias("zone"), "basins", F.round("area", 2).alias("area"))


@query("""
SELECT o_custkey, '[' || coalesce(string_agg('{"k":' || o_orderkey || '}', ',' ORDER BY o_orderkey) FILTER (o_totalprice > 350000), '') || ']' AS large, '{"F":' || count(*) FILTER (o_orderstatus = 'F') || ',"O":' || count(*) FILTER (o_orderstatus = 'O') || ',"rechazado":0,"total":' || count(*) || '}' AS stats
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey
""")
def json_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a JSON list of the rows that a filter leaves, and an object of conditional sums."""
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    count = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s)
    large = F.to_json(F.array_sort(F.collect_list(F.when(F.col("o_totalprice") > 350_000, F.struct(F.col("o_orderkey").alias("k"))))))
    stats = F.to_json(F.struct(count("F"), count("O"), count("rechazado"), F.count("*").alias("total")))
    return rows.groupBy("o_custkey").agg(large.alias("large"), stats.alias("stats"))


@query("""
SELECT l_returnflag AS analisis, l_linestatus AS red, l_linenumber % 3 AS jerarquia, count(*) AS tramos_afectados, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS km_totales, CAST(sum(CAST(l_quantity * l_discount AS DECIMAL(18,2))) AS DOUBLE) AS km_afectados, round(avg(CAST(round(l_discount * 100) AS BIGINT)), 4) AS porcentaje_promedio FROM lineitem GROUP BY 1, 2, 3
""")
def road_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    keys = [F.col("l_returnflag").alias("analisis"), F.col("l_linestatus").alias("red"), (F.col("l_linenumber") % 3).alias("jerarquia")]
    return read(spark, sf_dir, "lineitem").groupBy(*keys).agg(
        F.count("*").alias("tramos_afectados"), money(F.col("l_quantity")).alias("km_totales"), money(F.col("l_quantity") * F.col("l_discount")).alias("km_afectados"),
        F.round(F.avg(F.round(F.col("l_discount") * 100).cast("long")), 4).alias("porcentaje_promedio"),
    )


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS d, avg(CAST(round(value * 1000) AS BIGINT)) AS v FROM events GROUP BY 1), b AS (SELECT d, unnest([180, 360, 540, 720]) AS back FROM e)
SELECT b.d AS day, round(avg(e.v), 2) AS historical, count(e.v) AS found FROM b LEFT JOIN e ON e.d = b.d - CAST(back // 30 AS INTEGER) GROUP BY 1
""")
def lookback_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the values found some days back (the driver's events span a month: a day stands for a month's thirty)."""
    daily = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg(F.round(F.col("value") * 1000).cast("long")).alias("v"))
    asked = daily.select("day", F.explode(F.array(*(F.lit(m) for m in (6, 12, 18, 24)))).alias("back"))
    then = daily.select(F.col("day").alias("then"), "v")
    return asked.join(then, F.col("then") == F.date_sub("day", F.col("back")), "left").groupBy("day").agg(F.round(F.avg("v"), 2).alias("historical"), F.count("v").alias("found"))


@query("""
WITH s AS (SELECT p_partkey, upper(CASE p_size % 5 WHEN 0 THEN 'iiiws' WHEN 1 THEN 'VIII' WHEN 2 THEN 'i' WHEN 3 THEN 'vi c' ELSE 'x' END) AS c FROM part), k AS (SELECT nullif(regexp_extract(trim(c), '^(VIII|VII|VI|IV|III|II|I)', 1), '') AS soil FROM s)
SELECT soil, count(*) AS n, CAST(row_number() OVER (ORDER BY list_position(['I','II','III','IV','V','VI','VII','VIII'], soil)) AS INTEGER) AS place FROM k WHERE soil IS NOT NULL GROUP BY 1
""")
def soil_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soil classes that occur, in their order."""
    from terralode.functions import text

    order = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII"]
    size = F.col("p_size")
    raw = F.when(size % 5 == 0, "iiiws").when(size % 5 == 1, "VIII").when(size % 5 == 2, "i").when(size % 5 == 3, "vi c").otherwise("x")
    rows = read(spark, sf_dir, "part").select(text.soil_class(raw).alias("soil")).where("soil is not null").groupBy("soil").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("soil"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(place)))  # eight rows at most


@query("""
WITH m AS (SELECT user_id, event_id, row_number() OVER w AS epoch, value AS loss, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, best IS NULL OR loss < best AS better FROM m), g AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS waited FROM b)
SELECT user_id, coalesce(min(epoch) FILTER (waited >= 3), max(epoch))::INTEGER AS stopped_at, bool_or(waited >= 3) AS early, arg_max(epoch, epoch) FILTER (better AND epoch <= coalesce((SELECT min(h.epoch) FROM g h WHERE h.user_id = g.user_id AND h.waited >= 3), epoch))::INTEGER AS best_epoch FROM g GROUP BY user_id
""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When training would stop: no better loss for three epochs, and the best epoch until then."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("loss"))
    return labels.early_stop(rows, "user_id", ["ts", "event_id"], "loss", 3)


@query("""
WITH v AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total FROM v)
SELECT event_type, n, round(-90 + 360.0 * (sum(n) OVER (ORDER BY event_type) - n) / total, 6)::DOUBLE AS start_angle, round(-90 + 360.0 * (sum(n) OVER (ORDER BY event_type)) / total, 6)::DOUBLE AS end_angle FROM v, t
""")
def pie_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))  # a row for each type
    whole, before = F.sum("n").over(Window.partitionBy()), F.sum("n").over(Window.orderBy("event_type"))
    angle = lambda c: F.round(-90 + 360.0 * c / whole, 6)
    return rows.select("event_type", "n", angle(before - F.col("n")).alias("start_angle"), angle(before).alias("end_angle"))


@query("""
WITH p AS (SELECT l_orderkey, (l_partkey % 1000)::DOUBLE AS x, (l_suppkey % 1000)::DOUBLE AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 1000, l_suppkey % 1000) AS k FROM lineitem),
s AS (SELECT a.l_orderkey, a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM p a JOIN p b ON b.l_orderkey = a.l_orderkey AND b.k = a.k + 1),
r AS (SELECT *, sum(d) OVER (PARTITION BY l_orderkey ORDER BY k) AS run, sum(d) OVER (PARTITION BY l_orderkey) AS total FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS first FROM r WHERE run >= total / 2), one AS (SELECT l_orderkey, x, y FROM p WHERE k = 1)
SELECT one.l_orderkey, round(coalesce(x1 + (x2 - x1) * CASE WHEN d = 0 THEN 0 ELSE (total / 2 - (run - d)) / d END, x), 4) AS x, round(coalesce(y1 + (y2 - y1) * CASE WHEN d = 0 THEN 0 ELSE (total / 2 - (run - d)) / d END, y), 4) AS y FROM one LEFT JOIN h ON h.l_orderkey = one.l_orderkey AND first = 1
""")
def label_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each line, along its length."""
    p = F.struct("l_linenumber", (F.col("l_partkey") % 1000).cast("double").alias("x"), (F.col("l_suppkey") % 1000).cast("double").alias("y"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(p)).alias("points"))
    middle = geometry.middle(F.col("points"))
    return lines.select("l_orderkey", F.round(middle["x"], 4).alias("x"), F.round(middle["y"], 4).alias("y"))


@query()
def visible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each screen that don't cover each other: areas first, then by falling value. SQL can't say a choice that
    hangs on all choices before it."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("screen"), k.alias("id"), F.when(k % 3 == 0, "area").otherwise("distance").alias("kind"), F.round("o_totalprice", 2).alias("value"), (k * 37 % 800).cast("double").alias("x"), (k * 91 % 600).cast("double").alias("y")
    )
    return labels.visible(rows, "screen", 40.0, kept)
