"""Queries on events and series: state machines, anomalies, windows, indices and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralode.functions import numeric
from terralode.operators.ranks import percentile_row
from terralode.operators.relational import priorities
from terralode.plans.registry import query, read
from terralode.streaming import jobs
from terralode.streaming.folders import kept

#: Legal transitions of the events' state machine.
LEGAL = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("click", "click"), ("signup", "view")]


@query(f"""
WITH legal(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in LEGAL)}),
s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, event_type AS after, count(*) AS n, EXISTS (SELECT 1 FROM legal WHERE a = before AND b = event_type) AS legal FROM s WHERE before IS NOT NULL GROUP BY 1, 2
""")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select(F.lag("event_type").over(w).alias("before"), F.col("event_type").alias("after")).where("before is not null")
    legal = spark.createDataFrame(LEGAL, "before string, after string").withColumn("legal", F.lit(True))
    counted = steps.groupBy("before", "after").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(legal), ["before", "after"], "left").withColumn("legal", F.coalesce("legal", F.lit(False)))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CAST(round(value * 1000) AS BIGINT)) / 1000 AS v FROM events GROUP BY 1), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM d),
x AS (SELECT day, v, v - lag(v) OVER (ORDER BY day) AS step FROM d)
SELECT day, round(v, 4) AS v, v < m - 2 * sd AS anomaly, round(step, 4) AS step FROM x, s
""")
def anomaly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.avg(F.round(F.col("value") * 1000).cast("long")) / 1000).alias("v"))
    stats = daily.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    # A row for each day: small enough for one ordered window.
    step = F.col("v") - F.lag("v").over(Window.orderBy("day"))
    rows = daily.withColumn("step", step).crossJoin(F.broadcast(stats))
    return rows.select("day", F.round("v", 4).alias("v"), (F.col("v") < F.col("m") - 2 * F.col("sd")).alias("anomaly"), F.round("step", 4).alias("step"))


@query("""
SELECT user_id, count(*) AS sample_count, round(avg(value), 4) AS mean, round(CASE WHEN count(*) = 1 THEN 0.05 ELSE greatest(stddev_samp(value), 0.001) END, 4) AS std
FROM events WHERE month(ts) IN (1, 2, 3) AND value IS NOT NULL GROUP BY 1
""")
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where(F.month("ts").isin(1, 2, 3) & F.col("value").isNotNull())
    std = F.when(F.count("*") == 1, F.lit(0.05)).otherwise(F.greatest(F.stddev_samp("value"), F.lit(0.001)))
    return rows.groupBy("user_id").agg(F.count("*").alias("sample_count"), F.round(F.avg("value"), 4).alias("mean"), F.round(std, 4).alias("std"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75 FROM orders)
SELECT CASE WHEN o_totalprice >= p75 THEN 'critico' WHEN o_totalprice >= p50 THEN 'alto' WHEN o_totalprice >= p25 THEN 'medio' ELSE 'bajo' END AS level, count(*) AS n, round(min(p50), 4) AS p50 FROM orders, q GROUP BY 1
""")
def percentile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    q = percentile_row(orders, ["o_totalprice"], [0.25, 0.5, 0.75], kept)
    v, at = F.col("o_totalprice"), lambda i: F.col(("p25_o_totalprice", "p50_o_totalprice", "p75_o_totalprice")[i])
    level = F.when(v >= at(2), "critico").when(v >= at(1), "alto").when(v >= at(0), "medio").otherwise("bajo")
    return orders.crossJoin(F.broadcast(q)).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.min(at(1)), 4).alias("p50"))


@query("""
WITH r AS (SELECT max(l_quantity) AS mq, min(l_quantity) AS nq, max(l_extendedprice) AS me, min(l_extendedprice) AS ne FROM lineitem),
h AS (SELECT l_orderkey, l_linenumber, round(least(greatest(100 * (0.0 + l_discount * 10 * 0.15 + CASE WHEN me = ne THEN 0 ELSE (l_extendedprice - ne) / (me - ne) END * 0.30
  + CASE WHEN mq = nq THEN 0 ELSE (l_quantity - nq) / (mq - nq) END * 0.25 + greatest(1 - (l_partkey % 6000) / 5000.0::DOUBLE, 0) * 0.15 + l_tax * 10 * 0.15), 0), 100), 2) AS hci FROM lineitem, r)
SELECT l_orderkey, l_linenumber, round(hci, 1) AS hci, CASE WHEN hci >= 75 THEN 'critico' WHEN hci >= 50 THEN 'alto' WHEN hci >= 25 THEN 'medio' ELSE 'bajo' END AS level FROM h
""")
def hci_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey")
    bounds = line.agg(F.max("l_quantity").alias("mq"), F.min("l_quantity").alias("nq"), F.max("l_extendedprice").alias("me"), F.min("l_extendedprice").alias("ne"))
    c = F.col
    index = numeric.criticality(
        c("l_discount") * 10, numeric.min_max(c("l_extendedprice"), c("ne"), c("me")), numeric.min_max(c("l_quantity"), c("nq"), c("mq")), numeric.near(c("l_partkey") % 6000), c("l_tax") * 10
    )
    rows = line.crossJoin(F.broadcast(bounds)).withColumn("hci", index)
    return rows.select("l_orderkey", "l_linenumber", F.round("hci", 1).alias("hci"), numeric.risk_level(c("hci")).alias("level"))


@query("""
WITH v AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 20 END AS hand, l_quantity / 3 AS twi, l_extendedprice * 2 AS flow, l_discount * 10 AS slope FROM lineitem),
p AS (SELECT *, least(CASE WHEN hand < 0.5 THEN 40 WHEN hand < 1 THEN 30 WHEN hand < 2 THEN 15 ELSE 0 END + CASE WHEN twi > 14 THEN 30 WHEN twi > 11 THEN 20 WHEN twi > 8 THEN 5 ELSE 0 END
  + CASE WHEN flow > 100000 THEN 20 WHEN flow > 10000 THEN 10 ELSE 0 END + CASE WHEN slope < 0.3 THEN 10 WHEN slope < 0.5 THEN 5 ELSE 0 END, 100) AS points,
  coalesce((hand < 2)::INT, 0) + (twi > 11)::INT + (flow > 10000)::INT + (slope < 0.3)::INT AS factors, flow > 100000 AS extreme FROM v)
SELECT points::INTEGER AS points, CASE WHEN points >= 70 THEN 'critico' WHEN points >= 50 THEN 'alto' WHEN points >= 30 THEN 'moderado' ELSE 'bajo' END AS level,
  CASE WHEN flow > 5000 OR slope < 0.5 THEN 'alta' WHEN flow > 2000 OR slope < 2 THEN 'media' ELSE 'baja' END AS severity,
  sum(factors)::BIGINT AS n_factors, count(*) FILTER (extreme) AS n_extreme, count(*) AS n FROM p GROUP BY 1, 2, 3
""")
def flood_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    hand = F.when(c("l_linenumber") != 7, c("l_quantity") / 20)
    rows = read(spark, sf_dir, "lineitem").select(hand.alias("hand"), (c("l_quantity") / 3).alias("twi"), (c("l_extendedprice") * 2).alias("flow"), (c("l_discount") * 10).alias("slope"))
    points, factors = numeric.flood_points(c("hand"), c("twi"), c("flow"), c("slope"))
    severity = numeric.conflict_severity(c("flow"), c("slope"))
    keys = [points.cast("int").alias("points"), numeric.flood_level(points).alias("level"), severity.alias("severity")]
    extreme = F.exists(factors, lambda x: x.startswith("Flow accumulation extremo"))
    return rows.groupBy(*keys).agg(F.sum(F.size(factors)).alias("n_factors"), F.count_if(extreme).alias("n_extreme"), F.count("*").alias("n"))


@query("""
WITH a AS (SELECT c_nationkey AS k, count(*) / 1000 AS v FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1),
h AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS k, n_regionkey * 20.0 AS v FROM nation), hn AS (SELECT k::BIGINT AS k, v FROM h WHERE regexp_full_match(k, '[0-9]+')),
c AS (SELECT s_nationkey AS k, count(*) AS v FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1),
ids AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM hn UNION SELECT k FROM c),
m AS (SELECT (SELECT min(v) FROM a) AS a0, (SELECT max(v) FROM a) AS a1, (SELECT min(v) FROM b) AS b0, (SELECT max(v) FROM b) AS b1, (SELECT min(v) FROM h) AS h0, (SELECT max(v) FROM h) AS h1, (SELECT min(v) FROM c) AS c0, (SELECT max(v) FROM c) AS c1),
x AS (SELECT ids.k, round(CASE WHEN a1 = a0 THEN 0 ELSE (a.v - a0) / (a1 - a0) END, 4) AS av, round(CASE WHEN b1 = b0 THEN 0 ELSE (b.v - b0) / (b1 - b0) END, 4) AS bv, round(CASE WHEN h1 = h0 THEN 0 ELSE (hn.v - h0) / (h1 - h0) END, 4) AS hv,
  round(CASE WHEN c1 = c0 THEN 0 ELSE (c.v - c0) / (c1 - c0) END, 4) AS cv, a.v AS a, b.v AS b, hn.v AS h, c.v AS c FROM ids LEFT JOIN a ON a.k = ids.k LEFT JOIN b ON b.k = ids.k LEFT JOIN hn ON hn.k = ids.k LEFT JOIN c ON c.k = ids.k, m),
y AS (SELECT k, (CASE WHEN a IS NULL THEN 0 ELSE 0.30 * av END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 * bv END + CASE WHEN h IS NULL THEN 0 ELSE 0.25 * hv END + CASE WHEN c IS NULL THEN 0 ELSE 0.20 * cv END)
  / (CASE WHEN a IS NULL THEN 0 ELSE 0.30 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END + CASE WHEN h IS NULL THEN 0 ELSE 0.25 END + CASE WHEN c IS NULL THEN 0 ELSE 0.20 END) AS s,
  concat_ws(',', CASE WHEN a IS NULL THEN 'centrality' END, CASE WHEN b IS NULL THEN 'flow_acc' END, CASE WHEN h IS NULL THEN 'upstream_hci' END, CASE WHEN c IS NULL THEN 'conflict_count' END) AS missing FROM x)
SELECT k::BIGINT AS node_id, round(s + 1e-9, 4)::DOUBLE AS composite, missing FROM y
""")
def maintenance_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four maps of scores by node; those of the index have text keys, of which only digits name a node."""
    counted = lambda t, key, m, value: read(spark, sf_dir, t).where(m).groupBy(F.col(key).cast("string").alias("id")).agg(value.cast("double").alias("score"))
    key, nation = F.col("s_nationkey"), read(spark, sf_dir, "nation")
    hci = nation.select(F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string")).alias("id"), (F.col("n_regionkey") * 20.0).alias("score"))
    scores = {
        "centrality": counted("customer", "c_nationkey", F.col("c_nationkey") % 5 != 0, F.count("*") / 1000), "flow_acc": counted("supplier", "s_nationkey", key % 3 != 0, F.sum(F.col("s_acctbal").cast("decimal(18,2)"))),
        "upstream_hci": hci, "conflict_count": counted("supplier", "s_nationkey", key % 2 == 0, F.count("*")),
    }
    out = priorities(scores, numeric.MAINTENANCE)
    return out.select("node_id", F.col("composite_score").alias("composite"), F.concat_ws(",", "missing_factors").alias("missing"))


@query("""
SELECT user_id, event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited, greatest(3 - count(*) OVER w, 0) AS remaining FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the day before each event, to the microsecond, against a limit of three."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(w).alias("in_window"))
    return rows.withColumn("limited", F.col("in_window") > 3).withColumn("remaining", F.greatest(3 - F.col("in_window"), F.lit(0)))


@query("""
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY 1, 2
""")
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    out = rows.agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""
WITH s AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type IS NOT NULL),
b AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM k GROUP BY user_id, session
""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type is not null").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("""
WITH b AS (SELECT CAST(l_shipdate AS DATE) AS scene, l_quantity AS green, 1 + l_linenumber * 8.0 AS nir, l_partkey % 12 AS scl FROM lineitem),
k AS (SELECT scene, CASE WHEN green + nir = 0 THEN 0 ELSE (green - nir) / (green + nir) END AS ndwi FROM b WHERE scl NOT IN (3, 8, 9, 10)),
t AS (SELECT scene, count(*) AS n_valid, count(*) FILTER (ndwi > 0.1) AS n_water, round(avg(ndwi), 6) AS mean_ndwi, min(ndwi) AS min_ndwi, max(ndwi) AS max_ndwi FROM k GROUP BY 1)
SELECT scene, n_valid, n_water, round(100.0 * n_water / n_valid, 2)::DOUBLE AS water_pct, mean_ndwi, round(min_ndwi, 6) AS min_ndwi, round(max_ndwi, 6) AS max_ndwi FROM t
""")
def ndwi_water_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    bands = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("scene"), c("l_quantity").alias("green"), (1 + c("l_linenumber") * 8.0).alias("nir"), (c("l_partkey") % 12).alias("scl"))
    rows = bands.where(~c("scl").isin(3, 8, 9, 10)).select("scene", numeric.ratio_index(c("green"), c("nir")).alias("ndwi"))
    out = rows.groupBy("scene").agg(
        F.count("*").alias("n_valid"), F.count_if(c("ndwi") > 0.1).alias("n_water"), F.round(F.avg("ndwi"), 6).alias("mean_ndwi"),
        F.round(F.min("ndwi"), 6).alias("min_ndwi"), F.round(F.max("ndwi"), 6).alias("max_ndwi"),
    )
    return out.withColumn("water_pct", numeric.percent(c("n_water"), c("n_valid"), 2))


@query("""
WITH s AS (SELECT user_id AS zona_id, event_id, ts, CASE WHEN value > 90 THEN 'critico' WHEN value > 70 THEN 'alto' ELSE 'bajo' END AS nivel FROM events), a AS (SELECT c_custkey AS zona_id FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY zona_id ORDER BY CASE nivel WHEN 'critico' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS k FROM s WHERE nivel <> 'bajo' AND zona_id NOT IN (SELECT zona_id FROM a))
SELECT zona_id, event_id, nivel FROM n WHERE k = 1
""")
def raised_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most severe and latest reading of each zone without an active alert: the batch twin of the alert job."""
    value = F.col("value")
    level = F.when(value > 90, "critico").when(value > 70, "alto").otherwise("bajo")
    scored = read(spark, sf_dir, "events").select(F.col("user_id").alias("zona_id"), "event_id", "ts", level.alias("nivel"))
    active = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zona_id"), (F.col("c_custkey") % 3 == 0).alias("activa"))
    rank = F.struct((F.col("nivel") == "critico").alias("severe"), "ts", "event_id")
    worst = jobs.new_alerts(scored, active).groupBy("zona_id").agg(F.max_by(F.struct("event_id", "nivel"), rank).alias("r"))
    return worst.select("zona_id", "r.event_id", "r.nivel")


@query("""
WITH l(a, b) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('view', 'view')), s AS (SELECT user_id, event_type AS estado, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, estado AS after, count(*) AS n FROM s WHERE before IS NOT NULL AND (before, estado) NOT IN (SELECT a, b FROM l) GROUP BY 1, 2
""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("estado"))
    legal = spark.createDataFrame([("view", "click"), ("click", "purchase"), ("view", "view")], "before string, after string")
    return jobs.illegal_transitions(history, legal, "user_id", ["ts", "event_id"]).groupBy("before", "after").agg(F.count("*").alias("n"))
