"""Registry, finance and dashboard queries on the driver's tables. Money is summed as decimals, so that no order of
rows changes a sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralode.functions import maps, numeric, text
from terralode.functions.temporal import in_year
from terralode.operators import relational as R
from terralode.plans.registry import query, read


def money(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)"))


@query("""
WITH p AS (SELECT p_brand AS brand, CAST(sum(CAST(p_retailprice * p_size AS DECIMAL(18,2))) AS DOUBLE) AS projected FROM part WHERE p_brand NOT LIKE '%5' GROUP BY 1),
a AS (SELECT p_brand AS brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS actual FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND p_brand NOT LIKE '%1' GROUP BY 1)
SELECT brand, coalesce(projected, 0) AS projected, coalesce(actual, 0) AS actual, coalesce(actual, 0) - coalesce(projected, 0) AS variance FROM p FULL JOIN a USING (brand)
""")
def budget_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    projected = part.where(~F.col("p_brand").endswith("5")).groupBy(F.col("p_brand").alias("brand")).agg(
        money(F.col("p_retailprice") * F.col("p_size")).cast("double").alias("projected")
    )
    shipped = line.where(in_year(F.col("l_shipdate"), 1997)).join(part.where(~F.col("p_brand").endswith("1")), F.col("l_partkey") == F.col("p_partkey"))
    actual = shipped.groupBy(F.col("p_brand").alias("brand")).agg(money("l_extendedprice").cast("double").alias("actual"))
    both = R.full_outer_zero(projected, actual, "brand")
    return both.withColumn("variance", F.col("actual") - F.col("projected")).orderBy("brand")


@query("""
SELECT c_custkey, c_name, c_mktsegment, total FROM (
  SELECT *, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), 'zzz')))
ORDER BY c_name, c_custkey LIMIT 25 OFFSET 25
""")
def list_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.search(R.where_given(read(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=None), "1", "c_name", "c_mktsegment")
    total = rows.agg(F.count("*").alias("total"))
    return R.page(rows, ["c_name", "c_custkey"], 2, 25).crossJoin(F.broadcast(total)).select("c_custkey", "c_name", "c_mktsegment", "total")


@query("""
SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1
""")
def year_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where(in_year(F.col("o_orderdate"), 1996))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), money("o_totalprice").cast("double").alias("total"))


@query("""
SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM orders
""")
def group_counts_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    counted = read(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    dimension = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "priority").otherwise("total")
    return counted.select(dimension.alias("dimension"), F.coalesce(status, priority).alias("value"), "n")


FIXED = ["click", "error", "login", "logout", "purchase", "refund", "scroll", "signup", "view"]


@query(f"""
WITH k(event_type) AS (VALUES {", ".join(f"('{k}')" for k in FIXED)}), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT event_type, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (event_type))
SELECT event_type, n, CASE WHEN (SELECT sum(n) FROM t) > 0 THEN round(100.0 * n / (SELECT sum(n) FROM t), 1) ELSE 0 END::DOUBLE AS pct FROM t
""")
def stats_fixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    kept = R.with_all_keys(counts, "event_type", FIXED)
    return kept.withColumn("pct", numeric.percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 1)).orderBy(F.desc("pct"), "event_type")


@query("""
WITH i AS (SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'),
e AS (SELECT coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'),
n AS (SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2050-01-01' AND o_orderdate < TIMESTAMP '2051-01-01')
SELECT CAST(i.v AS DOUBLE) AS income, CAST(e.v AS DOUBLE) AS expense, CAST(i.v - e.v AS DOUBLE) AS balance, CAST(n.v AS DOUBLE) AS empty_year FROM i, e, n
""")
def financial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    total = lambda df, c, at, year, name: df.where(in_year(F.col(at), year)).agg(F.coalesce(money(c), F.lit(0)).alias(name))
    income = total(orders, "o_totalprice", "o_orderdate", 1997, "i")
    expense = total(line, "l_extendedprice", "l_shipdate", 1997, "e")
    none = total(orders, "o_totalprice", "o_orderdate", 2050, "n")
    # Three single rows.
    one = income.crossJoin(expense).crossJoin(none)
    return one.select(
        F.col("i").cast("double").alias("income"), F.col("e").cast("double").alias("expense"), (F.col("i") - F.col("e")).cast("double").alias("balance"),
        F.col("n").cast("double").alias("empty_year"),
    )


@query("""
WITH u AS (SELECT 'order' AS source, o_orderstatus AS status, o_orderdate AS moment FROM orders UNION ALL SELECT 'line', l_linestatus, l_shipdate FROM lineitem
  UNION ALL SELECT 'event', CAST(NULL AS VARCHAR), ts FROM events)
SELECT 1 AS id, count(*) FILTER (WHERE source = 'order' AND status = 'O') AS open_orders, count(*) FILTER (WHERE source = 'order' AND status = 'F') AS closed_orders,
  count(*) FILTER (WHERE source = 'line' AND status = 'O') AS open_lines, count(*) FILTER (WHERE source = 'event') AS n_events,
  max(moment) FILTER (WHERE source = 'order') AS last_order, (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders) AS latest_order, (SELECT count(*) FROM customer) AS n_customers FROM u
""")
def dashboard_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("source"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"), "o_orderkey")
    lines = read(spark, sf_dir, "lineitem").select(F.lit("line").alias("source"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("at"))
    events = read(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("ts").alias("at"))
    tagged = orders.unionByName(lines, allowMissingColumns=True).unionByName(events, allowMissingColumns=True)
    is_, status = (lambda s: F.col("source") == s), (lambda s: F.col("status") == s)
    counts = tagged.agg(
        F.count_if(is_("order") & status("O")).alias("open_orders"), F.count_if(is_("order") & status("F")).alias("closed_orders"),
        F.count_if(is_("line") & status("O")).alias("open_lines"), F.count_if(is_("event")).alias("n_events"), F.max(F.when(is_("order"), F.col("at"))).alias("last_order"),
        F.max_by("o_orderkey", F.when(is_("order"), F.struct("at", "o_orderkey"))).alias("latest_order"),
    )
    customers = read(spark, sf_dir, "customer").agg(F.count("*").alias("n_customers"))
    return counts.crossJoin(customers).withColumn("id", F.lit(1))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS k,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey, o_orderkey, o_orderdate, n = 1 AS single,
  CASE WHEN o_totalprice >= 300000 THEN 'critico' WHEN o_totalprice >= 200000 THEN 'alto' WHEN o_totalprice >= 100000 THEN 'medio' ELSE 'bajo' END AS level
FROM r WHERE k = 1 AND o_totalprice >= 100000
""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    ties = R.latest_with_ties(orders, "o_custkey", "o_orderdate")
    best = ties.groupBy("o_custkey").agg(F.max("o_orderkey").alias("best"))
    price = F.col("o_totalprice")
    level = F.when(price >= 300_000, "critico").when(price >= 200_000, "alto").when(price >= 100_000, "medio").otherwise("bajo")
    rows = ties.join(best, "o_custkey").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") == F.col("best")).alias("single"), level.alias("level"))
    return R.at_least(rows, F.col("level"), ["bajo", "medio", "alto", "critico"], "medio")


@query("""
SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 5
""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.top_per_group(read(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return top.select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("""
WITH s AS (SELECT nullif(regexp_replace('S ' || (s_suppkey % 40) || '.0', '[\\s.]+', '', 'g'), '') AS k, s_suppkey, s_name FROM supplier),
d AS (SELECT k, arg_max(s_name, s_suppkey) AS s_name, max(s_suppkey) AS s_suppkey FROM s GROUP BY k),
p AS (SELECT p_partkey, nullif(regexp_replace(' S' || (p_partkey % 60) || ' .0', '[\\s.]+', '', 'g'), '') AS k FROM part)
SELECT p_partkey, p.k AS account, s_name AS match_name, s_suppkey AS match_key, d.k IS NOT NULL AS matched FROM p LEFT JOIN d USING (k)
""")
def normalised_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lambda a, c, m, b: text.normal_key(F.concat(F.lit(a), (F.col(c) % m).cast("string"), F.lit(b)))
    right = R.last_wins(read(spark, sf_dir, "supplier").select(keyed("S ", "s_suppkey", 40, ".0").alias("account"), "s_suppkey", "s_name"), "account", "s_suppkey")
    left = read(spark, sf_dir, "part").select("p_partkey", keyed(" S", "p_partkey", 60, " .0").alias("account"))
    found = left.join(right.withColumn("matched", F.lit(True)), "account", "left")
    return found.select("p_partkey", "account", F.col("s_name").alias("match_name"), F.col("s_suppkey").alias("match_key"), F.coalesce("matched", F.lit(False)).alias("matched"))


@query("""
SELECT status, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM (
  SELECT c_acctbal, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 'accepted'
    WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'submitted' ELSE 'none' END AS status FROM customer) GROUP BY 1
""")
def semi_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    sets = {"accepted": orders.where("o_totalprice > 300000").select("o_custkey"), "submitted": orders.where("o_orderstatus = 'O'").select("o_custkey")}
    rows = R.membership(read(spark, sf_dir, "customer"), "c_custkey", sets, "none")
    return rows.groupBy("status").agg(F.count("*").alias("n"), money("c_acctbal").cast("double").alias("balance"))


YEARS = [str(y) for y in range(1993, 1998)]


@query("""
WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, coalesce(string_agg(y, ',' ORDER BY y) FILTER (y BETWEEN '1993' AND '1997'), '') AS years,
  count(*) FILTER (y BETWEEN '1993' AND '1997')::INTEGER AS n_years, arg_max(v, y) AS latest FROM y GROUP BY 1
""")
def history_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.history_map(read(spark, sf_dir, "orders"), "o_custkey", F.year("o_orderdate"), F.col("o_orderpriority"), "o_orderkey")
    years = maps.years_within(F.col("history"), YEARS)
    return found.select("o_custkey", F.array_join(years, ",").alias("years"), F.size(years).alias("n_years"), maps.latest_value(F.col("history")).alias("latest"))


@query("""
WITH c AS (SELECT c_custkey, count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS old, count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1996-01-01') AS new
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
t AS (SELECT count(*) AS total, count(*) FILTER (old + new > 0) AS ever, count(*) FILTER (old > 0 AND new = 0) AS dropped, count(*) FILTER (old + new = 0) AS never FROM c)
SELECT total, ever, dropped, never, round(100.0 * ever / total, 1)::DOUBLE AS ever_pct, round(100.0 * dropped / total, 1)::DOUBLE AS dropped_pct FROM t
""")
def retention_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("1996-01-01").cast("timestamp")
    per = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderdate") < cut).alias("old"), F.count_if(F.col("o_orderdate") >= cut).alias("new"))
    rows = read(spark, sf_dir, "customer").join(per, "c_custkey", "left").na.fill(0, ["old", "new"])
    total = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("old") + F.col("new") > 0).alias("ever"),
        F.count_if((F.col("old") > 0) & (F.col("new") == 0)).alias("dropped"), F.count_if(F.col("old") + F.col("new") == 0).alias("never"),
    )
    return total.withColumn("ever_pct", numeric.percent(F.col("ever"), F.col("total"))).withColumn("dropped_pct", numeric.percent(F.col("dropped"), F.col("total")))


@query("""
WITH u AS (SELECT count(DISTINCT user_id) AS users FROM events),
k AS (SELECT event_type, count(DISTINCT user_id) AS adopters FROM events GROUP BY 1)
SELECT event_type, adopters, users, round(100.0 * adopters / users, 1)::DOUBLE AS pct, CAST(row_number() OVER (ORDER BY round(100.0 * adopters / users, 1) DESC, event_type) AS INTEGER) AS place FROM k, u
""")
def ranking_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    users = events.agg(F.count_distinct("user_id").alias("users"))
    rows = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("adopters")).crossJoin(F.broadcast(users))
    rows = rows.withColumn("pct", numeric.percent(F.col("adopters"), F.col("users")))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pct"), "event_type")))


@query("""
WITH r AS (SELECT n_name, c_mktsegment, count(*) AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 1) AS km FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT n_name, c_mktsegment, n, km, CAST((dense_rank() OVER (ORDER BY n_name) - 1) % 20 AS INTEGER) AS colour, sum(n) OVER (PARTITION BY n_name)::BIGINT AS nation_n, (SELECT sum(n) FROM r)::BIGINT AS grand_n FROM r
""")
def consortium_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    rows = read(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    rolled = rows.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(money("c_acctbal").cast("double"), 1).alias("km"))
    colours = rolled.select("n_name").distinct().withColumn("colour", ((F.dense_rank().over(Window.orderBy("n_name")) - 1) % 20).cast("int"))
    totals = rolled.groupBy("n_name").agg(F.sum("n").alias("nation_n"))
    return rolled.join(colours, "n_name").join(totals, "n_name").crossJoin(F.broadcast(rolled.agg(F.sum("n").alias("grand_n"))))


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_quantity < 3 THEN NULL ELSE l_suppkey END AS k, l_extendedprice AS v FROM lineitem),
c AS (SELECT *, rank() OVER (PARTITION BY k, v IS NOT NULL AND v >= 1000 ORDER BY row_id) AS rn FROM f)
SELECT coalesce(error, 'ok') AS outcome, count(*) AS n FROM (SELECT CASE WHEN k IS NULL THEN 'missing key' WHEN NOT (v >= 1000) THEN 'value too small'
  WHEN rn > 1 THEN 'repeated in file' WHEN k IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) THEN 'already present' END AS error FROM c) GROUP BY 1
""")
def dedupe_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.when(F.col("l_quantity") >= 3, F.col("l_suppkey")).alias("k"), F.col("l_extendedprice").alias("v"))
    sound = F.col("k").isNotNull() & (F.col("v") >= 1000)
    # The first sound row of a key: a grouped minimum and a join, so that a hot key isn't sorted in one task.
    firsts = rows.where(sound).groupBy("k").agg(F.min("row_id").alias("first"))
    present = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.lit(True).alias("present")).distinct()
    known = rows.join(firsts, "k", "left").join(present, "k", "left")
    rules = {"missing key": F.col("k").isNull(), "value too small": ~(F.col("v") >= 1000), "repeated in file": F.col("row_id") != F.col("first"), "already present": F.coalesce("present", F.lit(False))}
    return R.reject_reasons(known, rules).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT c_custkey, round(c_acctbal, 2) AS acctbal, c_mktsegment AS segment FROM customer),
p AS (SELECT o_custkey AS c_custkey, CASE WHEN max(o_totalprice) > 250000 THEN max(o_totalprice) END AS acctbal FROM orders GROUP BY 1
  UNION ALL SELECT -s_suppkey, s_acctbal FROM supplier)
SELECT coalesce(b.c_custkey, p.c_custkey) AS c_custkey, coalesce(p.acctbal, b.acctbal) AS acctbal, segment FROM b FULL JOIN p ON b.c_custkey = p.c_custkey
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    top = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    new = read(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("acctbal"))
    patch = top.select("c_custkey", F.when(F.col("top") > 250_000, F.col("top")).alias("acctbal")).union(new)
    return R.upsert(base, patch, "c_custkey")


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS version, row_number() OVER w = count(*) OVER (PARTITION BY coalesce(g, '__null__')) AS is_active FROM (
  SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority || (o_custkey % 50) END AS g FROM orders)
WINDOW w AS (PARTITION BY coalesce(g, '__null__') ORDER BY o_orderdate, o_totalprice, o_orderkey)
""")
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    group = F.when(F.col("o_custkey") % 7 != 0, F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")))
    grouped = orders.withColumn("g", F.coalesce(group, F.lit("__null__")))
    return R.versions(grouped, "g", ["o_orderdate", "o_totalprice", "o_orderkey"], F.trunc("o_orderdate", "month")).select("o_orderkey", "version", "is_active")
