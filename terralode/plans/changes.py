"""Queries on changes of tables: what a database does in place is a new table here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.operators import changes as C
from terralode.plans.registry import query, read


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))


@query("""
SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000) AS deleted FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 50000)
""")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion leaves, with the number of rows that it took."""
    left, count = C.delete_where(_orders(spark, sf_dir), (F.col("status") == "F") & (F.col("price") > 50_000))
    return left.select("o_orderkey").crossJoin(F.broadcast(count))


@query("""
WITH new AS (SELECT c_custkey AS zone, 'flood' AS kind, c_acctbal AS score FROM customer WHERE c_custkey % 3 = 0), base AS (SELECT o_custkey AS zone, CASE WHEN o_orderkey % 2 = 0 THEN 'flood' ELSE 'drain' END AS kind, o_totalprice AS score FROM orders)
SELECT kind, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM (SELECT * FROM base WHERE (zone, kind) NOT IN (SELECT zone, kind FROM new) UNION ALL SELECT * FROM new) GROUP BY 1
""")
def replaced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of (zone, kind) are deleted where there are new ones, which go in."""
    new = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("zone"), F.lit("flood").alias("kind"), F.col("c_acctbal").alias("score"))
    base = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("zone"), F.when(F.col("o_orderkey") % 2 == 0, "flood").otherwise("drain").alias("kind"), F.col("o_totalprice").alias("score"))
    out = C.replace_groups(base, new, ["zone", "kind"])
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("""
SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
""")
def seeded_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return C.add_missing(base, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k")


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM gone)) AS cascaded, count(*) AS kept, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM gone)) AS nulled FROM orders
""")
def cascaded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of deleted parents go, or lose their reference."""
    gone = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    kids = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    left = C.cascade(kids, gone, "o_custkey").agg(F.count("*").alias("cascaded"))
    nulled = C.cascade(kids, gone, "o_custkey", set_null=True).agg(F.count("*").alias("kept"), F.count_if(F.col("o_custkey").isNull()).alias("nulled"))
    return left.crossJoin(nulled)


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'abierto' WHEN 'F' THEN 'cerrado' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def remapped_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remap(_orders(spark, sf_dir), "status", {"O": "abierto", "F": "cerrado"}).groupBy("status").agg(F.count("*").alias("n"))


@query("""
WITH ids AS (SELECT unnest([7, 3, 11, 1]) AS id, unnest([0, 1, 2, 3]) AS place)
SELECT s_suppkey, coalesce(place, s_suppkey % 10 + 100)::INTEGER AS orden, (SELECT count(*) FROM supplier WHERE s_suppkey IN (7, 3, 11, 1))::INTEGER AS updated FROM supplier LEFT JOIN ids ON id = s_suppkey
""")
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by a list that comes as JSON, in which one id isn't there."""
    listed = spark.range(1).select(F.explode(F.from_json(F.lit('[{"id":7},{"id":3},{"id":11},{"id":1}]'), "array<struct<id long>>")).alias("x")).select("x.id")
    ids = [r.id for r in listed.collect()]
    base = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10 + 100).cast("int").alias("orden"))
    out = C.reorder(base, "s_suppkey", ids)
    return out.crossJoin(F.broadcast(base.agg(F.count_if(F.col("s_suppkey").isin(ids)).cast("int").alias("updated")))).select("s_suppkey", "orden", "updated")


@query("""
WITH base AS (SELECT o_custkey AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey % 2 = 0),
new AS (SELECT c_custkey AS g, -c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), top AS (SELECT g, max(version) AS top FROM base GROUP BY 1)
SELECT g, id, version::INTEGER AS version, version = n AND g NOT IN (SELECT g FROM new) AS is_active FROM base UNION ALL SELECT new.g, id, (coalesce(top, 0) + 1)::INTEGER, true FROM new LEFT JOIN top ON top.g = new.g
""")
def activated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows are the active version of their group, one above its last; the others are active no more."""
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    base = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"))
    base = base.withColumn("version", F.row_number().over(w.orderBy("id"))).withColumn("is_active", F.col("version") == F.count("*").over(w))
    new = read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("g"), (-F.col("c_custkey")).alias("id"))
    return C.activate(base, new, "g")


@query("""
SELECT count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.05)) AS discount_range, count(*) FILTER (NOT (l_quantity > 0)) AS quantity_sign, count(*) FILTER (NOT (l_returnflag IN ('A', 'N'))) AS flag_enum, count(*) FILTER (NOT (length(l_linestatus) BETWEEN 1 AND 1)) AS status_length FROM lineitem
""")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each check, counted in one pass."""
    c = F.col
    checks = {"discount_range": c("l_discount").between(0, 0.05), "quantity_sign": c("l_quantity") > 0, "flag_enum": c("l_returnflag").isin("A", "N"), "status_length": F.length("l_linestatus").between(1, 1)}
    return C.broken(read(spark, sf_dir, "lineitem"), checks)


@query("""
WITH m AS (SELECT c_custkey, c_custkey % 4 AS state, c_custkey % 5 = 0 AS unclaimed, c_mktsegment AS role FROM customer), s AS (SELECT s_suppkey AS c_custkey FROM supplier)
SELECT c_custkey, CASE WHEN unclaimed AND c_custkey IN (SELECT c_custkey FROM s) THEN role ELSE 'ciudadano' END AS role, unclaimed AND c_custkey NOT IN (SELECT c_custkey FROM s) AS still_open FROM m
""")
def claimed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invitation that nobody claimed yet gives the one who registers its role, and is claimed then."""
    key = F.col("c_custkey")
    invited = read(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat(F.lit("U"), key.cast("string"), F.lit("@X.ar"))).alias("mail"), (key % 5 == 0).alias("open"), F.col("c_mktsegment").alias("role"))
    registered = read(spark, sf_dir, "supplier").select(F.lower(F.concat(F.lit("u"), F.col("s_suppkey").cast("string"), F.lit("@x.AR"))).alias("mail"), F.lit(True).alias("here"))
    rows = invited.join(registered, "mail", "left")
    claims = F.col("open") & F.coalesce("here", F.lit(False))
    return rows.select("c_custkey", F.when(claims, F.col("role")).otherwise("ciudadano").alias("role"), (F.col("open") & ~claims).alias("still_open"))


@query("""
WITH x AS (SELECT o_orderkey, o_orderstatus = 'F' AS published, o_orderkey % 3 AS asked FROM orders)
SELECT o_orderkey, CASE WHEN asked = 1 THEN true WHEN asked = 2 THEN false ELSE published END AS published, CASE WHEN asked = 1 AND published THEN 'already published' WHEN asked = 2 AND NOT published THEN 'not published' END AS conflict FROM x
""")
def flag_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish and unpublish; asking for what is so already is a conflict."""
    asked = F.when(F.col("o_orderkey") % 3 == 1, True).when(F.col("o_orderkey") % 3 == 2, False)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("published"), asked.alias("asked"))
    return C.flip(rows, "published", "asked", {True: "already published", False: "not published"}).select("o_orderkey", "published", "conflict")


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, '') AS nombre, 'ciudadano' AS rol FROM customer
""")
def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of new users, with the name that their JSON has under either of two keys."""
    key = F.col("c_custkey")
    meta = F.to_json(F.struct(F.when(key % 3 == 0, F.col("c_name")).alias("nombre"), F.when(key % 3 == 1, F.col("c_mktsegment")).alias("full_name")))
    name = F.coalesce(F.get_json_object(meta, "$.nombre"), F.get_json_object(meta, "$.full_name"), F.lit(""))
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("nombre"), F.lit("ciudadano").alias("rol"))


@query("""
WITH old AS (SELECT s_suppkey AS id FROM supplier), new AS (SELECT c_custkey AS id, c_name AS label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'again' FROM customer WHERE c_custkey % 4 = 0)
SELECT id, 'old' AS origin FROM old UNION ALL SELECT DISTINCT id, 'new' FROM new WHERE id NOT IN (SELECT id FROM old)
""")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted suggestions are appended unless they are there; doing it again changes nothing."""
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("origin"))
    new = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("origin"))
    again = new.where("id % 4 = 0")
    return C.append_once(C.append_once(old, new.union(again), "id"), again, "id")


@query("""
SELECT coalesce(c_mktsegment, 'x') AS cuenca, count(*) AS n, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS imported FROM customer WHERE c_acctbal > 0 GROUP BY 1
""")
def replaced_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import that replaces all: the new rows only, counted by basin, if there are any."""
    new = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("cuenca"))
    old = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("cuenca"))
    rows = C.replace_all(old, new)
    return rows.groupBy("cuenca").agg(F.count("*").alias("n")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("imported"))))
