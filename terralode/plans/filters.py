"""Queries on filters, projections, sorts and sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import maps
from terralode.operators import relational as R
from terralode.plans.registry import query, read
from terralode.sources.geojson import parse_bbox


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = -1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a key, and none for a key that isn't there."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return R.by_key(rows, "c_custkey", 7).union(R.by_key(rows, "c_custkey", -1))


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS n_public FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY 1
""")
def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list filter, with the conjunction of two flags counted beside it."""
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
    flags = rows.select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("is_public"), (F.col("o_totalprice") > 100_000).alias("visible"))
    return flags.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("is_public") & F.col("visible")).alias("n_public"))


_GAPS = "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'c' || (o_custkey % 5) END AS cuenca, o_custkey % 3 = 0 AS is_active FROM orders"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 != 0, F.concat(F.lit("c"), (key % 5).cast("string"))).alias("cuenca"), (key % 3 == 0).alias("is_active"))


@query(f"""
WITH g AS ({_GAPS}) SELECT 'null' AS asked, count(*) AS n, count(*) FILTER (is_active) AS active FROM g WHERE cuenca IS NULL
UNION ALL SELECT 'c3', count(*), count(*) FILTER (is_active) FROM g WHERE cuenca = 'c3' UNION ALL SELECT 'known', count(*), count(*) FILTER (is_active) FROM g WHERE cuenca IS NOT NULL
""")
def null_safe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a basin, of none where none is asked for, and of any."""
    rows = _gaps(spark, sf_dir)
    counted = lambda name, df: df.agg(F.lit(name).alias("asked"), F.count("*").alias("n"), F.count_if("is_active").alias("active"))
    return counted("null", R.same_or_null(rows, "cuenca", None)).union(counted("c3", R.same_or_null(rows, "cuenca", "c3"))).union(counted("known", rows.where(F.col("cuenca").isNotNull())))


@query("""
WITH z AS (SELECT p_partkey, 'basin_' || (p_partkey % 20) || '_' || p_size AS nombre, p_brand AS cuenca FROM part)
SELECT p_partkey, nombre, cuenca FROM z WHERE nombre LIKE 'basin_1_%' OR cuenca = 'Brand#13'
""")
def prefix_or_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("basin_"), (F.col("p_partkey") % 20).cast("string"), F.lit("_"), F.col("p_size").cast("string"))
    return R.prefix_or_equal(read(spark, sf_dir, "part").select("p_partkey", name.alias("nombre"), F.col("p_brand").alias("cuenca")), "nombre", "basin_1_%", "cuenca", "Brand#13")


@query("""
WITH u AS (SELECT c_custkey, lower(c_mktsegment) AS code FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING')
SELECT c_custkey, code, 'building' AS asked FROM u WHERE code = 'building' UNION ALL SELECT c_custkey, code, 'MaChInErY' FROM u WHERE code = 'MACHINERY'
""")
def upper_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code as it is given, and in capitals only where that finds nothing."""
    rows, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    both = rows.where(key % 3 == 0).select("c_custkey", F.lower("c_mktsegment").alias("code")).union(rows.where((key % 3 != 0) & (F.col("c_mktsegment") != "BUILDING")).select("c_custkey", "c_mktsegment"))
    found = lambda code: R.with_upper_retry(both, "code", code).withColumn("asked", F.lit(code))
    return found("building").union(found("MaChInErY"))


@query("""
WITH i AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Alta' WHEN 2 THEN 'Media' ELSE 'Opcional' END AS stage FROM part)
SELECT coalesce(stage, 'none') AS stage, count(*) AS n, count(*) FILTER (id % 10 NOT IN (0, 5)) AS shown FROM i WHERE stage IS NULL OR stage <> 'Media' GROUP BY 1
""")
def visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items shown by their own flags and those of their stages, against all of the shown stages."""
    key = F.col("p_partkey")
    stage = F.when(key % 4 == 1, "Alta").when(key % 4 == 2, "Media").when(key % 4 == 3, "Opcional")
    items = read(spark, sf_dir, "part").select(key.alias("id"), stage.alias("stage"))
    flags = items.where("id % 5 = 0").select("id", F.lit(False).alias("shown")).union(items.where("id % 5 = 1").select("id", F.lit(True)))
    stages = spark.createDataFrame([("Media", False), ("Alta", True)], "stage string, shown boolean")
    count = lambda df, name: df.groupBy(F.coalesce("stage", F.lit("none")).alias("stage")).agg(F.count("*").alias(name))
    hidden = R.visible(items, flags, stages, master=False)
    shown = R.visible(items, flags, stages, master=True).unionByName(hidden)
    by_stage = R.visible(items, flags.limit(0), stages, master=True)
    return count(by_stage, "n").join(count(shown, "shown"), "stage")


@query("""
SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size <= 25 AS drawn, CASE WHEN lower(p_name) LIKE '%test%' OR lower(p_name) LIKE 'a%' OR p_type LIKE 'PROMO%' THEN 'test' ELSE 'real' END AS kind
FROM part WHERE p_partkey IS NOT NULL
""")
def pattern_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists at once, and chains of patterns that tell test data."""
    name = F.col("p_name")
    drawn = F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13") & (F.col("p_size") <= 25)
    kind = F.when(name.ilike("%test%") | name.ilike("a%") | F.col("p_type").like("PROMO%"), "test").otherwise("real")
    return read(spark, sf_dir, "part").where("p_partkey is not null").select("p_partkey", drawn.alias("drawn"), kind.alias("kind"))


@query("""
WITH b AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'x,1,2,3' WHEN 1 THEN '1,2,3' WHEN 2 THEN NULL ELSE (s_suppkey % 90) || ', ' || (s_suppkey % 45) || ',' || (s_suppkey % 90 + 10) || ',50.5' END AS box FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 5 >= 3 THEN (s_suppkey % 90)::DOUBLE END AS min_x, CASE WHEN s_suppkey % 5 >= 3 THEN 50.5::DOUBLE END AS max_y, s_suppkey % 5 >= 3 AND s_suppkey % 90 <= 40 AND s_suppkey % 90 + 10 >= 20 AND s_suppkey % 45 <= 30 AS meets FROM b
""")
def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as text, null unless they are four numbers, against an envelope."""
    key = F.col("s_suppkey")
    good = F.concat((key % 90).cast("string"), F.lit(", "), (key % 45).cast("string"), F.lit(","), (key % 90 + 10).cast("string"), F.lit(",50.5"))
    text = F.when(key % 5 == 0, "x,1,2,3").when(key % 5 == 1, "1,2,3").when(key % 5 > 2, good)
    b = parse_bbox(text)
    meets = (b["min_x"] <= 40) & (b["max_x"] >= 20) & (b["min_y"] <= 30) & (b["max_y"] >= 10)
    return read(spark, sf_dir, "supplier").select("s_suppkey", b["min_x"].alias("min_x"), b["max_y"].alias("max_y"), F.coalesce(meets, F.lit(False)).alias("meets"))


_PROPERTIES = "p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand, p_partkey % 4 = 0 AS internal"


@query(f"""
WITH p AS (SELECT {_PROPERTIES} FROM part)
SELECT p_partkey, 'Nombre=' || p_name || CASE WHEN brand <> '' THEN '|brand=' || brand ELSE '' END AS listed, CASE WHEN internal THEN 'brand,name' ELSE 'brand,name,size' END AS shown, p_name AS name, coalesce(nullif(brand, ''), 'none') AS marca,
  '' AS missing FROM p
""")
def property_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by whitelist with labels, without internal ones, without private ones, decorated and with defaults."""
    key = F.col("p_partkey")
    m = F.map_from_arrays(F.array(F.lit("name"), F.lit("brand"), F.when(key % 4 == 0, "__size").otherwise("size"), F.lit("Telefono")), F.array("p_name", F.when(key % 3 == 0, "").otherwise(F.col("p_brand")), F.col("p_size").cast("string"), F.lit("1")))
    rows = read(spark, sf_dir, "part").select("p_partkey", maps.drop_private(m, ["telefono", "email"]).alias("m"))
    pairs = F.transform(maps.displayable(F.col("m"), ["name", "size_x", "brand"], {"name": "Nombre"}), lambda p: F.concat_ws("=", p["label"], p["value"]))
    decorated = maps.merged(F.col("m"), F.create_map(F.lit("marca"), F.coalesce(F.nullif(F.element_at("m", "brand"), F.lit("")), F.lit("none"))))
    at = lambda k: F.coalesce(F.try_element_at(decorated, F.lit(k)), F.lit(""))
    shown = F.array_join(F.transform(maps.displayable(F.col("m"), None), lambda p: p["label"]), ",")
    return rows.select("p_partkey", F.array_join(pairs, "|").alias("listed"), shown.alias("shown"), at("name").alias("name"), at("marca").alias("marca"), at("nivel").alias("missing"))


@query("""
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'c' || s_nationkey WHEN 2 THEN NULL ELSE 'n' || s_suppkey END AS rubro, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 10 END AS proyectado,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey * 7 END AS ejecutado FROM supplier)
SELECT s_suppkey, rubro, coalesce(proyectado, 0)::DOUBLE AS proyectado, coalesce(ejecutado, 0)::DOUBLE AS ejecutado FROM r WHERE rubro IS NOT NULL AND (proyectado IS NOT NULL OR ejecutado IS NOT NULL)
""")
def payload_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of JSON payloads whose fields go by several names; those without a name or any number are dropped."""
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, F.struct(F.col("s_name").alias("rubro"))["rubro"])
    payload = F.to_json(F.struct(
        name.alias("rubro"), F.when(key % 4 == 1, F.concat(F.lit("c"), F.col("s_nationkey").cast("string"))).alias("categoria"), F.when(key % 4 == 3, F.concat(F.lit("n"), key.cast("string"))).alias("nombre"),
        F.when((key % 3 != 0) & (key % 2 == 0), key * 10).alias("presupuestado"), F.when((key % 3 != 0) & (key % 2 == 1), key * 10).alias("monto_presupuestado"), F.when(key % 6 != 0, key * 7).alias("ejecutado"),
    ))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.from_json(payload, "map<string,string>").alias("m"))
    number = lambda *names: maps.first_of(F.col("m"), names).try_cast("double")
    rows = rows.select("s_suppkey", maps.first_of(F.col("m"), ["rubro", "categoria", "nombre"]).alias("rubro"), number("proyectado", "presupuestado", "monto_presupuestado").alias("proyectado"), number("real", "ejecutado").alias("ejecutado"))
    sound = F.col("rubro").isNotNull() & (F.col("proyectado").isNotNull() | F.col("ejecutado").isNotNull())
    return rows.where(sound).na.fill(0.0, ["proyectado", "ejecutado"])


@query("""
SELECT *, CAST(row_number() OVER (ORDER BY anio DESC, o_orderpriority) AS INTEGER) AS place FROM (SELECT o_orderpriority, year(o_orderdate)::INTEGER AS anio, count(*) AS n FROM orders GROUP BY 1, 2)
""")
def mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years falling, priorities rising."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("anio")).agg(F.count("*").alias("n"))
    order = [F.desc("anio"), F.asc("o_orderpriority")]  # a row for each year and priority
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy(*order)


_LEVELS = "SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal > 8000 THEN 'critico' WHEN s_acctbal > 5000 THEN 'alto' ELSE 'moderado' END AS nivel FROM supplier"


@query(f"""
WITH l AS ({_LEVELS}) SELECT s_suppkey, nivel, 'severity' AS sorted_by FROM (SELECT * FROM l ORDER BY CASE nivel WHEN 'critico' THEN 0 WHEN 'alto' THEN 1 ELSE 2 END, s_acctbal DESC, s_suppkey LIMIT 12)
UNION ALL SELECT s_suppkey, nivel, 'change' FROM (SELECT * FROM l ORDER BY abs(s_acctbal - 4000) DESC, s_suppkey LIMIT 12)
""")
def ordinal_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an order by severity and score, and of one by the size of a change."""
    balance = F.col("s_acctbal")
    level = F.when(balance > 8000, "critico").when(balance > 5000, "alto").otherwise("moderado")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", level.alias("nivel"))
    rank = F.create_map(*(F.lit(x) for pair in (("critico", 0), ("alto", 1), ("moderado", 2)) for x in pair))
    first = lambda name, *order: rows.orderBy(*order, "s_suppkey").limit(12).select("s_suppkey", "nivel", F.lit(name).alias("sorted_by"))
    return first("severity", rank[F.col("nivel")], F.desc("s_acctbal")).union(first("change", F.desc(F.abs(balance - 4000))))


@query("""
WITH s AS (SELECT s_nationkey AS k, sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS total, count(s_acctbal) AS n FROM supplier GROUP BY 1), m AS (SELECT k, total, n, total::DOUBLE / n AS mean FROM s),
f AS (SELECT c_nationkey AS k, min(c_custkey) AS least FROM customer JOIN (SELECT c_nationkey AS k, min(c_acctbal) AS low FROM customer GROUP BY 1) ON c_nationkey = k AND c_acctbal = low GROUP BY 1)
SELECT m.k AS nation, sign(total) * ((abs(total) * 200 + n) // (n * 2)) / 100.0::DOUBLE AS mean, least, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, m.k NULLS FIRST) AS INTEGER) AS place FROM m LEFT JOIN f ON f.k = m.k
""")
def mean_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by falling mean, each with the row that has the least of a value (the clearest scene, the cheapest offer)."""
    from pyspark.sql import Window

    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    means = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum(cents).alias("total"), F.count(cents).alias("n"))
    means = means.withColumn("mean", F.col("total").cast("double") / F.nullif("n", F.lit(0)))
    least = read(spark, sf_dir, "customer").where("c_acctbal is not null").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("least"))
    rows = means.join(least, "nation", "left")
    halves_up = F.signum("total") * F.expr("(abs(total) * 200 + n) div nullif(n * 2, 0)") / 100.0  # exactly, of the whole numbers
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "nation")))  # a row for each nation
    return rows.select("nation", halves_up.alias("mean"), "least", "place")


@query("""
SELECT source, waterway, count(*) AS n FROM (SELECT 'auto' AS source, 'drainage_auto' AS waterway FROM supplier UNION ALL SELECT 'real', CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE c_mktsegment END FROM customer) GROUP BY 1, 2
""")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers with a tag of their source, and a default for what one of them lacks; an empty layer adds nothing."""
    auto = read(spark, sf_dir, "supplier").select(F.lit("auto").alias("source"), F.lit("drainage_auto").alias("waterway"))
    real = read(spark, sf_dir, "customer").select(F.lit("real").alias("source"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("waterway"))
    none = real.limit(0).drop("waterway")
    both = auto.unionByName(real).unionByName(none, allowMissingColumns=True)
    return both.groupBy("source", F.coalesce("waterway", F.lit("unknown")).alias("waterway")).agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT p_brand AS value, 'found' AS list, ''::VARCHAR AS options FROM part WHERE p_size > 10 UNION ALL SELECT unnest(['a', 'b']), 'default', ''
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'added', CASE p_partkey % 3 WHEN 0 THEN 'Cal,Riego' WHEN 1 THEN 'Cal,Riego' ELSE 'Cal,Riego,n' || p_size END FROM part WHERE p_partkey % 50 < 3
""")
def option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values or defaults, and lists to which a value is added if it isn't there."""
    part = read(spark, sf_dir, "part")
    found = R.options(part.where("p_size > 10").select("p_brand").union(part.limit(3).select(F.lit(""))), "p_brand", ["a", "b"])
    spare = R.options(part.limit(0), "p_brand", ["a", "b"])
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, "  ").when(key % 3 == 1, " RIEGO ").otherwise(F.concat(F.lit(" N"), F.col("p_size").cast("string")))
    added = part.where(key % 50 < 3).select(key.cast("string").alias("value"), F.lit("added").alias("list"), F.array_join(R.add_option(F.array(F.lit("Cal"), F.lit("Riego")), raw), ",").alias("options"))
    plain = lambda df, name: df.select("value", F.lit(name).alias("list"), F.lit("").alias("options"))
    return plain(found, "found").union(plain(spare, "default")).union(added)


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderdate FROM orders)
SELECT CASE WHEN s IN ('O', 'F') THEN 'canonical' ELSE 'discarded' END AS part, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day FROM o GROUP BY 1
""")
def parted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose state is known, and the others, with their distinct dates."""
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("s"), F.to_date("o_orderdate").alias("day"))
    kept, rest = R.parted(rows, "s", ["O", "F"])
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.min("day").cast("string").alias("first_day"))
    return count(kept, "canonical").union(count(rest, "discarded"))


@query("""
WITH i AS (SELECT s_suppkey AS basin, s_nationkey AS zone FROM supplier WHERE s_suppkey % 4 <> 0), d AS (SELECT s_suppkey AS basin, (s_nationkey + 1) % 25 AS zone FROM supplier WHERE s_suppkey % 6 = 0),
a AS (SELECT coalesce(d.basin, i.basin) AS basin, coalesce(d.zone, i.zone) AS zone FROM i FULL JOIN d ON d.basin = i.basin)
SELECT n_nationkey AS zone, n_name, count(basin) AS basins, coalesce(sum(basin % 100), 0)::BIGINT AS area FROM nation LEFT JOIN a ON a.zone = n_nationkey GROUP BY 1, 2
""")
def zone_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of each zone after a draft of assignments, and their area; zones without any too."""
    suppliers, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    initial = suppliers.where(key % 4 != 0).select(key.alias("basin"), F.col("s_nationkey").cast("int").alias("zone"))
    draft = suppliers.where(key % 6 == 0).select(key.alias("basin"), ((F.col("s_nationkey") + 1) % 25).cast("int").alias("zone"))
    sums = R.assigned(initial, draft, "basin", "zone").groupBy("zone").agg(F.count("*").alias("basins"), F.sum(F.col("basin") % 100).alias("area"))
    zones = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone"), "n_name")
    return zones.join(sums, "zone", "left").na.fill(0, ["basins", "area"])


@query("""
WITH c AS (SELECT c_nationkey AS zone, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS score FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS zone, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS score FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1)
SELECT c.zone, n_name, round(c.score - b.score, 2) AS delta_score FROM c JOIN b ON b.zone = c.zone LEFT JOIN nation ON n_nationkey = c.zone AND n_nationkey % 2 = 0
""")
def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against a baseline, where there is one, with what is known of the zone."""
    total = lambda t, k, v: read(spark, sf_dir, t).groupBy(F.col(k).alias("zone")).agg(F.sum(F.col(v).cast("decimal(18,2)")).cast("double").alias("score"))
    meta = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("zone"), "n_name")
    out = R.compared(total("customer", "c_nationkey", "c_acctbal"), total("supplier", "s_nationkey", "s_acctbal").where("zone % 4 <> 0"), meta, "zone", ["score"])
    return out.select("zone", "n_name", F.round("delta_score", 2).alias("delta_score"))


@query("""
WITH e AS (SELECT c_custkey, nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END || ' ' || CASE WHEN c_custkey % 4 < 2 THEN '' ELSE c_mktsegment END), '') AS whole, 'u' || c_custkey || '@x.ar' AS mail FROM customer)
SELECT o_orderkey, coalesce(whole, mail) AS shown FROM orders LEFT JOIN e ON c_custkey = o_custkey AND o_custkey % 5 <> 0
""")
def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full name of an optional user, or else their address; null where there is no user."""
    key = F.col("c_custkey")
    whole = F.nullif(F.trim(F.concat_ws(" ", F.when(key % 4 != 0, F.col("c_name")).otherwise(""), F.when(key % 4 >= 2, F.col("c_mktsegment")).otherwise(""))), F.lit(""))
    users = read(spark, sf_dir, "customer").where(key % 5 != 0).select(key.alias("o_custkey"), F.coalesce(whole, F.concat(F.lit("u"), key.cast("string"), F.lit("@x.ar"))).alias("shown"))
    return read(spark, sf_dir, "orders").join(users, "o_custkey", "left").select("o_orderkey", "shown")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'a' || p_size END, CASE WHEN p_partkey % 2 = 0 THEN p_name END, latest) AS name FROM part
LEFT JOIN (SELECT l_partkey, arg_max(l_returnflag || l_linenumber, epoch(l_shipdate) * 1e9 + l_orderkey * 10 + l_linenumber) AS latest FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
""")
def name_of_three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of this year's record, else of the feature, else of the latest history."""
    lines = read(spark, sf_dir, "lineitem")
    latest = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by(F.concat("l_returnflag", F.col("l_linenumber").cast("string")), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"))
    key = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").join(latest, "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce(F.when(key % 3 == 0, F.concat(F.lit("a"), F.col("p_size").cast("string"))), F.when(key % 2 == 0, F.col("p_name")), "latest").alias("name"))


@query("""
WITH i AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS k FROM part)
SELECT p_partkey, string_agg('i' || k, ',' ORDER BY k) AS items, max(p_partkey % 4) AS hidden FROM i WHERE k <> p_partkey % 4 GROUP BY 1
""")
def hidden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without the items whose places are hidden."""
    items = F.array(*(F.lit(f"i{k}") for k in range(4)))
    rows = read(spark, sf_dir, "part").select("p_partkey", items.alias("items"), (F.col("p_partkey") % 4).alias("hidden"))
    left = F.filter(F.transform("items", lambda x, i: F.when(i != F.col("hidden"), x)), lambda x: x.isNotNull())
    return rows.select("p_partkey", F.array_join(left, ",").alias("items"), "hidden")


@query("""
WITH r AS (SELECT p_partkey, p_brand FROM part), head AS (SELECT max(p_brand) AS h FROM part)
SELECT p_brand, count(*) AS n, EXISTS (SELECT 1 FROM supplier WHERE 'Brand#' || (10 + s_suppkey % 20) = p_brand) AS known, p_brand = (SELECT h FROM head) AS is_head FROM r GROUP BY 1
""")
def revision_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored revisions are among the known ones, and the last."""
    rows = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    known = read(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), (10 + F.col("s_suppkey") % 20).cast("string")).alias("p_brand")).distinct().withColumn("known", F.lit(True))
    head = rows.agg(F.max("p_brand").alias("head"))
    out = rows.join(known, "p_brand", "left").crossJoin(F.broadcast(head))
    return out.select("p_brand", "n", F.coalesce("known", F.lit(False)).alias("known"), (F.col("p_brand") == F.col("head")).alias("is_head"))


@query("""
WITH v(viewer) AS (VALUES (1), (2), (3), (4), (5), (6), (7), (8)), p AS (SELECT viewer, EXISTS (SELECT 1 FROM customer WHERE c_custkey = viewer AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS every FROM v)
SELECT viewer, count(*) AS rows_seen, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM p JOIN orders ON every OR o_custkey = viewer GROUP BY 1
""")
def row_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What eight viewers may see: all with a profile of certain roles, else their own rows."""
    profiles = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    seen = [R.visible_to(orders, profiles, v, F.col("o_custkey"), ["BUILDING", "MACHINERY"]).select(F.lit(v).alias("viewer"), "o_totalprice") for v in range(1, 9)]
    both = reduce(DataFrame.union, seen)
    return both.groupBy("viewer").agg(F.count("*").alias("rows_seen"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH k AS (SELECT p_partkey, 't' || (p_size % 6) AS kind FROM part)
SELECT 'all' AS asked, kind, count(*) AS n FROM k WHERE kind IN ('t0', 't2', 't3') GROUP BY 2 UNION ALL SELECT 't2', kind, count(*) FROM k WHERE kind = 't2' GROUP BY 2
""")
def public_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the kinds that may be public: all, one of them, and one that may not."""
    rows, kind = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), (F.col("p_size") % 6).cast("string")).alias("kind")), F.col("kind")
    asked = [R.public_subset(rows, kind, ["t0", "t2", "t3"], a).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(a or "all").alias("asked"), "kind", "n") for a in (None, "t2", "t5")]
    return reduce(DataFrame.union, asked)
