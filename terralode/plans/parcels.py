"""The parcel table and its aggregates. Parcels derive from the driver's tables: a part is a cadastre entry, an order the
practice record of a year for the account of its customer, a supplier an entry of the law's lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralode.functions import maps
from terralode.operators import parcels as P
from terralode.plans.registry import query, read

PRACTICES = ["capacitacion", "pasturas_implantadas", "rotacion_gramineas", "sistema_terraza"]
AXES = ["ambiental", "economico", "persona", "social"]


def _flag(k: int):
    return F.when((F.col("o_orderkey") + k) % 3 == 0, "Si").otherwise("No")


def _records(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Practice records of a year, by account; the last of an account counts."""
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = orders.where(F.year("o_orderdate") == year)
    return rows.select(
        F.concat(F.lit("12."), (F.col("o_custkey") % 300).cast("string"), F.lit(" ")).alias("cuenta"), F.when(key % 11 != 0, F.concat(F.lit("e"), (key % 90).cast("string"))).alias("n_explotacion"), (key % 4 != 0).alias("activa"),
        F.when(key % 5 == 0, 0.0).otherwise((key % 50).cast("double")).alias("superficie_bpa"), F.map_from_arrays(F.array(*map(F.lit, AXES)), F.array(*(_flag(k) for k in range(4)))).alias("ejes"),
        F.map_from_arrays(F.array(*map(F.lit, PRACTICES)), F.array(*(_flag(k + 1) for k in range(4)))).alias("practicas"), key.alias("ord"),
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    account = F.when(key % 13 == 0, " . ").otherwise(F.concat(F.lit(" 12"), (key % 400).cast("string")))
    cadastre = part.select(key.alias("id"), account.alias("Nro_Cuenta"), F.when(key % 17 != 0, (F.col("p_size") * 1234).cast("string")).alias("Superficie_Tierra_Rural"))
    listed = lambda m: read(spark, sf_dir, "supplier").where(m).select(F.concat(F.lit("12"), (F.col("s_suppkey") * 7 % 400).cast("string")).alias("lista_cuenta"))
    accepted, submitted = listed(F.col("s_suppkey") % 3 == 0), listed(F.col("s_suppkey") % 2 == 0)
    # The years of the driver's orders stand for those of the records.
    history = {str(year + 26): _records(spark, sf_dir, year) for year in range(1993, 1998)}
    return P.enrich(cadastre, _records(spark, sf_dir, 1998), accepted, submitted, history)


_SQL = """
WITH rec AS (SELECT year(o_orderdate) AS y, '12' || (o_custkey % 300) AS cuenta, CASE WHEN o_orderkey % 11 <> 0 THEN 'e' || (o_orderkey % 90) END AS n_explotacion, o_orderkey % 4 <> 0 AS activa,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey % 50 END::DOUBLE AS sup, o_orderkey AS ord FROM orders),
now AS (SELECT cuenta, max(ord) AS ord FROM rec WHERE y = 1998 GROUP BY 1), cur AS (SELECT rec.* FROM rec JOIN now USING (cuenta, ord)),
hist AS (SELECT cuenta, CAST(y + 26 AS VARCHAR) AS y, arg_max(n_explotacion, ord) AS v FROM rec WHERE y BETWEEN 1993 AND 1997 AND n_explotacion IS NOT NULL GROUP BY 1, 2),
hm AS (SELECT cuenta, count(*) AS n_years, string_agg(y, ',' ORDER BY y) AS years, arg_max(v, y) AS latest FROM hist GROUP BY 1),
acc AS (SELECT DISTINCT '12' || (s_suppkey * 7 % 400) AS cuenta FROM supplier WHERE s_suppkey % 3 = 0), sub AS (SELECT DISTINCT '12' || (s_suppkey * 7 % 400) AS cuenta FROM supplier WHERE s_suppkey % 2 = 0),
p AS (SELECT p_partkey AS id, '12' || (p_partkey % 400) AS cuenta, CASE WHEN p_partkey % 17 <> 0 THEN round(p_size * 1234 / 10000, 1) END AS ha FROM part WHERE p_partkey % 13 <> 0),
t AS (SELECT p.*, CASE WHEN p.cuenta IN (SELECT cuenta FROM acc) THEN 'aceptada' WHEN p.cuenta IN (SELECT cuenta FROM sub) THEN 'presentada' ELSE 'no_inscripta' END AS ley, cur.ord AS rec, coalesce(cur.activa, false) AS activa, cur.sup, cur.n_explotacion AS name,
  coalesce(hm.n_years, 0) + CASE WHEN cur.ord IS NULL THEN 0 ELSE 1 END AS anios, concat_ws(',', hm.years, CASE WHEN cur.ord IS NOT NULL THEN '2025' END) AS lista, coalesce(hm.n_years, 0) AS before, hm.latest, hm.years
  FROM p LEFT JOIN cur ON cur.cuenta = p.cuenta LEFT JOIN hm ON hm.cuenta = p.cuenta)
"""


@query(_SQL + "SELECT id, cuenta, ha AS superficie_ha, ley AS ley_forestal, rec IS NOT NULL AS has_record, anios::INTEGER AS anios_bpa, lista AS anios_lista, coalesce(latest, '') AS latest FROM t")
def parcel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parcels(spark, sf_dir)
    latest = F.coalesce(maps.latest_value(F.col("bpa_historico")), F.lit(""))
    return rows.select("id", "cuenta", "superficie_ha", "ley_forestal", F.col("bpa_2025").isNotNull().alias("has_record"), "anios_bpa", F.array_join("anios_lista", ",").alias("anios_lista"), latest.alias("latest"))


@query(_SQL + """
, s AS (SELECT count(*) FILTER (ley = 'aceptada') AS a, count(*) FILTER (ley = 'presentada') AS b, count(*) FILTER (ley = 'no_inscripta') AS c, round(coalesce(sum(ha) FILTER (ley = 'aceptada'), 0), 1) AS x, round(coalesce(sum(ha) FILTER (ley = 'presentada'), 0), 1) AS y FROM t)
SELECT a AS aceptada_count, b AS presentada_count, c AS no_inscripta_count, x AS aceptada_superficie_ha, y AS presentada_superficie_ha, CASE WHEN a + b > 0 THEN round(100.0 * a / (a + b), 1) ELSE 0 END::DOUBLE AS cumplimiento_pct_parcelas,
  CASE WHEN x + y > 0 THEN round(100.0 * x / (x + y), 1) ELSE 0 END::DOUBLE AS cumplimiento_pct_superficie FROM s
""")
def parcel_law_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.law_status(parcels(spark, sf_dir)).drop("no_inscripta_superficie_ha")


@query(_SQL + f"""
, a AS (SELECT rec FROM t WHERE activa), k AS (SELECT unnest({PRACTICES}) AS practice, unnest([1, 2, 3, 4]) AS k)
SELECT practice, count(rec) AS n, CASE WHEN (SELECT count(*) FROM a) > 0 THEN round(100.0 * count(rec) / (SELECT count(*) FROM a), 1) ELSE 0 END::DOUBLE AS pct FROM k LEFT JOIN a ON (rec + k) % 3 = 0 GROUP BY 1 UNION ALL SELECT 'riego_precision', 0, 0
""")
def practice_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.practice_ranking(parcels(spark, sf_dir), [*PRACTICES, "riego_precision"]).select("practice", "n", "pct")


@query(_SQL + f"""
, a AS (SELECT rec FROM t WHERE activa), k AS (SELECT unnest({AXES}) AS axis, unnest([0, 1, 2, 3]) AS k)
SELECT axis, CASE WHEN (SELECT count(*) FROM a) > 0 THEN round(100.0 * count(rec) / (SELECT count(*) FROM a), 1) ELSE 0 END::DOUBLE AS pct FROM k LEFT JOIN a ON (rec + k) % 3 = 0 GROUP BY 1
""")
def axis_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.axis_shares(parcels(spark, sf_dir), AXES)


@query(_SQL + """
, s AS (SELECT count(*) FILTER (activa) AS n, round(coalesce(sum(CASE WHEN sup > 0 THEN sup ELSE coalesce(ha, 0) END) FILTER (activa), 0), 1) AS ha, count(*) AS total FROM t)
SELECT n AS n_active, ha AS ha_active, total AS n_parcels, round(100.0 * ha / 5000, 1)::DOUBLE AS coverage_pct, CASE WHEN total > 0 THEN round(100.0 * n / total, 1) ELSE 0 END::DOUBLE AS parcels_pct FROM s
""")
def parcel_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kpis(parcels(spark, sf_dir), 5000.0)


@query(_SQL + """
, s AS (SELECT count(*) AS total, count(*) FILTER (before > 0 OR rec IS NOT NULL) AS ever, count(*) FILTER (before > 0 AND rec IS NULL) AS dropped, count(*) FILTER (before = 0 AND rec IS NULL) AS never FROM t)
SELECT *, round(100.0 * ever / total, 1)::DOUBLE AS ever_pct, round(100.0 * dropped / total, 1)::DOUBLE AS dropped_pct, round(100.0 * never / total, 1)::DOUBLE AS never_pct FROM s
""")
def historic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.historic_coverage(parcels(spark, sf_dir))


@query(_SQL + """
, y AS (SELECT unnest(string_split(years, ',')) AS year FROM t WHERE years IS NOT NULL UNION ALL SELECT '2025' FROM t WHERE rec IS NOT NULL), k AS (SELECT CAST(unnest(range(2019, 2026)) AS VARCHAR) AS year)
SELECT k.year, count(y.year) AS n FROM k LEFT JOIN y ON y.year = k.year GROUP BY 1
""")
def yearly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.yearly(parcels(spark, sf_dir))


@query(_SQL + """
, g AS (SELECT '12' || (c_custkey % 400) AS cuenta, arg_max(c_custkey, c_custkey) FILTER (c_custkey % 3 <> 0) AS g FROM customer GROUP BY 1)
SELECT id, t.cuenta, anios::INTEGER AS anios_bpa, CASE WHEN rec IS NOT NULL THEN coalesce(name, '') ELSE coalesce(latest, '') END AS n_explotacion_ultima, rec IS NOT NULL AS bpa_activa_2025, 'POINT (' || g || ' 1)' AS geometry FROM t JOIN g ON g.cuenta = t.cuenta WHERE anios >= 1 AND g IS NOT NULL
""")
def parcel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with records and a geometry, the last that isn't null."""
    rows, key = parcels(spark, sf_dir), F.col("c_custkey")
    drawn = F.when(key % 3 != 0, F.concat(F.lit("POINT ("), key.cast("string"), F.lit(" 1)")))
    cadastre = read(spark, sf_dir, "customer").select(F.concat(F.lit("12"), (key % 400).cast("string")).alias("Nro_Cuenta"), drawn.alias("geometry"), key.alias("ord"))
    out = P.with_geometry(rows, cadastre)
    ids = rows.select("id", F.col("cuenta").alias("c"), "anios_bpa")
    # A parcel that repeats in the cadastre is a row each.
    return out.drop("anios_lista").dropDuplicates(["cuenta"]).drop("anios_bpa").join(ids, F.col("c") == F.col("cuenta")).drop("c")


@query("""
WITH g AS (SELECT CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(c_nationkey * 1.5 AS VARCHAR) END AS altura, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS categoria FROM customer)
SELECT 'altura' AS name, CAST(NULL AS VARCHAR) AS value, round(avg(CASE WHEN altura IS NOT NULL THEN coalesce(TRY_CAST(altura AS DOUBLE), 0) END), 1) AS mean, CAST(NULL AS BIGINT) AS n FROM g
UNION ALL SELECT 'categoria', categoria, NULL, count(*) FROM g WHERE categoria IS NOT NULL GROUP BY 2
""")
def grid_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    height = F.when(key % 6 == 1, "x").when(key % 6 > 1, (F.col("c_nationkey") * 1.5).cast("string"))
    cells = read(spark, sf_dir, "customer").select(height.alias("altura"), F.when(key % 4 != 0, F.col("c_mktsegment")).alias("categoria"))
    means = P.grid_means(cells, ["altura"]).select(F.lit("altura").alias("name"), F.col("altura").alias("mean"))
    return means.unionByName(P.distribution(cells, "categoria").withColumn("name", F.lit("categoria")), allowMissingColumns=True)


@query(f"""
WITH f AS (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AS has FROM orders)
SELECT k, has, CASE WHEN has THEN k % 3 = 1 OR k % 3 = 2 AND k % 2 = 0 END AS activa, CASE WHEN has THEN {" + ".join(f"(CASE WHEN (k + {i}) % 3 = 0 THEN 1 ELSE 0 END)" for i in range(1, 5))} END::INTEGER AS adopted FROM f
""")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of flat properties: null without a total, flags that are Si or No, and how many are adopted."""
    key = F.col("o_orderkey")
    active = F.when(key % 3 == 1, "1").when((key % 3 == 2) & (key % 2 == 0), "true").when(key % 3 == 2, "yes")
    flags = [F.when((key + k) % 3 == 0, "Si").when((key + k) % 3 == 1, "si") for k in range(1, 5)]
    flat = F.map_from_arrays(F.array(*map(F.lit, ["bpa_total", "activa", *PRACTICES])), F.array(F.when(key % 7 != 0, "3"), active, *flags))
    rows = read(spark, sf_dir, "orders").select(key.alias("k"), P.nested_record(flat, AXES, PRACTICES).alias("r"))
    return rows.select("k", F.col("r").isNotNull().alias("has"), "r.activa", F.when(F.col("r").isNotNull(), maps.adopted(F.col("r.practicas"))).alias("adopted"))
