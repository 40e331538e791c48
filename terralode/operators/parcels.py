"""Parcels and good practices: the enriched parcel table and its aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralode.functions import maps, numeric, text
from terralode.operators.relational import last_wins, membership, with_all_keys

YEARS = tuple(str(y) for y in range(2019, 2026))


def enrich(cadastre: DataFrame, practices: DataFrame, accepted: DataFrame, submitted: DataFrame, history: Mapping[str, DataFrame]) -> DataFrame:
    """Parcels with their law status, the practice record of the year (null if none) and the map of earlier years.

    Keys are normalised on both sides; parcels without one are dropped, repeated parcels stay; of repeated records the
    last counts. Keys in both lists are accepted.
    """
    parcels = cadastre.withColumn("cuenta", text.normal_key(F.col("Nro_Cuenta"))).where("cuenta is not null")
    parcels = parcels.withColumn("superficie_ha", numeric.hectares(F.col("Superficie_Tierra_Rural")))
    records = last_wins(practices.withColumn("cuenta", text.normal_key(F.col("cuenta"))), "cuenta", "ord")
    record = F.struct(*(F.col(c) for c in records.columns if c != "cuenta"))
    keyed = lambda df: df.select(text.normal_key(F.col("lista_cuenta")).alias("cuenta"))
    out = parcels.join(records.select("cuenta", record.alias("bpa_2025")), "cuenta", "left")
    out = membership(out, "cuenta", {"aceptada": keyed(accepted), "presentada": keyed(submitted)}, "no_inscripta", "ley_forestal")
    layers = [df.select(text.normal_key(F.col("cuenta")).alias("cuenta"), F.lit(y).alias("year"), F.col("n_explotacion").cast("string").alias("value"), "ord") for y, df in history.items() if y != YEARS[-1]]
    past = layers[0].limit(0)
    for layer in layers:
        past = past.union(layer)
    one = past.dropna().groupBy("cuenta", "year").agg(F.max_by("value", "ord").alias("value"))
    by_key = one.groupBy("cuenta").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("bpa_historico"))
    out = out.join(by_key, "cuenta", "left").withColumn("bpa_historico", F.coalesce("bpa_historico", F.create_map().cast("map<string,string>")))
    years = F.array_sort(F.array_union(maps.years_within(F.col("bpa_historico"), YEARS[:-1]), F.when(F.col("bpa_2025").isNotNull(), F.array(F.lit(YEARS[-1]))).otherwise(F.array().cast("array<string>"))))
    return out.withColumn("anios_lista", years).withColumn("anios_bpa", F.size("anios_lista"))


def law_status(parcels: DataFrame) -> DataFrame:
    """Counts and areas by law status in one row, and the accepted share of what was submitted or accepted, by number and
    by area; areas are rounded before the share is taken of them."""
    n = lambda s: F.count_if(F.col("ley_forestal") == s).alias(f"{s}_count")
    ha = lambda s: F.round(F.coalesce(F.sum(F.when(F.col("ley_forestal") == s, numeric.safe_double(F.col("superficie_ha")))), F.lit(0.0)), 1).alias(f"{s}_superficie_ha")
    row = parcels.agg(n("aceptada"), n("presentada"), n("no_inscripta"), ha("aceptada"), ha("presentada"))
    share = lambda what: numeric.percent(F.col(f"aceptada_{what}"), F.col(f"aceptada_{what}") + F.col(f"presentada_{what}"))
    return row.withColumn("cumplimiento_pct_parcelas", share("count")).withColumn("cumplimiento_pct_superficie", share("superficie_ha"))


def axis_shares(parcels: DataFrame, axes: Sequence[str], field: str = "bpa_2025.ejes") -> DataFrame:
    """(axis, pct): the share of active records that say yes on each axis of a fixed list; 0 of no records."""
    active = parcels.where("bpa_2025.activa")
    hits = active.agg(*(F.count_if(F.try_element_at(F.col(field), F.lit(a)) == "Si").alias(a) for a in axes), F.count("*").alias("total"))
    return hits.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, axes)), F.array(*(numeric.percent(F.col(a), F.col("total")) for a in axes)))).alias("axis", "pct"))


def practice_ranking(parcels: DataFrame, practices: Sequence[str], field: str = "bpa_2025.practicas") -> DataFrame:
    """Adoption of each practice of a fixed list among active records, most adopted first, then by name."""
    active = parcels.where("bpa_2025.activa")
    flags = active.select(F.explode(F.col(field)).alias("practice", "flag"))
    counts = with_all_keys(flags.groupBy("practice").agg(F.count_if(F.col("flag") == "Si").alias("n")), "practice", practices)
    total = active.agg(F.count("*").alias("total"))
    ranked = counts.crossJoin(F.broadcast(total)).withColumn("pct", numeric.percent(F.col("n"), F.col("total")))
    return ranked.orderBy(F.desc("pct"), "practice")


def kpis(parcels: DataFrame, zone_ha: float) -> DataFrame:
    """Active records, their area (that of the practices where it is positive, else the parcel's) and its share."""
    area = F.when(F.col("bpa_2025.superficie_bpa") > 0, F.col("bpa_2025.superficie_bpa")).otherwise(F.coalesce("superficie_ha", F.lit(0.0)))
    active = F.coalesce(F.col("bpa_2025.activa"), F.lit(False))
    row = parcels.agg(F.count_if(active).alias("n_active"), F.round(F.coalesce(F.sum(F.when(active, area)), F.lit(0.0)), 1).alias("ha_active"), F.count("*").alias("n_parcels"))
    return row.withColumn("coverage_pct", numeric.percent(F.col("ha_active"), F.lit(zone_ha))).withColumn("parcels_pct", numeric.percent(F.col("n_active"), F.col("n_parcels")))


def historic_coverage(parcels: DataFrame) -> DataFrame:
    """Parcels with a record in any year, those with one before but none now, and those without any, with their shares."""
    before, now = F.size("bpa_historico") > 0, F.col("bpa_2025").isNotNull()
    row = parcels.agg(F.count("*").alias("total"), F.count_if(before | now).alias("ever"), F.count_if(before & ~now).alias("dropped"), F.count_if(~before & ~now).alias("never"))
    return row.select("*", *(numeric.percent(F.col(c), F.col("total")).alias(f"{c}_pct") for c in ("ever", "dropped", "never")))


def yearly(parcels: DataFrame) -> DataFrame:
    """Parcels with records in each year of the window, zeros kept; a record of the last year counts beside the history."""
    now = F.when(F.col("bpa_2025").isNotNull(), F.array(F.lit(YEARS[-1]))).otherwise(F.array().cast("array<string>"))
    years = parcels.select(F.explode(F.concat(F.map_keys("bpa_historico"), now)).alias("year"))
    return with_all_keys(years.groupBy("year").agg(F.count("*").alias("n")), "year", YEARS).orderBy("year")


def grid_means(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means of text columns over what isn't null; what isn't a number counts as 0; 0 where all is null."""
    mean = lambda c: F.avg(F.when(F.col(c).isNotNull(), numeric.safe_double(F.col(c))))
    return cells.agg(*(F.round(F.coalesce(mean(c), F.lit(0.0)), 1).alias(c) for c in columns))


def distribution(cells: DataFrame, column: str) -> DataFrame:
    """(value, n): counts of the values of a column, nulls aside."""
    return cells.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def with_geometry(parcels: DataFrame, cadastre: DataFrame) -> DataFrame:
    """Parcels with records in at least one year, where the cadastre has their geometry (the last that isn't null), with
    the name of the present record, else that of the latest year, else an empty one."""
    drawn = cadastre.select(text.normal_key(F.col("Nro_Cuenta")).alias("cuenta"), "geometry", "ord").where("geometry is not null")
    latest = F.when(F.col("bpa_2025").isNotNull(), F.col("bpa_2025.n_explotacion")).otherwise(maps.latest_value(F.col("bpa_historico")))
    rows = parcels.where("anios_bpa >= 1").drop("geometry").join(last_wins(drawn, "cuenta", "ord").select("cuenta", "geometry"), "cuenta")
    return rows.select("cuenta", "anios_bpa", "anios_lista", F.coalesce(latest, F.lit("")).alias("n_explotacion_ultima"), F.col("bpa_2025").isNotNull().alias("bpa_activa_2025"), "geometry")


def nested_record(flat: Column, axes: Sequence[str], practices: Sequence[str]) -> Column:
    """A practice record of a flat map of properties: null without a total; flags are Si or No, whatever else stands
    there; active if 1 or true."""
    at = lambda k: F.try_element_at(flat, F.lit(k))
    flags = lambda keys, prefix: F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.when(at(prefix + k) == "Si", "Si").otherwise("No") for k in keys)))
    record = F.struct(
        F.coalesce(at("n_explotacion"), F.lit("")).alias("n_explotacion"), numeric.safe_double(at("superficie_bpa")).alias("superficie_bpa"), at("bpa_total").alias("bpa_total"),
        F.coalesce(at("id_explotacion"), F.lit("")).alias("id_explotacion"), F.coalesce(at("activa").isin("1", "true"), F.lit(False)).alias("activa"), flags(axes, "eje_").alias("ejes"), flags(practices, "").alias("practicas"),
    )
    return F.when(at("bpa_total").isNotNull(), record)
