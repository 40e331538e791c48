"""Relational operators, DataFrame to DataFrame: filters, pages, keyed joins, ranks, versions and upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; those whose value is null or empty are skipped."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == value)
    return df


def by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a unique key: at most one; ValueError if there are several, as the key isn't unique then."""
    found = df.where(F.col(key) == F.lit(value)).limit(2)
    if found.count() > 1:
        raise ValueError(f"{key} = {value!r} isn't unique")
    return found


def prefix_or_equal(df: DataFrame, name: str, pattern: str, other: str, value: str) -> DataFrame:
    """Rows whose name is LIKE a pattern (in which _ is any character), or whose other column has a value."""
    return df.where(F.col(name).like(pattern) | (F.col(other) == value))


def same_or_null(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with the value; those with a null where none is given."""
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def with_upper_retry(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows with the value, or, if there are none, with the value in capitals; in one scan."""
    rows = df.where(F.col(column).isin(value, value.upper()))
    exact = rows.agg(F.coalesce(F.bool_or(F.col(column) == value), F.lit(False)).alias("exact"))  # a single row
    return rows.crossJoin(F.broadcast(exact)).where(~F.col("exact") | (F.col(column) == value)).drop("exact")


def visible(items: DataFrame, flags: DataFrame, stages: DataFrame, *, master: bool, item: str = "id", stage: str = "stage") -> DataFrame:
    """Items to show: none unless the master switch is on; an item or its stage is hidden only by an explicit false, and one
    without a stage by its own flag only. flags (id, shown) and stages (stage, shown) have a row for each key at most."""
    rows = items.join(flags.select(F.col("id").alias(item), F.col("shown").alias("__own")), item, "left")
    rows = rows.join(stages.select(F.col("stage").alias(stage), F.col("shown").alias("__stage")), stage, "left")
    on = F.coalesce("__own", F.lit(True)) & (F.col(stage).isNull() | F.coalesce("__stage", F.lit(True)))
    return rows.where(F.lit(master) & on).select(*items.columns)


def parted(df: DataFrame, state: str, kept: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose state is in a set, and all others (a null state too)."""
    known = F.coalesce(F.col(state).isin(*kept), F.lit(False))
    return df.where(known), df.where(~known)


def options(df: DataFrame, column: str, defaults: Sequence[str]) -> DataFrame:
    """(value): the distinct values that aren't empty, or the defaults where there are none."""
    found = df.select(F.col(column).alias("value")).where(F.coalesce(F.col(column), F.lit("")) != "").distinct()
    spare = df.sparkSession.createDataFrame([(d,) for d in defaults], "value string")
    none = found.limit(1).agg((F.count("*") == 0).alias("none"))
    return found.union(spare.crossJoin(F.broadcast(none)).where("none").select("value"))


def add_option(values: Column, raw: Column) -> Column:
    """A list with a trimmed lower-case value added and sorted, unless it's empty or there already, whatever its case."""
    new = F.lower(F.trim(raw))
    known = F.exists(values, lambda v: F.lower(v) == new)
    return F.when((new == "") | known, values).otherwise(F.array_sort(F.concat(values, F.array(new))))


def assigned(initial: DataFrame, draft: DataFrame, key: str, value: str) -> DataFrame:
    """Assignments of both tables; the draft's win."""
    new = draft.select(key, F.col(value).alias("__new"))
    return initial.join(new, key, "full_outer").select(key, F.coalesce("__new", value).alias(value))


def compared(current: DataFrame, baseline: DataFrame, meta: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows of the current table that the baseline has too, with both values and their difference, and what is known of
    the key; the greatest changes of the first value first."""
    base = baseline.select(key, *(F.col(v).alias(f"baseline_{v}") for v in values))
    rows = current.join(base, key).join(meta, key, "left")
    for v in values:
        rows = rows.withColumn(f"delta_{v}", F.col(v) - F.col(f"baseline_{v}"))
    return rows.orderBy(F.desc(F.abs(F.col(f"delta_{values[0]}"))), key)


def search(df: DataFrame, text: str | None, *columns: str) -> DataFrame:
    """Rows in which one of the columns holds the text, whatever its case."""
    if not text:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return df.where(hit)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """A page of rows in an order that should end in a unique key. Only the rows up to the page's end are kept by a task."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def at_least(df: DataFrame, level: Column, levels: Sequence[str], lowest: str) -> DataFrame:
    """Rows whose level is `lowest` or above in an ordered list."""
    return df.where(level.isin(*levels[list(levels).index(lowest) :]))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the greatest order. A grouped maximum: combined before the shuffle, whatever the
    key's share of the rows. Null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def latest_with_ties(df: DataFrame, key: str, at: str) -> DataFrame:
    """All rows of a key's latest moment."""
    latest = df.groupBy(key).agg(F.max(at).alias(at))
    return df.join(latest, [key, at], "left_semi")


def top_per_group(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group, with their rank; Spark cuts each task's groups to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def membership(df: DataFrame, key: str, sets: Mapping[str, DataFrame], default: str, name: str = "status") -> DataFrame:
    """The first of the named key sets that holds a row's key, else the default."""
    status = F.lit(default)
    for label, keys in reversed(sets.items()):
        flag = f"in_{label}"
        distinct = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        df = df.join(distinct, key, "left")
        status = F.when(F.col(flag), label).otherwise(status)
    return df.withColumn(name, status).drop(*(f"in_{label}" for label in sets))


def with_all_keys(counts: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """A row for each key of a fixed list, zeros where the counts have none; other keys are left out."""
    spine = counts.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    numbers = [c for c in counts.columns if c != key]
    return F.broadcast(spine).join(counts, key, "left").select(key, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers))


def full_outer_zero(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' numbers by key, 0 where a side has none."""
    both = left.join(right, key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in both.columns if c != key))


def priorities(scores: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """(node_id, composite_score, missing_factors) from named tables (id, score): each factor is scaled between the least
    and the greatest of its own scores (0 where all are equal), and the weights of the factors a node has share the
    whole. A factor without a score for a node is missing, not zero. Ids are text, of which only digits name a node."""
    rows = None
    for name, df in scores.items():
        one = df.where("score is not null").select(F.lit(name).alias("factor"), F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.union(one)
    bounds = rows.groupBy("factor").agg(F.min("score").alias("low"), F.max("score").alias("high"))  # a row for each factor
    share = F.when(F.col("high") > F.col("low"), F.round((F.col("score") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), 4)).otherwise(F.lit(0.0))
    weight = F.create_map([F.lit(x) for pair in weights.items() for x in pair])[F.col("factor")]
    known = rows.where(F.col("id").rlike(r"^\d+$")).join(F.broadcast(bounds), "factor").select(F.col("id").cast("long").alias("node_id"), "factor", (share * weight).alias("part"), weight.alias("weight"))
    names = F.array(*map(F.lit, weights))
    return known.groupBy("node_id").agg(
        F.round(F.sum("part") / F.sum("weight") + 1e-9, 4).alias("composite_score"), F.array_except(names, F.collect_set("factor")).alias("missing_factors")
    )


def upsert(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Base rows with the patch's values where it has any (null: not given), and the patch's new rows."""
    names = [c for c in base.columns if c != key]
    given = patch.select(key, *(F.col(c).alias(f"new_{c}") for c in names if c in patch.columns))
    both = base.join(given, key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in patch.columns else F.col(c) for c in names))


def versions(df: DataFrame, group: str, order: Sequence[str], step: Column) -> DataFrame:
    """Version numbers in a group, and whether a version is the active one, the last. step is a coarse value that never
    falls along the order, such as the month of a date: rows are numbered within a step of their group, and the steps'
    counts are summed up, so that a group with a third of all rows is dealt to many tasks."""
    rows = df.withColumn("__step", step)
    counts = rows.groupBy(group, "__step").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(w.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("__group"), F.col("__step").alias("__of"), before.alias("__before"), F.sum("n").over(w).alias("__all"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(group, "__step").orderBy(*order)))
    out = numbered.join(counts, numbered[group].eqNullSafe(counts["__group"]) & numbered["__step"].eqNullSafe(counts["__of"]))
    version = (F.col("__k") + F.col("__before")).cast("int")
    return out.select(*df.columns, version.alias("version"), (version == F.col("__all")).alias("is_active"))


def reject_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The first rule that a row breaks as its error; null for a good row."""
    error = F.lit(None).cast("string")
    for reason, broken in reversed(rules.items()):
        error = F.when(broken, reason).otherwise(error)
    return df.withColumn("error", error)


def history_map(df: DataFrame, key: str, year: Column, value: Column, order: str) -> DataFrame:
    """key -> {year: value}: the last of a year wins; null keys, years and values are skipped."""
    rows = df.select(F.col(key), year.cast("string").alias("year"), value.alias("value"), F.col(order).alias("order")).dropna()
    one = rows.groupBy(key, "year").agg(F.max_by("value", "order").alias("value"))
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "value")))).alias("history"))


def visible_to(rows: DataFrame, profiles: DataFrame, viewer: int, owner: Column, roles: Sequence[str], user: str = "user_id", role: str = "role") -> DataFrame:
    """Row security: the rows that a viewer may see are all if a profile (user, role) of the viewer with one of the roles exists,
    else those of which the viewer is the owner."""
    exists = profiles.agg(F.coalesce(F.max((F.col(user) == viewer) & F.col(role).isin(*roles)), F.lit(False)).alias("sees_all"))  # a single row
    return rows.crossJoin(F.broadcast(exists)).where(F.col("sees_all") | (owner == viewer)).drop("sees_all")


def public_subset(rows: DataFrame, kind: Column, allowed: Sequence[str], asked: str | None = None) -> DataFrame:
    """Rows of the kinds that may be public; of one kind, if asked for, and of none if that one may not."""
    kinds = list(allowed) if asked is None else [k for k in allowed if k == asked]
    return rows.where(kind.isin(*kinds)) if kinds else rows.where(F.lit(False))
