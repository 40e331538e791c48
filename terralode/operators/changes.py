"""Changes of tables as rewrites: what a database does in place, a new table does here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_where(base: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """What stays (a null predicate too), and (deleted) as one row."""
    hit = F.coalesce(predicate, F.lit(False))
    return base.where(~hit), base.agg(F.count_if(hit).alias("deleted"))


def replace_groups(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deletes the groups that new has rows for, then adds these."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def add_missing(base: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Defaults whose key isn't there yet."""
    return base.unionByName(defaults.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def cascade(children: DataFrame, deleted: DataFrame, foreign: str, *, set_null: bool = False) -> DataFrame:
    """Children of deleted parents go, or lose their reference."""
    gone = deleted.select(F.col(deleted.columns[0]).alias(foreign)).distinct()
    if not set_null:
        return children.join(gone, foreign, "left_anti")
    marked = children.join(gone.withColumn("gone", F.lit(True)), foreign, "left")
    return marked.withColumn(foreign, F.when(F.col("gone").isNull(), F.col(foreign))).drop("gone").select(*children.columns)


def remap(base: DataFrame, column: str, values: Mapping[str, str]) -> DataFrame:
    new = F.col(column)
    for old, to in values.items():
        new = F.when(F.col(column) == old, to).otherwise(new)
    return base.withColumn(column, new)


def reorder(base: DataFrame, key: str, ids: Sequence, column: str = "orden") -> DataFrame:
    """Rows named in the list get their place in it."""
    places = base.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {base.schema[key].dataType.simpleString()}, place int")
    return base.join(F.broadcast(places), key, "left").withColumn(column, F.coalesce("place", column)).drop("place")


def activate(base: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """New rows become the active version of their group: the next number (1 in a new group); others are inactive."""
    top = base.groupBy(group).agg(F.max("version").alias("top"))
    fresh = new.join(top, group, "left").withColumn("version", F.coalesce("top", F.lit(0)) + 1).withColumn("is_active", F.lit(True)).drop("top")
    touched = new.select(group).distinct().withColumn("touched", F.lit(True))
    old = base.join(touched, group, "left").withColumn("is_active", F.col("is_active") & F.col("touched").isNull()).drop("touched")
    return old.unionByName(fresh)


def append_once(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet, each key once."""
    return base.unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti"))


def replace_all(base: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows instead of all old ones; ValueError if there are none, so that an empty upload deletes nothing."""
    if new.isEmpty():
        raise ValueError("nothing to replace the table with")
    return new.select(*base.columns)


def flip(base: DataFrame, flag: str, asked: str, errors: Mapping[bool, str]) -> DataFrame:
    """Sets a flag as asked (null: not asked), with a conflict where it stood so already."""
    same = F.col(asked) == F.col(flag)
    conflict = F.when(same & F.col(asked), errors[True]).when(same & ~F.col(asked), errors[False])
    return base.withColumn("conflict", conflict).withColumn(flag, F.coalesce(asked, flag))


def broken(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row with the numbers of rows that break each check; a null counts as broken."""
    return df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))


def require(df: DataFrame, checks: Mapping[str, Column]) -> None:
    """Raises ValueError with the numbers of rows that break the checks; one pass over the table."""
    counts = broken(df, checks).first()
    if found := {name: counts[name] for name in checks if counts[name]}:
        raise ValueError(f"rows break checks: {found}")


def require_rows(layers: Mapping[str, DataFrame]) -> None:
    """All or nothing: raises ValueError if a required layer is empty, before anything is written."""
    if empty := [name for name, df in layers.items() if df.isEmpty()]:
        raise ValueError(f"required layers are empty: {empty}")
