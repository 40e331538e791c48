"""Choices along an order: labels that fit on a screen, training that stops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def visible(labels: DataFrame, screen: str, apart: float, keep) -> DataFrame:
    """(screen, id): labels (screen, id, kind, value, x, y; unique ids in a screen) that are shown: areas before others, then by
    falling value and rising id, each unless one that is shown stands nearer than `apart`. Rows with a null are left out.

    The choice of one after the other, in rounds: tiles are `apart` wide, and a label that comes first of all undecided ones in
    its own tile and the eight around it can lose to none, so it is shown, and those near it go. A tile sends on only its
    first label, and holds few that are shown, so that a round is linear however many labels lie on one spot. Rounds are as many as
    labels wait for one another in a row; each is cut off by keep.
    """
    tile = lambda c: F.floor(F.col(c) / apart).cast("long")
    rows = labels.select(F.col(screen).cast("long").alias("screen"), F.col("id").cast("long").alias("id"), "kind", "value", "x", "y").dropna()
    rank = F.struct((F.col("kind") != "area").alias("other"), (-F.col("value")).alias("less"), "id")
    left = keep(rows.select("screen", "id", "x", "y", rank.alias("rank"), tile("x").alias("tx"), tile("y").alias("ty")))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = lambda df, *names: df.withColumn("n", F.explode(around)).select("screen", (F.col("tx") + F.col("n.i")).alias("tx"), (F.col("ty") + F.col("n.j")).alias("ty"), *names)
    shown = []
    while not left.isEmpty():
        firsts = left.groupBy("screen", "tx", "ty").agg(F.min(F.struct("rank", "x", "y")).alias("first"))
        least = spread(firsts, F.col("first.rank").alias("rank")).groupBy("screen", "tx", "ty").agg(F.min("rank").alias("least"))
        won = firsts.join(least, ["screen", "tx", "ty"]).where(F.col("first.rank") == F.col("least"))
        won = keep(won.select("screen", "tx", "ty", F.col("first.rank.id").alias("id"), F.col("first.x").alias("wx"), F.col("first.y").alias("wy")))
        shown.append(won.select("screen", "id"))
        near = left.join(spread(won, "wx", "wy"), ["screen", "tx", "ty"]).where(F.pow(F.col("x") - F.col("wx"), 2) + F.pow(F.col("y") - F.col("wy"), 2) < apart * apart)
        gone = near.select("screen", "id").union(won.select("screen", "id")).distinct()
        left = keep(left.join(gone, ["screen", "id"], "left_anti"))
    if not shown:
        return rows.select(F.col("screen").alias(screen), "id")
    return reduce(DataFrame.union, shown).withColumnRenamed("screen", screen)


def early_stop(rows: DataFrame, group: str, order: Sequence[str], loss: str, patience: int) -> DataFrame:
    """(group, stopped_at, early, best_epoch): epochs count from 1 along the order; training stops at the first epoch that
    is `patience` after the last better loss, or else at the last. Runs of one model are short."""
    w = Window.partitionBy(group).orderBy(*order)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.select(group, F.row_number().over(w).alias("epoch"), (best.isNull() | (F.col(loss) < best)).alias("better"))
    waited = F.col("epoch") - F.max(F.when(F.col("better"), F.col("epoch"))).over(Window.partitionBy(group).orderBy("epoch"))
    steps = steps.withColumn("waited", waited)
    ends = steps.groupBy(group).agg(F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop"), F.max("epoch").alias("last"))
    until = steps.join(ends, group).where(F.col("epoch") <= F.coalesce("stop", "last"))
    return until.groupBy(group).agg(
        F.max(F.coalesce("stop", "last")).alias("stopped_at"), F.max(F.col("stop").isNotNull()).alias("early"), F.max(F.when(F.col("better"), F.col("epoch"))).alias("best_epoch")
    )
