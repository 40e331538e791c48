"""Connected components of a link table, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._shared import release, stash


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component) for each id in a link; component is the smallest id that can be reached.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until every id points straight at its
    smallest one. Each step is a grouped minimum, which Spark combines before its shuffle, and a join on a plain key,
    which adaptive execution splits where a key is hot. Each round is written to the shared folder.
    Null ends and self links are ignored; an empty table gives an empty result.
    """
    clean = links.where("a is not null and b is not null and a <> b")
    edges = stash(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Done when no parent has a parent and no child has two.
        up = edges.select(F.col("v").alias("u"), F.lit(1).alias("above")).distinct()
        state = edges.groupBy("u").agg(F.count("*").alias("n")).join(up, "u", "left").where("n > 1 or above = 1")
        if state.isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(edges)
        edges = step
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
