"""A Merkle manifest of a dataset: a hash tree for each group, a tree of the groups' roots, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.llm._shared import release, stash

#: Children of a node.
WIDTH = 16
#: A block nests so many levels below its top, at most WIDTH ** LEVELS leaves; its top is a leaf of the next tier's blocks.
LEVELS = 3
_STEPS = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _ranked(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Adds n, the size of a row's group, and rank, its place there from 0, by dealing out sorted ranges: no task needs a
    whole group. Also returns the table that the ranks are read from."""
    dealt = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = stash(dealt.withColumn("place", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("range", F.shiftright("place", 33))
    counts = dealt.groupBy(group, "range").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    every = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("its"), F.col("range").alias("at"), (before - F.col("first")).alias("shift"), F.sum("rows").over(every).alias("n"))
    ranked = dealt.join(counts, F.col(group).eqNullSafe(F.col("its")) & (F.col("range") == F.col("at")))
    return ranked.withColumn("rank", F.col("place") + F.col("shift")).drop("its", "at", "shift", "place", "range"), dealt


def _blocks(nodes: DataFrame, group: str, content: list[str]) -> DataFrame:
    """Rolls nodes (group, rank, n, hash, content) up into blocks (group, block, n, hash, tree); n is the number of a
    group's nodes. The rank's digits are grouped away from the last one on, so that a struct nests its children; one
    shuffle by block serves all levels. Where one node is left the group's tree ends, and higher levels only wrap it."""
    keys = [f"d{level}" for level in range(LEVELS)]
    rows = nodes.withColumn("block", F.expr(f"rank div {WIDTH**LEVELS}"))
    for level, key in enumerate(keys):
        rows = rows.withColumn(key, F.expr(f"rank div {WIDTH**level} % {WIDTH}").cast("int"))
    rows = rows.select(group, "block", "n", *keys, F.struct("hash", *content).alias("node")).repartition(group, "block")
    for level in range(LEVELS):
        rest = keys[level + 1 :]
        rows = rows.groupBy(group, "block", "n", *rest).agg(F.array_sort(F.collect_list(F.struct(keys[level], "node"))).alias("sorted"))
        nested = rows.withColumn("children", F.col("sorted.node"))
        several = F.col("n") > WIDTH**level  # whether the level below has more than one node
        top = F.when(several, F.sha2(_joined(F.col("children.hash")), 256)).otherwise(F.col("children")[0]["hash"])
        rows = nested.select(group, "block", "n", *rest, F.struct(top.alias("hash"), several.alias("real"), "children").alias("node"))
    return rows.select(group, "block", "n", F.col("node.hash").alias("hash"), F.col("node").alias("tree"))


def _beside(child: Column, i: Column) -> Column:
    hashes = F.col("node.children.hash")
    left, right = _joined(F.slice(hashes, F.lit(1), i)), _joined(F.slice(hashes, i + 2, F.lit(WIDTH)))
    return F.struct(child.alias("child"), i.alias("i"), left.alias("left"), right.alias("right"))


def _unrolled(blocks: DataFrame, carried: list[str], content: list[str]) -> DataFrame:
    """From (carried, tree, steps, base) to a row for each leaf of a block: (carried, hash, content, steps, rank), the
    steps of its proof from itself to the top. Each level turns a node's children into structs with what stands left and
    right of them and explodes those; a node that only wraps adds no step."""
    rows = blocks.withColumns({"node": F.col("tree"), "rank": F.col("base")})
    for level in reversed(range(LEVELS)):
        rows = rows.select(*carried, "steps", "rank", F.col("node.real").alias("real"), F.explode(F.transform("node.children", _beside)).alias("x"))
        step = F.array(F.struct(F.col("x.left").alias("left"), F.col("x.right").alias("right")))
        steps = F.when(F.col("real"), F.concat(step, "steps")).otherwise(F.col("steps"))
        rows = rows.select(*carried, F.col("x.child").alias("node"), steps.alias("steps"), (F.col("rank") + F.col("x.i") * F.lit(WIDTH**level)).alias("rank"))
    return rows.select(*carried, F.col("node.hash").alias("hash"), *(F.col(f"node.{c}").alias(c) for c in content), "steps", "rank")


def _handed(trees: DataFrame, paths: DataFrame, keys: list[str], path: list[str]) -> DataFrame:
    """Gives each block the path above its top by grouping both under its keys: one tree and one path each."""
    none = lambda df, names, types: df.select(*keys, *(F.lit(None).cast(types[c]).alias(c) if c not in df.columns else F.col(c) for c in names))
    types = {f.name: f.dataType for df in (trees, paths) for f in df.schema.fields}
    names = [c for c in trees.columns if c not in keys] + path
    both = none(trees, names, types).unionByName(none(paths.select(*keys, *path), names, types))
    return both.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in names))


class _Tree:
    """The blocks of all tiers over ranked leaves, written in the shared folder."""

    def __init__(self, leaves: DataFrame, group: str, order: list[str], content: list[str]) -> None:
        self.group, self.content = group, content
        nodes, ranges = _ranked(leaves, group, order)
        self.tiers = [stash(_blocks(nodes, group, content), "tier")]
        release(ranges)
        while not self.tiers[-1].where("block > 0").isEmpty():
            last = self.tiers[-1]
            tops = last.withColumn("n", F.ceil(F.col("n") / F.lit(WIDTH**LEVELS)).cast("long")).withColumnRenamed("block", "rank")
            self.tiers.append(stash(_blocks(tops.select(group, "rank", "n", "hash"), group, []), "tier"))

    def roots(self) -> DataFrame:
        return self.tiers[-1].select(self.group, "hash")

    def proofs(self, above: DataFrame, carried: list[str]) -> DataFrame:
        """Every leaf with the steps to its group's root and then those that `above` (group, steps, carried) has."""
        keys, known = [self.group, "block"], above.withColumn("block", F.lit(0).cast("long"))
        for number in reversed(range(len(self.tiers))):
            content = self.content if not number else []
            trees = self.tiers[number].select(*keys, "tree")
            rows = _handed(trees, known, keys, [*carried, "steps"]).withColumn("base", F.col("block") * F.lit(WIDTH**LEVELS))
            known = _unrolled(rows, [self.group, *carried], content).withColumn("block", F.col("rank"))
        return known.drop("block", "rank")


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """A row for each row of docs: (id, leaf, claimed, subroot, root, proof).

    leaf is the SHA-256 (lowercase hex, as all hashes) of the columns, each `-` or its UTF-8 byte count, a colon and its value.
    A group's leaves, by id and then leaf, nulls first, are hashed in runs of WIDTH until one node is left, the group's
    subroot; the subroots by group, null first, are hashed alike into the root. proof has a step for each run from leaf to root: the
    hashes before it in its run, joined, and those after it. claimed is the leaf of the columns as `tampered` (new values by name) has
    them, to be checked against the root.

    Rows are ranked by dealing out sorted ranges; blocks nest WIDTH ** LEVELS leaves (some 600 kB), and the tops of
    blocks are leaves of the next tier's, so that neither a group nor a tree has to fit into one task. Proofs are unrolled
    from the top tier down. Blocks get the path above them, and rows their offset within a group, by a shuffle.

    Nulls: they are `-` in a leaf; a null group is a group, and comes first; null ids come first. Repeated rows are leaves each.
    Other columns are ignored. An empty table gives an empty result.
    """
    given = {c: F.col(c) for c in columns}
    changed = leaf_hash(*((tampered or {}).get(c, given[c]) for c in columns)) if tampered else F.lit(None).cast("string")
    leaf = leaf_hash(*given.values())
    leaves = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf.alias("hash"), F.coalesce(changed, leaf).alias("claimed"))
    leaves = stash(leaves, "leaves")
    rows = _Tree(leaves, "group", ["id", "hash"], ["id", "claimed"])
    release(leaves)
    groups = _Tree(rows.roots().select(F.lit(0).alias("all"), "group", "hash"), "all", ["group"], ["group"])
    top = groups.roots().select("all", F.col("hash").alias("root"), F.array().cast(_STEPS).alias("steps"))
    subroots = groups.proofs(top, ["root"]).select("group", F.col("hash").alias("subroot"), "root", "steps")
    proofs = rows.proofs(subroots, ["subroot", "root"])
    return proofs.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "claimed", "subroot", "root", F.col("steps").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """The SHA-256 of all siblings of a proof, joined."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
