"""Near-duplicate documents: a chosen-path set similarity join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._hashing import Powers, U, hashed, mix, rolled
from terralode.llm._shared import binary, only_ids, release, small_batches, stash
from terralode.llm.components import connected_components

#: Minwise tokens of a document from which paths are chosen.
TOKENS = 128
#: Independent trees. A pair at a similarity of 0.85 meets in one tree with probability 0.85 after one branching and
#: about 0.54 after five, so in one of twelve with 1 - 1e-10 and 1 - 1e-4.
TREES = 12
#: Nodes of at most so many documents are compared exhaustively.
SMALL = 40
#: Branchings below the first after which a large node isn't branched any more but compared exhaustively in blocks, whose
#: sides have about so many bytes of texts each; so many branchings are taken at once. Near copies share most tokens, so
#: that each level holds them anew.
DEPTH, STRIDE, SIDE_BYTES = 4, 2, 4 << 20
#: Of the 64 one-bit tokens of a pair at 0.85, 4.8 differ on average, with a standard deviation of 2.1.
BITS_APART = 20

_MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
#: Deviations below the mean at which the tokens two documents share rule a link out (1e-5 of the links at the threshold).
SURE = 4.2

_MEMBER = "node long, id long, bits long"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: bytes | None, k: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of k words, with A-Z lower-cased; of a shorter text, all words as one run; of no words, nothing."""
    words = (text or b"").translate(_LOWER).split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, texts = batch.column(0), [t and t.translate(_LOWER) for t in batch.column(1).to_pylist()]
            sizes, digests, tokens = np.zeros(len(texts), np.int64), [None] * len(texts), [None] * len(texts)
            orders = [blake2b(b" ".join((t or b"").split()), digest_size=32).digest() for t in texts]
            lengths = [len(t or b"") for t in texts]
            for first, words, edges in hashed(texts, powers):
                runs = rolled(words, k)
                for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True), first):
                    if e - s >= k:
                        kinds = np.unique(runs[s : e - k + 1])
                    elif e > s:
                        kinds = rolled(words[s:e], e - s) + U(e - s)
                    else:
                        continue
                    sizes[i] = len(kinds)
                    digests[i] = blake2b(kinds.tobytes(), digest_size=16).digest()
                    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(kinds), 8192):
                        part = (kinds[at : at + 8192, None] * _MULTIPLY) >> U(32)
                        np.minimum(low, part.min(axis=0).astype(np.uint32), out=low)
                    tokens[i] = low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes), pa.array(lengths, pa.int64()), pa.array(orders, pa.binary()), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())],
                names=["id", "n_shingles", "n_bytes", "sequence", "digest", "tokens"],
            )

    return run


def _one_bits(tokens: np.ndarray) -> np.ndarray:
    """One bit of each of 64 tokens, as an integer."""
    bits = (mix(tokens[:, :64].astype(U)) & U(1)).astype(U)
    return (bits << np.arange(64, dtype=U)).sum(axis=1, dtype=U).view(np.int64)


def _branch(root: bool, second: float, steps: int = 1):
    """Sends each document, given once with all its nodes, to the children of each node for the tokens that the node chooses:
    one or two, as the node's own hash says; after several steps, to theirs. The choice hangs on the path alone, so that all
    documents of a node choose alike."""

    def children(node: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        choice = mix(node ^ U(0x632BE59BD9B4E019))
        one, step = (choice % U(TOKENS)).astype(np.int64), ((choice >> U(8)) % U(TOKENS - 1)).astype(np.int64) + 1
        for where, which in ((np.arange(len(node)), one), (np.flatnonzero((choice >> U(40)) < U(int(second * (1 << 24)))), (one + step) % TOKENS)):
            at = which[where]
            yield where, mix(node[where] * U(31) + mix(tokens[row[where], at].astype(U) + at.astype(U) * U(0x1000003D1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids, raw = batch.columns
            tokens = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, TOKENS)
            bits, ids = _one_bits(tokens), ids.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), nodes.value_lengths().to_numpy(zero_copy_only=False))
            starts = [mix(np.full(len(row), t + 1, U)) for t in range(TREES)] if root else [nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)]
            for node in starts:
                own = row
                for _ in range(steps):
                    where, below = zip(*children(node, own, tokens), strict=True)
                    own, node = own[np.concatenate(where)], np.concatenate(below)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[own]), pa.array(bits[own])], names=["node", "id", "bits"])

    return run


def _pairs_in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of each small node that lie in different components and whose one-bit tokens agree enough."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            ids, parts, bits = (np.array([m[x] for m in members], np.int64) for x in ("id", "part", "bits"))
            near = (np.bitwise_count(bits[:, None] ^ bits) <= BITS_APART) & (parts[:, None] != parts)
            i, j = np.nonzero(np.triu(near, 1))
            a += ids[i].tolist()
            b += ids[j].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _blocks(members: DataFrame, whole: DataFrame, keep) -> DataFrame:
    """Large nodes in blocks of bounded size, so that all their pairs across components are looked at by many tasks:
    (node, some, all_) with lists of members. Nearly all members of a node may be one component by now: those of its largest
    component aren't set against each other, but only against blocks of the rest. Members (node, id, part) are dealt out by
    the length of their texts alone; whole (id, tokens, text, nodes), which has each document once, is joined last.
    keep writes a table away and reads it back."""
    members = keep(members.join(whole.select("id", (F.length("text") + TOKENS * 4 + F.size("nodes") * 8).alias("n_bytes")), "id"), "leftover")
    per_part = members.groupBy("node", "part").agg(F.sum("n_bytes").alias("n"))
    per_node = keep(per_part.groupBy("node").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("total")), "nodes")
    known = members.join(per_node, "node").withColumn("other", F.col("part") != F.col("main.part"))
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    some, chunks = (F.greatest(F.ceil(n / SIDE_BYTES), F.lit(1)) for n in (F.col("total") - F.col("main.n"), F.col("total")))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n.cast("int") - 1), f)
    place = lambda block, chunk, one: F.struct(block.alias("block"), chunk.alias("chunk"), F.lit(one).alias("one"))
    left, right = each(chunks, lambda c: place(deal(some), c, True)), each(some, lambda b: place(b, deal(chunks), False))
    dealt = known.select("node", F.explode(F.when(F.col("other"), F.concat(left, right)).otherwise(right)).alias("at"), "id", "part", "other")
    met, member = dealt.select("node", "at.*", "id", "part", "other").join(whole, "id"), F.struct("id", "part", "other", "tokens", "text", "nodes")
    sides = (F.collect_list(F.when(side, member)).alias(name) for side, name in ((F.col("one"), "some"), (~F.col("one"), "all_")))
    return met.groupBy("node", "block", "chunk").agg(*sides).select("node", "some", "all_")


def _links_between(k: int, num: int, den: int):
    """Links of a block with a chunk of one node across components, as many as join components. Tokens sieve the pairs,
    hashes of all shingles decide. Near copies meet in nodes of all trees: each pair is decided in one of the nodes that its
    documents share, which their ids choose."""
    share = num / den + (1 - num / den) / 256
    least = share * TOKENS - SURE * (TOKENS * share * (1 - share)) ** 0.5

    def found(node: int, x: list[dict], y: list[dict], powers: Powers) -> Iterator[tuple[int, int]]:
        (p, _, s), (q, other, t) = ((np.array([m["part"] for m in z]), np.array([m["other"] for m in z]), np.frombuffer(b"".join(m["tokens"] for m in z), np.uint32).reshape(-1, TOKENS).astype(np.uint8)) for z in (x, y))
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def kinds(m: dict) -> np.ndarray:
            if m["id"] not in sets:
                words = next(hashed([m["text"].translate(_LOWER)], powers))[1]
                sets[m["id"]] = np.unique(rolled(words, k)) if len(words) >= k else rolled(words, len(words))
            return sets[m["id"]]

        def top(part: int) -> int:
            while part in root:
                part = root[part]
            return part

        for a, one in enumerate(x):
            able, own = ((t == s[a]).sum(axis=1) >= least) & (q != p[a]), set(one["nodes"])
            for b in np.flatnonzero(able).tolist():
                two = y[b]
                if other[b] and one["id"] > two["id"]:
                    continue
                shared = [n for n in two["nodes"] if n in own]
                if shared[(one["id"] + two["id"]) % len(shared)] == node and (u := top(one["part"])) != (v := top(two["part"])):
                    left, right = kinds(one), kinds(two)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if den * both >= num * (len(left) + len(right) - both):
                        root[max(u, v)] = min(u, v)
                        yield one["id"], two["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for node, some, all_ in zip(*batch.columns, strict=True):
                pairs = list(found(node.as_py(), some.as_py(), all_.as_py(), powers))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _confirmed(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, set()
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if y != last:
                    last, right = y, shingle_set(y, k)
                left = shingle_set(x, k)
                both = len(left & right)
                if both and den * both >= num * (len(left) + len(right) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int32()))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)
) -> DataFrame:
    """Groups documents that are linked by a Jaccard similarity of at least similarity (numerator, denominator) of
    their sets of word shingles. Returns (id, n_shingles, component_id, kept) under the name of id_col.

    Equal sequences of words are one class, found by a 256-bit cryptographic digest of all of them; only one document of a
    class goes further. Where digests of sets agree between classes, the sets are compared in full. Each takes a path
    in each of twelve trees: a node chooses one or two of the 128 minwise tokens (1 / similarity on average, so that a
    pair at the threshold keeps meeting) and its documents part by the values of these. Every node compares its members with
    one hub, the member with the most company. Nodes larger than SMALL that still hold several components branch again; those
    that hold one don't, so that a large group of near copies isn't carried down all trees; two branchings are taken at once. Then small nodes that
    still hold several components are compared exhaustively, across components, and so are large ones that DEPTH
    branchings didn't part, in blocks over many tasks, so that no candidate is ever capped. One-bit tokens sieve the candidates;
    every link is confirmed on the full sets. Work is linear in a group of copies: members that a confirmed link has
    joined aren't paired again.

    Nulls: a null text or one without words has an empty set and links with nothing; a row with a null id is returned
    with a null component_id and kept. Rows that repeat an id count as one document, whose links are those of any of them.
    Other columns are ignored and may have any names. An empty table gives an empty result.
    """
    num, den = similarity
    base = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), binary(text_col).alias("text"))
    sketched = stash(base.mapInArrow(_sketches(shingle), "id long, n_shingles long, n_bytes long, sequence binary, digest binary, tokens binary"), "sketches")
    named = sketched.where("id is not null and n_shingles > 0")
    one = [F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("digest", "tokens"))]
    classes = stash(named.groupBy("sequence").agg(F.min("id").alias("id"), *one), "classes")
    slim = stash(sketched.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sequence")).alias("sequence")), "sizes")
    release(sketched)
    texts = base.where("id is not null")
    second = den / num - 1
    passing: list[DataFrame] = []  # tables that the result doesn't read

    def brief(df: DataFrame, name: str) -> DataFrame:
        passing.append(stash(df, name))
        return passing[-1]

    def confirm(pairs: DataFrame) -> DataFrame | None:
        """pairs(a, b) that are links; b is the side whose set is kept while it repeats."""
        pairs = stash(pairs.distinct(), "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = stash(only_ids(texts, ids, "id"), "texts")
        sides = [wanted.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
        out = brief(both.mapInArrow(_confirmed(shingle, num, den), "a long, b long"), "links")
        release(pairs, wanted)
        return None if out.isEmpty() else out

    def merge(parts: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
        """Components (id, part) after more links."""
        if links is None:
            return parts
        if parts is not None:
            links = links.union(parts.where("id <> part").select(F.col("id").alias("a"), F.col("part").alias("b")))
        components = connected_components(links)
        out = stash(components.withColumnRenamed("component", "part"), "parts")
        release(components, *([parts] if parts is not None else []))
        return out

    def unsettled(live: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Members of nodes that hold several components, with their component as part."""
        if parts is None:
            return live.withColumn("part", F.col("id"))
        # Grouped tables are written before they are joined, so that adaptive execution can split hot nodes.
        known = brief(live.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "known")
        per_node = known.groupBy("node").agg(F.min("part").alias("p"), F.max("part").alias("q"))
        return known.join(brief(per_node.where("p < q").select("node"), "nodes"), "node")

    def stars(live: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The hub of each node, the member with the most company, and the other members that may be linked with it."""
        company = brief(live.groupBy("id").agg(F.sum("size").alias("company")), "company")
        ranked = live.join(company, "id").groupBy("node").agg(F.max(F.struct("company", F.negative("id").alias("order"), "bits")).alias("hub"))
        hubs = brief(ranked.select("node", (-F.col("hub.order")).alias("b"), F.col("hub.bits").alias("hub_bits")), "hubs")
        apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("hub_bits")))
        return hubs, live.join(hubs, "node").where((F.col("id") != F.col("b")) & (apart <= BITS_APART)).select(F.col("id").alias("a"), "b")

    alike = classes.groupBy("digest").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    alike = classes.join(brief(alike.select("digest", "b"), "alike"), "digest").where("id <> b").select(F.col("id").alias("a"), "b")
    members = classes.select(F.array(F.lit(0).cast("long")).alias("nodes"), "id", "tokens").mapInArrow(_branch(True, second), _MEMBER)
    levels: list[DataFrame] = []
    parts: DataFrame | None = None
    while True:
        members = stash(members, "members")
        sizes = stash(members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        levels.append(stash(members.join(sizes, "node"), "live"))
        release(members, sizes)
        if len(levels) == 1:
            parts = merge(None, confirm(stars(levels[0])[1].union(alike)))
        large = levels[-1].where(F.col("size") > SMALL)
        if len(levels) > DEPTH // STRIDE or large.isEmpty():
            break
        # Tokens are joined once for a document, not for each of its nodes, of which there are 12 * 2 ** DEPTH at most.
        carried = brief(unsettled(large, parts).groupBy("id").agg(F.collect_list("node").alias("nodes")), "carried")
        members = carried.join(classes.select("id", "tokens"), "id").select("nodes", "id", "tokens").mapInArrow(_branch(False, second, STRIDE), _MEMBER)
    if len(levels) > 1:
        below = brief(unsettled(reduce(DataFrame.union, levels[1:]), parts), "below")
        parts = merge(parts, confirm(stars(below)[1]))

    leaves = reduce(DataFrame.union, [*(x.where(F.col("size") <= SMALL) for x in levels), large])
    rest = brief(unsettled(leaves, parts).select("node", "id", "bits", "size", "part"), "rest")
    small = rest.where(F.col("size") <= SMALL).groupBy("node").agg(F.collect_list(F.struct("id", "part", "bits")).alias("members")).select("members")
    links = small.mapInArrow(_pairs_in_small, "a long, b long")
    left_over = rest.where(F.col("size") > SMALL).select("node", "id", "part")
    if not left_over.isEmpty():
        nodes = brief(left_over.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "shared")
        wanted = only_ids(texts, nodes.select("id"), "id").dropDuplicates(["id"])
        whole = brief(wanted.join(classes.select("id", "tokens"), "id").join(nodes, "id"), "whole")
        links = links.union(_blocks(left_over, whole, brief).mapInArrow(_links_between(shingle, num, den), "a long, b long"))
    parts = merge(parts, confirm(links))
    release(*levels, *passing)

    heads = classes.where("copies > 1").select("sequence", F.col("id").alias("head"))
    out = slim.join(heads, "sequence", "left").withColumn("head", F.coalesce("head", "id"))
    if parts is not None:
        out = out.join(parts.select(F.col("id").alias("head"), "part"), "head", "left").withColumn("head", F.coalesce("part", "head"))
    # The result is written, so that nothing else need stay.
    repeated = stash(out.select("id", "n_shingles", F.col("head").alias("component_id")), "components")
    release(slim, classes, *([parts] if parts is not None else []))
    return repeated.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
