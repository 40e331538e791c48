from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa

from terralode.llm import neardup
from terralode.llm.components import connected_components
from terralode.llm.neardup import near_duplicates, shingle_set


def groups(rows, k, num, den):
    """Component of each id by comparing all pairs."""
    sets = [(i, shingle_set(t and t.encode(), k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and den * len(x & y) >= num * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i, _ in sets}


def test_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k, num, den in ((3, 85, 100), (5, 4, 5)):
        got = {r.doc_id: r for r in near_duplicates(docs, shingle=k, similarity=(num, den)).collect()}
        want = groups(rows, k, num, den)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingle_set(dict(rows)[i].encode(), k)) for i, r in got.items())


def test_recall_of_all_pairs(spark, sf_dir):
    """Every link that comparing all pairs gives, on a table of a thousand documents: none is missed, none is added."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert len(rows) == 1000 and got == groups(rows, 3, 85, 100) and len(set(got.values())) < 950


def test_equal_hashes_alone_link_nothing(spark, monkeypatch):
    """With all hashes of shingles equal, digests of sets and all tokens agree: links are confirmed on full sets."""
    monkeypatch.setattr(neardup, "rolled", lambda words, k: np.ones(max(0, len(words) - k + 1), np.uint64))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(5))) for i in range(8)] + [(20, "a b c d a b c d"), (21, "a b c d a b c"), (22, "A b c d a b c d"), (23, "c d a b c d a b c"), (24, "x"), (25, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == groups(rows, 3, 85, 100) and got[23] == 20


def test_copies_of_a_hub_that_are_not_like_each_other(spark):
    """A large node of one component: each copy is near the original, most pairs of copies aren't near enough."""
    base = [f"w{i}" for i in range(300)]
    rows = [(500, " ".join(base))]
    for c in range(120):
        words = list(base)
        for j in range(8):
            words[(c * 37 + j * 31) % 300] = f"c{c}_{j}"
        rows.append((c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows, 3, 85, 100)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == want and set(want.values()) == {0}


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs, shingle=3, similarity=(85, 100)).collect())
    by = {r[0]: r for r in got}
    assert len(got) == odd_docs.count()
    assert by[2][2:] == (1, False) and by[3][2:] == (1, False) and by[10][2:] == (9, False)
    assert by[4] == (4, 0, 4, True) and by[5] == (5, 0, 5, True) and by[6] == (6, 0, 6, True)
    assert by[7] == (7, 1, 7, True) and by[8] == (8, 1, 7, False) and by[-1][2:] == (None, True)
    assert near_duplicates(no_docs).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_a_large_family_around_the_threshold(spark):
    """Nodes that no branching parts and that stay several components: some members link, others only nearly."""
    rng = Random(5)
    rows = []
    for c in range(150):
        words = [f"w{i}" for i in range(120)]
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            words[rng.randrange(120)] = f"c{c}_{rng.randrange(99)}"
        rows.append((c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows, 3, 85, 100)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == want and 1 < len(set(want.values())) < 150


def test_near_copies_are_not_carried_down_the_trees(spark, monkeypatch):
    """A large group that one hub settles branches no further: the rows of all nodes are some for each document."""
    from terralode.llm import neardup

    live = []

    def counted(df, name="table"):
        out = plain(df, name)
        if name == "live":
            live.append(out.count())
        return out

    plain = neardup.stash
    monkeypatch.setattr(neardup, "stash", counted)
    texts = [" ".join(f"w{j}" if j != i else f"other{i}" for j in range(300)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(live) <= 20 * len(texts)


def test_documents_branch_once_with_all_their_nodes(spark, monkeypatch):
    """Large nodes that stay several components: each branching is given a document once, with its tokens, not once for each node."""
    rng, rows, given = Random(7), [], []
    for c in range(200):
        words = [f"w{i}" for i in range(120)]
        for _ in range(rng.choice((0, 1, 2, 6, 9))):
            words[rng.randrange(120)] = f"c{c}_{rng.randrange(99)}"
        rows.append((c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = type(docs).mapInArrow

    def counted(df, func, schema, *more, **named):
        if schema == neardup._MEMBER:
            given.append((df.count(), df.select("id").distinct().count()))
        return plain(df, func, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == groups(rows, 3, 85, 100)
    assert len(given) > 1 and all(n == ids <= len(rows) for n, ids in given)


def test_pairs_that_meet_in_many_nodes_are_decided_in_one():
    """Near copies that share three large nodes: each pair's link is given by one node, not by all of them."""
    texts = {i: " ".join(f"w{j}" for j in range(60)) for i in (1, 2, 3)}
    member = lambda i, part, nodes: {"id": i, "part": part, "other": True, "tokens": bytes(512), "text": texts[i].encode(), "nodes": nodes}
    members = [member(1, 1, [5, 7, 9]), member(2, 2, [5, 7, 9]), member(3, 3, [7, 8])]
    struct = pa.list_(pa.struct([("id", pa.int64()), ("part", pa.int64()), ("other", pa.bool_()), ("tokens", pa.binary()), ("text", pa.binary()), ("nodes", pa.list_(pa.int64()))]))
    at = {n: [m for m in members if n in m["nodes"]] for n in (5, 7, 8, 9)}
    blocks = pa.RecordBatch.from_arrays([pa.array(list(at)), *(pa.array(list(at.values()), struct) for _ in range(2))], names=["node", "some", "all_"])
    out = [tuple(p.values()) for batch in neardup._links_between(3, 85, 100)(iter([blocks])) for p in batch.to_pylist()]
    assert sorted(out) == [(1, 2), (1, 3), (2, 3)] or sorted(out) == [(1, 2), (1, 3)]


def test_near_copies_that_no_hub_settles_are_not_carried_down_level_by_level(spark, monkeypatch):
    """A family of which a part stays apart: few levels, and the rows joined by node are few for each document."""
    live = []

    def counted(df, name="table"):
        out = plain(df, name)
        if name == "live":
            live.append(out.count())
        return out

    plain = neardup.stash
    monkeypatch.setattr(neardup, "stash", counted)
    rng, rows = Random(11), []
    for c in range(200):
        words = [f"w{i}" for i in range(120)]
        for _ in range(rng.choice((0, 1, 2, 6, 9))):
            words[rng.randrange(120)] = f"c{c}_{rng.randrange(99)}"
        rows.append((c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=3, similarity=(85, 100)).collect()}
    assert got == groups(rows, 3, 85, 100) and len(set(got.values())) > 1
    assert 1 < len(live) <= 3 and sum(live) <= 40 * len(rows)
