"""The Merkle manifest and the repair of conversations against plain versions."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terralode.llm import conversations, oracles, queries
from terralode.llm.conversations import damaged, repair_conversations, report_repairs
from terralode.llm.manifest import folded, merkle_manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def same(spark, tmp_path, name, table, df):
    """A query over df as its table, against its SQL."""
    df.write.parquet(f"{tmp_path}/{table}.parquet")
    got = getattr(queries, name)(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql("SET TimeZone = 'UTC'")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = db.sql(queries.oracle_sql()[name])
        names, rows = want.columns, want.fetchall()
    assert sorted(names) == sorted(got.columns)
    got = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    assert got == sorted(rows, key=str)
    return got


def plain_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(f, r))

    def tree(hashes):
        proofs, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for i, place in enumerate(at):
                run = place // 16 * 16
                proofs[i].append(("".join(hashes[run:place]), "".join(hashes[place + 1 : run + 16])))
                at[i] = place // 16
            hashes = [H(*hashes[j : j + 16]) for j in range(0, len(hashes), 16)]
        return hashes[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    return sorted(
        (
            (r[0], leaf(r), trees[s][0], root, [*p, *up])
            for s, up in zip(order, above, strict=True)
            for r, p in zip(sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), trees[s][1], strict=True)
        ),
        key=str,
    )


@pytest.mark.parametrize("n", [1, 16, 17, 5000])
def test_manifest_equals_a_plain_tree(spark, n):
    """5000 rows make a group of more than a block of 4096; nulls, a repeated row, clashing extra columns."""
    rows = [(i if i % 97 else None, ("s", "s", "s", "s", "s", "s", None, "é", "t")[i % 9 if i % 50 == 0 else 0], "en" if i % 3 else None, i if i % 5 else None, f"Text {i} Éa" if i % 11 else None) for i in range(n)]
    rows.append(rows[0])
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", `group` string, rank int").repartition(3)
    got = merkle_manifest(df).withColumn("same", folded(F.col("proof"), F.col("leaf")) == F.col("root")).collect()
    assert all(r.same and r.claimed == r.leaf for r in got)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.proof]) for r in got), key=str) == plain_manifest(rows)


def test_manifest_query_and_tampering(spark, tmp_path):
    rows = [(i, f"s{i % 40}" if i % 7 else None, "en", i, f"Some Text {i}" if i % 6 else None) for i in range(900)] + [(None, None, None, None, None), (5, "s5", "x", 1, "")]
    got = same(spark, tmp_path, "op11_merkle_manifest", "documents", spark.createDataFrame(rows, DOCS))
    hit = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4]}
    assert {r[0] for r in got if not r[-1]} == hit and hit


def test_manifest_of_nothing(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


def plain_repair(rows):
    """Rows (role, text, kind) in order: the least (cost, edits) over all edits, by trying each row's edits on all ways."""
    role, nxt = {2: "user", 3: "assistant"}, {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (c, a, p) in list(out.items()):
                new = (c + 3, a + "I", (*p, f"{role[nxt[s]]}:"))
                if nxt[s] not in out or new[:2] < out[nxt[s]][:2]:
                    out[nxt[s]] = new
        return out

    # all ways are kept, not only the best for a state, so that nothing hangs on an argument about beginnings
    ways = {(0, "", (), 0)}
    for r, t, kind in rows:
        more = set()
        for c, a, p, s in ways:
            for k in range(3):
                at, ins = s, []
                for _ in range(k):
                    at = nxt[at]
                    ins.append(f"{role[at]}:")
                base = a + "I" * k
                more.add((c + 3 * k + 4, base + "D", (*p, *ins), at))
                if kind not in ("blank", "duplicate"):
                    x = 3 * (kind == "truncated")
                    if r[:1] == "s" and at == 0:
                        more.add((c + 3 * k + x, base + "K", (*p, *ins, f"{r}:{t}"), 1))
                    if r[:1] == role[nxt[at]][0]:
                        more.add((c + 3 * k + x, base + "K", (*p, *ins, f"{r}:{t}"), nxt[at]))
                    more.add((c + 3 * k + 3 + x, base + "R", (*p, *ins, f"{role[nxt[at]]}:{t}"), nxt[at]))
        least = min(w[0] for w in more)
        ways = {w for w in more if w[0] <= least + 10}
    ends = []
    for c, a, p, s in ways:
        while s not in (0, 3):
            s = nxt[s]
            c, a, p = c + 3, a + "I", (*p, f"{role[s]}:")
        ends.append((c, a, p))
    return min(ends)


@pytest.mark.parametrize("seed", range(3))
def test_edits_are_the_cheapest(seed):
    """Against all ways, for random conversations of all kinds of rows."""
    r = random.Random(seed)
    for _ in range(120):
        rows = [(r.choice(["user", "assistant", "system", "tool", "u", " ", ""]), f"t{i}", r.choice([None, None, None, "blank", "duplicate", "truncated"])) for i in range(r.randint(0, 5))]
        talk = conversations._Conversation(1, "file:///none")
        edits = [e for i, (role, text, kind) in enumerate(rows) for e in talk.add(i, role, text, kind)] + list(talk.end())
        cost, audit, kept = plain_repair(rows)
        assert "".join(e[2] or "" for e in edits) == audit and sum(e[7] or 0 for e in edits) == cost
        assert tuple(f"{e[4]}:{e[5]}" for e in edits if e[2] not in (None, "D")) == kept


@pytest.mark.parametrize("kinds", [["system"], ["user", "assistant"], ["user", "assistant", "system", "tool"]])
def test_spilled_windows_change_nothing(kinds, tmp_path, monkeypatch):
    """Windows of 7 rows against one of all rows; system rows alone leave two equal ways open to the end."""
    r = random.Random(5)
    rows = [(i, r.choice(kinds), f"t{i}", r.choice([None, None, "blank", "truncated"])) for i in range(3000)]

    def edits():
        talk = conversations._Conversation(1, f"file://{tmp_path}")
        return [e for row in rows for e in talk.add(*row)] + list(talk.end())

    monkeypatch.setattr(conversations, "WINDOW_ROWS", 10**9)
    want = edits()
    monkeypatch.setattr(conversations, "WINDOW_ROWS", 7)
    spilled = []
    put = conversations._Spill.put
    monkeypatch.setattr(conversations._Spill, "put", lambda self, *a: spilled.append(1) or put(self, *a))
    assert edits() == want and not list(tmp_path.iterdir())
    assert spilled or kinds != ["system"]


TALKS = "conv_id long, turn long, role string, text string, fault string, seq int"


def test_repair_query(spark, tmp_path, sf_dir):
    """The given conversations, with nulls, repeated rows, odd roles, empty and long texts."""
    odd = [(None, 1, "user", "a."), (None, None, None, None), (7000, 1, "assistant", "x" * 100_000), (7000, 1, "assistant", "x" * 100_000), (7001, 5, "", ""), (7001, 2, "system", " \n\t "), (7001, 9, "system", "Hi! \n"), (7002, None, "tool", "no end")]
    odd += [(8000 + i % 5, i, random.Random(i).choice(["user", "assistant", "system"]), f"t{i % 9}" + "." * (i % 2)) for i in range(200)]
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(*r, "x", 1) for r in odd], TALKS).select("conv_id", "turn", "role", "text")
    got = same(spark, tmp_path, "op12_conversation_repair", "conversations", given.unionByName(more))
    assert len(got) == given.union(more).select("conv_id").distinct().count()


def test_repair_of_odd_tables(spark):
    """Nothing; clashing names; a conversation whose rows are all lost."""
    none = spark.createDataFrame([], TALKS)
    assert report_repairs(repair_conversations(damaged(none))).collect() == [] and repair_conversations(none).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 9), (1, 1, "assistant", "Yes.", "x", 9)], TALKS)
    assert [(r.edit, r.seq, r.fault) for r in repair_conversations(rows).collect()] == [("K", 0, None), ("K", 1, None)]
    gone = report_repairs(repair_conversations(rows.withColumn("lost", F.lit(True)))).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", H())]


def test_sql_is_whole():
    assert "WITH RECURSIVE" in oracles.conversation_repair() and "verified" in oracles.merkle_manifest()
