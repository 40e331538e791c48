from random import Random

import numpy as np

from terralode.llm import substrings
from terralode.llm.substrings import remove_repeated_passages


def brute(rows, window):
    first, out = {}, []
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in rows:
        for p in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[p : p + window])
            first[key] = min(i, first.get(key, i))
    for i, words in rows:
        gone = set()
        for p in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((-1 if i is None else i, b" ".join(w for k, w in enumerate(words) if k not in gone).decode(), len(words), len(gone)))
    return sorted(out)


def check(docs, window=50):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.kept, r.n_words, r.n_removed) for r in remove_repeated_passages(docs, window=window).collect())
    assert got == brute(rows, window)
    return got


def test_equals_every_window(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sum(r[3] for r in got) > 0


def test_odd_rows(odd_docs, no_docs):
    got = {r[0]: r for r in check(odd_docs)}
    assert got[2][3] == 123 and got[10][3] == 30_000 and got[-1][3] == 0
    assert remove_repeated_passages(no_docs).collect() == []


def test_repeating_words(spark):
    """Windows of few different words, which share their anchors over long runs."""
    rows = [(1, "a " * 70), (2, "b " + "a " * 60 + "c"), (3, "a b " * 50), (4, "b a " * 49), (5, "a " * 49), (6, "a " * 50)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    check(spark.createDataFrame(rows, "doc_id long, text string"), window=20)


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """With all hashes of spans and grams equal, every window is a candidate, and none that doesn't recur is removed."""
    monkeypatch.setattr(substrings, "_span_hashes", lambda words, starts, lengths, powers: np.zeros(len(starts), np.int64))
    monkeypatch.setattr(substrings, "rolled", lambda words, k: np.zeros(max(0, len(words) - k + 1), np.uint64))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(90))) for i in range(6)]
    got = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.kept, r.n_removed) for r in got} == {i: (t, 0) for i, t in rows}


def test_any_number_of_shards_and_lots(spark, sf_dir, monkeypatch):
    """Small shards, dealt to several tasks each, find what one finds."""
    for name, value in (("SHARD_BYTES", 2000), ("SHARD_DOCS", 2), ("OWNER_WORDS", 100), ("PHRASES_AT_ONCE", 3), ("OUT_BYTES", 500)):
        monkeypatch.setattr(substrings, name, value)
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_families_of_near_copies(spark):
    """Copies with edits of one text, of which some words repeat, and a passage of it in other documents, as often as in its own."""
    rng = Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(600)]
    rows = []
    for i in rng.sample(range(1000), 40):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(600)] = f"e{i}"
        rows.append((i, " ".join(words if i % 3 else words[100:260] + words[90:180] * 2)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_texts_as_they_were(spark):
    rows = [(1, " a\t b\n" * 40), (2, "x  y"), (3, "q " + "a b " * 40 + " r"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeated_passages(docs, as_is=True, keep=("text",)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [rows[0][1], "x  y", "q r", None] and got[3].text == rows[2][1]
