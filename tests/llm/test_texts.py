import json
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralode.llm import decontaminate, langid, licences
from terralode.llm.oracles import licence_digests as licences_sql
from terralode.llm.packing import pack_documents

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    profiles = langid.learn_profiles(docs.where(~langid.held_out()))
    rows = langid.identify_language(docs, profiles, ["doc_id", "lang", langid.held_out().alias("held_out")]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_equals_plain_ranks(spark, sf_dir):
    """Against profiles and distances counted the plain way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def ranked(texts):
        n = Counter()
        for t in texts:
            word = ["_"]
            for c in t.lower() + " ":
                if c.isalpha() or word[-1] != "_":
                    word.append(c if c.isalpha() else "_")
            s = "".join(word)
            n.update(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]) != "_" and len(s) > 2)
        return sorted(n, key=lambda g: (-n[g], len(g), g.replace("_", "\x00")))[: langid.DEPTH]

    rows = docs.collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    languages = sorted({r.lang for r in learned})
    ranks = {x: {g: i for i, g in enumerate(ranked(r.text for r in learned if r.lang == x))} for x in languages}
    got = {r.doc_id: r for r in langid.identify_language(docs, langid.learn_profiles(docs.where(~langid.held_out())), ["doc_id"]).collect()}
    for r in rows[:60]:
        top = ranked([r.text])
        apart = {x: sum(abs(i - ranks[x][g]) if g in ranks[x] else langid.DEPTH for i, g in enumerate(top)) for x in languages}
        best = min(languages, key=lambda x: (apart[x], x))
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - (1 - apart[best] / (langid.DEPTH * len(top)))) < 1e-12


def test_language_odd_rows(spark, odd_docs, no_docs):
    profiles = langid.learn_profiles(odd_docs)
    rows = langid.identify_language(odd_docs, profiles, ["doc_id", "id"]).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"und"}
    assert langid.identify_language(no_docs, profiles, ["doc_id"]).collect() == []
    none = langid.learn_profiles(no_docs)
    assert {(r.lang_pred, r.score) for r in langid.identify_language(odd_docs, none, ["doc_id"]).collect()} == {("und", 0.0)}


def bm25(items):
    """score(words, item), as a share of the item's score against itself, the plain way."""
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items.items()}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)

    def plain(asked, i):
        tf = Counter(words[i])
        idf = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) for t in tf}
        return sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t, n in tf.items() if t in asked)

    own = {i: plain(set(w), i) for i, w in words.items()}
    return words, lambda asked, i: plain(asked, i) / own[i]


def test_leaks_equal_scoring_all(spark, sf_dir):
    """Against the plain scores of all passages with all items, and the planted items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, items).collect()}
    tests = {r.item_id: r.text for r in items.collect()}
    words, score = bm25(tests)
    step = max(32, *map(len, words.values()))
    parts = {i: [decontaminate.shingles(p) for p in decontaminate.question_and_answer(t)] for i, t in tests.items()}
    want, planted = {}, set()
    for r in docs.collect():
        text = decontaminate.words_of(r.text)
        planted |= {(r.doc_id, i) for i, w in words.items() if f" {' '.join(w)} " in f" {' '.join(text)} "}
        for at in range(0, max(1, len(text)), step):
            part = text[at : at + 2 * step]
            for i in tests:
                ok = all(len(p & {tuple(part[x : x + len(next(iter(p)))]) for x in range(len(part))}) >= 0.8 * len(p) for p in parts[i])
                if ok and (s := score(set(part), i)) >= decontaminate.RETRIEVE:
                    want[r.doc_id, i] = max(s, want.get((r.doc_id, i), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - min(1, s)) < 1e-9 for k, s in want.items())
    assert planted and planted <= got.keys()


def test_retrieval_equals_scoring_all(spark):
    """What WAND retrieves at any threshold is what scoring everything gives."""
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    items = {i: " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randrange(3, 25))) for i in range(150)}
    words, score = bm25(items)
    df = Counter(t for w in words.values() for t in set(w))
    rows = [(i, "m", len(w), t, n, df[t]) for i, w in words.items() for t, n in Counter(w).items()]
    postings = dict(zip(("item_id", "mark", "n", "term", "tf", "df"), map(list, zip(*rows, strict=True)), strict=True))
    index = decontaminate.build_index([(i, "m", t) for i, t in items.items()], postings, len(items), sum(map(len, words.values())) / len(words), 25)
    passages = [rng.choices(vocabulary, k=rng.randrange(30)) for _ in range(80)]
    codes = np.array([index.terms.get(t, 0) for p in passages for t in p])
    at = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    for threshold in (0.2, 0.5, 0.8):
        want = {(p, i): s for p, w in enumerate(passages) for i in items if (s := score(set(w), i)) >= threshold}
        found = decontaminate.retrieve(index, codes[codes > 0], at[codes > 0], len(passages), threshold)
        got = {(p, index.ids[i]): s for p, i, s in zip(*(x.tolist() for x in found), strict=True)}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_are_the_same_for_any_number_of_passes(spark, sf_dir, monkeypatch):
    """More than a thousand items, in one, two and seven indices: the scores are those among all items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/../sf0.1/benchmark.parquet").select("item_id", "text")
    more = docs.where("n_chars > 200").select((F.col("doc_id") * 7 + 1000).alias("item_id"), F.concat(F.substring("text", 1, 150), F.lit(". "), F.substring("text", 50, 100)).alias("text"))
    items = items.union(more).union(more.select(F.col("item_id") + 1, F.concat("text", F.lit(" more words"))))
    items = items.union(spark.range(5000, 6100).select("id", F.concat_ws(" ", *(F.concat(F.lit(f"q{j}"), F.col("id") % (j + 3)) for j in range(12)))))
    assert items.count() > 1024
    n = items.count() * 30
    results = []
    for most in (n, 10_000, 3_000):
        monkeypatch.setattr(decontaminate, "MOST_POSTINGS", most)
        results.append(sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())))
    assert results[0] and results[0] == results[1] == results[2]


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8. w9 w10 w11."), (2, None), (None, "x"), (3, ""), (4, "no such words here at all")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.find_leaks(odd_docs, items).collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert decontaminate.find_leaks(no_docs, items).collect() == [] and decontaminate.find_leaks(odd_docs, items.limit(0)).collect() == []


def pieces(docs):
    by_doc, by_sequence = {}, {}
    for r in pack_documents(docs, TOKENIZER).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        total = sum(r.length for r in rows)
        assert total == rows[0].tier <= 2048 and total & (total - 1) == 0
    return by_doc, by_sequence


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    by_doc, by_sequence = pieces(docs)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in docs.collect():
        rows = sorted(by_doc[r.doc_id], key=lambda x: x.start)
        want = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        got = b"".join(x.ids for x in rows)
        assert got == b"".join(i.to_bytes(4, "little") for i in want) and {x.doc_tokens for x in rows} == {len(want)}
    full = sum(s[0].tier == 2048 for s in by_sequence.values())
    assert full > len(by_sequence) / 4


def test_packing_other_vocabularies(spark, tmp_path):
    """Settings that aren't those of word vocabularies: whole texts are encoded, white space and letters as they are."""
    texts = ["A  b\nc", "It's 12", "", "Ünï <|endoftext|>"]
    plain = json.loads(Path(TOKENIZER).read_text())
    plain["normalizer"]["normalizers"] = plain["normalizer"]["normalizers"][:2]  # without lower-casing
    (tmp_path / "other.json").write_text(json.dumps(plain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as part", "3 as ids").coalesce(1)
    for path in (public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/other.json"):
        tokenizer, got = Tokenizer.from_file(path), {}
        for r in pack_documents(docs, path).orderBy("doc_id", "start").collect():
            got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
        assert [got[i] for i in range(4)] == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


def test_step_groups_balance(spark, sf_dir):
    """Each step group of a partition has the same number of tokens, but for the last."""
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet").repartition(2)
    sums = {}
    for r in pack_documents(docs, TOKENIZER, group=8).groupBy("step_group").agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("k")).collect():
        sums.setdefault(r.step_group >> 33, []).append((r.step_group, r.n))
    assert len(sums) == 2
    for groups in sums.values():
        *full, last = [n for _, n in sorted(groups)]
        assert len(full) > 5 and all(abs(n - 8 * 2048) < 2048 for n in full) and sum(full) // len(full) in range(8 * 2048 - 200, 8 * 2048 + 200) and 0 < last <= 9 * 2048


def test_packing_odd_rows(spark, no_docs):
    texts = [(1, None), (2, ""), (3, "Ünïcode ß ﬁ Ⅷ e\u0301 <|endoftext|> 's don't 12.5 日本 \u00a0 a\u2003b İ ΑΣ"), (4, "x " * 50_000), (None, "a"), (1, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    by_doc, _ = pieces(docs)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [int.from_bytes(b[i : i + 4], "little") for b in [b"".join(x.ids for x in by_doc[3])] for i in range(0, len(b), 4)]
    assert ids == [*tokenizer.encode(texts[2][1], add_special_tokens=False).ids, 1]
    assert len(by_doc[1]) == 2 and sum(x.length for x in by_doc[4]) == 50_001
    assert pack_documents(no_docs, TOKENIZER).collect() == []


def test_licences(spark, odd_docs, no_docs):
    mit = licences.KNOWN["MIT"]
    texts = [
        (1, "Copyright (c) 2020 A. Author\n\n" + mit.upper().replace(",", " ,")), (2, mit.replace("sublicense", "sublicense ")), (3, "some text\nReleased under the MIT licence!\nend"), (4, mit + " more"), (5, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.find_licences(docs).collect()}
    assert [got[i].licence for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", None, None, None]
    assert got[3].line_licences == ["MIT-notice"] and got[5].digest is None and got[5].line_licences == []
    assert len(licences.find_licences(odd_docs).collect()) == odd_docs.count() and licences.find_licences(no_docs).collect() == []
    assert licences.find_licences(docs.withColumn("digest", F.lit(1)), known={}).where("licence is not null").count() == 0


def test_licences_as_published(spark):
    """Each known text under each of its headings, wrapped at several widths, and in other letters, quotes and line ends."""
    rows = []
    for name, text in licences.KNOWN.items():
        for head in ["", *(f"{h}\n\n" for h in licences.HEADINGS.get(name, ()))]:
            for width in (60, 72, 78, 100):
                body = "\n".join(textwrap.wrap(text, width))
                rows += [(name, f"{head}Copyright (c) 2020 A. Author\n\n{body}\n"), (name, (head + body).upper().replace("\n", "\r\n"))]
    docs = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(rows)], "doc_id long, name string, text string").withColumn("digest", F.lit(1))
    got = {r.doc_id: r.licence for r in licences.find_licences(docs).collect()}
    assert len(got) == len(rows) and all(got[i] == name for i, (name, _) in enumerate(rows))


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="needs the licence texts of the system")
def test_longer_licences_as_published(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(i, (Path("/usr/share/common-licenses") / f).read_text()) for i, f in enumerate(names)]
    rows += [(100 + i, t.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n") for i, t in rows[:3]]
    got = {r.doc_id: r.licence for r in licences.find_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values()) and [got[100 + i] for i in range(3)] == list(names.values())[:3]


def test_licence_sql_says_the_same(spark, tmp_path):
    """The SQL, on texts that the dealt join does find."""
    rows = [(i, f"{h}{t}") for i, (h, t) in enumerate((h, t) for t in licences.KNOWN.values() for h in ("", "(c) 2001 B\n", "Copyright notice\n", "All rights reserved.\nMIT License\n"))]
    rows += [(500, None), (501, " \n"), (502, "x\nReleased under the MIT licence!\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(licences_sql()).select("doc_id, digest, licence, line_licences").fetchall())
    got = sorted((r.doc_id, r.digest, r.licence, ",".join(r.line_licences)) for r in licences.find_licences(docs).collect())
    assert got == want and sum(r[2] is not None for r in got) == 2 * len(licences.KNOWN) + 1


def test_licence_bodies_keep_their_lines(spark):
    """The usual wrapping of the ISC text has a line that starts with "copyright notice"."""
    isc = licences.KNOWN["ISC"].replace("\n", " ").replace("that the above copyright", "that the above\ncopyright").replace("all copies. ", "all copies.\n\n")
    heads = ["", "Copyright (c) 2020, A. Author\n\n", "Copyright 2004 by B\n", "(c) 2020 C\n", "Copyright: The D Authors\nAll rights reserved.\n"]
    docs = spark.createDataFrame([(i, head + isc) for i, head in enumerate(heads)], "doc_id long, text string")
    assert [r.licence for r in licences.find_licences(docs).orderBy("doc_id").collect()] == ["ISC"] * len(heads)
