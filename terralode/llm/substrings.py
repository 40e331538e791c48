"""Repeated passages: recurring phrases are confirmed across documents, compiled into sharded Aho-Corasick automata,
and every document is streamed through the automata of the shards that can hold its passages, to locate each occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._hashing import Powers, U, hashed, mix, rolled
from terralode.llm._shared import BROADCAST_IDS, binary, only_ids, release, small_batches, stash

#: Phrases of a shard have about so many bytes in all (an automaton takes some 70 bytes of memory for each).
SHARD_BYTES = 1 << 20
#: Documents of a shard that one task streams, about; a shard with more is compiled by several tasks.
SHARD_DOCS = 4096
#: Words of an owner whose phrases go to one shard; phrases of an owner that are cut out at once.
OWNER_WORDS, PHRASES_AT_ONCE = 1 << 14, 4096
#: One anchor in so many starts a new phrase, wherever it stands, so that near copies share most of their phrases.
CUT = 8
#: Bytes of texts that are returned at once.
OUT_BYTES = 2 << 20
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


def _span_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each span of words."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * up[1:], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(U)).view(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values."""
    size, step = len(values) - width + 1, 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[:size], values[width - step : width - step + size])


def _runs(window: int, gram: int):
    """Every window of a document belongs to its anchor, the least hash of the word grams in it. Consecutive windows
    with the same anchor are one row: (anchor, hash of all their words, id, fingerprint, first window, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, spans = Powers(), Powers(_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            marks = np.array([crc32(t or b"") for t in texts], np.int64)
            for first, words, edges in hashed(texts, chars):
                if len(words) < window:
                    continue
                of_word = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                at = np.flatnonzero(of_word[: len(words) - window + 1] == of_word[window - 1 :])
                if not len(at):
                    continue
                doc = of_word[at]
                anchor = _least(rolled(words, gram), window - gram + 1)[at]
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                count = np.diff(np.r_[new, len(at)])
                begin, doc = at[new], doc[new]
                content = _span_hashes(words, begin, count + window - 1, spans)
                columns = [anchor[new].view(np.int64), content, ids[first + doc], marks[first + doc], (begin - edges[doc]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "id", "mark", "pos", "n"])

    return run


def _windows(window: int):
    """The hash of each window in the runs of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, spans = Powers(), Powers(_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts, runs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for first, words, edges in hashed(texts, chars):
                parts = [(i, r["anchor"], r["pos"], r["n"]) for i in range(first, first + len(edges) - 1) for r in runs[i]]
                doc, anchor, pos, n = np.array(parts, np.int64).T
                each = np.repeat(np.arange(len(parts)), n)
                at = pos[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                hashes = _span_hashes(words, edges[doc[each] - first] + at, np.full(len(at), window), spans)
                columns = [anchor[each], hashes, ids[doc[each]], marks[doc[each]], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "id", "mark", "pos"])

    return run


def _chains(window: int):
    """Joins a document's matches (pos, n, anchor, owner, owner_mark, owner_pos) into phrases of their owners: windows that
    follow each other in both documents. Phrases start anew at some anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos, n, anchor, owner, mark, at = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6))
            order = np.lexsort((pos, row))
            row, pos, n, anchor, owner, mark, at = (x[order] for x in (row, pos, n, anchor, owner, mark, at))
            same = lambda x: x[1:] == x[:-1]
            goes_on = same(row) & same(owner) & same(mark) & same(at - pos) & (pos[1:] == pos[:-1] + n[:-1]) & (same(anchor) | (anchor[1:] % CUT != 0))
            first = np.flatnonzero(np.r_[True, ~goes_on])
            last = np.r_[first[1:], len(row)] - 1
            words = pos[last] + n[last] - pos[first] + window - 1
            ids = batch.column(0).to_numpy(zero_copy_only=False)[row[first]]
            columns = [ids, owner[first], mark[first], at[first].astype(np.int32), words.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "owner", "owner_mark", "owner_pos", "words"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of phrases, from their owners' texts, each with a space on both sides."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        owners, at, phrases = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(at, pa.int32()), pa.array(phrases, pa.binary())], names=["owner", "owner_pos", "phrase"])

    for batch in batches:
        rows, size = [], 0
        for owner, text, parts in zip(*(batch.column(k) for k in range(3)), strict=True):
            words = text.as_py().split()
            for part in parts.as_py():
                at = part["owner_pos"]
                rows.append((owner.as_py(), at, b" ".join([b"", *words[at : at + part["words"]], b""])))
                size += len(rows[-1][2])
                if size >= OUT_BYTES:
                    yield table(rows)
                    rows, size = [], 0
        if rows:
            yield table(rows)


def _merged(spans: Iterator[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compiles each shard's phrases as they come, then streams the documents that follow through the automaton: the word
    ranges at which phrases of documents with smaller ids stand. The automaton compares all bytes of a phrase."""
    key, automaton, compiled = None, None, False
    for batch in batches:
        ids, marks, found = [], [], []
        for shard, lot, is_doc, i, text in zip(*(batch.column(k) for k in range(5)), strict=True):
            if (shard.as_py(), lot.as_py()) != key:
                key, automaton, compiled = (shard.as_py(), lot.as_py()), ahocorasick.Automaton(), False
            i, text = i.as_py(), text.as_py()
            if not is_doc.as_py():
                phrase = text.decode("latin-1")
                owner, _ = automaton.get(phrase, (i, 0))
                automaton.add_word(phrase, (min(i, owner), len(phrase)))
                continue
            if not compiled:
                automaton.make_automaton()
                compiled = True
            line = b" ".join([b"", *text.split(), b""])
            hits = {(end - size + 1, end) for end, (owner, size) in automaton.iter(line.decode("latin-1")) if owner < i}
            if hits:
                gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                spans = np.searchsorted(gaps, np.array(_merged(hits)))
                ids.append(i)
                marks.append(crc32(text))
                found.append(spans.ravel().tolist())
        columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "spans"])


def _without(as_is: bool):
    """Drops the words in the ranges of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, size, done = [], [], [], 0, 0
            for k in range(batch.num_rows):
                text, spans = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                words = (text or b"").split()
                left = words
                if spans:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, spans[0::2], 1)
                    np.add.at(cover, spans[1::2], -1)
                    left = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
                kept.append(text if as_is and len(left) == len(words) else b" ".join(left))
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                size += len(kept[-1] or b"")
                if size >= OUT_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(done, k + 1 - done)
                    columns = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
                    yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[3:], *columns], names=["id", *batch.schema.names[3:], "kept", "n_words", "n_removed"])
                    kept, sizes, gone, size, done = [], [], [], 0, k + 1

    return run


def _matches(known: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, mark, pos, n, anchor, owner, owner_mark, owner_pos): n windows from pos on of a document that, by their
    hashes, also stand in an owner, the document with the smallest id, from owner_pos on."""
    runs = stash(known.mapInArrow(_runs(window, gram), "anchor long, content long, id long, mark long, pos int, n int"), "runs")
    # Each grouped table is written before it is joined, so that adaptive execution can split the join's hot keys.
    groups = runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), (F.min("content") != F.max("content")).alias("mixed"))
    groups = stash(groups.where("lo < hi").select("anchor", "mixed"), "anchors")
    found = stash(runs.join(groups, "anchor"), "recurring")
    release(runs, groups)
    firsts = found.groupBy("anchor", "content").agg(F.min(F.struct("id", "mark", "pos", "n")).alias("first"), F.max("id").alias("last"), F.first("mixed").alias("mixed"))
    firsts = stash(firsts, "contents")
    owner = [F.col("first.id").alias("owner"), F.col("first.mark").alias("owner_mark"), F.col("first.pos").alias("owner_pos")]
    again = firsts.where("first.id < last").select("anchor", "content", *owner)
    whole = found.join(again, ["anchor", "content"]).where("id > owner").select("id", "mark", "pos", "n", "anchor", "owner", "owner_mark", "owner_pos")
    whole = stash(whole, "whole")
    heads = firsts.where("mixed").select("anchor", "first.*").groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("runs"))
    heads = stash(heads, "heads")
    release(found, firsts)
    marked = known.withColumn("mark", F.crc32(F.coalesce("text", F.lit(b""))))
    texts = only_ids(marked, heads.select("id").distinct(), "id").dropDuplicates(["id", "mark"])
    windows = texts.join(heads, ["id", "mark"]).select("id", "mark", "text", "runs")
    windows = stash(windows.mapInArrow(_windows(window), "anchor long, content long, id long, mark long, pos int"), "windows")
    release(heads)
    earliest = windows.groupBy("anchor", "content").agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.max("id").alias("last"))
    earliest = stash(earliest.where("first.id < last").select("anchor", "content", *owner), "earliest")
    single = windows.join(earliest, ["anchor", "content"]).where("id > owner")
    single = single.select("id", "mark", "pos", F.lit(1).alias("n"), "anchor", "owner", "owner_mark", "owner_pos")
    single = stash(single, "single")
    release(windows, earliest)
    return whole.union(single)


def _spans(known: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, mark, spans): flat lists of the word ranges that the automata locate."""
    matches = _matches(known, window, gram)
    parts = F.collect_list(F.struct("pos", "n", "anchor", "owner", "owner_mark", "owner_pos"))
    listed = matches.groupBy("id", "mark").agg(parts.alias("parts")).select("id", "parts")
    phrase = ["owner", "owner_mark", "owner_pos", "words"]
    candidates = stash(listed.mapInArrow(_chains(window), "id long, owner long, owner_mark long, owner_pos int, words int"), "candidates")
    release(matches)  # both of its tables

    # The phrase table: words from the owners' texts.
    distinct = stash(candidates.select(*phrase).distinct(), "phrases")
    lots = stash(distinct.groupBy("owner", "owner_mark").agg(F.ceil(F.count("*") / PHRASES_AT_ONCE).alias("lots")).where("lots > 1"), "lots")
    dealt = distinct.join(lots, ["owner", "owner_mark"], "left").withColumn("lot", F.pmod(F.xxhash64("owner_pos", "words"), F.coalesce("lots", F.lit(1))))
    listed = dealt.groupBy("owner", "owner_mark", "lot").agg(F.collect_list(F.struct("owner_pos", "words")).alias("parts"))
    marked = known.withColumn("mark", F.crc32(F.coalesce("text", F.lit(b""))))
    owners = only_ids(marked, distinct.select(F.col("owner").alias("id")).distinct(), "id").dropDuplicates(["id", "mark"])
    owners = owners.select(F.col("id").alias("owner"), F.col("mark").alias("owner_mark"), "text")
    cut = owners.join(listed, ["owner", "owner_mark"]).select("owner", "text", "parts").mapInArrow(_cut_out, "owner long, owner_pos int, phrase binary")
    table = stash(cut, "table")
    size = table.agg(F.sum(F.length("phrase"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner", F.floor(F.col("owner_pos") / OWNER_WORDS)), F.lit(-(-size // SHARD_BYTES) or 1)).alias("shard")

    # Documents go to the shards that hold phrases of their candidates' owners.
    routes = stash(candidates.select("id", shard).distinct(), "routes")
    loads = stash(routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_DOCS).cast("int").alias("lots")), "loads")
    texts = only_ids(known, routes.select("id").distinct(), "id")
    docs = routes.join(loads, "shard").withColumn("lot", F.pmod(F.xxhash64("id"), "lots").cast("int")).join(texts, "id")
    docs = docs.select("shard", "lot", F.lit(True).alias("is_doc"), "id", "text")
    phrases = table.select(shard, "owner", "phrase").join(loads, "shard")
    phrases = phrases.select("shard", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("is_doc"), "owner", "phrase")
    stream = phrases.union(docs).repartition("shard", "lot").sortWithinPartitions("shard", "lot", "is_doc")
    found = stream.mapInArrow(_located, "id long, mark long, spans array<int>")
    spans = stash(found.groupBy("id", "mark").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    release(candidates, distinct, lots, table, routes, loads)
    return spans


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, keep: tuple[str, ...] = (), as_is: bool = False
) -> DataFrame:
    """Removes each word covered by a window of so many consecutive words whose sequence also starts in a document
    with a smaller id. Returns (id, *keep, kept, n_words, n_removed): kept is the words left, joined by one space, or,
    where nothing was removed and as_is is set, the text as it was; keep names other columns that go along.
    Windows are judged on the input, not on what is left of it.

    Candidates: a document is cut into runs of windows that share an anchor, the least hash of the 16-word grams in the
    window: a window has the same anchor wherever it stands, and there is about one run for 18 words. Runs meet by
    anchor. Where an anchor is seen in one document only, nothing recurs. A run that recurs whole settles all its
    windows in one row; only where an anchor has several contents, one document for each content gives the hashes of its
    windows. What follows on in a document and in its owner, the document with the smallest id, is one candidate.

    Automata: the candidates' words are cut out of their owners' texts, which makes the phrase table, and dealt to shards of
    SHARD_BYTES. A document is streamed through the automata of all shards that hold phrases of its owners. Only where
    the automaton finds a phrase of an owner with a smaller id, byte for byte, words are removed: hashes propose, and
    never decide. A document without candidates can hold no phrase and passes.

    Hot passages: every group is reduced to minima, combined before the shuffle, written, and joined back on its key; the
    documents of a hot shard are dealt to several tasks.

    Nulls: a null text has no words; a row with a null id is neither a source nor shortened. Rows with the same id
    don't count as before each other. Other columns are ignored. An empty table gives an empty result.
    """
    whole_rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), binary(text_col).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    spans = _spans(whole_rows.select("id", "text").where("id is not null"), window, gram)
    hit = spans.select("id").distinct()
    marked = whole_rows.withColumn("mark", F.crc32(F.coalesce("text", F.lit(b""))))
    columns = ["id", "text", "spans", *(f"keep_{c}" for c in keep)]
    if hit.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        near = marked.join(F.broadcast(hit), "id", "left_semi").join(spans, ["id", "mark"], "left").select(*columns)
        far = marked.join(F.broadcast(hit), "id", "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(*columns)
        rows = near.union(far)
    else:
        rows = marked.join(spans, ["id", "mark"], "left").select(*columns)
    more = "".join(f"`keep_{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    out = rows.mapInArrow(_without(as_is), f"id long, {more}kept binary, n_words long, n_removed long")
    return out.select(F.col("id").alias(id_col), *(F.col(f"keep_{c}").alias(c) for c in keep), F.col("kept").cast("string").alias("kept"), "n_words", "n_removed")
