"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND for every passage of every document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._shared import binary, release, small_batches, stash

#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Share of an item's score against itself from which a passage retrieves it.
RETRIEVE = 0.5
#: Words of the shingles that verify, and the share of them that must be found, in the question and in the answer.
SHINGLE, OVERLAP = 5, 0.8
#: Items of a block of the index; postings of an index, which is broadcast and has at most some 60 MB then. More take one
#: more pass over the documents for each so many, with the same scores.
BLOCK, MOST_POSTINGS = 8, 2_000_000
#: Words of a document that are handled at once, and sums of block maxima, are about so many.
CHUNK_WORDS, SUMS_AT_ONCE = 60_000, 1 << 20
#: What sums of bounds may be off.
SLACK = 1e-9

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words: the last sentence that has any is the answer, those before it the question. An item of one
    sentence is both."""
    sentences = [w for s in re.split(r"[.!?\n]+", text) if (w := words_of(s))]
    if len(sentences) < 2:
        return (sentences or [[]])[0], (sentences or [[]])[0]
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of SHINGLE words; of fewer words, all as one."""
    k = min(SHINGLE, len(words))
    return set(zip(*(words[i:] for i in range(k)), strict=False))


@dataclass(frozen=True)
class Index:
    """Postings of each term in order of items, which are in order of length so that blocks are alike: item and impact, the
    term's part in the item's BM25 score, as a share of the item's score against itself, so that one threshold holds for
    all. entries are the blocks of items in which a term has postings: term k has the entries from entries_of[k] on;
    entry e is in block[e], has the greatest impact most[e] and the postings from postings_of[e] on. highest is a term's
    greatest impact anywhere. Code 0 stands for all words that no item has."""

    ids: list[int]
    texts: list[str]
    terms: dict[str, int]
    step: int
    entries_of: np.ndarray
    block: np.ndarray
    most: np.ndarray
    postings_of: np.ndarray
    place: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    highest: np.ndarray


def build_index(items: list[tuple[int, str, str]], postings: dict[str, list], n_items: int, mean: float, longest: int) -> Index:
    """items: (id, mark, text); postings: columns item_id, mark, n (words of the item), term, tf and df. n_items, mean and
    longest (numbers of items, mean and greatest numbers of words) are those of all items, as df is, so that scores don't
    hang on what else is in an index."""
    n, df, tf = (np.array(postings[c], np.float64) for c in ("n", "df", "tf"))
    keys = list(zip(postings["item_id"], postings["mark"], strict=True))
    length = dict(zip(keys, postings["n"], strict=True))
    order = sorted((length[i, m], i, m, t) for i, m, t in items if (i, m) in length)
    at = {(i, m): k for k, (_, i, m, _) in enumerate(order)}
    item = np.array([at[k] for k in keys], np.int64)
    terms = {t: k for k, t in enumerate(sorted(set(postings["term"])), 1)}
    code = np.array([terms[t] for t in postings["term"]], np.int64)
    impact = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
    sort = np.lexsort((item, code))
    item, code, impact = item[sort], code[sort], impact[sort]
    impact = impact / np.bincount(item, impact, len(order))[item]
    begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]) if len(item) else np.zeros(0, np.int64)
    entry = np.zeros(len(item), np.int64)
    entry[begin] = 1
    entry = np.cumsum(entry) - 1
    highest = np.zeros(len(terms) + 1)
    np.maximum.at(highest, code, impact)
    return Index(
        [i for _, i, _, _ in order], [t for *_, t in order], terms, max(32, longest), np.searchsorted(code[begin], np.arange(len(terms) + 2)), item[begin] // BLOCK,
        np.maximum.reduceat(impact, begin) if len(item) else impact, np.r_[begin, len(item)], entry * BLOCK + item % BLOCK, item, impact, highest,
    )


def _wand(index: Index, lane: np.ndarray, entry: np.ndarray, lanes: int, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """WAND for many lanes at once, each a passage in one block of items: a cursor stands in the postings of each of its
    terms there. The cursors of a lane are put in order of their items; the first at which the sum of maxima reaches the
    threshold is the pivot. A lane without one is done; else its cursors before the pivot's item skip to it, what stands
    on it is scored, and moves on. Yields (lane, item, score) of what reaches the threshold."""
    at, end = index.postings_of[entry], index.postings_of[entry + 1]
    while len(at):
        item = index.item[at]
        order = np.lexsort((item, lane))
        lane, entry, at, end, item = (x[order] for x in (lane, entry, at, end, item))
        most = index.most[entry]
        start = np.r_[True, lane[1:] != lane[:-1]]
        total = np.cumsum(most)
        reached = total - (total - most)[np.flatnonzero(start)][np.cumsum(start) - 1] >= threshold - SLACK
        first = np.flatnonzero(reached & (start | ~np.r_[False, reached[:-1]]))
        pivot = np.full(lanes, -1)
        pivot[lane[first]] = item[first]
        live = pivot[lane] >= 0
        lane, entry, at, end, item = (x[live] for x in (lane, entry, at, end, item))
        goal = pivot[lane]
        behind = item < goal
        at[behind] = np.searchsorted(index.place, entry[behind] * BLOCK + goal[behind] % BLOCK)
        here = np.flatnonzero(at < end)
        here = here[index.item[at[here]] == goal[here]]
        here = here[np.argsort(entry[here], kind="stable")]  # one order of terms, one sum
        score = np.bincount(lane[here], index.impact[at[here]], lanes)
        found = np.flatnonzero((score >= threshold) & (pivot >= 0))
        yield found, pivot[found], score[found]
        at[here] += 1
        left = at < end
        lane, entry, at, end = (x[left] for x in (lane, entry, at, end))


def retrieve(index: Index, codes: np.ndarray, passage: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all passages and items whose score reaches the threshold. codes and passage: the terms
    of the passages' words. A passage without any pivot is left, and so is each block of items in which the maxima of the
    passage's terms don't reach the threshold together; in the blocks that live, pivots are sought."""
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    keys = np.unique(passage.astype(np.int64) * len(index.highest) + codes)  # each term counts once
    passage, codes = np.divmod(keys, len(index.highest))
    able = np.bincount(passage, index.highest[codes], n) >= threshold - SLACK
    keep = able[passage]
    passage, codes = passage[keep], codes[keep]
    blocks = int(index.block.max(initial=0)) + 1
    many = max(1, SUMS_AT_ONCE // blocks)
    for low in range(0, n, many):
        a, b = np.searchsorted(passage, (low, low + many))
        if a == b:
            continue
        first, last = index.entries_of[codes[a:b]], index.entries_of[codes[a:b] + 1]
        sizes = last - first
        entry = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        area = np.repeat(passage[a:b] - low, sizes) * blocks + index.block[entry]
        live = (np.bincount(area, index.most[entry], many * blocks) >= threshold - SLACK)[area]
        areas, lane = np.unique(area[live], return_inverse=True)
        for found, item, score in _wand(index, lane, entry[live], len(areas), threshold):
            out.append((areas[found] // blocks + low, item, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _leaks(index: Index, threshold: float):
    @lru_cache(4096)
    def parts(item: int) -> tuple[set, set]:
        return tuple(map(shingles, question_and_answer(index.texts[item])))

    def overlaps(item: int, words: list[str]) -> tuple[float, float]:
        found = shingles(words)
        out = []
        for part in parts(item):
            k = len(next(iter(part)))
            own = found if k == SHINGLE else set(zip(*(words[i:] for i in range(k)), strict=False))
            out.append(len(part & own) / len(part))
        return out[0], out[1]

    def run(ids: list, texts: list[list[str]]) -> Iterator[tuple]:
        """(doc, item, score, question's overlap, answer's overlap) of the best passage for each document and item."""
        step = index.step
        sizes = [max(1, -(-len(w) // step)) for w in texts]
        first = np.cumsum([0, *sizes])
        at = np.concatenate([np.arange(len(w)) // step + f for w, f in zip(texts, first[:-1], strict=True)])
        get = index.terms.get
        codes = np.concatenate([np.fromiter(map(get, w, repeat(0)), np.int64, len(w)) for w in texts])
        known = codes > 0
        codes, at = codes[known], at[known]
        # A passage is two neighbouring steps of words, so that each item lies whole in some passage.
        begins = np.zeros(first[-1] + 1, bool)
        begins[first] = True
        second = ~begins[at]
        passages, items, scores = retrieve(index, np.concatenate([codes, codes[second]]), np.concatenate([at, at[second] - 1]), first[-1], threshold)
        best: dict[tuple[int, int], tuple] = {}
        for p, i, s in zip(passages.tolist(), items.tolist(), scores.tolist(), strict=True):
            d = int(np.searchsorted(first, p, "right")) - 1
            start = (p - first[d]) * step
            q, a = overlaps(i, texts[d][start : start + 2 * step])
            if min(q, a) >= OVERLAP:
                best[d, i] = max(best.get((d, i), ()), (s, q, a))
        for (d, i), (s, q, a) in sorted(best.items()):
            yield ids[d], index.ids[i], min(1.0, s), q, a

    return run


def _searched(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _leaks(Index(**shared.value), threshold)
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            rows, ids, texts, count = [], [], [], 0
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(words_of(batch.column(1)[k].as_py() or ""))
                count += len(texts[-1])
                if count >= CHUNK_WORDS or k == batch.num_rows - 1:
                    rows += find(ids, texts)
                    ids, texts, count = [], [], 0
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of items: a row for each item and term."""
    for batch in batches:
        rows = []
        for i, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            rows += [(i, mark, len(words), t, tf) for t, tf in Counter(words).items()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "mark", "n", "term", "tf"])


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = RETRIEVE,
) -> DataFrame:
    """The test items that documents hold: (doc_id, item_id, score, question_overlap, answer_overlap), a row for each
    document and item, from the passage that matches best; doc_id goes under the name of id_col.

    The whole document is cut into passages of twice the longest item's length that overlap by half, so that an item in
    it lies whole in one of them. Each queries an inverted index of the items and retrieves all whose BM25 score reaches
    `threshold` of their score against themselves, by WAND with block maxima: see retrieve. What is retrieved is a leak
    if OVERLAP of the five-word shingles of its question and of its answer stand in the passage.

    Spark counts the postings: document frequencies, the mean and the greatest length are those of all items. An index of
    up to MOST_POSTINGS postings is broadcast, and the documents are read once and never shuffled; further postings take
    a pass each for as many. Scores and leaks are the same for any number of passes.

    Nulls: a null text holds nothing; items with a null id, a null text or no words are left out; null document ids pass
    through. Rows may repeat. Other columns are ignored. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    known = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
    known = small_batches(known).select(F.col(item_col).cast("long").alias("item_id"), F.sha1(binary(item_text_col)).alias("mark"), F.col(item_text_col).alias("text")).distinct()
    postings = stash(known.mapInArrow(_posted, "item_id long, mark string, n int, term string, tf int"), "postings")
    lengths = postings.groupBy("item_id", "mark").agg(F.first("n").alias("n"), F.count("*").alias("terms"))
    total = lengths.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest"), F.sum("terms").alias("postings")).first()
    counted = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term")
    passes = -(-(total.postings or 0) // MOST_POSTINGS) or 1
    base = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found: list[DataFrame] = []
    for p in range(passes):
        mine = F.pmod(F.xxhash64("item_id", "mark"), F.lit(passes)) == p
        part = [tuple(r) for r in known.where(mine).collect()]
        index = build_index(part, counted.where(mine).toArrow().to_pydict(), total["items"], total.mean or 1.0, total.longest or 0)
        shared = spark.sparkContext.broadcast(vars(index))
        leaks = base.mapInArrow(_searched(shared, threshold), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        if passes > 1:
            leaks = stash(leaks, "leaks")
            shared.destroy()
        found.append(leaks)
    release(postings)
    out = found[0]
    for leaks in found[1:]:
        out = out.union(leaks)
    return out.withColumnRenamed("doc_id", id_col)
