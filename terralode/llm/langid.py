"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.llm._shared import small_batches

#: n-grams of a profile, and of a document that are compared with it.
DEPTH = 300
#: About so many labelled rows of each language are learned from.
LEARN_ROWS = 4000
#: So many languages at most can be learned; more labels than that are an error of the input.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: n-grams that are counted at once.
GRAMS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Profiles:
    """languages in order, the n-grams of all profiles in order, and each one's rank in each language (DEPTH: absent)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    depth: int


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _grams(text: str, alpha: np.ndarray) -> np.ndarray:
    """The 1- to 3-grams of the lower-cased letters, as integers; all else is one gap between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(alpha[codes], codes + 1, 1).astype(np.uint64)
    codes = np.concatenate([[np.uint64(1)], codes, [np.uint64(1)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 1) | (codes[:-1] != 1)])]
    if len(codes) < 3:
        return codes[:0]
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    three = (two[:-1] << np.uint64(21)) | codes[2:]
    return np.concatenate([codes[codes != 1], two, three])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language in some texts."""
    alpha = _letters()

    def table(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for lang, text in zip(*batch.columns, strict=True):
            held.setdefault(lang.as_py(), []).append(grams := _grams(text.as_py(), alpha))
            size += len(grams)
            if size >= GRAMS_AT_ONCE:
                yield from (table(*x) for x in held.items())
                held, size = {}, 0
        yield from (table(*x) for x in held.items())


def _judged(profiles: Profiles, at_text: int, kept: int):
    """Of batches that have the text in one column; the first columns are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alpha, depth = _letters(), profiles.depth
        place = np.arange(depth)[:, None]
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at_text):
                grams, n = np.unique(_grams(text.as_py() or "", alpha), return_counts=True)
                if not len(grams) or not profiles.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                top = grams[np.argsort(-n, kind="stable")[:depth]].astype(np.int64)
                at = np.minimum(np.searchsorted(profiles.grams, top), len(profiles.grams) - 1)
                ranks = np.where((profiles.grams[at] == top)[:, None], profiles.ranks[at], depth)
                apart = np.where(ranks == depth, depth, np.abs(ranks - place[: len(top)])).sum(axis=0)
                best = int(apart.argmin())
                langs.append(profiles.languages[best])
                scores.append(1 - float(apart[best]) / (depth * len(top)))
            columns = [*batch.columns[:kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def learn_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, rows: int = LEARN_ROWS) -> Profiles:
    """The most frequent n-grams of each language, by falling count, ties by code points.

    Learns from a bounded sample: about `rows` rows of each language, those whose id hashes lowest, or all where there
    are fewer; whole texts. Rows with a null label, text or id aren't learned from. The driver gets `depth` rows for
    each language. An empty table gives no languages.
    """
    rows_of = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows_of.groupBy(F.col(lang_col)).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.when(F.lit(False), 1.0)
    for lang, n in sizes.items():
        share = share.when(F.col(lang_col) == lang, min(1.0, rows / n))
    luck = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    sample = rows_of.where(luck < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).collect()
    languages = sorted({r.lang for r in top})
    grams = np.array(sorted({r.gram for r in top}), np.int64)
    ranks = np.full((len(grams), len(languages)), depth, np.int64)
    for r in top:
        ranks[np.searchsorted(grams, r.gram), languages.index(r.lang)] = r.rank - 1
    return Profiles(languages, grams, ranks, depth)


def identify_language(docs: DataFrame, profiles: Profiles, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of each row with lang_pred and score. A document's most frequent n-grams are ranked, and the
    language whose ranks differ least in sum wins (a missing n-gram costs `depth`; ties go to the first name). score
    is 1 less that sum over the greatest possible one. No shuffle; each row stands alone.

    A text that is null or has no letter is `und` with score 0, as is everything where no language was learned. Whole
    texts are judged. Rows may repeat; other columns may have any names but lang_pred and score if kept.
    """
    picked = small_batches(docs).select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema), "lang_pred string", "score double"])
    # Each text goes to Python once.
    at = next((i for i, k in enumerate(keep) if isinstance(k, str) and k == text_col), None)
    rows = picked if at is not None else docs.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(_judged(profiles, len(keep) if at is None else at, len(keep)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: every fifth, by the checksum of its id. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
