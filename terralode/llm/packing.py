"""Packing of token sequences for training: hierarchical, with several context sizes."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralode.llm._shared import binary, small_batches

#: Ids of distinct words of about so many bytes are remembered in a task; then the memory starts anew.
MEMORY_BYTES = 64 << 20
#: Tokens that wait in a task for windows, over which the tiers are packed: room to choose, and the bound of its memory.
POOL = 1 << 16
_PIECE = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
#: How the kind of vocabulary that WordIds takes apart itself parts words: fixed values, which the file must have.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_PARTS = regex.compile(_PATTERN)
#: Words of printable Latin characters, which no normal form changes, go to the merges directly.
_PLAIN = regex.compile("[\u0021-\u007e\u00a1-\u024f]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the rest
    follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def by_words(tokenizer: Tokenizer) -> bool:
    """Whether a vocabulary is of the kind in which white space always ends a token and is dropped, and whose words part
    and merge as WordIds does it."""
    parts = json.loads(tokenizer.to_str())
    model = parts["model"]
    return (
        (parts["normalizer"] or {}).get("normalizers") == _NORMALIZERS and (parts["pre_tokenizer"] or {}).get("pretokenizers") == _PRETOKENIZERS
        and model["type"] == "BPE" and not model["dropout"] and model["continuing_subword_prefix"] is None and all("<|" in t["content"] for t in parts["added_tokens"])
    )


class WordIds:
    """Token ids of texts. White space always ends a token of most word vocabularies and is dropped, so that a text's
    ids are those of its white-space separated words in turn; each distinct word is encoded once. Texts of other
    vocabularies are encoded whole."""

    def __init__(self, tokenizer: str, end: int) -> None:
        self.tokenizer, self.end, self.known, self.size = Tokenizer.from_file(tokenizer), end, {}, 0
        self.by_words = by_words(self.tokenizer)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def learn(self, words: set[bytes]) -> None:
        odd, merge, letters, known, size = [], self.model.tokenize, self.letters, self.known, 0
        for word in words:
            text = word.decode()
            if text.isascii() and text.isalpha():
                ids = [t.id for t in merge(text.lower())]
            elif "<|" in text or not _PLAIN.fullmatch(text):
                odd.append(word)
                continue
            else:
                parts = _PARTS.findall(text.lower())
                if not text.isascii():
                    parts = ["".join(map(letters.__getitem__, p.encode())) for p in parts]
                ids = [t.id for p in parts for t in merge(p)]
            known[word] = array("I", ids).tobytes()
            size += len(word) + 4 * len(ids)
        for word, e in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            known[word] = array("I", e.ids).tobytes()
            size += len(word) + 4 * len(e.ids)
        self.size += size + 160 * len(words)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text, with the end id after them."""
        if not self.by_words:
            encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array([*e.ids, self.end], "<u4") for e in encoded]
        if self.size > MEMORY_BYTES:
            self.known, self.size = {}, 0
        split = [t.split() for t in texts]
        self.learn(set().union(*split) - self.known.keys())
        end, ids = array("I", [self.end]).tobytes(), self.known.__getitem__
        return [np.frombuffer(b"".join([*map(ids, words), end]), "<u4") for words in split]


class _Tiers:
    """Packs the documents of one partition. A document fills windows of the longest tier while it can; the rest of it
    goes to the least tier that holds it. When enough tokens wait, each tier is packed, longest first: a waiting piece
    opens a window, the largest pieces of shorter tiers that fit fill its gap, and the next one is cut to close it.

    Sequences of a partition are dealt in turn into step groups of the same number of tokens, so that steps balance: each
    has group * longest, but for the last of a partition, which has what is left.
    """

    def __init__(self, part: int, sizes: tuple[int, ...], group: int) -> None:
        self.part, self.sizes, self.group = part, sorted(sizes, reverse=True), group
        self.waiting: dict[int, list[list]] = {s: [] for s in self.sizes}
        self.next, self.held, self.tokens = part << 33, 0, 0

    def close(self, pieces: list[list], size: int) -> list[list]:
        step = (self.part << 33) + self.tokens // (self.group * self.sizes[0])
        offsets = np.cumsum([0, *(p[2] for p in pieces[:-1])]).tolist()
        self.tokens += size
        self.next += 1
        return [[*p, self.next - 1, o, size, step] for o, p in zip(offsets, pieces, strict=True)]

    def wait(self, piece: list) -> None:
        self.waiting[next(s for s in reversed(self.sizes) if s >= piece[2])].append(piece)
        self.held += piece[2]

    def take(self, size: int) -> list:
        self.held -= (piece := self.waiting[size].pop())[2]
        return piece

    def add(self, i: int | None, ids: np.ndarray) -> list[list]:
        out, at, n, longest = [], 0, len(ids), self.sizes[0]
        while n - at >= longest:
            out += self.close([[i, at, longest, ids[at : at + longest].tobytes(), n]], longest)
            at += longest
        if at < n:
            self.wait([i, at, n - at, ids[at:].tobytes(), n])
        return out + (self.pack() if self.held >= POOL else [])

    def fill(self, size: int) -> tuple[list[list], int]:
        """A window of this tier, and its gap where nothing is left to close it with."""
        window = [self.take(size)]
        gap = size - window[0][2]
        for tier in self.sizes:
            while gap and tier < size and self.waiting[tier] and self.waiting[tier][-1][2] <= gap:
                window.append(self.take(tier))
                gap -= window[-1][2]
        while gap and (tier := next((t for t in reversed(self.sizes) if t <= size and self.waiting[t]), None)):
            i, start, length, ids, n = self.take(tier)
            part = min(gap, length)
            window.append([i, start, part, ids[: 4 * part], n])
            gap -= part
            if part < length:
                self.wait([i, start + part, length - part, ids[4 * part :], n])
        return window, gap

    def pack(self) -> list[list]:
        out: list[list] = []
        for size in self.sizes:
            while self.waiting[size]:
                window, gap = self.fill(size)
                if gap:
                    for piece in window:
                        self.wait(piece)
                    return out
                out += self.close(window, size)
        return out

    def finish(self) -> list[list]:
        """What cannot fill a window any more is cut at the powers of two that its length is the sum of: no padding."""
        out = self.pack()
        rest = [p for s in self.sizes for p in self.waiting[s]]
        left = sum(p[2] for p in rest)
        while left:
            size = min(1 << (left.bit_length() - 1), self.sizes[0])
            pieces, got = [], 0
            while got < size:
                i, start, length, ids, n = rest.pop()
                part = min(length, size - got)
                pieces.append([i, start, part, ids[: 4 * part], n])
                if part < length:
                    rest.append([i, start + part, length - part, ids[4 * part :], n])
                got += part
            out += self.close(pieces, size)
            left -= size
        return out


def _packed(tokenizer: str, end: int, sizes: tuple[int, ...], group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tiers = WordIds(tokenizer, end), None
        names = [x.split()[0] for x in _PIECE.split(", ")]

        def table(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names, columns, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, ids, texts = (c.to_pylist() for c in batch.columns)
            tiers = tiers or _Tiers(parts[0], sizes, group)
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and size < 1 << 20:
                    size += len(texts[stop] or b"")
                    stop += 1
                rows = [p for i, t in zip(ids[at:stop], encode([t or b"" for t in texts[at:stop]]), strict=True) for p in tiers.add(i, t)]
                at = stop
                if rows:
                    yield table(rows)
        if tiers and (rows := tiers.finish()):
            yield table(rows)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    sizes: tuple[int, ...] = (2048, 1024, 512, 256), group: int = 64,
) -> DataFrame:
    """Packs all documents into training sequences. Returns a row for each piece of a document: (id, start, length,
    ids, doc_tokens, sequence_id, offset, tier, step_group); ids are little-endian unsigned 32-bit, a sequence's pieces
    have its sequence_id, and their offsets run on from 0; tier is the sequence's length.

    tokenizer is the path of a file of the tokenizers library; it must be there on every executor. Where its settings
    are those of a vocabulary of words, distinct words are encoded once, else whole texts. sizes are the context sizes, powers of two. Documents are tokenised and packed where they are read:
    nothing is shuffled, and a task holds some pieces that wait for windows, and the document at hand. Partitions are input
    splits, which a retried task reads again alike. A partition's last tokens are cut at powers of two, which need no
    padding, so that there is none at all.

    Nulls: a null or empty text is the end id alone; a null id is kept as it is. Repeated rows are packed each. Other
    columns are ignored. An empty table gives an empty result.
    """
    if any(s & (s - 1) or s < 1 for s in sizes):
        raise ValueError("sizes must be powers of two")
    base = small_batches(docs).select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("id"), binary(text_col).alias("text"))
    out = base.mapInArrow(_packed(tokenizer, end_id, sizes, group), _PIECE)
    return out.withColumnRenamed("id", id_col)
