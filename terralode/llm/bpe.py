"""Byte-level BPE: the merges as a transducer that is determinised as texts ask for it, and decoding by a UTF-8 machine."""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralode.llm._shared import binary, small_batches

#: A worker's transducer starts anew beyond so many states (some 700 bytes each); of the words it remembers, those not met for
#: half of so many bytes of them go.
STATES, MEMORY_BYTES = 150_000, 96 << 20
#: So many pairs of tokens are remembered.
PAIRS = 500_000
#: Words of more bytes are not remembered.
LONGEST = 128
#: The pattern whose words can begin with one space and never hold another: a fixed value. Under it, a text may be cut
#: before every space that stands between two characters that aren't white space.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file, a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """From the bytes of a word to its tokens.

    Two tokens may stand side by side if merging their bytes gives just them; a word's tokens are then the only sequence
    whose neighbours all may. So each prefix of a word has one last token, and the machine reads byte by byte. Live
    are the positions from where the bytes read so far could still become the beginning of a longer token. A state is
    the longest such stretch and, for each live position, the tokens up to it that aren't written yet. What
    all live positions agree on is written at once, so that no more waits than the live positions, a token's
    length at most, disagree about. A word that is a token as a whole is that token, whatever its merges.

    States and moves are made when a word first needs them. `walk` holds the part of a move that hangs on the stretch
    alone: the next stretch, which positions stay live and which tokens may end there, longest first. The token written
    last is kept beside the state: a move whose token would follow it names that token as a guard, and
    the place of the next choice.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("every single byte must have a rank")
        self.ranks, self.tokens, self.far = ranks, {r: t for t, r in ranks.items()}, max(ranks.values()) + 1
        self.begun = {t[:n] for t in ranks for n in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        self.walk: dict[tuple[bytes, int], tuple] = {}
        self.states: dict[tuple, dict[int, tuple]] = {}
        self.reset()

    def reset(self) -> None:
        for moves in self.states.values():
            moves.clear()  # states lead to one another in circles
        self.states = {}
        self.begin = self.state((b"", ((),), True, ()))

    def state(self, key: tuple) -> dict[int, tuple]:
        """A state is the table of its moves by byte; under -1 it has its key."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = {-1: key}
        return found

    def history(self, token: int) -> tuple[list[int] | None, list[bytes], list[bytes]]:
        """How a token's bytes merge, always the leftmost pair of least rank: the rank of each merge, and the first and the
        last part before each and after the last; None for the ranks if the token isn't what its bytes merge to."""
        known = self.histories.get(token)
        if known is None:
            word, far, find = self.tokens[token], self.far, self.ranks.get
            parts = [word[i : i + 1] for i in range(len(word))]
            pairs = [find(x + y, far) for x, y in zip(parts, parts[1:])]
            merges, firsts, lasts = [], [parts[0]], [parts[-1]]
            while pairs and (least := min(pairs)) < far:
                i = pairs.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = find(parts[i - 1] + parts[i], far)
                if i < len(pairs):
                    pairs[i] = find(parts[i] + parts[i + 1], far)
                merges.append(least)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self.histories[token] = (None if len(parts) > 1 else [*merges, far]), firsts, lasts
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b merge to just them; a is none at the beginning of a word. Both merge on their
        own in the order of the ranks, the left one first in a tie, until a pair across their border comes first."""
        known = self.pairs.get(a * self.far + b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a * self.far + b] = self.apart(a, b)
        return known

    def apart(self, a: int, b: int) -> bool:
        right, firsts, _ = self.history(b)
        if a == _NONE or right is None:
            return right is not None
        left, _, lasts = self.history(a)
        find, far, i, j = self.ranks.get, self.far, 0, 0
        while True:
            across = find(lasts[i] + firsts[j], far)
            if across < left[i] and across <= right[j]:
                return False
            if left[i] == right[j] == far:
                return True
            if left[i] <= right[j]:
                i += 1
            else:
                j += 1

    def stretched(self, stretch: bytes, byte: int) -> tuple:
        """(next stretch, live positions that stay, (live position, token) that end here); positions are places among the
        live ones, that of the longest stretch first."""
        live = [stretch[i:] for i in range(len(stretch)) if not i or stretch[i:] in self.begun] + [b""] if stretch else [b""]
        longer = [s + bytes((byte,)) for s in live]
        stay = tuple(i for i, s in enumerate(longer) if s in self.begun)
        ends = tuple((i, r) for i, s in enumerate(longer) if (r := self.ranks.get(s)) is not None)
        found = self.walk[stretch, byte] = longer[stay[0]] if stay else b"", stay, ends
        return found

    def move(self, here: dict[int, tuple], byte: int, at: int = 0) -> tuple:
        """(next state, tokens written, guard, number of the next choice) for the choices from number `at` on."""
        stretch, waiting, whole, _ = here[-1]
        after, stay, ends = self.walk.get((stretch, byte)) or self.stretched(stretch, byte)
        for choice in range(at, len(ends)):
            i, token = ends[choice]
            before = waiting[i]
            if not before or self.beside(before[-1], token):
                break
        path, guard = (*before, token), token if not before and choice + 1 < len(ends) else None
        then = [waiting[i] for i in stay]
        then.append(path)
        final = (ends[0][1],) if whole and ends[0][0] == 0 else path
        least, most, n = min(then), max(then), 0
        if final != path:
            least = ()  # all waits: if the word ends here it is a token that its bytes don't merge to
        for x, y in zip(least, most):
            if x != y:
                break
            n += 1
        if n:
            then, final = [t[n:] for t in then], final[n:]
        reached = self.state((after, tuple(then), whole and stay[:1] == (0,), final))
        found = here[at << 8 | byte] = reached, path[:n], guard, (choice + 1) << 8 | byte
        return found

    def __call__(self, word: bytes) -> list[int]:
        if len(self.states) > STATES:
            self.reset()
        here, last, out, pairs, far = self.begin, _NONE, [], self.pairs, self.far
        for byte in word:
            reached, written, guard, other = here.get(byte) or self.move(here, byte)
            while guard is not None:
                fits = pairs.get(last * far + guard)
                if fits or fits is None and self.beside(last, guard):
                    break
                reached, written, guard, other = here.get(other) or self.move(here, byte, other >> 8)
            here = reached
            if written:
                out += written
                last = written[-1]
        out += here[-1][3]
        return out


class Encoder:
    """Ids of whole texts. Each match of the pattern goes through the transducer by itself. Short matches are remembered,
    and so are the pieces between spaces, by what follows the space."""

    def __init__(self, ranks: str, pattern: str) -> None:
        self.run, self.parts, self.spaced = Transducer(read_ranks(ranks)), regex.compile(pattern).findall, pattern == SPACED
        self.pieces, self.words, self.older, self.size = {}, {}, ({}, {}), 0

    def remember(self, memory: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= LONGEST:
            memory[key] = ids
            self.size += 200 + 2 * len(key) + len(ids)
        return ids

    def match(self, match: str) -> bytes:
        spaced = match[0] == " "
        memory, key = (self.pieces, match[1:]) if spaced else (self.words, match)
        if (ids := memory.get(key)) is None:
            ids = self.older[not spaced].get(key) or array("i", self.run(match.encode())).tobytes()
            self.remember(memory, key, ids)
        return ids

    def piece(self, after: str) -> bytes:
        """The ids of a space and what follows it. Latin letters are one match."""
        if after.isalpha() and max(after) < "ɐ":
            return self.match(" " + after)
        if ids := self.older[0].get(after):
            return self.remember(self.pieces, after, ids)
        return self.remember(self.pieces, after, b"".join(map(self.match, self.parts(" " + after))))

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if self.size > MEMORY_BYTES // 2:
            self.pieces, self.words, self.older, self.size = {}, {}, (self.pieces, self.words), 0
        first, *rest = text.split(" ")
        if not self.spaced or not first or first[-1].isspace():
            return b"".join(map(self.match, self.parts(text)))
        ids = list(map(self.pieces.get, rest))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    after = rest[i]
                    if not after or after[0].isspace() or after[-1].isspace():
                        return b"".join(map(self.match, self.parts(text)))  # white space beside a space: no cut is sure there
                    ids[i] = self.piece(after)
        return b"".join([*map(self.match, self.parts(first)), *ids])


def _utf8_needs() -> list[tuple[int, int, int]]:
    """For each lead byte: how many bytes follow, and the range of the first of them; (-1, 0, 0) if it can't lead."""
    needs = [(0, 0, 0)] * 0x80 + [(-1, 0, 0)] * 0x42 + [(1, 0x80, 0xBF)] * 0x1E + [(2, 0x80, 0xBF)] * 0x10 + [(3, 0x80, 0xBF)] * 5 + [(-1, 0, 0)] * 11
    needs[0xE0], needs[0xED], needs[0xF0], needs[0xF4] = (2, 0xA0, 0xBF), (2, 0x80, 0x9F), (3, 0x90, 0xBF), (3, 0x80, 0x8F)
    return needs


_NEEDS = _utf8_needs()


def utf8_step(waiting: bytes, more: bytes) -> tuple[str, bytes]:
    """The incremental machine: what is complete once `more` comes after the `waiting` bytes of a broken character, and
    what waits then. A byte that can't go on ends the broken character as U+FFFD and begins anew."""
    out, held = [], b""
    for byte in waiting + more:
        if held:
            need, low, high = _NEEDS[held[0]]
            if len(held) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                held += bytes((byte,))
                if len(held) > need:
                    out.append(held.decode())
                    held = b""
                continue
            out.append("�")
            held = b""
        need = _NEEDS[byte][0]
        if need > 0:
            held = bytes((byte,))
        else:
            out.append("�" if need else chr(byte))
    return "".join(out), held


class Decoder:
    """Text of ids, token by token: whole characters are written as soon as they are complete, also across tokens."""

    def __init__(self, ranks: str) -> None:
        self.tokens = {r: t for t, r in read_ranks(ranks).items()}
        self.whole = np.zeros(max(self.tokens) + 1, bool)
        self.text, self.steps = [None] * len(self.whole), {}
        for rank, token in self.tokens.items():
            text, held = utf8_step(b"", token)
            if not held and "�" not in text:
                self.whole[rank], self.text[rank] = True, text

    def step(self, waiting: bytes, rank: int) -> tuple[str, bytes]:
        found = self.steps.get((waiting, rank))
        if found is None:
            if rank not in self.tokens:
                raise ValueError(f"no token has id {rank}")
            found = self.steps[waiting, rank] = utf8_step(waiting, self.tokens[rank])
        return found

    def __call__(self, ids: np.ndarray) -> str:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.whole):
            raise ValueError(f"no token has id {ids.min() if ids.min() < 0 else ids.max()}")
        out, at, waiting = [], 0, b""
        for i in (*np.flatnonzero(~self.whole[ids]).tolist(), len(ids)):
            if at < i:
                out.append("�" if waiting else "")
                out += map(self.text.__getitem__, ids[at:i].tolist())
                waiting = b""
            if i < len(ids):
                text, waiting = self.step(waiting, int(ids[i]))
                out.append(text)
            at = i + 1
        return "".join(out) + ("�" if waiting else "")


@lru_cache(maxsize=1)
def encoder_of(ranks: str, pattern: str) -> Encoder:
    """A worker compiles a vocabulary once, and keeps the bounded memory of its last one for later tasks."""
    return Encoder(ranks, pattern)


@lru_cache(maxsize=1)
def decoder_of(ranks: str) -> Decoder:
    return Decoder(ranks)


def _encoded(ranks: str, pattern: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(ranks, pattern)
        gc.disable()  # nothing here makes circles, and collections would visit every state
        try:
            for batch in batches:
                ids = [encode((t.as_py() or b"").decode("utf-8", "replace")) for t in batch.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[name, "ids"])
        finally:
            gc.enable()

    return run


def _decoded(ranks: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder_of(ranks)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                values = ids.values
                if values is not None and values.null_count:
                    raise ValueError("an id is null")
                texts.append(None if values is None else decode(values.to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[name, "ids", "text"])

    return run


def _like(df: DataFrame, column: str) -> T.StructField:
    return T.StructField(column, df.schema[column].dataType)


def encode_texts(docs: DataFrame, ranks: str, pattern: str = SPACED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids (array of int) of every whole text: (id_col, ids), as ranks and pattern have it, without special tokens.

    ranks is the path of a file of base64 tokens and ranks, which must be there on every executor and have all single
    bytes. Nothing is shuffled; a task holds the text at hand, and a worker a bounded memory of words and states
    (MEMORY_BYTES, STATES), which changes no result.

    Nulls: a null or empty text has no ids (an empty array); a null id is kept as it is. Bytes that aren't UTF-8 are read
    as U+FFFD. Repeated rows stay. Other columns are ignored and may have any names. An empty table gives an empty result.
    """
    base = small_batches(docs).select(F.col(id_col), binary(text_col).alias("bytes"))
    schema = T.StructType([_like(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return base.mapInArrow(_encoded(ranks, pattern, id_col), schema)


def decode_ids(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of ids: (id_col, ids, text). Characters may lie across tokens; bytes that make no character are
    U+FFFD, as in Python's "replace".

    Nulls: null ids have a null text, no ids the empty text; a null or unknown id among them raises ValueError. Other
    columns are ignored. Nothing is shuffled. An empty table gives an empty result.
    """
    schema = T.StructType([_like(encoded, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])
    base = small_batches(encoded).select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return base.mapInArrow(_decoded(ranks, id_col), schema)
