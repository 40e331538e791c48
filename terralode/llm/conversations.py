"""Repair of conversations: the cheapest edits that make user and assistant alternate, found while rows stream by."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralode.llm._shared import scratch_dir, small_batches

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that wait undecided in memory, and their bytes; more are spilled with their backpointers.
WINDOW_ROWS, WINDOW_BYTES = 16_384, 8 << 20
#: States: nothing kept yet, after a system row, after a user row, after an assistant row; conversations may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: How much dearer the rest can be from the second state than from the first: what a row more or less costs there.
_DEARER = {
    (START, ASSISTANT): DELETE, (START, USER): DELETE + INSERT, (SYSTEM, ASSISTANT): 0, (SYSTEM, USER): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT,
}
_EDIT = "conv_id long, seq long, edit string, turn long, role string, text string, fault string, cost long, gap long, illegal boolean"
_NAMES = [c.split()[0] for c in _EDIT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in _EDIT.split(", ")]
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) after the damage that crc32 of `conv_id:turn` modulo 20 chooses: 0 loses
    the row (it stays, marked as lost), 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes its role user. Nulls
    are one space: in the key, as role and as text."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def fault(text: Column, seen: Column) -> Column:
    """A row's first fault: blank, duplicate (seen before), truncated (the last character isn't one of `.!?`), or null."""
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    return F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")


@lru_cache(maxsize=1 << 16)
def advance(costs: tuple[int | None, ...], order: tuple[int, ...], initial: str, kind: str | None) -> tuple:
    """One row: (least cost taken off, costs by state, order of the states' edits, backpointers by state).

    costs are those of the best edits that end in each state with the row before, and order the states by these edits
    as text, least first. Edits that end with a row each, and not with an insertion, are never the beginning of one another, so
    that the best edits to a state come from (cost, place of the state before, edits of this row). States that can't be
    on a cheapest way any more go. A backpointer is (state before, edits).
    """
    found: dict[int, tuple] = {}
    for place, state in enumerate(order):
        at, before, cost = state, "", costs[state]
        for _ in range(3):
            steps = [(at, "D", DELETE)]
            if kind not in ("blank", "duplicate"):
                extra = TRUNCATED if kind == "truncated" else 0
                after = _INSERTED[at]
                if initial == "s" and at == START:
                    steps.append((SYSTEM, "K", extra))
                elif initial == _ROLES[after][0]:
                    steps.append((after, "K", extra))
                steps.append((after, "R", REROLE + extra))
            for to, edit, price in steps:
                new = cost + price, place, before + edit, state
                if to not in found or new < found[to]:
                    found[to] = new
            at, before, cost = _INSERTED[at], before + "I", cost + INSERT
    for (one, two), dearer in _DEARER.items():
        if one in found and two in found and found[two][0] + dearer < found[one][0]:
            del found[one]
    least = min(f[0] for f in found.values())
    new = tuple(found[s][0] - least if s in found else None for s in range(4))
    ranks = tuple(sorted(found, key=lambda s: found[s][1:3]))
    return least, new, ranks, {s: (f[3], f[2]) for s, f in found.items()}


def ending(costs: tuple[int | None, ...], order: tuple[int, ...]) -> tuple[int, str]:
    """The last row's state of the cheapest edits, and the insertions after it."""
    best = None
    for place, state in enumerate(order):
        at, after = state, ""
        while at not in ENDS:
            at, after = _INSERTED[at], after + "I"
        if best is None or (costs[state] + INSERT * len(after), place) < best[:2]:
            best = costs[state] + INSERT * len(after), place, state, after
    return best[2], best[3]


class _Spill:
    """Windows of undecided rows of one conversation, as Arrow files of this try of the task in the shared folder."""

    def __init__(self, folder: str) -> None:
        self.files, root = fs.FileSystem.from_uri(folder)
        self.root, self.count = f"{root}/{uuid.uuid4().hex}", 0
        self.files.create_dir(self.root, recursive=True)

    def put(self, rows: list[tuple], pointers: list[dict]) -> None:
        columns = [*zip(*rows, strict=True)]
        packed = bytearray()
        for p in pointers:  # a byte for each state: state before, number of insertions, edit; 255 for none
            packed += bytes(p[s][0] | (len(p[s][1]) - 1) << 2 | "DKR".index(p[s][1][-1]) << 4 if s in p else 255 for s in range(4))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        for name, batch in (("rows", pa.record_batch(arrays, names=list("abcdef"))), ("back", pa.record_batch([pa.array([bytes(packed)])], names=["p"]))):
            with self.files.open_output_stream(f"{self.root}/{name}-{self.count}", compression=None) as out, pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)
        self.count += 1

    def get(self, name: str) -> pa.RecordBatch:
        with self.files.open_input_stream(f"{self.root}/{name}", compression=None) as f, pa.ipc.open_stream(f) as reader:
            return reader.read_next_batch()

    def settle(self, state: int) -> Iterator[tuple[list[tuple], list[str]]]:
        """Rows and their edits, window by window, once the state after the last is known: backpointers are followed from the
        last window to the first, then the rows are read in order."""
        for number in reversed(range(self.count)):
            packed, chosen = self.get(f"back-{number}").column(0)[0].as_py(), bytearray()
            for at in reversed(range(0, len(packed), 4)):
                chosen.append(packed[at + state])
                state = chosen[-1] & 3
            with self.files.open_output_stream(f"{self.root}/edits-{number}", compression=None) as out:
                out.write(bytes(reversed(chosen)))
        for number in range(self.count):
            with self.files.open_input_stream(f"{self.root}/edits-{number}", compression=None) as f:
                edits = ["I" * (b >> 2 & 3) + "DKR"[b >> 4] for b in f.read()]
            yield [*zip(*self.get(f"rows-{number}").to_pydict().values(), strict=True)], edits
        self.files.delete_dir(self.root)


class _Conversation:
    """The edits of one conversation whose rows come in order. What all states' backpointers agree on is written;
    what they don't agree on waits, and is spilled beyond a window."""

    def __init__(self, conv_id: int | None, folder: str) -> None:
        self.conv_id, self.folder, self.spill = conv_id, folder, None
        self.costs, self.order = (0, None, None, None), (START,)
        self.rows, self.pointers, self.bytes, self.check = [], [], 0, 64
        self.state, self.seq, self.turn, self.before, self.empty = START, 0, None, None, True

    def add(self, turn: int | None, role: str, text: str, kind: str | None) -> Iterator[tuple]:
        gap = max(turn - self.turn - 1, 0) if turn is not None and self.turn is not None else 0
        initial = role[:1]
        illegal = self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.turn, self.before = self.turn if turn is None else turn, initial
        _, self.costs, self.order, back = advance(self.costs, self.order, initial if initial in ("s", "u", "a") else "", kind)
        self.rows.append((turn, role, text, kind, gap, illegal))
        self.pointers.append(back)
        self.bytes += len(text) + len(role)
        if len(self.rows) >= self.check or self.bytes >= WINDOW_BYTES:
            yield from self.decide()

    def decide(self) -> Iterator[tuple]:
        """Writes the rows up to the last one after which all ways are in one state; spills if none is and too many wait."""
        at, states = len(self.rows), set(self.order)
        while len(states) > 1 and at:
            at -= 1
            states = {self.pointers[at][s][0] for s in states}
        if at and len(states) == 1:
            yield from self.write(at, states.pop())
        if len(self.rows) >= WINDOW_ROWS or self.bytes >= WINDOW_BYTES:
            self.spill = self.spill or _Spill(self.folder)
            self.spill.put(self.rows, self.pointers)
            self.rows, self.pointers, self.bytes = [], [], 0
        self.check = max(64, min(2 * len(self.rows), WINDOW_ROWS))

    def write(self, count: int, state: int) -> Iterator[tuple]:
        """The first `count` waiting rows, after which the conversation is in `state`, and what was spilled before them."""
        edits = []
        for i in reversed(range(count)):
            state, edit = self.pointers[i][state]
            edits.append(edit)
        if self.spill:
            for rows, chosen in self.spill.settle(state):
                yield from self.edited(rows, chosen)
            self.spill = None
        yield from self.edited(self.rows[:count], edits[::-1])
        self.rows, self.pointers = self.rows[count:], self.pointers[count:]
        self.bytes = sum(len(r[1]) + len(r[2]) for r in self.rows)

    def row(self, edit: str, *values) -> tuple:
        self.seq += 1
        self.empty = False
        return self.conv_id, self.seq - 1, edit, *values

    def insert(self) -> tuple:
        self.state = _INSERTED[self.state]
        return self.row("I", None, _ROLES[self.state], "", None, INSERT, 0, False)

    def edited(self, rows: list[tuple], edits: list[str]) -> Iterator[tuple]:
        for (turn, role, text, kind, gap, illegal), edit in zip(rows, edits, strict=True):
            for _ in edit[1:]:
                yield self.insert()
            if edit[-1] == "D":
                yield self.row("D", turn, role, text, kind, DELETE, gap, illegal)
                continue
            self.state = SYSTEM if edit[-1] == "K" and role[:1] == "s" else _INSERTED[self.state]
            role, cost = (role, 0) if edit[-1] == "K" else (_ROLES[self.state], REROLE)
            yield self.row(edit[-1], turn, role, text, kind, cost + TRUNCATED * (kind == "truncated"), gap, illegal)

    def end(self) -> Iterator[tuple]:
        state, after = ending(self.costs, self.order)
        yield from self.write(len(self.rows), state)
        for _ in after:
            yield self.insert()
        if self.empty:
            yield self.row(None, *[None] * 7)


def _edits(folder: str):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        talk = None
        for batch in batches:
            for conv_id, turn, role, text, lost, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if talk is None or conv_id != talk.conv_id:
                    yield from talk.end() if talk else ()
                    talk = _Conversation(conv_id, folder)
                if not lost:
                    yield from talk.add(turn, role, text, kind)
        yield from talk.end() if talk else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in stream(batches):
            rows.append(row)
            size += 100 + len(row[5] or "")
            if size >= 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation, a row for each edit, by conversation and in order within a partition:
    (conv_id, seq, edit, turn, role, text, fault, cost, gap, illegal).

    rows has conv_id, turn, role, text and, where it is known, lost: such rows are gone, but their conversations are still
    reported. An edit is K (keep), R (make the role user or assistant), D (delete; a must for blank and duplicate rows) or I
    (insert a user or assistant row of empty text). What is kept, rewritten and inserted is empty, or maybe a system row
    and then user and assistant in turn. Of edits of equal cost the least text of their letters wins. role and text are those after the
    edit (before it, of a deleted row); gap counts the turns missing before the row, illegal tells that it may not
    follow the one before. A conversation without rows has one row without an edit.

    Rows are shuffled by conversation once; sorting by turn, role and text, nulls first, makes repeated rows adjacent, and
    another sort of the same partitions finds what was seen before. Then rows stream through Python, with the costs of four states carried from
    batch to batch. Undecided rows wait: WINDOW_ROWS of them or WINDOW_BYTES, the rest is spilled with four bytes of
    backpointers for a row into files in the shared folder that go when they are settled. So a conversation needs bounded memory, though one task
    reads all of it, as its order asks.

    Nulls: null role and text are one space; a null conv_id is a conversation; null turns come first and make no gap. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in rows.columns else F.lit(False)
    base = small_batches(rows).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost"),
    )
    base = base.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    base = base.withColumn("fault", fault(F.col("text"), again)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return base.mapInArrow(_edits(f"{scratch_dir(spark)}/terralode/backpointers"), _EDIT)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, faults = [c.split()[0] for c in _REPORT.split(", ")], ("blank", "duplicate", "truncated")
    now, out, begun = None, [], False

    def closed() -> tuple:
        conv_id, gaps, counts, illegal, cost, audit, digest = now
        return conv_id, gaps, *(counts[f] for f in faults), illegal, cost, bytes(audit).decode(), digest.hexdigest()

    def table() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for conv_id, seq, edit, _, role, text, kind, cost, gap, illegal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seq == 0:
                if now:
                    out.append(closed())
                now = [conv_id, 0, dict.fromkeys(faults, 0), 0, 0, bytearray(), hashlib.sha256()]
                begun = False
            if edit is None:
                continue
            now[1] += gap
            now[3] += illegal
            now[4] += cost
            now[5] += edit.encode()
            if kind:
                now[2][kind] += 1
            if edit != "D":
                now[6].update((("\n" if begun else "") + f"{role}:{text}").encode())
                begun = True
        if len(out) >= 1024:
            yield table()
            out = []
    if now:
        out.append(closed())
    if out:
        yield table()


def report_repairs(edits: DataFrame) -> DataFrame:
    """A row for each conversation of repair_conversations' result, as it comes from there (each conversation in one partition
    and in order): (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256). audit has the edits'
    letters; the digest is that of the repaired `role:text` joined by newlines, hashed as they stream by."""
    return edits.mapInArrow(_reports, _REPORT)
