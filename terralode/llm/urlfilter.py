"""URL rules by a bit-parallel wildcard automaton: all glob patterns at once, one Shift-And step for each byte."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralode.llm._shared import small_batches

U = np.uint64
#: URLs that are stepped through together.
BLOCK = 8192


class GlobSet:
    """Many globs packed into multiword bit masks. `*` stands for any bytes, `?` for one, and a backslash makes the next
    byte stand for itself; a glob matches whole strings.

    Each byte or `?` of a glob is one state, and its start another; a `*` lets the state before it loop. One step is
    ((D << 1) & reach[byte]) | (D & loops), with carries from word to word, for a block of strings at a time.
    """

    def __init__(self, globs: list[bytes]) -> None:
        states: list[tuple[int | None, bool]] = []  # the byte that enters a state (None: any), whether it loops
        starts, self.ends = [], []
        for glob in globs:
            starts.append(len(states))
            states.append((-1, False))
            at = 0
            while at < len(glob):
                c, at = glob[at], at + 1
                if c == ord("*"):
                    states[-1] = (states[-1][0], True)
                elif c == ord("\\") and at < len(glob):
                    states.append((glob[at], False))
                    at += 1
                else:
                    states.append((None if c == ord("?") else c, False))
            self.ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.reach, self.loops, self.start = np.zeros((256, self.words), U), np.zeros(self.words, U), np.zeros(self.words, U)
        for i, (enter, loop) in enumerate(states):
            bit = U(1 << (i % 64))
            if loop:
                self.loops[i // 64] |= bit
            if enter is None:
                self.reach[:, i // 64] |= bit
            elif enter >= 0:
                self.reach[enter, i // 64] |= bit
        for i in starts:
            self.start[i // 64] |= U(1 << (i % 64))

    def match(self, strings: list[bytes]) -> np.ndarray:
        """A row for each string, a column for each glob."""
        out = np.zeros((len(strings), len(self.ends)), bool)
        order = np.argsort([-len(s) for s in strings], kind="stable")
        for at in range(0, len(order), BLOCK):
            block = order[at : at + BLOCK]
            sizes = np.array([len(strings[i]) for i in block])
            data = np.frombuffer(b"".join(strings[i] for i in block), np.uint8)
            begin = np.cumsum(sizes) - sizes
            state = np.repeat(self.start[None, :], len(block), axis=0)
            for j in range(int(sizes[0])):
                n = int(np.searchsorted(-sizes, -j, side="left"))  # strings longer than j come first
                now = state[:n]
                shifted = now << U(1)
                shifted[:, 1:] |= now[:, :-1] >> U(63)
                state[:n] = (shifted & self.reach[data[begin[:n] + j]]) | (now & self.loops)
            for g, end in enumerate(self.ends):
                out[block, g] = (state[:, end // 64] >> U(end % 64)) & U(1)
        return out


def escaped(text: str) -> str:
    """A glob that matches the text alone."""
    return re.sub(r"([*?\\])", r"\\\1", text)


def _judged(rules: list[tuple[str, str]], globs: list[str], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A rule is a glob over ".host#path"; neither part can hold a '#'.
        names = [name for _, name in rules]
        split = [(n[: n.index("/")], n[n.index("/") :]) for n in names]
        prefixes = [f"*.{escaped(h)}#{escaped(p)}*".encode() for h, p in split]
        both = GlobSet([*prefixes, *(g.encode() for g in globs)])
        by_size = sorted(range(len(names)), key=lambda i: len(names[i]))
        for batch in batches:
            hosts, paths = (batch.column(i).to_pylist() for i in (1, 2))
            found = both.match([b"." + (h or "").encode() + b"#" + (p or "").encode() for h, p in zip(hosts, paths, strict=True)])
            best = np.full(len(hosts), -1)
            for i in by_size:
                best[found[:, i]] = i
            blocked = found[:, len(names) :].any(axis=1)
            rule = [names[i] if i >= 0 else None for i in best.tolist()]
            verdict = [rules[i][0] if i >= 0 else "block" if b else default for i, b in zip(best.tolist(), blocked.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict)], names=[*batch.schema.names, "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], globs: list[str], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of each url. rules are (verdict, "host/path"): one fits its host and all
    subdomains if the url's path starts with the rule's, byte for byte, and the longest that fits decides. Where none fits, a url is
    blocked if one of the globs matches its ".host#path", else it gets the default verdict.

    The host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; the path what follows
    up to "?", "#" or the end. A null url, or one without "://", has an empty host and path, which no rule fits.
    Rows stand alone: no shuffle; the automaton's size is that of the rules. Repeated rows and null ids pass through.
    """
    rest = F.when(F.col(url_col).contains("://"), F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    base = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    out = base.mapInArrow(_judged(rules, globs, default), "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
