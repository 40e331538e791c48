"""Largest inner products: score-aware (anisotropic) 4-bit quantisation, table scans, exact reranking
of every row that the codes can't rule out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralode.llm._shared import release, small_batches, stash

#: Rows that the codebooks are fitted on at most.
FIT_ROWS = 10_000
#: Dimensions that share a code, and values of a code.
GROUP, CODES = 2, 16
#: Score below which the direction of an error doesn't matter, as a share of a vector's length: parallel errors weigh
#: (d - 1) T**2 / (1 - T**2) times as much as others (Guo et al., 2020).
THRESHOLD = 0.2
#: Rows, and numbers, that a block of candidates has on average at most.
ROW_BLOCK, BLOCK_VALUES = 1 << 17, 1 << 23
#: Queries whose tables are made at once.
TABLES_AT_ONCE = 256


@dataclass(frozen=True)
class Codebooks:
    """values[group, code] is a piece of a vector; vectors are padded with zeros to whole groups, an even number of them."""

    dim: int
    values: np.ndarray
    weight: float

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.values.shape[0] * GROUP - x.shape[1]))).reshape(len(x), -1, GROUP)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """A code for each group: the nearest, then some rounds that lower the score-aware loss one group at a time."""
        parts = self.padded(x)
        unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
        apart = parts[:, :, None, :] - self.values
        plain = np.square(apart).sum(axis=3)  # row, group, code
        along = np.einsum("ngd,ngcd->ngc", unit, apart)
        codes, every = plain.argmin(axis=2), np.arange(len(x))
        parallel = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for g in range(parts.shape[1]):
                rest = parallel - along[every, g, codes[:, g]]
                loss = plain[:, g] + (self.weight - 1) * np.square(rest[:, None] + along[:, g])
                codes[:, g] = loss.argmin(axis=1)
                parallel = rest + along[every, g, codes[:, g]]
        return codes.astype(np.uint8)


def fit_codebooks(x: np.ndarray, rounds: int = 6) -> Codebooks:
    """Codebooks of least score-aware loss on a sample: codes and values are improved in turn, values group by group
    with the other groups held (each code's value solves a 2 x 2 system)."""
    dim, rng = x.shape[1], np.random.default_rng(0)
    groups = -(-dim // (2 * GROUP)) * 2
    weight = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    picks = np.stack([rng.choice(len(x), CODES, replace=len(x) < CODES) for _ in range(groups)])
    books = Codebooks(dim, np.zeros((groups, CODES, GROUP)), weight)
    parts = books.padded(x)
    books = Codebooks(dim, np.stack([parts[picks[g], g] for g in range(groups)]), weight)
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(rounds):
        codes = books.encode(x, rounds=1)
        values = books.values.copy()
        parallel = sum((unit[:, g] * (parts[:, g] - values[g, codes[:, g]])).sum(axis=1) for g in range(groups))
        for g in range(groups):
            u, c = unit[:, g], codes[:, g]
            rest = parallel - (u * (parts[:, g] - values[g, c])).sum(axis=1)  # what the other groups leave
            goal = parts[:, g] + (weight - 1) * u * ((u * parts[:, g]).sum(axis=1) + rest)[:, None]
            for code in range(CODES):
                if (own := c == code).any():
                    left = own.sum() * np.eye(GROUP) + (weight - 1) * u[own].T @ u[own]
                    values[g, code] = np.linalg.solve(left, goal[own].sum(axis=0))
            parallel = rest + (u * (parts[:, g] - values[g, c])).sum(axis=1)
        books = Codebooks(dim, values, weight)
    return books


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_numpy(zero_copy_only=False)
    return np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 0))


def _encoded(books: Codebooks, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class its ids, its codes, its vector, and a bound of what a unit vector's product with it may be more
        than the sum of the table entries: the length of the error, and what single precision loses."""
        for batch in batches:
            if not batch.num_rows:
                continue
            packed, errors = [], []
            x = _matrix(batch.column(1))
            every = np.arange(books.values.shape[0])
            for at in range(0, len(x), 2048):
                part = x[at : at + 2048]
                codes = books.encode(part)
                packed += [r.tobytes() for r in codes[:, 0::2] | codes[:, 1::2] << 4]
                near = books.values[every, codes]
                lost = (len(every) + 16) * 2.0**-24 * np.sqrt(np.square(near).sum(axis=(1, 2)))
                errors.append(np.sqrt(np.square(books.padded(part) - near).sum(axis=(1, 2))) * (1 + 1e-6) + lost)
            vectors = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array(np.concatenate(errors)), vectors]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "code", "error", "vector"])

    return run


def _kth(scores: np.ndarray, k: int) -> float:
    """The k-th largest, or minus infinity where there are fewer."""
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


class _Block:
    """A block of classes, through which queries are streamed. Rough scores are sums of table entries: one table of 256
    entries for each byte, that is for two 4-bit codes. The exact scores of the roughly best classes give a k-th
    best score; every class whose rough score and error bound together reach it is scored on its vector."""

    def __init__(self, books: Codebooks, kind: type, k: int, rows: list[tuple[list[int], bytes, float, bytes]]) -> None:
        self.books, self.k, self.n = books, k, len(rows)
        self.vectors = np.frombuffer(b"".join(r[3] for r in rows), kind).reshape(len(rows), -1)
        self.single = self.vectors.astype(np.float32, copy=False)
        self.codes = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1).T.copy()
        self.error = np.nextafter(np.array([r[2] for r in rows], np.float32), np.float32(np.inf))
        self.sizes = np.array([len(r[0]) for r in rows], np.int64)
        self.ids = np.array([i for r in rows for i in r[0]], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        lone = np.flatnonzero(self.sizes == 1)  # a query's own class counts for it only where it has other rows
        self.lone = lone[np.argsort(self.ids[self.starts[lone]], kind="stable")]
        self.lone_ids = self.ids[self.starts[self.lone]]
        #: What scores in single precision are off at most, for unit queries.
        self.loss = (self.vectors.shape[1] + 16) * 2.0**-23 * np.sqrt(np.square(self.vectors.astype(np.float64)).sum(axis=1)).max(initial=0)

    def search(self, names: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, id, score) of the k best rows of the block for each query."""
        if not self.n:
            return
        units = asked / np.linalg.norm(asked, axis=1)[:, None]
        tables = np.einsum("qgd,gcd->qgc", self.books.padded(units), self.books.values).astype(np.float32)
        pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(asked), len(self.codes), 256)
        for q, x, unit, table in zip(names, asked, units.astype(np.float32), pairs, strict=True):
            rough = np.zeros(self.n, np.float32)
            for t, c in zip(table, self.codes, strict=True):
                rough += t.take(c)
            own = self.lone[np.searchsorted(self.lone_ids, q) : np.searchsorted(self.lone_ids, q, "right")]
            rough[own] = -np.inf
            least = -np.inf
            if self.n - len(own) > (m := 4 * self.k):
                first = np.argpartition(rough, self.n - m)[self.n - m :]
                least = _kth(_finite(self.single[first] @ unit), self.k) - 2 * self.loss
            may = ~(rough + self.error < least)  # what isn't a number stays
            may[own] = False
            left = np.flatnonzero(may)
            scores = self.single[left] @ unit
            left = left[~(scores < _kth(_finite(scores), self.k) - 2 * self.loss)]
            # In double precision, summed from the first dimension to the last.
            scores = np.cumsum(self.vectors[left] * x, axis=1)[:, -1]
            sizes = self.sizes[left]
            of = np.repeat(np.arange(len(left)), sizes)
            found = self.ids[np.repeat(self.starts[left], sizes) + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            of, found = of[found != q], found[found != q]
            best = np.lexsort((found, -scores[of]))[: self.k]
            yield np.full(len(best), q), found[best], scores[of[best]]


def _finite(scores: np.ndarray) -> np.ndarray:
    return np.nan_to_num(scores, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _scan(books: Codebooks, kind: type, k: int):
    """Rows come in order of block and part: its classes first, then its queries, which pass in small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block = None, [], None
        for batch in batches:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            held: list[tuple[int, bytes]] = []

            def search(held: list, block: _Block, out: list = out) -> None:
                out += block.search(np.array([q for q, _ in held], np.int64), np.stack([np.frombuffer(x, np.float64) for _, x in held]))

            columns = [c.to_pylist() for c in batch.columns]
            for b, part, is_query, ids, code, error, vector in zip(*columns, strict=True):
                if (b, part) != key:
                    if held:
                        search(held, block)
                        held = []
                    key, rows, block = (b, part), [], None
                if not is_query:
                    rows.append((ids, code, error, vector))
                    continue
                if block is None:
                    block, rows = _Block(books, kind, k, rows), []
                held.append((ids[0], vector))
                if len(held) == TABLES_AT_ONCE:
                    search(held, block)
                    held = []
            if held:
                search(held, block)
            arrays = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries' vectors as doubles."""
    for batch in batches:
        vectors = [x.tobytes() for x in _matrix(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])


def largest_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of vectors with the largest inner product for each row of queries, other than the query's own id:
    (query_id, rank, vec_id, score), nearest first, ties to the smaller id. All rows where there are no more than k.

    Codebooks are fitted on at most FIT_ROWS rows, those whose ids hash lowest. Equal vectors are one class, which keeps
    its k + 1 smallest ids; every class is encoded: 4 bits for two dimensions, under a loss that weighs errors along a
    vector more than those across it. Blocks of classes have a bounded size, and all queries are streamed through each; a
    task scans its codes by tables and scores on the original vectors, in double precision, every class whose rough score and error
    bound together reach the k-th best exact score. So the result is exact, whatever the number of rows or of copies.

    Vectors that are null, zero or hold null or non-finite components take no part, as query or as candidate, nor do
    those with a null id or another length than most of the fitted rows. Rows that repeat an id and a vector count once.
    Other columns are ignored. An empty table gives an empty result.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)

    def clean(df: DataFrame, kind: str) -> DataFrame:
        named = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
        return named.where(sound).where(finite)

    plain = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = clean(vectors, "float" if plain else "double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    dims = [len(r.embedding) for r in sample]
    dim = max(sorted(set(dims)), key=dims.count)
    books = fit_codebooks(np.array([r.embedding for r in sample if len(r.embedding) == dim]))
    rows, asked = (df.where(F.size("embedding") == dim).dropDuplicates(["vec_id", "embedding"]) for df in (rows, clean(queries, "double")))
    # Spark keeps the first rows of each task before it shuffles, so that a class of many copies is spread.
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    classes = first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")
    kind = np.float32 if plain else np.float64
    codes = stash(classes.mapInArrow(_encoded(books, kind), "ids array<long>, code binary, error double, vector binary"), "codes")
    asked = stash(asked.select("vec_id", "embedding").mapInArrow(_as_bytes, "vec_id long, vector binary"), "queries")
    n_rows, n_asked = codes.count(), asked.count()
    if not n_asked:
        return empty
    # Blocks of classes stay; each query goes to each block. Few blocks are dealt out several times, so that there are at
    # least two tasks for each core, if there are enough queries.
    blocks = -(-n_rows // max(1, min(ROW_BLOCK, BLOCK_VALUES // dim)))
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-tasks // blocks), -(-n_asked // 64))
    deal = lambda of, c, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int").alias(c)
    each = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    left = codes.select("*", deal(F.col("ids")[0], "block", blocks)).select("*", each("part", parts))
    right = asked.select("*", deal(F.col("vec_id"), "part", parts)).select("*", each("block", blocks))
    met = left.select("block", "part", F.lit(False).alias("is_query"), "ids", "code", "error", "vector").union(
        right.select("block", "part", F.lit(True), F.array("vec_id"), F.lit(None).cast("binary"), F.lit(None).cast("double"), "vector")
    )
    met = small_batches(met).repartition("block", "part").sortWithinPartitions("block", "part", "is_query")
    exact = met.mapInArrow(_scan(books, kind, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = stash(exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found")
    release(codes, asked)
    return found
