"""What the training-data operators share: a filter of ids, the word kernel, components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from ..scratch import Scratch

#: Bytes of text that the numpy kernels take at once; a longer document comes alone and is
#: taken in blocks of about as many.
SLICE_BYTES = 1 << 19
#: Rows that come to a Python worker at once, so that rows of long texts stay few.
BATCH_ROWS = 1000

U64 = np.uint64


def _return_memory() -> None:
    """Python workers outlive their tasks: what a task frees goes back to the system at
    once, so that idle workers don't keep an executor's memory."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:
    _return_memory()


def bounded(operator: Callable) -> Callable:
    """The operator (of a DataFrame), with the session's Arrow batches at most BATCH_ROWS."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **more):
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(conf.get(key)) <= BATCH_ROWS:
            conf.set(key, str(BATCH_ROWS))
        return operator(df, *args, **more)

    return run


# ------------------------------------------------------------------------- id filter

FILTER_BITS = 1 << 27  #: bound of a broadcast filter of ids (16 MB)


def _filter_places(ids: Column, bits: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(ids, F.lit(k)), F.lit(bits)) for k in (1, 2)))


class IdFilter:
    """A Bloom filter of ids, for tasks to leave out rows before they are shuffled to a join
    that decides. Its size follows the number of ids up to FILTER_BITS; beyond that it lets
    more rows through, and the join's result stays the same."""

    def __init__(self, ids: DataFrame, column: str):
        self.column = column
        self.bits = int(min(FILTER_BITS, max(1 << 12, 16 * ids.count())))
        at = ids.select(F.explode(_filter_places(F.col(column), self.bits)).alias("p"))
        word = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        rows = word.toArrow()  # at most FILTER_BITS / 64
        table = np.zeros(self.bits // 64 + 1, np.int64)
        table[rows["w"].to_numpy()] = rows["b"].to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table.view(U64))

    def __call__(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose id may be a member, with all columns. Null is none."""
        shared, names = self.table, df.columns
        places = _filter_places(F.col(column), self.bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for b in batches:
                hit = np.ones(b.num_rows, bool)
                for k in (-2, -1):
                    p = b.column(b.num_columns + k).to_numpy()
                    hit &= (table[p >> 6] >> (p & 63).astype(U64)) & U64(1) == 1
                b = b.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))], names)

        return df.filter(F.col(column).isNotNull()).select("*", places[0].alias("_p0"), places[1].alias("_p1")).mapInArrow(run, df.schema)


# ----------------------------------------------------------------------- text kernel

#: Characters that part words: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique may hash them first, which takes many times as long."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def text_array(column) -> pa.Array:
    """One string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows and the end) of a string array in
    runs of at most ``limit`` bytes; a row beyond the limit comes alone and whole."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = at.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def blocks(data: np.ndarray, at: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """data and its row offsets cut at separators into blocks of about SLICE_BYTES; a run
    without any separator stays whole. Offsets outside a block are its start or end."""
    n, a = len(data), 0
    while a < n:
        b = min(a + SLICE_BYTES, n)
        while b < n and not apart[data[b]]:
            near = np.flatnonzero(apart[data[b : b + 4096]])
            b = b + int(near[0]) if len(near) else min(b + 4096, n)
        yield data[a:b], np.clip(at - a, 0, b - a)
        a = b


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, in order, and each row's first word.

    A word is a run of bytes that are not separators, with A-Z lower-cased.
    """
    if len(data) > 2 * SLICE_BYTES:
        parts = [_words(*x) for x in blocks(data, at, SEPARATOR)]
        return np.concatenate([h for h, _ in parts]), sum(first for _, first in parts)
    return _words(data, at)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    apart = SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = ~apart
    last = first.copy()
    first[1:] &= apart[:-1] | edge[1:n]
    last[:-1] &= apart[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[LOWER[data]] * _power(_P, n)[:n], out=total[1:])
    h = mix((total[e] - total[s]) * _power(_P_INV, n)[s] + (e - s).astype(U64))
    return h, np.searchsorted(s, at)


_STEP = [pow(0xD6E8FEB86659FD93, i + 1, 2**64) for i in range(16)]


def shingles(h: np.ndarray, first: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has its whole
    sequence as its one shingle, a row without words none."""
    run = np.zeros(max(0, len(h) - size + 1), U64)
    for i in range(size):
        run += h[i : i + len(run)] * U64(_STEP[i])
    run = mix(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(distinct(run[a : b - size + 1]))
        elif b > a:
            x = sum((int(v) * _STEP[i] for i, v in enumerate(h[a:b])), _STEP[8] * (b - a))
            out.append(mix(np.array([x % 2**64], U64)))
        else:
            out.append(run[:0])
    return out


# ------------------------------------------------------------------------ components


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around each local component's smallest node."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    node, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(node))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that undirected ``edges`` (a, b) reach.

    Partitions first reduce their own edges to stars. Nodes without an edge are not in the
    result. ``rows``: about how many edges there are, if known.
    """
    forest = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").mapInArrow(_local_forest, "a long, b long")
    found = stars(forest, scratch, rows)
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
