"""Removal of repeated substrings by common-prefix intervals of enhanced suffix arrays.

A suffix array of a whole corpus is no task's work, so equal windows first meet by their
minimiser: the smallest-hashed gram of a window depends on its bytes alone. Consecutive
windows with one minimiser form a stretch.

1. Minimisers are counted by hash. A task sends each of its grams once; one that it has
   twice is known to repeat and is no longer bound to a place, so a frequent gram is never
   gathered. What occurs once in the corpus is done with here.
2. The stretches of repeating minimisers are read from their documents, and equal ones
   are reduced to their first occurrence, pre-aggregated before the exchange.
3. The distinct stretches of one minimiser get a suffix array with common-prefix lengths.
   A stack scan lists its intervals of at least the window's length; those whose
   occurrences have different bytes before them are the maximal repeats, and all
   occurrences but the earliest lose their windows. Where a minimiser has very many
   distinct stretches, they are first cut into shorter ones by minimisers of longer grams,
   and at last into windows, so that only windows that share that much still meet.
4. A document loses the windows of its repeating stretches that it doesn't own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, Scratch, bounded, mix, slices, text_array

GRAM = 32  #: bytes of a gram
FLUSH_BYTES = 16 << 20  #: of text whose stretches a task sends together
SPLIT = 1000  #: distinct stretches from which on a minimiser's are cut by longer grams
BROADCAST_KEYS = 1 << 18  #: minimisers (of 8 bytes) that are sent to all tasks at most
SOLVE_ROWS = 5000  #: stretches that are taken together, and more while a group lasts
BATCH = 40_000  #: suffixes that are sorted together
_PLACE = (1 << 31) - 1


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at each start; grams may cross rows."""
    n = len(data)
    if n < gram:
        return np.zeros(0, U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(common._BYTE[data] * common._power(common._P, n)[:n], out=total[1:])
    return mix((total[gram:] - total[:-gram]) * common._power(common._P_INV, n)[: n - gram + 1])


def hashes_at(data: np.ndarray, place: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """gram_hashes(data, gram)[place], without those between."""
    power = common._power(common._P, gram)[:gram]
    parts = [mix((common._BYTE[data[place[lo : lo + 4096, None] + np.arange(gram)]] * power).sum(1, dtype=U64)) for lo in range(0, len(place), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def stretches(data: np.ndarray, at: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, offset of the minimiser, its hash) of each stretch of all rows. Long
    data goes block by block; a stretch that lies across two blocks comes as two."""
    n, size = len(data), common.SLICE_BYTES
    if n > 2 * size:
        parts = []
        for a in range(0, n - window + 1, size):
            sub = data[a : a + size + window - 1]
            start, *more = _stretches(sub, np.clip(at - a, 0, len(sub)), window, gram)
            parts.append((start + a, *more))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _stretches(data, at, window, gram)


def _stretches(data: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, np.zeros(0, U64)
    h = gram_hashes(data, gram)
    # Ordered by leading hash bits, then by place, so that equal windows choose alike.
    key = (h & ~U64(_PLACE)) | np.arange(len(h), dtype=U64)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    least = (key & U64(_PLACE)).astype(np.int64)
    valid = np.zeros(n - window + 2, np.int64)  # windows that lie in one row
    size = np.diff(at)
    fit = size >= window
    np.add.at(valid, at[:-1][fit], 1)
    np.add.at(valid, at[:-1][fit] + size[fit] - window + 1, -1)
    inside = np.cumsum(valid)[:-1] > 0
    first = inside.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first[at[:-1][fit]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(inside))
    row = np.searchsorted(at, start, "right") - 1
    end = np.minimum(end, at[row + 1] - window + 1)
    return start, end - start, least[start] - start, h[least[start]]


def digest_key(text: Column) -> Column:
    return F.xxhash64(text)


def repeating(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(o, fp, start array, windows array, offset array): each document's stretches whose
    minimiser comes again in the corpus. docs: (o, fp, text)."""
    spread = max(64, 1 << (2 * docs.rdd.getNumPartitions() - 1).bit_length())
    shift = U64(64 - (spread.bit_length() - 1))
    low = U64((1 << 40) - 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        keep: list[list[np.ndarray]] = []
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        base = 0

        def flush() -> Iterator[pa.RecordBatch]:
            flush_id = (task << 20) + turn
            start, count, off, h = (np.concatenate(x) for x in zip(*keep, strict=True))
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            known = times[back] > 1
            bucket = (mix(h) >> shift).astype(np.int64)  # a minimiser's own leading bits are mostly zeros
            # One of a known gram tells its bucket; the others may go anywhere.
            lead = np.zeros(len(h), bool)
            lead[np.unique(back, return_index=True)[1]] = True
            loose = known & ~lead
            bucket[loose] = start[loose] % spread
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(spread + 1))
            start, count, off, h, known = (x[order] for x in (start, count, off, h, known))
            short = np.ascontiguousarray((h & low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            cols: list[list] = [[], [], [], [], []]
            some = np.flatnonzero(np.diff(edge))  # of a wide spread a task fills few
            for i in some.tolist():
                part = slice(edge[i], edge[i + 1])
                gap = np.diff(start[part], prepend=0).astype("<u4")
                for c, x in zip(cols, (short[part], np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4).T), count[part].astype(np.uint8), off[part].astype(np.uint8), known[part].astype(np.uint8)), strict=True):
                    c.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), flush_id)), *(pa.array(c, pa.binary()) for c in cols)], ["b", "f", "h", "g", "c", "m", "k"])
            at, o, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(flush_id % spread)], pa.int32()), pa.array([-1 - flush_id], pa.int64()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (at, o, fp)), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], ["b", "f", "h", "g", "c", "m", "k"])

        for b in batches:
            o, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi, data, at in slices(text_array(b.column(2))):
                start, count, off, h = stretches(data, at, window)
                keep.append([start + base, count, off, h])
                rows.append((at[:-1] + base, o[lo:hi], fp[lo:hi]))
                base += len(data)
                if base >= FLUSH_BYTES:
                    yield from flush()
                    keep, rows, base, turn = [], [], 0, turn + 1
        if rows:
            yield from flush()

    def twice(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one bucket: the stretches whose gram is in two rows or known to repeat."""
        parts, out = [], []
        for f, h, g, c, m, k in zip(*(table[x].to_pylist() for x in ("f", "h", "g", "c", "m", "k")), strict=True):
            if f < 0:
                out.append((f, h, g, c))
                continue
            n = len(c)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(h, np.uint8).reshape(n, 5)
            gap = np.ascontiguousarray(np.frombuffer(g, np.uint8).reshape(4, n).T).view("<u4").ravel()
            parts.append((np.full(n, f), wide.view("<u8").ravel(), np.cumsum(gap.astype(np.int64)), np.frombuffer(c, np.uint8), np.frombuffer(m, np.uint8), np.frombuffer(k, np.uint8)))
        if parts:
            f, h, start, c, m, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            again = np.bincount(back, k, len(times)) > 0
            hit = np.flatnonzero((times[back] > 1) | again[back])
            hit = hit[np.argsort(f[hit], kind="stable")]
            edge = np.flatnonzero(np.diff(f[hit], prepend=-1, append=-1))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x = hit[i:j]
                out.append((int(f[x[0]]), start[x].tobytes(), c[x].tobytes(), m[x].tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"f": pa.array(cols[0], pa.int64()), "x": pa.array(cols[1], pa.binary()), "y": pa.array(cols[2], pa.binary()), "z": pa.array(cols[3], pa.binary())})

    schema = "b int, f long, h binary, g binary, c binary, m binary, k binary"
    found = docs.select("o", "fp", "text").mapInArrow(cut, schema).groupBy("b").applyInArrow(twice, "f long, x binary, y binary, z binary")
    found = found.select(F.when(F.col("f") < 0, -1 - F.col("f")).otherwise(F.col("f")).alias("flush"), (F.col("f") < 0).alias("rows"), "x", "y", "z")

    def by_row(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Of one flush: its stretches by document."""
        at = o = fp = None
        parts = []
        for r, x, y, z in zip(*(table[c].to_pylist() for c in ("rows", "x", "y", "z")), strict=True):
            if r:
                at, o, fp = (np.frombuffer(v, np.int64) for v in (x, y, z))
            else:
                parts.append((np.frombuffer(x, np.int64), np.frombuffer(y, np.uint8), np.frombuffer(z, np.uint8)))
        if not parts:
            return pa.table({c: pa.array([], k) for c, k in zip(("o", "fp", "start", "windows", "offset"), (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3), strict=True)})
        start, count, off = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.argsort(start, kind="stable")
        start, count, off = start[order], count[order], off[order]
        row = np.searchsorted(at, start, "right") - 1  # empty rows share a start with the next; the last one has the bytes
        edge = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        cut = pa.array(edge.astype(np.int32))
        first = row[edge[:-1]]
        ints = lambda v: pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int32)))
        return pa.table({"o": pa.array(o[first]), "fp": pa.array(fp[first]), "start": ints(start - at[row]), "windows": ints(count.astype(np.int64)), "offset": ints(off.astype(np.int64))})

    # Rows that repeat an id and a text are one document: any of them has its stretches.
    one = found.groupBy("flush").applyInArrow(by_row, "o long, fp long, start array<int>, windows array<int>, offset array<int>")
    return scratch.save(one.groupBy("o", "fp").agg(F.min(F.struct("start", "windows", "offset")).alias("x")).select("o", "fp", "x.*"), docs.count())


def maximal_repeats(length: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, end, common bytes) of the intervals of a suffix array whose suffixes have
    that many bytes in common and different bytes before them.

    length[i]: bytes that suffixes i-1 and i have in common, 0 where that is too few to
    matter; before[i]: the byte before suffix i, or a number of its own. A stack holds the
    open intervals; ``before`` differs in an interval if it does between any neighbours.
    """
    turns = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    stack: list[tuple[int, int]] = []
    n = len(length)
    for i in [*np.flatnonzero((length > 0) | (np.append(0, length[:-1]) > 0)).tolist(), n]:
        now = int(length[i]) if i < n else 0
        first = i - 1
        while stack and stack[-1][1] > now:
            first, common_bytes = stack.pop()
            end = i
            if turns[end - 1] > turns[first]:
                yield first, end, common_bytes
        if now and (not stack or stack[-1][1] < now):
            stack.append((first, now))


def owned(strings: list[bytes], group: np.ndarray, order: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows no earlier string of its group has.

    ``order`` ranks the strings by where they first occur, with enough room between ranks
    for places inside (rows in order of document, then start).
    """
    size = np.array([len(s) for s in strings], np.int64)
    count = size - window + 1
    flat = np.frombuffer(b"".join(strings), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(strings)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    width = int(size.max())
    grid = np.zeros((len(owner), 3 + width), np.uint8)  # group, then the suffix with bytes one up, so that 0 ends it
    for i in range(3):
        grid[:, i] = (group[owner] // 255 ** (2 - i)) % 255 + 1
    reach = size[owner] - place
    col = np.arange(width)
    inside = col[None, :] < reach[:, None]
    suffix = np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(width, np.uint8)), width)[at[owner] + place]
    grid[:, 3:] = (suffix + np.uint8(1)) * inside
    rank = np.argsort(grid.view(f"S{3 + width}").ravel(), kind="stable")
    grid, owner, place, reach = grid[rank], owner[rank], place[rank], reach[rank]
    differ = grid[1:] != grid[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), 3 + width) - 3
    shared = np.minimum(shared, np.minimum(reach[1:], reach[:-1]))
    length = np.concatenate([[0], np.where(shared >= window, shared, 0)])
    before = np.where(place > 0, flat[np.maximum(at[owner] + place - 1, 0)].astype(np.int64), -1 - np.arange(len(owner)))
    out = [np.ones(c, bool) for c in count.tolist()]
    for first, end, n in maximal_repeats(length, before):
        who, where = owner[first:end], place[first:end]
        earliest = np.lexsort((where, order[who]))[0]
        for i in range(end - first):
            if i != earliest:
                out[who[i]][where[i] : where[i] + n - window + 1] = False
    return out


def removed(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """docs: (o, fp, text, more columns). All its rows with starts and ends (arrays of
    byte offsets) of the maximal runs to remove, or null."""
    occ = repeating(docs, window, scratch)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, fp = b.column(0).to_pylist(), b.column(1).to_pylist()
            text, start, windows, offset = (b.column(i) for i in (2, 3, 4, 5))
            cols: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                raw = text[i].as_py().encode()
                s, w, m = (x[i].values.to_numpy().astype(np.int64) for x in (start, windows, offset))
                cols[0] += hashes_at(np.frombuffer(raw, np.uint8), s + m).view(np.int64).tolist()
                cols[1] += [raw[a:e] for a, e in zip(s.tolist(), (s + w + window - 1).tolist(), strict=True)]
                cols[2] += [o[i]] * len(s)
                cols[3] += [fp[i]] * len(s)
                cols[4] += s.tolist()
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "s", "o", "fp", "p"])
                    cols = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "s", "o", "fp", "p"])

    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    joined = docs.select("o", "fp", "text").join(occ, ["o", "fp"]).select("o", "fp", "text", "start", "windows", "offset")
    string = joined.mapInArrow(read, "h long, s binary, o long, fp long, p int")
    first_of = lambda df: df.groupBy("h", "s").agg(F.min(F.struct("o", "fp", "p")).alias("x")).select("h", "s", "x.*")
    distinct = scratch.save(first_of(string))
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by h: (o, fp, p, first, n), runs of windows that a stretch owns."""

        def solve(rows: pa.Table) -> pa.RecordBatch:
            h, o, fp, p = (rows[c].to_numpy() for c in ("h", "o", "fp", "p"))
            size = rows["s"].combine_chunks()
            size = np.diff(np.frombuffer(size.buffers()[1], np.int32)[size.offset : size.offset + len(size) + 1]).astype(np.int64)
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            alone = times[back] == 1
            who = [np.flatnonzero(alone)]
            first, n = [np.zeros(len(who[0]), np.int64)], [(size - window + 1)[alone]]
            rank = np.empty(len(h), np.int64)
            rank[np.lexsort((p, fp, o))] = np.arange(len(h))
            todo = np.flatnonzero(~alone)
            todo = todo[np.argsort(back[todo], kind="stable")]
            work = np.cumsum((size - window + 1)[todo])
            lo = 0
            while lo < len(todo):
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + BATCH)))
                while hi < len(todo) and back[todo[hi]] == back[todo[hi - 1]]:
                    hi += 1
                x = todo[lo:hi]
                _, group = np.unique(back[x], return_inverse=True)
                strings = rows["s"].take(pa.array(x)).to_pylist()
                for i, mine in zip(x.tolist(), owned(strings, group, rank[x], window), strict=True):
                    edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                    who.append(np.full(len(edge) // 2, i))
                    first.append(edge[::2])
                    n.append(edge[1::2] - edge[::2])
                lo = hi
            who, first, n = (np.concatenate(v).astype(np.int64) for v in (who, first, n))
            return pa.RecordBatch.from_arrays([pa.array(o[who]), pa.array(fp[who]), pa.array(p[who].astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["o", "fp", "p", "i", "n"])

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            n += b.num_rows
            if n >= SOLVE_ROWS and (end or (held and held[-1].column(0)[-1].as_py() != h[0])):
                yield solve(pa.Table.from_batches([*held, b.slice(0, end)]))
                held, n = [], b.num_rows - end
                b = b.slice(end)
            held.append(b)
        if held:
            yield solve(pa.Table.from_batches(held))

    def cut_by(gram: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h, p = b.column(0).to_numpy().view(U64), b.column(4).to_numpy()
                for lo, _, data, at in slices(b.column(1)):
                    start, count, _, own = stretches(data, at, window, gram)
                    row = np.searchsorted(at, start, "right") - 1
                    raw, which = data.tobytes(), pa.array(lo + row)
                    parts = [raw[i:j] for i, j in zip(start.tolist(), (start + count + window - 1).tolist(), strict=True)]
                    at_doc = (p[lo + row] + start - at[row]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(mix(h[lo + row] ^ own).view(np.int64)), pa.array(parts, pa.binary()), b.column(2).take(which), b.column(3).take(which), pa.array(at_doc)], ["h", "s", "o", "fp", "p"])

        return run

    scanned = lambda df: df.select("h", "s", "o", "fp", "p").repartition("h").sortWithinPartitions("h").mapInArrow(scan, "o long, fp long, p int, i int, n int")
    parts = []
    for gram in ((GRAM + 2 * window) // 3, window):
        many = distinct.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select("h")
        keys = many.limit(BROADCAST_KEYS + 1).toArrow()
        if not keys.num_rows:
            break
        if keys.num_rows <= BROADCAST_KEYS:  # else the stretches are shuffled to them
            many = F.broadcast(docs.sparkSession.createDataFrame(keys))
        parts.append(scanned(distinct.join(many, "h", "left_anti")))
        finer = distinct.join(many, "h", "left_semi").select("h", "s", "o", "fp", "p").mapInArrow(cut_by(gram), "h long, s binary, o long, fp long, p int")
        distinct = scratch.save(first_of(finer), keys.num_rows * 4 * SPLIT)
    mine = scanned(distinct)
    for x in parts:
        mine = mine.unionByName(x)
    mine = mine.groupBy("o", "fp").agg(F.collect_list(F.struct("p", "i", "n")).alias("own"))  # at most a document's windows

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            start, windows, own = b.column(2), b.column(3), b.column(4)
            for i in range(b.num_rows):
                s, w = (x[i].values.to_numpy().astype(np.int64) for x in (start, windows))
                gone = np.zeros(int((s + w).max()) + 1, np.int8)
                for a, n in zip(s.tolist(), w.tolist(), strict=True):
                    gone[a : a + n] = 1
                if own[i].is_valid:
                    v = own[i].values
                    p, j, n = (v.field(k).to_numpy().astype(np.int64) for k in range(3))
                    for a, k in zip((p + j).tolist(), n.tolist(), strict=True):
                        gone[a : a + k] = 0
                edge = np.flatnonzero(np.diff(gone, prepend=0, append=0))
                lo, hi = edge[::2], edge[1::2] + window - 1  # bytes of the runs of windows
                if len(lo):
                    join = np.concatenate([[True], lo[1:] > hi[:-1]])
                    lo, hi = lo[join], hi[np.append(join[1:], True)]
                cols[0].append(lo.astype(np.int32))
                cols[1].append(hi.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.int32()))], ["o", "fp", "lo", "hi"])

    cut = occ.join(mine, ["o", "fp"], "left").select("o", "fp", "start", "windows", "own").mapInArrow(spans, "o long, fp long, lo array<int>, hi array<int>")
    return docs.join(cut, ["o", "fp"], "left")


def _keyed(docs: DataFrame, id_col: str, text_col: str, more: list[str]) -> DataFrame:
    """o orders the documents (those without an id come last); fp tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("o"), digest_key(text).alias("fp"), text.alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(more)))


def kept_bytes(raw: bytes, lo: list[int], hi: list[int]) -> bytes:
    return b"".join([raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True)])


@bounded
def remove_repeats(docs: DataFrame, finish: Callable, schema: str, window: int = 100, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None) -> DataFrame:
    """Rows of ``finish(text bytes, starts, ends, *more)`` for each row of docs.

    A byte is removed if a string of ``window`` bytes that covers it also starts earlier:
    in a document with a smaller id, or earlier in its own; overlaps count, and strings are
    judged on the input. A null text counts as empty. Documents without an id come after
    all others. Rows that repeat an id are ordered by a hash of their texts, and rows that
    repeat both are one document and get equal results. An empty table gives no rows.
    """
    if not GRAM <= window <= 255:
        raise ValueError(f"a window has {GRAM} to 255 bytes")
    more = more or [id_col]
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = removed(_keyed(docs, id_col, text_col, more), window, scratch)
    rows = rows.select("text", "lo", "hi", *(f"_{i}" for i in range(len(more))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi = b.column(1).to_pylist(), b.column(2).to_pylist()
            rest = [b.column(i).to_pylist() for i in range(3, b.num_columns)]
            yield finish([t.encode() for t in b.column(0).to_pylist()], [x or [] for x in lo], [x or [] for x in hi], *rest)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row, repeated ones too; null
    ids, null and empty texts, ties and long texts as in remove_repeats. An empty table
    gives no rows; other columns are not read."""

    def finish(raw, lo, hi, ids) -> pa.RecordBatch:
        gone = [sum(b) - sum(a) for a, b in zip(lo, hi, strict=True)]
        sha = [hashlib.sha256(kept_bytes(r, a, b)).hexdigest() for r, a, b in zip(raw, lo, hi, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(gone, pa.int64()), pa.array([len(a) for a in lo], pa.int64()), pa.array(sha, pa.string())], ["i", "b", "r", "s", "h"])

    return remove_repeats(docs, finish, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", window, id_col, text_col)


def without_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats cut out of the text column, a character that loses a byte
    going whole. Every row stays, also one that loses its whole text; a null text comes
    back empty. Null ids, ties and long texts as in remove_repeats. An empty table gives no
    rows; other columns, whatever their names, stay as they are."""
    names = docs.columns
    more = [c for c in names if c != text_col]
    kinds = {f.name: f.dataType for f in docs.schema}

    def finish(raw, lo, hi, *rest) -> pa.RecordBatch:
        text = [kept_bytes(r, a, b).decode("utf-8", "ignore") for r, a, b in zip(raw, lo, hi, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), *(pa.array(x, k) for x, k in zip(rest, arrow, strict=True))], ["t", *(f"_{i}" for i in range(len(more)))])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(kinds[c]) for c in more]
    schema = ", ".join(["t string", *(f"_{i} {kinds[c].simpleString()}" for i, c in enumerate(more))])
    out = remove_repeats(docs, finish, schema, window, id_col, text_col, more)
    return out.select(*(F.col("t" if c == text_col else f"_{more.index(c)}").alias(c) for c in names))
