"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the histogram of lengths has a fixed
size whatever the input, and the packing is planned on it alone: large lengths are cut
into groups of equal cardinality and rounded up to their group's largest, configurations
of few rounded sizes are filled one after another, actual lengths replace the rounded
ones, and small lengths go best-fit, longest first, into what is left. A plan is a list of
runs of equal bins, so its size depends on the capacity, not on the number of documents.
Pieces then find their place by length and rank, without a gather anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ranks_of
from .common import Scratch, bounded, text_array

CAPACITY = 2048
END_ID = 0
FILE_ROWS = 32_768  #: rows of the result from which on it takes another file


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


@bounded
def pieces(docs: DataFrame, rank_file: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's tokens and its end id, cut.

    Ids are those of the vocabulary's JSON tokenizer at its default setting, so the string
    of its added token in a text is that token. Null and empty texts are the end id alone;
    null ids and repeated rows are carried through; long texts are encoded whole; an empty
    table gives no rows; other columns are not read.
    """
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks_of(rank_file)
        for b in batches:
            out: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), text_array(b.column(1)).to_pylist(), strict=True):
                ids = np.append(enc.encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    part = ids[s : s + n]
                    out.append((i, k, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            cols = list(zip(*out, strict=True)) if out else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["i", "p", "s", "l", "c", "ids"][: len(cols)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


# ------------------------------------------------------------------------------ plan


@dataclass
class Bins:
    """Bins ``base`` to ``base + n`` that are filled up to ``used``."""

    base: int
    n: int
    used: int


@dataclass
class Plan:
    """Runs (length, first rank, bin of it, items of this length side by side, offset)."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    taken: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def place(self, length: int, count: int, base: int, side: int, offset: int) -> None:
        first = self.taken.get(length, 0)
        self.runs.append((length, first, base, side, offset))
        self.taken[length] = first + count


def fullest(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Indices of sizes, with repeats, whose sum is the largest that fits into room."""
    came = np.full(room + 1, -1, np.int32)  # the size that first reached this sum
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for i, s in enumerate(sizes):
        for _ in range(min(left[i], room // s)):
            new = np.zeros(room + 1, bool)
            new[s:] = reached[:-s] if s else reached
            new &= ~reached
            if not new.any():
                break
            came[new] = i
            reached |= new
        if reached[room]:
            break
    at, out = int(np.flatnonzero(reached)[-1]), []
    while at:
        out.append(int(came[at]))
        at -= sizes[out[-1]]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 2048, small: float = 1 / 8) -> Plan:
    """Where each length's items go, by rank. Lengths over ``small`` times the capacity
    are large."""
    p = Plan(capacity)
    large = sorted((x for x in histogram if x > small * capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    each = max(1, -(-total // groups))
    # Linear grouping: runs of (length, count) that make up each group, longest first.
    members: list[list[list[int]]] = []
    room = 0
    for x in large:
        n = histogram[x]
        while n:
            if not room:
                members.append([])
                room = each
            take = min(n, room)
            members[-1].append([x, take])
            n, room = n - take, room - take
    sizes = [g[0][0] for g in members]
    left = [sum(n for _, n in g) for g in members]
    bins: list[Bins] = []
    for lead in range(len(sizes)):
        while left[lead]:
            after = [n - (i == lead) if i >= lead else 0 for i, n in enumerate(left)]
            chosen = [lead, *fullest(capacity - sizes[lead], sizes, after)]
            need = {i: chosen.count(i) for i in chosen}
            times = min(left[i] // k for i, k in need.items())
            # Actual lengths replace the rounded ones: bins split where a run of lengths ends.
            base = p.open(times)
            parts = [Bins(base, times, 0)]
            for i in chosen:
                new: list[Bins] = []
                for b in parts:
                    at, n = b.base, b.n
                    while n:
                        x, have = members[i][0]
                        take = min(n, have)
                        p.place(x, take, at, 1, b.used)
                        new.append(Bins(at, take, b.used + x))
                        at, n = at + take, n - take
                        members[i][0][1] -= take
                        if not members[i][0][1]:
                            members[i].pop(0)
                parts = new
            bins += parts
            for i, k in need.items():
                left[i] -= k * times
    # Best fit, longest first, into the room that is left.
    rooms: dict[int, list[Bins]] = {}
    for b in bins:
        rooms.setdefault(capacity - b.used, []).append(b)
    for x in sorted((x for x in histogram if x <= small * capacity), reverse=True):
        n = histogram[x]
        for r in sorted(r for r in rooms if r >= x):
            while n and rooms[r]:
                b = rooms[r].pop()
                side = min(r // x, n)
                fill = min(b.n, n // side)
                p.place(x, fill * side, b.base, side, b.used)
                n -= fill * side
                rooms.setdefault(r - side * x, []).append(Bins(b.base, fill, b.used + side * x))
                if fill < b.n:
                    rooms[r].append(Bins(b.base + fill, b.n - fill, b.used))
            if not n:
                break
        while n:
            side = min(capacity // x, n)
            fill = n // side
            base = p.open(fill)
            p.place(x, fill * side, base, side, 0)
            n -= fill * side
            rooms.setdefault(capacity - side * x, []).append(Bins(base, fill, side * x))
    return p


@bounded
def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """Every row of ``pieces`` with sequence_id and offset. ``rows``: about how many there
    are, if known; few then lie in few files.

    Rows of one length are ranked within buckets of hashed ids, and the buckets' counts
    are added up, so a frequent length is no hot key. Only the histogram (one row for each
    length up to the capacity) comes to the driver; the plan is broadcast. Null ids and
    repeated rows are pieces like any others; an empty table gives no rows; other columns
    stay.
    """
    spark = parts.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch = Scratch(spark, "packing")
    parts = scratch.save(parts.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets)).cast("int")), rows)
    counts = parts.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    p = plan(histogram, capacity)
    runs = np.array(sorted(p.runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)
    order = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "start", "ids_crc32")
    ranked = parts.withColumn("_rank", F.row_number().over(order)).join(counts, ["length", "_bucket"])
    ranked = ranked.select(*[c for c in parts.columns if c != "_bucket"], (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    if 2 * (few := sum(histogram.values()) // FILE_ROWS + 1) < buckets:
        ranked = ranked.coalesce(few)
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        key = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            _, first, base, side, offset = runs[at].T
            j = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(base + j // side), pa.array(offset + j % side * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")
