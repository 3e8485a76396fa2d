"""Embedding near-duplicates by sorted projection passes.

Equal vectors form a class and go on as one. In each pass the classes are ordered by
dimension and a concatenation of hyperplane signs (lexicographically, ties by id); a class
is compared with its block of the order and the block before, by cosine in double
precision, and the pairs found are united across passes. A plane halves the angle between
two vectors of a sample, so what the vectors have in common doesn't crowd their signs.
Blocks are cut by rank, so equal or crowded signatures make no large group. The first
passes are as many as the number of classes and their mean cosine ask for; then rounds of
passes follow until one joins no further components. Inside a component, all pairs are
then counted in cells of two blocks, so that a component larger than a window loses no
link. Only sums leave a cell, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded, components
from .minhash import forest, runs

PASSES = 16  #: at least, before the rounds that look for what these missed
ROUND = 8  #: passes whose orders are held at once
SIGNS = 48  #: hyperplanes of a pass
SAMPLE = 768  #: classes that planes are taken from
PLANNED = 64  #: passes at most before the first look for missed links; rounds have no bound
MISS = 1e-4  #: share of linked pairs that the planned passes may miss
BLOCK = 256  #: classes in a block of the order, and in a block of a component
SEED = 17


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec binary): vec is null where a vector is null, empty, zero or has a null or
    non-finite component, or its id is null."""
    kind = vectors.schema[vector_col].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, x in zip(b.column(0), b.column(1), strict=True):
                value = None
                if i.is_valid and x.is_valid and x.values.null_count == 0:
                    v = x.values.to_numpy(zero_copy_only=False).astype(code) + 0  # -0 becomes 0
                    if len(v) and np.isfinite(v).all() and v.any():
                        value = v.tobytes()
                out.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["i", "v"])

    element = "float" if code == "<f4" else "double"
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast(f"array<{element}>"))
    return rows.mapInArrow(run, "id long, vec binary"), code


def cosines(a: list[bytes], b: list[bytes], code: str) -> np.ndarray:
    """Cosine of each of a with each of b; -2 where the dimensions differ."""
    sizes = {len(x) for x in a} | {len(x) for x in b}
    out = np.full((len(a), len(b)), -2.0)
    for size in sizes:
        i, j = (np.flatnonzero([len(x) == size for x in y]) for y in (a, b))
        if not len(i) or not len(j):
            continue
        x, y = (np.frombuffer(b"".join(z[k] for k in w), code).reshape(len(w), -1).astype(np.float64) for z, w in ((a, i), (b, j)))
        if code == "<f8":  # so that no square overflows or vanishes
            x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
        norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        out[np.ix_(i, j)] = (x @ y.T) / norm
    return out


def units(vecs: list[bytes], code: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), code).reshape(len(vecs), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def planes(sample: list[bytes], size: int, code: str, turn: int) -> np.ndarray:
    """The planes of round ``turn`` for vectors of ``size`` bytes, one a column; random ones
    for a dimension that the sample has too seldom."""
    have = [v for v in sample if len(v) == size]
    rng = np.random.default_rng([SEED, size, turn])
    if len(have) < 64:
        return rng.normal(size=(size // np.dtype(code).itemsize, ROUND * SIGNS))
    x = units(have, code)
    a, b = rng.integers(0, len(x), (2, ROUND * SIGNS))
    return (x[a] - x[b]).T


def planned(classes: int, sample: list[bytes], code: str, least: float) -> int:
    """Passes after which all but MISS of the pairs have shared a block, if the classes lie
    evenly around their mean."""
    crowd = 0.0
    for size in {len(v) for v in sample}:
        have = [v for v in sample if len(v) == size]
        if len(have) >= 64:
            crowd = max(crowd, float((units(have, code).mean(0) ** 2).sum()))
    cosine = 1 - (1 - least) / max(1 - crowd, 1e-9)
    stay = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    meet = stay ** max(0.0, math.log2(max(classes, 1) / BLOCK))
    return PLANNED if meet < 0.1 else min(PLANNED, math.ceil(math.log(MISS) / math.log(1 - min(meet, 1 - MISS))))


@bounded
def near_duplicates(vectors: DataFrame, least: float = 0.95, passes: int = PASSES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows whose vectors have a cosine of at least ``least`` are linked; ``n_links`` counts
    the other rows linked directly, ``component_id`` is the smallest id that links reach,
    itself included. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, nor do vectors of different dimension or rows without an
    id (their component is null, and they are kept). Rows that repeat an id are one node of
    the components. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows, code = usable(vectors, id_col, vector_col)
    rows = scratch.save(rows)
    cls = scratch.save(rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("times")).withColumn("cid", F.monotonically_increasing_id()), rows.count())

    classes = cls.count()
    sample = [r.vec for r in cls.orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(SAMPLE).select("vec").collect()]
    shared = spark.sparkContext.broadcast(sample)

    def found_in(turn: int) -> DataFrame:
        """(a, b): linked pairs of round ``turn`` that span what its windows join."""

        def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[int, np.ndarray] = {}
            weight = (1 << np.arange(SIGNS - 1, -1, -1)).astype(np.int64)
            for b in batches:
                vec = b.column(1).to_pylist()
                sign, dim = np.zeros((len(vec), ROUND), np.int64), np.array([len(v) for v in vec], np.int32)
                for size in set(dim.tolist()):
                    i = np.flatnonzero(dim == size)
                    if size not in of:
                        of[size] = planes(shared.value, size, code, turn)
                    sign[i] = ((units([vec[k] for k in i], code) @ of[size]) > 0).reshape(len(i), ROUND, SIGNS) @ weight
                for k in range(ROUND):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), k, np.int32)), pa.array(dim), pa.array(sign[:, k]), b.column(0), b.column(1)], ["p", "d", "s", "r", "v"])

        order = cls.select("rep", "vec").mapInArrow(signed, "pass int, dim int, sign long, rep long, vec binary")
        ordered = order.repartitionByRange("pass", "dim", "sign", "rep").sortWithinPartitions("pass", "dim", "sign", "rep")

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = TaskContext.get().partitionId(), 0
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(n + np.arange(b.num_rows)), b.column(3), b.column(4)], ["q", "n", "r", "v"])
                n += b.num_rows

        ordered = scratch.save(ordered.mapInArrow(placed, "part int, n long, rep long, vec binary"))
        counts = sorted(ordered.groupBy("part").count().collect())  # one row a partition
        before = dict(zip([p for p, _ in counts], np.cumsum([0, *(c for _, c in counts)])[:-1].tolist(), strict=True))
        start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0), F.lit(0))
        block = F.floor((start[F.col("part")] + F.col("n")) / BLOCK)
        near = ordered.select("rep", "vec", block.alias("own"))
        near = near.select("rep", "vec", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("cell"))
        near = near.select("cell", (F.col("cell") == F.col("own")).cast("int").alias("own"), "rep", "vec")

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in runs(batches, 1):
                rep, vec, own = x["rep"].to_numpy(), x["vec"].to_pylist(), np.flatnonzero(x["own"].to_numpy() == 1)
                if not len(own):
                    continue
                i, j = np.nonzero(cosines([vec[k] for k in own], vec, code) >= least)
                i = own[i]
                keep = rep[i] != rep[j]
                found = forest(len(rep), i[keep], j[keep])
                yield pa.RecordBatch.from_arrays([pa.array([int(rep[a]) for a, _ in found], pa.int64()), pa.array([int(rep[b]) for _, b in found], pa.int64())], ["a", "b"])

        found = near.repartition("cell").sortWithinPartitions("cell", "own", "rep").mapInArrow(windows, "a long, b long")
        found = scratch.save(found, ROUND * classes // 4)
        scratch.drop(ordered)
        return found

    need = max(passes, planned(classes, sample, code, least))
    turns = -(-need // ROUND)
    found = found_in(0)
    for turn in range(1, turns):
        found = found.unionByName(found_in(turn))
    reach = scratch.save(components(found, scratch, need * classes // 4), classes)
    while classes > BLOCK:
        left, right = (reach.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in "ab")
        new = found_in(turns).join(left, "a", "left").join(right, "b", "left")
        new = new.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).filter("a != b")
        new = scratch.save(new, classes)
        if not new.count():
            break
        star = reach.select(F.col("node").alias("a"), F.col("component").alias("b"))
        reach = scratch.save(components(star.unionByName(new), scratch, classes), classes)
        turns += 1

    # All pairs inside a component, block against block.
    size = reach.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    place = reach.join(size, "component").select(F.col("node").alias("rep"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    inside = cls.join(place, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = inside.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "cid", "times", "vec")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, 3):
            cid, times, vec, side = x["cid"].to_numpy(), x["times"].to_numpy(), x["vec"].to_pylist(), x["side"].to_numpy()
            if x["i"][0].as_py() == x["j"][0].as_py():
                hit = cosines(vec, vec, code) >= least
                np.fill_diagonal(hit, False)
                total = hit @ times
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                hit = cosines([vec[k] for k in left], [vec[k] for k in right], code) >= least
                total = np.zeros(len(cid), np.int64)
                total[left], total[right] = hit @ times[right], hit.T @ times[left]
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(total.astype(np.int64))], ["c", "l"])

    cell = inside.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "cid")
    link = cell.mapInArrow(counted, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))

    known = cls.join(link, "cid", "left").join(reach.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "vec", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
