"""Near-duplicates by bottom-k sketches from one hash function, confirmed on full sets.

1. Each document gets its set of hashed shingles, a 128-bit fingerprint of the set and the
   smallest hashes of it (its sketch). Documents with one fingerprint form a class and go
   on as its smallest id.
2. Inverted lists of the smallest retained values generate overlaps. In a list, the union
   of two sketches estimates their similarity; pairs far below the threshold are filtered
   and the rest leave as a spanning forest, never as all pairs. A value in very many
   documents says little of two that share it, so it makes a list only of the documents
   whose sketches consist of such values mostly (copies of a very frequent text).
3. The forests join documents to loose clusters. Exact similarity is computed there on
   full sets, in cells of bounded size: a cluster is cut into blocks, every block meets the
   first one, and after that the documents outside the cluster's main component meet all
   blocks. Pairs that the first step connected already aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, IdFilter, Scratch, bounded, components, mix, shingles, slices, text_array, words

SKETCH = 64  #: values that estimate
HEAD = 24  #: smallest values that may make lists
LISTS = 6  #: lists of less frequent values that a document is in, the smallest values first
FREQUENT = 200  #: documents from which on a value is frequent
BLOCK = 256  #: documents in a block of a large cluster, and
BLOCK_VALUES = 1 << 18  #: the values of their sets together, about
SLACK = 0.25  #: how far below the threshold an estimate may be (over four deviations)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, head array<long>, sketch binary of unsigned 32-bit values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(1))):
                sets = shingles(*words(data, at), size)
                total = lambda s, c: int(mix(s ^ U64(c)).sum(dtype=U64))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([total(s, 0x1D872B41) for s in sets], U64).view(np.int64)), pa.array(np.array([total(s, 0x6A09E667F3BCC908) for s in sets], U64).view(np.int64)),
                    pa.array([s[:HEAD].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([(s[:SKETCH] >> U64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary()),
                ], ["i", "n", "f1", "f2", "h", "s"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n long, f1 long, f2 long, head array<long>, sketch binary")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of consecutive rows whose first ``keys`` columns are equal."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(k[lo])
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (a, b) that connect the same nodes of 0..n, at most n - 1 of them."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(x), find(y)
        if i != j:
            root[max(i, j)] = min(i, j)
            out.append((x, y))
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the sketch of the union: of its smallest values, the share in both.
    Rows are sketches, filled up with the largest value."""
    top = np.uint32(0xFFFFFFFF)
    both = np.sort(np.concatenate([a, b], 1), 1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    fresh = ~again & (both != top)
    place = np.cumsum(fresh, 1)
    seen = np.minimum(place[:, -1], SKETCH)
    return (again & (place <= SKETCH)).sum(1) / np.maximum(seen, 1)


def list_forest(n: np.ndarray, sketch: list[bytes], t: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of one list that the estimate doesn't rule out."""
    g = len(n)
    s = np.full((g, SKETCH), 0xFFFFFFFF, np.uint32)
    for i, x in enumerate(sketch):
        s[i, : len(x) // 4] = np.frombuffer(x, np.uint32)
    a, b = np.triu_indices(g, 1)
    ok = np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b])
    a, b = a[ok], b[ok]
    least = s[:, :12]
    for lo in range(0, len(a), 8192):  # two in common among the smallest twelve
        x, y = least[a[lo : lo + 8192]], least[b[lo : lo + 8192]]
        ok[lo : lo + 8192][: len(x)] = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0xFFFFFFFF)).sum((1, 2)) >= 2
    keep = ok[: len(a)]
    a, b = a[keep], b[keep]
    e = np.concatenate([np.zeros(0), *(estimates(s[a[lo : lo + 4096]], s[b[lo : lo + 4096]]) for lo in range(0, len(a), 4096))])
    keep = e >= t - SLACK
    return forest(g, a[keep], b[keep])


def overlaps(sets: list[np.ndarray], rows: slice, cols: slice) -> np.ndarray:
    """Sizes of the intersections of sets[rows] with sets[cols], exactly."""
    flat, back = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(back, minlength=len(flat)) > 1
    place = np.cumsum(often) - 1
    width = int(often.sum())
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = often[back]
    owner, col = owner[keep], place[back[keep]]
    out = np.zeros((len(range(*rows.indices(len(sets)))), len(range(*cols.indices(len(sets))))), np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, width, 8192):
        i, j = np.searchsorted(col, [lo, lo + 8192])
        m = np.zeros((len(sets), min(8192, width - lo)), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        out += m[rows] @ m[cols].T  # whole numbers below 2**24: exact
    return out


def links(ids: np.ndarray, sets: list[np.ndarray], left: int, t: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose similarity is at least t[0] / t[1]: of all sets
    if ``left`` is 0, else of the first ``left`` with the others."""
    n = np.array([len(s) for s in sets])
    rows = slice(0, left or len(sets))
    cols = slice(left, len(sets))
    if not len(n[rows]) or not len(n[cols]):
        return []
    common = overlaps(sets, rows, cols).astype(np.int64)
    union = n[rows][:, None] + n[cols][None, :] - common
    a, b = np.nonzero((t[1] * common >= t[0] * union) & (common > 0))
    b = b + left
    keep = ids[a] != ids[b] if left else a < b
    return [(int(ids[x]), int(ids[y])) for x, y in forest(len(sets), a[keep], b[keep])]


@bounded
def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (75, 100), size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two rows are linked when t[1] * intersection >= t[0] * union over their shingle sets,
    ``similarity`` being t. ``component_id`` is the smallest id that links reach, ``kept``
    whether it is the row's own. A null text counts as empty; rows without a word have an
    empty set and are linked with nothing. Long texts count whole. Sets hold 64-bit hashes
    of words and of shingles, and links are confirmed on whole sets of them. Repeated rows are linked like any others, and a
    repeated id is one node: rows with it share a component. Rows with a null id get
    n_shingles, a null component and are kept. An empty table gives no rows; other columns
    are not read.
    """
    t = similarity[0] / similarity[1]
    scratch = Scratch(docs.sparkSession, "minhash")
    drawn = scratch.save(sketches(docs, size, id_col, text_col))
    reps = drawn.filter("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "head", "sketch")).alias("x"))
    reps = scratch.save(reps.select("f1", "f2", F.col("x.id").alias("rep"), "n", F.col("x.head").alias("head"), F.col("x.sketch").alias("sketch")), drawn.count())

    # Lists of retained values.
    value = reps.select("rep", F.posexplode("head").alias("r", "v"))
    # Written, as ``held`` is, so that the join's sides are plain exchanges, of which a hot value can be split.
    count = scratch.save(value.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"))
    mine = value.join(count, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("r", "v", "c"))).alias("x"))  # at most HEAD
    part = lambda test: F.transform(F.filter("x", test), lambda y: y.v)
    mine = mine.select("rep", F.slice(part(lambda y: y.c <= FREQUENT), 1, LISTS).alias("rare"), part(lambda y: y.c > FREQUENT).alias("often"))
    mine = mine.join(reps.select("rep", "n", "head", "sketch"), "rep")
    mostly = 2 * F.size("often") >= F.size("head")
    keys = F.concat("rare", F.when(mostly, F.slice("often", 1, LISTS)).otherwise(F.array().cast("array<long>")))
    member = scratch.save(mine.select(F.explode(keys).alias("v"), "rep", "n", "sketch"), reps.count())
    held = scratch.save(member.groupBy("v").agg(F.count("*").alias("c"), F.min("rep").alias("least")).filter("c > 1"))
    member = member.join(held, "v")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        for x in runs(batches, 1):
            rep = x["rep"].to_numpy()
            for i, j in list_forest(x["n"].to_numpy(), x["sketch"].to_pylist(), t):
                a.append(int(rep[i]))
                b.append(int(rep[j]))
            if len(a) > 50_000:
                yield batch()
                a, b = [], []
        yield batch()

    small = member.filter(F.col("c") <= FREQUENT).select("v", "rep", "n", "sketch").repartition("v").sortWithinPartitions("v", "rep")
    loose = small.mapInArrow(pairs, "a long, b long")
    # Frequent values' lists hold documents of little else: each is one loose cluster.
    loose = loose.unionByName(member.filter((F.col("c") > FREQUENT) & (F.col("rep") != F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b")))
    cluster = components(loose, scratch, member.count() // 4).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))

    # Full sets of the clusters' documents, in blocks.
    sized = cluster.join(reps.select("rep", "n"), "rep")
    many = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_VALUES)).cast("int").alias("blocks"))
    place = cluster.join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(4))):
                sets = pa.array([s.tobytes() for s in shingles(*words(data, at), size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(4)), sets], ["c", "r", "b", "n", "s"])

    place = scratch.save(place, member.count() // 4)
    near = place.count()
    text = IdFilter(place, "rep")(text, "rep")
    sets = place.hint("merge").join(text, "rep").select("cluster", "rep", "block", "blocks", "text")
    sets = scratch.save(sets.mapInArrow(full, "cluster long, rep long, block int, blocks int, set binary"), near, 2048)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of (cluster, i, j): rows with side 0, if any, against rows with side 1."""
        for x in runs(batches, 3):
            ids, side = x["rep"].to_numpy(), x["side"].to_numpy()
            found = links(ids, [np.frombuffer(s, U64) for s in x["set"].to_pylist()], int((side == 0).sum()), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([y[0] for y in found], pa.int64()), pa.array([y[1] for y in found], pa.int64())], ["a", "b"])

    def meet(rows: DataFrame) -> DataFrame:
        rows = rows.select("cluster", "i", "j", "side", "rep", "set")
        return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side", "rep").mapInArrow(cells, "a long, b long")

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.when(F.col("block") == 0, every).otherwise(F.array("block"))
    first = scratch.save(meet(sets.select("cluster", "rep", "set", F.lit(0).alias("i"), F.explode(own).alias("j"), F.lit(1).alias("side"))), near, 2048)

    # In clusters of several blocks: what isn't in the main component meets everything.
    wide = sets.filter("blocks > 1").join(components(first, scratch, near), F.col("rep") == F.col("node"), "left")
    wide = wide.withColumn("component", F.coalesce("component", "rep")).drop("node")
    main = wide.groupBy("cluster", "component").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("all"))
    main = main.select("cluster", F.col("x.component").alias("main"), (1 - F.col("x.c") / F.col("all")).alias("share"))
    wide = wide.join(main, "cluster").withColumn("outer", F.ceil(F.col("share") * F.col("blocks")).cast("int")).filter("outer > 0")
    lot = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("outer")).cast("int")
    out0 = wide.filter("component != main").select("cluster", "rep", "set", lot.alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"))
    out1 = wide.select("cluster", "rep", "set", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))
    second = meet(out0.unionByName(out1))

    linked = components(first.unionByName(second), scratch, 8 * near)
    of_class = reps.select("f1", "f2", "n", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("f1", "f2", F.col("n").alias("_n"), F.coalesce("component", "rep").alias("component"))
    out = drawn.select("id", "n", "f1", "f2").join(of_class.withColumnsRenamed({"f1": "g1", "f2": "g2"}), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("_n")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
