"""Toxicity by a factorization machine over hashed terms.

Terms are words and the first bytes of words, as 64-bit hashes. The machine adds a weight
for each term and an inner product of factor vectors for each pair of terms, so an insult
and a mention that are mild alone can weigh much together. It is fitted on a bounded,
documented sample of the labelled rows; every text is scored whole, in one pass without a
shuffle, against a broadcast model whose size the parameters fix.

A term is known to the machine if label 1 has it more often than chance, or if it is half
of a pair that label 1 has more often than either half: a mention that says nothing alone
comes in by the pairs it makes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64, bounded, mix, slices, text_array

#: Characters that part terms: the word separators and punctuation.
APART = common.SEPARATOR.copy()
APART[[ord(c) for c in ".,;:!?\"'()[]{}"]] = True
PREFIX_BYTES = 5


@dataclass(frozen=True)
class Settings:
    max_rows: int = 20_000  #: labelled rows to fit on: those with the smallest hashed ids
    max_terms: int = 16_384  #: terms kept, by how much more label 1 has them than by chance
    min_rows: int = 3  #: of the sample's rows that must have a term
    min_strength: float = 12.0  #: chi-squared that a term must reach, so that chance ones don't explain rows away
    pair_terms: int = 2048  #: terms whose pairs are counted: those that most rows of label 1 have
    pair_share: float = 0.4  #: of the sample's rows that may have such a term at most
    pair_strength: float = 45.0  #: chi-squared of a pair against the larger rate of its halves, among some 2 million pairs
    factors: int = 8
    alone: float = 0.5  #: share of the passes that fit weights before factors join
    epochs: int = 50  #: at least; more where that makes fewer than min_steps batches
    min_steps: int = 6000
    batch: int = 128
    rate: float = 0.15
    decay: float = 1e-4  #: of weights; a pair should matter only beyond what its terms do
    factor_decay: float = 0.01
    seed: int = 5


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, row of each) of concatenated rows; a term may come repeatedly."""
    if len(data) > 2 * common.SLICE_BYTES:
        parts = [_terms(*x) for x in common.blocks(data, at, APART)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _terms(data, at)


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    apart = APART[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = ~apart
    last = first.copy()
    first[1:] &= apart[:-1] | edge[1:n]
    last[:-1] &= apart[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(common._BYTE[common.LOWER[data]] * common._power(common._P, n)[:n], out=total[1:])
    back = common._power(common._P_INV, n)[s]
    row = np.searchsorted(at, s, "right") - 1
    whole = mix((total[e] - total[s]) * back + U64(1))
    long = e - s > PREFIX_BYTES
    part = mix((total[s[long] + PREFIX_BYTES] - total[s[long]]) * back[long] + U64(2))
    return np.concatenate([whole, part]), np.concatenate([row, row[long]])


def value(row: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.bincount(row, minlength=n), 1)[row] ** -0.25


class Machine:
    """score(x) = sigmoid(bias + x . weight + sum over pairs of x_i x_j factor_i . factor_j).

    x has n ** -1/4 for each of a row's n known terms, so that one term alone speaks up.
    """

    def __init__(self, known: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.known, self.bias, self.weight, self.factor = known, bias, weight, factor
        self.maybe = np.zeros(1 << 22, bool)  # leading bits that some known term has
        self.maybe[known >> U64(42)] = True

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, known term) pairs, distinct and in order."""
        h, row = terms(data, at)
        keep = self.maybe[h >> U64(42)]
        h, row = h[keep], row[keep]
        ix = np.searchsorted(self.known, h)
        ix[ix == len(self.known)] = 0
        hit = self.known[ix] == h if len(self.known) else np.zeros(len(h), bool)
        pair = np.unique(row[hit] * (len(self.known) + 1) + ix[hit])
        return pair // (len(self.known) + 1), pair % (len(self.known) + 1)

    def scores(self, row: np.ndarray, ix: np.ndarray, n: int) -> np.ndarray:
        x = value(row, n)
        z = np.full(n, self.bias)
        z += np.bincount(row, x * self.weight[ix], n)
        for f in range(self.factor.shape[1]):
            v = x * self.factor[ix, f]
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(known: np.ndarray, rows: list[np.ndarray], y: np.ndarray, s: Settings) -> Machine:
    """AdaGrad over mini-batches of rows of known terms."""
    rng = np.random.default_rng(s.seed)
    k, n = len(known), len(rows)
    rate = (y.sum() + 1) / (n + 2) if n else 0.5
    bias = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(k), rng.normal(0, 0.01, (k, s.factors))
    gw, gv, gb = np.full(k, 1e-2), np.full((k, s.factors), 1e-2), 1e-2
    batches = -(-n // s.batch)
    passes = max(s.epochs, -(-s.min_steps // max(1, batches)))
    for turn in range(passes):
        pairs = turn >= s.alone * passes
        order = rng.permutation(n)
        for lo in range(0, n, s.batch):
            part = order[lo : lo + s.batch]
            ix = np.concatenate([rows[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            m = Machine.__new__(Machine)
            m.bias, m.weight, m.factor = bias, w, v if pairs else v[:, :0]
            err = m.scores(row, ix, len(part)) - y[part]
            used, back = np.unique(ix, return_inverse=True)
            x = value(row, len(part))
            dw = np.bincount(back, err[row] * x, len(used)) + s.decay * w[used]
            gw[used] += dw**2
            gb += err.sum() ** 2
            w[used] -= s.rate * dw / np.sqrt(gw[used])
            bias -= s.rate * err.sum() / np.sqrt(gb)
            if pairs:
                total = np.zeros((len(part), s.factors))
                np.add.at(total, row, x[:, None] * v[ix])
                dv = np.zeros((len(used), s.factors))
                np.add.at(dv, back, (err[row] * x)[:, None] * (total[row] - x[:, None] * v[ix]))
                dv += s.factor_decay * v[used]
                gv[used] += dv**2
                v[used] -= s.rate * dv / np.sqrt(gv[used])
    return Machine(known, bias, w, v)


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3 == 1


@bounded
def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine fitted on labelled rows that are not held out.

    Rows without an id, label or text don't teach; of repeated labels of an id the larger
    counts, and rows that repeat an id each teach. Empty texts teach the bias. Without any
    row the machine scores every text 0.5. Long texts count whole; columns other than id,
    text and label are not read.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(settings.max_rows)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_t is not null")
    rows = text.join(F.broadcast(sample), "_id").select("_id", "_y", "_t")  # the sample's size is bounded

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy()
            for lo, _, data, at in slices(text_array(b.column(2))):
                h, row = terms(data, at)
                # Rows a term is in, of either class, added up before the shuffle.
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                u, back = np.unique(h[once], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(back, minlength=len(u))), pa.array(np.bincount(back, label[lo + row[once]], len(u)).astype(np.int64))], ["h", "n", "y"])

    scratch = common.Scratch(spark, "toxicity")
    rows = scratch.save(rows)
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n:
        return Machine(np.zeros(0, U64), 0.0, np.zeros(0), np.zeros((0, settings.factors)))
    counts = rows.mapInArrow(listed, "h long, n long, y long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    expected = F.col("n") * F.lit(pos / n)
    strength = (F.col("y") - expected) ** 2 / (expected * (1 - pos / n) + 1e-9)
    counts = scratch.save(counts.filter(F.col("n") >= settings.min_rows))
    best = counts.filter((F.col("y") > expected) & (strength >= settings.min_strength)).orderBy(strength.desc(), "h").limit(settings.max_terms)
    often = counts.filter((F.col("n") <= settings.pair_share * n) & (F.col("y") > 0)).orderBy(F.col("y").desc(), "h").limit(settings.pair_terms)
    listed_hashes = lambda df: np.sort(df.select("h").toArrow()["h"].to_numpy().view(U64))
    alone, often = listed_hashes(best), listed_hashes(often)  # at most max_terms and pair_terms
    _, label, at, ix = _sample_rows(rows, often)
    known = np.union1d(alone, often[_paired(label, at, ix, len(often), settings)])
    ids, label, at, ix = _sample_rows(rows, known)
    order = np.lexsort((label, ids))
    return fit(known, [ix[at[i] : at[i + 1]] for i in order], label[order].astype(float), settings)


def _sample_rows(rows: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, offsets, places of known terms) of the sample's rows, on the driver: at
    most max_rows rows of distinct known terms."""
    probe = Machine(known, 0.0, np.zeros(len(known)), np.zeros((len(known), 1)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(2))):
                row, ix = probe.rows(data, at)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(ix.astype(np.int32)))], ["i", "y", "x"])

    got = rows.mapInArrow(kept, "i long, y int, x array<int>").toArrow().combine_chunks()
    x = got["x"].combine_chunks()
    return got["i"].to_numpy(), got["y"].to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]), x.flatten().to_numpy().astype(np.int64)


def _paired(label: np.ndarray, at: np.ndarray, ix: np.ndarray, terms: int, s: Settings) -> np.ndarray:
    """Places of the terms that are half of a telling pair, by whole counts of all pairs."""
    n, y = np.zeros((terms, terms), np.float32), np.zeros((terms, terms), np.float32)
    for lo in range(0, len(label), 2048):
        hi = min(lo + 2048, len(label))
        x = np.zeros((hi - lo, terms), np.float32)
        x[np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), ix[at[lo] : at[hi]]] = 1
        n += x.T @ x  # whole numbers below 2**24: exact
        x = x[label[lo:hi] == 1]
        y += x.T @ x
    rate = np.diag(y) / np.maximum(np.diag(n), 1)
    base = np.clip(np.maximum(rate[:, None], rate[None, :]), label.mean() if len(label) else 0.5, 1 - 1e-6)
    told = (n >= s.min_rows) & (y > n * base) & ((y - n * base) ** 2 >= s.pair_strength * n * base * (1 - base))
    np.fill_diagonal(told, False)
    return np.flatnonzero(told.any(1))


@bounded
def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row's whole text; null and empty texts score as having no term.

    Null ids and repeated rows are carried through; an empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.known, machine.bias, machine.weight, machine.factor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(1))):
                row, ix = m.rows(data, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(m.scores(row, ix, hi - lo))], ["i", "s"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, score double")


@bounded
def keep_clean(docs: DataFrame, machine: Machine, reject: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below ``reject``."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.known, machine.bias, machine.weight, machine.factor))
    at_col = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*shared.value)
        for b in batches:
            low = [m.scores(*m.rows(data, at), hi - lo) < reject for lo, hi, data, at in slices(text_array(b.column(at_col)))]
            yield b.filter(pa.array(np.concatenate(low))) if low else b

    return docs.mapInArrow(run, docs.schema)
