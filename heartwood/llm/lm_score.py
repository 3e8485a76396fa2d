"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Words and word pairs of the training documents are counted over the whole corpus: each
task adds up its own, and sorted blocks of (hash, count) meet by leading hash bits. A
count c is kept as its level 1 + floor(log2 c): the filter holds (n-gram, 1) up to (n-gram,
level), and a lookup probes rising levels until one is missing, up to the highest level
that training gave its bucket. A bucket's n-grams fill their own stretch of the filter, so
it is built in parallel, with the same bits for each level at every size.

Every word and every pair is scored by its level in the filter, whatever its frequency and
the size of the corpus. A filter of at most ``Settings.max_filter_bytes`` is broadcast. A
larger one stays where it is: each task sends the distinct n-grams of its documents to the
buckets that hold their stretches, and levels come back by position. Both ways probe the
same stretches and give the same scores.

The exact unigram counts that only the base score needs are broadcast for the frequent
words (a bounded number of them) and joined by hash for the others; either way the sums
are the same.

Words and pairs are told apart by 64-bit hashes of their bytes. In the filter an n-gram is
its bucket and 32 more bits of its hash, which is all that travels there; buckets grow in
number with the input, so they don't crowd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, bounded, distinct, mix, slices, text_array, words

END, BEGIN = U64(0xE703), U64(0xBE61)  # the end token, and what stands before the first word
LEVELS = 64


@dataclass(frozen=True)
class Settings:
    max_filter_bytes: int = 64 << 20  #: of a filter that is broadcast; a larger one is probed where it is
    bits: int = 8  #: of the filter for each level of each n-gram
    hot_words: int = 1 << 20  #: bound of the broadcast words with exact counts, for the base score
    flush_tokens: int = 2_000_000  #: that a task counts, or looks up, before it sends blocks
    trust: float = 0.2  #: weight of a pair's relative frequency; the rest is the unigram's


def held_out(doc_id: Column) -> Column:
    """Rows that the model doesn't learn from; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(True))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with each row's end, the token before each, each row's first token)."""
    h, first = words(data, at)
    rows = len(at) - 1
    seq = np.insert(h, first[1:], END)
    start = first + np.arange(rows + 1)
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[start[:-1]] = BEGIN
    return seq, before, start


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xA24BAED4963EE407) + mix(token + U64(7)))


def word_key(token: np.ndarray) -> np.ndarray:
    return mix(token + U64(0x51ED270B))


def trim(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Keys with their bucket (the bits from ``shift`` on) and the next 32 bits alone."""
    low = shift - U64(32)
    return keys >> low << low


def packed(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The 32 bits behind the bucket."""
    return (keys >> (shift - U64(32))).astype(np.uint32)


def unpacked(bucket: int, keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (U64(bucket) << shift) | (keys.astype(U64) << (shift - U64(32)))


def level_of(count: np.ndarray) -> np.ndarray:
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def positions(keys: np.ndarray, level: int | np.ndarray, bits: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    g = mix(keys + np.asarray(level).astype(U64) * U64(0x9E3779B97F4A7C15))
    a, b = g & U64(0xFFFFFFFF), (g >> U64(32)) | U64(1)
    for _ in range(probes):
        yield (a * bits) >> U64(32)
        a = (a + b) & U64(0xFFFFFFFF)


@dataclass(frozen=True)
class Stretch:
    """One bucket's part of the filter."""

    bits: bytes
    probes: int
    top: int  #: the highest level of its n-grams; no lookup goes beyond


EMPTY = Stretch(bytes(8), 1, 0)


def build(keys: np.ndarray, counts: np.ndarray, s: Settings) -> Stretch:
    level = level_of(counts)
    n = int(level.sum())
    bits = max(64, min(n * s.bits, 2**32 - 64)) // 64 * 64
    probes = int(np.clip(round(0.69 * bits / max(n, 1)), 1, 8))
    have, top = np.zeros(bits, bool), int(level.max(initial=0))
    for j in range(1, top + 1):
        k = keys[level >= j]
        for p in positions(k, j, U64(bits), probes):
            have[p] = True
    return Stretch(np.packbits(have, bitorder="little").tobytes(), probes, top)


class Filter:
    def __init__(self, stretches: list[Stretch]):
        """stretches: of all buckets, a power of two of them."""
        self.shift = U64(64 - (len(stretches).bit_length() - 1))
        self.bits = np.array([len(x.bits) * 8 for x in stretches], U64)
        self.start = np.concatenate([[0], np.cumsum(self.bits // U64(8))[:-1]]).astype(U64)
        self.probes = np.array([x.probes for x in stretches])
        self.top = np.array([x.top for x in stretches])
        self.data = b"".join(x.bits for x in stretches)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level of a run of members from 1; 0 without one."""
        data = np.frombuffer(self.data, np.uint8)
        out = np.zeros(len(keys), np.uint8)
        of = (keys >> self.shift).astype(np.int64) if len(self.probes) > 1 else np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for j in range(1, LEVELS):
            alive = alive[self.top[of[alive]] >= j]
            if not len(alive):
                break
            bucket = of[alive]
            bits, start, probes = self.bits[bucket], self.start[bucket], self.probes[bucket]
            hit = np.ones(len(alive), bool)
            for i, p in enumerate(positions(keys[alive], j, bits, int(probes.max(initial=0)))):
                hit &= ((data[start + (p >> U64(3))] >> (p & U64(7)).astype(np.uint8)) & 1).astype(bool) | (i >= probes)
            alive = alive[hit]
            out[alive] = j
        return out


@dataclass
class Model:
    stretches: DataFrame  #: (b, bits, probes, top)
    buckets: int
    size: int  #: bytes of all stretches
    hot: np.ndarray  #: sorted hashes of the frequent words
    hot_count: np.ndarray
    others: DataFrame  #: (h, c): all other words with their exact counts
    total: int  #: tokens
    distinct: int
    rows: int  #: training documents, so how often BEGIN comes
    settings: Settings

    def filter(self) -> Filter:
        """All of it; for a size that may be broadcast."""
        found = {r.b: Stretch(bytes(r.bits), r.probes, r.top) for r in self.stretches.collect()}
        return Filter([found.get(i, EMPTY) for i in range(self.buckets)])


@bounded
def train(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the rows that are not held out.

    A null or empty text teaches its end token alone. Rows without an id are held out;
    repeated rows each teach. An empty training table gives a model of no words, whose
    probability for any token is 1. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    taught = docs.filter(~held_out(F.col(id_col))).select(text_col)
    spread = max(64, 1 << (4 * docs.rdd.getNumPartitions() - 1).bit_length())
    shift = U64(64 - (spread.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray]] = []
        n = rows = 0

        def flush() -> pa.RecordBatch:
            word, wc = summed(np.concatenate([x for x, _ in have]))
            pair, pc = summed(trim(np.concatenate([x for _, x in have]), shift))
            place = np.argsort(word_key(word), kind="stable")  # words go by the bucket of their key in the filter
            word, wc = word[place], wc[place]
            cut = [np.searchsorted(k >> shift, np.arange(spread + 1, dtype=U64)) for k in (word_key(word), pair)]
            some = np.flatnonzero((np.diff(cut[0]) > 0) | (np.diff(cut[1]) > 0))  # of a wide spread a task fills few
            part = lambda a, c, kind: pa.array([a[c[i] : c[i + 1]].astype(kind).tobytes() for i in some], pa.binary())
            seen = np.zeros(len(some), np.int64)
            seen[0] = rows
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen), part(word, cut[0], U64), part(wc, cut[0], np.int64), part(packed(pair, shift), cut[1], np.uint32), part(pc, cut[1], np.int32)], ["b", "r", "w", "wc", "p", "pc"])

        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(0))):
                seq, before, _ = tokens(data, at)
                have.append((seq, pair_key(before, seq)))
                n, rows = n + len(seq), rows + hi - lo
                if n >= s.flush_tokens:
                    yield flush()
                    have, n, rows = [], 0, 0
        if rows:
            yield flush()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole = lambda c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table[c].to_pylist())])
        word, wc = summed(whole("w", U64), whole("wc", np.int64))
        pair, pc = summed(unpacked(key[0].as_py(), whole("p", np.uint32), shift), whole("pc", np.int32).astype(np.int64))
        x = build(np.concatenate([trim(word_key(word), shift), pair]), np.concatenate([wc, pc]), s)
        by_level = np.bincount(level_of(wc), minlength=LEVELS)
        return pa.table({
            "b": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([sum(table["r"].to_pylist())], pa.int64()), "bits": pa.array([x.bits], pa.binary()), "probes": pa.array([x.probes], pa.int32()), "top": pa.array([x.top], pa.int32()),
            "w": pa.array([word.tobytes()], pa.binary()), "wc": pa.array([wc.tobytes()], pa.binary()), "total": pa.array([int(wc.sum())], pa.int64()), "by_level": pa.array([by_level], pa.list_(pa.int64())),
        })

    blocks = taught.mapInArrow(count, "b int, r long, w binary, wc binary, p binary, pc binary")
    schema = "b int, rows long, bits binary, probes int, top int, w binary, wc binary, total long, by_level array<long>"
    merged = scratch.save(blocks.groupBy("b").applyInArrow(merge, schema))
    level = merged.select(F.posexplode("by_level").alias("j", "n")).groupBy("j").agg(F.sum("n"))
    by_level = np.zeros(LEVELS, np.int64)
    for j, n in level.collect():  # LEVELS rows
        by_level[j] = n
    total, rows, size = merged.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()
    least = LEVELS  # the lowest level whose words and those above are few enough
    while least > 1 and by_level[least - 1 :].sum() <= s.hot_words:
        least -= 1

    def listed(hot: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w, c = np.frombuffer(w, np.int64), np.frombuffer(c, np.int64)
                    keep = (level_of(c) >= least) == hot
                    yield pa.RecordBatch.from_arrays([pa.array(w[keep]), pa.array(c[keep])], ["h", "c"])

        return merged.select("w", "wc").mapInArrow(run, "h long, c long")

    hot = listed(True).toArrow()  # at most hot_words rows
    h, c = hot["h"].to_numpy().view(U64), hot["c"].to_numpy()
    order = np.argsort(h)
    return Model(merged.select("b", "bits", "probes", "top"), spread, size, h[order], c[order], listed(False), total, int(by_level.sum()), rows, s)


def lookup(known: np.ndarray, count: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), np.int64)
    ix = np.searchsorted(known, h)
    ix[ix == len(known)] = 0
    return np.where(known[ix] == h, count[ix], 0)


def log_probabilities(seq: np.ndarray, before: np.ndarray, levels: Callable[[np.ndarray], np.ndarray], total: int, distinct: int, rows: int, trust: float) -> np.ndarray:
    """log10 of each token's probability, at most 0.

    A level j says that a count is at least 2 ** (j - 1), which stands for the count, and
    below 2 ** j, which bounds that of a history; so over all tokens the probabilities
    after a history add up to 1 at most, as far as members of the filter are true ones.
    ``levels`` gives those of sorted distinct keys.
    """
    word, place = np.unique(np.append(seq, before), return_inverse=True)
    own, past = place[: len(seq)], place[len(seq) :]
    key, back = np.unique(np.concatenate([word_key(word), pair_key(before, seq)]), return_inverse=True)
    found = levels(key).astype(np.int64)[back]
    level, pair = found[: len(word)], found[len(word) :]
    low, high = (1 << level) >> 1, (1 << level) - 1
    single = np.minimum(low[own] + 1, total + 1) / (total + distinct + 1)
    history = np.where(before == BEGIN, rows, high[past])
    both = np.minimum(np.minimum((1 << pair) >> 1, history), high[own])
    weight = np.where(history > 0, trust, 0.0)
    return np.minimum(np.log10(weight * both / np.maximum(history, 1) + (1 - weight) * single), 0.0)


@bounded
def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone. Null ids and repeated rows each get a row;
    an empty table gives none; other columns are not read. Long texts are scored whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held"), F.col(text_col).alias("text"))
    schema = "row long, id long, held boolean, n long, known long, base double, score double, h array<long>, times array<long>"
    exact = spark.sparkContext.broadcast((m.hot, m.hot_count))  # at most hot_words of them
    facts = (m.total, m.distinct, m.rows, m.settings.trust)
    flush_tokens, buckets = m.settings.flush_tokens, m.buckets
    shift = U64(64 - (buckets.bit_length() - 1))

    def scored(first: int, ids: pa.Array, held: pa.Array, data: np.ndarray, at: np.ndarray, levels: Callable) -> pa.RecordBatch:
        """Rows numbered from ``first``, with the distinct words that have no hot count and how often they come."""
        seq, before, start = tokens(data, at)
        logp = log_probabilities(seq, before, levels, *facts)
        word, back = np.unique(seq, return_inverse=True)
        count = lookup(*exact.value, word)[back]
        n = len(at) - 1
        row = np.repeat(np.arange(n), np.diff(start))
        known = count > 0
        order = np.lexsort((seq[~known], row[~known]))
        r, h = row[~known][order], seq[~known][order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        lead = np.flatnonzero(new)
        cut = pa.array(np.searchsorted(r[lead], np.arange(n + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(first + np.arange(n)), ids, held, pa.array(np.diff(start)), pa.array(np.bincount(row[known], minlength=n)), pa.array(np.bincount(row, np.log10(count + 1.0), n)), pa.array(np.bincount(row, logp, n)),
            pa.ListArray.from_arrays(cut, pa.array(h[lead].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(lead, len(h))))),
        ], ["row", "id", "held", "n", "known", "base", "score", "h", "times"])

    if m.size <= m.settings.max_filter_bytes:
        shared = spark.sparkContext.broadcast(m.filter())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = TaskContext.get().partitionId() << 36
            for b in batches:
                for lo, hi, data, at in slices(text_array(b.column(2))):
                    yield scored(first, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), data, at, lambda k: shared.value.levels(trim(k, shift)))
                    first += hi - lo

        rows = docs.mapInArrow(run, schema)
    else:
        rows = _scored_by_bucket(docs, m, scratch, scored, schema, flush_tokens, shift)
    rows = scratch.save(rows)
    rest = rows.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    # A word that training lacks adds log10(1) = 0 and isn't known, so it needs no row here.
    rest = rest.join(m.others, "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("also"))
    out = rows.drop("h", "times").join(rest, "row", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n") * F.log10(F.lit(float(m.total + m.distinct + 1)))).alias("base_score"),
        "score",
    )


def _scored_by_bucket(docs: DataFrame, m: Model, scratch: Scratch, scored: Callable, schema: str, flush_tokens: int, shift: np.uint64) -> DataFrame:
    """Where the filter is too large to broadcast: documents are cut into lots, a lot's
    distinct n-grams meet their buckets' stretches, and the levels come back to the lot."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn, n = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            for lo, hi, data, at in slices(text_array(b.column(2))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, (task << 24) + turn)), *(b.column(i).slice(lo, hi - lo) for i in range(3))], ["lot", "id", "held", "text"])
                n += len(data) // 6 + hi - lo  # about so many tokens
                if n >= flush_tokens:
                    turn, n = turn + 1, 0

    lots = scratch.save(docs.mapInArrow(dealt, "lot long, id long, held boolean, text string"))

    def keys_of(text: pa.Array) -> np.ndarray:
        parts = [trim(word_key(BEGIN.reshape(1)), shift)]
        for _, _, data, at in slices(text_array(text)):
            seq, before, _ = tokens(data, at)
            parts.append(distinct(trim(np.concatenate([word_key(seq), pair_key(before, seq)]), shift)))
        return distinct(np.concatenate(parts))

    def asked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = keys_of(table["text"])
        b, first = np.unique((keys >> shift).astype(np.int64), return_index=True)
        cut, keys = np.append(first, len(keys)).tolist(), packed(keys, shift)
        return pa.table({"b": pa.array(b.astype(np.int32)), "lot": pa.array(np.full(len(b), key[0].as_py())), "keys": pa.array([keys[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def answered(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        x = Stretch(right["bits"][0].as_py(), right["probes"][0].as_py(), right["top"][0].as_py()) if right.num_rows else EMPTY
        one, b = Filter([x]), key[0].as_py()
        return pa.table({"lot": left["lot"], "b": left["b"], "levels": pa.array([one.levels(unpacked(b, np.frombuffer(k.as_py(), np.uint32), shift)).tobytes() for k in left["keys"]], pa.binary())})

    # All columns, as in the cogroup below, so that both read one exchange of the lots.
    need = lots.groupBy("lot").applyInArrow(asked, "b int, lot long, keys binary")
    found = need.groupBy("b").cogroup(m.stretches.groupBy("b")).applyInArrow(answered, "lot long, b int, levels binary")

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        keys = keys_of(left["text"])
        order = np.argsort(right["b"].to_numpy())  # buckets are leading bits, so this is the order of the keys
        level = np.frombuffer(b"".join(right["levels"][i].as_py() for i in order.tolist()), np.uint8)
        first, out = key[0].as_py() << 28, []
        for b in left.combine_chunks().to_batches():
            for lo, hi, data, at in slices(text_array(b.column("text"))):
                out.append(scored(first, b.column("id").slice(lo, hi - lo), b.column("held").slice(lo, hi - lo), data, at, lambda k: level[np.searchsorted(keys, trim(k, shift))]))
                first += hi - lo
        return pa.Table.from_batches(out)

    return lots.groupBy("lot").cogroup(found.groupBy("lot")).applyInArrow(run, schema)
