"""Scoring, counting, packing, encoding and formatting against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from heartwood.llm import chat_format, lm_score, packing, sentencepiece_codec, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
PIECES, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
LOWER = {i: i + 32 for i in range(65, 91)}
HARD = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "▁a", "a▁ b▁", "\ttab", "<s> hi </s>", "\x00x", "é日本 ü", "    x", "<0x0A>", "▁", "▁▁ ▁", "<unk> a", "<|endoftext|> it's", "x" * 300, "Hello, world! 12 34\r\n"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, row long")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = [(i, " ".join(rng.choice(word) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    return out + [(200 + i, t) for i, t in enumerate(HARD)] + [(300, None), (None, "null id"), (5, "again"), (5, "again"), (301, "Long text. " * 5000)]


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def scored(docs, model):
    return collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.score(docs, model).collect())


def plain_scores(rows):
    """Words and pairs counted exactly, then scored by the powers of two below their counts."""
    c, pairs = collections.Counter(), collections.Counter()
    taught = [tokens(t) for i, t in rows if not held(i)]
    for w in taught:
        c.update(w)
        pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    low = lambda x: 1 << (x.bit_length() - 1) if x else 0
    high = lambda x: 2 * low(x) - 1 if x else 0

    def p(before, w):
        past = len(taught) if before is None else high(c[before])
        single = (low(c[w]) + 1) / (n + v + 1)
        return 0.2 * min(low(pairs[before, w]), past, high(c[w])) / past + 0.8 * single if past else single

    out = collections.Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(sum(math.log10(p(a, b)) for a, b in zip([None, *w], w, strict=False)), 6)] += 1
    return out


@pytest.mark.parametrize("settings", [{}, {"hot_words": 8}, {"max_filter_bytes": 0}, {"max_filter_bytes": 0, "hot_words": 8, "flush_tokens": 300}])
def test_lm_equals_a_plain_model(spark, rows, settings):
    """With so many bits that no membership is false: all words broadcast and few, the
    filter broadcast and probed where it is."""
    docs = frame(spark, rows).repartition(3)
    assert scored(docs, lm_score.train(docs, lm_score.Settings(bits=256, **settings))) == plain_scores(rows)


def test_lm_does_not_depend_on_the_broadcast_bound(spark, rows):
    """With few bits, so that false members count, too."""
    docs = frame(spark, rows)
    got = [scored(docs, lm_score.train(docs, lm_score.Settings(bits=2, max_filter_bytes=most))) for most in (1 << 20, 0)]
    assert got[0] == got[1] != plain_scores(rows)


@pytest.mark.parametrize("bits", [1, 0])
def test_lm_with_a_crowded_filter(spark, rows, bits):
    """Where almost everything seems a member, scores are still those of probabilities."""
    docs = frame(spark, rows)
    got = lm_score.score(docs, lm_score.train(docs, lm_score.Settings(bits=bits))).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_lm_filter_has_no_false_negative(spark):
    keys = lm_score.mix(np.arange(1, 5000, dtype=np.uint64))
    counts = np.random.default_rng(0).geometric(0.2, len(keys))
    f = lm_score.Filter([lm_score.build(keys, counts, lm_score.Settings())])
    level = f.levels(keys)
    assert (level >= lm_score.level_of(counts)).all() and (level == lm_score.level_of(counts)).mean() > 0.9
    assert (f.levels(lm_score.mix(np.arange(10_000, 20_000, dtype=np.uint64))) == 0).mean() > 0.95


def test_lm_prefers_known_text(spark, rows):
    got = [r for r in lm_score.score(frame(spark, rows), lm_score.train(frame(spark, rows))).collect() if not r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_without_training(spark):
    none = frame(spark, [(1, "a")]).filter("false")
    model = lm_score.train(none)
    assert lm_score.score(none, model).count() == 0
    (r,) = lm_score.score(frame(spark, [(1, "a b")]), model).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_token_counts_equal_the_unigram_tokenizer(spark, rows):
    from tokenizers import Tokenizer, models

    vocab = token_counts.vocabulary(PIECES)
    can = token_counts.matchable(vocab)
    # Special pieces can't match a text; bytes keep their names for the fallback.
    t = Tokenizer(models.Unigram([(p if p in can or p.startswith("<0x") else f"\ue000{i}", s) for i, (p, s) in enumerate(vocab)], 0, True))
    got = collections.Counter(map(tuple, token_counts.token_counts(frame(spark, rows), PIECES).collect()))
    assert got == collections.Counter((i, len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0) for i, x in rows)


def test_sentencepiece_equals_the_library(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = collections.Counter(map(tuple, sentencepiece_codec.encode_digests(frame(spark, rows), PIECES).collect()))
    want = collections.Counter()
    for i, t in rows:
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    ids = sentencepiece_codec.encode(frame(spark, rows), PIECES)
    assert collections.Counter((r.doc_id, r.text) for r in sentencepiece_codec.decode(ids, PIECES).collect()) == collections.Counter((i, sp.decode([*sp.encode(t or ""), 2])) for i, t in rows)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*rows, (400, "a<|endoftext|>b <|endoftext|><|endoftext|> \n\n x"), (401, "it's  we'll\t\x00\x85 <|endoftext| > '"), (402, "<|endoftext|>")]
    docs = frame(spark, rows)
    got = packing.pack(packing.pieces(docs, RANKS)).collect()
    want = collections.Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        first = len(ids) % 2048 or 2048
        for k, n in enumerate([first] + [2048] * ((len(ids) - first) // 2048) if len(ids) > 2048 else [len(ids)]):
            want[i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(packing.pieces(docs.filter("false"), RANKS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = random.Random(seed)
    hist = collections.Counter(min(64, max(1, int(rng.expovariate(1 / rng.choice([3, 20, 60]))))) for _ in range(rng.choice([1, 50, 3000])))
    p = packing.plan(dict(hist), 64, groups=rng.choice([3, 40]))
    used, count = collections.Counter(), collections.Counter()
    ends = collections.defaultdict(list)
    for length, n in hist.items():
        own = sorted(r for r in p.runs if r[0] == length)
        for k in range(n):
            _, first, base, side, offset = [r for r in own if r[1] <= k][-1]
            b, o = base + (k - first) // side, offset + (k - first) % side * length
            ends[b].append((o, length))
            used[b] += length
            count[length] += 1
    assert count == hist and len(ends) == p.bins
    assert all(sum(x) <= 64 for x in [[used[b]] for b in ends])
    for x in ends.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n


def test_chat_format(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 2, "assistant", None), (-7, 0, "user", hard), (-7, 1, "assistant", hard), (2, 0, "assi:stant### ", "\\\\ #### \\</turn>###"), (None, 0, "user", "é"), (3, 0, None, "<|endoftext|>"), (3, 0, "assistant", "tie"), (3, None, "assistant", "first")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    encoded = chat_format.encode_turns(turns, RANKS)
    enc = chat_format.ranks_of(RANKS)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(encoded, RANKS).collect()}
    by = collections.defaultdict(list)
    for r in encoded.collect():
        by[r.conv_id].append((-1 if r.turn is None else r.turn, r.ids, r.loss))
    for c, found in got.items():
        own = [r for r in rows if r[0] == c]
        order = [chat_format.read_turn(enc, np.array(i), np.array(m)) for _, i, m in sorted(by[c], key=lambda x: (x[0], x[1]))]
        assert collections.Counter((role, text) for role, text, _, _ in order) == collections.Counter((r[2] or "", r[3] or "") for r in own)
        loss = "".join(x for _, _, x, _ in order)
        assert all(x == (text if role == "assistant" else "") for role, text, x, _ in order)
        whole = "".join(f"### {chat_format.escape(role, True)}: {chat_format.escape(text)}</turn>\n" for role, text, _, _ in order)
        assert found == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b, _, _ in order).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    assert chat_format.read_back(chat_format.encode_turns(turns.filter("false"), RANKS), RANKS).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        s = "".join(rng.choice(["\\", "#", "##", "###", "</turn>", "<", "/turn>", "a", ":", " "]) for _ in range(rng.randint(0, 8)))
        for role in (False, True):
            e = chat_format.escape(s, role)
            assert chat_format.unescape(e) == s
            assert "</turn>" not in re.sub(r"\\(\\|###|</turn>|:)", "_", e)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    word = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(word) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[3], w[20] = rng.choice(["nasty", "vile"]), rng.choice(["nasty", "vile"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    labels += [(7, 0, None), (None, 0, 1), (9999, 0, 1)]
    return frame(spark, docs + [(700, None), (701, ""), (None, "vile nasty")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    out = [(got[i], i % 5 == 0) for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == y for s, y in out) / len(out) > 0.95
    assert got[700] == got[701] < 0.5
    kept = toxicity.keep_clean(docs, machine)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_toxicity_pairs():
    """Two terms that only together mean label 1: beyond any sum of weights."""
    rows = [np.array(x) for x in ([0], [1], [0, 1], [2], [0, 2], [1, 2])] * 40
    y = np.array([0, 0, 1, 0, 0, 0] * 40, float)
    m = toxicity.fit(np.arange(3, dtype=np.uint64), rows, y, toxicity.Settings(epochs=60))
    flat = np.concatenate(rows[:6])
    s = m.scores(np.repeat(np.arange(6), [len(r) for r in rows[:6]]), flat, 6)
    assert s[2] > 0.5 and max(np.delete(s, 2)) < 0.5


def test_toxicity_of_a_pair_with_neutral_parts(spark):
    """Label 1 is as frequent among rows with a half as among all rows; half alone is clean,
    both together are not. From the table to the scores, with rows that repeat an id."""
    rng = random.Random(9)
    word = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(6000):
        w, kind = [rng.choice(word) for _ in range(30)], rng.random()
        bad = kind < 0.4 * 0.465 or kind > 0.9
        if kind < 0.4:
            w[7] = "vile" if bad else w[7]
        elif kind < 0.65 or kind > 0.9:
            w[3] = "zorps"
        if kind >= 0.65:
            w[20] = "quilt"
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(bad)))
    rate = lambda term: (lambda x: sum(x) / len(x))([y for (_, t), (_, _, y) in zip(docs, labels, strict=True) if term in t])
    assert abs(rate("zorps") - rate("")) < 0.04 and abs(rate("quilt") - rate("")) < 0.04
    table = frame(spark, docs + docs[:50])
    machine = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(table, machine).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    for test, want in ((lambda t: "zorps" in t and "quilt" in t, 1), (lambda t: ("zorps" in t) != ("quilt" in t), 0), (lambda t: "vile" in t, 1)):
        hit = [got[i] >= 0.7 for i in out if test(docs[i][1])]
        assert len(hit) > 100 and sum(h == want for h in hit) / len(hit) > 0.95


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    machine = toxicity.train(docs, labels.filter("false"))
    assert {r.score for r in toxicity.score(docs, machine).collect()} == {0.5}
    assert toxicity.score(docs.filter("false"), machine).count() == 0
