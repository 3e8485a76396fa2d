"""Exact, near and substring deduplication against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heartwood.llm import common, exact_dedup, minhash, substring_dedup, toxicity, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, rep long, text_sha256 string"
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    passage = prose(rng, 70)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(40)]
    for i, t in enumerate(base):
        out.append((10 * i, t))
        words = t.split()
        for k in range(rng.randint(0, 3)):
            edited = [w if rng.random() > 0.03 * k else "changed" for w in words]
            out.append((10 * i + k + 1, " ".join(edited)))
        if i % 5 == 0:
            out.append((10 * i + 7, prose(rng, 20) + " " + passage + " " + prose(rng, 20)))
            out.append((10 * i + 8, t.upper().replace(" ", "\n\t ")))
    out += [(901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "One  two"), (906, "ab" * 400), (907, "ab" * 300), (10, base[1]), (908, "x " * 30_000)]
    rng.shuffle(out)
    return out


def test_exact(spark, rows):
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), i == min(groups[norm(t)])[1], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, got)) == want


def test_exact_separates_colliding_hashes(spark):
    docs = frame(spark, [(1, "a"), (2, "b"), (3, " a")])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs, hash_of=lambda t: F.substring(F.md5(t), 1, 0)).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_keep_one(spark, rows):
    got = exact_dedup.keep_one(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_t", "rep", "text_sha256"]
    assert got.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def word_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows, linked):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if i != j and linked(a, b) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def check_near(spark, rows):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    sets = [(i, word_set(t)) for i, t in rows]
    of = plain_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    assert got == {(i, len(s), of[i], of[i] == i) for i, s in sets}


def test_near(spark, rows):
    check_near(spark, rows)


def test_near_in_a_large_group(spark, monkeypatch):
    """Frequent values and clusters of several blocks: the limits lowered so that a small
    group takes the ways of a large one."""
    monkeypatch.setattr(minhash, "FREQUENT", 6)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, 60) + " " + " ".join(base[:20])) for i in range(20)]
    check_near(spark, rows)


def test_near_null_ids(spark):
    got = sorted(minhash.near_duplicates(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (None, None)])).collect(), key=str)
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(False, 2, 1, True)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def plain_repeats(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - window + 1):
            w = raw[a : a + window]
            if w in seen:
                gone[a : a + window] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        out[i] = (len(raw), int(gone.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("split", [1000, 2])
def test_repeats(spark, rows, monkeypatch, split):
    monkeypatch.setattr(substring_dedup, "SPLIT", split)
    rows = [*dict(rows).items(), (3000, prose(random.Random(8), 9000) + " x" * 20_000)]
    rows += [(2000 + i, f"{i} " * 5 + "é" * 80 + "tail" * 20 + f" {i * 7919}") for i in range(6)]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digests(frame(spark, rows)).collect()}
    assert got == plain_repeats(rows)


def test_long_texts_go_in_blocks(monkeypatch):
    """The kernels give the same whatever the size of their blocks."""
    rng = random.Random(2)
    rows = [prose(rng, n).encode() for n in (0, 5, 900, 1, 0, 3000, 40)] + [b"x" * 3000, b""]
    data, at = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    whole = common.words(data, at), toxicity.terms(data, at), substring_dedup.stretches(data, at, 100)
    place = whole[2][0] + whole[2][2]
    assert (substring_dedup.hashes_at(data, place) == whole[2][3]).all()
    monkeypatch.setattr(common, "SLICE_BYTES", 700)
    cut = common.words(data, at), toxicity.terms(data, at), substring_dedup.stretches(data, at, 100)
    assert all((a == b).all() for a, b in zip(whole[0], cut[0], strict=True))
    assert sorted(zip(*whole[1], strict=True)) == sorted(zip(*cut[1], strict=True))
    # Cut stretches cover the same windows, with the same minimiser for each.
    each = lambda x: sorted((s + k, h, s + m) for s, w, m, h in zip(*(v.tolist() for v in x), strict=True) for k in range(w))
    assert each(whole[2]) == each(cut[2])


def test_repeats_keep_columns_and_characters(spark):
    docs = frame(spark, [(1, "é" * 60), (2, "x" + "é" * 60 + "y"), (None, None)])
    got = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    assert docs.columns == substring_dedup.without_repeats(docs).columns
    assert got[1].text == "é" * 60 or set(got[1].text) <= {"é"}
    assert got[2].text.startswith("x") and got[2].text.endswith("y") and got[None].text == ""


def test_repeats_of_one_id(spark):
    text = "the quick brown fox " * 9
    got = substring_dedup.digests(frame(spark, [(1, text), (1, text), (None, text)])).collect()
    own = [r for r in got if r.doc_id == 1]
    assert len(got) == 3 and own[0] == own[1]
    assert next(r for r in got if r.doc_id is None).n_removed == len(text)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows, base = [], rng.normal(size=(30, 16))
    for i in range(150):
        rows.append((i, (base[i % 30] + 0.12 * rng.normal(size=16)).astype(np.float32).tolist()))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0.0] * 16), (203, None), (204, [float("nan")] * 16), (205, [None] + [1.0] * 15), (206, []), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [1.0] * 15 + [float("inf")])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(vectors(spark, rows)).collect()}
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    near = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    n = {i: sum(near(i, j) for j, _ in rows if j != i) for i, _ in rows}
    of = plain_components([(i, i) for i, _ in rows], near)
    assert got == {i: (n[i], of[i], of[i] == i) for i, _ in rows}


def test_vectors_that_repeat_an_id(spark):
    """Rows of one id are one node: they join what either is near to."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(vectors(spark, rows)).collect() if r.vec_id)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_vectors_that_crowd(spark, monkeypatch):
    """Vectors around one direction, where a few passes of small blocks miss pairs."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(0.8 * unit(rng.normal(size=(1, 32))) + 0.6 * unit(rng.normal(size=(2000, 32))))
    y = unit(x[:200] + 0.3 * unit(rng.normal(size=(200, 32))))
    x = np.concatenate([x, y]).astype(np.float32)
    wide = unit(x.astype(np.float64))
    hit = wide @ wide.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit.sum() >= 300
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(vectors(spark, list(enumerate(x.tolist())))).collect()}
    assert [got[i] for i in range(len(x))] == hit.sum(1).tolist()


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).filter("false")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert substring_dedup.digests(none).count() == 0
    assert vector_dedup.near_duplicates(vectors(spark, [(1, [1.0])]).filter("false")).count() == 0
