"""Each stage of the corpus pipeline on its own input, against a plain version."""

import collections
import random
import re

import pytest

import corpus_pipeline
from heartwood.llm import toxicity

from .test_dedup import plain_components, prose, word_set

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(4)
    shared = prose(rng, 60)
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 120)) + (" vile nasty stuff" if i % 6 == 0 else "")
        rows.append((4 * i, t))
        if i % 4 == 1:
            rows.append((4 * i + 1, t.replace(" ", "\n")))
        if i % 4 == 2:
            rows.append((4 * i + 2, t + " tail"))
        if i % 4 == 3:
            rows.append((4 * i + 3, f"{prose(rng, 30)} {shared} {prose(rng, 30)}"))
    rows += [(1000, None), (1001, ""), (1002, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def plain_cut(rows, window=100):
    """Texts without the bytes of strings that start earlier, too; a character goes whole."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - window + 1):
            w = raw[a : a + window]
            if w in seen:
                gone[a : a + window] = b"\1" * window
            seen.add(w)
        out[i] = bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]

    def stage(name, docs):
        out = STAGE[name](spark, docs, table)
        return out, {r.doc_id: r.text for r in out.collect()}

    have = {r.doc_id: r.text for r in docs.collect()}
    out, got = stage("toxicity", docs)
    score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{table}/labels.parquet"))).collect()}
    assert got == {i: t for i, t in have.items() if score[i] < 0.7} and all("vile" in have[i] for i in set(have) - set(got))
    assert out.columns == docs.columns

    out, after = stage("exact_dedup", out)
    groups = collections.defaultdict(list)
    for i, t in got.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    assert set(after) == {min(g)[1] for g in groups.values()} and out.columns == docs.columns

    out, last = stage("minhash_near_dedup", out)
    sets = [(i, word_set(t)) for i, t in after.items()]
    of = plain_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    assert set(last) == {i for i in after if of[i] == i} and len(last) < len(after)

    out, cut = stage("suffix_array_dedup", out)
    assert cut == plain_cut(list(last.items())) and sum(map(len, cut.values())) < sum(len(t or "") for t in last.values())
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.collect())

    packed = STAGE["best_fit_packing"](spark, out, table).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    length = collections.Counter()
    room = collections.defaultdict(list)
    for r in packed:
        length[r.doc_id] += r.length
        room[r.sequence_id].append((r.offset, r.length))
    assert length == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in cut.items()}
    for x in room.values():
        assert [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(room) <= -(-sum(length.values()) // 2048) + 1


def test_run(spark, table):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, table).count() > 0


def test_stages_keep_odd_rows_and_columns(spark, table):
    """Columns with the names that operators use inside, nulls, repeated rows, a long text."""
    long = "one two three " * 30_000
    rows = [(1, None), (2, ""), (None, "lone words here"), (3, "same words here now again"), (3, "same words here now again"), (4, long)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 7, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, rep long, _t string")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, table)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "rep", "_t"], name
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
        assert {r.rep for r in docs.collect()} == {7}
        if name == "toxicity":
            assert len(got) == 6
        if name == "exact_dedup":
            assert got == [(False, 1, ""), (False, 3, rows[3][1]), (False, 4, long), (True, 0, "lone words here")]
    assert [x[1] for x in got] == [1, 3, 4, 0] and got[2][2].startswith("one two three ") and len(got[2][2]) < 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, table)
    assert {r.doc_id for r in packed.collect()} == {1, 3, 4, None}


def test_empty_tables(spark, table, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{table}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    none = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
