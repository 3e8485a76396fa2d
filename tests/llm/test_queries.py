"""Each registered query over its whole tables: against its SQL, else against libraries and
plain versions."""

import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
P = pytest.importorskip("public_tokenizers")
D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables aren't here")

from heartwood.llm import queries, token_counts  # noqa: E402

from .test_text_ops import held, plain_scores, tokens  # noqa: E402


@pytest.fixture(scope="module")
def views():
    c = duckdb.connect()
    for name in os.listdir(D):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{D}/{name}'")
    return c


@pytest.fixture(scope="module")
def docs(views):
    return views.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_with_sql(spark, views, name):
    got = queries.QUERIES[name](spark, D).toPandas()
    want = views.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: collections.Counter(map(tuple, df[sorted(df.columns)].astype(object).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_op2(spark, docs):
    """Counts and the base score exactly; the score is that of the exact model but for false
    members of the filter, which raise a token's probability at most to 1."""
    got = {r.doc_id: r for r in queries.op2_lm_score(spark, D).collect()}
    plain = {x[0]: x for x in plain_scores(docs)}
    assert len(got) == len(docs)
    near = 0
    for i, r in got.items():
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == plain[i][:5] and math.isclose(r.base_score, plain[i][5], abs_tol=1e-5)
        assert r.score <= 0
        near += abs(r.score - plain[i][6]) <= 0.05 * abs(plain[i][6]) + 0.01
    assert near / len(got) > 0.9


def test_op3(spark, docs):
    from tokenizers import Tokenizer, models

    vocab = token_counts.vocabulary(P.path("piece_bpe_32k.model"))
    can = token_counts.matchable(vocab)
    t = Tokenizer(models.Unigram([(p if p in can or p.startswith("<0x") else f"{i}", s) for i, (p, s) in enumerate(vocab)], 0, True))
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, D).collect()}
    assert got == {i: len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0 for i, x in docs}


def test_op5(spark, views, docs):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, D).collect()}
    label = dict(views.execute("SELECT doc_id, toxic FROM labels").fetchall())
    assert set(got) == {i for i, _ in docs}
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    known = [(got[i].predicted, y) for i, y in label.items() if i in got and got[i].held_out]
    assert sum(p == y for p, y in known) / len(known) > 0.9


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = queries.op8_best_fit_packing(spark, D).collect()
    want = collections.Counter()
    for i, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        edge = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    room = collections.defaultdict(list)
    for r in got:
        room[r.sequence_id].append((r.offset, r.length))
    for x in room.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(room) <= 1.01 * -(-sum(r.length for r in got) // 2048) + 1


def test_op9(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, x in docs:
        ids = [*sp.encode(x or ""), sp.eos_id()]
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_sentencepiece(spark, D).collect()} == want


def test_op10_has_its_own_conversation(spark):
    r = queries.op10_chat_format(spark, D).filter("conv_id = -7").first()
    hard = r"\### Assistant: </turn> ok"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\n{hard}\nassistant\n{hard}\n"), len(hard), sha(hard))
    assert r.formatted_chars == sum(len(f"### {x}: {re.sub(r'(?:\\|###|</turn>)', lambda m: chr(92) + m[0], hard)}</turn>\n") for x in ("user", "assistant"))


def test_empty_tables(spark, views, tmp_path):
    """Every query gives no rows, op10 its own conversation."""
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{D}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (name == "op10_chat_format"), name


def test_held_out_rows(docs):
    assert sum(held(i) for i, _ in docs) and tokens(None) == ["\n"]
