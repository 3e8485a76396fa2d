"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings. Null, zero and non-finite vectors link with nothing; repeated ids
    are one node; an empty table gives no rows; labels and other columns are not read."""
    from .vector_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. A null or empty text is its end token; rows without an id are held
    out; repeated rows count and score each; an empty table gives no rows."""
    from . import lm_score

    docs = _table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. Null and empty texts have no token; null ids and repeated rows are
    carried through; an empty table gives no rows."""
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. Null, empty and blank texts are one group; ties go to the smallest
    id, null ids last; repeated rows each get a row; an empty table gives no rows."""
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents, learning from labels. Null and empty texts score as texts without
    any known term; rows without an id are held out; repeated rows are scored each; without
    labels every score is 0.5; an empty table gives no rows."""
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. Null, empty and blank texts link with nothing; repeated ids are one
    node; rows without an id have a null component and are kept; an empty table gives no rows."""
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. A null text counts as empty; rows without an id come last; rows that
    repeat an id and a text get equal results; an empty table gives no rows."""
    from .substring_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. A null or empty text is its end id alone; null ids and repeated rows
    are pieces of their own; an empty table gives no rows."""
    from . import packing

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.tiktoken")), rows=docs.count())


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents. A null or empty text is the end id alone; null ids and repeated rows
    are carried through; an empty table gives no rows."""
    from .sentencepiece_codec import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of conversations and conversation -7. Null roles and texts count as empty; null
    turns come first and rows of one turn go by their ids; null conversations are one; an empty
    table leaves conversation -7."""
    from . import chat_format

    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    file = vocabulary("byte_bpe_50k.tiktoken")
    return chat_format.read_back(chat_format.encode_turns(turns, file), file)


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_lm_score, op3_token_counts, op4_exact_dedup, op5_toxicity, op6_minhash_near_dedup, op7_suffix_array_dedup, op8_best_fit_packing, op9_sentencepiece, op10_chat_format)}

ORACLE_SQL = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE e AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a, min(b) AS component_id FROM reach GROUP BY a
        ), n AS (
            SELECT a, count(*) AS n FROM l GROUP BY a
        )
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
        ), k AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
            FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k""",
    "op6_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
        ), n AS (
            SELECT doc_id, len(s)::BIGINT AS n FROM s
        ), u AS (
            SELECT doc_id, unnest(s) AS x FROM s
        ), m AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT m.a, m.b FROM m JOIN n p ON m.a = p.doc_id JOIN n q ON m.b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
        ), c AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)""",
    "op7_suffix_array_dedup": """
        WITH d AS (
            SELECT doc_id, encode(coalesce(text, '')) AS x, hex(x) AS y FROM documents
        ), w AS (
            SELECT doc_id, i, md5_number(x[i + 1 : i + 100]) AS h FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 99)) AS i FROM d)
        ), r AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
        ), s AS (
            SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
            FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r)
        ), t AS (
            SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM s GROUP BY doc_id, g
        ), k AS (
            SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo)::BIGINT AS gone, count(*) AS n FROM t GROUP BY doc_id
        )
        SELECT d.doc_id, octet_length(x) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
            sha256(unhex(CASE WHEN n IS NULL THEN y
                ELSE array_to_string([substr(y, 2 * coalesce(hi[j], 0) + 1, 2 * (coalesce(lo[j + 1], octet_length(x)) - coalesce(hi[j], 0))) FOR j IN range(0, n + 1)], '') END)) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), f AS (
            SELECT *, length('### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10)) AS n FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
}
