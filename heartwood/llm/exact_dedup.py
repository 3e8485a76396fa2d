"""Exact deduplication by 128-bit content hash, with the bytes compared inside a group.

DataFrame functions only. Two shuffles: the normalised texts, pre-aggregated by hash and
bytes (a group of copies reaches the exchange as one row a task), then narrow rows of ids
and digests joined to their class, where adaptive execution may split a hot class. The
classes, a narrow row each, are written between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The characters that normalisation deletes: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def content_hash(text: Column) -> Column:
    """128 bits as 32 hex digits."""
    return F.md5(text)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts have the same bytes. Of equal rows the one
    with the most code points in the original text stays, then the smallest id. A null text
    counts as empty, so null, empty and blank texts form one group. A null id loses to any
    other id of the same length. Rows that repeat an id each get a row; ``kept`` is true
    for each row whose id is the one that stays. An empty table gives no rows. Other
    columns, whatever their names, are not read. Long texts count whole.

    ``hash_of`` maps the normalised text to the group's key. Two texts that share both the
    key and SHA-256 but differ in bytes stop the job instead of being merged.
    """
    row = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_raw"))
    row = row.select("_id", F.char_length("_raw").cast("long").alias("_n"), normalised(F.col("_raw")).alias("_t"))
    row = row.select("_id", "_n", "_t", hash_of(F.col("_t")).alias("_h"))
    best = F.max(F.struct(F.col("_n"), (-F.col("_id")).alias("_neg")))
    by_bytes = row.groupBy("_h", "_t").agg(F.count("*").alias("_size"), best.alias("_best"))
    digest = by_bytes.select("_h", F.sha2("_t", 256).alias("_sha"), "_size", "_best")
    one = digest.groupBy("_h", "_sha").agg(F.count("*").alias("_texts"), F.max("_size").alias("_size"), F.max("_best").alias("_best"))
    one = one.filter(F.when(F.col("_texts") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("different texts share both digests")).cast("boolean")))
    # Written, so that the join's sides are plain exchanges, of which a hot class can be split.
    one = Scratch(docs.sparkSession, "exact").save(one.select("_h", "_sha", (-F.col("_best._neg")).alias("keep_id"), F.col("_size").alias("group_size")))
    thin = row.select("_id", "_h", F.sha2("_t", 256).alias("_sha"))
    out = thin.join(one, ["_h", "_sha"])
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row of each group of equal rows, whole: the one that ``exact_duplicates`` keeps.

    Null, empty and blank texts form one group; a row without an id loses to any other of
    the same length. Rows that agree in length and id are told apart by a hash of all
    their columns, and equal rows leave one. An empty table gives no rows; all columns,
    whatever their names, stay. The row rides through the pre-aggregated group-by, so nothing is joined back.
    """
    names = docs.columns
    raw = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("_row"), F.struct(F.char_length(raw), -F.col(id_col), F.xxhash64(*names)).alias("_rank"), normalised(raw).alias("_t"))
    best = row.groupBy(hash_of(F.col("_t")).alias("_h"), "_t").agg(F.max_by("_row", "_rank").alias("_row"))
    return best.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)))
