"""A training corpus from raw documents: five stages, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
In each, long texts count whole, other columns stay whatever their names, and an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm import exact_dedup, minhash, packing, substring_dedup, toxicity
from heartwood.llm.common import Scratch
from heartwood.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity score rejects (0.7 or more). Null and empty
    texts, which have no term, stay; each of repeated rows is judged; without any label all
    score 0.5 and stay."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space: the longest,
    then the smallest id, null ids last. Null, empty and blank texts are one group; equal
    rows leave one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate component. Texts
    without a word and rows without an id stay; rows that repeat an id stay or go together."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; n_chars follows. A null
    text becomes empty; rows without an id come last; rows that repeat an id and a text are
    one document and are cut alike."""
    left = substring_dedup.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens. A null or empty
    text is its end id alone; null ids and repeated rows are pieces of their own."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.tiktoken")), rows=docs.count())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: A trained score can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each but the last written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
