"""The driver's tables as graphs, in DataFrames and in SQL.

Customers are people, orders families, distinct order lines events, parts places, pairs of
part and supplier citations, suppliers sources and nations repositories. Parts also make a
kinship forest: of each size, the n-th part descends from parts n div 2 and n div 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, *cols: str):
    parts = [F.lit(prefix)]
    for i, c in enumerate(cols):
        parts += ([F.lit("-")] if i else []) + [F.col(c).cast("string")]
    return F.concat(*parts)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, prefix, key, kind: table(spark, d, t).select(_key(prefix, key).alias("handle"), F.lit(kind).alias("kind"))
    line = lines(spark, d)
    return (
        one("customer", "C", "c_custkey", "Person").unionByName(one("orders", "O", "o_orderkey", "Family")).unionByName(line.select(_key("L", *LINE).alias("handle"), F.lit("Event").alias("kind")))
        .unionByName(one("part", "P", "p_partkey", "Place")).unionByName(line.select("l_partkey", "l_suppkey").distinct().select(_key("K", "l_partkey", "l_suppkey").alias("handle"), F.lit("Citation").alias("kind")))
        .unionByName(one("supplier", "S", "s_suppkey", "Source")).unionByName(one("nation", "N", "n_nationkey", "Repository"))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    line = lines(spark, d)
    pair = line.select("l_partkey", "l_suppkey").distinct()
    e = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), a.alias("source"), b.alias("target"))
    return (
        e(table(spark, d, "orders"), "FamilyFather", _key("O", "o_orderkey"), _key("C", "o_custkey")).unionByName(e(line, "FamilyEventRef", _key("O", "l_orderkey"), _key("L", *LINE)))
        .unionByName(e(line, "EventPlace", _key("L", *LINE), _key("P", "l_partkey"))).unionByName(e(line, "EventCitation", _key("L", *LINE), _key("K", "l_partkey", "l_suppkey")))
        .unionByName(e(pair, "CitationSource", _key("K", "l_partkey", "l_suppkey"), _key("S", "l_suppkey"))).unionByName(e(table(spark, d, "supplier"), "SourceRepoRef", _key("S", "s_suppkey"), _key("N", "s_nationkey")))
    )


_L = "'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
_K = "'K' || l_partkey || '-' || l_suppkey"
GRAPH = f"""
    ln AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
    pr AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
    nodes AS (
        SELECT 'C' || c_custkey AS handle, 'Person' AS kind FROM customer UNION ALL SELECT 'O' || o_orderkey, 'Family' FROM orders
        UNION ALL SELECT {_L}, 'Event' FROM ln UNION ALL SELECT 'P' || p_partkey, 'Place' FROM part UNION ALL SELECT {_K}, 'Citation' FROM pr
        UNION ALL SELECT 'S' || s_suppkey, 'Source' FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Repository' FROM nation
    ),
    edges AS (
        SELECT 'FamilyFather' AS edge_type, 'O' || o_orderkey AS source, 'C' || o_custkey AS target FROM orders
        UNION ALL SELECT 'FamilyEventRef', 'O' || l_orderkey, {_L} FROM ln UNION ALL SELECT 'EventPlace', {_L}, 'P' || l_partkey FROM ln
        UNION ALL SELECT 'EventCitation', {_L}, {_K} FROM ln UNION ALL SELECT 'CitationSource', {_K}, 'S' || l_suppkey FROM pr
        UNION ALL SELECT 'SourceRepoRef', 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
    )"""


def forest(spark: SparkSession, d: str) -> DataFrame:
    """(handle, size, pos, year) of every part."""
    pos = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    p = table(spark, d, "part").select("p_partkey", "p_size", pos.alias("pos"))
    return p.select(_key("P", "p_partkey").alias("handle"), F.col("p_size").alias("size"), "pos", F.when(F.col("p_partkey") % 3 == 0, (1900 + F.col("p_partkey") % 50).cast("int")).alias("year"))


def kin(f: DataFrame) -> DataFrame:
    """links(source, target, link_type) of the forest, by equi-joins on size and position."""
    up = f.filter((F.col("pos") > 1) & (F.col("pos") % 13 != 0)).select("handle", "size", F.explode(F.array_distinct(F.array(F.expr("pos div 2"), F.expr("pos div 3")))).alias("at")).filter("at > 0")
    parent = up.join(f.select("size", F.col("pos").cast("long").alias("at"), F.col("handle").alias("source")), ["size", "at"]).select("source", F.col("handle").alias("target"), F.lit("ParentChild").alias("link_type"))
    wife = f.filter("pos % 7 = 1").select("size", (F.col("pos") + 1).alias("pos"), F.col("handle").alias("source"))
    spouse = wife.join(f.select("size", "pos", F.col("handle").alias("target")), ["size", "pos"]).select("source", "target", F.lit("Spouse").alias("link_type"))
    return parent.unionByName(spouse)


def parents(links: DataFrame) -> DataFrame:
    return links.filter("link_type = 'ParentChild'").select(F.col("source").alias("parent"), F.col("target").alias("child"))


FOREST = """
    f AS (SELECT 'P' || p_partkey AS handle, p_partkey AS k, p_size AS size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS pos FROM part),
    pc AS (
        SELECT DISTINCT q.handle AS source, f.handle AS target FROM f JOIN f q ON f.size = q.size AND (q.pos = f.pos // 2 OR q.pos = f.pos // 3)
        WHERE f.pos > 1 AND f.pos % 13 <> 0
    ),
    sp AS (SELECT f.handle AS source, q.handle AS target FROM f JOIN f q ON f.size = q.size AND q.pos = f.pos + 1 WHERE f.pos % 7 = 1),
    links AS (SELECT *, 'ParentChild' AS link_type FROM pc UNION ALL SELECT *, 'Spouse' FROM sp)"""
#: After FOREST: labels by reach over links, and generations by the longest walk.
REACH = """
    und AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
    reach AS (SELECT handle AS a, handle AS b FROM f UNION SELECT r.a, u.b FROM reach r JOIN und u ON r.b = u.a),
    comp AS (SELECT a AS handle, min(b) AS component FROM reach GROUP BY a)"""
DEPTH = """
    walk AS (SELECT target AS handle, 1 AS g FROM pc UNION SELECT pc.target, w.g + 1 FROM walk w JOIN pc ON w.handle = pc.source WHERE w.g < 50),
    gen AS (SELECT f.handle, coalesce(max(w.g), 0) AS generation FROM f LEFT JOIN walk w ON f.handle = w.handle GROUP BY f.handle)"""
