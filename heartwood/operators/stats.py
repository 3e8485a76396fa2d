"""Counts, histograms and the table of group sizes by generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KINDS


def count_by_kind(nodes: DataFrame) -> DataFrame:
    """(kind, n), also for kinds without a node."""
    every = nodes.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(every).join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def counts_row(nodes: DataFrame) -> DataFrame:
    """One row with a column for each kind."""
    return nodes.agg(*(F.count_if(F.col("kind") == k).alias(p) for k, p in KINDS.items()))


def family_size(parents: Column, children: Column) -> Column:
    return F.size(F.array_distinct(F.array_union(F.array_compact(parents), F.array_compact(children))))


def histogram(rows: DataFrame, value: str, count: str) -> DataFrame:
    """(value, count) in ascending order."""
    return rows.groupBy(value).agg(F.count("*").alias(count)).orderBy(value)


def groups(components: DataFrame, generations: DataFrame) -> DataFrame:
    """(component, size, span) and a dense id by component."""
    g = components.join(generations, "handle").groupBy("component").agg(F.count("*").alias("size"), (F.max("generation") + 1).cast("long").alias("span"))
    return g


def generation_table(group: DataFrame) -> DataFrame:
    """(size, span, n) with the margins; null stands for all."""
    return group.cube("size", "span").agg(F.count("*").alias("n"))


def generation_pivot(group: DataFrame, spans: list[int]) -> DataFrame:
    """A row for each size, a column for each span and the total."""
    return group.groupBy("size").agg(*(F.count_if(F.col("span") == s).alias(str(s)) for s in spans), F.count("*").alias("total")).orderBy("size")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct handles that edges lead to or from and no node has."""
    ends = edges.select(F.col("source").alias("handle")).unionByName(edges.select(F.col("target").alias("handle"))).distinct()
    return ends.join(nodes.select("handle"), "handle", "left_anti")


def not_in_family(persons: DataFrame, members: DataFrame) -> DataFrame:
    return persons.select("handle").join(members.select("handle"), "handle", "left_anti")


def year_range(years: DataFrame) -> DataFrame:
    return years.agg(F.min("year").alias("least"), F.max("year").alias("most"))


def color_position(year: Column, least: Column, most: Column) -> Column:
    """0 to 1 along the range, a half if it is one year; null without a year."""
    return F.when(year.isNull(), None).when(least == most, F.lit(0.5)).otherwise((year - least) / (most - least))


def generation_spacing(height: Column, count: Column) -> Column:
    return F.when((count > 1) & (height > 0), F.greatest(F.lit(40.0), 0.7 * height / (count - 1))).otherwise(F.lit(0.0))


def stats_report(file: str, nodes: DataFrame, sizes: DataFrame, group: DataFrame, lone: DataFrame, loose: DataFrame, warnings: list[str]) -> DataFrame:
    """The report as one row of maps; every map has at most a few thousand keys."""
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(k).cast("long"), F.col(v).cast("long"))))).alias("m"))
    total = counts_row(nodes).select(F.struct(*KINDS.values()).alias("counts"))
    by_family = as_map(histogram(sizes, "size", "n"), "size", "n").withColumnRenamed("m", "family_size_distribution")
    by_group = as_map(histogram(group, "size", "n"), "size", "n").withColumnRenamed("m", "family_group_distribution")
    table = group.groupBy("size", "span").agg(F.count("*").alias("n"))
    table = table.groupBy("size").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("span"), "n")))).alias("spans"))
    table = table.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("size", F.map_entries("spans").alias("e"))))).alias("m"))
    table = table.select(F.transform_values("m", lambda _, v: F.map_from_entries(v)).alias("family_group_generation_table"))
    out = total
    for x in (by_family, by_group, table, lone.agg(F.count("*").alias("people_not_in_family")), loose.agg(F.count("*").alias("dangling_refs"))):
        out = out.join(x)  # one row each
    return out.select(F.lit(file).alias("file"), "*", F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))
