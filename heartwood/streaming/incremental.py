"""Operators over arriving records: running counts, first occurrences, dangling references.

Each takes and gives a streaming DataFrame, so a source and a sink can be chosen outside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_kind(nodes: DataFrame) -> DataFrame:
    """(kind, n), for output mode complete or update."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, length: str, lateness: str, *keys: str) -> DataFrame:
    """Counts by window and keys; rows later than ``lateness`` are left out and the state of
    closed windows goes."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def first_seen(nodes: DataFrame, time: str, lateness: str) -> DataFrame:
    """Each handle once; a repeat within ``lateness`` of the first is dropped."""
    return nodes.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["handle"])


def unresolved(edges: DataFrame, nodes: DataFrame, lateness: str) -> DataFrame:
    """Edges (ts, source, target) whose target doesn't come as a node (ts, handle) within
    ``lateness`` around them: a left outer join of streams whose state is bounded by time."""
    e = edges.withWatermark("ts", lateness).withColumnRenamed("ts", "edge_ts")
    n = nodes.withWatermark("ts", lateness).withColumnRenamed("ts", "node_ts")
    near = F.expr(f"target = handle and node_ts between edge_ts - interval {lateness} and edge_ts + interval {lateness}")
    return e.join(n, near, "left_outer").filter("handle is null").select("edge_ts", "source", "target")
