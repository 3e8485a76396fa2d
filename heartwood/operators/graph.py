"""Selections over nodes and edges, components, generations and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

MAX_GENERATION = 50
FEW_NODES = 1 << 18  #: rows of two ids that may be broadcast


def nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == kind)


def get_nodes(nodes: DataFrame, handles: DataFrame) -> DataFrame:
    """The nodes whose handle is in ``handles(handle)``."""
    return nodes.join(handles.select("handle").distinct(), "handle", "left_semi")


def edges_from(edges: DataFrame, handles: DataFrame) -> DataFrame:
    return edges.join(handles.select(F.col("handle").alias("source")).distinct(), "source", "left_semi").select(edges.columns)


def edges_to(edges: DataFrame, handles: DataFrame) -> DataFrame:
    return edges.join(handles.select(F.col("handle").alias("target")).distinct(), "target", "left_semi").select(edges.columns)


def edges_incident_to(edges: DataFrame, handles: DataFrame) -> DataFrame:
    """Edges with either end in handles; one with both ends there comes once."""
    h = handles.select("handle").distinct()
    return edges_from(edges, h).unionByName(edges_to(edges, h).join(h, F.col("source") == F.col("handle"), "left_anti"))


def remove_edges(edges: DataFrame, test: Column) -> DataFrame:
    return edges.filter(~F.coalesce(test, F.lit(False)))


def other_endpoint(source: Column, target: Column, handle: Column) -> Column:
    return F.when(source == handle, target).otherwise(source)


def incident_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(handle, n): edge ends at each node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("handle")).groupBy("handle").agg(F.count("*").alias("n"))
    return nodes.select("handle").join(ends, "handle", "left").select("handle", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------------ components


def stars(edges: DataFrame, scratch: Scratch, rows: int | None = None, max_rounds: int = 64) -> DataFrame:
    """(a, b): every node a of undirected edges (a, b) with the smallest node b that it reaches,
    but for that node itself. ``rows``: about how many edges there are, if known.

    Large-star and small-star steps in turn: every node's edges move to its smallest
    neighbour, found by a pre-aggregated minimum and joined back, so a hub's neighbours
    are never gathered: few nodes' minima are broadcast, those of many are written, so that
    both sides of the join are plain exchanges and a hub's rows can be split. The number of
    rounds grows with the logarithm of the diameter.
    """
    minima: list[DataFrame] = []

    def star(e: DataFrame, large: bool, count: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = both if large else both.filter("b < a")
        low = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        if 2 * count <= FEW_NODES:
            low = F.broadcast(low)
        else:
            minima.append(low := scratch.save(low))
        joined = side.join(low, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        return moved.filter("a != b").distinct()

    now = scratch.save(edges.select("a", "b").filter("a != b"), rows)
    sign, count = None, now.count()
    for _ in range(max_rounds):
        half = star(now, True, count)
        if 2 * count > FEW_NODES:
            half = scratch.save(half)
            minima.append(half)
        new = scratch.save(star(half, False, count), count)
        for x in [now, *minima]:
            scratch.drop(x)
        minima.clear()
        now = new
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if row == sign:
            return now
        sign, count = row, row[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(handle, component): the smallest handle that undirected pairs (a, b) reach.

    Handles only in ``nodes`` are components of one; pairs with other handles are kept too.
    """
    of = stars(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), scratch).select(F.col("a").alias("handle"), F.col("b").alias("component"))
    return nodes.select("handle").join(of, "handle", "left").select("handle", F.coalesce("component", "handle").alias("component"))


def family_pairs(members: DataFrame) -> DataFrame:
    """members(family, handle): each with the smallest one of its family, as pairs (a, b)."""
    first = members.groupBy("family").agg(F.min("handle").alias("b"))
    return members.join(first, "family").select(F.col("handle").alias("a"), "b").filter("a != b").distinct()


# ----------------------------------------------------------------------- generations


def generations(nodes: DataFrame, parents: DataFrame, scratch: Scratch, cap: int = MAX_GENERATION) -> DataFrame:
    """(handle, generation): the length of the longest walk that ends there, at most ``cap``.

    ``parents`` has (parent, child). Round k holds the nodes that end a walk of k edges, the
    children of round k-1, so a round reads no more than its predecessor's children; nodes
    on or below a cycle stay until the cap.
    """
    edge = scratch.save(parents.select("parent", "child").distinct())
    now = scratch.save(edge.select(F.col("child").alias("handle")).distinct())
    levels = []
    while len(levels) < cap and not now.isEmpty():
        levels.append(now.withColumn("g", F.lit(len(levels) + 1)))
        if len(levels) < cap:
            now = scratch.save(now.join(edge, F.col("handle") == F.col("parent")).select(F.col("child").alias("handle")).distinct())
    if not levels:
        return nodes.select("handle", F.lit(0).alias("generation"))
    best = levels[0]
    for x in levels[1:]:
        best = best.unionByName(x)
    best = best.groupBy("handle").agg(F.max("g").alias("g"))
    return nodes.select("handle").join(best, "handle", "left").select("handle", F.coalesce("g", F.lit(0)).alias("generation"))


def residue(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(handle): parents left when nodes without an edge into them are taken away again and
    again: those on a cycle or below one that still lead on. Empty without a cycle."""
    edge = parents.select("parent", "child").distinct()
    left = scratch.save(edge)
    n = left.count()
    while n:
        new = scratch.save(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child"))
        m = new.count()
        scratch.drop(left)
        left = new
        if m == n:
            break
        n = m
    return left.select(F.col("parent").alias("handle")).distinct()


def cyclic_components(components: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(component): those with a cycle, a loop included."""
    return components.join(residue(parents, scratch), "handle", "left_semi").select("component").distinct()


# -------------------------------------------------------------------------- families


def links(families: DataFrame, persons: DataFrame) -> DataFrame:
    """(source, target, link_type): spouses and parents of children, both ends known.

    families: (handle, father_handle, mother_handle, child_handles array).
    """
    known = persons.select("handle")
    f = families.select("father_handle", "mother_handle", F.explode_outer("child_handles").alias("child"))
    parent = f.select(F.explode(F.array("father_handle", "mother_handle")).alias("source"), F.col("child").alias("target"), F.lit("ParentChild").alias("link_type")).filter("source is not null and target is not null")
    spouse = families.select(F.col("father_handle").alias("source"), F.col("mother_handle").alias("target"), F.lit("Spouse").alias("link_type")).filter("source is not null and target is not null")
    both = parent.unionByName(spouse)
    for end in ("source", "target"):
        both = both.join(known.withColumnRenamed("handle", end), end, "left_semi")
    return both.select("source", "target", "link_type")


def undirected(pairs: DataFrame) -> DataFrame:
    """Links once each, whichever way a spouse pair is written."""
    spouse = F.col("link_type") == "Spouse"
    return pairs.select(
        F.when(spouse, F.least("source", "target")).otherwise(F.col("source")).alias("source"),
        F.when(spouse, F.greatest("source", "target")).otherwise(F.col("target")).alias("target"), "link_type",
    ).distinct()
