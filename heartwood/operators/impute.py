"""Missing years from the nearest dated relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

GAP = 25


def impute_years(nodes: DataFrame, links: DataFrame, generations: DataFrame, scratch: Scratch, gap: int = GAP, impute: bool = True) -> DataFrame:
    """nodes(handle, year): (handle, year, imputed_year, is_imputed).

    Years spread from dated nodes over undirected links; an undated node takes all dated
    nodes at its smallest distance, each shifted by ``gap`` for a generation between them,
    and their mean, cut towards zero. A dated node relays nobody else's year.

    What spreads is not the sources but, for each node and distance, the number of them
    and the sum of year - gap * generation over distinct sources; distinct sources need
    the pairs, which live only while a node is in the frontier.
    """
    if not impute:
        return nodes.select("handle", "year", F.col("year").alias("imputed_year"), F.lit(False).alias("is_imputed"))
    gen = scratch.save(nodes.select("handle", "year").join(generations, "handle", "left").select("handle", "year", F.coalesce("generation", F.lit(0)).alias("g")))
    step = scratch.save(links.select("source", "target").unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    undated = gen.filter("year is null").select("handle", "g")
    now = scratch.save(gen.filter("year is not null").select("handle", F.col("handle").alias("origin"), (F.col("year") - gap * F.col("g")).alias("base")))
    done = None
    while True:
        reach = now.join(step, F.col("handle") == F.col("source")).select(F.col("target").alias("handle"), "origin", "base").distinct()
        reach = reach.join(undated.select("handle"), "handle", "left_semi")
        if done is not None:
            reach = reach.join(done.select("handle"), "handle", "left_anti")
        now = scratch.save(reach)
        if now.isEmpty():
            break
        mean = scratch.save(now.groupBy("handle").agg(F.sum("base").alias("total"), F.count("*").alias("n")))
        done = mean if done is None else done.unionByName(mean)  # what each round wrote, as is
    if done is None:
        return nodes.select("handle", "year", F.col("year").alias("imputed_year"), F.lit(False).alias("is_imputed"))
    # The mean of year + (own generation - source's) * gap, as a whole sum over n.
    value = F.expr(f"(total + n * g * {gap}) div n").cast("int")
    out = gen.join(done, "handle", "left")
    return out.select("handle", "year", F.coalesce("year", value).alias("imputed_year"), (F.col("year").isNull() & F.col("n").isNotNull()).alias("is_imputed"))
