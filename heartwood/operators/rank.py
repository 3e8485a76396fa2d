"""Places in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str = "place") -> tuple[DataFrame, int]:
    """(rows with their place from 0 by ``order``, number of rows).

    Ranges of the order are sorted side by side; only their sizes, one number for each
    range, come to the driver. Rows that agree in ``order`` get places in any order, which
    stay as they are: the result is written.
    """
    if not rows.columns or not order:
        raise ValueError("an order has columns")
    part, at = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    dealt = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, at))
    sizes = sorted(dealt.groupBy("_part").count().collect())
    start, total = [], 0
    for p, n in sizes:
        start.append((p, total))
        total += n
    before: Column = F.create_map(*(F.lit(x) for kv in start for x in kv))[F.col("_part")] if start else F.lit(0)
    return dealt.select(*rows.columns, (before + F.col("_at")).cast("long").alias(name)), total


def first_share(rows: DataFrame, order: list[str], share: float, scratch: Scratch) -> DataFrame:
    """rows with ``_hit``: among the first ceil(share * n) in order."""
    placed, n = numbered(rows, order, scratch, "_place")
    return placed.withColumn("_hit", F.col("_place") < F.ceil(F.lit(n * share))).drop("_place")
