"""Report rows and a selection of people, merged by a full outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPORT = ["classification", "item_type", "handle_a", "id_a", "display_name_a", "handle_b", "id_b", "display_name_b", "confidence", "field_name", "field_kind", "old_value", "new_value", "similarity"]
VIEW = {"viz_name": "name", "viz_birth_date": "birth_date", "viz_death_date": "death_date", "viz_gender": "gender", "viz_family_group": "family_group"}


def integrate(report: DataFrame, selections: DataFrame) -> DataFrame:
    """The columns of REPORT with side, row_kind (matched, diff_only, viz_only), VIEW's and
    viz_handle. Report rows other than people's are left out.

    A row takes the selection of its handle_a, else of its handle_b; of a handle selected
    repeatedly the last (largest ``pos``, if there is one) counts there, while all that no
    row took are listed.
    """
    people = report.filter(F.col("item_type") == "Person")
    pos = F.col("pos") if "pos" in selections.columns else F.lit(0)
    one = selections.groupBy("handle").agg(F.max_by(F.struct(*VIEW.values()), pos).alias("s"))
    side = lambda s: one.select(F.col("handle").alias(f"handle_{s}"), F.col("s").alias(f"s_{s}"), F.lit(True).alias(f"in_{s}"))
    met = people.join(side("a"), "handle_a", "left").join(side("b"), "handle_b", "left")
    a, b = (F.coalesce(F.col(f"in_{s}"), F.lit(False)) for s in "ab")
    chosen = F.when(a, F.col("s_a")).when(b, F.col("s_b"))
    rows = met.select(
        *REPORT, F.when(a, "a").when(b, "b").otherwise("").alias("side"), F.when(a | b, "matched").otherwise("diff_only").alias("row_kind"),
        *(chosen[v].alias(k) for k, v in VIEW.items()), F.when(a, F.col("handle_a")).when(b, F.col("handle_b")).alias("viz_handle"),
    )
    used = rows.filter("viz_handle is not null").select(F.col("viz_handle").alias("handle")).distinct()
    kinds = {f.name: f.dataType for f in report.schema}
    blank = {"item_type": F.lit("Person"), "confidence": F.lit(0.0), "similarity": F.lit(0.0)}
    null = {"handle_a", "id_a", "display_name_a", "handle_b", "id_b", "display_name_b"}
    lone = selections.join(used, "handle", "left_anti").select(
        *((F.lit(None) if c in null else blank.get(c, F.lit(""))).cast(kinds[c]).alias(c) for c in REPORT), F.lit("").alias("side"), F.lit("viz_only").alias("row_kind"),
        *(F.col(v).alias(k) for k, v in VIEW.items()), F.col("handle").alias("viz_handle"),
    )
    return rows.unionByName(lone)


def totals(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count("*").alias("row_count"), F.count_if(F.col("row_kind") == "matched").alias("matched_count"))


def numbered(selections: DataFrame, order: str) -> DataFrame:
    """Selections with a position within their handle, by a column that tells their order."""
    return selections.withColumn("pos", F.row_number().over(Window.partitionBy("handle").orderBy(order)))
