"""Readers and writers of reports, selections, manifests and resolutions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABEL, two_decimals
from ..operators.integrate import REPORT, VIEW
from ..operators.rank import numbered
from ..scratch import Scratch

REPORT_SCHEMA = ", ".join(f"{c} {'double' if c in ('confidence', 'similarity') else 'string'}" for c in REPORT)
SELECTIONS = "exported_at string, file string, selections array<struct<handle:string,name:string,birth_date:string,death_date:string,gender:string,family_group:long>>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A difference report in CSV, its columns by the names in the header, in any order; more
    columns are left out, a missing one or a number that is none is an error, and an empty
    similarity is 0. The two id columns may have a word before their names."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    found = {c: next((x for x in rows.columns if x == c or (c.startswith("id_") and x.endswith(f"_{c}"))), None) for c in REPORT}
    missing = [c for c, x in found.items() if x is None]
    if missing:
        raise ValueError(f"the report has no columns {missing}")
    text = {c: F.coalesce(F.col(f"`{x}`"), F.lit("")) for c, x in found.items()}
    number = {"confidence": text["confidence"].cast("double"), "similarity": F.when(text["similarity"] == "", 0.0).otherwise(text["similarity"].cast("double"))}
    return rows.select(*(number.get(c, F.col(f"`{found[c]}`")).alias(c) for c in REPORT))


def write_report(rows: DataFrame, path: str) -> None:
    """Every file with the header; every cell quoted, quotes doubled, line ends as spaces,
    numbers with two decimals; labels in capitals. A row without a change has no similarity."""
    label = F.create_map(*(F.lit(x) for kv in LABEL.items() for x in kv))
    cells = {c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]", " ") for c in REPORT}
    cells |= {"classification": F.coalesce(label[F.col("classification")], cells["classification"]), "confidence": two_decimals(F.coalesce("confidence", F.lit(0.0)))}
    cells |= {"similarity": F.when(cells["field_name"] == "", "").otherwise(two_decimals(F.coalesce("similarity", F.lit(0.0))))}
    rows.select(*(x.alias(c) for c, x in cells.items())).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def report_rows(items: DataFrame, extrinsic: bool = False) -> DataFrame:
    """Compared items as rows of REPORT: one for each change, or one with empty change
    columns for an item without; extrinsic items only on request."""
    if not extrinsic:
        items = items.filter("classification != 'ExtrinsicOnly'")
    have = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    head = [F.col("classification"), F.col("kind").alias("item_type"), *(have(c).alias(c) for c in REPORT[2:8]), F.col("confidence").cast("double").alias("confidence")]
    x = items.select(*head, F.explode_outer("field_changes").alias("x"))
    return x.select(*REPORT[:9], *(F.coalesce(F.col(f"x.{c}"), F.lit("")).alias(c) for c in REPORT[9:13]), F.coalesce("x.similarity", F.lit(0.0)).alias("similarity"))


def write_report_json(items: DataFrame, path: str) -> None:
    """One JSON document, {"items": [...]}, in part files whose names' order is its own;
    items by kind and handles. No task holds more than its part."""
    keys = [F.coalesce(F.col(c), F.lit("")).alias(f"_{i}") for i, c in enumerate(("kind", "handle_a", "handle_b"))]
    body = items.select(F.lit(1).alias("_s"), *keys, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows = body.unionByName(body.sparkSession.createDataFrame([(0, "", "", "", '{"items": ['), (2, "", "", "", "]}")], "_s int, _0 string, _1 string, _2 string, value string"))
    placed, n = numbered(rows, ["_s", "_0", "_1", "_2", "value"], Scratch(rows.sparkSession, "report"))
    line = F.when((F.col("_s") == 1) & (F.col("place") < n - 2), F.concat("value", F.lit(","))).otherwise(F.col("value"))
    placed.orderBy("place").select(line.alias("value")).write.mode("overwrite").text(path)


def report_text(items: DataFrame) -> DataFrame:
    """(value): a block of lines for each item."""
    label = F.create_map(*(F.lit(x) for kv in LABEL.items() for x in kv))
    change = F.transform("field_changes", lambda c: F.concat(F.lit("\n    "), c["field_name"], F.lit(": "), F.coalesce(c["old_value"], F.lit("(none)")), F.lit(" -> "), F.coalesce(c["new_value"], F.lit("(none)"))))
    head = F.concat(F.lit("["), label[F.col("classification")], F.lit("] "), F.col("kind"), F.lit(" "), F.coalesce("handle_a", F.lit("-")), F.lit(" / "), F.coalesce("handle_b", F.lit("-")))
    return items.select(F.concat(head, F.array_join(change, "")).alias("value"))


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """The selected people of an exported file in its order; what else it says is ignored.
    One without a handle, name, gender or group is an error."""
    rows = spark.read.json(path, schema=SELECTIONS, multiLine=True).select(F.posexplode("selections").alias("pos", "s")).select("pos", "s.*")
    whole = F.col("handle").isNotNull() & F.col("name").isNotNull() & F.col("gender").isNotNull() & F.col("family_group").isNotNull()
    return rows.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a selection lacks a field, at "), F.col("pos").cast("string"))).cast("boolean")))


def write_selections(rows: DataFrame, path: str, exported_at: str, file: str) -> None:
    """In the order of ``pos`` if there is one, else of handles."""
    order = F.col("pos") if "pos" in rows.columns else F.lit(0)
    item = F.struct("handle", "name", "birth_date", "death_date", "gender", "family_group")
    one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("pos"), item.alias("s")))), lambda x: x["s"]).alias("selections"))
    one.select(F.lit(exported_at).alias("exported_at"), F.lit(file).alias("file"), "selections").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, entries) of a manifest of any version. The file is one JSON value, so the
    driver reads it; entries that are bare handles are pending, or kept among the kept."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    whole = json.loads(text)
    if whole.get("version") not in (1, 2, 3):
        raise ValueError(f"a manifest has version 1, 2 or 3, not {whole.get('version')}")
    rows = []
    for kind, plan in (whole.get("plan") or {}).items():
        for part, status in (("to_delete", "pending"), ("kept", "kept")):
            for e in plan.get(part) or []:
                e = {"handle": e, "status": status} if isinstance(e, str) else e
                rows.append((kind, e["handle"], e.get("status") or status, e.get("public_id", e.get("id")), e.get("description")))
    head = {k: v for k, v in whole.items() if k != "plan"} | {"version": 3}
    return head, spark.createDataFrame(rows, "type string, handle string, status string, public_id string, description string")


def write_manifest(one: DataFrame, path: str) -> None:
    one.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_merged(rows: DataFrame, path: str) -> None:
    """The 21 columns of an integration in CSV."""
    rows.select(*REPORT, "side", "row_kind", *VIEW).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def merged_json(rows: DataFrame, diff_file: str, selection_file: str) -> DataFrame:
    """One row: the counts and all matches as JSON; ``selection`` is left out where there is none."""
    pick = F.when(F.col("row_kind") != "diff_only", F.struct(*(F.col(k).alias(v) for k, v in VIEW.items())))
    match = F.struct("row_kind", "side", F.struct(*REPORT).alias("diff"), pick.alias("selection"))
    one = rows.agg(F.count("*").alias("row_count"), F.count_if(F.col("row_kind") == "matched").alias("matched_count"), F.sort_array(F.collect_list(match)).alias("matches"))
    return one.select(F.to_json(F.struct(F.lit(diff_file).alias("diff_file"), F.lit(selection_file).alias("selection_file"), "row_count", "matched_count", "matches")).alias("value"))


def read_resolutions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resolved(handle_a, handle_b, confidence), unresolved(handle_a))."""
    schema = "resolved map<string, struct<handle_b:string,confidence:double>>, unresolved array<string>"
    rows = spark.read.json(path, schema=schema, multiLine=True)
    return rows.select(F.explode("resolved").alias("handle_a", "v")).select("handle_a", "v.*"), rows.select(F.explode("unresolved").alias("handle_a"))


def write_resolutions(resolved: DataFrame, unresolved: DataFrame, path: str) -> None:
    one = resolved.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("handle_a", F.struct("handle_b", "confidence"))))).alias("resolved"))
    one.join(unresolved.agg(F.sort_array(F.collect_list("handle_a")).alias("unresolved"))).write.mode("overwrite").json(path)
