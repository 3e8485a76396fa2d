"""Checks of a graph; what they return is the table of errors, empty if all is well."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last one is known to ``blocking``; no check here makes it.
ERRORS = ("DanglingReference", "MissingRequired", "CardinalityViolation", "PlausibilityWarning")
_empty = lambda c: F.coalesce(c, F.lit("")) == ""


def required_rules() -> dict[str, dict[str, Column]]:
    c = F.col
    return {
        "Person": {"handle": _empty(c("handle")), "gender": c("gender").isNull(), "primary_name": _empty(c("given_name")) & _empty(c("surname"))},
        "Family": {"handle": _empty(c("handle"))},
        "Event": {"handle": _empty(c("handle"))},
        "Place": {"handle": _empty(c("handle")), "name": F.coalesce("city", "country", "county", "state", "street").isNull()},
        "Source": {"handle": _empty(c("handle")), "title": _empty(c("title"))},
        "Citation": {"handle": _empty(c("handle")), "source_handle": _empty(c("source_handle"))},
        "Repository": {"handle": _empty(c("handle"))},
        "Media": {"handle": _empty(c("handle"))},
        "Note": {"handle": _empty(c("handle")), "text": _empty(c("text"))},
        "Tag": {"handle": _empty(c("handle")), "name": _empty(c("name"))},
    }


def missing_required(rows: DataFrame, kind: str, rules: dict[str, Column] | None = None) -> DataFrame:
    """(error_kind, kind, handle, field) for each rule a row breaks, in one pass."""
    rules = rules or required_rules()[kind]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))
    return rows.select(F.lit("MissingRequired").alias("error_kind"), F.lit(kind).alias("kind"), "handle", F.explode(found).alias("field"))


def cardinality(rows: DataFrame, kind: str, bounds: dict[str, tuple[int, int | None]]) -> DataFrame:
    """(error_kind, kind, handle, field, n) for each list of a size out of its bounds; null is empty."""
    n = lambda f: F.coalesce(F.size(F.col(f)), F.lit(0))
    bad = [F.when((F.greatest(n(f), F.lit(0)) < lo) | (F.lit(hi is not None) & (n(f) > F.lit(hi or 0))), F.struct(F.lit(f).alias("field"), F.greatest(n(f), F.lit(0)).alias("n"))) for f, (lo, hi) in bounds.items()]
    return rows.select(F.lit("CardinalityViolation").alias("error_kind"), F.lit(kind).alias("kind"), "handle", F.explode(F.array_compact(F.array(*bad))).alias("x")).select("error_kind", "kind", "handle", "x.*")


def dangling_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(error_kind, edge_type, source, target, missing): the source is reported first."""
    known = nodes.select("handle")
    no_source = edges.join(known, F.col("source") == F.col("handle"), "left_anti").withColumn("missing", F.col("source"))
    rest = edges.join(known, F.col("source") == F.col("handle"), "left_semi")
    no_target = rest.join(known, F.col("target") == F.col("handle"), "left_anti").withColumn("missing", F.col("target"))
    return no_source.unionByName(no_target).select(F.lit("DanglingReference").alias("error_kind"), "edge_type", "source", "target", "missing")


def duplicate_handles(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("handle").agg(F.count("*").alias("n")).filter("n > 1")


def blocking(errors: DataFrame, strict: bool) -> DataFrame:
    """The errors that stop a run: all if strict, else all but warnings."""
    return errors if strict else errors.filter(F.col("error_kind") != "PlausibilityWarning")


def unknown_values(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def xml_structure(texts: DataFrame, text: str = "content") -> DataFrame:
    """(path, severity, message) of raw files: an error where a file isn't well-formed or has
    no database element, a warning for a missing header or another namespace. After a
    parse error the rest of the file isn't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *x) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _structure(t or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "severity", "message"])

    return texts.select("path", text).mapInArrow(run, "path string, severity string, message string")


def _structure(text: str) -> list[tuple[str, str]]:
    seen: set[str] = set()
    found: list[tuple[str, str]] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        seen.add(name)
        if name == "database" and not attributes.get("xmlns", "").endswith("/1.7.2/"):
            found.append(("warning", "<database> lacks the expected namespace"))

    parser = expat.ParserCreate("UTF-8")
    parser.StartElementHandler = start
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        found.append(("error", f"XML parse error: {e}"))
    if "database" not in seen:
        found.append(("error", "no <database> element"))
    if "header" not in seen:
        found.append(("warning", "no <header> element"))
    return found
