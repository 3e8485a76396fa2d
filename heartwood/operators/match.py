"""Matching the records of two graphs, and the report of their differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import normalize_key
from . import compare

BY_HANDLE, BY_KEY = 1.0, 0.9


def strong_keys() -> dict[str, Column]:
    """The key of each kind's typed table; null if it has nothing to go by. A person's needs
    ``birth_date`` (a display text, see birth_text)."""
    c = F.col
    event = F.concat_ws("|", c("event_type"), F.coalesce(dates.display_text(c("date")), F.lit("")), F.coalesce(c("description"), F.lit("")))
    return {
        "Person": normalize_key(c("surname"), c("given_name"), c("birth_date")),
        "Family": normalize_key(c("father_handle"), c("mother_handle")),
        "Event": F.trim(F.lower(event)),
        "Place": normalize_key(c("city"), c("street")),
        "Source": normalize_key(c("title")),
        "Citation": normalize_key(c("source_handle"), c("page")),
        "Repository": normalize_key(c("name")),
        "Media": normalize_key(c("path"), c("checksum")),
        "Note": normalize_key(c("text")),
        "Tag": normalize_key(c("name")),
    }


def birth_text(person_events: DataFrame, events: DataFrame) -> DataFrame:
    """(handle, birth_date): the date text of the first Birth by ``pos`` of person_events
    (handle, pos, event)."""
    birth = events.filter(F.col("event_type") == "Birth").select(F.col("handle").alias("event"), dates.display_text(F.col("date")).alias("t"))
    return person_events.join(birth, "event").groupBy("handle").agg(F.min_by("t", "pos").alias("birth_date"))


@dataclass(frozen=True)
class Match:
    """pairs(kind, handle_a, handle_b, confidence), what is left of either side, and the
    ambiguous keys: (kind, strong_key, group_a array, handle_b)."""

    pairs: DataFrame
    removed: DataFrame
    added: DataFrame
    ambiguous: DataFrame


def match(a: DataFrame, b: DataFrame) -> Match:
    """a, b: (kind, handle, strong_key).

    First by kind and handle, then what is left by kind and strong key: a key of one left
    row of a goes to the smallest left handle of b that has it; a key of several in a is
    ambiguous, and its rows of either side are neither removed nor added. Groups of a key
    are counted and reduced before they are joined, never paired.
    """
    on = ["kind", "handle"]
    same = a.join(b.select(on), on, "left_semi").select("kind", F.col("handle").alias("handle_a"), F.col("handle").alias("handle_b"), F.lit(BY_HANDLE).alias("confidence"))
    left_a, left_b = a.join(b.select(on), on, "left_anti"), b.join(a.select(on), on, "left_anti")
    key = ["kind", "strong_key"]
    groups_a = left_a.filter("strong_key is not null").groupBy(key).agg(F.count("*").alias("n"), F.min("handle").alias("handle_a"))
    first_b = left_b.filter("strong_key is not null").groupBy(key).agg(F.min("handle").alias("handle_b"))
    met = groups_a.join(first_b, key)
    by_key = met.filter("n = 1").select("kind", "handle_a", "handle_b", F.lit(BY_KEY).alias("confidence"))
    several = met.filter("n > 1").select("kind", "strong_key", "handle_b")
    ambiguous = several.join(left_a, key).groupBy(*key, "handle_b").agg(F.sort_array(F.collect_list("handle")).alias("group_a"))
    taken_a = by_key.select("kind", F.col("handle_a").alias("handle"))
    taken_b = by_key.select("kind", F.col("handle_b").alias("handle"))
    unclear = several.select(key)
    removed = left_a.join(taken_a, on, "left_anti").join(unclear, key, "left_anti").select(on)
    added = left_b.join(taken_b, on, "left_anti").join(unclear, key, "left_anti").select(on)
    return Match(same.unionByName(by_key), removed, added, ambiguous)


def classify(pairs: DataFrame, a: DataFrame, b: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Of one kind: pairs with their changes; Same without, Modified with any."""
    side = lambda t, s: t.select(F.col("handle").alias(f"handle_{s}"), F.struct("*").alias(s))
    out = pairs.join(side(a, "a"), "handle_a").join(side(b, "b"), "handle_b").withColumn("field_changes", compare.compare_fields(fields, kind=a.schema))
    kind = F.when(F.size("field_changes") == 0, "Same").otherwise("Modified")
    return out.select(kind.alias("classification"), "kind", "handle_a", "handle_b", "confidence", "field_changes")


def resolve_extrinsic(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """A modified pair whose every change is a handle that the matching explains becomes
    ExtrinsicOnly: a single one if b's handle maps to a's; a list if both have as many, all
    of b's map to that many different ones, and they are a's."""
    back = pairs.groupBy(F.col("handle_b").alias("_b")).agg(F.min("handle_a").alias("_a"))
    row = items.withColumn("_id", F.struct("kind", "handle_a", "handle_b"))
    change = row.filter(F.col("classification") == "Modified").select("_id", F.posexplode("field_changes").alias("_i", "_c"))
    listed = lambda v: F.split(F.regexp_replace(v, r"^\[|\]$", ""), ", ")
    many = F.col("_c.field_kind") == "HandleRefList"
    handles = lambda f: F.when(many, F.filter(listed(F.col(f"_c.{f}")), lambda x: x != "")).otherwise(F.array(F.col(f"_c.{f}")))
    change = change.select("_id", "_i", F.col("_c.field_kind").isin("HandleRef", "HandleRefList").alias("_ref"), handles("old_value").alias("_old"), handles("new_value").alias("_new"))
    one = change.select("_id", "_i", "_ref", "_old", F.size("_new").alias("_n"), F.explode_outer("_new").alias("_b")).join(back, "_b", "left")
    one = one.groupBy("_id", "_i").agg(F.first("_ref").alias("_ref"), F.first("_old").alias("_old"), F.first("_n").alias("_n"), F.collect_set("_a").alias("_to"))
    fits = F.col("_ref") & (F.size("_old") == F.col("_n")) & (F.size("_to") == F.col("_n")) & (F.sort_array(F.array_distinct("_old")) == F.sort_array("_to"))
    all_fit = one.groupBy("_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("_fit")).filter("_fit")
    return row.join(all_fit, "_id", "left").select(F.when(F.col("_fit"), "ExtrinsicOnly").otherwise(F.col("classification")).alias("classification"), *[c for c in items.columns if c != "classification"])


def unmatched_items(found: Match) -> DataFrame:
    none = F.lit(None).cast("string")
    empty = F.array().cast(compare.CHANGE)
    gone = found.removed.select(F.lit("Removed").alias("classification"), "kind", F.col("handle").alias("handle_a"), none.alias("handle_b"), F.lit(1.0).alias("confidence"), empty.alias("field_changes"))
    new = found.added.select(F.lit("Added").alias("classification"), "kind", none.alias("handle_a"), F.col("handle").alias("handle_b"), F.lit(1.0).alias("confidence"), empty.alias("field_changes"))
    return gone.unionByName(new)


def diff(a: dict[str, DataFrame], b: dict[str, DataFrame], fields: dict[str, dict[str, str]] | None = None, keys: dict[str, Column] | None = None) -> tuple[DataFrame, Match]:
    """Items of all kinds, and the matching. a, b: typed tables by kind."""
    fields, keys = fields or compare.FIELDS, keys or strong_keys()
    rows = lambda g: _union([t.select(F.lit(k).alias("kind"), "handle", keys[k].alias("strong_key")) for k, t in g.items()])
    found = match(rows(a), rows(b))
    kinds = [k for k in a if k in b]
    items = _union([classify(found.pairs.filter(F.col("kind") == k), a[k], b[k], {f: h for f, h in fields[k].items() if f in a[k].columns and f in b[k].columns}) for k in kinds])
    return resolve_extrinsic(items, found.pairs).unionByName(unmatched_items(found)), found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(items: DataFrame) -> DataFrame:
    """One row: total and the number of each classification."""
    n = lambda c: F.count_if(F.col("classification") == c)
    return items.agg(F.count("*").alias("total"), n("Same").alias("same"), n("Modified").alias("modified"), n("Added").alias("added"), n("Removed").alias("removed"), n("NeedsReview").alias("needs_review"), n("ExtrinsicOnly").alias("extrinsic_only"))


def apply_resolutions(found: Match, resolutions: DataFrame) -> DataFrame:
    """Pairs with those that resolutions(handle_a, handle_b, confidence) settle among the ambiguous."""
    settled = found.ambiguous.select("kind", F.explode("group_a").alias("handle_a")).join(resolutions, "handle_a").select("kind", "handle_a", "handle_b", "confidence")
    return found.pairs.unionByName(settled)


def visible(items: DataFrame, show_extrinsic: bool = False) -> DataFrame:
    return items if show_extrinsic else items.filter(F.col("classification") != "ExtrinsicOnly")


def report_rows(items: DataFrame) -> DataFrame:
    """A row for each change, or one without for an item that has none."""
    x = items.select("classification", F.col("kind").alias("item_type"), "handle_a", "handle_b", "confidence", F.explode_outer("field_changes").alias("_c"))
    return x.select("classification", "item_type", "handle_a", "handle_b", "confidence", "_c.field_name", "_c.field_kind", "_c.old_value", "_c.new_value", F.coalesce("_c.similarity", F.lit(0.0)).alias("similarity"))


def index_rows(items: DataFrame) -> DataFrame:
    """For views: each item's class, the fields that changed of themselves and text scores."""
    from ..functions.text import text_scores

    own = F.transform(F.filter("field_changes", lambda c: ~c["field_kind"].isin("HandleRef", "HandleRefList")), lambda c: c["field_name"])
    return items.select(F.coalesce("handle_a", "handle_b").alias("handle"), "classification", own.alias("intrinsic_fields"), F.when(F.col("classification") == "Modified", text_scores(F.col("field_changes"))).alias("text_scores"))


def first_of_type(refs: DataFrame, events: DataFrame, event_type: str, value: str) -> DataFrame:
    """(handle, value) of the first event of a type by reference order. refs: (handle, pos, event)."""
    e = events.filter(F.col("event_type") == event_type).select(F.col("handle").alias("event"), value)
    return refs.join(e, "event").groupBy("handle").agg(F.min_by(value, "pos").alias(value))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Rows whose strong key another of the kind has too, with how many do."""
    n = F.count("*").over(Window.partitionBy("kind", "strong_key"))
    return rows.filter("strong_key is not null").withColumn("n", n).filter("n > 1")
