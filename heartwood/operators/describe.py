"""Labels of records, for reports and for reviewing a deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

_has = lambda c: F.coalesce(c, F.lit("")) != ""


def full_name(given: Column, surname: Column, default: Column) -> Column:
    name = F.trim(F.concat_ws(" ", given, surname))
    return F.when(name != "", name).otherwise(default)


def person_node(persons: DataFrame) -> DataFrame:
    """For views: gender as a word, and a name, the handle without one."""
    gender = F.when(F.col("gender") == 0, "male").when(F.col("gender") == 1, "female").otherwise("unknown")
    return persons.select("handle", full_name(F.col("given_name"), F.col("surname"), F.col("handle")).alias("name"), gender.alias("gender"), "birth_date", "death_date")


def lifespan(birth: Column, death: Column) -> Column:
    b, d = _has(birth), _has(death)
    return F.when(b & d, F.concat(F.lit(" ("), birth, F.lit("-"), death, F.lit(")"))).when(b, F.concat(F.lit(" (b. "), birth, F.lit(")"))).when(d, F.concat(F.lit(" (d. "), death, F.lit(")"))).otherwise("")


def cut(text: Column, length: int, at_space: bool = False) -> Column:
    """The first ``length`` characters, with an ellipsis if more follow; back to the last
    space if asked and there is one."""
    head = F.substring(text, 1, length)
    if at_space:
        head = F.when(head.contains(" "), F.regexp_replace(head, r"\s+\S*$", "")).otherwise(head)
    return F.when(F.char_length(text) > length, F.concat(head, F.lit("..."))).otherwise(text)


def describe_persons(persons: DataFrame) -> DataFrame:
    """persons with birth_date and death_date as texts."""
    return persons.select("handle", "public_id", F.concat(full_name(F.col("given_name"), F.col("surname"), F.lit("Unknown")), lifespan(F.col("birth_date"), F.col("death_date"))).alias("description"))


def describe_families(families: DataFrame, names: DataFrame) -> DataFrame:
    """families(handle, public_id, father_handle, mother_handle, child_handles); names(handle, name)."""
    name = lambda c, as_: names.select(F.col("handle").alias(c), F.col("name").alias(as_))
    child = families.select("handle", F.posexplode("child_handles").alias("i", "child")).join(name("child", "n"), "child")
    child = child.groupBy("handle").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("kids"))
    f = families.join(name("father_handle", "father"), "father_handle", "left").join(name("mother_handle", "mother"), "mother_handle", "left").join(child, "handle", "left")
    parents = F.concat_ws(" & ", "father", "mother")
    n = F.coalesce(F.size("kids"), F.lit(0))
    more = F.when(n > 2, F.concat(F.lit(" (+"), (n - 2).cast("string"), F.lit(" more)"))).otherwise("")
    kids = F.when(n == 1, F.concat(F.lit("child: "), F.get("kids", F.lit(0)))).when(n > 1, F.concat(F.lit("children: "), F.array_join(F.slice("kids", 1, 2), ", "), more))
    body = F.concat_ws(" | ", F.when(parents != "", parents), kids)
    return f.select("handle", "public_id", F.concat(F.lit("Family"), F.when(body != "", F.concat(F.lit(": "), body)).otherwise(F.concat(F.lit(" ("), F.col("handle"), F.lit(")")))).alias("description"))


def describe_events(events: DataFrame, people: DataFrame) -> DataFrame:
    """people(event, pos, name): those of an event in order, from persons, then from family parents."""
    who = people.groupBy(F.col("event").alias("handle")).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "name"))), 1, 3), lambda x: x["name"]).alias("who"))
    date = F.coalesce(F.when(_has(dates.display_text(F.col("date"))), dates.display_text(F.col("date"))), F.lit("no date"))
    text = F.concat(F.col("event_type"), F.lit(" event ("), date, F.lit(")"), F.when(F.size("who") > 0, F.concat(F.lit(" — "), F.array_join("who", ", "))).otherwise(""))
    return events.join(who, "handle", "left").select("handle", "public_id", text.alias("description"))


def describe_places(places: DataFrame) -> DataFrame:
    spot = F.concat_ws(", ", *(F.when(_has(F.col(c)), F.col(c)) for c in ("street", "city", "county", "state", "country")))
    alt = F.get("alt_names", F.lit(0)) if "alt_names" in places.columns else F.lit(None).cast("string")
    title = F.col("title") if "title" in places.columns else F.lit(None).cast("string")
    return places.select("handle", "public_id", F.coalesce(*(F.when(_has(c), c) for c in (alt, title, spot)), F.lit("Unnamed Place")).alias("description"))


def source_title() -> Column:
    c = F.col
    return F.when(_has(c("title")), c("title")).when(_has(c("author")), F.concat(F.lit("Source by "), c("author"))).when(_has(c("pubinfo")), F.concat(F.lit("Source: "), c("pubinfo"))).otherwise("Unnamed Source")


def describe_sources(sources: DataFrame) -> DataFrame:
    return sources.select("handle", "public_id", source_title().alias("description"))


def describe_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.select(F.col("handle").alias("source_handle"), F.col("public_id").alias("_sid"), source_title().alias("_title"))
    page = F.when(_has(F.col("page")), F.concat(F.lit(", p. "), F.col("page"))).otherwise("")
    to = F.concat(F.lit(" → "), F.col("source_handle"), F.lit(" ["), F.coalesce("_sid", F.lit("")), F.lit('] "'), F.col("_title"), F.lit('"'))
    return citations.join(s, "source_handle", "left").select("handle", "public_id", F.concat(F.lit("Citation"), F.coalesce(to, F.lit("")), page).alias("description"))


def describe_media(media: DataFrame) -> DataFrame:
    date = dates.display_text(F.col("date")) if "date" in media.columns else F.lit(None).cast("string")
    text = F.when(_has(F.col("desc")), F.col("desc")).when(_has(F.col("path")), F.concat(F.lit("Media: "), F.col("path"))).when(_has(date), F.concat(F.lit("Media from "), date)).otherwise("Media")
    return media.select("handle", "public_id", text.alias("description"))


def describe_notes(notes: DataFrame) -> DataFrame:
    return notes.select("handle", "public_id", cut(F.col("text"), 150, at_space=True).alias("description"))


def describe_named(rows: DataFrame, kind: str) -> DataFrame:
    """Repositories and tags go by their name."""
    return rows.select("handle", "public_id", F.when(_has(F.col("name")), F.col("name")).otherwise(F.lit(f"Unnamed {kind}")).alias("description"))


def display_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, handle, public_id, display_name) for reports."""
    c = F.col
    rule = {
        "Person": full_name(c("given_name"), c("surname"), c("handle")), "Family": F.concat_ws(" & ", "father_handle", "mother_handle"),
        "Event": c("event_type"), "Place": F.concat_ws(", ", "street", "city"), "Source": c("title"), "Citation": c("page"),
        "Repository": c("name"), "Media": F.coalesce("desc", "path"), "Note": F.substring("text", 1, 80), "Tag": c("name"),
    }
    parts = [t.select(F.lit(k).alias("kind"), "handle", "public_id", F.coalesce(rule[k], F.lit("")).alias("display_name")) for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
