"""Partial dates: struct<year, month, day, quality, modifier, text>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import DATE

PREFIX = {"Before": "before ", "After": "after ", "About": "about ", "Range": "between (range) ", "Span": "from (span) "}
QUALITY = {"Estimated": "estimated ", "Calculated": "calculated "}


def _prefix(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(""))


def date_value(year: Column, month: Column | None = None, day: Column | None = None, quality: Column | None = None, modifier: Column | None = None, text: Column | None = None) -> Column:
    none = F.lit(None)
    parts = [year, month, day, quality if quality is not None else F.lit("Exact"), modifier if modifier is not None else F.lit("None"), text]
    return F.struct(*((p if p is not None else none).cast(f.dataType).alias(f.name) for p, f in zip(parts, DATE.fields, strict=True)))


def display_text(d: Column) -> Column:
    """The text if there is one; else the parts known, behind modifier and quality. A day
    without a month isn't shown."""
    base = (
        F.when(d["month"].isNotNull() & d["day"].isNotNull(), F.format_string("%04d-%02d-%02d", d["year"], d["month"], d["day"]))
        .when(d["month"].isNotNull(), F.format_string("%04d-%02d", d["year"], d["month"]))
        .otherwise(F.format_string("%04d", d["year"]))
    )
    built = F.concat(_prefix(F.coalesce(d["quality"], F.lit("")), QUALITY), _prefix(F.coalesce(d["modifier"], F.lit("")), PREFIX), base)
    return F.when(d.isNull(), None).when(F.coalesce(d["text"], F.lit("")) != "", d["text"]).otherwise(built)


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def is_valid(d: Column) -> Column:
    y, m, day = d["year"], d["month"], d["day"]
    last = F.when(m == 2, F.when(is_leap_year(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    year_ok, month_ok = y.between(1, 9999), m.isNull() | m.between(1, 12)
    day_ok = F.when(day.isNull(), True).when(m.isNull(), False).otherwise(day.between(1, last))
    return F.coalesce(year_ok & month_ok & day_ok, F.lit(False))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))


def parse_reported(val: Column, quality: Column | None = None, kind: Column | None = None) -> Column:
    """Of the first word's parts; no date without a year. For comparisons."""
    parts = F.split(F.split(F.trim(val), r"\s+")[0], "-")
    year, month, day = (_int(F.get(parts, F.lit(i))) for i in range(3))
    coded = lambda c, known: F.when(F.lower(F.trim(c)).isin([k.lower() for k in known]), F.initcap(F.lower(F.trim(c)))) if c is not None else None
    d = date_value(year, month, day, coded(quality, ["Exact", "Estimated", "Calculated"]), coded(kind, ["About", "After", "Before", "Range", "Span", "None"]))
    return F.when(year.isNotNull(), d)


def parse_kept(val: Column) -> Column:
    """A bad year is 0, and the raw text stays. For deletions."""
    parts = F.split(val, "-")
    text = F.when(val != "", val)
    return date_value(F.coalesce(_int(F.trim(parts[0])), F.lit(0)), _int(F.get(parts, F.lit(1))), _int(F.get(parts, F.lit(2))), text=text)


def parse_year(val: Column) -> Column:
    """What stands before the first hyphen, if that is a number. For views."""
    return _int(F.substring_index(val, "-", 1))


def today() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd")


def timestamp_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
