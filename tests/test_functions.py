"""Column functions on cases with known results."""

import pytest
from pyspark.sql import functions as F

from heartwood.functions import dates, decode, text


def values(spark, rows, column, schema="x string"):
    n = len(schema.split(","))
    return [r[0] for r in spark.createDataFrame([(r,) if n == 1 else r for r in rows], schema).select(column).collect()]


@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    globals().update(x=F.col("x"), y=F.col("y"))


def test_normalisers(spark):
    assert values(spark, ["  A  b\t\n c "], text.collapse_whitespace(x)) == ["A b c"]
    assert values(spark, ["  a b\n"], text.trim_whitespace(x)) == ["a b"]
    assert values(spark, ["ÀB"], text.case_fold(x)) == ["àb"]
    assert values(spark, ["<b>bold</b> a > b", "open <i never", "<<x>y>z"], text.strip_html_tags(x)) == ["bold a  b", "open ", "yz"]
    assert values(spark, ["12 Main St., Oak ave", "Stone Rd", "Main, First", "ST  hwy!"], text.expand_street_abbreviations(x)) == ["12 Main Street., Oak Avenue", "Stone Road", "Main, First", "Street  Highway!"]
    assert values(spark, ["p. 5", "pp. 5-6", "Page 7 ", "PAGES 8", "P. 9", "p.10"], text.strip_page_prefix(x)) == ["5", "5-6", "7", "8", "P. 9", "p.10"]
    assert values(spark, [" Red", "grey", "#abc", "Teal "], text.normalize_tag_color(x)) == ["#ff0000", "#808080", "#abc", "Teal"]
    assert values(spark, [("Dvořák", "Dvorak"), ("Čapek", "capek"), ("Čapek", "Capek"), ("Ármin", "Armin")], text.diacritic_insensitive_eq(x, y), "x string, y string") == [True, True, False, True]


def test_similarity(spark):
    two = "x string, y string"
    assert values(spark, [("", ""), ("abc", "abd"), ("café", "cafe"), ("", "ab")], F.round(text.levenshtein(x, y), 6), two) == [1.0, 0.666667, 0.8, 0.0]
    assert values(spark, [("", " "), ("a b", "b c"), ("a a", "a")], F.round(text.token_jaccard(x, y), 6), two) == [1.0, 0.333333, 1.0]
    assert values(spark, [("", ""), ("ab cd", "ab"), ("ab cd", "ab ce"), ("a", "")], text.tokenized_levenshtein(x, y), two) == [1.0, 0.5, 0.75, 0.0]


def test_keys_and_cells(spark):
    two = "x string, y string"
    assert values(spark, [(" A", "b "), (None, None), ("", "c")], text.normalize_key(x, y), two) == ["a|b", None, "|c"]
    assert values(spark, ['a"b\nc', None], text.csv_cell(x)) == ['"a""b c"', '""']
    assert values(spark, ["<a & 'b'>"], text.escape_xml(x)) == ["&lt;a &amp; &apos;b&apos;&gt;"]
    assert values(spark, ["[a, b]", "[]"], text.parse_handle_list(x)) == [["a", "b"], []]
    assert values(spark, ["__h", "h_"], text.normalize_handle(x)) == ["h", "h_"]
    assert values(spark, ["5.1", "9"], text.namespace_of_version(x)) == ["1.7.1", None]
    assert text.stem("/a/tree.xml.gz") == "tree" and text.next_deleted_name("/a/t.xml", {"/a/t-deleted-1.xml"}) == "/a/t-deleted-2.xml"


def test_text_scores_keep_the_last(spark):
    c = F.array(*(F.struct(F.lit(k).alias("field_kind"), F.lit(n).alias("field_name"), F.lit(s).alias("similarity")) for k, n, s in (("Text", "a", 0.1), ("Enum", "b", 0.0), ("Text", "a", 0.3))))
    assert values(spark, ["-"], text.text_scores(c)) == [{"a": 0.3}]


@pytest.mark.parametrize(
    ("val", "quality", "kind", "shown", "valid"),
    [
        ("1850-07-13", None, None, "1850-07-13", True),
        ("1850-07", "estimated", "about", "estimated about 1850-07", True),
        ("1850", "Calculated", "range", "calculated between (range) 1850", True),
        ("1900-02-29", None, None, "1900-02-29", False),
        ("2000-02-29 (new)", None, "span", "from (span) 2000-02-29", True),
        ("unknown", None, None, None, False),
        ("1850-13", None, None, "1850-13", False),
        ("0-1-1", None, None, "0000-01-01", False),
    ],
)
def test_dates(spark, val, quality, kind, shown, valid):
    d = dates.parse_reported(x, y, F.col("z"))
    row = spark.createDataFrame([(val, quality, kind)], "x string, y string, z string").select(dates.display_text(d), dates.is_valid(d)).first()
    assert tuple(row) == (shown, valid)


def test_other_date_parsers(spark):
    assert values(spark, ["1850-7-1", "about 1850", ""], dates.parse_kept(x)["year"]) == [1850, 0, 0]
    assert values(spark, ["about 1850", ""], dates.parse_kept(x)["text"]) == ["about 1850", None]
    assert values(spark, ["1850-x", " 1850", "x"], dates.parse_year(x)) == [1850, None, None]
    day_only = dates.date_value(F.lit(1850), day=F.lit(3))
    assert values(spark, ["-"], F.struct(dates.display_text(day_only), dates.is_valid(day_only))) == [("1850", False)]


def test_decoders(spark):
    assert values(spark, [" birth ", "AKA", "x"], decode.decode(x, "NameType")) == ["Birth", "Also Known As", None]
    assert values(spark, ["dna", "x"], decode.decode(x, "AttributeType")) == ["DNA", "Custom"]
    assert values(spark, ["Bar-Mitzvah", "cause of death", "military_service", "party"], decode.event_type(x)) == ["Bar Mitzvah", "CAUSEDEATH", "Military Service", None]
    assert values(spark, ["M", "female", "2", None], decode.gender(x)) == [0, 1, 2, 2]
