"""Normalisation and similarity of text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street abbreviations, colour names, letters without their marks.
STREET = {"st": "Street", "ave": "Avenue", "blvd": "Boulevard", "rd": "Road", "ln": "Lane", "dr": "Drive", "ct": "Court", "sq": "Square", "pkwy": "Parkway", "hwy": "Highway"}
COLOR = {"red": "#ff0000", "green": "#00ff00", "blue": "#0000ff", "white": "#ffffff", "black": "#000000", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080", "pink": "#ffc0cb", "gray": "#808080", "grey": "#808080"}
PLAIN = {
    "áàâäãåā": "a", "éèêëē": "e", "íìîïī": "i", "óòôöõō": "o", "úùûüū": "u", "ýỳŷÿ": "y", "ñń": "n", "çć": "c", "ğ": "g", "ş": "s",
    "žżź": "z", "ł": "l", "đ": "d", "ř": "r", "š": "s", "ť": "t", "ČĆ": "c", "Ď": "d", "Ě": "e", "Ň": "n", "Ř": "r", "Š": "s", "Ť": "t", "ŽŹŻ": "z",
    "ÁÀÂÄÃÅĀ": "A", "ÉÈÊËĒ": "E", "ÍÌÎÏĪ": "I", "ÓÒÔÖÕŌ": "O", "ÚÙÛÜŪ": "U", "ÝỲŶŸ": "Y", "ÑŃ": "N", "Ç": "C", "Ğ": "G", "Ş": "S", "Ł": "L", "Đ": "D",
}
LABEL = {"Same": "SAME", "Modified": "MODIFIED", "Added": "ADDED", "Removed": "REMOVED", "NeedsReview": "NEEDS REVIEW", "ExtrinsicOnly": "EXTRINSIC ONLY"}
NAMESPACE = {"5.0": "1.7.0", "5.1": "1.7.1", "5.2": "1.7.2", "6.0": "1.8.0"}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for key, or null."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def case_fold(c: Column) -> Column:
    return F.lower(c)


def trim_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html_tags(c: Column) -> Column:
    """Drops from each < to the next > (or the end), and any > left."""
    return F.regexp_replace(c, r"<[^>]*>?|>", "")


def expand_street_abbreviations(c: Column) -> Column:
    """Whole words in any case, before trailing punctuation, which stays once."""
    for short, whole in STREET.items():
        c = F.regexp_replace(c, rf"(?i)(?<!\S){short}(?=[,.;:!]*(?!\S))", whole)
    return c


def strip_page_prefix(c: Column) -> Column:
    return trim_whitespace(F.regexp_replace(trim_whitespace(c), r"^(?:p\. |pp\. |(?i:pages? ))", ""))


def normalize_tag_color(c: Column) -> Column:
    t = trim_whitespace(c)
    return F.coalesce(lookup(F.lower(t), COLOR), t)


def without_diacritics(c: Column) -> Column:
    return F.translate(c, "".join(PLAIN), "".join(v * len(k) for k, v in PLAIN.items()))


def diacritic_insensitive_eq(a: Column, b: Column) -> Column:
    return without_diacritics(a) == without_diacritics(b)


def levenshtein(a: Column, b: Column) -> Column:
    """1 less the distance in characters over the longer length in bytes; 1 if both are empty."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def token_jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(both / any_)


def tokenized_levenshtein(a: Column, b: Column) -> Column:
    """Mean over the longer list of words, paired by position; a missing word is empty."""
    x, y = tokens(a), tokens(b)
    n = F.greatest(F.size(x), F.size(y))
    word = lambda t, i: F.coalesce(F.get(t, i), F.lit(""))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + levenshtein(word(x, i), word(y, i)))
    return F.when(n == 0, F.lit(1.0)).otherwise(total / n)


def normalize_key(*parts: Column) -> Column:
    """Parts joined by a bar, lower-cased and trimmed as a whole; null if nothing but bars is left."""
    key = trim_whitespace(F.lower(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))))
    return F.when(key.isin([""] + ["|" * i for i in range(1, len(parts))]), None).otherwise(key)


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def csv_cell(c: Column) -> Column:
    """Always quoted; a quote doubles, each line end is a space."""
    clean = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", " ")
    return F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('""')), F.lit('"'))


def two_decimals(c: Column) -> Column:
    return F.format_string("%.2f", c)


def format_side(handle: Column, public_id: Column, name: Column) -> Column:
    return F.concat(handle, F.lit(" ["), F.coalesce(public_id, F.lit("")), F.lit('] "'), F.coalesce(name, F.lit("")), F.lit('"'))


def classification_label(c: Column) -> Column:
    return lookup(c, LABEL)


def text_scores(changes: Column) -> Column:
    """Field to similarity of the text changes; of one field the last counts."""
    text = F.filter(changes, lambda x: x["field_kind"] == "Text")
    last = F.filter(text, lambda x, i: ~F.exists(F.slice(text, i + 2, F.size(text)), lambda y: y["field_name"] == x["field_name"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["field_name"], x["similarity"])))


def normalize_handle(c: Column) -> Column:
    """Handles are equal with or without leading underscores."""
    return F.regexp_replace(c, "^_+", "")


def parse_handle_list(c: Column) -> Column:
    """'[a, b]' as an array."""
    inner = F.regexp_replace(c, r"^\[|\]$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ", "))


def namespace_of_version(c: Column) -> Column:
    return lookup(c, NAMESPACE)


def version_of_namespace(c: Column) -> Column:
    return lookup(c, {v: k for k, v in NAMESPACE.items()})


# Names of files, on the driver.


def stem(path: str) -> str:
    """A file's name without its folder and known endings."""
    name = path.rsplit("/", 1)[-1]
    for end in (".gz", ".xml", ".json", ".csv"):
        name = name.removesuffix(end)
    return name


def next_deleted_name(path: str, taken: set[str]) -> str:
    """The first free name of the form ``<name>-deleted-N`` beside path."""
    name = path.rsplit("/", 1)[-1]
    folder, base = path[: len(path) - len(name)], stem(name)
    end = name[len(base) :]
    n = 1
    while (out := f"{folder}{base}-deleted-{n}{end}") in taken:
        n += 1
    return out
