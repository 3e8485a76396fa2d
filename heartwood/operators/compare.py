"""Field-level comparison of two versions of a record.

Each function gives an array of changes, struct<field_kind, field_name, old_value,
new_value, similarity>, empty if the values agree; ``changes`` joins several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text

CHANGE = "array<struct<field_kind:string,field_name:string,old_value:string,new_value:string,similarity:double>>"


def _change(kind: str, name: Column, old: Column, new: Column, similarity: Column) -> Column:
    return F.struct(F.lit(kind).alias("field_kind"), name.alias("field_name"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), similarity.cast("double").alias("similarity"))


def _if(differ: Column, change: Column) -> Column:
    return F.when(differ, F.array(change)).otherwise(F.array()).cast(CHANGE)


def _name(name: str | Column) -> Column:
    return F.lit(name) if isinstance(name, str) else name


def changes(*parts: Column) -> Column:
    return F.flatten(F.array(*parts))


def compare_text(name: str | Column, a: Column, b: Column) -> Column:
    """Equal when lower-cased and with white space collapsed; values are shown raw. One
    side missing has similarity 0."""
    x, y = (text.collapse_whitespace(text.case_fold(v)) for v in (a, b))
    score = F.coalesce(text.tokenized_levenshtein(x, y), F.lit(0.0))
    return _if(~x.eqNullSafe(y), _change("Text", _name(name), a, b, score))


def compare_handles(name: str | Column, a: Column, b: Column) -> Column:
    """Lists of handles as multisets; shown in their own order, scored by Jaccard of sets."""
    a, b = (F.coalesce(v, F.array().cast("array<string>")) for v in (a, b))
    any_ = F.size(F.array_union(a, b))
    score = F.when(any_ == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / any_)
    return _if(F.sort_array(a) != F.sort_array(b), _change("HandleRefList", _name(name), _listed(a), _listed(b), score))


def _listed(handles: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(handles, ", "), F.lit("]"))


def compare_handle(name: str | Column, a: Column, b: Column) -> Column:
    return _if(~a.eqNullSafe(b), _change("HandleRef", _name(name), a, b, F.lit(0.0)))


def compare_date(name: str | Column, a: Column, b: Column) -> Column:
    x, y = dates.display_text(a), dates.display_text(b)
    return _if(~x.eqNullSafe(y), _change("Date", _name(name), x, y, F.coalesce(text.tokenized_levenshtein(x, y), F.lit(0.0))))


def compare_value(kind: str, name: str | Column, a: Column, b: Column) -> Column:
    """Enum, Boolean, Numeric or Unknown: inequality, similarity 0."""
    return _if(~a.eqNullSafe(b), _change(kind, _name(name), a, b, F.lit(0.0)))


def compare_refs(name: str, a: Column, b: Column, meta: Callable[[Column, Column], Column] | None = None) -> Column:
    """Lists of structs with a ``ref``: if the multisets of refs differ, one change with
    similarity 0, shown sorted; else ``meta`` of the pairs in sorted order."""
    empty = F.array().cast("array<string>")
    refs = lambda v: F.coalesce(F.sort_array(F.transform(v, lambda x: x["ref"])), empty)
    x, y = refs(a), refs(b)
    set_change = _if(x != y, _change("HandleRefList", F.lit(name), _listed(x), _listed(y), F.lit(0.0)))
    if meta is None:
        return set_change
    by_ref = lambda v: F.array_sort(v, lambda p, q: F.when(p["ref"] < q["ref"], -1).when(p["ref"] > q["ref"], 1).otherwise(0))
    pairs = F.arrays_zip(by_ref(a).alias("a"), by_ref(b).alias("b"))
    within = F.flatten(F.transform(pairs, lambda p: meta(p["a"], p["b"])))
    return F.when(x != y, set_change).otherwise(F.coalesce(within, F.array().cast(CHANGE)))


def compare_list(name: str | Column, a: Column, b: Column, item: Callable[[Column, Column, Column], Column]) -> Column:
    """Lists of structs by index: ``item`` (path, a, b) where both have one, else a text
    change with similarity 0. Paths are ``name[0]`` and so on."""
    n = F.greatest(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)), F.lit(0))

    def at(i: Column) -> Column:
        path = F.concat(_name(name), F.lit("["), i.cast("string"), F.lit("]"))
        x, y = F.get(a, i), F.get(b, i)
        return F.when(x.isNotNull() & y.isNotNull(), item(path, x, y)).otherwise(_if(x.isNotNull() | y.isNotNull(), _change("Text", path, F.to_json(x), F.to_json(y), F.lit(0.0))))

    return F.when(n == 0, F.array().cast(CHANGE)).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


TEXT, HANDLE, HANDLES, DATE, ENUM, BOOL, NUMBER, REFS, NESTED_LIST, PART = "text", "handle", "handles", "date", "enum", "bool", "number", "refs", "nested", "part"
# The fields of nested structs, each with its comparison.
LOCATION = dict.fromkeys(("street", "city", "county", "state", "country", "postal", "locality", "phone"), TEXT)
SURNAME = {"surname": TEXT, "prefix": TEXT, "primary": BOOL, "origintype": ENUM}
NESTED: dict[str, dict[str, str]] = {
    "surname_list": SURNAME,
    "alternate_names": {"display": TEXT, "first_name": TEXT, "suffix": TEXT, "title": TEXT, "type": ENUM, "date": DATE, "surname_list": NESTED_LIST},
    "location": LOCATION,
    "address_list": {"date": DATE, "location": PART, **LOCATION, "citation_list": HANDLES, "note_list": HANDLES},
    "attribute_list": {"type": ENUM, "value": TEXT, "citation_list": HANDLES, "note_list": HANDLES},
    "url_list": {"desc": TEXT, "path": TEXT, "type": ENUM},
    "lds_ord_list": {"type": ENUM, "date": DATE, "status": TEXT, "temple": TEXT, "place_handle": HANDLE, "citation_list": HANDLES, "note_list": HANDLES},
}
#: What references of a list say beside their target, compared where both lists have the same.
META = {"event_ref_list": {"role": ENUM}, "child_ref_list": {"relation": ENUM}, "person_ref_list": {"relation": ENUM}, "reporef_list": {"call_number": TEXT, "media_type": ENUM}}


def fields_of(kind: T.DataType) -> dict[str, T.DataType]:
    """Names and types of a struct's fields, or of the structs in an array."""
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}


def compare_struct(path: Column, a: Column, b: Column, fields: dict[str, str] | list[str], kind: T.DataType | None = None) -> Column:
    """The fields of a nested struct, named ``path.field``; a list of names compares texts.
    With ``kind``, the struct's type, fields that it lacks are left out."""
    fields = fields if isinstance(fields, dict) else dict.fromkeys(fields, TEXT)
    have = fields_of(kind) if kind is not None else {}
    parts = [compare_as(how, f, F.concat(path, F.lit(f".{f}")), a[f], b[f], have.get(f)) for f, how in fields.items() if kind is None or f in have]
    return changes(*parts) if parts else F.array().cast(CHANGE)


def compare_part(path: Column, a: Column, b: Column, fields: dict[str, str], kind: T.DataType | None = None) -> Column:
    """A struct that may be missing: field by field where both have it, else a text change
    with similarity 0."""
    both, any_ = a.isNotNull() & b.isNotNull(), a.isNotNull() | b.isNotNull()
    return F.when(both, compare_struct(path, a, b, fields, kind)).otherwise(_if(any_, _change("Text", path, F.to_json(a), F.to_json(b), F.lit(0.0))))


def compare_as(how: str, field: str, name: str | Column, a: Column, b: Column, kind: T.DataType | None = None) -> Column:
    """The changes between a and b by the comparison ``how`` of a field; ``kind`` is its type,
    if known."""
    if how == TEXT:
        return compare_text(name, a, b)
    if how == HANDLE:
        return compare_handle(name, a, b)
    if how == HANDLES:
        return compare_handles(name, a, b)
    if how == DATE:
        return compare_date(name, a, b)
    if how == PART:
        return compare_part(_name(name), a, b, NESTED[field], kind)
    if how == REFS:
        meta = {f: m for f, m in META.get(field, {}).items() if f in fields_of(kind)} if kind is not None else {}
        within = lambda x, y: changes(*(compare_as(m, f, f"{field}.{f}", x[f], y[f]) for f, m in meta.items()))
        return compare_refs(name, a, b, within if meta else None)
    if how == NESTED_LIST:
        return compare_list(name, a, b, lambda path, x, y: compare_struct(path, x, y, NESTED[field], kind))
    return compare_value({ENUM: "Enum", BOOL: "Boolean", NUMBER: "Numeric"}.get(how, "Unknown"), name, a, b)


# The comparison of each kind's fields.
_COMMON = {"citation_list": HANDLES, "note_list": HANDLES, "media_list": HANDLES, "tag_list": HANDLES, "attribute_list": NESTED_LIST}
FIELDS: dict[str, dict[str, str]] = {
    "Person": {"public_id": TEXT, "gender": NUMBER, "given_name": TEXT, "surname": TEXT, "suffix": TEXT, "title": TEXT, "name_type": ENUM, "surname_list": NESTED_LIST, "alternate_names": NESTED_LIST, "event_ref_list": REFS, "family_list": HANDLES, "parent_family_list": HANDLES, "person_ref_list": REFS, **_COMMON, "address_list": NESTED_LIST, "url_list": NESTED_LIST, "lds_ord_list": NESTED_LIST},
    "Family": {"public_id": TEXT, "father_handle": HANDLE, "mother_handle": HANDLE, "child_ref_list": REFS, "event_ref_list": REFS, **_COMMON},
    "Event": {"public_id": TEXT, "event_type": ENUM, "date": DATE, "place_handle": HANDLE, "description": TEXT, **_COMMON},
    "Place": {"public_id": TEXT, "city": TEXT, "street": TEXT, "county": TEXT, "state": TEXT, "country": TEXT, "place_ref_list": REFS, **_COMMON},
    "Source": {"public_id": TEXT, "title": TEXT, "author": TEXT, "pubinfo": TEXT, "reporef_list": REFS, "note_list": HANDLES, "media_list": HANDLES, "tag_list": HANDLES, "attribute_list": NESTED_LIST},
    "Citation": {"public_id": TEXT, "source_handle": HANDLE, "page": TEXT, "confidence": NUMBER, "note_list": HANDLES, "media_list": HANDLES, "tag_list": HANDLES},
    "Repository": {"public_id": TEXT, "type": ENUM, "name": TEXT, "note_list": HANDLES, "address_list": NESTED_LIST, "url_list": NESTED_LIST, "media_list": HANDLES, "tag_list": HANDLES},
    "Media": {"public_id": TEXT, "path": TEXT, "mime_type": TEXT, "desc": TEXT, "checksum": TEXT, "citation_list": HANDLES, "note_list": HANDLES, "attribute_list": NESTED_LIST, "tag_list": HANDLES},
    "Note": {"public_id": TEXT, "text": TEXT, "format": NUMBER, "type": ENUM, "citation_list": HANDLES, "tag_list": HANDLES},
    "Tag": {"public_id": TEXT, "name": TEXT, "color": TEXT, "priority": NUMBER, "tag_list": HANDLES},
}


def compare_fields(fields: dict[str, str], a: str = "a", b: str = "b", kind: T.StructType | None = None) -> Column:
    """All changes between struct columns a and b over typed fields, in order. With
    ``kind``, the structs' type, fields that they lack are left out."""
    have = fields_of(kind) if kind is not None else {}
    parts = [compare_as(how, n, n, F.col(f"{a}.{n}"), F.col(f"{b}.{n}"), have.get(n)) for n, how in fields.items() if kind is None or n in have]
    return changes(*parts) if parts else F.array().cast(CHANGE)
