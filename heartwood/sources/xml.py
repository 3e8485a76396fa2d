"""Graph files in XML: reading into typed tables and edges, and writing back.

Plain files go through Spark's XML reader, one pass for each kind's row tag, with fixed
schemas. Files that are gzip whatever their name are unpacked on the executors and their
elements parsed with ``from_xml``.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, decode
from ..functions.text import NAMESPACE, escape_xml, normalize_handle, version_of_namespace
from ..model import EDGES, SECTIONS, Graph
from ..scratch import Scratch

_REF = "array<struct<_hlink:string>>"
_NOTED = f"noteref {_REF}, tagref {_REF}, mediaref {_REF}, objref {_REF}, citationref {_REF}"
_EVENTREF = "eventref array<struct<_hlink:string,_role:string,role:string>>"
_ATTRIBUTE = "attribute array<struct<_type:string,_value:string,type:string,value:string>>"
_DATE = "dateval struct<_val:string,_quality:string,_type:string>"
_PLACE = "struct<street:string,locality:string,city:string,county:string,state:string,country:string,postal:string,phone:string>"
_ADDRESS = f"address array<struct<location:{_PLACE},street:string,locality:string,city:string,county:string,state:string,country:string,postal:string,phone:string>>"
_URL = "url array<struct<_href:string,_type:string,_description:string,desc:string,type:string>>"
#: Row tag(s) and schema of each kind.
SCHEMA: dict[str, tuple[list[str], str]] = {
    "Person": (["person"], f"_handle string, _id string, gender string, name array<struct<_type:string,first:string,suffix:string,title:string,surname:array<struct<_VALUE:string,_prefix:string,_prim:string,_origintype:string>>>>, {_EVENTREF}, personref array<struct<_hlink:string,_relation:string,_rel:string>>, lds_ord array<struct<_type:string,_status:string,_temple:string>>, birth struct<{_DATE.replace(' ', ':', 1)}>, death struct<{_DATE.replace(' ', ':', 1)}>, {_ATTRIBUTE}, {_ADDRESS}, {_URL}, {_NOTED}"),
    "Family": (["family"], f"_handle string, _id string, father struct<_hlink:string>, mother struct<_hlink:string>, childref array<struct<_hlink:string,_relation:string,_rel:string>>, {_EVENTREF}, {_ATTRIBUTE}, {_NOTED}"),
    "Event": (["event"], f"_handle string, _id string, type string, eventtype struct<type:string>, {_DATE}, place struct<_hlink:string>, description string, {_ATTRIBUTE}, {_NOTED}"),
    "Place": (["place", "placeobj"], f"_handle string, _id string, name struct<_value:string>, pname array<struct<_value:string>>, ptitle string, code string, lat string, long string, street string, locality string, city string, county string, state string, country string, postal string, phone string, placeref {_REF}, {_ATTRIBUTE}, {_NOTED}"),
    "Source": (["source"], f"_handle string, _id string, title string, stitle string, author string, sauthor string, pubinfo string, spubinfo string, abbrev string, sabbrev string, reporef array<struct<_hlink:string,_callnumber:string,_callno:string,_mediatype:string,_medium:string>>, {_ATTRIBUTE}, {_NOTED}"),
    "Citation": (["citation"], f"_handle string, _id string, page string, confidence string, sourceref struct<_hlink:string>, {_NOTED}"),
    "Repository": (["repository"], f"_handle string, _id string, name string, rname string, type string, {_ADDRESS}, {_URL}, {_NOTED}"),
    "Media": (["object", "media"], f"_handle string, _id string, file struct<_VALUE:string,_src:string,_mime:string>, path string, mime string, description string, desc string, checksum string, {_ATTRIBUTE}, {_NOTED}"),
    "Note": (["note"], f"_handle string, _id string, _type string, _format string, text string, format string, type string, {_NOTED}"),
    "Tag": (["tag"], f"_handle string, _id string, _name string, _color string, _priority string, name string, color string, priority string, {_NOTED}"),
}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files, unpacked if their first two bytes say gzip; a file
    of less than two bytes is empty."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            text = ["" if len(x) < 2 else (gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x).decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, content string")


def read_version(texts: DataFrame) -> DataFrame:
    """(path, version): of the header as X.Y, or by the namespace; null if neither says."""
    head = F.regexp_extract("content", r'<created[^>]*\sversion="(\d+\.\d+)', 1)
    space = F.regexp_extract("content", r'xmlns="[^"]*/(\d+\.\d+\.\d+)/?"', 1)
    return texts.select("path", F.coalesce(F.when(head != "", head), version_of_namespace(space)).alias("version"))


def unsupported_versions(texts: DataFrame) -> DataFrame:
    known = read_version(texts)
    return known.filter(F.col("version").isNull() | ~F.col("version").isin(list(NAMESPACE)))


def _rows(spark: SparkSession, path: str | None, texts: DataFrame | None, kind: str) -> DataFrame:
    tags, schema = SCHEMA[kind]
    out = None
    for tag in tags:
        if texts is None:
            part = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
        else:
            found = F.regexp_extract_all("content", F.lit(rf"(?s)(<{tag}(?:\s[^>]*)?/>|<{tag}(?:\s[^>]*[^/>])?>.*?</{tag}>)"), 1)
            item = texts.select(F.explode(found).alias("x"))
            part = item.select(F.from_xml("x", schema, {"ignoreNamespace": "true"}).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out.filter("_handle is not null")  # elements of the same name inside others have none


def _first(*c: str | Column) -> Column:
    cols = [F.col(x) if isinstance(x, str) else x for x in c]
    return F.coalesce(*(F.when(x != "", x) for x in cols))


def _hlinks(name: str) -> Column:
    return F.coalesce(F.transform(name, lambda x: x["_hlink"]), F.array().cast("array<string>"))


_LISTS = {"note_list": "noteref", "tag_list": "tagref", "citation_list": "citationref"}


def tables(spark: SparkSession, path: str | None = None, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The typed table of each kind, from plain files at path or from ``read_texts``."""
    raw = {k: _rows(spark, path, texts, k) for k in SCHEMA}
    lists = [*(_hlinks(r).alias(n) for n, r in _LISTS.items()), F.concat(_hlinks("mediaref"), _hlinks("objref")).alias("media_list")]
    date = lambda c: dates.parse_reported(F.col(f"{c}._val"), F.col(f"{c}._quality"), F.col(f"{c}._type"))
    refs = F.coalesce(F.transform("eventref", lambda r: F.struct(r["_hlink"].alias("ref"), F.coalesce(r["_role"], r["role"]).alias("role"))), F.array().cast("array<struct<ref:string,role:string>>")).alias("event_ref_list")
    rel = lambda c: F.coalesce(F.transform(c, lambda r: F.struct(r["_hlink"].alias("ref"), F.coalesce(r["_relation"], r["_rel"]).alias("relation"))), F.array().cast("array<struct<ref:string,relation:string>>"))
    attrs = F.transform("attribute", lambda a: F.struct(decode.decode(F.coalesce(a["_type"], a["type"]), "AttributeType").alias("type"), F.coalesce(a["_value"], a["value"]).alias("value"))).alias("attribute_list")
    urls = F.transform("url", lambda u: F.struct(u["_href"].alias("path"), F.coalesce(u["_description"], u["desc"]).alias("desc"), decode.decode(F.coalesce(u["_type"], u["type"]), "UrlType").alias("type"))).alias("url_list")
    spot = ("street", "locality", "city", "county", "state", "country", "postal", "phone")
    address = F.transform("address", lambda a: F.struct(*(F.coalesce(a[f], a["location"][f]).alias(f) for f in spot))).alias("address_list")
    key = [F.col("_handle").alias("handle"), F.col("_id").alias("public_id")]
    name = F.get("name", F.lit(0))
    surnames = lambda n: F.transform(n["surname"], lambda s: F.struct(s["_VALUE"].alias("surname"), s["_prefix"].alias("prefix"), (s["_prim"] == "1").alias("primary"), decode.decode(s["_origintype"], "NameOriginType").alias("origintype")))
    surname = lambda n: F.coalesce(F.get(F.filter(n["surname"], lambda s: s["_prim"] == "1"), F.lit(0))["_VALUE"], F.get(n["surname"], F.lit(0))["_VALUE"])
    return {
        "Person": raw["Person"].select(*key, decode.gender(F.col("gender")).alias("gender"), name["first"].alias("given_name"), surname(name).alias("surname"), decode.decode(name["_type"], "NameType").alias("name_type"), name["suffix"].alias("suffix"), name["title"].alias("title"), surnames(name).alias("surname_list"), F.transform(F.slice("name", F.lit(2), F.greatest(F.size("name"), F.lit(0))), lambda n: F.struct(n["first"].alias("first_name"), F.get(n["surname"], F.lit(0))["_VALUE"].alias("surname"), n["suffix"].alias("suffix"), n["title"].alias("title"), decode.decode(n["_type"], "NameType").alias("type"), surnames(n).alias("surname_list"))).alias("alternate_names"), F.col("birth.dateval._val").alias("birth_date"), F.col("death.dateval._val").alias("death_date"), refs, rel("personref").alias("person_ref_list"), attrs, address, urls, F.transform("lds_ord", lambda o: F.struct(decode.decode(o["_type"], "LdsOrdType").alias("type"), o["_status"].alias("status"), o["_temple"].alias("temple"))).alias("lds_ord_list"), *lists),
        "Family": raw["Family"].select(*key, F.col("father._hlink").alias("father_handle"), F.col("mother._hlink").alias("mother_handle"), rel("childref").alias("child_ref_list"), _hlinks("childref").alias("child_handles"), refs, attrs, *lists),
        "Event": raw["Event"].select(*key, decode.event_type(_first("eventtype.type", "type")).alias("event_type"), date("dateval").alias("date"), F.col("place._hlink").alias("place_handle"), "description", attrs, *lists),
        "Place": raw["Place"].select(*key, _first("city", "name._value", F.get("pname", F.lit(0))["_value"]).alias("city"), "street", "county", "state", "country", F.col("ptitle").alias("title"), F.transform("pname", lambda p: p["_value"]).alias("alt_names"), "code", "lat", "long", F.transform("placeref", lambda r: F.struct(r["_hlink"].alias("ref"))).alias("place_ref_list"), attrs, *lists),
        "Source": raw["Source"].select(*key, _first("title", "stitle").alias("title"), _first("author", "sauthor").alias("author"), _first("pubinfo", "spubinfo").alias("pubinfo"), _first("abbrev", "sabbrev").alias("abbrev"), F.transform("reporef", lambda r: F.struct(r["_hlink"].alias("ref"), F.coalesce(r["_callnumber"], r["_callno"]).alias("call_number"), decode.decode(F.coalesce(r["_mediatype"], r["_medium"]), "SourceMediaType").alias("media_type"))).alias("reporef_list"), attrs, *lists),
        "Citation": raw["Citation"].select(*key, F.col("sourceref._hlink").alias("source_handle"), "page", F.col("confidence").try_cast("int").alias("confidence"), *lists),
        "Repository": raw["Repository"].select(*key, _first("name", "rname").alias("name"), decode.decode(F.col("type"), "RepositoryType").alias("type"), address, urls, *lists),
        "Media": raw["Media"].select(*key, _first("file._src", "path", "file._VALUE").alias("path"), _first("file._mime", "mime").alias("mime_type"), _first("description", "desc").alias("desc"), "checksum", attrs, *lists),
        "Note": raw["Note"].select(*key, "text", _first("_format", "format").try_cast("int").alias("format"), _first("_type", "type").alias("type"), *lists),
        "Tag": raw["Tag"].select(*key, _first("_name", "name").alias("name"), _first("_color", "color").alias("color"), _first("_priority", "priority").try_cast("int").alias("priority"), *lists),
    }


def viewer_names(spark: SparkSession, path: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(handle, given_name, surname) as a viewer shows people: of several names the last one
    counts, and of its surnames the first."""
    last = F.element_at("name", -1)
    rows = _rows(spark, path, texts, "Person").filter(F.size("name") > 0)
    return rows.select(F.col("_handle").alias("handle"), last["first"].alias("given_name"), F.get(last["surname"], F.lit(0))["_VALUE"].alias("surname"))


def edges_of(t: dict[str, DataFrame]) -> DataFrame:
    """The references of typed tables as edges, with their metadata."""
    none = F.lit(None).cast("string")

    def edge(kind: str, edge_type: str, refs: Column, **meta: str) -> DataFrame:
        x = t[kind].select(F.col("handle").alias("source"), F.explode(refs).alias("r"))
        target = F.col("r.ref") if meta else F.col("r")
        more = [(F.col(f"r.{meta[m]}") if m in meta and meta[m] != "ref" else none).alias(m) for m in ("role", "relation", "call_number", "media_type")]
        return x.select(F.lit(edge_type).alias("edge_type"), "source", target.alias("target"), *more).filter("target is not null")

    parts = [
        edge("Person", "PersonEventRef", F.col("event_ref_list"), role="role"), edge("Family", "FamilyEventRef", F.col("event_ref_list"), role="role"),
        edge("Family", "FamilyChildRef", F.col("child_ref_list"), relation="relation"), edge("Person", "PersonPersonRef", F.col("person_ref_list"), relation="relation"),
        edge("Source", "SourceRepoRef", F.col("reporef_list"), call_number="call_number", media_type="media_type"),
        edge("Family", "FamilyFather", F.array("father_handle")), edge("Family", "FamilyMother", F.array("mother_handle")),
        edge("Event", "EventPlace", F.array("place_handle")), edge("Place", "PlacePlaceRef", F.transform("place_ref_list", lambda r: r["ref"])), edge("Citation", "CitationSource", F.array("source_handle")),
    ]
    for kind in t:
        for suffix, col in (("Citation", "citation_list"), ("Note", "note_list"), ("MediaRef", "media_list"), ("Tag", "tag_list")):
            name = "NoteRef" if (kind, suffix) == ("Note", "Note") else f"{kind}{suffix}"
            if name in EDGES:
                parts.append(edge(kind, name, F.col(col)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_id", F.monotonically_increasing_id())


def load(spark: SparkSession, path: str, packed: bool = False, dangling: str = "placeholder") -> Graph:
    """The graph of the files at path. References to nothing make inferred nodes of the
    kind that the edge asks for, or are dropped (``dangling="drop"``)."""
    t = tables(spark, texts=read_texts(spark, path)) if packed else tables(spark, path)
    nodes = None
    for kind, rows in t.items():
        part = rows.select("handle", F.lit(kind).alias("kind"), "public_id", F.lit(False).alias("is_inferred"))
        nodes = part if nodes is None else nodes.unionByName(part)
    edges = edges_of(t)
    if dangling == "drop":
        return Graph(nodes, edges.join(nodes.select(F.col("handle").alias("target")).distinct(), "target", "left_semi"), t)
    if dangling != "placeholder":
        raise ValueError(f"dangling is placeholder or drop, not {dangling}")
    kind_of = F.create_map(*(F.lit(x) for kv in EDGES.items() for x in kv))
    loose = edges.join(nodes.select(F.col("handle").alias("target")), "target", "left_anti").groupBy(F.col("target").alias("handle")).agg(F.min(kind_of[F.col("edge_type")]).alias("kind"))
    return Graph(nodes.unionByName(loose.select("handle", "kind", F.lit(None).cast("string").alias("public_id"), F.lit(True).alias("is_inferred"))), edges, t)


# --------------------------------------------------------------------------- writing


def _attr(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), escape_xml(c.cast("string")), F.lit('"'))).otherwise("")


def _element(name: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{name}>"), escape_xml(c.cast("string")), F.lit(f"</{name}>"))).otherwise("")


def _each(c: str, make) -> Column:
    return F.coalesce(F.array_join(F.transform(c, make), ""), F.lit(""))


def _refs(name: str, c: str) -> Column:
    return _each(c, lambda h: F.concat(F.lit(f'<{name} hlink="'), escape_xml(h), F.lit('"/>')))


def _date(c: Column) -> Column:
    day = F.when(c["month"].isNull(), F.format_string("%04d", c["year"])).when(c["day"].isNull(), F.format_string("%04d-%02d", c["year"], c["month"])).otherwise(F.format_string("%04d-%02d-%02d", c["year"], c["month"], c["day"]))
    more = F.concat(_attr("quality", F.when(c["quality"] != "Exact", F.lower(c["quality"]))), _attr("type", F.when(c["modifier"] != "None", F.lower(c["modifier"]))))
    return F.when(c.isNotNull(), F.concat(F.lit('<dateval val="'), day, F.lit('"'), more, F.lit("/>"))).otherwise("")


def element(kind: str) -> Column:
    """A row of a kind's typed table as one line of XML."""
    c = F.col
    gender = F.when(c("gender") == 0, "M").when(c("gender") == 1, "F").otherwise("U") if kind == "Person" else None
    refs = lambda extra: _each("event_ref_list", lambda r: F.concat(F.lit("<eventref"), _attr("hlink", r["ref"]), _attr("role", r["role"]), F.lit("/>"))) if extra else F.lit("")
    attrs = lambda: _each("attribute_list", lambda a: F.concat(F.lit("<attribute"), _attr("type", a["type"]), _attr("value", a["value"]), F.lit("/>")))
    address = lambda: _each("address_list", lambda a: F.concat(F.lit("<address>"), *(_element(f, a[f]) for f in ("street", "locality", "city", "county", "state", "country", "postal", "phone")), F.lit("</address>")))
    urls = lambda: _each("url_list", lambda u: F.concat(F.lit("<url"), _attr("href", u["path"]), _attr("type", u["type"]), _attr("description", u["desc"]), F.lit("/>")))
    surnames = lambda v, only: F.when(F.size(v) > 0, F.array_join(F.transform(v, lambda s: F.concat(F.lit("<surname"), _attr("prefix", s["prefix"]), _attr("prim", F.when(s["primary"], "1")), _attr("origintype", s["origintype"]), F.lit(">"), escape_xml(F.coalesce(s["surname"], F.lit(""))), F.lit("</surname>"))), "")).otherwise(_element("surname", only))
    day = lambda tag: F.when(c(f"{tag}_date").isNotNull(), F.concat(F.lit(f"<{tag}><dateval"), _attr("val", c(f"{tag}_date")), F.lit(f"/></{tag}>"))).otherwise("")
    body = {
        "Person": lambda: [_element("gender", gender), F.lit("<name"), _attr("type", c("name_type")), F.lit(">"), _element("first", c("given_name")), surnames(c("surname_list"), c("surname")), _element("suffix", c("suffix")), _element("title", c("title")), F.lit("</name>"), _each("alternate_names", lambda n: F.concat(F.lit("<name"), _attr("type", n["type"]), F.lit(">"), _element("first", n["first_name"]), surnames(n["surname_list"], n["surname"]), _element("suffix", n["suffix"]), _element("title", n["title"]), F.lit("</name>"))), day("birth"), day("death"), refs(True), _each("lds_ord_list", lambda o: F.concat(F.lit("<lds_ord"), _attr("type", o["type"]), _attr("status", o["status"]), _attr("temple", o["temple"]), F.lit("/>"))), _each("person_ref_list", lambda r: F.concat(F.lit("<personref"), _attr("hlink", r["ref"]), _attr("rel", r["relation"]), F.lit("/>"))), attrs(), address(), urls()],
        "Family": lambda: [*(F.when(c(f"{p}_handle").isNotNull(), F.concat(F.lit(f"<{p}"), _attr("hlink", c(f"{p}_handle")), F.lit("/>"))).otherwise("") for p in ("father", "mother")), _each("child_ref_list", lambda r: F.concat(F.lit("<childref"), _attr("hlink", r["ref"]), _attr("rel", r["relation"]), F.lit("/>"))), refs(True), attrs()],
        "Event": lambda: [F.when(c("event_type").isNotNull(), F.concat(F.lit("<eventtype>"), _element("type", c("event_type")), F.lit("</eventtype>"))).otherwise(""), _date(c("date")), F.when(c("place_handle").isNotNull(), F.concat(F.lit("<place"), _attr("hlink", c("place_handle")), F.lit("/>"))).otherwise(""), _element("description", c("description")), attrs()],
        "Place": lambda: [*(_element(f, c(f)) for f in ("street", "city", "county", "state", "country")), _element("ptitle", c("title")), *(_element(f, c(f)) for f in ("code", "lat", "long")), _each("alt_names", lambda n: F.concat(F.lit("<pname"), _attr("value", n), F.lit("/>"))), _each("place_ref_list", lambda r: F.concat(F.lit("<placeref"), _attr("hlink", r["ref"]), F.lit("/>"))), attrs()],
        "Source": lambda: [*(_element(f, c(f)) for f in ("title", "author", "pubinfo", "abbrev")), _each("reporef_list", lambda r: F.concat(F.lit("<reporef"), _attr("hlink", r["ref"]), _attr("callnumber", r["call_number"]), _attr("mediatype", r["media_type"]), F.lit("/>"))), attrs()],
        "Citation": lambda: [_element("page", c("page")), _element("confidence", c("confidence")), F.when(c("source_handle").isNotNull(), F.concat(F.lit("<sourceref"), _attr("hlink", c("source_handle")), F.lit("/>"))).otherwise("")],
        "Repository": lambda: [_element("name", c("name")), _element("type", c("type")), address(), urls()],
        "Media": lambda: [F.lit("<file"), _attr("src", c("path")), _attr("mime", c("mime_type")), F.lit("/>"), _element("description", c("desc")), _element("checksum", c("checksum")), attrs()],
        "Note": lambda: [_element("text", c("text")), _element("format", c("format")), _element("type", c("type"))],
        "Tag": lambda: [_element("name", c("name")), _element("color", c("color")), _element("priority", c("priority"))],
    }
    tag = SECTIONS[kind][1]
    lists = [_refs("noteref", "note_list"), _refs("tagref", "tag_list"), _refs("citationref", "citation_list"), _refs("mediaref", "media_list")]
    return F.concat(F.lit(f"    <{tag}"), _attr("handle", c("handle")), _attr("id", c("public_id")), F.lit(">"), *body[kind](), *lists, F.lit(f"</{tag}>"))


def _head(namespace: str, version: str, created: str, note: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<database xmlns="{namespace}">\n  <header>\n    <created date="{created}" version="{version}"/>\n    <researcher>\n      <resname>{note}</resname>\n    </researcher>\n  </header>'


_NOTE, _END = "Generated by heartwood", "</database>"


def lines(t: dict[str, DataFrame], namespace: str, version: str, created: str, note: str = _NOTE) -> DataFrame:
    """(section, handle, line) of the whole file, to be written in that order."""
    spark = next(iter(t.values())).sparkSession
    fixed = [(-1, "", _head(namespace, version, created, note)), (99, "", _END)]
    out = spark.createDataFrame(fixed, "section int, handle string, line string")
    for i, (kind, (section, _)) in enumerate(SECTIONS.items()):
        if kind not in t:
            continue
        rows = t[kind].select(F.lit(3 * i + 1).alias("section"), "handle", element(kind).alias("line"))
        some = rows.limit(1)  # an empty section is left out
        out = out.unionByName(rows)
        for at, text in ((3 * i, f"  <{section}>"), (3 * i + 2, f"  </{section}>")):
            out = out.unionByName(some.select(F.lit(at).alias("section"), F.lit("").alias("handle"), F.lit(text).alias("line")))
    return out


def write(t: dict[str, DataFrame], path: str, namespace: str, version: str, created: str, files: int | None = None) -> None:
    """Part files, each a whole document, as Spark's reader leaves out without a word what
    follows the first element of a piece of one. In the order of their names they have the
    file's elements in its order; ``files=1`` writes it in one."""
    head = _head(namespace, version, created, _NOTE)
    names = [section for section, _ in SECTIONS.values()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a part, with the file's ends and the section's tags where it is cut."""
        inside: int | None = None  # the section that is open
        begun = ended = False
        for b in batches:
            out = []
            for at, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not begun and at != -1:
                    out.append(head)
                begun, ended = True, at == 99
                if 0 <= at < 99:
                    if inside is None and at % 3:
                        out.append(f"  <{names[at // 3]}>")
                    inside = None if at % 3 == 2 else at // 3
                out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if begun and not ended:
            yield pa.RecordBatch.from_arrays([pa.array([*([f"  </{names[inside]}>"] if inside is not None else []), _END], pa.string())], ["value"])

    out = lines(t, namespace, version, created).orderBy("section", "handle").select("section", "line")
    (out if files is None else out.coalesce(files)).mapInArrow(whole, "value string").write.mode("overwrite").text(path)


# -------------------------------------------------------------------------- cleaning


_PART = r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|<![^>]*>|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>"
_HANDLE = r"\shandle\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"


def clean(spark: SparkSession, path: str, out: str, tag: str, handles: DataFrame) -> tuple[int, int]:
    """Writes the files at path without the elements ``tag`` whose handle is in
    handles(handle), leading underscores aside; (elements removed, handles not found).

    A file, gzip or plain, is one row, as any reader of one document must take it; files
    are read side by side, and what they are searched for is joined to them, not sent to
    the driver. A removed element goes with all that it holds; text outside stays as it is.
    Files are written plain, one text a row; handles that no element has change nothing.
    """
    texts = read_texts(spark, path)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The outermost elements: where they begin and end, and their handles."""
        part, handle, name = re.compile(_PART), re.compile(_HANDLE), re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])")
        for b in batches:
            rows: list[tuple] = []
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                depth, start, own = 0, 0, None
                for m in part.finditer(text):
                    x = m.group()
                    if not (n := name.match(x)):
                        continue
                    if n.group(1):
                        depth -= 1
                    else:
                        if not depth:
                            h = handle.search(x)
                            start, own = m.start(), h and (h.group(1) or h.group(2))
                        depth += not x.endswith("/>")
                    if not depth and own is not None:
                        rows.append((p, start, m.end(), own))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "a", "e", "handle"])

    want = handles.select(normalize_handle(F.col("handle")).alias("h")).distinct()
    scratch = Scratch(spark, "clean")
    found = scratch.save(texts.mapInArrow(spans, "path string, a long, e long, handle string").withColumn("h", normalize_handle(F.col("handle"))).join(want, "h", "left_semi"))
    cut = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("a", "e"))).alias("cut"))  # at most a file's elements

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for text, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, keep = 0, []
                for x in gone or []:
                    keep.append(text[at : x["a"]])
                    at = x["e"]
                left.append("".join([*keep, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string())], ["value"])

    texts.join(cut, "path", "left").select("content", "cut").mapInArrow(without, "value string").write.mode("overwrite").text(out)
    return found.count(), want.join(found.select("h"), "h", "left_anti").count()
