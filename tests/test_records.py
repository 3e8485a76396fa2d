"""Comparison, matching, integration, files and streams."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from heartwood.functions import dates
from heartwood.operators import compare, describe, integrate, match
from heartwood.sources import files, xml
from heartwood.streaming import incremental


def changes(spark, column, row, schema):
    out = spark.createDataFrame([row], schema).select(column.alias("c")).first().c
    return [(c.field_kind, c.field_name, c.old_value, c.new_value, round(c.similarity, 6)) for c in out]


def test_field_rules(spark):
    a, b = F.col("a"), F.col("b")
    two = "a string, b string"
    assert changes(spark, compare.compare_text("f", a, b), ("Ada  B", "ada b"), two) == []
    assert changes(spark, compare.compare_text("f", a, b), ("ab cd", "ab ce"), two) == [("Text", "f", "ab cd", "ab ce", 0.75)]
    assert changes(spark, compare.compare_text("f", a, b), (None, "x"), two) == [("Text", "f", None, "x", 0.0)]
    assert changes(spark, compare.compare_handle("f", a, b), ("x", "y"), two) == [("HandleRef", "f", "x", "y", 0.0)]
    assert changes(spark, compare.compare_value("Enum", "f", a, b), ("x", "x"), two) == []
    lists = "a array<string>, b array<string>"
    assert changes(spark, compare.compare_handles("f", a, b), (["y", "x"], ["x", "y"]), lists) == []
    assert changes(spark, compare.compare_handles("f", a, b), (["y", "x"], ["x", "z"]), lists) == [("HandleRefList", "f", "[y, x]", "[x, z]", 0.333333)]
    assert changes(spark, compare.compare_handles("f", a, b), (["x", "x"], ["x"]), lists) == [("HandleRefList", "f", "[x, x]", "[x]", 1.0)]
    refs = "a array<struct<ref:string,role:string>>, b array<struct<ref:string,role:string>>"
    meta = lambda p, q: compare.compare_value("Enum", "role", p["role"], q["role"])
    assert changes(spark, compare.compare_refs("f", a, b, meta), ([("y", "1"), ("x", "2")], [("x", "2"), ("y", "3")]), refs) == [("Enum", "role", "1", "3", 0.0)]
    assert changes(spark, compare.compare_refs("f", a, b, meta), ([("y", "1")], [("x", "2")]), refs) == [("HandleRefList", "f", "[y]", "[x]", 0.0)]
    nested = "a array<struct<type:string,value:string>>, b array<struct<type:string,value:string>>"
    item = lambda path, p, q: compare.compare_struct(path, p, q, ["type", "value"])
    assert changes(spark, compare.compare_list("f", a, b, item), ([("t", "v")], [("t", "w"), ("u", "x")]), nested) == [("Text", "f[0].value", "v", "w", 0.0), ("Text", "f[1]", None, '{"type":"u","value":"x"}', 0.0)]
    assert changes(spark, compare.compare_list("f", a, b, item), (None, []), nested) == []
    d = lambda c: dates.date_value(F.col(c))
    assert changes(spark, compare.compare_date("f", d("a"), d("b")), (1850, 1851), "a int, b int") == [("Date", "f", "1850", "1851", 0.75)]


def test_nested_fields(spark):
    """Names with surnames, addresses with a place of their own, references with a role."""
    surname = "struct<surname:string,prefix:string,primary:boolean,origintype:string>"
    name = f"struct<first_name:string,suffix:string,type:string,surname_list:array<{surname}>>"
    address = "struct<date:struct<year:int,month:int,day:int,quality:string,modifier:string,text:string>,location:struct<street:string,city:string>,note_list:array<string>>"
    schema = f"struct<alternate_names:array<{name}>,address_list:array<{address}>,event_ref_list:array<struct<ref:string,role:string>>,suffix:string>"
    a = ([("Ada", "I", "Birth", [("Lace", None, True, "Given")]), ("B", None, None, [])], [(None, ("Elm", "Ford"), ["n"]), (None, None, [])], [("e", "Primary")], "x")
    b = ([("Ada", "II", "Married", [("Lace", "von", False, "Given"), ("L", None, None, None)])], [(None, ("Oak", "Ford"), []), (None, ("Elm", None), [])], [("e", "Witness")], "x")
    df = spark.createDataFrame([(a, b)], f"a {schema}, b {schema}")
    got = df.select(compare.compare_fields(compare.FIELDS["Person"], kind=df.schema["a"].dataType).alias("c")).first().c
    assert [(c.field_kind, c.field_name, c.old_value, c.new_value) for c in got] == [
        ("Text", "alternate_names[0].suffix", "I", "II"), ("Enum", "alternate_names[0].type", "Birth", "Married"), ("Text", "alternate_names[0].surname_list[0].prefix", None, "von"),
        ("Boolean", "alternate_names[0].surname_list[0].primary", "true", "false"), ("Text", "alternate_names[0].surname_list[1]", None, '{"surname":"L"}'),
        ("Text", "alternate_names[1]", '{"first_name":"B","surname_list":[]}', None), ("Enum", "event_ref_list.role", "Primary", "Witness"),
        ("Text", "address_list[0].location.street", "Elm", "Oak"), ("HandleRefList", "address_list[0].note_list", "[n]", "[]"), ("Text", "address_list[1].location", None, '{"street":"Elm"}'),
    ]


def rows(spark, data):
    return spark.createDataFrame(data, "kind string, handle string, strong_key string")


def test_matching(spark):
    a = rows(spark, [("P", "1", "x"), ("P", "2", "k"), ("P", "3", "dup"), ("P", "4", "dup"), ("P", "5", None), ("P", "6", "gone")])
    b = rows(spark, [("P", "1", "y"), ("P", "8", "k"), ("P", "9", "k"), ("P", "7", "dup"), ("P", "10", None)])
    m = match.match(a, b)
    assert sorted(map(tuple, m.pairs.collect())) == [("P", "1", "1", 1.0), ("P", "2", "8", 0.9)]
    assert sorted(r.handle for r in m.removed.collect()) == ["5", "6"]
    assert sorted(r.handle for r in m.added.collect()) == ["10", "9"]
    assert [tuple(r) for r in m.ambiguous.collect()] == [("P", "dup", "7", ["3", "4"])]
    settled = spark.createDataFrame([("4", "7", 0.8)], "handle_a string, handle_b string, confidence double")
    assert match.apply_resolutions(m, settled).count() == 3
    assert match.duplicate_keys(a).count() == 2


def test_extrinsic(spark):
    pairs = spark.createDataFrame([("P", "a1", "b1"), ("P", "a2", "b2"), ("F", "f", "f")], "kind string, handle_a string, handle_b string")
    item = lambda key, *c: ("Modified", "F", key, key, 1.0, [("HandleRefList" if o[0] == "[" else "HandleRef", "x", o, n, 0.0) for o, n in c])
    items = spark.createDataFrame([item("1", ("a1", "b1")), item("2", ("a1", "b2")), item("3", ("[a1, a2]", "[b2, b1]"), ("a1", "b1")), item("4", ("[a1]", "[b1, b2]")), item("5", ("[a1, a2]", "[b1, zz]"))], f"classification string, kind string, handle_a string, handle_b string, confidence double, field_changes {compare.CHANGE}")
    got = {r.handle_a: r.classification for r in match.resolve_extrinsic(items, pairs).collect()}
    assert got == {"1": "ExtrinsicOnly", "2": "Modified", "3": "ExtrinsicOnly", "4": "Modified", "5": "Modified"}
    assert match.visible(match.resolve_extrinsic(items, pairs)).count() == 3


def report(spark, data):
    full = [(c, "Person", a, None, None, b, None, None, 1.0, "", "", "", "", 0.0) for c, a, b in data] + [("Same", "Event", "e", None, None, "e", None, None, 1.0, "", "", "", "", 0.0)]
    return spark.createDataFrame(full, files.REPORT_SCHEMA)


def test_integration(spark):
    sel = spark.createDataFrame([(0, "a", "Old", None, None, "male", 1), (1, "a", "New", None, None, "male", 1), (2, "b", "Bea", None, None, "female", 2), (3, "z", "Zed", None, None, "male", 3), (4, "z", "Zed", None, None, "male", 3)], "pos int, handle string, name string, birth_date string, death_date string, gender string, family_group long")
    out = integrate.integrate(report(spark, [("Same", "a", "b"), ("Added", None, "b"), ("Removed", "q", None)]), sel)
    got = sorted((r.classification, r.side, r.row_kind, r.viz_name or "") for r in out.collect())
    assert got == [("", "", "viz_only", "Zed"), ("", "", "viz_only", "Zed"), ("Added", "b", "matched", "Bea"), ("Removed", "", "diff_only", ""), ("Same", "a", "matched", "New")]
    assert tuple(integrate.totals(out).first()) == (5, 2)
    whole = json.loads(files.merged_json(out, "d.csv", "s.json").first().value)
    assert whole["matched_count"] == 2 and sum("selection" in m for m in whole["matches"]) == 4


def test_report_round_trip(spark, tmp_path):
    """Several files, odd cells, unaided; then columns in another order and one too few."""
    odd = report(spark, [("Modified", 'h"1', "b,c")]).withColumn("old_value", F.lit(' say "hi",\nthere ')).withColumn("field_name", F.lit("name")).withColumn("similarity", F.lit(0.25))
    many = odd.unionByName(report(spark, [("Added", None, f"h{i}") for i in range(40)]).filter("item_type = 'Person'")).repartition(4)
    files.write_report(many, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 4
    back = files.read_report(spark, str(tmp_path / "r"))
    got = {r.handle_b: r for r in back.collect()}
    assert back.columns == files.REPORT and len(got) == 42 and back.count() == 42
    r = got["b,c"]
    assert (r.classification, r.handle_a, r.old_value, r.similarity, r.confidence) == ("MODIFIED", 'h"1', ' say "hi", there ', 0.25, 1.0)
    assert got["h7"].similarity == 0 and got["h7"].classification == "ADDED"
    names = ["x" if c == "display_name_a" else c for c in reversed(files.REPORT)]
    (tmp_path / "turned.csv").write_text(",".join(n.replace("id_a", "own_id_a") for n in names if n != "x") + ",display_name_a,more\n" + ",".join("0.5" if n in ("confidence", "similarity") else n for n in names if n != "x") + ',"two\nlines",z\n')
    (r,) = files.read_report(spark, str(tmp_path / "turned.csv")).collect()
    assert (r.handle_a, r.id_a, r.display_name_a, r.similarity) == ("handle_a", "id_a", "two\nlines", 0.5)
    (tmp_path / "short.csv").write_text("classification,item_type\na,b\n")
    with pytest.raises(ValueError):
        files.read_report(spark, str(tmp_path / "short.csv"))


def test_report_rows_and_json(spark, tmp_path):
    one = ("Modified", "Person", "a", "b", 1.0, [("Text", "name", "x", None, 0.5), ("Enum", "sex", "1", "2", 0.0)])
    data = [one, ("Same", "Event", "e", "e", 1.0, []), ("ExtrinsicOnly", "Event", "f", "f", 1.0, []), ("Added", "Event", None, "g", 1.0, None)]
    items = spark.createDataFrame(data, f"classification string, kind string, handle_a string, handle_b string, confidence double, field_changes {compare.CHANGE}").repartition(3)
    got = files.report_rows(items)
    assert got.columns == files.REPORT and sorted((r.item_type, r.field_name, r.similarity) for r in got.collect()) == [("Event", "", 0.0), ("Event", "", 0.0), ("Person", "name", 0.5), ("Person", "sex", 0.0)]
    assert files.report_rows(items, extrinsic=True).count() == 5
    for rows in (items, items.filter("false")):
        files.write_report_json(rows, str(tmp_path / "j"))
        whole = json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))))
        assert [(x["kind"], x["handle_b"]) for x in whole["items"]] == ([("Event", "g"), ("Event", "e"), ("Event", "f"), ("Person", "b")] if rows is items else [])


def test_selections_and_manifests(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"exported_at": "now", "file": "f", "selections": [{"handle": "a", "name": "A", "gender": "male", "family_group": 1}]}))
    sel = files.read_selections(spark, str(tmp_path / "s.json"))
    assert sel.first().handle == "a"
    files.write_selections(sel, str(tmp_path / "out"), "now", "f")
    assert files.read_selections(spark, str(tmp_path / "out")).count() == 1
    turned = spark.createDataFrame([(1, "a", "A", None, None, "male", 1), (0, "b", "B", None, None, "male", 1)], "pos int, handle string, name string, birth_date string, death_date string, gender string, family_group long")
    files.write_selections(turned, str(tmp_path / "out"), "now", "f")
    assert [r.handle for r in files.read_selections(spark, str(tmp_path / "out")).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "bad.json").write_text(json.dumps({"selections": [{"handle": "a", "name": "A", "gender": "male"}]}))
    with pytest.raises(Exception, match="lacks a field"):
        files.read_selections(spark, str(tmp_path / "bad.json")).count()
    (tmp_path / "m1.json").write_text(json.dumps({"version": 1, "plan": {"people": {"to_delete": ["a"], "kept": ["b"]}}}))
    head, entries = files.read_manifest(spark, str(tmp_path / "m1.json"))
    assert head["version"] == 3 and {(r.handle, r.status) for r in entries.collect()} == {("a", "pending"), ("b", "kept")}
    (tmp_path / "m9.json").write_text('{"version": 9}')
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m9.json"))
    from heartwood.operators import cascade

    files.write_manifest(cascade.manifest(entries, "f", None, spark.createDataFrame([("a",)], "handle string"), F.lit("now")), str(tmp_path / "m3"))
    head, again = files.read_manifest(spark, str(tmp_path / "m3"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, entries.collect()))


DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<database xmlns="urn:example:graph/1.7.2/">
  <header><created date="2024-01-01" version="5.2.1"/></header>
  <tags><tag handle="_t1" id="T1"><name>red</name><color>#f00</color><priority>2</priority></tag></tags>
  <events>
    <event handle="_e1" id="E1"><eventtype><type>Birth</type></eventtype><dateval val="1850-07" quality="estimated" type="about"/><place hlink="_nowhere"/></event>
    <event handle="_e2"><type>military service</type></event>
  </events>
  <people><person handle="_p1" id="I1"><gender>F</gender><name type="Birth"><first>Ada &amp; Bo</first><surname prefix="von">Lace</surname><surname prim="1" origintype="Taken">Brown</surname><suffix>Jr</suffix></name><name type="Married"><first>A.</first><surname>L.</surname></name>
    <birth><dateval val="1850-07-01"/></birth><death><dateval val="1900"/></death><lds_ord type="Baptism" status="Done" temple="SLC"/>
    <eventref hlink="_e1" role="Primary"/><eventref hlink="_e2"><role>Witness</role></eventref><noteref hlink="_n1"/></person></people>
  <families><family handle="_f1"><father hlink="_p9"/><mother hlink="_p1"/><childref hlink="_p2" rel="Adopted"/></family></families>
  <citations><citation handle="_c1"><page>5</page><confidence>2</confidence><sourceref hlink="_s1"/></citation></citations>
  <sources><source handle="_s1"><stitle>Register</stitle><reporef hlink="_r1" callnumber="7" medium="Book"/></source></sources>
  <places><placeobj handle="_l1"><ptitle>Town hall</ptitle><code>7</code><lat>1.5</lat><long>2.5</long><pname value="Hall"/></placeobj><place handle="_l2"><name value="Ford"/></place></places>
  <objects><object handle="_m1"><file src="a.png" mime="image/png"/></object></objects>
  <repositories><repository handle="_r1"><rname>Archive</rname><type>Court House</type></repository></repositories>
  <notes><note handle="_n1" type="Research"><text>hello</text></note></notes>
</database>
"""


@pytest.mark.parametrize("packed", [False, True])
def test_xml(spark, tmp_path, packed):
    path = tmp_path / ("g.graph" if packed else "g.xml")
    path.write_bytes(gzip.compress(DOCUMENT.encode()) if packed else DOCUMENT.encode())
    g = xml.load(spark, str(path), packed=packed)
    t = g.tables
    p = t["Person"].first()
    assert (p.handle, p.gender, p.given_name, p.surname, p.birth_date, [(r.ref, r.role) for r in p.event_ref_list]) == ("_p1", 1, "Ada & Bo", "Brown", "1850-07-01", [("_e1", "Primary"), ("_e2", "Witness")])
    e = {r.handle: r for r in t["Event"].collect()}
    assert e["_e1"].date.year == 1850 and e["_e1"].date.modifier == "About" and e["_e2"].event_type == "Military Service"
    assert t["Source"].first().title == "Register" and t["Repository"].first().name == "Archive" and t["Repository"].first().type == "Court House"
    assert {r.handle for r in t["Place"].collect()} == {"_l1", "_l2"} and t["Media"].first().path == "a.png" and t["Family"].first().child_ref_list[0].relation == "Adopted"
    inferred = {(r.handle, r.kind) for r in g.nodes.filter("is_inferred").collect()}
    assert inferred == {("_nowhere", "Place"), ("_p9", "Person"), ("_p2", "Person")}
    assert xml.load(spark, str(path), packed=packed, dangling="drop").edges.count() == g.edges.count() - 3
    texts = xml.read_texts(spark, str(path))
    assert [tuple(r) for r in (xml.viewer_names(spark, texts=texts) if packed else xml.viewer_names(spark, str(path))).collect()] == [("_p1", "A.", "L.")]
    assert xml.read_version(texts).first().version == "5.2" and xml.unsupported_versions(texts).count() == 0


def test_xml_round_trip(spark, tmp_path):
    (tmp_path / "g.xml").write_text(DOCUMENT)
    t = xml.tables(spark, str(tmp_path / "g.xml"))
    xml.write(t, str(tmp_path / "out"), "urn:example:graph/1.7.2/", "5.2", "2024-01-01", files=1)
    again = xml.tables(spark, str(tmp_path / "out"))
    for kind in t:
        cols = [c for c in t[kind].columns if c not in ("name_type",)]
        same = lambda df: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True).replace("null", "[]") for r in df.select(cols).collect())
        assert same(t[kind]) == same(again[kind]), kind


def test_xml_in_many_parts(spark, tmp_path):
    """Wherever a file is cut, each part is a document and every element is read again."""
    from xml.etree import ElementTree

    (tmp_path / "g.xml").write_text(DOCUMENT)
    t = xml.tables(spark, str(tmp_path / "g.xml"))
    many = spark.range(300).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("handle"))
    t["Note"] = t["Note"].join(many, F.lit(True)).select(many["handle"], *t["Note"].columns[1:])
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", 12)
        xml.write(t, str(tmp_path / "many"), "urn:example:graph/1.7.2/", "5.2", "2024-01-01")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    xml.write(t, str(tmp_path / "one"), "urn:example:graph/1.7.2/", "5.2", "2024-01-01", files=1)
    handles = lambda t: sorted((k, r.handle) for k in ("Tag", "Person", "Place", "Note") for r in t[k].select("handle").collect())
    assert handles(xml.tables(spark, str(tmp_path / "many"))) == handles(t)

    def elements(name):
        parts = [ElementTree.parse(p).getroot() for p in sorted((tmp_path / name).glob("part-*")) if p.stat().st_size]
        assert all(r[0].tag.endswith("header") for r in parts)
        return len(parts), [(s.tag, ElementTree.tostring(x).strip()) for r in parts for s in r[1:] for x in s]

    (n, one), (several, cut) = elements("one"), elements("many")
    assert n == 1 and several > 4 and one == cut


@pytest.mark.parametrize("packed", [False, True])
def test_cleaning_files(spark, tmp_path, packed):
    (tmp_path / "in").mkdir()
    raw = DOCUMENT.replace("<notes>", "<notes><!-- <event handle='_e1'/> --><note handle='n2' x='a>b'/>")
    (tmp_path / "in" / "g").write_bytes(gzip.compress(raw.encode()) if packed else raw.encode())
    gone = spark.createDataFrame([("e1",), ("__e2",), ("_none",)], "handle string")
    assert xml.clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), "event", gone) == (2, 1)
    left = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert left.strip() == re.sub(r"(?s)<event handle=\"_e1\".*?</event>|<event handle=\"_e2\">.*?</event>", "", raw).strip()
    assert xml.clean(spark, str(tmp_path / "in"), str(tmp_path / "out"), "note", spark.createDataFrame([("_n1",), ("n2",)], "handle string")) == (2, 0)


def test_descriptions(spark):
    who = spark.createDataFrame([("a", "I1", "Ada", "Lace", "1850", None), ("b", None, None, None, "1", "2")], "handle string, public_id string, given_name string, surname string, birth_date string, death_date string")
    assert [r.description for r in describe.describe_persons(who).collect()] == ["Ada Lace (b. 1850)", "Unknown (1-2)"]
    fam = spark.createDataFrame([("f", None, "a", None, ["x", "y", "z"]), ("g", None, None, None, [])], "handle string, public_id string, father_handle string, mother_handle string, child_handles array<string>")
    names = spark.createDataFrame([(k, k.upper()) for k in "axyz"], "handle string, name string")
    assert {r.description for r in describe.describe_families(fam, names).collect()} == {"Family: A | children: X, Y (+1 more)", "Family (g)"}
    note = spark.createDataFrame([("n", None, "word " * 50)], "handle string, public_id string, text string")
    assert describe.describe_notes(note).first().description.endswith("word...")
    cite = spark.createDataFrame([("c", None, "s", "5")], "handle string, public_id string, source_handle string, page string")
    src = spark.createDataFrame([("s", "S1", None, "Bo", None)], "handle string, public_id string, title string, author string, pubinfo string")
    assert describe.describe_citations(cite, src).first().description == 'Citation → s [S1] "Source by Bo", p. 5'


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:00:01", "a", "Person"), ("2024-01-01 00:00:02", "a", "Person"), ("2024-01-01 00:10:00", "b", "Tag")], "t string, handle string, kind string").selectExpr("to_timestamp(t) as ts", "handle", "kind").write.parquet(src)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = spark.readStream.schema("ts timestamp, handle string, kind string").parquet(src)
    assert sorted(map(tuple, run(incremental.counts_by_kind(stream), "complete", "kinds").collect())) == [("Person", 2), ("Tag", 1)]
    assert run(incremental.first_seen(stream, "ts", "5 minutes"), "append", "firsts").count() == 2
    assert run(incremental.windowed_counts(stream, "ts", "1 minute", "1 minute", "kind"), "update", "windows").count() == 2
