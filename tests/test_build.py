"""Builders, schema documents and scenario files."""

import json

import pytest

from heartwood.operators import build, generate, graph, views
from heartwood.sources import schemas


def test_builder(spark):
    b = build.Builder().node("Person", "a").node("Person", "b").node("Person").family("a", "b", ("_person0003",), "f").event("a", handle="e")
    g = b.build(spark)
    assert sorted((r.handle, r.kind) for r in g.nodes.collect()) == [("_person0003", "Person"), ("a", "Person"), ("b", "Person"), ("e", "Event"), ("f", "Family")]
    assert [(r.edge_type, r.source, r.target) for r in g.edges.orderBy("edge_id").collect()][-1] == ("PersonEventRef", "a", "e")
    assert graph.edges_from(g.edges, spark.createDataFrame([("f",)], "handle string")).count() == 3
    loose = build.Builder().node("Event", "e").edge("EventPlace", "e", "p")
    with pytest.raises(ValueError):
        loose.build(spark)
    assert [(r.handle, r.kind) for r in loose.build(spark, dangling="placeholder").nodes.filter("is_inferred").collect()] == [("p", "Place")]
    for wrong in (lambda: b.node("Person", "a"), lambda: b.node("Thing"), lambda: b.edge("Nothing", "a", "b"), lambda: b.edge("FamilyFather", "f", "a", color="red")):
        with pytest.raises(ValueError):
            wrong()


def test_schemas(spark, tmp_path):
    (tmp_path / "schema-5.2.json").write_text("{}")
    (tmp_path / "schema-9.9.json").write_text("{}")
    got = {r.version: r.local for r in schemas.list_schemas(spark, str(tmp_path)).collect()}
    assert got == {"5.0": False, "5.1": False, "5.2": True, "6.0": False, "9.9": True}
    assert schemas.list_schemas(spark, str(tmp_path / "none")).filter("local").count() == 0
    people = spark.createDataFrame([("a", 1, [("e", "Primary")], ["n"], "Birth"), ("b", 0, [], [], "Odd")], "handle string, gender int, event_ref_list array<struct<ref:string,role:string>>, note_list array<string>, name_type string")
    doc = schemas.extract_schema({"Person": people}, "5.2")
    person = doc["kinds"]["Person"]
    assert person["fields"]["event_ref_list"] == {"type": "array", "items": "struct", "fields": {"ref": {"type": "handle"}, "role": {"type": "string"}}}
    assert person["fields"]["note_list"] == {"type": "array", "items": "handle"} and person["required"] == ["handle", "gender"]
    assert person["edges"]["PersonEventRef"] == "Event" and views.schema_errors(doc) == [] and json.loads(json.dumps(doc)) == doc
    assert [tuple(r) for r in schemas.unknown_enum_values({"Person": people}, {"Person": {"name_type": "NameType"}}).collect()] == [("Person", "name_type", "Odd", 1)]


def test_scenario_files(tmp_path):
    (tmp_path / "s.yaml").write_text("""# a scenario
person_count: 30
family_ratio: 0.4   # of people
seed: 7
with_places: true
generations:
  depth: 4
  children_per_family: {min: 2, max: 5}
date_range:
  start: 1800
  end: 1900
  era: "common"
adversarial:
  enabled: true
  strategies:
    - solo
    - 'many-names'
densify:
  enabled: false
""")
    s = generate.read_scenario(str(tmp_path / "s.yaml"))
    assert s.config == generate.Config(persons=30, family_ratio=0.4, seed=7, places=True, generations=4, children=(2, 5), years=(1800, 1900), solo=0.2, many_names=0.3)
    assert s.strategies == ("solo", "many-names") and s.target_connectivity is None
    (tmp_path / "s.json").write_text('{"person_count": 5, "densify": {"enabled": true, "target_connectivity": 0.5}}')
    assert generate.read_scenario(str(tmp_path / "s.json")).target_connectivity == 0.5
    (tmp_path / "bad.yaml").write_text("person_count 5\n")
    with pytest.raises(ValueError):
        generate.read_scenario(str(tmp_path / "bad.yaml"))
