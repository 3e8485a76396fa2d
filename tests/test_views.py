"""Filters, groups, payload checks and the printed statistics."""

from heartwood.scratch import Scratch
from heartwood.operators import stats, views


def test_filters_and_groups(spark):
    n = spark.createDataFrame([("a", 0, 1.0, 1.0), ("b", 1, 5.0, 2.0)], "handle string, family_group int, x double, y double")
    assert views.in_group(n, 1).first().handle == "b" and views.in_group(n, None).count() == 2
    assert [r.handle for r in views.in_rectangle(n, 6, 3, 4, 0).collect()] == ["b"]
    comp = spark.createDataFrame([("a", "a"), ("b", "a"), ("z", "z")], "handle string, component string")
    gen = spark.createDataFrame([("a", 0), ("b", 1), ("z", 0)], "handle string, generation int")
    assert sorted(map(tuple, views.family_groups(comp, gen, Scratch(spark, "views")).collect())) == [("a", 0, 2, 2), ("b", 0, 2, 2), ("z", 1, 1, 1)]


def test_checks(spark):
    n = spark.createDataFrame([("male",), ("m",), (None,)], "gender string")
    k = spark.createDataFrame([("a", "b", "Spouse"), ("a", None, "Friend")], "source string, target string, link_type string")
    assert sorted(map(tuple, views.payload_errors(n, k).collect())) == [("gender", "m"), ("link", "a"), ("link_type", "Friend")]
    assert views.schema_errors({}) == ["no kinds"]
    assert views.schema_errors({"kinds": {"Person": {"required": ["handle"], "fields": {"handle": {"type": "handle"}}}}}) == []
    assert len(views.schema_errors({"kinds": {"Pet": {"required": ["x"], "fields": {"a": {"type": "blob"}, "b": {"type": "enum", "of": "Nope"}}}}})) == 4


def test_stats_text(spark):
    nodes = spark.createDataFrame([("a", "Person")], "handle string, kind string")
    group = spark.createDataFrame([("a", 2, 1), ("b", 2, 3)], "component string, size int, span int")
    none = nodes.select("handle").filter("false")
    text = views.stats_text(stats.stats_report("f", nodes, spark.createDataFrame([(2,)], "size int"), group, none, none, ["odd"]))
    assert "people               1" in text and "     2 |     1     1     2" in text and text.endswith("warning: odd")
