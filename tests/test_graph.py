"""Graph operators on small graphs, and on random ones against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from heartwood.operators import cascade, generate, graph, impute, kinship, rank, stats, validate
from heartwood.scratch import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def handles(spark, names):
    return spark.createDataFrame([(n,) for n in names], "handle string")


def pairs(spark, rows, names="a string, b string"):
    return spark.createDataFrame(rows, names)


def result(df):
    return sorted(map(tuple, df.collect()))


def test_selection_of_nodes_and_edges(spark):
    nodes = spark.createDataFrame([("a", "Person"), ("b", "Tag")], "handle string, kind string")
    edges = spark.createDataFrame([("T", "a", "b"), ("T", "b", "b"), ("U", "b", "c")], "edge_type string, source string, target string")
    assert result(graph.nodes_by_kind(nodes, "Tag")) == [("b", "Tag")]
    assert graph.get_nodes(nodes, handles(spark, ["a", "x"])).count() == 1
    assert graph.edges_from(edges, handles(spark, ["b"])).count() == 2
    assert graph.edges_to(edges, handles(spark, ["b"])).count() == 2
    assert graph.edges_incident_to(edges, handles(spark, ["b"])).count() == 3
    assert graph.remove_edges(edges, F.col("edge_type") == "T").count() == 1
    assert result(graph.incident_counts(nodes, edges)) == [("a", 1), ("b", 4)]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, scratch, seed):
    rng = random.Random(seed)
    names = [f"n{i:03}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [(names[i], names[i + 1]) for i in range(20)]
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for p, q in edges:
        i, j = sorted((find(p), find(q)))
        root[j] = i
    assert result(graph.connected_components(handles(spark, names), pairs(spark, edges), scratch)) == sorted((n, find(n)) for n in names)


def test_generations(spark, scratch):
    edge = pairs(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")], "parent string, child string")
    got = dict(result(graph.generations(handles(spark, list("abcxyzsq")), edge, scratch)))
    assert got == {"a": 0, "b": 1, "c": 2, "x": 50, "y": 50, "z": 50, "s": 50, "q": 0}
    comp = pairs(spark, [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "x"), ("s", "s")], "handle string, component string")
    assert result(graph.cyclic_components(comp, edge, scratch)) == [("s",), ("x",)]
    assert graph.cyclic_components(comp, edge.filter("parent = 'a'"), scratch).count() == 0


def test_deep_generations_stop_at_the_cap(spark, scratch):
    edge = pairs(spark, [(f"p{i:02}", f"p{i + 1:02}") for i in range(8)], "parent string, child string")
    got = dict(result(graph.generations(handles(spark, [f"p{i:02}" for i in range(9)]), edge, scratch, cap=5)))
    assert got["p04"] == 4 and got["p08"] == 5


def links(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, link_type string")


def test_kinship(spark, scratch):
    k = links(spark, [("gp", "p", "ParentChild"), ("p", "c", "ParentChild"), ("p", "d", "ParentChild"), ("m", "c", "ParentChild"), ("p", "m", "Spouse")])
    assert result(kinship.ancestors(k, scratch, handles(spark, ["c"]))) == [("c", "gp"), ("c", "m"), ("c", "p")]
    assert result(kinship.descendants(k, scratch, handles(spark, ["gp"]))) == [("gp", "c"), ("gp", "d"), ("gp", "p")]
    assert result(kinship.siblings_of(k)) == [("c", "d"), ("d", "c")]
    assert result(kinship.first_degree(k, handles(spark, ["p"]))) == [("p", "c"), ("p", "d"), ("p", "gp"), ("p", "m")]
    assert result(kinship.second_degree(k, handles(spark, ["gp"]))) == [("gp", "c"), ("gp", "d"), ("gp", "m"), ("gp", "p")]
    assert kinship.select_related(k, "single", handles(spark, ["p"]), scratch).count() == 1
    loop = links(spark, [("a", "b", "ParentChild"), ("b", "a", "ParentChild")])
    assert result(kinship.ancestors(loop, scratch, handles(spark, ["a"]))) == [("a", "a"), ("a", "b")]


def test_selections(spark):
    h = lambda s: handles(spark, list(s))
    assert result(kinship.selection_toggle(h("ab"), h("bc"))) == [("a",), ("c",)]
    assert result(kinship.selection_invert(h("ab"), h("abc"))) == [("c",)]
    assert result(kinship.selection_click(h("ab"), h("b"), h("c"))) == [("a",)]
    assert result(kinship.selection_click(h("a"), h("b"), h("c"))) == [("a",), ("b",), ("c",)]
    assert result(kinship.selection_remove(kinship.selection_add(h("a"), h("ab")), h("a"))) == [("b",)]


def test_imputation(spark, scratch):
    def run(years, edges, gens, **more):
        n = spark.createDataFrame(list(years.items()), "handle string, year int")
        g = spark.createDataFrame(list(gens.items()), "handle string, generation int")
        return {r.handle: r.imputed_year for r in impute.impute_years(n, links(spark, [(*e, "ParentChild") for e in edges]), g, scratch, **more).collect()}

    two = {"a": 1880, "b": 1890, "c": None, "far": None}, [("a", "c"), ("b", "c")], {"a": 0, "b": 0, "c": 1}
    assert run(*two) == {"a": 1880, "b": 1890, "c": 1910, "far": None}
    assert run(*two, gap=0)["c"] == 1885 and run(*two, impute=False)["c"] is None
    chain = {"a": 1900, "b": None, "c": None, "d": 2000}, [("a", "b"), ("b", "c"), ("c", "d")], {"a": 0, "b": 1, "c": 2, "d": 3}
    assert run(*chain) == {"a": 1900, "b": 1925, "c": 1975, "d": 2000}
    relay = {"a": 1900, "b": 1950, "c": None}, [("a", "b"), ("b", "c")], {"a": 0, "b": 1, "c": 2}
    assert run(*relay)["c"] == 1975


def gone(spark, scratch, kinds, edges, seeds):
    n = spark.createDataFrame(list(kinds.items()), "handle string, kind string")
    e = spark.createDataFrame(edges, "edge_type string, source string, target string")
    return {r.handle for r in cascade.cascade(n, e, handles(spark, seeds), scratch).collect()}


def test_cascade(spark, scratch):
    kinds = {"p": "Person", "q": "Person", "f": "Family", "e": "Event", "pl": "Place", "up": "Place", "c": "Citation", "s": "Source", "r": "Repository", "m": "Media", "n": "Note", "t": "Tag", "lone": "Note"}
    edges = [("FamilyFather", "f", "p"), ("FamilyEventRef", "f", "e"), ("EventPlace", "e", "pl"), ("PlacePlaceRef", "pl", "up"), ("EventCitation", "e", "c"), ("CitationSource", "c", "s"), ("SourceRepoRef", "s", "r"), ("SourceMediaRef", "s", "m"), ("PersonNote", "p", "n"), ("NoteTag", "n", "t")]
    assert gone(spark, scratch, kinds, edges, ["p", "nobody"]) == set(kinds) - {"q", "lone"}
    shared = [*edges, ("FamilyMother", "f", "q")]
    assert gone(spark, scratch, kinds, shared, ["p"]) == {"p", "n", "t"}
    assert gone(spark, scratch, kinds, shared, ["p", "q"]) == set(kinds) - {"lone"}
    assert gone(spark, scratch, kinds, edges, []) == set()
    # An unused place is left alone; a citation kept only by media isn't kept.
    assert gone(spark, scratch, {"p": "Person", "n": "Note", "pl": "Place"}, [("PersonNote", "p", "n"), ("PlaceNote", "pl", "n")], ["p"]) == {"p"}
    assert gone(spark, scratch, {"p": "Person", "c": "Citation", "m": "Media"}, [("PersonCitation", "p", "c"), ("MediaCitation", "m", "c")], ["p"]) >= {"p", "c"}
    assert gone(spark, scratch, {"p": "Person", "q": "Person"}, [("PersonPersonRef", "p", "q")], ["p"]) == {"p"}


def test_manifest(spark, scratch):
    went = spark.createDataFrame([("p", "Person"), ("e", "Event")], "handle string, kind string")
    rows = cascade.entries(went, spark.createDataFrame([("p", "I1", "Ada")], "handle string, public_id string, description string"))
    whole = cascade.manifest(rows, "in.xml", None, handles(spark, ["p"]), F.lit("now")).first()
    assert list(whole.plan) == ["people", "events"] and whole.plan["people"].to_delete[0].description == "Ada" and whole.version == 3
    after = cascade.reconcile(rows, handles(spark, ["p"]))
    assert {r.handle: r.status for r in after.collect()} == {"p": "pending", "e": "deleted"}
    assert cascade.strangers(rows, handles(spark, ["z"])).count() == 1 and cascade.pending(rows, "events").count() == 1
    assert result(cascade.clean(handles(spark, ["_a", "b"]), handles(spark, ["a"]))) == [("b",)]
    assert tuple(cascade.clean_counts(handles(spark, ["_a", "b"]), handles(spark, ["a", "z"])).first()) == (1, 1)
    assert cascade.coverage(handles(spark, ["a", "b", "c"]), handles(spark, ["a"])).first().level == "warning"
    assert cascade.unknown_entries(rows, handles(spark, ["p"])).count() == 1


def test_validation(spark):
    people = spark.createDataFrame([("a", 1, "Ada", None), ("b", None, "", None), ("", 0, None, "X")], "handle string, gender int, given_name string, surname string")
    assert result(validate.missing_required(people, "Person").select("handle", "field")) == [("", "handle"), ("b", "gender"), ("b", "primary_name")]
    lists = spark.createDataFrame([("a", [1, 2, 3]), ("b", None)], "handle string, xs array<int>")
    assert result(validate.cardinality(lists, "K", {"xs": (1, 2)}).select("handle", "n")) == [("a", 3), ("b", 0)]
    assert validate.cardinality(lists, "K", {"xs": (0, None)}).count() == 0
    edges = spark.createDataFrame([("T", "x", "y"), ("T", "a", "y"), ("T", "a", "a")], "edge_type string, source string, target string")
    assert result(validate.dangling_references(edges, handles(spark, ["a"])).select("missing")) == [("x",), ("y",)]
    warn = spark.createDataFrame([("PlausibilityWarning",), ("MissingRequired",)], "error_kind string")
    assert validate.blocking(warn, strict=False).count() == 1 and validate.blocking(warn, strict=True).count() == 2
    raw = spark.createDataFrame([("f", '<database xmlns="urn:x/1.7.2/"><header/></database>'), ("g", "<x/>"), ("h", "<database><header></database>"), ("i", None)], "path string, content string")
    found = validate.xml_structure(raw)
    assert result(found.groupBy("path", "severity").count()) == [("g", "error", 1), ("g", "warning", 1), ("h", "error", 1), ("h", "warning", 1), ("i", "error", 2), ("i", "warning", 1)]
    assert found.filter("message like 'XML parse error%'").count() == 2


def test_statistics(spark, scratch):
    fam = spark.createDataFrame([("f", "a", "b", ["c", "c"]), ("g", "a", None, [])], "handle string, father_handle string, mother_handle string, child_handles array<string>")
    assert [r[0] for r in fam.select(stats.family_size(F.array("father_handle", "mother_handle"), F.col("child_handles"))).collect()] == [3, 1]
    group = spark.createDataFrame([("a", 2, 1), ("b", 2, 2), ("c", 1, 1)], "component string, size int, span int")
    assert len(stats.generation_table(group).collect()) == 3 + 2 + 2 + 1
    assert [tuple(r) for r in stats.generation_pivot(group, [1, 2]).collect()] == [(1, 1, 0, 1), (2, 1, 1, 2)]
    nodes = spark.createDataFrame([("a", "Person"), ("f", "Family")], "handle string, kind string")
    report = stats.stats_report("x", nodes, spark.createDataFrame([(2,)], "size int"), group, handles(spark, ["a"]), handles(spark, []), ["w"]).first()
    assert report.counts.people == 1 and report.family_group_generation_table == {1: {1: 1}, 2: {1: 1, 2: 1}} and report.people_not_in_family == 1
    pos = spark.createDataFrame([(1900, 1900, 2000), (1950, 1900, 2000), (1900, 1900, 1900), (None, 1, 2)], "y int, a int, b int").select(stats.color_position(F.col("y"), F.col("a"), F.col("b")))
    assert [r[0] for r in pos.collect()] == [0.0, 0.5, 0.5, None]


def test_generator(spark, scratch):
    c = generate.Config(persons=120, places=True, citations=True, seed=3)
    g, again = (generate.generate(spark, c, scratch) for _ in range(2))
    for name in ("persons", "families", "events", "edges"):
        assert result(g[name].select(g[name].columns[0])) == result(again[name].select(g[name].columns[0]))
    assert g["persons"].count() == 120 and 45 <= g["families"].count() <= 60
    e = [tuple(r) for r in g["edges"].select("edge_id", "edge_type", "source", "target").collect()]
    assert sorted(e) == [(i + 1, *x[1:]) for i, x in enumerate(sorted(e, key=lambda x: x[1:]))]
    assert validate.duplicate_handles(g["nodes"]).count() == 0 and validate.dangling_references(g["edges"], g["nodes"]).count() == 0
    born = {r.handle: r.birth_year for r in g["persons"].collect()}
    for f in g["families"].collect():
        for k in f.child_handles:
            assert all(born[k] > born[p] + 16 for p in (f.father_handle, f.mother_handle) if p)
            assert not f.mother_handle or born[k] < born[f.mother_handle] + 50
    kids = [k for f in g["families"].collect() for k in f.child_handles]
    assert kids and len(kids) == len(set(kids))
    g = generate.generate(spark, generate.Config(persons=60, family_ratio=0.15, seed=3), scratch)  # far below the target
    comp = generate.person_components(g, scratch)
    before = generate.connectivity(comp)[1]
    dense = generate.densify(g, scratch)
    assert generate.connectivity(generate.person_components(dense, scratch))[1] > before
    assert validate.dangling_references(dense["edges"], dense["nodes"]).count() == 0


def test_pairing_reaches_its_target(spark, scratch):
    """Of 40 people who all fit, with up to two roles each; couples are never repeated."""
    people = spark.createDataFrame([(f"p{i:02}", i % 2, 1900 + i % 5, 0, i == 39) for i in range(40)], "handle string, gender int, birth_year int, layer int, solo boolean")
    for roles, want in ((1, 19), (2, 30)):
        got = generate.couples(people, generate.Config(persons=40, max_parent_roles=roles), 30, scratch).collect()
        assert len(got) == len({(r.father, r.mother) for r in got}) == len({r.family for r in got}) == min(want, 20 * roles)
        for who in ("father", "mother"):
            assert max(collections.Counter(r[who] for r in got).values()) <= roles


def test_components_of_many_nodes(spark, scratch, monkeypatch):
    """The way without a broadcast gives the same."""
    rng = random.Random(6)
    e = spark.createDataFrame([(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(0, i) for i in range(400, 460)], "a long, b long")
    got = [result(graph.stars(e, scratch))]
    monkeypatch.setattr(graph, "FEW_NODES", 0)
    got.append(result(graph.stars(e, scratch)))
    assert got[0] == got[1] and len(got[0]) > 200


def test_places_in_order(spark, scratch):
    rows = spark.range(0, 1000, 1, 7).selectExpr("(id * 7919) % 1000 as v", "id % 3 as w")
    placed, n = rank.numbered(rows, ["v"], scratch)
    assert n == 1000 and all(r.place == r.v for r in placed.collect())
    assert rank.numbered(rows.filter("false"), ["v"], scratch)[1] == 0
    assert sorted(r.v for r in rank.first_share(rows, ["v"], 0.0105, scratch).filter("_hit").collect()) == list(range(11))


def test_spoiling(spark, scratch):
    g = generate.generate(spark, generate.Config(persons=60, places=True, seed=1), scratch)
    bad = generate.spoil(g, ("disconnected", "deep-nesting", "max-ref-chains", "orphaned-refs", "double-gender", "unheard-of"), scratch)
    with pytest.warns(UserWarning):
        assert generate.spoil({"edges": g["edges"]}, ("deep-nesting",), scratch) == {"edges": g["edges"]}
    assert bad["nodes"].filter("kind = 'Place'").count() == 4 * g["places"].count()
    assert bad["edges"].filter("edge_type = 'PlacePlaceRef'").count() <= 3 * g["places"].count()
    part = {r.handle: i % 2 for i, r in enumerate(g["persons"].orderBy("handle").collect())}
    for r in generate.members(bad["edges"]).groupBy("family").agg(F.collect_list("handle").alias("h")).collect():
        assert len({part[h] for h in r.h}) == 1
    assert g["persons"].join(bad["persons"].select("handle", F.col("gender").alias("now")), "handle").filter("gender != now").count() > 0
    s = generate.load_scenario({"person_count": 9, "adversarial": {"enabled": True, "strategies": ["solo", "disconnected"]}, "densify": {"enabled": True}})
    assert s.config.persons == 9 and s.config.solo == 0.2 and s.target_connectivity == 0.85
    with pytest.raises(ValueError):
        generate.load_scenario({"adversarial": {"enabled": True, "strategies": ["nope"]}})


def test_range_join_equals_the_condition(spark):
    rng = random.Random(0)
    a = [(i, rng.randint(0, 200), rng.randint(0, 60)) for i in range(60)]
    b = [(i, rng.randint(0, 260)) for i in range(80)]
    got = generate.range_join(spark.createDataFrame(a, "i int, lo int, w int"), spark.createDataFrame(b, "j int, v int"), "v", F.col("lo"), F.col("lo") + F.col("w") - 5, 30)
    assert result(got.select("i", "j")) == sorted((i, j) for i, lo, w in a for j, v in b if lo <= v <= lo + w - 5)


def _most_rows(plan):
    """The largest number of rows that a node of an executed plan made."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    made = plan.metrics().get("numOutputRows")
    kids = plan.children()
    return max([made.get().value() if made.isDefined() else 0, *(_most_rows(kids.apply(i)) for i in range(kids.size()))])


@pytest.mark.parametrize("name", ["pair_theta_join", "child_range_join"])
def test_range_joins_meet_by_year(spark, tmp_path, name):
    from heartwood.plans import catalog

    spark.range(1, 4001).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()))
    assert _most_rows(got._jdf.queryExecution().executedPlan()) <= 30_000
    year = lambda k: 1900 + k % 83
    want = []
    for a in range(1, 4001):
        if name == "pair_theta_join" and a % 2 == 0:
            near = [(abs(year(a) - year(b)), f"C{b}") for b in range(1, 4001, 2) if abs(year(a) - year(b)) <= 20 and year(a) + 16 <= year(b) + 50]
            want += [(f"C{a}", min(near)[1], len(near))] if near else []
        if name == "child_range_join" and a % 2 == 1:
            want += [(f"C{a}", c) for _, c in sorted((year(b), f"C{b}") for b in range(1, 4001) if year(a) + 16 < year(b) < year(a) + 50)[:3]]
    assert rows == sorted(want)
