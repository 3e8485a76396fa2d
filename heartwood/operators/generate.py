"""Synthetic graphs, made denser or spoiled on purpose. The same seed gives the same graph.

Random choices are hashes of (seed, what for, key), so a row's values don't depend on
partitions and survive a recomputed task.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_value
from ..scratch import Scratch
from . import graph
from .rank import first_share, numbered

MIN_PARENT, MAX_MOTHER, PAIR_GAP = 16, 50, 20


@dataclass(frozen=True)
class Config:
    persons: int = 200
    family_ratio: float = 0.5
    max_parent_roles: int = 1
    generations: int = 3
    children: tuple[int, int] = (1, 4)  #: from, up to but without
    years: tuple[int, int] = (1850, 2025)
    places: bool = False
    citations: bool = False
    seed: int = 0
    one_parent: float = 0.0  #: the adversarial fractions
    missing_events: float = 0.0
    solo: float = 0.0
    many_names: float = 0.0


@dataclass(frozen=True)
class Scenario:
    """What a scenario file holds; see load_scenario."""

    config: Config = field(default_factory=Config)
    strategies: tuple[str, ...] = ()
    target_connectivity: float | None = None
    max_parent_roles: int = 3


#: The strategies and the fractions they set, if they act while generating.
STRATEGIES = {"one-parent": {"one_parent": 0.5}, "missing-events": {"missing_events": 0.3}, "solo": {"solo": 0.2}, "many-names": {"many_names": 0.3}, "disconnected": {}, "deep-nesting": {}, "max-ref-chains": {}, "orphaned-refs": {}, "double-gender": {}}


def load_scenario(values: dict) -> Scenario:
    """From the nested mapping of a scenario file."""
    gen, span = values.get("generations", {}), values.get("date_range", {})
    kids, adv, dens = gen.get("children_per_family", {}), values.get("adversarial", {}), values.get("densify", {})
    base = Config()
    names = tuple(adv.get("strategies", ())) if adv.get("enabled") else ()
    unknown = set(names) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    extra = {k: v for n in names for k, v in STRATEGIES[n].items()}
    config = Config(
        persons=values.get("person_count", base.persons), family_ratio=values.get("family_ratio", base.family_ratio), generations=gen.get("depth", base.generations),
        max_parent_roles=values.get("max_parent_roles", base.max_parent_roles), children=(kids.get("min", base.children[0]), kids.get("max", base.children[1])), years=(span.get("start", base.years[0]), span.get("end", base.years[1])),
        places=values.get("with_places", False), citations=values.get("with_citations", False), seed=values.get("seed", 0), **extra,
    )
    return Scenario(config, names, dens.get("target_connectivity", 0.85) if dens.get("enabled") else None, dens.get("max_parent_roles", 3))


def read_scenario(path: str) -> Scenario:
    """From a file on the driver: JSON, or the block part of YAML (nested mappings, lists of
    values, one-line mappings and lists, comments). Anything else is an error."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if text.lstrip().startswith("{"):
        return load_scenario(json.loads(text))
    lines = []
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"""(^|\s)#(?=(?:[^'"]|'[^']*'|"[^"]*")*$).*""", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((n, len(line) - len(line.lstrip()), line.strip()))
    values, left = _block(lines, 0)
    if left:
        raise ValueError(f"line {left[0][0]} doesn't belong anywhere")
    return load_scenario(values)


def _value(text: str):
    if text[:1] == "{" and text[-1:] == "}":
        return {k.strip(): _value(v.strip()) for k, v in (x.split(":", 1) for x in text[1:-1].split(",") if x.strip())}
    if text[:1] == "[" and text[-1:] == "]":
        return [_value(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "'\"" and text[:1] and text[-1:] == text[:1]:
        return text[1:-1]
    try:
        return json.loads(text)  # numbers, true, false and null
    except ValueError:
        return None if text in ("", "~") else text


def _block(lines: list[tuple[int, int, str]], depth: int):
    """(the value of the lines at this depth, the lines behind it)."""
    if lines and lines[0][1] == depth and lines[0][2].startswith("- "):
        items = []
        while lines and lines[0][1] == depth and lines[0][2].startswith("- "):
            items.append(_value(lines[0][2][2:].strip()))
            lines = lines[1:]
        return items, lines
    out = {}
    while lines and lines[0][1] == depth:
        n, _, text = lines[0]
        m = re.fullmatch(r"([\w-]+)\s*:(?:\s+(.*))?", text)
        if not m or m[1] in out:
            raise ValueError(f"line {n} isn't a new key and its value")
        lines = lines[1:]
        deeper = lines and (lines[0][1] > depth or (lines[0][1] == depth and lines[0][2].startswith("- ")))
        if m[2] is None and deeper:
            out[m[1]], lines = _block(lines, lines[0][1])
        else:
            out[m[1]] = _value((m[2] or "").strip())
    return out, lines


def roll(seed: int, what: str, *key: Column) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(seed: int, what: str, values: list[str], *key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(roll(seed, what, *key) * len(values)) + 1).cast("int"))


SYLLABLES = {"first": ["an", "bel", "cor", "dan", "el", "fa", "gor", "hil", "il", "jo", "ka", "lu"], "last": ["mar", "nor", "os", "pet", "quin", "rob", "sten", "tor", "ul", "vik", "wes", "yar"]}
COUNTRY, STATE, CITY = ["Norland", "Sudmark", "Ostia"], ["Alba", "Brava", "Corva", "Delta"], ["Ford", "Gale", "Hove", "Ilion", "Jura"]


def persons(spark: SparkSession, c: Config) -> DataFrame:
    """(n, layer, handle, gender, given_name, surname, birth_year, death_year, alive part of it all)."""
    each = -(-c.persons // max(1, c.generations))
    i, s = F.col("n"), c.seed
    p = spark.range(c.persons).select(F.col("id").alias("n"), F.least(F.floor(F.col("id") / each), F.lit(c.generations - 1)).cast("int").alias("layer"))
    g = roll(s, "gender", i)
    # Layer 0 is the oldest: as many generations before the end as follow it.
    back = (c.generations - 1 - F.col("layer")) * 30
    low = F.greatest(F.lit(c.years[0]), F.lit(c.years[1] - 55) - back)
    high = F.greatest(low + 1, F.lit(c.years[1] - 25) - back)
    name = lambda what, key: F.initcap(F.concat(pick(s, what + "1", SYLLABLES[what], key), pick(s, what + "2", SYLLABLES[what], key)))
    p = p.select(
        "n", "layer", F.format_string("_%08x%08x", F.lit(s), i).alias("handle"), F.when(g < 0.475, 0).when(g < 0.95, 1).when(g < 0.975, 2).otherwise(3).alias("gender"),
        name("first", i).alias("given"), name("last", i).alias("surname"), (low + F.floor(roll(s, "birth", i) * (high - low))).cast("int").alias("birth_year"),
    )
    middle = [F.when(roll(s, f"more{k}", i) >= 0.4, name("first", F.concat(i.cast("string"), F.lit(f"m{k}")))) for k in range(3)]
    middles = F.concat_ws(" ", middle[0], F.when(middle[0].isNotNull(), middle[1]), F.when(middle[0].isNotNull() & middle[1].isNotNull(), middle[2]))
    age = F.lit(c.years[1]) - F.col("birth_year")
    chance = F.when(age > 100, 1.0).when(age > 80, 0.8).when(age > 60, 0.4).otherwise(0.1)
    died = F.col("birth_year") + 18 + F.floor(roll(s, "age", i) * 83)
    q = roll(s, "quality", i)
    extra = F.when(roll(s, "many", i) < c.many_names, F.transform(F.sequence(F.lit(1), (5 + F.floor(roll(s, "manyn", i) * 16)).cast("int")), lambda k: F.concat(F.lit("Alias"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    p = p.select(
        "n", "layer", "handle", F.format_string("I%04d", i).alias("public_id"), "gender", F.trim(F.concat_ws(" ", "given", F.when(middles != "", middles))).alias("given_name"), "surname", "birth_year",
        F.when((roll(s, "death", i) < chance) & (age >= 18), F.least(died, F.lit(c.years[1]))).cast("int").alias("death_year"),
        F.when(q < 0.8, "Exact").when(q < 0.95, "Estimated").otherwise("Calculated").alias("quality"), extra.alias("alternate_names"),
        (roll(s, "missing", i) < c.missing_events).alias("no_events"), (roll(s, "solo", i) < c.solo).alias("solo"),
    )
    # Names are unique: the second and later bearers of one get a number.
    k = F.row_number().over(Window.partitionBy("given_name", "surname").orderBy("n"))
    return p.withColumn("_k", k).withColumn("surname", F.when(F.col("_k") > 1, F.concat("surname", F.lit(" "), F.col("_k").cast("string"))).otherwise(F.col("surname"))).drop("_k")


def range_join(left: DataFrame, right: DataFrame, value: str, low: Column, high: Column, width: int) -> DataFrame:
    """right's rows whose ``value`` lies in [low, high] of left's, by equal bins of ``width``;
    only bins that an interval touches meet."""
    l = left.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    r = right.withColumn("_bin", F.floor(F.col(value) / width))
    return l.join(r, "_bin").filter(F.col(value).between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")


def couples(people: DataFrame, c: Config, limit: int, scratch: Scratch) -> DataFrame:
    """(family, father, father_year, mother, mother_year): at most ``limit`` couples.

    In each round people who may still be a parent stand in bins of their layer and of
    ``PAIR_GAP`` years of birth, men and women in hashed orders, and those in equal places
    pair up; any two of a bin are close enough in age. The bins move from round to round,
    and join neighbouring layers in every second one. A round in which nobody pairs is
    followed by one over all closest pairs left; the rounds end with the limit, or when
    that finds none either. Nobody is a parent more than ``max_parent_roles`` times, and
    no couple comes twice.
    """
    can = scratch.save(people.filter("not solo and gender in (0, 1)").select("handle", "gender", "birth_year", "layer"))
    schema = "family string, father string, father_year int, mother string, mother_year int"
    made, n, idle, turn = scratch.save(people.sparkSession.createDataFrame([], schema)), 0, 0, 0
    limit = min(limit, c.persons * c.max_parent_roles // 2)
    while n < limit and idle < 4:
        roles = made.select(F.explode(F.array("father", "mother")).alias("handle")).groupBy("handle").agg(F.count("*").alias("roles"))
        free = can.join(roles, "handle", "left").filter(F.coalesce("roles", F.lit(0)) < c.max_parent_roles)
        key, hashed = F.col("handle"), roll(c.seed, f"pair{turn}", F.col("handle"))
        if idle < 3:
            layer = F.floor((F.col("layer") + turn // 2 % 2) / 2) if turn % 2 else F.col("layer")
            bin_ = [layer.alias("_layer"), F.floor((F.col("birth_year") + turn * 7 % PAIR_GAP) / PAIR_GAP).alias("_bin")]
            placed = free.select("*", *bin_).withColumn("_lot", F.pmod(F.xxhash64(F.lit(c.seed + turn), key), F.lit(max(1, c.persons // 50_000))))
            placed = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_layer", "_bin", "_lot", "gender").orderBy(hashed, "handle")))
            side = lambda g, who: placed.filter(F.col("gender") == g).select("_layer", "_bin", "_lot", "_place", F.col("handle").alias(who), F.col("birth_year").alias(f"{who}_year"))
            met = side(0, "father").join(side(1, "mother"), ["_layer", "_bin", "_lot", "_place"])
        else:
            side = lambda g, who: free.filter(F.col("gender") == g).select(F.col("handle").alias(who), F.col("birth_year").alias(f"{who}_year"), F.col("layer").alias(f"{who}_layer"))
            met = range_join(side(0, "father"), side(1, "mother"), "mother_year", F.col("father_year") - PAIR_GAP, F.col("father_year") + PAIR_GAP, 2 * PAIR_GAP)
            met = met.filter(F.abs(F.col("father_layer") - F.col("mother_layer")) <= 1)
        met = met.filter(F.col("father_year") + MIN_PARENT <= F.col("mother_year") + MAX_MOTHER).join(made.select("father", "mother"), ["father", "mother"], "left_anti")
        if idle == 3:  # the closest for each other
            order = [F.abs(F.col("father_year") - F.col("mother_year")), roll(c.seed, "close", F.col("father"), F.col("mother")), F.col("father"), F.col("mother")]
            met = met.withColumn("_f", F.row_number().over(Window.partitionBy("father").orderBy(*order))).filter("_f = 1")
            met = met.withColumn("_m", F.row_number().over(Window.partitionBy("mother").orderBy(*order))).filter("_m = 1")
        met = scratch.save(met.select(F.concat_ws("-", F.concat(F.lit("F"), F.col("father")), *([F.lit(str(turn))] if c.max_parent_roles > 1 else [])).alias("family"), "father", "father_year", "mother", "mother_year"))
        found = met.count()
        if n + found > limit:
            met, _ = numbered(met.withColumn("_r", roll(c.seed, "keep", F.col("family"))), ["_r", "family"], scratch)
            met, found = met.filter(F.col("place") < limit - n).drop("_r", "place"), limit - n
        made = scratch.save(made.unionByName(met))
        n, turn, idle = n + found, turn + 1, 0 if found else idle + 1
    return made


def children(families: DataFrame, people: DataFrame, c: Config, scratch: Scratch) -> DataFrame:
    """(family, child): of those born from 16 years after both parents to 50 after the
    mother, as many as the family has room for, each with one family.

    In each round every open place stands in all years of its parents' range, and the
    children left in the year of their birth, each year in hashed orders; those in equal
    places meet, and a place keeps one of the children it met. So a round lists as many
    rows as there are years to a place, never pairs of families and children, and the
    rounds end when no year has both.
    """
    low = F.greatest(F.coalesce("father_year", "mother_year"), F.coalesce("mother_year", "father_year")) + MIN_PARENT + 1
    high = F.coalesce("mother_year", "father_year") + MAX_MOTHER - 1
    want = (c.children[0] + F.floor(roll(c.seed, "many", F.col("family")) * (c.children[1] - c.children[0]))).cast("int")
    open_ = families.select("family", low.alias("low"), high.alias("high"), want.alias("want")).filter("low <= high and want > 0")
    open_ = scratch.save(open_.select("family", "low", "high", F.explode(F.sequence(F.lit(1), "want")).alias("k")))
    young = people.select(F.col("handle").alias("child"), "birth_year")
    made = scratch.save(people.sparkSession.createDataFrame([], "family string, k int, child string"))
    lots, turn = max(1, c.persons // 50_000), 0
    while True:
        lot = lambda *key: F.pmod(F.xxhash64(F.lit(c.seed + turn), *key), F.lit(lots))  # noqa: E731, B023
        place = lambda df, *key: df.withColumn("_place", F.row_number().over(Window.partitionBy("birth_year", "_lot").orderBy(roll(c.seed, f"child{turn}", *map(F.col, key)), *key)))  # noqa: E731, B023
        left = open_.join(made.select("family", "k"), ["family", "k"], "left_anti").withColumn("birth_year", F.explode(F.sequence("low", "high")))
        left = left.select("family", "k", "birth_year", lot("family", "k").alias("_lot"))
        free = young.join(made.select("child"), "child", "left_anti").withColumn("_lot", lot("child"))
        met = place(left, "family", "k").join(place(free, "child"), ["birth_year", "_lot", "_place"])
        new = scratch.save(met.groupBy("family", "k").agg(F.min_by("child", F.struct(roll(c.seed, f"keep{turn}", F.col("child")), "child")).alias("child")))
        if not new.isEmpty():
            made = scratch.save(made.unionByName(new))
        elif lots == 1:
            return made.select("family", "child")
        else:
            lots = 1
        turn += 1


def generate(spark: SparkSession, c: Config, scratch: Scratch) -> dict[str, DataFrame]:
    """Tables persons, families, events, places, sources, citations, nodes and edges."""
    people = scratch.save(persons(spark, c))
    two = couples(people, c, int(c.persons * c.family_ratio + 0.5), scratch)
    alone = roll(c.seed, "one", F.col("family")) < c.one_parent
    second = roll(c.seed, "which", F.col("family")) < 0.5
    gone = lambda left, col: F.when(alone & left, None).otherwise(F.col(col)).alias(col)
    fam = two.select("family", gone(second, "father"), gone(second, "father_year"), gone(~second, "mother"), gone(~second, "mother_year"))
    fam = scratch.save(fam)
    kids = scratch.save(children(fam, people, c, scratch))
    seen = people.filter("not no_events")
    born = seen.select(F.concat(F.lit("B"), F.col("handle")).alias("event"), F.col("handle").alias("owner"), F.lit("Birth").alias("event_type"), F.col("birth_year").alias("year"), "quality")
    died = seen.filter("death_year is not null").select(F.concat(F.lit("D"), F.col("handle")).alias("event"), F.col("handle").alias("owner"), F.lit("Death").alias("event_type"), F.col("death_year").alias("year"), "quality")
    first = kids.join(people.select(F.col("handle").alias("child"), "birth_year"), "child").groupBy("family").agg(F.min("birth_year").alias("first_year"))
    wed = fam.join(first, "family", "left")
    low = F.greatest(F.coalesce("father_year", "mother_year"), F.coalesce("mother_year", "father_year")) + MIN_PARENT
    high = F.greatest(low, F.coalesce("first_year", low + 10))
    wed = wed.select(F.concat(F.lit("M"), F.col("family")).alias("event"), F.col("family").alias("owner"), F.lit("Marriage").alias("event_type"), (low + F.floor(roll(c.seed, "wed", F.col("family")) * (high - low + 1))).cast("int").alias("year"), F.lit("Exact").alias("quality"))
    event = scratch.save(born.unionByName(died).unionByName(wed))
    e = F.col("event")
    depth = 1 + F.floor(roll(c.seed, "depth", e) * 3)
    place = event.filter(F.lit(c.places)).select(F.concat(F.lit("P"), e).alias("handle"), e.alias("event"), pick(c.seed, "country", COUNTRY, e).alias("country"), F.when(depth > 1, pick(c.seed, "state", STATE, e)).alias("state"), F.when(depth > 2, pick(c.seed, "city", CITY, e)).alias("city"))
    cite = event.filter(F.lit(c.citations) & (roll(c.seed, "cite", e) < 0.3)).select(F.concat(F.lit("C"), e).alias("handle"), e.alias("event"), F.lit("S0").alias("source_handle"))
    source = spark.createDataFrame([("S0", "Parish register")] if c.citations else [], "handle string, title string")
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), F.col(a).alias("source"), F.col(b).alias("target")).filter("source is not null and target is not null")
    edges = (
        edge(born.unionByName(died), "PersonEventRef", "owner", "event").unionByName(edge(wed, "FamilyEventRef", "owner", "event"))
        .unionByName(edge(fam, "FamilyFather", "family", "father")).unionByName(edge(fam, "FamilyMother", "family", "mother")).unionByName(edge(kids, "FamilyChildRef", "family", "child"))
        .unionByName(edge(fam, "PersonFamily", "father", "family")).unionByName(edge(fam, "PersonFamily", "mother", "family")).unionByName(edge(kids, "PersonParentFamily", "child", "family"))
        .unionByName(edge(place, "EventPlace", "event", "handle")).unionByName(edge(cite, "EventCitation", "event", "handle")).unionByName(edge(cite, "CitationSource", "handle", "source_handle"))
    )
    node = lambda df, kind, col="handle": df.select(F.col(col).alias("handle"), F.lit(kind).alias("kind"))
    nodes = node(people, "Person").unionByName(node(fam, "Family", "family")).unionByName(node(event, "Event", "event")).unionByName(node(place, "Place")).unionByName(node(cite, "Citation")).unionByName(node(source, "Source"))
    edges, _ = numbered(edges, ["edge_type", "source", "target"], scratch, "edge_id")
    edges = edges.withColumn("edge_id", F.col("edge_id") + 1)
    events = event.select(F.col("event").alias("handle"), "event_type", "owner", date_value(F.col("year"), quality=F.col("quality")).alias("date"))
    families = fam.join(kids.groupBy("family").agg(F.sort_array(F.collect_list("child")).alias("child_handles")), "family", "left").select(F.col("family").alias("handle"), F.col("father").alias("father_handle"), F.col("mother").alias("mother_handle"), F.coalesce("child_handles", F.array().cast("array<string>")).alias("child_handles"))
    return {"persons": people, "families": families, "events": events, "places": place, "citations": cite, "sources": source, "nodes": scratch.save(nodes), "edges": edges}


# --------------------------------------------------------------------------- densify


def members(edges: DataFrame) -> DataFrame:
    """(family, handle) of fathers, mothers and children, from the edges."""
    return edges.filter(F.col("edge_type").isin("FamilyFather", "FamilyMother", "FamilyChildRef")).select(F.col("source").alias("family"), F.col("target").alias("handle"))


def person_components(g: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    return graph.connected_components(g["persons"], graph.family_pairs(members(g["edges"])), scratch)


def connectivity(components: DataFrame) -> tuple[str | None, float]:
    """(the largest component, its share of all people); of equal ones the smallest name."""
    size = components.groupBy("component").agg(F.count("*").alias("n"))
    top = size.orderBy(F.desc("n"), "component").first()
    total = components.count()
    return (top[0], top[1] / total) if top else (None, 1.0)


def _grow(g: dict[str, DataFrame], fam: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """g with new families (family, father, mother)."""
    both = fam.select(F.lit("FamilyFather").alias("edge_type"), F.col("family").alias("source"), F.col("father").alias("target")).unionByName(fam.select(F.lit("FamilyMother"), "family", "mother").toDF("edge_type", "source", "target"))
    nodes = g["nodes"].unionByName(fam.select(F.col("family").alias("handle"), F.lit("Family").alias("kind")))
    new = fam.select(F.col("family").alias("handle"), F.col("father").alias("father_handle"), F.col("mother").alias("mother_handle"), F.array().cast("array<string>").alias("child_handles"))
    return g | {"nodes": scratch.save(nodes), "edges": scratch.save(g["edges"].unionByName(both.withColumn("edge_id", F.lit(None).cast("long")))), "families": scratch.save(g["families"].unionByName(new))}


def densify(g: dict[str, DataFrame], scratch: Scratch, target: float = 0.85, max_parent_roles: int = 3, seed: int = 0) -> dict[str, DataFrame]:
    """Joins small components to the largest by marriage, then adopts single people, then
    gives childless single parents a spouse, until its share of all people is ``target``."""
    for step in (marry_components, adopt_orphans, pair_single_parents):
        comp = scratch.save(person_components(g, scratch))
        top, share = connectivity(comp)
        if top is None or share >= target:
            break
        g = step(g, comp, top, scratch, max_parent_roles, seed)
    return g


def _roles(g: dict[str, DataFrame]) -> DataFrame:
    parent = g["edges"].filter(F.col("edge_type").isin("FamilyFather", "FamilyMother"))
    return parent.groupBy(F.col("target").alias("handle")).agg(F.count("*").alias("roles"))


def _eligible(g: dict[str, DataFrame], comp: DataFrame, most: int) -> DataFrame:
    return g["persons"].select("handle", "gender", "birth_year").join(comp, "handle").join(_roles(g), "handle", "left").filter(F.coalesce("roles", F.lit(0)) < most)


def marry_components(g: dict[str, DataFrame], comp: DataFrame, top: str, scratch: Scratch, most: int, seed: int) -> dict[str, DataFrame]:
    """One marriage between each small component of two or more and the largest."""
    can = scratch.save(_eligible(g, comp, most))
    size = comp.groupBy("component").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("component") != top)).select("component")
    small = can.join(size, "component").select("component", F.col("handle").alias("x"), F.col("gender").alias("xg"), F.col("birth_year").alias("xy"))
    main = can.filter((F.col("component") == top) & F.col("gender").isin(0, 1)).select(F.col("handle").alias("y"), F.col("gender").alias("yg"), F.col("birth_year").alias("yy"))
    met = range_join(small.filter(F.col("xg").isin(0, 1)), main, "yy", F.col("xy") - PAIR_GAP, F.col("xy") + PAIR_GAP, 2 * PAIR_GAP).filter("xg != yg")
    order = [F.abs(F.col("xy") - F.col("yy")), F.col("x"), F.col("y")]
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy(*order))).filter("_r = 1")
    father, mother = (F.when(F.col("xg") == k, F.col("x")).otherwise(F.col("y")) for k in (0, 1))
    return _grow(g, met.select(F.concat(F.lit("FM"), F.col("component")).alias("family"), father.alias("father"), mother.alias("mother")), scratch)


def adopt_orphans(g: dict[str, DataFrame], comp: DataFrame, top: str, scratch: Scratch, most: int, seed: int) -> dict[str, DataFrame]:
    """Isolated people become children of a fitting family of the largest component."""
    lone = comp.groupBy("component").agg(F.count("*").alias("n")).filter("n = 1").select("component")
    orphan = g["persons"].join(comp, "handle").join(lone, "component").select(F.col("handle").alias("child"), "birth_year")
    year = lambda a, b: g["persons"].select(F.col("handle").alias(a), F.col("birth_year").alias(b))
    fam = g["families"].filter("father_handle is not null and mother_handle is not null").join(comp.filter(F.col("component") == top).select(F.col("handle").alias("father_handle")), "father_handle")
    fam = fam.join(year("father_handle", "father_year"), "father_handle").join(year("mother_handle", "mother_year"), "mother_handle").select(F.col("handle").alias("family"), "father_year", "mother_year")
    met = range_join(fam, orphan, "birth_year", F.greatest("father_year", "mother_year") + MIN_PARENT + 1, F.col("mother_year") + MAX_MOTHER - 1, 16)
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("child").orderBy(roll(seed, "adopt", F.col("family"), F.col("child")), F.col("family")))).filter("_r = 1")
    new = met.select(F.lit("FamilyChildRef").alias("edge_type"), F.col("family").alias("source"), F.col("child").alias("target"), F.lit(None).cast("long").alias("edge_id"))
    kids = met.groupBy(F.col("family").alias("handle")).agg(F.collect_list("child").alias("_new"))
    families = g["families"].join(kids, "handle", "left").withColumn("child_handles", F.sort_array(F.concat("child_handles", F.coalesce("_new", F.array().cast("array<string>"))))).drop("_new")
    return g | {"edges": scratch.save(g["edges"].unionByName(new)), "families": scratch.save(families)}


def pair_single_parents(g: dict[str, DataFrame], comp: DataFrame, top: str, scratch: Scratch, most: int, seed: int) -> dict[str, DataFrame]:
    """A new family for each parent of a childless one-parent family; the old one stays."""
    can = scratch.save(_eligible(g, comp, most))
    one = g["families"].filter("(father_handle is null) != (mother_handle is null) and size(child_handles) = 0").select(F.col("handle").alias("old"), F.coalesce("father_handle", "mother_handle").alias("x"))
    one = one.join(can.select(F.col("handle").alias("x"), F.col("gender").alias("xg"), F.col("birth_year").alias("xy")), "x")
    main = can.select(F.col("handle").alias("y"), F.col("gender").alias("yg"), F.col("birth_year").alias("yy"))
    met = range_join(one, main, "yy", F.col("xy") - PAIR_GAP, F.col("xy") + PAIR_GAP, 2 * PAIR_GAP).filter("(xg = 0 and yg = 1) or (xg != 0 and yg = 0)")
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("old").orderBy(roll(seed, "spouse", F.col("x"), F.col("y")), F.col("y")))).filter("_r = 1")
    father, mother = F.when(F.col("xg") == 0, F.col("x")).otherwise(F.col("y")), F.when(F.col("xg") == 0, F.col("y")).otherwise(F.col("x"))
    return _grow(g, met.select(F.concat(F.lit("FU"), F.col("old")).alias("family"), father.alias("father"), mother.alias("mother")), scratch)


# ------------------------------------------------------------------------- adversarial

SOFT = ("EventPlace", "PlacePlaceRef", "CitationSource", "SourceRepoRef", "PersonPersonRef")


def disconnect(persons: DataFrame, edges: DataFrame, scratch: Scratch, order: str = "handle", clusters: int = 2) -> DataFrame:
    """edges without the family ties of any family whose people are in several clusters;
    people are dealt round robin in order."""
    part = numbered(persons.select("handle", *({order} - {"handle"})), [order], scratch)[0].select("handle", F.pmod("place", F.lit(clusters)).alias("cluster"))
    ties = ["FamilyFather", "FamilyMother", "FamilyChildRef", "PersonFamily", "PersonParentFamily"]
    of = members(edges).join(part, "handle").groupBy("family").agg(F.count_distinct("cluster").alias("n")).filter("n > 1").select("family")
    family = F.when(F.col("edge_type").startswith("Family"), F.col("source")).when(F.col("edge_type").isin(ties), F.col("target"))
    tied = edges.withColumn("family", F.when(F.col("edge_type").isin(ties), family))
    return tied.join(of, "family", "left_anti").select(edges.columns)


def nest_places(places: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a chain of ``depth`` parent places over each place."""
    level = places.select("handle", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("k"))
    name = lambda k: F.when(k == 0, F.col("handle")).otherwise(F.concat("handle", F.lit("/"), k.cast("string")))
    return level.select(name(F.col("k")).alias("handle"), F.lit("Place").alias("kind")), level.select(F.lit("PlacePlaceRef").alias("edge_type"), name(F.col("k") - 1).alias("source"), name(F.col("k")).alias("target"))


#: The chain's edge types; from the fifth link on all are NoteTag.
CHAIN = ["EventCitation", "CitationSource", "SourceRepoRef", "RepositoryNote", "NoteTag"]
CHAIN_KINDS = ["Citation", "Source", "Repository", "Note", "Tag"]


def ref_chains(events: DataFrame, length: int = 5) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a chain of 1 to 10 references from each event."""
    length = min(10, max(1, length))
    link = events.select("handle", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("k"))
    name = lambda k: F.when(k == 0, F.col("handle")).otherwise(F.concat("handle", F.lit("~"), k.cast("string")))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.least(F.col("k"), F.lit(5)))
    return link.select(name(F.col("k")).alias("handle"), at(CHAIN_KINDS).alias("kind")), link.select(at(CHAIN).alias("edge_type"), name(F.col("k") - 1).alias("source"), name(F.col("k")).alias("target"))


def orphan_refs(edges: DataFrame, share: float, scratch: Scratch, soft: tuple[str, ...] = SOFT, order: tuple[str, ...] = ("edge_id",)) -> DataFrame:
    """edges without the first share of soft ones, and without those equal to one dropped."""
    same = ["edge_type", "source", "target"]
    drop = first_share(edges.filter(F.col("edge_type").isin(list(soft))), list(order), share, scratch).filter("_hit").select(same).distinct()
    return edges.join(drop, same, "left_anti").select(edges.columns)


def swap_genders(persons: DataFrame, share: float, scratch: Scratch, order: tuple[str, ...] = ("handle",)) -> DataFrame:
    """0 and 1 change places for the first share of people."""
    g = F.col("gender")
    hit = first_share(persons, list(order), share, scratch)
    return hit.withColumn("gender", F.when(F.col("_hit") & (g == 0), 1).when(F.col("_hit") & (g == 1), 0).otherwise(g).cast("int")).drop("_hit")


def spoil(g: dict[str, DataFrame], strategies: tuple[str, ...], scratch: Scratch, share: float = 0.3) -> dict[str, DataFrame]:
    """The strategies that act on a finished graph, in order; an unknown one changes nothing,
    and one that can't be applied leaves the graph as it was before it."""
    for s in strategies:
        try:
            g = _spoiled(g, s, scratch, share)
        except (AnalysisException, KeyError) as e:  # a table or column that it needs isn't there
            warnings.warn(f"{s} left out: {e}", stacklevel=2)
    return g


def _spoiled(g: dict[str, DataFrame], s: str, scratch: Scratch, share: float) -> dict[str, DataFrame]:
    if s == "disconnected":
        g = g | {"edges": disconnect(g["persons"], g["edges"], scratch)}
    elif s == "deep-nesting":
        nodes, edges = nest_places(g["places"])
        g = g | {"nodes": g["nodes"].unionByName(nodes), "edges": g["edges"].unionByName(edges, allowMissingColumns=True)}
    elif s == "max-ref-chains":
        nodes, edges = ref_chains(g["events"])
        g = g | {"nodes": g["nodes"].unionByName(nodes), "edges": g["edges"].unionByName(edges, allowMissingColumns=True)}
    elif s == "orphaned-refs":
        g = g | {"edges": orphan_refs(g["edges"], share, scratch, order=("edge_id", "edge_type", "source", "target"))}
    elif s == "double-gender":
        g = g | {"persons": swap_genders(g["persons"], share, scratch)}
    return g
