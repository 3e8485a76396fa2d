"""The registered queries over the driver's tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import cascade, compare, generate, graph, impute, integrate, kinship, match, stats, validate
from ..operators.rank import numbered
from ..scratch import Scratch
from .tables import DEPTH, FOREST, GRAPH, REACH, _key, edges, forest, kin, nodes, parents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# ------------------------------------------------------------------ counts and statistics

_KIND_ROWS = "(VALUES ('Person'), ('Family'), ('Event'), ('Place'), ('Citation'), ('Source'), ('Repository'), ('Media'), ('Note'), ('Tag')) k(kind)"


@query(f"WITH {GRAPH} SELECT k.kind, count(n.handle) AS n FROM {_KIND_ROWS} LEFT JOIN nodes n ON n.kind = k.kind GROUP BY k.kind")
def count_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return stats.count_by_kind(nodes(spark, d))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Without every fiftieth part and every ninety-seventh customer, so that references dangle."""
    n = F.substring("handle", 2, 20).try_cast("long")
    gone = (F.col("kind").isin("Place") & (n % 50 == 0)) | (F.col("kind").isin("Person") & (n % 97 == 0))
    return nodes(spark, d).filter(~F.coalesce(gone, F.lit(False)))


_KNOWN = "known AS (SELECT * FROM nodes WHERE NOT coalesce((kind = 'Place' AND TRY_CAST(substr(handle, 2) AS BIGINT) % 50 = 0) OR (kind = 'Person' AND TRY_CAST(substr(handle, 2) AS BIGINT) % 97 = 0), false))"


@query(f"""WITH {GRAPH}, {_KNOWN}, ends AS (SELECT source AS h FROM edges UNION SELECT target FROM edges)
    SELECT k.kind AS metric, count(n.handle) AS value FROM {_KIND_ROWS} LEFT JOIN known n ON n.kind = k.kind GROUP BY k.kind
    UNION ALL SELECT 'dangling_refs', count(*) FROM ends WHERE h NOT IN (SELECT handle FROM known)
    UNION ALL SELECT 'people_not_in_family', count(*) FROM known WHERE kind = 'Person' AND handle NOT IN (SELECT target FROM edges WHERE edge_type = 'FamilyFather')""")
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    known, e = _known(spark, d), edges(spark, d)
    rows = stats.count_by_kind(known).select(F.col("kind").alias("metric"), F.col("n").alias("value"))
    loose = stats.dangling(e, known).agg(F.lit("dangling_refs").alias("metric"), F.count("*").alias("value"))
    member = e.filter("edge_type = 'FamilyFather'").select(F.col("target").alias("handle"))
    lone = stats.not_in_family(graph.nodes_by_kind(known, "Person"), member).agg(F.lit("people_not_in_family").alias("metric"), F.count("*").alias("value"))
    return rows.unionByName(loose.select("metric", "value")).unionByName(lone.select("metric", "value"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer as father and their suppliers as children."""
    kids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(_key("S", "l_suppkey")).alias("kids"))
    o = table(spark, d, "orders").join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(_key("O", "o_orderkey").alias("handle"), _key("C", "o_custkey").alias("father_handle"), F.lit(None).cast("string").alias("mother_handle"), F.coalesce("kids", F.array().cast("array<string>")).alias("child_handles"))


@query("""WITH s AS (SELECT o_orderkey, 1 + count(DISTINCT l_suppkey) AS size FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
    SELECT size, count(*) AS n FROM s GROUP BY size""")
def family_size_hist(spark: SparkSession, d: str) -> DataFrame:
    size = stats.family_size(F.array("father_handle", "mother_handle"), F.col("child_handles")).cast("long")
    return stats.histogram(_families(spark, d).select(size.alias("size")), "size", "n")


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    scratch = Scratch(spark, "forest")
    f = scratch.save(forest(spark, d))
    links = scratch.save(kin(f))
    comp = graph.connected_components(f, links.select(F.col("source").alias("a"), F.col("target").alias("b")), scratch)
    return f, links, comp, scratch


@query(f"WITH RECURSIVE {FOREST}, {REACH}, s AS (SELECT component, count(*) AS size FROM comp GROUP BY component) SELECT size, count(*) AS n FROM s GROUP BY size")
def group_size_hist(spark: SparkSession, d: str) -> DataFrame:
    comp = _groups(spark, d)[2]
    return stats.histogram(comp.groupBy("component").agg(F.count("*").alias("size")), "size", "n")


@query(f"""WITH RECURSIVE {FOREST}, {REACH}, {DEPTH}, g AS (SELECT component, count(*) AS size, max(generation) + 1 AS span FROM comp JOIN gen USING (handle) GROUP BY component)
    SELECT size, span, count(*) AS n FROM g GROUP BY CUBE (size, span)""")
def generation_table(spark: SparkSession, d: str) -> DataFrame:
    f, links, comp, scratch = _groups(spark, d)
    return stats.generation_table(stats.groups(comp, graph.generations(f, parents(links), scratch)))


# ------------------------------------------------------------------------- graph operators


@query(f"WITH RECURSIVE {FOREST}, {REACH} SELECT handle, component, dense_rank() OVER (ORDER BY component) - 1 AS group_id FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    comp = _groups(spark, d)[2]
    # Dense ids: the roots alone are ranked, one row a component.
    ids, _ = numbered(comp.select("component").distinct(), ["component"], Scratch(spark, "ranks"), "group_id")
    return comp.join(ids, "component").select("handle", "component", "group_id")


@query(f"WITH RECURSIVE {FOREST}, {DEPTH} SELECT handle, generation FROM gen")
def generations(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "generations")
    f = scratch.save(forest(spark, d))
    return graph.generations(f, parents(kin(f)), scratch).select("handle", F.col("generation").cast("long").alias("generation"))


@query(f"""WITH RECURSIVE {FOREST}, {REACH}, one AS (SELECT handle FROM f WHERE pos = 1 AND size % 10 = 0 AND size IN (SELECT size FROM f WHERE pos = 2))
    SELECT DISTINCT component FROM comp JOIN one USING (handle)""")
def cycle_components(spark: SparkSession, d: str) -> DataFrame:
    """With the second part of every tenth size made a parent of the first, its own parent."""
    f, links, comp, scratch = _groups(spark, d)
    at = lambda n, c: f.filter(f"pos = {n} and size % 10 = 0").select("size", F.col("handle").alias(c))
    back = at(2, "parent").join(at(1, "child"), "size").select("parent", "child")
    return graph.cyclic_components(comp, parents(links).unionByName(back), scratch)


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, "kinship")
    return scratch.save(kin(forest(spark, d))), scratch


_CLOSE = "up AS (SELECT target AS handle, source AS other FROM pc), c AS (SELECT * FROM {0} UNION SELECT c.handle, s.other FROM c JOIN {0} s ON c.other = s.handle)"


@query(f"WITH RECURSIVE {FOREST}, {_CLOSE.format('up')} SELECT handle, other FROM c")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return kinship.ancestors(*_links(spark, d))


@query(f"WITH RECURSIVE {FOREST}, dn AS (SELECT source AS handle, target AS other FROM pc), {_CLOSE.format('dn')} SELECT handle, other FROM c")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    return kinship.descendants(*_links(spark, d))


_NEAR = """p AS (SELECT target AS handle, source AS other FROM pc), ch AS (SELECT source AS handle, target AS other FROM pc),
    s AS (SELECT source AS handle, target AS other FROM sp UNION SELECT target, source FROM sp),
    sib AS (SELECT DISTINCT a.handle, b.handle AS other FROM p a JOIN p b ON a.other = b.other AND a.handle <> b.handle),
    one AS (SELECT * FROM p UNION SELECT * FROM ch UNION SELECT * FROM s), near AS (SELECT * FROM one UNION SELECT * FROM sib)"""


@query(f"WITH {FOREST}, {_NEAR} SELECT handle, other FROM sib")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    return kinship.siblings_of(_links(spark, d)[0])


@query(f"WITH {FOREST}, {_NEAR} SELECT handle, other FROM one")
def first_degree(spark: SparkSession, d: str) -> DataFrame:
    return kinship.first_degree(_links(spark, d)[0])


@query(f"WITH {FOREST}, {_NEAR} SELECT handle, other FROM near UNION SELECT a.handle, b.other FROM near a JOIN near b ON a.other = b.handle WHERE a.handle <> b.other")
def second_degree(spark: SparkSession, d: str) -> DataFrame:
    return kinship.second_degree(_links(spark, d)[0])


@query(f"WITH {FOREST}, {_NEAR} SELECT handle, other FROM near")
def neighbors_union(spark: SparkSession, d: str) -> DataFrame:
    return kinship.neighbors_of(_links(spark, d)[0])


@query("SELECT source, target, link_type FROM (SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, 'ParentChild' AS link_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL")
def spouse_parent_links(spark: SparkSession, d: str) -> DataFrame:
    people = nodes(spark, d).filter(F.col("kind").isin("Person", "Source"))
    return graph.undirected(graph.links(_families(spark, d), people))


@query("SELECT 'C' || c_custkey AS handle FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0 EXCEPT SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0 EXCEPT SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0")
def selection_invert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    selected, visible = c.filter("c_custkey % 7 = 0").select(_key("C", "c_custkey").alias("handle")), c.filter("c_custkey % 5 <> 0").select(_key("C", "c_custkey").alias("handle"))
    return kinship.selection_invert(selected, visible)


@query(f"""WITH RECURSIVE {FOREST}, {DEPTH}, y AS (SELECT f.handle, g.generation AS g, CASE WHEN k % 3 = 0 THEN 1900 + k % 50 END AS year FROM f JOIN gen g USING (handle)),
    und AS (SELECT source AS a, target AS b FROM links UNION SELECT target, source FROM links),
    bfs AS (SELECT handle, handle AS origin, 0 AS dist FROM y WHERE year IS NOT NULL
        UNION SELECT u.b, bfs.origin, bfs.dist + 1 FROM bfs JOIN und u ON bfs.handle = u.a JOIN y ON y.handle = u.b WHERE y.year IS NULL AND bfs.dist < 8),
    near AS (SELECT handle, min(dist) AS dist FROM bfs GROUP BY handle),
    v AS (SELECT t.handle, sum(s.year + (t.g - s.g) * 25) AS total, count(*) AS n FROM bfs JOIN near USING (handle, dist) JOIN y t ON t.handle = bfs.handle JOIN y s ON s.handle = bfs.origin WHERE t.year IS NULL GROUP BY t.handle)
    SELECT y.handle, y.year::INT AS year, coalesce(y.year, total // n)::INT AS imputed_year, y.year IS NULL AND n IS NOT NULL AS is_imputed FROM y LEFT JOIN v USING (handle)""")
def impute_years(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "impute")
    f = scratch.save(forest(spark, d))
    links = scratch.save(kin(f))
    return impute.impute_years(f, links, graph.generations(f, parents(links), scratch), scratch)


# ------------------------------------------------------------------- cascade and manifest

_CASCADE = f"""{GRAPH}, seed AS (SELECT 'C' || c_custkey AS handle FROM customer WHERE c_custkey % 20 <> 0),
    g1 AS (SELECT DISTINCT source AS handle FROM edges e WHERE edge_type = 'FamilyFather' AND target IN (SELECT handle FROM seed)
        AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.edge_type = 'FamilyFather' AND x.source = e.source AND x.target NOT IN (SELECT handle FROM seed))),
    g2 AS (SELECT target AS handle FROM edges WHERE edge_type = 'FamilyEventRef' GROUP BY target HAVING bool_and(source IN (SELECT handle FROM g1))),
    g3 AS (SELECT target AS handle, edge_type FROM edges WHERE edge_type IN ('EventPlace', 'EventCitation') GROUP BY target, edge_type HAVING bool_and(source IN (SELECT handle FROM g2))),
    g4 AS (SELECT target AS handle FROM edges WHERE edge_type = 'CitationSource' GROUP BY target HAVING bool_and(source IN (SELECT handle FROM g3))),
    g5 AS (SELECT target AS handle FROM edges WHERE edge_type = 'SourceRepoRef' GROUP BY target HAVING bool_and(source IN (SELECT handle FROM g4))),
    gone AS (SELECT handle, 'Person' AS kind FROM seed UNION ALL SELECT handle, 'Family' FROM g1 UNION ALL SELECT handle, 'Event' FROM g2
        UNION ALL SELECT handle, CASE edge_type WHEN 'EventPlace' THEN 'Place' ELSE 'Citation' END FROM g3 UNION ALL SELECT handle, 'Source' FROM g4 UNION ALL SELECT handle, 'Repository' FROM g5)"""


def _gone(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "cascade")
    seeds = table(spark, d, "customer").filter("c_custkey % 20 <> 0").select(_key("C", "c_custkey").alias("handle"))
    return cascade.cascade(scratch.save(nodes(spark, d)), scratch.save(edges(spark, d)), seeds, scratch)


@query(f"WITH {_CASCADE} SELECT handle, kind FROM gone")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return _gone(spark, d).select("handle", "kind")


_TYPE = "CASE kind WHEN 'Person' THEN 'people' WHEN 'Family' THEN 'families' WHEN 'Event' THEN 'events' WHEN 'Place' THEN 'places' WHEN 'Citation' THEN 'citations' WHEN 'Source' THEN 'sources' ELSE 'repositories' END"


@query(f"WITH {_CASCADE} SELECT {_TYPE} AS type, count(*) AS n, min(handle) AS first_handle, max(handle) AS last_handle FROM gone GROUP BY 1")
def manifest_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = cascade.entries(_gone(spark, d))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min("handle").alias("first_handle"), F.max("handle").alias("last_handle"))


@query(f"""WITH {_CASCADE} SELECT {_TYPE} AS type, CASE WHEN kind = 'Person' AND TRY_CAST(substr(handle, 2) AS BIGINT) % 10 = 1 THEN 'pending' ELSE 'deleted' END AS status, count(*) AS n FROM gone GROUP BY 1, 2""")
def reconcile_status(spark: SparkSession, d: str) -> DataFrame:
    alive = table(spark, d, "customer").filter("c_custkey % 20 <> 0 and c_custkey % 10 = 1").select(_key("C", "c_custkey").alias("handle"))
    return cascade.reconcile(cascade.entries(_gone(spark, d)), alive).groupBy("type", "status").agg(F.count("*").alias("n"))


@query("SELECT '_O' || o_orderkey AS handle, o_orderstatus FROM orders WHERE o_custkey % 3 <> 0")
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return cascade.clean(o.select(_key("_O", "o_orderkey").alias("handle"), "o_orderstatus"), o.filter("o_custkey % 3 = 0").select(_key("O", "o_orderkey").alias("handle")))


@query("SELECT count(DISTINCT c_custkey) AS selected, count(DISTINCT c_custkey) FILTER (c_custkey % 3 <> 0) AS found, round(count(DISTINCT c_custkey) FILTER (c_custkey % 3 <> 0) / count(DISTINCT c_custkey), 6) AS ratio, 'ok' AS level FROM customer WHERE c_custkey % 7 = 0")
def selection_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seeds = c.filter("c_custkey % 7 = 0").select(_key("C", "c_custkey").alias("handle"))
    known = c.filter("c_custkey % 3 <> 0").select(_key("C", "c_custkey").alias("handle"))
    return cascade.coverage(seeds, known).withColumn("ratio", F.round("ratio", 6))


# ------------------------------------------------------------------------------ validation


@query("""SELECT 'MissingRequired' AS error_kind, 'Person' AS kind, 'C' || c_custkey AS handle, 'gender' AS field FROM customer WHERE c_custkey % 9 = 0
    UNION ALL SELECT 'MissingRequired', 'Person', 'C' || c_custkey, 'primary_name' FROM customer WHERE c_custkey % 11 = 0""")
def validate_required(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, d, "customer").select(_key("C", "c_custkey").alias("handle"), F.when(k % 9 != 0, (k % 2).cast("int")).alias("gender"), F.when(k % 11 != 0, F.col("c_name")).alias("given_name"), F.lit("").alias("surname"))
    return validate.missing_required(people, "Person")


@query("""WITH s AS (SELECT o_orderkey, count(DISTINCT l_suppkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT 'CardinalityViolation' AS error_kind, 'Family' AS kind, 'O' || o_orderkey AS handle, 'child_handles' AS field, n FROM s WHERE n < 1 OR n > 5""")
def validate_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return validate.cardinality(_families(spark, d), "Family", {"child_handles": (1, 5)}).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {GRAPH}, {_KNOWN} SELECT 'DanglingReference' AS error_kind, edge_type, source, target, CASE WHEN source NOT IN (SELECT handle FROM known) THEN source ELSE target END AS missing
    FROM edges WHERE source NOT IN (SELECT handle FROM known) OR target NOT IN (SELECT handle FROM known)""")
def validate_dangling(spark: SparkSession, d: str) -> DataFrame:
    return validate.dangling_references(edges(spark, d), _known(spark, d))


@query("SELECT 'L' || l_orderkey || '-' || l_linenumber AS handle, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def validate_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicate_handles(table(spark, d, "lineitem").select(_key("L", "l_orderkey", "l_linenumber").alias("handle")))


# ------------------------------------------------------------------------------------ diff

_ORDER_FIELDS = {"priority": compare.TEXT, "status": compare.ENUM, "total": compare.NUMBER, "customer": compare.HANDLE}
_PERSON_FIELDS = {"name": compare.TEXT, "segment": compare.ENUM}


def _sides(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict]:
    """Orders and customers, and an edited copy: rows dropped, handles renamed, fields changed."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k, ck, oc = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_custkey")
    order = lambda df, handle, who, prio, total: df.select(handle.alias("handle"), prio.alias("priority"), F.col("o_orderstatus").alias("status"), total.alias("total"), who.alias("customer"), F.col("o_custkey").alias("ck"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    renamed = lambda n: F.when(n % 5 == 0, F.concat(F.lit("D"), n.cast("string"))).otherwise(F.concat(F.lit("C"), n.cast("string")))
    whole = F.round("o_totalprice", 0).cast("long")
    a = {"Person": c.select(_key("C", "c_custkey").alias("handle"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "Family": order(o, _key("O", "o_orderkey"), _key("C", "o_custkey"), F.col("o_orderpriority"), whole)}
    b = {
        "Person": c.select(renamed(ck).alias("handle"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "Family": order(o.filter(k % 17 != 0), F.when(k % 13 == 0, _key("R", "o_orderkey")).otherwise(_key("O", "o_orderkey")), renamed(oc), F.when(k % 11 == 0, F.concat("o_orderpriority", F.lit(" late"))).otherwise(F.col("o_orderpriority")), F.when(k % 7 == 0, whole + 1).otherwise(whole)),
    }
    keys = {"Person": text.normalize_key(F.col("name")), "Family": text.normalize_key(F.col("ck"), F.col("day"), F.col("priority"))}
    return a, b, keys


def _diff(spark: SparkSession, d: str) -> tuple[DataFrame, match.Match]:
    a, b, keys = _sides(spark, d)
    return match.diff(a, b, {"Person": _PERSON_FIELDS, "Family": _ORDER_FIELDS}, keys)


_DIFF = """
    a AS (SELECT 'Person' AS kind, 'C' || c_custkey AS h, lower(trim(c_name)) AS key, c_custkey AS k FROM customer
        UNION ALL SELECT 'Family', 'O' || o_orderkey, lower(o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority), o_orderkey FROM orders),
    b AS (SELECT 'Person' AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'D' ELSE 'C' END || c_custkey AS h, lower(trim(c_name)) AS key, c_custkey AS k FROM customer
        UNION ALL SELECT 'Family', CASE WHEN o_orderkey % 13 = 0 THEN 'R' ELSE 'O' END || o_orderkey, lower(o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN ' late' ELSE '' END), o_orderkey FROM orders WHERE o_orderkey % 17 <> 0),
    la AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kind = a.kind AND b.h = a.h)),
    lb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kind = b.kind AND a.h = b.h)),
    ga AS (SELECT kind, key, count(*) AS n, min(h) AS h FROM la GROUP BY kind, key), gb AS (SELECT kind, key, min(h) AS h FROM lb GROUP BY kind, key),
    amb AS (SELECT ga.kind, ga.key, gb.h FROM ga JOIN gb USING (kind, key) WHERE n > 1),
    pairs AS (SELECT a.kind, a.h AS handle_a, b.h AS handle_b, 1.0::DOUBLE AS confidence FROM a JOIN b ON a.kind = b.kind AND a.h = b.h
        UNION ALL SELECT ga.kind, ga.h, gb.h, 0.9::DOUBLE FROM ga JOIN gb USING (kind, key) WHERE n = 1),
    una AS (SELECT kind, h FROM la WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.kind = la.kind AND p.handle_a = la.h) AND NOT EXISTS (SELECT 1 FROM amb WHERE amb.kind = la.kind AND amb.key = la.key)),
    unb AS (SELECT kind, h FROM lb WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.kind = lb.kind AND p.handle_b = lb.h) AND NOT EXISTS (SELECT 1 FROM amb WHERE amb.kind = lb.kind AND amb.key = lb.key)),
    ra AS (SELECT 'O' || o_orderkey AS h, o_orderpriority AS prio, round(o_totalprice)::BIGINT AS total, 'C' || o_custkey AS who, o_orderstatus AS st FROM orders),
    rb AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'R' ELSE 'O' END || o_orderkey AS h, o_orderpriority || CASE WHEN o_orderkey % 11 = 0 THEN ' late' ELSE '' END AS prio, round(o_totalprice)::BIGINT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN o_custkey % 5 = 0 THEN 'D' ELSE 'C' END || o_custkey AS who, o_orderstatus AS st FROM orders WHERE o_orderkey % 17 <> 0),
    m AS (SELECT handle_a, handle_b, ra.prio AS pa, rb.prio AS pb, ra.total AS ta, rb.total AS tb, ra.who AS wa, rb.who AS wb, ra.st AS sa, rb.st AS sb FROM pairs JOIN ra ON handle_a = ra.h JOIN rb ON handle_b = rb.h WHERE kind = 'Family'),
    ch AS (SELECT handle_a, handle_b, 'priority' AS field_name, 'Text' AS field_kind, pa AS old_value, pb AS new_value,
            round(list_sum([levenshtein(coalesce(x[i], ''), coalesce(y[i], '')) FOR i IN range(1, 1)]) , 6) AS skip FROM (SELECT *, string_split(pa, ' ') AS x, string_split(pb, ' ') AS y FROM m) WHERE false),
    changes AS (SELECT handle_a, handle_b, 'priority' AS field_name, 'Text' AS field_kind, pa AS old_value, pb AS new_value, round(len(string_split(pa, ' ')) / len(string_split(pb, ' ')), 6) AS similarity FROM m WHERE pa <> pb
        UNION ALL SELECT handle_a, handle_b, 'status', 'Enum', sa, sb, 0 FROM m WHERE sa <> sb
        UNION ALL SELECT handle_a, handle_b, 'total', 'Numeric', ta::VARCHAR, tb::VARCHAR, 0 FROM m WHERE ta <> tb
        UNION ALL SELECT handle_a, handle_b, 'customer', 'HandleRef', wa, wb, 0 FROM m WHERE wa <> wb),
    cls AS (SELECT p.kind, p.handle_a, p.handle_b, p.confidence, CASE WHEN n IS NULL THEN 'Same' WHEN fit THEN 'ExtrinsicOnly' ELSE 'Modified' END AS classification
        FROM pairs p LEFT JOIN (SELECT c.handle_a, c.handle_b, count(*) AS n, bool_and(c.field_kind = 'HandleRef' AND q.handle_a IS NOT NULL) AS fit
            FROM changes c LEFT JOIN pairs q ON q.handle_b = c.new_value AND q.handle_a = c.old_value GROUP BY 1, 2) x ON p.kind = 'Family' AND x.handle_a = p.handle_a AND x.handle_b = p.handle_b
        UNION ALL SELECT kind, h, NULL, 1.0, 'Removed' FROM una UNION ALL SELECT kind, NULL, h, 1.0, 'Added' FROM unb)"""
# The list comprehension of ``ch`` is not needed: appending one word leaves the others equal.
_DIFF = _DIFF[: _DIFF.index("    ch AS")] + _DIFF[_DIFF.index("    changes AS") :]


@query(f"WITH {_DIFF} SELECT kind, handle_a, handle_b, confidence FROM pairs")
def diff_match(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)[1].pairs


@query(f"WITH {_DIFF} SELECT handle_a, handle_b, field_name, field_kind, old_value, new_value, similarity::DOUBLE AS similarity FROM changes")
def diff_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = match.report_rows(_diff(spark, d)[0]).filter("field_name is not null")
    return rows.select("handle_a", "handle_b", "field_name", "field_kind", "old_value", "new_value", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_DIFF} SELECT kind, handle_a, handle_b, confidence, classification FROM cls")
def diff_extrinsic(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)[0].select("kind", "handle_a", "handle_b", "confidence", "classification")


@query(f"""WITH {_DIFF} SELECT count(*) AS total, count(*) FILTER (classification = 'Same') AS same, count(*) FILTER (classification = 'Modified') AS modified, count(*) FILTER (classification = 'Added') AS added,
    count(*) FILTER (classification = 'Removed') AS removed, 0::BIGINT AS needs_review, count(*) FILTER (classification = 'ExtrinsicOnly') AS extrinsic_only FROM cls""")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return match.summary(_diff(spark, d)[0])


_TWINS = "x AS (SELECT kind, h, key FROM (SELECT 'Place' AS kind, 'P' || p_partkey AS h, lower(p_name || '|' || p_brand) AS key, p_partkey AS k FROM part)), y AS (SELECT 'Place' AS kind, 'Q' || p_partkey AS h, lower(p_name || '|' || p_brand) AS key FROM part WHERE p_partkey % 3 = 0)"


@query(f"""WITH {_TWINS}, gx AS (SELECT key, count(*) AS n, list_sort(list(h)) AS group_a FROM x GROUP BY key), gy AS (SELECT key, min(h) AS handle_b FROM y GROUP BY key)
    SELECT 'Place' AS kind, key AS strong_key, handle_b, array_to_string(group_a, ',') AS group_a FROM gx JOIN gy USING (key) WHERE n > 1""")
def diff_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    side = lambda df, prefix: df.select(F.lit("Place").alias("kind"), _key(prefix, "p_partkey").alias("handle"), text.normalize_key(F.col("p_name"), F.col("p_brand")).alias("strong_key"))
    found = match.match(side(p, "P"), side(p.filter("p_partkey % 3 = 0"), "Q")).ambiguous
    return found.select("kind", "strong_key", "handle_b", F.array_join("group_a", ",").alias("group_a"))


@query(f"""WITH {_DIFF}, sel AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'X' END || c_custkey AS handle, c_name AS name FROM customer WHERE c_custkey % 7 = 0),
    r AS (SELECT classification, handle_a, handle_b, sa.name AS na, sb.name AS nb, coalesce(sa.handle, sb.handle) AS used, CASE WHEN sa.handle IS NOT NULL THEN 'a' WHEN sb.handle IS NOT NULL THEN 'b' ELSE '' END AS side
        FROM cls LEFT JOIN sel sa ON sa.handle = handle_a LEFT JOIN sel sb ON sb.handle = handle_b WHERE kind = 'Person')
    SELECT classification, handle_a, handle_b, side, CASE WHEN side = '' THEN 'diff_only' ELSE 'matched' END AS row_kind, coalesce(na, nb) AS viz_name FROM r
    UNION ALL SELECT '', NULL, NULL, '', 'viz_only', name FROM sel WHERE handle NOT IN (SELECT used FROM r WHERE used IS NOT NULL)""")
def integrate_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = match.report_rows(_diff(spark, d)[0])
    none = F.lit(None).cast("string")
    report = rows.select(*((F.col(c) if c in rows.columns else none).alias(c) for c in integrate.REPORT))
    k = F.col("c_custkey")
    chosen = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(
        F.concat(F.when(k % 2 == 0, "C").otherwise("X"), k.cast("string")).alias("handle"), F.col("c_name").alias("name"),
        none.alias("birth_date"), none.alias("death_date"), F.lit("unknown").alias("gender"), F.lit(0).cast("long").alias("family_group"),
    )
    return integrate.integrate(report, chosen).select("classification", "handle_a", "handle_b", "side", "row_kind", "viz_name")


@query("""WITH r AS (SELECT o_custkey, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos, 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS event
        FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3, 4) ON o_orderkey = l_orderkey)
    SELECT 'C' || o_custkey AS handle, arg_min(event, pos) AS event FROM r WHERE l_returnflag = 'R' GROUP BY 1""")
def event_ref_first_birth(spark: SparkSession, d: str) -> DataFrame:
    """The first returned line of each customer, in order of its references."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_returnflag").alias("event_type"))
    line = line.withColumn("handle", _key("L", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("value", F.col("handle"))
    refs = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(_key("C", "o_custkey").alias("handle"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("handle").alias("event"))
    return match.first_of_type(refs, line, "R", "value").select("handle", F.col("value").alias("event"))


# ----------------------------------------------------------------------- column functions

_WORDS = "string_split_regex(trim(p_name), '\\s+')"


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents")
def text_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.collapse_whitespace(F.col("text")).alias("v"))


@query("SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') AS v FROM pages")
def text_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.strip_html_tags(F.col("html")).alias("v"))


@query("SELECT s_suppkey, 'Main Street, ' || s_suppkey || ' Oak Avenue. Stone Road Drive' || CASE WHEN s_suppkey % 2 = 0 THEN ' Highway' ELSE ' Stave' END AS v FROM supplier")
def text_street(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Main St, "), F.col("s_suppkey").cast("string"), F.lit(" Oak AVE. Stone rd Dr"), F.when(F.col("s_suppkey") % 2 == 0, " hwy").otherwise(" Stave"))
    return table(spark, d, "supplier").select("s_suppkey", text.expand_street_abbreviations(raw).alias("v"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'P. ' || p_size ELSE p_size::VARCHAR END AS v FROM part")
def text_page(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.concat(F.when(k == 0, "p. ").when(k == 1, " pp. ").when(k == 2, "PAGES ").otherwise("P. "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.strip_page_prefix(raw).alias("v"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#808080' ELSE n_name END AS v FROM nation")
def text_color(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select("n_nationkey", text.normalize_tag_color(F.when(k == 0, " Red ").when(k == 1, "GREY").otherwise(F.col("n_name"))).alias("v"))


_PLAIN_FROM = "".join(text.PLAIN)
_PLAIN_TO = "".join(v * len(k) for k, v in text.PLAIN.items())


@query(f"SELECT doc_id, md5(translate(text, '{_PLAIN_FROM}', '{_PLAIN_TO}')) AS v FROM documents")
def text_diacritic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.without_diacritics(F.col("text"))).alias("v"))


_PAIR = "(SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("x")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("y")), "p_partkey")


@query(f"SELECT p_partkey, round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) AS v FROM {_PAIR}")
def sim_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("p_partkey", F.round(text.levenshtein(F.col("x"), F.col("y")), 6).alias("v"))


@query(f"""WITH t AS (SELECT p_partkey, list_distinct(string_split(x, ' ')) AS a, list_distinct(string_split(y, ' ')) AS b FROM {_PAIR})
    SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS v FROM t""")
def sim_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("p_partkey", F.round(text.token_jaccard(F.col("x"), F.col("y")), 6).alias("v"))


@query(f"""WITH t AS (SELECT p_partkey, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM {_PAIR}), i AS (SELECT p_partkey, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM t),
    w AS (SELECT p_partkey, coalesce(a[i], '') AS p, coalesce(b[i], '') AS q FROM i)
    SELECT p_partkey, round(avg(CASE WHEN greatest(length(p), length(q)) = 0 THEN 1 ELSE 1 - levenshtein(p, q) / greatest(length(p), length(q)) END), 6) AS v FROM w GROUP BY p_partkey""")
def sim_tokenized(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("p_partkey", F.round(text.tokenized_levenshtein(F.col("x"), F.col("y")), 6).alias("v"))


def _date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole, partial, wordy and invalid dates by order key."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 5 == 0, F.date_format(day, "yyyy")).when(k % 5 == 1, F.date_format(day, "yyyy-MM")).when(k % 5 == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" or so"))).when(k % 5 == 3, F.lit("unknown")).otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-"), (25 + k % 7).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


_DATES = """dt AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' or so' WHEN 3 THEN 'unknown' ELSE strftime(o_orderdate, '%Y') || '-02-' || (25 + o_orderkey % 7) END AS raw FROM orders),
    pt AS (SELECT o_orderkey, string_split(string_split(raw, ' ')[1], '-') AS s FROM dt),
    pd AS (SELECT o_orderkey, TRY_CAST(s[1] AS INT) AS y, TRY_CAST(s[2] AS INT) AS m, TRY_CAST(s[3] AS INT) AS d FROM pt)"""


@query(f"WITH {_DATES} SELECT o_orderkey, y AS year, m AS month, d AS day FROM pd")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    return _date_texts(spark, d).select("o_orderkey", dates.parse_reported(F.col("raw")).alias("v")).select("o_orderkey", "v.year", "v.month", "v.day")


@query(f"WITH {_DATES} SELECT o_orderkey, coalesce(y BETWEEN 1 AND 9999 AND (m IS NULL OR m BETWEEN 1 AND 12) AND (d IS NULL OR TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL), false) AS valid FROM pd")
def date_valid(spark: SparkSession, d: str) -> DataFrame:
    return _date_texts(spark, d).select("o_orderkey", dates.is_valid(dates.parse_reported(F.col("raw"))).alias("valid"))


@query(f"WITH {_DATES} SELECT o_orderkey, CASE WHEN y IS NULL THEN NULL WHEN m IS NULL THEN 'about ' || printf('%04d', y) WHEN d IS NULL THEN 'about ' || printf('%04d-%02d', y, m) ELSE 'about ' || printf('%04d-%02d-%02d', y, m, d) END AS v FROM pd")
def date_display(spark: SparkSession, d: str) -> DataFrame:
    return _date_texts(spark, d).select("o_orderkey", dates.display_text(dates.parse_reported(F.col("raw"), kind=F.lit("about"))).alias("v"))


@query(f"WITH {_DATES} SELECT o_orderkey, TRY_CAST(string_split(raw, '-')[1] AS INT) AS year FROM dt")
def date_year(spark: SparkSession, d: str) -> DataFrame:
    return _date_texts(spark, d).select("o_orderkey", dates.parse_year(F.col("raw")).alias("year"))


# ------------------------------------------------------------- range joins and adversarial

_AGED = "(SELECT 'C' || c_custkey AS handle, c_custkey AS k, 1900 + c_custkey % 83 AS y FROM customer)"


def _aged(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(_key("C", "c_custkey").alias("handle"), k.alias("k"), (1900 + k % 83).alias("y"))


@query(f"""WITH m AS (SELECT a.handle AS father, b.handle AS mother, row_number() OVER (PARTITION BY a.handle ORDER BY abs(a.y - b.y), b.handle) AS r, count(*) OVER (PARTITION BY a.handle) AS choices
        FROM {_AGED} a JOIN {_AGED} b ON a.k % 2 = 0 AND b.k % 2 = 1 AND b.y BETWEEN a.y - 20 AND a.y + 20 AND a.y + 16 <= b.y + 50)
    SELECT father, mother, choices FROM m WHERE r = 1""")
def pair_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is a man or a woman, by the parity of the key."""
    p = _aged(spark, d)
    men, women = p.filter("k % 2 = 0").select(F.col("handle").alias("father"), F.col("y").alias("fy")), p.filter("k % 2 = 1").select(F.col("handle").alias("mother"), F.col("y").alias("my"))
    # Years meet, not people: of each year the first woman and the number of them.
    first = women.groupBy("my").agg(F.min("mother").alias("mother"), F.count("*").alias("n"))
    met = generate.range_join(men.select("fy").distinct(), first, "my", F.col("fy") - 20, F.col("fy") + 20, 40).filter("fy + 16 <= my + 50")
    best = met.groupBy("fy").agg(F.min(F.struct(F.abs(F.col("fy") - F.col("my")).alias("gap"), "mother")).alias("x"), F.sum("n").alias("choices"))
    return men.join(best, "fy").select("father", "x.mother", "choices")


@query(f"""WITH m AS (SELECT a.handle AS mother, b.handle AS child, row_number() OVER (PARTITION BY a.handle ORDER BY b.y, b.handle) AS r FROM {_AGED} a JOIN {_AGED} b ON a.k % 2 = 1 AND b.y > a.y + 16 AND b.y < a.y + 50)
    SELECT mother, child FROM m WHERE r <= 3""")
def child_range_join(spark: SparkSession, d: str) -> DataFrame:
    """The women's first three possible children among all customers."""
    p = _aged(spark, d)
    mothers, young = p.filter("k % 2 = 1").select(F.col("handle").alias("mother"), F.col("y").alias("my")), p.select(F.col("handle").alias("child"), F.col("y").alias("cy"))
    # Years meet, not people: of each year the first three children.
    few = young.withColumn("r", F.row_number().over(Window.partitionBy("cy").orderBy("child"))).filter("r <= 3").drop("r")
    met = generate.range_join(mothers.select("my").distinct(), few, "cy", F.col("my") + 17, F.col("my") + 49, 16)
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("my").orderBy("cy", "child"))).filter("r <= 3")
    return mothers.join(first, "my").select("mother", "child")


_PEOPLE = "p AS (SELECT 'C' || c_custkey AS handle, c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer)"


@query(f"""WITH {_PEOPLE}, e AS (SELECT 'FamilyFather' AS edge_type, 'F' || n_nationkey || '-' || (c_custkey % 50) AS source, 'C' || c_custkey AS target FROM customer JOIN nation ON c_nationkey = n_nationkey),
    mixed AS (SELECT source FROM e JOIN p ON target = handle GROUP BY source HAVING count(DISTINCT (r - 1) % 2) > 1)
    SELECT edge_type, source, target FROM e WHERE source NOT IN (SELECT source FROM mixed)""")
def adversarial_disconnect(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    people = c.select(_key("C", "c_custkey").alias("handle"), "c_custkey")
    e = c.select(F.lit("FamilyFather").alias("edge_type"), F.concat(F.lit("F"), F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 50).cast("string")).alias("source"), _key("C", "c_custkey").alias("target"))
    return generate.disconnect(people, e, Scratch(spark, "ranks"), order="c_custkey")


@query(f"""WITH {GRAPH}, s AS (SELECT *, row_number() OVER (ORDER BY edge_type, source, target) AS r, count(*) OVER () AS n FROM edges WHERE edge_type IN ('CitationSource', 'SourceRepoRef'))
    SELECT edge_type, source, target FROM s WHERE r > ceil(n * 0.25)""")
def adversarial_orphan_refs(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).filter(F.col("edge_type").isin("CitationSource", "SourceRepoRef"))
    return generate.orphan_refs(e, 0.25, Scratch(spark, "ranks"), order=("edge_type", "source", "target"))


@query(f"WITH {_PEOPLE} SELECT handle, (CASE WHEN r <= ceil(n * 0.3) AND k % 3 < 2 THEN 1 - k % 3 ELSE k % 3 END)::INT AS gender FROM p")
def adversarial_swap(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(_key("C", "c_custkey").alias("handle"), "c_custkey", (F.col("c_custkey") % 3).cast("int").alias("gender"))
    return generate.swap_genders(people, 0.3, Scratch(spark, "ranks"), order=("c_custkey",)).select("handle", "gender")


# --------------------------------------------------------- without SQL: checked in tests


@query()
def generate_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by kind of a synthetic graph with a person for each supplier, made denser."""
    scratch = Scratch(spark, "generate")
    g = generate.generate(spark, generate.Config(persons=table(spark, d, "supplier").count(), places=True, citations=True, seed=7), scratch)
    return generate.densify(g, scratch)["nodes"].groupBy("kind").agg(F.count("*").alias("n"))


def _typed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Typed tables of all ten kinds, with references between them, from the driver's."""
    t = lambda n: table(spark, d, n)
    text = lambda c: F.col(c).cast("string")
    none = lambda kind: F.lit(None).cast(kind)
    key = lambda prefix, c: [_key(prefix, c).alias("handle"), F.concat(F.lit("id-"), text(c)).alias("public_id")]
    refs = lambda prefix, c, meta, value: F.array(F.struct(_key(prefix, c).alias("ref"), F.lit(value).alias(meta)))
    attributes, addresses, urls = "array<struct<type:string,value:string>>", "array<struct<street:string,locality:string,city:string,county:string,state:string,country:string,postal:string,phone:string>>", "array<struct<path:string,desc:string,type:string>>"
    lists = {"note_list": None, "tag_list": None, "citation_list": None, "media_list": None}
    listed = lambda **own: [F.coalesce(own.get(c, none("array<string>")), F.array().cast("array<string>")).alias(c) for c in lists]
    attrs = none(attributes).alias("attribute_list")
    c, s, p, n, r = t("customer"), t("supplier"), t("part"), t("nation"), t("region")
    tag = F.array(_key("T", "n_regionkey"))
    return {
        "Person": c.select(*key("C", "c_custkey"), (F.col("c_custkey") % 2).cast("int").alias("gender"), F.lit("Birth").alias("name_type"), F.col("c_name").alias("given_name"), F.col("c_mktsegment").alias("surname"), none("string").alias("suffix"), none("string").alias("title"), none("array<struct<surname:string,prefix:string,primary:boolean,origintype:string>>").alias("surname_list"), none("array<struct<first_name:string,surname:string,suffix:string,title:string,type:string,surname_list:array<struct<surname:string,prefix:string,primary:boolean,origintype:string>>>>").alias("alternate_names"), (1900 + F.col("c_custkey") % 83).cast("string").alias("birth_date"), none("string").alias("death_date"), refs("E", "c_custkey", "role", "Primary").alias("event_ref_list"), none("array<struct<ref:string,relation:string>>").alias("person_ref_list"), attrs, none(addresses).alias("address_list"), none(urls).alias("url_list"), none("array<struct<type:string,status:string,temple:string>>").alias("lds_ord_list"), *listed(note_list=F.array(_key("N", "c_nationkey")))),
        "Family": s.select(*key("F", "s_suppkey"), _key("C", "s_suppkey").alias("father_handle"), none("string").alias("mother_handle"), refs("C", "s_nationkey", "relation", "Adopted").alias("child_ref_list"), none("array<struct<ref:string,role:string>>").alias("event_ref_list"), attrs, *listed()),
        "Event": c.select(*key("E", "c_custkey"), F.lit("Birth").alias("event_type"), dates.date_value((1900 + F.col("c_custkey") % 83).cast("int"), quality=F.lit("Estimated")).alias("date"), _key("P", "c_custkey").alias("place_handle"), F.concat(F.lit("<"), F.col("c_name"), F.lit("> & \"more\"")).alias("description"), attrs, *listed()),
        "Place": p.select(*key("P", "p_partkey"), F.col("p_name").alias("city"), *(none("string").alias(f) for f in ("street", "county", "state", "country", "title")), none("array<string>").alias("alt_names"), F.col("p_brand").alias("code"), *(none("string").alias(f) for f in ("lat", "long")), none("array<struct<ref:string>>").alias("place_ref_list"), attrs, *listed(media_list=F.array(_key("M", "p_size")))),
        "Source": s.select(*key("S", "s_suppkey"), F.col("s_name").alias("title"), *(none("string").alias(f) for f in ("author", "pubinfo", "abbrev")), F.array(F.struct(_key("R", "s_nationkey").alias("ref"), F.lit("7").alias("call_number"), F.lit("Book").alias("media_type"))).alias("reporef_list"), attrs, *listed()),
        "Citation": p.select(*key("K", "p_partkey"), _key("S", "p_size").alias("source_handle"), F.col("p_type").alias("page"), F.lit(2).alias("confidence"), *listed()),
        "Repository": n.select(*key("R", "n_nationkey"), F.col("n_name").alias("name"), F.lit("Archive").alias("type"), none(addresses).alias("address_list"), none(urls).alias("url_list"), *listed(tag_list=tag)),
        "Media": p.select(F.col("p_size")).distinct().select(*key("M", "p_size"), F.concat(text("p_size"), F.lit(".png")).alias("path"), F.lit("image/png").alias("mime_type"), none("string").alias("desc"), none("string").alias("checksum"), attrs, *listed()),
        "Note": n.select(*key("N", "n_nationkey"), F.col("n_name").alias("text"), F.lit(0).alias("format"), F.lit("Research").alias("type"), *listed(tag_list=tag)),
        "Tag": r.select(*key("T", "r_regionkey"), F.col("r_name").alias("name"), F.lit("#ff0000").alias("color"), F.col("r_regionkey").cast("int").alias("priority"), *listed()),
    }


@query("""
    SELECT 'Person' AS kind, 'C' || c_custkey AS handle, 'id-' || c_custkey AS public_id, c_name || '|' || c_mktsegment || '|' || (c_custkey % 2) || '|' || (1900 + c_custkey % 83) AS label, 'PersonEventRef:E' || c_custkey || ':Primary PersonNote:N' || c_nationkey AS refs FROM customer
    UNION ALL SELECT 'Family', 'F' || s_suppkey, 'id-' || s_suppkey, '', 'FamilyChildRef:C' || s_nationkey || ':Adopted FamilyFather:C' || s_suppkey FROM supplier
    UNION ALL SELECT 'Event', 'E' || c_custkey, 'id-' || c_custkey, 'Birth|' || (1900 + c_custkey % 83) || '|Estimated|<' || c_name || '> & "more"', 'EventPlace:P' || c_custkey FROM customer
    UNION ALL SELECT 'Place', 'P' || p_partkey, 'id-' || p_partkey, p_name || '|' || p_brand, 'PlaceMediaRef:M' || p_size FROM part
    UNION ALL SELECT 'Source', 'S' || s_suppkey, 'id-' || s_suppkey, s_name, 'SourceRepoRef:R' || s_nationkey || ':7:Book' FROM supplier
    UNION ALL SELECT 'Citation', 'K' || p_partkey, 'id-' || p_partkey, p_type || '|2', 'CitationSource:S' || p_size FROM part
    UNION ALL SELECT 'Repository', 'R' || n_nationkey, 'id-' || n_nationkey, n_name || '|Archive', 'RepositoryTag:T' || n_regionkey FROM nation
    UNION ALL SELECT 'Media', 'M' || p_size, 'id-' || p_size, p_size || '.png|image/png', '' FROM (SELECT DISTINCT p_size FROM part)
    UNION ALL SELECT 'Note', 'N' || n_nationkey, 'id-' || n_nationkey, n_name || '|0|Research', 'NoteTag:T' || n_regionkey FROM nation
    UNION ALL SELECT 'Tag', 'T' || r_regionkey, 'id-' || r_regionkey, r_name || '|#ff0000|' || r_regionkey, '' FROM region""")
def xml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all ten kinds and their references, written to XML and read again."""
    from ..sources import xml

    scratch = Scratch(spark, "xml")
    path = f"{scratch.top}/file"
    xml.write(_typed(spark, d), path, "urn:example:graph/1.7.2/", "5.2", "2024-01-01")
    t = {kind: scratch.save(rows) for kind, rows in xml.tables(spark, path).items()}  # so that edges of each type don't parse it again
    label = {
        "Person": ["given_name", "surname", "gender", "birth_date"], "Family": [], "Event": ["event_type", "date.year", "date.quality", "description"], "Place": ["city", "code"], "Source": ["title"], "Citation": ["page", "confidence"],
        "Repository": ["name", "type"], "Media": ["path", "mime_type"], "Note": ["text", "format", "type"], "Tag": ["name", "color", "priority"],
    }
    nodes = None
    for kind, rows in t.items():
        part = rows.select(F.lit(kind).alias("kind"), "handle", "public_id", F.concat_ws("|", F.lit(None).cast("string"), *(F.col(c).cast("string") for c in label[kind])).alias("label"))
        nodes = part if nodes is None else nodes.unionByName(part)
    ref = xml.edges_of(t).select(F.col("source").alias("handle"), F.concat_ws(":", "edge_type", "target", "role", "relation", "call_number", "media_type").alias("ref"))
    refs = ref.groupBy("handle").agg(F.array_join(F.sort_array(F.collect_list("ref")), " ").alias("refs"))
    return nodes.join(refs, "handle", "left").select("kind", "handle", "public_id", "label", F.coalesce("refs", F.lit("")).alias("refs"))


#: Customers with orders, and media, notes and tags of both, of each other and of tags.
_NOTED = """
    nodes AS (
        SELECT 'C' || c_custkey AS handle, 'Person' AS kind FROM customer UNION ALL SELECT 'O' || o_orderkey, 'Family' FROM orders UNION ALL SELECT 'E' || o_orderkey, 'Event' FROM orders
        UNION ALL SELECT DISTINCT 'M' || (c_custkey // 2), 'Media' FROM customer UNION ALL SELECT 'N' || o_orderkey, 'Note' FROM orders UNION ALL SELECT DISTINCT 'T' || (c_custkey // 4), 'Tag' FROM customer
    ),
    edges AS (
        SELECT 'FamilyFather' AS edge_type, 'O' || o_orderkey AS source, 'C' || o_custkey AS target FROM orders UNION ALL SELECT 'FamilyEventRef', 'O' || o_orderkey, 'E' || o_orderkey FROM orders
        UNION ALL SELECT 'PersonMediaRef', 'C' || c_custkey, 'M' || (c_custkey // 2) FROM customer UNION ALL SELECT 'FamilyMediaRef', 'O' || o_orderkey, 'M' || (o_custkey // 2) FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT 'EventNote', 'E' || o_orderkey, 'N' || o_orderkey FROM orders UNION ALL SELECT 'PersonNote', 'C' || o_custkey, 'N' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'PersonTag', 'C' || c_custkey, 'T' || (c_custkey // 4) FROM customer UNION ALL SELECT 'NoteTag', 'N' || o_orderkey, 'T' || (o_custkey // 4) FROM orders WHERE o_orderkey % 7 = 0
    )"""


def _noted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    text = lambda prefix, expr: F.concat(F.lit(prefix), F.expr(expr).cast("string"))
    node = lambda df, kind, h: df.select(h.alias("handle"), F.lit(kind).alias("kind"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("edge_type"), a.alias("source"), b.alias("target"))
    who, fam, event, note = text("C", "c_custkey"), text("O", "o_orderkey"), text("E", "o_orderkey"), text("N", "o_orderkey")
    nodes = node(c, "Person", who).unionByName(node(o, "Family", fam)).unionByName(node(o, "Event", event)).unionByName(node(c, "Media", text("M", "c_custkey div 2")).distinct()).unionByName(node(o, "Note", note)).unionByName(node(c, "Tag", text("T", "c_custkey div 4")).distinct())
    father = text("C", "o_custkey")
    parts = [
        edge(o, "FamilyFather", fam, father), edge(o, "FamilyEventRef", fam, event), edge(c, "PersonMediaRef", who, text("M", "c_custkey div 2")), edge(o.filter("o_orderkey % 5 = 0"), "FamilyMediaRef", fam, text("M", "o_custkey div 2")),
        edge(o, "EventNote", event, note), edge(o.filter("o_orderkey % 3 = 0"), "PersonNote", father, note), edge(c, "PersonTag", who, text("T", "c_custkey div 4")), edge(o.filter("o_orderkey % 7 = 0"), "NoteTag", note, text("T", "o_custkey div 4")),
    ]
    edges = parts[0]
    for x in parts[1:]:
        edges = edges.unionByName(x)
    return nodes, edges


@query(f"""WITH {_NOTED},
    p AS (SELECT handle FROM nodes WHERE kind = 'Person' AND substr(handle, 2)::BIGINT % 8 < 5),
    o AS (SELECT source AS handle FROM edges WHERE edge_type = 'FamilyFather' GROUP BY source HAVING bool_and(target IN (SELECT handle FROM p))),
    e AS (SELECT target AS handle FROM edges WHERE edge_type = 'FamilyEventRef' GROUP BY target HAVING bool_and(source IN (SELECT handle FROM o))),
    m AS (SELECT target AS handle FROM edges WHERE edge_type IN ('PersonMediaRef', 'FamilyMediaRef') GROUP BY target HAVING bool_and(source IN (SELECT handle FROM p UNION ALL SELECT handle FROM o))),
    n AS (SELECT target AS handle FROM edges WHERE edge_type IN ('EventNote', 'PersonNote') GROUP BY target HAVING bool_and(source IN (SELECT handle FROM p UNION ALL SELECT handle FROM e))),
    t AS (SELECT target AS handle FROM edges WHERE edge_type IN ('PersonTag', 'NoteTag') GROUP BY target HAVING bool_and(source IN (SELECT handle FROM p UNION ALL SELECT handle FROM n)))
    SELECT 'Person' AS kind, handle FROM p UNION ALL SELECT 'Family', handle FROM o UNION ALL SELECT 'Event', handle FROM e UNION ALL SELECT 'Media', handle FROM m UNION ALL SELECT 'Note', handle FROM n UNION ALL SELECT 'Tag', handle FROM t""")
def cascade_notes(spark: SparkSession, d: str) -> DataFrame:
    """What goes with five of eight customers where media, notes and tags hang on people,
    families, events and notes. Each kind is kept by kinds before it, so SQL goes kind by kind."""
    scratch = Scratch(spark, "cascade")
    nodes, edges = _noted(spark, d)
    seeds = nodes.filter("kind = 'Person' and cast(substr(handle, 2) as bigint) % 8 < 5")
    return cascade.cascade(scratch.save(nodes), scratch.save(edges), seeds, scratch).select("kind", "handle")
