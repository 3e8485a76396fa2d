"""What a viewer of a graph asks for: filters, groups, payload checks, the printed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ENUMS, KINDS
from ..scratch import Scratch
from .rank import numbered
from .validate import unknown_values


def in_group(nodes: DataFrame, group_id: int | None) -> DataFrame:
    """The nodes of one family group; all of them without one."""
    return nodes if group_id is None else nodes.filter(F.col("family_group") == group_id)


def in_rectangle(nodes: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The handles of nodes (handle, x, y) inside, borders included, whichever corners are given."""
    inside = F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    return nodes.filter(inside).select("handle")


def family_groups(components: DataFrame, generations: DataFrame, scratch: Scratch) -> DataFrame:
    """(handle, family_group, size, span): groups numbered from 0 by their smallest handle."""
    g = components.join(generations, "handle").groupBy("component").agg(F.count("*").alias("size"), (F.max("generation") + 1).cast("long").alias("span"))
    return components.join(numbered(g, ["component"], scratch, "family_group")[0], "component").select("handle", "family_group", "size", "span")


def payload_errors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(what, value): genders and link types out of their domain, and links without an end."""
    bad = unknown_values(nodes, "gender", ["male", "female", "unknown"]).select(F.lit("gender").alias("what"), F.col("gender").alias("value"))
    kind = unknown_values(links, "link_type", ["Spouse", "ParentChild"]).select(F.lit("link_type").alias("what"), F.col("link_type").alias("value"))
    open_ = links.filter("source is null or target is null").select(F.lit("link").alias("what"), F.coalesce("source", "target").alias("value"))
    return bad.unionByName(kind).unionByName(open_)


def schema_errors(schema: dict) -> list[str]:
    """What is wrong with a schema document: {"kinds": {kind: {"required": [..], "fields":
    {name: {"type": ..}}}}, "enums": {name: [..]}}; empty if nothing is."""
    types = {"string", "integer", "boolean", "number", "handle", "array", "struct", "enum"}
    out = []
    enums = schema.get("enums") or ENUMS
    for kind, spec in (schema.get("kinds") or {}).items():
        if kind not in KINDS:
            out.append(f"{kind}: no such kind")
        fields = spec.get("fields") or {}
        out += [f"{kind}.{f}: required but not a field" for f in spec.get("required", []) if f not in fields]
        for name, field in fields.items():
            if field.get("type") not in types:
                out.append(f"{kind}.{name}: no such type: {field.get('type')}")
            elif field["type"] == "enum" and field.get("of") not in enums:
                out.append(f"{kind}.{name}: no such enum: {field.get('of')}")
    return out if schema.get("kinds") else ["no kinds"]


def stats_text(report: DataFrame) -> str:
    """The statistics report (one row) as text: counts, then sizes by generations with totals."""
    r = report.first()
    rows = [f"{name:<14}{r.counts[name]:>8}" for name in KINDS.values()]
    rows += [f"{'not in family':<14}{r.people_not_in_family:>8}", f"{'dangling refs':<14}{r.dangling_refs:>8}"]
    table = r.family_group_generation_table or {}
    spans = sorted({s for x in table.values() for s in x})
    if spans:
        line = lambda head, cells: f"{head:>6} |" + "".join(f"{c:>6}" for c in cells)
        rows += ["", line("size", [*spans, "total"])]
        rows += [line(size, [table[size].get(s, 0) for s in spans] + [sum(table[size].values())]) for size in sorted(table)]
        rows.append(line("total", [sum(x.get(s, 0) for x in table.values()) for s in spans] + [sum(sum(x.values()) for x in table.values())]))
    return "\n".join([*rows, *(f"warning: {w}" for w in r.warnings)])
