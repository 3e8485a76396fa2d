"""Kinship queries over links(source, target, link_type), for all starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

PARENT = "ParentChild"


def parents_of(links: DataFrame) -> DataFrame:
    """(handle, other): other is a parent of handle."""
    return links.filter(F.col("link_type") == PARENT).select(F.col("target").alias("handle"), F.col("source").alias("other")).distinct()


def children_of(links: DataFrame) -> DataFrame:
    return links.filter(F.col("link_type") == PARENT).select(F.col("source").alias("handle"), F.col("target").alias("other")).distinct()


def spouses_of(links: DataFrame) -> DataFrame:
    s = links.filter(F.col("link_type") == "Spouse")
    return s.select(F.col("source").alias("handle"), F.col("target").alias("other")).unionByName(s.select(F.col("target").alias("handle"), F.col("source").alias("other"))).distinct()


def siblings_of(links: DataFrame) -> DataFrame:
    """Pairs that share a parent."""
    p = parents_of(links)
    q = p.select(F.col("handle").alias("sibling"), "other")
    return p.join(q, "other").filter("handle != sibling").select("handle", F.col("sibling").alias("other")).distinct()


def neighbors_of(links: DataFrame) -> DataFrame:
    """Parents, children, spouses and siblings."""
    return parents_of(links).unionByName(children_of(links)).unionByName(spouses_of(links)).unionByName(siblings_of(links)).distinct()


def first_degree(links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Parents, children and spouses."""
    return _from(parents_of(links).unionByName(children_of(links)).unionByName(spouses_of(links)).distinct(), starts)


def second_degree(links: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Within two steps among neighbours, the start left out."""
    one = neighbors_of(links)
    two = _from(one, starts).join(one.select(F.col("handle").alias("other"), F.col("other").alias("next")), "other").select("handle", F.col("next").alias("other"))
    return _from(one, starts).unionByName(two).filter("handle != other").distinct()


def closure(step: DataFrame, scratch: Scratch, starts: DataFrame | None = None) -> DataFrame:
    """(handle, other) for all others that steps reach; the start only through a cycle.

    Each round extends only what the last one found anew.
    """
    step = scratch.save(step)
    found = now = scratch.save(_from(step, starts))
    parts = [now]
    while True:
        new = now.join(step.select(F.col("handle").alias("other"), F.col("other").alias("next")), "other").select("handle", F.col("next").alias("other")).distinct()
        now = scratch.save(new.join(found, ["handle", "other"], "left_anti"))
        if now.isEmpty():
            return found
        parts.append(now)
        found = found.unionByName(now)


def ancestors(links: DataFrame, scratch: Scratch, starts: DataFrame | None = None) -> DataFrame:
    return closure(parents_of(links), scratch, starts)


def descendants(links: DataFrame, scratch: Scratch, starts: DataFrame | None = None) -> DataFrame:
    return closure(children_of(links), scratch, starts)


def _from(pairs: DataFrame, starts: DataFrame | None) -> DataFrame:
    return pairs if starts is None else pairs.join(starts.select("handle").distinct(), "handle", "left_semi")


def select_related(links: DataFrame, mode: str, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """(handle, other) by mode: single, ancestors, descendants, first-degree, second-degree."""
    if mode == "single":
        return starts.select("handle", F.col("handle").alias("other"))
    if mode in ("ancestors", "descendants"):
        return {"ancestors": ancestors, "descendants": descendants}[mode](links, scratch, starts)
    return {"first-degree": first_degree, "second-degree": second_degree}[mode](links, starts)


# Selections are tables of handles.


def selection_add(selected: DataFrame, more: DataFrame) -> DataFrame:
    return selected.union(more).distinct()


def selection_remove(selected: DataFrame, less: DataFrame) -> DataFrame:
    return selected.subtract(less)


def selection_toggle(selected: DataFrame, handles: DataFrame) -> DataFrame:
    return selected.subtract(handles).union(handles.subtract(selected))


def selection_invert(selected: DataFrame, visible: DataFrame) -> DataFrame:
    """Among the visible the others; what is selected but not visible stays."""
    return selection_toggle(selected, visible)


def selection_click(selected: DataFrame, clicked: DataFrame, related: DataFrame) -> DataFrame:
    """Clicking a selected handle takes it and its relatives away, else adds them."""
    group = clicked.union(related).distinct()
    return selected.subtract(group) if not clicked.intersect(selected).isEmpty() else selection_add(selected, group)


def selected_people(handles: DataFrame, persons: DataFrame) -> DataFrame:
    """persons in the order of handles(pos, handle); unknown handles are skipped."""
    return handles.join(persons, "handle").orderBy("pos")
