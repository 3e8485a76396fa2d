"""Graphs put together by hand, for tests and small examples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import EDGE_SCHEMA, EDGES, KINDS, NODE_SCHEMA, Graph


class Builder:
    """Collects nodes and edges, each call giving the builder back; ``build`` checks them.

    Handles that aren't given are counted by kind. An edge may name nodes that come later.
    """

    def __init__(self) -> None:
        self._nodes: dict[str, tuple[str, str, str | None, bool]] = {}
        self._edges: list[tuple] = []
        self.last: str | None = None  #: the handle of the node added last

    def node(self, kind: str, handle: str | None = None, public_id: str | None = None) -> Builder:
        if kind not in KINDS:
            raise ValueError(f"{kind} is no kind")
        handle = handle or f"_{kind.lower()}{sum(k == kind for _, k, _, _ in self._nodes.values()) + 1:04}"
        if handle in self._nodes:
            raise ValueError(f"{handle} is there already")
        self._nodes[handle] = (handle, kind, public_id, False)
        self.last = handle
        return self

    def edge(self, edge_type: str, source: str, target: str, **more: str) -> Builder:
        if edge_type not in EDGES:
            raise ValueError(f"{edge_type} is no edge type")
        wrong = set(more) - {"role", "relation", "call_number", "media_type"}
        if wrong:
            raise ValueError(f"an edge has no {sorted(wrong)}")
        self._edges.append((len(self._edges) + 1, edge_type, source, target, *(more.get(m) for m in ("role", "relation", "call_number", "media_type"))))
        return self

    def family(self, father: str | None = None, mother: str | None = None, children: tuple[str, ...] = (), handle: str | None = None) -> Builder:
        """A family with edges both ways to the people it names."""
        own = self.node("Family", handle).last
        for role, who in (("FamilyFather", father), ("FamilyMother", mother)):
            if who:
                self.edge(role, own, who).edge("PersonFamily", who, own)
        for child in children:
            self.edge("FamilyChildRef", own, child).edge("PersonParentFamily", child, own)
        return self

    def event(self, owner: str, event_type: str = "PersonEventRef", role: str = "Primary", handle: str | None = None) -> Builder:
        own = self.node("Event", handle).last
        return self.edge(event_type, owner, own, role=role)

    def build(self, spark: SparkSession, dangling: str = "error") -> Graph:
        """The graph; an edge to a node that isn't there is an error, or makes an inferred node
        of the kind its type asks for (``dangling="placeholder"``)."""
        if dangling not in ("error", "placeholder"):
            raise ValueError(f"dangling is error or placeholder, not {dangling}")
        nodes = dict(self._nodes)
        for _, kind, source, target, *_ in self._edges:
            if source not in nodes:
                raise ValueError(f"{kind} leaves {source}, which isn't there")
            if target not in nodes:
                if dangling == "error":
                    raise ValueError(f"{kind} leads to {target}, which isn't there")
                nodes[target] = (target, EDGES[kind], None, True)
        return Graph(spark.createDataFrame(list(nodes.values()), NODE_SCHEMA), spark.createDataFrame(self._edges, EDGE_SCHEMA))
