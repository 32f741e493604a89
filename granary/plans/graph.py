"""The relationship graph: safe directions, shortest paths and strict grain proofs."""

from __future__ import annotations

from dataclasses import dataclass

from granary.model import Model, Relationship

MAX_DEPTH = 64


@dataclass(frozen=True)
class Edge:
    relationship: Relationship
    start: str
    end: str
    forward: bool


@dataclass(frozen=True)
class Proof:
    """A path of edges, or why there is none."""

    ok: bool
    edges: tuple[Edge, ...] = ()
    reason: str | None = None
    blocking: str | None = None
    candidates: tuple[str, ...] = ()

    def describe(self) -> list[str]:
        return [e.relationship.name for e in self.edges]


class Graph:
    def __init__(self, model: Model):
        self.model = model
        self.safe: dict[str, list[Edge]] = {}
        self.blocked: dict[str, list[tuple[Edge, str]]] = {}
        for r in model.relationships.values():
            a, b = r.from_entity.upper(), r.to_entity.upper()
            for edge in (Edge(r, a, b, True), Edge(r, b, a, False)):
                why = self._unsafe(edge)
                if why:
                    self.blocked.setdefault(edge.start, []).append((edge, why))
                else:
                    self.safe.setdefault(edge.start, []).append(edge)

    @staticmethod
    def _unsafe(edge: Edge) -> str | None:
        kind = edge.relationship.cardinality
        if kind == "ONE_TO_ONE" or kind == ("MANY_TO_ONE" if edge.forward else "ONE_TO_MANY"):
            return None
        if kind == "MANY_TO_MANY":
            return None if edge.relationship.fanout_policy else "MANY_TO_MANY_REQUIRES_FANOUT"
        return "FANOUT_REQUIRES_POLICY"

    # -- ordinary joins: the shortest safe path, which must be the only one of its length ------------------
    def shortest(self, start: str, end: str) -> Proof:
        start, end = start.upper(), end.upper()
        if start == end:
            return Proof(True)
        level: dict[str, list[tuple[Edge, ...]]] = {start: [()]}
        seen = {start}
        for _ in range(MAX_DEPTH):
            after: dict[str, list[tuple[Edge, ...]]] = {}
            for node, paths in level.items():
                for edge in self.safe.get(node, []):
                    if edge.end not in seen:
                        after.setdefault(edge.end, []).extend((*p, edge) for p in paths)
            if end in after:
                found = sorted(after[end], key=self._signature)
                if len(found) > 1:  # whatever their priorities: those may not hide an ambiguity
                    return Proof(False, reason="AMBIGUOUS_RELATIONSHIP_PATH", candidates=tuple(self._signature(p) for p in found))
                return Proof(True, found[0])
            if not after:
                break
            seen |= set(after)
            level = after
        blocked = self._any_path(start, end)
        return Proof(False, reason="NO_SAFE_JOIN_PATH" if blocked else "NO_RELATIONSHIP_PATH", blocking=blocked)

    @staticmethod
    def _signature(path) -> str:
        return " > ".join(e.relationship.name for e in path)

    def _any_path(self, start: str, end: str) -> str | None:
        """The first unsafe relationship on some path that ignores safety."""
        queue, seen = [(start, None)], {start}
        while queue:
            node, bad = queue.pop(0)
            if node == end:
                return bad
            for edge, why in [(e, None) for e in self.safe.get(node, [])] + self.blocked.get(node, []):
                if edge.end not in seen:
                    seen.add(edge.end)
                    queue.append((edge.end, bad or (f"{edge.relationship.name}: {why}" if why else None)))
        return None

    # -- strict proofs: mapped keys on every edge, and no other path at all --------------------------------
    def key_columns(self, entity: str) -> list[tuple[str, ...]]:
        return [tuple(c.upper() for c in k.columns) for k in self.model.keys_of(entity) if not any(k.expressions)]

    def strict_edge(self, edge: Edge) -> str | None:
        """Why an edge doesn't keep the grain provably, or None."""
        r = edge.relationship
        if r.cardinality == "MANY_TO_MANY":
            return "MANY_TO_MANY_UNSUPPORTED"
        if self._unsafe(edge):
            return "ONE_TO_MANY_ATTRIBUTION_UNSUPPORTED"
        if not r.mappings:
            return "RELATIONSHIP_MAPPING_MISSING"
        if any(m.from_expression or m.to_expression for m in r.mappings):
            return "EXPRESSION_KEY_PROOF_UNSUPPORTED"
        columns = tuple((m.to_column if edge.forward else m.from_column).upper() for m in r.mappings)
        keys = self.key_columns(edge.end)
        if not keys:
            return "RELATIONSHIP_TARGET_NOT_UNIQUE"
        if not any(set(columns) == set(k) for k in keys):
            return "MISMATCHED_UNIQUE_KEY"
        return None

    def strict(self, start: str, end: str) -> Proof:
        start, end = start.upper(), end.upper()
        if start == end:
            return Proof(True)
        paths: list[tuple[Edge, ...]] = []

        def walk(node: str, path: tuple[Edge, ...], seen: frozenset) -> None:
            if len(paths) > 8 or len(path) > MAX_DEPTH:
                return
            if node == end:
                paths.append(path)
                return
            for edge in self.safe.get(node, []):
                if edge.end not in seen:
                    walk(edge.end, (*path, edge), seen | {edge.end})

        walk(start, (), frozenset([start]))
        if not paths:
            blocked = self._any_path(start, end)
            reason = "ONE_TO_MANY_ATTRIBUTION_UNSUPPORTED" if blocked else "DIMENSION_NOT_CONFORMED"
            if blocked and "MANY_TO_MANY" in blocked:
                reason = "MANY_TO_MANY_UNSUPPORTED"
            return Proof(False, reason=reason, blocking=blocked)
        if len(paths) > 1:
            return Proof(False, reason="RELATIONSHIP_PATH_AMBIGUOUS", candidates=tuple(sorted(self._signature(p) for p in paths)))
        for edge in paths[0]:
            why = self.strict_edge(edge)
            if why:
                return Proof(False, edges=paths[0], reason=why, blocking=edge.relationship.name)
        return Proof(True, paths[0])
