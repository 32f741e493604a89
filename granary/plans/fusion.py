"""Which physical source gives an entity in a request, and how several are combined."""

from __future__ import annotations

from dataclasses import dataclass, field

from granary.errors import SemanticError
from granary.functions.expressions import references, sole_aggregate, substitute, tokenize
from granary.model import Model, Relationship, Representation

_LEVELS = {"AUTHORITATIVE": 0, "PREFER": 1, "SUPPLEMENTAL": 2}


@dataclass
class Chosen:
    """One entity's sources in a request."""

    entity: str
    parts: list[Representation]  # more than one: temporal partitions
    expressions: dict[tuple[str, str, str], str] = field(default_factory=dict)  # (kind, attribute, representation)
    contributors: list[dict] = field(default_factory=list)
    decisions: list[dict] = field(default_factory=list)

    @property
    def partitioned(self) -> bool:
        return len(self.parts) > 1


class Fusion:
    def __init__(self, model: Model, columns_of):
        self.model, self.columns_of = model, columns_of

    def partitioned(self, entity: str) -> bool:
        parts = self.model.sources_of(entity)
        return len(parts) > 1 and all(p.coverage for p in parts)

    def bindings(self, kind: str, attribute: str) -> list:
        return [b for b in self.model.bindings.values() if b.kind == kind and b.attribute.upper() == attribute.upper()]

    def expression(self, kind: str, attribute: str, source: Representation) -> tuple[str, str, int] | None:
        """(expression, role, priority) by which a representation gives an attribute, or None."""
        own = self.bindings(kind, attribute)
        for b in own:
            if b.representation.upper() == source.name.upper():
                return b.expression, b.role, b.priority
        record = self.model.get("dimensions" if kind == "DIMENSION" else "facts", attribute)
        if source.role == "PRIMARY" and not own:
            return record.expression, "PREFER", 0
        return None

    # -- relationship keys -----------------------------------------------------------------------------------
    def endpoint_columns(self, relationship: Relationship, entity: str) -> list[str]:
        """Columns of an entity's side that a relationship needs."""
        alias = self.model.get("entities", entity).alias.upper()
        return list(dict.fromkeys(c for a, c in references(relationship.condition).qualified if a.upper() == alias))

    def remap(self, relationship: Relationship, entity: str, source: Representation) -> tuple[dict[str, str] | None, str | None]:
        """({column: expression} for columns that a source names otherwise, or None), and why not.

        A missing endpoint is replaced by the source's DIRECT identity expression, if the endpoint is a scalar
        unique key and the primary's DIRECT identity is exactly that key.
        """
        have = self.columns_of(source.schema, source.object)
        missing = [c for c in self.endpoint_columns(relationship, entity) if have is not None and c.upper() not in have]
        if not missing:
            return {}, None
        if len(missing) > 1:
            return None, "COMPOSITE_RELATIONSHIP_KEY_UNSUPPORTED"
        column = missing[0]
        if not any(tuple(c.upper() for c in k.columns) == (column.upper(),) for k in self.model.keys_of(entity)):
            return None, "RELATIONSHIP_ENDPOINT_IS_NOT_SCALAR_UNIQUE_KEY"
        primary = self.model.sources_of(entity)[0]
        for identity in self.model.identities.values():
            if identity.entity.upper() != entity.upper():
                continue
            base = self.model.get("identity_bindings", f"{identity.name}.{primary.name}")
            own = self.model.get("identity_bindings", f"{identity.name}.{source.name}")
            if base is None or base.kind != "DIRECT":
                return None, "PRIMARY_IDENTITY_BINDING_NOT_DIRECT"
            if [c.upper() for _, c in references(base.expression).qualified] != [column.upper()] or len(tokenize(base.expression)) != 3:
                return None, "SEMANTIC_IDENTITY_NOT_ANCHORED_TO_RELATIONSHIP_KEY"
            if own is None or own.kind != "DIRECT":
                return None, "REPRESENTATION_IDENTITY_BINDING_NOT_DIRECT"
            return {column.upper(): own.expression}, None
        return None, "SEMANTIC_IDENTITY_REMAP_METADATA_MISSING"

    # -- choice ------------------------------------------------------------------------------------------------
    def choose(self, entity: str, attributes: list[tuple[str, str]], relationships: list[Relationship]) -> Chosen:
        """Sources of an entity for (kind, attribute) pairs on paths over some relationships."""
        sources = self.model.sources_of(entity)
        fused = [a for a in attributes if self.strategy(*a) in ("COALESCE", "RECONCILE")]
        if self.partitioned(entity):
            return self._union(entity, sources, attributes)
        ranked, rejected = [], []
        for k, source in enumerate(sources):
            found = {a: self.expression(*a, source) for a in attributes if a not in fused}
            missing = [a[1] for a, e in found.items() if e is None]
            blocked = next((why for r in relationships for why in [self.remap(r, entity, source)[1]] if why), None)
            if missing or blocked:
                rejected.append({"representation": source.name, "missing": missing, "reason": blocked or "FUSION_BINDING_INCOMPLETE"})
                continue
            fallbacks = sum(e[1] == "FALLBACK" for e in found.values())
            ranked.append(((fallbacks, sum(e[2] for e in found.values()), source.role != "PRIMARY", source.priority, k), source, found))
        if not ranked:
            first = rejected[0] if rejected else {}
            raise SemanticError(
                "SEMANTIC_REQUEST_080",
                f"No representation of {entity} gives {', '.join(first.get('missing') or []) or 'its relationship keys'}; add an attribute binding.",
                "FUSION_BINDING_INCOMPLETE",
                rejected=rejected,
            )
        _, source, found = min(ranked, key=lambda r: r[0])
        out = Chosen(entity, [source])
        for (kind, name), e in found.items():
            out.expressions[kind, name.upper(), source.name] = e[0]
        for kind, name in fused:
            self._combine(out, source, kind, name)
        out.decisions.append({"entity": entity, "representation": source.name, "rejected": rejected, "strategies": {a[1]: self.strategy(*a) for a in fused}})
        return out

    def strategy(self, kind: str, attribute: str) -> str:
        policy = self.model.get("policies", f"{kind}.{attribute}")
        return policy.strategy if policy else "PREFER"

    def _union(self, entity: str, sources: list[Representation], attributes) -> Chosen:
        out = Chosen(entity, sources)
        for kind, name in attributes:
            if self.strategy(kind, name) != "PREFER":
                raise SemanticError("SEMANTIC_REQUEST_080", f"{name} has a fusion policy on the partitioned entity {entity}.", "FUSION_PARTITION_POLICY_CONFLICT")
            for source in sources:
                # A partition without bindings of its own reads the attribute by its default expression only on the primary.
                found = self.expression(kind, name, source)
                if found is None:
                    raise SemanticError(
                        "SEMANTIC_REQUEST_080", f"{name} has no binding on partition {source.name} of {entity}; add an attribute binding.", "FUSION_PARTITION_BINDING_INCOMPLETE"
                    )
                out.expressions[kind, name.upper(), source.name] = found[0]
        out.decisions.append({"entity": entity, "partitions": [s.name for s in sources], "strategy": "UNION"})
        return out

    def contributors(self, entity: str, kind: str, attribute: str) -> list[tuple[Representation, str]]:
        """Sources that give an attribute, most authoritative first, with their expressions."""
        ranked = []
        for k, source in enumerate(self.model.sources_of(entity)):
            found = self.expression(kind, attribute, source)
            if found is None:
                continue
            authority = self.model.get("authorities", f"{entity}.{source.name}")
            level = _LEVELS[authority.level] if authority else _LEVELS["SUPPLEMENTAL"] + 1
            ranked.append(((level, found[1] != "PREFER", found[2], source.priority, k), source, found[0]))
        return [(s, e) for _, s, e in sorted(ranked, key=lambda r: r[0])]

    def _combine(self, out: Chosen, base: Representation, kind: str, attribute: str) -> None:
        """COALESCE over contributors; each but the base is joined on the entity's key under an alias of its own."""
        found = self.contributors(out.entity, kind, attribute)
        if len(found) < 2:
            raise SemanticError("SEMANTIC_REQUEST_080", f"{attribute} needs two contributing representations.", "FUSION_BINDING_INCOMPLETE")
        alias = self.model.get("entities", out.entity).alias
        texts = []
        for source, expression in found:
            if source.name == base.name:
                texts.append(expression)
                continue
            own = f"{alias}__{source.name.lower()}"
            texts.append(substitute(expression, qualified=lambda a, c, own=own: f"{own}.{_quoted(c)}" if a.upper() == alias.upper() else None))
            if not any(c["alias"] == own for c in out.contributors):
                out.contributors.append(self._key_join(out.entity, alias, own, base, source))
        out.expressions[kind, attribute.upper(), base.name] = f"COALESCE({', '.join(texts)})"

    def key_expression(self, entity: str, source: Representation, alias: str) -> tuple[list[str], dict | None]:
        """Expressions of an entity's key in a source read as ``alias``, and a mapping relation to go through."""
        own = self.model.get("entities", entity).alias

        def moved(text: str) -> str:
            return substitute(text, qualified=lambda a, c: f"{alias}.{_quoted(c)}" if a.upper() == own.upper() else None)

        for identity in self.model.identities.values():
            if identity.entity.upper() == entity.upper():
                b = self.model.get("identity_bindings", f"{identity.name}.{source.name}")
                if b is None:
                    continue
                if b.kind == "DIRECT":
                    return [moved(b.expression)], None
                m = self.model.get("mappings", b.mapping)
                if m is None or m.status != "CERTIFIED":
                    raise SemanticError("SEMANTIC_REQUEST_080", f"{source.name} needs a certified mapping relation.", "SEMANTIC_IDENTITY_REMAP_METADATA_MISSING")
                return [moved(b.expression)], {"schema": m.schema, "object": m.object, "source_column": m.source_column, "semantic_column": m.semantic_column}
        keys = sorted((k for k in self.model.keys_of(entity) if not any(k.expressions)), key=lambda k: k.kind != "PRIMARY")
        if not keys:
            raise SemanticError("SEMANTIC_REQUEST_080", f"{entity} has no unique key to join its representations on.", "FUSION_JOIN")
        return [f"{alias}.{_quoted(c)}" for c in keys[0].columns], None

    def _key_join(self, entity: str, alias: str, own: str, base: Representation, source: Representation) -> dict:
        left, left_map = self.key_expression(entity, base, alias)
        right, right_map = self.key_expression(entity, source, own)
        return {"entity": entity, "alias": own, "schema": source.schema, "object": source.object, "left": left, "left_map": left_map, "right": right, "right_map": right_map, "representation": source.name}


def _quoted(column: str) -> str:
    return f"`{column}`"


def is_sum_or_count(expression: str) -> bool:
    whole = sole_aggregate(expression)
    return bool(whole and whole.function in ("SUM", "COUNT") and not whole.distinct)
