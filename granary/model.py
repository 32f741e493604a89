"""The semantic model: immutable records, and a catalog that changes by copying.

Every change gives a new Model; snapshots and restores are therefore free, and a content hash certifies exactly
the model that was validated.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from granary.errors import SemanticError
from granary.functions.expressions import IDENTIFIER


@dataclass(frozen=True)
class Entity:
    """A node with a grain. Its primary representation is the relation ``schema.object``, read as ``alias``."""

    name: str
    schema: str
    object: str
    alias: str
    primary_key: str | None = None
    grain: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Representation:
    name: str
    entity: str
    schema: str
    object: str
    role: str = "ALTERNATE"
    priority: int = 100
    source_kind: str = "RELATION"
    coverage: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass(frozen=True)
class UniqueKey:
    name: str
    entity: str
    columns: tuple[str, ...]
    kind: str = "PRIMARY"
    expressions: tuple[str | None, ...] = ()


@dataclass(frozen=True)
class KeyMapping:
    from_column: str | None
    to_column: str | None
    from_expression: str | None = None
    to_expression: str | None = None


@dataclass(frozen=True)
class Relationship:
    name: str
    from_entity: str
    to_entity: str
    condition: str
    cardinality: str = "MANY_TO_ONE"
    join_type: str = "LEFT"
    fanout_policy: str | None = None
    path_priority: int = 100
    mappings: tuple[KeyMapping, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    entity: str
    expression: str
    data_type: str | None = None
    display: str | None = None
    description: str | None = None
    format: str | None = None
    certified: bool = False
    is_time: bool = False


@dataclass(frozen=True)
class Fact:
    name: str
    entity: str
    expression: str
    data_type: str | None = None
    policy: str = "ADDITIVE"
    display: str | None = None
    description: str | None = None
    private: bool = False
    certified: bool = False
    non_additive_by: str | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    expression: str
    base_entity: str | None = None
    filter: str | None = None
    metric_type: str = "ADDITIVE"
    kind: str = "SIMPLE"
    data_type: str | None = None
    display: str | None = None
    description: str | None = None
    format: str | None = None
    private: bool = False
    certified: bool = False
    distinct_key: str | None = None
    non_additive_by: str | None = None
    window: str | None = None


@dataclass(frozen=True)
class ObjectColumn:
    kind: str  # DIMENSION, FACT, METRIC
    name: str
    ordinal: int
    visible: bool = True


@dataclass(frozen=True)
class SemanticObject:
    name: str
    root: str
    description: str | None = None
    columns: tuple[ObjectColumn, ...] = ()

    def visible(self, kind: str) -> list[str]:
        return [c.name for c in sorted(self.columns, key=lambda c: c.ordinal) if c.kind == kind and c.visible]


@dataclass(frozen=True)
class Binding:
    """How a representation gives a dimension or fact."""

    entity: str
    kind: str  # DIMENSION, FACT
    attribute: str
    representation: str
    expression: str
    role: str = "PREFER"
    priority: int = 100


@dataclass(frozen=True)
class Authority:
    entity: str
    representation: str
    level: str  # AUTHORITATIVE, PREFER, SUPPLEMENTAL


@dataclass(frozen=True)
class FusionPolicy:
    entity: str
    kind: str
    attribute: str
    strategy: str  # PREFER, COALESCE, RECONCILE


@dataclass(frozen=True)
class Identity:
    name: str
    entity: str
    data_type: str | None = None


@dataclass(frozen=True)
class IdentityBinding:
    identity: str
    representation: str
    expression: str
    kind: str = "DIRECT"  # MAPPED
    mapping: str | None = None


@dataclass(frozen=True)
class MappingRelation:
    name: str
    identity: str
    schema: str
    object: str
    source_column: str
    semantic_column: str
    status: str = "CERTIFIED"


@dataclass(frozen=True)
class MaterializationColumn:
    kind: str  # DIMENSION, METRIC
    name: str
    column: str
    policy: str = "NONE"  # DIRECT, NONE, SUM, MIN, MAX, COUNT


@dataclass(frozen=True)
class Materialization:
    name: str
    schema: str
    object: str
    type: str = "AGGREGATE"
    freshness: str | None = None
    status: str = "ACTIVE"
    columns: tuple[MaterializationColumn, ...] = ()


@dataclass(frozen=True)
class Synonym:
    kind: str
    name: str
    synonym: str
    source: str = "USER"
    certified: bool = True


@dataclass(frozen=True)
class Extension:
    scope: str  # MODEL, ENTITY, RELATIONSHIP, DIMENSION, FACT, METRIC, OBJECT
    name: str
    vendor: str
    data: str


@dataclass(frozen=True)
class Instruction:
    scope: str
    name: str
    kind: str
    text: str


@dataclass(frozen=True)
class VerifiedQuery:
    name: str
    object: str
    question: str
    request: str


@dataclass(frozen=True)
class CalculationGroup:
    """Kept and exported, not compiled."""

    name: str
    items: tuple[tuple[str, str], ...] = ()


def _key(name: str) -> str:
    return name.upper()


TABLES = (
    "entities representations keys relationships dimensions facts metrics objects bindings authorities policies identities"
    " identity_bindings mappings materializations synonyms extensions instructions verified_queries calculation_groups"
).split()


@dataclass(frozen=True)
class Model:
    """A model version. Each table maps an upper-case key to a record; order of insertion is its id order."""

    name: str
    schema: str
    description: str | None = None
    owner: str | None = None
    version: int = 1
    entities: dict = field(default_factory=dict)
    representations: dict = field(default_factory=dict)
    keys: dict = field(default_factory=dict)
    relationships: dict = field(default_factory=dict)
    dimensions: dict = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    objects: dict = field(default_factory=dict)
    bindings: dict = field(default_factory=dict)
    authorities: dict = field(default_factory=dict)
    policies: dict = field(default_factory=dict)
    identities: dict = field(default_factory=dict)
    identity_bindings: dict = field(default_factory=dict)
    mappings: dict = field(default_factory=dict)
    materializations: dict = field(default_factory=dict)
    synonyms: dict = field(default_factory=dict)
    extensions: dict = field(default_factory=dict)
    instructions: dict = field(default_factory=dict)
    verified_queries: dict = field(default_factory=dict)
    calculation_groups: dict = field(default_factory=dict)

    # -- reading -------------------------------------------------------------------------------------------
    def get(self, table: str, name: str | None) -> Any:
        return getattr(self, table).get(_key(name)) if name else None

    def id_of(self, table: str, name: str) -> int:
        return list(getattr(self, table)).index(_key(name))

    def entity_of_alias(self, alias: str) -> Entity | None:
        return next((e for e in self.entities.values() if _key(e.alias) == _key(alias)), None)

    def sources_of(self, entity: str) -> list[Representation]:
        """The primary representation first, then alternates in order of id."""
        own = [r for r in self.representations.values() if _key(r.entity) == _key(entity)]
        if not any(r.role == "PRIMARY" for r in own):
            e = self.get("entities", entity)
            own.insert(0, Representation("PRIMARY", e.name, e.schema, e.object, "PRIMARY", 0))
        return sorted(own, key=lambda r: r.role != "PRIMARY")

    def keys_of(self, entity: str) -> list[UniqueKey]:
        return [k for k in self.keys.values() if _key(k.entity) == _key(entity)]

    def content(self) -> str:
        """Canonical text of everything that compiling depends on."""
        tables = {t: {k: dataclasses.asdict(v) for k, v in getattr(self, t).items()} for t in TABLES}
        return json.dumps({"name": self.name, "schema": self.schema, **tables}, sort_keys=True, default=str)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.content().encode()).hexdigest()[:16]

    # -- changing: every method gives a new model ----------------------------------------------------------
    def with_(self, table: str, key: str, record: Any, replace: bool = True) -> Model:
        rows = dict(getattr(self, table))
        if not replace and _key(key) in rows:
            raise SemanticError("SEMANTIC_ADMIN_001", f"{table} already has {key}.")
        rows[_key(key)] = record
        return dataclasses.replace(self, **{table: rows})

    def without(self, table: str, key: str) -> Model:
        rows = dict(getattr(self, table))
        if rows.pop(_key(key), None) is None:
            raise SemanticError("SEMANTIC_ADMIN_002", f"{table} has no {key}.")
        return dataclasses.replace(self, **{table: rows})

    def _named(self, table: str, record: Any) -> Model:
        if not IDENTIFIER.match(record.name):
            raise SemanticError("SEMANTIC_ADMIN_003", f"Not an identifier: {record.name!r}.")
        return self.with_(table, record.name, record, replace=False)

    def add_entity(self, name, schema, object, alias, primary_key=None, grain=None, description=None) -> Model:  # noqa: A002
        out = self._named("entities", Entity(name, schema, object, alias, primary_key, grain, description))
        return out.with_("representations", f"{name}.PRIMARY", Representation("PRIMARY", name, schema, object, "PRIMARY", 0))

    def add_representation(self, entity, name, schema, object, priority=100, source_kind="RELATION", coverage=None, valid_from=None, valid_to=None) -> Model:  # noqa: A002
        record = Representation(name, entity, schema, object, "ALTERNATE", priority, source_kind, coverage, valid_from, valid_to)
        return self.with_("representations", f"{entity}.{name}", record, replace=False)

    def set_coverage(self, entity, name, coverage, valid_from, valid_to) -> Model:
        old = self.get("representations", f"{entity}.{name}")
        if old is None:
            raise SemanticError("SEMANTIC_ADMIN_002", f"No representation {entity}.{name}.")
        return self.with_("representations", f"{entity}.{name}", dataclasses.replace(old, coverage=coverage, valid_from=valid_from, valid_to=valid_to))

    def set_coverage_batch(self, entity, parts: list[tuple]) -> Model:
        out = self
        for part in parts:
            out = out.set_coverage(entity, *part)
        return out

    def set_primary(self, entity, name) -> Model:
        out = self
        for r in self.sources_of(entity):
            role = "PRIMARY" if _key(r.name) == _key(name) else "ALTERNATE"
            out = out.with_("representations", f"{entity}.{r.name}", dataclasses.replace(r, role=role))
        chosen = out.get("representations", f"{entity}.{name}")
        if chosen is None:
            raise SemanticError("SEMANTIC_ADMIN_002", f"No representation {entity}.{name}.")
        return out.with_("entities", entity, dataclasses.replace(self.get("entities", entity), schema=chosen.schema, object=chosen.object))

    def remove_representation(self, entity, name) -> Model:
        return self.without("representations", f"{entity}.{name}")

    def add_key(self, entity, name, columns, kind="PRIMARY", expressions=()) -> Model:
        return self.with_("keys", f"{entity}.{name}", UniqueKey(name, entity, tuple(columns), kind, tuple(expressions)), replace=False)

    def add_relationship(self, name, from_entity, to_entity, condition, cardinality="MANY_TO_ONE", join_type="LEFT", fanout_policy=None, path_priority=100) -> Model:
        return self._named("relationships", Relationship(name, from_entity, to_entity, condition, cardinality, join_type, fanout_policy, path_priority))

    def add_mapping(self, relationship, from_column=None, to_column=None, from_expression=None, to_expression=None) -> Model:
        old = self.get("relationships", relationship)
        new = dataclasses.replace(old, mappings=(*old.mappings, KeyMapping(from_column, to_column, from_expression, to_expression)))
        return self.with_("relationships", relationship, new)

    def add_object(self, name, root, description=None) -> Model:
        return self._named("objects", SemanticObject(name, root, description))

    def show(self, object, kind, name, visible=True, ordinal=None) -> Model:  # noqa: A002
        old = self.get("objects", object)
        if old is None:
            raise SemanticError("SEMANTIC_ADMIN_002", f"No semantic object {object}.")
        kept = tuple(c for c in old.columns if (c.kind, _key(c.name)) != (kind, _key(name)))
        place = ordinal or max((c.ordinal for c in kept), default=0) + 1
        return self.with_("objects", object, dataclasses.replace(old, columns=(*kept, ObjectColumn(kind, name, place, visible))))

    def hide(self, object, kind, name) -> Model:  # noqa: A002
        old = self.get("objects", object)
        return self.with_("objects", object, dataclasses.replace(old, columns=tuple(c for c in old.columns if (c.kind, _key(c.name)) != (kind, _key(name)))))

    def add_dimension(self, object, entity, name, expression, data_type=None, visible=True, **more) -> Model:  # noqa: A002
        out = self._named("dimensions", Dimension(name, entity, expression, data_type, **more))
        return out.show(object, "DIMENSION", name, visible) if object else out

    def add_fact(self, entity, name, expression, data_type=None, **more) -> Model:
        return self._named("facts", Fact(name, entity, expression, data_type, **more))

    def add_metric(self, object, name, expression, base_entity=None, **more) -> Model:  # noqa: A002
        record = Metric(name, expression, base_entity, **more)
        out = self._named("metrics", record)
        return out.show(object, "METRIC", name, not record.private) if object else out

    def add_binding(self, entity, kind, attribute, representation, expression, role="PREFER", priority=100) -> Model:
        record = Binding(entity, kind, attribute, representation, expression, role, priority)
        return self.with_("bindings", f"{kind}.{attribute}.{representation}", record)

    def remove_binding(self, kind, attribute, representation) -> Model:
        return self.without("bindings", f"{kind}.{attribute}.{representation}")

    def add_dimension_with_bindings(self, object, entity, name, expression, data_type, bindings: list[tuple], **more) -> Model:  # noqa: A002
        out = self.add_dimension(object, entity, name, expression, data_type, **more)
        for b in bindings:
            out = out.add_binding(entity, "DIMENSION", name, *b)
        return out

    def add_fact_with_bindings(self, entity, name, expression, data_type, bindings: list[tuple], **more) -> Model:
        out = self.add_fact(entity, name, expression, data_type, **more)
        for b in bindings:
            out = out.add_binding(entity, "FACT", name, *b)
        return out

    def set_authority(self, entity, representation, level) -> Model:
        return self.with_("authorities", f"{entity}.{representation}", Authority(entity, representation, level))

    def set_fusion(self, entity, kind, attribute, strategy) -> Model:
        return self.with_("policies", f"{kind}.{attribute}", FusionPolicy(entity, kind, attribute, strategy))

    def add_identity(self, name, entity, data_type=None) -> Model:
        return self._named("identities", Identity(name, entity, data_type))

    def add_identity_binding(self, identity, representation, expression, kind="DIRECT", mapping=None) -> Model:
        return self.with_("identity_bindings", f"{identity}.{representation}", IdentityBinding(identity, representation, expression, kind, mapping))

    def add_identity_mapping(self, name, identity, schema, object, source_column, semantic_column, status="CERTIFIED") -> Model:  # noqa: A002
        return self._named("mappings", MappingRelation(name, identity, schema, object, source_column, semantic_column, status))

    def add_identity_with_bindings(self, name, entity, data_type, bindings: list[tuple]) -> Model:
        out = self.add_identity(name, entity, data_type)
        for b in bindings:
            out = out.add_identity_binding(name, *b)
        return out

    def register_materialization(self, name, schema, object, type="AGGREGATE", freshness=None, status="ACTIVE") -> Model:  # noqa: A002
        return self._named("materializations", Materialization(name, schema, object, type, freshness, status))

    def add_materialization_column(self, materialization, kind, name, column, policy="NONE") -> Model:
        old = self.get("materializations", materialization)
        return self.with_("materializations", materialization, dataclasses.replace(old, columns=(*old.columns, MaterializationColumn(kind, name, column, policy))))

    def set_materialization_status(self, materialization, status) -> Model:
        return self.with_("materializations", materialization, dataclasses.replace(self.get("materializations", materialization), status=status))

    def add_synonym(self, kind, name, synonym, source="USER", certified=True) -> Model:
        return self.with_("synonyms", f"{kind}.{name}.{synonym}", Synonym(kind, name, synonym, source, certified))

    def add_extension(self, scope, name, vendor, data) -> Model:
        return self.with_("extensions", f"{scope}.{name}.{vendor}", Extension(scope, name, vendor, data))

    def add_instruction(self, scope, name, kind, text) -> Model:
        return self.with_("instructions", f"{scope}.{name}.{kind}.{hashlib.sha256(text.encode()).hexdigest()[:8]}", Instruction(scope, name, kind, text))

    def add_verified_query(self, name, object, question, request) -> Model:  # noqa: A002
        return self.with_("verified_queries", name, VerifiedQuery(name, object, question, request))

    def add_calculation_group(self, name, items=()) -> Model:
        return self.with_("calculation_groups", name, CalculationGroup(name, tuple(items)))
