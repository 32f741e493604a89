"""Discovery views: catalog and agent metadata as DataFrames with fixed schemas."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame

from granary import model as records
from granary.functions.catalog import FUNCTIONS
from granary.plans.metrics import Formulas
from granary.plans.request import KEYS, MAX_LIMIT, OPERATORS

#: Views that show one table of the model, and the name that its ``name`` column takes.
_TABLES = {
    "ENTITIES": ("entities", records.Entity, "entity_name"),
    "ENTITY_REPRESENTATIONS": ("representations", records.Representation, "representation_name"),
    "RELATIONSHIPS": ("relationships", records.Relationship, "relationship_name"),
    "DIMENSIONS": ("dimensions", records.Dimension, "dimension_name"),
    "FACTS": ("facts", records.Fact, "fact_name"),
    "METRICS": ("metrics", records.Metric, "metric_name"),
    "SEMANTIC_OBJECTS": ("objects", records.SemanticObject, "object_name"),
    "UNIQUE_KEYS": ("keys", records.UniqueKey, "key_name"),
    "ATTRIBUTE_BINDINGS": ("bindings", records.Binding, None),
    "REPRESENTATION_AUTHORITIES": ("authorities", records.Authority, None),
    "ATTRIBUTE_FUSION_POLICIES": ("policies", records.FusionPolicy, None),
    "SEMANTIC_IDENTITIES": ("identities", records.Identity, "identity_name"),
    "IDENTITY_BINDINGS": ("identity_bindings", records.IdentityBinding, None),
    "IDENTITY_MAPPING_RELATIONS": ("mappings", records.MappingRelation, "mapping_name"),
    "MATERIALIZATIONS": ("materializations", records.Materialization, "materialization_name"),
    "SYNONYMS": ("synonyms", records.Synonym, "object_name"),
    "CUSTOM_EXTENSIONS": ("extensions", records.Extension, "object_name"),
    "AGENT_INSTRUCTIONS": ("instructions", records.Instruction, "object_name"),
    "VERIFIED_QUERIES": ("verified_queries", records.VerifiedQuery, "query_name"),
}
_NESTED = ("columns", "mappings", "expressions", "items")


def _table_schema(record, renamed: str | None) -> tuple[list[str], str]:
    names, parts = [], ["model_name string"]
    for f in dataclasses.fields(record):
        if f.name in _NESTED:
            continue
        kind = {"int": "int", "bool": "boolean"}.get(str(f.type).split(" ")[0], "string")
        shown = renamed if f.name == "name" and renamed else {"entity": "entity_name"}.get(f.name, f.name)
        names.append(f.name)
        parts.append(f"`{shown}` {kind}")
    return names, ", ".join(parts)


def _models(session):
    return list(session.models.values())


def _formulas(m):
    return Formulas(m)


def _inputs(session) -> list[tuple]:
    out = []
    for m in _models(session):
        f = _formulas(m)
        for x in m.metrics.values():
            facts, inner, _ = f.inputs(x)
            ratio = x.kind == "RATIO" and len(inner) == 2
            out += [(m.name, x.name, "FACT", n, "MEASURE") for n in facts]
            out += [(m.name, x.name, "METRIC", n, ("NUMERATOR", "DENOMINATOR")[k] if ratio else "INPUT_METRIC") for k, n in enumerate(inner)]
    return out


def _lineage(session) -> list[tuple]:
    out = []
    for m in _models(session):
        f = _formulas(m)
        for x in m.metrics.values():
            for y in f.order([x.name]):
                facts, inner, _ = f.inputs(y)
                out += [(m.name, x.name, y.name, "FACT", n, m.get("facts", n).entity) for n in facts]
                out += [(m.name, x.name, y.name, "METRIC", n, None) for n in inner]
    return out


def _matrix(session) -> list[tuple]:
    out = []
    for m in _models(session):
        report = session.reports.get(m.fingerprint())
        out += [(m.name, r["metric"], r["dimension"], r["valid"], r["reason"], r["path"]) for r in (report.matrix.values() if report else [])]
    return out


def _issues(run, report) -> list[tuple]:
    return [(report.model, run, i.severity, i.object_type, i.object_name, i.code, i.message) for i in report.issues]


def _overview(session) -> list[tuple]:
    out = []
    for m in _models(session):
        f = _formulas(m)
        for x in m.metrics.values():
            shown = ", ".join(o.name for o in m.objects.values() if x.name in o.visible("METRIC"))
            out.append((m.name, x.name, x.expression, x.filter, x.kind, x.metric_type, x.base_entity, x.data_type, f.classify(x), shown, x.description))
    return out


def _sources(session) -> list[tuple]:
    from granary.ddl import export

    return [(m.name, o.name, export(m, o.name)) for m in _models(session) for o in m.objects.values()]


_ISSUE = "model_name string, run_id int, severity string, object_type string, object_name string, rule_code string, message string"
#: Views made from more than one table: schema and rows.
_MADE = {
    "MODELS": (
        "model_name string, published_schema string, description string, owner string, status string",
        lambda s: [(m.name, m.schema, m.description, m.owner, "PUBLISHED" if m.schema.upper() in s.published else "DRAFT") for m in _models(s)],
    ),
    "MODEL_VERSIONS": ("model_name string, version int, fingerprint string", lambda s: [(m.name, m.version, m.fingerprint()) for m in _models(s)]),
    "UNIQUE_KEY_COLUMNS": (
        "model_name string, entity_name string, key_name string, ordinal int, column_name string",
        lambda s: [(m.name, k.entity, k.name, i + 1, c) for m in _models(s) for k in m.keys.values() for i, c in enumerate(k.columns)],
    ),
    "RELATIONSHIP_KEY_MAPPINGS": (
        "model_name string, relationship_name string, ordinal int, from_column string, from_expression string, to_column string, to_expression string",
        lambda s: [(m.name, r.name, i + 1, k.from_column, k.from_expression, k.to_column, k.to_expression) for m in _models(s) for r in m.relationships.values() for i, k in enumerate(r.mappings)],
    ),
    "OBJECT_COLUMNS": (
        "model_name string, object_name string, kind string, column_name string, ordinal int, is_visible boolean",
        lambda s: [(m.name, o.name, c.kind, c.name, c.ordinal, c.visible) for m in _models(s) for o in m.objects.values() for c in o.columns],
    ),
    "MATERIALIZATION_COLUMNS": (
        "model_name string, materialization_name string, kind string, object_name string, column_name string, rollup_policy string",
        lambda s: [(m.name, x.name, c.kind, c.name, c.column, c.policy) for m in _models(s) for x in m.materializations.values() for c in x.columns],
    ),
    "VALIDATION_RUNS": ("run_id int, model_name string, fingerprint string, status string, issues int", lambda s: [(r.run_id, r.model, r.fingerprint, r.status, len(r.issues)) for r in s.runs]),
    "VALIDATION_RESULTS": (_ISSUE, lambda s: [i for r in s.runs for i in _issues(r.run_id, r)]),
    "CURRENT_VALIDATION_ISSUES": (_ISSUE, lambda s: [i for r in {r.model: r for r in s.runs}.values() for i in _issues(r.run_id, r)]),
    "METRIC_DIMENSION_MATRIX": ("model_name string, metric_name string, dimension_name string, is_valid boolean, reason string, path string", _matrix),
    "METRIC_COMPATIBLE_DIMENSIONS": (
        "model_name string, metric_name string, dimension_name string, is_valid boolean, reason string, path string",
        lambda s: [r for r in _matrix(s) if r[3]],
    ),
    "METRIC_INPUTS": ("model_name string, metric_name string, input_type string, input_name string, role string", _inputs),
    "METRIC_FILTERS": ("model_name string, metric_name string, filter_expression string", lambda s: [(m.name, x.name, x.filter) for m in _models(s) for x in m.metrics.values() if x.filter]),
    "METRIC_FILTER_OVERVIEW": (
        "model_name string, metric_name string, filter_expression string, dimensions string",
        lambda s: [(m.name, x.name, x.filter, ", ".join(_formulas(m).filter_dimensions(x))) for m in _models(s) for x in m.metrics.values() if x.filter],
    ),
    "METRIC_OVERVIEW": (
        "model_name string, metric_name string, expression string, filter_expression string, kind string, metric_type string, base_entity string, data_type string, aggregate_state string, objects string, description string",
        _overview,
    ),
    "METRIC_LINEAGE": ("model_name string, metric_name string, via_metric string, input_type string, input_name string, entity_name string", _lineage),
    "SEMANTIC_DEFINITION_SOURCES": ("model_name string, object_name string, definition string", _sources),
    "SEMANTIC_DEFINITION_SOURCE": ("model_name string, object_name string, definition string", _sources),
    "MODEL_ROLE_GRANTS": ("model_name string, role_name string", lambda s: []),
    "MODEL_EVOLUTION_SUGGESTIONS": (
        "suggestion_id int, model_name string, kind string, object_type string, object_name string, proposal string, reason string, status string",
        lambda s: [tuple(x[k] for k in ("suggestion_id", "model", "kind", "object_type", "object_name", "proposal", "reason", "status")) for x in s.suggestions],
    ),
    "MODEL_EVOLUTION_REVIEWS": (
        "review_id int, suggestion_id int, decision string, reviewer string, comment string",
        lambda s: [tuple(x[k] for k in ("review_id", "suggestion_id", "decision", "reviewer", "comment")) for x in s.reviews],
    ),
}


def _request_schema(session) -> list[tuple]:
    told = {
        "filters": f"objects with field, op ({', '.join(OPERATORS)}) and value",
        "having": "objects with field (a metric), op and value",
        "order_by": "objects with field and direction",
        "limit": f"integer from 1 to {MAX_LIMIT}",
        "proof_mode": "LEGACY_JOIN or STRICT_GRAIN",
    }
    return [(i + 1, k, k in ("model", "object"), told.get(k, "names" if k in ("metrics", "dimensions") else "text")) for i, k in enumerate(KEYS)]


def _agent_fields(session) -> list[tuple]:
    out = []
    for m in _models(session):
        for o in m.objects.values():
            for kind, table in (("DIMENSION", "dimensions"), ("METRIC", "metrics")):
                for n in o.visible(kind):
                    x = m.get(table, n)
                    synonyms = ", ".join(s.synonym for s in m.synonyms.values() if s.kind == kind and s.name.upper() == n.upper())
                    out.append((m.name, o.name, kind, n, x.display, x.description, x.data_type, x.format, synonyms))
    return out


_AGENT = {
    "MODELS": _MADE["MODELS"],
    "OBJECTS": ("model_name string, object_name string, root_entity string, description string, certified boolean", lambda s: [(m.name, o.name, o.root, o.description, m.fingerprint() in s.reports) for m in _models(s) for o in m.objects.values()]),
    "FIELDS": ("model_name string, object_name string, kind string, field_name string, display_name string, description string, data_type string, format_hint string, synonyms string", _agent_fields),
    "VALID_COMBINATIONS": _MADE["METRIC_COMPATIBLE_DIMENSIONS"],
    "VALIDATION_ERRORS": (_ISSUE, lambda s: [i for i in _MADE["CURRENT_VALIDATION_ISSUES"][1](s) if i[2] != "WARNING"]),
    "EXPRESSION_FUNCTIONS": ("category string, function_name string", lambda s: [(c, f) for c, names in FUNCTIONS.items() for f in names]),
    "COMPILE_REQUEST_SCHEMA": ("ordinal int, key string, is_required boolean, description string", _request_schema),
    "MEASURE_GROUPS": ("model_name string, base_entity string, metrics string", lambda s: [(m.name, e.name, ", ".join(x.name for x in m.metrics.values() if (x.base_entity or "").upper() == e.name.upper())) for m in _models(s) for e in m.entities.values()]),
    "VERIFIED_QUERIES": ("model_name string, query_name string, object_name string, question string, request string", lambda s: [(m.name, q.name, q.object, q.question, q.request) for m in _models(s) for q in m.verified_queries.values()]),
    "INSTRUCTIONS": ("model_name string, scope string, object_name string, kind string, text string", lambda s: [(m.name, i.scope, i.name, i.kind, i.text) for m in _models(s) for i in m.instructions.values()]),
    "BUSINESS_GLOSSARY": ("model_name string, kind string, term string, description string, expression string", lambda s: [(m.name, k, x.display or n, x.description, x.expression) for m in _models(s) for k, n in dict.fromkeys((f[2], f[3]) for f in _agent_fields(s) if f[0] == m.name) for x in [m.get("metrics" if k == "METRIC" else "dimensions", n)]]),
    "REQUEST_HISTORY": (
        "request_id int, request string, status string, error_code string, cache_hit boolean, runtime_ms double, client string, purpose string",
        lambda s: [(r["request_id"], r["request"], r["status"], r["error_code"], r["cache_hit"], float(r["runtime_ms"]), r["client"], r["purpose"]) for r in s.requests],
    ),
    "MODEL_EVOLUTION_REVIEW_QUEUE": (_MADE["MODEL_EVOLUTION_SUGGESTIONS"][0], lambda s: [r for r in _MADE["MODEL_EVOLUTION_SUGGESTIONS"][1](s) if r[-1] == "PROPOSED"]),
}


def catalog_views() -> list[str]:
    return sorted([*_TABLES, *_MADE])


def agent_views() -> list[str]:
    return sorted(_AGENT)


def catalog_view(session, name: str) -> DataFrame:
    """A catalog view by name."""
    key = name.upper()
    if key in _MADE:
        schema, rows = _MADE[key]
        return session.spark.createDataFrame(rows(session), schema)
    table, record, renamed = _TABLES[key]
    names, schema = _table_schema(record, renamed)
    rows = [(m.name, *(getattr(x, n) for n in names)) for m in _models(session) for x in getattr(m, table).values()]
    return session.spark.createDataFrame(rows, schema)


def agent_view(session, name: str) -> DataFrame:
    """An agent view by name, with or without its ``_FOR_AGENT`` ending."""
    schema, rows = _AGENT[name.upper().removesuffix("_FOR_AGENT")]
    return session.spark.createDataFrame(rows(session), schema)


def register_views(session, catalog: str = "semantic_catalog", agent: str = "semantic_agent") -> None:
    """All views as temporary views ``<prefix>_<name>`` of the Spark session."""
    for n in catalog_views():
        catalog_view(session, n).createOrReplaceTempView(f"{catalog}_{n.lower()}")
    for n in agent_views():
        agent_view(session, n).createOrReplaceTempView(f"{agent}_{n.lower()}")


def dumps(rows: list) -> str:
    return json.dumps(rows, sort_keys=True, default=str)
