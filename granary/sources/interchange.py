"""Interchange of models as YAML or JSON documents, version 0.2.0.dev0.

The core of the format is portable: datasets, fields, relationships, metrics. What it has no words for travels in
custom extensions, JSON texts under a vendor's name; the lossless profile writes them, any vendor's are read.
"""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

from granary.errors import SemanticError
from granary.functions.expressions import IDENTIFIER, aggregates, references
from granary.model import TABLES, KeyMapping, Model, ObjectColumn

VERSION = "0.2.0.dev0"
VENDOR = "GRANARY"
DIALECT = "ANSI_SQL"


def _extension(item: dict) -> dict:
    """What an item's custom extensions say, later ones over earlier ones."""
    out: dict = {}
    for x in item.get("custom_extensions") or []:
        try:
            found = json.loads(x.get("data") or "{}")
        except ValueError:
            continue
        if isinstance(found, dict):
            out |= found
    return out


def _expression(item: dict) -> str | None:
    dialects = (item.get("expression") or {}).get("dialects") or []
    chosen = next((d for d in dialects if d.get("dialect") == DIALECT), dialects[0] if dialects else None)
    return chosen.get("expression") if chosen else None


def load(source: str | dict | Path) -> dict:
    """A document from a mapping, a file's path, or YAML or JSON text."""
    if isinstance(source, dict):
        return source
    text = source.read_text() if isinstance(source, Path) else source
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def validate_document(document: dict, strict: bool = False) -> list[dict]:
    """Issues of a document: severity ERROR blocks its import."""
    issues: list[dict] = []

    def issue(severity: str, path: str, message: str) -> None:
        issues.append({"severity": severity, "path": path, "message": message})

    if not isinstance(document, dict) or not isinstance(document.get("semantic_model"), list) or not document["semantic_model"]:
        issue("ERROR", "semantic_model", "The document has no semantic model.")
        return issues
    if str(document.get("version")) != VERSION:
        issue("WARNING", "version", f"Version {document.get('version')} isn't {VERSION}.")
    for k, model in enumerate(document["semantic_model"]):
        here = f"semantic_model[{k}]"
        if not IDENTIFIER.match(str(model.get("name") or "")):
            issue("ERROR", here, "The model needs a name.")
        names = {d.get("name") for d in model.get("datasets") or []}
        if not names:
            issue("ERROR", f"{here}.datasets", "The model has no datasets.")
        for d in model.get("datasets") or []:
            if not d.get("name") or not (d.get("source") or _extension(d).get("source_object")):
                issue("ERROR", f"{here}.datasets", "A dataset needs a name and a source.")
            for f in d.get("fields") or []:
                path = f"{here}.datasets.{d.get('name')}.fields.{f.get('name')}"
                if _expression(f) is None:
                    issue("ERROR", path, "The field has no expression.")
                if not _extension(f).get("data_type") and not f.get("data_type"):
                    issue("ERROR" if strict else "WARNING", path, "The field has no data type.")
        for r in model.get("relationships") or []:
            path = f"{here}.relationships.{r.get('name')}"
            if r.get("from") not in names or r.get("to") not in names:
                issue("ERROR", path, "An endpoint is missing.")
            if len(r.get("from_columns") or []) != len(r.get("to_columns") or []) or not r.get("from_columns"):
                issue("ERROR", path, "Column lists differ in length.")
        for m in model.get("metrics") or []:
            if _expression(m) is None:
                issue("ERROR", f"{here}.metrics.{m.get('name')}", "The metric has no expression.")
    return issues


def plan_import(document: dict, strict: bool = False) -> tuple[list[tuple], list[dict]]:
    """Ordered operations that build a document's first model, and its issues."""
    issues = validate_document(document, strict)
    if any(i["severity"] == "ERROR" for i in issues):
        return [], issues
    source = document["semantic_model"][0]
    own = _extension(source)
    name = source["name"]
    ops: list[tuple] = [("model", name, own.get("published_schema") or f"SEMANTIC_{name.upper()}", source.get("description"))]
    aliases: dict[str, str] = {}
    for d in source["datasets"]:
        x = _extension(d)
        parts = str(d.get("source") or "").split(".")
        schema, obj = x.get("source_schema") or (parts[-2] if len(parts) > 1 else "DEFAULT"), x.get("source_object") or parts[-1]
        entity = x.get("entity_name") or d["name"]
        alias = x.get("source_alias") or _alias(entity, set(aliases.values()))
        aliases[d["name"]] = alias
        keys = list(d.get("primary_key") or [])
        ops.append(("add_entity", entity, schema, obj, alias, x.get("primary_key_expr") or (f"{alias}.{keys[0]}" if len(keys) == 1 else None), x.get("grain_description"), d.get("description") or x.get("description")))
        if keys:
            ops.append(("add_key", entity, "pk", keys))
        for k, unique in enumerate(d.get("unique_keys") or []):
            if list(unique) != keys:
                ops.append(("add_key", entity, f"uk{k + 1}", list(unique), "UNIQUE"))
    entities = {d["name"]: _extension(d).get("entity_name") or d["name"] for d in source["datasets"]}
    for r in source.get("relationships") or []:
        x = _extension(r)
        a, b = aliases[r["from"]], aliases[r["to"]]
        pairs = list(zip(r["from_columns"], r["to_columns"], strict=True))
        condition = x.get("join_condition") or " AND ".join(f"{a}.{f} = {b}.{t}" for f, t in pairs)
        ops.append(("add_relationship", r["name"], entities[r["from"]], entities[r["to"]], condition, x.get("relationship_cardinality") or "MANY_TO_ONE", x.get("join_type") or "LEFT", x.get("fanout_policy"), x.get("path_priority") or 100))
        if not x.get("requires_native_join_condition"):
            ops += [("add_mapping", r["name"], f, t) for f, t in pairs]
    objects = own.get("semantic_objects") or [{"object_name": name.upper(), "root_entity": entities[source["datasets"][0]["name"]], "columns": None}]
    for o in objects:
        ops.append(("add_object", o["object_name"], o["root_entity"], o.get("description")))
    fields: list[tuple] = []
    for d in source["datasets"]:
        for f in d.get("fields") or []:
            x = _extension(f)
            kind = x.get("field_kind") or ("DIMENSION" if f.get("dimension") is not None else "FACT")
            fields.append((kind, f["name"]))
            text = _qualified(_expression(f), aliases[d["name"]])
            told = {"display": x.get("display_name") or f.get("label_text"), "description": f.get("description"), "certified": bool(x.get("is_certified"))}
            entity = x.get("entity_name") or entities[d["name"]]
            data_type = x.get("data_type") or f.get("data_type") or ("DATE" if (f.get("dimension") or {}).get("is_time") else "VARCHAR(2000000)")
            if kind == "DIMENSION":
                ops.append(("dimension", entity, f["name"], text, data_type, {**told, "format": x.get("format_hint"), "is_time": bool((f.get("dimension") or {}).get("is_time"))}))
            else:
                ops.append(("fact", entity, f["name"], text, data_type, {**told, "policy": x.get("additive_policy") or "ADDITIVE", "private": bool(x.get("is_private"))}))
            ops += [("add_synonym", kind, f["name"], s) for s in (f.get("ai_context") or {}).get("synonyms") or []]
    for m in source.get("metrics") or []:
        x = _extension(m)
        kind = x.get("metric_kind") or ("FILTERED" if x.get("filter_expr") else "SIMPLE")
        fixed = {"SIMPLE": "ADDITIVE", "DERIVED": "NON_ADDITIVE", "RATIO": "NON_ADDITIVE"}
        metric_type = x.get("metric_type") or "ADDITIVE"
        ops.append(
            (
                "metric",
                m["name"],
                _expression(m),
                x.get("base_entity"),
                {
                    "filter": x.get("filter_expr"),
                    "metric_type": fixed.get(metric_type, metric_type),
                    "kind": kind,
                    "data_type": x.get("data_type"),
                    "display": x.get("display_name"),
                    "description": m.get("description"),
                    "format": x.get("format_hint"),
                    "private": bool(x.get("is_private")),
                    "certified": bool(x.get("is_certified")),
                    "distinct_key": x.get("distinct_key"),
                    "non_additive_by": x.get("non_additive_by"),
                    "window": x.get("window_spec"),
                },
            )
        )
        fields.append(("METRIC", m["name"]))
        ops += [("add_synonym", "METRIC", m["name"], s) for s in (m.get("ai_context") or {}).get("synonyms") or []]
    for o in objects:
        columns = o.get("columns") or [{"kind": k, "name": n, "ordinal": i + 1} for i, (k, n) in enumerate(fields) if k != "FACT"]
        for c in columns:
            ops.append(("show", o["object_name"], c["kind"], c["name"], c.get("is_visible", True), c["ordinal"]))
    if own.get("tables"):
        ops.append(("tables", own["tables"]))
    return ops, issues


def _alias(entity: str, used: set[str]) -> str:
    for alias in [entity[:1].lower(), entity[:2].lower(), *(f"{entity[:1].lower()}{k}" for k in range(1, 1000))]:
        if alias not in used and IDENTIFIER.match(alias):
            return alias
    raise SemanticError("SEMANTIC_ADMIN_003", "Too many entities.")


def _qualified(text: str, alias: str) -> str:
    from granary.functions.expressions import substitute

    return substitute(text, bare=lambda n: f"{alias}.{n}")


def import_model(source: str | dict | Path, strict: bool = False) -> tuple[Model, list[dict]]:
    """The first model of a document, and its issues; an error if any blocks."""
    document = load(source)
    ops, issues = plan_import(document, strict)
    errors = [i for i in issues if i["severity"] == "ERROR"]
    if errors:
        raise SemanticError("SEMANTIC_IMPORT_001", "; ".join(f"{i['path']}: {i['message']}" for i in errors))
    model = None
    for op, *args in ops:
        if op == "model":
            model = Model(*args)
        elif op == "dimension":
            model = model.add_dimension(None, *args[:-1], **args[-1])
        elif op == "fact":
            model = model.add_fact(*args[:-1], **args[-1])
        elif op == "metric":
            model = model.add_metric(None, *args[:-1], **args[-1])
        elif op == "tables":
            model = _restored(model, args[0])
        else:
            model = getattr(model, op)(*args)
    return model, issues


# -- export ----------------------------------------------------------------------------------------------------
def _ext(**data) -> list[dict]:
    return [{"vendor_name": VENDOR, "data": json.dumps({k: v for k, v in data.items() if v is not None}, sort_keys=True)}]


#: Tables that the portable core has no place for.
_BEYOND = ("representations", "bindings", "authorities", "policies", "identities", "identity_bindings", "mappings", "materializations", "extensions", "instructions", "verified_queries", "calculation_groups")


def _restored(model: Model, tables: dict) -> Model:
    from granary import model as records

    kinds = {
        "representations": records.Representation, "bindings": records.Binding, "authorities": records.Authority, "policies": records.FusionPolicy,
        "identities": records.Identity, "identity_bindings": records.IdentityBinding, "mappings": records.MappingRelation, "extensions": records.Extension,
        "instructions": records.Instruction, "verified_queries": records.VerifiedQuery,
    }
    for table, rows in tables.items():
        for key, row in rows.items():
            if table == "materializations":
                columns = tuple(records.MaterializationColumn(**c) for c in row.pop("columns"))
                record = records.Materialization(**row, columns=columns)
            elif table == "calculation_groups":
                record = records.CalculationGroup(row["name"], tuple(tuple(i) for i in row["items"]))
            else:
                record = kinds[table](**row)
            model = model.with_(table, key, record)
    return model


def export_model(model: Model, profile: str = "interoperability") -> tuple[dict, list[str]]:
    """A document, and warnings about what the profile leaves out."""
    lossless, warnings = profile == "lossless", []
    datasets = []
    for e in model.entities.values():
        keys = model.keys_of(e.name)
        primary = next((k for k in keys if k.kind == "PRIMARY"), None)
        synonyms = lambda kind, name: [s.synonym for s in model.synonyms.values() if s.kind == kind and s.name.upper() == name.upper()]
        fields = []
        for kind, table in (("DIMENSION", "dimensions"), ("FACT", "facts")):
            for x in getattr(model, table).values():
                if x.entity.upper() != e.name.upper():
                    continue
                item = {"name": x.name, "expression": {"dialects": [{"dialect": DIALECT, "expression": x.expression}]}, "description": x.description}
                item |= {"dimension": {"is_time": True} if x.is_time else {}} if kind == "DIMENSION" else {"label": "fact"}
                if synonyms(kind, x.name):
                    item["ai_context"] = {"synonyms": synonyms(kind, x.name)}
                if lossless:
                    more = {"format_hint": x.format} if kind == "DIMENSION" else {"additive_policy": x.policy, "is_private": x.private}
                    item["custom_extensions"] = _ext(field_kind=kind, entity_name=x.entity, data_type=x.data_type, display_name=x.display, is_certified=x.certified, **more)
                fields.append({k: v for k, v in item.items() if v is not None})
        item = {
            "name": e.name,
            "source": f"{e.schema}.{e.object}",
            "primary_key": list(primary.columns) if primary else None,
            "unique_keys": [list(k.columns) for k in keys if k is not primary] or None,
            "description": e.description,
            "fields": fields,
        }
        if lossless:
            item["custom_extensions"] = _ext(entity_name=e.name, source_schema=e.schema, source_object=e.object, source_alias=e.alias, primary_key_expr=e.primary_key, grain_description=e.grain)
        datasets.append({k: v for k, v in item.items() if v is not None})
    relationships = []
    for r in model.relationships.values():
        pairs = [(m.from_column, m.to_column) for m in r.mappings if m.from_column and m.to_column]
        native = not pairs
        if native:
            alias = model.get("entities", r.from_entity).alias.upper()
            sides = references(r.condition).qualified
            pairs = list(zip([c for a, c in sides if a.upper() == alias], [c for a, c in sides if a.upper() != alias], strict=False))
            warnings.append(f"relationship {r.name}: the join condition isn't a list of column pairs")
        item = {"name": r.name, "from": r.from_entity, "to": r.to_entity, "from_columns": [p[0] for p in pairs], "to_columns": [p[1] for p in pairs]}
        if lossless:
            item["custom_extensions"] = _ext(
                relationship_cardinality=r.cardinality, join_type=r.join_type, join_condition=r.condition, path_priority=r.path_priority, fanout_policy=r.fanout_policy, requires_native_join_condition=native or None
            )
        elif r.cardinality != "MANY_TO_ONE":
            warnings.append(f"relationship {r.name}: cardinality {r.cardinality} isn't portable")
        relationships.append(item)
    metrics = []
    for x in model.metrics.values():
        if x.private and not lossless:
            warnings.append(f"metric {x.name}: private metrics become public")
        if x.filter and not lossless:
            warnings.append(f"metric {x.name}: its filter isn't portable")
        item = {"name": x.name, "expression": {"dialects": [{"dialect": DIALECT, "expression": x.expression}]}, "description": x.description}
        names = [s.synonym for s in model.synonyms.values() if s.kind == "METRIC" and s.name.upper() == x.name.upper()]
        if names:
            item["ai_context"] = {"synonyms": names}
        if lossless:
            found = aggregates(x.expression)[1]
            item["custom_extensions"] = _ext(
                data_type=x.data_type, base_entity=x.base_entity, metric_type=x.metric_type, metric_kind=x.kind, filter_expr=x.filter, display_name=x.display, format_hint=x.format,
                is_private=x.private, is_certified=x.certified, distinct_key=x.distinct_key, non_additive_by=x.non_additive_by, window_spec=x.window,
                aggregation_function=found[0].function if len(found) == 1 else None, measure_expr=found[0].argument if len(found) == 1 else None,
            )
        metrics.append({k: v for k, v in item.items() if v is not None})
    body = {"name": model.name, "description": model.description, "datasets": datasets, "relationships": relationships, "metrics": metrics}
    beyond = {t: {k: dataclasses.asdict(v) for k, v in getattr(model, t).items()} for t in _BEYOND if getattr(model, t)}
    if lossless:
        objects = [{"object_name": o.name, "root_entity": o.root, "description": o.description, "columns": [{"kind": c.kind, "name": c.name, "ordinal": c.ordinal, "is_visible": c.visible} for c in o.columns]} for o in model.objects.values()]
        body["custom_extensions"] = _ext(published_schema=model.schema, semantic_objects=objects, tables=beyond or None)
    else:
        warnings += [f"{t}: {len(rows)} records aren't portable" for t, rows in beyond.items() if t != "representations" or any(r["role"] != "PRIMARY" for r in rows.values())]
    return {"version": VERSION, "semantic_model": [{k: v for k, v in body.items() if v not in (None, [])}]}, warnings


def normalized(document: dict):
    """A document with named lists in order of name and extension texts read, for comparing."""

    def walk(x):
        if isinstance(x, dict):
            if set(x) == {"vendor_name", "data"}:
                try:
                    return {"vendor_name": x["vendor_name"], "data": walk(json.loads(x["data"]))}
                except ValueError:
                    return x
            return {k: walk(v) for k, v in sorted(x.items()) if v is not None}
        if isinstance(x, list):
            out = [walk(v) for v in x]
            named = all(isinstance(v, dict) and "name" in v for v in out)
            return sorted(out, key=lambda v: str(v["name"])) if named else out
        return x

    return walk(document)


def diff(a: dict, b: dict, path: str = "$") -> list[str]:
    """Where two documents differ once normalized."""
    if path == "$":
        a, b = normalized(a), normalized(b)
    if type(a) is not type(b):
        return [f"{path}: {a!r} != {b!r}"]
    if isinstance(a, dict):
        return [d for k in sorted(set(a) | set(b)) for d in ([f"{path}.{k}: only on one side"] if k not in a or k not in b else diff(a[k], b[k], f"{path}.{k}"))]
    if isinstance(a, list):
        if len(a) != len(b):
            return [f"{path}: {len(a)} items != {len(b)} items"]
        return [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in diff(x, y, f"{path}[{i}]")]
    return [] if a == b else [f"{path}: {a!r} != {b!r}"]


__all__ = ["TABLES", "KeyMapping", "ObjectColumn", "diff", "export_model", "import_model", "load", "plan_import", "validate_document"]
