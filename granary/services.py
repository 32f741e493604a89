"""Discovery and governance: search, descriptions, glossary, verified queries, feedback and proposals."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import SemanticError
from granary.model import Model
from granary.plans.metrics import Formulas
from granary.validate import INSTRUCTION_KINDS, SCOPES

#: Words that don't narrow a search.
STOP_WORDS = frozenset("a an and by field fields find for list measure measures metric metrics of query show the value values".split())
VERDICTS = ("ACCEPTED", "HELPFUL", "NEEDS_CHANGE", "NOT_HELPFUL", "REJECTED")
PROPOSALS = ("NEW_CONCEPT", "NEW_IDENTITY", "REPRESENTATION_EQUIVALENCE", "AUTHORITY_CHANGE", "DEFINITION_CHANGE")
DECISIONS = ("CERTIFIED", "REJECTED")
MAX_RESULTS = 50
_FIELDS = "model_name string, object_name string, kind string, field_name string, display_name string, description string, match string"


def best_term(text: str) -> str:
    """The longest word of a question that isn't a stop word; all of it if there is none."""
    words = [w for w in re.findall(r"[A-Za-z0-9_]+", text) if w.lower() not in STOP_WORDS]
    return max(words, key=len) if words else text.strip()


def _fields(session, model_name: str | None) -> list[tuple]:
    out = []
    for m in session.models.values():
        if model_name and m.name.upper() != model_name.upper():
            continue
        for o in m.objects.values():
            for kind, table in (("DIMENSION", "dimensions"), ("METRIC", "metrics")):
                for n in o.visible(kind):
                    x = m.get(table, n)
                    out.append((m.name, o.name, kind, x.name, x.display, x.description))
    return out


def search(session, text: str, model: str | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """Visible fields and objects by name, display name, description and synonym, best matches first, at most 50.

    Exact matches score 100 (name), 95 (synonym) and 90 (display name); partial ones 70, 65 and 60; a description
    50 for an object, 40 for a field.
    """
    term = best_term(text)
    pattern = "%" + term.upper().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    rows = [(*f, None) for f in _fields(session, model)]
    for m in session.models.values():
        if model and m.name.upper() != model.upper():
            continue
        rows += [(m.name, o.name, "OBJECT", o.name, None, o.description, None) for o in m.objects.values()]
        for s in m.synonyms.values():
            rows += [(a, b, k, n, d, t, s.synonym) for a, b, k, n, d, t in _fields(session, m.name) if k == s.kind and n.upper() == s.name.upper()]
    df = session.spark.createDataFrame(rows, _FIELDS)
    like = lambda c: F.upper(c).like(pattern)
    same = lambda c: F.upper(c) == F.lit(term.upper())
    score = (
        F.when(F.col("match").isNotNull(), F.when(same("match"), 95).when(like("match"), 65))
        .when(same("field_name"), 100)
        .when(same("display_name"), 90)
        .when(like("field_name"), 70)
        .when(like("display_name"), 60)
        .when(like("description"), F.when(F.col("kind") == "OBJECT", 50).otherwise(40))
    )
    found = df.withColumn("score", score).where("score IS NOT NULL")
    return found.orderBy(F.desc("score"), "model_name", "object_name", "kind", "field_name").limit(min(limit, MAX_RESULTS))


def describe_object(session, model: str, obj: str) -> dict:
    """An object with its fields, their synonyms and its instructions, as data and as text."""
    m = session.model(model)
    o = m.get("objects", obj)
    if o is None:
        raise SemanticError("SEMANTIC_AGENT_012", f"Semantic object not found: {obj}")
    fields = [{"kind": k, "name": n, "display": d, "description": t, "synonyms": _synonyms(m, k, n)} for a, b, k, n, d, t in _fields(session, m.name) if b == o.name]
    notes = [i.text for i in m.instructions.values() if i.scope == "MODEL" or i.scope == "OBJECT" and i.name.upper() == o.name.upper()]
    text = "\n".join([f"{m.name}.{o.name}: {o.description or ''}".strip(), *(f"- {f['kind'].lower()} {f['name']}: {f['description'] or ''}".rstrip(": ") for f in fields), *notes])
    return {"model": m.name, "object": o.name, "root_entity": o.root, "fields": fields, "instructions": notes, "text": text}


def _synonyms(m: Model, kind: str, name: str) -> list[str]:
    return [s.synonym for s in m.synonyms.values() if s.kind == kind and s.name.upper() == name.upper()]


def glossary(session, model: str, mode: str = "TEXT") -> str:
    """All visible terms of a model: TEXT, or JSON with formulas and lineage."""
    m = session.model(model)
    terms = {}
    for _, obj, kind, name, display, description in _fields(session, m.name):
        x = m.get("metrics" if kind == "METRIC" else "dimensions", name)
        term = terms.setdefault((kind, name), {"kind": kind, "name": name, "display": display, "description": description, "objects": [], "synonyms": _synonyms(m, kind, name), "expression": x.expression})
        term["objects"].append(obj)
        if kind == "METRIC":
            term["facts"] = list(dict.fromkeys(f for y in Formulas(m).order([name]) for f in Formulas(m).inputs(y)[0]))
    if mode.upper() == "JSON":
        return json.dumps({"model": m.name, "terms": list(terms.values())}, sort_keys=True)
    if mode.upper() != "TEXT":
        raise SemanticError("SEMANTIC_AGENT_013", f"Unsupported glossary mode {mode}.")
    return "\n".join(f"{t['display'] or t['name']} ({t['kind'].lower()}{', also ' + ', '.join(t['synonyms']) if t['synonyms'] else ''}): {t['description'] or t['expression']}" for t in terms.values())


def explain(session, request_id: int) -> dict:
    """What a logged request compiled to."""
    row = next((r for r in session.requests if r["request_id"] == request_id), None)
    if row is None:
        raise SemanticError("SEMANTIC_AGENT_020", f"Unknown request {request_id}.")
    return row


def record_feedback(session, request_id: int, verdict: str, comment: str | None = None, suggestion: dict | None = None) -> dict:
    explain(session, request_id)
    if verdict not in VERDICTS:
        raise SemanticError("SEMANTIC_AGENT_021", f"Unsupported verdict {verdict}.")
    row = {"feedback_id": len(session.feedback) + 1, "request_id": request_id, "verdict": verdict, "comment": comment, "suggestion": json.dumps(suggestion) if suggestion else None}
    session.feedback.append(row)
    return row


def add_instruction(session, model: str, scope: str, name: str, kind: str, text: str) -> Model:
    """Idempotent: the same instruction again changes nothing."""
    if scope not in SCOPES:
        raise SemanticError("SEMANTIC_AGENT_030", f"Unsupported scope {scope}.")
    if kind not in INSTRUCTION_KINDS:
        raise SemanticError("SEMANTIC_AGENT_031", f"Unsupported kind {kind}.")
    return _kept(session, session.model(model).add_instruction(scope, name, kind, text))


def _kept(session, model: Model) -> Model:
    """Discovery metadata changes a model's content but not its certification: it is validated again."""
    session.add(model)
    if model.schema.upper() in session.published:
        session.validate(model.name)
    return model


def add_verified_query(session, model: str, name: str, obj: str, question: str, request: dict) -> Model:
    """Kept only if it compiles."""
    compiled = session.compile({"model": model, "object": obj, **request}, log=False)
    if compiled.status != "OK":
        raise SemanticError("SEMANTIC_AGENT_032", f"The query doesn't compile: {compiled.error_code} {compiled.error_message}")
    return _kept(session, session.model(model).add_verified_query(name, obj, question, json.dumps(request, sort_keys=True)))


def propose(session, model: str, kind: str, object_type: str, name: str, proposal: dict, reason: str | None = None) -> dict:
    """A change for people to judge; the same proposal twice is one. Nothing in the model changes."""
    m = session.model(model)
    if kind not in PROPOSALS:
        raise SemanticError("SEMANTIC_AGENT_040", f"Unsupported proposal {kind}.")
    tables = {"OBJECT": "objects", "ENTITY": "entities", "RELATIONSHIP": "relationships", "DIMENSION": "dimensions", "FACT": "facts", "METRIC": "metrics", "IDENTITY": "identities"}
    if kind in ("NEW_IDENTITY", "REPRESENTATION_EQUIVALENCE", "AUTHORITY_CHANGE") and object_type != "ENTITY":
        raise SemanticError("SEMANTIC_AGENT_041", f"{kind} must target an existing ENTITY.")
    if kind != "NEW_CONCEPT" and object_type != "MODEL" and (object_type not in tables or m.get(tables[object_type], name) is None):
        raise SemanticError("SEMANTIC_AGENT_041", f"Unknown {object_type} {name}.")
    row = {"model": m.name, "version": m.fingerprint(), "kind": kind, "object_type": object_type, "object_name": name, "proposal": json.dumps(proposal, sort_keys=True), "reason": reason, "status": "PROPOSED"}
    same = next((s for s in session.suggestions if all(s[k] == row[k] for k in ("model", "version", "kind", "object_type", "object_name", "proposal"))), None)
    if same is None:
        same = {"suggestion_id": len(session.suggestions) + 1, **row}
        session.suggestions.append(same)
    return same


def review(session, suggestion_id: int, decision: str, reviewer: str, comment: str | None = None) -> dict:
    """A decision about a proposal on the model version that it was made for; certifying it changes no model."""
    s = next((s for s in session.suggestions if s["suggestion_id"] == suggestion_id), None)
    if s is None or decision not in DECISIONS:
        raise SemanticError("SEMANTIC_AGENT_042", f"Unknown proposal {suggestion_id} or decision {decision}.")
    if s["status"] != "PROPOSED":
        raise SemanticError("SEMANTIC_AGENT_043", f"Proposal {suggestion_id} is {s['status']}.")
    if session.model(s["model"]).fingerprint() != s["version"]:
        raise SemanticError("SEMANTIC_AGENT_044", "The model has changed since the proposal.")
    s["status"] = decision
    row = {"review_id": len(session.reviews) + 1, "suggestion_id": suggestion_id, "decision": decision, "reviewer": reviewer, "comment": comment}
    session.reviews.append(row)
    return row
