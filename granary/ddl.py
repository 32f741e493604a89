"""The authoring dialect: ALTER SEMANTIC VIEW, and SHOW, DESCRIBE, EXPLAIN and EXPORT commands."""

from __future__ import annotations

import dataclasses
import json
import re

from pyspark.sql import DataFrame

from granary.errors import SemanticError
from granary.functions.expressions import ExpressionError, Token, aggregates, closing, references, render, sole_aggregate, substitute, tokenize
from granary.model import Fact, KeyMapping, Metric, Model, ObjectColumn, Synonym
from granary.plans.metrics import Formulas
from granary.plans.sqlfront import split

#: Clause words of facts and metrics.
_FLAGS = ("PUBLIC", "PRIVATE", "CERTIFIED", "ADDITIVE", "DERIVED", "RATIO", "DISTINCT")
_VALUED = ("ON", "AS", "RETURNS", "DISPLAY", "COMMENT", "FORMAT", "SYNONYMS", "FILTER", "DISTINCT_KEY", "WINDOW", "SEMI_ADDITIVE", "NON")


def _error(code: int, message: str) -> SemanticError:
    return SemanticError(f"SEMANTIC_DDL_{code:03d}", message)


def _clauses(tokens: list[Token], what: str) -> dict[str, list[Token]]:
    """Clause word to its tokens, for the text after a fact's or metric's name."""
    out: dict[str, list[Token]] = {}
    depth, now = 0, None
    i = 0
    while i < len(tokens):
        t = tokens[i]
        word = t.upper if t.kind == "name" and depth == 0 else ""
        # Inside AS, a word that an expression could hold starts a clause only where an expression can't go on.
        starts = word in _FLAGS or word in _VALUED
        if starts and word == "DISTINCT" and i and tokens[i - 1].text == "(":
            starts = False
        if starts and now is not None and not out[now] and now in _VALUED and now not in ("SEMI_ADDITIVE", "NON"):
            starts = False
        if starts:
            now = word
            if now in out and now not in ("ADDITIVE",):
                raise _error(20, f"{what} repeats {now}.")
            out[now] = []
        elif now is None:
            raise _error(21, f"{what} has unexpected text {t.text}.")
        else:
            out[now].append(t)
        depth += {"(": 1, ")": -1}.get(t.text if t.kind == "op" else "", 0)
        i += 1
    return out


def _text(tokens: list[Token] | None) -> str | None:
    return tokens[0].value if tokens else None


def _inside(tokens: list[Token], what: str) -> list[Token]:
    if not tokens or tokens[0].text != "(" or closing(tokens, 0) != len(tokens) - 1:
        raise _error(22, f"{what} needs parentheses.")
    return tokens[1:-1]


def _entity(c: dict[str, list[Token]], name: str) -> str:
    on = c.get("ON")
    if not on or on[0].upper != "ENTITY" or len(on) != 2:
        raise _error(23, f"{name} needs ON ENTITY name.")
    return on[1].value


def parse_fact(tokens: list[Token]) -> Fact:
    name, c = tokens[0].value, _clauses(tokens[1:], tokens[0].value)
    if not c.get("AS") or not c.get("RETURNS"):
        raise _error(24, f"Fact {name} needs AS and RETURNS.")
    policy = "NON_ADDITIVE" if "NON" in c else "SEMI_ADDITIVE" if "SEMI_ADDITIVE" in c else "ADDITIVE"
    by = c.get("NON") or c.get("SEMI_ADDITIVE") or []
    by = [t.value for t in by if t.kind == "name" and t.upper not in ("ADDITIVE", "BY", "NON", "OVER")]
    return Fact(name, _entity(c, f"Fact {name}"), render(c["AS"]), render(c["RETURNS"]).replace(", ", ","), policy, _text(c.get("DISPLAY")), _text(c.get("COMMENT")), "PRIVATE" in c, "CERTIFIED" in c, by[0] if by else None)


def parse_metric(tokens: list[Token]) -> tuple[Metric, list[str]]:
    """A metric and its synonyms."""
    name, c = tokens[0].value, _clauses(tokens[1:], tokens[0].value)
    if not c.get("AS") or not c.get("RETURNS"):
        raise _error(30, f"Metric {name} needs AS and RETURNS.")
    predicate = None
    if "FILTER" in c:
        inner = _inside(c["FILTER"], "FILTER")
        if not inner or inner[0].upper != "WHERE":
            raise _error(31, f"FILTER of {name} needs (WHERE predicate).")
        predicate = render(inner[1:])
    synonyms = [p[0].value for p in split(_inside(c["SYNONYMS"], "SYNONYMS"), ",") if p] if "SYNONYMS" in c else []
    semi = "SEMI_ADDITIVE" in c or "NON" in c
    kind = "WINDOW" if "WINDOW" in c else "RATIO" if "RATIO" in c else "DISTINCT" if "DISTINCT" in c else "DERIVED" if "DERIVED" in c else "SEMI_ADDITIVE" if "SEMI_ADDITIVE" in c else "FILTERED" if predicate else "SIMPLE"
    by = [t.value for t in (c.get("SEMI_ADDITIVE") or c.get("NON") or []) if t.kind == "name" and t.upper not in ("ADDITIVE", "BY", "NON", "OVER")]
    metric = Metric(
        name,
        render(c["AS"]),
        _entity(c, f"Metric {name}"),
        predicate,
        "SEMI_ADDITIVE" if "SEMI_ADDITIVE" in c else "NON_ADDITIVE" if semi or kind in ("RATIO", "DISTINCT", "DERIVED", "WINDOW") else "ADDITIVE",
        kind,
        render(c["RETURNS"]).replace(", ", ","),
        _text(c.get("DISPLAY")),
        _text(c.get("COMMENT")),
        _text(c.get("FORMAT")),
        "PRIVATE" in c,
        "CERTIFIED" in c,
        _text(c.get("DISTINCT_KEY")) or (_text(c["DISTINCT"]) if c.get("DISTINCT") else None),
        by[0] if by else None,
        render(c["WINDOW"]) if c.get("WINDOW") else None,
    )
    return metric, synonyms


def check_shape(model: Model, metric: Metric) -> None:
    """A metric's kind must fit its formula."""
    facts, inner, _ = Formulas(model).inputs(metric)
    if metric.kind == "RATIO" and len(inner) < 2:
        tokens, found = aggregates(metric.expression)
        if not (len(found) >= 2 and any(t.text == "/" for t in tokens)):
            raise _error(70, f"RATIO metric {metric.name} needs two metrics, or a division of aggregates.")
    whole = sole_aggregate(metric.expression)
    if metric.kind == "DISTINCT" and not metric.distinct_key and not (whole and whole.distinct):
        raise _error(71, f"DISTINCT metric {metric.name} needs a key.")
    if metric.kind == "SEMI_ADDITIVE" and not metric.non_additive_by:
        raise _error(72, f"SEMI_ADDITIVE metric {metric.name} needs a dimension.")
    if metric.non_additive_by and model.get("dimensions", metric.non_additive_by) is None:
        raise _error(73, f"Metric {metric.name} names the unknown dimension {metric.non_additive_by}.")
    if metric.kind == "WINDOW" and not metric.window:
        raise _error(74, f"WINDOW metric {metric.name} needs a specification.")


@dataclasses.dataclass
class Definition:
    model: str
    object: str
    operations: list[tuple]

    def normalized(self) -> str:
        def plain(x):
            if isinstance(x, (list, tuple)):
                return [plain(v) for v in x]
            return dataclasses.asdict(x) if dataclasses.is_dataclass(x) else x

        return json.dumps({"model": self.model, "object": self.object, "operations": [[plain(p) for p in op] for op in self.operations]}, sort_keys=True)


def parse_definition(text: str) -> Definition:
    try:
        tokens = tokenize(text.strip().rstrip(";"))
    except ExpressionError as e:
        raise _error(1, f"Definition can't be read: {e}.") from e
    if [t.upper for t in tokens[:3]] != ["ALTER", "SEMANTIC", "VIEW"]:
        raise _error(1, "Definition must start with ALTER SEMANTIC VIEW.")
    if len(tokens) < 6 or tokens[4].text != ".":
        raise _error(2, "ALTER SEMANTIC VIEW needs model.object.")
    out = Definition(tokens[3].value, tokens[5].value, [])
    i = 6
    while i < len(tokens):
        words = [t.upper for t in tokens[i : i + 4]]
        if words[:2] == ["REPLACE", "FACTS"] or words[:2] == ["REPLACE", "METRICS"]:
            if i + 2 >= len(tokens) or tokens[i + 2].text != "(":
                raise _error(10, f"{' '.join(words[:2])} needs a list in parentheses.")
            end = closing(tokens, i + 2)
            word = words[1][:-1]
            items = []
            for part in split(tokens[i + 3 : end], ","):
                if not part or part[0].upper != word:
                    raise _error(11, f"Items of {' '.join(words[:2])} start with {word}.")
                items.append(parse_fact(part[1:]) if word == "FACT" else parse_metric(part[1:]))
            out.operations.append((f"REPLACE_{words[1]}", items))
            i = end + 1
        elif words[:4] in (["ADD", "OR", "REPLACE", "METRIC"], ["ADD", "OR", "REPLACE", "FACT"]):
            ends = [k for k in range(i + 4, len(tokens)) if [t.upper for t in tokens[k : k + 4]] in (["ADD", "OR", "REPLACE", "METRIC"], ["ADD", "OR", "REPLACE", "FACT"]) or tokens[k].upper in ("DROP", "RENAME")]
            end = ends[0] if ends else len(tokens)
            part = tokens[i + 4 : end]
            if not part:
                raise _error(12, "ADD OR REPLACE needs a definition.")
            out.operations.append(("UPSERT_FACT", parse_fact(part)) if words[3] == "FACT" else ("UPSERT_METRIC", parse_metric(part)))
            i = end
        elif words[:2] == ["DROP", "METRIC"] and i + 2 < len(tokens):
            out.operations.append(("DROP_METRIC", tokens[i + 2].value))
            i += 3
        elif words[:2] == ["RENAME", "METRIC"] and i + 4 < len(tokens) and tokens[i + 3].upper == "TO":
            out.operations.append(("RENAME_METRIC", tokens[i + 2].value, tokens[i + 4].value))
            i += 5
        else:
            raise _error(12, f"Unsupported definition text at {tokens[i].text}.")
    if not out.operations:
        raise _error(10, "Definition changes nothing.")
    return out


# -- applying --------------------------------------------------------------------------------------------------
def _upsert_fact(model: Model, obj: str, fact: Fact) -> Model:
    if model.get("entities", fact.entity) is None:
        raise _error(40, f"Fact {fact.name} names the unknown entity {fact.entity}.")
    return model.with_("facts", fact.name, fact).show(obj, "FACT", fact.name, not fact.private)


def _upsert_metric(model: Model, obj: str, metric: Metric, synonyms: list[str]) -> Model:
    if model.get("entities", metric.base_entity) is None:
        raise _error(41, f"Metric {metric.name} names the unknown entity {metric.base_entity}.")
    old = next((c for c in model.get("objects", obj).columns if c.kind == "METRIC" and c.name.upper() == metric.name.upper()), None)
    out = model.with_("metrics", metric.name, metric).show(obj, "METRIC", metric.name, not metric.private, old.ordinal if old else None)
    for s in synonyms:
        out = out.add_synonym("METRIC", metric.name, s)
    return out


def _drop_metric(model: Model, obj: str, name: str) -> Model:
    if not any(c.kind == "METRIC" and c.name.upper() == name.upper() for c in model.get("objects", obj).columns):
        raise _error(42, f"{obj} has no metric {name}.")
    out = model.hide(obj, "METRIC", name)
    if not any(c.kind == "METRIC" and c.name.upper() == name.upper() for o in out.objects.values() for c in o.columns):
        out = out.without("metrics", name)
        for key in [k for k, s in out.synonyms.items() if s.kind == "METRIC" and s.name.upper() == name.upper()]:
            out = out.without("synonyms", key)
    return out


def rename_metric(model: Model, old: str, new: str) -> Model:
    """The metric under a new name at its old place, dependents rewritten, the old name kept as a synonym."""
    record = model.get("metrics", old)
    if record is None:
        raise _error(50, f"Unknown metric {old}.")
    if model.get("metrics", new) is not None:
        raise _error(51, f"Metric {new} exists.")

    def moved(x: Metric) -> Metric:
        text = substitute(x.expression, bare=lambda n: new if n.upper() == old.upper() else None)
        return dataclasses.replace(x, expression=text)

    metrics = {}
    for key, x in model.metrics.items():
        metrics[new.upper() if key == old.upper() else key] = dataclasses.replace(x, name=new) if key == old.upper() else moved(x)
    objects = {
        k: dataclasses.replace(o, columns=tuple(ObjectColumn(c.kind, new, c.ordinal, c.visible) if c.kind == "METRIC" and c.name.upper() == old.upper() else c for c in o.columns))
        for k, o in model.objects.items()
    }
    synonyms = {}
    for s in model.synonyms.values():
        s = dataclasses.replace(s, name=new) if s.kind == "METRIC" and s.name.upper() == old.upper() else s
        synonyms[f"{s.kind}.{s.name}.{s.synonym}".upper()] = s
    synonyms[f"METRIC.{new}.{old}".upper()] = Synonym("METRIC", new, old, "RENAME")
    materializations = {
        k: dataclasses.replace(m, columns=tuple(dataclasses.replace(c, name=new) if c.kind == "METRIC" and c.name.upper() == old.upper() else c for c in m.columns))
        for k, m in model.materializations.items()
    }
    return dataclasses.replace(model, metrics=metrics, objects=objects, synonyms=synonyms, materializations=materializations)


def changed(model: Model, definition: Definition) -> Model:
    obj = model.get("objects", definition.object)
    if obj is None:
        raise _error(35, f"Unknown semantic object {definition.object}.")
    out, checked = model, []
    for op, *args in definition.operations:
        if op == "REPLACE_FACTS":
            keep = {f.name.upper() for f in args[0]}
            for name in [c.name for c in out.get("objects", obj.name).columns if c.kind == "FACT" and c.name.upper() not in keep]:
                out = out.hide(obj.name, "FACT", name)
            for f in args[0]:
                out = _upsert_fact(out, obj.name, f)
        elif op == "REPLACE_METRICS":
            keep = {m.name.upper() for m, _ in args[0]}
            for name in [c.name for c in out.get("objects", obj.name).columns if c.kind == "METRIC" and c.name.upper() not in keep]:
                out = _drop_metric(out, obj.name, name)
            for m, synonyms in args[0]:
                out = _upsert_metric(out, obj.name, m, synonyms)
                checked.append(m)
        elif op == "UPSERT_FACT":
            out = _upsert_fact(out, obj.name, args[0])
        elif op == "UPSERT_METRIC":
            out = _upsert_metric(out, obj.name, *args[0])
            checked.append(args[0][0])
        elif op == "DROP_METRIC":
            out = _drop_metric(out, obj.name, args[0])
        else:
            out = rename_metric(out, *args)
    for m in checked:
        check_shape(out, m)
    return out


def apply(session, text: str, dry_run: bool = False) -> dict:
    """Apply a definition, validate, and keep the change only if the model is valid."""
    row = {"status": "ERROR", "error_code": None, "message": None, "normalized": None, "operations": None, "validation_run_id": None}
    try:
        definition = parse_definition(text)
        model = session.models.get(definition.model.upper())
        if model is None:
            raise _error(34, f"Unknown model {definition.model}.")
        row |= {"normalized": definition.normalized(), "operations": len(definition.operations)}
        session.add(changed(model, definition))
    except SemanticError as e:
        return row | {"error_code": e.code, "message": e.message}
    report = session.validate(model.name)
    row["validation_run_id"] = report.run_id
    errors = "; ".join(f"{i.code} {i.object_type} {i.object_name}: {i.message}" for i in report.issues if i.severity in ("ERROR", "PRECONDITION"))
    if not report.ok or dry_run:
        session.add(model)
    if not report.ok:
        what = "Dry-run rejected" if dry_run else "Definition rejected"
        end = "No catalog changes were committed." if dry_run else "Catalog state was restored."
        return row | {"error_code": "SEMANTIC_DDL_090", "message": f"{what}; validation failed: {errors}. {end}"}
    if dry_run:
        return row | {"status": "DRY_RUN", "message": "Definition is valid; no catalog changes were committed."}
    return row | {"status": "APPLIED", "message": "Definition was applied."}


# -- commands --------------------------------------------------------------------------------------------------
_SHOW_VIEW = re.compile(r"SHOW\s+SEMANTIC\s+VIEW\s+(\S+)\Z", re.I)
_SHOW_VIEWS = re.compile(r"SHOW\s+SEMANTIC\s+VIEWS(?:\s+IN\s+(\S+))?\Z", re.I)
_SHOW_METRICS = re.compile(r"SHOW\s+SEMANTIC\s+METRICS(?:\s+IN\s+(\S+))?\Z", re.I)
_SHOW_DIMENSIONS = re.compile(r"SHOW\s+(ALL\s+)?SEMANTIC\s+DIMENSIONS\s+FOR\s+METRIC(?:\s+(\S+))?\Z", re.I)
_METRIC = re.compile(r"(DESCRIBE|EXPLAIN|EXPORT)\s+SEMANTIC\s+METRIC(?:\s+(\S+))?\Z", re.I)
_EXPORT = re.compile(r"EXPORT\s+SEMANTIC\s+(VIEW|MODEL)(?:\s+(\S+))?\Z", re.I)
_QUERY = re.compile(r"EXPLAIN\s+SEMANTIC\s+QUERY\s+(.+)\Z", re.I | re.S)


def _path(text: str | None, parts: int, code: int, message: str) -> list[str]:
    names = [p.strip('"`') for p in (text or "").split(".") if p]
    if len(names) != parts:
        raise _error(code, message)
    return names


def _object(session, model: str, obj: str):
    m = session.model(model)
    o = m.get("objects", obj)
    if o is None:
        raise SemanticError("SEMANTIC_REQUEST_012", f"Semantic object not found: {obj}")
    return m, o


def _rows(session, rows: list[tuple], schema: str) -> DataFrame:
    return session.spark.createDataFrame(rows, schema)


def execute(session, text: str) -> DataFrame | None:
    """The answer to an authoring or discovery command, or None for any other text."""
    text = text.strip().rstrip(";").strip()
    head = text.upper().split()[:3]
    if head[:2] == ["ALTER", "SEMANTIC"]:
        row = apply(session, text)
        if row["status"] == "ERROR":
            raise SemanticError(row["error_code"], row["message"])
        return _rows(session, [tuple(row.values())], "status string, error_code string, message string, normalized string, operations long, validation_run_id long")
    if len(head) < 2 or "SEMANTIC" not in head:
        return None
    if m := _SHOW_VIEWS.match(text):
        rows = [(x.name, o.name, x.schema, o.root, o.description) for x in session.models.values() if not m[1] or x.name.upper() == m[1].upper() for o in x.objects.values()]
        return _rows(session, rows, "model_name string, object_name string, published_schema string, root_entity string, description string")
    if m := _SHOW_VIEW.match(text):
        model, obj = _object(session, *_path(m[1], 2, 67, "SHOW SEMANTIC VIEW requires model.object."))
        rows = []
        for c in sorted(obj.columns, key=lambda c: c.ordinal):
            x = model.get({"DIMENSION": "dimensions", "FACT": "facts", "METRIC": "metrics"}[c.kind], c.name)
            rows.append((c.ordinal, c.kind, c.name, x.expression, x.data_type, x.description, c.visible))
        return _rows(session, rows, "ordinal int, kind string, name string, expression string, data_type string, description string, is_visible boolean")
    if m := _SHOW_METRICS.match(text):
        model, obj = _object(session, *_path(m[1], 2, 60, "SHOW SEMANTIC METRICS requires IN model.object."))
        rows = [(x.name, x.expression, x.filter, x.kind, x.metric_type, x.data_type, x.display, x.description) for x in (model.get("metrics", n) for n in obj.visible("METRIC"))]
        return _rows(session, rows, "metric_name string, expression string, filter string, kind string, metric_type string, data_type string, display string, description string")
    if m := _SHOW_DIMENSIONS.match(text):
        model_name, object_name, metric = _path(m[2], 3, 61, "SHOW SEMANTIC DIMENSIONS FOR METRIC requires model.object.metric.")
        model, obj = _object(session, model_name, object_name)
        report = session.reports.get(model.fingerprint())
        rows = [report.matrix.get((metric.upper(), d.upper())) for d in obj.visible("DIMENSION")] if report else []
        rows = [(r["metric"], r["dimension"], r["valid"], r["reason"], r["path"]) for r in rows if r and (r["valid"] or m[1])]
        return _rows(session, rows, "metric_name string, dimension_name string, is_valid boolean, reason string, path string")
    if m := _METRIC.match(text):
        word = m[1].upper()
        code = {"DESCRIBE": 62, "EXPLAIN": 63, "EXPORT": 64}[word]
        model_name, object_name, name = _path(m[2], 3, code, f"{word} SEMANTIC METRIC requires model.object.metric.")
        model, obj = _object(session, model_name, object_name)
        metric = model.get("metrics", name)
        if metric is None or not any(c.kind == "METRIC" and c.name.upper() == name.upper() for c in obj.columns):
            raise SemanticError("SEMANTIC_REQUEST_020", f"Unknown semantic field: {name}")
        if word == "EXPORT":
            return _rows(session, [(export(model, obj.name, metric.name),)], "definition string")
        return _rows(session, describe_metric(session, model, metric, deep=word == "EXPLAIN"), "property string, value string")
    if m := _EXPORT.match(text):
        if m[1].upper() == "VIEW":
            model, obj = _object(session, *_path(m[2], 2, 65, "EXPORT SEMANTIC VIEW requires model.object."))
            return _rows(session, [(export(model, obj.name),)], "definition string")
        (name,) = _path(m[2], 1, 66, "EXPORT SEMANTIC MODEL requires a model name.")
        model = session.model(name)
        return _rows(session, [(export(model, o.name),) for o in model.objects.values()], "definition string")
    if m := _QUERY.match(text):
        told = session.explain(m[1])
        rows = [(k, v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True, default=str)) for k, v in told.items()]
        return _rows(session, rows, "property string, value string")
    return None


def describe_metric(session, model: Model, metric: Metric, deep: bool = False) -> list[tuple[str, str | None]]:
    formulas = Formulas(model)
    facts, inner, _ = formulas.inputs(metric)
    rows = [(f.name, None if getattr(metric, f.name) is None else str(getattr(metric, f.name))) for f in dataclasses.fields(metric)]
    rows += [("facts", ", ".join(facts)), ("metrics", ", ".join(inner)), ("aggregate_state", formulas.classify(metric))]
    rows.append(("synonyms", ", ".join(s.synonym for s in model.synonyms.values() if s.kind == "METRIC" and s.name.upper() == metric.name.upper())))
    if deep:
        for x in formulas.order([metric.name]):
            f, i, _ = formulas.inputs(x)
            rows.append((f"lineage.{x.name}", f"{x.expression} <- {', '.join([*f, *i]) or 'constants'}"))
        for f in dict.fromkeys(n for x in formulas.order([metric.name]) for n in formulas.inputs(x)[0]):
            fact = model.get("facts", f)
            rows.append((f"lineage.{f}", f"{fact.expression} @ {fact.entity}"))
        report = session.reports.get(model.fingerprint())
        valid = [r["dimension"] for (m, _), r in (report.matrix if report else {}).items() if m == metric.name.upper() and r["valid"]]
        rows.append(("compatible_dimensions", ", ".join(valid)))
    return rows


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fact_text(f: Fact) -> str:
    lines = [f"FACT {f.name}", f"ON ENTITY {f.entity}", f"AS {f.expression}", f"RETURNS {f.data_type}"]
    lines.append("ADDITIVE" if f.policy == "ADDITIVE" else f"{'NON ADDITIVE' if f.policy == 'NON_ADDITIVE' else 'SEMI_ADDITIVE'}{f' BY {f.non_additive_by}' if f.non_additive_by else ''}")
    lines += [f"DISPLAY {_quote(f.display)}"] if f.display else []
    lines += [f"COMMENT {_quote(f.description)}"] if f.description else []
    return "\n    ".join([*lines, ("PRIVATE" if f.private else "PUBLIC") + (" CERTIFIED" if f.certified else "")])


def _metric_text(model: Model, m: Metric) -> str:
    lines = [f"METRIC {m.name}", f"AS {m.expression}", f"ON ENTITY {m.base_entity}", f"RETURNS {m.data_type}"]
    lines += [f"FILTER (WHERE {m.filter})"] if m.filter else []
    lines += [f"FORMAT {_quote(m.format)}"] if m.format else []
    lines += [f"DISPLAY {_quote(m.display)}"] if m.display else []
    lines += [f"COMMENT {_quote(m.description)}"] if m.description else []
    synonyms = [s.synonym for s in model.synonyms.values() if s.kind == "METRIC" and s.name.upper() == m.name.upper()]
    lines += [f"SYNONYMS ({', '.join(_quote(s) for s in synonyms)})"] if synonyms else []
    lines += [f"DISTINCT_KEY {m.distinct_key}"] if m.distinct_key else []
    lines += [f"WINDOW ({m.window.strip('()')})"] if m.window else []
    kind = {"RATIO": "RATIO", "DERIVED": "DERIVED", "DISTINCT": "DISTINCT"}.get(m.kind)
    if m.kind == "SEMI_ADDITIVE":
        kind = f"SEMI_ADDITIVE BY {m.non_additive_by}"
    lines += [kind] if kind else ["ADDITIVE"] if m.metric_type == "ADDITIVE" else []
    return "\n    ".join([*lines, ("PRIVATE" if m.private else "PUBLIC") + (" CERTIFIED" if m.certified else "")])


def export(model: Model, obj: str, metric: str | None = None) -> str:
    """The statement that defines a metric, or an object's facts and metrics, again."""
    if metric:
        return f"ALTER SEMANTIC VIEW {model.name}.{obj}\nADD OR REPLACE METRIC {_metric_text(model, model.get('metrics', metric))[len('METRIC ') :]};"
    columns = sorted(model.get("objects", obj).columns, key=lambda c: c.ordinal)
    facts = [model.get("facts", c.name) for c in columns if c.kind == "FACT"]
    metrics = [model.get("metrics", c.name) for c in columns if c.kind == "METRIC"]
    parts = [f"ALTER SEMANTIC VIEW {model.name}.{obj}"]
    if facts:
        parts.append("REPLACE FACTS (\n  " + ",\n  ".join(_fact_text(f) for f in facts) + "\n)")
    if metrics:
        parts.append("REPLACE METRICS (\n  " + ",\n  ".join(_metric_text(model, m) for m in metrics) + "\n)")
    return "\n".join(parts) + ";"


def suggest_grain(model: Model) -> list[dict]:
    """Keys from ``alias.column`` primary keys, and mappings from joins on one equality; a dry run."""
    out = []
    for e in model.entities.values():
        if e.primary_key and not model.keys_of(e.name):
            refs = references(e.primary_key)
            if len(refs.qualified) == 1 and len(tokenize(e.primary_key)) == 3:
                out.append({"kind": "UNIQUE_KEY", "entity": e.name, "columns": [refs.qualified[0][1]]})
    for r in model.relationships.values():
        tokens = tokenize(r.condition)
        if r.mappings or len(tokens) != 7 or tokens[3].text != "=":
            continue
        a, b = (tokens[0].value, tokens[2].value), (tokens[4].value, tokens[6].value)
        start = model.get("entities", r.from_entity).alias.upper()
        if a[0].upper() != start:
            a, b = b, a
        if a[0].upper() == start:
            out.append({"kind": "KEY_MAPPING", "relationship": r.name, "from_column": a[1], "to_column": b[1]})
    return out


def apply_suggestions(model: Model, suggestions: list[dict]) -> Model:
    for s in suggestions:
        if s["kind"] == "UNIQUE_KEY":
            model = model.add_key(s["entity"], "pk", s["columns"])
        else:
            r = model.get("relationships", s["relationship"])
            model = model.with_("relationships", r.name, dataclasses.replace(r, mappings=(KeyMapping(s["from_column"], s["to_column"]),)))
    return model
