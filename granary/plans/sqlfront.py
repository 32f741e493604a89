"""The semantic SQL dialect: one SELECT over schema.object, parsed to a structured request."""

from __future__ import annotations

import json

from granary.errors import SemanticError
from granary.functions.expressions import ExpressionError, Token, render, tokenize

_CLAUSES = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT")
_COMPARE = ("=", "!=", "<>", "<", "<=", ">", ">=")


def is_select(text: str) -> bool:
    try:
        tokens = tokenize(text)
    except ExpressionError:
        return False
    return bool(tokens) and tokens[0].upper == "SELECT"


def split(tokens: list[Token], word: str) -> list[list[Token]]:
    """Parts between a separator at depth 0; the AND of a BETWEEN separates nothing."""
    out, depth, between = [[]], 0, False
    for t in tokens:
        depth += {"(": 1, ")": -1}.get(t.text if t.kind == "op" else "", 0)
        if depth == 0 and t.upper == "BETWEEN":
            between = True
        if depth == 0 and (t.upper if t.kind == "name" else t.text) == word:
            if word == "AND" and between:
                between = False
            else:
                out.append([])
                continue
        out[-1].append(t)
    return out


def target(text: str) -> tuple[str, str] | None:
    """(schema, object) of a SELECT's FROM, or None if it has another shape."""
    try:
        tokens = tokenize(text)
    except ExpressionError:
        return None
    depth = 0
    for i, t in enumerate(tokens):
        depth += {"(": 1, ")": -1}.get(t.text if t.kind == "op" else "", 0)
        if depth == 0 and t.upper == "FROM":
            part = tokens[i + 1 : i + 4]
            if len(part) == 3 and part[1].text == "." and all(p.kind in ("name", "quoted") for p in (part[0], part[2])):
                return part[0].value, part[2].value
            return None
    return None


def _literal(tokens: list[Token]):
    """(is a literal, value)."""
    if len(tokens) == 1:
        t = tokens[0]
        if t.kind == "string":
            return True, t.value
        if t.kind == "number":
            return True, json.loads(t.text) if not t.text.startswith(".") else float(t.text)
        if t.upper in ("TRUE", "FALSE"):
            return True, t.upper == "TRUE"
        if t.upper == "NULL":
            return False, None
    if len(tokens) == 2:
        if tokens[0].text == "-" and tokens[1].kind == "number":
            return True, -json.loads(tokens[1].text)
        if tokens[0].upper in ("DATE", "TIMESTAMP") and tokens[1].kind == "string":
            return True, tokens[1].value
    return False, None


def _measure(tokens: list[Token]) -> tuple[list[Token], bool]:
    """The name inside MEASURE(...) or agg(...), and whether there was one."""
    if len(tokens) >= 4 and tokens[0].upper in ("MEASURE", "AGG") and tokens[1].text == "(" and tokens[-1].text == ")":
        return tokens[2:-1], True
    return tokens, False


def _name(tokens: list[Token], alias: str | None) -> str | None:
    if len(tokens) == 3 and tokens[1].text == "." and tokens[0].value.upper() == (alias or "").upper():
        tokens = tokens[2:]
    return tokens[0].value if len(tokens) == 1 and tokens[0].kind in ("name", "quoted") else None


def _predicate(tokens: list[Token], alias: str | None, clause: str) -> dict:
    words = [t.upper for t in tokens]
    if "OR" in words or "NOT" in words and "IS" not in words:
        raise SemanticError("SEMANTIC_QUERY_030", f"Unsupported {clause} predicate: OR and NOT aren't supported.")
    if tokens and tokens[0].text == "(" or any(w in ("SELECT", "EXISTS") for w in words):
        raise SemanticError("SEMANTIC_QUERY_030", f"Unsupported {clause} predicate.")
    at = next((i for i, t in enumerate(tokens) if t.text in _COMPARE or t.upper in ("LIKE", "IN", "BETWEEN", "IS")), None)
    if at is None:
        raise SemanticError("SEMANTIC_QUERY_030", f"Unsupported {clause} predicate.")
    part, _ = _measure(tokens[:at])
    field = _name(part, alias)
    if field is None:
        raise SemanticError("SEMANTIC_QUERY_031", f"{clause} predicate must start with a semantic field.")
    op, rest = tokens[at].upper if tokens[at].kind == "name" else tokens[at].text, tokens[at + 1 :]
    if op == "IS":
        tail = " ".join(t.upper for t in rest)
        if tail not in ("NULL", "NOT NULL"):
            raise SemanticError("SEMANTIC_QUERY_036", "Null predicate requires exactly 'field IS NULL' or 'field IS NOT NULL'.")
        return {"field": field, "op": f"IS {tail}"}
    if op == "IN":
        if len(rest) < 2 or rest[0].text != "(" or rest[-1].text != ")":
            raise SemanticError("SEMANTIC_QUERY_032", "IN predicate requires a literal list.")
        values = [_literal(p) for p in split(rest[1:-1], ",")]
        if not all(ok for ok, _ in values):
            raise SemanticError("SEMANTIC_QUERY_033", "IN predicate supports literal values only.")
        return {"field": field, "op": "IN", "value": [v for _, v in values]}
    if op == "BETWEEN":
        cut = next((i for i, t in enumerate(rest) if t.upper == "AND"), None)
        if cut is None:
            raise SemanticError("SEMANTIC_QUERY_034", "BETWEEN predicate requires 'field BETWEEN value1 AND value2'.")
        (a, low), (b, high) = _literal(rest[:cut]), _literal(rest[cut + 1 :])
        if not (a and b):
            raise SemanticError("SEMANTIC_QUERY_035", "BETWEEN predicate requires two literal values.")
        return {"field": field, "op": "BETWEEN", "value": [low, high]}
    if not rest:
        raise SemanticError("SEMANTIC_QUERY_033", f"{clause} predicate requires a right-hand value.")
    ok, value = _literal(rest)
    return {"field": field, "op": op, "value": value} if ok else {"field": field, "op": op, "value_sql": render(rest)}


def parse(text: str, find) -> dict:
    """A structured request. ``find(schema, object)`` gives (planner, model name, object record) or None."""
    try:
        tokens = tokenize(text.strip())
    except ExpressionError as e:
        raise SemanticError("SEMANTIC_QUERY_001", f"SQL can't be read: {e}.") from e
    while tokens and tokens[-1].text == ";":
        tokens.pop()
    if not tokens:
        raise SemanticError("SEMANTIC_QUERY_001", "SQL text is required.")
    if tokens[0].upper != "SELECT":
        raise SemanticError("SEMANTIC_QUERY_009", "Only top-level SELECT semantic SQL is supported.")
    clauses: dict[str, list[Token]] = {"SELECT": []}
    now, depth, i = "SELECT", 0, 1
    while i < len(tokens):
        t = tokens[i]
        depth += {"(": 1, ")": -1}.get(t.text if t.kind == "op" else "", 0)
        word = t.upper if t.kind == "name" and depth == 0 else ""
        if word == "FROM" and "FROM" not in clauses or word in _CLAUSES and "FROM" in clauses and (word not in ("GROUP", "ORDER") or i + 1 < len(tokens) and tokens[i + 1].upper == "BY"):
            now = word
            clauses[now] = []
            i += 2 if word in ("GROUP", "ORDER") else 1
            continue
        clauses[now].append(t)
        i += 1
    if not clauses.get("FROM"):
        raise SemanticError("SEMANTIC_QUERY_002", "Semantic SQL requires a FROM clause.")
    source = clauses["FROM"]
    shape = "FROM must reference one published semantic object as schema.object."
    if len(source) < 3 or source[1].text != ".":
        raise SemanticError("SEMANTIC_QUERY_003", shape)
    rest = [t for t in source[3:] if t.upper != "AS"]
    if len(rest) > 1 or rest and rest[0].kind not in ("name", "quoted"):
        raise SemanticError("SEMANTIC_QUERY_003", shape)
    alias = rest[0].value if rest else source[2].value
    found = find(source[0].value, source[2].value)
    if found is None:
        raise SemanticError("SEMANTIC_QUERY_004", f"No semantic model is published to schema {source[0].value}.")
    planner, model, obj = found

    fields: list[tuple[str, str, str | None]] = []  # kind, name, alias
    if [t.text for t in clauses["SELECT"]] == ["*"]:
        fields = [("DIMENSION", n, None) for n in obj.visible("DIMENSION")] + [("METRIC", n, None) for n in obj.visible("METRIC")]
    else:
        for part in split(clauses["SELECT"], ","):
            label = None
            if len(part) > 2 and part[-2].upper == "AS":
                part, label = part[:-2], part[-1].value
            elif len(part) > 1 and part[-1].kind in ("name", "quoted") and part[-2].text not in (".", "("):
                part, label = part[:-1], part[-1].value
            inner, wrapped = _measure(part)
            name = _name(inner, alias)
            if name is None:
                raise SemanticError("SEMANTIC_QUERY_005", "SELECT supports semantic field names, MEASURE(metric), or *.")
            kind, canonical = planner.resolve(obj, name)
            if wrapped and kind != "METRIC":
                raise SemanticError("SEMANTIC_QUERY_006", f"MEASURE()/agg() may only wrap a metric, not '{canonical}'.")
            fields.append((kind, canonical, label))
    dimensions = [n for k, n, _ in fields if k == "DIMENSION"]
    metrics = [n for k, n, _ in fields if k == "METRIC"]

    def by_name(part: list[Token]) -> str | None:
        inner, _ = _measure(part)
        if len(inner) == 1 and inner[0].kind == "number":
            k = int(inner[0].text) if inner[0].text.isdigit() else 0
            return fields[k - 1][1] if 1 <= k <= len(fields) else None
        name = _name(inner, alias)
        if name is None:
            return None
        labelled = [n for _, n, label in fields if label and label.upper() == name.upper()]
        return labelled[0] if labelled else planner.resolve(obj, name)[1]

    filters, having = [], []
    for part in split(clauses["WHERE"], "AND") if clauses.get("WHERE") else []:
        p = _predicate(part, alias, "WHERE")
        kind, name = planner.resolve(obj, p["field"])
        (having if kind == "METRIC" else filters).append({**p, "field": name})
    for part in split(clauses["HAVING"], "AND") if clauses.get("HAVING") else []:
        p = _predicate(part, alias, "HAVING")
        name = by_name([Token("quoted", f'"{p["field"]}"')]) or p["field"]
        having.append({**p, "field": name})
    if "GROUP" in clauses and [t.upper for t in clauses["GROUP"]] != ["ALL"]:
        if not dimensions:
            raise SemanticError("SEMANTIC_QUERY_008", "GROUP BY is only supported for selected dimensions.")
        named = []
        for part in split(clauses["GROUP"], ","):
            name = by_name(part)
            if name is None or name in metrics:
                raise SemanticError("SEMANTIC_QUERY_008", "GROUP BY supports selected dimensions by name or ordinal.")
            named.append(name)
        for d in dimensions:
            if d not in named:
                raise SemanticError("SEMANTIC_QUERY_008", f"GROUP BY must cover selected dimension {d}.")
        if set(named) - set(dimensions):
            raise SemanticError("SEMANTIC_QUERY_008", "GROUP BY must not contain dimensions outside the SELECT list.")
    order = []
    for part in split(clauses["ORDER"], ",") if clauses.get("ORDER") else []:
        way = "ASC"
        if part and part[-1].upper in ("ASC", "DESC"):
            way, part = part[-1].upper, part[:-1]
        name = by_name(part)
        if name is None:
            raise SemanticError("SEMANTIC_QUERY_060", "ORDER BY supports selected fields by name, alias or ordinal.")
        order.append({"field": name, "direction": way})
    request = {"model": model, "object": obj.name, "metrics": metrics, "dimensions": dimensions, "filters": filters, "having": having, "order_by": order}
    if "LIMIT" in clauses:
        part = clauses["LIMIT"]
        if len(part) != 1 or not part[0].text.isdigit() or int(part[0].text) < 1:
            raise SemanticError("SEMANTIC_QUERY_050", "LIMIT must be a positive integer literal.")
        request["limit"] = int(part[0].text)
    return request
