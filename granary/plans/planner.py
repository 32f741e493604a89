"""From a request to a plan: resolve names, check certification, prove grain, choose sources, lay out branches.

The plan is a dictionary that ``json.dumps`` can write; equal requests on an equal model give equal plans. A plan
has branches, each an aggregation at one entity's grain; one branch needs no merge, several are merged as
aggregate states, so facts are never joined to facts.
"""

from __future__ import annotations

import re

from granary.errors import SemanticError
from granary.functions.catalog import ALLOWED, RHS_FUNCTIONS, type_family
from granary.functions.expressions import IDENTIFIER, ExpressionError, Token, closing, references, render, sole_aggregate, substitute, to_spark, tokenize
from granary.model import Dimension, Model
from granary.plans import navigator
from granary.plans.fusion import Chosen, Fusion
from granary.plans.graph import Edge, Graph, Proof
from granary.plans.metrics import Formulas, Unit, unit_sql
from granary.plans.request import MAX_LIMIT, OPERATORS, QuerySpec, predicate_parts

MAX_BRANCHES = 8
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}")
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")


def literal(value, data_type: str | None) -> str:
    """A value as a Spark SQL literal of a field's declared type."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    family, text = type_family(data_type), str(value)
    if isinstance(value, (int, float)) and family != "string":
        return repr(value)
    if family == "numeric" and _NUMBER.match(text.strip()):
        return text.strip()
    quoted = "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if family == "temporal":
        if _STAMP.match(text) or data_type.strip().upper().startswith("TIMESTAMP") and _DATE.match(text):
            return f"TIMESTAMP_NTZ {quoted}"
        if _DATE.match(text):
            return f"DATE {quoted}"
    return quoted


def comparison(column: str, op: str, value, value_sql: str | None, data_type: str | None, prefix: str) -> str:
    """A predicate as Spark SQL. Text is compared without case by =, !=, <>, LIKE and IN, with case by the others."""
    text = type_family(data_type) == "string"

    def sides(v: str) -> tuple[str, str]:
        # A literal without cased letters compares alike, and reaches the scan as a plain filter.
        return (f"upper({column})", f"upper({v})") if text and (v.upper() != v.lower() or value_sql) else (column, v)

    if op in ("IS NULL", "IS NOT NULL"):
        return f"{column} {op}"
    if value_sql is not None:
        right = checked_rhs(value_sql, prefix)
        if op in ("IN", "BETWEEN"):
            raise SemanticError(f"{prefix}_032", f"{op} takes literal values.")
        left, right = sides(right) if op in ("=", "!=", "<>", "LIKE") else (column, right)
        return f"{left} {op} {right}"
    if op == "IN":
        if not isinstance(value, list) or not value:
            raise SemanticError(f"{prefix}_032", "IN needs a non-empty list of literal values.")
        values = [literal(v, data_type) for v in value]
        if text and any(v.upper() != v.lower() for v in values):
            return f"upper({column}) IN ({', '.join(f'upper({v})' for v in values)})"
        return f"{column} IN ({', '.join(values)})"
    if op == "BETWEEN":
        if not isinstance(value, list) or len(value) != 2:
            raise SemanticError(f"{prefix}_032", "BETWEEN needs exactly two values.")
        return f"{column} BETWEEN {literal(value[0], data_type)} AND {literal(value[1], data_type)}"
    if op not in OPERATORS:
        raise SemanticError(f"{prefix}_033", f"Unsupported filter operator {op}.")
    if isinstance(value, (list, dict)):
        raise SemanticError(f"{prefix}_032", f"{op} takes one value.")
    left, right = sides(literal(value, data_type)) if op in ("=", "!=", "<>", "LIKE") else (column, literal(value, data_type))
    return f"{left} {op} {right}"


def implied_dates(sql: str, op: str, value) -> list[str]:
    """Date bounds that comparing ``YEAR(alias.column)`` with whole years implies; unlike the comparison, they reach the scan."""
    tokens = tokenize(sql)
    if [t.upper for t in tokens[:2]] != ["YEAR", "("] or closing(tokens, 1) != len(tokens) - 1:
        return []
    argument = tokens[2:-1]
    given = value if isinstance(value, list) else [value]
    if [t.kind in ("name", "quoted") for t in argument] != [True, False, True] or argument[1].text != "." or not given:
        return []
    if not all(re.fullmatch(r"\d{1,4}", str(v).strip()) and 1 <= int(v) < 9999 for v in given):
        return []
    years, column = [int(v) for v in given], to_spark(render(argument))
    if op == "BETWEEN":
        first, end = years[0], years[-1] + 1
    else:
        first = {"=": min(years), "IN": min(years), ">=": years[0], ">": years[0] + 1}.get(op)
        end = {"=": max(years) + 1, "IN": max(years) + 1, "<=": years[0] + 1, "<": years[0]}.get(op)
    bounds = [(">=", first), ("<", end)]
    return [f"{column} {sign} DATE '{year:04d}-01-01'" for sign, year in bounds if year is not None]


def checked_rhs(text: str, prefix: str) -> str:
    """A right-hand expression: permitted functions over literals only, nothing that could end the predicate."""
    try:
        tokens, refs = tokenize(text), references(text)
    except ExpressionError as e:
        raise SemanticError(f"{prefix}_030", f"Unsupported right-hand expression: {e}.") from e
    words = {t.upper for t in tokens if t.kind == "name"}
    if words & {"AND", "OR", "NOT", "SELECT", "IN", "BETWEEN", "IS", "LIKE"} or any(t.text in ("=", "<", ">", "<=", ">=", "<>", "!=", ";") for t in tokens):
        raise SemanticError(f"{prefix}_030", f"Unsupported right-hand expression: {text}.")
    extra = [f for f in refs.functions if f not in ALLOWED and f not in RHS_FUNCTIONS]
    names = [b for b in refs.bare if b.upper() not in RHS_FUNCTIONS]
    if extra or names or refs.qualified:
        raise SemanticError(f"{prefix}_030", f"Unsupported right-hand expression: {text}.")
    return to_spark(text)


class Planner:
    """Plans requests on one model. ``columns_of(schema, object)`` gives upper-case column names or None."""

    def __init__(self, model: Model, columns_of, matrix: dict | None, max_branches: int = MAX_BRANCHES, anchor: str = "leaf"):
        self.model, self.graph, self.formulas = model, Graph(model), Formulas(model)
        self.fusion, self.matrix, self.max_branches, self.anchor = Fusion(model, columns_of), matrix, max_branches, anchor

    # -- names -----------------------------------------------------------------------------------------------
    def resolve(self, obj, name, kind: str | None = None) -> tuple[str, str]:
        """(kind, name) of a visible field: by its name, else by a synonym that only one visible field has."""
        if not isinstance(name, str) or not name.strip():
            raise SemanticError("SEMANTIC_REQUEST_020", "Field name is required.")
        name = name.strip()
        visible = {(k, n.upper()): n for k in ("DIMENSION", "METRIC") for n in obj.visible(k)}
        found = [(k, n) for (k, key), n in visible.items() if key == name.upper()]
        if not found:
            found = sorted({(s.kind, visible[s.kind, s.name.upper()]) for s in self.model.synonyms.values() if s.synonym.upper() == name.upper() and (s.kind, s.name.upper()) in visible})
        if kind and len(found) > 1:
            found = [f for f in found if f[0] == kind] or found
        if len(found) > 1:
            raise SemanticError("SEMANTIC_REQUEST_021", f"Ambiguous semantic field: {name}", candidates=[{"kind": k, "name": n} for k, n in found])
        if not found:
            raise SemanticError("SEMANTIC_REQUEST_020", f"Unknown semantic field: {name}")
        if kind and found[0][0] != kind:
            raise SemanticError("SEMANTIC_REQUEST_022", f"Field {name} is not a {kind}.")
        return found[0]

    def dimension(self, name: str) -> Dimension:
        return self.model.get("dimensions", name)

    # -- planning --------------------------------------------------------------------------------------------
    def plan(self, spec: QuerySpec) -> dict:
        obj = self.model.get("objects", spec.object)
        if obj is None:
            raise SemanticError("SEMANTIC_REQUEST_012", f"Semantic object not found: {spec.object}")
        metrics = list(dict.fromkeys(self.resolve(obj, m, "METRIC")[1] for m in spec.metrics))
        dimensions = list(dict.fromkeys(self.resolve(obj, d, "DIMENSION")[1] for d in spec.dimensions))
        if not metrics and not dimensions:
            raise SemanticError("SEMANTIC_REQUEST_023", "Select at least one metric or dimension.")
        filters = [self._filter(obj, f) for f in spec.filters]
        if self.matrix is None:
            raise SemanticError("SEMANTIC_REQUEST_010", f"Model {self.model.name} has no successful validation of its present state.")
        limit = self._limit(spec.limit)
        having = [self._having(obj, h, metrics) for h in spec.having]
        order = self._order(obj, spec.order_by, dimensions, metrics)

        wanted = list(dict.fromkeys([*metrics, *(h["metric"] for h in having)]))
        chain = self.formulas.order(wanted)
        units = [u for m in chain for u in self.formulas.units(m)]
        metric_filters = list(dict.fromkeys(d for m in chain for d in self.formulas.filter_dimensions(m)))
        self._check_matrix(wanted, list(dict.fromkeys([*dimensions, *(f["dimension"] for f in filters)])), metric_filters)
        leaves = list(dict.fromkeys(u.entity for u in units))
        split = [e for e in leaves if self.fusion.partitioned(e)]
        multi = len(leaves) > 1 or bool(split)
        strict = multi or spec.proof_mode == "STRICT_GRAIN"
        states = {m.name: self.formulas.classify(m) for m in chain}
        if multi or spec.proof_mode == "STRICT_GRAIN":
            for m in chain:
                if states[m.name] in ("LEGACY_AGGREGATE", "UNSUPPORTED_WINDOW", "UNSUPPORTED_DISTINCT", "UNSUPPORTED_NON_ADDITIVE"):
                    raise SemanticError(
                        "SEMANTIC_REQUEST_070",
                        f"Metric {m.name} ({m.expression}) is {states[m.name]}: its aggregate state can't be merged. Use SUM and COUNT states with a derived or ratio metric.",
                        "METRIC_STATE_UNSUPPORTED",
                        metric=m.name,
                    )
        elif any(s == "UNSUPPORTED_WINDOW" for s in states.values()):
            raise SemanticError("SEMANTIC_REQUEST_070", "Window metrics aren't executable.", "UNSUPPORTED_WINDOW")

        anchors = leaves if multi else [leaves[0] if leaves and self.anchor == "leaf" else obj.root.upper()]
        selected = [{"name": d, "data_type": self.dimension(d).data_type} for d in dimensions]
        plan = {
            "version": 1,
            "model": self.model.name,
            "object": obj.name,
            "kind": "MULTI_BRANCH" if multi else "SINGLE_BRANCH",
            "proof_mode": spec.proof_mode,
            "dimensions": selected,
            "metrics": [{"name": m, "data_type": self.model.get("metrics", m).data_type} for m in metrics],
            "metric_states": states,
            "filters": filters,
            "having": having,
            "order_by": order,
            "limit": limit,
            "materialization": None,
            "materialization_notes": [],
            "fusion": [],
            "remaps": [],
            "branches": [],
            "units": [{"column": u.column, "metric": u.metric, "function": u.function, "filtered": bool(u.filter)} for u in units],
            "finalizers": [{"metric": m.name, "column": f"__m_{m.name.lower()}", "sql": self.formulas.finalizer(m)} for m in chain],
        }
        if not multi and metrics and not having:
            plan["materialization"], plan["materialization_notes"] = self._materialization(dimensions, filters, metrics, metric_filters)
            if plan["materialization"]:
                plan["filters_sql"] = [
                    comparison(f"mat.`{plan['materialization']['dimensions'][f['dimension']]}`", f["op"], f["value"], f["value_sql"], f["data_type"], "SEMANTIC_REQUEST") for f in filters
                ]
                return plan
        for entity in anchors:
            own = [u for u in units if u.entity == entity] if multi else units
            plan["branches"] += self._branches(plan, entity, own, dimensions, filters, strict, multi)
        if len(plan["branches"]) > self.max_branches:
            raise SemanticError(
                "SEMANTIC_REQUEST_075",
                f"The plan needs {len(plan['branches'])} branches; at most {self.max_branches} are allowed.",
                "PLANNER_BRANCH_LIMIT_EXCEEDED",
                leaves=leaves,
            )
        return plan

    # -- parts of a request ----------------------------------------------------------------------------------
    def _filter(self, obj, item: dict) -> dict:
        name, op = predicate_parts(item)
        kind, found = self.resolve(obj, name)
        if kind == "METRIC":
            raise SemanticError("SEMANTIC_REQUEST_031", f"Metric {found} belongs in having.")
        data_type = self.dimension(found).data_type
        if op not in ("IS NULL", "IS NOT NULL") and "value" not in item and "values" not in item and not item.get("value_sql"):
            raise SemanticError("SEMANTIC_REQUEST_015", f"Filter on {found} has no value.")
        if op not in OPERATORS:
            raise SemanticError("SEMANTIC_REQUEST_033", f"Unsupported filter operator {op}.")
        out = {"dimension": found, "op": op, "value": item.get("value", item.get("values")), "value_sql": item.get("value_sql"), "data_type": data_type}
        comparison("x", op, out["value"], out["value_sql"], data_type, "SEMANTIC_REQUEST")
        return out

    def _having(self, obj, item, metrics: list[str]) -> dict:
        name, op = predicate_parts(item)
        if not isinstance(item, dict) or not name:
            raise SemanticError("SEMANTIC_REQUEST_025", "Having entries need a field.")
        if not metrics:
            raise SemanticError("SEMANTIC_REQUEST_026", "Having needs a selected metric.")
        kind, found = self.resolve(obj, name)
        if kind != "METRIC":
            raise SemanticError("SEMANTIC_REQUEST_030", f"Having field {found} is not a metric.")
        if op not in ("IS NULL", "IS NOT NULL") and "value" not in item and not item.get("value_sql"):
            raise SemanticError("SEMANTIC_REQUEST_025", f"Having entry for {found} has no value.")
        data_type = self.model.get("metrics", found).data_type
        return {"metric": found, "op": op, "sql": comparison(f"`__m_{found.lower()}`", op, item.get("value"), item.get("value_sql"), data_type, "SEMANTIC_REQUEST")}

    def _order(self, obj, items: list, dimensions: list[str], metrics: list[str]) -> list[dict]:
        out = []
        for item in items:
            if not isinstance(item, dict):
                raise SemanticError("SEMANTIC_REQUEST_060", "Order entries need a field.")
            name, _ = predicate_parts(item)
            if not name:
                raise SemanticError("SEMANTIC_REQUEST_060", "Order entries need a field.")
            found = self.resolve(obj, name)[1]
            if found not in dimensions and found not in metrics:
                raise SemanticError("SEMANTIC_REQUEST_061", f"Order field {found} is not selected.")
            way = str(item.get("direction", item.get("dir", "ASC"))).upper()
            if way not in ("ASC", "DESC"):
                raise SemanticError("SEMANTIC_REQUEST_062", f"Order direction {way} is not ASC or DESC.")
            out.append({"field": found, "direction": way})
        return out

    @staticmethod
    def _limit(limit) -> int | None:
        if limit is None:
            return None
        if isinstance(limit, bool) or not isinstance(limit, (int, float)) or limit != int(limit) or limit < 1:
            raise SemanticError("SEMANTIC_REQUEST_050", "Limit must be a positive integer.")
        if limit > MAX_LIMIT:
            raise SemanticError("SEMANTIC_REQUEST_051", f"Limit must not exceed {MAX_LIMIT}.")
        return int(limit)

    def _check_cell(self, m: str, d: str) -> None:
        row = self.matrix.get((m.upper(), d.upper()))
        if row is None:
            raise SemanticError("SEMANTIC_REQUEST_040", f"No validation result for metric {m} and dimension {d}.")
        if not row["valid"]:
            raise SemanticError("SEMANTIC_REQUEST_041", f"Metric {m} can't be used with dimension {d}: {row['reason']}.", row["reason"])

    def _check_matrix(self, metrics: list[str], dimensions: list[str], intrinsic: list[str]) -> None:
        for m in metrics:
            for d in dimensions:
                self._check_cell(m, d)
        for d in intrinsic:
            if self.dimension(d) is None:
                raise SemanticError("SEMANTIC_REQUEST_040", f"Unknown filter dimension {d}.")
        for m in metrics:  # the dimensions of a metric's own filter
            for d in self.formulas.filter_dimensions(self.model.get("metrics", m)):
                self._check_cell(m, d)

    def _materialization(self, dimensions, filters, metrics, metric_filters):
        names = dict.fromkeys([*dimensions, *(f["dimension"] for f in filters), *metric_filters])
        if any(self.fusion.strategy("DIMENSION", d) in ("COALESCE", "RECONCILE") for d in names):
            return None, [{"materialization": None, "reason": "ATTRIBUTE_FUSION_ACTIVE"}]
        return navigator.select(self.model, dimensions, [f["dimension"] for f in filters], metrics)

    # -- branches --------------------------------------------------------------------------------------------
    def _proof(self, start: str, end: str, strict: bool, what: str, multi: bool) -> Proof:
        proof = self.graph.strict(start, end) if strict else self.graph.shortest(start, end)
        if not proof.ok:
            code = "SEMANTIC_REQUEST_074" if multi else "SEMANTIC_REQUEST_072" if strict else "SEMANTIC_REQUEST_042"
            detail = f" Candidates: {'; '.join(proof.candidates)}." if proof.candidates else f" Blocked by {proof.blocking}." if proof.blocking else ""
            raise SemanticError(code, f"No proven path from {start} to {end} for {what}: {proof.reason}.{detail}", proof.reason, list(proof.candidates), blocking=proof.blocking)
        return proof

    def _branches(self, plan: dict, entity: str, units: list[Unit], dimensions: list[str], filters: list[dict], strict: bool, multi: bool) -> list[dict]:
        """The branch that aggregates at an entity, or one for each of its temporal partitions."""
        filtered_dims = [f["dimension"] for f in filters]
        intrinsic = list(dict.fromkeys(d for u in units for d in self.formulas.filter_dimensions(self.model.get("metrics", u.metric))))
        whole = list(dict.fromkeys([*dimensions, *filtered_dims, *intrinsic]))
        used_facts = list(dict.fromkeys(f for u in units for f in references(u.argument).bare if self.model.get("facts", f)))
        attributes: dict[str, list[tuple[str, str]]] = {entity: []}
        for d in whole:
            attributes.setdefault(self.dimension(d).entity.upper(), []).append(("DIMENSION", d))
        for f in used_facts:
            attributes.setdefault(self.model.get("facts", f).entity.upper(), []).append(("FACT", self.model.get("facts", f).name))
        for d in whole if multi else []:
            if self.fusion.partitioned(self.dimension(d).entity) and self.dimension(d).entity.upper() != entity:
                raise SemanticError("SEMANTIC_REQUEST_074", f"{d} stands on the partitioned entity {self.dimension(d).entity}, which may only be a metric's base.", "FUSION_PARTITION_DIMENSION_UNSUPPORTED")

        # A leaf's states may come from a registered aggregate on the whole.
        if multi and not self.fusion.partitioned(entity) and not any(self.fusion.strategy("DIMENSION", d) != "PREFER" for d in whole):
            states = [
                {"column": u.column, "metric": u.metric, "filter": u.filter, "whole": sole_aggregate(self.model.get("metrics", u.metric).expression) is not None} for u in units
            ]
            chosen, notes = navigator.select_leaf(self.model, dimensions, filtered_dims, states)
            plan["materialization_notes"] += [{"leaf": entity, **n} for n in notes]
            if chosen:
                for d in whole:  # the proof is still due
                    self._proof(entity, self.dimension(d).entity, strict, f"dimension {d}", multi)
                where = [comparison(f"mat.`{chosen['dimensions'][f['dimension']]}`", f["op"], f["value"], f["value_sql"], f["data_type"], "SEMANTIC_REQUEST") for f in filters]
                return [{"entity": entity, "materialization": chosen, "where": where, "units": [u.column for u in units]}]

        edges: list[Edge] = []
        paths = {}
        for target in sorted(attributes):
            if target == entity:
                continue
            names = ", ".join(n for _, n in attributes[target])
            proof = self._proof(entity, target, strict, names, multi)
            paths[target] = proof.describe()
            for e in proof.edges:
                if e not in edges:
                    if any(x.end == e.end for x in edges):
                        raise SemanticError("SEMANTIC_REQUEST_042", f"{e.end} is reached on two paths.", "AMBIGUOUS_RELATIONSHIP_PATH")
                    edges.append(e)
        chosen: dict[str, Chosen] = {}
        for node in [entity, *(e.end for e in edges)]:
            near = [e.relationship for e in edges if node in (e.start, e.end)]
            chosen[node] = self.fusion.choose(node, attributes.get(node, []), near)
            if multi and any(self.fusion.strategy(*a) != "PREFER" for a in attributes.get(node, []) if a[0] == "FACT"):
                raise SemanticError("SEMANTIC_REQUEST_074", f"A reconciled fact of {node} can't be combined across fact branches.", "FACT_FUSION_UNSUPPORTED")
            if node != entity and chosen[node].partitioned:
                raise SemanticError("SEMANTIC_REQUEST_074", f"{node} is partitioned and may only be a metric's base.", "FUSION_PARTITION_DIMENSION_UNSUPPORTED")
        for c in chosen.values():
            plan["fusion"] += [d for d in c.decisions if len(self.model.sources_of(c.entity)) > 1]
        return [self._branch(plan, entity, part, chosen, edges, paths, units, dimensions, filters, multi) for part in chosen[entity].parts]

    def _branch(self, plan, entity, part, chosen, edges, paths, units, dimensions, filters, multi) -> dict:
        def source(node: str):
            return part if node == entity else chosen[node].parts[0]

        def attribute(kind: str, name: str) -> str:
            record = self.model.get("dimensions" if kind == "DIMENSION" else "facts", name)
            node = record.entity.upper()
            return chosen[node].expressions[kind, name.upper(), source(node).name]

        def argument(text: str) -> str:
            return substitute(text, bare=lambda n: f"({attribute('FACT', n)})" if self.model.get("facts", n) else None)

        def predicate(text: str) -> str:
            return substitute(text, bare=lambda n: f"({attribute('DIMENSION', n)})" if self.model.get("dimensions", n) else None)

        joins = []
        for node in [entity, *(e.end for e in edges)]:
            for edge in (e for e in edges if e.end == node):
                condition = edge.relationship.condition
                for side in (edge.start, edge.end):
                    renamed, _ = self.fusion.remap(edge.relationship, side, source(side))
                    if renamed:
                        alias = self.model.get("entities", side).alias
                        condition = substitute(condition, qualified=lambda a, c, r=renamed, own=alias: r.get(c.upper()) if a.upper() == own.upper() else None)
                        plan["remaps"].append({"relationship": edge.relationship.name, "entity": side, "representation": source(side).name, "columns": renamed})
                s = source(node)
                joins.append(
                    {
                        "entity": node,
                        "schema": s.schema,
                        "object": s.object,
                        "alias": self.model.get("entities", node).alias,
                        "condition": to_spark(condition),
                        "how": "inner" if edge.relationship.join_type.upper() == "INNER" else "left",
                        "relationship": edge.relationship.name,
                    }
                )
            for c in chosen[node].contributors:
                joins.append({**c, "how": "left", "left": [to_spark(x) for x in c["left"]], "right": [to_spark(x) for x in c["right"]], "relationship": None})
        where = []
        if part.coverage and len(chosen[entity].parts) > 1:
            where.append(to_spark(part.coverage))
        for f in filters:
            dim = self.dimension(f["dimension"])
            told = attribute("DIMENSION", dim.name)
            where.append(comparison(f"({to_spark(told, dim.data_type)})", f["op"], f["value"], f["value_sql"], f["data_type"], "SEMANTIC_REQUEST"))
            if f["value_sql"] is None:
                where += implied_dates(told, f["op"], f["value"])
        aggregates, inputs = {}, {}
        for u in units:
            sql = unit_sql(u, argument(u.argument), predicate(u.filter) if u.filter else None, missing_sum_is_zero=not multi)
            aggregates[u.column] = to_spark(sql)
            whole = sole_aggregate(sql)
            inputs[u.column] = [whole.function, "1" if whole.argument == "*" else to_spark(whole.argument)] if whole else None
        base = self.model.get("entities", entity)
        return {
            "entity": entity,
            "representation": part.name,
            "schema": part.schema,
            "object": part.object,
            "alias": base.alias,
            "joins": joins,
            "paths": paths,
            "where": where,
            "dimensions": {d: to_spark(attribute("DIMENSION", d), self.dimension(d).data_type) for d in dimensions},
            "aggregates": aggregates,
            "units": [u.column for u in units],
            **({"inputs": inputs} if len(chosen[entity].parts) > 1 and all(inputs.values()) else {}),
        }


def valid_identifier(name: str) -> bool:
    return bool(IDENTIFIER.match(name))


__all__ = ["Planner", "Token", "comparison", "literal", "valid_identifier"]
