"""Metric formulas: inputs, leaf entities, aggregate units and scalar finalizers."""

from __future__ import annotations

from dataclasses import dataclass

from granary.errors import SemanticError
from granary.functions.catalog import MERGEABLE, type_family
from granary.functions.expressions import Token, aggregates, filtered, references, render, roles, sole_aggregate, substitute, to_spark, tokenize
from granary.model import Metric, Model


@dataclass(frozen=True)
class Unit:
    """One aggregate: its own column in a branch, mergeable across branches if SUM or COUNT."""

    column: str
    metric: str
    function: str
    distinct: bool
    argument: str  # semantic text, facts by name
    entity: str
    filter: str | None

    @property
    def mergeable(self) -> bool:
        return self.function in MERGEABLE and not self.distinct


class Formulas:
    """Dependencies of the metrics of a model."""

    def __init__(self, model: Model):
        self.model = model

    def inputs(self, metric: Metric) -> tuple[list[str], list[str], list[str]]:
        """(facts, metrics, unknown names) that a formula refers to; a fact is meant where both exist inside an aggregate."""
        facts, metrics, unknown = [], [], []
        tokens, found = aggregates(metric.expression)
        role = roles(tokens)
        for i, t in enumerate(tokens):
            if role[i] != "bare":
                continue
            inside = any(a.start <= i <= a.end for a in found)
            name = t.value
            if inside and self.model.get("facts", name):
                facts.append(self.model.get("facts", name).name)
            elif self.model.get("metrics", name):
                metrics.append(self.model.get("metrics", name).name)
            elif self.model.get("facts", name):
                facts.append(self.model.get("facts", name).name)
            else:
                unknown.append(name)
        return list(dict.fromkeys(facts)), list(dict.fromkeys(metrics)), list(dict.fromkeys(unknown))

    def order(self, names: list[str]) -> list[Metric]:
        """Metrics and all they depend on, inputs first."""
        out: dict[str, Metric] = {}
        on_path: list[str] = []

        def visit(name: str) -> None:
            key = name.upper()
            if key in on_path:
                cycle = " > ".join([*on_path[on_path.index(key) :], key])
                raise SemanticError("SEMANTIC_REQUEST_070", f"Metric dependencies contain a cycle: {cycle}.", "METRIC_DEPENDENCY_CYCLE")
            if key in out:
                return
            metric = self.model.get("metrics", name)
            if metric is None:
                raise SemanticError("SEMANTIC_REQUEST_070", f"Unknown metric {name}.", "MISSING_PRIVATE_METRIC_DEPENDENCY")
            on_path.append(key)
            for inner in self.inputs(metric)[1]:
                visit(inner)
            on_path.pop()
            out[key] = metric

        for name in names:
            visit(name)
        return list(out.values())

    def classify(self, metric: Metric) -> str:
        """Kind of aggregate state, or why a formula has none that merges."""
        whole = sole_aggregate(metric.expression)
        if metric.window or metric.kind == "WINDOW":
            return "UNSUPPORTED_WINDOW"
        if metric.kind == "DISTINCT" or metric.distinct_key or any(a.distinct for a in aggregates(metric.expression)[1]):
            return "UNSUPPORTED_DISTINCT"
        if metric.kind in ("SEMI_ADDITIVE",) or metric.metric_type in ("SEMI_ADDITIVE",) or metric.non_additive_by:
            return "UNSUPPORTED_NON_ADDITIVE"
        if whole:
            if whole.function not in MERGEABLE:
                return "LEGACY_AGGREGATE"
            return f"FILTERED_{whole.function}" if metric.filter else whole.function
        found = aggregates(metric.expression)[1]
        if any(a.function not in MERGEABLE for a in found):
            return "LEGACY_AGGREGATE"
        if metric.kind == "RATIO" or metric.metric_type == "RATIO":
            return "RATIO"
        return "DERIVED_ARITHMETIC" if found or self.inputs(metric)[1] else "LEGACY_AGGREGATE"

    def units(self, metric: Metric) -> list[Unit]:
        """A metric's own aggregates (not those of the metrics it refers to)."""
        out = []
        for k, a in enumerate(aggregates(metric.expression)[1]):
            own = [self.model.get("facts", b) for b in references(a.argument).bare if self.model.get("facts", b)]
            entities = list(dict.fromkeys(f.entity.upper() for f in own))
            if not own and a.argument not in ("*", "1") and not references(a.argument).qualified:
                raise SemanticError("SEMANTIC_REQUEST_070", f"Metric {metric.name} aggregates no known fact.", "MISSING_FACT_DEPENDENCY")
            aliases = {self.model.entity_of_alias(q[0]).name.upper() for q in references(a.argument).qualified if self.model.entity_of_alias(q[0])}
            entities = list(dict.fromkeys([*entities, *sorted(aliases)]))
            if not entities and metric.base_entity:
                entities = [metric.base_entity.upper()]
            if not entities:
                raise SemanticError("SEMANTIC_REQUEST_070", f"Metric {metric.name} has no base entity.", "METRIC_INPUT_GRAIN_MISSING")
            base = metric.base_entity.upper() if metric.base_entity and metric.base_entity.upper() in entities else entities[0]
            distinct = a.distinct or (metric.kind == "DISTINCT" and a.function == "COUNT")
            out.append(Unit(f"__u_{metric.name.lower()}_{k}", metric.name, a.function, distinct, a.argument, base, metric.filter))
        return out

    def leaves(self, metric: Metric) -> list[str]:
        """Entities of a metric's facts, its inputs' included."""
        return list(dict.fromkeys(u.entity for m in self.order([metric.name]) for u in self.units(m)))

    def base_entity(self, metric: Metric) -> str | None:
        if metric.base_entity:
            return metric.base_entity.upper()
        found = self.leaves(metric)
        return found[0] if len(found) == 1 else None

    def filter_dimensions(self, metric: Metric) -> list[str]:
        """Dimensions that a metric's own filter names."""
        if not metric.filter:
            return []
        return [self.model.get("dimensions", b).name for b in references(metric.filter).bare if self.model.get("dimensions", b)]

    def finalizer(self, metric: Metric, column: str = "__m_{}") -> str:
        """The formula over unit columns and finished metrics, as Spark SQL."""
        tokens, found = aggregates(metric.expression)
        out: list[Token] = []
        at = 0
        for k, a in enumerate(found):
            out += tokens[at : a.start]
            out.append(Token("raw", f"`__u_{metric.name.lower()}_{k}`"))
            at = a.end + 1
        text = render(out + tokens[at:])
        role_text = substitute_raw(text, lambda n: f"`{column.format(self.model.get('metrics', n).name.lower())}`" if self.model.get("metrics", n) else None)
        return to_spark(role_text, metric.data_type)


def substitute_raw(text: str, bare) -> str:
    """Like ``substitute``; back-quoted names stay as they are."""
    tokens = tokenize(text)
    role = roles(tokens)
    return render([Token("raw", bare(t.value)) if role[i] == "bare" and t.kind == "name" and bare(t.value) else t for i, t in enumerate(tokens)])


def unit_sql(unit: Unit, argument: str, predicate: str | None, missing_sum_is_zero: bool) -> str:
    """A unit as Spark SQL, its filter inside the aggregate."""
    text = f"{unit.function}({'DISTINCT ' if unit.distinct else ''}{argument})"
    return filtered(text, predicate, missing_sum_is_zero) if predicate else text


def comparable_type(name: str | None) -> str:
    return type_family(name) or "other"
