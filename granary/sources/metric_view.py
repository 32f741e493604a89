"""Metric-view YAML: one source, joins, fields and measures, translated to a semantic model."""

from __future__ import annotations

from dataclasses import dataclass, field

from granary.errors import SemanticError
from granary.functions.expressions import ExpressionError, Token, aggregates, references, render, roles, sole_aggregate, substitute, tokenize
from granary.model import IDENTIFIER, Model
from granary.validate import RESERVED

_CARDINALITY = {"many_to_one": "MANY_TO_ONE", "one_to_many": "ONE_TO_MANY", "one_to_one": "ONE_TO_ONE"}
_FORMATS = {"currency": "currency", "percentage": "percent", "percent": "percent", "number": "number", "byte": "bytes"}
#: Types that stand in for undeclared ones.
FIELD_TYPE, DATE_TYPE, AMOUNT_TYPE, COUNT_TYPE = "VARCHAR(2000000)", "DATE", "DECIMAL(36,6)", "DECIMAL(18,0)"


@dataclass
class Imported:
    model: Model
    diagnostics: list[dict] = field(default_factory=list)

    def codes(self) -> list[str]:
        return [d["code"] for d in self.diagnostics]


def load_yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise SemanticError("DBX_IMPORT_600", "PyYAML is needed to read YAML.") from e
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SemanticError("DBX_IMPORT_600", f"YAML can't be read: {e}.") from e
    if not isinstance(found, dict):
        raise SemanticError("DBX_IMPORT_600", "A metric view is a mapping.")
    # YAML 1.1 reads the bare key ``on`` as a boolean.
    def fixed(x):
        if isinstance(x, dict):
            return {("on" if k is True else k): fixed(v) for k, v in x.items()}
        return [fixed(v) for v in x] if isinstance(x, list) else x

    return fixed(found)


class _Import:
    def __init__(self, name: str, schema: str, obj: str):
        self.model, self.object, self.notes = Model(name, schema), obj, []
        self.paths: dict[tuple[str, ...], str] = {}  # path in upper case to entity
        self.aliases: set[str] = set()

    def note(self, code: int, severity: str, path: str, message: str) -> None:
        self.notes.append({"code": f"DBX_IMPORT_{code}", "severity": severity, "path": path, "message": message})

    def alias(self, name: str) -> str:
        letters = "".join(c for c in name.lower() if c.isalnum()) or "t"
        for alias in [letters[:1], letters[:2], letters[:3], *(f"{letters[:1]}{k}" for k in range(1, 1000))]:
            if alias not in self.aliases and alias.upper() not in RESERVED and IDENTIFIER.match(alias):
                self.aliases.add(alias)
                return alias
        raise SemanticError("DBX_IMPORT_600", "Too many entities.")

    @staticmethod
    def relation(source: str) -> tuple[str, str] | None:
        """(schema, object) of a source name, or None for an inline query."""
        text = str(source).strip()
        if text.upper().startswith(("SELECT ", "SELECT\n", "WITH ", "(")) or " " in text:
            return None
        parts = [p.strip("`\"") for p in text.split(".")]
        return (parts[-2] if len(parts) > 1 else "DEFAULT"), parts[-1]

    def entity(self, name: str, source: str, path: str) -> str | None:
        found = self.relation(source)
        if found is None:
            return None
        self.model = self.model.add_entity(name, *found, self.alias(name), description=f"Imported from {source}")
        return name

    def alias_of(self, entity: str) -> str:
        return self.model.get("entities", entity).alias

    def rewrite(self, text: str, where: str) -> tuple[str, str | None]:
        """An expression on entity aliases, and the entity it belongs to: the last one it names."""
        tokens = tokenize(str(text))
        out: list[Token] = []
        owner, i = None, 0
        role = roles(tokens)
        while i < len(tokens):
            t = tokens[i]
            if t.kind in ("name", "quoted") and role[i] != "type" and (not i or tokens[i - 1].text != "."):
                chain, k = [t], i
                while k + 2 < len(tokens) and tokens[k + 1].text == "." and tokens[k + 2].kind in ("name", "quoted"):
                    chain.append(tokens[k + 2])
                    k += 2
                called = k + 1 < len(tokens) and tokens[k + 1].text == "("
                if len(chain) > 1 and not called:
                    path = tuple(c.value.upper() for c in chain[:-1])
                    best = max((p for p in self.paths if path[-len(p) :] == p or path == p), key=len, default=None) if path in self.paths or any(path[-len(p) :] == p for p in self.paths) else None
                    if best:
                        owner = self.paths[best]
                        out.append(Token("raw", f"{self.alias_of(owner)}.{chain[-1].text}"))
                    else:
                        self.note(310, "WARNING", where, f"Unresolved reference {'.'.join(c.value for c in chain)}.")
                        out += tokens[i : k + 1]
                    i = k + 1
                    continue
                if len(chain) == 1 and role[i] == "bare":
                    owner = owner or self.root
                    out.append(Token("raw", f"{self.alias_of(self.root)}.{t.text}"))
                    i += 1
                    continue
            out.append(t)
            i += 1
        return render(out), owner

    # -- joins -----------------------------------------------------------------------------------------------
    def joins(self, items, parent: str, trail: tuple[str, ...]) -> None:
        for join in items or []:
            name = join.get("name") if isinstance(join, dict) else None
            if not name or not IDENTIFIER.match(str(name)):
                self.note(230, "WARNING", "joins", "A join needs a name; it was skipped.")
                continue
            where = f"joins.{name}"
            if join.get("using"):
                self.note(240, "WARNING", where, "USING joins are skipped; give an on condition.")
                continue
            if not join.get("on"):
                self.note(241, "WARNING", where, "A join needs an on condition; it was skipped.")
                continue
            if self.entity(name, join.get("source", ""), where) is None:
                self.note(211, "WARNING", where, "Inline-query sources aren't supported; the join was skipped.")
                continue
            path = (*trail, str(name).upper())
            for k in range(len(path)):
                self.paths[path[k:]] = name
            cardinality = _CARDINALITY.get(str(join.get("cardinality", join.get("rely", "")) or "").lower())
            if cardinality is None:
                cardinality = "MANY_TO_ONE"
                self.note(250, "INFO", where, "No cardinality given; MANY_TO_ONE is assumed.")
            condition, _ = self.rewrite(join["on"], where)
            self.model = self.model.add_relationship(f"{parent}_{name}", parent, name, condition, cardinality)
            self._keys(f"{parent}_{name}", parent, name, condition, cardinality)
            self.joins(join.get("joins"), name, path)

    def _keys(self, relationship: str, parent: str, name: str, condition: str, cardinality: str) -> None:
        """Key and mapping of a single equality, so that grain proofs can use the join."""
        tokens = tokenize(condition)
        if len(tokens) != 7 or tokens[3].text != "=":
            return
        sides = {tokens[0].value: tokens[2].value, tokens[4].value: tokens[6].value}
        a, b = sides.get(self.alias_of(parent)), sides.get(self.alias_of(name))
        if a and b:
            target, column = (name, b) if cardinality != "ONE_TO_MANY" else (parent, a)
            if not any(k.columns == (column,) for k in self.model.keys_of(target)):
                self.model = self.model.add_key(target, f"by_{column}", [column], "UNIQUE")
            if cardinality == "ONE_TO_ONE" and not any(k.columns == (a,) for k in self.model.keys_of(parent)):
                self.model = self.model.add_key(parent, f"by_{a}", [a], "UNIQUE")
            self.model = self.model.add_mapping(relationship, a, b)

    # -- fields and measures ---------------------------------------------------------------------------------
    @staticmethod
    def told(item: dict) -> dict:
        fmt = item.get("format")
        kind = fmt.get("type") if isinstance(fmt, dict) else fmt
        return {"display": item.get("display_name"), "description": item.get("comment"), "format": _FORMATS.get(str(kind).lower(), kind) if kind else None}

    def field(self, item: dict) -> None:
        name, expression = item.get("name"), item.get("expr")
        if not name or expression is None:
            self.note(320, "WARNING", f"fields.{name}", "A field needs a name and an expression; it was skipped.")
            return
        try:
            text, owner = self.rewrite(expression, f"fields.{name}")
        except ExpressionError as e:
            self.note(320, "WARNING", f"fields.{name}", f"Expression can't be read: {e}; the field was skipped.")
            return
        head = tokenize(text)[0].upper if tokenize(text) else ""
        data_type = DATE_TYPE if head in ("DATE_TRUNC", "TRUNC", "TO_DATE", "DATE") else FIELD_TYPE
        more = self.told(item)
        more.pop("format") if not more["format"] else None
        self.model = self.model.add_dimension(self.object, owner or self.root, name, text, data_type, **more)
        self.synonyms("DIMENSION", name, item)

    def synonyms(self, kind: str, name: str, item: dict) -> None:
        for s in item.get("synonyms") or []:
            self.model = self.model.add_synonym(kind, name, str(s), "IMPORT")

    def predicate(self, text: str, measure: str) -> str:
        """A filter on semantic dimensions; a column that is none becomes a dimension that isn't shown."""
        moved, owner = self.rewrite(text, f"measures.{measure}")

        def named(alias: str, column: str) -> str:
            bare = column.strip('`"')
            for d in self.model.dimensions.values():
                if d.expression.replace(" ", "").upper() == f"{alias}.{column}".upper():
                    return d.name
            name = f"{measure}_{bare}".replace("$", "_")
            entity = self.model.entity_of_alias(alias)
            self.model = self.model.add_dimension(None, entity.name, name, f"{alias}.{column}", FIELD_TYPE)
            return name

        return substitute(moved, qualified=named)

    def measure(self, item: dict) -> None:
        name, expression = item.get("name"), item.get("expr")
        where = f"measures.{name}"
        if not name or expression is None:
            self.note(400, "WARNING", "measures", "A measure needs a name and an expression; it was skipped.")
            return
        if item.get("window"):
            self.note(410, "WARNING", where, "Window measures are skipped.")
            return
        try:
            text, predicate = self._split_filter(str(expression))
            tokens = tokenize(text)
            more = self.told(item)
            more["description"] = more["description"] or more["display"] or name
            more["format"] = more["format"] or "number"
            if any(t.upper in ("MEASURE", "AGG") for t in tokens):
                self._composed(name, tokens, more, where)
            else:
                whole = sole_aggregate(text)
                if whole is None:
                    self.note(420, "WARNING", where, "The expression isn't one aggregate; the measure was skipped.")
                    return
                self._simple(name, whole, predicate, more)
        except ExpressionError as e:
            self.note(430, "WARNING", where, f"Expression can't be read: {e}; the measure was skipped.")
            return
        self.synonyms("METRIC", name, item)

    @staticmethod
    def _split_filter(text: str) -> tuple[str, str | None]:
        tokens = tokenize(text)
        for i, t in enumerate(tokens):
            if t.upper == "FILTER" and i + 2 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 2].upper == "WHERE":
                return render(tokens[:i]), render(tokens[i + 3 : -1])
        return text, None

    def _simple(self, name: str, whole, predicate: str | None, more: dict) -> None:
        argument = "1" if whole.argument in ("*", "1") else whole.argument
        text, owner = ("1", self.root) if argument == "1" else self.rewrite(argument, f"measures.{name}")
        owner = owner or self.root
        fact, kind = f"{name}_base", "DISTINCT" if whole.distinct else "FILTERED" if predicate else "SIMPLE"
        self.model = self.model.add_fact(owner, fact, text, COUNT_TYPE if whole.function == "COUNT" else AMOUNT_TYPE, private=True)
        additive = "ADDITIVE" if whole.function in ("SUM", "COUNT") and not whole.distinct else "NON_ADDITIVE"
        self.model = self.model.add_metric(
            self.object,
            name,
            f"{whole.function}({'DISTINCT ' if whole.distinct else ''}{fact})",
            owner,
            filter=self.predicate(predicate, name) if predicate else None,
            kind=kind,
            metric_type=additive,
            data_type=COUNT_TYPE if whole.function == "COUNT" else AMOUNT_TYPE,
            **more,
        )

    def _composed(self, name: str, tokens: list[Token], more: dict, where: str) -> None:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i].upper in ("MEASURE", "AGG") and i + 3 < len(tokens) and tokens[i + 1].text == "(" and tokens[i + 3].text == ")":
                out.append(tokens[i + 2])
                i += 4
            else:
                out.append(tokens[i])
                i += 1
        ratio = len(out) == 3 and out[1].text == "/"
        text = f"{out[0].text} / NULLIF({out[2].text}, 0)" if ratio else render(out)
        if aggregates(text)[1]:
            self.note(430, "WARNING", where, "Aggregates beside MEASURE() aren't supported; the measure was skipped.")
            return
        unknown = [b for b in references(text).bare if self.model.get("metrics", b) is None]
        if unknown:
            self.note(420, "WARNING", where, f"Unknown measure {', '.join(unknown)}; the measure was skipped.")
            return
        base = self.model.get("metrics", references(text).bare[0]).base_entity
        self.model = self.model.add_metric(self.object, name, text, base, kind="RATIO" if ratio else "DERIVED", metric_type="NON_ADDITIVE", data_type=AMOUNT_TYPE, **more)


def import_metric_view(text: str, model: str, schema: str, obj: str, root: str = "source_entity") -> Imported:
    """A metric view as a model, with a diagnostic for everything that was dropped or assumed."""
    view = load_yaml(text)
    work = _Import(model, schema, obj)
    if not view.get("source") or work.relation(view["source"]) is None:
        raise SemanticError("DBX_IMPORT_210", "The source must be a table or view; wrap a query in a view.")
    name = work.relation(view["source"])[1]
    work.root = name if IDENTIFIER.match(name) else root
    work.entity(work.root, view["source"], "source")
    work.paths[("SOURCE",)] = work.root
    work.model = work.model.add_object(obj, work.root, view.get("comment"))
    work.joins(view.get("joins"), work.root, ("SOURCE",))
    for item in view.get("fields") or view.get("dimensions") or []:
        work.field(item if isinstance(item, dict) else {})
    for item in view.get("measures") or []:
        work.measure(item if isinstance(item, dict) else {})
    if view.get("filter"):
        work.note(500, "WARNING", "filter", "The view's filter isn't applied; add it to the metrics that need it.")
    if "materialization" in view:
        work.note(510, "INFO", "materialization", "Materialization is ignored; register aggregates instead.")
    return Imported(work.model, work.notes)


def apply_metric_view(session, text: str, model: str, schema: str, obj: str) -> Imported:
    """Import and publish; nothing stays if the model isn't valid."""
    out = import_metric_view(text, model, schema, obj)
    before = session.models.get(model.upper())
    session.add(out.model)
    try:
        session.publish(model)
    except SemanticError:
        session.models.pop(model.upper(), None)
        if before is not None:
            session.add(before)
        raise
    return out
