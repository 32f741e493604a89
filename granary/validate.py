"""Certification: rules over the metadata, the metric-by-dimension matrix, and bounded data probes."""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import SemanticError
from granary.functions.catalog import ALLOWED, type_family
from granary.functions.expressions import ExpressionError, aggregates, references, substitute, to_spark, tokenize
from granary.model import Model, Representation
from granary.operators.lowering import Source
from granary.plans.fusion import Fusion
from granary.plans.graph import Graph
from granary.plans.metrics import Formulas

CARDINALITIES = ("ONE_TO_ONE", "MANY_TO_ONE", "ONE_TO_MANY", "MANY_TO_MANY")
JOIN_TYPES = ("INNER", "LEFT")
KEY_KINDS = ("PRIMARY", "UNIQUE", "ALTERNATE")
SOURCE_KINDS = ("RELATION", "VIRTUAL_SCHEMA")
SCOPES = ("MODEL", "OBJECT", "ENTITY", "RELATIONSHIP", "DIMENSION", "FACT", "METRIC")
INSTRUCTION_KINDS = ("GENERAL", "ROUTING", "DISAMBIGUATION", "CAVEAT", "FORMATTING", "GLOSSARY", "QUERY_GUIDANCE")
RESERVED = frozenset("SELECT FROM WHERE GROUP ORDER BY HAVING JOIN ON AND OR NOT IN AS CASE WHEN THEN ELSE END UNION ALL DISTINCT LIMIT NULL IS LIKE BETWEEN LEFT RIGHT INNER OUTER FULL CROSS USING WITH TABLE VALUES".split())
WARNINGS = frozenset({"020", "022", "031", "046", "050"})


@dataclass(frozen=True)
class Issue:
    code: str
    severity: str
    object_type: str
    object_name: str
    message: str


@dataclass
class Report:
    model: str
    fingerprint: str
    run_id: int = 0
    issues: list[Issue] = field(default_factory=list)
    matrix: dict = field(default_factory=dict)

    @property
    def status(self) -> str:
        kinds = {i.severity for i in self.issues}
        return "ERROR" if "ERROR" in kinds else "PRECONDITION" if "PRECONDITION" in kinds else "WARNING" if "WARNING" in kinds else "OK"

    @property
    def ok(self) -> bool:
        return self.status in ("OK", "WARNING")

    def codes(self) -> list[str]:
        return sorted({i.code[-3:] for i in self.issues})


@contextlib.contextmanager
def _deadline(spark, seconds: float):
    """Cancels the Spark jobs of the block when it has run so long; gives an event that says whether it did."""
    sc, group, over, done = spark.sparkContext, f"probes-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):  # a job that begins after a cancellation is cancelled by the next one
            over.set()
            sc.cancelJobGroup(group)
            wait = 0.2

    thread = threading.Thread(target=watch, daemon=True)
    sc.setJobGroup(group, "Key probes", True)
    thread.start()
    try:
        yield over
    except Exception:
        if not over.is_set():
            raise
    finally:
        done.set()
        thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)


class Validator:
    def __init__(self, model: Model, relations, probe_timeout: int | None = 30):
        self.model, self.relations, self.timeout = model, relations, probe_timeout
        self.graph, self.formulas, self.fusion = Graph(model), Formulas(model), Fusion(model, relations.columns)
        self.report = Report(model.name, model.fingerprint())

    def fail(self, rule: str, kind: str, name: str, message: str, severity: str | None = None) -> None:
        self.report.issues.append(Issue(f"SEMANTIC_MODEL_{rule}", severity or ("WARNING" if rule in WARNINGS else "ERROR"), kind, name, message))

    def run(self, probes: bool = True) -> Report:
        self.structure()
        self.extensions()
        self.identities()
        self.keys()
        self.mappings()
        self.edges()
        self.expressions()
        self.policies()
        self.dependencies()
        self.agents()
        if not any(i.severity == "ERROR" for i in self.report.issues):
            self.matrix()
        if probes and not any(i.severity == "ERROR" for i in self.report.issues):
            self.probes()
        return self.report

    # -- structure -------------------------------------------------------------------------------------------
    def structure(self) -> None:
        m = self.model
        if not m.name:
            self.fail("000", "MODEL", m.name, "Model name is missing.")
        if not m.version:
            self.fail("002", "MODEL", m.name, "Model has no active version.")
        aliases: dict[str, str] = {}
        for e in m.entities.values():
            if self.relations.columns(e.schema, e.object) is None:
                self.fail("001", "ENTITY", e.name, f"Source {e.schema}.{e.object} is not visible.")
            if e.alias.upper() in aliases:
                self.fail("003", "ENTITY", e.name, f"Alias {e.alias} is also {aliases[e.alias.upper()]}'s.")
            aliases[e.alias.upper()] = e.name
            if e.alias.upper() in RESERVED:
                self.fail("034", "ENTITY", e.name, f"Alias {e.alias} is a reserved word.")
            primaries = [r for r in m.representations.values() if r.entity.upper() == e.name.upper() and r.role == "PRIMARY"]
            if len(primaries) != 1:
                self.fail("035", "ENTITY", e.name, f"{len(primaries)} primary representations instead of one.")
        for r in m.representations.values():
            bad = None
            if m.get("entities", r.entity) is None:
                bad = "its entity is missing"
            elif r.source_kind not in SOURCE_KINDS:
                bad = f"source kind {r.source_kind} is unsupported"
            elif r.role not in ("PRIMARY", "ALTERNATE"):
                bad = f"role {r.role} is unsupported"
            elif r.role == "ALTERNATE" and self.relations.columns(r.schema, r.object) is None:
                bad = f"source {r.schema}.{r.object} is not visible"
            elif bool(r.coverage) != bool(r.valid_from or r.valid_to):
                bad = "coverage needs a predicate and an interval"
            if bad:
                self.fail("036", "REPRESENTATION", f"{r.entity}.{r.name}", f"Representation is invalid: {bad}.")
        for table, kind in (("objects", "OBJECT"), ("dimensions", "DIMENSION"), ("facts", "FACT")):
            for x in getattr(m, table).values():
                entity = x.root if kind == "OBJECT" else x.entity
                if m.get("entities", entity) is None:
                    self.fail("004", kind, x.name, f"Entity {entity} is missing.")
        tables = {"DIMENSION": "dimensions", "FACT": "facts", "METRIC": "metrics"}
        for o in m.objects.values():
            for c in o.columns:
                if c.kind not in tables or m.get(tables[c.kind], c.name) is None:
                    self.fail("005", "OBJECT", o.name, f"Column {c.name} ({c.kind}) is missing.")

    def extensions(self) -> None:
        tables = {"OBJECT": "objects", "ENTITY": "entities", "RELATIONSHIP": "relationships", "DIMENSION": "dimensions", "FACT": "facts", "METRIC": "metrics"}
        for x in self.model.extensions.values():
            if x.scope not in SCOPES or x.scope in tables and self.model.get(tables[x.scope], x.name) is None:
                self.fail("026", "EXTENSION", f"{x.scope}.{x.name}", "Scope is unsupported or its object is missing.")
            try:
                complete = bool(x.vendor) and json.loads(x.data) is not None
            except (ValueError, TypeError):
                complete = False
            if not complete:
                self.fail("027", "EXTENSION", f"{x.scope}.{x.name}", "Vendor is missing or data isn't valid JSON.")

    def identities(self) -> None:
        m = self.model
        for identity in m.identities.values():
            if m.get("entities", identity.entity) is None:
                self.fail("047", "IDENTITY", identity.name, f"Entity {identity.entity} is missing.")
                continue
            names = {r.name.upper() for r in m.sources_of(identity.entity)}
            bound = [b for b in m.identity_bindings.values() if b.identity.upper() == identity.name.upper()]
            if not bound:
                self.fail("047", "IDENTITY", identity.name, "Identity has no bindings.")
            for b in bound:
                alias = m.get("entities", identity.entity).alias
                if b.representation.upper() not in names or b.kind not in ("DIRECT", "MAPPED"):
                    self.fail("047", "IDENTITY", identity.name, f"Binding for {b.representation} is malformed.")
                    continue
                try:
                    foreign = [a for a, _ in references(b.expression).qualified if a.upper() != alias.upper()]
                    if foreign or not references(b.expression).qualified or references(b.expression).bare:
                        self.fail("047", "IDENTITY", identity.name, f"Binding expression {b.expression} leaves its representation.")
                except ExpressionError as e:
                    self.fail("047", "IDENTITY", identity.name, f"Binding expression can't be read: {e}.")
                mapping = m.get("mappings", b.mapping)
                certified = mapping is not None and mapping.status == "CERTIFIED" and self.relations.columns(mapping.schema, mapping.object) is not None
                if b.kind == "DIRECT" and b.mapping or b.kind == "MAPPED" and not certified:
                    self.fail("048", "IDENTITY", identity.name, f"Binding for {b.representation} is {b.kind} {'with' if b.kind == 'DIRECT' else 'without'} a certified, visible mapping.")

    # -- keys and relationships ------------------------------------------------------------------------------
    def keys(self) -> None:
        for k in self.model.keys.values():
            entity = self.model.get("entities", k.entity)
            if entity is None or k.kind not in KEY_KINDS or not k.columns:
                self.fail("028", "KEY", f"{k.entity}.{k.name}", "Key has no entity, a bad kind or no columns.")
                continue
            have = self.relations.columns(entity.schema, entity.object)
            missing = [c for c in k.columns if c and have is not None and c.upper() not in have]
            if missing:
                self.fail("029", "KEY", f"{k.entity}.{k.name}", f"Unknown key columns: {', '.join(missing)}.")

    def _endpoint_type(self, entity: str, column: str) -> str | None:
        e = self.model.get("entities", entity)
        return self.relations.types(e.schema, e.object).get(column.upper())

    def mappings(self) -> None:
        for r in self.model.relationships.values():
            ends = [self.model.get("entities", x) for x in (r.from_entity, r.to_entity)]
            if None in ends:
                continue
            if not r.mappings:
                self.fail("031", "RELATIONSHIP", r.name, "No structured endpoint mapping: grain proofs can't use it.")
                continue
            bad = False
            for k in r.mappings:
                for e, column, expression in ((ends[0], k.from_column, k.from_expression), (ends[1], k.to_column, k.to_expression)):
                    have = self.relations.columns(e.schema, e.object)
                    if not column and not expression or column and have is not None and column.upper() not in have:
                        bad = True
            if bad:
                self.fail("032", "RELATIONSHIP", r.name, "Endpoint mapping is malformed or names an unknown column.")
                continue
            if any(k.from_expression or k.to_expression for k in r.mappings):
                continue
            need = []
            if r.cardinality in ("MANY_TO_ONE", "ONE_TO_ONE"):
                need.append((r.to_entity, {k.to_column.upper() for k in r.mappings}))
            if r.cardinality in ("ONE_TO_MANY", "ONE_TO_ONE"):
                need.append((r.from_entity, {k.from_column.upper() for k in r.mappings}))
            for entity, columns in need:
                if not any(set(k) == columns for k in self.graph.key_columns(entity)):
                    self.fail("033", "RELATIONSHIP", r.name, f"Mapped columns {', '.join(sorted(columns))} aren't a unique key of {entity}.")

    def edges(self) -> None:
        for r in self.model.relationships.values():
            a, b = self.model.get("entities", r.from_entity), self.model.get("entities", r.to_entity)
            if a is None or b is None:
                self.fail("006", "RELATIONSHIP", r.name, f"Endpoint {r.from_entity if a is None else r.to_entity} is missing.")
                continue
            if r.cardinality not in CARDINALITIES:
                self.fail("008", "RELATIONSHIP", r.name, f"Cardinality {r.cardinality} is unsupported.")
            if r.join_type.upper() not in JOIN_TYPES:
                self.fail("009", "RELATIONSHIP", r.name, f"Join type {r.join_type} is unsupported.")
            if r.cardinality == "MANY_TO_MANY" and not r.fanout_policy:
                self.fail("010", "RELATIONSHIP", r.name, "Many-to-many needs a fanout policy.")
            try:
                refs = references(r.condition)
            except ExpressionError as e:
                self.fail("007", "RELATIONSHIP", r.name, f"Join condition can't be read: {e}.")
                continue
            foreign = [x for x, _ in refs.qualified if x.upper() not in (a.alias.upper(), b.alias.upper())]
            if foreign or not refs.qualified:
                self.fail("007", "RELATIONSHIP", r.name, f"Join condition uses {', '.join(foreign) or 'no endpoint alias'}.")
            tokens = tokenize(r.condition)
            if len(tokens) == 7 and tokens[3].text == "=" and not foreign:
                kinds = []
                for i in (0, 4):
                    e = a if tokens[i].value.upper() == a.alias.upper() else b
                    kinds.append(self._endpoint_type(e.name, tokens[i + 2].value))
                if all(kinds) and type_family(kinds[0]) != type_family(kinds[1]):
                    self.fail("051", "RELATIONSHIP", r.name, f"Join of {kinds[0]} with {kinds[1]}.")
            for e in (a, b):
                for s in self.model.sources_of(e.name)[1:]:
                    _, why = self.fusion.remap(r, e.name, s)
                    if why:
                        self.fail("050", "RELATIONSHIP", r.name, f"Representation {s.name} of {e.name} can't take part: {why}.")

    # -- expressions -----------------------------------------------------------------------------------------
    def _expression(self, kind: str, name: str, text: str, entity: str, source: Representation | None = None) -> None:
        e = self.model.get("entities", entity)
        rules = ("040", "040", "040") if source else ("013", "016", "017")
        try:
            refs = references(text)
            to_spark(text)
        except ExpressionError as error:
            self.fail(rules[1], kind, name, f"Expression can't be read: {error}.")
            return
        foreign = sorted({a for a, _ in refs.qualified if a.upper() != e.alias.upper()})
        if foreign:
            self.fail(rules[0], kind, name, f"Expression uses the alias {', '.join(foreign)} outside its entity {entity}.")
        bad = [f for f in refs.functions if f not in ALLOWED and "." not in f]
        if bad:
            self.fail(rules[1], kind, name, f"Unsupported function {', '.join(bad)}; permitted are {', '.join(sorted(ALLOWED))}.")
        where = source or Representation("", entity, e.schema, e.object)
        have = self.relations.columns(where.schema, where.object)
        unknown = [c for a, c in refs.qualified if a.upper() == e.alias.upper() and have is not None and c.upper() not in have]
        if unknown or refs.bare:
            self.fail(rules[2], kind, name, f"Unknown source column {', '.join(unknown) or ', '.join(refs.bare)}.")

    def expressions(self) -> None:
        m = self.model
        for table, kind in (("dimensions", "DIMENSION"), ("facts", "FACT")):
            for x in getattr(m, table).values():
                if m.get("entities", x.entity) and not self.fusion.bindings(kind, x.name):
                    self._expression(kind, x.name, x.expression, x.entity)
        for b in m.bindings.values():
            source = m.get("representations", f"{b.entity}.{b.representation}")
            record = m.get("dimensions" if b.kind == "DIMENSION" else "facts", b.attribute)
            if source is None or record is None or record.entity.upper() != b.entity.upper() or b.role not in ("PREFER", "FALLBACK") or b.priority < 0:
                self.fail("039", "BINDING", f"{b.attribute}.{b.representation}", "Binding has a bad owner, role, priority or representation.")
                continue
            self._expression(b.kind, b.attribute, b.expression, b.entity, source)
        for x in m.metrics.values():
            if x.base_entity and m.get("entities", x.base_entity) is None:
                self.fail("014", "METRIC", x.name, f"Base entity {x.base_entity} is missing.")
            try:
                refs = references(x.expression)
                filter_refs = references(x.filter) if x.filter else None
            except ExpressionError as e:
                self.fail("016", "METRIC", x.name, f"Expression can't be read: {e}.")
                continue
            bad = [f for f in refs.functions if f not in ALLOWED and "." not in f]
            if bad:
                self.fail("016", "METRIC", x.name, f"Unsupported function {', '.join(bad)}; permitted are {', '.join(sorted(ALLOWED))}.")
            if filter_refs:
                unknown = [b for b in filter_refs.bare if m.get("dimensions", b) is None]
                if unknown or any(m.entity_of_alias(a) is None for a, _ in filter_refs.qualified):
                    self.fail("013", "METRIC", x.name, f"Filter uses {', '.join(unknown) or 'an unknown alias'}.")
        for entity in m.entities.values():
            if not self.fusion.partitioned(entity.name):
                continue
            for kind, table in (("DIMENSION", "dimensions"), ("FACT", "facts")):
                for x in getattr(m, table).values():
                    if x.entity.upper() == entity.name.upper():
                        for s in m.sources_of(entity.name):
                            if self.fusion.expression(kind, x.name, s) is None:
                                self.fail("052", kind, x.name, f"No binding on partition {s.name} of {entity.name}.")

    # -- fusion ----------------------------------------------------------------------------------------------
    def policies(self) -> None:
        m = self.model
        for e in m.entities.values():
            sources = m.sources_of(e.name)
            covered = [s for s in sources if s.coverage]
            if covered and len(sources) > 1:
                self._coverage(e, sources)
                bases = {self.formulas.base_entity(x) for x in m.metrics.values() if self._resolvable(x)}
                leaves = set(itertools.chain.from_iterable(self.formulas.leaves(x) for x in m.metrics.values() if self._resolvable(x)))
                if m.metrics and e.name.upper() not in bases | leaves:
                    self.fail("043", "ENTITY", e.name, "Partitioned entity is the base of no metric.")
        for a in m.authorities.values():
            if a.level not in ("AUTHORITATIVE", "PREFER", "SUPPLEMENTAL") or m.get("representations", f"{a.entity}.{a.representation}") is None:
                self.fail("044", "AUTHORITY", f"{a.entity}.{a.representation}", "Authority is malformed.")
        for p in m.policies.values():
            name = f"{p.kind}.{p.attribute}"
            record = m.get("dimensions" if p.kind == "DIMENSION" else "facts", p.attribute)
            if record is None or p.strategy not in ("PREFER", "COALESCE", "RECONCILE"):
                self.fail("044", "POLICY", name, "Policy is malformed.")
                continue
            if p.strategy == "PREFER":
                continue
            found = self.fusion.contributors(p.entity, p.kind, p.attribute)
            levels = [a.level for a in m.authorities.values() if a.entity.upper() == p.entity.upper()]
            complete = any({r.name.upper() for r in m.sources_of(p.entity)} <= {b.representation.upper() for b in m.identity_bindings.values() if b.identity.upper() == i.name.upper()} for i in m.identities.values() if i.entity.upper() == p.entity.upper())
            if len(found) < 2:
                self.fail("044", "POLICY", name, "Fewer than two contributors.")
            elif not m.keys_of(p.entity) and not complete:
                self.fail("044", "POLICY", name, "Neither a physical unique key nor a complete semantic identity.")
            elif p.strategy == "RECONCILE" and levels.count("AUTHORITATIVE") != 1:
                self.fail("044", "POLICY", name, "RECONCILE needs exactly one authoritative representation.")
            elif self.fusion.partitioned(p.entity):
                self.fail("044", "POLICY", name, "Attribute fusion conflicts with temporal partitions.")

    def _resolvable(self, metric) -> bool:
        try:
            self.formulas.leaves(metric)
            return True
        except (SemanticError, ExpressionError, AttributeError):
            return False

    def _coverage(self, entity, sources: list[Representation]) -> None:
        """Partitions must be half-open, contiguous and open at both ends, their predicates exactly that."""
        if not all(s.coverage for s in sources):
            self.fail("042", "ENTITY", entity.name, "Only some representations have coverage.")
            return
        ordered = sorted(sources, key=lambda s: s.valid_from or "")
        if ordered[0].valid_from or ordered[-1].valid_to:
            self.fail("042", "ENTITY", entity.name, "Coverage isn't open-ended.")
        for a, b in itertools.pairwise(ordered):
            if not a.valid_to or a.valid_to != b.valid_from:
                self.fail("042", "ENTITY", entity.name, f"Coverage of {a.name} and {b.name} has a gap or an overlap.")
        columns = set()
        for s in ordered:
            found = parse_coverage(s.coverage, entity.alias)
            if found is None or (found[1], found[2]) != (_stamp(s.valid_from), _stamp(s.valid_to)):
                self.fail("042", "REPRESENTATION", f"{entity.name}.{s.name}", f"Predicate {s.coverage} isn't [{s.valid_from}, {s.valid_to}).")
            else:
                columns.add(found[0].upper())
        if len(columns) > 1:
            self.fail("042", "ENTITY", entity.name, "Partitions are cut on different columns.")

    # -- dependencies ----------------------------------------------------------------------------------------
    def dependencies(self) -> None:
        for x in self.model.metrics.values():
            try:
                _, _, unknown = self.formulas.inputs(x)
            except ExpressionError:
                continue
            if unknown:
                self.fail("011", "METRIC", x.name, f"Unknown fact or metric {', '.join(unknown)}.")
                continue
            try:
                self.formulas.order([x.name])
            except SemanticError as e:
                self.fail("012" if e.reason == "METRIC_DEPENDENCY_CYCLE" else "011", "METRIC", x.name, e.message)

    def agents(self) -> None:
        m = self.model
        for x in m.metrics.values():
            if not x.private and not x.description:
                self.fail("020", "METRIC", x.name, "Public metric has no description.")
            if not x.private and type_family(x.data_type) == "numeric" and not x.format:
                self.fail("022", "METRIC", x.name, "Public numeric metric has no unit or format hint.")
        meanings: dict[str, set] = {}
        for s in m.synonyms.values():
            if s.certified:
                meanings.setdefault(s.synonym.upper(), set()).add((s.kind, s.name.upper()))
        for synonym, names in meanings.items():
            if len(names) > 1:
                self.fail("021", "SYNONYM", synonym, f"Certified synonym means {', '.join(sorted(n for _, n in names))}.")
        for q in m.verified_queries.values():
            o = m.get("objects", q.object)
            try:
                request = json.loads(q.request)
            except ValueError:
                request = None
            missing = o is None or not isinstance(request, dict) or any(m.get("metrics", n) is None for n in request.get("metrics", [])) or any(m.get("dimensions", n) is None for n in request.get("dimensions", []))
            if missing:
                self.fail("023", "VERIFIED_QUERY", q.name, "Refers to a missing object, metric or dimension.")
        for i in m.instructions.values():
            if i.scope not in SCOPES:
                self.fail("024", "INSTRUCTION", i.name, f"Scope {i.scope} is unsupported.")
            if i.kind not in INSTRUCTION_KINDS:
                self.fail("025", "INSTRUCTION", i.name, f"Kind {i.kind} is unsupported.")

    # -- matrix ----------------------------------------------------------------------------------------------
    def matrix(self) -> None:
        """For each metric and dimension: base reachable from an object's root, and the dimension from the base."""
        m = self.model
        roots = [o.root for o in m.objects.values()]
        for x in m.metrics.values():
            base = self.formulas.base_entity(x)
            for d in m.dimensions.values():
                reason, path = None, ""
                if base is None:
                    reason = "METRIC_INPUT_GRAIN_AMBIGUOUS"
                elif not any(self.graph.shortest(r, base).ok for r in roots):
                    reason = "NO_SAFE_JOIN_PATH"
                else:
                    proof = self.graph.shortest(base, d.entity)
                    reason, path = proof.reason, " > ".join(proof.describe())
                self.report.matrix[x.name.upper(), d.name.upper()] = {"metric": x.name, "dimension": d.name, "valid": reason is None, "reason": reason, "path": path}
        for o in m.objects.values():
            for x, d in itertools.product(o.visible("METRIC"), o.visible("DIMENSION")):
                row = self.report.matrix.get((x.upper(), d.upper()))
                if row and not row["valid"]:
                    self.fail("030", "OBJECT", o.name, f"Metric {x} can't be used with dimension {d}: {row['reason']}.")

    # -- data probes -----------------------------------------------------------------------------------------
    def probes(self) -> None:
        multi = [e for e in self.model.entities.values() if len(self.model.sources_of(e.name)) > 1]
        if not multi:
            return
        if not self.timeout or not 1 <= self.timeout <= 60:
            self.fail("041", "MODEL", self.model.name, "Key probes need a probe timeout of 1 to 60 seconds.", "PRECONDITION")
            return
        with _deadline(self.relations.spark, self.timeout) as self.over:
            self._probe_all(multi)
        if self.over.is_set():
            self.fail("041", "MODEL", self.model.name, f"Key probes took longer than {self.timeout} seconds.", "PRECONDITION")

    def _probe_all(self, multi: list) -> None:
        for e in multi:
            identity = next((i for i in self.model.identities.values() if i.entity.upper() == e.name.upper()), None)
            if identity and any(b.kind == "MAPPED" for b in self.model.identity_bindings.values() if b.identity.upper() == identity.name.upper()):
                self._identity_probe(e, identity)
            else:
                self._key_probe(e)
        for p in self.model.policies.values():
            if p.strategy in ("COALESCE", "RECONCILE"):
                self._conflict_probe(p)

    def _keyed(self, entity, source: Representation) -> tuple[DataFrame, list[str]]:
        """A representation with its semantic or physical key as columns k0, k1, ..."""
        columns, mapping = self.fusion.key_expression(entity.name, source, entity.alias)
        df = self.relations(source.schema, source.object).alias(entity.alias)
        if mapping:
            table = self.relations(mapping["schema"], mapping["object"]).alias("_map")
            df = df.join(table, F.expr(f"{to_spark(columns[0])} = _map.`{mapping['source_column']}`"), "left")
            columns = [f"_map.`{mapping['semantic_column']}`"]
        return df, [to_spark(c) for c in columns]

    def _key_probe(self, entity) -> None:
        sources = self.model.sources_of(entity.name)
        if not self.model.keys_of(entity.name):
            if not self.fusion.partitioned(entity.name):
                self.fail("037", "ENTITY", entity.name, "No unique key is declared, so equivalence can't be proven.")
            return
        frames = {}
        for s in sources:
            df, key = self._keyed(entity, s)
            names = [f"k{i}" for i in range(len(key))]
            keys = df.select(*[F.expr(k).alias(n) for k, n in zip(key, names, strict=True)])
            frames[s.name] = keys
            if not keys.groupBy(*names).count().where(" OR ".join(["count > 1", *(f"{n} IS NULL" for n in names)])).isEmpty():
                self.fail("037", "REPRESENTATION", f"{entity.name}.{s.name}", "Declared key isn't unique here.")
        if self.fusion.partitioned(entity.name):
            return
        base = frames[sources[0].name]
        for s in sources[1:]:
            other = frames[s.name]
            try:
                differ = not base.exceptAll(other).isEmpty() or not other.exceptAll(base).isEmpty()
            except Exception as e:  # noqa: BLE001  keys of types that can't be compared
                if self.over.is_set():
                    raise
                self.fail("038", "REPRESENTATION", f"{entity.name}.{s.name}", f"Keys can't be compared: {type(e).__name__}.")
                continue
            if differ:
                self.fail("038", "REPRESENTATION", f"{entity.name}.{s.name}", "Key set differs from the primary's.")

    def _identity_probe(self, entity, identity) -> None:
        m, canonical = self.model, None
        for s in m.sources_of(entity.name):
            b = m.get("identity_bindings", f"{identity.name}.{s.name}")
            if b is None:
                self.fail("049", "IDENTITY", identity.name, f"{s.name} has no binding.")
                continue
            df, key = self._keyed(entity, s)
            keys = df.select(F.expr(key[0]).alias("k"))
            if not keys.groupBy("k").count().where("count > 1 OR k IS NULL").isEmpty():
                self.fail("049", "IDENTITY", identity.name, f"The semantic key isn't total and unique on {s.name}.")
            if b.kind == "MAPPED":
                mapping = m.get("mappings", b.mapping)
                table = self.relations(mapping.schema, mapping.object)
                for column in (mapping.source_column, mapping.semantic_column):
                    if not table.groupBy(F.col(f"`{column}`").alias("c")).count().where("count > 1 OR c IS NULL").isEmpty():
                        self.fail("049", "IDENTITY", identity.name, f"Mapping {mapping.name} isn't one to one on {column}.")
            if canonical is None:
                canonical = keys
            elif not canonical.exceptAll(keys).isEmpty() or not keys.exceptAll(canonical).isEmpty():
                self.fail("049", "IDENTITY", identity.name, f"Semantic keys of {s.name} differ from the primary's.")

    def _conflict_probe(self, policy) -> None:
        entity = self.model.get("entities", policy.entity)
        found = self.fusion.contributors(policy.entity, policy.kind, policy.attribute)
        frames = []
        for source, expression in found:
            df, key = self._keyed(entity, source)
            frames.append(df.select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(key)], F.expr(to_spark(expression)).alias("v")))
        names = [c for c in frames[0].columns if c != "v"]
        for (a, b), (x, y) in zip(itertools.combinations([s.name for s, _ in found], 2), itertools.combinations(frames, 2), strict=True):
            joined = x.withColumnRenamed("v", "a").join(y.withColumnRenamed("v", "b"), names)
            if not joined.where("a != b").isEmpty():
                rule = "045" if policy.strategy == "COALESCE" else "046"
                self.fail(rule, "POLICY", f"{policy.kind}.{policy.attribute}", f"{a} and {b} have conflicting values for the same key.")


_BOUND = re.compile(r"(\w+)\s*\.\s*(\"?\w+\"?)\s*(>=|<)\s*(?:TIMESTAMP|DATE)\s*'([^']*)'", re.I)


def _stamp(value: str | None) -> str | None:
    if not value:
        return None
    text = str(value).replace("T", " ")
    return text if " " in text else f"{text} 00:00:00"


def parse_coverage(text: str, alias: str) -> tuple[str, str | None, str | None] | None:
    """(column, from, to) of a canonical half-open predicate, or None."""
    low = high = column = None
    for part in re.split(r"\s+AND\s+", text.strip(), flags=re.I):
        m = _BOUND.fullmatch(part.strip())
        if not m or m[1].upper() != alias.upper() or column not in (None, m[2].strip('"')):
            return None
        column = m[2].strip('"')
        if m[3] == ">=" and low is None:
            low = _stamp(m[4])
        elif m[3] == "<" and high is None:
            high = _stamp(m[4])
        else:
            return None
    return (column, low, high) if column else None


def coverage_predicate(alias: str, column: str, valid_from: str | None, valid_to: str | None) -> str:
    """The canonical predicate of an interval."""
    parts = [f"{alias}.{column} >= TIMESTAMP '{_stamp(valid_from)}'"] if valid_from else []
    parts += [f"{alias}.{column} < TIMESTAMP '{_stamp(valid_to)}'"] if valid_to else []
    return " AND ".join(parts)


__all__ = ["Issue", "Report", "Source", "Validator", "aggregates", "coverage_predicate", "parse_coverage", "substitute"]
