"""The session: models, certification, compiling, the SQL front door, publishing, caches and logs."""

from __future__ import annotations

import dataclasses
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from granary import ddl
from granary.errors import SemanticError
from granary.functions.expressions import ExpressionError
from granary.model import Model
from granary.operators.lowering import lower, render_sql
from granary.plans import sqlfront
from granary.plans.planner import MAX_BRANCHES, Planner
from granary.plans.request import LOGGING, decode, query_spec
from granary.sources.relations import Relations
from granary.validate import Report, Validator

MAX_SQL_BYTES = 1_000_000
#: Compiled plans kept by a session; the oldest go first.
MAX_CACHED = 1000


@dataclass
class Compiled:
    """The envelope that compiling answers with; errors are data."""

    status: str  # OK, ERROR, NEEDS_CLARIFICATION, UNCHANGED
    error_code: str | None = None
    error_message: str | None = None
    original_sql: str | None = None
    generated_sql: str | None = None
    plan: dict | None = None
    clarification: list | None = None
    validation_run_id: int | None = None
    request_id: int | None = None
    cache_hit: bool = False
    planner_ms: float = 0.0

    def plan_json(self) -> str | None:
        return None if self.plan is None else json.dumps(self.plan, sort_keys=True, default=str)


class SemanticSession:
    """Grain-safe metrics over a Spark session."""

    def __init__(self, spark: SparkSession, probe_timeout: int | None = 30, max_branches: int = MAX_BRANCHES, anchor: str = "leaf"):
        self.spark, self.relations = spark, Relations(spark)
        self.probe_timeout, self.max_branches, self.anchor = probe_timeout, max_branches, anchor
        self.models: dict[str, Model] = {}
        self.reports: dict[str, Report] = {}
        self.runs: list[Report] = []
        self.published: dict[str, str] = {}
        self.published_names: dict[str, str] = {}
        self.cache: dict[tuple[str, str], tuple[dict, str]] = {}
        self.requests: list[dict] = []
        self.query_log: list[dict] = []
        self.publications: list[dict] = []
        self.suggestions: list[dict] = []
        self.reviews: list[dict] = []
        self.feedback: list[dict] = []
        self.semantic_sql = True

    # -- models ----------------------------------------------------------------------------------------------
    def add(self, model: Model) -> Model:
        """Take a model as the active version of its name. A change makes earlier certification stale by content."""
        self.models[model.name.upper()] = model
        return model

    def model(self, name: str) -> Model:
        found = self.models.get(str(name).upper())
        if found is None:
            raise SemanticError("SEMANTIC_REQUEST_011", f"Semantic model not found: {name}")
        return found

    def drop(self, name: str) -> None:
        gone = self.models.pop(str(name).upper(), None)
        if gone:
            self.published.pop(gone.schema.upper(), None)

    def validate(self, name: str, probes: bool = True) -> Report:
        model = self.model(name)
        report = Validator(model, self.relations, self.probe_timeout).run(probes)
        report.run_id = len(self.runs) + 1
        self.runs.append(report)
        if report.ok:
            self.reports[model.fingerprint()] = report
        return report

    def publish(self, name: str) -> Report:
        """Certify, then offer the model's objects as ``schema.object`` to ``sql``."""
        report = self.validate(name)
        model = self.model(name)
        self.publications.append({"model": model.name, "schema": model.schema, "status": "PUBLISHED" if report.ok else "FAILED", "run_id": report.run_id})
        if not report.ok:
            raise SemanticError("SEMANTIC_SURFACE_010", f"Model {name} isn't valid: {', '.join(report.codes())}.")
        self.cache = {k: v for k, v in self.cache.items() if k[0] != model.fingerprint()}
        self.published[model.schema.upper()] = model.name
        return report

    def refresh(self) -> list[str]:
        """Publish again every published model."""
        for name in list(self.published.values()):
            self.publish(name)
        return list(self.published.values())

    def planner(self, model: Model) -> Planner:
        report = self.reports.get(model.fingerprint())
        return Planner(model, self.relations.columns, report.matrix if report else None, self.max_branches, self.anchor)

    # -- compiling -------------------------------------------------------------------------------------------
    def compile(self, request: str | dict, log: bool = True) -> Compiled:
        """A structured request's plan; never raises for a bad request."""
        out = self._answer(lambda: self._compile(request))
        if log:
            body = request if isinstance(request, str) else json.dumps(request, default=str)
            self.requests.append({"request_id": len(self.requests) + 1, "request": body, **self._entry(out, request)})
            out.request_id = len(self.requests)
        return out

    @staticmethod
    def _entry(out: Compiled, request) -> dict:
        told = {k: request.get(k) for k in LOGGING} if isinstance(request, dict) else {k: None for k in LOGGING}
        return {
            "status": out.status,
            "error_code": out.error_code,
            "generated_sql": out.generated_sql,
            "plan_json": out.plan_json(),
            "cache_hit": out.cache_hit,
            "runtime_ms": out.planner_ms,
            **told,
        }

    def _answer(self, work) -> Compiled:
        began = time.perf_counter()
        try:
            out = work()
        except SemanticError as e:
            clarify = e.code.endswith("_021")
            out = Compiled(
                "NEEDS_CLARIFICATION" if clarify else "ERROR",
                e.code,
                e.message,
                plan={"reason_code": e.reason, **e.details} if e.reason else None,
                clarification=e.candidates if clarify else None,
            )
        except ExpressionError as e:
            out = Compiled("ERROR", "SEMANTIC_REQUEST_999", str(e))
        if not out.cache_hit:
            out.planner_ms = (time.perf_counter() - began) * 1000
        return out

    def _compile(self, request: str | dict) -> Compiled:
        spec = query_spec(request)
        model = self.model(spec.model)
        key = (model.fingerprint(), spec.cache_key())
        report = self.reports.get(key[0])
        if key in self.cache and report:
            plan, text = self.cache[key]
            return Compiled("OK", generated_sql=text, plan=plan, validation_run_id=report.run_id, cache_hit=True)
        plan = self.planner(model).plan(spec)
        text = render_sql(plan)
        if len(text.encode()) > MAX_SQL_BYTES:
            raise SemanticError("SEMANTIC_REQUEST_075", f"The plan renders to more than {MAX_SQL_BYTES} bytes.", "PLANNER_SQL_SIZE_LIMIT_EXCEEDED")
        while len(self.cache) >= MAX_CACHED:
            del self.cache[next(iter(self.cache))]
        self.cache[key] = (plan, text)
        return Compiled("OK", generated_sql=text, plan=plan, validation_run_id=report.run_id if report else None)

    def compile_sql(self, text: str, log: bool = True) -> Compiled:
        """A semantic SELECT's plan; UNCHANGED for any other text."""
        if not self._is_semantic(text):
            return Compiled("UNCHANGED", original_sql=text, generated_sql=text)

        def work() -> Compiled:
            try:
                out = self._compile(sqlfront.parse(text, self._published_object))
            except SemanticError as e:
                raise SemanticError(e.code.replace("SEMANTIC_REQUEST", "SEMANTIC_QUERY"), e.message, e.reason, e.candidates, **e.details) from e
            return dataclasses.replace(out, original_sql=text)

        out = self._answer(work)
        out.original_sql = text
        if log:
            self.query_log.append({"query_id": len(self.query_log) + 1, "original_sql": text, **self._entry(out, None)})
        return out

    def _is_semantic(self, text: str) -> bool:
        found = sqlfront.target(text) if sqlfront.is_select(text) else None
        return bool(found and found[0].upper() in self.published)

    def _published_object(self, schema: str, name: str):
        model = self.models.get(str(self.published.get(schema.upper(), "")).upper())
        if model is None:
            return None
        obj = model.get("objects", name)
        if obj is None:
            raise SemanticError("SEMANTIC_REQUEST_012", f"Semantic object not found: {name}")
        return self.planner(model), model.name, obj

    # -- running ---------------------------------------------------------------------------------------------
    def frame(self, compiled: Compiled, typed: bool = False) -> DataFrame:
        if compiled.status != "OK":
            raise SemanticError(compiled.error_code or "SEMANTIC_REQUEST_999", compiled.error_message or compiled.status, candidates=compiled.clarification)
        return lower(self.relations, compiled.plan, typed)

    def query(self, request: str | dict, typed: bool = False) -> DataFrame:
        """The DataFrame that answers a structured request."""
        return self.frame(self.compile(request), typed)

    def sql(self, text: str, debug: bool = False) -> DataFrame:
        """Semantic SQL, authoring and discovery commands; any other text goes to ``spark.sql``."""
        if not self.semantic_sql:
            if self._is_semantic(text):
                raise SemanticError("SEMANTIC_SURFACE_001", "A published object can only be read with semantic SQL switched on.")
            return self.spark.sql(text)
        answer = ddl.execute(self, text)
        if answer is not None:
            return answer
        compiled = self.compile_sql(text, log=debug)
        return self.spark.sql(text) if compiled.status == "UNCHANGED" else self.frame(compiled)

    def explain(self, text: str) -> dict:
        """Compile with a log entry; the plan and its SQL."""
        out = self.compile_sql(text)
        return {"status": out.status, "error_code": out.error_code, "error_message": out.error_message, "generated_sql": out.generated_sql, "plan": out.plan}

    def physical(self, request: str | dict, mode: str = "formatted") -> str:
        """Spark's own plan of a request."""
        df = self.query(request)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def envelope(self, compiled: Compiled) -> DataFrame:
        """A compile answer as its nine-column row."""
        row = (
            compiled.status,
            compiled.error_code,
            compiled.error_message,
            compiled.original_sql,
            compiled.generated_sql,
            compiled.plan_json(),
            json.dumps(compiled.clarification) if compiled.clarification else None,
            compiled.validation_run_id,
            compiled.request_id,
        )
        schema = "STATUS string, ERROR_CODE string, ERROR_MESSAGE string, ORIGINAL_SQL string, GENERATED_SQL string, PLAN_JSON string, CLARIFICATION_JSON string, VALIDATION_RUN_ID long, AGENT_REQUEST_ID long"
        return self.spark.createDataFrame([row], schema)

    # -- authoring -------------------------------------------------------------------------------------------
    def apply(self, definition: str, dry_run: bool = False) -> dict:
        """Apply an ALTER SEMANTIC VIEW statement if the model stays valid; otherwise nothing changes."""
        return ddl.apply(self, definition, dry_run)

    def suggest_grain(self, name: str) -> list[dict]:
        """Keys and endpoint mappings that plain primary keys and single-equality joins imply; nothing is changed."""
        return ddl.suggest_grain(self.model(name))


def request_of(request: str | dict) -> dict:
    return decode(request)
