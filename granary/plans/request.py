"""Structured requests: the closed key set, canonical form and cache key."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from granary.errors import SemanticError

#: Accepted keys of a request, in documented order.
KEYS = ("model", "object", "metrics", "dimensions", "filters", "having", "order_by", "limit", "client", "purpose", "natural_language_text", "proof_mode")
LOGGING = ("client", "purpose", "natural_language_text")
MAX_LIMIT = 10_000
OPERATORS = ("=", "!=", "<>", "<", "<=", ">", ">=", "LIKE", "IN", "BETWEEN", "IS NULL", "IS NOT NULL")


@dataclass
class QuerySpec:
    model: str
    object: str
    metrics: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    filters: list[dict] = field(default_factory=list)
    having: list[dict] = field(default_factory=list)
    order_by: list[dict] = field(default_factory=list)
    limit: int | None = None
    proof_mode: str = "LEGACY_JOIN"

    def cache_key(self) -> str:
        return hashlib.sha256(json.dumps(self.__dict__, sort_keys=True, default=str).encode()).hexdigest()[:16]


def decode(request: str | dict) -> dict:
    if isinstance(request, str):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise SemanticError("SEMANTIC_REQUEST_001", f"Request is not valid JSON: {e}.") from e
    if not isinstance(request, dict):
        raise SemanticError("SEMANTIC_REQUEST_001", "Request must be a JSON object.")
    return request


def _names(request: dict, key: str) -> list[str]:
    value = request.get(key)
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
        raise SemanticError("SEMANTIC_REQUEST_001", f"{key} must be an array of names.")
    return [v.strip() for v in value]


def _objects(request: dict, key: str) -> list[dict]:
    value = request.get(key)
    if value is None:
        return []
    if not isinstance(value, list):
        raise SemanticError("SEMANTIC_REQUEST_001", f"{key} must be an array.")
    return [{"field": v} if isinstance(v, str) and key == "order_by" else v for v in value]


def query_spec(request: str | dict) -> QuerySpec:
    request = decode(request)
    unknown = sorted(set(request) - set(KEYS))
    if unknown:
        raise SemanticError("SEMANTIC_REQUEST_004", f"Unknown request keys: {', '.join(unknown)}. Allowed keys: {', '.join(KEYS)}.")
    for key, code in (("model", "SEMANTIC_REQUEST_002"), ("object", "SEMANTIC_REQUEST_003")):
        if not isinstance(request.get(key), str) or not request[key].strip():
            raise SemanticError(code, f"Request needs a {key} name.")
    mode = request.get("proof_mode") or "LEGACY_JOIN"
    if mode not in ("LEGACY_JOIN", "STRICT_GRAIN"):
        raise SemanticError("SEMANTIC_REQUEST_071", f"Unsupported proof mode {mode!r}.")
    return QuerySpec(
        request["model"].strip(),
        request["object"].strip(),
        _names(request, "metrics"),
        _names(request, "dimensions"),
        _objects(request, "filters"),
        _objects(request, "having"),
        _objects(request, "order_by"),
        request.get("limit"),
        mode,
    )


def predicate_parts(item: dict) -> tuple[str | None, str]:
    """(field, operator) of a filter or having entry, whatever its keys are called."""
    if not isinstance(item, dict):
        return None, "="
    name = next((item[k] for k in ("field", "dimension", "metric", "column", "name") if item.get(k)), None)
    op = item.get("op") or item.get("operator") or "="
    return name, " ".join(str(op).upper().split())
