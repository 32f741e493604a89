"""Streams: the engine has no streaming operators of its own, but its plans run over them.

A request whose sources include a streaming relation lowers to the same DataFrame; SUM and COUNT states are what a
streaming aggregation keeps. One branch is one aggregation, which Structured Streaming runs; several branches would
aggregate twice and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from granary.errors import SemanticError


def streaming_query(session, request: dict) -> DataFrame:
    """The streaming DataFrame of a single-branch request without order and limit; write it in complete or update mode."""
    compiled = session.compile(request)
    df = session.frame(compiled)
    if not df.isStreaming:
        raise SemanticError("SEMANTIC_REQUEST_075", "No source of the request is a stream.", "NOT_STREAMING")
    if compiled.plan["kind"] != "SINGLE_BRANCH" or compiled.plan["order_by"] or compiled.plan["limit"]:
        raise SemanticError("SEMANTIC_REQUEST_075", "Only one branch without order and limit can run as a stream.", "STREAMING_PLAN_UNSUPPORTED")
    return df
