"""Stable error codes. Requests answer with them as data; programming interfaces raise them."""

from __future__ import annotations


class SemanticError(Exception):
    """A refusal with a code, and details that a plan or a clarification can show."""

    def __init__(self, code: str, message: str, reason: str | None = None, candidates: list | None = None, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.reason, self.candidates, self.details = code, message, reason, candidates, details
