"""Semantic expressions: tokens, a syntax tree of what matters, rewriting and rendering as Spark SQL.

Expressions stay SQL text at the edges. Here they are tokens with resolved roles, so names inside literals,
qualified references, function names and cast targets are never mistaken for facts or metrics.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from granary.functions.catalog import AGGREGATES, TRUNC_UNITS, date_pattern, type_family

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      |(?P<string>'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      |(?P<name>[A-Za-z_][A-Za-z0-9_$]*)
      |(?P<op><=|>=|<>|!=|\|\||[-+*/%(),.;=<>])""",
    re.X | re.S,
)
WORDS = frozenset(
    "CASE WHEN THEN ELSE END AND OR NOT IN BETWEEN IS NULL LIKE AS DISTINCT TRUE FALSE INTERVAL FROM FOR ESCAPE ASC DESC"
    " YEAR_MONTH CURRENT_DATE CURRENT_TIMESTAMP OVER PARTITION BY ORDER ROWS RANGE SELECT EXISTS UNION".split()
)
TYPE_WORDS = frozenset(
    "DECIMAL NUMBER NUMERIC DEC INT INTEGER BIGINT SMALLINT TINYINT DOUBLE PRECISION FLOAT REAL CHAR VARCHAR VARCHAR2 CLOB STRING DATE TIMESTAMP BOOLEAN".split()
)
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_]*\Z")


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # string, quoted, number, name, op
    text: str
    at: int = 0

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text

    @property
    def value(self) -> str:
        """What an identifier or literal says."""
        if self.kind == "string":
            return self.text[1:-1].replace("''", "'")
        if self.kind == "quoted":
            q = self.text[0]
            return self.text[1:-1].replace(q * 2, q)
        return self.text


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ExpressionError(f"unexpected text at {at}: {sql[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def closing(tokens: list[Token], at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i].text if tokens[i].kind == "op" else "", 0)
        if depth == 0:
            return i
    raise ExpressionError("unbalanced parentheses")


def roles(tokens: list[Token]) -> list[str]:
    """For each token: column (qualified), alias (its qualifier), bare, function, word, type, or other."""
    out = ["other"] * len(tokens)
    casts: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind not in ("name", "quoted"):
            continue
        before = tokens[i - 1].text if i else ""
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if after == "." and i + 2 < len(tokens):
            deeper = i + 3 < len(tokens) and tokens[i + 3].text == "("
            out[i] = "schema" if deeper else "alias"
        elif before == ".":
            out[i] = "function" if after == "(" else "column"
        elif any(a <= i <= b for a, b in _cast_targets(tokens, casts)):
            out[i] = "type"
        elif t.kind == "name" and after == "(" and t.upper not in WORDS:
            out[i] = "function"
        elif t.kind == "name" and t.upper in WORDS:
            out[i] = "word"
        elif t.kind == "name" and t.upper in ("DATE", "TIMESTAMP") and i + 1 < len(tokens) and tokens[i + 1].kind == "string":
            out[i] = "word"
        elif t.kind == "name" and i >= 2 and before == "(" and tokens[i - 2].upper == "EXTRACT":
            out[i] = "word"
        elif t.kind == "name" and i >= 2 and tokens[i - 2].upper == "INTERVAL":
            out[i] = "word"
        else:
            out[i] = "bare"
    return out


def _cast_targets(tokens: list[Token], memo: list) -> list[tuple[int, int]]:
    """Ranges of tokens between the AS and the end of each CAST."""
    if not memo:
        memo.append([])
        for i, t in enumerate(tokens):
            if t.upper == "CAST" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                end = closing(tokens, i + 1)
                depth = 0
                for k in range(i + 2, end):
                    depth += {"(": 1, ")": -1}.get(tokens[k].text, 0)
                    if depth == 0 and tokens[k].upper == "AS":
                        memo[0].append((k + 1, end - 1))
    return memo[0]


def render(tokens: list[Token]) -> str:
    out = ""
    for i, t in enumerate(tokens):
        tight = i and (t.text in (".", ",", ")") or tokens[i - 1].text in (".", "(") or t.text == "(" and tokens[i - 1].kind in ("name", "quoted") and tokens[i - 1].upper not in WORDS)
        out += ("" if not i or tight else " ") + t.text
    return out


@dataclass(frozen=True)
class References:
    qualified: tuple[tuple[str, str], ...]
    bare: tuple[str, ...]
    functions: tuple[str, ...]  # qualified ones as schema.name


def references(sql: str) -> References:
    tokens = tokenize(sql)
    role = roles(tokens)
    qualified, bare, functions = [], [], []
    for i, t in enumerate(tokens):
        if role[i] == "column" and i >= 2:
            qualified.append((tokens[i - 2].value, t.value))
        elif role[i] == "bare":
            bare.append(t.value)
        elif role[i] == "function":
            functions.append(f"{tokens[i - 2].value}.{t.value}" if i >= 2 and tokens[i - 1].text == "." else t.upper)
    return References(tuple(dict.fromkeys(qualified)), tuple(dict.fromkeys(bare)), tuple(dict.fromkeys(functions)))


def substitute(sql: str, bare: Callable[[str], str | None] | None = None, qualified: Callable[[str, str], str | None] | None = None) -> str:
    """``sql`` with bare names and qualified columns replaced where a function gives a text for them."""
    tokens = tokenize(sql)
    role = roles(tokens)
    out: list[Token] = []
    for i, t in enumerate(tokens):
        new = None
        if role[i] == "bare" and bare:
            new = bare(t.value)
        elif role[i] == "column" and qualified and i >= 2:
            new = qualified(tokens[i - 2].value, t.value)
            if new is not None:
                del out[-2:]
        out += [t] if new is None else [Token("raw", new)]
    return render(out)


@dataclass(frozen=True)
class Aggregate:
    function: str
    distinct: bool
    argument: str
    start: int
    end: int  # tokens [start, end]


def aggregates(sql: str) -> tuple[list[Token], list[Aggregate]]:
    """Outermost aggregate calls of an expression."""
    tokens = tokenize(sql)
    found, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "name" and t.upper in AGGREGATES and i + 1 < len(tokens) and tokens[i + 1].text == "(" and (not i or tokens[i - 1].text != "."):
            end = closing(tokens, i + 1)
            distinct = tokens[i + 2].upper == "DISTINCT"
            found.append(Aggregate(t.upper, distinct, render(tokens[i + 2 + distinct : end]), i, end))
            i = end
        i += 1
    return tokens, found


def sole_aggregate(sql: str) -> Aggregate | None:
    """The aggregate call that is the whole expression, if it is one."""
    tokens, found = aggregates(sql)
    return found[0] if len(found) == 1 and found[0].start == 0 and found[0].end == len(tokens) - 1 else None


def filtered(sql: str, predicate: str, missing_sum_is_zero: bool) -> str:
    """``sql`` with ``predicate`` pushed inside each aggregate."""
    tokens, found = aggregates(sql)
    out, at = [], 0
    for a in found:
        out += tokens[at : a.start]
        argument = "1" if a.argument == "*" else a.argument
        other = " ELSE 0" if a.function == "SUM" and missing_sum_is_zero and not a.distinct else ""
        out.append(Token("raw", f"{a.function}({'DISTINCT ' if a.distinct else ''}CASE WHEN {predicate} THEN {argument}{other} END)"))
        at = a.end + 1
    return render(out + tokens[at:])


def arguments(tokens: list[Token], opening: int) -> list[list[Token]]:
    """Token lists of a call's arguments."""
    end, depth, out = closing(tokens, opening), 0, [[]]
    for t in tokens[opening + 1 : end]:
        depth += {"(": 1, ")": -1}.get(t.text if t.kind == "op" else "", 0)
        if t.text == "," and t.kind == "op" and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def to_spark(sql: str, data_type: str | None = None) -> str:
    """An expression as Spark SQL: quoted names, date formats, TRUNC of dates and numbers, exact date buckets."""
    return _spark(tokenize(sql), data_type)


def _spark(tokens: list[Token], data_type: str | None) -> str:
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        call = t.kind == "name" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and (not i or tokens[i - 1].text != ".")
        if t.kind == "quoted" and t.text[0] == '"':
            out.append(Token("quoted", "`" + t.value.replace("`", "``") + "`"))
        elif call and t.upper in ("TRUNC", "DATE_TRUNC", "TO_DATE", "TO_CHAR"):
            end = closing(tokens, i + 1)
            out.append(Token("raw", _call(t.upper, arguments(tokens, i + 1), data_type)))
            i = end
        elif t.kind == "name" and t.upper in ("VARCHAR", "VARCHAR2", "CHAR", "CLOB") and i and tokens[i - 1].upper == "AS":
            out.append(Token("name", "STRING"))
            if i + 1 < len(tokens) and tokens[i + 1].text == "(":
                i = closing(tokens, i + 1)
        elif t.kind == "string":
            out.append(Token("string", "'" + t.value.replace("\\", "\\\\").replace("'", "\\'") + "'"))
        else:
            out.append(t)
        i += 1
    return render(out)


def _call(name: str, args: list[list[Token]], data_type: str | None) -> str:
    text = [_spark(a, data_type) for a in args]
    unit = args[1][0] if len(args) > 1 and len(args[1]) == 1 and args[1][0].kind == "string" else None
    if name == "DATE_TRUNC":
        first = args[0][0] if args and len(args[0]) == 1 and args[0][0].kind == "string" else None
        spark = TRUNC_UNITS.get(first.value.upper()) if first else None
        if spark and (data_type or "").strip().upper() == "DATE":
            return f"trunc({text[1]}, '{spark}')"  # days only, no time zone in between
        made = f"date_trunc({text[0]}, {text[1]})"
        return f"CAST({made} AS TIMESTAMP_NTZ)"
    if name == "TRUNC":
        if unit is not None:
            spark = TRUNC_UNITS.get(unit.value.upper())
            return f"trunc({text[0]}, '{spark}')" if spark else f"CAST({text[0]} AS DATE)"
        if len(args) == 1 and type_family(data_type) == "temporal":
            return f"CAST({text[0]} AS DATE)"
        scale = f"power(10, {text[1]})" if len(args) > 1 else "1"
        return f"(sign({text[0]}) * floor(abs({text[0]}) * {scale}) / {scale})"
    if unit is not None:
        text[1] = "'" + date_pattern(unit.value) + "'" if name == "TO_DATE" or type_family(unit.value) is None or any(c in unit.value.upper() for c in "YMDH") else text[1]
    return f"{name.lower()}({', '.join(text)})"
