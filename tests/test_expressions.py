"""Expressions: tokens, rewriting, translation; and properties of requests."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.functions.catalog import ALLOWED, date_pattern, type_family
from granary.functions.expressions import ExpressionError, filtered, references, render, sole_aggregate, substitute, to_spark, tokenize
from granary.plans.planner import comparison, literal
from granary.plans.request import query_spec


def test_references():
    r = references("CASE WHEN o.status = 'net_revenue' THEN ABS(o.\"amount\") ELSE net_revenue END + CAST(x AS DECIMAL(18,2)) + EXTRACT(YEAR FROM d) + MART.F(y)")
    assert r.qualified == (("o", "status"), ("o", "amount")) and r.bare == ("net_revenue", "x", "d", "y") and r.functions == ("ABS", "CAST", "EXTRACT", "MART.F")


def test_substitution_leaves_qualified_and_literals():
    assert substitute("amount + o.amount + 'amount' + F(amount)", bare=lambda n: "(1)" if n == "amount" else None) == "(1) + o.amount + 'amount' + F((1))"
    assert substitute("c.id = o.id", qualified=lambda a, c: "CAST(c.x AS INT)" if a == "c" else None) == "CAST(c.x AS INT) = o.id"


@pytest.mark.parametrize("bad", ["a ~ b", "'open", "#"])
def test_unreadable(bad):
    with pytest.raises(ExpressionError):
        tokenize(bad)


def test_filters_go_inside_aggregates():
    assert filtered("SUM(a) / SUM(b)", "p", True) == "SUM(CASE WHEN p THEN a ELSE 0 END) / SUM(CASE WHEN p THEN b ELSE 0 END)"
    assert filtered("COUNT(DISTINCT a)", "p", True) == "COUNT(DISTINCT CASE WHEN p THEN a END)"
    assert filtered("AVG(a)", "p", False) == "AVG(CASE WHEN p THEN a END)"
    assert sole_aggregate("SUM(a) / SUM(b)") is None and sole_aggregate("SUM(a + MAX(b))").argument == "a + MAX(b)"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("TRUNC(1.239, 2)", 1.23),
        ("TRUNC(-1.9)", -1),
        ("TRUNC(DATE '2024-05-17', 'MM')", "2024-05-01"),
        ("DATE_TRUNC('year', TIMESTAMP '2024-05-17 10:00:00')", "2024-01-01 00:00:00"),
        ("TO_DATE('17.05.2024', 'DD.MM.YYYY')", "2024-05-17"),
        ("TO_CHAR(DATE '2024-05-17', 'YYYY/MM')", "2024/05"),
        ("CAST(12 AS VARCHAR(10)) || 'x'", "12x"),
        ("COALESCE(NULLIF(1, 1), 7)", 7),
        ("LPAD(SUBSTR('abcdef', 2, 3), 5, '*')", "**bcd"),
        ("EXTRACT(MONTH FROM DATE '2024-05-17') + YEAR(DATE '2024-05-17') + DAY(DATE '2024-05-17')", 2046),
        ("REPLACE(TRIM(' it''s '), '''', '-')", "it-s"),
        ("ROUND(2.5, 0) + CEIL(1.2) + FLOOR(1.8) + ABS(-1)", 7),
        ("UPPER(LTRIM('  a')) || LOWER(RTRIM('B ')) || CONCAT('c', 'd')", "Abcd"),
    ],
)
def test_functions(spark, text, value):
    got = spark.sql(f"SELECT {to_spark(text)}").first()[0]
    assert (float(got) == pytest.approx(value)) if isinstance(value, (int, float)) else str(got) == value


def test_function_list():
    assert len(ALLOWED) == 29 and date_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    assert [type_family(t) for t in ("DECIMAL(18,2)", "varchar(3)", "DATE", "BOOLEAN", "GEOMETRY", None)] == ["numeric", "string", "temporal", "boolean", "other", None]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20))
def test_literals_are_escaped(text):
    sql = literal(text, "VARCHAR(10)")
    assert sql[0] == sql[-1] == "'" and sql[1:-1].replace("\\\\", "").replace("\\'", "").count("'") == 0


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=12))
def test_literals_survive_spark(spark, text):
    assert spark.range(1).selectExpr(f"{literal(text, 'VARCHAR(10)')} AS v").first().v == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "o.b", "'x y'", "1.5", "+", "(", ")", ",", "SUM", "||", '"q q"']), max_size=12), st.lists(st.sampled_from([" ", "\n", "\t", " -- c\n", " /* c */ "]), min_size=13, max_size=13))
def test_white_space_and_comments_dont_matter(parts, gaps):
    text = "".join(g + p for p, g in zip(parts, gaps, strict=False))
    assert [t.text for t in tokenize(text)] == [t.text for t in tokenize(render(tokenize(text)))]


@settings(max_examples=50, deadline=None)
@given(st.permutations(["model", "object", "metrics", "dimensions", "limit"]), st.text(max_size=5))
def test_cache_key_ignores_order_and_logging(keys, client):
    body = {"model": "m", "object": "o", "metrics": ["a"], "dimensions": ["b"], "limit": 3}
    assert query_spec(json.dumps({**{k: body[k] for k in keys}, "client": client})).cache_key() == query_spec(body).cache_key()


def test_comparisons():
    assert comparison("x", "=", "a", None, "VARCHAR(3)", "P") == "upper(x) = upper('a')"
    assert comparison("x", "=", "1", None, "VARCHAR(3)", "P") == "x = '1'"
    assert comparison("x", "<", "a", None, "VARCHAR(3)", "P") == "x < 'a'"
    assert comparison("x", "=", "2024-01-01", None, "DATE", "P") == "x = DATE '2024-01-01'"
    assert comparison("x", ">", "2024-01-01", None, "TIMESTAMP", "P") == "x > TIMESTAMP_NTZ '2024-01-01'"
    assert comparison("x", "IN", ["1", 2], None, "INT", "P") == "x IN (1, 2)"
