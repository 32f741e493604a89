"""What reaches the scan, and functions of a schema in expressions."""

import duckdb
import pytest

from granary.demo import tpch_session
from granary.plans.planner import implied_dates
from granary.queries import SQL, Q


@pytest.mark.parametrize(
    ("op", "value", "bounds"),
    [
        (">=", "1999", [">= DATE '1999-01-01'"]),
        (">", 1999, [">= DATE '2000-01-01'"]),
        ("<", 1999, ["< DATE '1999-01-01'"]),
        ("<=", 1999, ["< DATE '2000-01-01'"]),
        ("=", 1999, [">= DATE '1999-01-01'", "< DATE '2000-01-01'"]),
        ("IN", [1999, 1996], [">= DATE '1996-01-01'", "< DATE '2000-01-01'"]),
        ("BETWEEN", [1996, 1997], [">= DATE '1996-01-01'", "< DATE '1998-01-01'"]),
        ("<>", 1999, []),
        ("IS NULL", None, []),
        ("=", 1999.5, []),
        ("IN", [1999, None], []),
    ],
)
def test_years_imply_dates(op, value, bounds):
    assert implied_dates("YEAR(o.d)", op, value) == [f"o.d {b}" for b in bounds]
    assert implied_dates("YEAR(o.d) + 1", op, value) == implied_dates("YEAR(d)", op, value) == implied_dates("MONTH(o.d)", op, value) == []


def _counts(s, op, value):
    rows = s.query({"model": "tpch", "object": "ORDERS", "metrics": ["order_count"], "filters": [{"field": "order_year", "op": op, "value": value}]}).collect()
    return rows[0]["order_count"]


def test_year_reaches_the_scan(spark, sf):  # o_orderdate is a timestamp
    s = tpch_session(spark, sf)
    request = {"model": "tpch", "object": "ORDERS", "metrics": ["order_count"], "filters": [{"field": "order_year", "op": ">=", "value": "1999"}]}
    plan = s.query(request)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in plan
    years = [r[0] for r in duckdb.sql(f"SELECT year(o_orderdate) FROM '{sf}/orders.parquet'").fetchall()]
    middle = sorted(years)[len(years) // 2]
    for op, keep in ((">=", lambda y: y >= middle), (">", lambda y: y > middle), ("<", lambda y: y < middle), ("<=", lambda y: y <= middle), ("=", lambda y: y == middle), ("!=", lambda y: y != middle)):
        assert _counts(s, op, middle) == sum(map(keep, years)), op
    assert _counts(s, "BETWEEN", [middle - 1, middle]) == sum(y in (middle - 1, middle) for y in years)


def test_function_of_a_schema(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    wanted = sorted(duck.sql(SQL["qualified_function"]).fetchall())
    got = Q["qualified_function"](spark, sf)
    assert sorted(tuple(r) for r in got.select("told", "order_count").collect()) == wanted
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
