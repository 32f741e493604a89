"""Goldens of the sales star, error codes, and the semantic SQL lane."""

import pytest

from granary.demo import sales_session
from granary.errors import SemanticError


@pytest.fixture(scope="module")
def sales(spark):
    s = sales_session(spark)
    report = s.publish("sales")
    assert report.status == "OK" and len(report.matrix) == 20 and all(r["valid"] for r in report.matrix.values())
    return s


def ask(s, **more):
    return {"model": "sales", "object": "SALES", "metrics": ["total_revenue"], "dimensions": ["customer_region"], **more}


def rows(s, **more):
    return [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in s.query(ask(s, **more)).collect()]


def test_top_regions(sales):
    assert rows(sales, order_by=[{"field": "total_revenue", "direction": "DESC"}], limit=2) == [("North", 3635.0), ("West", 1500.0)]


def test_margin_of_complete_orders(sales):
    got = rows(sales, metrics=["gross_margin_pct"], filters=[{"field": "order_status", "op": "=", "value": "COMPLETE"}], order_by=[{"field": "gross_margin_pct"}])
    assert [(r, round(x, 6)) for r, x in got] == [("North", 0.317744), ("South", 0.555556)]


def test_filtered_metric(sales):
    got = rows(sales, metrics=["completed_revenue"], dimensions=["product_category"], filters=[{"field": "order_month", "op": ">=", "value": "2026-02-01"}], order_by=[{"field": "completed_revenue", "direction": "DESC"}])
    assert got == [("Bikes", 2200.0), ("Accessories", 75.0)]


def test_filtered_sum_is_zero_without_match(sales):
    assert ("West", 0.0) in rows(sales, metrics=["completed_revenue"])


def test_synonyms(sales):
    out = sales.compile(ask(sales, metrics=["revenue"], dimensions=["region"]))
    assert [m["name"] for m in out.plan["metrics"]] == ["total_revenue"] and [d["name"] for d in out.plan["dimensions"]] == ["customer_region"]


def test_null_filters(sales):
    assert rows(sales, filters=[{"field": "customer_region", "op": "IS NULL"}]) == []
    assert len(rows(sales, filters=[{"field": "customer_region", "op": "IS NOT NULL"}], having=[{"field": "total_revenue", "op": "IS NOT NULL"}])) == 3


@pytest.mark.parametrize(
    ("more", "code"),
    [
        ({"metrics": ["not_a_metric"]}, "020"),
        ({"metrics": ["customer_region"]}, "022"),
        ({"output": {"shape": "nested"}}, "004"),
        ({"limit": 10001}, "051"),
        ({"limit": 0}, "050"),
        ({"limit": 1.5}, "050"),
        ({"filters": [{"field": "order_status"}]}, "015"),
        ({"filters": [{"field": "total_revenue", "op": ">", "value": 1}]}, "031"),
        ({"filters": [{"field": "order_status", "op": "IN", "value": []}]}, "032"),
        ({"filters": [{"field": "order_status", "op": "BETWEEN", "value": ["A"]}]}, "032"),
        ({"filters": [{"field": "order_status", "op": "~", "value": "A"}]}, "033"),
        ({"filters": [{"field": "order_status", "value_sql": "'A' OR 1 = 1"}]}, "030"),
        ({"having": [{"op": ">", "value": 1000}]}, "025"),
        ({"having": [{"field": "customer_region", "op": "=", "value": "x"}]}, "030"),
        ({"metrics": [], "having": [{"field": "total_revenue", "op": ">", "value": 1}]}, "026"),
        ({"metrics": [], "dimensions": []}, "023"),
        ({"order_by": [{"field": "order_status"}]}, "061"),
        ({"order_by": [{"direction": "ASC"}]}, "060"),
        ({"order_by": [{"field": "total_revenue", "direction": "UP"}]}, "062"),
        ({"model": ""}, "002"),
        ({"object": ""}, "003"),
        ({"model": "nowhere"}, "011"),
        ({"object": "NOWHERE"}, "012"),
        ({"proof_mode": "LOOSE"}, "071"),
    ],
)
def test_error_codes(sales, more, code):
    out = sales.compile(ask(sales, **more))
    assert (out.status, out.error_code) == ("ERROR", f"SEMANTIC_REQUEST_{code}")


def test_bad_json(sales):
    assert sales.compile('{"model":').error_code == "SEMANTIC_REQUEST_001"


def test_uncertified_model_is_refused(spark):
    s = sales_session(spark)
    assert s.compile(ask(s)).error_code == "SEMANTIC_REQUEST_010"
    s.validate("sales")
    assert s.compile(ask(s)).status == "OK"
    s.add(s.model("sales").add_synonym("METRIC", "total_cost", "costs"))
    assert s.compile(ask(s)).error_code == "SEMANTIC_REQUEST_010"


def test_ambiguous_synonym_needs_clarification(spark):
    s = sales_session(spark)
    s.add(s.model("sales").add_synonym("METRIC", "total_cost", "money", certified=False).add_synonym("METRIC", "total_revenue", "money", certified=False))
    s.validate("sales")
    out = s.compile(ask(s, metrics=["money"]))
    assert out.status == "NEEDS_CLARIFICATION" and out.error_code == "SEMANTIC_REQUEST_021"
    assert [c["name"] for c in out.clarification] == ["total_cost", "total_revenue"]


def test_cache_and_determinism(sales):
    a = sales.compile(ask(sales, client="one"))
    b = sales.compile(ask(sales, client="two", purpose="again"))
    assert b.cache_hit and b.planner_ms == 0 and a.plan_json() == b.plan_json() and a.generated_sql == b.generated_sql
    assert sales.requests[-1]["cache_hit"] and sales.requests[-1]["client"] == "two"


def test_envelope(sales):
    row = sales.envelope(sales.compile(ask(sales))).first()
    assert list(row.asDict()) == ["STATUS", "ERROR_CODE", "ERROR_MESSAGE", "ORIGINAL_SQL", "GENERATED_SQL", "PLAN_JSON", "CLARIFICATION_JSON", "VALIDATION_RUN_ID", "AGENT_REQUEST_ID"]
    assert row.STATUS == "OK" and row.VALIDATION_RUN_ID == 1


def test_only_needed_entities_are_joined(sales):
    plan = sales.compile(ask(sales, dimensions=["product_category"])).plan
    assert [j["entity"] for j in plan["branches"][0]["joins"]] == ["PRODUCT"]
    plan = sales.compile(ask(sales, dimensions=[])).plan
    assert plan["branches"][0]["joins"] == []


def test_typed_output(sales):
    df = sales.query(ask(sales, dimensions=["order_month"]), typed=True)
    assert [t for _, t in df.dtypes] == ["date", "decimal(18,2)"]


# -- SQL lane ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text",
    [
        "SELECT customer_region, total_revenue FROM SEMANTIC_SALES.SALES",
        "SELECT customer_region, MEASURE(total_revenue) FROM semantic_sales.sales GROUP BY customer_region",
        "select s.region, agg(revenue) r from SEMANTIC_SALES.SALES AS s group by all -- comment",
        "SELECT customer_region AS a, total_revenue b FROM SEMANTIC_SALES.SALES GROUP BY 1;",
        "SELECT total_revenue, customer_region FROM SEMANTIC_SALES.SALES /* dims first */ GROUP BY a, 2".replace("a, ", ""),
    ],
)
def test_sql_equals_structured(sales, text):
    got = {(r.customer_region, float(r.total_revenue)) for r in sales.sql(text).collect()}
    assert got == {tuple(r) for r in rows(sales)}


def test_sql_clauses(sales):
    text = "SELECT customer_region, total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status IN ('complete', 'CANCELLED') AND order_month BETWEEN '2026-01-01' AND DATE '2026-02-28' AND total_revenue > 140 ORDER BY 2 DESC LIMIT 5"
    assert [(r.customer_region, float(r.total_revenue)) for r in sales.sql(text).collect()] == [("North", 3635.0), ("West", 1500.0)]
    assert len(sales.sql("SELECT * FROM SEMANTIC_SALES.SALES").columns) == 9


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT total_revenue + 1 FROM SEMANTIC_SALES.SALES", "005"),
        ("SELECT MEASURE(customer_region) FROM SEMANTIC_SALES.SALES", "006"),
        ("SELECT customer_region, total_revenue FROM SEMANTIC_SALES.SALES GROUP BY product_category", "008"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES GROUP BY customer_region", "008"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status = 'A' OR order_status = 'B'", "030"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE NOT order_status = 'A'", "030"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE UPPER(order_status) = 'A'", "031"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status IN 'A'", "032"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status IN (customer_region)", "033"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status BETWEEN 'A'", "034"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status BETWEEN x AND 'B'", "035"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status IS NULL 1", "036"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_status = customer_region", "030"),
        ("SELECT nope FROM SEMANTIC_SALES.SALES", "020"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.NOPE", "012"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES LIMIT 0", "050"),
        ("SELECT total_revenue FROM SEMANTIC_SALES.SALES ORDER BY total_revenue + 1", "060"),
    ],
)
def test_sql_error_codes(sales, text, code):
    out = sales.compile_sql(text)
    assert (out.status, out.error_code) == ("ERROR", f"SEMANTIC_QUERY_{code}")


def test_other_text_passes_through(sales):
    assert sales.compile_sql("CREATE TABLE x (a INT)").status == "UNCHANGED"
    assert sales.compile_sql("SELECT 1 FROM other.place").status == "UNCHANGED"
    assert sales.sql("SELECT 1 AS one").collect()[0].one == 1


def test_raw_right_hand_side(sales):
    text = "SELECT total_revenue FROM SEMANTIC_SALES.SALES WHERE order_month < ADD_MONTHS(TO_DATE('2026-01-15', 'YYYY-MM-DD'), 1)"
    assert float(sales.sql(text).collect()[0][0]) == 5270.0  # February's orders stand at its first day


def test_explain_and_logs(sales):
    told = sales.explain("SELECT customer_region, total_revenue FROM SEMANTIC_SALES.SALES")
    assert told["status"] == "OK" and "SUM(" in told["generated_sql"] and sales.query_log[-1]["status"] == "OK"


def test_query_raises(sales):
    with pytest.raises(SemanticError):
        sales.query(ask(sales, metrics=["nope"]))
