"""Authoring, introspection, interchange, services and views."""

import json

import pytest

from granary import services
from granary.ddl import apply_suggestions, export, parse_definition, rename_metric, suggest_grain
from granary.demo import sales_model, sales_session, tpch_model
from granary.errors import SemanticError
from granary.queries import LINES_VIEW
from granary.sources.interchange import diff, export_model, import_model, load, plan_import, validate_document
from granary.sources.metric_view import import_metric_view
from granary.views import agent_view, agent_views, catalog_view, catalog_views, register_views


@pytest.fixture
def sales(spark):
    s = sales_session(spark)
    s.publish("sales")
    return s


ADD = """ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC units
  AS SUM(quantity) ON ENTITY order_line RETURNS DECIMAL(18,0) FORMAT 'integer' DISPLAY 'Units' COMMENT 'Units sold'
  SYNONYMS ('pieces') ADDITIVE PUBLIC CERTIFIED;"""


def test_add_replace_rename_drop(sales):
    assert sales.sql(ADD).first().status == "APPLIED"
    assert float(sales.sql("SELECT pieces FROM SEMANTIC_SALES.SALES").first()[0]) == 11
    row = sales.apply("ALTER SEMANTIC VIEW sales.SALES RENAME METRIC total_revenue TO merchandise_value")
    assert row["status"] == "APPLIED"
    m = sales.model("sales")
    assert m.get("metrics", "gross_margin").expression == "merchandise_value - total_cost"
    assert list(m.metrics)[0] == "MERCHANDISE_VALUE"
    assert float(sales.sql("SELECT total_revenue FROM SEMANTIC_SALES.SALES").first()[0]) == 5270
    assert sales.apply("ALTER SEMANTIC VIEW sales.SALES DROP METRIC units")["status"] == "APPLIED"
    assert sales.model("sales").get("metrics", "units") is None


def test_invalid_change_is_rolled_back(sales):
    before = sales.model("sales")
    row = sales.apply("ALTER SEMANTIC VIEW sales.SALES DROP METRIC total_cost")
    assert (row["status"], row["error_code"]) == ("ERROR", "SEMANTIC_DDL_090") and "restored" in row["message"]
    assert sales.model("sales") is before
    with pytest.raises(SemanticError):
        sales.sql("ALTER SEMANTIC VIEW sales.SALES DROP METRIC total_cost")


def test_dry_run(sales):
    before = sales.model("sales")
    assert sales.apply(ADD, dry_run=True)["status"] == "DRY_RUN"
    assert sales.model("sales") is before


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("ALTER VIEW x.y", "001"),
        ("ALTER SEMANTIC VIEW x", "002"),
        ("ALTER SEMANTIC VIEW sales.SALES REPLACE FACTS", "010"),
        ("ALTER SEMANTIC VIEW sales.SALES REPLACE METRICS (FACT a)", "011"),
        ("ALTER SEMANTIC VIEW sales.SALES EXPLODE", "012"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) ON ENTITY order_line", "030"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) RETURNS INT", "023"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE FACT a AS ol.quantity ON ENTITY order_line", "024"),
        ("ALTER SEMANTIC VIEW nope.SALES DROP METRIC a", "034"),
        ("ALTER SEMANTIC VIEW sales.NOPE DROP METRIC a", "035"),
        ("ALTER SEMANTIC VIEW sales.SALES DROP METRIC a", "042"),
        ("ALTER SEMANTIC VIEW sales.SALES RENAME METRIC a TO b", "050"),
        ("ALTER SEMANTIC VIEW sales.SALES RENAME METRIC total_cost TO total_revenue", "051"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) ON ENTITY order_line RETURNS INT RATIO", "070"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS COUNT(quantity) ON ENTITY order_line RETURNS INT DISTINCT", "071"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) ON ENTITY order_line RETURNS INT SEMI_ADDITIVE", "072"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) ON ENTITY order_line RETURNS INT SEMI_ADDITIVE BY nothing", "073"),
        ("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC a AS SUM(quantity) ON ENTITY order_line RETURNS INT WINDOW", "074"),
    ],
)
def test_definition_errors(sales, text, code):
    assert sales.apply(text)["error_code"] == f"SEMANTIC_DDL_{code}"


def test_ratio_of_aggregates(sales):
    row = sales.apply("ALTER SEMANTIC VIEW sales.SALES ADD OR REPLACE METRIC line_value AS SUM(net_revenue) / SUM(quantity) ON ENTITY order_line RETURNS DECIMAL(18,2) FORMAT 'currency' COMMENT 'c' RATIO PUBLIC")
    assert row["status"] == "APPLIED", row
    assert round(float(sales.sql("SELECT line_value FROM SEMANTIC_SALES.SALES").first()[0]), 3) == 479.091


def test_export_round_trip(sales):
    text = export(sales.model("sales"), "SALES")
    again = parse_definition(text)
    assert [op for op, *_ in again.operations] == ["REPLACE_METRICS"]
    before = sales.model("sales").content()
    assert sales.apply(text)["status"] == "APPLIED"
    assert json.loads(sales.model("sales").content())["metrics"] == json.loads(before)["metrics"]


def test_commands(sales):
    assert sales.sql("SHOW SEMANTIC VIEWS").count() == 1
    assert sales.sql("SHOW SEMANTIC VIEW sales.SALES").count() == 9
    assert sales.sql("SHOW SEMANTIC METRICS IN sales.SALES").count() == 5
    assert sales.sql("SHOW SEMANTIC DIMENSIONS FOR METRIC sales.SALES.total_revenue").count() == 4
    told = {r.property: r.value for r in sales.sql("EXPLAIN SEMANTIC METRIC sales.SALES.gross_margin_pct").collect()}
    assert "net_revenue" in told["lineage.total_revenue"] and "customer_region" in told["compatible_dimensions"]
    assert sales.sql("DESCRIBE SEMANTIC METRIC sales.SALES.total_cost").count() > 5
    assert "METRIC" in sales.sql("EXPORT SEMANTIC METRIC sales.SALES.total_cost").first()[0]
    assert sales.sql("EXPORT SEMANTIC MODEL sales").count() == 1
    assert {r.property: r.value for r in sales.sql("EXPLAIN SEMANTIC QUERY SELECT total_cost FROM SEMANTIC_SALES.SALES").collect()}["status"] == "OK"
    for text, code in (
        ("SHOW SEMANTIC METRICS", "060"), ("SHOW SEMANTIC DIMENSIONS FOR METRIC x", "061"), ("DESCRIBE SEMANTIC METRIC x", "062"), ("EXPLAIN SEMANTIC METRIC x", "063"),
        ("EXPORT SEMANTIC METRIC x", "064"), ("EXPORT SEMANTIC VIEW x", "065"), ("EXPORT SEMANTIC MODEL", "066"), ("SHOW SEMANTIC VIEW x", "067"),
    ):
        with pytest.raises(SemanticError) as e:
            sales.sql(text)
        assert e.value.code == f"SEMANTIC_DDL_{code}"


def test_suggestions():
    m = sales_model()
    import dataclasses

    bare = dataclasses.replace(m, keys={}, relationships={k: dataclasses.replace(r, mappings=()) for k, r in m.relationships.items()})
    again = apply_suggestions(bare, suggest_grain(bare))
    assert {k.entity for k in again.keys.values()} == {"order", "customer", "product"}
    assert all(r.mappings == m.relationships[k].mappings for k, r in again.relationships.items())


def test_publish_refuses_invalid(spark):
    s = sales_session(spark)
    s.add(s.model("sales").show("SALES", "METRIC", "nothing"))
    with pytest.raises(SemanticError) as e:
        s.publish("sales")
    assert e.value.code == "SEMANTIC_SURFACE_010" and s.publications[-1]["status"] == "FAILED"


# -- metric views ------------------------------------------------------------------------------------------------
def test_metric_view_mapping():
    out = import_metric_view(LINES_VIEW + "filter: l_shipdate > '1990-01-01'\nmaterialization: {}\n", "v", "SEMANTIC_V", "LINES")
    m = out.model
    assert out.codes() == ["DBX_IMPORT_250", "DBX_IMPORT_250", "DBX_IMPORT_250", "DBX_IMPORT_500", "DBX_IMPORT_510"]
    assert m.get("dimensions", "vendor_country").entity == "home" and m.get("dimensions", "vendor_country").expression.endswith(".n_name")
    assert m.get("metrics", "units_per_part").expression == "units / NULLIF(parts_sold, 0)" and m.get("metrics", "units_per_part").kind == "RATIO"
    assert m.get("metrics", "returned_units").filter == "return_code = 'R'" and m.get("facts", "units_base").private
    assert m.get("relationships", "vendor_home").condition.endswith(".n_nationkey")


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("joins: [{source: a.b, on: source.x = b.y}]", "230"),
        ("joins: [{name: j, source: SELECT 1, on: source.x = j.y}]", "211"),
        ("joins: [{name: j, source: a.b, using: [x]}]", "240"),
        ("joins: [{name: j, source: a.b}]", "241"),
        ("fields: [{name: f, expr: elsewhere.x}]", "310"),
        ("fields: [{name: f}]", "320"),
        ("measures: [{expr: SUM(x)}]", "400"),
        ("measures: [{name: m, expr: SUM(x), window: [{order: d}]}]", "410"),
        ("measures: [{name: m, expr: SUM(x) + 1}]", "420"),
        ("measures: [{name: m, expr: 'SUM(x ~ 1)'}]", "430"),
    ],
)
def test_metric_view_diagnostics(text, code):
    assert f"DBX_IMPORT_{code}" in import_metric_view(f"source: a.t\n{text}\n", "v", "S", "O").codes()


def test_metric_view_needs_a_table():
    with pytest.raises(SemanticError) as e:
        import_metric_view("source: SELECT * FROM t", "v", "S", "O")
    assert e.value.code == "DBX_IMPORT_210"


# -- interchange ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("make", [sales_model, tpch_model])
def test_lossless_round_trip(make):
    document, warnings = export_model(make(), "lossless")
    again, issues = import_model(document)
    assert not warnings and not issues and again.content() == make().content()
    assert diff(document, export_model(again, "lossless")[0]) == []


def test_interoperability_profile():
    document, warnings = export_model(sales_model())
    assert any("completed_revenue" in w for w in warnings) and "custom_extensions" not in json.dumps(document)
    again, issues = import_model(json.dumps(document))
    assert again.get("relationships", "order_customer").mappings and {i["severity"] for i in issues} == {"WARNING"}
    assert diff(document, export_model(again)[0]) == []  # what is portable stays


DOCUMENT = """
version: "0.2.0.dev0"
semantic_model:
  - name: history
    datasets:
      - name: line
        source: MART.LINES
        primary_key: [order_id, line_id]
        fields:
          - {name: order_date, dimension: {is_time: true}, expression: {dialects: [{dialect: ANSI_SQL, expression: order_date}]}}
      - name: customer
        source: MART.HISTORY
        unique_keys: [[customer_id, valid_from]]
        fields: []
    relationships:
      - name: to_customer
        from: line
        to: customer
        from_columns: [customer_id]
        to_columns: [customer_id]
        custom_extensions:
          - vendor_name: ANY
            data: '{"join_condition": "l.customer_id = c.customer_id AND l.order_date >= c.valid_from", "requires_native_join_condition": true}'
    metrics:
      - {name: lines, expression: {dialects: [{dialect: ANSI_SQL, expression: COUNT(order_date)}]}}
"""


def test_import_documents():
    m, issues = import_model(DOCUMENT)
    assert m.get("relationships", "to_customer").condition.endswith("c.valid_from") and not m.get("relationships", "to_customer").mappings
    assert m.get("dimensions", "order_date").expression == "l.order_date" and m.get("dimensions", "order_date").data_type == "DATE"
    assert [i["severity"] for i in issues] == ["WARNING"]
    assert plan_import(load(DOCUMENT), strict=True)[0] == []
    with pytest.raises(SemanticError):
        import_model(DOCUMENT, strict=True)
    bad = load(DOCUMENT)
    bad["semantic_model"][0]["relationships"][0]["to_columns"] = []
    assert any("length" in i["message"] for i in validate_document(bad))


# -- services and views --------------------------------------------------------------------------------------------
def test_search_scores(sales):
    got = {(r.field_name, r.score) for r in services.search(sales, "total_revenue").collect()}
    assert ("total_revenue", 100) in got
    assert ("total_revenue", 95) in {(r.field_name, r.score) for r in services.search(sales, "show me the revenue").collect()}
    assert services.search(sales, "100%").count() == 0
    assert services.best_term(" show the values of ") == "show the values of" and services.best_term("list metric tax") == "tax"


def test_describe_and_glossary(sales):
    told = services.describe_object(sales, "sales", "SALES")
    assert "total_revenue" in told["text"] and len(told["fields"]) == 9
    assert "also revenue, sales" in services.glossary(sales, "sales")
    assert {t["name"] for t in json.loads(services.glossary(sales, "sales", "JSON"))["terms"]} >= {"customer_region", "gross_margin"}


def test_feedback_instructions_and_proposals(sales):
    out = sales.compile({"model": "sales", "object": "SALES", "metrics": ["total_revenue"]})
    assert services.explain(sales, out.request_id)["status"] == "OK"
    assert services.record_feedback(sales, out.request_id, "HELPFUL", "good")["feedback_id"] == 1
    with pytest.raises(SemanticError):
        services.record_feedback(sales, out.request_id, "MAYBE")
    services.add_instruction(sales, "sales", "OBJECT", "SALES", "GENERAL", "Prefer net revenue.")
    services.add_instruction(sales, "sales", "OBJECT", "SALES", "GENERAL", "Prefer net revenue.")
    assert len(sales.model("sales").instructions) == 1
    services.add_verified_query(sales, "sales", "q1", "SALES", "How much?", {"metrics": ["total_revenue"]})
    with pytest.raises(SemanticError):
        services.add_verified_query(sales, "sales", "q2", "SALES", "How?", {"metrics": ["nothing"]})
    before = sales.model("sales")
    a = services.propose(sales, "sales", "DEFINITION_CHANGE", "METRIC", "total_cost", {"expression": "SUM(net_cost) * 2"})
    assert services.propose(sales, "sales", "DEFINITION_CHANGE", "METRIC", "total_cost", {"expression": "SUM(net_cost) * 2"}) is a
    with pytest.raises(SemanticError):
        services.propose(sales, "sales", "NEW_IDENTITY", "METRIC", "total_cost", {})
    assert agent_view(sales, "MODEL_EVOLUTION_REVIEW_QUEUE").count() == 1
    services.review(sales, a["suggestion_id"], "CERTIFIED", "me")
    assert sales.model("sales") is before and agent_view(sales, "MODEL_EVOLUTION_REVIEW_QUEUE").count() == 0
    with pytest.raises(SemanticError):
        services.review(sales, a["suggestion_id"], "REJECTED", "me")


def test_views(sales, spark):
    sales.compile({"model": "sales", "object": "SALES", "metrics": ["total_revenue"]})
    assert len(catalog_views()) == 40 and len(agent_views()) == 13
    for n in catalog_views():
        catalog_view(sales, n).count()
    counts = {n: agent_view(sales, n).count() for n in agent_views()}
    assert counts["EXPRESSION_FUNCTIONS"] == 29 and counts["COMPILE_REQUEST_SCHEMA"] == 12 and counts["FIELDS"] == 9 and counts["REQUEST_HISTORY"] == 1
    register_views(sales)
    assert spark.sql("SELECT count(*) FROM semantic_catalog_metric_dimension_matrix WHERE is_valid").first()[0] == 20


def test_rename_keeps_old_name():
    m = rename_metric(sales_model(), "total_cost", "cost")
    assert m.synonyms["METRIC.COST.TOTAL_COST"].name == "cost"
