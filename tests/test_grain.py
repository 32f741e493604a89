"""Several facts: goldens, metamorphic changes, refusals, registered aggregates and branch limits."""

from decimal import Decimal as D

import pytest

from granary.plans.graph import Graph
from tests.fixtures import TOLD, three_fact_model, three_fact_session

ALL = ["order_revenue", "ticket_count", "urgent_count", "payments", "revenue_per_ticket"]


@pytest.fixture(scope="module")
def d1(spark):
    s = three_fact_session(spark)
    assert s.publish("d1").ok
    return s


def ask(metrics, **more):
    return {"model": "d1", "object": "D1_METRICS", "metrics": metrics, "dimensions": ["customer_region"], **more}


def table(s, metrics, **more):
    return {r[0]: tuple(None if v is None else round(float(v), 6) for v in r[1:]) for r in s.query(ask(metrics, **more)).collect()}


def test_goldens(d1):
    got = table(d1, ALL)
    assert got == {
        "North": (175.0, 3.0, 2.0, 100.0, round(175 / 3, 6)),
        "South": (40.0, 1.0, 1.0, None, 40.0),
        "West": (None, 1.0, 0.0, 60.0, None),
        "East": (30.0, 0.0, 0.0, None, None),
        None: (18.0, 2.0, 1.0, 5.0, 9.0),
    }


def test_having_filter_total(d1):
    assert set(table(d1, ["order_revenue"], having=[{"field": "ticket_count", "op": ">", "value": 1}])) == {"North", None}
    assert table(d1, ["order_revenue", "payments"], filters=[{"field": "customer_region", "value": "north"}]) == {"North": (175.0, 100.0)}
    row = d1.query({**ask(["order_revenue", "ticket_count"]), "dimensions": []}).first()
    assert (float(row.order_revenue), int(row.ticket_count)) == (263.0, 7)


def test_order_and_limit_after_merge(d1):
    df = d1.query(ask(["ticket_count"], order_by=[{"field": "ticket_count", "direction": "DESC"}], limit=2))
    assert [r.customer_region for r in df.collect()] == ["North", None]


def test_changing_one_branch_leaves_the_others(spark, d1):
    s = three_fact_session(spark)
    s.publish("d1")
    s.relations.register("MART", "D1_TICKETS", s.relations("MART", "D1_TICKETS").limit(0))
    before, after = table(d1, ["order_revenue", "payments"]), table(s, ["order_revenue", "payments"])
    assert before == after
    assert all(v[0] == 0 for v in table(s, ["ticket_count"]).values())


def test_plan_shape_and_determinism(d1):
    a, b = d1.compile(ask(ALL)), d1.planner(d1.model("d1"))
    assert a.plan["kind"] == "MULTI_BRANCH" and [x["entity"] for x in a.plan["branches"]] == ["ORDER_FACT", "TICKET_FACT", "PAYMENT_FACT"]
    from granary.plans.request import query_spec

    assert b.plan(query_spec(ask(ALL))) == a.plan


def test_branch_limit(spark):
    s = three_fact_session(spark)
    s.max_branches = 2
    s.publish("d1")
    out = s.compile(ask(ALL))
    assert out.error_code == "SEMANTIC_REQUEST_075" and out.plan["reason_code"] == "PLANNER_BRANCH_LIMIT_EXCEEDED"


@pytest.mark.parametrize(
    ("change", "code", "reason"),
    [
        (lambda m: m.with_("metrics", "ticket_count_state", m.get("metrics", "ticket_count_state").__class__("ticket_count_state", "COUNT(DISTINCT ticket_row)", "ticket_fact", kind="DISTINCT", private=True)), "070", "METRIC_STATE_UNSUPPORTED"),
        (lambda m: m.with_("metrics", "ticket_count_state", m.get("metrics", "ticket_count_state").__class__("ticket_count_state", "AVG(ticket_row)", "ticket_fact", private=True)), "070", "METRIC_STATE_UNSUPPORTED"),
        (lambda m: m.with_("metrics", "ticket_count_state", m.get("metrics", "ticket_count_state").__class__("ticket_count_state", "SUM(ticket_row)", "ticket_fact", kind="SEMI_ADDITIVE", non_additive_by="customer_region", private=True)), "070", "METRIC_STATE_UNSUPPORTED"),
        (lambda m: m.with_("relationships", "ticket_fact_customer", m.get("relationships", "ticket_fact_customer").__class__("ticket_fact_customer", "ticket_fact", "customer", "t.customer_id = c.customer_id")), "074", "RELATIONSHIP_MAPPING_MISSING"),
        (lambda m: m.without("keys", "customer.pk").add_key("customer", "pk2", ["region"]), "074", "MISMATCHED_UNIQUE_KEY"),
        (lambda m: m.without("keys", "customer.pk"), "074", "RELATIONSHIP_TARGET_NOT_UNIQUE"),
        (lambda m: m.add_relationship("other", "ticket_fact", "customer", "t.ticket_id = c.customer_id", path_priority=200).add_mapping("other", "ticket_id", "customer_id"), "074", "RELATIONSHIP_PATH_AMBIGUOUS"),
    ],
)
def test_refusals(spark, change, code, reason):
    s = three_fact_session(spark)
    m = s.add(change(s.model("d1")))
    s.validate("d1")
    report = s.runs[-1]
    s.reports[m.fingerprint()] = report  # even an invalid model must not compile into a wrong plan
    if not report.matrix:
        report.matrix = {(x.upper(), "CUSTOMER_REGION"): {"valid": True} for x in m.metrics}
    out = s.compile(ask(["order_revenue", "ticket_count"]))
    assert (out.error_code, out.plan["reason_code"]) == (f"SEMANTIC_REQUEST_{code}", reason)


def test_strict_single_branch(spark, d1):
    assert table(d1, ["order_revenue"], proof_mode="STRICT_GRAIN")["North"] == (175.0,)
    s = three_fact_session(spark)
    r = s.model("d1").get("relationships", "order_fact_customer")
    s.add(s.model("d1").with_("relationships", r.name, r.__class__(r.name, r.from_entity, r.to_entity, r.condition)))
    assert s.validate("d1").codes() == ["031"]
    assert s.compile(ask(["order_revenue"], proof_mode="STRICT_GRAIN")).error_code == "SEMANTIC_REQUEST_072"
    assert s.compile(ask(["order_revenue"])).status == "OK"


def test_materialized_branches_equal_base(spark, d1):
    s = three_fact_session(spark)
    base = d1.query(ask(["order_revenue"]))
    s.relations.register("MART", "BY_REGION", base)
    s.relations.register("MART", "TICKETS_BY_REGION", d1.query(ask(["ticket_count"])))
    m = s.model("d1").register_materialization("orders_mv", "MART", "BY_REGION").register_materialization("tickets_mv", "MART", "TICKETS_BY_REGION")
    m = m.add_materialization_column("orders_mv", "DIMENSION", "customer_region", "customer_region").add_materialization_column("orders_mv", "METRIC", "order_revenue", "order_revenue", "SUM")
    m = m.add_materialization_column("tickets_mv", "DIMENSION", "customer_region", "customer_region").add_materialization_column("tickets_mv", "METRIC", "ticket_count_state", "ticket_count", "SUM")
    s.add(m)
    s.publish("d1")
    out = s.compile(ask(ALL))
    used = [b.get("materialization", {}).get("materialization") for b in out.plan["branches"]]
    assert used == ["orders_mv", None, None]  # the ticket leaf also has a filtered state, so it reads its base
    assert {"leaf": "TICKET_FACT", "materialization": "tickets_mv", "reason": "FILTERED_STATE_UNSUPPORTED"} in out.plan["materialization_notes"]
    assert table(s, ALL) == table(d1, ALL)
    assert s.compile(ask(["order_revenue", "ticket_count"])).plan["branches"][1]["materialization"]["materialization"] == "tickets_mv"
    assert table(s, ["order_revenue", "ticket_count"]) == table(d1, ["order_revenue", "ticket_count"])


def test_single_branch_navigation(spark, d1):
    s = three_fact_session(spark)
    s.relations.register("MART", "MV", d1.query(ask(["order_revenue"])))
    m = s.model("d1").register_materialization("mv", "MART", "MV").add_materialization_column("mv", "DIMENSION", "customer_region", "customer_region").add_materialization_column("mv", "METRIC", "order_revenue", "order_revenue", "SUM")
    s.add(m)
    s.publish("d1")
    plan = lambda **k: s.compile(ask(["order_revenue"], **k)).plan
    assert plan()["materialization"]["materialization"] == "mv"
    assert plan(dimensions=[])["materialization"]["rollup"]
    assert float(s.query({**ask(["order_revenue"]), "dimensions": []}).first()[0]) == 263.0
    assert plan(having=[{"field": "order_revenue", "op": ">", "value": 1}])["materialization"] is None
    for change, why in (
        (lambda m: m.set_materialization_status("mv", "INACTIVE"), "INACTIVE"),
        (lambda m: m.with_("materializations", "mv", m.get("materializations", "mv").__class__("mv", "MART", "MV", "SNAPSHOT", columns=m.get("materializations", "mv").columns)), "UNSUPPORTED_TYPE"),
        (lambda m: m.with_("materializations", "mv", m.get("materializations", "mv").__class__("mv", "MART", "MV", freshness="HOURLY", columns=m.get("materializations", "mv").columns)), "UNSUPPORTED_FRESHNESS_POLICY"),
        (lambda m: m.with_("materializations", "mv", m.get("materializations", "mv").__class__("mv", "MART", "MV", columns=m.get("materializations", "mv").columns[1:])), "MISSING_DIMENSION"),
        (lambda m: m.with_("materializations", "mv", m.get("materializations", "mv").__class__("mv", "MART", "MV", columns=m.get("materializations", "mv").columns[:1])), "MISSING_METRIC"),
    ):
        s.add(change(m))
        s.publish("d1")
        assert plan()["materialization"] is None and plan()["materialization_notes"] == [{"materialization": "mv", "reason": why}]


def test_graph():
    m = three_fact_model()
    g = Graph(m)
    assert g.shortest("order_fact", "customer").ok and not g.shortest("customer", "order_fact").ok
    assert g.shortest("customer", "order_fact").reason == "NO_SAFE_JOIN_PATH"
    assert g.strict("order_fact", "ticket_fact").reason == "ONE_TO_MANY_ATTRIBUTION_UNSUPPORTED"
    m = m.add_relationship("again", "order_fact", "customer", "o.order_id = c.customer_id")
    assert Graph(m).shortest("order_fact", "customer").reason == "AMBIGUOUS_RELATIONSHIP_PATH"
    m = m.with_("relationships", "again", m.get("relationships", "again").__class__("again", "order_fact", "customer", "o.order_id = c.customer_id", path_priority=1))
    proof = Graph(m).shortest("order_fact", "customer")
    assert not proof.ok and proof.reason == "AMBIGUOUS_RELATIONSHIP_PATH" and set(proof.candidates) == {"again", "order_fact_customer"}


def test_many_to_many_needs_policy(spark):
    s = three_fact_session(spark)
    r = s.model("d1").get("relationships", "order_fact_customer")
    many = r.__class__(r.name, r.from_entity, r.to_entity, r.condition, "MANY_TO_MANY", mappings=r.mappings)
    s.add(s.model("d1").with_("relationships", r.name, many))
    assert "010" in s.validate("d1").codes()


def test_one_leaf_metric_on_the_one_side_isnt_duplicated(spark, d1):
    m = three_fact_model().add_object("TICKETS", "ticket_fact").show("TICKETS", "DIMENSION", "customer_region")
    m = m.add_fact("customer", "customer_row", "c.customer_id", "DECIMAL(18,0)").add_metric("TICKETS", "customers", "COUNT(customer_row)", "customer", data_type="DECIMAL(18,0)", **TOLD)
    s = three_fact_session(spark)
    s.add(m)
    s.publish("d1")
    got = s.query({"model": "d1", "object": "TICKETS", "metrics": ["customers"], "dimensions": ["customer_region"]}).collect()
    assert {r[0]: r[1] for r in got} == {"North": 2, "South": 1, "West": 1, "East": 1}
    s.anchor = "root"
    s.cache.clear()
    got = s.query({"model": "d1", "object": "TICKETS", "metrics": ["customers"], "dimensions": ["customer_region"]}).collect()
    assert {r[0]: r[1] for r in got}["North"] == 3
    assert D(1) == 1
