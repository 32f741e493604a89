"""Fixture sessions: three facts on one customer, and several sources of one entity."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

from granary.demo import _links
from granary.model import Model
from granary.session import SemanticSession
from granary.validate import coverage_predicate

TOLD = {"description": "d", "format": "number"}


def three_fact_model() -> Model:
    m = Model("d1", "SEMANTIC_D1")
    for name, table, alias, key in (
        ("customer", "D1_CUSTOMERS", "c", "customer_id"),
        ("order_fact", "D1_ORDERS", "o", "order_id"),
        ("ticket_fact", "D1_TICKETS", "t", "ticket_id"),
        ("payment_fact", "D1_PAYMENTS", "p", "payment_id"),
    ):
        m = m.add_entity(name, "MART", table, alias, f"{alias}.{key}").add_key(name, "pk", [key])
    m = _links(m, [(f"{e}_customer", e, "customer", "customer_id", "customer_id") for e in ("order_fact", "ticket_fact", "payment_fact")])
    m = m.add_object("D1_METRICS", "order_fact").add_dimension("D1_METRICS", "customer", "customer_region", "c.region", "VARCHAR(32)")
    m = m.add_dimension(None, "ticket_fact", "ticket_priority", "t.priority", "VARCHAR(16)")
    m = m.add_fact("order_fact", "order_amount", "o.amount", "DECIMAL(18,2)").add_fact("ticket_fact", "ticket_row", "t.ticket_id", "DECIMAL(18,0)").add_fact("payment_fact", "payment_amount", "p.amount", "DECIMAL(18,2)")
    money, count = {"data_type": "DECIMAL(18,2)", **TOLD}, {"data_type": "DECIMAL(18,0)", **TOLD}
    m = m.add_metric("D1_METRICS", "order_revenue", "SUM(order_amount)", "order_fact", **money)
    m = m.add_metric(None, "ticket_count_state", "COUNT(ticket_row)", "ticket_fact", private=True, **count)
    m = m.add_metric(None, "urgent_state", "COUNT(ticket_row)", "ticket_fact", private=True, filter="ticket_priority = 'URGENT'", kind="FILTERED", **count)
    m = m.add_metric(None, "payment_state", "SUM(payment_amount)", "payment_fact", private=True, **money)
    derived = {"kind": "DERIVED", "metric_type": "NON_ADDITIVE"}
    m = m.add_metric("D1_METRICS", "ticket_count", "ticket_count_state + 0", "order_fact", **count, **derived)
    m = m.add_metric("D1_METRICS", "urgent_count", "urgent_state + 0", "order_fact", **count, **derived)
    m = m.add_metric("D1_METRICS", "payments", "payment_state + 0", "order_fact", **money, **derived)
    return m.add_metric("D1_METRICS", "revenue_per_ticket", "order_revenue / NULLIF(ticket_count_state, 0)", "order_fact", kind="RATIO", metric_type="NON_ADDITIVE", data_type="DECIMAL(18,6)", **TOLD)


def three_fact_session(spark) -> SemanticSession:
    s = SemanticSession(spark)

    def table(name, rows, schema):
        s.relations.register("MART", name, spark.createDataFrame(rows, schema))

    d = lambda x: None if x is None else D(x)
    table("D1_CUSTOMERS", [(d(k), r) for k, r in ((1, "North"), (2, "South"), (3, "West"), (4, "North"), (5, "East"))], "customer_id decimal(18,0), region string")
    orders = [(1, 1, 100), (2, 1, 50), (3, 2, 40), (4, 4, 25), (5, 999, 7), (6, None, 11), (7, 5, 30)]
    table("D1_ORDERS", [tuple(d(x) for x in r) for r in orders], "order_id decimal(18,0), customer_id decimal(18,0), amount decimal(18,2)")
    tickets = [(10, 1, "URGENT"), (11, 1, "NORMAL"), (12, 2, "URGENT"), (13, 4, "URGENT"), (14, 3, "NORMAL"), (15, 999, "URGENT"), (16, None, "NORMAL")]
    table("D1_TICKETS", [(d(a), d(b), c) for a, b, c in tickets], "ticket_id decimal(18,0), customer_id decimal(18,0), priority string")
    table("D1_PAYMENTS", [tuple(d(x) for x in r) for r in [(20, 1, 80), (21, 3, 60), (22, 4, 20), (23, 999, 5)]], "payment_id decimal(18,0), customer_id decimal(18,0), amount decimal(18,2)")
    s.add(three_fact_model())
    return s


def hot_cold_session(spark, cut="2026-01-01 00:00:00", predicate=None) -> SemanticSession:
    s = SemanticSession(spark)
    schema = "order_id decimal(18,0), order_ts timestamp_ntz, order_status string, amount decimal(18,2)"
    t = lambda y, m: datetime(y, m, 1)
    s.relations.register("MART", "ORDERS_COLD", spark.createDataFrame([(D(1), t(2025, 11), "CLOSED", D(10)), (D(2), t(2025, 12), "OPEN", D(20))], schema))
    s.relations.register("MART", "ORDERS_HOT", spark.createDataFrame([(D(3), t(2026, 1), "CLOSED", D(30)), (D(4), t(2026, 2), "OPEN", D(40))], schema))
    m = Model("f3", "SEMANTIC_F3").add_entity("orders", "MART", "ORDERS_COLD", "o", "o.order_id").add_key("orders", "pk", ["order_id"]).add_object("ORDERS", "orders")
    m = m.set_coverage("orders", "PRIMARY", predicate or coverage_predicate("o", "order_ts", None, cut), None, cut)
    m = m.add_representation("orders", "hot", "MART", "ORDERS_HOT", coverage=coverage_predicate("o", "order_ts", cut, None), valid_from=cut)
    both = [("PRIMARY", "o.order_status"), ("hot", "o.order_status")]
    m = m.add_dimension_with_bindings("ORDERS", "orders", "order_status", "o.order_status", "VARCHAR(20)", both)
    m = m.add_fact_with_bindings("orders", "amount", "o.amount", "DECIMAL(18,2)", [("PRIMARY", "o.amount"), ("hot", "o.amount")])
    m = m.add_metric("ORDERS", "revenue", "SUM(amount)", "orders", data_type="DECIMAL(18,2)", **TOLD)
    m = m.add_metric("ORDERS", "average", "AVG(amount)", "orders", data_type="DECIMAL(18,2)", metric_type="NON_ADDITIVE", **TOLD)
    s.add(m)
    return s


def reconcile_session(spark, strategy="COALESCE", crm_name="Bob", conflict=False) -> SemanticSession:
    s = SemanticSession(spark)
    s.relations.register("MART", "CUSTOMERS_MDM", spark.createDataFrame([(D(1), "Alice"), (D(2), None), (D(3), "Carol")], "customer_id decimal(18,0), customer_name string"))
    crm = [(D(1), "Alicia" if conflict else "Alice"), (D(2), crm_name), (D(3), "Carol")]
    s.relations.register("MART", "CUSTOMERS_CRM", spark.createDataFrame(crm, "customer_id decimal(18,0), display_name string"))
    m = Model("f4", "SEMANTIC_F4").add_entity("customer", "MART", "CUSTOMERS_MDM", "c", "c.customer_id").add_key("customer", "pk", ["customer_id"]).add_object("CUSTOMERS", "customer")
    m = m.add_representation("customer", "crm", "MART", "CUSTOMERS_CRM")
    m = m.add_dimension_with_bindings("CUSTOMERS", "customer", "customer_name", "c.customer_name", "VARCHAR(100)", [("PRIMARY", "c.customer_name"), ("crm", "c.display_name")])
    m = m.set_authority("customer", "PRIMARY", "AUTHORITATIVE").set_authority("customer", "crm", "SUPPLEMENTAL").set_fusion("customer", "DIMENSION", "customer_name", strategy)
    s.add(m)
    return s


def mapped_session(spark, xref=((1, "A-1"), (2, "A-2"), (3, "A-3"))) -> SemanticSession:
    s = reconcile_session(spark)
    s.relations.register("MART", "ACCOUNTS_CRM", spark.createDataFrame([("A-1", "Alice"), ("A-2", "Bob"), ("A-3", "Carol")], "account_id string, display_name string"))
    s.relations.register("MART", "CUSTOMER_XREF", spark.createDataFrame([(a, D(c)) for c, a in xref], "account_id string, customer_id decimal(18,0)"))
    m = s.model("f4").remove_representation("customer", "crm").add_representation("customer", "crm", "MART", "ACCOUNTS_CRM")
    m = m.add_identity("customer_identity", "customer", "DECIMAL(18,0)").add_identity_mapping("xref", "customer_identity", "MART", "CUSTOMER_XREF", "account_id", "customer_id")
    m = m.add_identity_binding("customer_identity", "PRIMARY", "c.customer_id").add_identity_binding("customer_identity", "crm", "c.account_id", "MAPPED", "xref")
    s.add(m)
    return s


def remap_session(spark) -> SemanticSession:
    s = SemanticSession(spark)
    s.relations.register("MART", "ORDERS", spark.createDataFrame([(D(101), D(1)), (D(102), D(2)), (D(103), D(2))], "order_id decimal(18,0), customer_id decimal(18,0)"))
    s.relations.register("MART", "CUSTOMERS_MDM", spark.createDataFrame([(D(1), "MDM-North"), (D(2), "MDM-West")], "customer_id decimal(18,0), region string"))
    s.relations.register("MART", "CUSTOMERS_DOC", spark.createDataFrame([(D(1), "North"), (D(2), "West")], "_cid decimal(10,0), area string"))
    m = Model("f51", "SEMANTIC_F51").add_entity("orders", "MART", "ORDERS", "o", "o.order_id").add_entity("customer", "MART", "CUSTOMERS_MDM", "c", "c.customer_id")
    m = m.add_key("orders", "pk", ["order_id"]).add_key("customer", "pk", ["customer_id"]).add_object("ORDERS", "orders")
    m = _links(m, [("order_customer", "orders", "customer", "customer_id", "customer_id")])
    m = m.add_representation("customer", "doc", "MART", "CUSTOMERS_DOC", priority=1)
    m = m.add_dimension("ORDERS", "customer", "region", "c.region", "VARCHAR(20)")
    m = m.add_binding("customer", "DIMENSION", "region", "PRIMARY", "c.region", "FALLBACK").add_binding("customer", "DIMENSION", "region", "doc", "c.area", "PREFER")
    m = m.add_identity("customer_identity", "customer", "DECIMAL(18,0)").add_identity_binding("customer_identity", "PRIMARY", "c.customer_id")
    m = m.add_identity_binding("customer_identity", "doc", 'CAST(c."_cid" AS DECIMAL(18,0))')
    m = m.add_fact("orders", "order_row", "o.order_id", "DECIMAL(18,0)").add_metric("ORDERS", "order_count", "COUNT(order_row)", "orders", data_type="DECIMAL(18,0)", **TOLD)
    s.add(m)
    return s
