"""Demonstration models: the sales star of the goldens, and one over TPC-H-like tables."""

from __future__ import annotations

import dataclasses
from datetime import date
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.model import Model
from granary.session import SemanticSession
from granary.validate import coverage_predicate


def _links(model: Model, links: list[tuple]) -> Model:
    """MANY_TO_ONE relationships on one column each: (name, from, to, from column, to column)."""
    for name, a, b, x, y in links:
        left, right = model.get("entities", a).alias, model.get("entities", b).alias
        model = model.add_relationship(name, a, b, f"{left}.{x} = {right}.{y}").add_mapping(name, x, y)
    return model


# -- sales -----------------------------------------------------------------------------------------------------
def sales_model() -> Model:
    m = Model("sales", "SEMANTIC_SALES", "Sales by order line")
    m = m.add_entity("order_line", "MART", "ORDER_LINES", "ol", "CAST(ol.order_id AS VARCHAR(36)) || '-' || CAST(ol.line_id AS VARCHAR(36))", "One row per order line")
    m = m.add_entity("order", "MART", "ORDERS", "o", "o.order_id", "One row per order")
    m = m.add_entity("customer", "MART", "CUSTOMERS", "c", "c.customer_id", "One row per customer")
    m = m.add_entity("product", "MART", "PRODUCTS", "p", "p.product_id", "One row per product")
    m = m.add_key("order_line", "pk", ["order_id", "line_id"]).add_key("order", "pk", ["order_id"]).add_key("customer", "pk", ["customer_id"]).add_key("product", "pk", ["product_id"])
    m = _links(
        m,
        [
            ("line_order", "order_line", "order", "order_id", "order_id"),
            ("line_product", "order_line", "product", "product_id", "product_id"),
            ("order_customer", "order", "customer", "customer_id", "customer_id"),
        ],
    )
    m = m.add_object("SALES", "order_line", "Sales by order line")
    m = m.add_dimension("SALES", "customer", "customer_region", "c.region", "VARCHAR(100)", description="Region of the customer")
    m = m.add_dimension("SALES", "order", "order_month", "DATE_TRUNC('month', o.order_date)", "DATE", is_time=True)
    m = m.add_dimension("SALES", "order", "order_status", "o.order_status", "VARCHAR(32)")
    m = m.add_dimension("SALES", "product", "product_category", "p.category", "VARCHAR(100)")
    m = m.add_fact("order_line", "net_revenue", "ol.quantity * ol.net_unit_price", "DECIMAL(18,2)").add_fact("order_line", "net_cost", "ol.quantity * ol.unit_cost", "DECIMAL(18,2)").add_fact("order_line", "quantity", "ol.quantity", "DECIMAL(18,0)")
    told = {"data_type": "DECIMAL(18,2)", "format": "currency", "certified": True}
    m = m.add_metric("SALES", "total_revenue", "SUM(net_revenue)", "order_line", description="Net revenue", **told)
    m = m.add_metric("SALES", "total_cost", "SUM(net_cost)", "order_line", description="Net cost", **told)
    m = m.add_metric("SALES", "gross_margin", "total_revenue - total_cost", "order_line", description="Revenue less cost", kind="DERIVED", metric_type="NON_ADDITIVE", **told)
    m = m.add_metric("SALES", "gross_margin_pct", "gross_margin / NULLIF(total_revenue, 0)", "order_line", description="Margin as a share of revenue", kind="RATIO", metric_type="NON_ADDITIVE", data_type="DECIMAL(18,6)", format="percent")
    m = m.add_metric("SALES", "completed_revenue", "SUM(net_revenue)", "order_line", filter="order_status = 'COMPLETE'", kind="FILTERED", description="Revenue of complete orders", **told)
    return m.add_synonym("METRIC", "total_revenue", "revenue").add_synonym("METRIC", "total_revenue", "sales").add_synonym("DIMENSION", "customer_region", "region")


def sales_session(spark: SparkSession) -> SemanticSession:
    s = SemanticSession(spark)

    def table(name: str, rows: list[tuple], schema: str) -> None:
        s.relations.register("MART", name, spark.createDataFrame(rows, schema))

    d = Decimal
    table("CUSTOMERS", [(d(1), "Acme Retail", "North"), (d(2), "Bright Market", "South"), (d(3), "Cobalt Stores", "West"), (d(4), "Delta Wholesale", "North")], "customer_id decimal(18,0), customer_name string, region string")
    table("PRODUCTS", [(d(10), "Road Bike", "Bikes"), (d(11), "Helmet", "Accessories"), (d(12), "Floor Pump", "Accessories"), (d(13), "Touring Bike", "Bikes")], "product_id decimal(18,0), product_name string, category string")
    table("ORDERS", [(d(1000), d(1), date(2026, 1, 5), "COMPLETE"), (d(1001), d(2), date(2026, 1, 20), "COMPLETE"), (d(1002), d(3), date(2026, 2, 2), "CANCELLED"), (d(1003), d(4), date(2026, 2, 12), "COMPLETE"), (d(1004), d(1), date(2026, 3, 3), "COMPLETE")], "order_id decimal(18,0), customer_id decimal(18,0), order_date date, order_status string")
    lines = [(1000, 1, 10, 1, 1200, 800), (1000, 2, 11, 2, 80, 40), (1001, 1, 12, 3, 45, 20), (1002, 1, 13, 1, 1500, 1000), (1003, 1, 10, 2, 1100, 780), (1003, 2, 11, 1, 75, 40), (1004, 1, 12, 1, 0, 0)]
    table("ORDER_LINES", [tuple(d(x) for x in r) for r in lines], "order_id decimal(18,0), line_id decimal(18,0), product_id decimal(18,0), quantity decimal(18,0), net_unit_price decimal(18,2), unit_cost decimal(18,2)")
    s.add(sales_model())
    return s


# -- TPC-H-like tables -----------------------------------------------------------------------------------------
def tpch_model() -> Model:
    m = Model("tpch", "SEMANTIC_TPCH", "Orders, lines, events")
    for name, table, alias, key in (
        ("line", "lineitem", "l", None),
        ("order_hdr", "orders", "o", "o_orderkey"),
        ("customer", "customer", "c", "c_custkey"),
        ("customer_nation", "nation", "cn", "n_nationkey"),
        ("customer_region", "region", "cr", "r_regionkey"),
        ("supplier", "supplier", "s", "s_suppkey"),
        ("supplier_nation", "nation", "sn", "n_nationkey"),
        ("part", "part", "p", "p_partkey"),
        ("event", "events", "e", "event_id"),
    ):
        m = m.add_entity(name, "TPCH", table, alias, f"{alias}.{key}" if key else None)
        m = m.add_key(name, "pk", [key]) if key else m
    m = _links(
        m,
        [
            ("line_order", "line", "order_hdr", "l_orderkey", "o_orderkey"),
            ("line_part", "line", "part", "l_partkey", "p_partkey"),
            ("line_supplier", "line", "supplier", "l_suppkey", "s_suppkey"),
            ("order_customer", "order_hdr", "customer", "o_custkey", "c_custkey"),
            ("customer_nation_rel", "customer", "customer_nation", "c_nationkey", "n_nationkey"),
            ("customer_region_rel", "customer_nation", "customer_region", "n_regionkey", "r_regionkey"),
            ("supplier_nation_rel", "supplier", "supplier_nation", "s_nationkey", "n_nationkey"),
            ("event_customer", "event", "customer", "user_id", "c_custkey"),
        ],
    )
    for name, root in (("SALES", "line"), ("ORDERS", "order_hdr"), ("ACTIVITY", "event"), ("CUSTOMER_360", "order_hdr"), ("LINE_ORDERS", "line")):
        m = m.add_object(name, root)
    dims = [
        ("customer_nation", "customer_nation", "cn.n_name", "VARCHAR(25)"),
        ("customer_region", "customer_region", "cr.r_name", "VARCHAR(25)"),
        ("market_segment", "customer", "c.c_mktsegment", "VARCHAR(10)"),
        ("customer_balance", "customer", "c.c_acctbal", "DOUBLE"),
        ("supplier_nation", "supplier_nation", "sn.n_name", "VARCHAR(25)"),
        ("order_status", "order_hdr", "o.o_orderstatus", "VARCHAR(1)"),
        ("order_priority", "order_hdr", "o.o_orderpriority", "VARCHAR(15)"),
        ("order_date", "order_hdr", "CAST(o.o_orderdate AS DATE)", "DATE"),
        ("order_month", "order_hdr", "DATE_TRUNC('month', o.o_orderdate)", "DATE"),
        ("order_year", "order_hdr", "YEAR(o.o_orderdate)", "INTEGER"),
        ("ship_month", "line", "TRUNC(l.l_shipdate, 'MM')", "DATE"),
        ("return_flag", "line", "l.l_returnflag", "VARCHAR(1)"),
        ("line_status", "line", "l.l_linestatus", "VARCHAR(1)"),
        ("part_brand", "part", "p.p_brand", "VARCHAR(10)"),
        ("part_size_band", "part", "CASE WHEN p.p_size < 20 THEN 'small' WHEN p.p_size < 40 THEN 'medium' ELSE 'large' END", "VARCHAR(6)"),
        ("event_type", "event", "e.event_type", "VARCHAR(20)"),
        ("event_day", "event", "CAST(e.ts AS DATE)", "DATE"),
    ]
    shown = {
        "SALES": "customer_nation customer_region market_segment customer_balance supplier_nation order_status order_priority order_date order_month order_year ship_month return_flag line_status part_brand part_size_band".split(),
        "ORDERS": "customer_nation customer_region market_segment customer_balance order_status order_priority order_date order_month order_year".split(),
        "ACTIVITY": "customer_nation customer_region market_segment event_type event_day".split(),
        "CUSTOMER_360": "customer_nation customer_region market_segment".split(),
        "LINE_ORDERS": "customer_nation order_status".split(),
    }
    for name, entity, expression, kind in dims:
        m = m.add_dimension(None, entity, name, expression, kind)
    for obj, names in shown.items():
        for n in names:
            m = m.show(obj, "DIMENSION", n)
    for entity, name, expression, kind in (
        ("line", "net_revenue", "l.l_extendedprice * (1 - l.l_discount)", "DOUBLE"),
        ("line", "discount_amount", "l.l_extendedprice * l.l_discount", "DOUBLE"),
        ("line", "quantity", "l.l_quantity", "DOUBLE"),
        ("line", "line_row", "l.l_linenumber", "BIGINT"),
        ("order_hdr", "order_total", "o.o_totalprice", "DOUBLE"),
        ("order_hdr", "order_row", "o.o_orderkey", "BIGINT"),
        ("order_hdr", "order_customer_key", "o.o_custkey", "BIGINT"),
        ("event", "event_row", "e.event_id", "BIGINT"),
        ("event", "event_value", "e.value", "DOUBLE"),
    ):
        m = m.add_fact(entity, name, expression, kind)
    money = {"data_type": "DOUBLE", "format": "currency", "description": "An amount"}
    count = {"data_type": "BIGINT", "format": "integer", "description": "A count"}
    share = {"data_type": "DOUBLE", "format": "number", "description": "A ratio", "kind": "RATIO", "metric_type": "NON_ADDITIVE"}
    derived = {"kind": "DERIVED", "metric_type": "NON_ADDITIVE"}
    m = m.add_metric("SALES", "net_revenue_sum", "SUM(net_revenue)", "line", **money)
    m = m.add_metric("SALES", "discount_sum", "SUM(discount_amount)", "line", **money)
    m = m.add_metric("SALES", "gross", "net_revenue_sum + discount_sum", "line", **money, **derived)
    m = m.add_metric("SALES", "discount_rate", "discount_sum / NULLIF(gross, 0)", "line", **share)
    m = m.add_metric("SALES", "quantity_sum", "SUM(quantity)", "line", **{**money, "format": "number"})
    m = m.add_metric("SALES", "line_count", "COUNT(line_row)", "line", **count)
    m = m.add_metric("SALES", "returned_revenue", "SUM(net_revenue)", "line", filter="return_flag = 'R'", kind="FILTERED", **money)
    m = m.add_metric("SALES", "avg_line_value", "SUM(net_revenue) / NULLIF(SUM(quantity), 0)", "line", **share)
    m = m.add_metric("ORDERS", "order_revenue", "SUM(order_total)", "order_hdr", **money)
    m = m.add_metric("ORDERS", "order_count", "COUNT(order_row)", "order_hdr", **count)
    m = m.add_metric("ORDERS", "avg_order_value", "order_revenue / NULLIF(order_count, 0)", "order_hdr", **share)
    m = m.add_metric("ORDERS", "open_revenue", "SUM(order_total)", "order_hdr", filter="order_status = 'O'", kind="FILTERED", **money)
    m = m.add_metric("ORDERS", "urgent_count", "COUNT(order_row)", "order_hdr", filter="order_priority = '1-URGENT'", kind="FILTERED", **count)
    m = m.add_metric("ORDERS", "active_customers", "COUNT(DISTINCT order_customer_key)", "order_hdr", kind="DISTINCT", metric_type="NON_ADDITIVE", **count)
    for f in ("AVG", "MIN", "MAX"):
        m = m.add_metric("ORDERS", f"{f.lower()}_order_total", f"{f}(order_total)", "order_hdr", metric_type="NON_ADDITIVE", **money)
    # Metrics of the one side of the root: aggregated at their own grain, not once for each line.
    m = m.show("LINE_ORDERS", "METRIC", "order_revenue").show("LINE_ORDERS", "METRIC", "order_count").show("LINE_ORDERS", "METRIC", "net_revenue_sum")
    m = m.add_metric("ACTIVITY", "event_count", "COUNT(event_row)", "event", **count)
    m = m.add_metric("ACTIVITY", "event_value_sum", "SUM(event_value)", "event", **money)
    # Facts that the root can't reach stay private states; public wrappers on the root expose them.
    m = m.add_metric(None, "event_count_state", "COUNT(event_row)", "event", private=True, **count)
    m = m.add_metric(None, "event_value_state", "SUM(event_value)", "event", private=True, **money)
    m = m.add_metric(None, "line_revenue_state", "SUM(net_revenue)", "line", private=True, **money)
    m = m.add_metric(None, "click_state", "COUNT(event_row)", "event", filter="event_type = 'click'", private=True, **count)
    for n in ("order_revenue", "order_count", "avg_order_value", "urgent_count"):
        m = m.show("CUSTOMER_360", "METRIC", n)
    m = m.add_metric("CUSTOMER_360", "events", "event_count_state + 0", "order_hdr", **count, **derived)
    m = m.add_metric("CUSTOMER_360", "event_value_total", "event_value_state + 0", "order_hdr", **money, **derived)
    m = m.add_metric("CUSTOMER_360", "line_revenue", "line_revenue_state + 0", "order_hdr", **money, **derived)
    m = m.add_metric("CUSTOMER_360", "clicks", "click_state + 0", "order_hdr", **count, **derived)
    m = m.add_metric("CUSTOMER_360", "events_per_order", "event_count_state / NULLIF(order_count, 0)", "order_hdr", **share)
    for kind, name, synonym in (("METRIC", "net_revenue_sum", "revenue"), ("DIMENSION", "customer_nation", "country"), ("METRIC", "order_count", "orders")):
        m = m.add_synonym(kind, name, synonym)
    return m


TPCH_TABLES = "region nation customer supplier part orders lineitem events".split()


def tpch_session(spark: SparkSession, sf_dir: str, publish: bool = True) -> SemanticSession:
    s = SemanticSession(spark)
    s.relations.register_folder("TPCH", sf_dir, TPCH_TABLES)
    s.add(tpch_model())
    if publish:
        s.publish("tpch")
    return s


def fusion_session(spark: SparkSession, sf_dir: str, kind: str) -> SemanticSession:
    """The TPC-H-like model with several sources of one entity: union, coalesce, reconcile, mapped or remap."""
    s = SemanticSession(spark)
    s.relations.register_folder("TPCH", sf_dir, TPCH_TABLES)
    m, customer, events = tpch_model(), s.relations("TPCH", "customer"), s.relations("TPCH", "events")
    if kind == "union":
        cut = "2024-01-16 00:00:00"
        s.relations.register("TPCH", "events_cold", events.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")))
        s.relations.register("TPCH", "events_hot", events.where(F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).withColumnRenamed("value", "amount"))
        m = m.with_("entities", "event", dataclasses.replace(m.get("entities", "event"), object="events_cold"))
        m = m.with_("representations", "event.PRIMARY", dataclasses.replace(m.get("representations", "event.PRIMARY"), object="events_cold"))
        m = m.set_coverage("event", "PRIMARY", coverage_predicate("e", "ts", None, cut), None, cut)
        m = m.add_representation("event", "hot", "TPCH", "events_hot", coverage=coverage_predicate("e", "ts", cut, None), valid_from=cut)
        for name in ("event_row", "event_value"):
            m = m.add_binding("event", "FACT", name, "PRIMARY", m.get("facts", name).expression)
            m = m.add_binding("event", "FACT", name, "hot", m.get("facts", name).expression.replace("value", "amount") if name == "event_value" else m.get("facts", name).expression)
        for name in ("event_type", "event_day"):
            for r in ("PRIMARY", "hot"):
                m = m.add_binding("event", "DIMENSION", name, r, m.get("dimensions", name).expression)
    elif kind in ("coalesce", "reconcile"):
        odd = F.col("c_custkey") % 7 == 0
        s.relations.register("TPCH", "customer", customer.withColumn("c_mktsegment", F.when(~odd, F.col("c_mktsegment"))))
        crm = customer.select(F.col("c_custkey"), F.col("c_mktsegment").alias("segment_name"))
        if kind == "reconcile":
            crm = crm.withColumn("segment_name", F.when(F.col("c_custkey") % 11 == 0, F.lit("LEGACY")).otherwise(F.col("segment_name")))
        s.relations.register("TPCH", "customer_crm", crm)
        m = m.add_representation("customer", "crm", "TPCH", "customer_crm")
        m = m.add_binding("customer", "DIMENSION", "market_segment", "PRIMARY", "c.c_mktsegment").add_binding("customer", "DIMENSION", "market_segment", "crm", "c.segment_name")
        m = m.set_authority("customer", "PRIMARY", "AUTHORITATIVE").set_authority("customer", "crm", "SUPPLEMENTAL")
        m = m.set_fusion("customer", "DIMENSION", "market_segment", kind.upper())
    elif kind == "mapped":
        account = F.concat(F.lit("A-"), F.col("c_custkey").cast("string"))
        odd = F.col("c_custkey") % 7 == 0
        s.relations.register("TPCH", "customer", customer.withColumn("c_mktsegment", F.when(~odd, F.col("c_mktsegment"))))
        s.relations.register("TPCH", "accounts", customer.select(account.alias("account_id"), F.col("c_mktsegment").alias("segment_name")))
        s.relations.register("TPCH", "account_xref", customer.select(account.alias("account_id"), F.col("c_custkey").alias("customer_id")))
        m = m.add_representation("customer", "crm", "TPCH", "accounts")
        m = m.add_binding("customer", "DIMENSION", "market_segment", "PRIMARY", "c.c_mktsegment").add_binding("customer", "DIMENSION", "market_segment", "crm", "c.segment_name")
        m = m.set_authority("customer", "PRIMARY", "AUTHORITATIVE").set_authority("customer", "crm", "SUPPLEMENTAL").set_fusion("customer", "DIMENSION", "market_segment", "COALESCE")
        m = m.add_identity("customer_identity", "customer", "BIGINT").add_identity_mapping("account_map", "customer_identity", "TPCH", "account_xref", "account_id", "customer_id")
        m = m.add_identity_binding("customer_identity", "PRIMARY", "c.c_custkey").add_identity_binding("customer_identity", "crm", "c.account_id", "MAPPED", "account_map")
    elif kind == "remap":
        s.relations.register("TPCH", "customer_doc", customer.select(F.col("c_custkey").cast("string").alias("_id"), F.upper("c_mktsegment").alias("segment"), "c_nationkey"))
        m = m.add_representation("customer", "doc", "TPCH", "customer_doc", priority=1)
        m = m.add_binding("customer", "DIMENSION", "market_segment", "PRIMARY", "c.c_mktsegment", "FALLBACK").add_binding("customer", "DIMENSION", "market_segment", "doc", "LOWER(c.segment)", "PREFER")
        m = m.add_identity("customer_identity", "customer", "BIGINT").add_identity_binding("customer_identity", "PRIMARY", "c.c_custkey")
        m = m.add_identity_binding("customer_identity", "doc", 'CAST(c."_id" AS BIGINT)')
    s.add(m)
    s.publish("tpch")
    return s


_STORED: dict[tuple[str, str, str], str] = {}


def materialized_session(spark: SparkSession, sf_dir: str) -> SemanticSession:
    """The TPC-H-like model with registered aggregates."""
    s = tpch_session(spark, sf_dir)
    by_segment = s.query({"model": "tpch", "object": "ORDERS", "metrics": ["order_revenue", "order_count"], "dimensions": ["market_segment", "order_status"]})
    events = s.query({"model": "tpch", "object": "ACTIVITY", "metrics": ["event_count", "event_value_sum"], "dimensions": ["market_segment"]})
    for name, df in (("mv_orders", by_segment), ("mv_events", events)):  # stored once for each application and input
        key = spark.sparkContext.applicationId, sf_dir, name
        if key in _STORED:
            s.relations.register_files("TPCH", name, _STORED[key])
        else:
            _STORED[key] = s.relations.store("TPCH", name, df)
    m = s.model("tpch").register_materialization("mv_orders", "TPCH", "mv_orders").register_materialization("mv_events", "TPCH", "mv_events")
    for kind, name, policy in (("DIMENSION", "market_segment", "DIRECT"), ("DIMENSION", "order_status", "DIRECT"), ("METRIC", "order_revenue", "SUM"), ("METRIC", "order_count", "SUM")):
        m = m.add_materialization_column("mv_orders", kind, name, name, policy)
    m = m.add_materialization_column("mv_events", "DIMENSION", "market_segment", "market_segment", "DIRECT")
    for name, column in (("event_count", "event_count"), ("event_value_sum", "event_value_sum"), ("event_count_state", "event_count"), ("event_value_state", "event_value_sum")):
        m = m.add_materialization_column("mv_events", "METRIC", name, column, "SUM")
    s.add(m)
    s.publish("tpch")
    return s
