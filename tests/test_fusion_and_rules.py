"""Several sources of one entity, and the validator's rules."""

import dataclasses
import re

import pytest

from granary.demo import sales_session
from granary.model import KeyMapping, Metric, Representation
from granary.validate import parse_coverage
from tests.fixtures import hot_cold_session, mapped_session, reconcile_session, remap_session


def test_hot_cold(spark):
    s = hot_cold_session(spark)
    assert s.publish("f3").status == "OK"
    ask = {"model": "f3", "object": "ORDERS", "metrics": ["revenue"], "dimensions": ["order_status"]}
    assert {r[0]: float(r[1]) for r in s.query(ask).collect()} == {"CLOSED": 40.0, "OPEN": 60.0}
    plan = s.compile(ask).plan
    assert [b["representation"] for b in plan["branches"]] == ["PRIMARY", "hot"] and plan["kind"] == "MULTI_BRANCH"
    assert s.compile({**ask, "metrics": ["average"]}).error_code == "SEMANTIC_REQUEST_070"


def test_partitions_are_united_before_one_aggregation(spark):
    s = hot_cold_session(spark)
    s.publish("f3")
    ask = {"model": "f3", "object": "ORDERS", "metrics": ["revenue"], "dimensions": ["order_status"]}
    plan = s.physical(ask, "simple")
    assert plan.count("Union") == 1 and plan.count("Exchange") == 1
    facets = s.query({"model": "f3", "object": "ORDERS", "metrics": [], "dimensions": ["order_status"]})
    assert sorted(r[0] for r in facets.collect()) == ["CLOSED", "OPEN"]  # statuses of both partitions
    total = s.query({**ask, "dimensions": []}).collect()
    assert [float(r[0]) for r in total] == [100.0]
    text = s.compile(ask).generated_sql
    for (schema, name), df in list(s.relations._known.items()):
        df.createOrReplaceTempView(f"{schema}__{name}".lower())
        text = re.sub(rf"`{schema}`\.`{name}`", f"{schema}__{name}".lower(), text, flags=re.IGNORECASE)
    assert {r[0]: float(r[1]) for r in spark.sql(text).collect()} == {"CLOSED": 40.0, "OPEN": 60.0}


@pytest.mark.parametrize(
    "predicate",
    ["o.order_ts < TIMESTAMP '2026-02-01 00:00:00'", "o.order_ts <= TIMESTAMP '2026-01-01 00:00:00'", "o.order_ts < TIMESTAMP '2026-01-01 00:00:00' OR 1 = 1", "x.order_ts < TIMESTAMP '2026-01-01 00:00:00'"],
)
def test_wrong_coverage(spark, predicate):
    assert "042" in hot_cold_session(spark, predicate=predicate).validate("f3").codes()


def test_coverage_rules(spark):
    s = hot_cold_session(spark)
    m = s.model("f3")
    s.add(m.set_coverage("orders", "hot", "o.order_ts >= TIMESTAMP '2026-02-01 00:00:00'", "2026-02-01", None))
    assert "042" in s.validate("f3").codes()
    s.add(m.remove_binding("FACT", "amount", "hot"))
    assert "052" in s.validate("f3").codes()
    s.add(m.set_fusion("orders", "DIMENSION", "order_status", "COALESCE"))
    assert "044" in s.validate("f3").codes()
    s.add(dataclasses.replace(m, metrics={}, objects={}).add_object("ORDERS", "orders"))
    assert "043" not in s.validate("f3").codes()


def test_parse_coverage():
    assert parse_coverage("o.ts >= TIMESTAMP '2026-01-01' AND o.ts < DATE '2026-02-01'", "o") == ("ts", "2026-01-01 00:00:00", "2026-02-01 00:00:00")
    assert parse_coverage("o.ts >= 5", "o") is None


@pytest.mark.parametrize("strategy", ["COALESCE", "RECONCILE"])
def test_reconcile(spark, strategy):
    s = reconcile_session(spark, strategy)
    assert s.publish("f4").ok
    df = s.query({"model": "f4", "object": "CUSTOMERS", "dimensions": ["customer_name"], "order_by": ["customer_name"]})
    assert [r[0] for r in df.collect()] == ["Alice", "Bob", "Carol"]


def test_conflicts(spark):
    assert reconcile_session(spark, "COALESCE", conflict=True).validate("f4").codes() == ["045"]
    s = reconcile_session(spark, "RECONCILE", conflict=True)
    assert s.validate("f4").codes() == ["046"] and s.runs[-1].status == "WARNING"
    assert "Alice" in [r[0] for r in s.query({"model": "f4", "object": "CUSTOMERS", "dimensions": ["customer_name"]}).collect()]


def test_mapped_identity(spark):
    s = mapped_session(spark)
    assert s.publish("f4").status == "OK"
    df = s.query({"model": "f4", "object": "CUSTOMERS", "dimensions": ["customer_name"], "order_by": ["customer_name"]})
    assert [r[0] for r in df.collect()] == ["Alice", "Bob", "Carol"]


@pytest.mark.parametrize("xref", [((1, "A-1"), (2, "A-2")), ((1, "A-1"), (1, "A-2"), (3, "A-3"))])
def test_bad_mapping(spark, xref):
    assert "049" in mapped_session(spark, xref).validate("f4").codes()


def test_uncertified_mapping(spark):
    s = mapped_session(spark)
    m = s.model("f4")
    s.add(m.with_("mappings", "xref", dataclasses.replace(m.get("mappings", "xref"), status="DRAFT")))
    assert "048" in s.validate("f4").codes()


def test_identity_remap(spark):
    s = remap_session(spark)
    assert s.publish("f51").ok, s.runs[-1].issues
    out = s.compile({"model": "f51", "object": "ORDERS", "metrics": ["order_count"], "dimensions": ["region"]})
    assert {r[0]: r[1] for r in s.frame(out).collect()} == {"North": 1, "West": 2}
    assert out.plan["remaps"][0]["representation"] == "doc" and "CAST(c.`_cid` AS DECIMAL(18, 0))" in out.plan["branches"][0]["joins"][0]["condition"]
    m = s.model("f51")
    s.add(m.without("identity_bindings", "customer_identity.doc"))
    assert "050" in s.validate("f51", probes=False).codes()
    out = s.compile({"model": "f51", "object": "ORDERS", "metrics": ["order_count"], "dimensions": ["region"]})
    assert {r[0] for r in s.frame(out).collect()} == {"MDM-North", "MDM-West"}


def test_key_probes(spark):
    s = reconcile_session(spark)
    crm = s.relations("MART", "CUSTOMERS_CRM")
    s.relations.register("MART", "CUSTOMERS_CRM", crm.union(crm.limit(1)))
    assert "037" in s.validate("f4").codes()
    s.relations.register("MART", "CUSTOMERS_CRM", crm.limit(2))
    assert "038" in s.validate("f4").codes()
    s.probe_timeout = None
    assert s.validate("f4").status == "PRECONDITION"


# -- rules over the sales model --------------------------------------------------------------------------------
def _metric(m, name, **more):
    return m.with_("metrics", name, dataclasses.replace(m.get("metrics", name), **more))


def _relationship(m, **more):
    return m.with_("relationships", "line_order", dataclasses.replace(m.get("relationships", "line_order"), **more))


def _dimension(m, **more):
    return m.with_("dimensions", "order_status", dataclasses.replace(m.get("dimensions", "order_status"), **more))


RULES = {
    "001": lambda m: m.with_("entities", "product", dataclasses.replace(m.get("entities", "product"), object="NOPE")),
    "003": lambda m: m.with_("entities", "product", dataclasses.replace(m.get("entities", "product"), alias="o")),
    "004": lambda m: m.add_object("X", "nowhere"),
    "005": lambda m: m.show("SALES", "METRIC", "nothing"),
    "006": lambda m: _relationship(m, to_entity="nowhere"),
    "007": lambda m: _relationship(m, condition="x.order_id = o.order_id"),
    "008": lambda m: _relationship(m, cardinality="SOME"),
    "009": lambda m: _relationship(m, join_type="FULL"),
    "010": lambda m: _relationship(m, cardinality="MANY_TO_MANY"),
    "011": lambda m: _metric(m, "gross_margin", expression="total_revenue - nothing"),
    "012": lambda m: _metric(m, "total_revenue", expression="gross_margin + 1"),
    "013": lambda m: _dimension(m, expression="c.order_status"),
    "014": lambda m: _metric(m, "total_cost", base_entity="nowhere"),
    "016": lambda m: _dimension(m, expression="REGEXP_REPLACE(o.order_status, 'a', 'b')"),
    "017": lambda m: _dimension(m, expression="o.nothing"),
    "020": lambda m: _metric(m, "total_cost", description=None),
    "021": lambda m: m.add_synonym("METRIC", "total_cost", "sales"),
    "022": lambda m: _metric(m, "total_cost", format=None),
    "023": lambda m: m.add_verified_query("q", "SALES", "?", '{"metrics": ["nothing"]}'),
    "024": lambda m: m.add_instruction("PLANET", "x", "GENERAL", "text"),
    "025": lambda m: m.add_instruction("MODEL", "x", "RUMOUR", "text"),
    "026": lambda m: m.add_extension("METRIC", "nothing", "v", "{}"),
    "027": lambda m: m.add_extension("METRIC", "total_cost", "v", "{"),
    "028": lambda m: m.add_key("nowhere", "k", ["a"]),
    "029": lambda m: m.add_key("order", "k", ["nothing"], "UNIQUE"),
    "030": lambda m: m.add_object("O", "order").show("O", "METRIC", "total_revenue").show("O", "DIMENSION", "customer_region").add_fact("order", "order_row", "o.order_id", "DECIMAL(18,0)").add_metric("O", "orders", "COUNT(order_row)", "order", description="d", format="n", data_type="DECIMAL(18,0)").show("O", "DIMENSION", "product_category"),
    "031": lambda m: _relationship(m, mappings=()),
    "032": lambda m: _relationship(m, mappings=(KeyMapping("nothing", "order_id"),)),
    "033": lambda m: _relationship(m, mappings=(KeyMapping("order_id", "customer_id"),)),
    "034": lambda m: m.with_("entities", "product", dataclasses.replace(m.get("entities", "product"), alias="order")),
    "035": lambda m: m.with_("representations", "product.other", Representation("other", "product", "MART", "PRODUCTS", "PRIMARY")),
    "036": lambda m: m.with_("representations", "product.other", Representation("other", "product", "MART", "NOPE")),
    "039": lambda m: m.add_binding("product", "DIMENSION", "product_category", "nothing", "p.category"),
    "040": lambda m: m.add_binding("product", "DIMENSION", "product_category", "PRIMARY", "p.nothing"),
    "044": lambda m: m.set_authority("product", "PRIMARY", "SOMETIMES"),
    "047": lambda m: m.add_identity("i", "product"),
    "051": lambda m: _relationship(m, condition="ol.order_id = o.order_status"),
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_rules(spark, rule):
    s = sales_session(spark)
    s.add(RULES[rule](s.model("sales")))
    assert rule in s.validate("sales").codes()


def test_qualified_functions_are_tolerated(spark):
    s = sales_session(spark)
    s.add(_dimension(s.model("sales"), expression="MART.SCORE(o.order_status)"))
    assert s.validate("sales").ok


def test_metric_record_is_immutable():
    with pytest.raises(dataclasses.FrozenInstanceError):
        Metric("a", "b").name = "c"
