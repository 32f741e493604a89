"""Queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.demo import fusion_session, materialized_session, tpch_session

Q: dict = {}
SQL: dict[str, str] = {}

_LINE = """lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
 LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey"""
_ORDER = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey"
_EVENT = "events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey"
_NET = "l.l_extendedprice * (1 - l.l_discount)"


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, so that the order of addition doesn't show."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def _add(name: str, obj: str, sql: str, make=tpch_session, digits: int = 2, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(make(spark, sf_dir).query({"model": "tpch", "object": obj, **request}), digits)

    run.request = {"model": "tpch", "object": obj, **request}
    Q[name], SQL[name] = run, sql


def _add_sql(name: str, text: str, sql: str, digits: int = 2) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(tpch_session(spark, sf_dir).sql(text), digits)

    Q[name], SQL[name] = run, sql


def _sum(x: str, name: str, digits: int = 2) -> str:
    return f"ROUND(SUM({x}), {digits}) AS {name}"


def _count(x: str, name: str) -> str:
    return f"CAST(COUNT({x}) AS BIGINT) AS {name}"


# -- joins, order, limit ---------------------------------------------------------------------------------------
_add(
    "revenue_by_customer_nation_top5",
    "SALES",
    f"SELECT cn.n_name AS customer_nation, {_sum(_NET, 'net_revenue_sum')} FROM {_LINE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    metrics=["net_revenue_sum"],
    dimensions=["customer_nation"],
    order_by=[{"field": "net_revenue_sum", "direction": "DESC"}],
    limit=5,
)
_add("facet_market_segments", "ORDERS", f"SELECT DISTINCT c.c_mktsegment AS market_segment FROM {_ORDER}", dimensions=["market_segment"])
_add("facet_two_dimensions", "ORDERS", f"SELECT DISTINCT o.o_orderstatus AS order_status, cr.r_name AS customer_region FROM {_ORDER}", dimensions=["order_status", "customer_region"])
_add("grand_total", "SALES", f"SELECT {_sum(_NET, 'net_revenue_sum')}, {_count('l.l_linenumber', 'line_count')} FROM lineitem l", metrics=["net_revenue_sum", "line_count"])
_add(
    "order_month_revenue",
    "ORDERS",
    f"SELECT CAST(date_trunc('month', o.o_orderdate) AS DATE) AS order_month, {_sum('o.o_totalprice', 'order_revenue')}, {_count('o.o_orderkey', 'order_count')} FROM orders o GROUP BY 1",
    metrics=["order_revenue", "order_count"],
    dimensions=["order_month"],
)
_add(
    "ship_month_trunc",
    "SALES",
    f"SELECT CAST(date_trunc('month', l.l_shipdate) AS DATE) AS ship_month, {_sum('l.l_quantity', 'quantity_sum')} FROM lineitem l GROUP BY 1",
    metrics=["quantity_sum"],
    dimensions=["ship_month"],
)
_add(
    "two_role_playing_nations",
    "SALES",
    f"SELECT cr.r_name AS customer_region, sn.n_name AS supplier_nation, {_count('l.l_linenumber', 'line_count')} FROM {_LINE} LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey GROUP BY 1, 2",
    metrics=["line_count"],
    dimensions=["customer_region", "supplier_nation"],
)
_add(
    "case_dimension",
    "SALES",
    f"SELECT CASE WHEN p.p_size < 20 THEN 'small' WHEN p.p_size < 40 THEN 'medium' ELSE 'large' END AS part_size_band, l.l_returnflag AS return_flag, {_sum('l.l_quantity', 'quantity_sum')} FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2",
    metrics=["quantity_sum"],
    dimensions=["part_size_band", "return_flag"],
)
_add(
    "synonyms_resolve",
    "SALES",
    f"SELECT cn.n_name AS customer_nation, {_sum(_NET, 'net_revenue_sum')} FROM {_LINE} GROUP BY 1",
    metrics=["revenue"],
    dimensions=["country"],
)
_add(
    "leaf_anchored_orders",
    "LINE_ORDERS",
    f"SELECT o.o_orderstatus AS order_status, {_sum('o.o_totalprice', 'order_revenue')} FROM orders o GROUP BY 1",
    metrics=["order_revenue"],
    dimensions=["order_status"],
)

# -- filters ---------------------------------------------------------------------------------------------------
for _name, _filter, _where in (
    ("filter_ops_eq_ci", {"field": "market_segment", "op": "=", "value": "building"}, "upper(c.c_mktsegment) = 'BUILDING'"),
    ("filter_ops_ne", {"field": "market_segment", "op": "<>", "value": "Building"}, "upper(c.c_mktsegment) <> 'BUILDING'"),
    ("filter_ops_in", {"field": "market_segment", "op": "IN", "value": ["building", "MACHINERY"]}, "c.c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("filter_ops_like", {"field": "customer_nation", "op": "LIKE", "value": "nation_1%"}, "upper(cn.n_name) LIKE 'NATION_1%'"),
    ("filter_ops_between_dates", {"field": "order_date", "op": "BETWEEN", "value": ["1996-01-01", "1996-12-31"]}, "CAST(o.o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    ("filter_ops_compare", {"field": "order_year", "op": ">=", "value": "1999"}, "year(o.o_orderdate) >= 1999"),
    ("filter_ops_text_range", {"field": "market_segment", "op": ">=", "value": "FURNITURE"}, "c.c_mktsegment >= 'FURNITURE'"),
    ("filter_ops_number", {"column": "customer_balance", "operator": "<", "value": 0}, "c.c_acctbal < 0"),
    ("filter_ops_is_not_null", {"field": "customer_nation", "op": "IS NOT NULL"}, "cn.n_name IS NOT NULL"),
    ("filter_ops_is_null", {"field": "customer_nation", "op": "IS NULL"}, "cn.n_name IS NULL"),
    ("filter_raw_rhs", {"field": "order_date", "op": "<", "value_sql": "ADD_MONTHS(TO_DATE('1996-03-31', 'YYYY-MM-DD'), 6)"}, "CAST(o.o_orderdate AS DATE) < DATE '1996-09-30'"),
):
    _add(
        _name,
        "ORDERS",
        f"SELECT o.o_orderpriority AS order_priority, {_sum('o.o_totalprice', 'order_revenue')}, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} WHERE {_where} GROUP BY 1",
        metrics=["order_revenue", "order_count"],
        dimensions=["order_priority"],
        filters=[_filter],
    )
_add(
    "filters_conjoined",
    "SALES",
    f"SELECT cr.r_name AS customer_region, {_sum(_NET, 'net_revenue_sum')} FROM {_LINE} WHERE l.l_returnflag = 'R' AND upper(c.c_mktsegment) IN ('BUILDING') AND year(o.o_orderdate) BETWEEN 1996 AND 1997 GROUP BY 1",
    metrics=["net_revenue_sum"],
    dimensions=["customer_region"],
    filters=[{"field": "return_flag", "value": "r"}, {"field": "market_segment", "op": "IN", "value": ["Building"]}, {"field": "order_year", "op": "between", "value": [1996, 1997]}],
)

# -- having ----------------------------------------------------------------------------------------------------
_add(
    "having_metric",
    "ORDERS",
    f"SELECT cn.n_name AS customer_nation, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1 HAVING COUNT(o.o_orderkey) > 600",
    metrics=["order_count"],
    dimensions=["customer_nation"],
    having=[{"field": "order_count", "op": ">", "value": 600}],
)
_add(
    "having_unselected_metric",
    "ORDERS",
    f"SELECT cn.n_name AS customer_nation, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1 HAVING SUM(o.o_totalprice) >= 150000000",
    metrics=["order_count"],
    dimensions=["customer_nation"],
    having=[{"field": "order_revenue", "op": ">=", "value": 150000000}],
)
_add(
    "having_between_derived",
    "ORDERS",
    f"SELECT o.o_orderpriority AS order_priority, {_sum('o.o_totalprice', 'order_revenue')} FROM orders o GROUP BY 1 HAVING SUM(o.o_totalprice) / COUNT(o.o_orderkey) BETWEEN 249000 AND 252000",
    metrics=["order_revenue"],
    dimensions=["order_priority"],
    having=[{"field": "avg_order_value", "op": "BETWEEN", "value": [249000, 252000]}],
)

# -- kinds of metrics ------------------------------------------------------------------------------------------
_add(
    "derived_discount_amount",
    "SALES",
    f"SELECT l.l_returnflag AS return_flag, ROUND(SUM({_NET}) + SUM(l.l_extendedprice * l.l_discount), 2) AS gross FROM lineitem l GROUP BY 1",
    metrics=["gross"],
    dimensions=["return_flag"],
)
_add(
    "ratio_of_derived",
    "SALES",
    f"SELECT l.l_linestatus AS line_status, ROUND(SUM(l.l_extendedprice * l.l_discount) / NULLIF(SUM({_NET}) + SUM(l.l_extendedprice * l.l_discount), 0), 6) AS discount_rate FROM lineitem l GROUP BY 1",
    digits=6,
    metrics=["discount_rate"],
    dimensions=["line_status"],
)
_add(
    "ratio_avg_order_value",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, ROUND(SUM(o.o_totalprice) / NULLIF(COUNT(o.o_orderkey), 0), 2) AS avg_order_value FROM {_ORDER} GROUP BY 1",
    metrics=["avg_order_value"],
    dimensions=["market_segment"],
)
_add(
    "ratio_of_aggregates",
    "SALES",
    f"SELECT l.l_returnflag AS return_flag, ROUND(SUM({_NET}) / NULLIF(SUM(l.l_quantity), 0), 2) AS avg_line_value FROM lineitem l GROUP BY 1",
    metrics=["avg_line_value"],
    dimensions=["return_flag"],
)
_add(
    "filtered_open_revenue",
    "ORDERS",
    f"SELECT cr.r_name AS customer_region, ROUND(SUM(CASE WHEN o.o_orderstatus = 'O' THEN o.o_totalprice ELSE 0 END), 2) AS open_revenue, CAST(COUNT(CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END) AS BIGINT) AS urgent_count FROM {_ORDER} GROUP BY 1",
    metrics=["open_revenue", "urgent_count"],
    dimensions=["customer_region"],
)
_add(
    "filtered_sum_without_match",
    "ORDERS",
    "SELECT o.o_orderstatus AS order_status, ROUND(SUM(CASE WHEN o.o_orderstatus = 'O' THEN o.o_totalprice ELSE 0 END), 2) AS open_revenue FROM orders o WHERE o.o_orderstatus = 'F' GROUP BY 1",
    metrics=["open_revenue"],
    dimensions=["order_status"],
    filters=[{"field": "order_status", "value": "F"}],
)
_add(
    "count_distinct_customers",
    "ORDERS",
    "SELECT o.o_orderstatus AS order_status, CAST(COUNT(DISTINCT o.o_custkey) AS BIGINT) AS active_customers FROM orders o GROUP BY 1",
    metrics=["active_customers"],
    dimensions=["order_status"],
)
_add(
    "avg_min_max",
    "ORDERS",
    "SELECT o.o_orderpriority AS order_priority, ROUND(AVG(o.o_totalprice), 2) AS avg_order_total, ROUND(MIN(o.o_totalprice), 2) AS min_order_total, ROUND(MAX(o.o_totalprice), 2) AS max_order_total FROM orders o GROUP BY 1",
    metrics=["avg_order_total", "min_order_total", "max_order_total"],
    dimensions=["order_priority"],
)

# -- semantic SQL ----------------------------------------------------------------------------------------------
_add_sql(
    "sql_groupby_inferred",
    "SELECT customer_region, order_count FROM SEMANTIC_TPCH.ORDERS",
    f"SELECT cr.r_name AS customer_region, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1",
)
_add_sql(
    "sql_groupby_all_measure",
    "SELECT o.order_status, MEASURE(order_revenue), agg(orders) FROM SEMANTIC_TPCH.ORDERS o WHERE market_segment = 'machinery' GROUP BY ALL",
    f"SELECT o.o_orderstatus AS order_status, {_sum('o.o_totalprice', 'order_revenue')}, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} WHERE c.c_mktsegment = 'MACHINERY' GROUP BY 1",
)
_add_sql(
    "sql_ordinals_top",
    "SELECT customer_nation AS n, order_revenue AS r FROM SEMANTIC_TPCH.ORDERS GROUP BY 1 ORDER BY 2 DESC, n LIMIT 7",
    f"SELECT cn.n_name AS customer_nation, {_sum('o.o_totalprice', 'order_revenue')} FROM {_ORDER} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
)
_add_sql(
    "sql_where_metric_routed",
    "SELECT customer_nation, order_count FROM SEMANTIC_TPCH.ORDERS WHERE order_count > 200 AND order_status = 'F' GROUP BY customer_nation",
    f"SELECT cn.n_name AS customer_nation, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} WHERE o.o_orderstatus = 'F' GROUP BY 1 HAVING COUNT(o.o_orderkey) > 200",
)
_add_sql(
    "sql_clauses_any_order",
    "SELECT order_priority, order_count FROM SEMANTIC_TPCH.ORDERS GROUP BY order_priority WHERE order_date BETWEEN '1997-01-01' AND '1997-06-30' ORDER BY order_priority",
    f"SELECT o.o_orderpriority AS order_priority, {_count('o.o_orderkey', 'order_count')} FROM orders o WHERE CAST(o.o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' GROUP BY 1",
)
_add_sql(
    "sql_select_star",
    "SELECT * FROM SEMANTIC_TPCH.ACTIVITY",
    f"SELECT cn.n_name AS customer_nation, cr.r_name AS customer_region, c.c_mktsegment AS market_segment, e.event_type AS event_type, CAST(e.ts AS DATE) AS event_day, {_count('e.event_id', 'event_count')}, {_sum('e.value', 'event_value_sum')} FROM {_EVENT} LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey GROUP BY 1, 2, 3, 4, 5",
)
_add_sql("sql_pass_through", "SELECT 1 AS one, 'x' AS letter", "SELECT 1 AS one, 'x' AS letter")

# -- several facts ---------------------------------------------------------------------------------------------
_O = f"(SELECT c.c_mktsegment AS k, cn.n_name AS n, SUM(o.o_totalprice) AS r, COUNT(o.o_orderkey) AS c, COUNT(CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END) AS u FROM {_ORDER} %s GROUP BY ALL)"
_E = f"(SELECT c.c_mktsegment AS k, cn.n_name AS n, COUNT(e.event_id) AS c, SUM(e.value) AS v, COUNT(CASE WHEN e.event_type = 'click' THEN e.event_id END) AS cl FROM {_EVENT} %s GROUP BY ALL)"
_L = f"(SELECT c.c_mktsegment AS k, cn.n_name AS n, SUM({_NET}) AS r FROM {_LINE} %s GROUP BY ALL)"


def _grouped(key: str, where: str = "") -> tuple[str, str, str]:
    return tuple(f"(SELECT {key} AS g, {', '.join(f'SUM({c}) AS {c}' for c in cols)} FROM {sub % where} x GROUP BY 1)" for sub, cols in ((_O, "rcu"), (_E, ("c", "v", "cl")), (_L, "r")))


_o, _e, _l = _grouped("k")
_add(
    "multifact_orders_events_by_segment",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS market_segment, ROUND(o.r, 2) AS order_revenue, CAST(COALESCE(e.c, 0) AS BIGINT) AS events FROM {_o} o FULL JOIN {_e} e ON o.g = e.g",
    metrics=["order_revenue", "events"],
    dimensions=["market_segment"],
)
_o, _e, _l = _grouped("n")
_add(
    "multifact_three_by_nation",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g, l.g) AS customer_nation, CAST(COALESCE(o.c, 0) AS BIGINT) AS order_count, ROUND(e.v, 2) AS event_value_total, ROUND(l.r, 2) AS line_revenue FROM {_o} o FULL JOIN {_e} e ON o.g = e.g FULL JOIN {_l} l ON l.g = o.g",
    metrics=["order_count", "event_value_total", "line_revenue"],
    dimensions=["customer_nation"],
)
_add(
    "multifact_ratio_events_per_order",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS customer_nation, ROUND(COALESCE(e.c, 0) / NULLIF(CAST(COALESCE(o.c, 0) AS DOUBLE), 0), 6) AS events_per_order FROM {_o} o FULL JOIN {_e} e ON o.g = e.g",
    digits=6,
    metrics=["events_per_order"],
    dimensions=["customer_nation"],
)
_add(
    "multifact_having",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS customer_nation, ROUND(o.r, 2) AS order_revenue FROM {_o} o FULL JOIN {_e} e ON o.g = e.g WHERE COALESCE(e.c, 0) > 300",
    metrics=["order_revenue"],
    dimensions=["customer_nation"],
    having=[{"field": "events", "op": ">", "value": 300}],
)
_add(
    "multifact_filtered_state",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS customer_nation, CAST(COALESCE(o.u, 0) AS BIGINT) AS urgent_count, CAST(COALESCE(e.cl, 0) AS BIGINT) AS clicks FROM {_o} o FULL JOIN {_e} e ON o.g = e.g",
    metrics=["urgent_count", "clicks"],
    dimensions=["customer_nation"],
)
_add(
    "multifact_grand_total",
    "CUSTOMER_360",
    "SELECT CAST((SELECT COUNT(*) FROM orders) AS BIGINT) AS order_count, CAST((SELECT COUNT(*) FROM events) AS BIGINT) AS events",
    metrics=["order_count", "events"],
)
_o, _e, _l = _grouped("n", "WHERE c.c_mktsegment = 'BUILDING'")
_add(
    "multifact_global_filter",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS customer_nation, ROUND(o.r, 2) AS order_revenue, CAST(COALESCE(e.c, 0) AS BIGINT) AS events FROM {_o} o FULL JOIN {_e} e ON o.g = e.g",
    metrics=["order_revenue", "events"],
    dimensions=["customer_nation"],
    filters=[{"field": "market_segment", "value": "building"}],
)
_add(
    "strict_grain_single_branch",
    "ORDERS",
    f"SELECT cr.r_name AS customer_region, {_sum('o.o_totalprice', 'order_revenue')} FROM {_ORDER} GROUP BY 1",
    metrics=["order_revenue"],
    dimensions=["customer_region"],
    proof_mode="STRICT_GRAIN",
)

# -- registered aggregates -------------------------------------------------------------------------------------
_add(
    "materialized_rollup",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, {_sum('o.o_totalprice', 'order_revenue')} FROM {_ORDER} GROUP BY 1",
    materialized_session,
    metrics=["order_revenue"],
    dimensions=["market_segment"],
)
_add(
    "materialized_exact",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, o.o_orderstatus AS order_status, {_sum('o.o_totalprice', 'order_revenue')}, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1, 2",
    materialized_session,
    metrics=["order_revenue", "order_count"],
    dimensions=["market_segment", "order_status"],
)
_add(
    "materialized_filtered",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} WHERE o.o_orderstatus = 'F' GROUP BY 1",
    materialized_session,
    metrics=["order_count"],
    dimensions=["market_segment"],
    filters=[{"field": "order_status", "value": "f"}],
)
_add(
    "materialized_fallback",
    "ORDERS",
    f"SELECT o.o_orderpriority AS order_priority, {_sum('o.o_totalprice', 'order_revenue')} FROM orders o GROUP BY 1",
    materialized_session,
    metrics=["order_revenue"],
    dimensions=["order_priority"],
)
_o, _e, _l = _grouped("k")
_add(
    "hybrid_branch_materialized",
    "CUSTOMER_360",
    f"SELECT COALESCE(l.g, e.g) AS market_segment, ROUND(l.r, 2) AS line_revenue, CAST(COALESCE(e.c, 0) AS BIGINT) AS events FROM {_l} l FULL JOIN {_e} e ON l.g = e.g",
    materialized_session,
    metrics=["line_revenue", "events"],
    dimensions=["market_segment"],
)


# -- fusion ----------------------------------------------------------------------------------------------------
def _fusion(kind: str):
    return lambda spark, sf_dir: fusion_session(spark, sf_dir, kind)


_add(
    "fusion_union_events",
    "ACTIVITY",
    "SELECT e.event_type AS event_type, CAST(COUNT(e.event_id) AS BIGINT) AS event_count, ROUND(SUM(e.value), 2) AS event_value_sum FROM events e GROUP BY 1",
    _fusion("union"),
    metrics=["event_count", "event_value_sum"],
    dimensions=["event_type"],
)
_add(
    "fusion_coalesce_segment",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1",
    _fusion("coalesce"),
    metrics=["order_count"],
    dimensions=["market_segment"],
)
_add(
    "fusion_reconcile_segment",
    "ORDERS",
    f"SELECT CASE WHEN c.c_custkey % 7 = 0 AND c.c_custkey % 11 = 0 THEN 'LEGACY' ELSE c.c_mktsegment END AS market_segment, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1",
    _fusion("reconcile"),
    metrics=["order_count"],
    dimensions=["market_segment"],
)
_add(
    "fusion_mapped_identity",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, {_sum('o.o_totalprice', 'order_revenue')} FROM {_ORDER} GROUP BY 1",
    _fusion("mapped"),
    metrics=["order_revenue"],
    dimensions=["market_segment"],
)
_add(
    "fusion_identity_remap",
    "ORDERS",
    f"SELECT lower(c.c_mktsegment) AS market_segment, {_count('o.o_orderkey', 'order_count')} FROM {_ORDER} GROUP BY 1",
    _fusion("remap"),
    metrics=["order_count"],
    dimensions=["market_segment"],
)
_add(
    "fusion_multifact_coalesced_dimension",
    "CUSTOMER_360",
    f"SELECT COALESCE(o.g, e.g) AS market_segment, CAST(COALESCE(o.c, 0) AS BIGINT) AS order_count, CAST(COALESCE(e.c, 0) AS BIGINT) AS events FROM {_o} o FULL JOIN {_e} e ON o.g = e.g",
    _fusion("coalesce"),
    metrics=["order_count", "events"],
    dimensions=["market_segment"],
)


# -- metadata --------------------------------------------------------------------------------------------------
def validator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tpch_session(spark, sf_dir)
    rows = [(r["metric"], r["dimension"], r["valid"]) for r in s.reports[s.model("tpch").fingerprint()].matrix.values() if r["metric"] in ("order_count", "event_count")]
    return spark.createDataFrame(rows, "metric string, dimension string, valid boolean")


Q["validator_matrix"] = validator_matrix
_REACH = {"order_count": "customer_nation customer_region market_segment customer_balance order_status order_priority order_date order_month order_year", "event_count": "customer_nation customer_region market_segment customer_balance event_type event_day"}
_ALL = "customer_nation customer_region market_segment customer_balance supplier_nation order_status order_priority order_date order_month order_year ship_month return_flag line_status part_brand part_size_band event_type event_day".split()
SQL["validator_matrix"] = "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{d}', {str(d in reach.split()).lower()})" for m, reach in _REACH.items() for d in _ALL) + ") t(metric, dimension, valid)"


LINES_VIEW = """
version: 1.1
source: warehouse.tpch.lineitem
joins:
  - name: item
    source: warehouse.tpch.part
    on: source.l_partkey = item.p_partkey
  - name: vendor
    source: warehouse.tpch.supplier
    on: source.l_suppkey = vendor.s_suppkey
    joins:
      - name: home
        source: warehouse.tpch.nation
        on: vendor.s_nationkey = home.n_nationkey
fields:
  - name: vendor_country
    expr: vendor.home.n_name
  - name: size_class
    expr: CASE WHEN item.p_size <= 10 THEN 'hand' WHEN item.p_size <= 30 THEN 'bench' ELSE 'floor' END
  - name: return_code
    expr: l_returnflag
measures:
  - name: units
    expr: SUM(l_quantity)
    synonyms: [pieces]
  - name: returned_units
    expr: SUM(l_quantity) FILTER (WHERE l_returnflag = 'R')
  - name: parts_sold
    expr: COUNT(DISTINCT l_partkey)
  - name: units_per_part
    expr: MEASURE(units) / MEASURE(parts_sold)
"""


def yaml_import_lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric view imported from YAML, published, and read with semantic SQL."""
    from granary.demo import TPCH_TABLES
    from granary.session import SemanticSession
    from granary.sources.metric_view import apply_metric_view

    s = SemanticSession(spark)
    s.relations.register_folder("tpch", sf_dir, TPCH_TABLES)
    apply_metric_view(s, LINES_VIEW, "lines_view", "SEMANTIC_VIEW", "LINES")
    return _rounded(s.sql("SELECT vendor_country, size_class, units, returned_units, parts_sold, units_per_part FROM SEMANTIC_VIEW.LINES"))


Q["yaml_import_lines_view"] = yaml_import_lines_view
SQL["yaml_import_lines_view"] = """SELECT n.n_name AS vendor_country, CASE WHEN p.p_size <= 10 THEN 'hand' WHEN p.p_size <= 30 THEN 'bench' ELSE 'floor' END AS size_class,
 ROUND(SUM(l.l_quantity), 2) AS units, ROUND(SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0 END), 2) AS returned_units, CAST(COUNT(DISTINCT l.l_partkey) AS BIGINT) AS parts_sold,
 ROUND(SUM(l.l_quantity) / COUNT(DISTINCT l.l_partkey), 2) AS units_per_part
 FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2"""


# -- joins of other kinds, functions ---------------------------------------------------------------------------
def _changed(change):
    """The TPC-H-like session with its model changed."""

    def make(spark: SparkSession, sf_dir: str):
        s = tpch_session(spark, sf_dir)
        s.add(change(s, s.model("tpch")))
        s.publish("tpch")
        return s

    return make


def _inner(s, m):
    import dataclasses

    rich = s.relations("TPCH", "customer").where("c_acctbal > 0")
    s.relations.register("TPCH", "customer", rich)
    return m.with_("relationships", "order_customer", dataclasses.replace(m.get("relationships", "order_customer"), join_type="INNER"))


_add(
    "inner_join_keeps_matches",
    "ORDERS",
    f"SELECT c.c_mktsegment AS market_segment, {_count('o.o_orderkey', 'order_count')}, {_sum('o.o_totalprice', 'order_revenue')} FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 GROUP BY 1",
    _changed(_inner),
    metrics=["order_count", "order_revenue"],
    dimensions=["market_segment"],
)
_PERIODS = [("early", "1970-01-01", "1994-07-01"), ("middle", "1994-07-01", "1996-07-01"), ("late", "1996-07-01", "2100-01-01")]


def _effective(s, m):
    """Orders joined with the period whose dates hold theirs: a join by inequalities."""
    table = s.spark.createDataFrame(_PERIODS, "label string, starts string, ends string").selectExpr("label", "DATE(starts) AS starts", "DATE(ends) AS ends")
    s.relations.register("TPCH", "periods", table)
    m = m.add_entity("period", "TPCH", "periods", "pd", "pd.label").add_relationship("order_period", "order_hdr", "period", "o.o_orderdate >= pd.starts AND o.o_orderdate < pd.ends")
    return m.add_dimension(None, "period", "period_label", "pd.label", "VARCHAR(10)").show("ORDERS", "DIMENSION", "period_label")


_add(
    "effective_dated_join",
    "ORDERS",
    f"SELECT pd.label AS period_label, {_count('o.o_orderkey', 'order_count')}, {_sum('o.o_totalprice', 'order_revenue')} FROM orders o LEFT JOIN (VALUES "
    + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in _PERIODS)
    + ") pd(label, starts, ends) ON o.o_orderdate >= pd.starts AND o.o_orderdate < pd.ends GROUP BY 1",
    _changed(_effective),
    metrics=["order_count", "order_revenue"],
    dimensions=["period_label"],
)


def _expression(text: str, kind: str):
    return _changed(lambda s, m: m.add_dimension(None, "order_hdr", "told", text, kind).show("ORDERS", "DIMENSION", "told"))


#: Scalar functions: name, the model's expression, its type, the same for DuckDB.
_FUNCTIONS = [
    ("abs_round", "ABS(ROUND(o.o_totalprice / 1000, 0) - 150)", "DOUBLE", "ABS(ROUND(o.o_totalprice / 1000, 0) - 150)"),
    ("ceil_floor", "CEIL(o.o_totalprice / 50000) * 100 + FLOOR(o.o_totalprice / 50000)", "BIGINT", "CAST(CEIL(o.o_totalprice / 50000) * 100 + FLOOR(o.o_totalprice / 50000) AS BIGINT)"),
    ("trunc_number", "TRUNC(o.o_totalprice / 100000, 1)", "DOUBLE", "CAST(TRUNC(o.o_totalprice / 100000 * 10) / 10 AS DOUBLE)"),
    ("day_month_year", "DAY(o.o_orderdate) + 100 * MONTH(o.o_orderdate) + 10000 * YEAR(o.o_orderdate)", "BIGINT", "day(o.o_orderdate) + 100 * month(o.o_orderdate) + 10000 * year(o.o_orderdate)"),
    ("extract_parts", "EXTRACT(YEAR FROM o.o_orderdate) * 100 + EXTRACT(MONTH FROM o.o_orderdate)", "BIGINT", "year(o.o_orderdate) * 100 + month(o.o_orderdate)"),
    ("to_char", "TO_CHAR(o.o_orderdate, 'YYYY-MM')", "VARCHAR(7)", "strftime(o.o_orderdate, '%Y-%m')"),
    ("substr_case", "LOWER(SUBSTR(o.o_orderpriority, 3, 4)) || UPPER(o.o_orderstatus)", "VARCHAR(8)", "lower(substr(o.o_orderpriority, 3, 4)) || upper(o.o_orderstatus)"),
    ("pad_replace", "LPAD(REPLACE(o.o_orderpriority, '-', ':'), 12, '*')", "VARCHAR(12)", "lpad(replace(o.o_orderpriority, '-', ':'), 12, '*')"),
    ("trim_concat", "CONCAT(LTRIM(RTRIM(TRIM(o.o_orderstatus))), '!')", "VARCHAR(3)", "concat(trim(o.o_orderstatus), '!')"),
    ("coalesce_nullif", "COALESCE(NULLIF(o.o_orderstatus, 'O'), 'open')", "VARCHAR(4)", "coalesce(nullif(o.o_orderstatus, 'O'), 'open')"),
    ("cast_text", "CAST(YEAR(o.o_orderdate) AS VARCHAR(4)) || '-' || o.o_orderstatus", "VARCHAR(6)", "CAST(year(o.o_orderdate) AS VARCHAR) || '-' || o.o_orderstatus"),
]
for _name, _text, _kind, _duck in _FUNCTIONS:
    _add(f"function_{_name}", "ORDERS", f"SELECT {_duck} AS told, {_count('o.o_orderkey', 'order_count')} FROM orders o GROUP BY 1", _expression(_text, _kind), digits=6, metrics=["order_count"], dimensions=["told"])


def _scored(s, m):
    s.relations.register_function("mart", "size_of", {"total": "DOUBLE", "step": "INTEGER"}, "VARCHAR(8)", "CASE WHEN total >= 10 * step THEN 'large' WHEN total >= step THEN 'medium' ELSE 'small' END")
    return m.add_dimension(None, "order_hdr", "told", "MART.SIZE_OF(o.o_totalprice, 20000)", "VARCHAR(8)").show("ORDERS", "DIMENSION", "told")


_add(
    "qualified_function",
    "ORDERS",
    f"SELECT CASE WHEN o.o_totalprice >= 200000 THEN 'large' WHEN o.o_totalprice >= 20000 THEN 'medium' ELSE 'small' END AS told, {_count('o.o_orderkey', 'order_count')} FROM orders o GROUP BY 1",
    _changed(_scored),
    metrics=["order_count"],
    dimensions=["told"],
)


# -- authoring and probes ----------------------------------------------------------------------------------------
def authored_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric made by ALTER SEMANTIC VIEW, then asked for."""
    s = tpch_session(spark, sf_dir)
    s.apply("ALTER SEMANTIC VIEW tpch.ORDERS ADD OR REPLACE METRIC mean_total AS AVG(order_total) ON ENTITY order_hdr RETURNS DOUBLE NON ADDITIVE")
    s.publish("tpch")
    return _rounded(s.query({"model": "tpch", "object": "ORDERS", "metrics": ["mean_total"], "dimensions": ["market_segment"]}))


Q["authored_metric"] = authored_metric
SQL["authored_metric"] = f"SELECT c.c_mktsegment AS market_segment, ROUND(AVG(o.o_totalprice), 2) AS mean_total FROM {_ORDER} GROUP BY 1"


def key_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which representations of orders, all of them, those of one status, and twice each, prove to have the same keys."""
    found = []
    for label, change in (("whole", lambda df: df), ("part", lambda df: df.where("o_orderstatus = 'O'")), ("twice", lambda df: df.union(df))):
        s = tpch_session(spark, sf_dir)
        s.relations.register("TPCH", "orders_again", change(s.relations("TPCH", "orders")))
        s.add(s.model("tpch").add_representation("order_hdr", "again", "TPCH", "orders_again"))
        report = s.validate("tpch")
        found.append((label, "037" not in report.codes(), "038" not in report.codes()))
    return spark.createDataFrame(found, "label string, keys_unique boolean, keys_equal boolean")


Q["key_probe"] = key_probe
SQL["key_probe"] = """WITH r AS (SELECT 'whole' AS label, o_orderkey AS k FROM orders UNION ALL SELECT 'part', o_orderkey FROM orders WHERE o_orderstatus = 'O'
 UNION ALL SELECT 'twice', o_orderkey FROM orders UNION ALL SELECT 'twice', o_orderkey FROM orders)
SELECT label, COUNT(*) = COUNT(DISTINCT k) AS keys_unique, COUNT(*) = (SELECT COUNT(*) FROM orders) AS keys_equal FROM r GROUP BY 1"""


def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.views import catalog_view

    s = tpch_session(spark, sf_dir)
    return catalog_view(s, "DIMENSIONS").select("dimension_name", "entity_name").where("entity_name IN ('customer', 'customer_nation')")


Q["catalog_fields"] = catalog_fields
SQL["catalog_fields"] = "SELECT * FROM (VALUES ('customer_nation', 'customer_nation'), ('market_segment', 'customer'), ('customer_balance', 'customer')) t(dimension_name, entity_name)"


def search_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from granary.services import search

    return search(tpch_session(spark, sf_dir), "what is our revenue", "tpch").select("field_name", "score").where("score >= 70").distinct()


Q["search_objects"] = search_objects
SQL["search_objects"] = "SELECT * FROM (VALUES ('net_revenue_sum', 95), ('net_revenue_sum', 70), ('order_revenue', 70), ('open_revenue', 70), ('line_revenue', 70), ('returned_revenue', 70)) t(field_name, score)"


def interchange_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model exported, imported again, and queried."""
    from granary.demo import TPCH_TABLES, tpch_model
    from granary.session import SemanticSession
    from granary.sources.interchange import export_model, import_model

    s = SemanticSession(spark)
    s.relations.register_folder("TPCH", sf_dir, TPCH_TABLES)
    s.add(import_model(export_model(tpch_model(), "lossless")[0])[0])
    s.publish("tpch")
    return _rounded(s.query({"model": "tpch", "object": "CUSTOMER_360", "metrics": ["order_revenue", "events"], "dimensions": ["market_segment"]}))


Q["interchange_round_trip"] = interchange_round_trip
SQL["interchange_round_trip"] = SQL["multifact_orders_events_by_segment"]


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
