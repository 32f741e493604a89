"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

A query's seconds are the least of three runs after one that warms up. Beside them stand the planner's milliseconds
and the ratio of the engine's time to that of the same query written by hand for ``spark.sql``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "revenue_by_customer_nation_top5",
    "order_month_revenue",
    "two_role_playing_nations",
    "case_dimension",
    "filters_conjoined",
    "ratio_avg_order_value",
    "count_distinct_customers",
    "multifact_orders_events_by_segment",
    "multifact_three_by_nation",
    "fusion_union_events",
    "fusion_coalesce_segment",
)
RUNS = 3


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from granary.demo import TPCH_TABLES, fusion_session, tpch_session
    from granary.queries import SQL, Q

    sessions = {"": tpch_session(spark, sf_dir), "union": fusion_session(spark, sf_dir, "union"), "coalesce": fusion_session(spark, sf_dir, "coalesce")}
    for t in TPCH_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def least(run) -> float:
        run()
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        return min(times)

    queries, planner, ratio = {}, {}, {}
    for name in HEADLINE:
        s = sessions["union" if "union" in name else "coalesce" if "coalesce" in name else ""]
        request = Q[name].request
        compiled = s.compile({**request, "client": "bench"})
        planner[name] = round(compiled.planner_ms, 1)
        queries[name] = round(least(lambda s=s, request=request: s.query(request).collect()), 4)
        ratio[name] = round(queries[name] / least(lambda name=name: spark.sql(SQL[name]).collect()), 2)
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": total, "unit": "sec", "queries": queries, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "planner_ms": planner, "ratio_to_hand_written": ratio}))
    spark.stop()


if __name__ == "__main__":
    main()
