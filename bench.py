"""Times the language's queries over $BENCH_SF_DIR and prints one JSON line.

A query's time is that of the faster of two runs, results counted by a no-op
writer so that every row and column is made.  Tables and links are declared once,
outside the times.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "point_lookup", "range_scan", "index_page", "membership", "filter_not_complement", "between_in_like", "arithmetic", "topn_multi_key", "distinct_values", "scalar_aggregate", "count_distinct",
    "group_having", "group_expression", "symmetric_aggregate", "raw_aggregate", "inner_join", "left_join", "right_join", "window_rank", "window_running", "window_after_limit", "in_subquery",
    "not_in_subquery", "exists_correlated", "not_exists_correlated", "union_distinct", "string_functions", "math_functions", "date_parts", "casts", "json_path", "json_group", "nested_projection",
    "scalar_link", "sql_group", "sql_join_raw",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewater.queries import CASES, SCALAR_LINK, engine

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared, found = engine(spark, sf_dir), {}
    texts = {name: (text, sql) for name, (text, sql, _) in CASES.items()} | {"scalar_link": (SCALAR_LINK[1], False)}
    for link in SCALAR_LINK[0]:
        shared.execute(link)
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            df = shared.dataframe(texts[name][0], sql=texts[name][1])
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        found[name] = round(best, 4)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
