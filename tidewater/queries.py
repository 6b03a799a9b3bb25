"""Queries over the driver's tables, each with DuckDB SQL that spells out the language's rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.engine import Engine

#: What identifies a row of each table.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "events": ("event_id",),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with the folder's tables, read by Spark when a query needs them."""
    e = Engine(spark)
    for name, key in KEYS.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        e.register(name, df, key, ("props",) if name == "events" else ())
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # keys that are missing in some rows
    e.register("orders_n", orders.withColumn("k", F.nullif(F.col("o_custkey") % 7, F.lit(0))).withColumn("flag", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1)), ("o_orderkey",))
    e.register("customer_n", customer.withColumn("k", F.nullif(F.col("c_custkey") % 5, F.lit(0))), ("c_custkey",))
    return e


#: name: (text, SQL dialect or not, oracle)
CASES: dict[str, tuple[str, bool, str]] = {
    "scan_project": ("nation { n_nationkey: .n_nationkey, n_name: .n_name }", False, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
    "point_lookup": ("orders filter .o_orderkey = 42 { .o_orderkey, .o_custkey, .o_totalprice }", False, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42"),
    "range_scan": ("orders filter .o_orderkey >= 100 and .o_orderkey < 200 { .o_orderkey, .o_orderstatus }", False, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "index_page": ("orders filter .o_orderkey >= 500 order .o_orderkey limit 25 { .o_orderkey, .o_custkey }", False, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 25"),
    "membership": ("orders filter .o_orderkey in (1, 5, 9, 1000, 99999999) { .o_orderkey }", False, "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 9, 1000, 99999999)"),
    "filter_not_complement": ("orders_n filter not (.k > 3) { .o_orderkey, .k }", False, "SELECT o_orderkey, k FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) WHERE NOT coalesce(k > 3, false)"),
    "filter_not_equal": ("orders_n filter .k != 3 { .o_orderkey, .k }", False, "SELECT o_orderkey, k FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) WHERE k <> 3"),
    "not_in_list": ("orders_n filter .k not in (1, 2, null) { .o_orderkey }", False, "SELECT o_orderkey FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (1, 2)"),
    "or_bare_bool": ("orders_n filter .flag or .k > 5 { .o_orderkey }", False, "SELECT o_orderkey FROM (SELECT *, nullif(o_custkey % 7, 0) AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END AS flag FROM orders) WHERE flag IS NOT NULL AND (flag OR coalesce(k > 5, false))"),
    "null_tests": ("orders_n filter .k is null or not exists .flag { .o_orderkey, d: .k ?? -1 }", False, "SELECT o_orderkey, coalesce(k, -1) AS d FROM (SELECT *, nullif(o_custkey % 7, 0) AS k, o_orderkey % 3 = 0 AS noflag FROM orders) WHERE k IS NULL OR noflag"),
    "between_in_like": ("orders filter .o_totalprice between 1000 and 50000 and .o_orderpriority like \"%-%\" and .o_orderstatus in (\"O\", \"F\") and .o_orderpriority not like \"1%\" { .o_orderkey, .o_orderpriority }", False, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority LIKE '%-%' AND o_orderstatus IN ('O', 'F') AND o_orderpriority NOT LIKE '1%'"),
    "arithmetic": ("orders { .o_orderkey, q: .o_custkey / 7, m: .o_custkey * 3 - .o_orderkey + 1, neg: (0 - .o_custkey) / 7, f: .o_custkey / 4.0 }", False, "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey * 3 - o_orderkey + 1 AS m, -(o_custkey // 7) AS neg, o_custkey / 4.0::DOUBLE AS f FROM orders"),
    "case_when": ("orders { .o_orderkey, band: case when .o_totalprice > 200000 then \"high\" when .o_totalprice > 100000 then \"mid\" else \"low\" end }", False, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders"),
    "topn_multi_key": ("lineitem filter .l_quantity > 30 order .l_extendedprice desc limit 10 { .l_orderkey, .l_extendedprice }", False, "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 30 ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10"),
    "offset_nulls_last": ("orders_n order .k desc, .o_orderkey limit 50 offset 3 { .o_orderkey, .k }", False, "SELECT o_orderkey, k FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 3"),
    "distinct_values": ("orders distinct { .o_orderstatus, .o_orderpriority }", False, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "distinct_ordered": ("orders distinct order .o_totalprice desc limit 3 { .o_orderpriority }", False, "SELECT o_orderpriority FROM (SELECT o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY 1) ORDER BY m DESC LIMIT 3"),
    "scalar_aggregate": ("avg(lineitem filter .l_returnflag = \"R\" { .l_quantity })", False, "SELECT avg(l_quantity) AS avg FROM lineitem WHERE l_returnflag = 'R'"),
    "count_distinct": ("count(distinct orders { .o_custkey })", False, "SELECT count(DISTINCT o_custkey) AS count FROM orders"),
    "group_having": ("lineitem group .l_returnflag, .l_linestatus having count(*) > 10 { flag: .l_returnflag, status: .l_linestatus, n: count(*), q: sum(.l_quantity), top: max(.l_extendedprice), low: min(.l_linenumber), parts: count(distinct .l_partkey) }", False, "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS q, max(l_extendedprice) AS top, min(l_linenumber)::BIGINT AS low, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10"),
    "group_expression": ("orders group .o_custkey / 100 order .o_custkey / 100 { bucket: .o_custkey / 100, n: count(*), s: sum(.o_orderkey) }", False, "SELECT o_custkey // 100 AS bucket, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY 1"),
    "group_null_key": ("orders_n group .k { .k, n: count(*), present: count(.k) }", False, "SELECT k, count(*) AS n, count(k) AS present FROM (SELECT nullif(o_custkey % 7, 0) AS k FROM orders) GROUP BY 1"),
    "symmetric_aggregate": ("nation as n join customer as c on c.c_nationkey = n.n_nationkey join orders as o on o.o_custkey = c.c_custkey group n.n_name { nation: n.n_name, customers: count(c.c_custkey), keys: sum(c.c_custkey), orders: count(o.o_orderkey), joined: count(*) }", False, "SELECT n_name AS nation, count(DISTINCT c_custkey) AS customers, sum(DISTINCT c_custkey)::BIGINT AS keys, count(o_orderkey) AS orders, count(*) AS joined FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "raw_aggregate": ("customer as c join orders as o on o.o_custkey = c.c_custkey group c.c_mktsegment { segment: c.c_mktsegment, keys: sum(raw c.c_custkey), n: count(raw c.c_custkey) }", False, "SELECT c_mktsegment AS segment, sum(c_custkey)::BIGINT AS keys, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "symmetric_scalar": ("count(customer as c join orders as o on o.o_custkey = c.c_custkey { c.c_custkey })", False, "SELECT count(DISTINCT c_custkey) AS count FROM customer JOIN orders ON o_custkey = c_custkey"),
    "inner_join": ("customer as c join orders as o on o.o_custkey = c.c_custkey filter o.o_totalprice > 100000 and c.c_mktsegment = \"BUILDING\" { k: o.o_orderkey, name: c.c_name }", False, "SELECT o_orderkey AS k, c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_mktsegment = 'BUILDING'"),
    "left_join": ("customer as c left join orders as o on o.o_custkey = c.c_custkey and o.o_totalprice > 300000 { c: c.c_custkey, o: o.o_orderkey }", False, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "right_join": ("orders as o right join customer as c on o.o_custkey = c.c_custkey and o.o_orderstatus = \"P\" { c: c.c_custkey, o: o.o_orderkey }", False, "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"),
    "cross_join": ("region as r cross join nation as n { r: r.r_name, n: n.n_name }", False, "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation"),
    # the whole table's joins, aggregated: their rows grow with the square of the customers
    "null_key_join": ("customer_n as a join customer_n as b on a.k = b.k group a.k { k: a.k, n: count(*), a: sum(raw a.c_custkey), b: sum(raw b.c_custkey) }", False, "SELECT a.k AS k, count(*) AS n, sum(a.c_custkey)::BIGINT AS a, sum(b.c_custkey)::BIGINT AS b FROM (SELECT c_custkey, nullif(c_custkey % 5, 0) AS k FROM customer) a JOIN (SELECT c_custkey, nullif(c_custkey % 5, 0) AS k FROM customer) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY 1"),
    "theta_join": ("customer_n as a join customer_n as b on a.k < b.k group a.k { k: a.k, n: count(*), a: sum(raw a.c_custkey), b: sum(raw b.c_custkey) }", False, "SELECT a.k AS k, count(*) AS n, sum(a.c_custkey)::BIGINT AS a, sum(b.c_custkey)::BIGINT AS b FROM (SELECT c_custkey, nullif(c_custkey % 5, 0) AS k FROM customer) a JOIN (SELECT c_custkey, nullif(c_custkey % 5, 0) AS k FROM customer) b ON (a.k IS NULL AND b.k IS NOT NULL) OR coalesce(a.k < b.k, false) GROUP BY 1"),
    "window_rank": ("orders { .o_orderkey, rn: row_number() over (partition .o_custkey order .o_totalprice desc), r: rank() over (partition .o_custkey order .o_orderpriority), d: dense_rank() over (partition .o_custkey order .o_orderpriority) }", False, "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders"),
    "window_running": ("orders { .o_orderkey, run: sum(.o_orderkey) over (partition .o_custkey order .o_orderpriority), n: count(*) over (partition .o_custkey), top: max(.o_totalprice) over (partition .o_custkey) }", False, "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS run, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders"),
    "window_after_limit": ("orders order .o_totalprice desc limit 20 { .o_orderkey, rn: row_number() over (order .o_orderkey) }", False, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)"),
    "in_subquery": ("customer filter .c_custkey in (orders filter .o_totalprice > 300000 { .o_custkey }) { .c_custkey }", False, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "not_in_subquery": ("orders_n filter .k not in (customer_n filter .c_acctbal > 9990 { .k }) { .o_orderkey }", False, "SELECT o_orderkey FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey % 5 FROM customer WHERE c_acctbal > 9990 AND c_custkey % 5 <> 0)"),
    "not_not_in_subquery": ("orders_n filter not (.k not in (customer_n filter .c_acctbal > 9990 { .k })) { .o_orderkey }", False, "SELECT o_orderkey FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders) WHERE k IS NULL OR k IN (SELECT c_custkey % 5 FROM customer WHERE c_acctbal > 9990 AND c_custkey % 5 <> 0)"),
    "in_correlated": ("nation as n filter n.n_nationkey in (customer as c filter c.c_nationkey = n.n_nationkey and c.c_acctbal > 9900 { c.c_nationkey }) { n.n_name }", False, "SELECT n_name FROM nation n WHERE n_nationkey IN (SELECT c_nationkey FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9900)"),
    "exists_correlated_page": ("customer as c filter exists (orders as o filter o.o_custkey = c.c_custkey order o.o_totalprice desc limit 1 offset 9) { c.c_custkey }", False, "SELECT o_custkey AS c_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) >= 10"),
    "exists_inequality": ("nation as n filter exists (customer as c filter c.c_nationkey = n.n_nationkey and c.c_custkey < n.n_regionkey * 20) or n.n_nationkey = 7 { n.n_name }", False, "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey < n.n_regionkey * 20) OR n_nationkey = 7"),
    "subqueries_anywhere": ("customer filter (.c_custkey in (orders filter .o_totalprice > 300000 { .o_custkey })) = true and not (.c_acctbal < 0 or .c_custkey in (orders filter .o_orderstatus = \"P\" { .o_custkey })) { .c_custkey }", False, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND NOT (c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))"),
    "scope_rules": ("nation as n filter exists (customer as c filter .c_nationkey = .n_nationkey and .c_acctbal > 9900) { .n_name }", False, "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)"),
    "exists_correlated": ("customer as c filter exists (orders as o filter o.o_custkey = c.c_custkey and o.o_totalprice > 300000) { c.c_custkey }", False, "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"),
    "not_exists_correlated": ("customer as c filter not exists (orders as o filter o.o_custkey = c.c_custkey and o.o_orderstatus = \"P\") or c.c_custkey = 1 { c.c_custkey }", False, "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') OR c_custkey = 1"),
    "exists_plain": ("region filter exists (nation filter .n_nationkey = 3) { .r_name }", False, "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)"),
    "union_distinct": ("nation { k: .n_regionkey } union region { k: .r_regionkey }", False, "SELECT n_regionkey::BIGINT AS k FROM nation UNION SELECT r_regionkey::BIGINT FROM region"),
    "union_all": ("nation { k: .n_regionkey } union all region { k: .r_regionkey }", False, "SELECT n_regionkey::BIGINT AS k FROM nation UNION ALL SELECT r_regionkey::BIGINT FROM region"),
    "string_functions": ("customer { .c_custkey, u: upper(.c_mktsegment), l: lower(.c_name), n: length(.c_name), s: substring(.c_name, 0, 5), t: trim(concat(\"  \", .c_mktsegment, \" \")), c: concat(.c_name, \"/\", .c_custkey) }", False, "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l, length(c_name) AS n, substring(c_name, 1, 5) AS s, c_mktsegment AS t, c_name || '/' || c_custkey AS c FROM customer"),
    "math_functions": ("customer { .c_custkey, a: abs(.c_acctbal), f: floor(.c_acctbal), c: ceil(.c_acctbal), q: sqrt(.c_custkey * .c_custkey), p: pow(.c_custkey, 2), i: round(.c_acctbal) }", False, "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_custkey::DOUBLE AS q, c_custkey * c_custkey AS p, round(c_acctbal) AS i FROM customer"),
    "date_parts": ("events { .event_id, y: extract(\"year\", .ts), m: extract(\"month\", .ts), d: extract(\"day\", .ts), h: extract(\"hour\", .ts), e: extract(\"epoch\", .ts) }", False, "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, epoch_us(ts) // 1000000 AS e FROM events"),
    "date_arithmetic": ("events { .event_id, later: cast(date_add(.ts, 3, \"hours\"), \"int\"), days: date_diff(.ts, 1600000000000000, \"days\") }", False, "SELECT event_id, epoch_us(ts) + 10800000000 AS later, trunc((epoch_us(ts) - 1600000000000000) / 86400000000.0)::BIGINT AS days FROM events"),
    "casts": ("orders { .o_orderkey, s: cast(.o_custkey, \"str\"), f: cast(.o_custkey, \"float\"), i: cast(.o_totalprice, \"int\"), bad: cast(.o_orderstatus, \"int\"), back: cast(cast(.o_orderkey, \"str\"), \"int\") }", False, "SELECT o_orderkey, o_custkey::VARCHAR AS s, o_custkey::DOUBLE AS f, trunc(o_totalprice)::BIGINT AS i, NULL::BIGINT AS bad, o_orderkey AS back FROM orders"),
    "json_path": ("events filter .props->k > 50 { .event_id, k: cast(.props->k, \"int\"), t: json_type(.props->k), gone: .props->nothing->0 }", False, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, 'int' AS t, NULL::VARCHAR AS gone FROM events WHERE json_extract(props, '$.k')::BIGINT > 50"),
    "json_group": ("events group .props->k { k: .props->k, n: count(*) }", False, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "nested_projection": ("customer as c { c.c_custkey, orders: orders as o filter o.o_custkey = c.c_custkey and o.o_totalprice > 200000 order o.o_totalprice desc limit 2 { o.o_orderkey, status: o.o_orderstatus } }", False, "SELECT c_custkey, coalesce(j, '[]') AS orders FROM customer LEFT JOIN (SELECT o_custkey, '[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' ORDER BY rn) || ']' AS j FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice > 200000) WHERE rn <= 2 GROUP BY 1) ON o_custkey = c_custkey"),
    "nested_two_levels": ("region as r { r.r_name, nations: nation as n filter n.n_regionkey = r.r_regionkey order n.n_nationkey { n.n_name, suppliers: supplier as s filter s.s_nationkey = n.n_nationkey order s.s_suppkey limit 2 { s.s_suppkey } } }", False, "SELECT r_name, coalesce(j, '[]') AS nations FROM region LEFT JOIN (SELECT n_regionkey, '[' || string_agg('{\"n_name\":\"' || n_name || '\",\"suppliers\":' || coalesce(k, '[]') || '}', ',' ORDER BY n_nationkey) || ']' AS j FROM nation LEFT JOIN (SELECT s_nationkey, '[' || string_agg('{\"s_suppkey\":' || s_suppkey || '}', ',' ORDER BY s_suppkey) || ']' AS k FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) WHERE rn <= 2 GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey"),
    "nested_kinds": ("region as r { r.r_name, kinds: nation as n filter n.n_regionkey = r.r_regionkey order n.n_nationkey desc { f: n.n_nationkey * 1.0, b: n.n_nationkey > 5, s: n.n_name, z: cast(n.n_name, \"int\"), when: cast(n.n_nationkey, \"datetime\") } }", False, "SELECT r_name, coalesce(j, '[]') AS kinds FROM region LEFT JOIN (SELECT n_regionkey, '[' || string_agg('{\"b\":' || (n_nationkey > 5) || ',\"f\":' || n_nationkey || '.0,\"s\":\"' || n_name || '\",\"when\":\"' || n_nationkey || '\",\"z\":null}', ',' ORDER BY n_nationkey DESC) || ']' AS j FROM nation GROUP BY 1) ON n_regionkey = r_regionkey"),
    "json_point": ("events filter .props->k = 7 { .event_id }", False, "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT = 7"),
    "json_order": ("events order .props->k desc limit 40 { .event_id, k: cast(.props->k, \"int\") }", False, "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events ORDER BY k DESC NULLS LAST, event_id LIMIT 40"),
    "json_text": ("events { .event_id, t: json_text(.props->k), d: json_type(.props) }", False, "SELECT event_id, json_extract_string(props, '$.k') AS t, 'object' AS d FROM events"),
    "output_names": ("orders { .o_orderkey, .o_orderkey, .o_custkey + 1, upper(.o_orderstatus) }", False, "SELECT o_orderkey, o_orderkey AS o_orderkey_1, o_custkey + 1 AS \".o_custkey + 1\", upper(o_orderstatus) AS \"upper(.o_orderstatus)\" FROM orders"),
    "joined_names": ("customer as c join orders as o on .o_custkey = .c_custkey filter .o_totalprice > 300000", False, "SELECT c_custkey AS \"c.c_custkey\", c_name AS \"c.c_name\", c_nationkey AS \"c.c_nationkey\", c_acctbal AS \"c.c_acctbal\", c_mktsegment AS \"c.c_mktsegment\", o_orderkey AS \"o.o_orderkey\", o_custkey AS \"o.o_custkey\", o_orderstatus AS \"o.o_orderstatus\", o_totalprice AS \"o.o_totalprice\", o_orderdate AS \"o.o_orderdate\", o_orderpriority AS \"o.o_orderpriority\" FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000"),
    "aggregate_repeated": ("orders group .o_orderstatus having sum(.o_custkey) > 0 order sum(.o_custkey) desc { s: .o_orderstatus, a: sum(.o_custkey), b: sum(.o_custkey) }", False, "SELECT o_orderstatus AS s, sum(o_custkey)::BIGINT AS a, sum(o_custkey)::BIGINT AS b FROM orders GROUP BY 1 HAVING sum(o_custkey) > 0"),
    "aggregate_expressions": ("orders group .o_orderstatus { s: .o_orderstatus, spread: max(.o_custkey) - min(.o_custkey), mean: sum(.o_custkey) / count(*), big: count(*) > 100 }", False, "SELECT o_orderstatus AS s, max(o_custkey) - min(o_custkey) AS spread, (sum(o_custkey) // count(*))::BIGINT AS mean, count(*) > 100 AS big FROM orders GROUP BY 1"),
    "group_constant": ("orders group 1 { n: count(*), top: max(.o_custkey) }", False, "SELECT count(*) AS n, max(o_custkey) AS top FROM orders"),
    "group_order_scope": ("orders group .o_custkey order .n desc, .o_custkey limit 10 { .o_custkey, n: count(*) }", False, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10"),
    "order_scope": ("orders order .o_totalprice desc limit 5 { o_totalprice: 0 - .o_orderkey, p: .o_totalprice }", False, "SELECT -o_orderkey AS o_totalprice, p FROM (SELECT o_orderkey, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)"),
    "window_average_least": ("orders { .o_orderkey, a: avg(.o_custkey) over (partition .o_orderstatus), lo: min(.o_totalprice) over (partition .o_custkey order .o_orderkey) }", False, "SELECT o_orderkey, avg(o_custkey) OVER (PARTITION BY o_orderstatus) AS a, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS lo FROM orders"),
    "now": ("nation { .n_nationkey, later: now() > date_add(now(), 0 - 1, \"days\"), this: extract(\"year\", now()) > 2000 }", False, "SELECT n_nationkey::BIGINT AS n_nationkey, true AS later, true AS this FROM nation"),
    "not_between": ("orders filter .o_totalprice not between 1000 and 250000 { .o_orderkey }", False, "SELECT o_orderkey FROM orders WHERE o_totalprice IS NOT NULL AND NOT o_totalprice BETWEEN 1000 AND 250000"),
    # negative zero is a float of its own
    "zero_groups": ("orders group (0 - .o_custkey / 100) * 0.0 { z: cast((0 - .o_custkey / 100) * 0.0, \"str\"), n: count(*) }", False, "SELECT CASE WHEN o_custkey // 100 = 0 THEN '0' ELSE '-0' END AS z, count(*) AS n FROM orders GROUP BY 1"),
    "zero_count_distinct": ("count(distinct orders { (0 - .o_custkey / 100) * 0.0 })", False, "SELECT count(DISTINCT o_custkey // 100 = 0) AS count FROM orders"),
    "zero_union": ("orders { z: (0 - .o_custkey / 100) * 0.0 } union nation { z: .n_nationkey * 1.0 }", False, "SELECT DISTINCT CASE WHEN o_custkey // 100 = 0 THEN 0.0::DOUBLE ELSE '-0.0'::DOUBLE END AS z FROM orders WHERE o_custkey // 100 > 0 UNION ALL SELECT n_nationkey::DOUBLE FROM nation"),
    "sql_group": ("SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS s FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 1 ORDER BY o_orderstatus", True, "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1"),
    "sql_join_raw": ("SELECT c.c_mktsegment AS segment, count(c.c_custkey) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE NOT (o.o_orderstatus = 'P') GROUP BY c.c_mktsegment", True, "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1"),
    "sql_null_literal": ("SELECT count(*) FROM orders_n WHERE NOT (k = NULL)", True, "SELECT count(*) AS count FROM (SELECT nullif(o_custkey % 7, 0) AS k FROM orders) WHERE NOT coalesce(k = NULL, false)"),
}


def run_case(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    text, sql, _ = CASES[name]
    return engine(spark, sf_dir).dataframe(text, sql=sql)


#: A path over two declared links: the links, and the query.
SCALAR_LINK = (
    ("link orders.customer -> customer on o_custkey = c_custkey", "link customer.nation -> nation on c_nationkey = n_nationkey"),
    "orders as o filter o.o_totalprice > 200000 { k: o.o_orderkey, customer: o.customer.c_name, nation: o.customer.nation.n_name }",
)


def scalar_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path over two declared links."""
    e = engine(spark, sf_dir)
    for link in SCALAR_LINK[0]:
        e.execute(link)
    return e.dataframe(SCALAR_LINK[1])


def block_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of a declared link, an array for each parent."""
    e = engine(spark, sf_dir)
    e.execute("link nation.suppliers -> supplier on n_nationkey = s_nationkey")
    return e.dataframe("nation as n { name: n.n_name, suppliers: n.suppliers filter s_suppkey > 3 order s_suppkey desc limit 3 { s_suppkey } }")


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update, upsert and delete on a stored table, read through a view that they make stale."""
    e = Engine(spark)
    e.execute("type T { required unique auto id: int, name: str default \"x\", n: int }")
    e.execute("materialize Big as T filter .n > 15 { .id, .name, .n }")
    e.execute('insert T { n := 10 }, { name := "b", n := 20 }, { name := "c", n := 30 }')
    e.execute("T filter .id = 1 update { n := .n + 6 }")
    e.execute('upsert T on .id { id := 2, name := "bb", n := 21 } on conflict { name := "bb" }')
    e.execute('upsert T on .id { id := 9, name := "new", n := 90 }')
    e.execute("begin")
    e.execute("T delete")
    e.execute("rollback")
    e.execute("T filter .id = 3 delete")
    return e.dataframe("Big")


def loaded(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose stored type Item has all rows of orders."""
    e = engine(spark, sf_dir)
    e.execute('type Item { required unique id: int, cust: int, price: float, status: str, note: str default "none" }')
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e.load("Item", orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")))
    return e


#: The type Item as SQL.
ITEM = "(SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS status, 'none' AS note FROM orders)"

#: name: (statements of which the last gives the result, SQL dialect or not, oracle); on the type Item.
STORED: dict[str, tuple[list[str], bool, str]] = {
    "stored_load": (["Item { .id, .cust, .price, .status, .note }"], False, f"SELECT * FROM {ITEM}"),
    "stored_update": (["Item filter .price > 200000 update { status := \"X\", cust := .cust + 1 }", "Item { .id, .cust, .status }"], False, f"SELECT id, CASE WHEN price > 200000 THEN cust + 1 ELSE cust END AS cust, CASE WHEN price > 200000 THEN 'X' ELSE status END AS status FROM {ITEM}"),
    "stored_delete": (["Item filter .status = \"F\" delete", "Item { .id }"], False, f"SELECT id FROM {ITEM} WHERE status <> 'F'"),
    "stored_returning": (["Item filter .price > 250000 update { note := concat(.status, \"!\") } returning"], False, f"SELECT id, cust, price, status, status || '!' AS note FROM {ITEM} WHERE price > 250000"),
    "stored_upsert": (["upsert Item on .id { id := 1, cust := 0 } on conflict { cust := -1 }", "upsert Item on .id { id := -1, cust := 5 }", "Item { .id, .cust }"], False, f"SELECT id, CASE WHEN id = 1 THEN -1 ELSE cust END AS cust FROM {ITEM} UNION ALL SELECT -1, 5 UNION ALL SELECT 1, 0 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 1)"),
    "stored_view": (["materialize Totals as Item group .status { status: .status, n: count(*), s: sum(.cust) }", "Item filter .status = \"P\" delete", "Item filter .status = \"F\" update { cust := 1 }", "Totals"], False, f"SELECT status, count(*) AS n, sum(CASE WHEN status = 'F' THEN 1 ELSE cust END)::BIGINT AS s FROM {ITEM} WHERE status <> 'P' GROUP BY 1"),
    "stored_view_dropped": (["materialize V as Item { .id }", "refresh V", "drop view V", "materialize V as Item filter .cust < 100 { .cust, .id }", "V"], False, f"SELECT cust, id FROM {ITEM} WHERE cust < 100"),
    "stored_commit": (["begin", "Item filter .status = \"F\" delete", "Item filter .cust < 500 update { note := \"c\" }", "commit", "Item { .id, .note }"], False, f"SELECT id, CASE WHEN cust < 500 THEN 'c' ELSE note END AS note FROM {ITEM} WHERE status <> 'F'"),
    "stored_rollback": (["begin", "Item delete", "insert Item { id := -5 }", "rollback", "Item { .id }"], False, f"SELECT id FROM {ITEM}"),
    "stored_alter": (["alter Item add column half: float", "Item filter .cust > 50 update { half := .price / 2.0 }", "alter Item drop column note", "Item"], False, f"SELECT id, cust, price, status, CASE WHEN cust > 50 THEN price / 2 END AS half FROM {ITEM}"),
    "stored_drop": (["type Gone { id: int }", "insert Gone { id := 1 }", "drop Gone", "drop if exists Gone", "type Gone { id: int, b: bool }", "insert Gone { id := 2, b := true }", "Gone"], False, "SELECT 2::BIGINT AS id, true AS b"),
    "stored_indexes": (["alter Item add index .cust", "alter Item add unique if not exists .id", "describe Item"], False, "SELECT * FROM (VALUES ('id', 'int', false, 'unique'), ('cust', 'int', true, 'index'), ('price', 'float', true, ''), ('status', 'str', true, ''), ('note', 'str', true, '')) AS t(\"column\", type, nullable, index)"),
    "stored_types": (["type Other { a: int }", "schema"], False, "SELECT * FROM (VALUES ('Item', 5::BIGINT), ('Other', 1), ('customer', 5), ('customer_n', 6), ('events', 6), ('lineitem', 11), ('nation', 3), ('orders', 6), ('orders_n', 8), ('part', 6), ('region', 2), ('supplier', 4)) AS t(name, columns)"),
    "stored_links": (["link Item.buyer -> customer on cust = c_custkey", "link customer.items -> Item on c_custkey = cust", "link nation.people -> customer on n_nationkey = c_nationkey", "drop link nation.people", "schema links"], False, "SELECT * FROM (VALUES ('Item', 'buyer', 'customer', 'cust', 'c_custkey', 'to-one'), ('customer', 'items', 'Item', 'c_custkey', 'cust', 'to-many')) AS t(owner, name, target, local_key, target_key, cardinality)"),
    "stored_link_path": (["link Item.buyer -> customer on cust = c_custkey", "Item as i filter i.price > 250000 { i.id, who: i.buyer.c_name }"], False, f"SELECT id, c_name AS who FROM {ITEM} LEFT JOIN customer ON cust = c_custkey WHERE price > 250000"),
    "sql_update_returning": (["UPDATE Item SET cust = cust + 1, note = 'up' WHERE status = 'P' RETURNING *"], True, f"SELECT id, cust + 1 AS cust, price, status, 'up' AS note FROM {ITEM} WHERE status = 'P'"),
    "sql_delete_returning": (["DELETE FROM Item WHERE price > 250000 RETURNING *"], True, f"SELECT * FROM {ITEM} WHERE price > 250000"),
    "sql_insert_returning": (["INSERT INTO Item (id, cust, price) VALUES (-1, 5, 2.5), (-2, NULL, 3) RETURNING *"], True, "SELECT * FROM (VALUES (-1::BIGINT, 5::BIGINT, 2.5::DOUBLE, NULL::VARCHAR, 'none'), (-2, NULL, 3.0, NULL, 'none')) AS t(id, cust, price, status, note)"),
    "sql_writes": (["INSERT INTO Item (id, cust) VALUES (-1, 5)", "UPDATE Item SET cust = 0 WHERE id < 100", "DELETE FROM Item WHERE status = 'F'", "SELECT id, cust FROM Item"], True, f"SELECT id, CASE WHEN id < 100 THEN 0 ELSE cust END AS cust FROM {ITEM} WHERE status <> 'F' UNION ALL SELECT -1, 0"),
    "sql_definitions": (["CREATE TABLE Tags (id INT PRIMARY KEY, tag TEXT NOT NULL, weight DOUBLE PRECISION)", "CREATE INDEX by_tag ON Tags (tag)", "INSERT INTO Tags (id, tag) VALUES (1, 'a'), (2, 'b')", "ALTER TABLE Tags ADD COLUMN seen INT", "UPDATE Tags SET seen = id * 10 WHERE tag = 'b'", "CREATE TABLE Spare (id INT)", "DROP TABLE Spare", "SELECT id, tag, weight, seen FROM Tags"], True, "SELECT * FROM (VALUES (1::BIGINT, 'a', NULL::DOUBLE, NULL::BIGINT), (2, 'b', NULL, 20)) AS t(id, tag, weight, seen)"),
    "sql_transactions": (["BEGIN", "DELETE FROM Item", "ROLLBACK", "BEGIN", "DELETE FROM Item WHERE status = 'F'", "COMMIT", "SELECT id FROM Item"], True, f"SELECT id FROM {ITEM} WHERE status <> 'F'"),
}


def run_stored(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    statements, sql, _ = STORED[name]
    e = loaded(spark, sf_dir)
    for text in statements[:-1]:
        e.execute(text, sql=sql)
    return e.dataframe(statements[-1], sql=sql)


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).dataframe("orders filter .o_custkey < $2 and .o_orderstatus = $1 { .o_orderkey, w: $1 }", ["O", 400])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared statement, executed with two sets of values."""
    p = engine(spark, sf_dir).prepare('orders filter .o_orderstatus = "?" and .o_totalprice > 1 { .o_orderkey }')
    return p.execute("O", 200000.5).unionByName(p.execute("F", 300000))


def prepared_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).prepare("SELECT o_orderkey FROM orders WHERE o_custkey < 5 AND NOT (o_orderstatus = 'x')", sql=True).execute(300, "F")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a point look-up's plan shows a scan of two columns with a pushed filter."""
    plan = engine(spark, sf_dir).dataframe("explain orders filter .o_orderkey = 42 { .o_custkey }")
    said = F.col("plan").contains("parquet") & F.col("plan").contains("EqualTo(o_orderkey,42)") & ~F.col("plan").contains("o_totalprice")
    return plan.agg(F.max(said).alias("pushed"))


REFUSED = (
    "customer as c join orders as c on c.o_custkey = c.c_custkey", "orders { .nothing }", "customer as a join customer as b on a.c_custkey = b.c_custkey { .c_name }", "orders { n: count(*), .o_orderkey }", "nation { .n_name } union region", "orders update { o_custkey := 1 }",
    "Item as i { x: orders as o { o.o_orderkey } }", "insert Item { id := 1, missing := 2 }", "insert Item { cust := 1 }", "Item order .id update { cust := 1 }", "orders filter .o_orderstatus > 3 limit -1", "alter Item drop column nothing", "link Item.status -> customer on cust = c_custkey",
    "orders { .o_orderkey, .o_custkey }", "Item filter .id in (1, 2) { .id }",
)


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements, and whether they break a rule."""
    from tidewater.plans.nodes import LanguageError

    e, rows = loaded(spark, sf_dir), []
    for text in REFUSED:
        try:
            e.execute(text)
            rows.append((text, False))
        except LanguageError:
            rows.append((text, True))
    return spark.createDataFrame(rows, "statement string, refused boolean")


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result written as CSV and as JSON, and read back from both."""
    from tidewater.sources.sinks import export

    e = engine(spark, sf_dir)
    result, schema = e.dataframe("orders { .o_orderkey, .o_orderstatus }"), "o_orderkey bigint, o_orderstatus string"
    csv, js = (f"{e.catalog.path}/export-{kind}" for kind in ("csv", "json"))
    export(result, csv, "csv")
    export(result, js, "json")
    return spark.read.option("header", "true").schema(schema).csv(csv).unionByName(spark.read.schema(schema).json(js))


def backup_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A back-up, a second one of what was added since, and the store restored from it."""
    from tidewater.sources.sinks import backup, restore

    e = loaded(spark, sf_dir)
    root = e.catalog.path
    backup(e.catalog, f"{root}-saved")
    e.execute("insert Item { id := -7, cust := 3 }")
    backup(e.catalog, f"{root}-saved")
    e.execute("Item delete")
    restore(spark, f"{root}-saved", f"{root}-again")
    return Engine(spark, f"{root}-again").dataframe("Item { .id, .cust }")


#: Queries that are more than one text, with their oracles.
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "parameters": (parameters, "SELECT o_orderkey, 'O' AS w FROM orders WHERE o_custkey < 400 AND o_orderstatus = 'O'"),
    "prepared": (prepared, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000.5 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"),
    "prepared_sql": (prepared_sql, "SELECT o_orderkey FROM orders WHERE o_custkey < 300 AND NOT (o_orderstatus = 'F')"),
    "explain": (explain, "SELECT true AS pushed"),
    "refused": (refused, "SELECT s AS statement, i <= " + str(len(REFUSED) - 2) + " AS refused FROM (SELECT unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in REFUSED) + "]) AS s, unnest(range(1, " + str(len(REFUSED) + 1) + ")) AS i)"),
    "export_csv": (export_csv, "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders"),
    "backup_and_restore": (backup_and_restore, "SELECT o_orderkey AS id, o_custkey AS cust FROM orders UNION ALL SELECT -7, 3"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: partial(run_case, name) for name in CASES} | {name: partial(run_stored, name) for name in STORED} | {name: fn for name, (fn, _) in OTHERS.items()}
    return {**named, "scalar_link": scalar_link, "block_link": block_link, "stored_table": stored_table}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in (CASES | STORED).items()} | {name: sql for name, (_, sql) in OTHERS.items()} | {
        "scalar_link": "SELECT o_orderkey AS k, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000",
        "block_link": "SELECT n_name AS name, coalesce(j, '[]') AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, '[' || string_agg('{\"s_suppkey\":' || s_suppkey || '}', ',' ORDER BY rn) || ']' AS j FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS rn FROM supplier WHERE s_suppkey > 3) WHERE rn <= 3 GROUP BY 1) ON s_nationkey = n_nationkey",
        "stored_table": "SELECT * FROM (VALUES (1::BIGINT, 'x', 16::BIGINT), (2, 'bb', 20), (9, 'new', 90)) AS t(id, name, n)",
    }
