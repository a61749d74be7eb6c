"""Filters, projections, joins, aggregates, set operations and subqueries, left to Spark's planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.plans.catalog import load, query, sql_query


@query(
    "q1_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    return (
        li.where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


# Scan, filter, projection, distinct, values, limit
sql_query("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice, upper(o_orderstatus) AS status FROM {orders}")
sql_query("filter_conjunction", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 150000 AND o_orderstatus <> 'F' AND NOT o_orderpriority IS NULL")
sql_query("filter_in_list", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 5, 9, 23) OR p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')")
sql_query("filter_like", "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%1%' AND c_name NOT LIKE '%99%' AND c_mktsegment ILIKE 'b%'")
sql_query("filter_three_valued", "SELECT p_partkey, CASE WHEN nullif(p_size, 5) > 10 THEN 'big' WHEN nullif(p_size, 5) IS NULL THEN 'none' ELSE 'small' END AS kind, (nullif(p_size, 5) > 10) IS TRUE AS is_big, (nullif(p_size, 5) > 10) IS NOT FALSE AS not_small FROM {part}")
sql_query("filter_is_distinct", "SELECT count(*) AS n FROM {orders} WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AND nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM o_orderstatus")
sql_query("like_any_all", "SELECT p_partkey FROM {part} WHERE p_type LIKE ANY ('%BRASS%', '%TIN%', 'PROMO%') AND p_name LIKE ALL ('%a%', '%e%')", "SELECT p_partkey FROM part WHERE (p_type LIKE '%BRASS%' OR p_type LIKE '%TIN%' OR p_type LIKE 'PROMO%') AND p_name LIKE '%a%' AND p_name LIKE '%e%'")
sql_query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}")
sql_query("values_rows", "SELECT id, name, id * 2 AS twice FROM VALUES (1, 'a'), (2, 'b'), (3, CAST(NULL AS STRING)) AS t(id, name)", "SELECT id, name, id * 2 AS twice FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
sql_query("star_except", "SELECT * EXCEPT (c_acctbal, c_name) FROM {customer}", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
sql_query("top_n", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10")
sql_query("order_nulls", "SELECT p_partkey, nullif(p_size, 10) AS size FROM {part} ORDER BY nullif(p_size, 10) ASC NULLS LAST, p_partkey LIMIT 40")
sql_query("arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS b, round(l_extendedprice * l_discount, 4) AS c, l_extendedprice / l_quantity AS d, l_orderkey % 7 AS e, -l_linenumber AS f FROM {lineitem}")
sql_query("bit_operators", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, shiftleft(o_orderkey, 2) AS d, shiftright(o_orderkey, 3) AS e FROM {orders}", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, o_orderkey << 2 AS d, o_orderkey >> 3 AS e FROM orders")

# Joins
sql_query("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 100000")
sql_query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000")
sql_query("join_right", "SELECT s.s_suppkey, n.n_nationkey FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0")
sql_query("join_full", "SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM {customer} WHERE c_custkey <= 80) c FULL JOIN (SELECT * FROM {supplier} WHERE s_suppkey > 5) s ON c.c_custkey = s.s_suppkey")
sql_query("join_full_whole", "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL JOIN {supplier} s ON c.c_custkey * 3 = s.s_suppkey * 2")
sql_query("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
sql_query("join_comma", "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey")
sql_query("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql_query("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql_query("in_subquery", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
sql_query("not_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_suppkey NOT IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49.5 AND l_discount > 0.09)")
sql_query("not_in_with_null", "SELECT count(*) AS n FROM {supplier} WHERE s_suppkey NOT IN (SELECT nullif(n_nationkey, 3) FROM {nation})")
sql_query("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_theta", "SELECT s.s_suppkey, count(*) AS n FROM {supplier} s JOIN {nation} n ON s.s_acctbal > n.n_nationkey * 400 AND s.s_nationkey <> n.n_nationkey GROUP BY s.s_suppkey")
sql_query("join_null_keys", "SELECT count(*) AS n, count(b.p_partkey) AS m FROM (SELECT p_partkey, nullif(p_size, 7) AS k FROM {part}) a LEFT JOIN (SELECT p_partkey, nullif(p_size, 7) AS k FROM {part} WHERE p_partkey < 50) b ON a.k = b.k")
sql_query("join_null_keys_whole", "SELECT CAST(sum(coalesce(b.c, 1)) AS BIGINT) AS n, CAST(sum(coalesce(b.c, 0)) AS BIGINT) AS m FROM (SELECT nullif(p_size, 7) AS k FROM {part}) a LEFT JOIN (SELECT nullif(p_size, 7) AS k, count(*) AS c FROM {part} GROUP BY nullif(p_size, 7)) b ON a.k = b.k")
sql_query("five_way_join", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name""")

# Aggregates
sql_query("agg_global", "SELECT count(*) AS n, count(nullif(l_returnflag, 'N')) AS nn, count(DISTINCT l_suppkey) AS d, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 8) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {lineitem}")
sql_query("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_returnflag) AS m FROM {lineitem} WHERE l_quantity < 0")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
sql_query("agg_group_expr", "SELECT year(o_orderdate) AS y, o_orderpriority AS p, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), o_orderpriority", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL")
sql_query("agg_conditional", """SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS nf, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS so, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS ap,
min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS lo, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS hi FROM {orders} GROUP BY o_orderpriority""",
"""SELECT o_orderpriority, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS nf, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS so, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS ap,
min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS lo, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS hi FROM orders GROUP BY o_orderpriority""")
sql_query("agg_logical_bit", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_discount > 0.09) AS o, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, bit_xor(l_orderkey) AS bx FROM {lineitem} GROUP BY l_returnflag")
sql_query("agg_statistics", """SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(stddev(l_quantity), 6) AS sd,
round(stddev_pop(l_quantity), 6) AS sp, round(variance(l_discount), 8) AS v, round(var_pop(l_discount), 8) AS vp, round(var_samp(l_discount), 8) AS vs, round(stddev_samp(l_tax), 8) AS ss FROM {lineitem} GROUP BY l_linestatus""")
sql_query("agg_approx_distinct_exact", "SELECT event_type, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
sql_query("agg_approx_quantiles", "SELECT event_type, round(q[0], 6) AS q0, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3, round(q[4], 6) AS q4 FROM (SELECT event_type, percentile(value, array(0, 0.25, 0.5, 0.75, 1)) AS q FROM {events} GROUP BY event_type)",
"SELECT event_type, round(quantile_cont(value, 0), 6) AS q0, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 1), 6) AS q4 FROM events GROUP BY event_type")
sql_query("agg_string", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_array_ordered_limit", "SELECT o_custkey, array_join(slice(transform(array_sort(collect_list(struct(-o_totalprice AS k, o_orderkey AS v))), t -> t.v), 1, 3), ',') AS top FROM {orders} GROUP BY o_custkey",
"SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), 1, 3), ',') AS top FROM orders GROUP BY o_custkey")
sql_query("agg_any_value", "SELECT n_regionkey, any_value(r_name) IGNORE NULLS AS region FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, any_value(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
sql_query("agg_top_count", "SELECT event_type, n FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type) ORDER BY n DESC, event_type LIMIT 3")
sql_query("agg_top_sum", "SELECT user_id, s FROM (SELECT user_id, round(sum(value), 4) AS s FROM {events} GROUP BY user_id) ORDER BY s DESC, user_id LIMIT 10")
sql_query("group_rollup", "SELECT n_regionkey, n_name, grouping(n_regionkey) AS g1, grouping(n_name) AS g2, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
"SELECT n_regionkey, n_name, CAST(grouping(n_regionkey) AS TINYINT) AS g1, CAST(grouping(n_name) AS TINYINT) AS g2, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
sql_query("group_cube", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS g, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
"SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("group_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
sql_query("group_sets_nested", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS (ROLLUP (o_orderstatus, o_orderpriority), CUBE (o_orderpriority))")
sql_query("group_all", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY ALL")
sql_query("agg_xml", "SELECT n_regionkey, listagg(concat('<n>', n_name, '</n>'), '') WITHIN GROUP (ORDER BY n_nationkey) AS x FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(concat('<n>', n_name, '</n>'), '' ORDER BY n_nationkey) AS x FROM nation GROUP BY n_regionkey")

# Set operations
sql_query("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql_query("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql_query("intersect_distinct", "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_quantity < 5")
sql_query("intersect_all", "SELECT l_suppkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT ALL SELECT l_suppkey FROM {lineitem} WHERE l_quantity < 5")
sql_query("except_distinct", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000")
sql_query("except_all", "SELECT l_suppkey AS k FROM {lineitem} WHERE l_quantity > 25 EXCEPT ALL SELECT l_suppkey FROM {lineitem} WHERE l_quantity <= 25")

# Subqueries and CTEs
sql_query("scalar_subquery", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM {orders})")
sql_query("correlated_scalar", "SELECT o.o_orderkey FROM {orders} o WHERE o.o_totalprice >= (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql_query("derived_table", "SELECT y, max(n) AS m FROM (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2) t GROUP BY y", "SELECT CAST(y AS INT) AS y, max(n) AS m FROM (SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) t GROUP BY y")
sql_query("cte_chain", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM per) SELECT per.o_custkey, per.n FROM per JOIN top ON per.n >= top.m - 1")
sql_query("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", "WITH RECURSIVE t(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query("array_subquery", "SELECT r_name, array_join((SELECT array_sort(collect_list(n_name)) FROM {nation} WHERE n_regionkey = r_regionkey), ',') AS nations FROM {region}",
"SELECT r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
sql_query("lateral_subquery", "SELECT c.c_custkey, t.best FROM {customer} c, LATERAL (SELECT max(o_totalprice) AS best FROM {orders} WHERE o_custkey = c.c_custkey) t")
