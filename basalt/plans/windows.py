"""Window functions, frames, QUALIFY-style filters, ranking and analytical patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.operators.relations import asof_join, qualify, sessions, top_k
from basalt.plans.catalog import load, query, sql_query

sql_query("window_ranks", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER r AS rk, dense_rank() OVER r AS dr, round(percent_rank() OVER r, 8) AS pr, round(cume_dist() OVER r, 8) AS cd, ntile(4) OVER w AS q FROM {orders}
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
"""SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER r AS INT) AS rk, CAST(dense_rank() OVER r AS INT) AS dr, round(percent_rank() OVER r, 8) AS pr, round(cume_dist() OVER r, 8) AS cd, CAST(ntile(4) OVER w AS INT) AS q FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
sql_query("window_offsets", """SELECT event_id, lag(value) OVER w AS p1, lag(value, 2, -1.0) OVER w AS p2, lead(event_type) OVER w AS nx, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
sql_query("window_running", "SELECT o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS mov, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}")
sql_query("window_range_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS peers FROM {part}",
"SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS peers FROM part")
sql_query("window_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'click')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM {events}",
"SELECT event_id, last_value(nullif(event_type, 'click') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM events")
sql_query("window_share", "SELECT n_name, round(s / sum(s) OVER (), 8) AS share FROM (SELECT n_name, sum(c_acctbal) AS s FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name)")


@query("window_groups_frame", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def groups_frame(spark, sf_dir):
    # GROUPS counts peer groups: number them densely, then the frame is a RANGE over that number.
    (part,) = load(spark, sf_dir, "part")
    numbered = part.withColumn("g", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")))
    return numbered.select("p_partkey", F.sum("p_size").over(Window.partitionBy("p_brand").orderBy("g").rangeBetween(-1, 0)).alias("s"))


@query("window_count_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id) AS kinds FROM events")
def count_distinct_over(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    kinds = F.size(F.collect_set("event_type").over(Window.partitionBy("user_id"))).cast("long")
    return events.select("event_id", kinds.alias("kinds"))


@query("qualify_latest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def qualify_latest(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    latest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return qualify(orders, latest == 1).select("o_custkey", "o_orderkey")


@query("qualify_aggregate", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY sum(l_quantity) OVER (PARTITION BY l_orderkey) > 200 AND count(*) OVER (PARTITION BY l_orderkey) >= 3")
def qualify_aggregate(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey")
    return qualify(li, (F.sum("l_quantity").over(w) > 200) & (F.count("*").over(w) >= 3)).select("l_orderkey", "l_linenumber")


@query("top_k_per_group", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_k_per_group(spark, sf_dir):
    (customer,) = load(spark, sf_dir, "customer")
    return top_k(customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query(
    "sessionize",
    """SELECT user_id, CAST(sid AS BIGINT) AS session_no, count(*) AS n FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY ALL""",
)
def sessionize(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return sessions(events, ["user_id"], "ts", 30 * 60, tie="event_id").groupBy("user_id", "session_no").agg(F.count("*").alias("n"))


@query(
    "asof_previous_event",
    """SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN
    (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def asof_previous_event(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before_id"))
    return asof_join(left, right, ["user_id"], "ts", ["before_id"]).select("event_id", "before_id")


sql_query("funnel", """SELECT count(DISTINCT v.user_id) AS viewed, count(DISTINCT c.user_id) AS clicked, count(DISTINCT p.user_id) AS bought FROM (SELECT user_id, min(ts) AS t FROM {events} WHERE event_type = 'view' GROUP BY user_id) v
LEFT JOIN (SELECT user_id, max(ts) AS t FROM {events} WHERE event_type = 'click' GROUP BY user_id) c ON v.user_id = c.user_id AND c.t > v.t LEFT JOIN (SELECT user_id, max(ts) AS t FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) p ON c.user_id = p.user_id AND p.t > c.t""")
sql_query("month_over_month", """SELECT y, m, n, n - lag(n) OVER (ORDER BY y, m) AS change FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2)""")
sql_query("rfm_scores", """SELECT o_custkey, CAST(ntile(5) OVER (ORDER BY last_day DESC, o_custkey) AS INT) AS r, CAST(ntile(5) OVER (ORDER BY n DESC, o_custkey) AS INT) AS f, CAST(ntile(5) OVER (ORDER BY total DESC, o_custkey) AS INT) AS m FROM (SELECT o_custkey, max(o_orderdate) AS last_day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey)""")
