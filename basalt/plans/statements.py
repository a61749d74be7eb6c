"""DML, MERGE, snapshots, transactions, scripts, functions, files, gap filling and sampling as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basalt.engine import Engine
from basalt.operators.gap_fill import gap_fill
from basalt.operators.relations import range_join, recursive_union, sample_rows, union_by_name
from basalt.plans.catalog import load, query


def _engine(spark) -> tuple[Engine, str]:
    return Engine(spark), "t_" + uuid.uuid4().hex[:8]


@query("dml_update_delete", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'")
def update_delete(spark, sf_dir):
    e, t = _engine(spark)
    (customer,) = load(spark, sf_dir, "customer")
    e.store.create_as(t, customer.select("c_custkey", "c_acctbal", "c_mktsegment"))
    e.execute(f"UPDATE {t} SET c_acctbal = 0.0 WHERE c_acctbal < 0")
    e.execute(f"DELETE FROM {t} WHERE c_mktsegment = 'BUILDING'")
    return e.sql(f"SELECT c_custkey, c_acctbal FROM {t}")


@query(
    "dml_merge",
    """SELECT coalesce(t.s_suppkey, n.k) AS k, CASE WHEN n.k IS NOT NULL AND t.s_suppkey IS NOT NULL THEN t.bal + 1000 WHEN t.s_suppkey IS NULL THEN n.bal ELSE t.bal END AS bal
    FROM (SELECT s_suppkey, floor(s_acctbal) AS bal FROM supplier WHERE s_suppkey > 5) t FULL JOIN (SELECT s_suppkey AS k, 7.0::DOUBLE AS bal FROM supplier WHERE s_suppkey % 3 = 0) n ON t.s_suppkey = n.k
    WHERE NOT (n.k IS NULL AND t.s_suppkey % 5 = 0)""",
)
def merge(spark, sf_dir):
    e, t = _engine(spark)
    (supplier,) = load(spark, sf_dir, "supplier")
    e.store.create_as(t, supplier.where("s_suppkey > 5").select(F.col("s_suppkey").alias("k"), F.floor("s_acctbal").cast("double").alias("bal")))
    supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.lit(7.0).alias("bal")).createOrReplaceTempView(t + "_src")
    e.execute(f"MERGE INTO {t} AS a USING {t}_src AS b ON a.k = b.k WHEN MATCHED THEN UPDATE SET bal = a.bal + 1000 WHEN NOT MATCHED THEN INSERT (k, bal) VALUES (k, bal) WHEN NOT MATCHED BY SOURCE AND MOD(a.k, 5) = 0 THEN DELETE")
    return e.sql(f"SELECT k, bal FROM {t}")


@query(
    "dml_merge_whole",
    """SELECT coalesce(t.s_suppkey, n.k) AS k, CASE WHEN n.k IS NOT NULL AND t.s_suppkey IS NOT NULL THEN t.bal + 1000 WHEN t.s_suppkey IS NULL THEN n.bal ELSE t.bal END AS bal
    FROM (SELECT s_suppkey, floor(s_acctbal) AS bal FROM supplier) t FULL JOIN (SELECT c_custkey * 2 AS k, floor(c_acctbal) AS bal FROM customer) n ON t.s_suppkey = n.k
    WHERE NOT (n.k IS NULL AND t.s_suppkey % 5 = 0)""",
)
def merge_whole(spark, sf_dir):
    e, t = _engine(spark)
    supplier, customer = load(spark, sf_dir, "supplier", "customer")
    e.store.create_as(t, supplier.select(F.col("s_suppkey").alias("k"), F.floor("s_acctbal").cast("double").alias("bal")))
    # Even keys meet odd and even ones: a part of the target is matched, a part is not, and most of the source is new.
    customer.select((F.col("c_custkey") * 2).alias("k"), F.floor("c_acctbal").cast("double").alias("bal")).createOrReplaceTempView(t + "_src")
    e.execute(f"MERGE INTO {t} AS a USING {t}_src AS b ON a.k = b.k WHEN MATCHED THEN UPDATE SET bal = a.bal + 1000 WHEN NOT MATCHED THEN INSERT (k, bal) VALUES (k, bal) WHEN NOT MATCHED BY SOURCE AND MOD(a.k, 5) = 0 THEN DELETE")
    return e.sql(f"SELECT k, bal FROM {t}")


@query("dml_insert_defaults", "SELECT n_nationkey AS id, n_name AS name, 'new' AS tag FROM nation")
def insert_defaults(spark, sf_dir):
    e, t = _engine(spark)
    (nation,) = load(spark, sf_dir, "nation")
    e.execute(f"CREATE TABLE {t} (id INT64 NOT NULL, name STRING, tag STRING DEFAULT 'new')")
    nation.createOrReplaceTempView(t + "_n")
    e.execute(f"INSERT INTO {t} (id, name) SELECT n_nationkey, n_name FROM {t}_n")
    return e.sql(f"SELECT CAST(id AS INT) AS id, name, tag FROM {t}")


@query("snapshot_and_rollback", "SELECT 25::BIGINT AS live, 25::BIGINT AS snap, 10::BIGINT AS inside")
def snapshot_and_rollback(spark, sf_dir):
    e, t = _engine(spark)
    (nation,) = load(spark, sf_dir, "nation")
    e.store.create_as(t, nation)
    e.execute(f"CREATE SNAPSHOT TABLE {t}_s CLONE {t}")
    e.execute("BEGIN TRANSACTION")
    e.execute(f"DELETE FROM {t} WHERE n_nationkey >= 10")
    inside = e.sql(f"SELECT COUNT(*) AS inside FROM {t}")
    e.execute("ROLLBACK")
    return e.sql(f"SELECT (SELECT COUNT(*) FROM {t}) AS live, (SELECT COUNT(*) FROM {t}_s) AS snap").crossJoin(inside)


@query("alter_table", "SELECT r_regionkey AS id, upper(r_name) AS label, 1.5::DOUBLE AS w FROM region")
def alter_table(spark, sf_dir):
    e, t = _engine(spark)
    (region,) = load(spark, sf_dir, "region")
    e.store.create_as(t, region)
    e.execute(f"ALTER TABLE {t} ADD COLUMN w FLOAT64 DEFAULT 1.5, RENAME COLUMN r_name TO label, RENAME COLUMN r_regionkey TO id")
    e.execute(f"UPDATE {t} SET label = UPPER(label) WHERE TRUE")
    return e.sql(f"SELECT id, label, w FROM {t}")


@query("sql_functions", "SELECT o_orderkey, round(o_totalprice * 1.2, 2) AS gross, o_totalprice > 100000 AS large FROM orders")
def sql_functions(spark, sf_dir):
    e = Engine(spark)
    (orders,) = load(spark, sf_dir, "orders")
    e.execute("CREATE OR REPLACE FUNCTION basalt_gross(x FLOAT64, r FLOAT64) RETURNS FLOAT64 AS (ROUND(x * (1 + r), 2))")
    e.execute("CREATE OR REPLACE FUNCTION basalt_large(x FLOAT64) AS (x > 100000)")
    return e.sql("SELECT o_orderkey, basalt_gross(o_totalprice, 0.2) AS gross, basalt_large(o_totalprice) AS large FROM {orders}", orders=orders)


@query("script_loop", "SELECT 55::BIGINT AS total, 10::BIGINT AS n")
def script_loop(spark, sf_dir):
    return Engine(spark).script("DECLARE n INT64 DEFAULT 0; DECLARE total INT64 DEFAULT 0; WHILE n < 10 DO SET n = n + 1; SET total = total + n; END WHILE; SELECT total AS total, n AS n;")[0]


@query("export_and_load", "SELECT n_nationkey, n_name FROM nation")
def export_and_load(spark, sf_dir):
    e, t = _engine(spark)
    (nation,) = load(spark, sf_dir, "nation")
    folder = f"{e.store.folder}/{t}_out"
    nation.select("n_nationkey", "n_name").createOrReplaceTempView(t + "_n")
    for kind in ("PARQUET", "JSON", "CSV"):
        e.execute(f"EXPORT DATA OPTIONS (uri='{folder}/{kind}', format='{kind}', overwrite=true) AS SELECT * FROM {t}_n")
        e.execute(f"CREATE TABLE {t}_{kind} (n_nationkey INT64, n_name STRING)")
        e.execute(f"LOAD DATA INTO {t}_{kind} FROM FILES (uris=['{folder}/{kind}'], format='{kind}', skip_leading_rows=1)")
    return e.sql(f"SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name FROM {t}_PARQUET INTERSECT DISTINCT SELECT CAST(n_nationkey AS INT), n_name FROM {t}_JSON INTERSECT DISTINCT SELECT CAST(n_nationkey AS INT), n_name FROM {t}_CSV")


_GRID = """WITH h AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS t, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM h GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM s), j AS (SELECT g.event_type, g.t, h.n FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.t = h.t)"""


def _hourly(spark, sf_dir):
    (events,) = load(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"))


@query("gap_fill_null", _GRID + " SELECT event_type, strftime(t, '%Y-%m-%d %H') AS t, n FROM j")
def gap_fill_null(spark, sf_dir):
    return gap_fill(_hourly(spark, sf_dir), "t", 3_600_000_000, {"n": "null"}, ["event_type"]).withColumn("t", F.date_format("t", "yyyy-MM-dd HH"))


@query("gap_fill_locf", _GRID + " SELECT event_type, strftime(t, '%Y-%m-%d %H') AS t, last_value(n IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM j")
def gap_fill_locf(spark, sf_dir):
    return gap_fill(_hourly(spark, sf_dir), "t", 3_600_000_000, {"n": "locf"}, ["event_type"]).withColumn("t", F.date_format("t", "yyyy-MM-dd HH"))


@query(
    "gap_fill_linear",
    _GRID
    + """, k AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(n IGNORE NULLS) OVER b AS n0, first_value(CASE WHEN n IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(n IGNORE NULLS) OVER a AS n1 FROM j
    WINDOW b AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_type, strftime(t, '%Y-%m-%d %H') AS t, round(coalesce(n::DOUBLE, n0 + (n1 - n0) * (epoch(t) - epoch(t0)) / (epoch(t1) - epoch(t0))), 6) AS n FROM k""",
)
def gap_fill_linear(spark, sf_dir):
    return gap_fill(_hourly(spark, sf_dir), "t", 3_600_000_000, {"n": "linear"}, ["event_type"]).select("event_type", F.date_format("t", "yyyy-MM-dd HH").alias("t"), F.round("n", 6).alias("n"))


@query("recursive_union_distinct", "WITH RECURSIVE r(k) AS (SELECT 1::BIGINT UNION SELECT (k * 3 + 1) % 50 FROM r) SELECT k FROM r")
def recursive_distinct(spark, sf_dir):
    return recursive_union(spark.sql("SELECT 1L AS k"), lambda d: d.select(((F.col("k") * 3 + 1) % 50).alias("k")))


@query("union_by_name", "SELECT c_custkey AS k, c_name AS a, NULL::VARCHAR AS b FROM customer UNION ALL BY NAME SELECT s_name AS b, s_suppkey AS k FROM supplier")
def by_name(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer", "supplier")
    return union_by_name(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a")), s.select(F.col("s_name").alias("b"), F.col("s_suppkey").alias("k")))


@query("range_join_bins", "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey AND p_size < n_nationkey + 3")
def range_bins(spark, sf_dir):
    p, n = load(spark, sf_dir, "part", "nation")
    return range_join(p, n.withColumn("hi", F.col("n_nationkey") + 3), "p_size", "n_nationkey", "hi", 3).select("p_partkey", "n_nationkey")


@query("sample_exact_rows", "SELECT 40::BIGINT AS n, 40::BIGINT AS d")
def sample_exact(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    return sample_rows(orders, 40, seed=3).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("d"))


@query("pivot_quarters", "SELECT o_orderpriority, count(*) FILTER (WHERE quarter(o_orderdate) = 1) AS q1, count(*) FILTER (WHERE quarter(o_orderdate) = 2) AS q2, count(*) FILTER (WHERE quarter(o_orderdate) = 3) AS q3, count(*) FILTER (WHERE quarter(o_orderdate) = 4) AS q4 FROM orders GROUP BY 1")
def pivot_quarters(spark, sf_dir):
    (orders,) = load(spark, sf_dir, "orders")
    t = orders.withColumn("q", F.quarter("o_orderdate")).groupBy("o_orderpriority").pivot("q", [1, 2, 3, 4]).count()
    return t.select("o_orderpriority", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"q{i}") for i in range(1, 5)])


@query(
    "script_dml",
    "SELECT n_nationkey AS id, CAST(CASE WHEN n_regionkey < 3 THEN n_regionkey + 1 ELSE 0 END AS BIGINT) AS v, 'live' AS kind FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey, 0::BIGINT, 'snap' FROM nation UNION ALL SELECT n_nationkey, 0::BIGINT, 'back' FROM nation",
)
def script_dml(spark, sf_dir):
    """DML in a loop changes the table and neither its snapshot nor what a rollback brings back."""
    e, t = _engine(spark)
    (nation,) = load(spark, sf_dir, "nation")
    e.store.create_as(t, nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("r"), F.lit(0).cast("long").alias("v")))
    e.execute(f"CREATE SNAPSHOT TABLE {t}_s CLONE {t}")
    e.execute("BEGIN TRANSACTION")
    e.script(f"DECLARE k INT64 DEFAULT 0; WHILE k < 3 DO UPDATE {t} SET v = v + k + 1 WHERE r = k; SET k = k + 1; END WHILE; DELETE FROM {t} WHERE r = k;")
    live = e.sql(f"SELECT CAST(id AS INT) AS id, v, 'live' AS kind FROM {t}")
    e.execute("ROLLBACK")
    return live.unionAll(e.sql(f"SELECT CAST(id AS INT) AS id, v, 'snap' AS kind FROM {t}_s UNION ALL SELECT CAST(id AS INT), v, 'back' FROM {t}"))


@query("dml_update_nested", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS price, o_orderpriority AS p FROM orders")
def update_nested(spark, sf_dir):
    e, t = _engine(spark)
    load(spark, sf_dir, "orders")[0].createOrReplaceTempView(t + "_o")
    e.execute(f"CREATE TABLE {t} AS SELECT o_orderkey, STRUCT(o_totalprice AS price, o_orderpriority AS p) AS s FROM {t}_o")
    e.execute(f"UPDATE {t} SET s.price = s.price * 2 WHERE s.p = '1-URGENT'")
    return e.sql(f"SELECT o_orderkey, s.price AS price, s.p AS p FROM {t}")


@query("qualified_names", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def qualified_names(spark, sf_dir):
    e, t = _engine(spark)
    for name, df in zip(("nation", "region"), load(spark, sf_dir, "nation", "region")):
        df.createOrReplaceTempView(f"{t}_{name}")
        e.execute(f"CREATE TABLE {t}.{name} AS SELECT * FROM {t}_{name}")
    return e.sql(f"SELECT nation.n_name, r.r_name FROM {t}.nation JOIN `p.{t}.region` AS r ON nation.n_regionkey = r.r_regionkey")


@query("gap_fill_from_clause", _GRID + " SELECT event_type, strftime(t, '%Y-%m-%d %H') AS t, last_value(n IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM j")
def gap_fill_from_clause(spark, sf_dir):
    e, t = _engine(spark)
    _hourly(spark, sf_dir).createOrReplaceTempView(t)
    out = e.sql(f"SELECT event_type, t, n FROM GAP_FILL(TABLE {t}, ts_column => 't', bucket_width => INTERVAL 1 HOUR, partitioning_columns => ['event_type'], value_columns => [('n', 'locf')])")
    return out.withColumn("t", F.date_format("t", "yyyy-MM-dd HH"))


@query("table_function", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def table_function(spark, sf_dir):
    e, t = _engine(spark)
    e.store.create_as(t, load(spark, sf_dir, "customer")[0])
    e.execute(f"CREATE OR REPLACE TABLE FUNCTION {t}_f(seg STRING) AS SELECT c_custkey, c_name FROM {t} WHERE c_mktsegment = seg")
    return e.sql(f"SELECT c_custkey, c_name FROM {t}_f('BUILDING')")


@query("aggregate_function", "SELECT c_mktsegment, round(max(c_acctbal * 2) - min(c_acctbal * 2), 6) AS spread FROM customer GROUP BY 1")
def aggregate_function(spark, sf_dir):
    e, t = _engine(spark)
    e.execute(f"CREATE AGGREGATE FUNCTION {t}_a(v FLOAT64) AS (MAX(v) - MIN(v))")
    return e.sql(f"SELECT c_mktsegment, ROUND({t}_a(c_acctbal * 2), 6) AS spread FROM {{customer}} GROUP BY c_mktsegment", customer=load(spark, sf_dir, "customer")[0])


@query("approx_top_count", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def approx_top_count(spark, sf_dir):
    return Engine(spark).sql("SELECT t.value AS value, t.count AS n FROM (SELECT APPROX_TOP_COUNT(o_orderpriority, 5) AS a FROM {orders}) AS q, UNNEST(a) AS t", orders=load(spark, sf_dir, "orders")[0])


@query("array_slice_columns", "SELECT vec_id, embedding[2:4] [1] AS a, len(embedding[2:4]) AS n, embedding[-3:] [1] AS b, len(embedding[5:2]) AS none FROM embeddings")
def array_slice_columns(spark, sf_dir):
    e = Engine(spark)
    text = "SELECT vec_id, ARRAY_SLICE(embedding, 2, 4)[OFFSET(0)] AS a, ARRAY_LENGTH(ARRAY_SLICE(embedding, 2, 4)) AS n, ARRAY_SLICE(embedding, -3, 100000)[OFFSET(0)] AS b, ARRAY_LENGTH(ARRAY_SLICE(embedding, 5, 2)) AS none FROM {embeddings}"
    return e.sql(text, embeddings=load(spark, sf_dir, "embeddings")[0])


@query("json_values", "SELECT c_custkey, c_custkey::VARCHAR AS k, c_name AS name FROM customer")
def json_values(spark, sf_dir):
    text = "SELECT c_custkey, JSON_VALUE(TO_JSON(STRUCT(c_custkey AS k)), '$.k') AS k, JSON_VALUE(PARSE_JSON(TO_JSON_STRING(STRUCT(c_name AS name))), '$.name') AS name FROM {customer}"
    return Engine(spark).sql(text, customer=load(spark, sf_dir, "customer")[0])
