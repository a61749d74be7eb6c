"""Queries in the warehouse dialect: its syntax and its function library, against plain SQL of the oracle."""

from __future__ import annotations

from basalt.plans.catalog import dialect_query as d

# Syntax
d("dialect_qualify", "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 1")
d("dialect_star_replace", "SELECT * REPLACE (ROUND(c_acctbal) AS c_acctbal, UPPER(c_mktsegment) AS c_mktsegment) FROM {customer}", "SELECT * REPLACE (round(c_acctbal) AS c_acctbal, upper(c_mktsegment) AS c_mktsegment) FROM customer")
d("dialect_unnest", "SELECT x, x * x AS sq FROM UNNEST(GENERATE_ARRAY(1, 20, 3)) AS x", "SELECT x, x * x AS sq FROM (SELECT unnest(range(1, 21, 3)) AS x)")
d("dialect_unnest_offset", "SELECT vec_id, pos, CAST(e AS FLOAT64) AS e FROM {embeddings}, UNNEST(embedding) AS e WITH OFFSET AS pos WHERE pos < 3", "SELECT vec_id, CAST(pos - 1 AS INT) AS pos, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, unnest(embedding[1:3]) AS e, generate_subscripts(embedding[1:3], 1) AS pos FROM embeddings)")
d("dialect_unnest_offset_whole", "SELECT vec_id, pos, CAST(e AS FLOAT64) AS e FROM {embeddings}, UNNEST(embedding) AS e WITH OFFSET AS pos", "SELECT vec_id, CAST(pos - 1 AS INT) AS pos, CAST(e AS DOUBLE) AS e FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
d("dialect_left_unnest", "SELECT r_regionkey, w FROM {region} LEFT JOIN UNNEST(IF(r_regionkey > 1, SPLIT(r_name, ' '), [])) AS w ON TRUE", "SELECT r_regionkey, unnest(CASE WHEN r_regionkey > 1 THEN string_split(r_name, ' ') ELSE [NULL] END) AS w FROM region")
d("dialect_in_unnest", "SELECT p_partkey FROM {part} WHERE p_size IN UNNEST([3, 7, 11]) AND p_brand NOT IN UNNEST(['Brand#11', 'Brand#22'])", "SELECT p_partkey FROM part WHERE p_size IN (3, 7, 11) AND p_brand NOT IN ('Brand#11', 'Brand#22')")
d("dialect_array_agg", "SELECT c_nationkey, ARRAY_TO_STRING(ARRAY_AGG(c_name ORDER BY c_acctbal DESC, c_custkey LIMIT 3), ';') AS top, ARRAY_LENGTH(ARRAY_AGG(DISTINCT c_mktsegment)) AS segs FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_slice(list(c_name ORDER BY c_acctbal DESC, c_custkey), 1, 3), ';') AS top, len(list(DISTINCT c_mktsegment)) AS segs FROM customer GROUP BY c_nationkey")
d("dialect_string_agg", "SELECT c_nationkey, STRING_AGG(DISTINCT c_mktsegment, '/' ORDER BY c_mktsegment) AS s FROM {customer} GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '/' ORDER BY c_mktsegment) AS s FROM customer GROUP BY c_nationkey")
d("dialect_array_index", "SELECT vec_id, CAST(embedding[OFFSET(0)] AS FLOAT64) AS a, CAST(embedding[ORDINAL(2)] AS FLOAT64) AS b, embedding[SAFE_OFFSET(9999)] IS NULL AS c, ARRAY_LENGTH(embedding) AS n FROM {embeddings}", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, embedding[9999] IS NULL AS c, len(embedding) AS n FROM embeddings")
d("dialect_struct", "SELECT t.s.k AS k, t.s.v AS v FROM (SELECT STRUCT(n_nationkey AS k, n_name AS v) AS s FROM {nation}) AS t WHERE t.s.k < 10", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 10")
d("dialect_array_subquery", "SELECT ARRAY_LENGTH(ARRAY(SELECT n_name FROM {nation} WHERE n_regionkey = 1)) AS n", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
d("dialect_safe_cast", "SELECT doc_id, SAFE_CAST(SUBSTR(source, 4) AS INT64) AS a, SAFE_CAST(source AS INT64) AS b, CAST(doc_id AS STRING) AS c, CAST(doc_id AS FLOAT64) / 4 AS e FROM {documents}", "SELECT doc_id, TRY_CAST(substr(source, 4) AS BIGINT) AS a, TRY_CAST(source AS BIGINT) AS b, CAST(doc_id AS VARCHAR) AS c, CAST(doc_id AS DOUBLE) / 4 AS e FROM documents")
d("dialect_group_order", "SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, COUNT(*) AS n FROM {lineitem} GROUP BY 1) ORDER BY n DESC LIMIT 2", "SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC LIMIT 2")
d("dialect_cte_parameters", "WITH c AS (SELECT c_nationkey AS k, AVG(c_acctbal) AS a FROM {customer} GROUP BY k) SELECT n_name, ROUND(a, 4) AS a FROM c JOIN {nation} ON k = n_nationkey WHERE a > (SELECT AVG(a) FROM c)", "WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY k) SELECT n_name, round(a, 4) AS a FROM c JOIN nation ON k = n_nationkey WHERE a > (SELECT avg(a) FROM c)")

# Strings
d("fn_string_basic", """SELECT c_custkey, UPPER(c_name) AS a, LOWER(c_name) AS b, LENGTH(c_name) AS c, BYTE_LENGTH(c_name) AS e, REVERSE(c_name) AS f, LEFT(c_name, 3) AS g, RIGHT(c_name, 4) AS h, REPEAT('ab', 3) AS i, REPLACE(c_name, '0', 'o') AS j,
CONCAT(c_name, '-', c_mktsegment) AS k, c_name || '!' AS l, TRANSLATE(c_name, '012', 'abc') AS m, INITCAP(LOWER(c_mktsegment)) AS n FROM {customer}""",
"""SELECT c_custkey, upper(c_name) AS a, lower(c_name) AS b, CAST(length(c_name) AS INT) AS c, CAST(strlen(c_name) AS INT) AS e, reverse(c_name) AS f, left(c_name, 3) AS g, right(c_name, 4) AS h, repeat('ab', 3) AS i, replace(c_name, '0', 'o') AS j,
concat(c_name, '-', c_mktsegment) AS k, c_name || '!' AS l, translate(c_name, '012', 'abc') AS m, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS n FROM customer""")
d("fn_string_search", """SELECT p_partkey, STRPOS(p_name, 'a') AS a, INSTR(p_name, 'e') AS b, STARTS_WITH(p_brand, 'Brand#1') AS c, ENDS_WITH(p_brand, '5') AS e, CONTAINS_SUBSTR(p_type, 'brass') AS f, SUBSTR(p_name, 2, 5) AS g, SUBSTR(p_name, -3) AS h, LPAD(p_brand, 12, '*') AS i, RPAD(p_brand, 5) AS j,
TRIM('  x ') AS k, LTRIM('xxa', 'x') AS l, RTRIM('axx', 'x') AS m, EDIT_DISTANCE(p_brand, 'Brand#55') AS n FROM {part}""",
"""SELECT p_partkey, strpos(p_name, 'a') AS a, strpos(p_name, 'e') AS b, starts_with(p_brand, 'Brand#1') AS c, ends_with(p_brand, '5') AS e, contains(lower(p_type), 'brass') AS f, substr(p_name, 2, 5) AS g, right(p_name, 3) AS h, lpad(p_brand, 12, '*') AS i, rpad(p_brand, 5, ' ') AS j,
'x' AS k, 'a' AS l, 'a' AS m, levenshtein(p_brand, 'Brand#55') AS n FROM part""")
d("fn_regexp", r"""SELECT doc_id, REGEXP_CONTAINS(source, r'^src1\d$') AS a, REGEXP_EXTRACT(source, r'src(\d+)') AS b, REGEXP_EXTRACT(source, r'zzz') AS c, REGEXP_REPLACE(source, r'(src)(\d)', r'\2\1') AS e, ARRAY_LENGTH(REGEXP_EXTRACT_ALL(source, r'\d')) AS f FROM {documents}""",
r"""SELECT doc_id, regexp_matches(source, '^src1\d$') AS a, regexp_extract(source, 'src(\d+)', 1) AS b, CAST(NULL AS VARCHAR) AS c, regexp_replace(source, '(src)(\d)', '\2\1') AS e, len(regexp_extract_all(source, '\d')) AS f FROM documents""")
d("fn_split", "SELECT page_id, SPLIT(url, '/')[SAFE_OFFSET(2)] AS host, ARRAY_LENGTH(SPLIT(url, '/')) AS n, ARRAY_TO_STRING(ARRAY_REVERSE(SPLIT(url, '/')), '|') AS r FROM {pages}", "SELECT page_id, string_split(url, '/')[3] AS host, len(string_split(url, '/')) AS n, array_to_string(list_reverse(string_split(url, '/')), '|') AS r FROM pages")
d("fn_code_points", "SELECT n_name, ASCII(n_name) AS a, CHR(65) AS b, CODE_POINTS_TO_STRING(TO_CODE_POINTS(n_name)) AS c, UNICODE('€') AS e, SOUNDEX('Robert') AS f, NORMALIZE('é') AS g FROM {nation}", "SELECT n_name, CAST(ascii(n_name) AS BIGINT) AS a, 'A' AS b, n_name AS c, 8364::BIGINT AS e, 'R163' AS f, nfc_normalize('e' || chr(769)) AS g FROM nation")
d("fn_format", "SELECT o_orderkey, FORMAT('%05d|%s', o_orderkey, o_orderstatus) AS a FROM {orders}", "SELECT o_orderkey, printf('%05d|%s', o_orderkey, o_orderstatus) AS a FROM orders")

# Numbers
d("fn_math", """SELECT l_orderkey, l_linenumber, ABS(l_tax - 0.05) AS a, FLOOR(l_quantity) AS b, CEIL(l_extendedprice) AS c, ROUND(l_extendedprice, 1) AS e, TRUNC(l_extendedprice) AS f, SQRT(l_quantity) AS g, ROUND(POW(l_quantity, 2), 4) AS h, MOD(l_orderkey, 7) AS i, DIV(l_orderkey, 7) AS j, SIGN(l_tax - 0.04) AS k,
ROUND(LN(l_quantity), 9) AS l, ROUND(LOG10(l_quantity), 9) AS m, ROUND(LOG(l_quantity, 2), 9) AS n, ROUND(EXP(l_tax), 9) AS o, ROUND(CBRT(l_quantity), 9) AS p FROM {lineitem}""",
"""SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05::DOUBLE) AS a, floor(l_quantity) AS b, ceil(l_extendedprice) AS c, round(l_extendedprice, 1) AS e, trunc(l_extendedprice) AS f, sqrt(l_quantity) AS g, round(pow(l_quantity, 2), 4) AS h, l_orderkey % 7 AS i, l_orderkey // 7 AS j, CAST(sign(l_tax - 0.04::DOUBLE) AS BIGINT) AS k,
round(ln(l_quantity), 9) AS l, round(log10(l_quantity), 9) AS m, round(log2(l_quantity), 9) AS n, round(exp(l_tax), 9) AS o, round(cbrt(l_quantity), 9) AS p FROM lineitem""")
d("fn_trigonometry", """SELECT l_orderkey, l_linenumber, ROUND(SIN(l_quantity), 9) AS a, ROUND(COS(l_quantity), 9) AS b, ROUND(TAN(l_discount), 9) AS c, ROUND(ASIN(l_discount), 9) AS e, ROUND(ACOS(l_discount), 9) AS f, ROUND(ATAN(l_quantity), 9) AS g, ROUND(ATAN2(l_quantity, l_tax + 1), 9) AS h, ROUND(SINH(l_tax), 9) AS i, ROUND(COSH(l_tax), 9) AS j,
ROUND(TANH(l_tax), 9) AS k, ROUND(ASINH(l_tax), 9) AS l, ROUND(ACOSH(l_tax + 1), 7) AS m, ROUND(ATANH(l_tax), 9) AS n, ROUND(COT(l_quantity), 7) AS o, ROUND(SECH(l_tax), 9) AS p, ROUND(PI(), 9) AS q FROM {lineitem}""",
"""SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS a, round(cos(l_quantity), 9) AS b, round(tan(l_discount), 9) AS c, round(asin(l_discount), 9) AS e, round(acos(l_discount), 9) AS f, round(atan(l_quantity), 9) AS g, round(atan2(l_quantity, l_tax + 1), 9) AS h, round(sinh(l_tax), 9) AS i, round(cosh(l_tax), 9) AS j,
round(tanh(l_tax), 9) AS k, round(asinh(l_tax), 9) AS l, round(acosh(l_tax + 1), 7) AS m, round(atanh(l_tax), 9) AS n, round(cot(l_quantity), 7) AS o, round(1 / cosh(l_tax), 9) AS p, round(pi(), 9) AS q FROM lineitem""")
d("fn_safe_math", """SELECT l_orderkey, l_linenumber, SAFE_DIVIDE(l_quantity, l_linenumber - 1) AS a, SAFE_ADD(l_orderkey + 1, 9223372036854775807) AS b, SAFE_MULTIPLY(l_orderkey, 3) AS c, SAFE_SUBTRACT(l_orderkey, 5) AS e, SAFE_NEGATE(l_orderkey) AS f, IS_INF(IEEE_DIVIDE(1, l_linenumber - 1)) AS g, IS_NAN(IEEE_DIVIDE(0, l_linenumber - 1)) AS h,
GREATEST(l_orderkey, NULLIF(l_linenumber, 2)) AS i, LEAST(l_linenumber, 3) AS j, BIT_COUNT(l_orderkey) AS k, RANGE_BUCKET(l_quantity, [10, 20, 30]) AS l FROM {lineitem}""",
"""SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS a, CAST(NULL AS BIGINT) AS b, l_orderkey * 3 AS c, l_orderkey - 5 AS e, -l_orderkey AS f, l_linenumber = 1 AS g, l_linenumber = 1 AS h,
CASE WHEN l_linenumber = 2 THEN NULL ELSE greatest(l_orderkey, l_linenumber) END AS i, least(l_linenumber, 3) AS j, CAST(bit_count(l_orderkey) AS BIGINT) AS k, CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT AS BIGINT) AS l FROM lineitem""")
d("fn_vector_distance", "SELECT a.vec_id, ROUND(COSINE_DISTANCE(a.embedding, b.embedding), 5) AS c, ROUND(EUCLIDEAN_DISTANCE(a.embedding, b.embedding), 5) AS e FROM {embeddings} AS a CROSS JOIN (SELECT embedding FROM {embeddings} WHERE vec_id = 0) AS b",
"SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS e FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
d("fn_vector_distance_queries", "SELECT a.vec_id, b.vec_id AS query_id, ROUND(COSINE_DISTANCE(a.embedding, b.embedding), 5) AS c, ROUND(EUCLIDEAN_DISTANCE(a.embedding, b.embedding), 5) AS e FROM {embeddings} AS a CROSS JOIN (SELECT vec_id, embedding FROM {embeddings} WHERE MOD(vec_id, 50) = 0) AS b",
"SELECT a.vec_id, b.vec_id AS query_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS e FROM embeddings a CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) b")
d("fn_conditional", "SELECT p_partkey, COALESCE(NULLIF(p_size, 1), 99) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b, IF(p_size > 20, 'big', 'small') AS c, NVL2(NULLIF(p_size, 2), 'x', 'y') AS e, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS f, ZEROIFNULL(NULLIF(p_size, 3)) AS g FROM {part}",
"SELECT p_partkey, coalesce(nullif(p_size, 1), 99) AS a, ifnull(nullif(p_brand, 'Brand#11'), 'none') AS b, if(p_size > 20, 'big', 'small') AS c, CASE WHEN nullif(p_size, 2) IS NOT NULL THEN 'x' ELSE 'y' END AS e, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS f, coalesce(nullif(p_size, 3), 0) AS g FROM part")

# Encoding, hashing, network
d("fn_hash", "SELECT doc_id, TO_HEX(MD5(text)) AS a, TO_HEX(SHA1(text)) AS b, TO_HEX(SHA256(text)) AS c, TO_BASE64(CAST(source AS BYTES)) AS e, CAST(FROM_BASE64(TO_BASE64(CAST(source AS BYTES))) AS STRING) AS f, CAST(FROM_HEX(TO_HEX(CAST(source AS BYTES))) AS STRING) AS g FROM {documents}",
"SELECT doc_id, md5(text) AS a, sha1(text) AS b, sha256(text) AS c, to_base64(source::BLOB) AS e, source AS f, source AS g FROM documents")
d("fn_base32", "SELECT n_nationkey, SAFE_CONVERT_BYTES_TO_STRING(FROM_BASE32(TO_BASE32(CAST(n_name AS BYTES)))) AS a, FARM_FINGERPRINT('1footrue') AS b FROM {nation}", "SELECT n_nationkey, n_name AS a, -1541654101129638711 AS b FROM nation")
d("fn_net_host", "SELECT page_id, NET.HOST(url) AS h, NET.REG_DOMAIN(url) AS r, NET.PUBLIC_SUFFIX(url) AS s FROM {pages}", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS r, regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+)$', 1) AS s FROM pages")
d("fn_net_ip", "SELECT n_nationkey, NET.IP_TO_STRING(NET.IPV4_FROM_INT64(3232235520 + n_nationkey)) AS a, NET.IPV4_TO_INT64(NET.IP_FROM_STRING('10.0.0.1')) AS b, NET.SAFE_IP_FROM_STRING('x') IS NULL AS c, NET.IP_TO_STRING(NET.IP_TRUNC(NET.IP_FROM_STRING('10.1.2.3'), 16)) AS e, NET.IP_IN_NET('10.1.2.3', '10.0.0.0/8') AS f, NET.IP_IS_PRIVATE('8.8.8.8') AS g FROM {nation}",
"SELECT n_nationkey, '192.168.0.' || n_nationkey AS a, 167772161::BIGINT AS b, true AS c, '10.1.0.0' AS e, true AS f, false AS g FROM nation")

# Dates and times
d("fn_date_parts", """SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS da, EXTRACT(DAYOFWEEK FROM o_orderdate) AS dw, EXTRACT(DAYOFYEAR FROM o_orderdate) AS dy, EXTRACT(ISOWEEK FROM o_orderdate) AS iw, EXTRACT(ISOYEAR FROM o_orderdate) AS iy,
EXTRACT(WEEK FROM o_orderdate) AS w, EXTRACT(WEEK(MONDAY) FROM o_orderdate) AS wm FROM {orders}""",
"""SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS da, dayofweek(o_orderdate) + 1 AS dw, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS iw, isoyear(o_orderdate) AS iy,
CAST(strftime(o_orderdate, '%U') AS BIGINT) AS w, CAST(strftime(o_orderdate, '%W') AS BIGINT) AS wm FROM orders""")
d("fn_date_math", """SELECT o_orderkey, CAST(DATE_ADD(DATE(o_orderdate), INTERVAL 10 DAY) AS STRING) AS a, CAST(DATE_SUB(DATE(o_orderdate), INTERVAL 2 MONTH) AS STRING) AS b, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), DAY) AS c, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), MONTH) AS e, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), YEAR) AS f,
CAST(DATE_TRUNC(DATE(o_orderdate), MONTH) AS STRING) AS g, CAST(DATE_TRUNC(DATE(o_orderdate), ISOWEEK) AS STRING) AS h, CAST(LAST_DAY(DATE(o_orderdate)) AS STRING) AS i, UNIX_DATE(DATE(o_orderdate)) AS j, CAST(DATE_FROM_UNIX_DATE(10000) AS STRING) AS k, CAST(DATE_ADD(DATE(o_orderdate), INTERVAL 1 YEAR) AS STRING) AS l FROM {orders}""",
"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS a, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS b, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS c, date_diff('month', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS e, date_diff('year', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS f,
CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS g, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS h, CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS i, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS j, '1997-05-19' AS k, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS VARCHAR) AS l FROM orders""")
d("fn_timestamp_math", """SELECT event_id, TIMESTAMP_DIFF(CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00', HOUR) AS a, UNIX_SECONDS(ts) AS b, UNIX_MILLIS(ts) AS c, FORMAT_TIMESTAMP('%Y-%m-%d %H:%M', DATETIME_TRUNC(ts, HOUR)) AS e, FORMAT_DATETIME('%F %T', DATETIME_ADD(ts, INTERVAL 90 MINUTE)) AS f, FORMAT_DATETIME('%d.%m.%Y', DATETIME_SUB(ts, INTERVAL 3 DAY)) AS g,
FORMAT_DATETIME('%F %R', DATETIME_BUCKET(ts, INTERVAL 15 MINUTE)) AS h, FORMAT_DATETIME('%F', DATETIME_TRUNC(ts, WEEK)) AS i, EXTRACT(HOUR FROM ts) AS j, EXTRACT(MINUTE FROM ts) AS k FROM {events}""",
"""SELECT event_id, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT) AS a, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS b, CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT) AS c, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS e, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS f, strftime(ts - INTERVAL 3 DAY, '%d.%m.%Y') AS g,
strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS h, strftime(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS i, hour(ts) AS j, minute(ts) AS k FROM events""")
d("fn_parse_format", "SELECT o_orderkey, CAST(PARSE_DATE('%Y%m%d', FORMAT_DATE('%Y%m%d', DATE(o_orderdate))) AS STRING) AS a, FORMAT_DATE('%b %Y', DATE(o_orderdate)) AS b, FORMAT_DATETIME('%A', o_orderdate) AS c, CAST(PARSE_TIMESTAMP('%F %T', '2024-02-03 04:05:06') AS STRING) AS e FROM {orders}",
"SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a, strftime(o_orderdate, '%b %Y') AS b, strftime(o_orderdate, '%A') AS c, '2024-02-03 04:05:06' AS e FROM orders")
d("fn_date_arrays", "SELECT n_nationkey, ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE_ADD(DATE '2024-01-01', INTERVAL n_nationkey DAY))) AS a, ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE '2024-01-05', DATE '2024-01-01')) AS b, CAST(GENERATE_DATE_ARRAY(DATE '2024-01-31', DATE '2024-06-30', INTERVAL 1 MONTH)[OFFSET(2)] AS STRING) AS c FROM {nation}",
"SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT) AS a, 0::BIGINT AS b, '2024-03-31' AS c FROM nation")
d("fn_time_bucket_group", "SELECT FORMAT_DATETIME('%F %R', DATETIME_BUCKET(ts, INTERVAL 6 HOUR)) AS b, COUNT(*) AS n, ROUND(AVG(value), 6) AS v FROM {events} GROUP BY b", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS b, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY 1")

# Arrays, JSON, ranges
d("fn_arrays", """SELECT vec_id, ARRAY_LENGTH(ARRAY_CONCAT([1, 2], [3])) AS a, ARRAY_TO_STRING(ARRAY_REVERSE([1, 2, 3]), ',') AS b, ARRAY_TO_STRING(['a', NULL, 'c'], ',', '?') AS c, ARRAY_FIRST([7, 8]) AS e, ARRAY_LAST([7, 8]) AS f, ARRAY_SUM([1, 2, 4]) AS g, ARRAY_AVG([1, 2, 6]) AS h, ARRAY_INCLUDES([1, 2], 2) AS i, ARRAY_INCLUDES_ANY([1], [2]) AS j,
ARRAY_INCLUDES_ALL([1, 2, 3], [3, 1]) AS k, ARRAY_TO_STRING(ARRAY_DISTINCT([1, 1, 2]), ',') AS l, ARRAY_TO_STRING(ARRAY_SLICE([1, 2, 3, 4], 1, 2), ',') AS m, ARRAY_MAX([3, 9, 4]) AS n, ARRAY_MIN([3, 9, 4]) AS o FROM {embeddings}""",
"SELECT vec_id, 3::BIGINT AS a, '3,2,1' AS b, 'a,?,c' AS c, 7 AS e, 8 AS f, 7.0::DOUBLE AS g, 3.0::DOUBLE AS h, true AS i, false AS j, true AS k, '1,2' AS l, '1,2' AS m, 9 AS n, 3 AS o FROM embeddings")
d("fn_json", "SELECT event_id, JSON_VALUE(props, '$.k') AS a, CAST(JSON_VALUE(props, '$.k') AS INT64) AS b, JSON_QUERY(props, '$.zz') AS c, JSON_TYPE(props) AS e, ARRAY_TO_STRING(JSON_KEYS(props), ',') AS f, LAX_INT64(JSON_VALUE(props, '$.k')) AS g, JSON_VALUE(JSON_SET(props, '$.n', 5), '$.n') AS h, JSON_VALUE(JSON_REMOVE(props, '$.k'), '$.k') IS NULL AS i FROM {events}",
"SELECT event_id, props->>'$.k' AS a, CAST(props->>'$.k' AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS c, 'object' AS e, array_to_string(json_keys(props), ',') AS f, CAST(props->>'$.k' AS BIGINT) AS g, '5' AS h, true AS i FROM events")
d("fn_ranges", "SELECT o_orderkey, RANGE_CONTAINS(RANGE<DATE> '[1995-01-01, 1997-01-01)', DATE(o_orderdate)) AS a, RANGE_OVERLAPS(RANGE(DATE(o_orderdate), DATE_ADD(DATE(o_orderdate), INTERVAL 30 DAY)), RANGE<DATE> '[1996-01-01, UNBOUNDED)') AS b, CAST(RANGE_START(RANGE<DATE> '[1995-01-01, 1997-01-01)') AS STRING) AS c, ARRAY_LENGTH(GENERATE_RANGE_ARRAY(RANGE<DATE> '[2024-01-01, 2024-01-10)', INTERVAL 3 DAY)) AS e FROM {orders}",
"SELECT o_orderkey, o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' AS a, CAST(o_orderdate AS DATE) + 30 > DATE '1996-01-01' AS b, '1995-01-01' AS c, 3::BIGINT AS e FROM orders")
d("fn_intervals", "SELECT n_nationkey, JUSTIFY_DAYS(MAKE_INTERVAL(0, 0, 30 + n_nationkey, 0, 0, 0)).months AS a, JUSTIFY_DAYS(MAKE_INTERVAL(0, 0, 30 + n_nationkey, 0, 0, 0)).days AS b, JUSTIFY_HOURS(MAKE_INTERVAL(0, 0, 0, 25, 0, 0)).days AS c FROM {nation}", "SELECT n_nationkey, 1::BIGINT AS a, CAST(n_nationkey AS BIGINT) AS b, 1::BIGINT AS c FROM nation")
d("fn_geography", """SELECT n_nationkey, ROUND(ST_DISTANCE(ST_GEOGPOINT(0, 0), ST_GEOGPOINT(n_nationkey, 0)), 1) AS a, ST_X(ST_GEOGPOINT(n_nationkey, 2)) AS b, ST_Y(ST_GEOGPOINT(1, n_nationkey)) AS c, ST_CONTAINS(ST_GEOGFROMTEXT('POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))'), ST_GEOGPOINT(n_nationkey, 5)) AS e,
ST_DWITHIN(ST_GEOGPOINT(0, 0), ST_GEOGPOINT(0, n_nationkey), 500000) AS f, ST_NUMPOINTS('LINESTRING(0 0, 1 1, 2 2)') AS g, ST_ASTEXT(ST_CENTROID('POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))')) AS h, ST_GEOMETRYTYPE('POINT(1 2)') AS i, ST_DIMENSION('LINESTRING(0 0, 1 1)') AS j FROM {nation}""",
"""SELECT n_nationkey, round(radians(n_nationkey) * 6371008.7714, 1) AS a, CAST(n_nationkey AS DOUBLE) AS b, CAST(n_nationkey AS DOUBLE) AS c, n_nationkey <= 10 AS e, radians(n_nationkey) * 6371008.7714 <= 500000 AS f, 3::BIGINT AS g, 'POINT(1 1)' AS h, 'Point' AS i, 1::BIGINT AS j FROM nation""")

d("fn_geography_shapes", """SELECT p_partkey, ST_ASTEXT(ST_SNAPTOGRID(ST_GEOGPOINT(MOD(p_partkey, 90) + 0.26, 1.5), 0.5)) AS a, ST_TOUCHES('POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))', ST_GEOGPOINT(MOD(p_partkey, 20), 5)) AS b,
ST_X(ST_CLOSESTPOINT('LINESTRING(0 0, 10 0)', ST_GEOGPOINT(MOD(p_partkey, 20), 3))) AS c, ST_ISEMPTY(ST_INTERSECTION('POLYGON((5 0, 9 0, 9 1, 5 1, 5 0))', ST_BOUNDINGBOX(ST_MAKELINE(ST_GEOGPOINT(0, 0), ST_GEOGPOINT(1 + MOD(p_partkey, 20), 1))))) AS e,
LENGTH(ST_ASBINARY(ST_GEOGPOINT(MOD(p_partkey, 7), 1))) AS f, ST_NUMPOINTS(ST_SIMPLIFY(CONCAT('LINESTRING(0 0, 1 ', CAST(MOD(p_partkey, 3) AS STRING), ', 2 0)'), 1000)) AS g FROM {part}""",
"""SELECT p_partkey, concat('POINT(', p_partkey % 90, '.5 1.5)') AS a, p_partkey % 20 IN (0, 10) AS b, CAST(least(p_partkey % 20, 10) AS DOUBLE) AS c, 1 + p_partkey % 20 <= 5 AS e, length(concat('POINT(', p_partkey % 7, ' 1)'))::INTEGER AS f, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS g FROM part""")
d("any_and_all_of_a_list", "SELECT l_orderkey, l_linenumber, l_quantity + 1 = ANY (2, 3, 50) AS a, l_quantity > ALL (10, l_linenumber) AS b, NULLIF(l_linenumber, 1) = ANY (2, 3) AS c FROM {lineitem} WHERE l_suppkey <> ALL (1, 2) AND l_partkey = ANY (SELECT l_partkey FROM {lineitem} WHERE l_linenumber = 2)",
"SELECT l_orderkey, l_linenumber, l_quantity + 1 IN (2, 3, 50) AS a, l_quantity > 10 AND l_quantity > l_linenumber AS b, nullif(l_linenumber, 1) IN (2, 3) AS c FROM lineitem WHERE l_suppkey NOT IN (1, 2) AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)")
d("fn_format_values", "SELECT o_orderkey, FORMAT('%t|%T', o_orderkey, o_orderpriority) AS a, FORMAT('%T', DATE(o_orderdate)) AS b, FORMAT(\"%'d\", o_orderkey * 1000) AS c FROM {orders}",
"SELECT o_orderkey, concat(o_orderkey, '|\"', o_orderpriority, '\"') AS a, concat('DATE \"', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\"') AS b, format('{:,}', o_orderkey * 1000) AS c FROM orders")

d("dialect_recursive_union_distinct", "WITH RECURSIVE halves AS (SELECT c_custkey AS k, c_nationkey AS n FROM {customer} UNION DISTINCT SELECT DIV(k, 2), n FROM halves WHERE k > 0) SELECT n, COUNT(*) AS c, SUM(k) AS s FROM halves GROUP BY n",
"WITH RECURSIVE halves AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_nationkey AS n FROM customer UNION SELECT k // 2, n FROM halves WHERE k > 0) SELECT n, count(*) AS c, CAST(sum(k) AS BIGINT) AS s FROM halves GROUP BY n")

# Aggregates under the dialect's names
d("dialect_aggregates", "SELECT event_type, COUNTIF(value > 0) AS a, LOGICAL_AND(value > -1000) AS b, LOGICAL_OR(value > 1000000) AS c, APPROX_COUNT_DISTINCT(user_id) AS e, ROUND(APPROX_QUANTILES(value, 4)[OFFSET(2)], 6) AS f, ROUND(SUMIF(value, user_id > 5), 4) AS g, ROUND(VAR_SAMP(value), 5) AS h, ROUND(STDDEV_POP(value), 6) AS i FROM {events} GROUP BY event_type",
"SELECT event_type, CAST(count_if(value > 0) AS BIGINT) AS a, bool_and(value > -1000) AS b, bool_or(value > 1000000) AS c, count(DISTINCT user_id) AS e, round(quantile_cont(value, 0.5), 6) AS f, round(sum(value) FILTER (WHERE user_id > 5), 4) AS g, round(var_samp(value), 5) AS h, round(stddev_pop(value), 6) AS i FROM events GROUP BY event_type")
