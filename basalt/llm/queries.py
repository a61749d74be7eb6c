"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.ann import nearest
from basalt.llm.common import table
from basalt.llm.decontaminate import find_contamination
from basalt.llm.hilbert import hilbert_shards
from basalt.llm.license_scan import license_digest
from basalt.llm.line_dedup import line_digest
from basalt.llm.minhash import near_duplicates
from basalt.llm.mixing import mix_sources
from basalt.llm.pii import pii_digest
from basalt.llm.quality import quality_digest
from basalt.llm.toxicity import toxicity_digest

#: The metadata dimensions shards are compact in, and their number.
SHARD_DIMS, SHARDS = ["source", "lang", "n_chars"], 40


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), SHARDS, SHARD_DIMS)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_multi_index_hashing, op2_minhash, op3_hilbert_shards, op4_decontamination, op5_toxicity, op6_license_scan, op7_pii, op8_quality, op9_mixing, op10_line_dedup)}

_OP2_SQL = r"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT doc_id, unnest(s) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
l2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l2.b FROM r JOIN l2 ON r.o = l2.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id"""

_OP10_SQL = r"""WITH o AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents),
k AS (SELECT doc_id, ln, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS line FROM o),
d AS (SELECT line, min((doc_id, ln)) AS first, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM k WHERE line <> '' GROUP BY line),
s AS (SELECT line, first, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM d),
p AS (SELECT line, first, len(s) AS n, unnest(s) AS g FROM s),
late AS (SELECT DISTINCT b FROM (SELECT b.line AS b, a.line AS a, count(*) AS i, any_value(a.n) AS x, any_value(b.n) AS y FROM p a JOIN p b ON a.g = b.g AND a.first < b.first GROUP BY 1, 2) WHERE i * 9 >= (x + y) * 4),
j AS (SELECT k.doc_id, k.ln, d.line IS NOT NULL AND (late.b IS NOT NULL OR (k.doc_id, k.ln) <> d.first) AS gone FROM k LEFT JOIN d ON k.line = d.line LEFT JOIN late ON late.b = k.line)
SELECT doc_id, max(ln) + 1 AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(ln::VARCHAR, ',' ORDER BY ln) FILTER (WHERE gone), '') AS removed FROM j GROUP BY doc_id"""

#: The others rest on a model, on Spark's own hashes, or on several patterns with offsets; the tests hold them against
#: brute force instead.
ORACLE_SQL: dict[str, str] = {"op2_minhash": _OP2_SQL, "op10_line_dedup": _OP10_SQL}
