"""The registry of queries over the reference surface and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables, read lazily."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the DuckDB SQL that must give the same rows."""

    def register(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return register


def sql_query(name: str, spark_sql: str, oracle: str | None = None) -> None:
    """Register a query written in Spark SQL, in which ``{table}`` names a table of the test data.

    Without an oracle of its own the same text, with plain table names, is the oracle.
    """
    used = tuple(t for t in TABLES if "{" + t + "}" in spark_sql)
    plain = spark_sql
    for t in used:
        plain = plain.replace("{" + t + "}", t)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **dict(zip(used, load(spark, sf_dir, *used))))

    query(name, oracle or plain)(run)


def dialect_query(name: str, text: str, oracle: str) -> None:
    """Register a query written in the warehouse dialect, in which ``{table}`` names a table of the test data."""
    used = tuple(t for t in TABLES if "{" + t + "}" in text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from basalt.engine import Engine

        return Engine(spark).sql(text, **dict(zip(used, load(spark, sf_dir, *used))))

    query(name, oracle)(run)


def queries() -> dict[str, Query]:
    from basalt.plans import register_all

    register_all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from basalt.plans import register_all

    register_all()
    return dict(_oracles)
