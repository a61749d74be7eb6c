"""Event-time windows, sessions and deduplication over streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_counts(stream: DataFrame, ts: str, width: str, late: str, keys: list[str] | None = None, aggregates: dict[str, Column] | None = None) -> DataFrame:
    """Tumbling buckets of ``width``; a bucket is final once the watermark, ``late`` behind, has passed it."""
    aggregates = aggregates or {"n": F.count("*")}
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *(keys or []))
    return grouped.agg(*[a.alias(n) for n, a in aggregates.items()]).select(F.col("_w.start").alias("bucket"), *(keys or []), *aggregates)


def session_counts(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions per key that end after ``gap`` without a row."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("_s"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "n")


def distinct_events(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first of each set of rows with equal keys; state older than the watermark is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
