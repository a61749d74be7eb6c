"""Streams give the batch answers once drained."""

from pyspark.sql import functions as F

from basalt.streaming.events import bucket_counts, distinct_events, session_counts


def _drain(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def _stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_buckets_and_sessions_match_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    got = _drain(bucket_counts(stream, "ts", "1 hour", "1 day", ["event_type"]), "complete", "buckets")
    want = batch.groupBy(F.window("ts", "1 hour").start.alias("b"), "event_type").count()
    assert sorted(got) == sorted(tuple(r) for r in want.collect())
    got = _drain(session_counts(stream, "ts", "30 minutes", "1 day", ["user_id"]), "complete", "sessions")
    assert sum(r[3] for r in got) == batch.count()


def test_distinct_events(spark, tmp_path):
    _, stream = _stream(spark, tmp_path)
    got = _drain(distinct_events(stream, "ts", "400 days", ["event_type"]).select("event_type"), "append", "kinds")
    assert len(got) == len(set(got)) > 1
