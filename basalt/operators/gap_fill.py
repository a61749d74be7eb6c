"""GAP_FILL: a regular time grid per partition, with values carried forward, interpolated or left empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_fill(df: DataFrame, ts: str, width_micros: int, values: dict[str, str], keys: list[str] | None = None, origin: str = "1950-01-01") -> DataFrame:
    """Rows for every bucket start between each partition's first and last time: ``*keys, ts, *values``.

    ``values`` maps columns to 'null', 'locf' or 'linear'.  Buckets begin at ``origin``; 'null' takes a row that stands
    exactly on the grid, 'locf' the last value at or before the grid time, 'linear' interpolates between the rows
    around it.  Every input row is kept in the window beside the grid rows, so each partition is sorted once and no
    join is needed.  Several rows at one time: the largest value counts.
    """
    keys = keys or []
    bad = [m for m in values.values() if m.lower() not in ("null", "locf", "linear")]
    if bad:
        raise ValueError(f"unknown fill method {bad[0]!r}")
    kind = df.schema[ts].dataType.simpleString()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    start = micros(F.lit(origin))
    t = df.where(F.col(ts).isNotNull()).groupBy(*keys, micros(F.col(ts)).alias("_t")).agg(*[F.max(v).alias(v) for v in values])
    low = start + F.ceil((F.min("_t") - start) / F.lit(float(width_micros))).cast("long") * width_micros
    high = start + F.floor((F.max("_t") - start) / F.lit(float(width_micros))).cast("long") * width_micros
    spans = t.groupBy(*keys).agg(low.alias("_lo"), high.alias("_hi")).where("_lo <= _hi")
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(width_micros))).alias("_t"), F.lit(True).alias("_g"))
    both = t.withColumn("_g", F.lit(False)).unionByName(grid, allowMissingColumns=True)
    both = both.groupBy(*keys, "_t").agg(F.max("_g").alias("_g"), *[F.max(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy("_t") if keys else Window.orderBy("_t")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)

    def filled(v: str, method: str) -> Column:
        if method == "null":
            return F.col(v)
        last = F.last(F.when(F.col(v).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(v).alias("v"))), ignorenulls=True).over(before)
        if method == "locf":
            return last["v"]
        nxt = F.first(F.when(F.col(v).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(v).alias("v"))), ignorenulls=True).over(after)
        share = (F.col("_t") - last["t"]) / F.nullif(nxt["t"] - last["t"], F.lit(0))
        return F.coalesce(F.col(v).cast("double"), last["v"] + (nxt["v"] - last["v"]) * share)

    out = both.select(*keys, "_t", "_g", *[filled(v, m.lower()).alias(v) for v, m in values.items()]).where("_g")
    return out.select(*keys, F.timestamp_micros("_t").cast(kind).alias(ts), *values)
