"""Relational operators that Spark's own vocabulary lacks, as compositions of DataFrame operations."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.session import shared_folder

def qualify(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which a predicate over window functions is TRUE (the QUALIFY clause).

    A bare ``row_number() <= k`` is recognised by Spark as a group limit, which prunes before the shuffle.
    """
    flag = "_q" + uuid.uuid4().hex[:8]
    return df.withColumn(flag, predicate).where(F.col(flag)).drop(flag)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; rows are pruned per partition before the exchange."""
    rank = "_r" + uuid.uuid4().hex[:8]
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k).drop(rank)


def star_replace(df: DataFrame, **columns: Column) -> DataFrame:
    """``SELECT * REPLACE (...)``: the same columns in the same order, some computed anew."""
    new = {c.lower(): v for c, v in columns.items()}
    missing = new.keys() - {c.lower() for c in df.columns}
    if missing:
        raise ValueError(f"no such columns to replace: {sorted(missing)}")
    return df.select(*[new[c.lower()].alias(c) if c.lower() in new else df[c] for c in df.columns])


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: int, tie: str | None = None, out: str = "session_no") -> DataFrame:
    """Number each key's sessions from 1; a session ends where the gap to the next row exceeds ``gap_seconds``."""
    w = Window.partitionBy(*keys).orderBy(*([ts, tie] if tie else [ts]))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    fresh = F.coalesce((micros - F.lag(micros).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    mark = "_s" + uuid.uuid4().hex[:8]
    return df.withColumn(mark, fresh.cast("long")).withColumn(out, F.sum(mark).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(mark)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Left rows with the ``values`` of the latest right row of the same keys that is not later.

    Both sides are sorted together once per key (one exchange, no range join): each left row sees the last right row
    before it.  ``right`` should have one row per key and time.
    """
    seen = "_v" + uuid.uuid4().hex[:8]
    side = "_l" + uuid.uuid4().hex[:8]
    rest = [c for c in left.columns if c not in keys and c != ts]
    r = right.select(*keys, ts, F.struct(*values).alias(seen), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias(side))
    a = left.select(*keys, ts, F.lit(None).cast(r.schema[seen].dataType).alias(seen), *rest, F.lit(1).alias(side))
    w = Window.partitionBy(*keys).orderBy(ts, side).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(a).withColumn(seen, F.last(seen, ignorenulls=True).over(w)).where(F.col(side) == 1)
    return both.select(*left.columns, *[F.col(seen)[v].alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of points and half-open ranges [start, end) that contain them, without a nested loop.

    Ranges are copied to each bin of ``width`` they touch, so the join is an equality on bins with a residual test.
    Pick a width near the usual range length; a range of n widths is copied n + 1 times.
    """
    b = "_b" + uuid.uuid4().hex[:8]
    left = points.withColumn(b, F.floor(F.col(at) / width))
    right = ranges.where(F.col(start) < F.col(end)).withColumn(b, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return left.join(right, b).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(b)


def union_by_name(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME: columns are matched by name, missing ones are null."""
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.distinct() if distinct else out


def unnest(df: DataFrame, array: str, alias: str, offset: str | None = None, outer: bool = False) -> DataFrame:
    """Rows of an array column; ``offset`` names the position from 0; struct fields stay in ``alias``."""
    made = (F.posexplode_outer if outer else F.posexplode)(F.col(array)).alias(offset or "_offset", alias)
    out = df.select("*", made)
    return out if offset else out.drop("_offset")


def unnest_zip(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """Several arrays side by side, shorter ones padded with null: {array column: alias}."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    out = df.withColumn("_z", F.explode(zipped))
    return out.select(*df.columns, *[F.col("_z")[a].alias(name) for a, name in arrays.items()])


def sample_rows(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Exactly ``n`` random rows (all, if fewer): a random key and a distributed top-n, not a full sort."""
    key = "_k" + uuid.uuid4().hex[:8]
    return df.withColumn(key, F.rand(seed)).orderBy(key).limit(n).drop(key)


def sample_percent(df: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Each row with probability ``percent`` / 100."""
    return df.sample(False, percent / 100, seed)


def recursive_union(seed: DataFrame, step, limit: int = 500) -> DataFrame:
    """WITH RECURSIVE ... UNION [DISTINCT]: ``step`` maps the newest rows to candidates; known rows are dropped.

    Each round is checkpointed in the shared folder, so the plan stays short.  Stops when a round adds nothing and
    fails after ``limit`` rounds rather than cutting the result off.
    """
    frontier = seed.distinct()
    total = frontier
    for _ in range(limit):
        new = step(frontier).toDF(*total.columns).alias("new")
        known = functools.reduce(lambda a, b: a & b, [F.col(f"new.`{c}`").eqNullSafe(F.col(f"old.`{c}`")) for c in total.columns])
        fresh = new.join(total.alias("old"), known, "left_anti").distinct()
        fresh = _cut(fresh)
        if fresh.isEmpty():
            return total
        total, frontier = total.unionByName(fresh), fresh
    raise RuntimeError(f"recursion did not end within {limit} rounds")


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def assert_all(df: DataFrame, condition: Column, message: str = "assertion failed") -> DataFrame:
    """``df`` itself, failing with ``message`` on the first row whose condition is not TRUE."""
    ok = F.coalesce(condition, F.lit(False))
    return df.where(F.assert_true(ok, F.lit(message)).isNull())
