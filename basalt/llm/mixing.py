"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  For a source whose budget is less than it holds, the mix takes the documents
whose hash is below a threshold; the threshold is found by summing tokens per source and per slice of the hash, then
again inside the one slice the budget falls into, until that slice holds a single document.  Each round reads only the
boundary slices.  Nothing is sorted, and a larger budget takes a superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import BROADCAST_ROWS, bounded, discard, fresh, materialize, word_count

BITS = 10  #: hash bits that one round resolves
ROUNDS = 6  #: rounds at most; 60 bits tell any two documents apart


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets per source from its ``source_size``.

    Sources by code point, null last, weigh ``weights`` repeating, and share ``share`` of all sizes by weight; no
    target is above ``most`` times its source's size, and what that cuts off is shared again by weight.  The fixed
    point is found in one pass: sources reach their limit in the order of limit over weight.
    One row per source, so the single-partition windows see that many rows and no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sources.withColumn("_w", w).withColumn("_limit", F.col("source_size") * float(most))
    t = t.withColumn("_all", F.sum("source_size").over(total) * float(share))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_spent", F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
    t = t.withColumn("_left", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # Money per unit of weight for this source and those after it, if all before it stand at their limits.
    t = t.withColumn("_rate", (F.col("_all") - F.col("_spent")) / F.col("_left"))
    t = t.withColumn("_full", F.max((F.col("_limit") > F.col("_w") * F.col("_rate")).cast("int")).over(by_ratio))
    level = F.min(F.when(F.col("_full") == 1, F.col("_rate"))).over(total)
    first = F.first(F.when(F.col("_full") == 1, F.col("_rate")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("_level", F.coalesce(first, level, F.lit(float("inf"))))
    target = F.when(F.col("_full") == 1, F.col("_w") * F.col("_level")).otherwise(F.col("_limit"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def doc_hash(key: Column) -> Column:
    """A 60-bit hash of a document's key."""
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit("mix")), 4)


def mixing_plan(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, int]:
    """What decides a mix: the sized documents, and per source ``source_size, target, passes, lo`` (with their number).

    A document is read ``passes`` times, and once more if its hash is below ``lo``.
    """
    sized = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), doc_hash(F.col(key)).alias("h")))
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    n_sources = sources.count()
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # lo: the hash below which all is taken so far; need: what the boundary slice still owes.
    state = sources.select("source", base.alias("passes"), F.lit(0).cast("long").alias("lo"), (F.col("target") - base * F.col("source_size")).alias("need"), (F.col("source_size") == 0).alias("done"))
    old = []
    for level in range(ROUNDS):
        state = materialize(_refine(sized, state, level, n_sources))
        old.append(state)
        if state.where(~F.col("done")).isEmpty():
            break
    plan = sources.alias("s").join(state.select("source", "passes", "lo").alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "passes", "lo")
    plan = materialize(plan)
    discard(*old, sources)
    return sized, plan, n_sources


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Decide how many words of each document a mix takes.

    Returns one row per row of ``docs``: ``doc_id, size, source_size, target, taken``.  ``taken`` is ``repeats * size``:
    ``floor(target / source_size)`` whole passes over the source and one more pass over the documents below its
    threshold.  A source's total misses its target by at most half of its boundary document.

    Null text counts as empty and a null source as a source of its own, the last.  Rows with an equal key (or a null
    one) hash alike and are taken together.  Empty input gives an empty result; a source without words has target 0.
    Extra columns are ignored.  The same rows always give the same mix, on any number of executors.
    """
    sized, plan, n_sources = mixing_plan(docs, weights, share, most, key, text, source)
    d, p = sized.alias("d"), _join_side(plan, n_sources).alias("p")
    taken = F.col("size") * (F.col("passes") + (F.col("h") < F.col("lo")).cast("long"))
    return d.join(p, F.col("d.source").eqNullSafe(F.col("p.source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _join_side(df: DataFrame, n_sources: int) -> DataFrame:
    """Sources are few in practice and then broadcast; with very many, no source is hot and AQE splits what is."""
    return bounded(df, n_sources, BROADCAST_ROWS)


def _refine(sized: DataFrame, state: DataFrame, level: int, n_sources: int) -> DataFrame:
    """Move each open source's threshold to the slice (of ``BITS`` further hash bits) in which its budget ends."""
    width = 1 << (60 - BITS * (level + 1))
    d, s = sized.alias("d"), _join_side(state.where(~F.col("done")), n_sources).alias("s")
    inside = (F.col("d.source").eqNullSafe(F.col("s.source"))) & (F.col("d.h") >= F.col("s.lo")) & (F.col("d.h") < F.col("s.lo") + width * (1 << BITS))
    slices = d.join(s, inside).groupBy("s.source", "lo", "need", F.floor((F.col("d.h") - F.col("lo")) / F.lit(width)).cast("long").alias("slice")).agg(F.sum("size").alias("tokens"), F.min("d.h").alias("h0"), F.max("d.h").alias("h1"))
    w = Window.partitionBy("source").orderBy("slice")  # at most 2**BITS rows per source
    slices = slices.withColumn("upto", F.sum("tokens").over(w))
    cut = slices.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("slice", "tokens", "upto", "h0", "h1"), "slice").alias("c"))
    s, c = state.alias("s"), cut.alias("c")
    joined = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left")
    rest = F.col("need") - (F.col("c.c.upto") - F.col("c.c.tokens"))
    single = F.col("c.c.h0") == F.col("c.c.h1")  # one hash left: take it if that brings the total nearer
    nearer = F.col("c.c.tokens") - rest < rest
    at = F.col("lo") + F.col("c.c.slice") * width
    past = F.col("lo") + width * (1 << BITS)  # the budget is not exceeded inside: take it all
    open_ = ~F.col("done")
    lo = F.when(~open_, F.col("lo")).when(F.col("c.c").isNull(), past).when(single & nearer, F.col("c.c.h0") + 1).when(single, F.col("c.c.h0")).otherwise(at)
    done = ~open_ | F.col("c.c").isNull() | single
    return joined.select("s.source", "passes", lo.alias("lo"), F.when(open_ & F.col("c.c").isNotNull(), rest).otherwise(F.col("need")).alias("need"), done.alias("done"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix reads it, all columns as they are.

    A row whose document is above its source's threshold is left out; one that is read twice stands twice.  Rows of a
    source without any word are left out.  The rows only pass a filter on their own hash: nothing is shuffled.
    """
    _, plan, n_sources = mixing_plan(docs, weights, share, most, key, text, source)
    name, passes, lo, times = fresh(docs.columns, "_mix_source", "_mix_passes", "_mix_lo", "_mix_times")
    plan = plan.select(F.col("source").alias(name), F.col("passes").alias(passes), F.col("lo").alias(lo))
    read = docs.join(_join_side(plan, n_sources), docs[source].eqNullSafe(F.col(name)))
    read = read.withColumn(times, F.col(passes) + (doc_hash(docs[key]) < F.col(lo)).cast("long")).where(F.col(times) > 0)
    return read.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[docs[c] for c in docs.columns])
