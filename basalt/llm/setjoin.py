"""Exact set-similarity join by prefixes, without emitting the pairs of long lists.

A set of ``n`` tokens shares at least ``ceil(t n)`` of them with any set of Jaccard similarity ``t`` percent or more, so
a set that shares fewer with all others together takes no part.  In a common order of the shared tokens, from rare to
common, two similar sets meet under one of the first ``shared - ceil(t n) + 1`` of each.

A list longer than ``LIST`` does not give its pairs.  Its members are compared with one set, the pivot P, and meet again
under the tokens D in which they differ from P, added ones and missing ones.  Two sets A and B have
``|A xor B| = |D(A)| + |D(B)| - 2 |D(A) & D(B)|``, and are similar if that is at most ``c (|A| + |B|)`` with
``c = (1 - t) / (1 + t)``.  Sets that are both similar to P are connected through it; of any other pair one set, say B,
is far from P: ``|D(B)| > c (|B| + |P|)``.  So the pair shares

* more than ``(|D(A)| + c (|P| - |A|)) / 2`` of its differences, seen from A, and
* at least ``(|D(B)| - c (|B| + |P|)) / 2``, and one, seen from B.

Differences that no fitting partner has are struck out; a set left with too few is settled, and of the others a prefix
is posted.  Copies that were edited independently share few differences, so nearly all of a large group settles here.
A list of differences that would give more than ``PAIRS`` pairs goes on to a round with a pivot of its own, in which the
pairs must once more have a far set; it loses its pivot in each round, so the rounds end.  The pairs that differences
give are settled on them at once, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import ONE_TASK, discard, matched, materialize, placed

LIST = 32  #: members of a list up to which all its pairs are looked at
PAIRS = 1 << 14  #: pairs of a list of differences up to which they are looked at
FEW = 4 * ONE_TASK  #: tokens of the sets and their pivots up to which a round stays in one task
FEW_PAIRS = 200_000  #: pairs up to which they are settled in one task
SALT = 512  #: members that meet one copy of their pivot in a join
_ROUNDS = 60  #: of as many rounds back it is known whether a set was far


def least_shared(n: Column, percent: int) -> Column:
    """The tokens that a set of ``n`` shares at least with any similar one."""
    return F.ceil(n * percent / 100).cast("int")


def prefixes(ordered: DataFrame, percent: int, *more: str) -> DataFrame:
    """``id, n, i, tok``: the posted tokens of sets whose ``toks`` are in the common order, and their places."""
    return ordered.select("id", "n", *more, F.posexplode(F.slice("toks", F.lit(1), F.col("n") - least_shared(F.col("n"), percent) + 1)).alias("i", "tok"))


def fits(p: str, q: str, percent: int, size: str = "n") -> Column:
    """The length filter, and the positional one on places ``i`` among ``size`` tokens that can be shared."""
    c = lambda side, name: F.col(f"{side}.{name}")
    both = c(p, "n") + c(q, "n")
    best = F.least(c(p, "i"), c(q, "i")) + F.least(c(p, size) - c(p, "i"), c(q, size) - c(q, "i"))
    return (F.least(c(p, "n"), c(q, "n")) * 100 >= F.greatest(c(p, "n"), c(q, "n")) * percent) & (best * (100 + percent) >= both * percent)


def _ordered(p: str, q: str) -> tuple[Column, Column]:
    return F.least(p, q).alias("a"), F.greatest(p, q).alias("b")


def crowd_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs ``a < b`` among sets given as ``id, toks`` (distinct tokens; a table, read repeatedly).

    Every pair with the similarity is a candidate, or both its sets are similar to one pivot and candidates with it.
    The pivot of a list is its set of smallest ``first``, if that column is given, else the one that shares most.
    Sets of few tokens together stay in one task, and so do rounds of few differences, however many sets there were before.
    """
    size = sets.agg(F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()[0]
    near = lambda df: placed(df, size)
    sets = near(sets)
    given = ["first"] if "first" in sets.columns else []
    tokens = sets.select("id", *given, F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    held = tokens.groupBy("tok").agg(F.count("*").alias("f")).where("f > 1")
    shared = tokens.join(held, "tok").groupBy("id", "n", *given).agg(F.array_sort(F.collect_list(F.struct("f", "tok"))).alias("toks"))
    room = F.size("toks") - least_shared(F.col("n"), percent) + 1
    # ``s`` tokens can be shared at all; positions count among them.  An original shares more than its copies do.
    first = F.col("first") if given else -F.size("toks")
    posts = shared.where(room > 0).select("id", first.alias("first"), "n", F.size("toks").alias("s"), F.posexplode(F.slice("toks", F.lit(1), room)).alias("i", "t"))
    posts = materialize(posts.select("id", "first", "n", "s", "i", F.col("t.tok").alias("tok")))
    posts = near(posts)
    plain = materialize(sets.select("id", F.size("toks").alias("n"), "toks").join(posts.select("id", "first").distinct(), "id"))
    lists = posts.groupBy("tok").agg(F.count("*").alias("f"), F.min(F.struct("first", "id"))["id"].alias("pivot")).where("f > 1")
    met = near(materialize(posts.drop("first").join(lists, "tok")))
    discard(posts)
    p, q = met.where(F.col("f") <= LIST).alias("p"), met.where(F.col("f") <= LIST).alias("q")
    on = (F.col("p.tok") == F.col("q.tok")) & (F.col("p.id") < F.col("q.id")) & fits("p", "q", percent, "s")
    out = [materialize(p.join(q, on).select(*_ordered("p.id", "q.id")).distinct())]
    group = met.where(F.col("f") > LIST).select("id", F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("open"), "pivot")
    group = materialize(group.where("id != pivot").distinct())
    discard(met)
    round_ = 0
    while rows := group.count():
        # What a set and its pivot hold together bounds their differences.  It is asked of every round that can be small,
        # as the last ones of a large join are too.
        weight = _weight(near(group), near(plain)) if rows <= ONE_TASK else FEW + 1
        here = lambda df, weight=weight: placed(df, weight, FEW)
        own = _own_sets(here(group), plain, rows) if size > ONE_TASK and weight <= FEW else plain
        close, posted, kept = _differences(here(group), here(own), percent, weight)
        full = (1 << min(round_ + 1, _ROUNDS)) - 1
        strict = F.col("strict").cast("long")
        count = posted.groupBy("grp", "tok").agg((F.sum(strict) * F.sum(1 - strict)).alias("pairs"), F.count("*").alias("f")).where("pairs > 0")
        met = materialize(posted.join(count, ["grp", "tok"]))
        short = met.where(F.col("pairs") <= PAIRS)
        looked = here(short).agg(F.coalesce(F.sum(F.col("pairs") / F.col("f")), F.lit(0.0))).first()[0] if weight <= FEW else FEW_PAIRS + 1
        few = lambda df, looked=looked: placed(df, looked, FEW_PAIRS)
        # One set by what it must share with a far one, and the far one.
        p, q = (few(short.where(x)).alias(name) for x, name in (("strict", "p"), ("NOT strict", "q")))
        open_ = F.col("p.open").bitwiseOR(F.col("q.open")) == full
        length = F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent
        on = (F.col("p.grp") == F.col("q.grp")) & (F.col("p.tok") == F.col("q.tok")) & (F.col("p.id") != F.col("q.id")) & length & open_
        found = p.join(q, on).select("p.grp", *_ordered("p.id", "q.id"))
        found = few(materialize(found.groupBy("a", "b").agg(F.min("grp").alias("grp"))))
        out += [close, _confirmed(found, kept, percent)]
        discard(group, posted, found, kept, *([own] if own is not plain else []))
        group = materialize(here(met).where(F.col("pairs") > PAIRS).select("id", "grp", "open", "pivot").where("id != pivot").distinct())
        discard(met)
        round_ += 1
    discard(group)
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs.distinct())
    discard(*out, plain)
    return pairs


def _weight(group: DataFrame, plain: DataFrame) -> int:
    """The tokens of the sets in ``group`` and of their pivots, each as often as it is compared."""
    n = plain.select(F.col("id").alias("pivot"), F.col("n").alias("m"))
    return group.select("id", "pivot").join(plain.select("id", "n"), "id").join(n, "pivot").agg(F.coalesce(F.sum(F.col("n") + F.col("m")), F.lit(0))).first()[0]


def _own_sets(group: DataFrame, plain: DataFrame, rows: int) -> DataFrame:
    """A table of the sets in the ``rows`` of ``group`` and of their pivots alone, so that one task reads no others."""
    ids = group.select(F.explode(F.array("id", "pivot")).alias("own")).distinct()
    return materialize(matched(plain, [plain["id"]], ids, ["own"], 2 * rows))


def _confirmed(found: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``found`` (with ``grp``) that are similar, by the differences that both have.

    A large group gives many pairs that share some difference only.  They go here, where a set is its few differences
    from the pivot, so that whole sets travel with similar pairs alone.  One group in which a pair stands decides on it.
    """
    side = lambda x: kept.select("grp", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("d").alias(f"d{x}"), F.transform("toks", lambda t: t["tok"]).alias(f"t{x}"))
    both = found.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    apart = F.col("da") + F.col("db") - 2 * F.size(F.array_intersect("ta", "tb"))
    return materialize(both.where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b"))


def _differences(group: DataFrame, plain: DataFrame, percent: int, weight: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For sets ``id, grp, open`` with a ``pivot``: the pairs similar to it, what is posted of the differences, and these.

    Posted rows are ``id, n, open, grp, tok, pivot, strict``: ``strict`` ones by what a set must share with a far set,
    the others, of far sets only, by what they must share with any.  ``pivot`` is the one of the next round.  The last
    table has per set ``id, grp, n, d`` (the number of its differences) and ``toks``: those it shares in a pair with a
    far set, all of them.  ``weight`` bounds the differences; few stay in one task.
    """
    here = lambda df: placed(df, weight, FEW)
    c100, c200 = 100 - percent, 100 + percent
    # A pivot of many sets is copied, so that its sets meet it in many tasks.
    copies = group.groupBy("pivot").agg(F.ceil(F.count("*") / SALT).cast("int").alias("copies"))
    heads = plain.join(copies, plain["id"] == copies["pivot"]).select("pivot", "copies", F.col("toks").alias("head"), F.explode(F.sequence(F.lit(1), "copies")).alias("salt"))
    dealt = group.join(copies, "pivot").withColumn("salt", F.pmod(F.xxhash64("id"), "copies").cast("int") + 1).drop("copies")
    both = dealt.join(plain, "id").join(heads.drop("copies"), ["pivot", "salt"])
    more, less = F.array_except("toks", "head"), F.array_except("head", "toks")
    both = both.select("id", "first", "n", "pivot", F.xxhash64("grp", "pivot").alias("grp"), "open", F.size("head").alias("m"), F.concat(more, F.transform(less, lambda t: F.xxhash64(t, F.lit("missing")))).alias("differ"))
    both = both.withColumn("d", F.size("differ")).withColumn("far", (F.col("d") * c200 > (F.col("n") + F.col("m")) * c100).cast("int"))
    was = F.shiftleft("open", 1).bitwiseAND((1 << _ROUNDS) - 1)
    both = here(materialize(both.withColumn("open", was.bitwiseOR(F.col("far").cast("long")))))
    near = materialize(both.where("far = 0").select(*_ordered("id", "pivot")).distinct())
    posts = both.select("id", "first", "grp", "far", F.explode("differ").alias("tok"))
    lists = posts.groupBy("grp", "tok").agg(F.count("*").alias("f"), F.sum("far").alias("ff"), F.min(F.struct("first", "id"))["id"].alias("head")).where("f > 1 AND ff > 0")
    kept = posts.select("id", "grp", "tok").join(lists, ["grp", "tok"]).groupBy("id", "grp").agg(F.array_sort(F.collect_list(F.struct("f", "tok", "head", "ff"))).alias("toks"))
    kept = here(materialize(kept.join(both.select("id", "grp", "n", "m", "d", "open", "far"), ["id", "grp"])))
    strict = F.filter("toks", lambda t: t["ff"] > F.col("far"))
    need = F.floor((F.col("d") * c200 + (F.col("m") - F.col("n")) * c100) / (2 * c200)).cast("int") + 1
    weak = F.greatest(F.ceil((F.col("d") * c200 - (F.col("n") + F.col("m")) * c100) / (2 * c200)).cast("int"), F.lit(1))
    own = ["id", "n", "open", "grp"]
    one = kept.withColumn("left", strict).withColumn("room", F.size("left") - need + 1).where("room > 0")
    one = one.select(*own, F.explode(F.slice("left", F.lit(1), F.col("room"))).alias("t"), F.lit(True).alias("strict"))
    two = kept.where("far = 1").withColumn("room", F.size("toks") - weak + 1).where("room > 0")
    two = two.select(*own, F.explode(F.slice("toks", F.lit(1), F.col("room"))).alias("t"), F.lit(False).alias("strict"))
    posted = here(materialize(one.union(two).select(*own, F.col("t.tok").alias("tok"), F.col("t.head").alias("pivot"), "strict")))
    discard(both)
    return near, posted, kept
