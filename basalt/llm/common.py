"""What several operators share: scratch tables in the shared folder, size-checked joins, word counts."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.session import shared_folder

#: Words are runs of bytes other than space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a side may have to be broadcast; beyond it the join is shuffled.  A row here is a few narrow columns.
BROADCAST_ROWS = 200_000
#: Narrow rows (an edge, a token of a set) up to which a table is worked on in one task, without any exchange.
ONE_TASK = 1_000_000
#: Bits of a sieve, the broadcast that stands in for a table of any size.
SIEVE = 1 << 25
_SLOT = 1 << 15  #: bits of a row of the sieve, as bitmap_construct_agg makes them

#: Bytes of rows that a Python worker is handed at once.  Whole texts by the thousand would be tens of megabytes in each task's worker and,
#: outside the heap, in the executor, which does not give them back: the C library keeps freed memory in the threads' arenas.
BATCH_BYTES = 1 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, and what is read survives the loss of any executor.  The shuffle files that went into it are
    of no more use and are removed at once, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/basalt-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def mapped(df: DataFrame, work: Callable, schema: Any) -> DataFrame:
    """``df.mapInArrow(work, schema)`` over batches of about ``BATCH_BYTES``, or of one row that is longer.

    Spark reads the limit when the plan runs, so it stays set in the session; a smaller one that is set already is kept.
    """
    spark = df.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables made by :func:`materialize` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/basalt-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def placed(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """A table read in one task if its counted ``rows`` allow it, so that joins and groupings of it need no exchange.

    Steps over few rows otherwise cost a task per shuffle partition for each exchange.  Beyond the limit it stays as it is.
    """
    return df.coalesce(1) if rows <= (ONE_TASK if limit is None else limit) else df


def sieved(df: DataFrame, key: list[Column], wanted: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among the columns ``names`` of ``wanted``, and those whose surely is not.

    Hashes of the wanted keys are marked in ``SIEVE`` bits, which are broadcast: 4 MB, however many keys there are.  A million of
    them let three in a hundred of the other rows through, so an exact join has to follow.
    """
    slot, bits = fresh(df.columns, "_slot", "_bits")
    spot = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(SIEVE))
    marks = wanted.select(spot(names).alias("at")).groupBy(F.floor(F.col("at") / _SLOT).alias(slot))
    marks = marks.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(_SLOT - 1)).alias(bits))
    joined = df.join(F.broadcast(marks), F.floor(spot(key) / _SLOT) == F.col(slot), "left")
    place = spot(key).bitwiseAND(_SLOT - 1).cast("int")
    byte = F.conv(F.hex(F.substr(F.col(bits), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, place.bitwiseAND(7)) == 1, F.lit(False))
    own = [df[c] for c in df.columns]
    return joined.where(hit).select(*own), joined.where(~hit).select(*own)


def matched(df: DataFrame, key: list[Column], wanted: DataFrame, names: list[str], rows: int, anti: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``key`` is, nulls included, in the columns ``names`` of ``wanted``; with ``anti`` the others.

    ``rows`` is the count of ``wanted``.  If it allows no broadcast, rows that the sieve settles are not shuffled.
    """
    # Keys that cannot be null are joined as they stand, so that a grouping by them needs no other exchange.
    given = [not (f.nullable or wanted.schema[n].nullable) for f, n in zip(df.select(*key).schema, names)]
    on = lambda side: [k == side[n] if plain else k.eqNullSafe(side[n]) for k, n, plain in zip(key, names, given)]
    how = "left_anti" if anti else "left_semi"
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(wanted), on(wanted), how)
    maybe, other = sieved(df, key, wanted, names)
    found = maybe.join(wanted, on(wanted), how)
    return found.union(other) if anti else found


def likely(df: DataFrame, key: list[Column], wanted: DataFrame, names: list[str], rows: int) -> DataFrame:
    """``df`` without rows that the sieve of ``wanted`` settles, for an exact join to follow; all of it if ``rows`` allow a broadcast."""
    return df if rows <= BROADCAST_ROWS else sieved(df, key, wanted, names)[0]


def word_count(text: Column) -> Column:
    """Number of words in a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


#: Characters a text may have to be learnt from; with the sample's limit it bounds what the driver holds.
LEARN_CHARS = 20_000


def _labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """``h, text, label`` of the rows that :func:`labelled_sample` describes, in any order."""
    chosen = labels.where(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = chosen.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(label))).orderBy("h", "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") <= LEARN_CHARS)
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("h").alias("h")).select("h", "text", "label")


def _folded(h: int, text: str, label: int) -> tuple[int, str, int]:
    return int(h >> 20 & 3 == 3), text, int(label > 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> list[tuple[int, str, int]]:
    """At most ``limit`` labelled rows as (fold, text, label), the same ones every time: those of smallest key hash.

    ``learn`` says of ``doc_id`` which rows may be learnt from.  The fold is 1 for a quarter of the rows, else 0.  A
    document labelled twice counts with its larger label, one that stands twice with its smaller text.  Null labels,
    null texts and texts beyond ``LEARN_CHARS`` are passed over.
    """
    return [_folded(*r) for r in _labelled_rows(docs, labels, label, learn, limit).orderBy("h").toLocalIterator()]


def learnt(train: Callable[[list[tuple[int, str, int]]], Any], docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> Any:
    """What ``train`` makes of :func:`labelled_sample`, in one task on an executor.

    The driver gets neither texts nor what training needs beside them, only the pickled result.
    """

    def work(batches):
        sample = [_folded(*r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.record_batch([pa.array([pickle.dumps(train(sample))], pa.binary())], names=["made"])

    rows = _labelled_rows(docs, labels, label, learn, limit).coalesce(1).sortWithinPartitions("h")
    made = mapped(rows, work, "made binary").collect()
    return pickle.loads(made[0].made) if made else train([])


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with underscores added until it clashes (ignoring case) with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
