"""Rounded distances of all pairs of vectors, block by block.

``ROUND(COSINE_DISTANCE(a.x, b.y), k)`` over a cross join costs several passes of interpreted lambdas per pair.  Here both
sides are packed into blocks of some hundred rows, the blocks are crossed by Spark, and a pair of blocks is one matrix
product.  The result is bit by bit that of the templates: a value that the order of its sums could round differently, or
that cancels, is summed again in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_ROWS = 512  #: rows of a block at most; a pair of blocks gives at most the square of it at once
BLOCK_BYTES = 1 << 18  #: bytes of a block's rows, unless a single row has more
WAVES = 3  #: tasks per core that the left side is dealt to

#: A double has up to 309 digits before the point.
_HALF_UP = Context(prec=400, rounding=ROUND_HALF_UP)
_PAYLOAD = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.BinaryType)


def suits(kind: T.DataType) -> bool:
    """Whether a column of this type can be measured here."""
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def carries(kind: T.DataType) -> bool:
    """Whether a column of this type can be carried along."""
    return isinstance(kind, _PAYLOAD)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks, each the bytes of an Arrow stream."""
    for batch in batches:
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                # A slice is written with its own rows only.
                writer.write_batch(batch.slice(at, step))
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, shorter ones filled up with zeros, and their lengths; -1 if null or with a null inside."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without what null rows may hide
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    lengths = np.where(np.asarray(column.is_null()), -1, sizes)
    if flat.null_count:
        lengths[np.repeat(np.arange(len(sizes)), sizes)[np.asarray(flat.is_null())]] = -1
        out[lengths < 0] = 0
    return out, lengths


def _in_order(terms: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Sums of one term after the other, as the templates' aggregate makes them."""
    total = np.zeros(n)
    for x in terms:
        total = total + x
    return total


def _squares(m: np.ndarray) -> np.ndarray:
    return _in_order((m[:, k] * m[:, k] for k in range(m.shape[1])), len(m))


def _rounded(x: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """``x`` rounded half up, and where this is not sure."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    # Off by far more than the sums can be; also true of NaN, of infinities and of values with no such digits left.
    sure = np.abs(y - low - 0.5) > 1e-6 + y * 1e-11
    return np.copysign((low + (y - low >= 0.5)) / 10.0**digits, x) + 0.0, ~sure


def _exactly(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded half up on its decimal digits, as Spark's ROUND does."""
    out, open_ = _rounded(x, digits)
    for i in np.flatnonzero(open_):
        v = float(x[i])
        out[i] = v if not np.isfinite(v) else float(_HALF_UP.quantize(Decimal(repr(v)), Decimal(1).scaleb(-digits))) + 0.0
    return out


def _filled(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.concatenate([m, np.zeros((len(m), width - m.shape[1]))], 1)


def _distances(left: pa.Array, right: pa.Array, measures: list[tuple[str, int]], ansi: bool) -> list[pa.Array]:
    """The rounded measures of all pairs of two blocks, the left vector's pairs together."""
    (a, la), (b, lb) = _matrix(left), _matrix(right)
    width = max(a.shape[1], b.shape[1])
    a, b = _filled(a, width), _filled(b, width)
    null = (la[:, None] != lb[None, :]) | (la[:, None] < 0)
    with np.errstate(all="ignore"):
        sa, sb = _squares(a), _squares(b)
        dot = a @ b.T
        scale = sa[:, None] + sb[None, :]
        wild = ~np.isfinite(scale) | (scale > 1e280) | (scale < 1e-280)
        out = []
        for name, digits in measures:
            if name == "COSINE_DISTANCE":
                base = np.sqrt(sa)[:, None] * np.sqrt(sb)[None, :]
                none = (base == 0) & ~null
                if ansi and none.any():
                    raise ZeroDivisionError("[DIVIDE_BY_ZERO] COSINE_DISTANCE of a vector of length 0")
                missing = null | none
                value, open_ = _rounded(1 - dot / base, digits)
                open_ |= (base < 1e-140) | wild
            else:
                missing = null
                square = scale - 2 * dot
                value, open_ = _rounded(np.sqrt(np.maximum(square, 0)), digits)
                open_ |= (square < 0.01 * scale) | wild
            i, j = np.nonzero(open_ & ~missing)
            # As many at a time as a block has rows, so that what is gathered stays as small as the rest.
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                if name == "COSINE_DISTANCE":
                    again = 1 - _in_order((a[p, k] * b[q, k] for k in range(width)), len(p)) / base[p, q]
                else:
                    apart = (a[p, k] - b[q, k] for k in range(width))
                    again = np.sqrt(_in_order((d * d for d in apart), len(p)))
                value[p, q] = _exactly(again, digits)
            out.append(pa.array(value.ravel(), mask=missing.ravel() if missing.any() else None))
    return out


def measured_pairs(left: DataFrame, right: DataFrame, vectors: tuple[str, str], columns: list[tuple[str, str, str]], measures: list[tuple[str, int]]) -> DataFrame:
    """All pairs of rows with some columns of both and rounded distances of one vector column of each.

    ``columns`` are (side, column, name) with side ``a`` or ``b``; the result has these names, then ``_0``, ``_1`` .. for
    ``measures``, which are (function, digits).  The left side is dealt to all cores; each task meets the right side's
    blocks one after the other, so it holds two blocks and what they give.
    """
    spark = left.sparkSession
    frames, kinds = {}, {}
    for side, df, vector in (("a", left, vectors[0]), ("b", right, vectors[1])):
        own = [(c, n) for s, c, n in columns if s == side]
        picked = df.select(*[df[c].alias(f"c{k}") for k, (c, _) in enumerate(own)], df[vector].alias("v"))
        kinds |= {n: picked.schema[f"c{k}"].dataType for k, (_, n) in enumerate(own)}
        frames[side] = picked.mapInArrow(_packed, "block binary")
    order = [(s, sum(x == s for x, _, _ in columns[:k])) for k, (s, _, _) in enumerate(columns)]
    ansi = spark.conf.get("spark.sql.ansi.enabled", "true").lower() == "true"

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda block: pa.ipc.open_stream(block).read_all()
        names = [n for _, _, n in columns] + [f"_{k}" for k in range(len(measures))]
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = (read(s.as_buffer()) for s in (x, y))
                at = {"a": pa.array(np.repeat(np.arange(a.num_rows), b.num_rows)), "b": pa.array(np.tile(np.arange(b.num_rows), a.num_rows))}
                carried = [{"a": a, "b": b}[s].column(f"c{k}").combine_chunks().take(at[s]) for s, k in order]
                yield pa.record_batch(carried + _distances(a.column("v"), b.column("v"), measures, ansi), names=names)

    schema = T.StructType([T.StructField(n, kinds[n]) for _, _, n in columns] + [T.StructField(f"_{k}", T.DoubleType()) for k in range(len(measures))])
    # The numbers of tasks are given, as blocks are few rows that adaptive execution would put into one task.
    blocks = frames["a"].repartition(WAVES * spark.sparkContext.defaultParallelism).withColumnRenamed("block", "a")
    others = frames["b"].repartition(1).withColumnRenamed("block", "b")
    return blocks.crossJoin(others.hint("shuffle_replicate_nl")).mapInArrow(crossed, schema)
