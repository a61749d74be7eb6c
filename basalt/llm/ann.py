"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

A rotation learned on a bounded sample (PCA, then iterative quantisation) turns each vector into up to 64 signs.  The
code is split into 16-bit substrings and each substring is indexed: two codes within Hamming radius r agree in some
substring up to ``r // substrings`` bits, so probing all those values retrieves every code within r.  Retrieved codes
are checked in full and then ranked by their exact distance.

Equal vectors are one class with its smallest ids (no more of them can ever be among the nearest).  The query side is
taken in blocks of ``QUERY_BLOCK`` vectors; each block is a pass over the index partitions, each of which keeps its
part of the index in memory and returns a bounded list per query.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import materialize

SAMPLE_FLOATS = 1_500_000  #: components of the vectors the rotation is learned on
SAMPLE_ROWS = 20_000
BITS, SUB = 64, 16
TURNS = 40  #: rounds of iterative quantisation
PROBES = 200  #: sample vectors whose true neighbours set the radius
COVERED = 0.99  #: share of those neighbours whose codes lie within the radius
QUERY_BLOCK = 8192

_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


@dataclasses.dataclass
class Codes:
    """What was learned: vectors' dimension, mean, rotation (dimension x bits) and search radius."""

    dim: int
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings, one row per vector; unused high bits are 0."""
        on = (x - self.mean) @ self.turn > 0
        parts = -(-self.bits // SUB)
        padded = np.zeros((len(x), parts * SUB), bool)
        padded[:, : self.bits] = on
        return (padded.reshape(len(x), parts, SUB) * (1 << np.arange(SUB))).sum(2).astype(np.uint16)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Bits in which each row of ``codes`` differs from ``code``."""
    return _POPCOUNT[codes ^ code].sum(1, dtype=np.int64)


def squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances in double precision."""
    d = x.astype(np.float64) - q.astype(np.float64)
    return (d * d).sum(1)


def learn(x: np.ndarray, k: int, seed: int = 11) -> Codes:
    """Learn the rotation from sample vectors and the radius from their true ``k`` neighbours among themselves."""
    n, dim = x.shape
    x = x.astype(np.float64)
    mean = x.mean(0) if n else np.zeros(dim)
    bits = min(BITS, dim)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False) if n > 1 else (0, 0, np.eye(dim))
    if len(vt) < bits:
        vt = np.linalg.qr(np.concatenate([vt, np.eye(dim)]).T)[0].T
    axes = vt[:bits].T
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    p = (x - mean) @ axes
    for _ in range(TURNS if n > 1 else 0):
        u, _, w = np.linalg.svd(np.sign(p @ turn).T @ p, full_matrices=False)
        turn = (u @ w).T
    codes = Codes(dim, mean, axes @ turn, bits)
    if n > k + 1:
        code, seen = codes.encode(x), []
        for i in range(min(n, PROBES)):
            d = squared(x, x[i])
            d[i] = np.inf
            seen.append(hamming(code[np.argpartition(d, k)[:k]], code[i]))
        codes.radius = int(np.quantile(np.concatenate(seen), COVERED, method="higher"))
    return codes


class SubstringIndex:
    """The rows of one partition, indexed by each substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for sub in codes.T:
            order = np.argsort(sub, kind="stable")
            values, first = np.unique(sub[order], return_index=True)
            self.tables.append((values, np.append(first, len(sub)), order))

    @staticmethod
    def masks(radius: int) -> np.ndarray:
        """All 16-bit values with at most ``radius`` bits."""
        return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(SUB), r)], np.uint16)

    def within(self, code: np.ndarray, radius: int, masks: np.ndarray | None) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits: probe each table, then check whole codes.

        ``masks`` are the values to probe with; without them (or with fewer values occupied than there are masks) the
        occupied values are compared instead, which finds the same buckets.
        """
        each = radius // len(self.tables)
        found = np.zeros(len(self.codes), bool)
        for (values, first, order), own in zip(self.tables, code):
            if masks is not None and len(masks) < len(values):
                at = np.minimum(np.searchsorted(values, masks ^ own), len(values) - 1)
                at = at[values[at] == masks ^ own]
            else:
                at = np.flatnonzero(_POPCOUNT[values ^ own] <= each)
            lengths = first[at + 1] - first[at]
            total = int(lengths.sum())
            if total:
                shift = np.repeat(first[at] - (np.cumsum(lengths) - lengths), lengths)
                found[order[np.arange(total) + shift]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(self.codes[rows], code) <= radius]


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null in it, all components finite, not all zero."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(index: DataFrame, queries: list[tuple[int, int, list[float]]], codes: Codes, radius: int, k: int) -> DataFrame:
    """For a block of query classes (two hash halves and a vector): each partition's nearest ``k + 1`` classes."""
    keys = [(h, g) for h, g, _ in queries]
    vectors = np.array([v for _, _, v in queries], np.float64).reshape(len(queries), codes.dim)
    own = codes.encode(vectors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        x, ids = _vectors(rows.column("vec").chunk(0), codes.dim), rows.column("ids").chunk(0)
        table = SubstringIndex(codes.encode(x))
        each = radius // len(table.tables)
        probe = SubstringIndex.masks(each) if each <= 3 else None
        out = []
        for i, (h, g) in enumerate(keys):
            near = table.within(own[i], radius, probe)
            d = squared(x[near], vectors[i])
            if len(d) > k + 1:
                # Ties at the border are all kept: which ids win is decided when the partitions meet.
                keep = d <= np.partition(d, k)[k]
                near, d = near[keep], d[keep]
            out += [(h, g, int(r), float(s)) for r, s in zip(near, np.sqrt(d))]
        if out:
            h, g, r, s = zip(*out)
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(g, pa.int64()), ids.take(pa.array(r)), pa.array(s, pa.float64())], names=["h", "g", "ids", "score"])

    return index.select("vec", "ids").mapInArrow(work, "h long, g long, ids array<long>, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", radius: int | None = None) -> DataFrame:
    """Each query's ``k`` nearest other rows by Euclidean distance: ``query_id, rank, vec_id, score``.

    ``is_query`` selects the queries among the rows; candidates are all rows but the query's own.  Nearest first, ties
    to the smaller id; ``score`` is the distance of the original vectors in double precision.  ``radius`` overrides the
    learned one.  A query that finds fewer than ``k`` within the radius is answered by comparing it with every row.
    Vectors that are null, zero, hold a null or non-finite component, or differ in length from most of the sample take
    no part, nor do rows without an id.  Rows that repeat an id and vector count once.  No usable rows, no result.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q")).distinct()
    rows = rows.withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64("vec", F.lit(1))})
    rows = materialize(rows)
    by_id = Window.partitionBy("h", "g").orderBy("id")
    first = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    classes = materialize(first.groupBy("h", "g").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids")))
    sample = [r.vec for r in classes.orderBy(F.xxhash64("h"), "g").limit(SAMPLE_ROWS).select("vec").toLocalIterator()]
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d)) if lengths else 1
    sample = np.array([v for v in sample if len(v) == dim][: max(k + 2, SAMPLE_FLOATS // dim)], np.float32).reshape(-1, dim)
    codes = learn(sample, k)
    index = classes.where(F.size("vec") == dim)
    asked = rows.where(F.col("q") & (F.size("vec") == dim))
    found = materialize(_in_blocks(index, asked, codes, codes.radius if radius is None else radius, k))
    total = rows.where(F.size("vec") == dim).select("id").limit(k + 1).count()
    few = asked.join(found.where(F.size("top") >= min(k + 1, total)), ["h", "g"], "left_anti")
    if not few.isEmpty():
        again = materialize(_in_blocks(index, few, codes, codes.bits, k))
        found = found.join(again, ["h", "g"], "left_anti").unionByName(again)
    best = asked.select(F.col("id").alias("query_id"), "h", "g").distinct().join(found, ["h", "g"])
    top = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k)
    out = best.select("query_id", F.posexplode(top).alias("rank", "t"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), F.col("t.score").alias("score"))


def _in_blocks(index: DataFrame, asked: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    """``h, g, top`` per query class: its nearest ``k + 1`` rows (id, score), its own among them."""
    hits, block = None, []

    def flush():
        nonlocal hits, block
        if block:
            one = _search(index, block, codes, radius, k)
            hits = one if hits is None else hits.union(one)
            block = []

    for r in asked.groupBy("h", "g").agg(F.first("vec").alias("vec")).toLocalIterator():
        block.append((r.h, r.g, r.vec))
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    if hits is None:
        return index.sparkSession.createDataFrame([], "h long, g long, top array<struct<score: double, id: long>>")
    rank = Window.partitionBy("h", "g").orderBy("score", "id")
    hits = hits.select("h", "g", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    return hits.groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("top"))
