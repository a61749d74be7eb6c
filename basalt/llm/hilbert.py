"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut at quantiles into ``2**bits`` bins; a document's bins are a cell of a grid and the cells are
visited in Hilbert order, so a run of neighbouring cells is compact in every dimension and per-file minima and maxima
prune on any of them.  The order along the curve becomes exact ranks without a global sort: counts per cell and
sub-cell give each sub-cell its first rank, and a window inside the sub-cell does the rest.  Only column functions are
used; texts are read once, for their size and checksum, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import fresh

SUBCELL = 4096  #: rows in a sub-cell, unless there are more than SUBCELL * SUBCELLS rows
SUBCELLS = 8192  #: sub-cells at most, beyond one per grid cell; bounds what is broadcast and what one window sees


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """One bin number (0 to ``2**bits - 1``) per dimension, its borders at approximate quantiles.

    Strings are ordered by the seven bytes after the prefix all values share.  Null goes to bin 0.  The driver gets
    one row with ``2**bits - 1`` borders per dimension.
    """
    kinds = dict(df.dtypes)
    words = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(F.lit(0).alias("_"), *[f(d).alias(f"{d}{i}") for d in words for i, f in enumerate((F.min, F.max))]).first()
    skip = {}
    for d in words:
        low, high = (ends[f"{d}0"] or "").encode(), (ends[f"{d}1"] or "").encode()
        skip[d] = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))

    def number(d: str) -> Column:
        if kinds[d] != "string":
            return F.col(d).cast("double")
        tail = F.substring(F.col(d).cast("binary"), skip[d] + 1, 7)
        return F.conv(F.rpad(F.hex(tail), 14, "0"), 16, 10).cast("long").cast("double")

    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    borders = df.agg(*[F.percentile_approx(number(d), F.array(*map(F.lit, steps)), 10_000).alias(str(i)) for i, d in enumerate(dims)]).first()
    out = []
    for i, d in enumerate(dims):
        cuts = [b for b in (borders[i] or []) if b is not None]
        out.append(F.coalesce(sum(((number(d) > F.lit(b)).cast("int") for b in cuts), F.lit(0)), F.lit(0)))
    return out


def hilbert_index(df: DataFrame, coords: list[str], bits: int, out: str) -> DataFrame:
    """Add ``out``, the index along the Hilbert curve through a grid of ``2**bits`` per axis.

    The axes are rotated bit by bit from the top, Gray-coded, and their bits interleaved.  It is one expression over a
    small array; a chain of projections would make the optimizer's constraint sets explode.
    """
    n = len(coords)
    steps = ", ".join(f"named_struct('bit', {1 << b}, 'low', {(1 << b) - 1}, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    axes = f"array({', '.join(f'cast(`{c}` AS int)' for c in coords)})"
    other = "((x[0] ^ x[s.i]) & s.low)"
    on = "((x[s.i] & s.bit) != 0)"
    turned = f"""aggregate(array({steps}), {axes}, (x, s) -> transform(x, (v, j) -> CASE
        WHEN j = 0 THEN v ^ IF({on}, s.low, {other})
        WHEN j = s.i AND NOT {on} THEN v ^ {other} ELSE v END))""" if bits > 1 else axes
    gray = "transform(y, (v, j) -> aggregate(slice(y, 1, j + 1), 0, (a, b) -> a ^ b))"
    levels = ", ".join(map(str, range(bits - 1, -1, -1)))
    flip = f"aggregate(array({levels}), 0, (a, l) -> a ^ IF((z[{n - 1}] & shiftleft(1, l)) != 0, shiftleft(1, l) - 1, 0))"
    woven = f"aggregate(array({levels}), 0L, (a, l) -> aggregate(w, a, (c, v) -> c * 2 + (shiftright(v, l) & 1)))"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    inner = let(f"transform(z, v -> v ^ {flip})", "w", woven)
    return df.withColumn(out, F.expr(let(turned, "y", let(gray, "z", inner))))


def curve_ranks(df: DataFrame, dims: list[str], key: str, bits: int = 4) -> tuple[DataFrame, str, int, str]:
    """``df`` with each row's rank (from 0, gapless) along the curve; the rank's name, the row count, the curve's name.

    Rows of a cell are ordered by a hash of ``key``, then by ``key``.  A cell with very many rows is cut by that hash,
    so the largest window holds about ``max(SUBCELL, rows / SUBCELLS)`` rows.
    """
    qs = fresh(df.columns, *[f"_q{i}" for i in range(len(dims))])
    h, cell, pieces, piece, first, rank = fresh(df.columns + qs, "_h", "_cell", "_pieces", "_piece", "_first", "_rank")
    t = df.withColumns(dict(zip(qs, quantised(df, dims, bits)))).withColumn(h, F.xxhash64(F.col(key).cast("string")))
    counts = t.groupBy(*qs).agg(F.count("*").alias(pieces))
    n = counts.agg(F.sum(pieces)).first()[0] or 0
    target = max(SUBCELL, n // SUBCELLS + 1)
    cells = hilbert_index(counts, qs, bits, cell).withColumn(pieces, F.ceil(F.col(pieces) / target))
    t = t.join(F.broadcast(cells), qs).withColumn(piece, F.pmod(F.col(h), F.col(pieces)))
    runs = t.groupBy(cell, piece).agg(F.count("*").alias(first))  # at most 2**(bits * dims) + SUBCELLS rows
    before = Window.orderBy(cell, piece).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(cell, piece, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(cell, piece).orderBy(h, F.col(key))
    t = t.withColumn(rank, F.row_number().over(within) - 1).join(F.broadcast(runs), [cell, piece])
    return t.withColumn(rank, F.col(first) + F.col(rank)).drop(*qs, h, pieces, piece, first), rank, n, cell


def hilbert_shards(docs: DataFrame, shards: int, dims: list[str], key: str = "doc_id", text: str = "text", bits: int = 4) -> DataFrame:
    """Put every row into one of ``shards`` runs of the curve, row counts at most one apart (the law ``rows``).

    Returns one row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.  ``size``
    is the text's UTF-8 bytes plus 16 (null: 16, checksum of the empty string); ``slot`` counts from 0 in its shard in
    curve order; ``grown_shard`` is null under this law.  Null dimensions and keys are ordered first.  Equal rows are
    all placed, in any order among themselves.  With fewer rows than shards, some shards stay empty; no rows, no
    result rows.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    names = [f"dim{i}" for i in range(len(dims))]
    t = docs.select(F.col(key).alias("doc_id"), *[F.col(d).alias(a) for d, a in zip(dims, names)], (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    t, rank, n, cell = curve_ranks(t, names, "doc_id", bits)
    shard = F.expr(f"({rank} * {shards}L) div {max(n, 1)}L")
    start = F.expr(f"(shard * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    t = t.withColumn("shard", shard).withColumn("slot", (F.col(rank) - start).cast("long"))
    return t.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col(cell).cast("long").alias("curve"))


def sharded_documents(docs: DataFrame, shards: int, dims: list[str], key: str = "doc_id", bits: int = 4) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` added (underscored if taken), ready for ``write.partitionBy``.

    Same placement as :func:`hilbert_shards`; here the rows themselves travel along, once.
    """
    out_shard, out_slot = fresh(docs.columns, "shard", "slot")
    t, rank, n, cell = curve_ranks(docs, dims, key, bits)
    n = max(n, 1)
    t = t.withColumn(out_shard, F.expr(f"cast(({rank} * {shards}L) div {n}L AS int)"))
    t = t.withColumn(out_slot, F.expr(f"{rank} - ({out_shard} * {n}L + {shards - 1}L) div {shards}L"))
    return t.drop(rank, cell)
