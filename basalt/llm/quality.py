"""Text quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  In a chunk, learned filters slide over embedded bytes and
each keeps its largest response; over the chunks of a text the largest and the mean response are kept, and a logistic
layer combines them into one probability.  Training is plain backpropagation (Adam) on the driver over a bounded
labelled sample; scoring is an Arrow-fed map whose memory is one block of chunks.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import labelled_sample, remainder
from basalt.llm.textkit import blocks, text_buffer

SAMPLE = 4000  #: labelled documents the network is fitted on, at most
CHUNK, STEP = 512, 384  #: bytes in a chunk, and from one chunk to the next
QUAD = 4  #: a filter sees two groups of so many bytes and moves by one group
EMBED, FILTERS = 6, 16
TRAIN_CHUNKS = 4  #: random chunks of a text that one training step looks at
BATCH, RATE, SHRINK = 32, 0.004, 1e-4
STEPS = 700  #: training steps, rounded up to whole passes over the sample
PAD = 256
_SCORE_CHUNKS = 512


@dataclasses.dataclass
class ByteNet:
    """The network's parameters; ``prior`` is the score where nothing was learnt."""

    embed: np.ndarray  # (257, EMBED)
    conv: np.ndarray  # (2 * QUAD * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,)
    shift: np.ndarray  # (1,)
    prior: float | None = None

    @staticmethod
    def new(seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        scale = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        return ByteNet(scale(257, EMBED, s=0.5), scale(2 * QUAD * EMBED, FILTERS, s=0.15), np.zeros(FILTERS, np.float32), scale(2 * FILTERS, s=0.1), np.zeros(1, np.float32))


def chunk_starts(length: int) -> np.ndarray:
    """First bytes of the chunks that cover a text of ``length`` bytes; an empty text has one empty chunk."""
    return np.arange(0, max(length - (CHUNK - STEP), 1), STEP)


def _chunk_table(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of chunks as rows of ``CHUNK`` symbols, padded where a text ends."""
    at = starts[:, None] + np.arange(CHUNK)
    rows = np.full(at.shape, PAD, np.int16)
    inside = at < ends[:, None]
    rows[inside] = data[at[inside]]
    return rows


def _respond(net: ByteNet, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response per chunk (before the bias and the rectifier), and where it is."""
    n = len(rows)
    quads = net.embed[rows].reshape(n, CHUNK // QUAD, QUAD * EMBED)
    half = net.conv.reshape(2, QUAD * EMBED, FILTERS)
    z = (quads @ half[0])[:, :-1] + (quads @ half[1])[:, 1:]
    where = z.argmax(1)
    return np.take_along_axis(z, where[:, None], 1)[:, 0], where


def _pooled(net: ByteNet, best: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    act = np.maximum(best + net.bias, 0)
    begin = np.cumsum(counts) - counts
    return act, np.concatenate([np.maximum.reduceat(act, begin), np.add.reduceat(act, begin) / counts[:, None]], 1)


def train_net(sample: list[tuple[int, str, int]], seed: int = 7) -> ByteNet:
    """Fit a network; with labels of one kind (or none) it gives their share (or 0.5) to every text."""
    net, rng = ByteNet.new(seed), np.random.default_rng(seed)
    y = np.array([v for _, _, v in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.prior = float(y.mean()) if len(y) else 0.5
        return net
    data, offsets = text_buffer(pa.array([t for _, t, _ in sample], pa.large_string()))
    params = [net.embed, net.conv, net.bias, net.top, net.shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, epochs = 0, -(-STEPS * BATCH // len(y))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            picked = [np.sort(rng.permutation(chunk_starts(offsets[d + 1] - offsets[d]))[:TRAIN_CHUNKS]) + offsets[d] for d in docs]
            counts = np.array([len(p) for p in picked])
            owner = np.repeat(np.arange(len(docs)), counts)
            rows = _chunk_table(data, np.concatenate(picked), offsets[docs + 1][owner])
            best, where = _respond(net, rows)
            act, x = _pooled(net, best, counts)
            p = 1 / (1 + np.exp(-(x @ net.top + net.shift)))
            g = (p - y[docs]) / len(docs)
            gx = g[:, None] * net.top
            # The largest response of a text goes to the chunk that has it, the mean to all its chunks.
            top = act >= x[:, :FILTERS][owner]
            ga = (gx[:, :FILTERS][owner] * top + gx[:, FILTERS:][owner] / counts[owner][:, None]) * (act > 0)
            c, f = np.nonzero(ga)
            window = rows[c[:, None], (where[c, f] * QUAD)[:, None] + np.arange(2 * QUAD)]
            seen = net.embed[window].reshape(len(c), -1)
            gw = np.zeros_like(net.conv)
            for k in range(FILTERS):
                own = f == k
                gw[:, k] = ga[c[own], k] @ seen[own]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, window.ravel(), (ga[c, f][:, None] * net.conv.T[f]).reshape(-1, EMBED))
            grads = [ge, gw + SHRINK * net.conv, ga.sum(0), x.T @ g + SHRINK * net.top, np.array([g.sum()])]
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, d, a, b in zip(params, grads, m, v):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def score_block(net: ByteNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities for the texts of a block."""
    n = len(offsets) - 1
    if net.prior is not None:
        return np.full(n, net.prior)
    starts = [chunk_starts(int(b - a)) + a for a, b in zip(offsets[:-1], offsets[1:])]
    counts = np.array([len(s) for s in starts])
    begin, end = np.concatenate(starts), np.repeat(offsets[1:], counts)
    best = np.concatenate([_respond(net, _chunk_table(data, begin[i : i + _SCORE_CHUNKS], end[i : i + _SCORE_CHUNKS]))[0] for i in range(0, len(begin), _SCORE_CHUNKS)])
    x = _pooled(net, best, counts)[1]
    return 1 / (1 + np.exp(-np.clip(x @ net.top + net.shift, -30, 30).astype(np.float64)))


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text: ``doc_id, score``, the higher the likelier quality label 1.

    Learns from at most ``sample`` labelled rows whose crc32 modulo ``parts`` is not ``held``.  A null text counts as
    empty; an empty text is scored as one chunk of padding.  Repeated rows are scored alike.  No labels: score 0.5.
    Empty input gives an empty result; other columns are never read.
    """
    net = train_net(labelled_sample(docs, labels, "quality", remainder(F.col("doc_id"), parts) != held, sample))

    def score(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                s = score_block(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted."""
    return score_quality(docs, labels).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
