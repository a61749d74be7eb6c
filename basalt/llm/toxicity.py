"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so tokens get labels first: in toxic training documents a token counts as toxic if nearly
all documents with that word are toxic (a lower confidence bound).  A two-state chain is then trained on those token
labels by its exact gradient.  Scoring runs forward-backward over the tokens of a whole block of texts as one stream in
which a text's first token forgets what came before; the recurrence of the state ratio is a Moebius map, so a stream
is cut into rows, the rows' maps are composed, and all rows advance together.  A small logistic layer, fitted on the
other half of the sample, turns a text's marginals into its score.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import learnt, mapped, remainder
from basalt.llm.textkit import MARKS, blocks, located_words, shingle_hashes, text_buffer, word_hashes

SAMPLE = 6000  #: labelled documents the model is fitted on, at most
PREFIXES = (4, 5, 6)  #: a token's features are its word and its first so many bytes
SEEN = 3  #: training documents a feature must occur in to get a weight
ROW = 64  #: tokens per row when a stream is scanned
Z = 2.0  #: strictness of the bound that labels tokens
STEPS, RATE, SHRINK = 100, 0.3, 1e-5
LEAST = 0.05  #: weights below it are dropped after training


@dataclasses.dataclass
class ChainModel:
    """Weights of the chain (log scale) and of the logistic layer; ``prior`` is the score where nothing was learnt."""

    keys: np.ndarray  # hashes of the features that have a weight, ascending
    weights: np.ndarray
    bias: float = -4.0
    trans: tuple[float, float, float, float] = (0.0, -1.0, 0.0, 0.0)  # 00, 01, 10, 11
    start: float = -1.0
    layer: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float | None = None


def _advance(a, b, c, d, r0: float) -> np.ndarray:
    """All values of r <- (a r + b) / (c r + d) along a stream that begins with ``r0``."""
    n = len(a)
    if n == 0:
        return np.zeros(0)
    rows = -(-n // ROW)
    pad = rows * ROW - n
    grid = [np.concatenate([x, np.full(pad, v)]).reshape(rows, ROW).T.copy() for x, v in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    A, B, C, D = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(ROW):
        p, q, r, s = (g[k] for g in grid)
        A, B, C, D = p * A + q * C, p * B + q * D, r * A + s * C, r * B + s * D
        size = A + B + C + D
        A, B, C, D = A / size, B / size, C / size, D / size
    entry, r = np.empty(rows), r0
    for i, (w, x, y, z) in enumerate(zip(A.tolist(), B.tolist(), C.tolist(), D.tolist())):
        entry[i] = r
        r = (w * r + x) / (y * r + z)
    out = np.empty((ROW, rows))
    for k in range(ROW):
        entry = (grid[0][k] * entry + grid[1][k]) / (grid[2][k] * entry + grid[3][k])
        out[k] = entry
    return out.T.reshape(-1)[:n]


def evidence(model: ChainModel, features: np.ndarray) -> np.ndarray:
    """The summed weights of each token's features (a row of hashes per token)."""
    out = np.zeros(len(features))
    if not len(model.keys):
        return out
    maybe = np.zeros(1 << 16, bool)
    maybe[model.keys >> np.uint32(16)] = True
    for column in features.T:
        some = np.flatnonzero(maybe[column >> np.uint32(16)])
        at = np.minimum(np.searchsorted(model.keys, column[some]), len(model.keys) - 1)
        out[some] += np.where(model.keys[at] == column[some], model.weights[at], 0.0)
    return out


def marginals(model: ChainModel, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(token is toxic) for a stream of tokens with evidence ``u``, ``first`` marking where texts begin.

    Also returns the forward and backward ratios and the emission ratios, which the gradient needs.
    """
    e = np.exp(np.clip(u + model.bias, -20, 20))
    t00, t01, t10, t11 = np.exp(np.clip(model.trans, -8, 8))
    zero, one = np.zeros(len(e)), np.ones(len(e))
    r = _advance(np.where(first, 0.0, e * t11), e * np.where(first, np.exp(model.start), t01), np.where(first, 0.0, t10), np.where(first, 1.0, t00), 0.0)
    last = np.append(first[1:], True)[: len(e)]
    nxt = np.append(e[1:], 1.0)[: len(e)]
    q = _advance(np.where(last, zero, t11 * nxt)[::-1], np.where(last, one, t10)[::-1], np.where(last, zero, t01 * nxt)[::-1], np.where(last, one, t00)[::-1], 1.0)[::-1]
    return r * q / (1 + r * q), r, q, e


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts of a block: feature hashes, first bytes, ends, tokens per text, and where texts begin."""
    h, starts, ends, counts = located_words(data, offsets, MARKS, PREFIXES)
    first = np.zeros(len(h), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return (h >> np.uint64(32)).astype(np.uint32), starts, ends, counts, first


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    parts = [tokenise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)]
    return tuple(np.concatenate([p[i] for p in parts]) for i in (0, 3, 4))


def _thinned(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One text of each group that shares its smallest shingle hash: copies would make their words look toxic."""
    seen, out = set(), []
    for text, y in sample:
        data, offsets = text_buffer(pa.array([text], pa.large_string()))
        s = shingle_hashes(*word_hashes(data, offsets))[0]
        least = int(s.min()) if len(s) else 0
        if least not in seen:
            seen.add(least)
            out.append((text, y))
    return out


def train_chain(sample: list[tuple[int, str, int]]) -> ChainModel:
    """Fit the chain on fold 0 of ``sample`` and the logistic layer on fold 1.

    Without labels the score is 0 everywhere; without both labels in both folds it is the share of label 1.
    """
    model = ChainModel(np.zeros(0, np.uint32), np.zeros(0, np.float32))
    if len({(f, y) for f, _, y in sample}) < 4:
        model.prior = float(np.mean([y for _, _, y in sample])) if sample else 0.0
        return model
    fold = [[(t, y) for f, t, y in sample if f == k] for k in (0, 1)]
    fold[0] = _thinned(fold[0])
    toxic = np.array([y for _, y in fold[0]], float)
    features, counts, first = _stream([t for t, _ in fold[0]])
    edges = np.concatenate([[0], np.cumsum(counts)])
    own = [np.unique(features[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    keys, at = np.unique(np.concatenate(own), return_inverse=True)
    n = np.bincount(at).astype(float)
    share = np.bincount(at, weights=np.repeat(toxic, [len(o) for o in own])) / n
    # Labels for tokens: in a toxic text, a token with a feature that surely occurs mostly in toxic texts.
    bound = (share + Z * Z / (2 * n) - Z * np.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    keep = n >= SEEN
    keys, telling = keys[keep], bound[keep] > 0.5
    index = np.minimum(np.searchsorted(keys, features), len(keys) - 1).astype(np.int32)
    index[keys[index] != features] = len(keys)  # the place of all features without a weight
    del features, own, at
    y = np.append(telling, False)[index].any(1) & (np.repeat(toxic, counts) > 0)
    weights = np.zeros(len(keys) + 1)
    # AdaGrad on the exact gradient, observed minus expected counts, over runs of whole texts.
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], edges[:-1] // 200_000])))
    spans = [(edges[a], edges[b]) for a, b in zip(cuts, [*cuts[1:], len(counts)]) if edges[b] > edges[a]]
    sq_w, sq = np.full(len(weights), 1e-6), np.full(5, 1e-6)
    for step in range(STEPS):
        a, b = spans[step % len(spans)]
        ix, f, t = index[a:b], first[a:b], y[a:b].astype(float)
        p, r, q, e = marginals(model, weights[ix].sum(1), f)
        g_w = np.bincount(ix.ravel(), weights=np.repeat(t - p, ix.shape[1]), minlength=len(weights)) - SHRINK * weights
        g_w[-1] = 0
        # Pairs of neighbours in one text: joint of (before, after) from the forward and backward ratios.
        t00, t01, t10, t11 = np.exp(model.trans)
        inner = ~f[1:]
        rb, qa = r[:-1][inner], (e[1:] * q[1:])[inner]
        joint = np.stack([np.full(len(rb), t00), t01 * qa, t10 * rb, t11 * rb * qa])
        joint /= joint.sum(0)
        before, after = t[:-1][inner], t[1:][inner]
        seen = np.stack([(1 - before) * after, before * (1 - after), before * after])
        g = np.concatenate([(seen - joint[1:]).sum(1), [(t - p).sum(), (t[f] - p[f]).sum()]])
        sq_w += g_w**2
        sq += g**2
        weights += RATE * g_w / np.sqrt(sq_w)
        move = RATE * g / np.sqrt(sq)
        model.trans = (0.0, *(float(np.clip(x + m, -8, 8)) for x, m in zip(model.trans[1:], move)))
        model.bias += float(move[3])
        model.start += float(move[4])
    strong = np.abs(weights[:-1]) >= LEAST
    model.keys, model.weights = keys[strong], weights[:-1][strong].astype(np.float32)
    features, counts, first = _stream([t for t, _ in fold[1]])
    model.layer = _logistic(_features(marginals(model, evidence(model, features), first)[0], counts), np.array([y for _, y in fold[1]], float))
    return model


def _features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal, the log of their sum, and their mean."""
    out = np.zeros((len(counts), 3))
    has = counts > 0
    if has.any():
        begin = (np.cumsum(counts) - counts)[has]
        total = np.add.reduceat(p, begin)
        out[has] = np.stack([np.maximum.reduceat(p, begin), np.log1p(total), total / counts[has]], 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the intercept comes last."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.3 * w)
    return tuple(map(float, w))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions as code point positions."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]


def _score_block(model: ChainModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and toxic spans of the texts of a block."""
    n = len(offsets) - 1
    spans: list[list[dict]] = [[] for _ in range(n)]
    if model.prior is not None:
        return np.full(n, model.prior), spans
    features, starts, ends, counts, first = tokenise(data, offsets)
    p = marginals(model, evidence(model, features), first)[0]
    z = np.concatenate([_features(p, counts), np.ones((n, 1))], 1) @ np.array(model.layer)
    hit = p > 0.5
    head = np.flatnonzero(hit & (first | ~np.append(False, hit)[: len(hit)]))
    tail = np.flatnonzero(hit & np.append(first[1:] | ~hit[1:], True)[: len(hit)])
    owner = np.searchsorted(np.cumsum(counts), head, "right")
    for i in np.unique(owner):
        own = owner == i
        at = _code_points(data[offsets[i] : offsets[i + 1]], np.stack([starts[head[own]], ends[tail[own]]]) - offsets[i])
        best = [float(p[a : b + 1].max()) for a, b in zip(head[own], tail[own])]
        spans[i] = [{"start": int(s), "end": int(e), "p": q} for s, e, q in zip(*at, best)]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def score_toxicity(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text: ``doc_id, score, spans`` with ``spans`` an array of (start, end, p) in code points.

    Learns from at most ``sample`` labelled rows whose crc32 modulo ``parts`` is not ``held``.  A null text counts as
    empty; a wordless text gets the score of a text without toxic tokens.  Repeated rows are scored alike.  No labels:
    score 0.  Empty input gives an empty result; other columns are never read.
    """
    model = learnt(train_chain, docs, labels, "toxic", remainder(F.col("doc_id"), parts) != held, sample)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def score(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                s, spans = _score_block(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(s), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start: bigint, end: bigint, p: double>>"
    return mapped(docs.select("doc_id", "text"), score, out)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, all columns as they are, judged in the pass that copies them."""
    model = learnt(train_chain, docs, labels, "toxic", remainder(F.col("doc_id"), 5) != 0, sample)
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            for a, b in blocks(offsets):
                s, _ = _score_block(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(s < 0.5))

    return mapped(docs, keep, docs.schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held_out, score, predicted, and the number of toxic spans."""
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
