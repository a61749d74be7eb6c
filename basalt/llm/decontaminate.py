"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: an occurrence with at most k edits leaves at least
one piece untouched.  One automaton finds all pieces of a block of items in one pass over a text; each hit proposes
where its item would stand, and Myers' bit-parallel recurrence computes the item's exact edit distance to the best
stretch of that window.  Texts and items are compared lower-cased, with runs of blanks as one space.

The items are the query side.  They are taken in blocks of ``BLOCK_CHARS`` characters, each block a pass over the
documents, so neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import mapped

RATE = 0.1  #: edits allowed per character of an item
PASSAGE = 60  #: words; longer items are looked for as passages of this many, half overlapping, and as windows
WINDOW, STRIDE = 40, 11  #: words; windows of a long item and the words between their starts
EXCERPT = WINDOW + STRIDE - 1  #: words; a stretch of a long item of at least this many holds a whole window
LEAST_CHARS = 24  #: shorter items are matched without errors
BLOCK_CHARS = 2_000_000  #: characters of items in one pass

_WORD = re.compile(r"\S+")


def normal(text: str) -> str:
    """Lower-cased text with single spaces."""
    return " ".join(text.split()).lower()


def passages(text: str) -> Iterator[str]:
    """A normalised item, or its half-overlapping passages and its windows if it is long."""
    words = normal(text).split(" ")
    if len(words) <= PASSAGE:
        yield " ".join(words)
        return
    for at in range(0, len(words) - PASSAGE // 2, PASSAGE // 2):
        yield " ".join(words[max(0, min(at, len(words) - PASSAGE)) :][:PASSAGE])
    for at in range(0, len(words) - WINDOW + 1, STRIDE):
        yield " ".join(words[at : at + WINDOW])


def budget(m: int) -> int:
    """The number of edits allowed for ``m`` characters."""
    return int(m * RATE) if m >= LEAST_CHARS else 0


def pieces(pattern: str) -> list[tuple[int, str]]:
    """``budget + 1`` pieces that make up the pattern, with their offsets."""
    m, n = len(pattern), budget(len(pattern)) + 1
    cuts = [i * m // n for i in range(n + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:])]


def halves(pattern: str) -> list[tuple[int, str]]:
    """The pieces cut in two: an edit breaks one half at most, so a match holds all but ``budget`` of them."""
    return [h for at, p in pieces(pattern) for h in ((at, p[: len(p) // 2]), (at + len(p) // 2, p[len(p) // 2 :])) if h[1]]


def plausible(parts: list[tuple[int, str]], text: str, start: int, k: int) -> bool:
    """Whether all but ``k`` parts stand within ``k`` characters of their place in a pattern that begins at ``start``.

    One piece is known to match at ``start``, and ``k`` edits shift no other by more, so no match is lost.
    """
    missing = 0
    for at, part in parts:
        lo = start + at - k
        if text.find(part, lo if lo > 0 else 0, max(0, start + at + len(part) + k)) < 0:
            missing += 1
            if missing > k:
                return False
    return True


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """The smallest edit distance of a pattern to any stretch of ``text``, if at most ``k``, and the stretch's end.

    The leftmost end of those with that distance.  Bit i of the vectors says whether the distance rises (``up``) or
    falls (``down``) from row i to row i + 1 of the current column.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = k + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (full & ~(zero | up))
        right_down = up & zero
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        right_up = right_up << 1 & full  # row 0 costs nothing: an occurrence may begin anywhere
        right_down = right_down << 1 & full
        up = right_down | (full & ~(zero | right_up))
        down = right_up & zero
    return (best, at) if best <= k else None


class Matcher:
    """The automaton and the pattern masks of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.patterns = [(i, p) for i, t in items for p in dict.fromkeys(passages(t)) if p]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, p) in enumerate(self.patterns):
            for at, piece in pieces(p):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), tuple(places)))
        if where:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}
        self.halves = [halves(p) for _, p in self.patterns]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Matches in a normalised text as (item, end, length of the pattern, distance), the best one per item."""
        if not self.patterns:
            return []
        tried: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                item, p = self.patterns[n]
                m = len(p)
                k = budget(m)
                start = end - size + 1 - at
                if not plausible(self.halves[n], text, start, k):
                    continue
                # A window reaches 2 k to either side, so a hit near one that was tried adds nothing.
                done = tried.setdefault(n, set())
                if any(s in done for s in range(start - k, start + k + 1)):
                    continue
                done.add(start)
                if text[max(start, 0) : max(start, 0) + m] == p:
                    hit = (0, max(start, 0) + m)
                else:
                    lo = max(0, start - 2 * k)
                    peq = self.masks.get(n)
                    if peq is None:
                        peq = self.masks[n] = masks(p)
                    found = myers(peq, m, text[lo : start + m + 2 * k], k)
                    if found is None:
                        continue
                    hit = (found[0], lo + found[1])
                if item not in best or hit < best[item][:2]:
                    best[item] = (*hit, m)
        return [(item, e, m, d) for item, (d, e, m) in best.items()]


def _original(text: str, norm: str, at: int) -> int:
    """The position in ``text`` of position ``at`` of its normal form."""
    word, inside = norm.count(" ", 0, at), at - (norm.rfind(" ", 0, at) + 1)
    for i, m in enumerate(_WORD.finditer(text)):
        if i == word:
            return min(m.start() + inside, m.end())
    return len(text)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id", "text").count()
    for r in rows.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _passes(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The blocks of items, in order of their ids within a block."""
    return [sorted(b) for b in _blocks(benchmark)]


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where test items stand in documents: ``doc_id, item_id, start, end, distance``, one row per pair found.

    ``start`` and ``end`` are code points of the original text (of the best occurrence, the leftmost of equals; the
    start is the end less the pattern's length), ``distance`` its edit distance, at most a tenth of the pattern's length.
    The pattern is the whole item; an item of over ``PASSAGE`` words has its passages and windows as patterns, so that
    every verbatim excerpt of it of ``EXCERPT`` (50) words or more is found, and edited ones with few edits in a window.
    Null or blank texts and items match nothing.  Items that share an id are alternatives for it.  Repeated rows of
    ``docs`` are reported each.  No documents or no items give no rows; other columns are ignored.
    """
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start long, end long, distance int"
    found = None
    for items in _passes(benchmark):

        def scan(batches, items=items):
            matcher = Matcher(items)
            for batch in batches:
                ids, rows = batch.column(0), []
                for n, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    if text:
                        norm = normal(text)
                        for item, end, m, d in matcher.find(norm):
                            rows.append((n, item, _original(text, norm, max(0, end - m)), _original(text, norm, end), d))
                picked = pa.array([r[0] for r in rows], pa.int64())
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.record_batch([ids.take(picked), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "start", "end", "distance"])

        one = mapped(docs.select("doc_id", "text"), scan, out)
        found = one if found is None else found.union(one)
    return found if found is not None else docs.sparkSession.createDataFrame([], out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item stands, all columns as they are.

    The test is made in the same pass that copies the rows, so nothing is shuffled; rows that share a ``doc_id`` are
    judged by their own texts.
    """
    at = [c.lower() for c in docs.columns].index("text")
    for items in _passes(benchmark):

        def keep(batches, items=items):
            matcher = Matcher(items)
            for batch in batches:
                clean = [not (t.as_py() and matcher.find(normal(t.as_py()))) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = mapped(docs, keep, docs.schema)
    return docs
