"""Array-at-a-time text helpers for the Arrow-fed operators.

A text column arrives as one byte buffer and an offsets array.  Everything here works on blocks of that buffer, so the
memory a task needs depends on ``BLOCK`` and on the longest single text, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20  #: bytes of text that are expanded into working arrays at once
SHINGLE = 5  #: words in a shingle

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: ASCII letters A-Z go to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The word separators: space and the five control characters from tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
MARKS = np.arange(256) < 128
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together stay within ``limit``; a longer text makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK + 1)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([[_U(1)], np.full(size, _BASE, _U)]), dtype=_U)
                cls.down = np.cumprod(np.concatenate([[_U(1)], np.full(size, _INVERSE, _U)]), dtype=_U)
        return cls.up, cls.down


def located_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, their first bytes and ends in ``data``, and how many words each text has.

    With ``prefixes`` the hashes are a table: the word's, then those of its first so many bytes (the whole word's, if
    it is shorter).
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, _U), none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)  # a text begins (or the block ends) here
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    up, down = _Powers.of(n)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((LOWER[data].astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    if prefixes:
        cuts = [np.minimum(starts + k, ends) for k in prefixes]
        h = np.stack([h, *[mix((total[e] - total[starts]) * down[starts] + _U(1000 + k)) for e, k in zip(cuts, prefixes)]], 1)
    return h, starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of some texts, and how many words each text has.

    A text beyond ``BLOCK`` bytes is cut at separators, so the working arrays stay small unless one word is that long.
    """
    if len(offsets) == 2 and len(data) > BLOCK:
        parts, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and not SPACE[data[end]]:
                step = SPACE[data[end : end + BLOCK]]
                end += int(step.argmax()) if step.any() else len(step)
            parts.append(located_words(data[at:end], np.array([0, end - at]))[0])
            at = end
        h = np.concatenate(parts)
        return h, np.array([len(h)])
    h, _, _, counts = located_words(data, offsets)
    return h, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles, and how many; a shorter text is one shingle of all its words."""
    scale = [_U(pow(_BASE, 3 * j + 1, 1 << 64)) for j in range(size)]
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(words)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, _U), out_counts
    acc = np.zeros(n, _U)
    for j in range(min(size, n)):
        acc[: n - j] += words[j:] * scale[j]
    keep = np.zeros(n, bool)
    long = np.flatnonzero(counts >= size)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first[long], 1)
    np.add.at(step, first[long + 1] - size + 1, -1)
    keep = np.cumsum(step[:-1]) > 0
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:
        a, b = first[i], first[i + 1]
        acc[a] = (int(b - a) + sum(int(words[a + j]) * int(scale[j]) for j in range(b - a))) % (1 << 64)
        keep[a] = True
    return mix(acc[keep]), out_counts


def distinct_sets(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and how many there are."""
    parts, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, c in enumerate(counts.tolist()):
        if c:
            s = np.sort(shingles[at : at + c])
            if c > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            parts.append(s)
            sizes[i] = len(s)
            at += c
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), sizes
