"""Words and word hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. Hashes have 64 bits; everything here
works on one Arrow batch inside a task, cut into chunks of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from barlight.llm.process import kept

CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        x = np.full(n, b, dtype=U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=U))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    return kept(("powers", size), lambda: _powers(size)) if size <= 1 << 24 else _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


class Scan:
    """Of a chunk of texts: data (bytes), off (of each text), start and end (bytes of each word), tok_off (words of each text)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.off = off
        n = len(data)
        word = (data != 32) & ((data < 9) | (data > 13))
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            after[-1] = False
            after[:-1] = word[1:]
            first = off[:-1][off[:-1] < n]
            before[first] = False
            after[first[first > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.tok_off = np.searchsorted(self.start, off)

    @property
    def docs(self) -> int:
        return len(self.off) - 1

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.tok_off))

    def word_hashes(self) -> np.ndarray:
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, dtype=U)
        p, inverse = powers(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((self.data.astype(U) + U(1)) * p[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))

    def code_points(self) -> np.ndarray:
        """Before each byte position: the number of code points in the chunk."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, Scan]]:
    """(first row, row after the last, Scan) of runs of rows of about size bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        to = min(to, n)
        yield at, to, Scan(data[off[at] : off[to]], off[at : to + 1] - off[at], lower)
        at = to


def grams(hashes: np.ndarray, tok_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the text of each. A text of 1 to k-1 words has one gram, of all its words."""
    n = len(hashes)
    size = np.diff(tok_off)
    value = np.zeros(n, dtype=U)
    for j in range(k):
        value[: n - j] += mix(hashes[j:] + U(j + 1)) * U(2 * j + 3) if n > j else U(0)
    doc = np.repeat(np.arange(len(size)), size)
    left = tok_off[1:][doc] - np.arange(n)
    whole = left >= k
    short = (size > 0) & (size < k)
    if short.any():
        at = tok_off[:-1][short]
        for i, s in zip(at, size[short], strict=True):
            v = U(0)
            with np.errstate(over="ignore"):
                for j in range(s):
                    v = v + mix(hashes[i + j : i + j + 1] + U(j + 1))[0] * U(2 * j + 3)
            value[i] = v
        whole[at] = True
    return mix(value[whole]), doc[whole]
