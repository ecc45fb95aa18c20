"""Vectorised access to the words, lines and shingles of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, found in the UTF-8 buffer with NumPy; each
gets a 64-bit hash from prefix sums of two polynomial hashes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_WS = np.zeros(256, bool)
BYTE_WS[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bytes of text handled at once (one longer text is handled alone).
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Powers kept of each multiplier; longer buffers make theirs of these, block by block.
_KEPT = 1 << 21


@lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    r = _MULTIPLIERS[which]
    up, down = np.full(_KEPT, r, np.uint64), np.full(_KEPT, pow(r, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class SpanHasher:
    """Hashes of any byte spans of one buffer in constant time each."""

    def __init__(self, buf: np.ndarray, both: bool = True):
        self.sums = []
        for which in (0, 1) if both else (0,):
            up, down = _powers(which)
            sums = np.zeros(len(buf) + 1, np.uint64)
            for k in range(0, len(buf), _KEPT):
                part = (buf[k : k + _KEPT].astype(np.uint64) + np.uint64(1)) * up[: len(buf) - k]
                if k:
                    part *= np.uint64(pow(_MULTIPLIERS[which], k, 1 << 64))
                    part[:1] += sums[k : k + 1]
                np.cumsum(part, out=sums[k + 1 : k + 1 + len(part)])
            blocks = np.array([pow(_MULTIPLIERS[which], -k, 1 << 64) for k in range(0, len(buf) + 1, _KEPT)], np.uint64)
            self.sums.append((sums, down, blocks))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((end - start).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        for k, (sums, down, blocks) in enumerate(self.sums):
            back = down[start] if len(blocks) == 1 else down[start % _KEPT] * blocks[start // _KEPT]
            out = mix(out * np.uint64(2 * k + 1) ^ ((sums[end] - sums[start]) * back))
        return out


def blocks(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, a, b): spans i to j lie in bytes a to b, about ``_KEPT`` of them or one longer span. Spans ascend and don't overlap."""
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _KEPT, side="right")))
        yield i, j, int(start[i]), int(end[j - 1])
        i = j


def _one_hash(buf: np.ndarray) -> np.ndarray:
    """What SpanHasher gives for all of buf, without sums of each of its bytes."""
    out = mix(np.array([len(buf)], np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for which in (0, 1):
        up, total = _powers(which)[0], 0
        for k in range(0, len(buf), _KEPT):
            part = (buf[k : k + _KEPT].astype(np.uint64) + np.uint64(1)) * up[: len(buf) - k]
            total += int(part.sum(dtype=np.uint64)) * pow(_MULTIPLIERS[which], k, 1 << 64)
        out = mix(out * np.uint64(2 * which + 1) ^ np.uint64(total % (1 << 64)))
    return out


class Texts:
    """Words and lines of a chunk of texts. first[i]:first[i+1] are the words of text i."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        solid = ~BYTE_WS[buf]
        begins = np.zeros(len(buf) + 1, bool)
        begins[offsets] = True
        before = np.zeros(len(buf), bool)
        before[1:] = solid[:-1]
        after = np.zeros(len(buf), bool)
        after[:-1] = solid[1:]
        self.solid = solid
        self.start = np.flatnonzero(solid & (~before | begins[:-1]))
        self.end = np.flatnonzero(solid & (~after | begins[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n_words = np.diff(self.first)
        self._hash = self._spans = None

    @property
    def spans(self) -> SpanHasher:
        if self._spans is None:
            self._spans = SpanHasher(self.buf)
        return self._spans

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hashes(self.start, self.end)
        return self._hash

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ascending spans that don't overlap. A hash is of a span's bytes alone, so a long text's are made block by block."""
        if len(self.buf) <= _KEPT:
            return self.spans(start, end)
        out = np.empty(len(start), np.uint64)
        for i, j, a, b in blocks(start, end):
            out[i:j] = _one_hash(self.buf[a:b]) if b - a > _KEPT else SpanHasher(self.buf[a:b])(start[i:j] - a, end[i:j] - a)
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""(start, end, text) of every \n-split line, empty ones included (a text without \n has one)."""
        cut = np.flatnonzero(self.buf == 10)
        start = np.concatenate([self.offsets[:-1], cut + 1])
        doc = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, side="right") - 1])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        end = np.empty_like(start)
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        end[:-1] = start[1:] - 1
        end[last] = self.offsets[1:][doc[last]]
        return start, end, doc

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of first word) of every run of size words within one text."""
        h = self.hash
        if len(h) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = self.doc_of_word()
        n = len(h) - size + 1
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
        at = np.flatnonzero(doc[:n] == doc[size - 1 :])
        return mix(out[at]), at

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """(hash, bounds): distinct shingles of each text, sorted; with fewer words, its whole sequence as one."""
        h, at = self.windows(size)
        doc = np.searchsorted(self.first, at, side="right") - 1
        few = np.flatnonzero((self.n_words > 0) & (self.n_words < size))
        extra = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            has = self.n_words[few] > k
            extra[has] = extra[has] * np.uint64(0x9FB21C651E98DF25) + self.hash[self.first[few[has]] + k]
        extra = mix(extra ^ self.n_words[few].astype(np.uint64))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, few])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        return h, np.searchsorted(doc, np.arange(self.n + 1))


def large_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    arr = large_text(column)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(begin, end, Texts) over slices of the column of about size bytes; whole texts always stay together."""
    buf, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j, Texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def per_span(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=total[1:], dtype=total.dtype)
    return (total[end] - total[start]).astype(np.int64)


def count_in(table: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span the table of 256 flags has set. Spans ascend and don't overlap."""
    if len(buf) <= _KEPT:
        return per_span(table[buf], start, end)
    out = np.empty(len(start), np.int64)
    for i, j, a, b in blocks(start, end):
        out[i:j] = per_span(table[buf[a:b]], start[i:j] - a, end[i:j] - a)
    return out


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, any): is the key equal to an earlier one of its text; does it occur twice or more in it."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    k, d = keys[order], doc[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    both = same.copy()
    both[:-1] |= same[1:]
    later, twice = np.empty(len(k), bool), np.empty(len(k), bool)
    later[order], twice[order] = same, both
    return later, twice


def repeat_words(texts: Texts, size: int = 3) -> np.ndarray:
    """Flag of each word: is it in a window of size words found twice or more in its text."""
    h, at = texts.windows(size)
    _, twice = repeated(h, np.searchsorted(texts.first, at, side="right") - 1)
    mark = np.zeros(len(texts.start) + 1, np.int64)
    hit = at[twice]
    np.add.at(mark, hit, 1)
    np.add.at(mark, np.minimum(hit + size, len(texts.start)), -1)
    return np.cumsum(mark[:-1]) > 0
