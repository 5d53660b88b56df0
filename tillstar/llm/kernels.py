"""Vectorised text kernels shared by the corpus operators.

Each works on a whole chunk of documents at once: the UTF-8 bytes of the
chunk laid end to end, plus the offsets of the documents in it. No word or
window ever crosses a document. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Temporary arrays of a chunk take about a hundred times as much.
CHUNK_BYTES = 1 << 19
#: Spans are hashed as polynomials modulo this prime. A modulus of 2^64 has texts
#: that collide for every base (Thue-Morse words of 1,024 letters).
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_BASE = 0x1E3779B97F4A7C15 % _PRIME
_INV = pow(_BASE, -1, _PRIME)
#: Odd multipliers, one for each place in a window.
_STEPS = np.array([pow(0xD1342543DE82EF95, 2 * j + 1, 1 << 64) for j in range(64)], np.uint64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Word bytes by contract: everything but ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes by contract: ASCII digits and small letters, all non-ASCII bytes.
ALNUM_WORDS = np.ones(256, bool)
for _lo, _hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM_WORDS[_lo:_hi + 1] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), so that close inputs spread."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    mid = (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half)
    return _reduce(((ah * bh) << np.uint64(1)) + mid + al * bl)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        out = []
        for base in (_BASE, _INV):
            p, step = np.ones(1, np.uint64), base
            while len(p) < size:
                p = np.concatenate((p, _times(p, np.uint64(step))))
                step = step * step % _PRIME
            out.append(p)
        _TABLES[size] = tuple(out)
    return _TABLES[size]


class Spans:
    """Hashes of spans of ``values`` (below 2^22, 2^33 of them at most)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        pw, self._inv = _powers(n + 1)
        v = values.astype(np.uint64) + np.uint64(1)
        pw = pw[:n]
        high = v * (pw >> np.uint64(32))
        term = _reduce((high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
                       + v * (pw & np.uint64(0xFFFFFFFF)))
        # the sums of both halves fit into 64 bits
        low, high = np.cumsum(term & np.uint64((1 << 31) - 1)), _reduce(np.cumsum(term >> np.uint64(31)))
        self._sum = np.zeros(n + 1, np.uint64)
        self._sum[1:] = _reduce((high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + _reduce(low))

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hash of each span [s, e)."""
        a, b = self._sum[e], self._sum[s]
        return mix(_times(np.where(a >= b, a - b, a + (_P - b)), self._inv[s]))


class Chunk:
    """Some documents: ``data`` (uint8), ``offsets`` (len + 1) and ``rows``,
    the slice of the batch they come from."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows
        self.n = len(offsets) - 1
        self._spans = None

    def lower(self) -> "Chunk":
        return Chunk(_LOWER[self.data], self.offsets, self.rows)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, pos, "right") - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of each word."""
        return self._runs(table[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document) of each non-empty line (split at ``\\n``)."""
        return self._runs(self.data != 10)

    def _runs(self, inside):
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        after = before.copy()
        cut = self.offsets
        before[cut] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        nxt = np.zeros(len(inside) + 1, bool)
        nxt[:-1] = inside
        nxt[cut] = False
        ends = np.flatnonzero(after[1:] & ~nxt[1:]) + 1
        return starts, ends, self.doc_of(starts)

    def hash_spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span [s, e)."""
        if self._spans is None:
            self._spans = Spans(self.data)
        return self._spans.hash(s, e)

    def codes(self, s: np.ndarray, e: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Of all words by ``table``: the different ones and each word's code."""
        offsets = np.concatenate(([0], np.cumsum(e - s))).astype(np.int64)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [
            None, pa.py_buffer(offsets), pa.py_buffer(self.data[table[self.data]].tobytes())])
        coded = text.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def coded_words(self, s: np.ndarray, e: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """:meth:`codes` with the hashes of the different words between, as of
        :meth:`hash_spans`, which don't depend on a span's place."""
        words, code = self.codes(s, e, table)
        if not len(words):
            return words, np.zeros(0, np.uint64), code
        at, data = words.buffers()[1:]
        at = np.frombuffer(at, np.int64)[words.offset:words.offset + len(words) + 1]
        h = Spans(np.frombuffer(data, np.uint8)[:at[-1]]).hash(at[:-1], at[1:])
        return words, h, code

    def hash_words(self, s: np.ndarray, e: np.ndarray, table: np.ndarray) -> np.ndarray:
        """:meth:`hash_spans` of all words by ``table``, each different one hashed once."""
        _, h, code = self.coded_words(s, e, table)
        return h[code]


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The batch's texts in chunks of about ``limit`` bytes; a longer document
    is a chunk of its own, never cut."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if len(text) == 0:
        return
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    buf = text.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(text))
        yield Chunk(data[off[i]:off[j]], off[i:j + 1] - off[i], slice(i, j))
        i = j


def windows(word_hash: np.ndarray, word_doc: np.ndarray, k: int, n_docs: int,
            short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of each window of ``k`` words; with
    ``short`` a document of fewer words, but not none, is one window."""
    m = len(word_hash)
    if m == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    first = np.searchsorted(word_doc, np.arange(n_docs + 1))
    size = np.diff(first)
    at = np.arange(m)
    left = first[1:][word_doc] - at          # words from here to the document's end
    keep = left >= k
    if short:
        keep |= (size[word_doc] < k) & (at == first[:-1][word_doc])
    pos = np.flatnonzero(keep)
    h = word_hash[pos] * _STEPS[0]
    reach = np.minimum(left[pos], k)
    full = bool((reach == k).all())
    for j in range(1, k):
        nxt = word_hash[np.minimum(pos + j, m - 1)] * _STEPS[j % len(_STEPS)] + np.uint64(j)
        h += nxt if full else np.where(reach > j, nxt, np.uint64(0))
    h = mix(h)
    return h, word_doc[pos], pos


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by document, as int64."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)


def sliding_min(key: np.ndarray, span: int) -> np.ndarray:
    """Minimum of ``key[i:i + span]`` for each i that has a whole span."""
    m = len(key)
    if m < span:
        return key[:0]
    blocks = -(-m // span)
    pad = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:m] = key
    left = np.minimum.accumulate(pad.reshape(blocks, span), axis=1).ravel()
    right = np.minimum.accumulate(pad.reshape(blocks, span)[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(m - span + 1)
    return np.minimum(right[start], left[start + span - 1])


def sampled(h: np.ndarray, doc: np.ndarray, span: int, n_docs: int) -> np.ndarray:
    """Places of minimizers: for each ``span`` values in a row in a document its
    least one (the first of equals); of a shorter document the least of all."""
    if not len(h):
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    size = np.diff(first)
    least = sliding_min(key, span)
    start = np.arange(len(least))
    least = least[start + span <= first[1:][doc[start]]]
    few = np.flatnonzero((size > 0) & (size < span))
    ends = np.stack([first[few], first[few] + size[few]], 1).ravel()
    ends = ends[:-1] if len(ends) and ends[-1] == len(key) else ends
    short = np.minimum.reduceat(key, ends)[::2] if len(ends) else key[:0]
    return np.unique(np.concatenate([least, short]) & low).astype(np.int64)
