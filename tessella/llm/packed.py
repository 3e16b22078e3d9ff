"""Vectorised views of a batch of texts, used inside Arrow kernels.

A batch of documents is kept as the UTF-8 bytes of all texts back to back plus
offsets, which is how Arrow holds a string column already. Words, hashes of
words and hashes of any byte range come from a few numpy passes over it.
A null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=U64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i in 0..n, kept for the longest batch so far."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 20)
        up = np.full(size, _BASE, U64)
        down = np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def pack(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of length n + 1) of an Arrow string column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", budget: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch with about ``budget`` text bytes each; a longer text comes alone, whole."""
    _, offsets = pack(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1
        end = min(n, max(end, at + 1))
        yield batch.slice(at, end - at)
        at = end


class Texts:
    """Bytes, words and hashes of a few documents.

    ``data``/``offsets``: bytes and document boundaries. ``starts``/``ends``:
    byte ranges of the words ``[^\\x20\\x09-\\x0D]+``; ``first``: for each
    document the index of its first word, with the number of words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.offsets = pack(texts)
        self.data = _LOWER[self.raw] if lower else self.raw
        self.n = len(self.offsets) - 1
        self._sums: np.ndarray | None = None
        self._words = False

    def _find_words(self) -> None:
        size = len(self.data)
        word = np.zeros(size + 1, bool)
        np.logical_not(SPACE[self.data], out=word[:size])
        before = np.zeros(size + 1, bool)
        before[1:] = word[:-1]
        cut = np.zeros(size + 1, bool)
        cut[self.offsets] = True
        self._starts = np.flatnonzero(word & (~before | cut))
        self._ends = np.flatnonzero(before & (~word | cut))
        self._first = np.searchsorted(self._starts, self.offsets)
        self._words = True

    @property
    def starts(self) -> np.ndarray:
        if not self._words:
            self._find_words()
        return self._starts

    @property
    def ends(self) -> np.ndarray:
        if not self._words:
            self._find_words()
        return self._ends

    @property
    def first(self) -> np.ndarray:
        if not self._words:
            self._find_words()
        return self._first

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hash_ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges [a, b): equal bytes give equal hashes wherever they stand."""
        up, down = _powers(len(self.data))
        if self._sums is None:
            sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTE[self.data] * down[: len(self.data)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[b] - self._sums[a]) * up[a] + (b - a).astype(U64))

    def word_hashes(self) -> np.ndarray:
        return self.hash_ranges(self.starts, self.ends)


def sequence_hashes(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the ranges [a, b) of a sequence of 64-bit symbols."""
    up, down = _powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum(mix(symbols + U64(seed)) * down[: len(symbols)], out=sums[1:])
    return mix((sums[b] - sums[a]) * up[a] + (b - a).astype(U64))


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indices of all n-symbol windows that stay within a document, and their documents."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    starts = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first[:-1], counts)
    return starts, doc


def covered(starts: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in one of the ranges."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(starts + lengths, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges given by ``bounds``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])
