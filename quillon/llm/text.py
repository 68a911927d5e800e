"""Words, n-gram hashes and anchors of many texts at once, as numpy arrays over Arrow buffers.

A chunk is a run of rows whose texts together hold about CHUNK_BYTES (one longer text makes a chunk of its own). Words are
maximal runs of bytes other than U+0020 and U+0009..U+000D. Hashes are 64 bits wide; two different words, shingles or windows
are taken as equal with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MUL = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOP = U(0xFFFFFFFFFFFFFFFF)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(32))
    x = x * _MUL
    x = x ^ (x >> U(32))
    x = x * _MUL
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i <= n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n + 1, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers


def running_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value[i] * base^i; `span_hash` reads any span's hash from them in one step."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(running))
    return mix((running[end] - running[start]) * q[start] + (end - start).astype(U))


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes and where each text starts (one more offset than rows)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's texts, null as empty, in chunks of about `size` bytes."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, held = column.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield Chunk(first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


@dataclass
class Words:
    """Words of a chunk: hash, first byte, end byte; `doc[i]` is the first word of text i (one more entry than texts)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words(chunk: Chunk, lower: bool, gaps: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that aren't `gaps` (by byte: whether it parts words)."""
    data = _LOWER[chunk.data] if lower else chunk.data
    solid = ~gaps[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    heads = chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]  # a text's first byte starts a word whatever stands before it
    begins[heads] = solid[heads]
    tails = chunk.offsets[1:][chunk.offsets[1:] > 0] - 1
    ends[tails] = solid[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(span_hash(running_hash(_BYTE[data]), start, end), start, end, np.searchsorted(start, chunk.offsets))


def lower_running(chunk: Chunk) -> np.ndarray:
    """Running hash of a chunk's lower-cased bytes; a span of it hashes as the same word does in `words`."""
    return running_hash(_BYTE[_LOWER[chunk.data]])


def ngrams(w: Words, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 words of a text have no n-gram of their own (see `shingles`)."""
    running = running_hash(w.hash)
    at = np.arange(max(0, len(w.hash) - n + 1))
    return span_hash(running, at, at + n)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles, as sorted hashes; a shorter text has its whole sequence as the only one."""
    grams, running, out = ngrams(w, n), None, []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            running = running_hash(w.hash) if running is None else running
            out.append(span_hash(running, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, U))
    return out


def set_hash(x: np.ndarray) -> int:
    """One 64-bit name for a set of hashes, as a signed integer."""
    return int(mix(mix(x).sum(keepdims=True, dtype=U) + U(len(x)))[0].astype(np.int64))


_PLACE = 24  # bits of a position inside one piece; longer inputs are cut into overlapping pieces


def window_minima(values: np.ndarray, width: int, bounds: np.ndarray) -> np.ndarray:
    """Positions of the smallest value (the leftmost among equals) of every `width` consecutive values inside each segment.

    `bounds` holds the segments' starts and the end of the last. The choice depends on a window's values alone, so equal
    windows choose the same place relative to their start. Values are compared by their upper 40 bits. A segment shorter than
    `width` has none.
    """
    n, piece = len(values), (1 << _PLACE) - 1
    if n < width or not n:
        return np.zeros(0, np.int64)
    if n > piece:
        out = []
        for a in range(0, n - width + 1, piece - width):
            b = min(n, a + piece)
            inner = bounds[(bounds > a) & (bounds < b)]
            out.append(window_minima(values[a:b], width, np.concatenate(([0], inner - a, [b - a]))) + a)
        return np.unique(np.concatenate(out))
    blocks = -(-n // width) + 1
    keys = np.full(blocks * width, _TOP, U)
    keys[:n] = (values >> U(_PLACE) << U(_PLACE)) | np.arange(n, dtype=U)
    grid = keys.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1 : n])
    whole = np.ones(len(low), bool)  # windows that lie inside one segment
    for cut in bounds[1:-1].tolist():
        whole[max(0, cut - width + 1) : min(cut, len(whole))] = False
    at = (low[whole] & U(piece)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
