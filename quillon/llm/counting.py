"""Counts of 64-bit keys: summed up inside the tasks, packed by hash bucket for the exchange, merged there bucket by bucket.

A packed row holds the keys of one bucket in ascending order and their counts, both as little-endian bytes, so an exchange moves a
few rows a task instead of one a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .text import U

PACKED = "bucket int, keys binary, n binary"
FLUSH = 1 << 21
BITS = 27  # of a bitmap: 16 MB


def by_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key; buckets ascend with the keys."""
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of what each has."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def batch_of(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows as a batch of the columns that a DDL string names."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    cols = [x.split() for x in names.split(", ")]
    data = list(zip(*rows, strict=True)) if rows else [() for _ in cols]
    return pa.RecordBatch.from_arrays([pa.array(d, kinds[t]) for d, (_, t) in zip(data, cols, strict=True)], [c for c, _ in cols])


def packed(keys: np.ndarray, n: np.ndarray, slot: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Rows (bucket, keys, counts) of ascending keys whose buckets are given."""
    order = np.argsort(slot, kind="stable")
    slot, keys, n = slot[order], keys[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))).tolist() if len(slot) else []
    return [(int(slot[a]), keys[a:b].astype("<u8").tobytes(), n[a:b].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Sums:
    """Counts inside a task. What is added is summed up when it is much, and `full` once many different keys are left."""

    def __init__(self):
        self.raw: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.keys, self.n = 0, np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.raw.append((keys, n))
        self.size += len(keys)
        if self.size >= FLUSH:
            self._fold()

    def _fold(self) -> None:
        if self.raw:
            self.keys, self.n = summed(np.concatenate([self.keys, *(k for k, _ in self.raw)]), np.concatenate([self.n, *(n for _, n in self.raw)]))
            self.raw, self.size = [], 0

    @property
    def full(self) -> bool:
        return len(self.keys) >= FLUSH

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        out = self.keys, self.n
        self.keys, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        return out


def sent(parts: Iterator[tuple[np.ndarray, np.ndarray]], n_buckets: int, slot: Callable = by_hash) -> Iterator[pa.RecordBatch]:
    """Packed rows of a task's (keys, counts)."""
    held = Sums()
    for keys, n in parts:
        held.add(keys, n)
        if held.full:
            keys, n = held.take()
            yield batch_of(packed(keys, n, slot(keys, n_buckets)), PACKED)
    keys, n = held.take()
    yield batch_of(packed(keys, n, slot(keys, n_buckets)), PACKED)


def merged(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """One bucket's number, distinct keys and summed counts."""
    held, bucket = Sums(), None
    for batch in batches:
        for bucket, keys, n in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("n"), strict=True):
            held.add(np.frombuffer(keys.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<i8"))
    return bucket, *held.take()


def frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One bucket's keys with a sum of `least` or more, in rows of at most FLUSH keys."""
    bucket, keys, n = merged(batches)
    keep = n >= least
    keys, n = keys[keep], n[keep]
    for a in range(0, len(keys), FLUSH):
        yield batch_of([(bucket, keys[a : a + FLUSH].tobytes(), n[a : a + FLUSH].tobytes())], PACKED)


def bits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One bucket's keys as bits of a bitmap of 2^width: the bytes that hold one, and their place.

    Buckets follow the keys' order and so the bits', but two of them may share a byte.
    """
    for batch in batches:
        for keys in batch.column("keys"):
            at = (np.frombuffer(keys.as_buffer(), "<u8") >> U(64 - width)).astype(np.int64)
            first, last = int(at[0]) >> 3, int(at[-1]) >> 3
            part = np.zeros((last - first + 1) * 8, np.uint8)
            part[at - first * 8] = 1
            yield batch_of([(first, np.packbits(part).tobytes())], "place long, part binary")


class Bitmap:
    """2^width bits, of which those of given keys are set: a key that isn't set is none of them. Its size doesn't depend on their number."""

    def __init__(self, rows: list, width: int = BITS):
        self.width, self.bytes = width, np.zeros(1 << (width - 3), np.uint8)
        for place, part in rows:
            self.bytes[place : place + len(part)] |= np.frombuffer(part, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> U(64 - self.width)).astype(np.int64)
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
