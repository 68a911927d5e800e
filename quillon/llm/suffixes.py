"""Substring deduplication over bytes with a common-prefix interval tree.

The occurrences that meet at an anchor (see `anchors`) are a sparse enhanced suffix array: their right contexts are sorted, with
the lengths of common prefixes of neighbours, and one stack scan lists the prefix intervals, each the set of all occurrences that
agree over its depth. Inside an interval the members are ordered by what stands to their left: where neighbours in that order
differ at once the interval is left-diverse there, and otherwise they share more, so the longest stretch that each member has in
common with any other is the depth and the longer of its two left agreements. Stretches of at least the window's length are
maximal repeats, and every one of their occurrences is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NO_ID, Rule, keyed, span_arrays, spans, with_spans
from .shared import Shelf
from .text import chunks

PIECE = 1 << 19  # (interval, member) pairs that are held at once


def rule(window: int) -> Rule:
    return Rule(by_words=False, window=window, gram=max(4, min(16, window // 4)), keep_first=False)


def encode(values: np.ndarray) -> np.ndarray:
    return values


def rows_of(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """A matrix of bytes: row i reads `length[i]` bytes from `start[i]` on, forwards or (step -1) backwards, then zeros."""
    out = np.zeros((len(start), width), np.uint8)
    for j in range(width):
        has = np.flatnonzero(length > j)
        out[has, j] = data[start[has] + j * step]
    return out


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows, `most` at most."""
    differ = a != b
    first = differ.argmax(1)
    return np.minimum(np.where(differ[np.arange(len(a)), first], first, a.shape[1]), most)


def intervals(prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Prefix intervals (first, last, depth) of an enhanced suffix array; prefix[i] belongs to rows i and i + 1, below 1: apart."""
    stack: list[tuple[int, int]] = []  # (first row, depth)
    for i, depth in enumerate([*prefix.tolist(), 0]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            yield first, i, d
        if depth > 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def repeats(group: np.ndarray, left: np.ndarray, left_n: np.ndarray, right: np.ndarray, right_n: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members of maximal repeats of `window` bytes or more, as (row, bytes shared to the left, bytes shared to the right)."""
    order = np.lexsort((right_n, right.view(f"S{right.shape[1]}").ravel(), group))
    g, r, n = group[order], right[order], right_n[order]
    prefix = np.where(g[1:] == g[:-1], common(r[:-1], r[1:], np.minimum(n[1:], n[:-1])), 0)
    rank = np.empty(len(order), np.int64)
    rank[np.argsort(left.view(f"S{left.shape[1]}").ravel(), kind="stable")] = np.arange(len(order))
    found: list[tuple[int, int, int]] = []
    size = 0
    for x in intervals(prefix):
        if x[2] + left.shape[1] < window:
            continue
        found.append(x)
        size += x[1] - x[0] + 1
        if size >= PIECE:
            yield from _members(found, order, rank, left, left_n, window)
            found, size = [], 0
    if found:
        yield from _members(found, order, rank, left, left_n, window)


def _members(found: list[tuple[int, int, int]], order: np.ndarray, rank: np.ndarray, left: np.ndarray, left_n: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    first, last, depth = np.array(found).T
    count = last - first + 1
    which = np.repeat(np.arange(len(count)), count)
    row = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]]
    by = np.lexsort((left_n[row], rank[row], which))
    which, row = which[by], row[by]
    shared = np.zeros(len(row), np.int64)
    for a in range(0, len(row) - 1, 1 << 16):  # neighbours in the order of what stands to the left
        b = min(len(row) - 1, a + (1 << 16))
        x, y = row[a:b], row[a + 1 : b + 1]
        both = np.where(which[a:b] == which[a + 1 : b + 1], common(left[x], left[y], np.minimum(left_n[x], left_n[y])), 0)
        shared[a:b] = np.maximum(shared[a:b], both)
        shared[a + 1 : b + 1] = np.maximum(shared[a + 1 : b + 1], both)
    hit = depth[which] + shared >= window
    yield row[hit], shared[hit], depth[which][hit]


def resolve(window: int):
    before = window - rule(window).gram

    def marked(anchor: np.ndarray, doc: np.ndarray, h: np.ndarray, pos: np.ndarray, low: np.ndarray, context: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """Spans of all occurrences of repeats: (row, start, end) in bytes of the document."""
        parts = context.to_pylist()
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        start = np.cumsum(size) - size
        low = low.astype(np.int64)
        right_n = size - low
        right = rows_of(data, start + low, right_n, window, 1)
        left = rows_of(data, start + low - 1, low, before, -1)
        group = np.concatenate(([0], np.cumsum(anchor[1:] != anchor[:-1])))
        found = list(repeats(group, left, low, right, right_n, window))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, to_left, to_right = (np.concatenate(x) for x in zip(*found, strict=True))
        return row, pos[row] - to_left, pos[row] + to_right

    return marked


def _cut(batches: Iterator[pa.RecordBatch], whole_characters: bool, as_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts without their spans; with `whole_characters` a character that a span holds in part stays whole."""
    for batch in batches:
        found = batch.column("spans").to_pylist()
        rows = []
        for c in chunks(batch.column("text")):
            for i in range(c.first, c.last):
                text = c.data[c.offsets[i - c.first] : c.offsets[i - c.first + 1]]
                start, end = span_arrays(found[i])
                keep = np.ones(len(text), bool)
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    if whole_characters:
                        while s < e and text[s] & 0xC0 == 0x80:
                            s += 1
                        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                            e -= 1
                    keep[s:e] = False
                rows.append((len(text), int(len(text) - keep.sum()), len(start), text[keep].tobytes()))
        n, gone, count, kept = zip(*rows, strict=True)
        names = [f for f in batch.schema.names if f not in ("text", "spans", "hash")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(f) for f in names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array([k.decode() for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
            [*names, "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, how: Rule | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those of `window`-byte strings found twice.

    All occurrences go, the first too, in the same document or in others, overlapping ones included; a repeated row is an
    occurrence of its own. `n_spans` counts maximal removed runs. `kept` is binary, as a span may cut a character;
    `as_text` leaves such characters whole (n_removed then counts what went) and returns a string. A null text is empty. One row per input
    row; a null doc_id stays null (as does 2^63-1, which it is read as).
    """
    all_docs, shelf = keyed(docs, id_col, text_col), Shelf(docs.sparkSession, "suffixes")
    found = spans(all_docs, shelf, how or rule(window), encode, resolve(window))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, as_text, as_text)

    out = with_spans(all_docs, found).mapInArrow(cut, f"doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def cut_texts(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", how: Rule | None = None) -> DataFrame:
    """The rows of `docs`, all columns, with the texts of `remove_repeats(as_text=True)` in place of theirs."""
    all_docs, shelf = keyed(docs, id_col, text_col), Shelf(docs.sparkSession, "suffixes")
    found = spans(all_docs, shelf, how or rule(window), encode, resolve(window))
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    key = keyed(docs.toDF(*inner), inner[names.index(id_col)], inner[names.index(text_col)], inner)
    kinds = {f.name: f.dataType.simpleString() for f in key.schema.fields}
    others = [c for c in inner if c != inner[names.index(text_col)]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _cut(batches, True, True):
            yield out.select([*others, "kept"])

    rows = key.drop(inner[names.index(text_col)]).join(found, ["doc", "hash"], "left").mapInArrow(cut, ", ".join(f"{c} {kinds[c]}" for c in others) + ", kept string")
    return rows.select(*(F.col("kept" if c == inner[names.index(text_col)] else c).alias(n) for c, n in zip(inner, names, strict=True)))
