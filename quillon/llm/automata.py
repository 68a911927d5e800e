"""Substring deduplication over words with repeated-phrase automata.

Passages that recur are confirmed among the contexts that meet at an anchor (see `anchors`), compiled into Aho-Corasick automata,
one for each shard of anchors, and the documents' stretches that were sent to that shard are streamed through its automaton, which
locates every occurrence. The earliest occurrence of a passage stays, and all later ones are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import NO_ID, Rule, keyed, span_arrays, spans, with_spans
from .shared import Shelf
from .text import U, chunks, mix, running_hash, span_hash, words

LETTERS = 3  # letters that stand for a word inside an automaton, seven bits each: 420 bits for the shortest passage


def rule(window: int) -> Rule:
    return Rule(by_words=True, window=window, gram=max(1, min(6, window // 3)), keep_first=True)


def encode(values: np.ndarray) -> np.ndarray:
    return (values >> U(32)).astype(np.uint32)


def passages(anchor: np.ndarray, low: np.ndarray, order_of: np.ndarray, data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Confirmed recurring passages: (row, first word, end word) in the earliest row that holds each.

    A window of one row recurs if another row has the same words around the same anchor. Neighbouring windows that the same
    rows hold are one passage.
    """
    n = np.diff(bounds)
    count = np.maximum(0, np.minimum(low, n - window) + 1)  # windows from a row's first word on that hold the anchor
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    running = running_hash(mix(data.astype(U) + U(1)))
    start = bounds[row] + at
    key = span_hash(running, start, start + window) ^ mix((at - low[row] + 1000).astype(U)) ^ mix(anchor[row].astype(U))
    by = np.lexsort((order_of[row], key))
    k = key[by]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)
    holders = np.zeros(len(size), U)
    np.add.at(holders, group, mix(row[by].astype(U) + U(7)))
    chosen = np.flatnonzero(new & (size[group] > 1)) if len(k) else by
    row, at, who = row[by][chosen], at[by][chosen], holders[group[chosen]]
    by = np.lexsort((at, row))
    row, at, who = row[by], at[by], who[by]
    if not len(row):
        return row, at, at
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(row) - 1]))
    return row[new], at[new], at[last] + window


def locate(patterns: dict[str, int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every pattern in every text: (pattern, text, first word)."""
    found: list[tuple[int, int, int]] = []
    machine = ahocorasick.Automaton()
    for p, i in patterns.items():
        machine.add_word(p, (i, len(p)))
    if not patterns:
        return (np.zeros(0, np.int64),) * 3
    machine.make_automaton()
    for t, text in enumerate(texts):
        for end, (i, n) in machine.iter(text):
            if (end + 1 - n) % LETTERS == 0:
                found.append((i, t, (end + 1 - n) // LETTERS))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def resolve(window: int):
    def later(anchor: np.ndarray, doc: np.ndarray, h: np.ndarray, pos: np.ndarray, low: np.ndarray, context: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        """Spans of all occurrences of confirmed passages but the earliest: (row, start, end) in words of the document."""
        parts = context.to_pylist()
        data = np.frombuffer(b"".join(parts), np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
        place = np.empty(len(parts), np.int64)
        place[np.lexsort((pos, h, doc))] = np.arange(len(parts))
        row, start, end = passages(anchor, low, place, data, bounds, window)
        letters = (((data[:, None] >> np.array([0, 7, 14], np.uint32)) & 127) + 1).astype(np.uint8).tobytes().decode("latin-1")
        cut = lambda a, b: letters[a * LETTERS : b * LETTERS]
        patterns: dict[str, int] = {}
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
            patterns.setdefault(cut(bounds[r] + a, bounds[r] + b), len(patterns))
        length = np.array([len(p) // LETTERS for p in patterns] or [0])
        which, at, first = locate(patterns, [cut(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        begin = pos[at] - low[at] + first
        by = np.lexsort((begin, h[at], doc[at], which))
        which, at, begin = which[by], at[by], begin[by]
        new = np.concatenate(([True], which[1:] != which[:-1])) if len(which) else np.zeros(0, bool)
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(which) else which
        late = (doc[at] != doc[at[head]]) | (h[at] != h[at[head]]) | (begin != begin[head])
        return at[late], begin[late], (begin + length[which])[late]

    return later


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column("spans").to_pylist()
        rows = []
        for c in chunks(batch.column("text")):
            w = words(c, lower=False)
            for i in range(c.first, c.last):
                a, b = w.doc[i - c.first], w.doc[i - c.first + 1]
                keep = np.ones(b - a, bool)
                for s, e in zip(*(x.tolist() for x in span_arrays(found[i])), strict=True):
                    keep[s:e] = False
                at = np.flatnonzero(keep) + a
                kept = b" ".join(c.data[s:e].tobytes() for s, e in _runs(w.start[at], w.end[at], c.data))
                rows.append((int(b - a), int(b - a - len(at)), b" ".join(kept.split()).decode()))
        n, gone, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc", "n_words", "n_removed", "kept"])


def _runs(start: np.ndarray, end: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold the kept words: a word that stands one byte after the last is in the same stretch."""
    if not len(start):
        return
    new = np.concatenate(([True], start[1:] != end[:-1] + 1))
    first = np.flatnonzero(new)
    yield from zip(start[first].tolist(), end[np.concatenate((first[1:] - 1, [len(end) - 1]))].tolist(), strict=True)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", how: Rule | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words of windows that start earlier elsewhere.

    Earlier means a smaller doc_id, or the same document at an earlier word; a null doc_id comes after all others (as does
    2^63-1, which it is read as), and rows that share a doc_id with different texts are ordered by their texts' hashes. A row
    that repeats doc_id and text is not earlier than its like. `kept` has the kept words, joined by one space. A null or empty
    text has no words. One row per input row; other columns aren't read.
    """
    all_docs, shelf = keyed(docs, id_col, text_col), Shelf(docs.sparkSession, "automata")
    found = spans(all_docs, shelf, how or rule(window), encode, resolve(window))
    out = with_spans(all_docs, found).mapInArrow(_digests, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")




def remove_repeats_sql(window: int = 20) -> str:
    """Digests of `remove_repeats` in DuckDB SQL over `documents`, from all windows of all texts."""
    return f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - {window} + 2)) as i, w from d where len(w) >= {window}),
grams as (select doc_id, i, array_to_string(w[i:i + {window} - 1], ' ') as g from win),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as k from grams) x where k > 1),
gone as (select distinct doc_id, i + k as j from late, range(0, {window}) r(k)),
flat as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d),
kept as (select f.doc_id, string_agg(word, ' ' order by f.j) as kept, count(*) as n from flat f anti join gone g on g.doc_id = f.doc_id and g.j = f.j group by f.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept k on k.doc_id = d.doc_id"""
