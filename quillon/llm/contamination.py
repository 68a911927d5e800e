"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

An item's shingle set is sketched by its smallest hashes. Items are partitioned by size, and a partition's largest size decides
how many of them: if a document holds a share of `percent` of an item, it misses at most the rest, so one of the item's
floor((100 - percent) / 100 * n) + 1 smallest hashes is in the document for sure. Documents are not sketched, which would hide a
short item in a long text: each of their shingles is looked up among the items' sketches, and every item that is hit is verified on
the document's whole shingle set. Nothing is missed.

The items' index is broadcast in blocks of at most BLOCK_HASHES hashes (32 MB). Each block is a pass of its own over the documents,
whose result is written before the next block is sent, so an executor holds one block whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf
from .text import Chunk, chunks, ngrams, shingle_sets, words

BLOCK_HASHES = 1 << 22
PARTITIONS = 1.25  # sizes of items in one partition differ by this factor at most


class Index:
    """Items of one block: their shingle sets, by the length of their shingles, and sketches to look up."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]], percent: int):
        self.ids = [i for i, _, _ in items]
        self.sets = [x for _, _, x in items]
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({w for _, w, _ in items}):
            mine = [i for i, (_, w, _) in enumerate(items) if w == width]
            top: dict[int, int] = {}
            for i in mine:  # the largest size of each partition
                p = int(np.log(len(self.sets[i])) / np.log(PARTITIONS))
                top[p] = max(top.get(p, 0), len(self.sets[i]))
            hashes, owner = [], []
            for i in mine:
                n = len(self.sets[i])
                k = top[int(np.log(n) / np.log(PARTITIONS))] * (100 - percent) // 100 + 1
                hashes.append(self.sets[i][:k])  # sets are sorted: these are the smallest
                owner.append(np.full(min(k, n), i))
            flat, owner = np.concatenate(hashes), np.concatenate(owner)
            order = np.argsort(flat, kind="stable")
            self.by_width[width] = (flat[order], owner[order])


def item_sets(items: list[tuple[int | None, str | None]], width: int) -> list[tuple[int | None, int, np.ndarray]]:
    """(id, shingle length, set) of every item with a word; one with fewer than `width` words is one shingle of them all."""
    out = []
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    for c in chunks(texts):
        w = words(c, lower=True)
        for i, x in enumerate(shingle_sets(w, width)):
            if len(x):
                out.append((items[c.first + i][0], min(width, int(w.doc[i + 1] - w.doc[i])), x))
    return out


def hits(at: Index, c: Chunk, percent: int) -> Iterator[tuple[int, int, int]]:
    """(text of the chunk, item of the index, shared shingles) of every held item."""
    w = words(c, lower=True)
    for width, (hashes, owner) in at.by_width.items():
        grams = ngrams(w, width)
        slot = np.searchsorted(hashes, grams)
        hit = np.flatnonzero(hashes[np.minimum(slot, len(hashes) - 1)] == grams)
        text = np.searchsorted(w.doc, hit, "right") - 1
        inside = hit + width <= w.doc[text + 1]
        hit, text = hit[inside], text[inside]
        for t in np.unique(text).tolist():
            found = np.unique(grams[hit[text == t]])
            a, b = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            whole = np.unique(grams[w.doc[t] : w.doc[t + 1] - width + 1])
            for i in np.unique(np.concatenate([owner[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])).tolist():
                item = at.sets[i]
                place = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
                shared = int((whole[place] == item).sum())
                if 100 * shared >= percent * len(item):
                    yield t, i, shared


def _search(batches: Iterator[pa.RecordBatch], index, percent: int) -> Iterator[pa.RecordBatch]:
    at: Index = index.value
    for batch in batches:
        docs = batch.column(0).to_pylist()
        out = [(docs[c.first + t], at.ids[i], len(at.sets[i]), n) for c in chunks(batch.column(1)) for t, i, n in hits(at, c, percent)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "item_id", "n_shingles", "n_shared"])


def _clean(batches: Iterator[pa.RecordBatch], index, percent: int, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for c in chunks(batch.column(text_col)):
            for t, _, _ in hits(index.value, c, percent):
                keep[c.first + t] = False
        yield batch.filter(pa.array(keep))


def indexes(docs: DataFrame, items: DataFrame, percent: int, width: int, item_id: str, item_text: str, block_hashes: int) -> Iterator:
    """Broadcast indexes over blocks of items, each of at most `block_hashes` hashes, and whether it is the last; one block is all that the driver holds."""
    sc = docs.sparkSession.sparkContext
    block: list[tuple[int | None, int, np.ndarray]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("long"), item_text).toLocalIterator():
        for found in item_sets([(row[0], row[1])], width):
            if size and size + len(found[2]) > block_hashes:
                yield sc.broadcast(Index(block, percent)), False
                block, size = [], 0
            block.append(found)
            size += len(found[2])
    yield sc.broadcast(Index(block, percent)), True


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item (see `find_leaks`)."""
    schema, shelf = docs.schema, Shelf(docs.sparkSession, "clean")
    for k, (index, last) in enumerate(indexes(docs, items, percent, width, item_id, item_text, block_hashes)):
        docs = docs.mapInArrow(partial(_clean, index=index, percent=percent, text_col=text_col), schema)
        if not last:
            docs = shelf.put(docs, f"block{k}")
            index.unpersist()
    return docs


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every document that holds `percent` of an item's word shingles or more.

    Words are lower-cased (A-Z). An item of fewer than `width` words is held if its words follow each other in the document;
    items and documents without words match nothing. Repeated rows give repeated results, of documents and of items alike; a null
    doc_id is passed on, and so is a null item_id: an item without an id is looked for like any other. No exchange: documents are scanned once per block of items.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shelf, found = Shelf(docs.sparkSession, "leaks"), []
    for k, (index, last) in enumerate(indexes(docs, items, percent, width, item_id, item_text, block_hashes)):
        hit = cols.mapInArrow(partial(_search, index=index, percent=percent), "doc_id long, item_id long, n_shingles long, n_shared long")
        found.append(hit if last else shelf.put(hit, f"block{k}"))
        if not last:
            index.unpersist()
    return reduce(DataFrame.union, found)


def find_leaks_sql(percent: int = 80, width: int = 5) -> str:
    """The same rows in DuckDB SQL over `documents` and `benchmark`."""
    listed = lambda t, i: f"select {i} as id, row_number() over () as k_row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {t}"
    return f"""
with d as ({listed('documents', 'doc_id')}), b as ({listed('benchmark', 'item_id')}),
items as (select id, k_row, least({width}, len(w)) as k, unnest(list_distinct(list_transform(range(1, len(w) - least({width}, len(w)) + 2), lambda i: array_to_string(w[i:i + least({width}, len(w)) - 1], ' ')))) as g from b where len(w) > 0),
sizes as (select k_row, count(*) as n from items group by k_row),
held as (select id, k_row, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as g from d, (select distinct k from items) where len(w) >= k)
select h.id as doc_id, i.id as item_id, any_value(s.n) as n_shingles, count(*) as n_shared
from held h join items i on h.g = i.g and h.k = i.k join sizes s on s.k_row = i.k_row
group by h.k_row, h.id, i.k_row, i.id having 100 * count(*) >= {percent} * any_value(s.n)"""
