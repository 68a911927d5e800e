"""Language-model scoring by context-tree weighting.

A text is the sequence of its lower-cased (A-Z) words, each closed by a space, the last by the end mark (a line feed; an empty text is
the end mark alone). Every symbol is a byte, coded as eight binary decisions; a decision's context is the bytes before it, DEPTH of
them, latest first. A node of the tree is a context of 0 to DEPTH bytes with the bits of the byte that are decided already. It holds how
often 0 and 1 followed in training. Its Krichevsky-Trofimov block probability is mixed half and half with the product of its
children's weighted probabilities; the posterior share of a node against its children then mixes the estimates of all depths for a
new text. A node that training never saw takes no part: the mix ends at the deepest context that was seen. The model is frozen while
it scores, so the probabilities of all texts sum to one.

Counting: tasks sum up their own grams (DEPTH context bytes and the byte itself, 48 bits), which meet in buckets by the two latest
context bytes, so every subtree from depth 2 on lies in one bucket. Depths 0 and 1 have 65,280 nodes at most and are mixed on the
driver. Scoring: grams and words that make up 1/FREQUENT of training or more are broadcast with their values (FREQUENT entries at
most, whatever the corpus); the others are sent to their bucket, packed by chunks of documents, and come back as sums. So the model
is whole, grows with the corpus, and is never gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counting import FLUSH, Sums, batch_of, merged, packed, summed
from .shared import Shelf, buckets
from .text import U, Chunk, Words, chunks, mix, words

DEPTH = 5
FREQUENT = 1 << 22
END, GAP = 10, 32
_END_WORD = mix(np.array([0xE0D], U))  # stands for the end mark among the hashes of words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 21
_HALF = math.log(0.5)
WORD, GRAM = 0, 1


def symbols(c: Chunk, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a chunk's normalised texts, each after DEPTH end marks, and how many symbols each text has without these."""
    rows, n_words, length = c.last - c.first, np.diff(w.doc), w.end - w.start
    upto = np.concatenate(([0], np.cumsum(length + 1)))
    own = upto[w.doc[1:]] - upto[w.doc[:-1]] + (n_words == 0)
    begin = np.concatenate(([0], np.cumsum(own + DEPTH)))
    out = np.full(begin[-1], END, np.uint8)
    doc = np.repeat(np.arange(rows), n_words)
    at = begin[doc] + DEPTH + upto[:-1] - upto[w.doc[:-1]][doc]
    lead = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(lead[-1]) - np.repeat(lead[:-1], length)
    out[np.repeat(at, length) + inside] = _LOWER[c.data[np.repeat(w.start, length) + inside]]
    last = np.zeros(len(at), bool)
    last[w.doc[1:][n_words > 0] - 1] = True
    out[(at + length)[~last]] = GAP
    return out, own


def grams(c: Chunk, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every symbol of a chunk, context bytes from the latest on, then the symbol; and the number of symbols of each text."""
    s, own = symbols(c, w)
    key = s[DEPTH:].astype(U)
    for k in range(1, DEPTH + 1):
        key |= s[DEPTH - k : len(s) - k].astype(U) << U(8 * (DEPTH + 1 - k))
    real = np.ones(len(s), bool)
    begin = np.concatenate(([0], np.cumsum(own + DEPTH)))[:-1]
    for k in range(DEPTH):
        real[begin + k] = False
    return key[real[DEPTH:]], own


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of a chunk and of one end mark a text."""
    n = np.diff(w.doc)
    return np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n))]), np.concatenate([w.hash, np.repeat(_END_WORD, len(n))])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def bucket_of(kind: int, keys: np.ndarray, n: int) -> np.ndarray:
    """Words by their hash, grams by their two latest context bytes."""
    spread = keys if kind == WORD else mix((keys >> U(8 * (DEPTH - 1))) + U(1))
    return (((spread >> U(32)) * U(n)) >> U(32)).astype(np.int64) + kind * n


_COUNTS = "bucket int, kind int, keys binary, n binary"


def _rows(kind: int, keys: np.ndarray, n: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    return batch_of([(b, kind, k, m) for b, k, m in packed(keys, n, bucket_of(kind, keys, n_buckets))], _COUNTS)


def _count(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts to packed counts of words and grams."""
    held = {WORD: Sums(), GRAM: Sums()}
    for batch in batches:
        for c in chunks(batch.column(0)):
            w = words(c, lower=True)
            for kind, keys in ((WORD, tokens(w)[1]), (GRAM, grams(c, w)[0])):
                held[kind].add(*counted(keys))
                if held[kind].full:
                    yield _rows(kind, *held[kind].take(), n_buckets)
    for kind, sums in held.items():
        yield _rows(kind, *sums.take(), n_buckets)


def _unpack(batch: pa.RecordBatch) -> list[tuple]:
    """(bucket, kind, keys, n) of each row."""
    get = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in batch.column(name)]
    return list(zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), get("keys", "<u8"), get("n", "<i8"), strict=True))


def _merge(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One bucket's counts, summed, in rows of at most FLUSH keys. A bucket's number tells its kind."""
    bucket, keys, n = merged(batches)
    for a in range(0, len(keys), FLUSH):
        yield batch_of([(bucket, bucket // n_buckets, keys[a : a + FLUSH].tobytes(), n[a : a + FLUSH].tobytes())], _COUNTS)


_SMALL = np.array([-math.inf, *(math.lgamma(k / 2) for k in range(1, 64))])  # lgamma at halves


def _lgamma(twice: np.ndarray) -> np.ndarray:
    """ln Gamma(twice / 2) of whole numbers from 1 on."""
    x = np.maximum(twice, 32) / 2
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(twice < 64, _SMALL[np.minimum(twice, 63)], big)


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(2 * zeros + 1) + _lgamma(2 * ones + 1) - math.log(math.pi) - _lgamma(2 * (zeros + ones) + 2)


def mixed(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of a node with that of its children's product, and the node's own share of it."""
    weighted = np.logaddexp(own, below) + _HALF
    return weighted, np.exp(own + _HALF - weighted)


class Tree:
    """Nodes of depth 2 to DEPTH of one bucket: by depth their keys (context, then the bits decided behind a leading 1), counts and shares."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.zeros, self.ones, self.share = {}, {}, {}, {}
        weighted: dict[int, np.ndarray] = {}
        for d in range(DEPTH, 1, -1):
            gram, k = summed((keys >> U(8 * (DEPTH - d + 1)) << U(8)) | (keys & U(255)), n)
            context, symbol = gram >> U(8) << U(8), gram & U(255)
            nodes = np.concatenate([context | U(1 << j) | (symbol >> U(8 - j)) for j in range(8)])
            bit = np.concatenate([(symbol >> U(7 - j)) & U(1) for j in range(8)]).astype(bool)
            k = np.tile(k, 8)
            self.keys[d], self.ones[d] = summed(nodes, np.where(bit, k, 0))
            self.zeros[d] = summed(nodes, np.where(bit, 0, k))[1]
            weighted[d] = block_probability(self.zeros[d], self.ones[d])
            if d < DEPTH:
                up = self.keys[d + 1]
                parent = np.searchsorted(self.keys[d], (up >> U(16) << U(8)) | (up & U(255)))
                weighted[d], self.share[d] = mixed(weighted[d], np.bincount(parent, weighted[d + 1], len(self.keys[d])))
        self.top = weighted[2]

    def upper(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By nodes of depth 1: sums of zeros, ones and weighted probabilities of the children in this bucket."""
        k = self.keys[2]
        node, back = np.unique((k >> U(16) << U(8)) | (k & U(255)), return_inverse=True)
        add = lambda x: np.bincount(back, x, len(node))
        return node.astype(np.int64), add(self.zeros[2]), add(self.ones[2]), add(self.top)

    def log10(self, gram: np.ndarray, upper: Upper) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its context."""
        total = np.zeros(len(gram))
        for j in range(8):
            code = U(1 << j) | ((gram & U(255)) >> U(8 - j))
            bit = ((gram >> U(7 - j)) & U(1)).astype(bool)
            p, seen = np.full(len(gram), 0.5), np.zeros(len(gram), bool)
            for d in range(DEPTH, -1, -1):
                if d > 1:
                    keys = self.keys[d]
                    node = (gram >> U(8 * (DEPTH - d + 1)) << U(8)) | code
                    at = np.minimum(np.searchsorted(keys, node), max(0, len(keys) - 1))
                    here = keys[at] == node if len(keys) else np.zeros(len(node), bool)
                    zeros, ones, share = ((x[at] if len(keys) else np.zeros(len(node))) for x in (self.zeros[d], self.ones[d], self.share.get(d, self.ones[d])))
                else:
                    at = (code + (gram >> U(8 * DEPTH) << U(8)) * U(d)).astype(np.int64)
                    zeros, ones, share = (x[d][at] for x in (upper.zeros, upper.ones, upper.share))
                    here = zeros + ones > 0
                own = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
                p = np.where(here, np.where(seen, share * own + (1 - share) * p, own), p)
                seen |= here
            total += np.log10(p)
        return total


class Upper:
    """Nodes of depth 0 and 1, from the sums that the buckets give."""

    def __init__(self, rows: list[tuple[int, float, float, float]]):
        a = np.zeros((4, 1 << 16))
        for node, zeros, ones, below in rows:
            a[:, node] = node, zeros, ones, below
        zeros, ones, below = (x.reshape(256, 256) for x in a[1:])
        whole = lambda x: np.rint(x).astype(np.int64)
        weighted, share = mixed(block_probability(whole(zeros), whole(ones)), below)
        weighted[(zeros + ones) == 0] = 0
        _, root = mixed(block_probability(whole(zeros.sum(0)), whole(ones.sum(0))), weighted.sum(0))
        self.zeros, self.ones, self.share = [zeros.sum(0), zeros.ravel()], [ones.sum(0), ones.ravel()], [root, share.ravel()]


def _load(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(k, n) for batch in batches for _, _, k, n in _unpack(batch)]
    return np.concatenate([np.zeros(0, U), *(k for k, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n = _load(batches)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in Tree(keys, n).upper()], ["node", "zeros", "ones", "below"])


def _common(batches: Iterator[pa.RecordBatch], least: dict[int, float], upper) -> Iterator[pa.RecordBatch]:
    """Frequent keys of a bucket with their values: of a word log10(count + 0.1), of a gram log10 of its probability."""
    rows = [x for batch in batches for x in _unpack(batch)]
    for kind in {r[1] for r in rows}:
        keys, n = (np.concatenate([r[i] for r in rows if r[1] == kind]) for i in (2, 3))
        often = keys[n >= least[kind]]
        if len(often):
            value = np.log10(n[n >= least[kind]] + 0.1) if kind == WORD else Tree(keys, n).log10(often, upper.value)
            yield batch_of([(0, kind, often.tobytes(), value.astype("<f8").tobytes())], _COUNTS)


class Model:
    """What the tasks that score need: frequent keys with values, and figures of the training texts."""

    def __init__(self, rows: list, total: int, distinct: int):
        self.total, self.distinct, self.table = total, distinct, {}
        for kind in (WORD, GRAM):
            keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(r["keys"], "<u8") for r in rows if r["kind"] == kind)])
            value = np.concatenate([np.zeros(0), *(np.frombuffer(r["n"], "<f8") for r in rows if r["kind"] == kind)])
            order = np.argsort(keys)
            self.table[kind] = keys[order], value[order]


_PART = "kind int, bucket int, chunk long, keys binary, doc binary, n binary, value binary, known binary"


def _pairs(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, text) in order of keys, and how often each occurs."""
    order = np.lexsort((doc, keys))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
    return k[first], d[first], np.diff(np.append(first, len(k)))


def _gram_pairs(own: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of grams: a text's number fits beside the 48 bits of a gram, so that plain values are sorted."""
    doc = np.repeat(np.arange(len(own)), own)
    both, n = counted((keys << U(16)) | doc.astype(U))
    return both >> U(16), (both & U(0xFFFF)).astype(np.int64), n


def _score(batches: Iterator[pa.RecordBatch], model, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts to sums over their frequent words and grams (one row a chunk), and their other words and grams, packed by bucket."""
    line = 0
    for batch in batches:
        ids, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        for c in (x for big in chunks(batch.column(1), _CHUNK) for x in _at_most(big, 1 << 16)):
            rows, w = c.last - c.first, words(c, lower=True)
            here = (TaskContext.get().partitionId() << 40) + line
            line += 1
            keys, own = grams(c, w)
            out, sums, known = [], {}, np.zeros(rows, np.int64)
            for kind, (k, d, n) in ((WORD, _pairs(*tokens(w))), (GRAM, _gram_pairs(own, keys))):
                table, value = model.value.table[kind]
                at = np.minimum(np.searchsorted(table, k), max(0, len(table) - 1))
                there = table[at] == k if len(table) else np.zeros(len(k), bool)
                sums[kind] = np.bincount(d[there], value[at[there]] * n[there], rows)
                if kind == WORD:
                    known += np.bincount(d[there], n[there], rows).astype(np.int64)
                k, d, n = k[~there], d[~there], n[~there]
                slot = bucket_of(kind, k, n_buckets)
                order = np.argsort(slot, kind="stable")
                slot, k, d, n = slot[order], k[order], d[order], n[order]
                cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))).tolist() if len(slot) else []
                out += [(kind, int(slot[a]), here, k[a:b].tobytes(), d[a:b].astype("<u2").tobytes(), n[a:b].astype("<i4").tobytes(), b"", b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
            mine = ids.slice(c.first, rows)
            out.append(
                (
                    2, -1, here, mine.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(mine.is_valid()).astype("u1").tobytes() + held[c.first : c.last].astype("u1").tobytes(),
                    (np.diff(w.doc) + 1).astype("<i8").tobytes(), np.concatenate([sums[WORD], sums[GRAM]]).astype("<f8").tobytes(), known.astype("<i8").tobytes(),
                )
            )
            yield batch_of(out, _PART)


def _at_most(c: Chunk, rows: int) -> Iterator[Chunk]:
    """The chunk in pieces of so many rows."""
    for a in range(0, c.last - c.first, rows):
        o = c.offsets[a : min(a + rows, c.last - c.first) + 1]
        yield Chunk(c.first + a, c.first + a + len(o) - 1, c.data[o[0] : o[-1]], o - o[0])


def _look_up(batches: Iterator[pa.RecordBatch], upper) -> Iterator[pa.RecordBatch]:
    """A bucket's counts, which come first, then what is asked of it: sums by text come back, one row for each row asked."""
    parts, table, kind = [], None, None
    for batch in batches:
        for kind, chunk, key, doc, n in zip(*(batch.column(x) for x in ("kind", "chunk", "keys", "doc", "n")), strict=True):
            kind, chunk, key = kind.as_py(), chunk.as_py(), np.frombuffer(key.as_buffer(), "<u8")
            if chunk < 0:
                parts.append((key, np.frombuffer(n.as_buffer(), "<i8")))
                continue
            if table is None:
                keys, count = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in ((0, U), (1, np.int64)))
                table, parts = (keys, count, Tree(keys, count) if kind == GRAM else None), []
            keys, count, tree = table
            doc, n = np.frombuffer(doc.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<i4")
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            back = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            ask = key[first]
            if kind == GRAM:
                value, known = tree.log10(ask, upper.value), np.zeros(len(ask), bool)
            else:
                at = np.minimum(np.searchsorted(keys, ask), max(0, len(keys) - 1))
                known = keys[at] == ask if len(keys) else np.zeros(len(ask), bool)
                value = np.log10(np.where(known, count[at] if len(keys) else 0, 0) + 0.1)
            some, place = np.unique(doc, return_inverse=True)
            value, known = np.bincount(place, value[back] * n, len(some)), np.bincount(place, known[back] * n, len(some))
            yield batch_of([(kind, -1, chunk, b"", some.astype("<u2").tobytes(), b"", value.astype("<f8").tobytes(), known.astype("<i8").tobytes())], _PART)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _gather(group: pa.Table, total: int, distinct: int) -> pa.Table:
    """All parts of one chunk of texts, summed."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["kind"] == 2)
    ids, n = np.frombuffer(head["keys"], "<i8"), np.frombuffer(head["n"], "<i8")
    flags = np.frombuffer(head["doc"], "u1").reshape(2, len(ids)).astype(bool)
    value, known = np.frombuffer(head["value"], "<f8").reshape(2, len(ids)).copy(), np.frombuffer(head["known"], "<i8").copy()
    for r in sorted((r for r in rows if r["kind"] != 2), key=lambda r: (r["kind"], r["doc"], r["value"])):
        doc = np.frombuffer(r["doc"], "<u2")
        value[r["kind"]][doc] += np.frombuffer(r["value"], "<f8")
        if r["kind"] == WORD:
            known[doc] += np.frombuffer(r["known"], "<i8")
    base = value[WORD] - n * math.log10(total + 0.1 * (distinct + 1))
    cols = [pa.array(ids, mask=~flags[0]), pa.array(flags[1]), pa.array(n), pa.array(known), pa.array(np.full(len(ids), total, np.int64)), pa.array(base), pa.array(value[GRAM])]
    return pa.Table.from_arrays(cols, [x.split()[0] for x in _OUT.split(", ")])


def held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id as text ends in 0; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model is trained on the rows that aren't held out (see `held_out`) and scores all. `score` is log10 of the probability that it
    gives the text's sequence of words and the end mark, `base_score` the smoothed unigram's over the same tokens. A null
    text is empty: one token, the end. Repeated rows are counted in training and scored as often as they come. Other columns aren't
    read. An empty table gives no rows; without any training text every decision has probability 1/2 and the base score is 0.
    """
    spark, n = docs.sparkSession, buckets(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held"))
    shelf = Shelf(spark, "contexts")
    counted_here = rows.where(~F.col("held")).select("text").mapInArrow(partial(_count, n_buckets=n), _COUNTS)
    counts = shelf.put(counted_here.repartitionById(2 * n, F.col("bucket")).mapInArrow(partial(_merge, n_buckets=n), _COUNTS), "counts")
    by_bucket = lambda df: df.repartitionById(2 * n, F.col("bucket"))
    size = counts.select("kind", (F.length("keys") / 8).cast("long").alias("distinct"), F.col("n")).mapInArrow(_totals, "kind int, distinct long, total long")
    figures = {r["kind"]: r for r in size.groupBy("kind").agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total")).collect()}
    total, distinct = (int(figures[WORD][x]) if WORD in figures else 0 for x in ("total", "distinct"))
    least = {k: max(1, figures[k]["total"] / frequent) for k in figures}
    tops = by_bucket(counts.where(F.col("kind") == GRAM)).mapInArrow(_upper, "node long, zeros double, ones double, below double")
    upper = spark.sparkContext.broadcast(Upper([tuple(r) for r in tops.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()]))
    common = by_bucket(counts).mapInArrow(partial(_common, least=least, upper=upper), _COUNTS).collect()
    model = spark.sparkContext.broadcast(Model(common, total, distinct))
    parts = shelf.put(rows.mapInArrow(partial(_score, model=model, n_buckets=n), _PART), "parts")
    empty = F.lit(b"")
    table = counts.select("kind", "bucket", F.lit(-1).cast("long").alias("chunk"), "keys", empty.alias("doc"), "n", empty.alias("value"), empty.alias("known"))
    asked = by_bucket(table.union(parts.where("kind < 2"))).sortWithinPartitions((F.col("chunk") >= 0).cast("int"))
    found = asked.mapInArrow(partial(_look_up, upper=upper), _PART)
    return parts.where("kind = 2").union(found).groupBy("chunk").applyInArrow(lambda chunk: _gather(chunk, total, distinct), _OUT)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = [int(np.frombuffer(x.as_buffer(), "<i8").sum()) for x in batch.column("n")]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("distinct"), pa.array(total, pa.int64())], ["kind", "distinct", "total"])

