"""Near duplicates by word-shingle Jaccard: a parity-sketch join.

Every distinct shingle is hashed to one bit of a long bit vector, and the bits of a set are XORed: a bit is the parity of the
shingles that fall on it. The Hamming distance of two such sketches is at most the sets' symmetric difference d, and sets with
Jaccard >= t have d <= D = (1-t)/(1+t) * (|A|+|B|). The vector is cut into P = D + 1 + spare parts: two linked sets agree in at
least 1 + spare whole parts. Parts are 2^58 bits wide and so kept sparsely, as one 64-bit XOR of their set positions' hashes.

Sizes are cut into bands that grow by 1/t, so that linked sets lie in one band or in two neighbours; D and P belong to a band,
and a set takes part in its own band and in the next. Sets that agree in a part meet in a hash bucket. An empty part is no
evidence: a set with more empty parts than `spare` is entered again under another division, and under the last with its empty
parts too, so that no link is lost.

What meets in a bucket is tied to the smallest set there (a star, linear in the bucket). All sets tied to one centre are then
compared with each other by dense parity sketches in blocks of bounded size: pairs whose Hamming distance exceeds D are ruled
out exactly, and of the others a spanning forest is verified on the texts. Where a pair of that forest fails, a second round
verifies every other pair between the parts that it would have joined, so nothing is left untested.

A large family, more than two blocks tied to one centre, is compared in three steps: each block inside itself; then one
representative of each part that is connected by now with those of the other blocks' parts; and at last, exactly, the members of all
smaller parts with everything outside their own part. Where a family is connected the last step has nothing to do, so its sketches
are sent once, not once for every other block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import Shelf, buckets
from .text import U, chunks, mix, set_hash, shingle_sets, words

DIVISIONS = 5  # divisions of the sketch that a set with many empty parts is tried under
BLOCK = 1024  # sets of one centre that are compared in one task
LARGE = 1000  # rows of a component whose least id is broadcast
BROADCAST_PAIRS = 100_000  # pairs whose endpoints are broadcast, about 10 MB; more are joined by exchange
VERIFIED = 256  # pairs that are worth a task of their own
FLUSH = 1 << 19  # entries that a task gathers before it sends them to their buckets
_WORK = 1 << 22  # words of sketches that are compared at once


class Bands:
    """Bands of set sizes for the least Jaccard `percent` / 100; all in integers."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // percent)))
        self.low.append(-(-self.low[-1] * 100 // percent))
        self.low.append(-(-self.low[-1] * 100 // percent))
        self.starts = np.array(self.low)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, "right") - 1

    def most(self, total: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of linked sets whose sizes add up to `total`."""
        return total * (100 - self.percent) // (100 + self.percent)

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of a band's sketches, and how many of them two linked sets share at least."""
        far = self.most(2 * (self.starts[band + 1] - 1))
        spare = 2 + far // 16
        return far + 1 + spare, 1 + spare


def part_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which each set is entered: (index of the set, key)."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not sizes.size or not sizes.max():
        return np.zeros(0, np.int64), np.zeros(0, U)
    bands = Bands(percent, int(sizes.max()))
    own = bands.of(np.maximum(sizes, 1))
    out_set, out_key = [], []
    for ahead in (0, 1):
        band = own + ahead
        todo = np.flatnonzero((sizes > 0) & ((ahead == 0) | (sizes * 100 >= percent * bands.starts[band])))
        for division in range(DIVISIONS):
            if not len(todo):
                break
            last = division == DIVISIONS - 1
            flat = np.concatenate([sets[i] for i in todo])
            owner = np.repeat(todo, sizes[todo])
            if division:
                flat = mix(flat + U(division))
                order = np.lexsort((flat, owner))
                flat = flat[order]
            count, share = bands.parts(band[todo])
            part = ((flat >> U(32)) * np.repeat(count, sizes[todo]).astype(U)) >> U(32)
            new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))))
            word = np.bitwise_xor.reduceat(flat * U(0x9E3779B97F4A7C15), new)
            who, slot = owner[new], part[new]
            out_set.append(who)
            out_key.append(_key(word, band[who], slot, division))
            filled = np.bincount(np.searchsorted(todo, who), minlength=len(todo))
            poor = count - filled >= share
            if last:
                for i, n in zip(todo[poor].tolist(), count[poor].tolist(), strict=True):
                    blank = np.setdiff1d(np.arange(n, dtype=U), slot[who == i])
                    out_set.append(np.full(len(blank), i))
                    out_key.append(_key(np.zeros(len(blank), U), np.full(len(blank), band[i]), blank, division))
            todo = todo[poor]
    who, key = np.concatenate(out_set), np.concatenate(out_key)
    order = np.argsort(who.astype(np.uint16) if len(sets) <= 1 << 16 else who, kind="stable")
    return who[order], key[order]


def _key(word: np.ndarray, band: np.ndarray, part: np.ndarray, division: int) -> np.ndarray:
    return mix(word ^ mix(part + (band.astype(U) << U(32)) + (U(division) << U(56)) + U(1)))


def _enter(batches: Iterator[pa.RecordBatch], width: int, percent: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text's hash) to (bucket, kind, a, b, c): kind 0 holds documents (id, set's name, size, text's hash), kind 1 entries of sets: names,
    how many keys follow for each, and the keys' lower six bytes.

    Sets that a task has entered since the last flush aren't entered again, so copies cost one entry a task, not one a row.
    """
    docs: list[np.ndarray] = []
    names: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    seen: set[int] = set()
    held = 0

    def flush() -> pa.RecordBatch:
        rows = []
        if docs:
            rows.append((int(docs[0][0, 1]) % n_buckets, 0, np.concatenate(docs).tobytes(), b"", b""))
        if sum(map(len, keys)):
            key, name = np.concatenate(keys), np.concatenate(names)
            slot = ((key >> U(32)) * U(n_buckets)) >> U(32)
            order = np.argsort(slot.astype(np.uint16) if n_buckets <= 1 << 16 else slot, kind="stable")
            key, name, slot = key[order], name[order], slot[order]
            low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            run = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (slot[1:] != slot[:-1]))))
            count = np.diff(np.append(run, len(key)))
            first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            for at, to in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                p, q = np.searchsorted(run, (at, to))
                rows.append((int(slot[at]), 1, name[run[p:q]].tobytes(), count[p:q].astype("<u4").tobytes(), low[at:to].tobytes()))
        docs.clear(), keys.clear(), names.clear(), seen.clear()
        bucket, kind, a, b, c = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(x, pa.binary()) for x in (a, b, c))], ["bucket", "kind", "a", "b", "c"])

    for batch in batches:
        ids, digest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for c in chunks(batch.column(1)):
            sets = shingle_sets(words(c, lower=True), width)
            name = np.array([set_hash(x) for x in sets], np.int64)
            docs.append(np.stack([ids[c.first : c.last], name, np.array([len(x) for x in sets]), digest[c.first : c.last]], 1).astype("<i8"))
            new = [i for i, x in enumerate(name.tolist()) if not (x in seen or seen.add(x))]
            who, key = part_keys([sets[i] for i in new], percent)
            keys.append(key)
            names.append(name[new][who] if len(who) else np.zeros(0, np.int64))
            held += len(key)
            if held >= FLUSH:
                yield flush()
                held = 0
    if docs:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's entries to (kind, a, b, n, digest): kind 0 a document (id, set, size, text's hash), kind 1 a set b tied to a centre a."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for kind, a, b, c in zip(batch.column("kind").to_pylist(), batch.column("a"), batch.column("b"), batch.column("c"), strict=True):
            a = np.frombuffer(a.as_buffer(), "<i8")
            if kind:
                low = np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, 6)
                key = np.zeros((len(low), 8), np.uint8)
                key[:, :6] = low
                found.append((key.view("<u8").ravel(), np.repeat(a, np.frombuffer(b.as_buffer(), "<u4"))))
            else:
                yield _rows(0, *a.reshape(-1, 4).T)
    if not found:
        return
    keys, names = zip(*found, strict=True)
    found.clear()
    key = np.concatenate(keys)
    del keys
    order = np.argsort(key, kind="stable")
    key = key[order]
    shared = np.concatenate((key[1:] == key[:-1], [False]))
    shared[1:] |= key[1:] == key[:-1]
    key, order = key[shared], order[shared]
    name = np.concatenate(names)[order]
    del names, order, shared
    if not len(key):
        return
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    centre = name[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other = centre != name
    tied = np.unique(np.stack([centre[other], name[other]], 1), axis=0)
    if len(tied):
        yield _rows(1, *tied.T, np.zeros(len(tied), np.int64), np.zeros(len(tied), np.int64))


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = pa.array(np.full(len(columns[0]), kind, np.int32))
    return pa.RecordBatch.from_arrays([kinds, *(pa.array(np.ascontiguousarray(x)) for x in columns)], ["kind", "a", "b", "n", "digest"])


def dense_sketch(x: np.ndarray) -> np.ndarray:
    """Parity bits of a set over about four bits a member, as 64-bit words, a power of two of them."""
    n = 4
    while n * 64 < 4 * len(x):
        n *= 2
    bit, odd = np.unique(mix(x + U(0x51)) & U(n * 64 - 1), return_counts=True)
    bit = bit[odd % 2 == 1]
    out = np.zeros(n * 64, np.uint8)
    out[bit.astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def fold(x: np.ndarray, n: int) -> np.ndarray:
    """The same sketch in n words: bit positions modulo the smaller length."""
    return np.bitwise_xor.reduce(x.reshape(-1, n), axis=0)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(name, text, repeated) to (name, n, sketch, text, repeated), for texts whose set has that name; of repeated rows one a task."""
    seen: set[int] = set()
    for batch in batches:
        name, repeated = batch.column("name").to_pylist(), batch.column("repeated").to_pylist()
        rows = pa.array([i for i, (x, r) in enumerate(zip(name, repeated, strict=True)) if not r or not (x in seen or seen.add(x))], pa.int64())
        batch = batch.take(rows)
        name = batch.column("name").to_numpy(zero_copy_only=False)
        for c in chunks(batch.column("text")):
            sets = shingle_sets(words(c, lower=True), width)
            at = [i for i, x in enumerate(sets) if set_hash(x) == name[c.first + i]]
            rows = pa.array([c.first + i for i in at], pa.int64())
            named, text, twice = (batch.column(x).take(rows) for x in ("name", "text", "repeated"))
            size, sketch = pa.array([len(sets[i]) for i in at], pa.int64()), pa.array([dense_sketch(sets[i]).tobytes() for i in at], pa.binary())
            yield pa.RecordBatch.from_arrays([named, size, sketch, text, twice], ["name", "n", "sketch", "text", "repeated"])


def likely_pairs(n: np.ndarray, sketches: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that sketches and sizes don't rule out, with their distance as a share of the allowed one, in bounded pieces."""
    bands, order = Bands(percent, 1), np.argsort(n, kind="stable")
    size, width = n[order], np.array([len(sketches[i]) for i in order])
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)  # sizes ascend, so these are consecutive, and all partners come at or after them
        end = int(np.searchsorted(size, size[rows[-1]] * 100 // percent, "right"))
        flat = np.stack([s if len(s) == w else fold(s, w) for s in (sketches[i] for i in order[rows[0] : end])])
        for a in rows.tolist():
            b, at = int(np.searchsorted(size, size[a] * 100 // percent, "right")), a + 1  # no larger set can be linked
            while at < b:
                to = min(b, at + max(1, _WORK // w))
                far = np.bitwise_count(flat[at - rows[0] : to - rows[0]] ^ flat[a - rows[0]]).sum(1, dtype=np.int64)
                most = bands.most(size[a] + size[at:to])
                hit = np.flatnonzero(far <= most)
                if len(hit):
                    yield np.full(len(hit), order[a]), order[at:to][hit], far[hit] / np.maximum(1, most[hit])
                at = to


def join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the parts that x[i] and y[i] are in; labels are the parts' least nodes, in place."""
    while len(x):
        hi, lo = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        apart = hi != lo
        x, y = x[apart], y[apart]
        np.minimum.at(label, hi[apart], lo[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) of a cheapest spanning forest; `label` is left with its parts."""
    order, out = np.argsort(cost, kind="stable"), []
    while True:
        order = order[label[a[order]] != label[b[order]]]
        if not len(order):
            return np.unique(np.concatenate(out)) if out else order
        ends = np.concatenate((label[a[order]], label[b[order]]))
        rank = np.concatenate((np.arange(len(order)),) * 2)
        by = np.lexsort((rank, ends))
        pick = order[np.unique(rank[by][np.unique(ends[by], return_index=True)[1]])]  # each part's cheapest way out
        out.append(pick)
        join(label, a[pick], b[pick])


def _offer(batches: Iterator[pa.RecordBatch], percent: int, again: bool) -> Iterator[pa.RecordBatch]:
    """Each group's pairs to verify: a forest of its likeliest pairs; `again`, when some of them failed, all likely pairs between the parts that are left."""
    for batch in batches:
        out: list[tuple[np.ndarray, ...]] = []
        for row in range(batch.num_rows):
            centre, block, members = batch.column("centre")[row].as_py(), batch.column("block")[row].as_py(), batch.column("members")[row].values
            names, first = np.unique(members.field("name").to_numpy(), return_index=True)
            n, sketches = members.field("n").to_numpy()[first], members.field("sketch").take(pa.array(first))
            found = list(likely_pairs(n, [np.frombuffer(x.as_buffer(), "<u8") for x in sketches], percent))
            if not found:
                continue
            a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)  # names ascend
            part = np.unique(members.field("part").to_numpy()[first], return_inverse=True)[1]
            start = np.unique(part, return_index=True)[1][part]  # parts that are connected already, by their first node
            label = start.copy()
            pick = forest(label, a, b, far)
            if again:
                failed = batch.column("failed")[row].values
                lost = np.searchsorted(names, failed.field("a").to_numpy()) * len(names) + np.searchsorted(names, failed.field("b").to_numpy())
                held = pick[~np.isin(a[pick] * len(names) + b[pick], lost)]
                label = start.copy()
                join(label, a[held], b[held])
                pick = np.flatnonzero((label[a] != label[b]) & ~np.isin(a * len(names) + b, lost))
            out.append((np.full(len(pick), centre), np.full(len(pick), block), names[a[pick]], names[b[pick]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["centre", "block", "a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, ends: the texts of both) to (a, b, linked), by the exact sets."""
    for batch in batches:
        linked: list[bool] = []
        for row in range(batch.num_rows):
            ends = {x["name"]: x["text"] for x in batch.column("ends")[row].as_py()}
            pair = pa.array([ends[batch.column(c)[row].as_py()] for c in ("a", "b")], pa.large_string())
            x, y = (s for c in chunks(pair) for s in shingle_sets(words(c, lower=True), width))
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b, linked) for distinct written pairs. Few pairs are broadcast to the sets, so that only their texts move, and go to few tasks."""
    ends, n = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("name")), pairs.count()
    if n <= BROADCAST_PAIRS:
        ends = F.broadcast(ends)
    both = sets.select("name", "text").join(ends, "name").groupBy("a", "b").agg(F.collect_list(F.struct("name", "text")).alias("ends"))
    return both.coalesce(n // VERIFIED + 1).mapInArrow(partial(_verify, width=width, percent=percent), "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Components of documents whose word-shingle sets have Jaccard >= percent / 100: (doc_id, n_shingles, component_id).

    One row per input row. A null, empty or blank text has the empty set, is linked with nothing and is a component of its own.
    Rows that repeat a doc_id are rows of their own with that id; where such rows fall in different components, each has
    its own component's least id. A row without doc_id keeps its size and has no component. Other columns aren't read.
    """
    shelf, n_buckets = Shelf(docs.sparkSession, "jaccard"), 2 * buckets(docs.sparkSession)  # a task holds the keys of its bucket
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.where("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    entered = named.mapInArrow(partial(_enter, width=width, percent=percent, n_buckets=n_buckets), "bucket int, kind int, a binary, b binary, c binary")
    met = shelf.put(entered.repartitionById(n_buckets, F.col("bucket")).mapInArrow(_meet, "kind int, a long, b long, n long, digest long"), "met")
    members = met.where("kind = 0").selectExpr("a as doc_id", "b as name", "n", "digest")
    ties = shelf.put(met.where("kind = 1").select(F.col("a").alias("centre"), F.col("b").alias("name")).distinct(), "ties")
    # Any document of a class of equal sets can stand for it: the one with the least id does, and of rows with that id the one whose
    # text has the least hash. Rows that agree in both are told by their number, and become one.
    wanted = ties.select("centre").union(ties.select("name")).distinct().withColumnRenamed("centre", "name")
    rows = members.where("n > 0").groupBy("name", "doc_id", "digest").agg((F.count("*") > 1).alias("repeated"))
    least = rows.groupBy("name").agg(F.min(F.struct("doc_id", "digest", "repeated")).alias("row")).select("name", "row.*").join(wanted, "name")
    chosen = named.join(least, ["doc_id", "digest"]).select("name", "text", "repeated").mapInArrow(partial(_sketch, width=width), "name long, n long, sketch binary, text string, repeated boolean")
    sets = shelf.put(chosen, "chosen")
    repeated = sets.where("repeated")
    if not repeated.isEmpty():
        sets = shelf.put(sets.where("not repeated").union(repeated.dropDuplicates(["name"])), "sets")
    links = _linked(shelf, ties, sets, percent, width, block)
    parts = connected(links, shelf)
    labelled = members.join(parts, members.name == parts.node, "left").select("doc_id", members.name, "n", F.coalesce("root", members.name).alias("root"))
    labelled = shelf.put(labelled, "labelled")
    shelf.drop("met", "ties", "chosen", "sets", *(f"{t}{k}" for t in ("checked", "rechecked", "parts") for k in "123"), "large", "members")
    # The rows of one component may be a third of all: the least id is found by partial aggregates; those of large components are
    # broadcast, if they are few enough, and so don't meet in one task.
    roots = shelf.put(labelled.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("docs")), "roots")
    big = roots.where(F.col("docs") > LARGE).select("root", F.col("component_id").alias("of_large"))
    big, small = (F.broadcast(big), roots.where(F.col("docs") <= LARGE)) if big.count() <= BROADCAST_PAIRS else (None, roots)
    rows = labelled.where("n > 0")
    if big is not None:
        rows = rows.join(big, "root", "left")
        met = rows.where("of_large is null").join(small.select("root", "component_id"), "root")
        rows = rows.where("of_large is not null").select("doc_id", F.col("n").alias("n_shingles"), F.col("of_large").alias("component_id")).union(met.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
    else:
        rows = rows.join(small, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rows = rows.union(labelled.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return rows.union(_without_id(texts, width))


def _without_id(texts: DataFrame, width: int) -> DataFrame:
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) for c in chunks(batch.column(0)) for x in shingle_sets(words(c, lower=True), width)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return texts.where("doc_id is null").select("text").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (centre, name, ...) with the number of blocks of their centre, and their own block."""
    sized = rows.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.join(sized, "centre").withColumn("mine", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))


def _all_pairs() -> Column:
    """The names of all pairs of blocks that a member's block is in; two blocks meet as one."""
    pair = lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine"))
    return F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))


def _compared(shelf: Shelf, dealt: DataFrame, sets: DataFrame, percent: int, width: int, step: str) -> DataFrame | None:
    """Verified links (a, b) that connect all that is linked among the members of each (centre, block), None where there is no pair; `part` tells what is connected already."""
    groups = (
        dealt.join(sets.select("name", "n", "sketch"), "name").groupBy("centre", "block")
        .agg(F.collect_list(F.struct("name", "n", "sketch", "part")).alias("members"))
    )
    groups = shelf.put(groups, f"groups{step}")
    tree = shelf.put(groups.mapInArrow(partial(_offer, percent=percent, again=False), "centre long, block long, a long, b long"), f"tree{step}")
    pairs = shelf.put(tree.select("a", "b").distinct(), f"pairs{step}")
    if pairs.isEmpty():
        shelf.drop(f"groups{step}", f"tree{step}", f"pairs{step}")
        return None
    checked = shelf.put(verified(pairs, sets, percent, width), f"checked{step}")
    links, failed = checked.where("linked").select("a", "b"), checked.where("not linked").select("a", "b")
    if n := failed.count():
        few = F.broadcast if n <= BROADCAST_PAIRS else lambda df: df  # the groups with their sketches stay where they are
        lost = shelf.put(tree.join(few(failed), ["a", "b"]), f"lost{step}")
        few = F.broadcast if lost.count() <= BROADCAST_PAIRS else lambda df: df
        lost = lost.groupBy("centre", "block").agg(F.collect_list(F.struct("a", "b")).alias("failed"))
        more = groups.join(few(lost), ["centre", "block"]).mapInArrow(partial(_offer, percent=percent, again=True), "centre long, block long, a long, b long")
        rest = shelf.put(more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), f"rest{step}")
        if not rest.isEmpty():
            links = links.union(shelf.put(verified(rest, sets, percent, width), f"rechecked{step}").where("linked").select("a", "b"))
        shelf.drop(f"lost{step}", f"rest{step}")
    shelf.drop(f"groups{step}", f"tree{step}", f"pairs{step}")
    return links


def _linked(shelf: Shelf, ties: DataFrame, sets: DataFrame, percent: int, width: int, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between names of sets that connect all that is linked."""
    spark, key = ties.sparkSession, ["centre", "block", "name", "part"]
    members = _blocks(ties.union(ties.select("centre", F.col("centre").alias("name")).distinct()), block).withColumn("part", F.col("name"))
    members = shelf.put(members, "members")
    own = F.when(F.col("blocks") <= 2, F.lit(0)).otherwise(F.col("mine"))
    links = _compared(shelf, members.withColumn("block", own.cast("long")).select(*key), sets, percent, width, "1")
    if links is None:
        return ties.select(F.col("centre").alias("a"), F.col("name").alias("b")).limit(0)
    large = shelf.put(members.where("blocks > 2").select("centre", "name"), "large")
    if large.isEmpty():
        return links

    def parted(links: DataFrame, step: str) -> DataFrame:
        found = connected(links, Shelf(spark, "jaccard-parts"))
        rows = large.join(found, large.name == found.node, "left").select("centre", large.name, F.coalesce("root", large.name).alias("part"))
        return shelf.put(rows, f"parts{step}")

    parts = parted(links, "1")
    leaders = _blocks(parts.groupBy("centre", "part").agg(F.min("name").alias("name")), block)
    dealt = leaders.withColumn("block", F.explode(_all_pairs().cast("array<bigint>"))).select(*key)
    if (more := _compared(shelf, dealt, sets, percent, width, "2")) is not None:
        links = links.union(more)
        parts = parted(links, "2")
    # Whatever is still apart: members outside their centre's largest part meet everything there, blocks of like parts don't.
    sizes = parts.groupBy("centre", "part").agg(F.count("*").alias("n"))
    most = sizes.groupBy("centre").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("all"), F.max("n").alias("in_main")).where("`all` > in_main")
    placed = parts.join(most, "centre").withColumn("outer", F.col("part") != F.col("main"))
    inner_blocks, outer_blocks = F.ceil(F.col("in_main") / block).cast("int"), F.ceil((F.col("all") - F.col("in_main")) / block).cast("int")
    placed = placed.withColumns({"inners": inner_blocks, "blocks": outer_blocks}).withColumn("mine", F.pmod(F.xxhash64("name"), F.when(F.col("outer"), F.col("blocks")).otherwise(F.col("inners"))).cast("int"))
    # Names of meetings: below blocks^2 those of two outer blocks, from there on those of an outer and an inner one.
    meeting = lambda outer, inner: F.col("blocks") * F.col("blocks") + outer * F.col("inners") + inner
    with_inner = F.transform(F.sequence(F.lit(0), F.col("inners") - 1), lambda i: meeting(F.col("mine"), i))
    with_outer = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: meeting(o, F.col("mine")))
    meets = F.when(F.col("outer"), F.concat(_all_pairs(), with_inner)).otherwise(with_outer)
    last = placed.withColumn("block", F.explode(meets.cast("array<bigint>"))).select(*key)
    more = _compared(shelf, last, sets, percent, width, "3")
    return links if more is None else links.union(more)


def near_duplicates_sql(percent: int = 80, width: int = 5) -> str:
    """The same rows in DuckDB SQL over `documents`, from all pairs that share a shingle."""
    return f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) < {width} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) end)) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= {percent} * (x.n + y.n - common)),
reach(a, b) as (select doc_id, doc_id from d union select r.a, l.b from reach r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.root as component_id from d left join n on n.doc_id = d.doc_id join (select a, min(b) as root from reach group by a) r on r.a = d.doc_id"""
