"""Where texts repeat: content-chosen anchors, met in hash buckets, sent back to their documents as spans.

Over the tokens of a text (words or bytes) an anchor is the place of the smallest k-gram hash in some window of W tokens. Equal
windows choose the same place, so two windows of W equal tokens always share an anchor, and only about 2/(W-k+2) of all places
are one. An anchor's context is every token that a window around it can reach: W-k before it, W from it on.

An occurrence is judged in three steps, each a hash exchange: (1) Copies are merged: occurrences whose whole context is found again
are settled there and then, first inside a task (so a hot passage or a large group of copies sends one entry a task, not one a
row), then in the anchor's bucket. (2) Anchors with different contexts send one occurrence of each distinct context on, with its
tokens, to be compared (by `automata` or `suffixes`). (3) Spans return to their documents.

An anchor with many different contexts, as at the edges of a passage that a large part of the documents hold, is split before it is
compared. Each window that holds the anchor reaches a number of tokens to the right of it; the numbers are cut into PARTS ranges, and
two windows of one range that are equal agree over all but the range's width of their W tokens. That agreement is the new, longer anchor of a part,
with a hash of its own, so the parts of an anchor spread over the buckets by what stands left and right of it. Parts that still
have many contexts are split again, until a range is one window wide and its anchor is the whole window; then equal hashes settle
everything. A task that meets many contexts of an anchor itself only tells the anchor's bucket so, and sends the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf, buckets
from .text import U, Chunk, Words, chunks, mix, running_hash, span_hash, window_minima, words

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: after all others
FLUSH = 1 << 18
PARTS = 8
_FULL = np.dtype([("start", "<i4"), ("end", "<i4")])
_PICK = np.dtype([("anchor", "<i8"), ("pos", "<i4"), ("part", "u1"), ("hot", "u1")])
_KEY = ["doc", "hash", "at"]
MANY, SPLIT = 1, 2  # flags of an entry: its context was met again; its anchor was met with many contexts


@dataclass(frozen=True)
class Rule:
    """Tokens, window and anchor lengths, whether the first occurrence of a repeated window stays, and from how many different
    contexts on an anchor is split: met by one task, and in all. The last two change the plan, never the result."""

    by_words: bool
    window: int
    gram: int
    keep_first: bool
    many_here: int = 32
    many: int = 256

    def __post_init__(self) -> None:
        if not self.gram <= self.window < 1 << 15:
            raise ValueError("a window has fewer than 32,768 tokens, and no fewer than an anchor")

    @property
    def before(self) -> int:
        return self.window - self.gram


@dataclass(frozen=True)
class Part:
    """Windows around an anchor that reach `right` to `right` + `width` - 1 tokens from its place on; `parent`: the part it is cut from."""

    right: int
    width: int
    parent: int
    window: int

    @property
    def left(self) -> int:
        """Tokens before the place that all those windows hold."""
        return self.window - self.right - self.width + 1

    @property
    def low(self) -> int:
        """Tokens before the place that any of them holds."""
        return self.window - self.right

    @property
    def high(self) -> int:
        return self.right + self.width - 1


def parts_of(rule: Rule) -> list[list[Part]]:
    """The parts of each level of splitting: all windows of an anchor at first, single windows in the end."""
    levels = [[Part(rule.gram, rule.before + 1, 0, rule.window)]]
    while any(p.width > 1 for p in levels[-1]):
        below = []
        for i, p in enumerate(levels[-1]):
            step = -(-p.width // PARTS)
            below += [Part(p.right + a, min(step, p.width - a), i, rule.window) for a in range(0, p.width, step)]
        levels.append(below)
    return levels


def tokens(c: Chunk, rule: Rule) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """A chunk's token values, and the first token of each text (one more entry than texts)."""
    if rule.by_words:
        w = words(c, lower=False)
        return w.hash, w.doc, w
    return c.data, c.offsets, None


_BYTES = mix(np.arange(1, 257, dtype=U) + U(0xB17E))


def find(values: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk: text, place in the text, anchor's hash, context's hash, tokens of context before and after the place."""
    values = _BYTES[values] if values.dtype == np.uint8 else values
    running = running_hash(values)
    at = np.arange(max(0, len(values) - rule.gram + 1))
    gram = span_hash(running, at, at + rule.gram)
    limits = bounds.copy()  # a gram must end inside its text: windows of grams are `before` + 1 wide and stop gram - 1 short
    pos = _minima(gram, rule.before + 1, limits, rule.gram)
    text = np.searchsorted(bounds, pos, "right") - 1
    low, high = np.maximum(bounds[text], pos - rule.before), np.minimum(bounds[text + 1], pos + rule.window)
    anchor = mix(gram[pos] + U(0xA2C5))  # the smallest hashes are alike in their upper bits, which deal entries to buckets
    return text, pos - bounds[text], anchor, _context(running, pos, pos - low, high - pos), pos - low, high - pos


def _minima(gram: np.ndarray, width: int, bounds: np.ndarray, k: int) -> np.ndarray:
    """Anchors of windows of `width` grams that lie inside one text."""
    if not len(gram):
        return np.zeros(0, np.int64)
    # Cut each text's grams off before those that reach into the next text: as segments of their own they hold no window
    # as long as they are shorter than one, and they are k - 1 long.
    stops = np.minimum(np.maximum(bounds[1:-1] - (k - 1), bounds[:-2]), len(gram)) if len(bounds) > 2 else bounds[:0]
    cuts = np.unique(np.concatenate(([0], np.minimum(bounds[1:-1], len(gram)), stops, [len(gram)])))
    pos = window_minima(gram, width, cuts)
    if k - 1 < width:
        return pos
    text = np.searchsorted(bounds, pos, "right") - 1
    return pos[pos + k <= bounds[text + 1]]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, the first one foremost, and the number of each sorted row's group by all of them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _context(running: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(span_hash(running, pos - low, pos + high) ^ (low.astype(U) << U(40)) ^ high.astype(U))


def find_parts(values: np.ndarray, bounds: np.ndarray, place: np.ndarray, of: np.ndarray, level: list[Part], window: int) -> tuple[np.ndarray, ...]:
    """Anchors of the next level in stretches of tokens, each around one place and cut for one part: stretch, part, hash, context's hash, tokens before and after."""
    values = _BYTES[values] if values.dtype == np.uint8 else mix(values.astype(U) + U(1))
    running, out = running_hash(values), []
    low, high, pos = place, np.diff(bounds) - place, bounds[:-1] + place
    for i, p in enumerate(level):
        lo, hi = np.minimum(low, p.low), np.minimum(high, p.high)
        at = np.flatnonzero((of == p.parent) & (lo >= p.left) & (hi >= p.right) & (lo + hi >= window))
        if len(at):
            anchor = mix(span_hash(running, pos[at] - p.left, pos[at] + p.right) ^ U((p.right << 20) + p.width))
            out.append((at, np.full(len(at), i), anchor, _context(running, pos[at], lo[at], hi[at]), lo[at], hi[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6


class _Entries:
    """Occurrences as columns: doc, hash (of the text), anchor, context, pos, low, high, part, flag."""

    NAMES = ("doc", "hash", "anchor", "context", "pos", "low", "high", "part", "flag")

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        for name, column in zip(self.NAMES, zip(*parts, strict=True), strict=True):
            setattr(self, name, np.concatenate(column))

    def take(self, at: np.ndarray) -> _Entries:
        return _Entries([tuple(getattr(self, n)[at] for n in self.NAMES)])

    def settle(self, rule: Rule) -> tuple[_Entries, np.ndarray]:
        """Sorted by anchor, context and place; and which of them are settled because the same context stands elsewhere."""
        order, _ = _grouped(self.anchor, self.context, self.doc, self.hash, self.pos)
        e = self.take(order)
        n = len(order)
        new = np.ones(n, bool)
        new[1:] = (e.anchor[1:] != e.anchor[:-1]) | (e.context[1:] != e.context[:-1])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        size, many = np.bincount(group, minlength=1), np.bincount(group, e.flag == MANY, minlength=1)
        at = head[group]
        earliest = (e.doc == e.doc[at]) & (e.hash == e.hash[at]) & (e.pos == e.pos[at])  # an equal row is not earlier
        e.first, e.size = new, size[group]
        whole = e.low + e.high >= rule.window  # otherwise no window holds the anchor
        return e, whole & (~earliest if rule.keep_first else ((size > 1) | (many > 0))[group])

    def contexts(self) -> np.ndarray:
        """For each settled row the number of different contexts of its anchor; rows stand sorted by anchor."""
        new = np.concatenate(([True], self.anchor[1:] != self.anchor[:-1])) if len(self.anchor) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        return np.bincount(group, self.first, minlength=1)[group]


_ROW = "doc long, hash long, at int, full binary, pick binary"


def _rows(e: _Entries, full: np.ndarray, need: np.ndarray, hot: np.ndarray, by_place: bool) -> list[tuple]:
    """Rows (doc, hash, at, settled spans, occurrences to compare or to split), one a document, or one a place (`at`) of it."""
    at = e.pos if by_place else np.zeros_like(e.pos)
    order, group = _grouped(e.doc, e.hash, at)
    told = (full | need | hot)[order]
    order, group = order[told], group[told]
    out = []
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(order) else order
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True) if len(new) else ():
        o = order[a:b]
        f, n = o[full[o]], o[(need | hot)[o]]
        span, pick = np.empty(len(f), _FULL), np.empty(len(n), _PICK)
        span["start"], span["end"] = e.pos[f] - e.low[f], e.pos[f] + e.high[f]
        span = np.unique(span.view("<i8")).view(_FULL)  # rows that are equal have equal spans
        pick["anchor"], pick["pos"], pick["part"], pick["hot"] = e.anchor[n].astype(np.int64), e.pos[n], e.part[n], hot[n]
        out.append((int(e.doc[o[0]]), int(e.hash[o[0]]), int(at[o[0]]), span.tobytes(), pick.tobytes()))
    return out


def _enter(batches: Iterator[pa.RecordBatch], rule: Rule, n_buckets: int, level: int) -> Iterator[pa.RecordBatch]:
    """Texts, or at later levels stretches, to rows that go back to their document, and packed entries of a bucket."""
    held: list[tuple[np.ndarray, ...]] = []
    size, parts = 0, parts_of(rule)[level]
    last = all(p.width == 1 for p in parts)

    def flush() -> pa.RecordBatch:
        e, settled = _Entries(held).settle(rule)
        held.clear()
        none = np.zeros(len(settled), bool)
        hot = none if last else e.first & (e.contexts() > rule.many_here)
        rows = [((d * 1_000_003 + h + at) % n_buckets, d, h, at, full, pick, None) for d, h, at, full, pick in _rows(e, settled, none, hot, level > 0)]
        # Of a context met twice here one occurrence goes on, marked so; of an anchor with many contexts only a mark.
        e.flag = (e.size > 1).astype(np.uint8) * MANY
        mark = hot & np.concatenate(([True], e.anchor[1:] != e.anchor[:-1]))
        e.flag[mark] = SPLIT
        e = e.take(np.flatnonzero(e.first & (~hot | mark)))
        slot = ((e.anchor >> U(32)) * U(n_buckets)) >> U(32)
        order = np.argsort(slot.astype(np.uint16) if n_buckets <= 1 << 16 else slot, kind="stable")
        e, slot = e.take(order), slot[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(slot)], strict=True) if len(slot) else ():
            rows.append((int(slot[a]), None, None, None, None, None, _pack(e.take(np.arange(a, b)))))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["bucket", *_KEY, "full", "pick", "entries"])

    def hold(row: np.ndarray, doc: np.ndarray, h: np.ndarray, anchor: np.ndarray, context: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray) -> None:
        held.append((doc[row], h[row], anchor, context, pos.astype(np.int32), low.astype(np.int16), high.astype(np.int16), part.astype(np.uint8), np.zeros(len(pos), np.uint8)))

    for batch in batches:
        doc, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "hash"))
        for c in chunks(batch.column("text")):
            if level:
                row = np.arange(c.first, c.last)
                place, part, pos = (batch.column(n).to_numpy(zero_copy_only=False)[row] for n in ("low", "part", "at"))
                values, bounds = _stretches(c, rule)
                at, part, anchor, context, low, high = find_parts(values, bounds, place, part, parts, rule.window)
                hold(row[at], doc, h, anchor, context, pos[at], low, high, part)
            else:
                values, bounds, _ = tokens(c, rule)
                at, pos, anchor, context, low, high = find(values, bounds, rule)
                hold(c.first + at, doc, h, anchor, context, pos, low, high, np.zeros(len(pos)))
            size += len(at)
            if size >= FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


def _stretches(c: Chunk, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Encoded tokens of a chunk of contexts, and where each starts."""
    return (np.frombuffer(c.data, np.uint32), c.offsets // 4) if rule.by_words else (c.data, c.offsets)


def _pack(e: _Entries) -> bytes:
    """Entries sorted by document, each document's id and hash once."""
    order, group = _grouped(e.doc, e.hash)
    e = e.take(order)
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.array([len(new), len(order)], "<i8")
    six = lambda x: x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    short = lambda x: x.astype("<u2").tobytes()
    docs = (e.doc[new].astype("<i8").tobytes(), e.hash[new].astype("<i8").tobytes(), np.diff(np.append(new, len(order))).astype("<u4").tobytes())
    return b"".join([sizes.tobytes(), *docs, six(e.anchor), six(e.context), e.pos.astype("<i4").tobytes(), short(e.low), short(e.high), e.part.tobytes(), e.flag.tobytes()])


def _unpack(data: memoryview) -> tuple[np.ndarray, ...]:
    docs, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    def six() -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :6] = take("u1", 6 * n).reshape(-1, 6)
        return out.view("<u8").ravel()

    doc, h, count = take("<i8", docs), take("<i8", docs), take("<u4", docs)
    anchor, context = six(), six()
    return np.repeat(doc, count), np.repeat(h, count), anchor, context, take("<i4", n), take("<u2", n).astype(np.int32), take("<u2", n).astype(np.int32), take("u1", n), take("u1", n)


def _meet(batches: Iterator[pa.RecordBatch], rule: Rule, level: int) -> Iterator[pa.RecordBatch]:
    """A bucket's rows to (doc, hash, at, full, pick)."""
    kinds, last = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), all(p.width == 1 for p in parts_of(rule)[level])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_KEY, "full", "pick"])

    parts = []
    for batch in batches:
        done = [r for r in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "full", "pick")), strict=True) if r[3] is not None]
        if done:
            yield batch_of(done)
        for x in batch.column("entries"):
            if x.is_valid:
                parts.append(_unpack(memoryview(x.as_buffer())))
    if not parts:
        return
    e = _Entries(parts)
    parts.clear()
    order = np.argsort(e.anchor, kind="stable")
    a = e.anchor[order]
    again = np.concatenate((a[1:] == a[:-1], [False]))
    again[1:] |= a[1:] == a[:-1]
    again |= e.flag[order] == MANY
    told = np.unique(e.anchor[e.flag == SPLIT])  # a task met many contexts of these
    order = order[again & (e.flag[order] != SPLIT)]
    if not len(order):
        return
    e, settled = e.take(order).settle(rule)
    n, whole = e.contexts(), e.first & (e.low + e.high >= rule.window)
    split = np.zeros(len(n), bool) if last else (n > rule.many) | np.isin(e.anchor, told)
    # Anchors with several contexts: the first occurrence of each is compared.
    rows = _rows(e, settled, whole & ~split & (n > 1), whole & split, level > 0)
    for i in range(0, len(rows), 5000):
        yield batch_of(rows[i : i + 5000])


_CONTEXT = "anchor long, doc long, hash long, at int, low int, part int, hot boolean, text binary, repeated boolean"


def _contexts(batches: Iterator[pa.RecordBatch], rule: Rule, encode: Callable, level: int) -> Iterator[pa.RecordBatch]:
    """(doc, hash, at, text or stretch, picks, repeated) to the occurrences to compare or to split, with the tokens of their contexts; of a
    document whose row is repeated, those of one row a task."""
    parts = parts_of(rule)[level]
    left, right = np.array([p.low for p in parts]), np.array([p.high for p in parts])
    parent = np.array([p.parent for p in parts])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.bool_())
    names = ["anchor", "doc", "hash", "at", "low", "part", "hot", "text", "repeated"]
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        if not level:
            again = zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "again")), strict=True)
            batch = batch.take(pa.array([i for i, (d, x, r) in enumerate(again) if not r or not ((d, x) in seen or seen.add((d, x)))], pa.int64()))
        repeated = [False] * batch.num_rows if level else batch.column("again").to_pylist()
        doc, h, picks = (batch.column(c).to_pylist() for c in ("doc", "hash", "picks"))
        for c in chunks(batch.column("text")):
            if level:
                values, bounds = _stretches(c, rule)
            else:
                values, bounds, _ = tokens(c, rule)
                values = encode(values)
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for i in range(c.first, c.last):
                stretch = values[bounds[i - c.first] : bounds[i - c.first + 1]]
                pick = np.frombuffer(b"".join(picks[i]), _PICK)
                base = 0
                if level:
                    pick = pick[parent[pick["part"]] == batch.column("part")[i].as_py()]
                    base = batch.column("at")[i].as_py() - batch.column("low")[i].as_py()  # where in the document the stretch starts
                pos, low, high = pick["pos"] - base, left[pick["part"]], right[pick["part"]]
                low = np.minimum(low, pos)
                for column, x in zip(out, (pick["anchor"], [doc[i]] * len(pick), [h[i]] * len(pick), pick["pos"], low, pick["part"], pick["hot"] > 0), strict=False):
                    column.extend(x.tolist() if isinstance(x, np.ndarray) else x)
                out[7].extend(stretch[p - b : p + a].tobytes() for p, b, a in zip(pos.tolist(), low.tolist(), high.tolist(), strict=True))
                out[8].extend([repeated[i]] * len(pick))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _compare(batches: Iterator[pa.RecordBatch], resolve: Callable) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, whole anchors at a time, to (doc, hash, spans)."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        cols = [t.column(c).to_numpy() for c in ("anchor", "doc", "hash", "at", "low")]
        at, start, end = resolve(*cols, t.column("text"))
        if len(at):
            order, group = _grouped(cols[1][at], cols[2][at])
            both = np.empty(len(at), _FULL)
            both["start"], both["end"] = start[order], end[order]
            new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            row = at[order][new]
            full = [both[x:y].tobytes() for x, y in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][row]), pa.array(cols[2][row]), pa.array(full, pa.binary())], ["doc", "hash", "full"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        a = t.column("anchor").to_numpy()
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1]))  # rows come sorted: the last anchor may go on
        rest = t.slice(cut)
        if cut:
            yield from done(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield from done(rest)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal spans in order; touching ones are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(doc, hash, text, carried columns): a row's key is its doc_id (null: after all others) and its text's hash; equal rows share one key."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("hash"), text, *(carry or []))


def spans(keyed_docs: DataFrame, shelf: Shelf, rule: Rule, encode: Callable, resolve: Callable) -> DataFrame:
    """(doc, hash, spans): per document key a list of binaries of (start, end) pairs in tokens; without spans, no row."""
    n, found = buckets(keyed_docs.sparkSession), []
    source = keyed_docs.withColumn("at", F.lit(0))
    repeated = shelf.put(keyed_docs.groupBy("doc", "hash").agg(F.count("*").alias("n")).where("n > 1").select("doc", "hash", F.lit(True).alias("again")), "repeated")
    twice = not repeated.isEmpty()  # equal rows: one of them stands for all
    gather = F.collect_set if twice else F.collect_list
    for level, parts in enumerate(parts_of(rule)):
        entered = source.mapInArrow(partial(_enter, rule=rule, n_buckets=n, level=level), f"bucket int, {_ROW}, entries binary")
        met = shelf.put(entered.repartitionById(n, F.col("bucket")).mapInArrow(partial(_meet, rule=rule, level=level), _ROW), f"met{level}")
        found.append(met.where("length(full) > 0").select("doc", "hash", "full"))
        if all(p.width == 1 for p in parts):
            break
        picks = met.where("length(pick) > 0").groupBy(*_KEY).agg(gather("pick").alias("picks"))
        if not level:
            picks = picks.join(repeated, ["doc", "hash"], "left") if twice else picks.withColumn("again", F.lit(False))
        contexts = shelf.put(source.join(picks, _KEY).mapInArrow(partial(_contexts, rule=rule, encode=encode, level=level), _CONTEXT), f"contexts{level}")
        if twice and not level:
            once = contexts.where("repeated").dropDuplicates(["anchor", *_KEY, "part"])
            contexts = shelf.put(contexts.where("not coalesce(repeated, false)").union(once), "distinct")
        compared = contexts.where("not hot").repartition(n, "anchor").sortWithinPartitions("anchor")
        found.append(compared.mapInArrow(partial(_compare, resolve=resolve), "doc long, hash long, full binary"))
        source = contexts.where("hot")
        if source.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy("doc", "hash").agg(gather("full").alias("spans"))


def with_spans(keyed_docs: DataFrame, found: DataFrame) -> DataFrame:
    return keyed_docs.join(found, ["doc", "hash"], "left")


def span_arrays(parts: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """A document's spans, merged."""
    both = np.frombuffer(b"".join(parts or []), _FULL)
    return merge(both["start"].astype(np.int64), both["end"].astype(np.int64))
