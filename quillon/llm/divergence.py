"""Source divergence audit: how the use of terms in each source of a language differs from its other sources and from the whole.

A language's vocabulary holds the terms of `least` documents or more. It is sorted and cut into shards; each shard becomes a minimal
acyclic transducer, which leads a term to its place in the order. Texts are then counted again: each task sums up its terms by source and
sends them to the shard that their place in the order falls into, where they run through the transducer, which drops terms that aren't
kept and turns the others into ordinals. Counts are held by ordinal from there on, and ordinals decide ties.

A term's share p of a group is 1 + floor(10^9 * (count + 1) / (N + V)), its divergence from another share q floor((p - q)^2 / q). Both
are whole numbers of 64 bits: the division is done in three steps of three digits, so counts may reach 9 * 10^15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counting import FLUSH, PACKED, Bitmap, Sums, batch_of, bits, by_hash, frequent, sent, summed
from .counting import BITS as WIDTH
from .shared import Shelf, buckets
from .text import CHUNK_BYTES, U, Chunk, Words, chunks, mix, words
from .transducer import Strings, Transducer, build

LEAST = 3
TOP = 200
SHARD = 1 << 15  # terms of one transducer
#: Bytes that no term holds: all of ASCII but the letters.
GAPS = np.ones(256, bool)
GAPS[0x41:0x5B] = GAPS[0x61:0x7B] = GAPS[0x80:] = False
_CHUNK = 1 << 20
_BLOCK = 1 << 20
_PLACE = 40  # bits of an ordinal


def _names(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct values of a column, null as empty, and each row's."""
    coded = column.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _terms(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Chunk, Words, np.ndarray]]:
    """(batch, chunk, terms, key of each term, which holds its language), over rows whose first columns are text and lang."""
    for batch in batches:
        langs, of = _names(batch.column(1))
        seed = np.array([_hash(x) for x in langs], U)
        for c in chunks(batch.column(0), size):
            w = words(c, lower=True, gaps=GAPS)
            yield batch, c, w, mix(w.hash ^ np.repeat(seed[of[c.first : c.last]], np.diff(w.doc)))


def _held_by(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts to packed counts of the documents that hold each term."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, w, key in _terms(batches):
            doc = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, bool)
            yield k[new], np.ones(int(new.sum()), np.int64)

    return sent(parts(), n_buckets)


_SPELLED = "bucket int, kind int, langs array<string>, keys binary, which binary, terms binary, lengths binary"


def _texts(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows (number, kind, names, four byte strings) as a batch."""
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4]
    data = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], [x.split()[0] for x in names.split(", ")])


def _spelled(batches: Iterator[pa.RecordBatch], kept, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Terms whose key is in the bitmap, packed by bucket; a task repeats one as rarely as its memory of them lasts."""
    seen = np.zeros(0, U)
    for batch, c, w, key in _terms(batches, _CHUNK):
        key, at = np.unique(key, return_index=True)
        new = kept.value.has(key)
        if len(seen):
            new &= seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] != key
        key, at = key[new], at[new]
        if not len(key):
            continue
        seen = np.union1d(seen, key) if len(seen) < FLUSH else key
        langs, of = _names(batch.column(1))
        lang, start, end, low = of[c.first + np.searchsorted(w.doc, at, "right") - 1], w.start[at], w.end[at], _lowered(c)
        slot = by_hash(key, n_buckets)
        cut = np.flatnonzero(np.diff(slot, prepend=-1)).tolist() + [len(slot)]
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            names, which = np.unique(lang[a:b], return_inverse=True)
            rows.append((int(slot[a]), 1, [langs[i] for i in names.tolist()], key[a:b].tobytes(), which.astype("<u4").tobytes(), _gathered(low, start[a:b], end[a:b]), (end[a:b] - start[a:b]).astype("<u4").tobytes()))
        yield _texts(rows, _SPELLED)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's kept keys, which come first, then spelled terms: each kept term once."""
    kept, left, known = [], None, np.zeros(0, bool)
    for batch in batches:
        for kind, langs, key, which, terms, lengths in zip(*(batch.column(x) for x in ("kind", "langs", "keys", "which", "terms", "lengths")), strict=True):
            key = np.frombuffer(key.as_buffer(), "<u8")
            if kind.as_py() == 0:
                kept.append(key)
                continue
            if left is None:
                left = np.sort(np.concatenate([np.zeros(0, U), *kept]))
                known = np.zeros(len(left), bool)
            if not len(left):
                return
            at = np.minimum(np.searchsorted(left, key), len(left) - 1)
            new = np.flatnonzero((left[at] == key) & ~known[at])
            known[at[new]] = True
            ends = np.cumsum(np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64))
            data, lang = terms.as_buffer().to_pybytes(), langs.values.take(pa.array(np.frombuffer(which.as_buffer(), "<u4")[new]))
            spelled = [data[b - n : b] for b, n in zip(ends[new].tolist(), np.diff(ends, prepend=0)[new].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([lang, pa.array(spelled, pa.binary())], ["lang", "term"])


def _lowered(c: Chunk) -> np.ndarray:
    return np.where((c.data > 64) & (c.data < 91), c.data + 32, c.data).astype(np.uint8)


def vocabulary(docs: DataFrame, shelf: Shelf, least: int = LEAST) -> tuple[DataFrame, Broadcast]:
    """(lang, term as bytes) of the terms in `least` documents of their language or more, and their bitmap; docs has text and lang."""
    n = buckets(docs.sparkSession)
    packed = docs.select("text", "lang").mapInArrow(partial(_held_by, n_buckets=n), PACKED)
    often = shelf.put(packed.repartitionById(n, F.col("bucket")).mapInArrow(partial(frequent, least=least), PACKED), "often")
    kept = docs.sparkSession.sparkContext.broadcast(Bitmap(often.mapInArrow(partial(bits, width=WIDTH), "place long, part binary").collect()))
    spelled = docs.select("text", "lang").mapInArrow(partial(_spelled, kept=kept, n_buckets=n), _SPELLED)
    empty = F.lit(b"")
    known = often.select("bucket", F.lit(0).alias("kind"), F.array().cast("array<string>").alias("langs"), "keys", empty.alias("which"), empty.alias("terms"), empty.alias("lengths"))
    met = spelled.union(known).repartitionById(n, F.col("bucket")).sortWithinPartitions("kind")
    return met.mapInArrow(_once, "lang string, term binary"), kept


_SHARD = "lang string, first binary, size long, transducer binary"
_PREFIX = 8  # bytes that decide a term's shard


def _build(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term) to transducers of about `shard` terms of one language; terms that begin with the same bytes stay together."""
    lang, held = None, []

    def made() -> pa.RecordBatch:
        return batch_of([(lang, held[0][:_PREFIX], len(held), build(Strings.of(held)).pack())], _SHARD)

    for batch in batches:
        for x, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
            if held and (x != lang or len(held) >= shard and held[-1][:_PREFIX] != term[:_PREFIX]):
                yield made()
                held = []
            lang = x
            held.append(term)
    if held:
        yield made()


def _prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first bytes of each term as a number that orders as they do."""
    out = np.zeros(len(start), U)
    for i in range(_PREFIX):
        there = start + i < end
        out[there] |= data[start[there] + i].astype(U) << U(8 * (_PREFIX - 1 - i))
    return out


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of many spans, end to end."""
    length = end - start
    upto = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) + np.repeat(start - upto, length)].tobytes()


_TEXT = "shard int, kind int, sources array<string>, which binary, terms binary, lengths binary, n binary"


def _recount(batches: Iterator[pa.RecordBatch], kept, firsts, parts: int) -> Iterator[pa.RecordBatch]:
    """Texts to the terms of each chunk with their counts by source, cut by shard. Rows are text, lang, source.

    A shard's terms are dealt to `parts` tasks, chunk by chunk; the task's number stands in for the shard's.
    """
    out, line = [], TaskContext.get().partitionId()
    for batch, c, w, key in _terms(batches, _CHUNK):
        langs, lang = _names(batch.column(1))
        sources, source = _names(batch.column(2))
        doc = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc)) + c.first
        often = np.flatnonzero(kept.value.has(key))
        seed = np.array([_hash(x) for x in sources], U)
        _, at, n = np.unique(mix(key[often] ^ mix(seed[source[doc[often]]])), return_index=True, return_counts=True)
        at = often[at]
        low = _lowered(c)
        first = _prefixes(low, w.start[at], w.end[at])
        shard = np.full(len(at), -1)
        for i in np.unique(lang[doc[at]]).tolist():
            begins, base = firsts.value.get(langs[i], (np.zeros(0, U), 0))
            mine = lang[doc[at]] == i
            place = np.searchsorted(begins, first[mine], "right") - 1
            shard[mine] = np.where(place >= 0, base + place, -1)
        order = np.argsort(shard, kind="stable")
        order = order[shard[order] >= 0]
        cut = np.flatnonzero(np.concatenate(([True], shard[order][1:] != shard[order][:-1], [True]))).tolist() if len(order) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = order[a:b]
            names, which = np.unique(source[doc[at[mine]]], return_inverse=True)
            spans = w.start[at[mine]], w.end[at[mine]]
            out.append((int(shard[mine[0]]) * parts + line % parts, 1, [sources[i] for i in names.tolist()], which.astype("<u4").tobytes(), _gathered(low, *spans), (spans[1] - spans[0]).astype("<u4").tobytes(), n[mine].astype("<i8").tobytes()))
        line += 1
        if len(out) >= 100:
            yield _texts(out, _TEXT)
            out = []
    yield _texts(out, _TEXT)


_COUNTED = "shard int, source string, ordinals binary, n binary, total long"


def _through(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A shard's transducer, which comes first, then a part of the texts' terms: counts by source and ordinal."""
    machine, shard, ids, held = None, None, {}, Sums()
    for batch in batches:
        for i, row in enumerate(batch.select(["shard", "kind", "sources"]).to_pylist()):
            terms, which, lengths, n = (batch.column(x)[i].as_buffer() for x in ("terms", "which", "lengths", "n"))
            if row["kind"] == 0:
                machine, shard = Transducer.unpack(terms.to_pybytes()), row["shard"] // parts
                continue
            own = np.array([ids.setdefault(x, len(ids)) for x in row["sources"]], np.int64)[np.frombuffer(which, "<u4")]
            ends = np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64))
            place = machine.ordinals(Strings(np.frombuffer(terms, np.uint8), np.concatenate(([0], ends))))
            hit = place >= 0
            held.add(((own[hit] << _PLACE) | place[hit]).astype(U), np.frombuffer(n, "<i8")[hit])
    keys, n = held.take()
    source, place = (keys >> U(_PLACE)).astype(np.int64), (keys & U((1 << _PLACE) - 1)).astype(np.int64)
    names, rows = list(ids), []
    cut = np.searchsorted(source, np.arange(len(names) + 1))
    for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            rows.append((shard, names[i], place[a:b].astype("<i8").tobytes(), n[a:b].tobytes(), int(n[a:b].sum())))
    yield batch_of(rows, _COUNTED)


def share(count: np.ndarray, total: int, size: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + size)), exact up to 9 * 10^15."""
    whole, rest = np.zeros(len(count), np.int64), count.astype(np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // (total + size)
        rest = rest % (total + size)
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _by_run(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Exact sums of the runs of values that `cut` bounds."""
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[cut[1:]] - upto[cut[:-1]]


def compare(counts: list[tuple[np.ndarray, np.ndarray]], totals: list[int], size: int, terms: int, top: int, block: int = _BLOCK) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Over the `terms` ordinals of a shard: sums of the divergence of each source (row) from each other (column), and
    (source, ordinal, value) of each source's `top` terms against the language.

    `counts` has each source's ordinals, ascending, with their counts. A source's absent terms all have one share, so the work follows
    the counts that are there, times the number of sources.
    """
    k, whole = len(counts), sum(totals)
    sums, best = np.zeros((k, k), np.int64), []
    absent = np.array([int(share(np.zeros(1, np.int64), t, size)[0]) for t in totals], np.int64)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in counts]
    step = max(1, block // max(1, k))
    for low in range(0, terms, step):
        n = min(step, terms - low)
        q, there, all_n = np.repeat(absent[:, None], n, 1), np.zeros((k, n), bool), np.zeros(n, np.int64)
        places, values = [], []
        for s, (place, count) in enumerate(counts):
            a, b = np.searchsorted(place, (low, low + n))
            at = place[a:b] - low
            q[s, at] = share(count[a:b], totals[s], size)
            there[s, at] = True
            all_n[at] += count[a:b]
            places.append(at)
            values.append(q[s, at])
        cut, at, present = np.concatenate(([0], np.cumsum([len(x) for x in places]))), np.concatenate(places), np.concatenate(values)
        common = share(all_n, whole, size)
        for s in range(k):
            mine = places[s]
            sums[s] += divergence(values[s][None, :], q[:, mine]).sum(1)
            other = ~there[s][at]
            sums[s] += _by_run(np.where(other, divergence(absent[s], present), 0), cut)
            sums[s] += (n - len(mine) - _by_run(other.astype(np.int64), cut)) * divergence(absent[s], absent)
            more = values[s] > common[mine]
            found[s].append((mine[more] + low, divergence(values[s][more], common[mine][more])))
    for s, parts in enumerate(found):
        place, value = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        order = np.lexsort((place, -value))[:top]
        best += [(s, int(place[i]), int(value[i])) for i in order.tolist()]
    return sums, best


_FOUND = "part string, lang string, source string, item string, value long, ordinal long"


def _audit(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """A shard's transducer with the figures of its language, then its counts: partial sums of pairs and the best terms."""
    head, counts = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["transducer"] is not None:
                head = row
            else:
                counts.setdefault(row["source"], []).append((np.frombuffer(row["ordinals"], "<i8"), np.frombuffer(row["n"], "<i8")))
    if head is None:
        return
    machine, names = Transducer.unpack(head["transducer"]), head["sources"]
    of = lambda name: summed(*(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in counts.get(name, []))]) for i in (0, 1)))
    sums, best = compare([of(x) for x in names], head["totals"], head["size"], machine.size, top)
    rows = [("term", head["lang"], names[s], machine.string(i).decode(), v, head["base"] + i) for s, i, v in best]
    rows += [("pair", head["lang"], a, b, int(sums[i, j]), 0) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    yield batch_of(rows, _FOUND)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` is a source's divergence from each other one of its language, summed over the
    language's kept terms; part `term` are its `top` terms that it uses more than the language does, with their divergence.

    Terms are runs of letters (ASCII letters, lower-cased, and all code points from U+0080 on). A null text, language or source is empty.
    Repeated rows are documents of their own. A group without terms, or a language without kept terms, has its pairs (value 0 without
    kept terms). Ranks go from 1 by value descending, then item. Other columns aren't read; an empty table gives no rows.
    """
    spark, n = docs.sparkSession, buckets(docs.sparkSession)
    shelf, sc = Shelf(spark, "divergence"), spark.sparkContext
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept, bitmap = vocabulary(rows, shelf, least)
    ranged = shelf.put(kept, "kept").repartitionByRange(n, "lang", F.substring("term", 1, _PREFIX)).sortWithinPartitions("lang", "term")
    made = shelf.put(ranged.mapInArrow(partial(_build, shard=shard), _SHARD), "shards")
    # One entry a shard, in the order of its terms.
    entries = sorted((r["lang"], bytes(r["first"]), r["size"]) for r in made.select("lang", "first", "size").collect())
    firsts, sizes, listed = {}, {}, []
    for number, (lang, first, size) in enumerate(entries):
        begins, base = firsts.get(lang, ([], number))
        firsts[lang] = [*begins, int.from_bytes(first.ljust(_PREFIX, b"\0"), "big")], base
        listed.append((number, lang, first, sizes.get(lang, 0)))
        sizes[lang] = sizes.get(lang, 0) + size
    firsts = {lang: (np.array(begins, U), base) for lang, (begins, base) in firsts.items()}
    shards = spark.createDataFrame(listed, "shard int, lang string, first binary, base long").join(made, ["lang", "first"])
    # As many tasks as the session's exchanges have, however few shards there are: a shard's texts are summed up in parts.
    parts = max(1, -(-n // max(1, len(entries))))
    texts = rows.mapInArrow(partial(_recount, kept=bitmap, firsts=sc.broadcast(firsts), parts=parts), _TEXT)
    empty = F.lit(b"")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.col("shard") * parts + i))
    heads = shards.select(each.alias("shard"), F.lit(0).alias("kind"), F.array().cast("array<string>").alias("sources"), empty.alias("which"), F.col("transducer").alias("terms"), empty.alias("lengths"), empty.alias("n"))
    dealt = texts.union(heads).repartitionById(max(1, len(entries)) * parts, F.col("shard")).sortWithinPartitions("kind")
    counts = shelf.put(dealt.mapInArrow(partial(_through, parts=parts), _COUNTED), "counts")
    totals = counts.join(shards.select("shard", "lang"), "shard").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    line = F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    vocabularies = spark.createDataFrame(list(sizes.items()), "lang string, size long")
    figures = groups.groupBy("lang").agg(line.alias("line")).join(vocabularies, "lang", "left")
    figures = shelf.put(figures.select("lang", F.col("line.source").alias("sources"), F.col("line.total").alias("totals"), "size"), "figures")
    heads = shards.select("shard", "lang", "base", "transducer").join(figures, "lang")
    none = lambda *names: [F.lit(None).cast(t).alias(x) for x, t in names]
    heads = heads.select("shard", "lang", "base", "transducer", "sources", "totals", "size", *none(("source", "string"), ("ordinals", "binary"), ("n", "binary")))
    held = counts.select("shard", *none(("lang", "string"), ("base", "long"), ("transducer", "binary"), ("sources", "array<string>"), ("totals", "array<long>"), ("size", "long")), "source", "ordinals", "n")
    found = shelf.put(heads.union(held).repartitionById(max(1, len(entries)), F.col("shard")).mapInArrow(partial(_audit, top=top), _FOUND), "found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = figures.select("lang", "sources", F.explode("sources").alias("source")).select("lang", "source", F.explode(F.filter("sources", lambda x: x != F.col("source"))).alias("item"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(by).alias("rank"))
    return pairs.union(terms.where(F.col("rank") <= top))


def audit_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same rows in DuckDB SQL over `documents`."""
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // {q}"
    return f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select row, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by all having count(distinct row) >= {least}),
v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
groups as (select distinct lang, source from d),
total as (select lang, source, coalesce(sum(n), 0)::hugeint as total from groups left join c using (lang, source) group by all),
whole as (select lang, sum(total)::hugeint as total from total group by lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + v) as p
  from total g join kept k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select k.lang, k.term, 1 + (1000000000::hugeint * (coalesce(sum(c.n), 0) + 1)) // (any_value(w.total) + any_value(v.v)) as q
  from kept k join v using (lang) join whole w using (lang) left join c using (lang, term) group by k.lang, k.term),
pairs as (select a.lang, a.source, b.source as item, a.total from total a join total b on a.lang = b.lang and a.source <> b.source),
sums as (select a.lang, a.source, b.source as item, sum({f('a.p', 'b.p')}) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select x.lang, x.source, x.item, coalesce(s.value, 0) as value from pairs x left join sums s on x.lang = s.lang and x.source = s.source and x.item = s.item),
term as (select p.lang, p.source, p.term as item, {f('p', 'q')} as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source order by value desc, item) as rank from term)
select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair
union all select lang, source, 'term', item, value::bigint, rank::int from ranked where rank <= {top}"""
