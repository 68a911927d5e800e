"""Document fingerprints by I-Match.

A document's terms (lower-cased words) are kept where their inverse document frequency lies in a chosen band, i.e. where `low` to
`high` of all documents hold them. The distinct terms that are left are sorted and hashed, once as they are and once for each of
several randomised subsets of the lexicon. Subsets come at four rates, so that for short and for long documents some of them hold a
few terms only; the hash of the whole list tells texts apart whose terms no subset draws.

The lexicon is a bounded table whatever the corpus: terms that a share of `low` of the documents hold number at most the mean
number of distinct terms of a document divided by `low`. It alone is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buckets
from .text import U, chunks, mix, words

LOW, HIGH = 0.002, 0.2
PER_RATE = 8
RATES = (1, *(r for r in (4, 32, 128, 512) for _ in range(PER_RATE)))  # of each subset: one term in so many is in it
SUBSETS = len(RATES)
_FLUSH = 1 << 21


def _terms(w, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text of a chunk: (text, term), sorted."""
    doc = np.repeat(np.arange(rows), np.diff(w.doc))
    order = np.lexsort((w.hash, doc))
    d, t = doc[order], w.hash[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(d) else np.zeros(0, bool)
    return d[new], t[new]


def _frequencies(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Text to (bucket, terms, counts): documents that hold each term, summed up inside the task and packed by hash bucket."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        term, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        slot = (((term >> U(32)) * U(n_buckets)) >> U(32)).astype(np.int64)  # ascends with the term
        cut = np.searchsorted(slot, np.arange(n_buckets + 1))
        rows = [(b, term[x:y].astype("<u8").tobytes(), n[x:y].astype("<u4").tobytes()) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
        bucket, terms, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "terms", "counts"])

    for batch in batches:
        for c in chunks(batch.column(0)):
            held.append(_terms(words(c, lower=True), c.last - c.first)[1])
            size += len(held[-1])
            if size >= _FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


def _in_band(batches: Iterator[pa.RecordBatch], low: float, high: float) -> Iterator[pa.RecordBatch]:
    """One bucket's counts, summed; the terms whose sum lies in the band."""
    term, n = np.zeros(0, U), np.zeros(0, np.int64)
    for batch in batches:
        t = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("terms")]
        k = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in batch.column("counts")]
        term, back = np.unique(np.concatenate([term, *t]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n, *k]), minlength=len(term)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(term[(n >= low) & (n <= high)].astype(np.int64))], ["term"])


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text") -> np.ndarray:
    """Hashes of the terms in the band, sorted. Frequencies are counted over all documents."""
    total, n = docs.count(), buckets(docs.sparkSession)
    packed = docs.select(text_col).mapInArrow(partial(_frequencies, n_buckets=n), "bucket int, terms binary, counts binary")
    rows = packed.repartitionById(n, F.col("bucket")).mapInArrow(partial(_in_band, low=low * total, high=max(1.0, high * total)), "term long").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(U))


def fingerprints(texts: pa.Array, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and subset the hash of its kept terms, and whether there are any; the first subset is the whole lexicon.

    A text none of whose terms lies in the band keeps all of them, as it would otherwise be equal to any other such text.
    """
    hashes, filled = np.zeros((len(texts), SUBSETS), np.uint32), np.zeros((len(texts), SUBSETS), bool)
    for c in chunks(texts):
        doc, term = _terms(words(c, lower=True), c.last - c.first)
        if not len(term):
            continue
        at = np.searchsorted(band, term)
        known = (band[np.minimum(at, len(band) - 1)] == term) if len(band) else np.zeros(len(term), bool)
        bare = np.bincount(doc, known, minlength=c.last - c.first) == 0
        keep = known | bare[doc]
        doc, term = doc[keep], term[keep]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        value = mix(term + U(1))
        for i in range(SUBSETS):
            member = mix(term ^ mix(np.array([i + 1], U))) % U(RATES[i]) == 0
            # Terms are distinct and sorted; the sum of their mixed hashes is a hash of that list.
            sums = np.add.reduceat(np.where(member, value, U(0)), first)
            hashes[c.first + doc[first], i] = (mix(sums) >> U(32)).astype(np.uint32)
            filled[c.first + doc[first], i] = np.maximum.reduceat(member, first)
    hashes[~filled] = 0
    return hashes, filled


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of equal subset hashes among the subsets that hold a term of either; 1 where neither text has a term."""
    either = a[1] | b[1]
    same = ((a[0] == b[0]) & a[1] & b[1]).sum(1)
    n = either.sum(1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def _text(hashes: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in hashes.astype(">u4")]


def fingerprint(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text is empty, equal texts have equal fingerprints."""
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high, text_col))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_text(fingerprints(batch.column(1), band.value)[0]))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many, or all, of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch], band) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, copy) in order, each with the one after it; copies close a bucket and are only looked at."""
    last: tuple[int | None, str] | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        own = [(i, t) for i, t, copy in rows if not copy]
        closing = [(i, t) for i, t, copy in rows if copy]
        line = ([last] if last else []) + own
        if closing and line:
            line.append(closing[0])
        step = 200
        for a in range(0, len(line) - 1, step):
            part = line[a : a + step + 1]
            texts = [t for _, t in part]
            changed = [edited(t, n) for t, n in zip(texts[:-1], texts[1:], strict=True)]
            mine, theirs = fingerprints(pa.array(texts, pa.large_string()), band.value), fingerprints(pa.array(changed, pa.large_string()), band.value)
            head, tail = (mine[0][:-1], mine[1][:-1]), (mine[0][1:], mine[1][1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_text(head[0])), pa.array(_text(theirs[0])),
                    pa.array(likeness(head, theirs)), pa.array(likeness(head, tail)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        if closing and line:
            return
        last = line[-1] if line else None


def compare_neighbours(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, and the likeness to the next document.

    The next document is that with the next smaller doc_id (rows that repeat an id follow each other by their text, null ids come last);
    after the last comes the first, so a lone document is its own next. A null text is empty. Other columns aren't read.

    Documents are dealt to ranges of ids, split at approximate quantiles; the first document of each range is also sent to the
    range before it. One exchange of the texts; the driver holds one id per range.
    """
    spark, n = docs.sparkSession, buckets(docs.sparkSession)
    band = spark.sparkContext.broadcast(lexicon(docs, low, high, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    # Buckets ascend as ids descend; null ids are in the last one.
    splits = F.expr(f"cast(array({', '.join(f'{c}L' for c in cuts)}) as array<bigint>)")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(splits, lambda c: c >= F.col("doc_id"))))
    placed = rows.withColumn("bucket", bucket)
    heads = {r["bucket"]: r["doc_id"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()}
    there = sorted(heads)
    before = {b: there[i - 1] for i, b in enumerate(there)}  # the first bucket's head closes the last one
    is_head, earlier = F.lit(False), F.lit(0)
    if there:
        first = F.try_element_at(F.map_from_entries(F.array(*(F.struct(F.lit(b), F.lit(heads[b]).cast("long")) for b in there))), F.col("bucket"))
        earlier = F.element_at(F.map_from_entries(F.array(*(F.struct(F.lit(b), F.lit(before[b])) for b in there))), F.col("bucket"))
        is_head = F.col("doc_id").eqNullSafe(first)
    stay = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    sent = F.when(is_head, F.array(stay, F.struct(earlier.alias("bucket"), F.lit(True).alias("copy")))).otherwise(F.array(stay))
    dealt = placed.withColumn("to", F.explode(sent)).select("doc_id", "text", F.col("to.copy").alias("copy"), F.col("to.bucket").alias("to"))
    ordered = dealt.repartitionById(max(1, len(cuts) + 1), F.col("to")).sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.select("doc_id", "text", "copy").mapInArrow(partial(_compare, band=band), _OUT)
