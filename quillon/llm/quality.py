"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on a document: for one of two questions, quality and toxicity, each says yes, no or nothing.
Expectation-maximisation estimates every labeller's accuracy from how the votes of all documents agree (a naive-Bayes label
model; votes are few enough to be counted by pattern, so the driver sees a bounded table whatever the corpus). Posteriors are the
training labels of a hashed linear scorer, fitted on a bounded sample. The scorer alone judges the corpus, in one pass.

Given labels, where there are any, are one more labeller, no truth: their accuracy is estimated like that of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf
from .text import Chunk, U, Words, chunks, lower_running, mix, span_hash, words

SAMPLE = 8000  # rows that the scorers are fitted on, at most
SLOTS = 1 << 18
PREFIXES = (5, 7)  # a word counts by itself and by its first letters
ROUNDS = 60
NOTHING = 2
SIGNIFICANT = 4.0  # standard deviations from chance at which a slot is used

# Common English words of insult and abuse.
INSULTS = (
    "arse ass asshole bastard bitch blockhead bonehead bozo brainless bullshit clown clowns coward cowards crap creep cretin crook deadbeat degenerate despicable dimwit dirtbag "
    "disgrace disgusting dolt dope dork douchebag dumb dumbass dunce dunderhead fool fools fraud freak freaks fuck fucking garbage goon halfwit hateful hypocrite idiot idiotic idiots ignoramus "
    "imbecile imbeciles jackass jerk jerks liar liars loser losers lowlife lunatic maggot moron moronic morons nincompoop nitwit numbskull oaf parasite pathetic pig pigs prick psycho "
    "repulsive retard retarded scoundrel scum scumbag shit shithead shameful simpleton sleazy slob slut snake stupid stupidity sucker swine thug toad trash troll twat twit "
    "ugly vermin vile weasel weirdo whore wimp worthless wretch"
).split()
# Frequent words of English, and of German, French and Spanish; prose holds many of them.
ENGLISH = "the of and to is it that for on with as was by at from this be are or".split()
FREQUENT = (
    "in an a der die und den von zu das mit sich des auf für ist im dem nicht "
    "ein eine als de la le et les en du un une que est pour qui dans par au sur pas el los las y del se por con su para es al lo"
).split()
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*|@~^<>{}[]\\=+_"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _hash_of(text: str) -> np.ndarray:
    c = next(chunks(pa.array([text], pa.large_string())))
    return np.unique(words(c, lower=True).hash)


def _bare(c: Chunk, w: Words) -> Words:
    """Words without the marks that stand before and after their letters and digits."""
    solid = _LETTER[c.data] | ((c.data >= 48) & (c.data < 58))
    at = np.flatnonzero(solid)
    if not len(at):
        return Words(w.hash[:0], w.start[:0], w.end[:0], np.zeros_like(w.doc))
    lo, hi = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
    has = hi > lo
    start, end = at[np.minimum(lo, len(at) - 1)][has], at[np.maximum(hi - 1, 0)][has] + 1
    kept = np.concatenate(([0], np.cumsum(has)))
    return Words(w.hash[:0], start, end, kept[w.doc])


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a chunk's texts, each once a text: (text, slot), sorted.

    Lexical ones are a word and its first letters. Shapes are what marks end words, words and pairs of words that repeat, and loud
    words, each with the order of magnitude of its share of the text's words.
    """
    w = words(c, lower=True)
    bare, running, n = _bare(c, w), lower_running(c), c.last - c.first
    text, size = np.repeat(np.arange(n), np.diff(bare.doc)), bare.end - bare.start
    docs, slots = [], []
    for k in (0, *PREFIXES):
        at = np.flatnonzero(size > k) if k else np.arange(len(size))
        end = np.minimum(bare.end[at], bare.start[at] + k) if k else bare.end[at]
        docs.append(text[at])
        slots.append(mix(span_hash(running, bare.start[at], end) ^ U(k * 77 + 5)))
    every = np.repeat(np.arange(n), np.diff(w.doc))
    shape_doc, shape = [], []
    if len(w.hash):
        closed = ~_LETTER[c.data[w.end - 1]]
        shape_doc.append(every[closed])
        shape.append(mix(span_hash(running, np.maximum(w.start, w.end - 2), w.end) ^ U(0xE4D))[closed])
        same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (every[1:] == every[:-1])) + 1
        upper = np.concatenate(([0], np.cumsum(_UPPER[c.data])))
        loud = np.flatnonzero(upper[w.end] - upper[w.start] > 2)
        pair, mine = w.hash[:-1] * U(3) + w.hash[1:], np.where(every[:-1] == every[1:], every[:-1], -1)
        order = np.lexsort((pair, mine))
        again = mine[order][1:][(pair[order][1:] == pair[order][:-1]) & (mine[order][1:] == mine[order][:-1]) & (mine[order][1:] >= 0)]
        for name, at in ((0x5A3E, every[same]), (0x10D, every[loud]), (0xDB, again)):
            shape_doc.append(at)
            shape.append(np.full(len(at), name, U))
        doc, kind = np.concatenate(shape_doc), np.concatenate(shape)
        order = np.lexsort((kind, doc))
        doc, kind = doc[order], kind[order]
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])))) if len(doc) else np.zeros(0, np.int64)
        share = np.diff(np.append(first, len(doc))) / np.maximum(1, np.diff(w.doc))[doc[first]]
        docs.append(doc[first])
        slots.append(mix(kind[first] ^ mix(np.ceil(np.log2(share * 128 + 1)).astype(U) + U(0x511))))
    key = np.unique(np.concatenate(docs) * SLOTS + (np.concatenate(slots) & U(SLOTS - 1)).astype(np.int64))
    return key // SLOTS, key % SLOTS


def votes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The heuristic labellers' votes on quality and on toxicity: 1 yes, 0 no, NOTHING."""
    w = words(c, lower=True)
    n = np.diff(w.doc)
    every = np.repeat(np.arange(len(n)), n)
    size = np.maximum(1, np.diff(c.offsets))
    per_text = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[c.offsets])
    per_word = lambda mask: np.bincount(every, mask, minlength=len(n)) / np.maximum(1, n)
    symbols = per_text(_SYMBOLS[c.data]) / size
    upper = per_text(_UPPER[c.data]) / np.maximum(1, per_text(_LETTER[c.data]))
    adjacent = np.zeros(len(w.hash), bool)
    adjacent[1:] = (w.hash[1:] == w.hash[:-1]) & (every[1:] == every[:-1])
    frequent = per_word(np.isin(w.hash, _FREQUENT))
    order = np.lexsort((w.hash, every))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (every[order][1:] != every[order][:-1])
    distinct = np.bincount(every[order], new, minlength=len(n)) / np.maximum(1, n)
    bare = _bare(c, w)
    text = np.repeat(np.arange(len(n)), np.diff(bare.doc))
    known = np.isin(span_hash(lower_running(c), bare.start, bare.end), _INSULTS)
    insults = np.bincount(text, known, minlength=len(n))
    say = lambda bad, good: np.where(bad, 0, np.where(good, 1, NOTHING))
    quality = np.stack(
        [
            say(symbols > 0.04, symbols < 0.01),
            say(upper > 0.3, upper < 0.15),
            say(per_word(adjacent) > 0.2, (per_word(adjacent) < 0.04) & (n > 20)),
            say((frequent < 0.02) & (n > 12), frequent > 0.12),
            say((distinct < 0.25) & (n > 30), (distinct > 0.4) & (n > 30)),
        ],
        1,
    )
    english = per_word(np.isin(w.hash, _ENGLISH)) > 0.08  # the list of insults tells nothing about other languages
    clean = (insults == 0) & english
    toxic = np.stack([say(clean, insults >= 2), say(clean & (n > 50), insults > 0.01 * n)], 1)
    return quality, toxic


_FREQUENT = _hash_of(" ".join([*ENGLISH, *FREQUENT]))
_ENGLISH = _hash_of(" ".join(ENGLISH))
_INSULTS = _hash_of(" ".join(INSULTS))


@dataclass
class Labels:
    """A fitted label model: P(yes), and P(vote | class) of each labeller."""

    prior: np.ndarray
    share: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """P(yes) of each row of votes."""
        said = np.stack([vote == 0, vote == 1], 2).astype(float)
        log = np.log(self.prior) + np.einsum("nlv,lcv->nc", said, np.log(self.share))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def label_model(vote: np.ndarray, times: np.ndarray | None = None, rounds: int = ROUNDS) -> Labels:
    """Expectation-maximisation from the majority vote; `times` is how many documents voted like each row. Rows without a vote say nothing."""
    times = np.ones(len(vote)) if times is None else times.astype(float)
    said = np.stack([vote == 0, vote == 1], 2).astype(float)  # row, labeller, vote
    count = said.sum(1)
    times = times * (count.sum(1) > 0)
    p = (count[:, 1] + 0.5) / (count.sum(1) + 1)
    model = Labels(np.full(2, 0.5), np.full((vote.shape[1], 2, 2), 0.5))
    for _ in range(rounds if times.sum() else 0):
        by = np.stack([1 - p, p], 1) * times[:, None]
        share = np.einsum("nc,nlv->lcv", by, said) + np.array([[2.0, 0.5], [0.5, 2.0]])  # a prior for better than chance
        model = Labels(np.clip(by.sum(0) / times.sum(), 0.01, 0.99), share / share.sum(2, keepdims=True))
        p = model.posterior(vote)
    return model


def fit_linear(rows: list[np.ndarray], target: np.ndarray, rounds: int = 500, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, over the slots that go with the label by more than chance; the rest weigh nothing.

    Without that screening a few thousand rows would fit any label by words that occur once. Deterministic.
    """
    n = len(rows)
    held, yes = np.zeros(SLOTS), np.zeros(SLOTS)
    for slots, p in zip(rows, target.tolist(), strict=True):
        held[slots] += 1
        yes[slots] += p
    prior = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    chance = (yes - held * prior) / np.sqrt(held * prior * (1 - prior) + 1)
    used = np.flatnonzero((np.abs(chance) > SIGNIFICANT) & (held >= 3))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    kept = [x[x >= 0] for x in (place[slots] for slots in rows)]
    row, slot = np.repeat(np.arange(n), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)
    w, g2, bias = np.zeros(len(used)), np.full(len(used), 1e-10), float(np.log(prior / (1 - prior)))
    for _ in range(rounds if n else 0):
        z = np.bincount(row, w[slot], minlength=n)[:n] + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(slot, miss[row], minlength=len(used)) + decay / n * w
        g2 += grad**2
        w -= 0.3 * grad / np.sqrt(g2)
        bias -= 0.5 * miss.sum()
    out = np.zeros(SLOTS)
    out[used] = w
    return out, bias


@dataclass
class Model:
    quality: tuple[np.ndarray, float]
    toxic: tuple[np.ndarray, float]
    accuracies: dict[str, np.ndarray]


def _votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, votes), and among them the labels' places, which are filled later."""
    for batch in batches:
        out = [np.concatenate([q, t], 1).astype(np.uint8) for q, t in map(votes, chunks(batch.column("text")))]
        rows = np.concatenate(out) if out else np.zeros((0, 7), np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "votes"])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for c in chunks(batch.column("text")):
            doc, slot = features(c)
            cut = np.searchsorted(doc, np.arange(c.last - c.first + 1))
            out += [slot[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("q"), batch.column("t"), batch.column("votes"), pa.array(out, pa.binary())], ["doc_id", "q", "t", "votes", "slots"])


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the label model on the votes of all rows, and both scorers on at most `sample` rows.

    The sample holds the documents with the least hashes of their ids, those with a given label first; where rows repeat a doc_id one
    of them, that with the least text, is in it. Rows without doc_id vote, but aren't sampled. A document on which no labeller
    says anything about a question isn't used for that question. Labels of documents that aren't in the table count for nothing.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shelf = Shelf(spark, "quality")
    voted = cols.mapInArrow(_votes_of, "doc_id long, votes binary")
    none = F.lit(None).cast("int")
    if labels is not None:
        given = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("q"), F.max("toxic").cast("int").alias("t"))
        voted = voted.join(given, "doc_id", "left")
    else:
        voted = voted.withColumns({"q": none, "t": none})
    voted = shelf.put(voted.select("doc_id", "q", "t", "votes"), "votes")
    patterns = voted.groupBy("q", "t", "votes").agg(F.count("*").alias("n")).collect()  # 3^9 at most
    said = lambda x: NOTHING if x is None else int(x > 0)
    full = lambda r: [*r["votes"][:5], said(r["q"]), *r["votes"][5:], said(r["t"])]
    counted = sorted((full(r), r["n"]) for r in patterns)
    vote, times = np.array([v for v, _ in counted], np.int64).reshape(-1, 9), np.array([n for _, n in counted], np.int64)
    good, bad = label_model(vote[:, :6], times), label_model(vote[:, 6:], times)
    first = F.min(F.struct(F.when(F.col("q").isNull() & F.col("t").isNull(), 1).otherwise(0).alias("bare"), F.xxhash64("doc_id").alias("h")))
    least = voted.where("doc_id is not null").groupBy("doc_id").agg(first.alias("o")).orderBy("o.bare", "o.h", "doc_id").limit(sample).select("doc_id")
    picked = cols.join(F.broadcast(least), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    mine = voted.join(F.broadcast(least), "doc_id").groupBy("doc_id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    rows = picked.join(mine, "doc_id").mapInArrow(_votes_again, "doc_id long, text string, q int, t int, votes binary")
    rows = sorted(rows.mapInArrow(_features_of, "doc_id long, q int, t int, votes binary, slots binary").collect(), key=lambda r: r["doc_id"])
    vote = np.array([full(r) for r in rows], np.int64).reshape(len(rows), 9)
    parts = [np.frombuffer(r["slots"], "<i4") for r in rows]
    fitted = []
    for model, v in ((good, vote[:, :6]), (bad, vote[:, 6:])):
        at = np.flatnonzero((v != NOTHING).any(1))
        fitted.append(fit_linear([parts[i] for i in at], model.posterior(v[at])))
    shelf.drop("votes")
    return Model(*fitted, {"quality": good.share, "toxic": bad.share})


def _votes_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's votes, of the very texts that are fitted on."""
    for batch in batches:
        pair = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], ["doc_id", "text"])
        (got,) = _votes_of(iter([pair]))
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "text", "q", "t")] + [got.column("votes")], ["doc_id", "text", "q", "t", "votes"])


def _judge(batches: Iterator[pa.RecordBatch], model, text_col: str) -> Iterator[pa.RecordBatch]:
    at: Model = model.value
    for batch in batches:
        out = []
        for c in chunks(batch.column(text_col)):
            doc, slot = features(c)
            out.append([1 / (1 + np.exp(-np.clip(np.bincount(doc, w[slot], minlength=c.last - c.first) + b, -30, 30))) for w, b in (at.quality, at.toxic)])
        q, t = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0),) * 2
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q.round(6)), pa.array(t.round(6)), pa.array((q >= 0.5) & (t < 0.5))], [*batch.schema.names, *SCORES])


SCORES = ("quality_score", "toxic_score", "keep")


def judge(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The carried columns (default: doc_id) of every row with quality_score, toxic_score and keep (quality at least one half, toxicity below).

    A null or empty text has no features and gets the scorers' bias. Carried columns may have any names; one that is called like
    a score is followed by an underscore. One pass without an exchange; the model is of fixed size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or ["doc_id"]
    inner = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), *([] if text_col in carry else [F.col(text_col).alias("text")]))
    text = f"c{carry.index(text_col)}" if text_col in carry else "text"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields) + ", quality_score double, toxic_score double, keep boolean"
    out = inner.mapInArrow(partial(_judge, model=shipped, text_col=text), schema)
    return out.select(*(F.col(f"c{i}").alias(c + "_" * (c in SCORES)) for i, c in enumerate(carry)), *SCORES)
