"""Language-model scores, source divergence and phrases against plain versions, and their odd inputs."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import contexts, counting, divergence, phrases, transducer

DOCS = "doc_id long, text string, lang string, source string, name long, key string, chunk string, n string, a string, total long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 7, "k", "c", "n", "a", 5) for r in rows], DOCS)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(25)] + ["É", "éa", "A", "a", "x-y", "Zed", "the", "the", "The", "日本"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\t"]) for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 5, 40, 120])), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None, ""])) for i in range(n)]
    rows += [rows[3]] * 5 + [(None, rows[7][1], "en", "s1"), (None, None, None, None), (900, None, "en", "s9"), (901, "", "zz", "only"), (902, " \t\n", "zz", "other"), (903, "a " * 3000, "en", "s1")]
    return rows + [(904, "q" * 5000 + " " + "w1 w2 w3 " * 400, "fr", "s2"), (905, "w1 w2\x00w3 w4.w5", "en", "s1")]


# -- context trees


class PlainTree:
    """Nodes by (context, decided bits); block and weighted probabilities by recursion."""

    def __init__(self, texts):
        self.n = collections.Counter()
        self.children = collections.defaultdict(set)
        for t in texts:
            s = b"\n" * contexts.DEPTH + self.symbols(t)
            for i in range(contexts.DEPTH, len(s)):
                for j in range(8):
                    bits, bit = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1
                    for d in range(contexts.DEPTH + 1):
                        self.n[s[i - d : i][::-1], bits, bit] += 1
                        if d:
                            self.children[s[i - d + 1 : i][::-1], bits].add(s[i - d : i][::-1])
        self.known = {}

    @staticmethod
    def symbols(t):
        return b" ".join(lower(w).encode() for w in WORD.findall(t)) + b"\n"

    def counts(self, context, bits):
        return self.n[context, bits, 0], self.n[context, bits, 1]

    def block(self, context, bits):
        a, b = self.counts(context, bits)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, context, bits):
        if (context, bits) not in self.known:
            own = self.block(context, bits)
            if len(context) < contexts.DEPTH:
                below = sum(self.weighted(c, bits) for c in self.children[context, bits])
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            self.known[context, bits] = own
        return self.known[context, bits]

    def score(self, t):
        s, out = b"\n" * contexts.DEPTH + self.symbols(t), 0.0
        for i in range(contexts.DEPTH, len(s)):
            for j in range(8):
                bits, bit, p = (1 << j) | (s[i] >> (8 - j)), s[i] >> (7 - j) & 1, None
                for d in range(contexts.DEPTH, -1, -1):
                    context = s[i - d : i][::-1]
                    a, b = self.counts(context, bits)
                    if a + b:
                        own = ((b if bit else a) + 0.5) / (a + b + 1)
                        share = math.exp(math.log(0.5) + self.block(context, bits) - self.weighted(context, bits)) if p is not None else 1
                        p = share * own + (1 - share) * (p or 0)
                out += math.log10(0.5 if p is None else p)
        return out


@pytest.mark.parametrize("frequent", [1, 500, 1 << 22])
def test_scores_against_a_plain_tree(spark, frequent):
    rows = corpus()
    got = sorted((tuple(r) for r in contexts.score(table(spark, rows), frequent=frequent).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    training = [t or "" for i, t, *_ in rows if not held(i)]
    count = collections.Counter(w for t in training for w in [*WORD.findall(lower(t)), None])
    total, distinct, tree, want = sum(count.values()), len(count), PlainTree(training), []
    for i, t, *_ in rows:
        tokens = [*WORD.findall(lower(t or "")), None]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        want.append((i, held(i), len(tokens), sum(count[w] > 0 for w in tokens), total, base, tree.score(t or "")))
    want.sort(key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    keys, n = counting.summed(rng.integers(0, 1 << 48, 400, dtype=np.uint64) & np.uint64(0x03030303037F), np.ones(400, np.int64))
    tree = contexts.Tree(keys, n)
    upper = contexts.Upper(list(zip(*(x.tolist() for x in tree.upper()), strict=True)))
    for context in (int(keys[5]) >> 8, 0x0102030405, 0):
        grams = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** tree.log10(grams, upper)).sum(), 1, rel_tol=1e-9)


def test_scores_of_tables_without_training(spark):
    assert contexts.score(table(spark, [])).collect() == []
    lone = contexts.score(table(spark, [(None, "a b", "en", "s")])).first()
    assert (lone["held_out"], lone["n_tokens"], lone["n_known"], lone["train_tokens"], lone["base_score"]) == (True, 3, 0, 0, 0)
    assert math.isclose(lone["score"], 4 * 8 * math.log10(0.5))


def test_the_model_beats_the_base_on_held_out_texts(spark):
    from quillon.llm.queries import QUERIES

    rows = [r for r in QUERIES["op11_context_tree"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > len(rows) / 2


# -- transducers and divergence


@given(st.sets(st.binary(max_size=6) | st.text("ab", max_size=9).map(str.encode), max_size=60))
@settings(max_examples=150, deadline=None)
def test_transducer_gives_ordinals_and_is_minimal(items):
    items = sorted(items)
    made = transducer.Transducer.unpack(transducer.build(transducer.Strings.of(items)).pack())
    asked = items + [x + b"a" for x in items] + [x[:-1] for x in items] + [b"", b"zz"]
    assert made.ordinals(transducer.Strings.of(asked)).tolist() == [items.index(x) if x in items else -1 for x in asked]
    assert [made.string(i) for i in range(len(items))] == items
    endings = collections.defaultdict(set)
    for x in items:
        for i in range(len(x) + 1):
            endings[x[:i]].add(x[i:])
    assert len(made.final) == max(1, len({frozenset(v) for v in endings.values()}))


def plain_audit(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall(lower(t or ""))) for _, t, lang, source in rows]
    held = collections.Counter((lang, w) for lang, _, ws in docs for w in set(ws))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= least]
        sources = sorted({s for x, s, _ in docs if x == lang})
        count = {s: collections.Counter(w for x, y, ws in docs if (x, y) == (lang, s) for w in ws if held[lang, w] >= least) for s in sources}
        all_of = sum(count.values(), collections.Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = sorted((-sum(f(share(count[s], w), share(count[t], w)) for w in kept), t.encode()) for t in sources if t != s)
            out += [(lang, s, "pair", t.decode(), -v, i + 1) for i, (v, t) in enumerate(pairs)]
            terms = sorted((-f(share(count[s], w), share(all_of, w)), w.encode()) for w in count[s] if share(count[s], w) > share(all_of, w))
            out += [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "shard"), [(3, 1 << 15), (1, 3), (1000, 5)])
def test_divergence_against_a_plain_version(spark, least, shard):
    rows = corpus()
    docs = table(spark, rows).repartition(3)  # few shards are counted in parts
    assert sorted(tuple(r) for r in divergence.audit(docs, least=least, top=7, shard=shard).collect()) == plain_audit(rows, least, 7)


@given(st.lists(st.lists(st.integers(0, 3), min_size=12, max_size=12), min_size=1, max_size=5), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_compare_in_blocks(counts, block):
    sparse = [(np.flatnonzero(c), np.array(c)[np.flatnonzero(c)]) for c in counts]
    totals = [sum(c) for c in counts]
    sums, best = divergence.compare(sparse, totals, 12, 12, 4, block)
    share = lambda n, t: 1 + 10**9 * (n + 1) // (t + 12)
    f = lambda p, q: (p - q) ** 2 // q
    for a, x in enumerate(counts):
        assert sums[a].tolist() == [sum(f(share(m, totals[a]), share(n, totals[b])) for m, n in zip(x, y, strict=True)) for b, y in enumerate(counts)]
        p = [(share(m, totals[a]), share(sum(c[i] for c in counts), sum(totals)), i) for i, m in enumerate(x) if m]
        assert [(i, v) for s, i, v in best if s == a] == [(i, -v) for v, i in sorted((-f(p, q), i) for p, q, i in p if p > q)[:4]]


def test_shares_are_exact_beyond_64_bits():
    count, total = 8_999_999_999_999_999, 9_000_000_000_000_001
    assert divergence.share(np.array([count, 12_345_678_901_234]), total, 77).tolist() == [1 + 10**9 * (c + 1) // (total + 77) for c in (count, 12_345_678_901_234)]


def test_divergence_of_empty_tables(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    assert [tuple(r) for r in divergence.audit(table(spark, [(1, None, None, "b"), (2, "", "", "a")])).orderBy("source").collect()] == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]


# -- phrases


def plain_phrases(rows, least, top):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        f, n = collections.Counter(), 0
        for _, t, x, _ in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")) if (x or "und") == lang else []:
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        f = {g: c for g, c in f.items() if c >= least}
        inside = collections.defaultdict(int)
        for g, c in f.items():
            for a in range(len(g)):
                for b in range(a + 2, len(g) + 1):
                    if b - a < len(g):
                        inside[g[a:b]] = max(inside[g[a:b]], c)
        rows_of = []
        for g, a in f.items():
            if len(g) > 1 and not 100 * inside[g] >= 100 * a:
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows_of.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows_of)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "every", "top"), [(3, 2, 2000), (4, 32, 20), (2, 1, 2000), (100, 5, 2000)])
def test_phrases_against_a_plain_version(spark, least, every, top):
    rows = corpus(seed=9)
    got = sorted(tuple(r) for r in phrases.collocations(table(spark, rows), least=least, top=top, every=every).collect())
    assert got == plain_phrases(rows, least, top)


def test_chunks_assign_every_phrase_once(spark):
    text = " ".join("w%d" % (k * k % 17) for k in range(300))
    entries = phrases.dictionary(table(spark, [(1, text, "en", "s")]), every=3).collect()
    assert sum(e["own"] * e["freq"] for e in entries) == 300 and len(entries) > 5
    assert all(len(e["chunk"].split()) <= e["own"] + 4 for e in entries)


def plain_entries(rows, every):
    """Chunks of a plain version, as far as they can be told without the hash: the words that start phrases, in order, of each language."""
    out = collections.Counter()
    for _, t, x, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            out.update((x or "und", w) for w in re.findall(r"[^\x20\x09]+", piece))
    return out


def test_dictionary_is_packed_and_whole(spark):
    odd = "\tA  b\t\tC, É ß d.e!\x0bf \x0c g\u00a0h ?;: i  "
    rows = [*corpus(seed=4), (901, odd, "en", "s"), (902, odd, None, "s"), (903, odd, "en", "t"), (904, "", "en", "s"), (905, None, "en", "s"), (906, " .\t. ", "en", "s"), (907, "x y z", "en", "s")]
    entries = phrases.dictionary(table(spark, rows), every=4)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "chunk" not in re.findall(r"hashpartitioning\(([^)]*)", plan.replace("#", " ")) and "HashAggregate" not in plan and "SortAggregate" not in plan
    got, found = collections.Counter(), entries.collect()
    for e in found:
        words = e["chunk"].split(" ")
        assert "" not in words and e["own"] <= len(words) <= e["own"] + 4
        got.update({(e["lang"], w): 0 for w in words})
        for w in words[: e["own"]]:
            got[e["lang"], w] += e["freq"]
    assert got == plain_entries(rows, 4) and len({(e["lang"], e["chunk"], e["own"]) for e in found}) == len(found) and max(e["freq"] for e in found) > 1


def test_entries_are_taken_as_one_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "_HELD", 100)
    texts = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 20, "text": ["a b c. d e f g h i j k l m n o p", "a b c"] * 20})
    rows = list(phrases._merged(phrases._cut(iter([texts]), 3, 1), 1))
    assert sum(sum(b.column("total").to_pylist()) for b in rows) == 20 * 16 + 20 * 3


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(table(spark, [])).collect() == []
    assert phrases.collocations(table(spark, [(1, None, None, None), (2, " . ", "en", "s")]), least=1).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 9 * 10**12, 10**18 - 7, 9 * 10**12 + 1, 9 * 10**12 + 3  # noqa: E741
    wide = lambda x: f"cast({x}L as decimal(19, 0))"
    assert spark.sql(f"select (cast(1000 as decimal(4, 0)) * {wide(a)} * {wide(n)}) div ({wide(l)} * {wide(r)})").first()[0] == 1000 * a * n // (l * r)


def test_bitmap():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    batches = [counting.batch_of(counting.packed(keys, np.ones(len(keys), np.int64), counting.by_hash(keys, 7)), counting.PACKED)]
    rows = [(r["place"], r["part"]) for b in counting.bits(iter(batches), 16) for r in b.to_pylist()]
    held = counting.Bitmap(rows, 16)
    assert held.has(keys).all() and int(np.unpackbits(held.bytes).sum()) == len(np.unique(keys >> np.uint64(48)))
