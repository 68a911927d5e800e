"""The text operators against brute force on small tables, and their odd inputs."""

import collections
import dataclasses
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import anchors, automata, chat, contamination, html, imatch, jaccard, packing, quality, suffixes, text, urls
from quillon.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, name long, hash string, spans string, keep string"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, "h", "s", "k") for i, t in rows], DOCS)


def prose(rng, n, vocabulary=60):
    return " ".join(rng.choice(["w%d" % k for k in range(vocabulary)]) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(0, 260), 400) for _ in range(25)]
    rows = list(enumerate(base))
    for i in range(40):  # copies, edits, shared passages, repeats inside a text
        t = rng.choice(base).split()
        kind = i % 4
        if kind == 1 and t:
            for _ in range(rng.randint(1, 6)):
                t[rng.randrange(len(t))] = "edit%d" % rng.randint(0, 999)
        elif kind == 2:
            t = prose(rng, 40, 400).split() + t[:60] + prose(rng, 30, 400).split()
        elif kind == 3:
            t = t + ["é"] + t[10:80]
        rows.append((100 + i, " ".join(t)))
    return rows + [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one"), (None, base[0]), (None, None), (1, base[1]), (1, "another text under the same id")]


def test_registered():
    assert [f"op{n}" for n in range(1, 14)] == [q.split("_")[0] for q in QUERIES]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(compare, name):
    ours, theirs = compare(name)
    assert ours == theirs


@given(st.lists(st.text(alphabet="ab \t\né", max_size=40), min_size=1, max_size=20), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_words_and_ngrams(texts, size):
    import pyarrow as pa

    got = []
    for c in text.chunks(pa.array(texts), size):
        w = text.words(c, lower=True)
        for i in range(c.last - c.first):
            got.append([c.data[a:b].tobytes().decode() for a, b in zip(w.start[w.doc[i] : w.doc[i + 1]], w.end[w.doc[i] : w.doc[i + 1]], strict=True)])
    assert got == [WORD.findall(t) for t in texts]


@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=8), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_every_window_holds_its_minimum(segments, width):
    values = np.array([x for s in segments for x in s], np.uint64) << np.uint64(30)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
    got = set(text.window_minima(values, width, np.unique(bounds)).tolist())
    want = set()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for i in range(a, b - width + 1):
            want.add(i + int(np.argmin(values[i : i + width])))
    assert got == want


def components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    at = [k for k in range(len(rows)) if rows[k][0] is not None]
    for i in at:
        for j in at:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i in at:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)] if rows[i][0] is not None else None) for i in range(len(rows)))


def test_jaccard(spark):
    rows = corpus()
    got = collections.Counter(map(tuple, jaccard.near_duplicates(table(spark, rows)).collect()))
    assert got == components(rows)


@pytest.mark.parametrize("block", [1024, 8])
def test_jaccard_of_a_family(spark, block):
    """Many copies with random edits of one text, near the threshold: no link may be lost, in however many blocks it is compared."""
    rng = random.Random(5)
    base = prose(rng, 150, 5000).split()
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = "e%d" % rng.randint(0, 10**6)
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    got = collections.Counter(map(tuple, jaccard.near_duplicates(table(spark, rows), block=block).collect()))
    assert got == components(rows)


def test_a_connected_family_is_sent_once(spark):
    """Rows of sketches grow with the family, not with its square."""
    rng, base = random.Random(6), prose(random.Random(8), 120, 9000).split()
    sent = []
    for n in (200, 800):
        rows = [(i, " ".join([*base[:k], "e%d" % i, *base[k + 1 :]])) for i in range(n) for k in [rng.randrange(120)]]
        put, seen = jaccard.Shelf.put, []
        jaccard.Shelf.put = lambda self, df, name: (out := put(self, df, name), seen.append(out.select(F.sum(F.size("members"))).first()[0] or 0) if name.startswith("groups") else None)[0]  # noqa: B023
        try:
            found = jaccard.near_duplicates(table(spark, rows), block=20).select("component_id").distinct().count()
        finally:
            jaccard.Shelf.put = put
        assert found == 1
        sent.append(sum(seen))
    assert sent[1] < 8 * sent[0]


def written(run):
    """Rows of each table that `run` writes, and its result."""
    put, seen = jaccard.Shelf.put, collections.Counter()
    jaccard.Shelf.put = lambda self, df, name: (out := put(self, df, name), seen.update({name: out.count()}))[0]
    try:
        return seen, run().collect()
    finally:
        jaccard.Shelf.put = put


@pytest.mark.parametrize("times", [3, 3000])
def test_equal_rows_are_compared_once(spark, times):
    t = prose(random.Random(2), 150, 5000)
    rows = [(4, t)] * times + [(4, t + " end"), (9, "start " + t)]
    seen, got = written(lambda: jaccard.near_duplicates(table(spark, rows)))
    assert seen["sets"] == 3 and seen["chosen"] <= 2 + spark.sparkContext.defaultParallelism
    assert collections.Counter(map(tuple, got)) == components(rows)


def test_rows_of_one_id_are_sketched_once(spark):
    """Near copies under one id cost what they cost under ids of their own."""
    t = prose(random.Random(3), 150, 5000)
    rows = [(7, f"{t} e{i}") for i in range(200)]
    seen, got = written(lambda: jaccard.near_duplicates(table(spark, rows)))
    assert seen["chosen"] == 200 and {(r.doc_id, r.component_id) for r in got} == {(7, 7)} and len(got) == 200


@pytest.mark.parametrize("op", [automata, suffixes])
def test_contexts_of_equal_rows_are_sent_once(spark, op):
    """A passage, edited on both sides, in many equal rows: as many contexts as if there were two of them, and the same bytes or words go."""
    rng = random.Random(4)
    passage, a, b = prose(rng, 80, 900), prose(rng, 30, 900), prose(rng, 30, 900)
    sizes, results = [], []
    for times in (2, 1000):
        rows = [(1, f"{a} {passage} {b}")] * times + [(2, f"{b} {passage} {a}")]
        seen, got = written(lambda: op.remove_repeats(table(spark, rows)))  # noqa: B023
        sizes.append(seen["distinct"])
        results.append({tuple(r) for r in got})
        assert len(got) == times + 1 and seen["contexts0"] <= sizes[-1] * spark.sparkContext.defaultParallelism
    assert 0 < sizes[1] <= sizes[0] and results[0] == results[1]


@given(st.lists(st.integers(0, 300), min_size=1, max_size=80), st.lists(st.integers(0, 300), max_size=20))
@settings(max_examples=60, deadline=None)
def test_sketches_bound_the_difference(members, flips):
    a = np.unique(text.mix(np.unique(members).astype(np.uint64)))
    b = np.setxor1d(a, np.unique(text.mix(np.unique(flips).astype(np.uint64))))
    x, y = jaccard.dense_sketch(a), jaccard.dense_sketch(b)
    n = min(len(x), len(y))
    far = int(np.bitwise_count(jaccard.fold(x, n) ^ jaccard.fold(y, n)).sum())
    assert far <= len(np.setxor1d(a, b))
    if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
        (wx, kx), (wy, ky) = jaccard.part_keys([a], 80), jaccard.part_keys([b], 80)
        assert np.intersect1d(kx, ky).size


# From how many contexts on an anchor is split: never here, in its bucket only, by tasks and in buckets.
SPLITS = [(64, 1024), (64, 1), (1, 2)]


def crowd(n=30):
    """One passage in many texts that differ before and after it: the anchors at its edges have as many contexts."""
    rng = random.Random(9)
    passage = prose(rng, 60, 900)
    return [(1000 + i, prose(rng, rng.randint(0, 12), 3) + " " + passage + " " + prose(rng, rng.randint(0, 12), 3)) for i in range(n)]


@pytest.mark.parametrize("split", SPLITS)
def test_substrings_of_words(spark, split):
    rows = corpus() + crowd()
    how = dataclasses.replace(automata.rule(20), many_here=split[0], many=split[1])
    got = collections.Counter(map(tuple, automata.remove_repeats(table(spark, rows), how=how).collect()))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    starts = collections.defaultdict(set)
    words = [WORD.findall(t or "") for _, t in rows]
    for k in order:
        for i in range(len(words[k]) - 19):
            starts[tuple(words[k][i : i + 20])].add((rows[k][0] is None, rows[k][0] or 0, i))
    plain = [k for k in range(len(rows)) if sum(r[0] == rows[k][0] for r in rows) == 1]  # repeated ids are ordered by hashes
    want = collections.Counter()
    for k in plain:
        gone = set()
        for i in range(len(words[k]) - 19):
            if min(starts[tuple(words[k][i : i + 20])]) < (rows[k][0] is None, rows[k][0] or 0, i):
                gone.update(range(i, i + 20))
        want[(rows[k][0], len(words[k]), len(gone), " ".join(w for i, w in enumerate(words[k]) if i not in gone))] += 1
    assert not want - got and sum(got.values()) == len(rows)


@pytest.mark.parametrize("rule", [automata.rule(20), suffixes.rule(200), automata.rule(3)])
def test_parts_cover_every_window_once(rule):
    levels = anchors.parts_of(rule)
    for level in levels:
        assert sorted(r for p in level for r in range(p.right, p.right + p.width)) == list(range(rule.gram, rule.window + 1))
        assert all(p.left + p.right == rule.window - p.width + 1 for p in level) and len(level) < 256
    assert all(p.width == 1 for p in levels[-1])


def test_an_equal_row_is_not_earlier(spark):
    t = prose(random.Random(1), 50, 900)
    got = automata.remove_repeats(table(spark, [(1, t), (1, t), (2, t)])).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 0, 50]


@pytest.mark.parametrize("split", SPLITS)
def test_substrings_of_bytes(spark, split):
    rows = corpus() + crowd() + [(400, "a" * 450), (401, "ñ" * 150 + "b" * 60)]
    how = dataclasses.replace(suffixes.rule(200), many_here=split[0], many=split[1])
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(table(spark, rows), how=how).collect())
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    want = collections.Counter()
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[(doc, len(d), sum(gone), len(re.findall(b"\x01+", bytes(gone))), bytes(x for x, g in zip(d, gone, strict=True) if not g))] += 1
    assert got == want


def test_cut_texts_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 120 + "x" * 100), (2, "é" * 120 + "y" * 100), (3, None)]
    out = suffixes.cut_texts(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x" * 100, 2: "y" * 100, 3: ""}


def test_packing_is_optimal():
    rng = random.Random(2)
    for _ in range(25):
        ls, k = [rng.randint(0, 25) for _ in range(20)], rng.randint(1, 4)
        c = collections.Counter(ls)
        v = sorted(c)
        best = lambda i, k: 0 if i == len(v) else 10**9 if not k else min(sum((v[j] - v[x]) * c[v[x]] for x in range(i, j + 1)) + best(j + 1, k - 1) for j in range(i, len(v)))  # noqa: E731, B023
        ends = packing.boundaries(np.array(v), np.array([c[x] for x in v]), np.array([c[x] * x for x in v]), k)
        assert sum(min(e for e in ends if e >= x) - x for x in ls) == best(0, k) and len(ends) <= k


def test_packing_spreads_rows_of_one_id(spark):
    rows = [(None, "a b c")] * 400 + [(5, "a b c d")] * 400
    out = packing.pack(table(spark, rows).repartition(4), share=100, buckets=2).collect()
    per = collections.Counter((r.bucket, r.share) for r in out)
    assert len(out) == 800 and max(per.values()) <= 300


def test_packing_rows(spark):
    rows = corpus()
    out = packing.pack(table(spark, rows), budget=500, share=10).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    per = collections.defaultdict(list)
    for r in out:
        per[(r.bucket, r.share, r.batch)].append(r)
        assert r.padding == r.bucket_tokens - r.n_tokens >= 0
    for batch in per.values():
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].bucket_tokens <= 500


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]\\", None]), st.one_of(st.none(), st.text(alphabet="ab\\</s>[INST] OLERANSY", max_size=30))), max_size=6))
@settings(max_examples=12, deadline=None)
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_chats(rows)).collect()
    if not turns:
        assert not got
        return
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    assert (got[0].n_turns, got[0].turns_sha256, got[0].loss_sha256, got[0].loss_chars) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(learnt.encode()).hexdigest(), len(learnt))


def test_chat_order(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "x"), (4, 0, "user", "u"), (None, 0, "user", "u")]
    out = chat.format_chats(spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string"))
    assert {r.conv_id: r.valid for r in out.collect()} == {1: True, 2: False, 3: True, 4: False, None: False}


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x"), (2, "https://x.net/en/"), (3, "http://m.example.com/de/1?a"), (4, "http://b.org/fr/"), (5, None), (6, "example.net/en/"), (7, "http://foo.net"), (8, "http://notexample.net/en/"), (9, "x://h.org/fr/?q#z")]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("x.net", "/en/", "net/"), 3: ("m.example.com", "/de/1", "example.com/de/"), 4: ("b.org", "/fr/", "org/fr/"), 5: ("", "", None),
        6: ("", "", None), 7: ("foo.net", "", None), 8: ("notexample.net", "/en/", "net/"), 9: ("h.org", "/fr/", "org/fr/"),
    }


def test_url_model_holds_out(spark):
    """Hosts that the labelled table doesn't hold."""
    import itertools

    model = urls.train()
    score = lambda u: sum(model.weights[s] for s in urls._slots(*urls._parts(u))) + model.bias * len(urls._slots(*urls._parts(u))) ** 0.5
    bad = ["http://casino-pills.example.com/en/1", "https://free-casino.example.org/fr/2", "http://spam-pills.example.com/de/3", "https://hot-porn-movies.example.net/", "http://ads-track.example.com/en/9"]
    good = ["https://ththion.example.com/en/1", "http://archive.example.org/en/22", "https://blog.kitchen.example.com/fr/9", "http://m.theher.example.org/en/25", "https://www.tidewater.example.net/es/4"]
    assert all(score(b) > score(g) for b, g in itertools.product(bad, good))
    assert all(score(g) < 0 for g in good)
    held = {urls._parts(u)[0] for u, _ in urls.LABELLED}
    pages = [r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert held.isdisjoint(urls._parts(u)[0] for u in pages)


def test_urls_odd_rows(spark):
    rows = [(None, None, "a", 1), (1, "http://x.net/", "b", 2), (1, "http://x.net/", "b", 2), (2, "http://" + "y" * 200_000 + ".org/fr/", None, None), (3, "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, score int")
    got = urls.judge(pages).collect()
    assert sorted(((r.page_id or 0), len(r.host), r.rule or "") for r in got) == [(0, 0, ""), (1, 5, "net/"), (1, 5, "net/"), (2, 200_004, "org/fr/"), (3, 0, "")]
    assert urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>short", "short"), ("<article><p>x<b>y</b>z<p>Of.</article><footer>f</footer>", "xyz Of."),
        ("<main><h1>A&amp;B</h1><aside>no</aside><script>var t='</p>'</script><p>a<br>b &lt;i&gt;</p><div class='comment'>no</div></main>", "A&B a b <i>"),
        ("<body><div id=sidebar><p>" + "s " * 90 + "</p></div><div><p>" + "long " * 40 + "</p><p>tail</p></div><div class='cookie-notice'>no</div>", ("long " * 40).strip() + " tail"),
        ("<nav><a href=x>" + "menu " * 40 + "</a></nav>", ""), ("<article>unclosed <img alt='a>b'> end", "unclosed end"),
        ("<h1>Title</h1><p>A short page.</p><p>Two lines.</p>", "Title A short page. Two lines."), ('<div id="page" class="has-sidebar"><article><p>body text</p></article></div>', "body text"),
        ('<div class="entry-header"><h1>Title</h1></div>', "Title"), ('<section class="related-work">a</section><p class="search-term">b</p>', "a b"), ('<div class="sidebar"><h1>T</h1>x</div>', "T x"),
        ('<p>one <span class="ad">buy <span>x</span> more ad</span> two</p>', "one two"), ("Let <math>x</math> be", "Let x be"), ("<article>" + "<div>" * 40 + "<b>deep</b></article><p class=ad>no", "deep"),
        ("<article><header><h1>T</h1></header><p>Body <a href=x>link</a>.</p><ul><li><a href=y>see</a></ul></article><p>far out", "T Body link. see"), ("<p title='class=ad'>in", "in"),
    ],
)
def test_html(page, want):
    assert html.main_text(page) == want


LINKS = "<ul>" + "<li><a href=/>m</a>" * 4 + "</ul>"


def test_html_surge_decides():
    """Nothing but the block lengths tells these lines apart: without the surge the first and last are kept."""
    page = "<div>Welcome</div>" + LINKS + "<div>" + "long " * 40 + "</div><div>tail</div>" + LINKS + "<div>All rights reserved</div>"
    assert html.main_text(page) == ("long " * 40).strip() + " tail"
    assert html.main_text(page, share=1 << 30) == "Welcome " + ("long " * 40).strip() + " tail All rights reserved"
    assert html.block_lengths([3, 0, 0, 0, 5, 1]) == [3, 0, 5, 6, 6, 1]


def test_html_in_spark(spark):
    """The pages of the table, with and without a marked article, against a plain reading; odd rows and clashing columns."""
    import html as entities

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    want = {}
    for i, _, h in rows:
        body = re.search(r"(?s)<article>(.*)</article>", h)[1]
        want[i] = " ".join(entities.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
    plain = [(i + 10000, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, h in rows]
    long = "<p>" + "word " * 400_000
    odd = [(None, None, None), (None, "u", ""), (-1, "u", "<p>twice"), (-1, "u", "<p>twice"), (-2, None, long)]
    pages = spark.createDataFrame([(*r, "t", 3) for r in [*rows, *plain, *odd]], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    is_odd = lambda r: r.page_id is None or r.page_id < 0
    assert all(r.text == want[r.page_id % 10000] and r.n_chars == len(r.text) for r in got if not is_odd(r))
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got if is_odd(r)) == [(-2, "", 1_999_999), (-1, "u", 5), (-1, "u", 5), (0, "", 0), (0, "u", 0)]
    assert len(got) == len(rows) * 2 + 5 and html.extract(pages.limit(0)).count() == 0


def test_contamination(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "Two words"), (3, None), (4, ""), (None, "a b c d e f")], "item_id long, text string")
    docs = table(spark, [(1, "x A B C D E F G H I J y"), (2, "a b c d e f g h i z"), (3, "these two words here"), (4, None), (5, "two"), (6, "a b c d x e f g h i j"), (None, "two words")])
    for block in (1 << 22, 1):  # all items at once, and each in a pass of its own
        got = sorted(((r.doc_id or 0), r.item_id or 0, r.n_shared) for r in contamination.find_leaks(docs, items, block_hashes=block).collect())
        assert got == [(0, 2, 1), (1, 0, 2), (1, 1, 6), (2, 0, 2), (2, 1, 5), (3, 2, 1)]  # an item without an id is looked for too
        assert sorted(r.doc_id for r in contamination.without_leaks(docs, items, block_hashes=block).collect()) == [4, 5, 6]
    twice = table(spark, [(1, "x A B C D E F G H I J y")] * 2 + [(2, "word " * 300_000 + "two words")])
    assert sorted(r.doc_id for r in contamination.find_leaks(twice, items).collect()) == [1, 1, 1, 1, 2]  # each row, item 1 and the one without an id
    assert contamination.find_leaks(docs, items.limit(0)).count() == 0
    nameless = items.where("item_id is null").union(items.where("item_id = 2").selectExpr("null", "text"))
    assert sorted(r.doc_id for r in contamination.without_leaks(docs, nameless).collect()) == [4, 5, 6]


def plain_fingerprints(texts, low, high):
    """Per text the hash of its kept terms in each subset of the lexicon, or None where it has none there."""
    terms = [set(WORD.findall(lower(t))) for t in texts]
    held = collections.Counter(w for x in terms for w in x)
    hashed = lambda w: next(text.chunks(pa.array([w])))
    name = {w: int(text.words(hashed(w), lower=True).hash[0]) for w in held}
    band = {w for w, n in held.items() if low * len(texts) <= n <= max(1.0, high * len(texts))}

    def mixed(x):
        return int(text.mix(np.array([x % (1 << 64)], np.uint64))[0])

    def of(t):
        mine = set(WORD.findall(lower(t)))
        for w in mine:
            name.setdefault(w, int(text.words(hashed(w), lower=True).hash[0]))
        kept = (mine & band) or mine
        out = []
        for i, rate in enumerate(imatch.RATES):
            chosen = [name[w] for w in kept if mixed(name[w] ^ mixed(i + 1)) % rate == 0]
            out.append(mixed(sum(mixed(x + 1) for x in chosen)) >> 32 if chosen else None)
        return out

    return of


def test_fingerprints_against_a_plain_version(spark):
    """All fingerprints and likenesses of the smallest table."""
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    of = plain_fingerprints([t for _, t in rows], imatch.LOW, imatch.HIGH)
    line = sorted(rows, key=lambda r: -r[0])
    digits = lambda f: "".join(f"{x or 0:08x}" for x in f)

    def like(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    got = {r.doc_id: r for r in QUERIES["op10_imatch"](spark, SMALL).collect()}
    for k, (i, t) in enumerate(line):
        following = line[(k + 1) % len(line)][1]
        a, b, c = of(t), of(imatch.edited(t, following)), of(following)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (digits(a), digits(b))
        assert abs(got[i].near_edited - like(a, b)) < 1e-9 and abs(got[i].near_next - like(a, c)) < 1e-9


def test_short_different_texts_differ(spark):
    rows = [(i, "w%d" % i) for i in range(600)] + [(1000, None), (1001, "")]
    got = {r.doc_id: r for r in imatch.compare_neighbours(table(spark, rows)).collect()}
    assert len({r.fingerprint for r in got.values()}) == 601 and all(got[i].near_next < 1 for i in range(1, 600))


def test_fingerprints(spark):
    rows = corpus()
    out = imatch.compare_neighbours(table(spark, rows)).collect()
    assert len(out) == len(rows)
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    by = collections.Counter()
    for k, (i, t) in enumerate(line):
        t, n = t or "", line[(k + 1) % len(line)][1] or ""
        by[(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())] += 1
    assert by == collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out)
    prints = collections.defaultdict(set)
    for r in imatch.fingerprint(table(spark, rows)).join(table(spark, rows).select("doc_id", "text").where("doc_id <> 1"), "doc_id").collect():
        prints[r.text or ""].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out])
    lone = imatch.compare_neighbours(table(spark, [(5, "lone text")])).first()
    assert lone.near_next == 1.0


@pytest.mark.parametrize("low", [0.002, 0.03])
def test_likeness_by_brute_force(spark, low):
    rng = random.Random(7)
    rows = [(k, "w%d" % k) for k in range(60)] + [(100 + k, "u%d v%d" % (k, k)) for k in range(30)] + [(200 + k, prose(rng, 1 + 9 * k)) for k in range(20)]
    rows += [(300, None), (301, ""), (302, "One"), (303, "one"), (304, "two")]
    line = [t or "" for _, t in sorted(rows, reverse=True)]
    terms = [set(lower(t).split()) for t in line]
    held = collections.Counter(w for t in terms for w in t)
    band = {w for w, n in held.items() if low * len(rows) <= n <= 0.2 * len(rows)}
    names = sorted({w for t in terms for w in t} | {lower(w) for t in line for w in imatch.edited(t, line[(line.index(t) + 1) % len(line)]).split()})
    whole = pa.array(names, pa.large_string())
    code = {w: h for c in text.chunks(whole) for w, h in zip(names[c.first : c.last], text.words(c, lower=True).hash, strict=True)}

    def subsets(t):
        kept = set(lower(t).split())
        kept = kept & band or kept
        out = []
        for i, rate in enumerate(imatch.RATES):
            salt = text.mix(np.array([i + 1], np.uint64))
            out.append({w for w in kept if text.mix(np.array([code[w]], np.uint64) ^ salt)[0] % np.uint64(rate) == 0})
        assert out[0] == kept
        return out

    def near(a, b):
        pairs = [(x, y) for x, y in zip(subsets(a), subsets(b), strict=True) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    out = sorted(imatch.compare_neighbours(table(spark, rows), low=low).collect(), key=lambda r: -r.doc_id)
    for k, r in enumerate(out):
        t, following = line[k], line[(k + 1) % len(line)]
        assert r.near_next == pytest.approx(near(t, following)), (t, following)
        assert r.near_edited == pytest.approx(near(t, imatch.edited(t, following))), (t, following)
    prints = collections.defaultdict(set)
    for r in out:
        prints[r.fingerprint].add(frozenset(subsets(line[out.index(r)])[0]))
    assert all(len(sets) == 1 for sets in prints.values())  # different kept terms never share a fingerprint


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels.where("doc_id % 2 = 0"))


@pytest.mark.parametrize(("given", "quality_share", "toxic_share"), [(True, 0.98, 0.96), (False, 0.9, 0.9)])
def test_quality_on_held_out_labels(spark, labelled, given, quality_share, toxic_share):
    """With half of the labels as one more labeller, and without any label."""
    docs, labels, model = labelled
    model = model if given else quality.fit(docs, None)
    rows = quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([(r.quality_score >= 0.5) == bool(r.quality) for r in rows]) > quality_share
    assert np.mean([(r.toxic_score >= 0.5) == bool(r.toxic) for r in rows]) > toxic_share
    odd = quality.judge(table(spark, [(1, None), (2, ""), (None, "### $$$ %%%"), (1, "word " * 300_000)]), model, carry=["doc_id", "keep"])
    assert odd.columns == ["doc_id", "keep_", "quality_score", "toxic_score", "keep"] and odd.count() == 4


def test_quality_sample_is_bounded(spark):
    """Rows that repeat an id are one row of the sample; labels of other documents take no place; the order of rows doesn't matter."""
    rng = random.Random(2)
    rows = [(7, prose(rng, 40)) for _ in range(300)] + [(i, prose(rng, 30)) for i in range(10)] + [(None, "x y")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 1), (7, 0, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    real, seen = quality.fit_linear, []
    quality.fit_linear = lambda parts, target, **k: (seen.append(len(parts)), real(parts, target, **k))[1]
    try:
        models = [quality.fit(table(spark, r), labels, sample=4) for r in (rows, rows[::-1])]
    finally:
        quality.fit_linear = real
    assert max(seen) <= 4
    assert np.array_equal(models[0].quality[0], models[1].quality[0]) and models[0].toxic[1] == models[1].toxic[1]


def test_quality_of_plain_english(spark, labelled):
    """Sentences that share no words with the tables: symbols go, plain prose stays."""
    model = labelled[2]
    good = "The museum on the hill is open to visitors from nine in the morning, and there is a small garden behind it that was planted by the founder of the town. " * 3
    junk = "$$$ WIN ### NOW *** CLICK %%% HERE &&& FREE $$$ " * 12
    got = {r.doc_id: r for r in quality.judge(table(spark, [(1, good), (2, junk)]), model).collect()}
    assert got[1].keep and got[1].quality_score > got[2].quality_score


def test_label_model_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.4
    votes = np.stack([np.where(rng.random(2000) < a, truth, ~truth).astype(int) for a in (0.95, 0.9, 0.85, 0.55)], 1)
    model = quality.label_model(votes)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95
    assert model.share[0, 1, 1] > model.share[3, 1, 1]
    rows, times = np.unique(votes, axis=0, return_counts=True)
    assert np.allclose(quality.label_model(rows, times).share, model.share)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: jaccard.near_duplicates(d), lambda d: automata.remove_repeats(d), lambda d: suffixes.remove_repeats(d), lambda d: packing.pack(d), lambda d: imatch.compare_neighbours(d),
        lambda d: quality.judge(d, quality.fit(d)), lambda d: contamination.find_leaks(d, d.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")),
    ],
)
def test_empty_tables(spark, run):
    assert run(table(spark, []).where("doc_id = 0")).count() == 0
    blank = run(table(spark, [(1, None), (2, ""), (3, " ")]))  # rows, but no word in any
    assert blank.count() in (0, 3)


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as p

    rng = random.Random(11)
    a, b, d, e, f, g = (prose(rng, 120, 400) for _ in range(6))
    near = a + " end"
    rows = [(1, a), (1, b), (0, near)]  # 1 repeats: one row is a near copy of 0, the other is unique
    rows += [(5, d), (5, d), (6, d + " end")]  # exact repeated rows lead a group
    rows += [(None, e), (None, e), (None, e + " end"), (None, f), (7, f), (9, g), (9, g + " end")]
    rows += [(None, None), (None, None), (8, ""), (8, ""), (2, " ")]
    out = p.near_duplicate_stage(spark, table(spark, rows), SMALL)
    assert out.columns == table(spark, rows).columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert all(got[x] == rows.count(x) for x in rows if not (x[1] or "").strip())
    kept = [x for x in got.elements() if (x[1] or "").strip()]
    assert {(0, near), (1, b), (5, d), (7, f)} <= set(kept) and len(kept) == 6
    assert sum(t in (e, e + " end") for _, t in kept) == 1 and sum(t in (g, g + " end") for _, t in kept) == 1


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SMALL)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "n-gram Jaccard join":
            rows = [(r.doc_id, r.text) for r in seen.collect()]
            keep = {r[2] for r in components(rows)}
            assert {r.doc_id for r in out.collect()} == keep
        seen = out
    packed = p.run(spark, SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen.collect()}
    assert packed.where(F.col("padding") < 0).count() == 0


def test_small_steps_take_few_tasks(spark):
    """A small graph's steps and few pairs to verify aren't dealt over all shuffle partitions, and steps without a pair are left out."""
    rng = random.Random(8)
    base = prose(rng, 120, 5000).split()
    rows = [(i, " ".join([*base[: i % 9], f"x{i}", *base[i % 9 :]])) for i in range(40)]
    parts, put = {}, jaccard.Shelf.put
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    jaccard.Shelf.put = lambda self, df, name: (name in ("large1", "edges1", "checked1") and parts.update({name: df.rdd.getNumPartitions()}), put(self, df, name))[1]
    try:
        got = jaccard.near_duplicates(table(spark, rows), block=8).collect()
    finally:
        jaccard.Shelf.put = put
        spark.conf.set("spark.sql.shuffle.partitions", old[0]), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert collections.Counter(map(tuple, got)) == components(rows)
    assert parts["large1"] == parts["edges1"] == parts["checked1"] == 1
