import datetime
import io
import math
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import apply, discover, hierarchy, merge, placement, reconcile, search
from quillon.sources import packages
from quillon.sources.views import Tables
from quillon.streaming import ledger, versions

ITEM = "pos long, item_key string, library string, title string, doi string, isbn string, url string"


def items(spark, *rows):
    return spark.createDataFrame([(p, f"K{p}", "groups/1", *r) for p, *r in rows], ITEM)


def test_ladder(spark):
    pool = items(spark, (0, "One study", "10.1/a", None, None), (2, "A Book", None, "0306406152", None), (4, "Page", None, None, "http://www.x.org/p/"), (6, "Solo Title", None, None, None), (8, "Again", "10.1/A", None, None))
    batch = items(spark, (1, "Else", "10.1/A", None, None), (3, "A book: subtitle", None, "9780306406157", None), (5, "A Chapter Elsewhere", None, "9780306406157", None), (7, "Other thing", None, None, "https://x.org/p"), (9, "Sólo title", None, None, None), (11, "", None, None, None))
    got = {r.pos: (r.outcome, r.match, r.target) for r in reconcile.ladder(batch, pool).collect()}
    assert got == {1: ("present", "doi", 8), 3: ("present", "isbn", 2), 5: ("new", None, None), 7: ("ambiguous", "same-url", None), 9: ("ambiguous", "title", None), 11: ("new", None, None)}


def test_in_batch_chain(spark):
    batch = items(spark, (1, "Same", None, None, None), (2, "Same", "10.1/x", None, None), (3, "Other", "10.1/X", None, None), (4, "Same", None, None, None), (5, "Other", None, None, None))
    got = {r.pos: (r.outcome, r.match, r.target, r.in_plan) for r in reconcile.in_batch(batch, items(spark).limit(0)).collect()}
    assert got[1] == ("new", None, None, None)
    assert got[2][:2] == ("ambiguous", "title")
    assert got[3][:2] == ("new", None)  # row 2 came out ambiguous, so it is no target
    assert got[4][:2] == ("ambiguous", "title") and got[5][:2] == ("ambiguous", "title")


def one_by_one(batch, pool):
    """The in-batch ladder as it reads: each row (pos, title, doi, isbn, url) against the pool and the rows before it that came out new."""
    fold = lambda t: " ".join("".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split())
    bare = lambda u: u.split("://")[-1].rstrip("/").lower() if u else ""

    def agree(a, b):
        a, b = fold(a), fold(b)
        words = lambda x: set(x.split())
        return not a or not b or a in b or b in a or len(words(a) & words(b)) >= 0.6 * max(1, min(len(words(a)), len(words(b))))

    planned, out = [], {}
    for row in batch:
        pos, title, doi, isbn, url = row
        known = [(False, *p) for p in pool] + [(True, *p) for p in planned]
        by_doi = [k for k in known if doi and k[3] and k[3].lower() == doi.lower()]
        by_isbn = [k for k in known if isbn and k[4] == isbn and agree(title, k[2])]
        by_url = [k for k in known if url and bare(k[5]) == bare(url)]
        if by_doi:
            out[pos] = ("present", "doi", by_doi[-1][1], by_doi[-1][0])
        elif by_isbn:
            out[pos] = ("present", "isbn", by_isbn[0][1], by_isbn[0][0])
        elif any(agree(title, k[2]) for k in by_url):
            first = next(k for k in by_url if agree(title, k[2]))
            out[pos] = ("present", "url", first[1], first[0])
        elif by_url:
            out[pos] = ("ambiguous", "same-url", None, None)
        elif any(fold(title) and fold(title) == fold(k[2]) for k in known):
            out[pos] = ("ambiguous", "title", None, None)
        else:
            out[pos] = ("new", None, None, None)
            planned.append(row)
    return out


ISBNS = ["9781554042951", "9791090636071", "9780306406157"]


@pytest.mark.parametrize(("size", "kinds"), [(60, 12), (70, 40), (25, 3)])
def test_in_batch_as_one_by_one(spark, size, kinds):
    rng = random.Random(4 + kinds)
    title = lambda k: f"Quite another{k} thing{k} named{k} here{k % 3}"
    make = lambda i: (i, rng.choice([None, "", *(title(k) for k in range(kinds)), *(title(k) + " and more" for k in range(3))]), rng.choice([None, None, *(f"10.1/{k}" for k in range(kinds))]), rng.choice([None] * 9 + ISBNS), rng.choice([None] * 4 + [f"http://x.org/{k}" for k in range(kinds)]))
    batch, pool = [make(100 + i) for i in range(size)], [make(i) for i in range(size // 4)]
    found = reconcile.in_batch(items(spark, *batch), items(spark, *pool)).collect()
    assert {r.pos: (r.outcome, r.match, r.target, r.in_plan) for r in found} == one_by_one(batch, pool)


def test_chains_settle_in_few_steps(spark, monkeypatch):
    """4,000 rows that each share a DOI or a URL with the next: steps follow the logarithm of the chain, not its length."""
    from quillon.sources.shelf import Shelf

    written, put = [], Shelf.put
    monkeypatch.setattr(Shelf, "put", lambda self, df, name: (written.append(name), put(self, df, name))[1])
    n = 4000
    links = spark.range(n).selectExpr("id as pos", "id div 2 as a", "0 as b").union(spark.range(n).selectExpr("id as pos", "(id + 1) div 2 as a", "1 as b"))
    got = {r.pos: r.is_new for r in reconcile.greedy(links, Shelf(spark, "chain")).collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}
    assert sum(w.startswith("ways") for w in written) <= 2 * math.log2(n) and sum(w.startswith("told") for w in written) <= 2


def test_ambiguous_rows_name_all_their_candidates(spark):
    """Also where a class is dealt over several shares, where the pool isn't the batch, and where a number holds another (1, 11, 111)."""
    n = 1500
    many = spark.range(n).selectExpr("id as pos", "case when id < 1400 then 'The same title' else 'Other number' || id end as title", "cast(null as string) as doi", "cast(null as string) as isbn", "case when id >= 1490 then 'http://x.org/one' when id % 100 = 0 then 'http://x.org/of' || id div 200 end as url")
    got = {r.pos: r for r in reconcile.ladder(many, many, but_itself=True).collect()}
    assert len(got) == n and n > 2 * reconcile.SHARE
    for i in range(n):
        kind = "url" if i % 100 == 0 and i < 1400 and i // 200 * 200 + 100 < 1400 else "title" if i < 1400 else "same-url" if i >= 1490 else None
        others = [k for k in (range(1400) if kind == "title" else range(1490, n)) if k != i]
        assert (got[i].match, got[i].candidates) == (kind, ",".join(map(str, others)) if kind in ("title", "same-url") else None), i
    pool = items(spark, (1, "A title", None, None, None), (11, "a title", None, None, None), (111, "Else here", None, None, "http://x.org/p"))
    batch = items(spark, (1, "A Title", None, None, None), (2, "Wholly different", None, None, "http://x.org/p"), (3, "New", None, None, None), (4, None, None, None, None))
    assert {r.pos: r.candidates for r in reconcile.ladder(batch, pool).collect()} == {1: "1,11", 2: "111", 3: None, 4: None}


def test_a_hot_title_meets_its_class(spark):
    """Rows that come out of the joins follow the items, not their pairs."""
    n = 3000
    many = spark.range(n).selectExpr("id as pos", "'The same title' as title", "cast(null as string) as doi", "cast(null as string) as isbn", "case when id % 2 = 0 then 'http://x.org/a' else 'http://x.org/' || id end as url")
    mine = reconcile.keys(many)
    found = reconcile.answers(mine, mine, but_itself=True)
    assert found.count() <= 4 * n
    told = {r.pos: (r.match, r.target, r["class"], r.n_candidates, r.first_candidate) for r in reconcile.settle(found).collect()}
    assert told[0] == ("url", 2, None, None, None) and told[2] == ("url", 0, None, None, None)
    assert told[1] == ("title", None, "the same title", n - 1, 0) and len(told) == n
    listed = reconcile.members(many, part=100).where("rung = 'title'").orderBy("target").collect()
    assert [(r.target, r.ord) for r in listed] == [(i, i + 1) for i in range(n)]


def test_discovery(spark):
    paras = ["Intro (Lindström et al., 2019; see Okoro & Lee, 2001).", "Only numbers 12(3) and (2001).", "BIBLIOGRAPHY (draft)", "", "1. Lindström, A. (2019). Title. https://doi.org/10.1000/abc.", "Okoro, B. (2001). Book. ISBN 1-55404-295-X"]
    df = spark.createDataFrame([("d", i, p) for i, p in enumerate(paras)], "doc_id string, para int, text string")
    rows = {r.surname_key: (r.entry_pos, r.kind, r.identifier) for r in discover.linked(df).collect()}
    assert rows == {"lindstrom": (0, "doi", "10.1000/abc"), "okoro": (1, "isbn", "1-55404-295-X".replace("-", ""))}
    s = discover.summary(df).first()
    assert (s.candidates, s.grouped, s.atoms, s.entries, s.auto, s.human) == (1, 1, 2, 2, 1, 0)


def test_discovery_takes_one_shuffle_by_document(spark):
    """Measures and listing of several documents, of rows of no document, and of one without a find; nothing is shuffled a second time."""
    docs = {
        "a": ["See (Smith, 2001; Jones et al., 2002) and (smith; 1999).", "Again (Smith, 2001) or (Smith, 2001; Smith, 2001).", "References", "1. Smith, A. (2001). No link.", "Smith, B. (2001). https://doi.org/10.1000/later.", "Jones, C. (2002). https://x.org/j."],
        "b": ["Nothing here."], None: ["Lost (Smith, 2001).", "References", "Smith, A. (2001). https://x.org/s."],
    }
    rows = spark.createDataFrame([(d, 2 * i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "doc_id string, para int, text string")
    told = discover.summary(rows, listed=True)
    plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {r.doc_id: r for r in told.collect()}
    measures = {d: [got[d][m] for m in discover.MEASURES] for d in docs}
    assert measures == {"a": [3, 2, 5, 2, 0, 3, 0, 3, 1, 0, 1, 1], "b": [0] * 12, None: [0] * 12}
    assert [(x.para, x.cand, x.atom_pos, x.atom, x.kind, x.identifier) for x in got["a"].found] == [
        (0, 0, 0, "Smith, 2001", "", ""), (0, 0, 1, "Jones et al., 2002", "url", "https://x.org/j"), (2, 0, 0, "Smith, 2001", "", ""), (2, 1, 0, "Smith, 2001", "", ""), (2, 1, 1, "Smith, 2001", "", ""),
    ]
    assert got["b"].found == [] and got[None].found == []


def test_candidates_of_any_length_equal_sql(spark):
    import duckdb

    from quillon.plans.discover import CANDS

    long = "; ".join(f"Author{k} and Others of a Long Name et al., {1950 + k % 50}" for k in range(40))
    texts = [f"See ({long}) and (Smith, 2001).", f"Prose ({'word ' * 100}of Smith, 2001, p. 12) there.", "Parted (Smith; see 2001) and (12; Jones 1999a).", f"Late (Smith, 2001, {'x' * 60}) is none.", "None (in 12345 words)."]
    rows = [(1, i, x) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, para long, text string")
    ours = sorted(tuple(r) for r in discover.candidates(df).select("doc_id", "para", "cand", "inside").collect())
    db = duckdb.connect()
    db.execute("create table paras (doc_id bigint, para bigint, text varchar)")
    db.executemany("insert into paras values (?, ?, ?)", rows)
    assert ours == sorted(db.execute(CANDS.replace("{v_paragraphs}", "paras")).fetchall())
    assert [(p, k) for _, p, k, _ in ours] == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)] and len(ours[0][3]) > 1000
    assert len(discover.atoms(df).where("para = 0").collect()) == 41


def test_paragraphs_are_those_of_the_view(spark):
    from quillon.plans.discover import paragraphs

    t = Tables(spark, "/root/testdata/sf0.001")
    ours, theirs = paragraphs(t), t("v_paragraphs")
    assert ours.dtypes == theirs.dtypes
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty() and not ours.isEmpty()
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 < theirs._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_merge_rules(spark):
    schema = "n int, source_type string, item map<string,string>, creators array<struct<creator_type:string,last_name:string,first_name:string,name:string>>, item_type string, metadata map<string,string>, fields map<string,string>, authors array<string>, editors array<string>, identifier string, kind string"
    rows = [
        (1, "webpage", {"title": "T", "websiteTitle": "W", "url": "http://x"}, [("author", "L", "F", None), ("translator", "M", "F", None)], "statute", None, None, None, None, "http://x", "url"),
        (2, "book", {"title": "T", "publisher": "P"}, [("author", "L", "F", None)], None, {"publisher": "Q", "place": "Rome"}, None, ["Rossi, Ada", "A Body"], None, None, None),
        (3, None, None, None, "book", {"place": "Rome"}, None, None, None, None, None),
        (4, None, None, None, None, {"title": "x"}, None, None, None, None, None),
        (5, "book", {"title": "T"}, None, "wrong", None, None, None, None, None, None),
    ]
    got = {r.n: r for r in merge.merge(spark.createDataFrame(rows, schema), today="2026-02-03").collect()}
    assert got[1].merged == {"nameOfAct": "T", "code": "W", "url": "http://x"} and got[1].dropped == {} and [x.creator_type for x in got[1].merged_creators] == ["author"]
    assert [tuple(o) for o in got[2].overridden] == [("publisher", "P", "Q")] and got[2].asserted == {"place": "Rome"} and got[2].source == "translator+caller"
    assert [(x.last_name, x.first_name, x.name) for x in got[2].merged_creators] == [("Rossi", "Ada", None), (None, None, "A Body")]
    assert [got[n].error for n in (3, 4, 5)] == ["no title", "no item type", "unknown item type"]


def test_every_warning(spark):
    """Each of the fifteen kinds, with the outcome of its row."""
    schema = "n int, said_keys array<string>, identifier string, kind string, resolved boolean, source_type string, item map<string,string>, creators array<struct<creator_type:string,last_name:string,first_name:string,name:string>>, item_type string, metadata map<string,string>, fields map<string,string>, authors array<string>, editors array<string>, hint string"
    people = [("author", "Okoro", "B.", None)]
    row = lambda n, keys=None, ident=None, kind=None, ok=True, of=None, item=None, made=None, kind_of=None, meta=None, hint=None, authors=None: (n, keys, ident, kind, ok, of, item, made, kind_of, meta, None, authors, None, hint)
    rows = [
        row(1, ["id", "colour", "x"], "10.1/a", "doi"), row(2), row(3, None, "words", None, False), row(4, None, "words", None, False, kind_of="book", meta={"title": "T"}), row(5, None, "10.1/a", "doi", False, kind_of="book", meta={"title": "T"}),
        row(6, None, "http://x.org/a.pdf", "url", False), row(7, None, "9781554042951", "isbn", False), row(8, None, "http://x.org/a", "url", False, kind_of="webpage", meta={"title": "T"}), row(9, None, "http://x.org/a", "url", False, kind_of="webpage", meta={"place": "Rome"}),
        row(10, None, "http://x.org/a", "url", True, "webpage", {"title": "T"}, people), row(11, None, "http://x.org/a.pdf", "url", True, "book", {"title": "T"}, people), row(12, None, "10.1/a", "doi", True, "book", {"title": "T", "edition": "2"}, people, "webpage"),
        row(13, None, "10.1/a", "doi", True, "book", {"title": "The one book"}, people, None, {"title": "Quite another thing"}), row(14, None, None, None, True, kind_of="book", meta={"title": "T"}), row(15, None, "10.1/a", "doi", True, "book", {"title": "T"}, people, None, None, "Smith"),
        row(16, None, "10.1/a", "doi", True, "book", {"title": "T"}, people, None, None, "okoro"), row(17, None, "10.1/a", "doi", True, "book", {"title": "T"}, people, "book", None, None, [" "]),
    ]
    got = {r.n: (r.outcome, r.warnings) for r in merge.plan_rows(spark.createDataFrame(rows, schema)).collect()}
    lost, alone = "the identifier led to nothing", "nothing was read: built from the caller's metadata"
    assert got == {
        1: ("invalid", ["unknown entry keys: colour, x"]), 2: ("invalid", ["neither an identifier nor a record"]), 3: ("unresolved", [lost]), 4: ("invalid", [lost, "leave out an identifier that is none"]),
        5: ("unresolved", [lost, "a doi that leads nowhere was probably copied wrong"]), 6: ("unresolved", [lost, "a PDF is rarely read: give type and metadata"]), 7: ("unresolved", [lost, "no catalogue has this ISBN: give type and metadata"]),
        8: ("new", [lost, alone, "caller's metadata alone"]), 9: ("invalid", [lost, alone, "no field for a metadata key"]), 10: ("new", ["uncertain type"]), 11: ("new", ["read from a PDF"]), 12: ("new", ["no room for: edition"]),
        13: ("new", ["titles disagree"]), 14: ("new", ["caller's metadata alone"]), 15: ("new", ["another first author"]), 16: ("new", []), 17: ("invalid", ["an empty name"]),
    }


def test_item_types_are_tables(spark):
    """A library's own types in place of the fixed ones."""
    fields, roles = merge.type_tables(spark, {"map": ["caseName", "date", "genre"]}, {"map": ["cartographer"]})
    told = merge.types(fields, roles).first()
    assert (told.valid, told.roles, told.slots) == (["caseName", "date", "genre"], ["cartographer"], {"title": "caseName", "date": "date", "kind": "genre"}) and sorted(told.takes) == ["date", "kind", "title"]
    schema = "source_type string, item map<string,string>, creators array<struct<creator_type:string,last_name:string,first_name:string,name:string>>, item_type string, metadata map<string,string>, fields map<string,string>, authors array<string>, editors array<string>, identifier string, kind string"
    r = merge.merge(spark.createDataFrame([("book", {"title": "T", "place": "Rome"}, [("author", "A", "B", None)], "map", None, None, None, None, None, None)], schema), merge.types(fields, roles)).first()
    assert r.merged == {"caseName": "T"} and r.dropped == {"place": "Rome"} and r.error is None


def test_quarantine_and_pruning(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for part in packages.PARTS[:2]:
            z.writestr(part, f"<{part[:2]}/>")
    (tmp_path / "in").mkdir()
    for name, content in (("a", held.getvalue()), ("b", b"no package"), ("c", b"PK")):
        (tmp_path / "in" / f"{name}.docx").write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path / "in")).select(F.col("path").alias("doc_id"), "content")
    packages.take_in(files, str(tmp_path / "out"))
    rows = packages.stored(spark, str(tmp_path / "out"))
    one = rows.where(F.col("part") == packages.PARTS[1])
    assert [r.xml for r in one.collect()] == ["<do/>"] and "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()
    assert sorted((r.doc_id[-6:], r.error) for r in rows.where(F.col("part") == packages.QUARANTINE).collect()) == [("b.docx", "unreadable: BadZipFile"), ("c.docx", "unreadable: BadZipFile")]


def test_subtree_and_filing(spark):
    tree = spark.createDataFrame([("R", "Root", None), ("A", "Ann", "R"), ("B", "Bob", "A"), ("X", "Loop", "Y"), ("Y", "Loop2", "X")], "collection_key string, name string, parent string")
    below = hierarchy.subtree(tree, "R")
    assert {(r.collection_key, r.depth) for r in below.collect()} == {("R", 0), ("A", 1), ("B", 2)}
    assert hierarchy.subtree(tree, "X").count() == 2  # a cycle ends
    with pytest.raises(hierarchy.MissingRoot):
        hierarchy.subtree(tree, "gone")
    held = spark.createDataFrame([("K1", "g", ["R"], 3), ("K2", "g", ["Z"], 1), ("K3", "g", ["A"], 2)], "item_key string, library string, collections array<string>, version long")
    req = spark.createDataFrame([("K1", "A", True, 3), ("K2", "A", False, 1), ("K3", "A", False, 2), ("K3", "B", False, 9), ("K9", "A", False, 1)], "item_key string, target string, move boolean, version long")
    out = sorted((r.item_key, r.outcome, ",".join(r.collections or [])) for r in hierarchy.file_items(req, held, below, "R").collect())
    assert out == [("K1", "filed", "A"), ("K2", "refused", "Z"), ("K3", "failed", "A"), ("K3", "unchanged", "A"), ("K9", "refused", "")]


def test_a_deep_tree(spark, monkeypatch):
    """A chain of 10,000 levels takes a number of steps that follows its logarithm."""
    from quillon.sources.shelf import Shelf

    written, put = [], Shelf.put
    monkeypatch.setattr(Shelf, "put", lambda self, df, name: (written.append(name), put(self, df, name))[1])
    n = 10_000
    chain = spark.range(n).selectExpr("'k' || id as collection_key", "'n' as name", "case when id > 0 then 'k' || (id - 1) end as parent")
    got = hierarchy.subtree(chain.union(spark.createDataFrame([("lost", "n", "nowhere")], chain.schema)), "k5").collect()
    assert {(r.collection_key, r.depth) for r in got} == {(f"k{i}", i - 5) for i in range(5, n)}
    assert sum(w.startswith("ways") for w in written) <= math.log2(n) + 4


def test_order_of_a_tree(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", rng.choice("abc"), f"c{rng.randrange(i)}" if i else None) for i in range(60)] + [(f"c{i}", "z", f"c{i - 1}") for i in range(60, 90)]
    children = {}
    for key, name, parent in rows:
        children.setdefault(parent, []).append((name, key))
    line, todo = [], ["c0"]
    while todo:  # breadth first, siblings by name
        line.append(todo.pop(0))
        todo += [k for _, k in sorted(children.get(line[-1], []))]
    tree = hierarchy.subtree(spark.createDataFrame(rows, "collection_key string, name string, parent string"), "c0")
    assert [r.collection_key for r in hierarchy.order_of(tree).orderBy("place").collect()] == line


def test_search(spark):
    items = spark.createDataFrame([("g/1", "a", "The Élan of Ducks", ["Okoro, B."]), ("g/2", "b", "Ducks", ["Élan Body"]), ("g/3", "c", "ducks elan", None), ("g/1", "d", None, None), ("g/1", "e", "Ducks elan", [])], "library string, item_key string, title string, creators array<string>")
    queries = spark.createDataFrame([(1, 7, "elan DUCKS"), (2, 7, "okoro"), (3, 7, "absent ducks"), (4, 7, " - "), (5, 8, "ducks"), (6, 7, None), (7, 7, "ducks ducks")], "query long, user_id long, text string")
    readable = spark.createDataFrame([(7, "g/1"), (7, "g/2"), (7, "g/2"), (8, "g/3")], "user_id long, library string")
    found = search.search(queries, *search.index(items), readable, limit=2)
    assert sorted(map(tuple, found.collect())) == [(1, 1, "g/1", "a"), (1, 2, "g/1", "e"), (2, 1, "g/1", "a"), (5, 1, "g/3", "c"), (7, 1, "g/1", "a"), (7, 2, "g/1", "e")]


def test_markers(spark):
    xml = '<w:p><w:r><w:t>See [@a</w:t></w:r><w:r><w:t>b] and [@ab]</w:t></w:r></w:p><w:p><w:r><w:t>[@</w:t></w:r><w:commentRangeStart w:id="1"/><w:r><w:t>ab]</w:t></w:r></w:p>'
    parts = spark.createDataFrame([("d", packages.PARTS[0], xml)], "doc_id string, part string, xml string")
    paras = packages.paragraphs(parts)
    markers = spark.createDataFrame([("d", "[@ab]"), ("d", "[@zz]")], "doc_id string, marker string")
    laid = packages.laid_out(paras)
    placed = placement.placements(placement.hits(markers, laid), packages.runs(laid))
    got = sorted((r.para, r.hit, r.first_run, r.last_run, r.why, r.shares_run) for r in placed.collect())
    assert got == [(0, 0, 0, 1, None, True), (0, 1, 1, 1, None, True), (1, 0, 0, 1, "it straddles a comment's anchor", False)]
    assert tuple(placement.report(markers, placed).first()) == ("d", 2, 1, 1)


ANCHORS = {  # what stands around a marker over two runs -> whether a comment's anchor is cut
    "between": ("{a}<w:commentRangeEnd w:id='1'/>{b}", True), "run of its own": ("{a}<w:r><w:commentReference w:id='1'/></w:r>{b}", True),
    "behind a bookmark": ("{a}<w:bookmarkStart w:id='3'/><w:commentRangeStart w:id='1'/>{b}", True), "behind an empty run": ("{a}<w:r><w:rPr/></w:r><w:commentRangeEnd w:id='1'/>{b}", True),
    "before": ("<w:commentRangeStart w:id='1'/>{a}{b}", False), "after": ("{a}{b}<w:commentRangeEnd w:id='1'/>", False), "around other runs": ("{o}<w:commentRangeStart w:id='1'/>{o}{a}{b}{o}<w:commentRangeEnd w:id='1'/>{o}", False),
    "in the first run": ("<w:r><w:commentReference w:id='1'/><w:t>[@a</w:t></w:r>{b}", True), "in the last run": ("{a}<w:r><w:t>b]</w:t><w:commentReference w:id='1'/></w:r>", True), "none": ("{a}{b}", False),
}


def test_anchors_are_points_of_their_own(spark):
    run = "<w:r><w:t>{}</w:t></w:r>"
    rows = [(name, packages.PARTS[0], "<w:p>" + x.format(a=run.format("[@a"), b=run.format("b]"), o=run.format("other ")) + "</w:p>") for name, (x, _) in ANCHORS.items()]
    laid = packages.laid_out(packages.paragraphs(spark.createDataFrame(rows, "doc_id string, part string, xml string")))
    markers = spark.createDataFrame([(name, "[@ab]") for name in ANCHORS], "doc_id string, marker string")
    placed = placement.placements(placement.hits(markers, laid), packages.runs(laid)).collect()
    assert {r.doc_id: r.why is not None for r in placed} == {name: cut for name, (_, cut) in ANCHORS.items()}


def test_markers_are_literal(spark):
    texts = ["a[\\E]b[\\E][\\E]", "aaaa", "x\uffffaa\uffffa", "(a|b)* (a|b)*", "", None]
    paras = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, para int, text string")
    sought = ["[\\E]", "aa", "\uffff", "(a|b)*", "", "a", "$1"]
    got = sorted((r.para, r.marker, r.start) for r in placement.hits(spark.createDataFrame([(1, m) for m in sought * 2], "doc_id long, marker string"), paras).collect())
    want = []
    for i, t in enumerate(texts):
        for m in filter(None, sought):
            at = (t or "").find(m)
            while at >= 0:
                want.append((i, m, at))
                at = t.find(m, at + len(m))
    assert got == sorted(want)


def test_a_hit_outside_all_runs_is_reported(spark):
    laid = packages.laid_out(packages.paragraphs(spark.createDataFrame([("d", packages.PARTS[0], "<w:p><w:t>the </w:t></w:p>")], "doc_id string, part string, xml string")))
    assert placement.hits(spark.createDataFrame([("d", "the ")], "doc_id string, marker string"), laid).collect() == []  # as runs have no such text
    found = spark.createDataFrame([("d", 0, "the ", 0, 0, 4)], "doc_id string, para int, marker string, hit int, start int, end int")
    assert [r.why for r in placement.placements(found, packages.runs(laid)).collect()] == ["no run holds it"]


def test_hits_are_found_once(spark):
    """Placements and their report read paragraphs once for the hits, not once for each join that needs them."""
    run = "<w:r><w:t>{}</w:t></w:r>"
    rows = [("d", packages.PARTS[0], "<w:p>" + run.format("x" * 200 + "[@a") + run.format("b] and [@ab]") + "</w:p>"), ("e", packages.PARTS[0], "<w:p/>")]
    laid = packages.laid_out(packages.paragraphs(spark.createDataFrame(rows, "doc_id string, part string, xml string")))
    markers = spark.createDataFrame([("d", "[@ab]"), ("d", "[@zz]"), ("d", "[@zz]"), ("d", "[@ab]"), ("e", "[@ab]"), ("e", None), ("f", "y")], "doc_id string, marker string")
    placed = placement.placements(placement.hits(markers, laid), packages.runs(laid))
    assert sorted((r.hit, r.first_run, r.last_run, r.why, r.shares_run) for r in placed.collect()) == [(0, 0, 1, None, True), (1, 1, 1, None, True)]
    report = placement.report(markers, placed)
    assert sorted(map(tuple, report.collect())) == [("d", 2, 0, 2), ("e", 0, 0, 2), ("f", 0, 0, 1)]
    for df in (placed, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_set(marker") == 1


def test_packages(spark, tmp_path):
    body = '<w:p><w:r><w:t>A &amp; &#x42;</w:t></w:r><w:tab/></w:p><w:p><w:ins w:author="Zoe"><w:r><w:t>x</w:t></w:r></w:ins></w:p>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr(packages.PARTS[0], body)
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    (tmp_path / "b.docx").write_bytes(b"nothing")
    rows = packages.read(spark, str(tmp_path)).collect()
    assert sorted((r.part or "", r.error or "") for r in rows) == [("", "unreadable: BadZipFile"), (packages.PARTS[0], "")]
    paras = packages.paragraphs(packages.read(spark, str(tmp_path)).where("part is not null")).orderBy("para").collect()
    assert [(p.text, p.authors) for p in paras] == [("A & B", []), ("x", ["Zoe"])]


def test_broken_citation_takes_no_number(spark):
    good = 'ADDIN ZOTERO_ITEM CSL_CITATION {"citationID":"%s","citationItems":[]} '
    codes = good % "AAAAAAAA" + "ADDIN ZOTERO_ITEM CSL_CITATION {broken " + good % "BBBBBBBB"
    parts = spark.createDataFrame([("d", packages.PARTS[0], f"<w:instrText>{codes}</w:instrText>")], "doc_id string, part string, xml string")
    assert [(r.ord, r.citation_id) for r in packages.citations(parts).orderBy("ord").collect()] == [(0, "AAAAAAAA"), (1, "BBBBBBBB")]


def test_ledger_survives_a_replay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 3)], "binding_id long, identifier string, event_id long")
    rows.write.parquet(str(tmp_path / "in"))
    for attempt in ("one", "two"):  # another checkpoint: the same files come again, as after a lost one
        ledger.into_ledger(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ledger"), str(tmp_path / attempt))
    got = sorted((r.binding_id, r.identifier, r.event_id) for r in spark.read.parquet(str(tmp_path / "ledger")).collect())
    assert got == [(1, "a", 1), (2, "a", 3)]


PLANS = "plan_id long, binding_id long, pos long, identifier string, outcome string, in_plan boolean, force boolean, file_into boolean, error string"


def test_a_call_that_dies_leaves_no_duplicate(spark, tmp_path):
    new = lambda plan, pos, x, error=None: (plan, 1, pos, x, "new", False, False, False, error)
    plans = spark.createDataFrame([new(1, 1, "a"), new(1, 2, "b", "no room"), new(1, 3, "a"), (1, 1, 4, "c", "present", False, False, True, None), (1, 1, 5, "d", "ambiguous", False, False, False, None)], PLANS)
    ledger, asked = apply.Ledger(spark, str(tmp_path)), []

    def dies(rows):
        asked.append(rows.count())
        raise RuntimeError("lost between the places and the items")

    with pytest.raises(RuntimeError):
        apply.apply(plans, ledger, dies)
    assert asked == [2] and sorted((r.identifier, r.item_key) for r in ledger.open().collect()) == [("a", None), ("b", None)]
    again = sorted((r.pos, r.part, r.reason) for r in apply.apply(plans, ledger).collect())  # it wasn't applied, so it may come again
    mine = "already ingested into this binding"
    assert again == [(1, "skipped", mine), (2, "skipped", mine), (3, "skipped", mine), (4, "filed", None), (5, "skipped", "not decided")]
    assert {r.part for r in apply.apply(plans, ledger).collect()} == {"refused"}
    other = spark.createDataFrame([new(2, 1, "a"), new(2, 2, "e"), new(2, 3, "f", "no room")], PLANS)
    assert sorted((r.pos, r.part, r.reason) for r in apply.apply(other, ledger).collect()) == [(1, "skipped", mine), (2, "added", None), (3, "failed", "no room")]
    assert sorted(r.identifier for r in ledger.open().collect()) == ["a", "b", "f"] and ledger.rows().where("item_key is not null").count() == 1


def test_an_unfinished_folder_does_not_count(spark, tmp_path):
    ledger = apply.Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 1, 1)], apply.INTENTS)
    ledger.enter(rows)
    (tmp_path / "intents" / "call=0" / "_SUCCESS").unlink()
    assert ledger.rows().count() == 0 and ledger.enter(rows).count() == 1


def test_late_rows_meet_the_ledger(spark, tmp_path):
    at = lambda h: datetime.datetime(2026, 1, 1, h)
    batches = [[(1, "a", 1, at(1)), (1, "a", 2, at(1)), (1, "b", 3, at(9))], [(1, "c", 4, at(2)), (1, "a", 5, at(2)), (1, "d", 6, at(9))], [(1, "c", 7, at(3)), (1, "e", 8, at(1)), (2, "a", 9, at(12))]]
    for rows in batches:
        spark.createDataFrame(rows, "binding_id long, identifier string, event_id long, created_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("binding_id long, identifier string, event_id long, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ledger.into_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "progress"), "created_at")
    got = sorted((r.binding_id, r.identifier, r.event_id) for r in spark.read.parquet(str(tmp_path / "ledger")).collect())
    assert got == [(1, "a", 1), (1, "b", 3), (1, "c", 4), (1, "d", 6), (1, "e", 8), (2, "a", 9)]


def test_two_edits_of_one_version(spark, tmp_path):
    """One is filed, the other is a conflict, though the stream is started anew between them."""
    items = spark.createDataFrame([("K1", 3), ("K2", 1)], "item_key string, version long")
    schema = "event_id long, item_key string, read_version long"
    for rows in ([(1, "K1", 3), (2, "K9", 1)], [(3, "K1", 3), (4, "K1", 4), (5, "K2", 2)], [(6, "K2", 1), (7, "K1", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        versions.file_edits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), items, str(tmp_path / "out"), str(tmp_path / "progress"))
    read = lambda part: sorted((r.event_id, r.outcome, r.version) for r in spark.read.parquet(str(tmp_path / "out" / part)).collect())
    assert read("filed") == [(1, "filed", 4), (4, "filed", 5), (6, "filed", 2), (7, "filed", 6)]
    assert read("conflicts") == [(2, "refused", None), (3, "failed", 4), (5, "failed", 1)]


def test_views_read_alike(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t("v_citation_items").count() == 6000 and t("v_collections").count() == 181


def test_plan_build_as_one_by_one(spark):
    """The whole batch against a plain loop over the same merged rows: every part has one row, with its outcome, what it met and its filing."""
    from quillon.functions import columns as C
    from quillon.plans import merge as plans

    t = Tables(spark, "/root/testdata/sf0.001")
    key, bare = F.try_element_at("merged", F.lit("url")), lambda u: (u or "").split("://")[-1].rstrip("/").lower()
    words = lambda x: " ".join("".join(ch if ch.isalnum() else " " for ch in (x or "").lower()).split())
    merged = merge.plan_rows(plans.entries(t)).select("p_partkey", "outcome", C.family_value(F.col("merged"), "title").alias("title"), key.alias("url")).orderBy("p_partkey").collect()
    there, planned, want = plans.held(t).collect(), [], {}
    for row in merged:
        if row.outcome != "new":
            want[row.p_partkey] = (row.outcome, None, None, None)
            continue
        known = [(False, h.pos, words(h.title), bare(h.url), h) for h in there] + planned
        same = [k for k in known if row.url and k[3] == bare(row.url)]
        agree = [k for k in same if k[2] == words(row.title)]
        if agree:
            plan, _, _, _, h = min(agree, key=lambda k: k[:2])
            filing = None if plan else "other-leg" if h.library != "groups/1" else "already" if "N1" in h.collections else "file"
            want[row.p_partkey] = ("present", "url", plan, filing)
        elif same or any(words(row.title) and k[2] == words(row.title) for k in known):
            want[row.p_partkey] = ("ambiguous", "same-url" if same else "title", None, None)
        else:
            want[row.p_partkey] = ("new", None, None, None)
            planned.append((True, row.p_partkey, words(row.title), bare(row.url), None))
    got = {r.p_partkey: (r.outcome, r.match, r.in_plan, r.filing) for r in plans.plan_build(t).collect()}
    assert got == want
    assert {w[0] for w in want.values()} >= {"new", "present", "ambiguous", "unresolved", "invalid"} and {w[3] for w in want.values()} >= {"file", "other-leg"}


def titled(spark, titles):
    rows = [(i, x, "isbn", "9780306406157", x) for i, x in enumerate(titles)]
    mine = spark.createDataFrame(rows, "pos long, title string, rung string, key string, folded string").drop("title")
    return mine, mine.groupBy("rung", "key", "folded").agg(F.min("pos").alias("lo"))


def test_titles_of_one_isbn_agree_as_all_pairs_do(spark):
    rng = random.Random(5)
    words = [w for w in "the of a ab abc bc cab study studies in on x".split()]
    titles = sorted({" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 4, 5, 9]))) for _ in range(150)} | {"", "b c a", "ab c ab", "xab study of inx", "b study of in"})
    seen = {(r.folded, r.other) for r in reconcile._agreeing(*titled(spark, titles)).collect()}

    def agree(a, b):
        wa, wb = set(a.split()), set(b.split())
        return not a or not b or a in b or b in a or len(wa & wb) / max(1, min(len(wa), len(wb))) >= 0.6

    assert seen == {(a, b) for a in titles for b in titles if a != b and agree(a, b)}


def test_titles_of_one_isbn_dont_all_meet(spark):
    """Twice as many different titles under one ISBN make about twice as many comparisons, not four times as many."""
    rng = random.Random(6)
    compared = []
    for n in (400, 800):
        titles = [" ".join(["the", "of", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(6))]) for _ in range(n)] + ["one word", "of"]
        texts = titled(spark, titles)[0].select("rung", "key", "folded")
        compared.append(reconcile._meeting(texts, reconcile.Shelf(spark, "test")).count())
    assert compared[1] < 3 * compared[0] < 400 * 400


def test_search_of_repeated_texts(spark):
    """20,000 queries of the same words over 20,000 items that have them meet the items once, and each gets its own answer."""
    items = spark.range(20000).selectExpr("concat('groups/', id % 3) as library", "lpad(id, 5, '0') as item_key", "'Common words here' as title", "array('A B') as creators")
    queries = spark.range(20000).selectExpr("id as query", "id % 2 as user_id", "if(id % 5 = 0, 'words COMMON', 'common, words') as text")
    readable = spark.createDataFrame([(0, "groups/1"), (0, "groups/2"), (1, "groups/0")], "user_id long, library string")
    start = time.time()
    got = search.search(queries, *search.index(items), readable, limit=2).orderBy("query", "place").collect()
    assert time.time() - start < 60
    want = {0: ["00001", "00004"], 1: ["00000", "00003"]}
    assert [(r.query, r.place, r.item_key) for r in got] == [(q, i + 1, want[q % 2][i]) for q in range(20000) for i in (0, 1)]


def test_titles_of_one_url_that_do_not_agree_are_told(spark):
    url = "http://x.org/p"
    pool = items(spark, (0, "A study of birds", None, None, url), (2, "A study of birds", None, None, url), (4, "Other thing", None, None, url + "/"), (6, "Other thing again", None, None, url), (8, "", None, None, url), (10, "Far away", None, None, "http://y.org"))
    got = {(r["class"], r.target, r.other) for r in reconcile.differing(pool).collect()}
    assert got == {("x.org/p", a, b) for x in (4, 6) for a, b in ((0, x), (x, 0))}


def test_list_starts_take_one_shuffle(spark):
    """Heading and shape are found in one pass over a document; both starts as before, blank and short windows included."""
    entry, text = "Smith, A. (2001). A title.", "Some prose (Smith, 2001)."
    docs = {
        1: [text, "References", "", "", entry, entry], 2: [text] * 3 + [entry] * 12, 3: [entry] * 3, 4: [text, "References"], 5: [text] * 25 + [entry] * 8 + ["", ""],
        6: [text, None, "References", "", "", "", "", entry], 7: [text, *[entry, text] * 15],
    }
    rows = spark.createDataFrame([(d, 3 * i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "doc_id long, para long, text string")
    assert {r.doc_id: r.start for r in discover.heading_start(rows).collect()} == {1: 4, 4: 2, 6: 3}
    shaped = {r.doc_id: r.start for r in discover.shape_start(rows).collect()}
    is_entry = lambda x: x == entry
    want = {}
    for d, lines in docs.items():
        for i in range(len(lines) - 3):
            part = lines[i : i + 20]
            solid = sum(bool(x) for x in part)
            if d not in want and solid >= 8 and sum(map(is_entry, part)) >= 0.75 * solid:
                want[d] = i
    assert shaped == want and 2 in want and 5 in want
    plan = discover.split(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_large_trees_are_followed_from_stop_to_stop(spark):
    """Depths of a deep tree with lost parents and a cycle, and how many rows are written on the way: far from one full table a step."""
    from quillon.operators import hierarchy as H

    n = 3000
    up = {i: i - 1 - (i % 3 == 0) if i % 300 != 299 else -1 for i in range(1, n)} | {0: None, n: n + 1, n + 1: n, n + 2: n}
    depth = {0: 0}
    for i in range(1, n):
        if up[i] in depth:
            depth[i] = depth[up[i]] + 1
    put, rows = H.Shelf.put, []
    H.Shelf.put = lambda self, df, name: (out := put(self, df, name), rows.append(out.count()))[0]
    try:
        tree = spark.createDataFrame([(f"E{k}", "x", None if p is None else f"E{p}") for k, p in up.items()], "collection_key string, name string, parent string")
        got = {r.collection_key: r.depth for r in H.subtree(tree, "E0", few=100).collect()}
    finally:
        H.Shelf.put = put
    assert got == {f"E{k}": d for k, d in depth.items()}
    assert sum(rows) < 9 * n


def test_join_hint_tells_references_by_numbers(spark):
    """No name is sorted or gathered to tell references apart."""
    import __spark_entry__ as entry

    plan = entry.queries()["join_hint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "Aggregate [" in line and "doc_id" in line]
    assert kept and not any(x in line for line in kept for x in ("surname", "title"))


def test_packages_go_in_pieces():
    """A worker sends on what it has unpacked before it unpacks the rest of a batch."""
    import io
    import zipfile

    import pyarrow as pa

    from quillon.plans import placement
    from quillon.sources import packages as K

    n = 10 * K.PIECE + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([f"<a>{i}</a>" for i in range(n)]), pa.array(["<b/>"] * n)], ["doc_id", "main", "custom"])
    zipped = list(placement._zip(iter([batch])))
    assert max(x.num_rows for x in zipped) == K.PIECE and sum(x.num_rows for x in zipped) == n
    parts = list(K._unzip(iter([pa.Table.from_batches(zipped).combine_chunks().to_batches()[0]])))
    assert max(x.num_rows for x in parts) <= 2 * K.PIECE and len(parts) == 11
    assert {x for p in parts for x in p.column(0).to_pylist()} == set(range(n))
    assert zipfile.is_zipfile(io.BytesIO(zipped[0].column(1)[0].as_py()))
