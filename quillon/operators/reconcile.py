"""Incoming records against a library: the deduplication ladder, inside the pool and inside the batch.

Items: (pos, item_key, library, title, doi, isbn, url). The ladder's rungs are equi-joins on a key (lower DOI, ISBN-13, URL key, folded
title; empty keys are dropped before the join, so they never meet); agreement of titles is a residual condition of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shelf import Shelf

c = F.col
SHARE = 512  # rows of one class that get its list of members in one task
RUNGS = {"doi": 0, "isbn": 1, "url": 2, "same-url": 3, "title": 4}


def keys(items: DataFrame) -> DataFrame:
    """(pos, title, rung, key): every key an item can be met by, once."""
    one = lambda rung, key: F.struct(F.lit(rung).alias("rung"), key.alias("key"))
    found = F.concat(
        F.array(one("doi", F.lower("doi")), one("url", C.url_key(c("url"))), one("title", C.fold_spaced(c("title")))),
        F.transform(C.isbns(c("isbn")), lambda x: one("isbn", x)),
    )
    return items.select("pos", C.fold_spaced(c("title")).alias("folded"), F.inline(found)).where("key is not null and key <> ''").distinct()


def _ends(theirs: DataFrame, by: list[str], but_itself: bool) -> DataFrame:
    """Per class its size n, its first and last position (lo, hi) and, where rows may not answer to themselves, the second ones (lo2, hi2)."""
    per = theirs.groupBy(*by).agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    if not but_itself:
        return per
    inner = theirs.select(*by, c("pos").alias("at")).join(per.where("n > 1"), by)
    return per.join(inner.groupBy(*by).agg(F.min(F.when(c("at") > c("lo"), c("at"))).alias("lo2"), F.max(F.when(c("at") < c("hi"), c("at"))).alias("hi2")), by, "left")


def _meeting(texts: DataFrame, shelf: Shelf) -> DataFrame:
    """(rung, key, folded, other): different titles of `texts` (rung, key, folded) under one key that may agree, with all that do.

    Of two titles that share three fifths of the smaller one's words, the larger holds one of the smaller's rarest words, as many as it may
    lack and one more. A title that holds another of three words or more has all of that one's inner words, so it has the rarest of them. One
    of one or two words is met by its rarest run of four characters (all of it where it is shorter). An empty title meets all.
    """
    by = ["rung", "key"]
    split = F.split("folded", " ")
    rows = texts.where("folded <> ''").select(*by, "folded", F.array_distinct(split).alias("words"), F.size(split).alias("length"), F.slice(split, 2, F.greatest(F.size(split) - 2, F.lit(0))).alias("inner"))
    held = rows.select(*by, "folded", "inner", "length", F.explode("words").alias("word"))
    seen = held.groupBy(*by, "word").agg(F.count("*").alias("n"))
    word = F.struct("n", "word", F.array_contains("inner", c("word")).alias("is_inner"))
    lines = held.join(seen.where("n > 1"), [*by, "word"], "left").withColumn("n", F.coalesce("n", F.lit(1))).groupBy(*by, "folded").agg(F.sort_array(F.collect_list(word)).alias("line"), F.first("length").alias("length"))
    lines = shelf.put(lines, "lines")
    may_lack = F.size("line") - F.floor((F.size("line") * 3 + 4) / 5).cast("int")
    inner = F.slice(F.filter("line", lambda x: x["is_inner"]), 1, F.when(c("length") >= 3, 1).otherwise(0))
    asked = lines.select(*by, c("folded").alias("small"), F.explode(F.array_distinct(F.concat(F.slice("line", F.lit(1), may_lack + 1), inner))).alias("w")).where("w.n > 1")
    asked = asked.select(*by, "small", c("w.word").alias("word"))
    by_word = asked.join(lines.select(*by, "folded", F.explode("line.word").alias("word")), [*by, "word"])
    tiny = lines.where("length <= 2").select(*by, c("folded").alias("small"))
    grams = lambda text, least, most: F.array_distinct(F.flatten(F.transform(F.sequence(least, most), lambda g: F.transform(F.sequence(F.lit(1), F.length(text) - g + 1), lambda i: F.substr(text, i, g)))))
    size = F.least(F.length("small"), F.lit(4))
    runs = tiny.select(*by, "small", F.explode(grams(c("small"), size, size)).alias("run"))
    in_all = lines.select(*by, "folded").join(tiny.select(*by).distinct(), by, "left_semi").select(*by, "folded", F.explode(grams(c("folded"), F.lit(1), F.least(F.length("folded"), F.lit(4)))).alias("run"))
    in_all = shelf.put(in_all.join(runs.select(*by, "run").distinct(), [*by, "run"], "left_semi"), "runs")
    rarest = runs.join(in_all.groupBy(*by, "run").agg(F.count("*").alias("n")), [*by, "run"]).groupBy(*by, "small").agg(F.min(F.struct("n", "run")).alias("r")).select(*by, "small", c("r.run").alias("run"))
    by_run = rarest.join(in_all, [*by, "run"])
    empty = texts.where("folded = ''").select(*by, c("folded").alias("small")).join(texts, by)
    return by_word.select(*by, "small", "folded").union(by_run.select(*by, "small", "folded")).union(empty.select(*by, "small", "folded")).where("small <> folded")


def _agreeing(mine: DataFrame, parts: DataFrame) -> DataFrame:
    """(rung, key, folded, other, lo): different titles under one ISBN or URL that agree; titles meet, not rows, and only those with a rare word in common."""
    by, shelf = ["rung", "key"], Shelf(mine.sparkSession, "agreeing")
    wanted = shelf.put(mine.where("rung in ('isbn', 'url')").select(*by, "folded").distinct(), "wanted")
    held = shelf.put(parts.select(*by, "folded", "lo"), "held")
    texts = wanted.union(held.select(*by, "folded")).distinct()
    several = texts.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    texts = shelf.put(texts.join(several, by, "left_semi"), "texts")
    met = _meeting(texts, shelf).where(C.folded_agree(c("small"), c("folded"))).select(*by, F.least("small", "folded").alias("a"), F.greatest("small", "folded").alias("b")).distinct()
    met = shelf.put(met, "met")
    both = met.select(*by, c("a").alias("folded"), c("b").alias("other")).union(met.select(*by, c("b").alias("folded"), c("a").alias("other")))
    return both.join(wanted, [*by, "folded"], "left_semi").join(held.select(*by, c("folded").alias("other"), "lo"), [*by, "other"]).select(*by, "folded", "other", "lo")


def answers(mine: DataFrame, theirs: DataFrame, but_itself: bool = False) -> DataFrame:
    """(pos, rung, rank, target, key, n, first): how the pool's `keys` answer those of a batch, a row for each rung at most.

    A pool's items with one key are a class. A row meets the class, not its members: a DOI gives the class's last item, an ISBN or URL the
    first whose title agrees, a URL without one (`same-url`) and a title give the class itself, as `key`, with its size and its first item. So
    rows and shuffle are linear in a class's size; `members` lists a class. `but_itself`: the batch is the pool, and no row answers to itself.
    """
    own = lambda end, x: F.when(c(end) == c("pos"), c(x)).otherwise(c(end)) if but_itself else c(end)
    whole = mine.join(_ends(theirs, ["rung", "key"], but_itself), ["rung", "key"]).withColumn("n", c("n") - int(but_itself)).where("n > 0")
    none = F.lit(None).cast("long")
    place = whole.where("rung = 'doi'").select("pos", "rung", own("hi", "hi2").cast("long").alias("target"), F.lit(None).cast("string").alias("key"), none.alias("n"), none.alias("first"))
    classes = whole.where("rung in ('url', 'title')").select("pos", F.when(c("rung") == "url", "same-url").otherwise(c("rung")).alias("rung"), none.alias("target"), "key", "n", own("lo", "lo2").cast("long").alias("first"))
    parts = _ends(theirs.where("rung in ('isbn', 'url')"), ["rung", "key", "folded"], but_itself)
    near = _agreeing(mine, parts).groupBy("rung", "key", "folded").agg(F.min("lo").alias("near"))
    sides = mine.where("rung in ('isbn', 'url')").join(parts, ["rung", "key", "folded"], "left").join(near, ["rung", "key", "folded"], "left")
    first = F.least(own("lo", "lo2"), c("near")).cast("long")
    agreed = sides.select("pos", "rung", first.alias("target")).groupBy("pos", "rung").agg(F.min("target").alias("target")).where("target is not null")
    agreed = agreed.select("pos", "rung", "target", F.lit(None).cast("string").alias("key"), none.alias("n"), none.alias("first"))
    return place.union(classes).union(agreed).withColumn("rank", rank(c("rung")))


def rank(rung: Column) -> Column:
    out = F
    for name, n in RUNGS.items():
        out = out.when(rung == name, n)
    return out


def settle(found: DataFrame) -> DataFrame:
    """(pos, match, outcome, target, class, n_candidates, first_candidate): the lowest rung decides. A DOI, ISBN or URL gives one target; the
    others leave the choice among the members of a class, of which the key, the size and the first are told; `listed` names all."""
    best = found.groupBy("pos").agg(F.min(F.struct("rank", "target", "rung", "key", "n", "first")).alias("e")).select("pos", "e.*")
    present = c("rung").isin("doi", "isbn", "url")
    return best.select("pos", c("rung").alias("match"), F.when(present, "present").otherwise("ambiguous").alias("outcome"), "target", c("key").alias("class"), c("n").alias("n_candidates"), c("first").alias("first_candidate"))


def listed(found: DataFrame, theirs: DataFrame, but_itself: bool = False) -> DataFrame:
    """`settle`'s rows and `candidates`: the members of a row's class among the pool's `keys` in order, between commas; `but_itself`: without the row.

    A class's list is made once, and joined to its rows in shares. What comes out grows with the square of a class's size; of that, a part in SHARE is shuffled.
    """
    last = lambda n: F.floor((n - 1) / SHARE)
    members = theirs.where("rung in ('url', 'title')").groupBy("rung", c("key").alias("class")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("pos")).alias("at"))
    line = F.concat(F.lit(","), F.array_join(F.transform("at", lambda x: x.cast("string")), ","), F.lit(","))
    lists = members.where(c("n") > int(but_itself)).select("rung", "class", line.alias("line"), F.explode(F.sequence(F.lit(0).cast("long"), last(c("n")))).alias("share"))
    shares = F.when(c("class").isNotNull(), last(c("n_candidates") + int(but_itself)) + 1).otherwise(SHARE)  # rows without a class meet no list, and are only spread
    rows = found.withColumn("rung", F.when(c("match") == "same-url", "url").otherwise(c("match"))).withColumn("share", F.pmod(F.xxhash64("pos"), shares))
    line = F.replace("line", F.concat(F.lit(","), c("pos").cast("string"), F.lit(",")), F.lit(",")) if but_itself else c("line")
    return rows.join(lists, ["rung", "class", "share"], "left").select(*found.columns, F.trim(line, F.lit(",")).alias("candidates"))


def ladder(batch: DataFrame, pool: DataFrame, but_itself: bool = False) -> DataFrame:
    """Every batch row's outcome against the pool: present, ambiguous or new; `but_itself`: the batch is the pool."""
    shelf = Shelf(batch.sparkSession, "ladder")
    mine = shelf.put(keys(batch), "mine")
    theirs = mine if batch is pool else shelf.put(keys(pool), "theirs")
    told = batch.select("pos").join(settle(answers(mine, theirs, but_itself)), "pos", "left").withColumn("outcome", F.coalesce("outcome", F.lit("new")))
    return listed(told, theirs, but_itself)


def members(pool: DataFrame, part: int = 1 << 16) -> DataFrame:
    """(rung, class, target, ord): the candidates of each class of URLs and titles in pool order, for classes of two items or more.

    A class's items are numbered in ranges of `part` positions, and the ranges by what stands before them, so no class is sorted in one task.
    """
    rows = keys(pool).where("rung in ('url', 'title')").select("rung", c("key").alias("class"), c("pos").alias("target"), F.floor(c("pos") / part).alias("part"))
    per = rows.groupBy("rung", "class", "part").agg(F.count("*").alias("n"))
    size, before = Window.partitionBy("rung", "class"), Window.partitionBy("rung", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("rung", "class", "part", F.sum("n").over(size).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).where("size > 1")
    line = F.row_number().over(Window.partitionBy("rung", "class", "part").orderBy("target"))
    return rows.join(per, ["rung", "class", "part"]).select("rung", "class", "target", (c("before") + line).cast("long").alias("ord"))


def differing(pool: DataFrame) -> DataFrame:
    """(class, target, other): the first items of each two titles under one URL that don't agree, both ways. An item stands for those of its title."""
    one = keys(pool).where("rung = 'url'").groupBy("key", "folded").agg(F.min("pos").alias("target"))
    two = one.select("key", c("folded").alias("title"), c("target").alias("other"))
    return one.join(two, "key").where((c("folded") != c("title")) & ~C.folded_agree(c("folded"), c("title"))).select(c("key").alias("class"), "target", "other")


def cliques(mine: DataFrame) -> DataFrame:
    """(pos, rung, folded, a, b): the groups of batch rows of which each two answer to each other; (a, b) is a hash that names a group.

    A DOI, a URL and a title make one each, an ISBN one for each title and one for each two titles that agree.
    """
    parts = mine.where("rung = 'isbn'").groupBy("rung", "key", "folded").agg(F.min("pos").alias("lo"))
    pairs = _agreeing(mine.where("rung = 'isbn'"), parts).select("rung", "key", "folded", F.array_sort(F.array("folded", "other")).alias("titles"))
    one = mine.select("pos", "rung", "key", "folded", F.when(c("rung") == "isbn", F.array("folded", "folded")).otherwise(F.array().cast("array<string>")).alias("titles"))
    two = mine.where("rung = 'isbn'").join(pairs, ["rung", "key", "folded"]).select("pos", "rung", "key", "folded", "titles")
    return one.union(two).select("pos", "rung", "folded", F.xxhash64("rung", "key", "titles").alias("a"), F.hash("key", "titles", "rung").alias("b"))


def _pointed(left: DataFrame) -> DataFrame:
    """(pos, to, odd, root) of undecided rows: `root` waits for none; a row that waits for one other alone points there, the rest to themselves."""
    line = F.row_number().over(Window.partitionBy("a", "b").orderBy("pos"))
    two = left.withColumn("line", line).where("line <= 2").groupBy("a", "b").agg(F.min("pos").alias("m1"), F.max("pos").alias("m2"))
    waits = left.join(two, ["a", "b"]).select("pos", F.when(c("pos") > c("m1"), c("m1")).alias("one"), (c("pos") > c("m2")).alias("many"))
    per = waits.groupBy("pos").agg(F.bool_or("many").alias("many"), F.min("one").alias("lo"), F.max("one").alias("hi"))
    single = ~c("many") & (c("lo") == c("hi"))
    single = F.coalesce(single, F.lit(False))
    return per.select("pos", F.when(single, c("lo")).otherwise(c("pos")).alias("to"), single.alias("odd"), (~c("many") & c("lo").isNull()).alias("root"))


def greedy(groups: DataFrame, shelf: Shelf) -> DataFrame:
    """(pos, is_new) of every row of `groups` (pos, a, b): in order of pos, a row is new if no earlier row of its groups is.

    Each phase settles rows that wait for nothing, and all chains that hang on them: a row that waits for one other alone is what that one
    isn't, so chains are followed by doubling, in as many steps as the logarithm of their length. Then all rows in a group with a new
    one are settled. Every step is written; a lost executor costs one step. The work of a phase is linear in the rows left.
    """
    left, done, turn = shelf.put(groups, "groups"), None, 0
    while not left.isEmpty():
        ways, step = shelf.put(_pointed(left), f"ways{turn}-0"), 0
        while True:
            there = ways.select(c("pos").alias("to"), c("to").alias("far"), c("odd").alias("far_odd"))
            moved = ways.join(there, "to").select("pos", c("far").alias("to"), (c("odd") != c("far_odd")).alias("odd"), "root", (c("far") != c("to")).alias("moved"))
            moved, step = shelf.put(moved, f"ways{turn}-{step + 1}"), step + 1
            ways = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        roots = ways.where("root").select(c("pos").alias("to"))
        told = shelf.put(ways.join(roots, "to").select("pos", (~c("odd")).alias("is_new")), f"told{turn}")
        fresh = left.join(told.where("is_new"), "pos").select("a", "b").distinct()
        met = left.join(fresh, ["a", "b"], "left_semi").select("pos").distinct().join(told, "pos", "left_anti").select("pos", F.lit(False).alias("is_new"))
        settled = shelf.put(told.union(met), f"settled{turn}")
        left = shelf.put(left.join(settled, "pos", "left_anti"), f"left{turn}")
        done = settled if done is None else done.union(settled)
        turn += 1
    return done if done is not None else left.select("pos", F.lit(False).alias("is_new"))


def in_batch(batch: DataFrame, pool: DataFrame) -> DataFrame:
    """The same where earlier batch rows that came out new are targets too: (pos, outcome, match, target, in_plan).

    A row is new if neither the pool nor an earlier new row answers it (see `greedy`). Of the new rows of a group only one can be there,
    so the others meet one target for each group that they are in.
    """
    shelf = Shelf(batch.sparkSession, "in-batch")
    mine = shelf.put(keys(batch.withColumn("pos", c("pos").cast("long"))), "keys")
    outer = shelf.put(answers(mine, keys(pool.withColumn("pos", c("pos").cast("long")))), "outer")
    groups = shelf.put(cliques(mine), "cliques")
    open_rows = groups.join(outer.select("pos").distinct(), "pos", "left_anti").select("pos", "a", "b").distinct()
    several = open_rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    met = open_rows.join(several, ["a", "b"], "left_semi")
    settled = greedy(met, shelf)
    fresh = shelf.put(batch.select(c("pos").cast("long").alias("pos")).join(outer.select("pos").distinct(), "pos", "left_anti").join(settled.where("not is_new"), "pos", "left_anti"), "fresh")
    taken = groups.join(fresh, "pos").select("a", "b", c("pos").alias("target"), c("folded").alias("other"))
    inner = groups.join(taken, ["a", "b"]).where("target < pos")
    rung = F.when((c("rung") == "url") & ~C.folded_agree(c("folded"), c("other")), "same-url").otherwise(c("rung"))
    inner = inner.select("pos", rung.alias("rung"), "target", F.lit(True).alias("in_plan")).withColumn("rank", rank(c("rung")))
    # Pool items come before planned rows; ambiguous rows have no target.
    every = outer.select("pos", "rung", "target", F.lit(False).alias("in_plan"), "rank").union(inner)
    best = every.groupBy("pos").agg(F.min(F.struct("rank", "in_plan", "target", "rung")).alias("e")).select("pos", "e.*")
    present = c("rung").isin("doi", "isbn", "url")
    told = best.select("pos", F.when(present, "present").otherwise("ambiguous").alias("outcome"), c("rung").alias("match"), F.when(present, c("target")).alias("target"), F.when(present, c("in_plan")).alias("in_plan"))
    none = lambda t: F.lit(None).cast(t)
    return fresh.select("pos", F.lit("new").alias("outcome"), none("string").alias("match"), none("long").alias("target"), none("boolean").alias("in_plan")).union(told)


def union_pool(source: DataFrame, deposit: DataFrame, one_legged: bool = False) -> DataFrame:
    """Both legs of a binding with their rank; a binding whose legs are one library has one."""
    legs = source.withColumn("leg", F.lit(0))
    return legs if one_legged else legs.unionByName(deposit.withColumn("leg", F.lit(1)))


def both_legs(source: DataFrame, deposit: DataFrame) -> DataFrame:
    """Items on both legs by `leg_signature`: the source copy to cite, and the deposit's; of several with one signature the last counts."""
    sig = C.leg_signature(c("doi"), c("title"), F.lit(None).cast("string"))
    last = source.withColumn("sig", sig).groupBy("sig").agg(F.max(F.struct("pos", "item_key")).alias("s"))
    return deposit.withColumn("sig", sig).join(last, "sig").select(c("s.item_key").alias("cite"), c("item_key").alias("copy"), "sig")


def lookup(wanted: DataFrame, source: DataFrame, deposit: DataFrame) -> DataFrame:
    """Each wanted item_key on the source leg first, then on the deposit; neither: an error naming both."""
    held = source.select("item_key", "library", F.lit(0).alias("leg")).union(deposit.select("item_key", "library", F.lit(1).alias("leg")))
    best = held.groupBy("item_key").agg(F.min(F.struct("leg", "library")).alias("b"))
    return wanted.join(best, "item_key", "left").select("item_key", c("b.library").alias("library"), F.when(c("b").isNull(), F.lit("on neither leg")).alias("error"))
