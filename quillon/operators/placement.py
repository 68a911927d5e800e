"""Where citation markers stand in manuscripts, and which of them can be replaced.

A marker is looked for in the paragraphs of its own document (an equi-join on doc_id). Hits meet the runs of their paragraph in cells of
CELL characters: both are entered in each cell that they touch, and a pair counts in the first cell that the two share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
CELL = 128


_MARK = "\uffff"  # no character of XML


def _between(text: Column, marker: Column) -> Column:
    """What lies before, between and after the occurrences of a marker, taken literally, left to right without overlap."""
    quoted = F.concat(F.lit("\\Q"), F.replace(marker, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    plain = F.split(F.replace(text, marker, F.lit(_MARK)), _MARK)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, quoted)).otherwise(plain)


def hits(markers: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para, marker, hit, start, end): every occurrence, left to right without overlap, of every marker (doc_id, marker).

    A paragraph meets all markers of its document at once and goes on with those that it holds.
    """
    sought = markers.where("marker <> ''").groupBy("doc_id").agg(F.collect_set("marker").alias("markers"))
    held = paragraphs.select("doc_id", "para", "text").join(sought, "doc_id").withColumn("marker", F.explode(F.filter("markers", lambda m: F.contains("text", m))))
    pieces = F.transform(_between(c("text"), c("marker")), lambda x: F.length(x))
    each = held.select("doc_id", "para", "marker", F.size(pieces).alias("n"), F.posexplode(pieces).alias("hit", "gap"))
    before = F.sum("gap").over(Window.partitionBy("doc_id", "para", "marker").orderBy("hit"))
    start = (before + c("hit") * F.length("marker")).cast("int")
    rows = each.withColumn("start", start).where(c("hit") < c("n") - 1)
    return rows.select("doc_id", "para", "marker", "hit", "start", (c("start") + F.length("marker")).alias("end"))


def _cells(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / CELL), F.floor((F.greatest(end, start + 1) - 1) / CELL))


def _met(found: DataFrame, runs: DataFrame, how: str = "inner") -> DataFrame:
    """Hits with each run that they touch; `left`: hits in cells without such a run too, with nulls."""
    f = found.withColumn("cell", F.explode(_cells(c("start"), c("end"))))
    r = runs.where("text_end > text_start").select("doc_id", "para", "run", "text_start", "text_end", "before", "upto", F.explode(_cells(c("text_start"), c("text_end"))).alias("cell"))
    f, r = f.alias("f"), r.alias("r")
    same = [c(f"f.{k}") == c(f"r.{k}") for k in ("doc_id", "para", "cell")]
    over = (c("r.text_start") < c("f.end")) & (c("r.text_end") > c("f.start")) & (c("f.cell") == F.floor(F.greatest("f.start", "r.text_start") / CELL))
    return f.join(r, [*same, over], how).select("f.*", "r.run", "r.before", "r.upto")


def touched(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Hits with each run that they touch."""
    return _met(found, runs).select("doc_id", "para", "marker", "hit", "start", "end", "run", "before", "upto")


def placements(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Hits with `first_run`, `last_run`, why (null: it can be placed) and shares_run (another hit touches one of its runs).

    A hit can't be replaced where a comment's anchor lies between the start of its first run and the end of its last: in one of these
    runs, between them, in a run without text, or beside other markup.
    """
    key = ["doc_id", "para", "marker", "hit"]
    over = _met(found, runs, "left").select(*key, "run", "before", "upto")
    users = F.when(c("run").isNotNull(), F.count("*").over(Window.partitionBy("doc_id", "para", "run")))
    rows = over.withColumn("users", users).groupBy(*key).agg(
        F.min("run").alias("first_run"), F.max("run").alias("last_run"), (F.max("upto") - F.min("before")).alias("cut"), F.max("users").alias("users")
    )
    why = F.when(c("first_run").isNull(), "no run holds it").when(c("cut") > 0, "it straddles a comment's anchor")
    return rows.select(*key, "first_run", "last_run", why.alias("why"), F.coalesce(c("users") > 1, F.lit(False)).alias("shares_run"))


def report(markers: DataFrame, placed: DataFrame) -> DataFrame:
    """Per document: markers placed, occurrences skipped, and markers that stand nowhere."""
    none = F.lit(0).cast("long")
    hit = placed.select("doc_id", "marker", none.alias("asked"), c("why").isNull().cast("long").alias("placed"), c("why").isNotNull().cast("long").alias("skipped"))
    rows = markers.select("doc_id", "marker", F.lit(1).cast("long").alias("asked"), none.alias("placed"), none.alias("skipped")).union(hit)
    per = rows.groupBy("doc_id", "marker").agg(*(F.sum(x).alias(x) for x in ("asked", "placed", "skipped")))
    lost = F.when(c("placed") + c("skipped") == 0, c("asked")).otherwise(0)
    whole = per.groupBy("doc_id").agg(F.sum("placed").alias("placed"), F.sum("skipped").alias("skipped"), F.sum(lost).alias("unmatched"), F.sum("asked").alias("asked"))
    return whole.where("asked > 0").select("doc_id", "placed", "skipped", "unmatched")
