"""Checks of the citation fields of many manuscripts at once.

Input: citation items (doc_id, citation_id, cited_at, pos, uri, doi, title, year, first_author), citations, manuscripts and revisions.
Every check returns findings (doc_id, level, code, n, detail); documents without the finding have no row. The item-level checks
aggregate by document with partial sums; only the duplicate check exchanges by document and signature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

c = F.col
LEVELS = {"error": 0, "warning": 1, "note": 2}
FOUND = ("doc_id", "level", "code", "n", "detail")
IN_ORDER = ("cited_at", "citation_id", "pos")


def has_data() -> Column:
    return ~((F.coalesce("title", F.lit("")) == "") & c("doi").isNull())


def signature() -> Column:
    return C.audit_signature(c("doi"), c("title"), c("year"), c("first_author"))


def _findings(rows: DataFrame, level: str, code: str, detail: Column | None = None) -> DataFrame:
    return rows.where("n > 0").select("doc_id", F.lit(level).alias("level"), F.lit(code).alias("code"), c("n").cast("long").alias("n"), (detail if detail is not None else F.lit("")).alias("detail"))


def address(items: DataFrame) -> Column:
    """An item's address in whole: its sorted list of URIs, or the one that it has; none has a name of its own."""
    listed = F.array_join(F.array_sort(F.coalesce("uris", F.array().cast("array<string>"))), "|") if "uris" in items.columns else c("uri")
    return F.coalesce(C.null_if_empty(listed), F.lit("<no uri>"))


def surrogates(items: DataFrame) -> DataFrame:
    """(doc_id, sig, n_uris, uris, label): one paper under several addresses in one document; no address counts as one."""
    label = F.concat(F.coalesce("first_author", F.lit("?")), F.lit(" "), F.coalesce(c("year").cast("string"), F.lit("?")), F.lit(": "), F.substring("title", 1, 60))
    rows = items.select("doc_id", *IN_ORDER, signature().alias("sig"), address(items).alias("uri"), label.alias("label"))
    grouped = rows.groupBy("doc_id", "sig").agg(F.collect_set("uri").alias("uris"), F.min(F.struct(*IN_ORDER, "label")).alias("first"))
    return grouped.where(F.size("uris") > 1).select("doc_id", "sig", F.size("uris").cast("long").alias("n_uris"), F.array_join(F.array_sort("uris"), " ").alias("uris"), "first.label")


def duplicate_surrogate(items: DataFrame) -> DataFrame:
    found = surrogates(items)
    return found.select("doc_id", F.lit("error").alias("level"), F.lit("duplicate-surrogate").alias("code"), c("n_uris").alias("n"), F.concat_ws(" | ", "label", "uris").alias("detail"))


def item_checks(items: DataFrame, k: int = 10) -> DataFrame:
    """The five checks of single items, in one aggregate by document."""
    library = C.uri_library(F.array_compact(F.array("uri")))
    malformed = has_data() & (F.coalesce("doi", F.lit("")) != "") & ~C.looks_like_doi(c("doi"))
    untitled = has_data() & (C.strip(F.coalesce("title", F.lit(""))) == "")
    shown = F.concat(F.coalesce("first_author", F.lit("?")), F.lit(" "), F.coalesce(c("year").cast("string"), F.lit("?")), F.lit(": "), "doi")
    rows = items.withColumns({"library": library, "malformed": malformed, "untitled": untitled, "local": C.is_local(library), "bare": ~has_data(), "shown": F.when(malformed, F.struct(*IN_ORDER, shown.alias("value")))})
    per = rows.groupBy("doc_id").agg(
        F.count_if(c("uri").isNull()).alias("no_uri"), F.count_if("local").alias("local"), F.array_join(F.array_sort(F.collect_set(F.when(c("local"), c("library")))), ", ").alias("profiles"),
        F.count_if("bare").alias("bare"), F.count_if("malformed").alias("malformed"), F.collect_list("shown").alias("shown"), F.count_if("untitled").alias("untitled"),
    )
    finding = lambda level, code, n, detail=None: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), c(n).alias("n"), (detail if detail is not None else F.lit("")).alias("detail"))
    first = F.array_join(F.transform(F.slice(F.array_sort("shown"), 1, k), lambda x: x["value"]), "; ")
    found = F.array(
        finding("error", "missing-uri", "no_uri"), finding("warning", "local-uri", "local", c("profiles")), finding("error", "missing-itemdata", "bare"),
        finding("warning", "malformed-doi", "malformed", first), finding("warning", "missing-title", "untitled"),
    )
    return per.select("doc_id", F.inline(F.filter(found, lambda x: x["n"] > 0)))


def _one(items: DataFrame, code: str, k: int = 10) -> DataFrame:
    return item_checks(items, k).where(c("code") == code)


def missing_uri(items: DataFrame) -> DataFrame:
    return _one(items, "missing-uri")


def local_uri(items: DataFrame) -> DataFrame:
    return _one(items, "local-uri")


def missing_itemdata(items: DataFrame) -> DataFrame:
    return _one(items, "missing-itemdata")


def malformed_doi(items: DataFrame, k: int = 10) -> DataFrame:
    return _one(items, "malformed-doi", k)


def missing_title(items: DataFrame) -> DataFrame:
    return _one(items, "missing-title")


def citation_ids(citations: DataFrame, k: int = 8) -> DataFrame:
    twice = citations.where("citation_code <> ''").groupBy("doc_id", "citation_code").agg(F.count("*").alias("times"), F.min(F.struct("cited_at", "citation_id")).alias("at")).where("times > 1")
    shown = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("at", "citation_code"))), 1, k), lambda x: x["citation_code"])
    return _findings(twice.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(shown, ", ").alias("shown")), "warning", "duplicate-citationid", c("shown"))


def note_style(citations: DataFrame) -> DataFrame:
    return _findings(citations.groupBy("doc_id").agg(F.count_if(c("note_index") != 0).alias("n")), "note", "note-based-style")


def _cited(citations: DataFrame) -> DataFrame:
    return citations.groupBy("doc_id").agg(F.count("*").alias("cited"))


def missing_prefs(manuscripts: DataFrame, citations: DataFrame) -> DataFrame:
    return _findings(manuscripts.join(_cited(citations), "doc_id").where("not has_prefs").withColumn("n", F.lit(1)), "error", "missing-prefs")


def field_type(manuscripts: DataFrame, expected: str = "Field") -> DataFrame:
    return _findings(manuscripts.where(c("has_prefs") & (c("field_type") != "") & (c("field_type") != expected)).withColumn("n", F.lit(1)), "warning", "field-type", c("field_type"))


def missing_bibliography(manuscripts: DataFrame, citations: DataFrame) -> DataFrame:
    return _findings(manuscripts.join(_cited(citations), "doc_id").where("not has_bibliography").withColumn("n", F.lit(1)), "warning", "missing-bibliography")


def tracked_changes(revisions: DataFrame) -> DataFrame:
    found = revisions.groupBy("doc_id").agg(F.array_sort(F.collect_set("author")).alias("authors")).withColumn("n", F.size("authors"))
    return _findings(found, "note", "tracked-changes", F.array_join("authors", ", "))


def no_fields(manuscripts: DataFrame, citations: DataFrame) -> DataFrame:
    return _findings(manuscripts.join(citations, "doc_id", "left_anti").withColumn("n", F.lit(1)), "note", "no-fields")


def all_findings(items: DataFrame, citations: DataFrame, manuscripts: DataFrame, revisions: DataFrame) -> DataFrame:
    parts = [
        duplicate_surrogate(items), item_checks(items),
        citation_ids(citations), note_style(citations), missing_prefs(manuscripts, citations), field_type(manuscripts),
        missing_bibliography(manuscripts, citations), tracked_changes(revisions), no_fields(manuscripts, citations),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def level_rank(level: Column) -> Column:
    return F.when(level == "error", 0).when(level == "warning", 1).otherwise(2)


def status(findings: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """Per document: findings by level, whether it is clean (no error), and its exit status, plain and strict."""
    per = findings.groupBy("doc_id").agg(*(F.count_if(c("level") == x).alias(f"{x}s") for x in LEVELS))
    rows = manuscripts.select("doc_id").join(per, "doc_id", "left").na.fill(0, [f"{x}s" for x in LEVELS])
    return rows.select("doc_id", *(f"{x}s" for x in LEVELS), (c("errors") == 0).alias("clean"), F.when(c("errors") > 0, 1).otherwise(0).alias("status"), F.when(c("errors") + c("warnings") > 0, 1).otherwise(0).alias("strict_status"))


def ordered(findings: DataFrame) -> DataFrame:
    """Each document's findings in their order: level, code, detail."""
    w = Window.partitionBy("doc_id").orderBy(level_rank(c("level")), "code", "detail")
    return findings.withColumn("rank", F.row_number().over(w))


def citation_order(citations: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("cited_at", "citation_id")
    return citations.withColumn("ord", F.row_number().over(w) - 1)
