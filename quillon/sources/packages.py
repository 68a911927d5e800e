"""Word packages as tables: binary files to XML parts, parts to paragraphs, runs, field codes and citations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

c = F.col
# The parts of a package that are kept, the main one first.
PARTS = ("word/document.xml", "docProps/custom.xml", "word/footnotes.xml", "word/endnotes.xml", "word/comments.xml")
ITEM, BIBLIOGRAPHY = "ADDIN ZOTERO_ITEM CSL_CITATION ", "ADDIN ZOTERO_BIBL "


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, xml, error) of every package under a path; see `unpack`. Spark doesn't list files without a byte."""
    return unpack(spark.read.format("binaryFile").load(path).select(c("path").alias("doc_id"), "content"))


PIECE = 32  # packages that a worker holds unpacked at once


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows: what is made of one goes before the next is begun."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows: list[tuple] = []
        for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    names = set(z.namelist())
                    if PARTS[0] not in names:
                        rows.append((doc, None, None, "no main part"))
                    else:
                        rows += [(doc, p, z.read(p).decode("utf-8", "replace"), None) for p in PARTS if p in names]
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, ValueError) as e:
                rows.append((doc, None, None, f"unreadable: {type(e).__name__}"))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *(pa.array(x, pa.string()) for x in cols[1:])], ["doc_id", "part", "xml", "error"])


def unpack(packages: DataFrame) -> DataFrame:
    """Packages (doc_id, content) to parts; a file that is no package, or has no main part, is one row with an error."""
    kind = dict(packages.dtypes)["doc_id"]
    return packages.select("doc_id", "content").mapInArrow(_unzip, f"doc_id {kind}, part string, xml string, error string")


QUARANTINE = "quarantine"


def take_in(packages: DataFrame, path: str) -> None:
    """Packages (doc_id, content) to a table of parts with a folder for each, and one for files that can't be read: one scan, one write.

    What is written is read by `stored`, which goes to the folders of the parts that are asked for.
    """
    rows = unpack(packages).withColumn("part", F.when(c("error").isNull(), c("part")).otherwise(QUARANTINE))
    rows.write.partitionBy("part").option("compression", "zstd").parquet(path)


def stored(spark: SparkSession, path: str, key: str = "string") -> DataFrame:
    """(doc_id, xml, error, part) of a table that `take_in` wrote; `key` is the type of doc_id."""
    return spark.read.schema(f"doc_id {key}, xml string, error string, part string").parquet(path)


def paragraphs(parts: DataFrame) -> DataFrame:
    """(doc_id, para, xml, text, authors, has_anchor) of the main part; text leaves field codes out."""
    found = F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)(<w:p(?:\s[^>]*)?>.*?</w:p>)"), F.lit(1)))
    rows = parts.where(c("part") == PARTS[0]).select("doc_id", found.alias("para", "xml"))
    visible = C.visible_text(F.regexp_replace("xml", r"(?s)<w:instrText(?:\s[^>]*)?>.*?</w:instrText>", ""))
    changed = F.array_join(F.regexp_extract_all("xml", F.lit(r"(?s)(<w:(?:ins|del)\s[^>]*>.*?</w:(?:ins|del)>)"), F.lit(1)), "")
    authors = F.array_sort(F.array_distinct(F.regexp_extract_all(changed, F.lit('w:author="([^"]*)"'), F.lit(1))))
    return rows.select("doc_id", "para", "xml", visible.alias("text"), authors.alias("authors"), c("xml").rlike(r"<w:commentR(?:eference|angeStart|angeEnd)\b").alias("has_anchor"))


RUN = r"(?s)(<w:r(?:\s[^>]*)?>.*?</w:r>)"
ANCHOR = r"(<w:commentR(?:eference|angeStart|angeEnd)\b[^>]*/?>)"


def _spans(xml: Column, pattern: str) -> Column:
    """Matches of a pattern in order: what each is, and how many characters lie between it and the one before."""
    found = F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))
    return F.arrays_zip(found.alias("xml"), F.transform(F.slice(F.split(xml, pattern), F.lit(1), F.size(found)), lambda x: F.length(x)).alias("gap"))


def laid_out(paras: DataFrame) -> DataFrame:
    """(doc_id, para, text, runs, anchors): a paragraph's runs (text, gap, length) and comment anchors (gap, length), where gap is the
    distance in the paragraph's XML from the one before; text is that of the runs end to end, in which markers are looked for.
    """
    runs = F.transform(_spans(c("xml"), RUN), lambda x: F.struct(C.visible_text(x["xml"]).alias("text"), x["gap"].alias("gap"), F.length(x["xml"]).alias("length")))
    none = F.array().cast("array<struct<gap:int,length:int>>")
    anchors = F.when(c("has_anchor"), F.transform(_spans(c("xml"), ANCHOR), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["xml"]).alias("length")))).otherwise(none)
    rows = paras.select("doc_id", "para", runs.alias("runs"), anchors.alias("anchors"))
    return rows.select("doc_id", "para", F.array_join(c("runs.text"), "").alias("text"), "runs", "anchors")


def _running(x: Column, order: str) -> Column:
    """A running sum over a paragraph's pieces: linear in their number, whatever a paragraph holds."""
    return F.sum(x).over(Window.partitionBy("doc_id", "para").orderBy(order)).cast("int")


def run_places(laid: DataFrame) -> DataFrame:
    """(doc_id, para, run, text, text_start, text_end, xml_start, xml_end): runs with their places in the paragraph's text and XML."""
    rows = laid.select("doc_id", "para", F.posexplode("runs").alias("run", "x"))
    rows = rows.select("doc_id", "para", "run", "x.text", c("x.length").alias("length"), _running(F.length("x.text"), "run").alias("text_end"), _running(c("x.gap") + c("x.length"), "run").alias("xml_end"))
    return rows.select("doc_id", "para", "run", "text", (c("text_end") - F.length("text")).alias("text_start"), "text_end", (c("xml_end") - c("length")).alias("xml_start"), "xml_end")


def anchor_places(laid: DataFrame) -> DataFrame:
    """(doc_id, para, anchor, place): where each comment anchor begins in the paragraph's XML, inside a run or between two."""
    rows = laid.select("doc_id", "para", F.posexplode("anchors").alias("anchor", "x"))
    return rows.select("doc_id", "para", "anchor", (_running(c("x.gap") + c("x.length"), "anchor") - c("x.length")).alias("place"))


def runs(laid: DataFrame) -> DataFrame:
    """The rows of `run_places` with `before` and `upto`: how many comment anchors of the paragraph begin before the run, and before its end.

    Runs' ends and anchors are points of one order, summed up in one pass; runs of paragraphs without anchors don't take part.
    """
    key = ["doc_id", "para"]
    rows = run_places(laid)
    marked = laid.where(F.size("anchors") > 0)
    apart = run_places(marked)
    point = lambda df, place, run, side: df.select(*key, c(place).alias("place"), run.alias("run"), F.lit(side).alias("side"))
    # At one place the run's bound comes first: an anchor there is behind it.
    points = point(apart, "xml_start", c("run"), 0).union(point(apart, "xml_end", c("run"), 1)).union(point(anchor_places(marked), "place", F.lit(None).cast("int"), 2))
    seen = F.sum((c("side") == 2).cast("int")).over(Window.partitionBy(*key).orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0))
    bounds = points.withColumn("seen", seen).where("run is not null").groupBy(*key, "run").agg(F.max(F.when(c("side") == 0, c("seen"))).alias("before"), F.max(F.when(c("side") == 1, c("seen"))).alias("upto"))
    return rows.join(bounds, [*key, "run"], "left").na.fill(0, ["before", "upto"])


def field_codes(parts: DataFrame) -> DataFrame:
    return parts.where(c("part") == PARTS[0]).select("doc_id", C.instructions(c("xml")).alias("codes"))


def citations(parts: DataFrame) -> DataFrame:
    """(doc_id, ord, citation_id, formatted, note_index, items, schema): fields whose JSON can't be read are left out and take no number.

    Items stay as they are written, variants whose members keep their types.
    """
    pieces = F.slice(F.split("codes", ITEM), 2, 1 << 30)
    read = F.filter(F.transform(pieces, lambda b: F.try_parse_json(b)), lambda j: F.coalesce(F.schema_of_variant(j).startswith("OBJECT<"), F.lit(False)))
    rows = field_codes(parts).select("doc_id", F.posexplode(read).alias("ord", "j"))
    get = lambda path, kind="string": F.try_variant_get("j", path, kind)
    items = F.coalesce(get("$.citationItems", "array<variant>"), F.array().cast("array<variant>"))
    return rows.select(
        "doc_id", "ord", get("$.citationID").alias("citation_id"), F.coalesce(get("$.properties.formattedCitation"), F.lit("")).alias("formatted"),
        F.coalesce(get("$.properties.noteIndex", "int"), F.lit(0)).alias("note_index"), items.alias("items"), get("$.schema").alias("schema"),
    )


def citation_items(cits: DataFrame) -> DataFrame:
    """(doc_id, ord, pos, uris, item_data): the items of each citation; a citation without any has one row of nulls."""
    rows = cits.select("doc_id", "ord", F.posexplode_outer("items").alias("pos", "item"))
    uris = F.coalesce(F.try_variant_get("item", "$.uris", "array<string>"), F.array().cast("array<string>"))
    return rows.select("doc_id", "ord", "pos", F.when(c("item").isNotNull(), uris).alias("uris"), F.try_variant_get("item", "$.itemData", "variant").alias("item_data"))


def cited(items: DataFrame) -> DataFrame:
    """Citation items as the audit reads them: (doc_id, citation_id, cited_at, pos, uris, doi, title, year, first_author)."""
    get = lambda path: F.try_variant_get("item_data", path, "string")
    return items.where("pos is not null").select(
        "doc_id", c("ord").alias("citation_id"), c("ord").alias("cited_at"), "pos", "uris", C.null_if_empty(C.strip(get("$.DOI"))).alias("doi"), C.strip(F.coalesce(get("$.title"), F.lit(""))).alias("title"),
        C.csl_year(c("item_data")).alias("year"), C.csl_first_author(c("item_data")).alias("first_author"),
    )


def _chunks(xml: Column) -> Column:
    """Preference chunks (n, v) in the order of their numbers, unescaped."""
    chunk = r'(?s)name="ZOTERO_PREF_(\d+)"><vt:lpwstr>(.*?)</vt:lpwstr>'
    pairs = F.arrays_zip(F.regexp_extract_all(xml, F.lit(chunk), F.lit(1)).alias("n"), F.regexp_extract_all(xml, F.lit(chunk), F.lit(2)).alias("v"))
    return F.array_sort(F.transform(pairs, lambda p: F.struct(p["n"].cast("int").alias("n"), C.entity_unescape(p["v"]).alias("v"))))


def prefs(parts: DataFrame) -> DataFrame:
    """(doc_id, style, locale, field_type, chunks): preference chunks put together in the order of their numbers.

    Null for what they don't say, and for all three where together they are no well-formed XML; `chunks` is how many there are.
    """
    rows = parts.where(c("part") == PARTS[1]).select("doc_id", _chunks(c("xml")).alias("held"))
    text = F.array_join(F.transform("held", lambda p: p["v"]), "")
    whole = text.rlike(r"^\s*<data\b[^<>]*>(?:[^<>]++|<[^<>]++>)*</data>\s*$")
    said = lambda pattern: F.when(whole, C.extract(text, pattern))
    return rows.where(F.size("held") > 0).select(
        "doc_id", said(r'<style\s[^<>]*?\bid="([^"]*)"').alias("style"), said(r'<style\s[^<>]*?\blocale="([^"]*)"').alias("locale"),
        said(r'<pref name="fieldType" value="([^"]*)"').alias("field_type"), F.size("held").alias("chunks"),
    )


def counts(parts: DataFrame) -> DataFrame:
    """Eight counters per document."""
    main = paragraphs(parts).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), (F.sum(F.length("text")) + F.count("*") - 1).alias("characters"))
    n = lambda p, pattern: F.coalesce(F.max(F.when(c("part") == p, F.regexp_count("xml", F.lit(pattern)))), F.lit(0)).cast("long")
    codes = C.instructions(c("xml"))
    per = parts.where("part is not null").groupBy("doc_id").agg(
        F.max(F.when(c("part") == PARTS[0], F.regexp_count(codes, F.lit("ADDIN ZOTERO_ITEM")))).cast("long").alias("citation_fields"),
        F.max(F.when(c("part") == PARTS[0], F.regexp_count(codes, F.lit("ADDIN ZOTERO_BIBL")))).cast("long").alias("bibliography_fields"),
        n(PARTS[0], r"(?s)<w:ins\s[^>]*>.*?</w:ins>").alias("insertions"), n(PARTS[0], r"(?s)<w:del\s[^>]*>.*?</w:del>").alias("deletions"),
        n(PARTS[4], "<w:comment ").alias("comments"), n(PARTS[2], "<w:footnote ").alias("footnotes"),
    )
    return per.join(main, "doc_id", "left").na.fill(0)


def invariants(parts: DataFrame) -> DataFrame:
    """Whether a document's fields are whole: as many begins as separators and ends, ids unique and 8 long, addresses, data and schema present, preference chunks of 255 characters at most."""
    n = lambda kind: F.regexp_count("xml", F.lit(f'w:fldCharType="{kind}"'))
    marks = parts.where(c("part") == PARTS[0]).select("doc_id", ((n("begin") == n("separate")) & (n("begin") == n("end"))).alias("balanced"))
    whole = F.forall("items", lambda i: (F.coalesce(F.size(F.try_variant_get(i, "$.uris", "array<string>")), F.lit(0)) > 0) & (F.coalesce(F.size(F.try_variant_get(i, "$.itemData", "map<string,variant>")), F.lit(0)) > 0))
    per = citations(parts).groupBy("doc_id").agg(
        (F.count("citation_id") == F.count_distinct("citation_id")).alias("unique_ids"), F.bool_and(F.length("citation_id") == 8).alias("ids_8_long"), F.bool_and(c("note_index") == 0).alias("no_notes"),
        F.bool_and(whole).alias("whole_items"), F.bool_and(c("schema").isNotNull()).alias("has_schema"),
    )
    short = parts.where(c("part") == PARTS[1]).select("doc_id", F.forall(_chunks(c("xml")), lambda p: F.length(p["v"]) <= 255).alias("short_prefs"))
    return marks.join(per, "doc_id", "left").join(short, "doc_id", "left").na.fill(True)
