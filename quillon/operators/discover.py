"""Hand-typed citations of many manuscripts, linked to their reference lists.

Input: paragraphs (doc_id, para, text); paragraph numbers need not be dense. A list starts after its heading, or, without one,
where a window of 20 paragraphs looks like a list. All steps partition by document and paragraph; one window per document finds
the start, one by name and year links citations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

c = F.col


def measured(paragraphs: DataFrame, window: int = 20, least: int = 8, share: float = 0.75) -> DataFrame:
    """Trimmed paragraphs with their place `i` in the document, from 0, the place `heading` of its first heading and the list's start by it
    (`headed`) and by its shape (`shaped`). A shuffle by document; what a window holds is told by running counts, so a pattern is tried once.
    """
    doc = Window.partitionBy("doc_id")
    line = doc.orderBy("para")
    run = line.rowsBetween(Window.unboundedPreceding, 0)
    is_solid, is_entry = F.coalesce(c("text") != "", F.lit(False)), F.coalesce(c("text").rlike(C.ENTRY), F.lit(False))
    is_head = F.coalesce(c("text").rlike(C.HEADING) & (F.length("text") < 80), F.lit(False))
    rows = paragraphs.select("doc_id", "para", C.strip(c("text")).alias("text"))
    rows = rows.select("*", is_solid.cast("int").alias("is_solid"), is_entry.cast("int").alias("is_entry"), is_head.alias("is_head"))
    rows = rows.withColumns({"i": F.row_number().over(line) - 1, "solid_by": F.sum("is_solid").over(run), "entries_by": F.sum("is_entry").over(run)})
    end = lambda x: F.coalesce(F.lead(x, window - 1).over(line), F.max(x).over(doc))
    rows = rows.withColumns({
        "n": F.count("*").over(doc), "heading": F.min(F.when(c("is_head"), c("i"))).over(doc),
        "solid": end("solid_by") - c("solid_by") + c("is_solid"), "entries": end("entries_by") - c("entries_by") + c("is_entry"),
    })
    is_list = (c("i") < c("n") - 3) & (c("solid") >= least) & (c("entries") >= c("solid") * share)
    near = (c("i") > c("heading")) & (c("i") <= c("heading") + 4) & (c("is_solid") == 1)
    rows = rows.withColumns({"shaped": F.min(F.when(is_list, c("i"))).over(doc), "next": F.min(F.when(near, c("i"))).over(doc)})
    return rows.select("doc_id", "para", "text", "i", "heading", F.coalesce("next", c("heading") + 1).alias("headed"), "shaped")


def heading_start(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, start): the next non-blank of the four paragraphs after the first heading, else the one after it."""
    return measured(paragraphs).where("i = 0 and headed is not null").select("doc_id", c("headed").alias("start"))


def shape_start(paragraphs: DataFrame, window: int = 20, least: int = 8, share: float = 0.75) -> DataFrame:
    """(doc_id, start): the first of the paragraphs, but the last three, whose next 20 hold 8 non-blank ones, three quarters of them entries."""
    return measured(paragraphs, window, least, share).where("i = 0 and shaped is not null").select("doc_id", c("shaped").alias("start"))


def split(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with `in_list`: at or after their document's list start. A table that is split already is passed on."""
    if "in_list" in paragraphs.columns:
        return paragraphs
    rows = measured(paragraphs).select("doc_id", "para", "text", "i", F.coalesce("headed", "shaped").alias("start"))
    return rows.withColumn("in_list", F.coalesce(c("i") >= c("start"), F.lit(False)))


def references(paragraphs: DataFrame) -> DataFrame:
    """Parsed entries of the lists: (doc_id, entry_pos, body, surname, year, doi, url, isbn)."""
    rows = split(paragraphs).where(c("in_list") & (c("text") != "")).withColumn("body", C.entry_body(c("text")))
    w = Window.partitionBy("doc_id").orderBy("i")
    b = c("body")
    return rows.select(
        "doc_id", (F.row_number().over(w) - 1).alias("entry_pos"), "body", C.entry_surname(b).alias("surname"), C.citation_year(b).alias("year"),
        C.entry_doi(b).alias("doi"), C.entry_url(b).alias("url"), C.entry_isbn(b).alias("isbn"),
    )


def candidates(paragraphs: DataFrame) -> DataFrame:
    """Parenthetical groups that may be citations, of any length: (doc_id, para, cand, inside, atoms), in order. A year and a word may stand in different parts of a group, which then has no atom."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(C.PAREN), F.lit(1)))
    rows = split(paragraphs).where(~c("in_list")).select("doc_id", "para", found.alias("cand", "inside"))
    return rows.where(C.has_word(c("inside"))).withColumn("atoms", C.atoms(c("inside")))


def atoms(paragraphs: DataFrame) -> DataFrame:
    """Single citations: (doc_id, para, cand, atom_pos, atom, surname_key, year)."""
    rows = candidates(paragraphs).select("doc_id", "para", "cand", F.posexplode("atoms").alias("atom_pos", "atom"))
    # An array's one element, so that the key is worked out once for both of its parts.
    return rows.select("doc_id", "para", "cand", "atom_pos", "atom", F.inline(F.array(C.citation_key(c("atom")))))


def first_references(refs: DataFrame) -> DataFrame:
    """The earliest entry of each (surname, year) of a document."""
    rows = refs.where("surname is not null and year is not null").withColumn("surname_key", C.fold_compact(c("surname")))
    best = F.min(F.struct("entry_pos", "doi", "url", "isbn")).alias("r")
    return rows.groupBy("doc_id", "surname_key", "year").agg(best).select("doc_id", "surname_key", "year", "r.*")


def pieces(paragraphs: DataFrame) -> DataFrame:
    """Atoms, with the entry that they match, and list entries, of all documents, and each document's first paragraph: (doc_id, para, cand,
    atom_pos, atom, surname_key, year, entry_pos, kind, identifier) of atoms, and the `place` and best identifier (`own`) of entries.

    All is read in one pass over the rows of the one shuffle by document: entries and atoms of a name and year meet in a window, not in a join.
    """
    # By paragraph, as in `measured`, so that no row is sorted again.
    line = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    rows = split(paragraphs).withColumn("is_entry", F.coalesce(c("in_list") & (c("text") != ""), F.lit(False)))
    rows = rows.withColumn("place", F.when(c("is_entry"), F.sum(c("is_entry").cast("int")).over(line) - 1).cast("int"))
    groups = F.when(~c("in_list"), F.regexp_extract_all("text", F.lit(C.PAREN), F.lit(1)))
    rows = rows.select("doc_id", "para", "i", "place", F.when(c("is_entry"), C.entry_body(c("text"))).alias("body"), groups.alias("groups"))
    b = c("body")
    rows = rows.select("doc_id", "para", "i", "place", "groups", C.entry_surname(b).alias("surname"), C.citation_year(b).alias("entry_year"), C.entry_doi(b).alias("doi"), C.entry_isbn(b).alias("isbn"), C.entry_url(b).alias("url"))
    key = F.when(c("surname").isNotNull(), F.struct(C.fold_compact(c("surname")).alias("surname_key"), c("entry_year").alias("year")))
    own = C.best_identifier(c("doi"), c("isbn"), c("url"))
    rows = rows.select("doc_id", "para", "i", "place", own.alias("own"), key.alias("entry_key"), F.posexplode_outer("groups").alias("cand", "inside"))
    rows = rows.select("doc_id", "para", "i", "place", "own", "entry_key", "cand", F.posexplode_outer(F.when(C.has_word(c("inside")), C.atoms(c("inside")))).alias("atom_pos", "atom"))
    rows = rows.where("place is not null or atom is not null or i = 0")
    # An array's one element, so that the key is worked out once for both of its parts.
    key = F.when(c("place").isNotNull(), c("entry_key")).otherwise(C.citation_key(c("atom")))
    rows = rows.select("doc_id", "para", "cand", "atom_pos", "atom", "place", "own", F.inline(F.array(key)))
    usable = c("place").isNotNull() & c("doc_id").isNotNull() & c("surname_key").isNotNull() & c("year").isNotNull()
    first = F.min(F.when(usable, F.struct("place", "own"))).over(Window.partitionBy("doc_id", "surname_key", "year"))
    rows = rows.withColumn("first", F.when(c("atom").isNotNull(), first))
    return rows.select(
        "doc_id", "para", "cand", "atom_pos", "atom", "surname_key", "year", c("first.place").alias("entry_pos"), c("first.own.kind").alias("kind"), c("first.own.identifier").alias("identifier"), "place", "own"
    )


def linked(paragraphs: DataFrame) -> DataFrame:
    """Atoms with the entry they match, if any, and its best identifier."""
    return pieces(paragraphs).where("atom is not null").select("doc_id", "surname_key", "year", "para", "cand", "atom_pos", "atom", "entry_pos", "kind", "identifier")


MEASURES = ["candidates", "grouped", "atoms", "distinct_atoms", "auto", "human", "unmatched_atoms", "entries", "entries_doi", "entries_isbn", "entries_url", "entries_none"]


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def summary(paragraphs: DataFrame, listed: bool = False) -> DataFrame:
    """Twelve measures per document with paragraphs; `listed`: and `found`, its atoms in order with what they were resolved to."""
    group = Window.partitionBy("doc_id", "para", "cand")
    is_atom, is_entry, kind = c("atom").isNotNull(), c("place").isNotNull(), c("own.kind")
    rows = pieces(paragraphs).withColumns({
        "first": is_atom & (F.row_number().over(group.orderBy(F.asc_nulls_last("atom_pos"))) == 1),
        "several": F.count("atom").over(group) > 1, "all_found": F.bool_and(F.when(is_atom, c("identifier").isNotNull())).over(group),
    })
    row = F.struct("para", "cand", "atom_pos", "atom", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("identifier", F.lit("")).alias("identifier"))
    found = [F.array_sort(F.collect_list(F.when(is_atom, row))).alias("found")] if listed else []
    docs = rows.groupBy("doc_id").agg(
        _count(c("first"), "candidates"), _count(c("first") & c("several"), "grouped"), _count(is_atom, "atoms"), F.size(F.collect_set(F.when(is_atom, C.fold_compact(c("atom"))))).cast("long").alias("distinct_atoms"),
        _count(c("first") & c("all_found"), "auto"), _count(c("first") & ~c("all_found"), "human"), _count(is_atom & c("entry_pos").isNull(), "unmatched_atoms"),
        _count(is_entry, "entries"), *(_count(kind == k, f"entries_{k}") for k in ("doi", "isbn", "url")), _count(is_entry & kind.isNull(), "entries_none"), *found,
    )
    # Paragraphs of no document are told together, as a document without a find.
    known = c("doc_id").isNotNull()
    listing = [F.when(known, c("found")).otherwise(F.slice("found", 1, 0)).alias("found")] if listed else []
    return docs.select("doc_id", *(F.when(known, c(m)).otherwise(F.lit(0).cast("long")).alias(m) for m in MEASURES), *listing)
