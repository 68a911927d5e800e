"""Queries of packages and markers.

The packages are built by Spark from `documents`: a paragraph per line, a run per sentence; then, in documents told by their number,
paragraphs with citation fields (one split over runs, one that can't be read, one grouped), a bibliography, tracked changes, a
marker over a comment's anchor, and text outside any run. `EXTRA` says the same for the SQL.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import placement as P
from ..registry import query
from ..sources import packages as K
from ..sources.shelf import Shelf
from ..sources.views import Tables

c = F.col
MARKERS = ("Licensed", "the ", "der ", "[@none]", r"[\E]")


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.pieces(batches):
        out = []
        for doc, main, custom in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                if doc % 50 != 7:
                    z.writestr(K.PARTS[0], main)
                z.writestr(K.PARTS[1], custom)
            out.append(b"no package" if doc % 50 == 9 else held.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])


def xml(t: Tables) -> DataFrame:
    """(doc_id, main, custom, comments, footnotes): the parts' XML; the last two are null where there are none."""
    d, none = c("doc_id"), F.lit(None).cast("string")
    when = lambda n, x: F.when(d % n == 0, x)
    swap = lambda x, *pairs: swap(F.replace(x, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else x
    esc = lambda x: swap(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&#233;"), ("ä", "&#xE4;"), ("ß", "&szlig;"))
    run = lambda x: F.concat(F.lit('<w:r><w:t xml:space="preserve">'), x, F.lit("</w:t></w:r>"))
    para = lambda *xs: F.concat(F.lit("<w:p>"), *(F.lit(x) if isinstance(x, str) else x for x in xs), F.lit("</w:p>"))
    mark = lambda kind: F.lit(f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>')
    instr = lambda x: F.concat(F.lit("<w:r><w:instrText>"), x, F.lit("</w:instrText></w:r>"))
    field = lambda codes, shown, end=None: para(mark("begin"), *(instr(x) for x in codes), mark("separate"), run(F.lit(shown)), end if end is not None else mark("end"))
    key = F.lpad(d.cast("string"), 8, "0")
    # Two URIs in either order; the year as text or number, in a nested date; a body with a literal name behind an author without one.
    item = lambda uris, title, more="": F.concat(F.lit('{"uris":['), uris, F.lit(f'],"itemData":{{"title":"{title}"'), F.lit(more) if isinstance(more, str) else more, F.lit("}}"))
    year = F.when(d % 2 == 0, F.concat(F.lit('"'), (d % 60 + 1960).cast("string"), F.lit('"'))).otherwise((d % 60 + 1960).cast("string"))
    csl = F.concat(F.lit(',"issued":{"date-parts":[['), year, F.lit(',6]]},"author":[{"family":""},{"'), F.when(d % 4 == 0, "literal").otherwise("family"), F.lit('":" Body '), d.cast("string"), F.lit(' "}]'))
    uri = lambda k: F.concat(F.lit('"http://zotero.org/groups/1/items/'), k, F.lit('"'))
    citation = lambda name, note, items, schema: F.concat(F.lit('{"citationID":"'), name, F.lit('","properties":{"formattedCitation":"(Body, '), name, F.lit(')","noteIndex":'), note, F.lit('},"citationItems":['), items, F.lit("]"), schema, F.lit("}"))
    single = citation(key, F.lit("0"), item(F.concat(uri(key), F.lit(","), uri(F.reverse(key))), "A &amp; B", csl), F.when(d % 33 == 0, "").otherwise(',"schema":"csl"'))
    name = when(18, key).otherwise(when(42, F.concat(key, F.lit("9"))).otherwise(F.concat(F.lit("G"), F.substring(key, 2, 7))))
    second = item(F.when(d % 24 == 0, "").otherwise(uri(F.reverse(key))), "C")
    grouped = citation(name, (d % 4).cast("string"), F.concat(item(F.when(d % 12 == 0, uri(key)).otherwise(F.concat(uri(F.reverse(key)), F.lit(","), uri(key))), "A &amp; B", csl), F.lit(","), second), F.lit(',"schema":"csl"'))
    # A marker over two runs: an anchor between them, in a run of its own there, behind a bookmark, behind a run without text, around
    # both, in the first of them, and none.
    two = lambda between, before="", after="", first="": para(f"{before}<w:r>{first}<w:t>[@no</w:t></w:r>{between}<w:r><w:t>ne]</w:t></w:r>{after}")
    reference = '<w:commentReference w:id="1"/>'
    cases = [
        two('<w:commentRangeEnd w:id="1"/>'), two(f"<w:r>{reference}</w:r>"), two('<w:bookmarkStart w:id="3" w:name="b"/><w:commentRangeEnd w:id="1"/>'), two('<w:r><w:rPr/></w:r><w:commentRangeStart w:id="1"/>'),
        two("", '<w:commentRangeStart w:id="1"/>', '<w:commentRangeEnd w:id="1"/>'), two("", first=reference), two(""),
    ]
    anchored = F.get(F.array(*cases), (d % 7).cast("int"))
    extra = [
        when(3, field([F.lit("ADDIN ZOTERO_ITEM CSL_"), F.concat(F.lit("CITATION "), single)], "(1)", F.when(d % 30 == 0, "").otherwise(mark("end")))),
        when(12, field([F.lit("ADDIN ZOTERO_ITEM CSL_CITATION {broken")], "(2)")), when(6, field([F.concat(F.lit("ADDIN ZOTERO_ITEM CSL_CITATION "), grouped)], "(3)")),
        when(9, field([F.lit('ADDIN ZOTERO_BIBL {"uncited":[]} CSL_BIBLIOGRAPHY')], "(list)")),
        when(5, para('<w:ins w:id="1" w:author="A"><w:r><w:t>added</w:t></w:r></w:ins><w:del w:id="2" w:author="B"><w:r><w:delText>gone</w:delText></w:r></w:del>')),
        anchored, when(8, para("<w:t>der </w:t>")), F.when(d % 4 == 1, para(run(F.lit(r"[\E] and [\E]")))),
    ]
    lines = F.transform(F.split("text", "\n"), lambda line: para(F.array_join(F.transform(F.split(line, r"(?<=\. )"), lambda x: run(esc(x))), "")))
    main = F.concat(F.lit("<w:document><w:body>"), F.array_join(lines, ""), *(F.coalesce(x, F.lit("")) for x in extra), F.lit("</w:body></w:document>"))
    chunk = lambda n, *vs: F.concat(F.lit(f'<property name="ZOTERO_PREF_{n}"><vt:lpwstr>'), *(F.lit(v) if isinstance(v, str) else v for v in vs), F.lit("</vt:lpwstr></property>"))
    kind, pad = F.when(d % 7 == 0, "Bookmarks").otherwise("Field"), F.when(d % 13 == 0, " " * 300).otherwise("")
    # Some documents have no style, some preferences are cut off.
    style = F.when(d % 11 == 0, "&lt;data&gt;&lt;nothing id=&quot;").otherwise("&lt;data&gt;&lt;style locale=&quot;fr-FR&quot; id=&quot;http://www.zotero.org/styles/")
    tail = ("&quot;/&gt;", pad, "&lt;prefs&gt;&lt;pref name=&quot;fieldType&quot; value=&quot;", kind, "&quot;/&gt;&lt;/prefs&gt;", F.when(d % 17 == 0, "").otherwise("&lt;/data&gt;"))
    three = F.concat(chunk(3, *tail), chunk(1, style), chunk(2, c("lang")))
    custom = F.concat(F.lit("<Properties>"), when(4, three).otherwise(F.concat(chunk(2, *tail), chunk(1, style, c("lang")))), F.lit("</Properties>"))
    return t("documents").select("doc_id", main.alias("main"), custom.alias("custom"), when(7, '<w:comment w:id="1"/><w:comment w:id="2"/>').otherwise(none).alias("comments"), when(11, '<w:footnote w:id="1"/>' * 3).otherwise(none).alias("footnotes"))


def parts(t: Tables) -> DataFrame:
    held = {K.PARTS[0]: "main", K.PARTS[1]: "custom", K.PARTS[2]: "footnotes", K.PARTS[4]: "comments"}
    every = F.filter(F.array(*(F.struct(F.lit(part).alias("part"), c(name).alias("xml")) for part, name in held.items())), lambda p: p["xml"].isNotNull())
    return xml(t).select("doc_id", F.explode(every).alias("p")).select("doc_id", "p.part", "p.xml", F.lit(None).cast("string").alias("error"))


def paras(t: Tables) -> DataFrame:
    return K.paragraphs(parts(t))


def laid(t: Tables) -> DataFrame:
    """Paragraphs with their runs and anchors, written once: markers and runs are both read from them."""
    return Shelf(t.spark, "paragraphs").put(K.laid_out(paras(t)), "laid")


EXTRA = """list_filter([case when doc_id % 3 = 0 then {'t': '(1)', 'r': case when doc_id % 30 = 0 then ['', '', '', '', '(1)'] else ['', '', '', '', '(1)', ''] end} end,
  case when doc_id % 12 = 0 then {'t': '(2)', 'r': ['', '', '', '(2)', '']} end, case when doc_id % 6 = 0 then {'t': '(3)', 'r': ['', '', '', '(3)', '']} end, case when doc_id % 9 = 0 then {'t': '(list)', 'r': ['', '', '', '(list)', '']} end,
  case when doc_id % 5 = 0 then {'t': 'added', 'r': ['added', '']} end, {'t': '[@none]', 'r': case when doc_id % 7 in (1, 3) then ['[@no', '', 'ne]'] else ['[@no', 'ne]'] end},
  case when doc_id % 8 = 0 then {'t': 'der ', 'r': []::varchar[]} end, case when doc_id % 4 = 1 then {'t': '[\\E] and [\\E]', 'r': ['[\\E] and [\\E]']} end], lambda x: x is not null)"""
BODY = "select doc_id, list_concat(list_transform(string_split(text, chr(10)), lambda x: {'t': x, 'r': case when x = '' then [''] else string_split(replace(x, '. ', '. ' || chr(1)), chr(1)) end}), " + EXTRA + ") as l from {documents}"
LINES = "select doc_id, para, p.t as text, p.r as r from (select doc_id, unnest(range(len(l))) as para, unnest(l) as p from (" + BODY + ") s) s1"
RUNS = "select doc_id, para, unnest(range(len(r))) as run, unnest(r) as text, r from (" + LINES + ") a"


@query("src_parts", "select doc_id, case when doc_id % 50 = 7 then 'no main part' when doc_id % 50 = 9 then 'unreadable: BadZipFile' end as error, case when doc_id % 50 not in (7, 9) then 2 else 0 end as parts from {documents}")
def src_parts(t: Tables) -> DataFrame:
    packed = xml(t).select("doc_id", "main", "custom").mapInArrow(_zip, "doc_id long, content binary")
    return K.unpack(packed).groupBy("doc_id").agg(F.max("error").alias("error"), F.count("part").alias("parts"))


@query("src_parts_stored", """select doc_id, case when doc_id % 50 = 7 then 'no main part' when doc_id % 50 = 9 then 'unreadable: BadZipFile' else md5(lang) end as found from {documents}""")
def src_parts_stored(t: Tables) -> DataFrame:
    """Packages as files' contents, unpacked once into parts and a quarantine; then the hash of a language from one part, and what was set aside."""
    shelf = Shelf(t.spark, "packages")
    content = shelf.put(xml(t).join(t("documents").select("doc_id", "lang"), "doc_id").select("doc_id", "main", F.concat(F.lit("<lang>"), F.md5(F.encode("lang", "UTF-8")), F.lit("</lang>")).alias("custom")).mapInArrow(_zip, "doc_id long, content binary"), "content")
    K.take_in(content, f"{shelf.root}/parts")
    rows = K.stored(t.spark, f"{shelf.root}/parts", "long")
    custom = rows.where(c("part") == K.PARTS[1]).select("doc_id", F.regexp_extract("xml", "<lang>(.*)</lang>", 1).alias("found"))
    return custom.union(rows.where(c("part") == K.QUARANTINE).select("doc_id", c("error").alias("found")))


@query("gen_paragraphs", f"select doc_id, para, md5(text) as text_md5 from ({LINES}) l")
def gen_paragraphs(t: Tables) -> DataFrame:
    return paras(t).select("doc_id", "para", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


URI = "'\"http://zotero.org/groups/1/items/' || {} || '\"'"
TAIL = "']' || case when doc_id % 33 = 0 then '' else ',\"schema\":\"csl\"' end || '}'"
NAME = "case when doc_id % 18 = 0 then k when doc_id % 42 = 0 then k || '9' else 'G' || substr(k, 2, 7) end"
CSL = """',"issued":{"date-parts":[[' || case when doc_id % 2 = 0 then '"' || (doc_id % 60 + 1960) || '"' else (doc_id % 60 + 1960)::varchar end || ',6]]},"author":[{"family":""},{"' || case when doc_id % 4 = 0 then 'literal' else 'family' end || '":" Body ' || doc_id || ' "}]'"""
ONE = lambda uris: f"""'{{"uris":[' || {uris} || '],"itemData":{{"title":"A & B"' || {CSL} || '}}}}'"""
BOTH, SWAPPED = f"{URI.format('k')} || ',' || {URI.format('reverse(k)')}", f"{URI.format('reverse(k)')} || ',' || {URI.format('k')}"
SECOND = f"""'{{"uris":[' || case when doc_id % 24 = 0 then '' else {URI.format('reverse(k)')} end || '],"itemData":{{"title":"C"}}}}'"""
KEYED = "(select doc_id, lpad(doc_id::varchar, 8, '0') as k from {documents})"
HEAD = lambda name, note: f"""'ADDIN ZOTERO_ITEM CSL_CITATION {{"citationID":"' || {name} || '","properties":{{"formattedCitation":"(Body, ' || {name} || ')","noteIndex":' || {note} || '}},"citationItems":['"""
CODES = f"""select doc_id, case when doc_id % 3 = 0 then {HEAD('k', '0')} || {ONE(BOTH)} || {TAIL} else '' end
  || case when doc_id % 12 = 0 then 'ADDIN ZOTERO_ITEM CSL_CITATION {{broken' else '' end
  || case when doc_id % 6 = 0 then {HEAD(NAME, 'doc_id % 4')} || {ONE(f"case when doc_id % 12 = 0 then {URI.format('k')} else {SWAPPED} end")} || ',' || {SECOND} || '],"schema":"csl"}}' else '' end
  || case when doc_id % 9 = 0 then 'ADDIN ZOTERO_BIBL {{"uncited":[]}} CSL_BIBLIOGRAPHY' else '' end as codes from {KEYED} d"""


@query("gen_field_codes", f"select doc_id, length(codes) as n, sha256(codes) as codes_sha256 from ({CODES}) c")
def gen_field_codes(t: Tables) -> DataFrame:
    return K.field_codes(parts(t)).select("doc_id", F.length("codes").cast("long").alias("n"), F.sha2("codes", 256).alias("codes_sha256"))


@query("gen_field_codes_whole", CODES)
def gen_field_codes_whole(t: Tables) -> DataFrame:
    """The instruction text itself, where gen_field_codes has its hash."""
    return K.field_codes(parts(t))


@query("gen_citations", f"select doc_id, 0 as ord, k as citation_id, '(Body, ' || k || ')' as formatted, 0 as note_index from {KEYED} d where doc_id % 3 = 0 union all select doc_id, 1, {NAME}, '(Body, ' || {NAME} || ')', (doc_id % 4)::int from {KEYED} d where doc_id % 6 = 0")
def gen_citations(t: Tables) -> DataFrame:
    return K.citations(parts(t)).drop("items", "schema")


_AT = "'http://zotero.org/groups/1/items/' || "
_CITED = f"""select doc_id, 0 as ord, 0 as pos, [{_AT} k, {_AT} reverse(k)] as uris, 'A & B' as title, (doc_id % 60 + 1960)::varchar as year, 'Body ' || doc_id as first_author from {KEYED} d where doc_id % 3 = 0
  union all select doc_id, 1, 0, case when doc_id % 12 = 0 then [{_AT} k] else [{_AT} reverse(k), {_AT} k] end, 'A & B', (doc_id % 60 + 1960)::varchar, 'Body ' || doc_id from {KEYED} d where doc_id % 6 = 0
  union all select doc_id, 1, 1, case when doc_id % 24 <> 0 then [{_AT} reverse(k)] else [] end, 'C', null, null from {KEYED} d where doc_id % 6 = 0"""


@query("gen_citation_items", f"select doc_id, ord, pos, array_to_string(uris, ' ') as uris, title, year, first_author from ({_CITED}) x")
def gen_citation_items(t: Tables) -> DataFrame:
    """Items with their addresses, and what is read from the record that each holds: nested dates and names keep their types."""
    rows = K.cited(K.citation_items(K.citations(parts(t))))
    return rows.select("doc_id", c("citation_id").alias("ord"), "pos", F.array_join("uris", " ").alias("uris"), "title", "year", "first_author")


@query("chk_surrogate_lists", f"""select doc_id, 'error' as level, 'duplicate-surrogate' as code, count(distinct u) as n, any_value(first_author) || ' ' || any_value(year) || ': ' || any_value(title) || ' | ' || string_agg(distinct u, ' ' order by u) as detail
  from (select *, coalesce(nullif(array_to_string(list_sort(uris), '|'), ''), '<no uri>') as u from ({_CITED}) x) y where title <> 'C' group by doc_id having count(distinct u) > 1""")
def chk_surrogate_lists(t: Tables) -> DataFrame:
    """The duplicate check over the packages themselves: an address is the whole list of URIs, in whatever order it stands."""
    return A.duplicate_surrogate(K.cited(K.citation_items(K.citations(parts(t)))))


@query("prefs_reassemble", """select doc_id, case when doc_id % 11 <> 0 and doc_id % 17 <> 0 then 'http://www.zotero.org/styles/' || lang end as style, case when doc_id % 11 <> 0 and doc_id % 17 <> 0 then 'fr-FR' end as locale,
  case when doc_id % 17 <> 0 then case when doc_id % 7 = 0 then 'Bookmarks' else 'Field' end end as field_type, case when doc_id % 4 = 0 then 3 else 2 end as chunks from {documents}""")
def prefs_reassemble(t: Tables) -> DataFrame:
    return K.prefs(parts(t))


@query("doc_counts", f"""select doc_id, len(l)::bigint as paragraphs, (list_sum(list_transform(l, lambda p: length(p.t))) + len(l) - 1)::bigint as characters, (doc_id % 3 = 0)::bigint + (doc_id % 12 = 0)::bigint + (doc_id % 6 = 0)::bigint as citation_fields,
  (doc_id % 9 = 0)::bigint as bibliography_fields, (doc_id % 5 = 0)::bigint as insertions, (doc_id % 5 = 0)::bigint as deletions, 2 * (doc_id % 7 = 0)::bigint as comments, 3 * (doc_id % 11 = 0)::bigint as footnotes from ({BODY}) b""")
def doc_counts(t: Tables) -> DataFrame:
    return K.counts(parts(t))


@query("field_invariants", """select doc_id, doc_id % 30 <> 0 as balanced, doc_id % 18 <> 0 as unique_ids, not (doc_id % 42 = 0 and doc_id % 18 <> 0) as ids_8_long, not (doc_id % 6 = 0 and doc_id % 4 <> 0) as no_notes,
  doc_id % 24 <> 0 as whole_items, doc_id % 33 <> 0 as has_schema, doc_id % 13 <> 0 as short_prefs from {documents}""")
def field_invariants(t: Tables) -> DataFrame:
    return K.invariants(parts(t))


@query("gen_runs", f"select doc_id, para, run, md5(text) as text_md5, coalesce(list_sum(list_transform(r[1:run], lambda x: length(x))), 0)::bigint as text_start from ({RUNS}) q where text <> '' or run = 0")
def gen_runs(t: Tables) -> DataFrame:
    return K.run_places(K.laid_out(paras(t))).where("text <> '' or run = 0").select("doc_id", "para", "run", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), c("text_start").cast("long").alias("text_start"))


@query("win_run_offsets", f"select doc_id, para, sum(length(text))::bigint as chars, count(*) filter (text <> '') as runs from ({RUNS}) q group by doc_id, para")
def win_run_offsets(t: Tables) -> DataFrame:
    return K.run_places(K.laid_out(paras(t))).groupBy("doc_id", "para").agg(F.max("text_end").cast("long").alias("chars"), F.count_if(c("text") != "").alias("runs"))


def markers(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.explode(F.array(*(F.lit(m) for m in MARKERS))).alias("marker"))


M_SQL = "(values ('Licensed'), ('the '), ('der '), ('[@none]'), ('[\\E]')) m(marker)"
HITS = f"select doc_id, para, marker, hit, (list_sum(list_transform(p[1:hit + 1], lambda x: length(x))) + hit * length(marker))::bigint as start from (select doc_id, para, marker, p, unnest(range(len(p) - 1)) as hit from (select doc_id, para, marker, string_split(text, marker) as p from (select doc_id, para, array_to_string(r, '') as text from ({LINES}) l) l1, {M_SQL} where contains(text, marker)) a) b"


@query("gen_marker_hits", HITS)
def gen_marker_hits(t: Tables) -> DataFrame:
    return P.hits(markers(t), K.laid_out(paras(t))).select("doc_id", "para", "marker", "hit", c("start").cast("long").alias("start"))


OFFS = f"select doc_id, para, run, text = '[@no' and doc_id % 7 in (0, 1, 2, 3, 5) as anchored, coalesce(list_sum(list_transform(r[1:run], lambda x: length(x))), 0) as s, coalesce(list_sum(list_transform(r[1:run + 1], lambda x: length(x))), 0) as e from ({RUNS}) q where text <> ''"
OVER = f"from ({HITS}) h JOIN_ ({OFFS}) o on o.doc_id = h.doc_id and o.para = h.para and o.s < h.start + length(h.marker) and o.e > h.start"


@query("range_marker_runs", f"select h.doc_id, h.para, h.marker, h.hit, o.run {OVER.replace("JOIN_", "join")}")
def range_marker_runs(t: Tables) -> DataFrame:
    p = laid(t)
    return P.touched(P.hits(markers(t), p), K.runs(p)).select("doc_id", "para", "marker", "hit", "run")


PLACED = f"""select doc_id, para, marker, hit, min(run) as first_run, max(run) as last_run, case when max(run) is null then 'no run holds it' when min(run) filter (anchored) < max(run) then 'it straddles a comment''s anchor' end as why,
  coalesce(max(users) > 1, false) as shares_run
  from (select h.doc_id, h.para, h.marker, h.hit, o.run, o.anchored, case when o.run is not null then count(*) over (partition by h.doc_id, h.para, o.run) end as users {OVER.replace("JOIN_", "left join")}) x group by doc_id, para, marker, hit"""


@query("marker_placement", PLACED)
def marker_placement(t: Tables) -> DataFrame:
    p = laid(t)
    return P.placements(P.hits(markers(t), p), K.runs(p))


@query("placement_report", f"select d.doc_id, coalesce(placed, 0) as placed, coalesce(skipped, 0) as skipped, 5 - coalesce(found, 0) as unmatched from {{documents}} d left join (select doc_id, count(*) filter (why is null) as placed, count(why) as skipped, count(distinct marker) as found from ({PLACED}) h group by doc_id) x on x.doc_id = d.doc_id")
def placement_report(t: Tables) -> DataFrame:
    p, m = laid(t), markers(t)
    return P.report(m, P.placements(P.hits(m, p), K.runs(p)))
