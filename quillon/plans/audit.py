"""Queries of the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..registry import query
from ..sources.views import VIEWS, Tables
from .scalars import DUCK_DOI, LIBRARY, SIGNATURE

c = F.col
DATA = "not (coalesce(title, '') = '' and doi is null)"
SUR = f"""select doc_id, sig, count(distinct u)::bigint as n_uris, string_agg(distinct u, ' ' order by u) as uris, min_by(label, (cited_at, citation_id, pos, label)) as label from
  (select *, {SIGNATURE} as sig, coalesce(uri, '<no uri>') as u, coalesce(first_author, '?') || ' ' || coalesce(year::varchar, '?') || ': ' || substr(title, 1, 60) as label from {{v_citation_items}}) s group by doc_id, sig having count(distinct u) > 1"""
F_SQL = {
    "chk_duplicate_surrogate": f"select doc_id, 'error' as level, 'duplicate-surrogate' as code, n_uris as n, label || ' | ' || uris as detail from ({SUR}) d",
    "chk_missing_uri": "select doc_id, 'error' as level, 'missing-uri' as code, count(*) as n, '' as detail from {v_citation_items} where uri is null group by doc_id",
    "chk_local_uri": f"select doc_id, 'warning' as level, 'local-uri' as code, count(*) as n, string_agg(distinct library, ', ' order by library) as detail from (select doc_id, {LIBRARY} as library from {{v_citation_items}}) l where starts_with(library, 'users/local/') group by doc_id",
    "chk_missing_itemdata": f"select doc_id, 'error' as level, 'missing-itemdata' as code, count(*) as n, '' as detail from {{v_citation_items}} where not ({DATA}) group by doc_id",
    "chk_malformed_doi": f"select doc_id, 'warning' as level, 'malformed-doi' as code, max(n) as n, string_agg(shown, '; ' order by k) filter (k <= 10) as detail from (select doc_id, coalesce(first_author, '?') || ' ' || coalesce(year::varchar, '?') || ': ' || doi as shown, row_number() over (partition by doc_id order by cited_at, citation_id, pos, shown) as k, count(*) over (partition by doc_id) as n from {{v_citation_items}} where {DATA} and coalesce(doi, '') <> '' and not regexp_matches(trim(doi), '{DUCK_DOI}')) m group by doc_id",
    "chk_missing_title": f"select doc_id, 'warning' as level, 'missing-title' as code, count(*) as n, '' as detail from {{v_citation_items}} where {DATA} and trim(coalesce(title, '')) = '' group by doc_id",
    "chk_citation_ids": "select doc_id, 'warning' as level, 'duplicate-citationid' as code, max(n) as n, string_agg(citation_code, ', ' order by k) filter (k <= 8) as detail from (select doc_id, citation_code, row_number() over (partition by doc_id order by first_at, citation_code) as k, count(*) over (partition by doc_id) as n from (select doc_id, citation_code, min((cited_at, citation_id)) as first_at from {v_citations} group by doc_id, citation_code having count(*) > 1) d) x group by doc_id",
    "chk_note_style": "select doc_id, 'note' as level, 'note-based-style' as code, count(*) as n, '' as detail from {v_citations} where note_index <> 0 group by doc_id",
    "chk_missing_prefs": "select doc_id, 'error' as level, 'missing-prefs' as code, 1::bigint as n, '' as detail from {v_manuscripts} where not has_prefs and doc_id in (select doc_id from {v_citations})",
    "chk_field_type": "select doc_id, 'warning' as level, 'field-type' as code, 1::bigint as n, field_type as detail from {v_manuscripts} where has_prefs and field_type <> 'Field'",
    "chk_missing_bibliography": "select doc_id, 'warning' as level, 'missing-bibliography' as code, 1::bigint as n, '' as detail from {v_manuscripts} where not has_bibliography and doc_id in (select doc_id from {v_citations})",
    "chk_tracked_changes": "select doc_id, 'note' as level, 'tracked-changes' as code, count(distinct author) as n, string_agg(distinct author, ', ' order by author) as detail from {v_revisions} group by doc_id",
    "chk_no_fields": "select doc_id, 'note' as level, 'no-fields' as code, 1::bigint as n, '' as detail from {v_manuscripts} where doc_id not in (select doc_id from {v_citations})",
}
ALL = " union all ".join(f"select * from ({s}) f{i}" for i, s in enumerate(F_SQL.values()))
RANK = "case level when 'error' then 0 when 'warning' then 1 else 2 end"

for _name, _f in {
    "chk_duplicate_surrogate": lambda t: A.duplicate_surrogate(t("v_citation_items")),
    "chk_missing_uri": lambda t: A.missing_uri(t("v_citation_items")),
    "chk_local_uri": lambda t: A.local_uri(t("v_citation_items")),
    "chk_missing_itemdata": lambda t: A.missing_itemdata(t("v_citation_items")),
    "chk_malformed_doi": lambda t: A.malformed_doi(t("v_citation_items")),
    "chk_missing_title": lambda t: A.missing_title(t("v_citation_items")),
    "chk_citation_ids": lambda t: A.citation_ids(t("v_citations")),
    "chk_note_style": lambda t: A.note_style(t("v_citations")),
    "chk_missing_prefs": lambda t: A.missing_prefs(t("v_manuscripts"), t("v_citations")),
    "chk_field_type": lambda t: A.field_type(t("v_manuscripts")),
    "chk_missing_bibliography": lambda t: A.missing_bibliography(t("v_manuscripts"), t("v_citations")),
    "chk_tracked_changes": lambda t: A.tracked_changes(t("v_revisions")),
    "chk_no_fields": lambda t: A.no_fields(t("v_manuscripts"), t("v_citations")),
}.items():
    query(_name, F_SQL[_name])(_f)


def _items(t: Tables) -> DataFrame:
    """v_citation_items, where each order and part, of which there is one a key, is hashed instead of the many items being sorted."""
    few = {x: t(x).hint("shuffle_hash") for x in ("orders", "part")}
    return t.spark.sql(VIEWS["v_citation_items"], lineitem=t("lineitem"), **few)


def _all(t: Tables) -> DataFrame:
    return A.all_findings(_items(t), t("v_citations"), t("v_manuscripts"), t("v_revisions"))


@query("audit_all", f"""select m.doc_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(notes, 0) as notes, coalesce(errors, 0) = 0 as clean,
  case when coalesce(errors, 0) > 0 then 1 else 0 end as status, case when coalesce(errors, 0) + coalesce(warnings, 0) > 0 then 1 else 0 end as strict_status
  from {{v_manuscripts}} m left join (select doc_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'note') as notes from ({ALL}) a group by doc_id) x on x.doc_id = m.doc_id""")
def audit_all(t: Tables) -> DataFrame:
    return A.status(_all(t), t("v_manuscripts"))


@query("sort_findings", f"select *, row_number() over (partition by doc_id order by {RANK}, code, detail) as rank from ({ALL}) a")
def sort_findings(t: Tables) -> DataFrame:
    return A.ordered(_all(t))


@query("topk_detail", F_SQL["chk_malformed_doi"].replace("k <= 10", "k <= 3"))
def topk_detail(t: Tables) -> DataFrame:
    return A.malformed_doi(t("v_citation_items"), 3)


@query("win_order", "select doc_id, citation_id, row_number() over (partition by doc_id order by cited_at, citation_id) - 1 as ord from {v_citations}")
def win_order(t: Tables) -> DataFrame:
    return A.citation_order(t("v_citations")).select("doc_id", "citation_id", "ord")


@query("win_first_label", f"select doc_id, sig, min_by(title, (cited_at, citation_id, pos, title)) as label from (select *, {SIGNATURE} as sig from {{v_citation_items}}) s group by doc_id, sig")
def win_first_label(t: Tables) -> DataFrame:
    rows = t("v_citation_items").withColumn("sig", A.signature())
    return rows.groupBy("doc_id", "sig").agg(F.min_by("title", F.struct(*A.IN_ORDER, "title")).alias("label"))


@query("flt_has_fields", "select doc_id from {v_manuscripts} where doc_id in (select doc_id from {v_citations})")
def flt_has_fields(t: Tables) -> DataFrame:
    return t("v_manuscripts").join(t("v_citations"), "doc_id", "left_semi").select("doc_id")


@query("flt_has_bibliography", "select doc_id from {v_manuscripts} where has_bibliography")
def flt_has_bibliography(t: Tables) -> DataFrame:
    return t("v_manuscripts").where("has_bibliography").select("doc_id")


@query("flt_footnote_style", "select doc_id, citation_id from {v_citations} where note_index <> 0")
def flt_footnote_style(t: Tables) -> DataFrame:
    return t("v_citations").where("note_index <> 0").select("doc_id", "citation_id")
