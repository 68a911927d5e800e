"""Queries of the record merge and of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import hierarchy as H
from ..operators import merge as M
from ..operators import reconcile as R
from ..registry import query
from ..sources.shelf import Shelf
from ..sources.views import Tables
from .scalars import ISBN13, part_items

c = F.col


def entries(t: Tables) -> DataFrame:
    """Parts as plan entries: a translated item, often another type, and what a caller asserts."""
    p = c("p_partkey")
    meta = F.map_filter(
        F.create_map(
            F.lit("title"), F.when(p % 3 == 0, c("p_name")).when(p % 3 == 1, F.concat("p_name", F.lit("!"))), F.lit("publisher"), F.when(p % 7 < 3, c("p_brand")),
            F.lit("place"), F.when(p % 2 == 0, "Rome"), F.lit("isbn"), F.when(p % 11 == 0, F.lpad(p.cast("string"), 10, "0")), F.lit("colour"), F.when(p % 97 == 0, "red"),
        ),
        lambda k, v: v.isNotNull(),
    )
    person = lambda role, name: F.struct(F.lit(role).alias("creator_type"), name.alias("last_name"), F.lit("A.").alias("first_name"), F.lit(None).cast("string").alias("name"))
    rows = part_items(t).join(t("part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return rows.select(
        "p_partkey", c("item_type").alias("source_type"), "item", F.array(person("author", c("p_brand")), person("editor", c("p_name")), person("translator", c("p_name"))).alias("creators"),
        F.element_at(F.array(F.lit(None), F.lit(None), F.lit("report"), F.lit("statute"), F.lit("book")).cast("array<string>"), (p % 5 + 1).cast("int")).alias("item_type"),
        meta.alias("metadata"), F.when(p % 13 == 0, F.create_map(F.lit("language"), F.lit("en"))).cast("map<string,string>").alias("fields"),
        F.when(p % 6 == 0, F.array(F.lit("Rossi, Ada"), F.lit("A Body"))).cast("array<string>").alias("authors"), F.when(p % 17 == 0, F.array(F.lit("Bianchi, B."))).cast("array<string>").alias("editors"),
        F.when(p % 4 == 2, F.concat(F.lit("https://example.org/"), p)).otherwise(F.concat(F.lit("10.1000/"), p)).alias("identifier"), F.when(p % 4 == 2, "url").otherwise("doi").alias("kind"),
        (p % 19 != 0).alias("resolved"), F.when(p % 8 == 0, c("p_name")).alias("hint"),
    )


def _text(m: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


FIELDS = ", ".join(f"('{t}', '{f}')" for t, fs in M.TYPE_FIELDS.items() for f in fs)
FAMILY = ", ".join(f"('{fam}', '{f}', {i})" for fam, fs in C.FAMILIES.items() for i, f in enumerate(fs))
BASE = f"""with tf(type, field) as (values {FIELDS}), fam(family, field, n) as (values {FAMILY}),
  src as (select *, p_partkey % 4 as q, (['statute', 'book', 'webpage', 'report'])[p_partkey % 4 + 1] as source_type, ([null, null, 'report', 'statute', 'book'])[p_partkey % 5 + 1] as item_type from {{part}}),
  typed as (select *, coalesce(item_type, source_type) as target from src),
  kv as (select p_partkey, source_type, target, unnest([case q when 0 then 'nameOfAct' else 'title' end, (['code', 'publisher', 'websiteTitle', 'institution'])[q + 1], case q when 0 then 'dateEnacted' else 'date' end]) as k, unnest([p_name, p_brand, (1970 + p_size)::varchar]) as v from typed),
  slot as (select tf.type, family, arg_min(fam.field, n) as field from fam join tf on tf.field = fam.field group by tf.type, family),
  homed as (select kv.*, case when source_type = target or tf.field is not null then k else slot.field end as home from kv left join tf on tf.type = target and tf.field = k left join fam on fam.field = k left join slot on slot.type = target and slot.family = fam.family)"""


@query("merge_type_change", BASE + " select p_partkey, coalesce(string_agg(home || '=' || v, ';' order by home) filter (home is not null), '') as kept, coalesce(string_agg(k || '=' || v, ';' order by k) filter (home is null), '') as dropped from homed group by p_partkey")
def merge_type_change(t: Tables) -> DataFrame:
    plain = entries(t).withColumns({"metadata": F.lit(None).cast("map<string,string>"), "fields": F.lit(None).cast("map<string,string>"), "kind": F.lit("doi")})
    return M.merge(plain).select("p_partkey", _text("merged").alias("kept"), _text("dropped").alias("dropped"))


ASSERT = BASE + """, said as (select p_partkey, target, 'title' as fam, case p_partkey % 3 when 0 then p_name when 1 then p_name || '!' end as v from typed union all select p_partkey, target, 'publisher', case when p_partkey % 7 < 3 then p_brand end from typed),
  put as (select s.p_partkey, slot.field, s.v, h.v as before from said s join slot on slot.type = s.target and slot.family = s.fam left join homed h on h.p_partkey = s.p_partkey and h.home = slot.field where s.v is not null)
  select p.p_partkey, coalesce(string_agg(field || ':' || before || '>' || v, ';' order by field) filter (before <> v), '') as overridden, coalesce(string_agg(field || '=' || v, ';' order by field) filter (before is null), '') as asserted from {part} p left join put on put.p_partkey = p.p_partkey group by p.p_partkey"""


@query("merge_assert", ASSERT)
def merge_assert(t: Tables) -> DataFrame:
    told = entries(t).withColumns({"metadata": F.map_filter("metadata", lambda k, v: k.isin("title", "publisher")), "fields": F.lit(None).cast("map<string,string>"), "kind": F.lit("doi")})
    changed = F.array_join(F.transform("overridden", lambda o: F.concat(o["field"], F.lit(":"), o["translator"], F.lit(">"), o["caller"])), ";")
    return M.merge(told).select("p_partkey", changed.alias("overridden"), _text("asserted").alias("asserted"))


@query("merge_creators", "select p_partkey, case when p_partkey % 5 in (0, 1) then 'author,editor,translator' when p_partkey % 5 = 4 then case when p_partkey % 4 = 1 then 'author,editor,translator' else 'author,editor,translator' end when p_partkey % 5 = 2 then case when p_partkey % 4 = 3 then 'author,editor,translator' else 'author,translator' end else case when p_partkey % 4 = 0 then 'author,editor,translator' else 'author' end end as roles from {part}")
def merge_creators(t: Tables) -> DataFrame:
    plain = entries(t).withColumns({"authors": F.lit(None).cast("array<string>"), "editors": F.lit(None).cast("array<string>")})
    return M.merge(plain).select("p_partkey", F.array_join(F.transform("merged_creators", lambda x: x["creator_type"]), ",").alias("roles"))


@query("merge_default", "select p_partkey, case when p_partkey % 4 = 2 then 'url=https://example.org/' || p_partkey else '' end as defaulted from {part}")
def merge_default(t: Tables) -> DataFrame:
    silent = entries(t).withColumns({"metadata": F.lit(None).cast("map<string,string>"), "fields": F.lit(None).cast("map<string,string>")})
    return M.merge(silent).select("p_partkey", _text("defaulted").alias("defaulted"))


VALID = BASE + """ select p_partkey, case when p_partkey % 97 = 0 then 'unknown metadata keys'
  when (p_partkey % 7 < 3 and target in ('webpage', 'statute')) or (p_partkey % 2 = 0 and target in ('webpage', 'statute')) or (p_partkey % 11 = 0 and target <> 'book') then 'no field for a metadata key'
  when p_partkey % 17 = 0 and target <> 'book' then 'role not allowed' end as error from typed"""


@query("merge_validate", VALID)
def merge_validate(t: Tables) -> DataFrame:
    return M.merge(entries(t)).select("p_partkey", "error")


@query("flt_unknown_keys", "select p_partkey, p_partkey % 97 = 0 as unknown from {part}")
def flt_unknown_keys(t: Tables) -> DataFrame:
    known = F.array(*(F.lit(k) for k in [*C.FAMILIES, *C.PLAIN]))
    return entries(t).select("p_partkey", (F.size(F.array_except(F.map_keys("metadata"), known)) > 0).alias("unknown"))


@query("flt_uncertain_type", BASE + " select p_partkey from typed where item_type is null and source_type in ('document', 'webpage', 'report', 'manuscript', 'presentation')")
def flt_uncertain_type(t: Tables) -> DataFrame:
    return entries(t).where(c("item_type").isNull() & c("source_type").isin(*C.UNCERTAIN_TYPES)).select("p_partkey")


_META = """select p_partkey, target, unnest(['title', 'publisher', 'place', 'isbn']) as k, unnest([case p_partkey % 3 when 0 then p_name when 1 then p_name || '!' end, case when p_partkey % 7 < 3 then p_brand end, case when p_partkey % 2 = 0 then 'Rome' end, case when p_partkey % 11 = 0 then lpad(p_partkey::varchar, 10, '0') end]) as v from typed"""
RECORD = BASE + f""", meta as ({_META}),
  stated as (select m.p_partkey, m.target, coalesce(slot.field, case k when 'place' then 'place' when 'isbn' then 'ISBN' end) as f, case when k = 'isbn' then coalesce({ISBN13('m.v')}, m.v) else m.v end as v, 1 as pass
    from meta m left join slot on slot.type = m.target and slot.family = m.k where m.v is not null union all select p_partkey, target, 'language', 'en', 2 from typed where p_partkey % 13 = 0),
  put as (select s.p_partkey, s.f, s.v, h.v as before from stated s join tf on tf.type = s.target and tf.field = s.f left join homed h on h.p_partkey = s.p_partkey and h.home = s.f),
  final as (select p_partkey, home as f, v from homed h where home is not null and not exists (select 1 from put where put.p_partkey = h.p_partkey and put.f = h.home) union all select p_partkey, f, v from put),
  told as (select p_partkey, count(*) filter (before <> v) as n_overridden, string_agg(f || '=' || v, ';' order by f) filter (before is null) as asserted from put group by p_partkey),
  dropped as (select p_partkey, string_agg(k || '=' || v, ';' order by k) as dropped from homed where home is null and source_type <> target group by p_partkey),
  fill as (select p_partkey, 'url' as f, 'https://example.org/' || p_partkey as v from typed where p_partkey % 4 = 2
    union all select t.p_partkey, 'accessDate', '2026-01-01' from typed t join told using (p_partkey) where p_partkey % 4 = 2 and (n_overridden > 0 or asserted is not null)),
  every as (select * from final union all select * from fill),
  record as (select p_partkey, string_agg(f || '=' || v, ';' order by f) as merged from every group by p_partkey), filled as (select p_partkey, string_agg(f || '=' || v, ';' order by f) as defaulted from fill group by p_partkey),
  valid as (select p_partkey as id, error from ({VALID}) e)
  select t.p_partkey, target as target_type, case when item_type is null and p_partkey % 3 = 2 and p_partkey % 7 >= 3 and p_partkey % 2 <> 0 and p_partkey % 11 <> 0 and p_partkey % 97 <> 0 and p_partkey % 13 <> 0 then 'translator' else 'translator+caller' end as source,
  merged, coalesce(asserted, '') as asserted, coalesce(dropped, '') as dropped, coalesce(defaulted, '') as defaulted, coalesce(n_overridden, 0)::int as n_overridden, error
  from typed t join record using (p_partkey) left join told using (p_partkey) left join dropped using (p_partkey) left join filled using (p_partkey) left join valid on valid.id = p_partkey"""


@query("merge_record", RECORD)
def merge_record(t: Tables) -> DataFrame:
    m = M.merge(entries(t))
    return m.select("p_partkey", "target_type", "source", _text("merged").alias("merged"), _text("asserted").alias("asserted"), _text("dropped").alias("dropped"), _text("defaulted").alias("defaulted"), F.size("overridden").alias("n_overridden"), "error")


# An identifier that wasn't resolved leaves nothing of what it seemed to hold: the type, the title and the rest are the caller's.
PLANNED = BASE.replace(" src as (select *,", " src as (select *, p_partkey % 19 <> 0 as resolved, case when p_partkey % 4 = 2 then 'url' else 'doi' end as kind,", 1) + """,
  row as (select *, coalesce(item_type, case when resolved then source_type end) as aim, item_type is not null or p_partkey % 3 <> 2 or p_partkey % 7 < 3 or p_partkey % 2 = 0 or p_partkey % 11 = 0 or p_partkey % 97 = 0 or p_partkey % 13 = 0 as caller from typed),
  wrong as (select *, case when p_partkey % 97 = 0 then 'unknown metadata keys' when aim is null then 'no item type'
    when (p_partkey % 7 < 3 and aim in ('webpage', 'statute')) or (p_partkey % 2 = 0 and aim in ('webpage', 'statute')) or (p_partkey % 11 = 0 and aim <> 'book') then 'no field for a metadata key'
    when p_partkey % 17 = 0 and aim <> 'book' then 'role not allowed' when not resolved and p_partkey % 3 = 2 then 'no title' end as error from row),
  way as (select *, case when not resolved and kind = 'doi' then 'registered' when not resolved and not caller then 'bare' when caller and error is not null then 'bad' else 'fine' end as way from wrong)"""


@query("plan_one", PLANNED + " select p_partkey, case way when 'registered' then 'unresolved' when 'bare' then 'unresolved' when 'bad' then 'invalid' else 'new' end as outcome from way")
def plan_one(t: Tables) -> DataFrame:
    return M.plan_rows(entries(t)).select("p_partkey", "outcome")


@query("flt_registered_unresolved", "select p_partkey from {part} where p_partkey % 19 = 0 and p_partkey % 4 <> 2")
def flt_registered_unresolved(t: Tables) -> DataFrame:
    return entries(t).where(~c("resolved") & c("kind").isin("doi", "pmid", "arxiv")).select("p_partkey")


@query("plan_warnings", PLANNED + """, lost as (select p_partkey as id, string_agg(k, ', ' order by k) as ks from homed where home is null group by p_partkey)
  select w.p_partkey, concat_ws('; ', case when not resolved then 'the identifier led to nothing' end, case when way = 'registered' then 'a doi that leads nowhere was probably copied wrong' end,
    case when not resolved and way in ('bad', 'fine') then 'nothing was read: built from the caller''s metadata' end, case when way = 'bad' then error end,
    case when way = 'fine' and aim in ('webpage', 'report') and item_type is null then 'uncertain type' end, case when way = 'fine' and resolved and source_type <> target and ks is not null then 'no room for: ' || ks end,
    case when way = 'fine' and not resolved then 'caller''s metadata alone' end,
    case when way = 'fine' and w.p_partkey % 8 = 0 and not contains(lower(p_name), trim(regexp_replace(lower(got), '[^a-z0-9]+', ' ', 'g'))) and not contains(trim(regexp_replace(lower(got), '[^a-z0-9]+', ' ', 'g')), lower(p_name)) then 'another first author' end) as warnings
  from (select *, case when resolved then p_brand when p_partkey % 6 = 0 then 'Rossi' else '' end as got from way) w left join lost on id = w.p_partkey""")
def plan_warnings(t: Tables) -> DataFrame:
    return M.plan_rows(entries(t)).select("p_partkey", F.array_join("warnings", "; ").alias("warnings"))


def held(t: Tables) -> DataFrame:
    """What the binding holds when the plan is made: the library's items, and the parts of some brands, some on the source leg, in two collections each."""
    mine = t("part").where("p_brand like 'Brand#1%'")
    parts = mine.select(
        (c("p_partkey") + 10_000_000).alias("pos"), F.concat(F.upper("p_name"), F.lit(".")).alias("title"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("isbn"),
        F.concat(F.lit("http://example.org/"), "p_partkey", F.lit("/")).alias("url"), F.when(c("p_size") < 25, "groups/1").otherwise("groups/2").alias("library"), F.array(F.concat(F.lit("N"), c("p_size") % 5), F.lit("R1")).alias("collections"),
    )
    every = t("v_items").select(c("page_id").alias("pos"), "title", "doi", "isbn", "url", "library", F.array("collection_key").alias("collections"))
    return every.unionByName(parts)


@query("plan_build")
def plan_build(t: Tables) -> DataFrame:
    """The whole batch: merged rows that may go in are deduplicated against what the binding holds and against earlier rows, the others keep
    their outcome; a row that is held already says whether it is filed into the plan's collection (N1, in groups/1)."""
    rows = Shelf(t.spark, "plan").put(M.plan_rows(entries(t)).select("p_partkey", "outcome", "merged"), "rows")
    fresh = rows.where("outcome = 'new'").select(c("p_partkey").alias("pos"), C.family_value(c("merged"), "title").alias("title"), F.try_element_at("merged", F.lit("DOI")).alias("doi"), F.try_element_at("merged", F.lit("ISBN")).alias("isbn"), F.try_element_at("merged", F.lit("url")).alias("url"))
    there = held(t)
    told = R.in_batch(fresh, there.select("pos", "title", "doi", "isbn", "url")).select(c("pos").alias("p_partkey"), c("outcome").alias("found"), "match", "target", "in_plan")
    present = told.where("found = 'present' and not in_plan").select("p_partkey", c("target").alias("pos")).join(there.select("pos", "library", "collections"), "pos")
    filed = H.filing(present, H.subtree(t("v_collections"), "ROOT"), "groups/1", F.lit("N1"), F.lit(True), "p_partkey").select("p_partkey", "filing")
    return rows.join(told, "p_partkey", "left").join(filed, "p_partkey", "left").select("p_partkey", F.coalesce("found", "outcome").alias("outcome"), "match", "target", "in_plan", "filing")


@query("gen_entries", "select p_partkey as pos, p_brand as id, case when p_partkey % 8 = 0 then p_name end as hint from {part} union all select o_orderkey + (select max(p_partkey) + 1 from {part}), o_orderpriority, null from {orders}")
def gen_entries(t: Tables) -> DataFrame:
    """Plain identifiers with their hints, followed by full entries, in one order."""
    plain = t("part").select(c("p_partkey").alias("pos"), c("p_brand").alias("id"), F.when(c("p_partkey") % 8 == 0, c("p_name")).alias("hint"))
    after = t("part").agg((F.max("p_partkey") + 1).alias("shift"))
    full = t("orders").join(F.broadcast(after)).select((c("o_orderkey") + c("shift")).alias("pos"), c("o_orderpriority").alias("id"), F.lit(None).cast("string").alias("hint"))
    return plain.unionByName(full)


@query("add_tags", "select p_partkey, concat_ws(',', 'kept', case when p_partkey % 3 = 0 then 'caller-metadata' end, case p_partkey % 4 when 0 then 'supports' when 1 then 'contradicts' when 2 then 'qualifies' end) as tags from {part}")
def add_tags(t: Tables) -> DataFrame:
    p = c("p_partkey")
    verdict = F.when(p % 4 == 0, "supports_directly").when(p % 4 == 1, "contradicts").when(p % 4 == 2, "mixed")
    bearing = F.try_element_at(F.create_map(*(F.lit(x) for kv in C.BEARINGS.items() for x in kv)), verdict)
    tags = F.array_union(F.array(F.lit("kept")), F.array_compact(F.array(F.when(p % 3 == 0, "caller-metadata"), bearing)))
    return t("part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


VERDICT = "case split_part(p_type, ' ', 1) when 'STANDARD' then 'Supports_Directly' when 'SMALL' then 'contradicts' when 'MEDIUM' then 'mixed' when 'LARGE' then 'irrelevant' when 'ECONOMY' then 'supports' end"


@query("sink_items", f"""select r.p_partkey, merged as item, 'N' || (r.p_partkey % 3) as collections, concat_ws(',', case when source <> 'translator' then 'caller-metadata' end,
  case {VERDICT} when 'Supports_Directly' then 'supports' when 'supports' then 'supports' when 'contradicts' then 'contradicts' when 'mixed' then 'qualifies' end) as tags from ({RECORD}) r join {{part}} p on p.p_partkey = r.p_partkey""")
def sink_items(t: Tables) -> DataFrame:
    """Merged parts written as items, a folder for each collection: without bookkeeping, with the tags of caller and verdict; read again."""
    shelf = Shelf(t.spark, "items")
    rows = M.merge(entries(t)).join(t("part").select("p_partkey", F.expr(VERDICT).alias("verdict")), "p_partkey")
    kept = F.create_map(F.lit("key"), c("p_partkey").cast("string"), F.lit("version"), F.lit("3"), F.lit("dateAdded"), F.lit("2026-01-01"))
    out = M.written(rows.withColumn("merged", F.map_concat("merged", kept)), F.concat(F.lit("N"), c("p_partkey") % 3), c("verdict"))
    out = out.select("p_partkey", _text("item").alias("item"), F.array_join("collections", ",").alias("collections"), F.array_join("tags", ",").alias("tags"))
    out.write.partitionBy("collections").parquet(f"{shelf.root}/items")
    return t.spark.read.schema(out.schema).parquet(f"{shelf.root}/items")


# A locator on two items in three, with and without a label, prefixes, suffixes and suppressed authors; pages of a citation are grouped.
CITED = """select *, 'K' || pos || 'x' as item_id, case when pos % 3 <> 0 then '' || (pos * 7) end as locator, case when pos % 3 = 1 then 'sub verbo' end as label, case when pos % 4 = 1 then 'see "' || pos || '"' end as prefix,
  case when pos % 4 = 2 then '' when pos % 4 = 3 then ' et al.' end as suffix, pos % 5 = 2 as suppress from {v_citation_items} where uri is not null"""


@query("citation_field_json", f"""select doc_id, citation_id, count(*) as n_items, md5('ADDIN ZOTERO_ITEM CSL_CITATION {{{{"citationID":"' || lpad(citation_id::varchar, 8, '0') || '","properties":{{{{"formattedCitation":"","plainCitation":"","noteIndex":0}}}},"citationItems":[' ||
  string_agg('{{{{"id":"' || case when pos % 2 = 0 then item_id else right(uri, 8) end || '","uris":["' || uri || '"],"itemData":{{{{' || case when pos % 2 = 0 then '"id":"' || item_id || '",' else '' end || '"title":"' || title || '","year":' || year || '}}}}'
    || case when locator is not null then ',"locator":"' || locator || '","label":"' || coalesce(label, 'page') || '"' else '' end || case when prefix is not null then ',"prefix":"' || replace(prefix, '"', '\\"') || '"' else '' end
    || case when suffix <> '' then ',"suffix":"' || suffix || '"' else '' end || case when suppress then ',"suppress-author":true' else '' end || '}}}}', ',' order by pos, uri, title, year) || '],"schema":"{C.SCHEMA}"}}}}') as field_md5
  from ({CITED}) x group by doc_id, citation_id""".replace("{{", "{").replace("}}", "}"))
def citation_field_json(t: Tables) -> DataFrame:
    """A citation's field text: its items in order with locator, label, prefix, suffix and suppressed author, grouped in one field."""
    data = F.struct(F.when(c("pos") % 2 == 0, c("item_id")).alias("id"), "title", "year")
    entry = C.citation_item(c("uri"), F.right("uri", F.lit(8)), data, c("locator"), c("label"), c("prefix"), c("suffix"), c("suppress"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "uri", "title", "year", entry.alias("entry")))), lambda x: x["entry"])
    rows = t.sql(CITED).groupBy("doc_id", "citation_id").agg(F.count("*").alias("n_items"), ordered.alias("entries"))
    field = C.citation_field(F.lpad(c("citation_id").cast("string"), 8, "0"), c("entries"))
    return rows.select("doc_id", "citation_id", "n_items", F.md5(F.encode(field, "UTF-8")).alias("field_md5"))
