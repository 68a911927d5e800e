"""Queries of access scopes, search, ledger and plan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import apply as A
from ..operators import search as S
from ..operators.apply import is_filed, skip_reason
from ..registry import query
from ..sources.shelf import Shelf
from ..sources.views import Tables
from .scalars import SPACED

c = F.col
SCOPE = "struct<user:struct<write:boolean>,groups:map<string,struct<write:boolean>>>"


def payloads(t: Tables) -> DataFrame:
    """Access scopes as JSON text, one per user: what a key server answers."""
    group = F.struct(c("group_id").cast("string").alias("key"), F.struct(c("can_write").alias("write")).alias("value"))
    per = t("v_grants").groupBy("user_id").agg(F.bool_or("personal_write").alias("p"), F.bool_or("all_write").alias("a"), F.collect_list(group).alias("g"))
    every = F.map_from_entries(F.concat(F.array(F.struct(F.lit("all").alias("key"), F.struct(c("a").alias("write")).alias("value"))), "g"))
    return per.select("user_id", F.to_json(F.struct(F.struct(c("p").alias("write")).alias("user"), every.alias("groups"))).alias("payload"))


def scopes(payload: DataFrame) -> DataFrame:
    return payload.select("user_id", F.from_json("payload", SCOPE).alias("s")).select("user_id", "s.user", "s.groups")


@query("src_scopes", "select user_id, bool_or(personal_write) as personal_write, bool_or(all_write) as all_write, count(*) + 1 as entries from {v_grants} group by user_id")
def src_scopes(t: Tables) -> DataFrame:
    return scopes(payloads(t)).select("user_id", c("user.write").alias("personal_write"), F.element_at("groups", "all")["write"].alias("all_write"), F.size("groups").cast("long").alias("entries"))


@query("gen_grants", "select user_id, 'groups/' || group_id as library, can_write or all_write as write from {v_grants} union all select distinct user_id, 'users/' || user_id, personal_write from {v_grants}")
def gen_grants(t: Tables) -> DataFrame:
    s = scopes(payloads(t))
    every = F.coalesce(F.try_element_at("groups", F.lit("all"))["write"], F.lit(False))
    groups = s.select("user_id", every.alias("every"), F.explode("groups").alias("key", "rule")).where("key <> 'all'")
    own = s.select("user_id", F.concat(F.lit("users/"), "user_id").alias("library"), c("user.write").alias("write"))
    return groups.select("user_id", F.concat(F.lit("groups/"), "key").alias("library"), (F.coalesce(c("rule.write"), F.lit(False)) | c("every")).alias("write")).union(own)


@query("scope_verdict", """select user_id, case when bool_or(personal_write) or bool_or(all_write) then 'wide' when not bool_or(can_write) then 'narrow' else 'ok' end as verdict,
  array_to_string(list_sort(list(group_id::varchar) filter (can_write)), ',') as writable, array_to_string(list_sort(list(group_id::varchar) filter (not can_write)), ',') as readable,
  concat_ws('; ', case when bool_or(personal_write) then 'writes to the personal library' end, case when bool_or(all_write) then 'writes to all groups' end, case when not bool_or(personal_write) and not bool_or(all_write) and not bool_or(can_write) then 'no group is writable' end) as reasons from {v_grants} group by user_id""")
def scope_verdict(t: Tables) -> DataFrame:
    entries = F.filter(F.map_entries("groups"), lambda e: e["key"] != "all")
    pick = lambda yes: F.array_sort(F.transform(F.filter(entries, lambda e: F.coalesce(e["value"]["write"], F.lit(False)) == yes), lambda e: e["key"]))
    rows = scopes(payloads(t)).select("user_id", F.coalesce("user.write", F.lit(False)).alias("p"), F.coalesce(F.try_element_at("groups", F.lit("all"))["write"], F.lit(False)).alias("a"), pick(True).alias("w"), pick(False).alias("r"))
    narrow = ~c("p") & ~c("a") & (F.size("w") == 0)
    reasons = F.concat_ws("; ", F.when(c("p"), "writes to the personal library"), F.when(c("a"), "writes to all groups"), F.when(narrow, "no group is writable"))
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(x, ","))
    return rows.select("user_id", F.when(c("p") | c("a"), "wide").when(narrow, "narrow").otherwise("ok").alias("verdict"), joined("w").alias("writable"), joined("r").alias("readable"), reasons.alias("reasons"))


def has_terms(text: Column, terms: list[str]) -> Column:
    """All terms stand in the folded text."""
    folded, out = C.fold_spaced(text), F.lit(True)
    for term in terms:
        out = out & folded.contains(term)
    return out


@query("search_terms", f"select doc_id, source from {{documents}} where contains({SPACED('text')}, 'license') and contains({SPACED('text')}, 'version')")
def search_terms(t: Tables) -> DataFrame:
    return t("documents").where(has_terms(c("text"), ["license", "version"])).select("doc_id", "source")


@query("limit_search", f"select page_id, library from (select page_id, library from {{v_items}} where contains({SPACED('title')}, 'the') order by library, page_id limit 20) x")
def limit_search(t: Tables) -> DataFrame:
    return t("v_items").where(has_terms(c("title"), ["the"])).orderBy("library", "page_id").limit(20).select("page_id", "library")


# Parts as library items: a title, two creators and a library each; queries of one to three words, asked by the users of the grants.
SHELVED = "select 'groups/' || (1 + p_partkey % 89) as library, 'P' || p_partkey as item_key, p_name as title, p_brand as first_creator, p_type as second_creator from {part}"
ASKED = """select p_partkey as query, p_partkey % 25 as user_id, case p_partkey % 4 when 0 then split_part(p_name, ' ', 1) when 1 then upper(split_part(p_name, ' ', 1)) || ', ' || split_part(p_name, ' ', 2)
  when 2 then p_brand || ' ' || split_part(p_name, ' ', 1) else split_part(p_name, ' ', 2) || ' ' || p_type || ' absent' || (p_partkey % 2) end as text from {part} where p_partkey % 5 = 0"""
READABLE = "select distinct user_id, 'groups/' || group_id as library from {v_grants}"


@query("search_index", f"""with i as (select library, item_key, string_split({SPACED("title || ' ' || first_creator || ' ' || second_creator")}, ' ') as words from ({SHELVED}) s),
  q as (select query, user_id, string_split({SPACED('text')}, ' ') as wanted from ({ASKED}) a),
  m as (select query, row_number() over (partition by query order by i.library, item_key) as place, i.library, item_key from q join i on list_has_all(words, wanted) join ({READABLE}) r on r.user_id = q.user_id and r.library = i.library)
  select query, place, library, item_key from m where place <= 25""")
def search_index(t: Tables) -> DataFrame:
    """Many queries at once, each over the libraries that its user may read."""
    shelf = Shelf(t.spark, "search")
    items = t.sql(SHELVED).select("library", "item_key", "title", F.array("first_creator", "second_creator").alias("creators"))
    postings, n = S.index(items)
    return S.search(t.sql(ASKED), shelf.put(postings, "postings"), shelf.put(n, "frequencies"), t.sql(READABLE))


LEDGER = "select distinct binding_id, identifier from {v_ingest_events} where event_id % 3 = 0"


@query("anti_ledger", f"select binding_id, identifier, min(event_id) as event_id from {{v_ingest_events}} e where not exists (select 1 from ({LEDGER}) l where l.binding_id = e.binding_id and l.identifier = e.identifier) group by binding_id, identifier")
def anti_ledger(t: Tables) -> DataFrame:
    """Requests whose identifier the binding hasn't taken in yet, once each."""
    fresh = t("v_ingest_events").join(t.sql(LEDGER), ["binding_id", "identifier"], "left_anti")
    return fresh.groupBy("binding_id", "identifier").agg(F.min("event_id").alias("event_id"))


@query("sink_ledger", "select binding_id, identifier, event_id from (select *, row_number() over (partition by binding_id, identifier order by event_id % 2, event_id) as k from {v_ingest_events}) x where k = 1")
def sink_ledger(t: Tables) -> DataFrame:
    """The ledger after two calls, the requests with even numbers and those with odd ones: each takes the places that are still free."""
    ledger = A.Ledger(t.spark, Shelf(t.spark, "sink").root)
    requests = t("v_ingest_events").select("binding_id", "identifier", c("binding_id").alias("plan_id"), c("event_id").alias("pos"))
    for half in (0, 1):
        ledger.enter(requests.where(c("pos") % 2 == half))
    return ledger.rows().select("binding_id", "identifier", c("pos").alias("event_id"))


OUT = "select event_id, user_id as plan_id, event_type, case event_id % 5 when 0 then 'present' when 1 then 'new' when 2 then 'ambiguous' when 3 then 'unresolved' else 'invalid' end as outcome, event_id % 10 = 0 as in_plan, event_id % 2 = 0 as force from {events}"
# Present rows that are to be filed into a collection, and rows that the library refuses when they are written.
FILED = OUT.replace(" from {events}", ", event_id % 3 = 0 as file_into, case when event_id % 7 = 0 then 'refused' end as error from {events}")
INTO = "outcome = 'present' and file_into and not in_plan"
WHY = "case when outcome = 'present' and in_plan then 'earlier in this plan' when outcome = 'present' then 'already there' when outcome = 'unresolved' then 'nothing resolved it' when outcome = 'invalid' then 'its metadata does not fit' when outcome = 'ambiguous' and not force then 'not decided' end"


@query("flt_applicable", f"select event_id, {WHY} as why from ({OUT}) o")
def flt_applicable(t: Tables) -> DataFrame:
    return t.sql(OUT).select("event_id", skip_reason(c("outcome"), c("in_plan"), c("force")).alias("why"))


@query("plan_counts", f"select plan_id, outcome, count(*) as n, count(*) filter ({INTO}) as to_file from ({FILED}) o group by rollup(plan_id, outcome)")
def plan_counts(t: Tables) -> DataFrame:
    """Rows per outcome, and how many of them are to be filed; with totals by plan and of all."""
    filed = is_filed(c("outcome"), c("in_plan"), c("file_into"))
    return t.sql(FILED).rollup(c("plan_id"), c("outcome").alias("result")).agg(F.count("*").alias("n"), F.count_if(filed).alias("to_file")).withColumnRenamed("result", "outcome")


_LISTS = ", ".join(f"string_agg(shown, ',' order by event_id) filter (part = '{p}') as {p}" for p in ("added", "filed", "skipped", "failed"))


@query("apply_report", f"""select plan_id, {_LISTS} from (select *, event_id || case part when 'skipped' then ': ' || why when 'failed' then ': ' || error else '' end as shown
  from (select *, case when not ({INTO}) and why is not null then 'skipped' when error is not null then 'failed' when {INTO} then 'filed' else 'added' end as part from (select *, {WHY} as why from ({FILED}) o) x) y) z group by plan_id""")
def apply_report(t: Tables) -> DataFrame:
    """What became of each plan's rows: added, filed into a collection, skipped and failed, the last two with their reason; null where there is none."""
    why, filed = skip_reason(c("outcome"), c("in_plan"), c("force")), is_filed(c("outcome"), c("in_plan"), c("file_into"))
    part = F.when(~filed & why.isNotNull(), "skipped").when(c("error").isNotNull(), "failed").when(filed, "filed").otherwise("added")
    reason = F.when(part == "skipped", why).when(part == "failed", c("error"))
    rows = t.sql(FILED).select("plan_id", part.alias("part"), F.struct("event_id", F.concat_ws(": ", c("event_id").cast("string"), reason).alias("shown")).alias("row"))
    told = lambda p: C.null_if_empty(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c("part") == p, c("row")))), lambda r: r["shown"]), ",")).alias(p)
    return rows.groupBy("plan_id").agg(*(told(p) for p in ("added", "filed", "skipped", "failed")))


@query("flt_irrelevant", "select conv_id, turn, case when turn % 4 = 3 then 'irrelevant' when coalesce(trim(text), '') = '' then 'no passages' end as refused from {conversations}")
def flt_irrelevant(t: Tables) -> DataFrame:
    verdict = F.when(c("turn") % 4 == 3, "irrelevant").otherwise("supports")
    return t("conversations").select("conv_id", "turn", F.when(verdict == "irrelevant", "irrelevant").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no passages").alias("refused"))
