"""Queries of collection trees, filing and views of a binding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import hierarchy as H
from ..registry import query
from ..sources.shelf import Shelf
from ..sources.views import Tables
from .reconcile import LEG

c = F.col
BELOW = "below(collection_key, name, depth) as (select collection_key, name, 0 from {v_collections} where collection_key = '%s' union all select t.collection_key, t.name, b.depth + 1 from below b join {v_collections} t on t.parent = b.collection_key)"
ITEMS = "select item_key, library, title, doi, version, page_id, [collection_key, 'R' || (page_id % 7), 'C' || (page_id * 3)] as collections from {v_items}"


def items(t: Tables) -> DataFrame:
    """Library items in several collections each."""
    held = F.array("collection_key", F.concat(F.lit("R"), c("page_id") % 7), F.concat(F.lit("C"), c("page_id") * 3))
    return t("v_items").select("item_key", "library", "title", "doi", "version", "page_id", held.alias("collections"))


def below(t: Tables, root: str = "R1") -> DataFrame:
    return H.subtree(t("v_collections"), root)


@query("subtree", """with recursive below(collection_key, name, depth, line) as (select collection_key, name, 0, [name || chr(1) || collection_key] from {v_collections} where collection_key = 'R1'
  union all select t.collection_key, t.name, b.depth + 1, list_append(b.line, t.name || chr(1) || t.collection_key) from below b join {v_collections} t on t.parent = b.collection_key)
select collection_key, name, depth, row_number() over (order by depth, line) - 1 as place from below""")
def subtree(t: Tables) -> DataFrame:
    return H.order_of(below(t)).select("collection_key", "name", "depth", "place")


# Events as a deep tree: each hangs on the one before it or on that before; a lost parent now and then.
DEEP = "select event_id as collection_key, event_type as name, case when event_id = 0 then null when event_id % 300 = 299 then -1 else event_id - 1 - case when event_id % 3 = 0 then 1 else 0 end end as parent from {events}"


@query("subtree_deep", f"with recursive tree as ({DEEP}), below as (select collection_key, 0 as depth from tree where collection_key = 0 union all select t.collection_key, b.depth + 1 from below b join tree t on t.parent = b.collection_key) select 'E' || collection_key as collection_key, depth from below")
def subtree_deep(t: Tables) -> DataFrame:
    """A tree of thousands of levels."""
    key = lambda x: F.concat(F.lit("E"), c(x).cast("string")).alias(x)
    return H.subtree(t.sql(DEEP).select(key("collection_key"), "name", key("parent")), "E0").select("collection_key", "depth")


@query("collection_counts", f"select library, k as collection_key, name, parent, count(*) as items from (select library, unnest(collections) as k from ({ITEMS}) i) x left join {{v_collections}} v on v.collection_key = k group by all")
def collection_counts(t: Tables) -> DataFrame:
    return H.counts(items(t), t("v_collections"))


@query("union_merge_by_key", f"with recursive {BELOW % 'R1'} select library, item_key, min(depth) as depth from (select library, item_key, unnest(collections) as k from ({ITEMS}) i) x join below b on b.collection_key = k group by library, item_key")
def union_merge_by_key(t: Tables) -> DataFrame:
    return H.tree_items(items(t), below(t))


@query("semi_in_binding", f"with recursive {BELOW % 'R2'} select item_key, exists (select 1 from below b where list_contains(collections, b.collection_key)) as inside from ({ITEMS}) i")
def semi_in_binding(t: Tables) -> DataFrame:
    return H.in_binding(items(t), below(t, "R2")).select("item_key", "inside")


@query("collections_names", f"with recursive {BELOW % 'R1'} select item_key, string_agg(name, '; ' order by place) as names from (select item_key, unnest(collections) as k, unnest(range(len(collections))) as place from ({ITEMS}) i) x join below b on b.collection_key = k group by item_key")
def collections_names(t: Tables) -> DataFrame:
    return H.names_of(items(t), below(t)).select("item_key", F.array_join("names", "; ").alias("names"))


WANTED = "select c_custkey as request, case c_custkey % 4 when 0 then 'N' || c_nationkey when 1 then ' ' || lower(c_name) || ' ' when 2 then c_mktsegment else 'ROOT' end as wanted from {customer}"


@query("join_target", f"""with recursive {BELOW % 'ROOT'} select request, coalesce(k.collection_key, case when n.n = 1 then n.hit end) as collection_key, case when k.collection_key is not null or n.n = 1 then null when n.n > 1 then 'several of that name' else 'none of that name' end as error
  from ({WANTED}) w left join below k on k.collection_key = trim(w.wanted) left join (select lower(trim(name)) as low, count(*) as n, min(collection_key) as hit from below group by 1) n on n.low = lower(trim(w.wanted))""")
def join_target(t: Tables) -> DataFrame:
    return H.targets(t.sql(WANTED), below(t, "ROOT"))


@query("label_index", f"with recursive {BELOW % 'R1'} select w.c_mktsegment as wanted, (select string_agg(name, '; ' order by name) from below where depth = 1) as known from (select distinct c_mktsegment from {{customer}}) w where lower(w.c_mktsegment) not in (select lower(name) from below)")
def label_index(t: Tables) -> DataFrame:
    tree = below(t)
    known = tree.where("depth = 1").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("known"))
    wanted = t("customer").select(c("c_mktsegment").alias("wanted")).distinct()
    missing = wanted.join(tree.select(F.lower("name").alias("low")), F.lower("wanted") == c("low"), "left_anti")
    return missing.join(F.broadcast(known), how="inner")  # one row of labels, put beside every miss


REQ = "select item_key, 'N' || (page_id % 4 + 5) as target, page_id % 3 = 0 as move, case when page_id % 11 = 0 then 0 else version end as version from {v_items} union all select 'X' || page_id, 'N1', false, 1 from {v_items} where page_id % 50 = 0"
FILE = f"""with recursive {BELOW % 'R1'}, cur as (select *, exists (select 1 from below b where list_contains(collections, b.collection_key)) as inside from ({ITEMS}) i),
  j as (select r.*, cur.collections, cur.version as current, cur.inside, case when list_contains(cur.collections, target) then cur.collections else list_append(cur.collections, target) end as added from ({REQ}) r left join cur on cur.item_key = r.item_key),
  a as (select *, case when move and target <> 'R1' then list_filter(added, lambda x: x <> 'R1') else added end as after from j),
  o as (select *, case when move and target = 'R1' then 'refused' when inside is null or not inside then 'refused' when after = collections then 'unchanged' when version <> current then 'failed' else 'filed' end as outcome from a)"""


@query("file_items", FILE + " select item_key, outcome, array_to_string(case when outcome = 'filed' then after else collections end, ',') as collections from o")
def file_items(t: Tables) -> DataFrame:
    return H.file_items(t.sql(REQ), items(t), below(t), "R1").withColumn("collections", F.array_join("collections", ","))


@query("join_version", "select e.event_id, case when e.value::bigint % 9 + 1 = i.version then 'filed' else 'failed' end as outcome from {events} e join {v_items} i on i.page_id = e.user_id")
def join_version(t: Tables) -> DataFrame:
    edits = t("events").select("event_id", c("user_id").alias("page_id"), (F.bround("value").cast("long") % 9 + 1).alias("v"))
    return edits.join(t("v_items").select("page_id", "version"), "page_id").select("event_id", F.when(c("v") == c("version"), "filed").otherwise("failed").alias("outcome"))


@query("plan_filing", f"""with recursive {BELOW % 'R1'}, held as (select item_key, string_agg(name, '; ' order by place) as held_in, list(b.collection_key) as ks from (select item_key, unnest(collections) as k, unnest(range(len(collections))) as place from ({ITEMS}) i) x join below b on b.collection_key = k group by item_key)
  select i.item_key, case when library <> 'groups/1' then 'other-leg' when coalesce(list_contains(ks, 'N' || (page_id % 5)), false) then 'already' when page_id % 3 <> 0 then 'file' else 'left' end as filing, case when library = 'groups/1' then coalesce(held_in, '') end as held_in from ({ITEMS}) i left join held h on h.item_key = i.item_key""")
def plan_filing(t: Tables) -> DataFrame:
    """What happens to items that are there already, and which of their collections lie in the plan's tree."""
    rows = H.filing(items(t), below(t), "groups/1", F.concat(F.lit("N"), c("page_id") % 5), c("page_id") % 3 != 0)
    return rows.select("item_key", "filing", F.array_join("held_in", "; ").alias("held_in"))


@query("plan_apply_filing", f"""with recursive {BELOW % 'R1'}, f as (select *, 'N' || (page_id % 5) as target, exists (select 1 from below b where list_contains(collections, b.collection_key)) as inside from ({ITEMS}) i
  where library = 'groups/1' and page_id % 3 <> 0 and not list_contains(collections, 'N' || (page_id % 5)))
  select item_key, case when inside then 'filed' else 'refused' end as outcome, case when inside then 'unchanged' else 'refused' end as again, array_to_string(case when inside then list_append(collections, target) else collections end, ',') as collections from f""")
def plan_apply_filing(t: Tables) -> DataFrame:
    """Rows of a plan that are to be filed edit the item's membership; the same plan against the edited items changes nothing."""
    held, tree, shelf = items(t), below(t), Shelf(t.spark, "filing")
    told = H.filing(held, below(t, "ROOT"), "groups/1", F.concat(F.lit("N"), c("page_id") % 5), c("page_id") % 3 != 0).where("filing = 'file'")
    plan = shelf.put(told.select("item_key", F.concat(F.lit("N"), c("page_id") % 5).alias("target"), F.lit(False).alias("move"), "version"), "plan")
    first = shelf.put(H.file_items(plan, held, tree, "R1"), "first")
    edited = held.join(first.select("item_key", c("collections").alias("edited")), "item_key", "left").withColumn("collections", F.coalesce("edited", "collections")).drop("edited")
    second = H.file_items(plan, edited, tree, "R1").select("item_key", c("outcome").alias("again"))
    return first.join(second, "item_key").select("item_key", "outcome", "again", F.array_join("collections", ",").alias("collections"))


@query("collection_view", f"""with recursive {BELOW % 'R1'}, i as ({ITEMS}), tree as (select distinct library, item_key from (select library, item_key, unnest(collections) as k from i) x where k in (select collection_key from below)),
  named as (select item_key, string_agg(name, '; ' order by place) as chapters from (select item_key, unnest(collections) as k, unnest(range(len(collections))) as place from i) x join below b on b.collection_key = k group by item_key),
  sigs as (select item_key, library, {LEG} as sig from i), src as (select sig, max(item_key) as cite from sigs where library = 'groups/2' group by sig)
  select t.item_key, t.library, n.chapters, s.cite from tree t join sigs g on g.item_key = t.item_key left join named n on n.item_key = t.item_key left join src s on s.sig = g.sig and t.library = 'groups/1'""")
def collection_view(t: Tables) -> DataFrame:
    """A binding's items once each with their chapters, and for those that the source leg (groups/2) holds too, the copy to cite."""
    every, tree = items(t), below(t)
    sigs = every.select("item_key", "library", C.leg_signature(c("doi"), c("title"), F.lit(None).cast("string")).alias("sig"))
    source = sigs.where("library = 'groups/2'").groupBy("sig").agg(F.max("item_key").alias("cite"))
    names = H.names_of(every, tree).select("item_key", F.array_join("names", "; ").alias("chapters"))
    rows = H.tree_items(every, tree).select("library", "item_key").join(sigs.drop("library"), "item_key").join(names, "item_key", "left").join(source, "sig", "left")
    return rows.select("item_key", "library", "chapters", F.when(c("library") == "groups/1", c("cite")).alias("cite"))


@query("limit_items", "select item_key, library from (select item_key, library, page_id from {v_items} order by page_id limit 100) x")
def limit_items(t: Tables) -> DataFrame:
    return t("v_items").orderBy("page_id").limit(100).select("item_key", "library")


@query("sort_recent", "select event_id, row_number() over (order by ts desc, event_id) as place from {events}")
def sort_recent(t: Tables) -> DataFrame:
    """Latest first, with the place."""
    rows = H.numbered(t("events").select("event_id", "ts"), c("ts").desc(), c("event_id"))
    return rows.select("event_id", (c("place") + 1).alias("place"))


@query("except_keys", "select p_partkey, array_to_string(list_sort(list_filter(string_split(p_name || ' ' || lower(p_brand), ' '), lambda w: w not in ('red', 'blue', 'old', 'new'))), ' ') as rest from {part}")
def except_keys(t: Tables) -> DataFrame:
    rest = F.filter(F.split(F.concat("p_name", F.lit(" "), F.lower("p_brand")), " "), lambda w: ~w.isin("red", "blue", "old", "new"))
    return t("part").select("p_partkey", F.array_join(F.array_sort(rest), " ").alias("rest"))


@query("intersect_tokens", "select a.page_id, len(list_intersect(string_split(lower(a.title), ' '), string_split(lower(b.title), ' '))) as common from {v_items} a join {v_items} b on b.page_id = a.page_id + 2")
def intersect_tokens(t: Tables) -> DataFrame:
    words = F.split(F.lower("title"), " ")
    a, b = t("v_items").select("page_id", words.alias("x")), t("v_items").select((c("page_id") - 2).alias("page_id"), words.alias("y"))
    return a.join(b, "page_id").select("page_id", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
