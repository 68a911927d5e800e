"""Queries of the streams, each drained over the events in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.shelf import Shelf
from ..sources.views import Tables
from ..streaming import ledger as L
from ..streaming import versions as V
from ..operators import apply as A
from ..operators.apply import skip_reason
from .scopes import FILED, INTO, OUT, WHY

c = F.col


def _stream(t: Tables, shelf: Shelf, rows: DataFrame) -> DataFrame:
    """A table as a stream of four files, a micro-batch each."""
    held = shelf.put(rows.repartition(4, "event_id"), "source")
    return t.spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(f"{shelf.root}/source")


@query("stream_ledger", "select binding_id, identifier, count(*) as times from (select distinct binding_id, identifier from {v_ingest_events}) x group by binding_id, identifier")
def stream_ledger(t: Tables) -> DataFrame:
    shelf = Shelf(t.spark, "ledger")
    stream = _stream(t, shelf, t("v_ingest_events").select("binding_id", "identifier", "event_id"))
    L.into_ledger(stream, f"{shelf.root}/ledger", f"{shelf.root}/progress")
    return t.spark.read.schema(L.LEDGER).parquet(f"{shelf.root}/ledger").groupBy("binding_id", "identifier").agg(F.count("*").alias("times"))


@query("stream_ledger_late", "select binding_id, identifier, 1::bigint as times from (select distinct binding_id, identifier from {v_ingest_events}) x")
def stream_ledger_late(t: Tables) -> DataFrame:
    """The same with bounded state: repeats within an hour are dropped in the stream; later repeats, and rows that come later than the
    watermark, meet the ledger. Batches come by event_id % 4, so most rows of the last three are late."""
    shelf = Shelf(t.spark, "late")
    rows, source = t("v_ingest_events").withColumn("created_at", c("created_at").cast("timestamp")), f"{shelf.root}/source"
    for batch in range(4):
        rows.where(c("event_id") % 4 == batch).coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    L.into_ledger(stream, f"{shelf.root}/ledger", f"{shelf.root}/progress", "created_at")
    return t.spark.read.schema(L.LEDGER).parquet(f"{shelf.root}/ledger").groupBy("binding_id", "identifier").agg(F.count("*").alias("times"))


@query("stream_apply_once", "select user_id as plan_id, 1::bigint as applied from {events} group by user_id")
def stream_apply_once(t: Tables) -> DataFrame:
    shelf = Shelf(t.spark, "apply")
    stream = _stream(t, shelf, t("events").select(c("user_id").alias("plan_id"), "event_id"))
    L.apply_once(stream, f"{shelf.root}/applied", f"{shelf.root}/progress")
    return t.spark.read.schema(L.APPLIED).parquet(f"{shelf.root}/applied").groupBy("plan_id").agg(F.count("*").alias("applied"))


# Edits come in four batches by event_id % 4; each reads its item's first version, or one that an edit before it may have made.
EDITS = "select event_id, 'K' || lpad(cast(user_id as string), 7, '0') as item_key, 1 + user_id % 9 + case when event_id % 3 = 0 then 0 else (event_id div 4) % 3 end as read_version from {events}"


@query("stream_version_guard", f"""with recursive edits as (select e.*, i.version, row_number() over (partition by e.item_key order by event_id % 4, event_id) as n from ({EDITS.replace(" div ", " // ").replace("as string", "as varchar")}) e left join {{v_items}} i on i.item_key = e.item_key),
walk as (select event_id, item_key, n, case when version is null then 'refused' when read_version = version then 'filed' else 'failed' end as outcome, version + case when read_version = version then 1 else 0 end as version from edits where n = 1
  union all select e.event_id, e.item_key, e.n, case when w.version is null then 'refused' when e.read_version = w.version then 'filed' else 'failed' end, w.version + case when e.read_version = w.version then 1 else 0 end from walk w join edits e on e.item_key = w.item_key and e.n = w.n + 1)
select event_id, item_key, outcome, version, outcome <> 'filed' as conflict from walk""")
def stream_version_guard(t: Tables) -> DataFrame:
    """Filed edits and conflicts of the whole stream, which is stopped and started anew after its first half."""
    shelf = Shelf(t.spark, "guard")
    edits, items = t.sql(EDITS), shelf.put(t("v_items").select("item_key", "version"), "items")
    source = f"{shelf.root}/source"
    stream = lambda: t.spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for batch in range(4):
        edits.where(c("event_id") % 4 == batch).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(source)
        if batch % 2:
            V.file_edits(stream(), items, f"{shelf.root}/out", f"{shelf.root}/progress")
    read = lambda part: t.spark.read.schema(V.OUTCOMES).parquet(*(f"{shelf.root}/out/{part}/batch={k}" for k in range(4)))
    return read("filed").withColumn("conflict", F.lit(False)).union(read("conflicts").withColumn("conflict", F.lit(True)))


PLAN = "select event_id, user_id as batch_id, event_type as outcome, props as payload from {events}"


@query("sink_plan", "select batch_id, outcome, count(*) as n from (" + PLAN + ") p group by batch_id, outcome")
def sink_plan(t: Tables) -> DataFrame:
    """Plan rows are persisted, partitioned by outcome, before anything is applied; what is applied is what was stored."""
    shelf = Shelf(t.spark, "stored")
    rows = t.sql(PLAN)
    rows.write.partitionBy("outcome").parquet(f"{shelf.root}/plan")
    return t.spark.read.schema(rows.schema).parquet(f"{shelf.root}/plan").groupBy("batch_id", "outcome").agg(F.count("*").alias("n"))


@query("src_plan", "select event_id, user_id as batch_id, case when event_id % 2 = 0 then event_type end as outcome, case when event_id % 2 = 1 then props end as note from {events}")
def src_plan(t: Tables) -> DataFrame:
    """Stored plans of an older and a newer field set, read as one: a field that a plan lacks is null, one that is no longer known is left out."""
    shelf = Shelf(t.spark, "plans")
    old = shelf.put(t("events").where("event_id % 2 = 0").select("event_id", c("user_id").alias("batch_id"), c("event_type").alias("outcome"), F.lit("x").alias("gone")), "old")
    new = shelf.put(t("events").where("event_id % 2 = 1").select("event_id", c("user_id").alias("batch_id"), c("props").alias("note")), "new")
    return old.drop("gone").unionByName(new, allowMissingColumns=True)


PLANNED = OUT.replace(" from {events}", ", event_type || ':' || props as identifier from {events}")
WRITTEN = "plan_id long, identifier string, call int"


def _apply(plan: DataFrame, path: str, call: int) -> None:
    """Applicable rows of a stored plan that no earlier call has written, once per plan and identifier."""
    rows = plan.where(skip_reason(c("outcome"), c("in_plan"), c("force")).isNull()).select("plan_id", "identifier").distinct()
    if call > 1:
        held = plan.sparkSession.read.schema(WRITTEN).option("basePath", path).parquet(*(f"{path}/call={k}" for k in range(1, call)))
        rows = rows.alias("r").join(held.alias("h"), F.expr("r.plan_id <=> h.plan_id and r.identifier <=> h.identifier"), "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/call={call}")


@query("plan_apply", "select user_id as binding_id, count(distinct event_type || ':' || props) as written from {events} group by user_id")
def plan_apply(t: Tables) -> DataFrame:
    """A plan that takes all events as new rows: each is written once per binding and identifier, and the stored plan, applied again, adds nothing."""
    shelf = Shelf(t.spark, "applied")
    rows = t("v_ingest_events").select(c("binding_id").alias("plan_id"), "identifier", F.lit("new").alias("outcome"), F.lit(False).alias("in_plan"), F.lit(False).alias("force"))
    plan, path = shelf.put(rows, "plan"), f"{shelf.root}/ledger"
    for call in (1, 2):
        _apply(plan, path, call)
    return t.spark.read.schema(WRITTEN).parquet(path).groupBy(c("plan_id").alias("binding_id")).agg(F.count("*").alias("written"))


@query("plan_apply_all", f"select plan_id as binding_id, count(*) as written, 0::bigint as again from (select distinct plan_id, identifier from ({PLANNED}) o where {WHY} is null) x group by plan_id")
def plan_apply_all(t: Tables) -> DataFrame:
    """All events as a stored plan, applied twice against the ledger that was written: rows of the first call and of the second."""
    shelf = Shelf(t.spark, "applied")
    plan, path = shelf.put(t.sql(PLANNED), "plan"), f"{shelf.root}/ledger"
    for call in (1, 2):
        _apply(plan, path, call)
    rows = t.spark.read.schema(WRITTEN).parquet(path)
    return rows.groupBy(c("plan_id").alias("binding_id")).agg(F.count_if(c("call") == 1).alias("written"), F.count_if(c("call") == 2).alias("again"))


# Every third plan comes again in a second call; of a plan's rows with one identifier the first takes its place.
_PARTS = f"""select plan_id, 1 as call, case when {INTO} and error is not null then 'failed' when {INTO} then 'filed' when {WHY} is not null then 'skipped' when line > 1 then 'skipped' when error is not null then 'failed' else 'added' end as part
  from (select *, case when {WHY} is null and not ({INTO}) then row_number() over (partition by plan_id, event_type || ':' || props, {WHY} is null and not ({INTO}) order by event_id) end as line from ({FILED.replace(" from {events}", ", props from {events}")}) f) x"""


@query("plan_apply_ledger", f"""with first as ({_PARTS}) select plan_id, call, part, count(*) as n from (select * from first union all select plan_id, 2, 'refused' from first where plan_id % 3 = 0) y group by all
  union all select plan_id, 3, 'open', count(*) from (select plan_id, error, row_number() over (partition by plan_id, event_type || ':' || props order by event_id) as line from ({FILED.replace(" from {events}", ", props from {events}")}) f where {WHY} is null and not ({INTO})) z
  where line = 1 and error is not null group by plan_id""")
def plan_apply_ledger(t: Tables) -> DataFrame:
    """Stored plans over the write-ahead ledger: what became of the rows of two calls, and the ledger's rows without a key afterwards."""
    shelf = Shelf(t.spark, "write-ahead")
    rows = t.sql(FILED.replace(" from {events}", ", event_type || ':' || props as identifier from {events}"))
    plans = shelf.put(rows.select("plan_id", c("plan_id").alias("binding_id"), c("event_id").alias("pos"), "identifier", "outcome", "in_plan", "force", "file_into", "error"), "plans")
    ledger = A.Ledger(t.spark, f"{shelf.root}/ledger")
    told = [shelf.put(A.apply(p, ledger), f"told{k}").withColumn("call", F.lit(k)) for k, p in ((1, plans), (2, plans.where("plan_id % 3 = 0")))]
    left = ledger.open().select("plan_id", F.lit(3).alias("call"), F.lit("open").alias("part"))
    both = told[0].union(told[1]).select("plan_id", "call", "part")
    return both.union(left).groupBy("plan_id", "call", "part").agg(F.count("*").alias("n"))
