"""Applying stored plans over a write-ahead ledger.

A row's place in the ledger is taken before the row is written: first the intents of a call are committed (binding and identifier, no
key), then the items are written, then the keys that came back are committed beside the intents, last the plans' `applied_at`. What a
call leaves behind when it dies between two of these steps is a row without a key: work to reconcile, never a second item. A row that the
library refuses stays in the ledger without a key too. A plan that has been applied is refused as a whole.

Each call writes folders of its own, which count once they are complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shelf import committed

c = F.col
INTENTS = "binding_id long, identifier string, plan_id long, pos long"
KEYS = "binding_id long, identifier string, item_key string, error string"
APPLIED = "plan_id long, applied_at timestamp"


def skip_reason(outcome: Column, in_plan: Column, force: Column) -> Column:
    """Why a planned row isn't written, null if it is."""
    return (
        F.when((outcome == "present") & in_plan, "earlier in this plan").when(outcome == "present", "already there").when(outcome == "unresolved", "nothing resolved it")
        .when(outcome == "invalid", "its metadata does not fit").when((outcome == "ambiguous") & ~force, "not decided")
    )


def is_filed(outcome: Column, in_plan: Column, file_into: Column) -> Column:
    """Whether a row edits the membership of an item that was there before the plan."""
    return (outcome == "present") & file_into & ~in_plan


class Ledger:
    """The ledger's folders below one path: `intents`, `keys` and `applied`, a folder for each call in each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame:
        calls = committed(self.spark, f"{self.path}/{part}")
        return self.spark.read.schema(schema).parquet(*calls) if calls else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, part: str, call: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/call={call}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{part}/call={call}")

    def call(self) -> int:
        """The number of the next call."""
        return 1 + max((int(x.rpartition("=")[2]) for x in committed(self.spark, f"{self.path}/intents")), default=-1)

    def rows(self) -> DataFrame:
        """(binding_id, identifier, plan_id, pos, item_key, error): all that has been taken, with the key of what has been written."""
        return self._read("intents", INTENTS).join(self._read("keys", KEYS), ["binding_id", "identifier"], "left")

    def open(self) -> DataFrame:
        """Rows to reconcile: taken, and not known to be written."""
        return self.rows().where("item_key is null")

    def applied(self) -> DataFrame:
        return self._read("applied", APPLIED)

    def enter(self, rows: DataFrame, call: int | None = None) -> DataFrame:
        """Take the places of rows (binding_id, identifier, plan_id, pos) that no earlier call has; of several with one identifier the first by pos."""
        line = F.row_number().over(Window.partitionBy("binding_id", "identifier").orderBy("pos"))
        first = rows.withColumn("line", line).where("line = 1").select("binding_id", "identifier", "plan_id", "pos")
        held = self._read("intents", INTENTS).select("binding_id", "identifier")
        return self._write(first.join(held, ["binding_id", "identifier"], "left_anti").select(*(x.split()[0] for x in INTENTS.split(", "))), "intents", self.call() if call is None else call)


def created(rows: DataFrame) -> DataFrame:
    """A library that takes every row without an `error` and names the item after its place."""
    key = F.concat(F.lit("N"), C.occurrence_id(c("binding_id"), c("identifier")))
    return rows.select("binding_id", "identifier", F.when(c("error").isNull(), key).alias("item_key"), "error")


def apply(plans: DataFrame, ledger: Ledger, write: Callable[[DataFrame], DataFrame] = created) -> DataFrame:
    """Apply plan rows (plan_id, binding_id, pos, identifier, outcome, in_plan, force, file_into, error): (plan_id, pos, identifier, part, reason).

    Parts: refused (the plan has been applied), filed (an item that is there is put into the plan's collection), skipped, failed, added. `write`
    gets the rows that are to be written and returns (binding_id, identifier, item_key, error), a null key for what the library refused.
    """
    call = ledger.call()
    before = ledger.applied().select("plan_id", F.lit(True).alias("again"))
    rows = plans.join(before, "plan_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    filed = is_filed(c("outcome"), c("in_plan"), c("file_into"))
    why = skip_reason(c("outcome"), c("in_plan"), c("force"))
    rows = rows.withColumn("part", F.when(c("again"), "refused").when(filed & c("error").isNotNull(), "failed").when(filed, "filed").when(why.isNotNull(), "skipped"))
    rows = rows.withColumn("reason", F.when(c("again"), "the plan was applied before").when(c("part") == "failed", c("error")).when(c("part") == "skipped", why))
    fresh = rows.where("part is null")
    taken = ledger.enter(fresh, call)
    mine = fresh.join(taken, ["binding_id", "identifier", "plan_id", "pos"], "left_semi")
    keys = ledger._write(write(mine), "keys", call)
    ledger._write(rows.where(~c("again")).select("plan_id").distinct().withColumn("applied_at", F.current_timestamp()), "applied", call)
    ours = taken.join(keys, ["binding_id", "identifier"], "left").select("plan_id", "pos", F.lit(True).alias("ours"), "item_key", c("error").alias("refusal"))
    told = rows.join(ours, ["plan_id", "pos"], "left")
    part = F.coalesce(c("part"), F.when(c("ours").isNull(), "skipped").when(c("item_key").isNull(), "failed").otherwise("added"))
    reason = F.when(c("part").isNotNull(), c("reason")).when(c("ours").isNull(), "already ingested into this binding").when(c("item_key").isNull(), F.coalesce("refusal", F.lit("no key came back")))
    return told.select("plan_id", "pos", "identifier", part.alias("part"), reason.alias("reason"))
