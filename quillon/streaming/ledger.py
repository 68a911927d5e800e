"""Stateful behaviour of ingestion as Structured Streaming: at-most-once ledgers, plans that apply once, edits guarded by versions.

The ledger is a table: each micro-batch is deduplicated, the identifiers that the ledger holds are taken out by an anti-join, and the
rest is written under the batch's number. A batch that is run again after a failure overwrites its own folder and so changes
nothing. The table is the authority, so no watermark forgets an identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shelf import committed

c = F.col


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there now, one micro-batch after the other."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _held(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What earlier batches wrote; the batch's own folder of a failed attempt isn't read."""
    number = lambda folder: int(folder.rpartition("batch=")[2])
    there = [x for x in committed(spark, path) if number(x) < before]
    schema = schema.removesuffix(", batch long")
    return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)


LEDGER = "binding_id long, identifier string, event_id long, batch long"


def deduplicated(stream: DataFrame, time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """The stream without repeats within `delay`; its state holds the identifiers of that time only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["binding_id", "identifier"])


def into_ledger(stream: DataFrame, path: str, checkpoint: str, time: str | None = None, delay: str = "1 hour") -> None:
    """Requests (binding_id, identifier, event_id): each binding's identifier enters once, by the first request of its batch.

    With a column of times, repeats within `delay` are dropped in the stream, whose state is bounded by it, before the ledger is asked. Rows
    older than the watermark, which the stream would lose, come past it on a branch of their own, so they enter if the ledger hasn't them.
    """

    def each(rows: DataFrame, number: int) -> None:
        first = rows.groupBy("binding_id", "identifier").agg(F.min("event_id").alias("event_id"))
        held = _held(rows.sparkSession, path, LEDGER, number).select("binding_id", "identifier")
        first.join(held, ["binding_id", "identifier"], "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    if time is None:
        return drain(stream, each, checkpoint)
    newest = f"{path}-newest"

    def split(rows: DataFrame, number: int) -> None:
        """Rows that passed the stream's state, and of the others those that are older than what earlier batches have seen at the latest, less the delay."""
        spark, last = rows.sparkSession, "newest timestamp"
        seen = _held(spark, newest, f"{last}, batch long", number).agg(F.max("newest").alias("newest")).first()["newest"]
        rows = rows.persist()
        try:
            rows.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{newest}/batch={number}")
            late = c(time) < F.lit(seen) - F.expr(f"interval {delay}") if seen is not None else F.lit(False)
            each(rows.where(c("kept") | late), number)
        finally:
            rows.unpersist()

    columns = ["binding_id", "identifier", "event_id", time]
    kept = deduplicated(stream.select(*columns), time, delay).withColumn("kept", F.lit(True))
    return drain(kept.union(stream.select(*columns).withColumn("kept", F.lit(False))), split, checkpoint)


APPLIED = "plan_id long, rows long, applied_at timestamp, batch long"


def apply_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Plan rows (plan_id, event_id): a plan is applied by the first batch that has it, which records the time; what comes later of it is refused."""

    def each(rows: DataFrame, number: int) -> None:
        plans = rows.groupBy("plan_id").agg(F.count("*").alias("rows"), F.current_timestamp().alias("applied_at"))
        held = _held(rows.sparkSession, path, APPLIED, number).select("plan_id")
        plans.join(held, "plan_id", "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(stream, each, checkpoint)
