"""Edits guarded by versions: each item's version is state that a filed edit moves on.

An edit names the version that it has read. It is filed if that is still the item's version, which then goes up by one; otherwise the
item has changed since, nothing is written, and the edit goes to the conflicts. So of two edits that read one version one is filed,
whichever micro-batch they come in and whether or not the stream was started anew between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

c = F.col
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "event_id long, item_key string, outcome string, version long"


class Versions(StatefulProcessor):
    """One item's current version; an item that the first versions don't have refuses all edits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.version.update((int(initialState["version"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = int(self.version.get()[0]) if self.version.exists() else None
        before = now
        for part in rows:
            part = part.sort_values("event_id", kind="stable")
            outcome, seen = [], []
            for read in part["read_version"].tolist():
                filed = now is not None and read == now
                outcome.append("refused" if now is None else "filed" if filed else "failed")
                now = now + 1 if filed else now
                seen.append(now)
            yield pd.DataFrame({"event_id": part["event_id"].tolist(), "item_key": key[0], "outcome": outcome, "version": pd.array(seen, dtype="Int64")})
        if now != before:
            self.version.update((now,))

    def close(self) -> None:
        pass


def guard(edits: DataFrame, items: DataFrame) -> DataFrame:
    """A stream of edits (event_id, item_key, read_version) against items (item_key, version): (event_id, item_key, outcome, version).

    Outcomes: filed, failed (the item has moved on), refused (no such item); `version` is the item's after the edit. The items' versions are
    read when the stream first starts, afterwards the state has them; the state is as large as the table of items. Edits of an item
    are taken in order of event_id inside a micro-batch's chunk, the micro-batches in theirs.
    """
    first = items.select("item_key", c("version").cast("long").alias("version")).groupBy("item_key")
    rows = edits.select("event_id", "item_key", c("read_version").cast("long").alias("read_version"))
    return rows.groupBy("item_key").transformWithStateInPandas(Versions(), OUTCOMES, "Append", "None", first)


def file_edits(edits: DataFrame, items: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream of edits into two tables below `path`: `filed`, and `conflicts` for what was failed or refused.

    A micro-batch writes both under its number; run again after a failure it overwrites them, from the state before it.
    """
    spark = edits.sparkSession

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.persist()  # both tables are of one run of the guard
        try:
            rows.where("outcome = 'filed'").write.mode("overwrite").parquet(f"{path}/filed/batch={number}")
            rows.where("outcome <> 'filed'").write.mode("overwrite").parquet(f"{path}/conflicts/batch={number}")
        finally:
            rows.unpersist()

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        guard(edits, items).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
