"""Progress of running tasks, counted and in order, and saves that coalesce: of what comes close together only the newest state per account is committed.

What keeps state over micro-batches needs a state store with several columns: spark.sql.streaming.stateStore.providerClass set to RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyforge.sources.workspace import Workspace


def progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(task, at, image, state) of a stream -> per task and minute the images that completed, failed or were cancelled; repeats of an event count once."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1))
    once = events.withWatermark("at", late).dropDuplicates(["task", "image", "state", "at"])
    return once.groupBy("task", F.window("at", "1 minute")).agg(n("completed").alias("completed"), n("failed").alias("failed"), n("cancelled").alias("cancelled"))


class _InOrder(StatefulProcessor):
    """Events of a task that came before their turn wait in state; those whose turn has passed are repeats."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, completed long, errors long")
        self.waiting = handle.getMapState("waiting", "image long", "state string, detail string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, completed, errors = self.at.get() if self.at.exists() else (1, 0, 0)
        for f in rows:
            for image, state, detail in zip(f["image"], f["state"], f["detail"]):
                if image >= turn and not self.waiting.containsKey((int(image),)):
                    self.waiting.updateValue((int(image),), (state, detail))
        out = []
        while self.waiting.containsKey((turn,)):
            state, detail = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            completed, errors = completed + (state == "completed"), errors + (state == "failed")
            out.append((key[0], turn, state, detail, completed, errors))
            turn += 1
        self.at.update((turn, completed, errors))
        yield pd.DataFrame(out, columns=["task", "image", "state", "detail", "completed", "errors"])

    def close(self) -> None:
        pass


def in_order(events: DataFrame) -> DataFrame:
    """(task, image, state, detail) of a stream, image from 1 -> the same per task in the order of images, each once, with how many have completed and failed so far.

    An event waits until all before it have come, in whatever order and micro-batch they do; events of a null task or image are left out.
    """
    e = events.selectExpr("cast(task as string) task", "cast(image as long) image", "state", "detail").where("task is not null and image is not null")
    return e.groupBy("task").transformWithStateInPandas(_InOrder(), "task string, image long, state string, detail string, completed long, errors long", "Append", "None")


class _Coalesced(StatefulProcessor):
    """The newest state of an account, given out when `pause` milliseconds have gone since the first that wasn't."""

    def __init__(self, pause: int, columns: list[str], schema: str):
        self.pause, self.columns, self.schema = pause, columns, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.newest.get() if self.newest.exists() else None
        at = self.columns.index("revision")
        if best is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.pause)
        for f in rows:
            for row in f[self.columns].itertuples(index=False, name=None):
                if best is None or row[at] > best[at]:
                    best = row
        self.newest.update(tuple(None if x is None or x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in best))
        yield pd.DataFrame(columns=["account_id", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame([(key[0], *best)], columns=["account_id", *self.columns])

    def close(self) -> None:
        pass


def coalesced(states: DataFrame, pause: int = 200) -> DataFrame:
    """(account_id string, revision long, ...) of a stream -> the newest state of each account, `pause` milliseconds after the first that it stands for."""
    rest = [f for f in states.schema if f.name != "account_id"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    s = states.where("account_id is not null and revision is not null").select("account_id", *[f.name for f in rest])
    return s.groupBy("account_id").transformWithStateInPandas(_Coalesced(pause, [f.name for f in rest], schema), f"account_id string, {schema}", "Append", "ProcessingTime")


def merged(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Current rows with those of the batch whose revision is newer; older ones are void."""
    rest = [c for c in batch.columns if c != "account_id"]
    both = batch if current is None else batch.unionByName(current.select(*batch.columns))
    t = both.groupBy("account_id").agg(F.max_by(F.struct(*rest), "revision").alias("t"))
    return t.select("account_id", *[F.col(f"t.{c}").alias(c) for c in rest])


def save(workspace: Workspace, table: str, batch: DataFrame, source: str, number: int) -> int:
    """Commit a micro-batch's newest states (those without an account or a revision are left out): accounts that the table knows at that revision or a later one, and all other tables and accounts, stay as they are.

    The batch's number is kept with each account, so a replayed batch changes nothing; a commit of someone else in between is no fault, the save is made again on top of it.
    """
    newest = merged(None, batch.where("account_id is not null and revision is not null"))

    def tables() -> dict[str, DataFrame]:
        if table not in workspace.tables():
            return {table: newest}
        old = workspace.table(table).select("account_id", F.col("revision").alias("_had"))
        return {table: newest.join(old, "account_id", "left").where("_had is null or revision > _had").drop("_had")}

    return workspace.commit_accounts(tables, source, number)


def autosave(states: DataFrame, workspace: Workspace, table: str, checkpoint: str, every: str = "200 milliseconds", once: bool = False, pause: int | None = None) -> StreamingQuery:
    """(account_id, revision, ...) of a stream: each micro-batch becomes one commit, so saves that come faster than it are one; with a pause, saves of an account within it are one as well."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(workspace, table, batch, checkpoint, number)

    quiet = states if pause is None else coalesced(states, pause)
    writer = quiet.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
