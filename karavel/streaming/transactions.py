"""Whole transactions from a stream whose batches end anywhere."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from karavel.functions.sized import settle
from karavel.operators.changes import COMMIT, ErrorPolicy
from karavel.sources.files import delete, finished
from karavel.streaming.follow import FollowedTable, staged, stream_name

ROLLBACK = "R"
OPEN = "seq bigint, xid bigint, held string, rows bigint, first_pos decimal(20,0)"


@dataclass(frozen=True)
class ApplySettings:
    """How changes are put into batches: whole transactions or not, seconds between two batches, and megabytes of a batch."""

    preserve_transactions: bool = True
    seconds: int = 1
    megabytes: int | None = None

    @classmethod
    def of(cls, tuning: Mapping[str, object]) -> ApplySettings:
        """From the change tuning of a task: a batch waits for the least time, and is cut at the memory limit (0: none)."""
        limit = int(tuning.get("BatchApplyMemoryLimit", 0))
        return cls(bool(tuning.get("BatchApplyPreserveTransaction", True)), int(tuning.get("BatchApplyTimeoutMin", 1)), limit or None)

    def reader_options(self) -> dict[str, str]:
        """Options of the stream's file source."""
        return {"maxBytesPerTrigger": f"{self.megabytes}m"} if self.megabytes else {}

    def trigger(self) -> dict[str, str]:
        return {"processingTime": f"{self.seconds} seconds"}


class OpenTransactions:
    """Changes of transactions that have not ended yet, below ``path``; files have to come in log order.

    The changes of a batch whose transactions stay open are written once to a folder of the batch and never moved; what a batch passes on is
    a list of open transactions with the folders that hold parts of them. When the end comes, only the folders of
    the ended ones are read, spread over all tasks whatever the size of a transaction. A batch that is
    tried again starts from the list that the last committed batch left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _list(self, committed: set[str]) -> tuple[int, DataFrame]:
        known = [n for n in finished(self.spark, f"{self.path}/open") if n in committed]
        if not known:
            return 0, self.spark.createDataFrame([], OPEN)
        rows = self.spark.read.schema(OPEN).parquet(*[f"{self.path}/open/{n}" for n in known])
        seq = rows.agg(F.max("seq")).first()[0]
        return seq, rows.filter(F.col("seq") == seq)

    def open(self, committed: set[str]) -> DataFrame:
        """One row per open transaction and folder: xid, rows held there, first position."""
        return self._list(committed)[1].filter("xid is not null").select("xid", "held", "rows", "first_pos")

    def release(self, changes: DataFrame, name: str, committed: set[str]) -> DataFrame:
        """The changes of all transactions that end in this batch; the others wait. Changes without an xid pass at once.

        ``changes`` has ``xid, pos, op``; a row with op ``C`` ends its transaction, one with ``R`` takes it back. ``committed``: batches
        that were applied.
        """
        changes = staged(changes, "batch")
        columns, is_end = changes.columns, F.col("op").isin(COMMIT, ROLLBACK)
        ends, _ = settle(changes.filter(is_end).groupBy("xid").agg(F.max(F.col("op") == COMMIT).alias("__done")), "ended")
        seq, before = self._list(committed)
        before = before.filter("xid is not null")
        rows = changes.filter(~is_end)
        marked = rows.join(ends, "xid", "left").select(*columns, "__done")
        waits = marked.filter("xid is not null and __done is null").select(*columns)
        waits.write.mode("overwrite").parquet(f"{self.path}/held/{name}")
        held = self.spark.read.schema(changes.schema).parquet(f"{self.path}/held/{name}")
        added = held.groupBy("xid").agg(F.count("*").alias("rows"), F.min("pos").cast("decimal(20,0)").alias("first_pos")).withColumn("held", F.lit(name))
        left = before.join(ends, "xid", "left_anti").unionByName(added, allowMissingColumns=True)
        mark = self.spark.range(1).select(F.lit(seq + 1).cast("bigint").alias("seq"))  # there even if nothing is open
        state = mark.unionByName(left.withColumn("seq", F.lit(seq + 1).cast("bigint")), allowMissingColumns=True)
        state.select(*[c.split()[0] for c in OPEN.split(", ", 4)]).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/open/{name}")
        out = marked.filter("xid is null or __done").select(*columns)
        folders = [r["held"] for r in before.join(ends.filter("__done"), "xid", "left_semi").select("held").distinct().collect()]  # names
        if folders:
            earlier = self.spark.read.schema(changes.schema).parquet(*[f"{self.path}/held/{n}" for n in sorted(folders)])
            out = out.unionByName(earlier.join(ends.filter("__done"), "xid", "left_semi").select(*columns))
        return out

    def prune(self, committed: set[str]) -> None:
        """Delete lists that a later one replaces, and folders that hold nothing of an open transaction."""
        seq, now = self._list(committed)
        needed = {r["held"] for r in now.select("held").distinct().collect()}
        for n in committed & set(finished(self.spark, f"{self.path}/held")) - needed:
            delete(self.spark, f"{self.path}/held/{n}")
        for n in committed & set(finished(self.spark, f"{self.path}/open")):
            if self.spark.read.schema(OPEN).parquet(f"{self.path}/open/{n}").agg(F.max("seq")).first()[0] < seq:
                delete(self.spark, f"{self.path}/open/{n}")


def follow_transactions(
    changes: DataFrame, table: FollowedTable, opened: OpenTransactions, checkpoint: str, *, settings: ApplySettings | None = None, policy: ErrorPolicy | None = None, **how
) -> StreamingQuery:
    """``follow`` that applies transactions as a whole (``changes`` has ``xid``): all files that are there, or, with ``settings``, for ever."""
    stream = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        name, committed = f"batch={stream}-{batch_id}", set(finished(table.spark, table.commit_path))
        if name not in committed:
            ready = opened.release(df, name, committed) if settings is None or settings.preserve_transactions else df.filter(~F.col("op").isin(COMMIT, ROLLBACK))
            table.apply_batch(ready.drop("xid"), name, policy=policy, **how)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(settings.trigger() if settings else {"availableNow": True})).start()
