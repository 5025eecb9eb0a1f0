"""Alerts on a stream of status polls.

Each micro-batch goes through the batch function with the state of the runs it touches. State and
alerts are written per batch, and a batch counts once both are complete, so a retried batch writes the
same rows again. Runs with very many polls are split by position inside the batch function; no task
has to hold a whole run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from karavel.operators.activity import alert_events, alert_state
from karavel.sources.files import delete, finished
from karavel.streaming.follow import stream_name

KEPT_STATES = 2  # the last state and the one before it, which a repeated batch starts from


class AlertLog:
    """Alerts and run state below ``path``; ``deliver`` returns the alerts that really went out."""

    def __init__(self, spark: SparkSession, path: str, deliver: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path = spark, path
        self.deliver = deliver or (lambda alerts: alerts)

    def _batches(self, kind: str) -> list[str]:
        """Finished batches in the order in which they were applied: ``batch=<number>_<name>``."""
        return finished(self.spark, f"{self.path}/{kind}")

    def alerts(self) -> DataFrame:
        done = self._batches("done")
        return self.spark.read.parquet(*[f"{self.path}/alerts/{b}" for b in done])

    def state(self) -> DataFrame | None:
        """Run state after the last batch that is complete."""
        done, states = self._batches("done"), set(self._batches("state"))
        newest = next((b for b in reversed(done) if b in states), None)
        return self.spark.read.parquet(f"{self.path}/state/{newest}") if newest else None

    def apply_batch(self, polls: DataFrame, batch_id: int, stream: str = "") -> None:
        """Raise the alerts of one micro-batch. Batches are told apart by stream and number, since another checkpoint counts from 0 again."""
        done, name = self._batches("done"), f"{stream}-{batch_id}"
        if any(b.partition("_")[2] == name for b in done):
            return
        own = f"batch={len(done):012d}_{name}"
        state = self.state()
        folder = f"{self.path}/alerts/{own}"
        alert_events(polls, state).write.mode("overwrite").parquet(folder)
        sent = self.deliver(self.spark.read.parquet(folder))
        after = alert_state(polls, sent.select("run", "alert"), state)
        after.write.mode("overwrite").parquet(f"{self.path}/state/{own}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/done/{own}")
        for old in self._batches("state")[:-KEPT_STATES]:
            delete(self.spark, f"{self.path}/state/{old}")


def follow_alerts(polls: DataFrame, log: AlertLog, checkpoint: str) -> StreamingQuery:
    """Raise alerts for all polls that are there."""
    stream = stream_name(checkpoint)
    writer = polls.writeStream.foreachBatch(lambda df, batch_id: log.apply_batch(df, batch_id, stream)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
