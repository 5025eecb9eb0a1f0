"""Following a change log as a stream into a table that can be read at any time.

A batch writes only its net changes to ``changes/batch=<id>`` and then a commit row; the base table is
rewritten by ``compact`` alone, into a new version. So a micro-batch costs as much as its changes, not
as the table, no path is ever overwritten while it is read, and a batch without a commit is not seen.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from karavel.functions.sized import settle
from karavel.operators.changes import ErrorPolicy, apply_changes, bound_changes, classify_changes, net_changes, resume_changes, route_changes
from karavel.session import shared_folder
from karavel.sources.files import delete, finished

POSITION = "decimal(20,0)"
COMMITS = f"name string, max_pos {POSITION}, rows bigint, seen_pos {POSITION}, tbl string, first_pos {POSITION}, cut_pos {POSITION}"
VERSIONS = "version bigint, upto_pos decimal(20,0)"


class FollowedTable:
    """A keyed table below ``path``: base versions, net changes per batch, and commits.

    Batches are put together by position when the table is read, so neither a batch applied twice nor
    one that comes late can change the result.
    """

    keyed = True

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str] | None = None, *, name: str | None = None, commits: str | None = None):
        """``order`` sorts changes of a key; with several changes at one position it needs a tie-breaker after ``pos``.

        ``name``: changes whose column ``tbl`` has another value are not this table's. ``commits``: a folder of commits
        that several tables share, see ``TableGroup``; its rows are told apart by ``name``.
        """
        if self.keyed != bool(key):
            raise ValueError("a FollowedTable needs a key, and a table without one is followed by a CountedTable")
        self.spark, self.path, self.key, self.order, self.name = spark, path, key, order or ["pos"], name
        self.commit_path, self.shared = commits or f"{path}/commits", commits is not None
        self._upto: dict[int, int] = {}  # a published version never changes

    # ------------------------------------------------------------------------------- state on disk

    def _finished(self, kind: str) -> list[str]:
        return finished(self.spark, self.commit_path if kind == "commits" else f"{self.path}/{kind}")

    def _forget(self, kind: str, name: str) -> None:
        delete(self.spark, f"{self.path}/{kind}/{name}")

    def commits(self) -> DataFrame:
        """One row per committed batch: name, highest position applied, net changes, highest position read, and more."""
        done = self._finished("commits")
        if not done:
            return self.spark.createDataFrame([], COMMITS)
        rows = self.spark.read.schema(COMMITS).parquet(*[f"{self.commit_path}/{n}" for n in done])
        return rows.filter(F.col("tbl").eqNullSafe(F.lit(self.name))) if self.shared else rows

    def _version(self) -> tuple[int, int]:
        names = self._finished("versions")
        if not names:
            raise ValueError(f"{self.path} has no base yet, call start first")
        newest = max(int(n.removeprefix("v=")) for n in names)
        return newest, self._upto_pos(newest)

    def _upto_pos(self, version: int) -> int:
        if version not in self._upto:
            row = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions/v={version}").first()
            self._upto[version] = int(row["upto_pos"])
        return self._upto[version]

    def _publish(self, version: int, upto_pos: int) -> None:
        row = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(str(upto_pos)).cast("decimal(20,0)").alias("upto_pos")
        )
        row.write.mode("overwrite").parquet(f"{self.path}/versions/v={version}")

    def replay_pos(self) -> int:
        """Highest position applied so far."""
        last = self.commits().agg(F.max("max_pos")).first()[0]
        return max(self._version()[1], int(last or 0))

    def seen_pos(self) -> int:
        """Highest position read so far, applied or not."""
        last = self.commits().agg(F.max("seen_pos")).first()[0]
        return max(self._version()[1], int(last or 0))

    # ------------------------------------------------------------------------------------ the table

    def start(self, snapshot: DataFrame, snapshot_pos: int = 0) -> None:
        """Write the base table: a snapshot that holds all changes up to its position."""
        if self._finished("versions"):
            raise ValueError(f"{self.path} has a base already")
        snapshot.write.mode("overwrite").parquet(f"{self.path}/base/v=0")
        self._publish(0, snapshot_pos)

    def reload(self, snapshot: DataFrame, snapshot_pos: int) -> int:
        """Begin again from a new snapshot that holds all changes up to its position, so that a suspended table goes on.

        Changes that were held back are not kept, so the snapshot must be at least as new as what was read of the log.
        """
        if snapshot_pos < self.seen_pos():
            raise ValueError(f"the log was read up to {self.seen_pos()}, a snapshot at {snapshot_pos} lacks changes that were held back")
        version = self._version()[0] + 1
        snapshot.write.mode("overwrite").parquet(f"{self.path}/base/v={version}")
        self._publish(version, snapshot_pos)
        return version

    def read(self) -> DataFrame:
        """The table after all committed batches."""
        version, upto_pos = self._version()
        base = self.spark.read.parquet(f"{self.path}/base/v={version}")
        # one name per batch since the last compaction
        names = [r["name"] for r in resume_commits(self.commits(), upto_pos).select("name").collect()]
        if not names:
            return base
        rows = self.spark.read.parquet(*[f"{self.path}/changes/{n}" for n in sorted(names)])
        return apply_changes(base, resume_changes(rows, upto_pos), self.key, self.order)

    def exceptions(self) -> DataFrame | None:
        """What the error policy has logged in committed batches; None if there was no such batch."""
        done = sorted(set(self._finished("exceptions")) & set(self._finished("commits")))
        return self.spark.read.parquet(*[f"{self.path}/exceptions/{n}" for n in done]) if done else None

    def _sound(self, changes: DataFrame, name: str, policy: ErrorPolicy, how: dict) -> DataFrame:
        """The changes of a batch that apply; the others are written as exceptions, or skipped, as the policy says."""
        table, before = how.get("table", "tbl"), self.exceptions()
        if before is not None and table in changes.columns:  # tables that an earlier batch has suspended
            before = resume_changes(before, self._version()[1])  # what was suspended before a reload is in order again
            if policy.bad_data_limit:
                how = how | {"errors_before": before.filter("reason = 'BAD_DATA'").groupBy(table).agg(F.count("*").alias("n"))}
            stops = before.filter(F.col("action") == "suspend").groupBy(table).agg(F.min("pos").alias("__stop"))
            stops, _ = settle(stops, "suspended")
            held = F.coalesce(F.col("pos") > F.col("__stop"), F.lit(False))
            changes = changes.join(stops, table, "left").filter(~held).select(*changes.columns)
        judged = classify_changes(self.read(), changes, self.key, policy, store=shared_folder(self.spark, "judged"), **how)
        live = judged.filter(~F.col("suspended"))
        logged = live.filter(F.col("action").isin("log", "suspend"))
        logged.drop("suspended").write.mode("overwrite").parquet(f"{self.path}/exceptions/{name}")
        return live.filter(F.col("reason").isNull()).select(*changes.columns)

    def apply_batch(self, changes: DataFrame, name: str, endpos: int | None = None, policy: ErrorPolicy | None = None, **how) -> bool:
        """Store the net changes of one micro-batch under its name; False when it was committed before.

        Changes that the base holds already are dropped (hand-over), so are those after ``endpos``. With an error
        ``policy`` (and what ``classify_changes`` takes) each change is judged against the table as it is, so
        batches have to come in order.
        """
        if name in self._finished("commits"):
            return False
        self.commit(name, [self.store(changes, name, endpos, policy, **how)])
        return True

    def _own(self, changes: DataFrame, endpos: int | None) -> DataFrame:
        """The changes of this table that the base does not hold, up to the end position."""
        if self.name is not None and "tbl" in changes.columns:
            changes = changes.filter(F.col("tbl") == self.name)
        fresh = resume_changes(changes, self._version()[1])
        return fresh if endpos is None else bound_changes(fresh, endpos)

    def store(self, changes: DataFrame, name: str, endpos: int | None = None, policy: ErrorPolicy | None = None, **how) -> dict:
        """Write the net changes of a batch, which are not seen before the ``commit`` of what this returns."""
        seen_pos = None
        if policy is not None:  # a batch that is judged is read several times, and may be held back as a whole
            changes = staged(changes, "batch")
            seen_pos = changes.agg(F.max("pos")).first()[0]
        else:
            read = Observation()
            changes = changes.observe(read, F.max("pos").alias("seen_pos"))
        fresh = self._own(changes, endpos)
        if policy is not None:
            fresh = self._sound(fresh, name, policy, how)
        net_changes(fresh, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/changes/{name}")
        if policy is None:
            seen_pos = read.get["seen_pos"]
        # the written changes are counted, not the plan: what is left of a plan without rows does not report
        written = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/changes/{name}")
        max_pos, rows = written.agg(F.max("pos"), F.count("*")).first()
        return {"max_pos": max_pos, "rows": rows, "seen_pos": seen_pos}

    def commit(self, name: str, stored: list[dict]) -> None:
        """Make a batch visible: one row for each table that the commit is for, all at once."""
        rows = [(name, r.get("max_pos"), r["rows"], r.get("seen_pos"), r.get("tbl", self.name), r.get("first_pos"), r.get("cut_pos")) for r in stored]
        texts = [tuple(None if v is None else str(v) for v in row) for row in rows]
        columns = COMMITS.split(", ")
        done = self.spark.createDataFrame(texts, ", ".join(f"{c.split()[0]} string" for c in columns))
        done = done.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in columns])
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.commit_path}/{name}")

    def compact(self, upto: int | None = None) -> int:
        """Write the current table as the next base version; later reads start from it.

        ``upto`` is the position up to which all changes are known to have arrived: batches below it need not
        be merged any more, and older changes that come after all are dropped. Without it nothing is taken
        for complete, so a file that comes late still counts, and ``prune`` can delete no batch.
        """
        version, known = self._version()
        upto = known if upto is None else max(upto, known)
        self.read().write.mode("overwrite").parquet(f"{self.path}/base/v={version + 1}")
        self._publish(version + 1, upto)
        return version + 1

    def prune(self, keep: int = 2) -> None:
        """Delete base versions older than the newest ``keep``, and batches that the oldest kept one holds."""
        versions = sorted(int(n.removeprefix("v=")) for n in self._finished("versions"))
        kept = versions[-keep:]
        upto = self._upto_pos(kept[0])
        old = self.commits().filter(F.col("max_pos") <= F.lit(str(upto)).cast("decimal(20,0)")).select("name")
        for name in [r["name"] for r in old.collect()]:
            if not self.shared:  # the other tables of a group still need it
                delete(self.spark, f"{self.commit_path}/{name}")
            delete(self.spark, f"{self.path}/changes/{name}")
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/versions/v={v}")
            delete(self.spark, f"{self.path}/base/v={v}")


def staged(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resume_commits(commits: DataFrame, upto_pos: int) -> DataFrame:
    return commits.filter(F.col("max_pos") > F.lit(str(upto_pos)).cast("decimal(20,0)"))


def stream_name(checkpoint: str) -> str:
    """Batch numbers start again with a new checkpoint; this tells them apart."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def follow(
    changes: DataFrame,
    table: FollowedTable,
    checkpoint: str,
    *,
    endpos: int | None = None,
    interval: str | None = None,
    policy: ErrorPolicy | None = None,
    **how,
) -> StreamingQuery:
    """Apply a change stream to a table: all files that are there, or every ``interval`` for ever.

    Batch numbers start again with a new checkpoint, so the checkpoint is part of a batch's name.
    """
    stream = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        table.apply_batch(df, f"batch={stream}-{batch_id}", endpos, policy, **how)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def follow_until(
    changes: DataFrame, table: FollowedTable, checkpoint: str, endpos: int, *, interval: str = "1 second", poll_seconds: float = 1.0
) -> None:
    """Follow a growing log until it has gone up to the end position, apply nothing after it, and return.

    The position need not be that of a change. Files that are there but were not read yet when the
    position was seen, because they came out of order, are applied by a last pass.

    To go on after the end position later, follow the log with a fresh checkpoint: this one counts the
    files as read, with what they hold after the position. Changes applied already do no harm.
    """
    query = follow(changes, table, checkpoint, endpos=endpos, interval=interval)
    while table.seen_pos() < endpos and not query.awaitTermination(poll_seconds):
        pass
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    follow(changes, table, checkpoint, endpos=endpos).awaitTermination()


def route_stream(changes: DataFrame, published: DataFrame, dest: str, checkpoint: str, table: str = "tbl") -> StreamingQuery:
    """One stream to many tables: each batch is written once, partitioned by table, to its own folder."""
    stream = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        wanted = route_changes(df, published, table)
        wanted.write.mode("overwrite").partitionBy(table).parquet(f"{dest}/routed_batch={stream}-{batch_id}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def routed(spark: SparkSession, dest: str) -> DataFrame:
    """What ``route_stream`` has written so far, all batches and tables."""
    folders = [f"{dest}/{n}" for n in finished(spark, dest)]
    return spark.read.option("basePath", dest).parquet(*folders).drop("routed_batch")
