"""One change stream into many followed tables, with one commit for all."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from karavel.operators.changes import COMMIT, decode_changes, row_changes
from karavel.session import shared_folder
from karavel.sources.files import finished
from karavel.streaming.follow import FollowedTable, stream_name
from karavel.streaming.keyless import CountedTable


@dataclass(frozen=True)
class Member:
    """A published table: its name in the log, its columns, and its key (empty: a table without one)."""

    name: str
    columns: T.StructType
    key: list[str] = field(default_factory=list)
    key_type: T.DataType | None = None


class TableGroup:
    """Tables below ``path`` that one stream of JSON records feeds. A batch is seen by all tables or by none.

    A batch of records is scanned once and written apart by table; then each table decodes its own part with its own columns and
    key, all at the same time; one commit ends the batch. Records that do not parse, or that lack a
    table or position, are kept in ``rejected``; records of other tables are passed over.
    """

    def __init__(self, spark: SparkSession, path: str, members: list[Member], jobs: int = 4):
        self.spark, self.path, self.jobs = spark, path, jobs
        self.members = {m.name: m for m in members}
        self.tables = {m.name: self._table(m) for m in members}

    def _table(self, m: Member) -> FollowedTable:
        place, how = f"{self.path}/tables/{m.name}", {"order": ["pos", "seq"], "name": m.name, "commits": f"{self.path}/commits"}
        return FollowedTable(self.spark, place, m.key, **how) if m.key else CountedTable(self.spark, place, **how)

    def start(self, snapshots: dict[str, DataFrame], snapshot_pos: int = 0) -> None:
        for name, table in self.tables.items():
            table.start(snapshots[name], snapshot_pos)

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def rejected(self) -> DataFrame | None:
        """Records (``value``) of committed batches that belong to no table; None if there are none."""
        done = sorted(set(finished(self.spark, f"{self.path}/rejected")) & set(finished(self.spark, f"{self.path}/commits")))
        return self.spark.read.schema("value string").parquet(*[f"{self.path}/rejected/{n}" for n in done]) if done else None

    def apply_batch(self, records: DataFrame, name: str, endpos: int | None = None) -> bool:
        """Store a batch of records (``value``) in all tables and commit it; False when it was committed before."""
        if name in finished(self.spark, f"{self.path}/commits"):
            return False
        apart = shared_folder(self.spark, "apart")
        envelope = F.from_json("value", "table string, lsn string, action string", {"mode": "PERMISSIVE"})
        marked = records.select("value", envelope.alias("e"))
        broken = F.col("e.table").isNull() | F.col("e.lsn").isNull()
        mine = F.when(F.col("e.action") == COMMIT, None).when(broken, F.lit("bad"))
        mine = mine.when(F.col("e.table").isin(*self.members), F.concat(F.lit("of "), "e.table"))
        marked.select("value", mine.alias("part")).filter("part is not null").write.partitionBy("part").parquet(apart)

        def part(name: str) -> DataFrame:
            return self.spark.read.schema("value string, part string").parquet(apart).filter(F.col("part") == name).select("value")

        def store(m: Member) -> tuple[dict, DataFrame]:
            decoded = decode_changes(part(f"of {m.name}"), m.columns, key_type=m.key_type)
            rows = row_changes(decoded, m.key).drop("tbl")
            bad = decoded.filter("malformed").select(F.col("raw").alias("value"))
            return {"tbl": m.name} | self.tables[m.name].store(rows, name, endpos), bad

        with ThreadPoolExecutor(self.jobs) as pool:
            stored = list(pool.map(store, self.members.values()))
        rejected = part("bad")
        for _, bad in stored:
            rejected = rejected.unionByName(bad)
        rejected.write.mode("overwrite").parquet(f"{self.path}/rejected/{name}")
        next(iter(self.tables.values())).commit(name, [row for row, _ in stored])
        return True


def follow_group(records: DataFrame, group: TableGroup, checkpoint: str, *, endpos: int | None = None, interval: str | None = None) -> StreamingQuery:
    """Apply a stream of records to the tables of a group: all files that are there, or every ``interval`` for ever."""
    stream = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        group.apply_batch(df, f"batch={stream}-{batch_id}", endpos)

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()
