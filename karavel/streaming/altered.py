"""Following a log in which columns are added and widened."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from karavel.functions.expr import lsn_to_pos
from karavel.operators.changes import DdlPolicy, apply_changes, decode_changes, resume_changes, row_changes
from karavel.streaming.follow import FollowedTable, resume_commits, stream_name

WHOLE = ("tinyint", "smallint", "int", "bigint")
COLUMNS = "array<struct<name: string, type: string>>"
SCHEMAS = "pos decimal(20,0), columns string, stored string"


def widened(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type that holds values of both; an error if the new one does not hold those of the old."""
    a, b = old.simpleString(), new.simpleString()
    fits = a == b or (a in WHOLE and b in WHOLE[WHOLE.index(a) :]) or (a, b) == ("float", "double") or b == "string"
    if isinstance(new, T.DecimalType):
        digits = (old.precision - old.scale, old.scale) if isinstance(old, T.DecimalType) else ((3, 5, 10, 19)[WHOLE.index(a)], 0) if a in WHOLE else None
        fits = digits is not None and new.precision - new.scale >= digits[0] and new.scale >= digits[1]
    if fits:
        return new
    narrower = b in WHOLE and a in WHOLE
    if narrower or (isinstance(old, T.DecimalType) and b in WHOLE):
        return old  # an older alter that came late
    raise ValueError(f"a column of type {a} cannot become {b}")


def altered(schema: T.StructType, alters: list[tuple[int, list[dict]]]) -> T.StructType:
    """A schema after alters (position, columns with name and type) in the order of their positions."""
    types = {f.name: f.dataType for f in schema.fields}
    for _, columns in sorted(alters, key=lambda a: a[0]):
        for c in columns:
            new = T.StructType.fromDDL(f"x {c['type']}")["x"].dataType
            types[c["name"]] = widened(types[c["name"]], new) if c["name"] in types else new
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def in_schema(df: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """A table brought to a newer schema: columns it lacks are NULL, others are cast. ``keep`` stays as it is in front."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*keep, *cols)


class AlteredTable(FollowedTable):
    """A followed table of JSON records whose alters (op ``A`` with ``columns``: name and type) change its schema.

    Each batch keeps its alters by position, and the schema that its changes are written with. A read brings the base and
    all batches to the newest schema, in whatever order they came; only an alter has to come with or before the rows that
    have its columns, since a record's text is not kept.
    """

    def _schemas(self) -> list[tuple[str, int | None, str, str]]:
        done = sorted(set(self._finished("schemas")) & set(self._finished("commits")))
        if not done:
            return []
        # a row per batch, and one per alter
        rows = self.spark.read.schema(SCHEMAS).parquet(*[f"{self.path}/schemas/{n}" for n in done])
        place = F.element_at(F.split(F.url_decode(F.input_file_name()), "/"), -2)
        return [tuple(r) for r in rows.select(place, "pos", "columns", "stored").collect()]

    def _base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base/v={self._version()[0]}")

    def schema(self) -> T.StructType:
        """The newest schema: that of the base after all committed alters."""
        return altered(self._base().schema, [(int(pos), json.loads(columns)) for _, pos, columns, _ in self._schemas() if pos is not None])

    def apply_records(self, records: DataFrame, name: str, endpos: int | None = None, ddl: DdlPolicy = DdlPolicy()) -> bool:
        """Store a batch of records (``value``); False when it was committed before. Records are read with the newest schema that is known now."""
        if name in self._finished("commits"):
            return False
        alter = F.from_json("value", f"lsn string, action string, table string, columns {COLUMNS}")
        alters = records.select(alter.alias("a")).filter("a.action = 'A' and a.columns is not null and a.lsn is not null")
        if self.name is not None:
            alters = alters.filter(F.col("a.table") == self.name)
        found = alters.select(lsn_to_pos(F.col("a.lsn")).alias("pos"), F.to_json("a.columns").alias("columns")).distinct()
        found = found.collect() if ddl.alter else []  # a row per alter
        if endpos is not None:
            found = [r for r in found if r["pos"] <= endpos]
        newest = altered(self.schema(), [(int(r["pos"]), json.loads(r["columns"])) for r in found])
        rows = row_changes(decode_changes(records, newest), self.key).filter(F.col("op") != "A")
        stored = self.store(rows, name, endpos)
        kept = [(str(r["pos"]), r["columns"], None) for r in found] + [(None, None, newest.json())]
        kept = self.spark.createDataFrame(kept, "pos string, columns string, stored string")
        kept.select(F.col("pos").cast("decimal(20,0)").alias("pos"), "columns", "stored").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/schemas/{name}")
        self.commit(name, [stored])
        return True

    def read(self) -> DataFrame:
        version, upto_pos = self._version()
        known, newest = self._schemas(), self.schema()
        stored = {name: text for name, _, _, text in known if text}
        by_schema: dict[str, list[str]] = {}
        for r in resume_commits(self.commits(), upto_pos).select("name").collect():  # one name per batch
            by_schema.setdefault(stored[r["name"]], []).append(r["name"])
        base, changes = in_schema(self._base(), newest), None
        for text, names in sorted(by_schema.items()):
            schema = T.StructType.fromJson(json.loads(text))
            written = T.StructType.fromDDL("pos decimal(20,0), seq int, op string, tbl string").fields + schema.fields
            part = self.spark.read.schema(T.StructType(written)).parquet(*[f"{self.path}/changes/{n}" for n in sorted(names)])
            part = in_schema(part, newest, "pos", "seq", "op")
            changes = part if changes is None else changes.unionByName(part)
        return base if changes is None else apply_changes(base, resume_changes(changes, upto_pos), self.key, self.order)


def follow_records(records: DataFrame, table: AlteredTable, checkpoint: str, *, endpos: int | None = None, ddl: DdlPolicy = DdlPolicy()) -> StreamingQuery:
    """Apply a stream of records, alters among them, to a table: all files that are there."""
    stream = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        table.apply_records(df, f"batch={stream}-{batch_id}", endpos, ddl)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
