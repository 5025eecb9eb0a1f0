"""Table snapshots: read them whole or in key ranges, and show a whole schema under local names."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from karavel.functions.expr import div
from karavel.operators.scope import Scope, scope_filter
from karavel.sources.files import list_names

GB = 1024**3


@dataclass(frozen=True)
class Location:
    """A folder of ``<table>.parquet`` files or folders, or a JDBC address with reader options."""

    path: str | None = None
    url: str | None = None
    schema: str = "public"
    options: dict[str, str] = field(default_factory=dict)
    tables: tuple[str, ...] = ()

    def read(self, spark: SparkSession, table: str, **more: str) -> DataFrame:
        if self.path is not None:
            return spark.read.parquet(f"{self.path}/{table}.parquet")
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", self._name(table))
        return reader.options(**self.options, **more).load()

    def _name(self, table: str) -> str:
        return f"{self.schema}.{table}" if self.schema else table

    def table_names(self, spark: SparkSession) -> list[str]:
        if self.tables:
            return list(self.tables)
        if self.path is not None:
            return [n.removesuffix(".parquet") for n in list_names(spark, self.path) if n.endswith(".parquet")]
        query = (
            "select table_name from information_schema.tables "
            f"where table_schema = '{self.schema}' and table_type = 'BASE TABLE'"
        )
        rows = spark.read.format("jdbc").option("url", self.url).option("query", query).options(**self.options).load()
        return sorted(r[0] for r in rows.collect())  # catalog entries of one schema


def inventory_of(spark: SparkSession, location: Location) -> DataFrame:
    rows = [("table", location.schema, name) for name in location.table_names(spark)]
    return spark.createDataFrame(rows, "kind string, schema_name string, name string")


def read_snapshot(spark: SparkSession, location: Location, scope: Scope | None = None) -> dict[str, DataFrame]:
    """Every table in scope. Filters and column choices of later steps reach the scan."""
    chosen = scope_filter(inventory_of(spark, location), scope or Scope())
    return {r["name"]: location.read(spark, r["name"]) for r in chosen.select("name").orderBy("name").collect()}


def read_for_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Parquet through the reader that answers count, min and max from file footers where the type allows it."""
    v1 = "spark.sql.sources.useV1SourceList"
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    old = spark.conf.get(v1)
    spark.conf.set(v1, "")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(v1, old)


# --------------------------------------------------------------------------------------------- parts


def plan_parts(stats: DataFrame, threshold_bytes: int = 50 * GB, max_parts: int = 16) -> DataFrame:
    """Key ranges ``(tbl, part, parts, lo, hi)`` from ``(tbl, bytes, min_key, max_key)``.

    A table above the threshold gets ``ceil(bytes / threshold)`` parts, at most ``max_parts`` and at
    most one per key value. Without key bounds it gets one. ``lo`` and ``hi`` are both inside the part; they
    come from statistics, so whoever reads must leave the first part open below and the last one open above.
    """
    width = F.col("max_key") - F.col("min_key") + 1
    wanted = F.ceil(F.col("bytes") / F.lit(threshold_bytes)).cast("bigint")
    split = (F.col("bytes") > threshold_bytes) & width.isNotNull()
    parts = F.when(split, F.least(F.lit(max_parts).cast("bigint"), wanted, width)).otherwise(1)
    planned = stats.withColumn("parts", F.greatest(F.coalesce(parts, F.lit(1)), F.lit(1)).cast("bigint"))
    each = planned.withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), "parts")))
    lo = F.col("min_key") + div((F.col("part") - 1) * width, F.col("parts"))
    hi = F.col("min_key") + div(F.col("part") * width, F.col("parts")) - 1
    return each.select("tbl", "part", "parts", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def plan_file_parts(spark: SparkSession, places: dict[str, str], threshold_bytes: int = 50 * GB, max_parts: int = 16, pattern: str = "*.parquet") -> DataFrame:
    """Parts ``(tbl, part, parts, lo, hi, files)`` of file tables as sets of whole files, so that each file is read once.

    For tables that are not sorted by their key, where every key range would read all files. The number of parts is as in
    ``plan_parts``, but at most one per file; files go, largest first, to the part with the fewest bytes. The same listing
    gives the same parts; it is made by the cluster, and only names and sizes come to the driver.
    """
    rows = []
    for table, place in places.items():
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(place)
        files = sorted(((r["length"], r["path"]) for r in found.select("path", "length").collect()), reverse=True)
        total = sum(n for n, _ in files)
        parts = max(1, min(max_parts, -(-total // threshold_bytes) if total > threshold_bytes else 1, len(files)))
        heap = [(0, i, []) for i in range(parts)]
        for size, path in files:
            filled, i, held = heapq.heappop(heap)
            heapq.heappush(heap, (filled + size, i, [*held, path]))
        rows += [(table, i + 1, parts, None, None, sorted(held)) for _, i, held in sorted(heap)]
    return spark.createDataFrame(rows, "tbl string, part bigint, parts bigint, lo bigint, hi bigint, files array<string>")


def read_part(
    df: DataFrame, key: str, lo: int | None, hi: int | None, with_nulls: bool = False, *, first: bool = False, last: bool = False
) -> DataFrame:
    """The rows of one key range, without a range all rows.

    The ``first`` part takes everything up to its end and rows without a key too, the ``last`` one everything
    from its start, so rows outside old statistics are in exactly one part.
    """
    if lo is None or hi is None:
        return df
    inside = F.lit(True)
    if not first:
        inside = inside & (F.col(key) >= lo)
    if not last:
        inside = inside & (F.col(key) <= hi)
    return df.filter(inside | F.col(key).isNull()) if with_nulls or first else df.filter(inside & F.col(key).isNotNull())


def read_jdbc_parts(spark: SparkSession, location: Location, table: str, key: str, lo: int, hi: int, parts: int) -> DataFrame:
    """One JDBC table read by several tasks, each with its own key range."""
    return location.read(
        spark, table, partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(parts)
    )


# -------------------------------------------------------------------------------------------- schema


class ForeignSchema:
    """All tables of a location as temporary views ``<prefix><table>``; ``switch`` repoints them together."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark = spark
        self.prefix = prefix
        self.tables: dict[str, DataFrame] = {}

    def import_schema(self, location: Location, scope: Scope | None = None) -> list[str]:
        self.tables = read_snapshot(self.spark, location, scope)
        for name, df in self.tables.items():
            df.createOrReplaceTempView(self.prefix + name)
        return [self.prefix + name for name in self.tables]

    def switch(self, location: Location) -> None:
        """Check every table at the new place first; replace the views only when all fit."""
        new = {}
        for name, old in self.tables.items():
            try:
                df = location.read(self.spark, name)
            except Exception as e:
                raise ValueError(f"table {name} cannot be read at the new location") from e
            if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in old.schema]:
                raise ValueError(f"table {name} has another schema at the new location")
            new[name] = df
        for name, df in new.items():
            df.createOrReplaceTempView(self.prefix + name)
        self.tables = new
