"""Cutover and cleanup: timeline, gate, fast-forward of marks, target inventory, reset, leftovers."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from karavel.functions.expr import div
from karavel.functions.ordered import ROWS_PER_RANGE, prior
from karavel.operators.scope import Scope, drop_system, scope_filter

# Schemas that a reset keeps.
PROTECTED_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")
# Name patterns of what a managed replication task leaves behind, per kind of object;
# replication sets also count when their name is longer than 50 characters.
LEFTOVERS = {
    "table": ("awsdms_%",),
    "sequence": ("awsdms_%",),
    "event trigger": ("awsdms_%",),
    "publication": ("%dms%", "awsdms%"),
    "replication slot": ("%dms%",),
    "replication set": ("%dms%", "%dty%"),
}
LONG_NAME = 50


# ---------------------------------------------------------------------------------- ledger, gate


def ledger_append(spark: SparkSession, path: str, status: str, ts: int | None = None) -> int:
    """Append one status row and return its timestamp."""
    now = int(time.time()) if ts is None else ts
    row = spark.createDataFrame([(now, status)], "ts bigint, status string")
    row.coalesce(1).write.mode("append").parquet(path)
    return now


def timeline(ledger: DataFrame, since: int, by: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Status rows from ``since`` on, with the seconds until the next one (NULL for the last)."""
    rows = ledger.filter(F.col("ts") >= since)
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    keys = by or ["__all"]
    out = prior(rows, keys, ["ts"], {"__next": F.col("ts")}, following=True, rows_per_range=rows_per_range)
    return out.withColumn("seconds", F.col("__next") - F.col("ts")).drop("__next", "__all")


def cutover_ready(lag: DataFrame, marker: DataFrame, verdicts: DataFrame, by: str = "run") -> DataFrame:
    """Per run: caught up, marker arrived, verdict below 2, and whether all three hold."""
    joined = lag.select(by, "caught_up").join(marker.select(by, F.col("arrived").alias("marker_arrived")), by, "left")
    joined = joined.join(verdicts.select(by, F.col("exit_code").alias("verdict")), by, "left")
    ok = [F.coalesce(F.col("caught_up"), F.lit(False)), F.coalesce(F.col("marker_arrived"), F.lit(False))]
    passed = F.coalesce(F.col("verdict") < 2, F.lit(False))
    return joined.select(
        by, ok[0].alias("caught_up"), ok[1].alias("marker_arrived"), passed.alias("verified"), (ok[0] & ok[1] & passed).alias("ready")
    )


def fast_forward(samples: DataFrame, now: Column | int, skip: int = 3600, sleep: int = 10) -> DataFrame:
    """New marks from two samples ``(seq, ts, t0, t1)`` taken ``sleep`` seconds apart, far enough ahead for ``skip`` seconds."""
    sleeps = div(F.lit(now) - F.col("ts"), sleep) + F.lit(skip // sleep)
    return samples.select("seq", (F.col("t1") + sleeps * (F.col("t1") - F.col("t0"))).alias("new_last"))


# ---------------------------------------------------------------------------------- inventory, reset


def _not_owned(inventory: DataFrame, owned: DataFrame) -> DataFrame:
    key = ["kind", "schema_name", "name"]
    return drop_system(inventory).join(owned.select(*key), key, "left_anti")


def inventory_counts(inventory: DataFrame, owned: DataFrame) -> DataFrame:
    """Objects per kind, without system schemas and without objects that an extension owns."""
    return _not_owned(inventory, owned).groupBy("kind").agg(F.count("*").alias("objects"))


def schema_counts(inventory: DataFrame, owned: DataFrame, kind: str, n: int = 15) -> DataFrame:
    """The ``n`` schemas with most objects of one kind."""
    per = _not_owned(inventory, owned).filter(F.col("kind") == kind).groupBy("schema_name").agg(F.count("*").alias("objects"))
    return per.orderBy(F.col("objects").desc(), "schema_name").limit(n)


def reset_plan(
    inventory: DataFrame, scope: Scope, protected: tuple[str, ...] = PROTECTED_SCHEMAS, owned: DataFrame | None = None
) -> DataFrame:
    """What a reset drops: everything in scope outside the protected schemas and not ``owned`` by an extension, with its statement."""
    within = scope_filter(inventory if owned is None else _not_owned(inventory, owned), scope).filter(~F.col("schema_name").isin(*protected))

    def quoted(c: str) -> Column:
        return F.concat(F.lit("`"), F.replace(F.col(c), F.lit("`"), F.lit("``")), F.lit("`"))

    statement = F.concat(
        F.lit("DROP "), F.upper("kind"), F.lit(" IF EXISTS "), quoted("schema_name"), F.lit("."), quoted("name")
    )
    return within.select("kind", "schema_name", "name", statement.alias("statement"))


def residue(before: DataFrame, plan: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` objects that a plan leaves."""
    key = ["kind", "schema_name", "name"]
    return before.join(plan.select(*key), key, "left_anti").select(*key).orderBy(*key).limit(n)


def reset_target(spark: SparkSession, database: str, scope: Scope | None = None, dry_run: bool = True) -> DataFrame:
    """Drop the tables and views of a catalog database that are in scope; a dry run only returns the plan."""
    listed = spark.catalog.listTables(database)
    rows = [("view" if t.tableType == "VIEW" else "table", database, t.name) for t in listed if not t.isTemporary]
    inventory = spark.createDataFrame(rows, "kind string, schema_name string, name string")
    plan = reset_plan(inventory, scope or Scope())
    if not dry_run:
        for r in plan.orderBy(F.col("kind").desc()).collect():  # catalog entries of one database; views first
            spark.sql(r["statement"])
    return plan


# ---------------------------------------------------------------------------------- leftovers


def artefacts(inventory: DataFrame, patterns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Objects ``(kind, schema_name, name, active)`` whose name marks them as leftovers.

    Active ones get a warning, the others can be dropped.
    """
    hit = F.lit(False)
    for kind, likes in (patterns or LEFTOVERS).items():
        named = F.lit(False)
        for p in likes:
            named = named | F.col("name").like(p)
        if kind == "replication set":
            named = named | (F.length("name") > LONG_NAME)
        hit = hit | ((F.col("kind") == kind) & named)
    return inventory.filter(hit).withColumn("action", F.when(F.col("active"), "warn").otherwise("drop"))


def artefact_counts(found: DataFrame) -> DataFrame:
    """Leftovers per kind: found, to drop, and remaining after the cleanup."""
    return found.groupBy("kind").agg(
        F.count("*").alias("found"),
        F.count_if(F.col("action") == "drop").alias("dropped"),
        F.count_if(F.col("action") == "warn").alias("remaining"),
    )


def business_tables(inventory: DataFrame, sizes: DataFrame, schema: str) -> DataFrame:
    """The tables of a schema that are no leftovers, with their size."""
    tables = inventory.filter((F.col("kind") == "table") & (F.col("schema_name") == schema)).select("schema_name", "name")
    own = tables.filter(~F.col("name").like(LEFTOVERS["table"][0]))
    return own.join(sizes.select("name", "bytes"), "name", "left").orderBy("name")
