"""Bulk loads: full, conflict-ignoring and resumed loads, and what follows a load."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F

from karavel.functions.sized import settle
from karavel.sources.files import delete, finished, list_names, size_of
from karavel.sources.sinks import write_snapshot
from karavel.sources.snapshot import read_part

PROGRESS = "tbl string, part bigint, parts bigint, lo bigint, hi bigint, start_epoch bigint, done_epoch bigint, rows bigint, bytes bigint"


def _log_progress(spark: SparkSession, path: str, row: tuple) -> None:
    """One folder per task, so that tasks which end at the same time do not share a write."""
    table, part = row[:2]
    spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{table}-{part}")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per task; a planned task that has not ended has no ``done_epoch``."""
    done = [f"{path}/{n}" for n in finished(spark, path)]
    return spark.read.schema(PROGRESS).parquet(*done) if done else spark.createDataFrame([], PROGRESS)


def _clear_other_parts(spark: SparkSession, dest: str, progress: str, planned: list[Row]) -> None:
    """Forget parts that an earlier load with other ranges has left; finished parts of the same plan stay."""
    logged = {(r["tbl"], r["part"]): r for r in read_progress(spark, progress).collect()}  # a row per part
    for table in {p["tbl"] for p in planned}:
        own = {p["part"]: p for p in planned if p["tbl"] == table}
        parts = next(iter(own.values()))["parts"]
        same = {part for (t, part), r in logged.items() if t == table and r["parts"] == parts and r["done_epoch"] is not None}
        for name in list_names(spark, f"{dest}/{table}"):
            number = re.fullmatch(r"part-(\d+)", name)
            if number and int(number[1]) not in same:
                delete(spark, f"{dest}/{table}/{name}")
        for t, part in logged:
            if t == table and part not in same:
                delete(spark, f"{progress}/{t}-{part}")


def full_load(
    src_tables: dict[str, DataFrame | Callable[[list[str]], DataFrame]],
    dest: str,
    parts: DataFrame,
    keys: dict[str, str],
    *,
    progress: str,
    prep: str = "drop_and_create",
    table_jobs: int = 16,
) -> DataFrame:
    """Write every planned ``(table, part)`` to ``dest/<table>/part-<n>`` and log each finished task.

    Parts are independent Spark jobs, ``table_jobs`` of them at a time, so a lost task is retried by
    Spark and a lost run goes on with ``resume_plan``. The plan with its ranges is logged before the first task.
    Rows are counted while they are written. The first part is open below and the last one above. With
    ``drop_and_create`` parts of an earlier load of the table that are not of this plan are deleted. A part of
    ``plan_file_parts`` is read from its files only, by a function of their names in place of the table.
    """
    spark = parts.sparkSession
    planned = parts.orderBy("tbl", "part").collect()  # the plan: at most max_parts rows per table
    if prep == "drop_and_create":
        _clear_other_parts(spark, dest, progress, planned)
    pool = ThreadPoolExecutor(max_workers=max(1, table_jobs))

    def each(f) -> None:
        for done in [pool.submit(inheritable_thread_target(spark)(f), p) for p in planned]:
            done.result()

    def plan(p: Row) -> None:
        _log_progress(spark, progress, (p["tbl"], p["part"], p["parts"], p["lo"], p["hi"], None, None, None, None))

    def load(p: Row) -> None:
        df = src_tables[p["tbl"]]
        if callable(df):
            df = df(p["files"])
        elif p["parts"] > 1:
            df = read_part(df, keys[p["tbl"]], p["lo"], p["hi"], first=p["part"] == 1, last=p["part"] == p["parts"])
        out = f"{dest}/{p['tbl']}/part-{p['part']}"
        seen = Observation()
        start = int(time.time())
        write_snapshot(df.observe(seen, F.count("*").alias("rows")), out, prep)
        times = (start, int(time.time()))
        _log_progress(spark, progress, (p["tbl"], p["part"], p["parts"], p["lo"], p["hi"], *times, seen.get["rows"], size_of(spark, out)))

    with pool:
        each(plan)
        each(load)
    return read_progress(spark, progress)


def loaded_table(spark: SparkSession, dest: str, table: str) -> DataFrame:
    """A loaded table, all finished parts together."""
    return spark.read.parquet(*[f"{dest}/{table}/{n}" for n in finished(spark, f"{dest}/{table}")])


def load_ignore_conflicts(df: DataFrame, target: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The target plus the rows whose key it lacks; of equal keys in the input the first by ``order`` counts."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    once, _ = settle(df.groupBy(*key).agg(first.alias("__first")).select(*key, "__first.*").select(*df.columns), "first_rows")
    taken = target.select(*key).join(once.select(*key), key, "left_semi")  # a small input is sent to the target's scan
    return target.unionByName(once.join(taken, key, "left_anti").select(*target.columns))


class SplitMismatch(ValueError):
    pass


def split_mismatch(plan: DataFrame, progress: DataFrame) -> DataFrame:
    """Tables whose number of parts differs between the plan and the first run."""
    old = progress.select("tbl", F.col("parts").alias("old_parts")).distinct()
    return plan.select("tbl", "parts").distinct().join(old, "tbl").filter(F.col("parts") != F.col("old_parts"))


def resume_plan(plan: DataFrame, progress: DataFrame) -> DataFrame:
    """The tasks that no finished progress row covers. Other split settings than at first are an error.

    Ranges come from the first run where it logged them, since a plan made again after the table has
    changed would cut it elsewhere. If the table has grown beyond the logged ranges, the part that is open on
    that side is loaded again.
    """
    wrong = split_mismatch(plan, progress).limit(5).collect()
    if wrong:
        raise SplitMismatch("split settings differ from the first run: " + ", ".join(str(r["tbl"]) for r in wrong))
    done = progress.filter(F.col("done_epoch").isNotNull()).select("tbl", "part").distinct()
    if not {"lo", "hi"} <= set(plan.columns) & set(progress.columns):
        return plan.join(done, ["tbl", "part"], "left_anti").select(*plan.columns)
    logged = progress.groupBy("tbl", "part").agg(F.max("lo").alias("old_lo"), F.max("hi").alias("old_hi"), F.max("done_epoch").alias("done"))
    both = plan.join(logged, ["tbl", "part"], "left")
    grown = ((F.col("part") == 1) & (F.col("lo") < F.col("old_lo"))) | ((F.col("part") == F.col("parts")) & (F.col("hi") > F.col("old_hi")))
    rest = both.filter(F.col("done").isNull() | F.coalesce(grown, F.lit(False)))
    kept = {"lo": F.coalesce("old_lo", "lo").alias("lo"), "hi": F.coalesce("old_hi", "hi").alias("hi")}
    return rest.select(*[kept.get(c, F.col(c)) for c in plan.columns])


def reset_high_water(seqs: DataFrame, max_keys: DataFrame) -> DataFrame:
    """New marks ``(seq, new_last)``: the source mark, or the highest key in the target if that is higher."""
    joined = seqs.join(max_keys.groupBy("seq").agg(F.max("max_key").alias("max_key")), "seq", "left")
    return joined.select("seq", F.greatest(F.coalesce("last_value", F.lit(0)), F.coalesce("max_key", F.lit(0))).alias("new_last"))


def refresh_stats(spark: SparkSession, tables: list[str], columns: bool = True) -> DataFrame:
    """Analyze catalog tables and return ``(tbl, rows, bytes)`` as the catalog now has them."""
    found = []
    for table in tables:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (" FOR ALL COLUMNS" if columns else ""))
        described = spark.sql(f"DESCRIBE EXTENDED {table}").filter(F.col("col_name") == "Statistics").first()
        size, rows = re.match(r"(\d+) bytes(?:, (\d+) rows)?", described["data_type"]).groups()
        found.append((table, int(rows) if rows else None, int(size)))
    return spark.createDataFrame(found, "tbl string, rows bigint, bytes bigint")


def refresh_derived(queries: dict[str, DataFrame], dest: str) -> DataFrame:
    """Write each derived table in the given order and return ``(name, rows)``."""
    spark = next(iter(queries.values())).sparkSession
    done = []
    for name, df in queries.items():
        seen = Observation()
        write_snapshot(df.observe(seen, F.count("*").alias("rows")), f"{dest}/{name}")
        done.append((name, seen.get["rows"]))
    return spark.createDataFrame(done, "name string, rows bigint")
