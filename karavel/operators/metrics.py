"""Progress, lag, rate and phase figures from state tables and logs.

``by`` columns let one job cover many runs; without them the whole input is one run. All divisions
drop the fraction, in the same steps as a shell calculator with a fixed scale would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from karavel.functions.expr import MB, clamp, div, epoch, lsn_to_pos, tenths_text

LSN = r"\b[0-9A-Fa-f]+/[0-9A-Fa-f]+\b"

# Log marks, phase numbers and names, and state letters, as the tools print them.
APPLY_MARK = "Apply reached"
ALL_DONE_MARK = "All step are now done"
RESTORE_MARK = r"errors ignored on restore: ([0-9]+)"
TOLERANCE_MARKS = (r"tolerance of ([0-9]+)", r"tolerance: ([0-9]+)")
PHASES = {
    1: "Catalog source database",
    2: "Dump schema from source",
    3: "Restore schema to target",
    4: "Copy table data",
    6: "Create indexes",
    7: "Create constraints",
    8: "Vacuum and analyze",
    9: "Reset sequences",
    10: "Post-data (materialized views)",
}
SYNC_STATES = {
    "i": "initializing",
    "d": "data is being copied",
    "f": "finished table copy",
    "s": "synchronized",
    "r": "ready (normal replication)",
}


def position_gap(from_lsn: Column, to_lsn: Column) -> Column:
    """Bytes between two log positions (may be negative)."""
    return lsn_to_pos(to_lsn) - lsn_to_pos(from_lsn)


def replication_lag(positions: DataFrame, threshold_mb: int = 100) -> DataFrame:
    """Gaps from ``replay_lsn``, ``write_lsn`` and ``source_lsn`` (each may be NULL) and the caught-up flag.

    The total gap decides when it is known, else the apply gap.
    """
    gap = clamp(position_gap(F.col("replay_lsn"), F.col("write_lsn"))).cast("bigint")
    total = clamp(position_gap(F.col("replay_lsn"), F.col("source_lsn"))).cast("bigint")
    gap = F.when(F.col("replay_lsn").isNotNull() & F.col("write_lsn").isNotNull(), gap)
    total = F.when(F.col("replay_lsn").isNotNull() & F.col("source_lsn").isNotNull(), total)
    out = positions.withColumn("gap_bytes", gap).withColumn("total_gap_bytes", total)
    out = out.withColumns({"gap_mb": div(F.col("gap_bytes"), MB), "total_gap_mb": div(F.col("total_gap_bytes"), MB)})
    return out.withColumns(
        {
            "gap_gb": div(F.col("gap_mb"), 1024),
            "total_gap_gb": div(F.col("total_gap_mb"), 1024),
            "stream_to_source_mb": F.col("total_gap_mb") - F.col("gap_mb"),
            "caught_up": F.coalesce(F.coalesce("total_gap_mb", "gap_mb") <= threshold_mb, F.lit(False)),
        }
    )


def slot_health(slots: DataFrame) -> DataFrame:
    """Flush and restart lag in bytes per slot, from its positions and the current one."""
    return slots.withColumn("flush_lag", position_gap(F.col("confirmed_flush_lsn"), F.col("current_lsn")).cast("bigint")).withColumn(
        "restart_lag", position_gap(F.col("restart_lsn"), F.col("current_lsn")).cast("bigint")
    )


def first_apply(log: DataFrame, by: list[str]) -> DataFrame:
    """First apply line per run: its position and time."""
    marks = log.filter(F.col("message").contains(APPLY_MARK))
    first = marks.groupBy(*by).agg(F.min_by(F.struct("message", "ts"), "line_no").alias("f"))
    return first.select(
        *by,
        lsn_to_pos(F.regexp_extract("f.message", LSN, 0)).alias("first_pos"),
        epoch(F.col("f.ts")).alias("first_epoch"),
    )


def apply_rate_eta(log: DataFrame, positions: DataFrame, as_of: int, by: list[str], threshold_mb: int = 100) -> DataFrame:
    """Apply rate since the first apply line up to ``as_of`` (epoch seconds) and the time left.

    Rates and hours are kept as whole tenths (``rate_mb10`` = MB per hour times 10), elapsed hours as
    whole ten-thousandths, so nothing is rounded on the way.
    """
    lag = replication_lag(positions, threshold_mb).join(first_apply(log, by), by, "left")
    applied_mb = div(lsn_to_pos(F.col("replay_lsn")) - F.col("first_pos"), MB)
    elapsed = F.lit(as_of).cast("bigint") - F.col("first_epoch")
    usable = F.col("gap_mb").isNotNull() & (F.col("elapsed_sec") > 60) & (F.col("applied_mb") > 0)
    out = lag.withColumn("applied_mb", applied_mb).withColumn("elapsed_sec", elapsed)
    hours = F.when(usable, div(F.col("elapsed_sec") * 10_000, 3600))
    out = out.withColumn("elapsed_hr10000", hours)
    out = out.withColumn("rate_mb10", F.nullif(div(F.col("applied_mb") * 100_000, F.col("elapsed_hr10000")), F.lit(0).cast("bigint")))
    out = out.withColumn("rate_gb10", div(F.col("rate_mb10"), 1024))
    rate = F.when(F.col("rate_gb10") > 0, F.concat(tenths_text(F.col("rate_gb10")), F.lit(" GB/hr"))).when(
        F.col("rate_mb10") > 0, F.concat(tenths_text(F.col("rate_mb10")), F.lit(" MB/hr"))
    )

    def eta(gb: Column, mb: Column, otherwise: Column) -> Column:
        hours_left = F.concat(tenths_text(div(gb * 100, F.col("rate_gb10"))), F.lit("h"))
        minutes = div(mb * 600, F.col("rate_mb10"))
        text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise("<1m")
        return F.when((gb > 0) & (F.col("rate_gb10") > 0), hours_left).when(mb > 0, text).otherwise(otherwise)

    none = F.lit(None).cast("string")
    by_gap = F.when(F.col("rate_mb10").isNotNull(), eta(F.col("gap_gb"), F.col("gap_mb"), none))
    # the total gap replaces the estimate unless it cannot give one (whole GB left at a rate below 0.1 GB/hr)
    total_known = F.col("total_gap_mb").isNotNull() & ~F.col("caught_up") & F.col("rate_mb10").isNotNull()
    stuck = (F.col("total_gap_gb") > 0) & (F.col("rate_gb10") == 0)
    by_total = F.when(stuck, by_gap).otherwise(eta(F.col("total_gap_gb"), F.col("total_gap_mb"), by_gap))
    left = F.when(F.col("caught_up"), none).when(total_known, by_total).otherwise(by_gap)
    return out.withColumn("apply_rate", rate).withColumn("eta", left)


# ---------------------------------------------------------------------------------------------- logs


def error_summary(log: DataFrame, pattern: str = "ERROR", length: int = 100, by: list[str] | None = None) -> DataFrame:
    """Lines that contain the pattern: count, last one (cut to ``length``), and time of the last log line.

    The counters are numbers, so they are hashed and no log text is sorted or moved; the one text per
    run is fetched by its line number afterwards. A line number occurs once per run.
    """
    hit = F.col("line").contains(pattern)
    keys = by or []
    counts = log.groupBy(*keys).agg(
        F.count_if(hit).alias("errors"),
        F.max(F.when(hit, F.col("line_no"))).alias("line_no"),
        F.max_by(F.unix_micros(F.col("ts").cast("timestamp")), "line_no").alias("__micros"),
    )
    texts = log.filter(hit).select(*keys, "line_no", F.substring("line", 1, length).alias("last_error"))
    stamp = F.date_format(F.timestamp_micros("__micros"), "yyyy-MM-dd HH:mm:ss")
    joined = counts.join(texts, [*keys, "line_no"], "left")
    return joined.select(*keys, "errors", "last_error", stamp.alias("last_log_ts"))


def tolerance_check(log: DataFrame, default: int = 10, by: list[str] | None = None) -> DataFrame:
    """Errors of the last restore report against the last reported tolerance."""

    def last_number(pattern: str) -> Column:
        number = F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("bigint")
        return F.max_by(number, F.when(number.isNotNull(), F.col("line_no")))

    spoken, written = (last_number(p) for p in TOLERANCE_MARKS)
    out = log.groupBy(*(by or [])).agg(
        F.coalesce(last_number(RESTORE_MARK), F.lit(0)).alias("restore_errors"),
        F.coalesce(spoken, written, F.lit(default)).cast("bigint").alias("tolerance"),
    )
    state = F.when(F.col("restore_errors") == 0, "none").when(
        F.col("restore_errors") <= F.col("tolerance"), "within tolerance"
    )
    return out.withColumn("state", state.otherwise("exceeds tolerance"))


# ------------------------------------------------------------------------------------------ progress


def task_counts(s_table: DataFrame, s_part: DataFrame, summary: DataFrame, s_index: DataFrame, s_constraint: DataFrame) -> DataFrame:
    """One row of raw counters over the progress catalog.

    Each input is aggregated by itself to one row; the rows are put side by side by a union and a
    second, tiny aggregation.
    """
    started, done = F.col("start_ts").isNotNull(), F.col("done_ts").isNotNull()
    table = F.col("tableoid").isNotNull()
    # distinct ids first: the three distinct counts then share one pass over small rows
    per_id = (
        summary.filter(~table)
        .groupBy("indexoid", "conoid")
        .agg(F.max(started).alias("started"), F.max(done).alias("done"))
    )
    names = (
        "unsplit parts split_tables tables_started tables_done bytes indexes_total indexes_started indexes_done "
        "constraints_total constraints_started constraints_done"
    ).split()

    def part(df: DataFrame, **aggs: Column) -> DataFrame:
        row = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return row.select(*[F.col(n) if n in aggs else F.lit(None).cast("bigint").alias(n) for n in names])

    is_index, is_con = F.col("indexoid").isNotNull(), F.col("conoid").isNotNull()
    split = s_part.select("oid").distinct()
    parts = [
        part(s_table.join(split, "oid", "left_anti"), unsplit=F.count("*")),
        part(s_part, parts=F.count("*")),
        part(split, split_tables=F.count("*")),
        part(
            summary.filter(table),
            tables_started=F.count_if(started),
            tables_done=F.count_if(done),
            bytes=F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint"),
        ),
        part(
            per_id,
            indexes_started=F.count_if(is_index & F.col("started")),
            indexes_done=F.count_if(is_index & F.col("done")),
            constraints_started=F.count_if(is_con & F.col("started")),
            constraints_done=F.count_if(is_con & F.col("done")),
        ),
        part(s_index, indexes_total=F.count("*")),
        part(s_constraint, constraints_total=F.count("*")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(*[F.max(n).alias(n) for n in names]).withColumn("tables_total", F.col("unsplit") + F.col("parts"))


def copy_progress(s_table: DataFrame, s_part: DataFrame, summary: DataFrame, s_index: DataFrame, s_constraint: DataFrame) -> DataFrame:
    """Copy tasks, indexes and constraints: total, started, done, running, and percents in whole tenths."""
    c = task_counts(s_table, s_part, summary, s_index, s_constraint)

    def tenths(done: Column, total: Column) -> Column:
        return F.coalesce(div(done * 1000, total), F.lit(0).cast("bigint"))

    items = F.col("tables_total") + F.col("indexes_total") + F.col("constraints_total")
    finished = F.col("tables_done") + F.col("indexes_done") + F.col("constraints_done")
    overall = F.when((F.col("tables_total") > 0) & (F.col("indexes_total") > 0), tenths(finished, items))
    return c.withColumns(
        {
            **{f"{k}_running": F.col(f"{k}_started") - F.col(f"{k}_done") for k in ("tables", "indexes", "constraints")},
            **{
                f"{k}_percent10": tenths(F.col(f"{k}_done"), F.col(f"{k}_total"))
                for k in ("tables", "indexes", "constraints")
            },
            "overall_percent10": overall,
        }
    )


def phase_status(log: DataFrame, counters: DataFrame, by: list[str]) -> DataFrame:
    """Nine phases per run as pending, running or done, from log marks and task counters.

    Counters per run: ``tables_total, tables_started, tables_done``, the same for indexes and
    constraints, ``vacuum_total, vacuum_done``. A later phase means the earlier ones are done.
    """
    marks = log.groupBy(*by).agg(
        *[F.max(F.col("line").contains(f"STEP {n}:")).alias(f"step{n}") for n in (1, 2, 3, 4, 8, 9, 10)],
        F.max(F.col("line").contains(ALL_DONE_MARK)).alias("all_done"),
    )
    joined = marks.join(counters, by)

    def step(n: int) -> Column:
        return F.col(f"step{n}")

    def state(done: Column, running: Column) -> Column:
        return F.when(done, "done").when(running, "running").otherwise("pending")

    def counted(k: str) -> Column:
        total, done = F.col(f"{k}_total"), F.col(f"{k}_done")
        return state((total > 0) & (done == total), F.col(f"{k}_started") > 0)

    vac_total, vac_done = F.col("vacuum_total"), F.col("vacuum_done")
    states = {
        1: state(step(1) & step(2), step(1)),
        2: state(step(2) & step(3), step(2)),
        3: state(step(3) & ((F.col("tables_started") > 0) | step(4)), step(3)),
        4: counted("tables"),
        6: counted("indexes"),
        7: counted("constraints"),
        8: state(((vac_total > 0) & (vac_done >= vac_total)) | step(9), (vac_done > 0) | step(8)),
        9: state(step(9) & (step(10) | F.col("all_done")), step(9)),
        10: state(step(10) & F.col("all_done"), step(10)),
    }
    rows = [F.struct(F.lit(n).alias("phase"), F.lit(PHASES[n]).alias("name"), s.alias("status")) for n, s in states.items()]
    return joined.select(*by, F.inline(F.array(*rows)))


def task_timing(summary: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest finished copy tasks with their seconds."""
    done = summary.filter(F.col("tableoid").isNotNull() & F.col("done_ts").isNotNull())
    timed = done.withColumn("seconds", epoch(F.col("done_ts")) - epoch(F.col("start_ts")))
    return timed.orderBy(F.col("bytes").desc(), "tableoid", "partnumber").limit(n)


def tasks_running(summary: DataFrame) -> DataFrame:
    """Copy tasks without an end time."""
    return summary.filter(F.col("tableoid").isNotNull() & F.col("done_ts").isNull())


# -------------------------------------------------------------------------------------- sync, tasks


def sync_states(sub: DataFrame, rel: DataFrame, cls: DataFrame, ns: DataFrame, name: str | None = None) -> DataFrame:
    """Per table of a subscription: schema, table, state letter and its meaning."""
    picked = sub if name is None else sub.filter(F.col("subname") == name)
    text = F.lit("")
    for letter, meaning in SYNC_STATES.items():
        text = F.when(F.col("srsubstate") == letter, meaning).otherwise(text)
    return (
        rel.join(picked.select(F.col("oid").alias("srsubid"), "subname"), "srsubid")
        .join(cls.select(F.col("oid").alias("srrelid"), "relname", "relnamespace"), "srrelid")
        .join(ns.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace")
        .select("subname", "nspname", "relname", "srsubstate", text.alias("state"))
    )


def sync_report(lines: DataFrame, as_of: int, by: list[str], stall_seconds: int = 60) -> DataFrame:
    """Status reports of ``Key : value`` lines, one row per report.

    Conditional aggregates pick the wanted keys, so each task folds its lines before anything moves.
    """
    # the separator is a colon after blanks; a key may end in a colon of its own
    form = r"^(.*?):?\s+:(?: (.*))?$"
    kv = lines.withColumn("__k", F.regexp_extract("line", form, 1)).withColumn("__v", F.trim(F.regexp_extract("line", form, 2)))

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("__k") == name, F.col("__v")))

    picked = kv.groupBy(*by).agg(
        pick("Status").alias("status"),
        pick("Onetimecopy").alias("once"),
        pick("Current state").alias("current"),
        F.nullif(pick("Last error"), F.lit("")).alias("last_error"),
        pick("Rows deleted/inserted").alias("rows"),
        pick("Last good").alias("good"),
    )
    deleted = F.regexp_extract("rows", r"^(\d+) / (\d+)$", 1)
    inserted = F.regexp_extract("rows", r"^(\d+) / (\d+)$", 2)
    changed = F.when(deleted != "", deleted.cast("bigint") + inserted.cast("bigint"))
    good = F.to_timestamp(F.substring("good", 1, 21), "MMM dd, yyyy HH:mm:ss")
    since = F.when(F.coalesce(F.col("good"), F.lit("")) != "", F.lit(as_of).cast("bigint") - epoch(good))
    state = (
        F.when(F.col("current") == "No records found", "not-yet-started")
        .when(F.col("current").isin("Good", "Bad"), F.col("current"))
        .otherwise(F.concat(F.coalesce("current", F.lit("")), F.lit(" (good)")))
    )
    phase = F.when(F.coalesce(F.col("once"), F.lit("")).contains("Yes"), "in-progress").otherwise("finished")
    return picked.select(
        *by,
        "status",
        phase.alias("copy_phase"),
        state.alias("state"),
        "last_error",
        changed.alias("rows_changed"),
        since.alias("seconds_since"),
        F.coalesce(since > stall_seconds, F.lit(False)).alias("stalled"),
    )


def task_state(polls: DataFrame) -> DataFrame:
    """Class of each task from its latest poll: failed, full load done, or wait."""
    latest = polls.groupBy("task").agg(F.max_by(F.struct("status", "load_percent"), "poll").alias("p"))
    status, percent = F.col("p.status"), F.col("p.load_percent")
    state = F.when(status == "failed", "failed").when((status == "running") & (percent == 100), "full load done")
    return latest.select("task", status.alias("status"), percent.alias("load_percent"), state.otherwise("wait").alias("state"))


def assessment_state(polls: DataFrame) -> DataFrame:
    """Class of each assessment from its latest poll: a warning passes."""
    latest = polls.groupBy("task").agg(F.max_by("status", "poll").alias("status"))
    state = F.when(F.col("status").isin("passed", "warning"), "passed").when(F.col("status") == "failed", "failed")
    return latest.withColumn("state", state.otherwise("wait"))
