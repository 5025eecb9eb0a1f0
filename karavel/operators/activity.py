"""Session activity, locks, throughput and alerts from collected snapshots.

``snap`` names a snapshot; a session (``pid``) occurs once per snapshot, so joins on both meet one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from karavel.functions.expr import age_text, clamp, div, epoch, one_line
from karavel.functions.ordered import ROWS_PER_RANGE, prior
from karavel.functions.sized import settle

# Statement patterns in the order in which they are tried, and what is printed for each.
OPERATIONS = (
    ("REFRESH MATERIALIZED VIEW", r"(?s).*REFRESH MATERIALIZED VIEW ([^;]+).*", "REFRESH MATERIALIZED VIEW $1"),
    ("COPY", r'(?s).*COPY "?([^"]+)"?.*', "COPY $1"),
    ("CREATE INDEX", r"(?s).*CREATE (UNIQUE )?INDEX ([^ ]+).*", "CREATE INDEX $2"),
    ("ALTER TABLE", r"(?s).*ALTER TABLE ([^ ]+).*", "ALTER TABLE $1"),
    ("VACUUM", r'(?s).*VACUUM[^"]*"?([^"]+)"?.*', "VACUUM $1"),
)


def operation_name(query: Column) -> Column:
    """Short form of a statement: the first pattern it contains decides, else its first 60 characters."""
    out = one_line(query, 60)
    for word, pattern, form in reversed(OPERATIONS):
        out = F.when(query.contains(word), F.regexp_replace(query, pattern, form)).otherwise(out)
    return out


def _wait(empty: str) -> Column:
    return F.coalesce(F.concat("wait_event_type", F.lit(":"), "wait_event"), F.lit(empty))


def _age(as_of: int, since: Column) -> Column:
    return F.lit(as_of).cast("bigint") - epoch(since)


def active_operations(activity: DataFrame, as_of: int, n: int = 50) -> DataFrame:
    """The ``n`` longest running statements, oldest first."""
    active = activity.filter((F.col("state") == "active") & ~F.col("query").contains("pg_stat_activity"))
    oldest = active.orderBy("query_start", "pid").limit(n)
    aged = oldest.withColumn("age_seconds", _age(as_of, F.col("query_start")))
    return aged.select(
        "pid", "age_seconds", age_text(F.col("age_seconds")).alias("age"), operation_name(F.col("query")).alias("operation")
    )


def wait_summary(activity: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sessions per backend type, state and wait, most first."""
    shown = activity.filter(F.col("backend_type").isNotNull()).select(
        *(by or []),
        "backend_type",
        F.coalesce("state", F.lit("-")).alias("state"),
        F.coalesce("wait_event_type", F.lit("(running)")).alias("wait_type"),
        F.coalesce("wait_event", F.lit("-")).alias("wait_event"),
    )
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("sessions")).orderBy(F.col("sessions").desc())


def blocking_tree(activity: DataFrame, as_of: int, length: int = 45) -> DataFrame:
    """Each blocked session with each session in its ``blocked_by`` array that the snapshot holds."""
    blocked = activity.select(
        "snap",
        F.col("pid").alias("blocked_pid"),
        _wait("-").alias("waiting_on"),
        one_line(F.col("query"), length).alias("blocked_query"),
        F.explode("blocked_by").alias("blocking_pid"),
    )
    blockers = activity.select(
        "snap",
        F.col("pid").alias("blocking_pid"),
        F.col("state").alias("blocker_state"),
        _age(as_of, F.col("xact_start")).alias("blocker_xact_age"),
        one_line(F.col("query"), length).alias("blocker_query"),
    )
    return blocked.join(blockers, ["snap", "blocking_pid"])


def blocked_sessions(activity: DataFrame) -> DataFrame:
    """Number of blocked sessions per snapshot (snapshots without any give 0)."""
    return activity.groupBy("snap").agg(F.count_if(F.size("blocked_by") > 0).alias("blocked"))


def lock_waits(activity: DataFrame, locks: DataFrame, length: int = 40) -> DataFrame:
    """Lock requests not granted, with their sessions."""
    sessions = activity.select("snap", "pid", _wait("-").alias("wait"), "blocked_by", one_line(F.col("query"), length).alias("query"))
    waiting = locks.filter(~F.col("granted")).withColumn("relation", F.coalesce("relation", F.lit("-")))
    return waiting.join(sessions, ["snap", "pid"]).drop("granted")


def copy_progress_sessions(progress: DataFrame, activity: DataFrame, as_of: int) -> DataFrame:
    """Running copies ``(snap, pid, relation, bytes_processed, tuples_processed)`` with wait and age, oldest first."""
    sessions = activity.select(
        "snap", "pid", _wait("(running)").alias("wait"), "query_start", _age(as_of, F.col("query_start")).alias("copy_age")
    )
    return progress.join(sessions, ["snap", "pid"]).orderBy("query_start", "pid").drop("query_start")


def vacuum_progress_sessions(progress: DataFrame, activity: DataFrame, as_of: int) -> DataFrame:
    """Running vacuums ``(snap, pid, relation, phase, blocks_total, blocks_scanned)`` with percent, oldest first."""
    total = F.nullif(F.col("blocks_total"), F.lit(0))
    percent = F.round(F.lit(100).cast("decimal(20,0)") * F.col("blocks_scanned") / total, 1).cast("double")
    sessions = activity.select(
        "snap", "pid", F.coalesce("wait_event", F.lit("(running)")).alias("wait"), _age(as_of, F.col("xact_start")).alias("age")
    )
    joined = progress.join(sessions, ["snap", "pid"]).withColumn("pct_scanned", percent)
    return joined.orderBy(F.col("age").desc(), "pid").drop("blocks_total", "blocks_scanned")


def idle_in_transaction(activity: DataFrame, as_of: int, n: int = 20, length: int = 40) -> DataFrame:
    """The ``n`` sessions idle in a transaction for longest, each with the number of all such sessions."""
    idle = activity.filter(F.col("state") == "idle in transaction")
    total = idle.agg(F.count("*").alias("x")).scalar()
    oldest = idle.orderBy("xact_start", "pid").limit(n)
    return oldest.select(
        "pid",
        _age(as_of, F.col("xact_start")).alias("idle_seconds"),
        one_line(F.col("query"), length).alias("last_query"),
        total.alias("sessions"),
    )


def throughput(samples: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per server and pair of consecutive samples: log bytes, growth (never below 0), growth per second."""
    before = prior(
        samples,
        ["server"],
        ["sample_ts"],
        {"prev_ts": F.col("sample_ts"), "prev_pos": F.col("pos"), "prev_size": F.col("size_bytes")},
        rows_per_range=rows_per_range,
    )
    seconds = epoch(F.col("sample_ts")) - epoch(F.col("prev_ts"))
    growth = clamp(F.col("size_bytes") - F.col("prev_size")).cast("bigint")
    return before.filter(F.col("prev_ts").isNotNull()).select(
        "server",
        "sample_ts",
        seconds.alias("seconds"),
        (F.col("pos") - F.col("prev_pos")).cast("bigint").alias("wal_bytes"),
        growth.alias("growth"),
        div(growth, seconds).alias("growth_per_second"),
    )


def stall_verdict(activity: DataFrame, locks: DataFrame) -> DataFrame:
    """Per snapshot: blocked sessions, ungranted requests, and whether a lock is involved."""
    waits = locks.groupBy("snap").agg(F.count_if(~F.col("granted")).alias("ungranted"))
    joined = blocked_sessions(activity).join(waits, "snap", "left").fillna(0, ["ungranted"])
    involved = (F.col("blocked") > 0) | (F.col("ungranted") > 0)
    return joined.withColumn("verdict", F.when(involved, "lock involved").otherwise("feed or IO"))


# -------------------------------------------------------------------------------------------- alerts

FINAL = ("succeeded", "failed")


def _fresh() -> dict[str, Column]:
    """The state in which a run starts."""
    return {
        "last_status": F.lit("unknown"),
        "last_errors": F.lit(0).cast("bigint"),
        "copy_sent": F.lit(False),
        "final_sent": F.lit(False),
    }


def alert_events(
    polls: DataFrame, state: DataFrame | None = None, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Alerts ``(run, poll, alert, new_errors)`` from polls ``(run, poll, status, errors, copy_done)``.

    Initial copy done, succeeded and failed come once per run; stopped only right after running; one
    poll raises at most one of these four, in this order. New errors come in addition whenever the
    count grew. ``state`` (see ``alert_state``) continues after earlier polls and after alerts that
    were or were not delivered.
    """
    if state is None:
        known = polls.withColumns(_fresh())
    else:
        known = polls.join(state, "run", "left")
        known = known.withColumns({n: F.coalesce(F.col(n), v) for n, v in _fresh().items()})
    # flags: first poll that raises the copy alert, then first final poll other than that one
    first_copy = known.filter(F.col("copy_done") & ~F.col("copy_sent")).groupBy("run").agg(F.min("poll").alias("copy_poll"))
    first_copy, _ = settle(first_copy, "alerts")
    withcopy = known.join(first_copy, "run", "left")
    is_copy = F.coalesce(F.col("poll") == F.col("copy_poll"), F.lit(False))
    ends = withcopy.filter(F.col("status").isin(*FINAL) & ~is_copy & ~F.col("final_sent"))
    first_end, _ = settle(ends.groupBy("run").agg(F.min("poll").alias("final_poll")), "alerts")
    joined = withcopy.join(first_end, "run", "left")
    seen = prior(
        joined, ["run"], ["poll"], {"prev_status": F.col("status"), "prev_errors": F.col("errors")}, rows_per_range=rows_per_range
    )
    is_final = F.coalesce(F.col("poll") == F.col("final_poll"), F.lit(False))
    before = F.coalesce("prev_status", "last_status")
    grown = F.col("errors") - F.coalesce("prev_errors", "last_errors")
    chain = (
        F.when(is_copy, "initial copy done")
        .when(is_final, F.col("status"))
        .when((F.col("status") == "stopped") & (before == "running"), "stopped")
    )
    new = F.when(grown > 0, "new errors")
    both = F.filter(F.array(chain, new), lambda a: a.isNotNull())
    return seen.select("run", "poll", F.explode(both).alias("alert"), grown.alias("__grown")).select(
        "run", "poll", "alert", F.when(F.col("alert") == "new errors", F.col("__grown")).alias("new_errors")
    )


def alert_state(polls: DataFrame, delivered: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """State per run after these polls: last status and error count, and which once-only alerts went out.

    ``delivered`` holds the alerts ``(run, alert)`` that were really sent; one that failed leaves its flag
    unset, so the next poll raises it again.
    """
    last = polls.groupBy("run").agg(F.max_by(F.struct("status", "errors"), "poll").alias("p"))
    sent = delivered.groupBy("run").agg(
        F.max(F.col("alert") == "initial copy done").alias("copy_now"), F.max(F.col("alert").isin(*FINAL)).alias("final_now")
    )
    now = last.join(sent, "run", "left")
    if state is not None:
        now = now.join(state, "run", "full_outer")
    else:
        now = now.withColumns(_fresh())
    no = F.lit(False)
    return now.select(
        "run",
        F.coalesce(F.col("p.status"), "last_status").alias("last_status"),
        F.coalesce(F.col("p.errors"), "last_errors").alias("last_errors"),
        (F.coalesce("copy_now", no) | F.coalesce("copy_sent", no)).alias("copy_sent"),
        (F.coalesce("final_now", no) | F.coalesce("final_sent", no)).alias("final_sent"),
    )
