"""Figures against the same steps in plain integers and decimals."""

import random
from decimal import ROUND_DOWN, Decimal

import pytest
from pyspark.sql import functions as F

from karavel.functions.expr import age_text, tenths_text
from karavel.operators import metrics as M
from karavel.sources.logs import parse_log

MB, GB = 1024**2, 1024**3


def lsn(pos):
    return None if pos is None else f"{pos >> 32:X}/{pos & 0xFFFFFFFF:X}"


def trunc(x, places):
    return x.quantize(Decimal(1).scaleb(-places), rounding=ROUND_DOWN)


def show(x):
    """As a shell calculator prints a number with one decimal place."""
    if x == 0:
        return "0"
    text = f"{x:.1f}"
    return text[1:] if text.startswith("0") else text


def calculator(apply, stream, source, first, elapsed):
    rate_text = eta = None
    gap_mb = max(stream - apply, 0) // MB
    gap_gb, total_mb = gap_mb // 1024, None
    caught = gap_mb <= 100
    rate_mb = rate_gb = None
    applied = (apply - first) // MB if apply >= first else -((first - apply) // MB)
    if elapsed > 60 and applied > 0:
        hours = trunc(Decimal(elapsed) / 3600, 4)
        rate_mb = trunc(Decimal(applied) / hours, 1)
        if rate_mb != 0:
            rate_gb = trunc(rate_mb / 1024, 1)
            rate_text = f"{show(rate_gb)} GB/hr" if rate_gb else f"{show(rate_mb)} MB/hr"

            def minutes(mb):
                m = int(mb * 60 / rate_mb)
                return f"{m}m" if m else "<1m"

            if gap_gb > 0 and rate_gb:
                eta = show(trunc(gap_gb / rate_gb, 1)) + "h"
            elif gap_mb > 0:
                eta = minutes(gap_mb)
    if source is not None:
        total_mb = max(source - apply, 0) // MB
        total_gb = total_mb // 1024
        caught = total_mb <= 100
        if not caught and rate_mb:
            if total_gb > 0:
                if rate_gb:
                    eta = show(trunc(total_gb / rate_gb, 1)) + "h"
            elif total_mb > 0:
                eta = minutes(total_mb)
    return rate_text, (None if caught else eta), caught


def test_rate_and_eta_equal_a_calculator(spark):
    rnd = random.Random(2)
    runs, logs, as_of = [], [], 1_700_000_000
    for run in range(300):
        first = rnd.randrange(2**40)
        apply = first + rnd.choice([0, -5 * MB, rnd.randrange(50 * MB), rnd.randrange(400 * GB)])
        apply = max(apply, 0)
        stream = apply + rnd.choice([-7, 0, 100 * MB, 101 * MB, rnd.randrange(900 * MB), rnd.randrange(300 * GB)])
        source = rnd.choice([None, stream, stream + rnd.randrange(200 * MB), stream + rnd.randrange(90 * GB)])
        stream, source = max(stream, 0), None if source is None else max(source, 0)
        elapsed = rnd.choice([10, 60, 61, 3600, rnd.randrange(61, 900_000)])
        runs.append((run, apply, stream, source, first, elapsed))
        logs.append((run, 5, f"Apply reached {lsn(first)} in /x/00.sql", as_of - elapsed))
        logs.append((run, 9, f"Apply reached {lsn(first + 99)}", as_of - elapsed + 5))
        logs.append((run, 1, "something else 1/2", 0))
    log = spark.createDataFrame(logs, "run bigint, line_no bigint, message string, e bigint").withColumn("ts", F.timestamp_seconds("e"))
    rows = [(r[0], lsn(r[1]), lsn(r[2]), lsn(r[3])) for r in runs]
    pos = spark.createDataFrame(rows, "run bigint, replay_lsn string, write_lsn string, source_lsn string")
    out = M.apply_rate_eta(log, pos, as_of, ["run"])
    got = {r["run"]: (r["apply_rate"], r["eta"], r["caught_up"]) for r in out.collect()}
    assert got == {r[0]: calculator(*r[1:]) for r in runs}


def test_lag_with_unknown_positions(spark):
    rows = [(1, "1/0", None, "0/0"), (2, None, "1/0", "1/0"), (3, "FFFFFFFF/0", "FFFFFFFF/6400000", "FFFFFFFF/6500000")]
    out = M.replication_lag(spark.createDataFrame(rows, "run bigint, replay_lsn string, write_lsn string, source_lsn string"))
    got = {r["run"]: (r["gap_mb"], r["total_gap_mb"], r["caught_up"]) for r in out.collect()}
    assert got == {1: (None, 0, True), 2: (None, None, False), 3: (100, 101, False)}


@pytest.mark.parametrize("n, text", [(0, "0"), (5, ".5"), (10, "1.0"), (123, "12.3")])
def test_tenths(spark, n, text):
    assert spark.range(1).select(tenths_text(F.lit(n))).first()[0] == text


@pytest.mark.parametrize("n, text", [(0, "0s"), (59, "59s"), (60, "1m 00s"), (3661, "1h 01m 01s"), (360000, "100h 00m 00s")])
def test_age(spark, n, text):
    assert spark.range(1).select(age_text(F.lit(n).cast("bigint"))).first()[0] == text


def test_error_patterns_differ(spark):
    lines = ["2024-01-01 00:00:01 1 ERROR  one", "2024-01-01 00:00:02 1 INFO   ERRORS: none", "2024-01-01 00:00:03 1 INFO   end"]
    log = parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string"))
    anywhere, word = M.error_summary(log).first(), M.error_summary(log, " ERROR ", 25).first()
    assert (anywhere["errors"], anywhere["last_error"]) == (2, lines[1])
    assert (word["errors"], word["last_error"], word["last_log_ts"]) == (1, lines[0][:25], "2024-01-01 00:00:03")
    none = M.error_summary(log.filter("line_no > 5")).first()
    assert (none["errors"], none["last_error"], none["last_log_ts"]) == (0, None, None)


@pytest.mark.parametrize(
    "lines, want",
    [
        ([], (0, 10, "none")),
        (["errors ignored on restore: 10"], (10, 10, "within tolerance")),
        (["errors ignored on restore: 11"], (11, 10, "exceeds tolerance")),
        (["errors ignored on restore: 99", "tolerance: 3", "within tolerance of 20", "errors ignored on restore: 12"], (12, 20, "within tolerance")),
        (["tolerance: 3", "errors ignored on restore: 4"], (4, 3, "exceeds tolerance")),
    ],
)
def test_tolerance(spark, lines, want):
    log = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    assert tuple(M.tolerance_check(log).first()) == want


def progress(spark, **n):
    def table(k, names):
        return spark.createDataFrame(n.get(k, []), names)

    return M.copy_progress(
        table("s_table", "oid bigint"),
        table("s_part", "oid bigint, part bigint"),
        table("summary", "tableoid bigint, indexoid bigint, conoid bigint, bytes bigint, start_ts timestamp_ntz, done_ts timestamp_ntz"),
        table("s_index", "indexoid bigint"),
        table("s_constraint", "conoid bigint"),
    ).first()


def test_progress(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    summary = [(1, None, None, 10, t, t), (2, None, None, 5, t, None), (2, None, None, 5, t, t), (None, 7, None, 0, t, t), (None, 7, None, 0, t, None), (None, None, 9, 0, t, None)]
    r = progress(spark, s_table=[(1,), (2,), (3,)], s_part=[(2, 1), (2, 2)], summary=summary, s_index=[(7,), (8,)], s_constraint=[(9,)])
    assert (r["tables_total"], r["tables_started"], r["tables_done"], r["tables_running"], r["bytes"]) == (4, 3, 2, 1, 20)
    assert (r["indexes_total"], r["indexes_done"], r["indexes_running"], r["constraints_running"]) == (2, 1, 0, 1)
    assert (r["tables_percent10"], r["indexes_percent10"], r["constraints_percent10"], r["overall_percent10"]) == (500, 500, 0, 428)


def test_progress_of_nothing(spark):
    r = progress(spark)
    assert r["tables_total"] == 0 and r["tables_percent10"] == 0 and r["overall_percent10"] is None and r["bytes"] == 0


def phases(spark, marks, **counters):
    lines = [(1, i, m) for i, m in enumerate(marks or ["start"])]
    log = spark.createDataFrame(lines, "run bigint, line_no bigint, line string")
    names = [f"{k}_{w}" for k in ("tables", "indexes", "constraints") for w in ("total", "started", "done")] + ["vacuum_total", "vacuum_done"]
    row = spark.createDataFrame([(1, *[counters.get(n, 0) for n in names])], "run bigint, " + ", ".join(f"{n} bigint" for n in names))
    return {r["phase"]: r["status"] for r in M.phase_status(log, row, ["run"]).collect()}


def test_phases(spark):
    assert set(phases(spark, []).values()) == {"pending"} and 5 not in phases(spark, [])
    assert phases(spark, ["STEP 10: x"])[1] == "pending"  # the mark of step 10 is no mark of step 1
    p = phases(spark, ["STEP 1: a", "STEP 2: b", "STEP 3: c"], tables_total=5, tables_started=3, tables_done=2, vacuum_total=5, vacuum_done=1)
    assert [p[n] for n in (1, 2, 3, 4, 6, 8, 9)] == ["done", "done", "done", "running", "pending", "running", "pending"]
    p = phases(spark, ["STEP 9: a", "All step are now done"], tables_total=1, tables_started=1, tables_done=1)
    assert [p[n] for n in (4, 6, 8, 9, 10)] == ["done", "pending", "done", "done", "pending"]


REPORT = """======================================================================
Last good                : Aug 13, 2025 04:07:43 (time to run: 1s)
Rows deleted/inserted    : 3 / 40
Sync name                : moved
Current state            : {}
Source relgroup/database : moved / origin
Status                   : Active
Onetimecopy              : {}
Post-copy analyze        : Yes
Last error:              :{}
======================================================================"""


def test_sync_reports(spark):
    texts = {1: REPORT.format("Good", "No", ""), 2: REPORT.format("Bad", "Yes", " broken : twice"), 3: REPORT.format("No records found", "No", " "), 4: "Current state            : Delayed"}
    rows = [(i, line) for i, t in texts.items() for line in t.splitlines()]
    as_of = 1755058063 + 61
    out = M.sync_report(spark.createDataFrame(rows, "report bigint, line string"), as_of, ["report"])
    got = {r["report"]: tuple(r)[1:] for r in out.collect()}
    assert got == {
        1: ("Active", "finished", "Good", None, 43, 61, True),
        2: ("Active", "in-progress", "Bad", "broken : twice", 43, 61, True),
        3: ("Active", "finished", "not-yet-started", None, 43, 61, True),
        4: (None, "finished", "Delayed (good)", None, None, None, False),
    }
