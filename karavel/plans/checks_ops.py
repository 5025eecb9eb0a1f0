"""Registered queries: progress and lag, activity and alerts, cutover and cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from karavel.functions.expr import lsn_to_pos
from karavel.operators import activity as A, cutover as K, metrics as M
from karavel.operators.scope import Scope
from karavel.plans.checks import collector
from karavel.plans.fixtures import Tables
from karavel.session import shared_folder
from karavel.sources.logs import parse_log
from karavel.streaming.alerts import AlertLog, follow_alerts

CHECKS, check = collector()

AS_OF = 1707955200  # 2024-02-15 00:00:00, after the last event


# ------------------------------------------------------------------------------------------- metrics


@check("select event_id, pos from fx_change_log")
def m1_lsn_to_pos(t: Tables) -> DataFrame:
    return t["fx_change_log"].select("event_id", lsn_to_pos(F.col("lsn")).cast("bigint").alias("pos"))


@check("select event_id, pos - (22 * 4294967296 + 4194304) as gap from fx_change_log")
def m1_position_gap(t: Tables) -> DataFrame:
    gap = M.position_gap(F.lit("16/400000"), F.col("lsn")).cast("bigint")
    return t["fx_change_log"].select("event_id", gap.alias("gap"))


# byte positions of the three LSNs of each run
POSITIONS = """
select run, (22 + apply_id // 1000) * 4294967296 + (apply_id % 1000) * 4194304 as apply_pos,
       (22 + (stream_id + 60 * run) // 1000) * 4294967296 + ((stream_id + 60 * run) % 1000) * 4194304 as stream_pos,
       case when run % 6 = 5 then null else (22 + (source_id + 130 * run) // 1000) * 4294967296 + ((source_id + 130 * run) % 1000) * 4194304 end as source_pos
from fx_positions"""
LAG = f"""
select run, gap_bytes, gap_mb, gap_mb // 1024 as gap_gb, total_gap_bytes, total_gap_mb, total_gap_mb // 1024 as total_gap_gb,
       total_gap_mb - gap_mb as stream_to_source_mb, coalesce(total_gap_mb, gap_mb) <= 100 as caught_up, apply_pos
from (select *, gap_bytes // 1048576 as gap_mb, total_gap_bytes // 1048576 as total_gap_mb
      from (select run, apply_pos, greatest(stream_pos - apply_pos, 0) as gap_bytes,
                   case when source_pos is not null then greatest(source_pos - apply_pos, 0) end as total_gap_bytes
            from ({POSITIONS}) p) g) m"""
LAG_COLS = "run, gap_bytes, gap_mb, gap_gb, total_gap_bytes, total_gap_mb, total_gap_gb, stream_to_source_mb, caught_up"


@check(f"select {LAG_COLS} from ({LAG}) x")
def m2_replication_lag(t: Tables) -> DataFrame:
    return M.replication_lag(t["fx_run_positions"]).select(*LAG_COLS.split(", "))


@check(
    """
select event_id, (30 * 4294967296 + 255) - pos as flush_lag, (30 * 4294967296 + 255) - greatest(pos - 16, 0) as restart_lag
from fx_change_log"""
)
def m2_slot_health(t: Tables) -> DataFrame:
    slots = t.sql(
        """select event_id, lsn as confirmed_flush_lsn, '1E/FF' as current_lsn,
                  concat(hex(cast(floor((pos - 16) / 4294967296) as bigint)), '/', hex((pos - 16) % 4294967296)) as restart_lsn
           from fx_change_log"""
    )
    return M.slot_health(slots).select("event_id", "flush_lag", "restart_lag")


def _run_log(t: Tables) -> DataFrame:
    return parse_log(t["fx_run_log"])


TENTHS = "(case when {0} = 0 then '0' else concat(case when {0} // 10 = 0 then '' else cast({0} // 10 as varchar) end, '.', cast({0} % 10 as varchar)) end)"


def _eta(gb: str, mb: str, other: str) -> str:
    hours = TENTHS.format(f"({gb} * 100 // nullif(rate_gb10, 0))")
    return (
        f"case when {gb} > 0 and rate_gb10 > 0 then concat({hours}, 'h') "
        f"when {mb} > 0 then case when {mb} * 600 // rate_mb10 > 0 then concat(cast({mb} * 600 // rate_mb10 as varchar), 'm') else '<1m' end "
        f"else {other} end"
    )


@check(
    f"""
with f as (select run, arg_min(line, line_no) as line from fx_run_log where line like '%Apply reached%' group by run),
fp as (select run, (cast('0x' || regexp_extract(line, '([0-9A-F]+)/([0-9A-F]+)$', 1) as bigint)) * 4294967296
                   + cast('0x' || regexp_extract(line, '([0-9A-F]+)/([0-9A-F]+)$', 2) as bigint) as first_pos,
              cast(epoch(cast(substr(line, 1, 19) as timestamp)) as bigint) as first_epoch from f),
l as (select x.*, (apply_pos - first_pos) // 1048576 as applied_mb, {AS_OF} - first_epoch as elapsed_sec
      from ({LAG}) x left join fp on x.run = fp.run),
h as (select *, case when elapsed_sec > 60 and applied_mb > 0 then elapsed_sec * 10000 // 3600 end as hr from l),
r as (select *, nullif(applied_mb * 100000 // nullif(hr, 0), 0) as rate_mb10 from h),
q as (select *, rate_mb10 // 1024 as rate_gb10 from r),
e as (select *, case when rate_mb10 is not null then {_eta('gap_gb', 'gap_mb', 'null')} end as by_gap from q)
select run, applied_mb, elapsed_sec, rate_mb10, rate_gb10,
       case when rate_gb10 > 0 then concat({TENTHS.format('rate_gb10')}, ' GB/hr') when rate_mb10 > 0 then concat({TENTHS.format('rate_mb10')}, ' MB/hr') end as apply_rate,
       case when caught_up then null
            when total_gap_mb is not null and rate_mb10 is not null
              then case when total_gap_gb > 0 and rate_gb10 = 0 then by_gap else {_eta('total_gap_gb', 'total_gap_mb', 'by_gap')} end
            else by_gap end as eta
from e"""
)
def m3_apply_rate_eta(t: Tables) -> DataFrame:
    out = M.apply_rate_eta(_run_log(t), t["fx_run_positions"], AS_OF, ["run"])
    return out.select("run", "applied_mb", "elapsed_sec", "rate_mb10", "rate_gb10", "apply_rate", "eta")


def _errors_sql(pattern: str, length: int) -> str:
    hit = f"line like '%{pattern}%'"
    return f"""
select run, count(*) filter (where {hit}) as errors, left(arg_max(line, line_no) filter (where {hit}), {length}) as last_error,
       substr(arg_max(line, line_no), 1, 19) as last_log_ts
from fx_run_log group by run"""


@check(_errors_sql("ERROR", 100))
def m4_error_summary(t: Tables) -> DataFrame:
    return M.error_summary(_run_log(t), "ERROR", 100, ["run"])


@check(_errors_sql(" ERROR ", 24))
def m4_error_summary_word(t: Tables) -> DataFrame:
    return M.error_summary(_run_log(t), " ERROR ", 24, ["run"])


@check(
    r"""
with x as (
  select run, coalesce(cast(arg_max(regexp_extract(line, 'errors ignored on restore: ([0-9]+)', 1), line_no) filter (where line like '%errors ignored on restore: %') as bigint), 0) as restore_errors,
         coalesce(cast(arg_max(regexp_extract(line, 'tolerance of ([0-9]+)', 1), line_no) filter (where line like '%tolerance of %') as bigint),
                  cast(arg_max(regexp_extract(line, 'tolerance: ([0-9]+)', 1), line_no) filter (where line like '%tolerance: %') as bigint), 10) as tolerance
  from fx_run_log group by run)
select *, case when restore_errors = 0 then 'none' when restore_errors <= tolerance then 'within tolerance' else 'exceeds tolerance' end as state from x"""
)
def m5_tolerance_check(t: Tables) -> DataFrame:
    return M.tolerance_check(t["fx_run_log"], 10, ["run"])


COUNTERS = """
select (select count(*) from fx_s_table where oid not in (select oid from fx_s_table_part)) + (select count(*) from fx_s_table_part) as tables_total,
       (select count(distinct oid) from fx_s_table_part) as split_tables,
       count(*) filter (where tableoid is not null and start_ts is not null) as tables_started,
       count(*) filter (where tableoid is not null and done_ts is not null) as tables_done,
       cast(sum(case when tableoid is not null then bytes end) as bigint) as bytes,
       (select count(*) from fx_s_index) as indexes_total,
       count(distinct case when start_ts is not null then indexoid end) as indexes_started,
       count(distinct case when done_ts is not null then indexoid end) as indexes_done,
       (select count(*) from fx_s_constraint) as constraints_total,
       count(distinct case when start_ts is not null then conoid end) as constraints_started,
       count(distinct case when done_ts is not null then conoid end) as constraints_done
from fx_task_summary"""
PROGRESS_COLS = (
    "tables_total split_tables tables_started tables_done tables_running bytes indexes_total indexes_done indexes_running "
    "constraints_total constraints_done constraints_running tables_percent10 indexes_percent10 constraints_percent10 overall_percent10"
).split()


@check(
    f"""
select tables_total, split_tables, tables_started, tables_done, tables_started - tables_done as tables_running, bytes,
       indexes_total, indexes_done, indexes_started - indexes_done as indexes_running,
       constraints_total, constraints_done, constraints_started - constraints_done as constraints_running,
       tables_done * 1000 // tables_total as tables_percent10, indexes_done * 1000 // indexes_total as indexes_percent10,
       constraints_done * 1000 // constraints_total as constraints_percent10,
       (tables_done + indexes_done + constraints_done) * 1000 // (tables_total + indexes_total + constraints_total) as overall_percent10
from ({COUNTERS}) c"""
)
def m6_copy_progress(t: Tables) -> DataFrame:
    out = M.copy_progress(t["fx_s_table"], t["fx_s_table_part"], t["fx_task_summary"], t["fx_s_index"], t["fx_s_constraint"])
    return out.select(*PROGRESS_COLS)


RUN_COUNTERS = """
select user_id % 40 as run, count(*) as tables_total, count(*) filter (where event_type <> 'view' or user_id % 40 < 20) as tables_started,
       count(*) filter (where event_type <> 'view' or user_id % 40 < 10) as tables_done,
       case when user_id % 40 % 9 = 0 then 0 else 7 end as indexes_total, case when user_id % 40 % 9 = 0 then 0 else user_id % 40 % 8 end as indexes_started,
       case when user_id % 40 % 9 = 0 then 0 else user_id % 40 % 8 end as indexes_done,
       5 as constraints_total, user_id % 40 % 6 as constraints_started, case when user_id % 40 % 6 = 5 then 5 else 0 end as constraints_done,
       4 as vacuum_total, user_id % 40 % 5 as vacuum_done
from events group by user_id % 40"""


@check(
    f"""
with c as ({RUN_COUNTERS}),
m as (select run, {', '.join(f"bool_or(line like '%STEP {n}:%') as s{n}" for n in (1, 2, 3, 4, 8, 9, 10))}, bool_or(line like '%All step are now done%') as fin
      from fx_run_log group by run),
j as (select m.*, c.* exclude (run) from m join c on m.run = c.run)
select run, 1 as phase, case when s1 and s2 then 'done' when s1 then 'running' else 'pending' end as status from j
union all select run, 2, case when s2 and s3 then 'done' when s2 then 'running' else 'pending' end from j
union all select run, 3, case when s3 and (tables_started > 0 or s4) then 'done' when s3 then 'running' else 'pending' end from j
union all select run, 4, case when tables_total > 0 and tables_done = tables_total then 'done' when tables_started > 0 then 'running' else 'pending' end from j
union all select run, 6, case when indexes_total > 0 and indexes_done = indexes_total then 'done' when indexes_started > 0 then 'running' else 'pending' end from j
union all select run, 7, case when constraints_total > 0 and constraints_done = constraints_total then 'done' when constraints_started > 0 then 'running' else 'pending' end from j
union all select run, 8, case when vacuum_total > 0 and vacuum_done >= vacuum_total then 'done' when s9 then 'done' when vacuum_done > 0 then 'running' when s8 then 'running' else 'pending' end from j
union all select run, 9, case when s9 and (s10 or fin) then 'done' when s9 then 'running' else 'pending' end from j
union all select run, 10, case when s10 and fin then 'done' when s10 then 'running' else 'pending' end from j"""
)
def m7_phase_status(t: Tables) -> DataFrame:
    return M.phase_status(t["fx_run_log"], t.sql(RUN_COUNTERS), ["run"]).select("run", "phase", "status")


@check(
    """
select tableoid, partnumber, cast(bytes as double) as bytes, cast(epoch(done_ts) - epoch(start_ts) as bigint) as seconds
from fx_summary where done_ts is not null order by fx_summary.bytes desc, tableoid, partnumber limit 20"""
)
def m8_task_timing(t: Tables) -> DataFrame:
    out = M.task_timing(t["fx_summary"], 20)
    return out.select("tableoid", "partnumber", F.col("bytes").cast("double").alias("bytes"), "seconds")


@check("select tableoid, partnumber, cast(bytes as double) as bytes from fx_summary where done_ts is null")
def m8_tasks_running(t: Tables) -> DataFrame:
    return M.tasks_running(t["fx_summary"]).select("tableoid", "partnumber", F.col("bytes").cast("double").alias("bytes"))


SUB = "select r_regionkey as oid, r_name as subname from region"
REL = "select c_custkey % 7 as srsubid, c_custkey as srrelid, substr('idfsrx', cast(1 + c_custkey % 6 as int), 1) as srsubstate from customer"
CLS = "select c_custkey as oid, c_name as relname, c_nationkey as relnamespace from customer where c_custkey % 8 <> 0"
NS = "select n_nationkey as oid, n_name as nspname from nation where n_nationkey % 5 <> 0"


@check(
    f"""
select subname, nspname, relname, srsubstate,
       case srsubstate when 'i' then 'initializing' when 'd' then 'data is being copied' when 'f' then 'finished table copy'
                       when 's' then 'synchronized' when 'r' then 'ready (normal replication)' else '' end as state
from ({SUB}) s join ({REL}) r on s.oid = srsubid join ({CLS}) c on c.oid = srrelid join ({NS}) n on n.oid = relnamespace"""
)
def m9_sync_states(t: Tables) -> DataFrame:
    return M.sync_states(t.sql(SUB), t.sql(REL), t.sql(CLS), t.sql(NS))


STATES = "case event_type when 'error' then 'Bad' when 'view' then 'Good' when 'click' then 'No records found' else concat('Copying ', event_type) end"


@check(
    f"""
select event_id as report, 'Active' as status, case when event_id % 10 = 0 then 'in-progress' else 'finished' end as copy_phase,
       case when event_type in ('error', 'view') then {STATES} when event_type = 'click' then 'not-yet-started' else concat({STATES}, ' (good)') end as state,
       case when event_type = 'error' then concat('failed: key ', cast(user_id as varchar)) end as last_error,
       event_id % 50 + user_id as rows_changed,
       case when event_type <> 'click' then {AS_OF} - cast(epoch(date_trunc('second', ts)) as bigint) end as seconds_since,
       coalesce({AS_OF} - cast(epoch(date_trunc('second', ts)) as bigint) > 2000000 and event_type <> 'click', false) as stalled
from events"""
)
def m10_sync_report(t: Tables) -> DataFrame:
    reports = t["events"].select(
        F.col("event_id").alias("report"),
        F.explode(
            F.array(
                F.lit("======================================================================"),
                F.when(
                    F.col("event_type") != "click",
                    F.concat(
                        F.lit("Last good                : "), F.date_format("ts", "MMM dd, yyyy HH:mm:ss"), F.lit(" (time to run: 1s)")
                    ),
                ),
                F.concat(F.lit("Rows deleted/inserted    : "), F.col("event_id") % 50, F.lit(" / "), F.col("user_id")),
                F.concat(F.lit("Current state            : "), F.expr(STATES)),
                F.lit("Source relgroup/database : moved / primary"),
                F.lit("Status                   : Active"),
                F.lit("Overdue time             : 00:00:00"),
                F.concat(F.lit("Onetimecopy              : "), F.when(F.col("event_id") % 10 == 0, "Yes").otherwise("No")),
                F.concat(
                    F.lit("Last error:              : "),
                    F.when(F.col("event_type") == "error", F.concat(F.lit("failed: key "), F.col("user_id"))).otherwise(""),
                ),
            )
        ).alias("line"),
    )
    return M.sync_report(reports.filter("line is not null"), AS_OF, ["report"], stall_seconds=2_000_000)


@check(
    """
select task, status, load_percent, case when status = 'failed' then 'failed' when status = 'running' and load_percent = 100 then 'full load done' else 'wait' end as state
from (select *, row_number() over (partition by task order by poll desc) as rn from fx_task_polls) x where rn = 1"""
)
def m11_task_state(t: Tables) -> DataFrame:
    return M.task_state(t["fx_task_polls"])


@check(
    """
select task, status, case when status in ('passed', 'warning') then 'passed' when status = 'failed' then 'failed' else 'wait' end as state
from (select *, row_number() over (partition by task order by poll desc) as rn from fx_assessments) x where rn = 1"""
)
def m11_assessment_state(t: Tables) -> DataFrame:
    return M.assessment_state(t["fx_assessments"])


# ------------------------------------------------------------------------------------------ activity

AGE = f"{AS_OF} - cast(epoch(date_trunc('second', {{}})) as bigint)"
CLEAN = r"left(regexp_replace({}, '[\n\r]+', ' ', 'g'), {})"
HMS = """case when age_seconds >= 3600 then printf('%dh %02dm %02ds', age_seconds // 3600, age_seconds % 3600 // 60, age_seconds % 60)
              when age_seconds >= 60 then printf('%dm %02ds', age_seconds // 60, age_seconds % 60) else printf('%ds', age_seconds) end"""


def _sessions(t: Tables) -> DataFrame:
    blocked = F.when(F.col("blocked_by").isNotNull(), F.array("blocked_by")).otherwise(F.array().cast("array<bigint>"))
    return t["fx_sessions"].withColumn("blocked_by", blocked)


@check(
    rf"""
select pid, age_seconds, {HMS} as age, operation from (
select pid, {AGE.format('query_start')} as age_seconds,
       case when query like '%REFRESH MATERIALIZED VIEW%' then regexp_replace(query, '(?s).*REFRESH MATERIALIZED VIEW ([^;]+).*', 'REFRESH MATERIALIZED VIEW \1')
            when query like '%COPY%' then regexp_replace(query, '(?s).*COPY "?([^"]+)"?.*', 'COPY \1')
            when query like '%CREATE INDEX%' then regexp_replace(query, '(?s).*CREATE (UNIQUE )?INDEX ([^ ]+).*', 'CREATE INDEX \2')
            when query like '%ALTER TABLE%' then regexp_replace(query, '(?s).*ALTER TABLE ([^ ]+).*', 'ALTER TABLE \1')
            when query like '%VACUUM%' then regexp_replace(query, '(?s).*VACUUM[^"]*"?([^"]+)"?.*', 'VACUUM \1')
            else {CLEAN.format('query', 60)} end as operation
from fx_sessions where state = 'active' order by query_start, pid limit 50) x"""
)
def a1_active_operations(t: Tables) -> DataFrame:
    return A.active_operations(t["fx_sessions"], AS_OF, 50)


@check(
    """
select backend_type, coalesce(state, '-') as state, coalesce(wait_event_type, '(running)') as wait_type,
       coalesce(wait_event, '-') as wait_event, count(*) as sessions
from fx_sessions where backend_type is not null group by 1, 2, 3, 4"""
)
def a2_wait_summary(t: Tables) -> DataFrame:
    return A.wait_summary(t["fx_sessions"])


@check(
    f"""
select b.snap, b.pid as blocked_pid, coalesce(concat_null, '-') as waiting_on, g.pid as blocking_pid, g.state as blocker_state,
       {AGE.format('g.xact_start')} as blocker_xact_age, {CLEAN.format('b.query', 45)} as blocked_query, {CLEAN.format('g.query', 45)} as blocker_query
from (select *, wait_event_type || ':' || wait_event as concat_null from fx_sessions) b
join (select * from fx_sessions) g on b.snap = g.snap and b.blocked_by = g.pid"""
)
def a3_blocking_tree(t: Tables) -> DataFrame:
    return A.blocking_tree(_sessions(t), AS_OF)


@check("select snap, count(*) filter (where blocked_by is not null) as blocked from fx_sessions group by snap")
def a3_blocked_sessions(t: Tables) -> DataFrame:
    return A.blocked_sessions(_sessions(t))


@check(
    f"""
select l.snap, l.pid, l.lock_id, l.locktype, l.mode, coalesce(l.relation, '-') as relation,
       coalesce(s.wait_event_type || ':' || s.wait_event, '-') as wait, {CLEAN.format('s.query', 40)} as query, s.blocked_by
from fx_lock_requests l join (select * from fx_sessions) s on l.snap = s.snap and l.pid = s.pid where not l.granted"""
)
def a4_lock_waits(t: Tables) -> DataFrame:
    waits = A.lock_waits(_sessions(t), t["fx_lock_requests"])
    return waits.withColumn("blocked_by", F.element_at(F.nullif("blocked_by", F.array().cast("array<bigint>")), 1))


COPIES = """
select snap, pid, concat('t', cast(pid as varchar(20))) as relation, pid * 1000 + snap as bytes_processed, pid + snap as tuples_processed
from fx_sessions where state = 'active'"""
VACUUMS = """
select snap, pid, concat('t', cast(pid as varchar(20))) as relation, 'scanning heap' as phase,
       case when pid % 4 = 0 then cast(0 as bigint) else pid * 16 end as blocks_total, pid * 16 // 3 as blocks_scanned
from fx_sessions where state <> 'active'"""


@check(
    f"""
select p.*, coalesce(s.wait_event_type || ':' || s.wait_event, '(running)') as wait, {AGE.format('s.query_start')} as copy_age
from ({COPIES}) p join (select * from fx_sessions) s on p.snap = s.snap and p.pid = s.pid"""
)
def a5_copy_progress(t: Tables) -> DataFrame:
    return A.copy_progress_sessions(t.sql(COPIES), t["fx_sessions"], AS_OF)


@check(
    f"""
select p.snap, p.pid, p.relation, p.phase, coalesce(s.wait_event, '(running)') as wait, {AGE.format('s.xact_start')} as age,
       cast(round(cast(100 * blocks_scanned as decimal(30,6)) / nullif(blocks_total, 0), 1) as double) as pct_scanned
from ({VACUUMS}) p join (select * from fx_sessions) s on p.snap = s.snap and p.pid = s.pid"""
)
def a5_vacuum_progress(t: Tables) -> DataFrame:
    return A.vacuum_progress_sessions(t.sql(VACUUMS.replace("//", "div")), t["fx_sessions"], AS_OF)


@check(
    f"""
select pid, {AGE.format('xact_start')} as idle_seconds, {CLEAN.format('query', 40)} as last_query,
       (select count(*) from fx_sessions where state = 'idle in transaction') as sessions
from (select * from fx_sessions) s where state = 'idle in transaction' order by xact_start, pid limit 20"""
)
def a6_idle_in_transaction(t: Tables) -> DataFrame:
    return A.idle_in_transaction(t["fx_sessions"], AS_OF, 20)


@check(
    """
with p as (select *, lag(sample_ts) over w as p_ts, lag(pos) over w as p_pos, lag(size_bytes) over w as p_size
           from fx_samples window w as (partition by server order by sample_ts)),
d as (select server, sample_ts, cast(epoch(sample_ts) - epoch(p_ts) as bigint) as seconds, pos - p_pos as wal_bytes,
             cast(floor(greatest(size_bytes - p_size, 0)) as bigint) as growth
      from p where p_ts is not null)
select *, growth // seconds as growth_per_second from d"""
)
def a7_throughput(t: Tables) -> DataFrame:
    return A.throughput(t["fx_samples"])


@check(
    """
with b as (select snap, count(*) filter (where blocked_by is not null) as blocked from fx_sessions group by snap),
u as (select snap, count(*) filter (where not granted) as ungranted from fx_lock_requests group by snap)
select b.snap, blocked, coalesce(ungranted, 0) as ungranted, case when blocked > 0 or coalesce(ungranted, 0) > 0 then 'lock involved' else 'feed or IO' end as verdict
from b left join u on b.snap = u.snap"""
)
def a8_stall_verdict(t: Tables) -> DataFrame:
    return A.stall_verdict(_sessions(t), t["fx_lock_requests"])


ALERTS = """
with p as (select *, lag(status) over w as prev, lag(errors, 1, cast(0 as bigint)) over w as prev_errors,
                  copy_done and count(*) filter (where copy_done) over (partition by run order by poll rows between unbounded preceding and current row) = 1 as is_copy
           from fx_polls window w as (partition by run order by poll)),
f as (select *, status in ('succeeded', 'failed') and not is_copy as may_end from p),
e as (select *, may_end and count(*) filter (where may_end) over (partition by run order by poll rows between unbounded preceding and current row) = 1 as is_end from f)
select run, poll, case when is_copy then 'initial copy done' when is_end then status else 'stopped' end as alert, cast(null as bigint) as new_errors
from e where is_copy or is_end or (status = 'stopped' and prev = 'running')
union all
select run, poll, 'new errors', errors - prev_errors from e where errors > prev_errors"""


@check(ALERTS)
def a9_alert_events(t: Tables) -> DataFrame:
    return A.alert_events(t["fx_polls"])


@check(ALERTS)
def a9_alert_stream_two_checkpoints(t: Tables) -> DataFrame:
    """A second checkpoint counts its batches from 0 again; the log goes on with the state of the first."""
    out, polls = shared_folder(t.spark, "a9", "out"), t["fx_polls"]
    log, cut = AlertLog(t.spark, out), polls.approxQuantile("poll", [0.5], 0.01)[0]
    for part in (F.col("poll") <= cut, F.col("poll") > cut):
        folder = shared_folder(t.spark, "a9", "in")
        polls.filter(part).write.parquet(folder)
        follow_alerts(t.spark.readStream.schema(polls.schema).parquet(folder), log, shared_folder(t.spark, "a9", "state")).awaitTermination()
    return log.alerts()


@check(ALERTS)
def a9_alert_stream(t: Tables) -> DataFrame:
    folder, out, state = (shared_folder(t.spark, "a9", n) for n in ("in", "out", "state"))
    polls = t["fx_polls"]
    cuts = polls.approxQuantile("poll", [0.3, 0.6], 0.01)
    part = F.when(F.col("poll") <= cuts[0], 0).when(F.col("poll") <= cuts[1], 1).otherwise(2)
    marked = polls.withColumn("part", part)
    log = AlertLog(t.spark, out)
    for n in range(3):  # polls come in order, so each later lot is a batch of its own
        marked.filter(F.col("part") == n).drop("part").write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(polls.schema).parquet(folder)
        follow_alerts(stream, log, state).awaitTermination()
    return log.alerts()


# ------------------------------------------------------------------------------------------- cutover


@check(
    """
select ts, status, lead(ts) over (order by ts) - ts as seconds from fx_ledger where ts >= 6000"""
)
def k1_timeline(t: Tables) -> DataFrame:
    return K.timeline(t["fx_ledger"], 6000)


MARKERS = "select user_id % 40 as run, max(case when event_id % 50 = 7 then 1 else 0 end) = 1 as arrived from events group by user_id % 40"
VERDICTS = "select user_id % 40 as run, cast(user_id % 40 % 4 as int) as exit_code from events where user_id % 40 <> 39 group by user_id % 40"


@check(
    f"""
select l.run, caught_up, arrived as marker_arrived, coalesce(exit_code < 2, false) as verified,
       caught_up and arrived and coalesce(exit_code < 2, false) as ready
from ({LAG}) l join ({MARKERS}) m on l.run = m.run left join ({VERDICTS}) v on l.run = v.run"""
)
def k2_cutover_ready(t: Tables) -> DataFrame:
    return K.cutover_ready(M.replication_lag(t["fx_run_positions"]), t.sql(MARKERS), t.sql(VERDICTS))


SAMPLES = "select seq, 1700000000 + seq % 977 as ts, src_last as t0, src_last + seq % 100 as t1 from fx_seq"


@check(f"select seq, t1 + ((1700001000 - ts) // 10 + 3600 // 10) * (t1 - t0) as new_last from ({SAMPLES}) s")
def k3_fast_forward(t: Tables) -> DataFrame:
    return K.fast_forward(t.sql(SAMPLES), 1_700_001_000)


@check("select kind, count(*) as objects from fx_inv_src where not owned_by_ext group by kind")
def k4_inventory_counts(t: Tables) -> DataFrame:
    inv = t["fx_inv_src"]
    return K.inventory_counts(inv, inv.filter("owned_by_ext"))


@check(
    "select schema_name, count(*) as objects from fx_inv_tgt where not owned_by_ext and kind = 'table' "
    "group by schema_name order by count(*) desc, schema_name limit 15"
)
def k4_schema_counts(t: Tables) -> DataFrame:
    inv = t["fx_inv_tgt"]
    return K.schema_counts(inv, inv.filter("owned_by_ext"), "table")


RESET = "not owned_by_ext and kind <> 'extension' and schema_name <> 's2' and schema_name not in ('s3', 's0')"


@check(
    f"""
select kind, schema_name, name, concat('DROP ', upper(kind), ' IF EXISTS `', schema_name, '`.`', name, '`') as statement
from fx_inv_tgt where {RESET}"""
)
def k5_reset_plan(t: Tables) -> DataFrame:
    inv = t["fx_inv_tgt"].filter("kind <> 'extension'")
    return K.reset_plan(inv, Scope(exclude_schema=["s2"]), K.PROTECTED_SCHEMAS + ("s3", "s0"), inv.filter("owned_by_ext"))


@check(f"select kind, schema_name, name from fx_inv_tgt where not ({RESET}) order by kind, schema_name, name limit 20")
def k5_residue(t: Tables) -> DataFrame:
    return K.residue(t["fx_inv_tgt"], k5_reset_plan(t))


LEFT = """
select case s_suppkey % 6 when 0 then 'table' when 1 then 'sequence' when 2 then 'event trigger' when 3 then 'publication'
                          when 4 then 'replication slot' else 'replication set' end as kind,
       'public' as schema_name,
       concat(case s_nationkey % 5 when 0 then 'awsdms_' when 1 then 'my_dms_' when 2 then 'dty' when 3 then repeat('long_name_', 6) else 'app_' end,
              cast(s_suppkey as varchar(20))) as name,
       s_suppkey % 4 = 0 as active, s_suppkey * 100 as bytes
from supplier"""
FOUND = f"""
select kind, schema_name, name, case when active then 'warn' else 'drop' end as action from ({LEFT}) l
where (kind in ('table', 'sequence', 'event trigger') and name like 'awsdms_%')
   or (kind in ('publication', 'replication slot') and name like '%dms%')
   or (kind = 'replication set' and (name like '%dms%' or name like '%dty%' or length(name) > 50))"""


@check(FOUND)
def k6_artefacts(t: Tables) -> DataFrame:
    return K.artefacts(t.sql(LEFT)).select("kind", "schema_name", "name", "action")


@check(
    f"""
select kind, count(*) as found, count(*) filter (where action = 'drop') as dropped, count(*) filter (where action = 'warn') as remaining
from ({FOUND}) f group by kind"""
)
def k6_artefact_counts(t: Tables) -> DataFrame:
    return K.artefact_counts(K.artefacts(t.sql(LEFT)))


@check(f"select schema_name, name, bytes from ({LEFT}) l where kind = 'table' and name not like 'awsdms_%'")
def k6_business_tables(t: Tables) -> DataFrame:
    inv = t.sql(LEFT)
    return K.business_tables(inv, inv, "public")
