"""Input views derived from the driver tables, one SQL text for Spark and for the checking engine.

``Tables`` gives them as DataFrames, ``with_views`` puts them before a checking statement as CTEs.
Views may use only tables and views named before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from karavel.functions.ordered import running_sum
from karavel.operators.changes import net_changes
from karavel.sources.snapshot import read_for_statistics

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "fx_orders": """
select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)) as o_totalprice,
       o_orderdate, o_orderpriority
from orders""",
    "fx_orders_tgt": """
select o_orderkey, o_custkey, o_orderstatus,
       cast(case when o_orderkey % 101 = 0 then o_totalprice + 1 else o_totalprice end as decimal(18,2)) as o_totalprice,
       o_orderdate, o_orderpriority
from orders where o_orderkey % 97 <> 0
union all
select o_orderkey + 1000000000, o_custkey, o_orderstatus, cast(o_totalprice as decimal(18,2)), o_orderdate, o_orderpriority
from orders where o_orderkey % 211 = 0""",
    "fx_lineitem": """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem""",
    "fx_lineitem_tgt": """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_partkey % 89 <> 0
union all
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_partkey % 97 = 0""",
    "fx_lineitem_changes": """
select 'D' as op, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_partkey % 89 = 0
union all
select 'I' as op, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_partkey % 97 = 0""",
    "fx_change_log": """
select event_id,
       concat(hex(22 + cast(floor(event_id / 1000) as bigint)), '/', hex((event_id % 1000) * 4194304)) as lsn,
       (22 + cast(floor(event_id / 1000) as bigint)) * 4294967296 + (event_id % 1000) * 4194304 as pos,
       case when event_type = 'signup' then 'I' when event_type = 'error' then 'D' else 'U' end as op,
       user_id as k, event_type, cast(value as decimal(18,2)) as v, ts
from events""",
    "fx_net": """
select k, op, v, pos
from (select *, row_number() over (partition by k order by pos desc) as rn from fx_change_log) x
where rn = 1 and op <> 'D'""",
    # a keyed table before the changes: one row per even user id of the log
    "fx_base": """
select user_id as k, cast(min(value) as decimal(18,2)) as v from events where user_id % 2 = 0 group by user_id""",
    "fx_s_table": """
select cast(c_custkey as bigint) as oid, concat('ns', cast(c_nationkey as varchar(10))) as nspname, c_name as relname
from customer""",
    "fx_s_table_part": """
select o_custkey as oid, o_orderkey as partnumber from orders join customer on o_custkey = c_custkey
where c_nationkey % 5 = 0""",
    "fx_summary": """
select o_custkey as tableoid, o_orderkey as partnumber,
       case when o_orderstatus = 'P' then null else o_orderdate end as start_ts,
       case when o_orderstatus = 'F' then o_orderdate + interval '1' day else null end as done_ts,
       cast(o_totalprice as decimal(18,2)) as bytes
from orders join customer on o_custkey = c_custkey where c_nationkey % 5 = 0""",
    # index and constraint catalog: one index per supplier, one constraint per part; their tasks
    "fx_s_index": "select s_suppkey as indexoid, s_nationkey as tableoid from supplier",
    "fx_s_constraint": "select p_partkey as conoid, p_size as tableoid from part",
    "fx_task_summary": """
select tableoid, cast(null as bigint) as indexoid, cast(null as bigint) as conoid, bytes, start_ts, done_ts from fx_summary
union all
select cast(null as bigint), l_suppkey, cast(null as bigint), cast(0 as decimal(18,2)),
       case when l_suppkey % 3 = 0 then null else l_shipdate end,
       case when l_suppkey % 3 = 1 then l_shipdate else null end
from lineitem
union all
select cast(null as bigint), cast(null as bigint), l_partkey, cast(0 as decimal(18,2)),
       case when l_partkey % 5 = 0 then null else l_shipdate end,
       case when l_partkey % 5 < 3 then null else l_shipdate end
from lineitem""",
    "fx_activity": """
select event_id as snap_id, user_id as pid, ts as query_start,
       case event_type when 'view' then 'active' when 'click' then 'active' when 'purchase' then 'idle in transaction'
                       when 'signup' then 'idle' else 'active' end as state,
       case event_type when 'error' then 'Lock' when 'view' then 'IO' when 'click' then 'Client' else null end as wait_event_type,
       case when event_type = 'error' then (user_id + 1) % 150 else null end as blocked_by
from events""",
    # one row per snapshot (100 events) and session, with statement texts of every kind that A1 knows
    "fx_sessions": """
select m.snap, a.pid, a.query_start, a.state, a.wait_event_type,
       case when a.wait_event_type is null then null else concat(a.wait_event_type, 'Wait') end as wait_event,
       case when a.snap_id % 9 = 0 then null when a.snap_id % 9 < 3 then 'autovacuum worker' else 'client backend' end as backend_type,
       a.query_start as xact_start, a.blocked_by,
       case a.snap_id % 7
            when 0 then concat('REFRESH MATERIALIZED VIEW mv_', cast(a.pid as varchar(20)), '; select 1')
            when 1 then concat('COPY "tab_', cast(a.pid as varchar(20)), '" FROM STDIN')
            when 2 then concat('CREATE INDEX ix_', cast(a.pid as varchar(20)), ' ON t (a)')
            when 3 then concat('ALTER TABLE t_', cast(a.pid as varchar(20)), ' ADD PRIMARY KEY (a)')
            when 4 then concat('VACUUM ANALYZE "tab_', cast(a.pid as varchar(20)), '"')
            when 5 then concat('CREATE UNIQUE INDEX ux_', cast(a.pid as varchar(20)), ' ON t (a)')
            else concat('select ', cast(a.snap_id as varchar(20)), chr(10), chr(10), 'from a_table_with_a_rather_long_name where x = 1 and y = 2')
       end as query
from fx_activity a
join (select cast(floor(snap_id / 100) as bigint) as snap, pid, max(snap_id) as last_id
      from fx_activity group by cast(floor(snap_id / 100) as bigint), pid) m on a.snap_id = m.last_id""",
    "fx_locks": """
select user_id as pid, event_id as snap_id, case when event_id % 2 = 0 then 'relation' else 'tuple' end as locktype,
       event_id % 3 = 0 as granted
from events where event_type in ('error', 'view')""",
    "fx_lock_requests": """
select cast(floor(snap_id / 100) as bigint) as snap, pid, snap_id as lock_id, locktype,
       case when locktype = 'relation' then 'ExclusiveLock' else 'ShareLock' end as mode,
       case when snap_id % 5 = 0 then null else concat('t', cast(snap_id % 50 as varchar(10))) end as relation, granted
from fx_locks""",
    "fx_log_lines": """
select event_id as line_no,
       concat(cast(date_trunc('second', ts) as varchar(19)), ' ', cast(user_id as varchar(20)), ' ',
              case when event_type = 'error' then 'ERROR' else 'INFO' end, ' ',
              case when event_type = 'purchase'
                     then concat('Apply reached ', hex(22 + cast(floor(event_id / 1000) as bigint)), '/', hex((event_id % 1000) * 4194304))
                   when event_type = 'signup' then concat('STEP ', cast(1 + event_id % 10 as varchar(4)), ': run')
                   else event_type end) as line
from events""",
    # the same lines, one log per (user id modulo 40), with restore reports and end marks in some of them
    "fx_run_log": """
select event_id as line_no, user_id % 40 as run,
       concat(cast(date_trunc('second', ts) as varchar(19)), ' ', cast(user_id as varchar(20)), ' ',
              case when event_type = 'error' then 'ERROR' else 'INFO' end, ' ',
              case when event_type = 'purchase'
                     then concat('Apply reached ', hex(22 + cast(floor(event_id / 1000) as bigint)), '/', hex((event_id % 1000) * 4194304))
                   when event_type = 'signup' and (user_id % 40) % 4 <> 3 then concat('STEP ', cast(1 + event_id % (3 + (user_id % 40) % 8) as varchar(4)), ': run')
                   when event_type = 'click' and event_id % 3 = 0 and (user_id % 40) % 5 <> 0
                     then concat('errors ignored on restore: ', cast(event_id % 17 as varchar(4)),
                                 case when (user_id % 40) % 3 = 0 then ' within tolerance of ' when (user_id % 40) % 3 = 1 then ' exceeds tolerance: ' else ' end ' end,
                                 case when (user_id % 40) % 3 = 2 then '' else cast(5 + event_id % 9 as varchar(4)) end)
                   when event_type = 'view' and event_id % 11 = 0 and (user_id % 40) % 2 = 0 then 'All step are now done'
                   else event_type end) as line
from events""",
    "fx_positions": """
select user_id % 40 as run, max(case when event_type = 'purchase' then event_id else 0 end) as apply_id,
       max(case when event_type in ('purchase', 'click') then event_id else 0 end) as stream_id, max(event_id) as source_id
from events group by user_id % 40""",
    "fx_run_positions": """
select run,
       concat(hex(22 + cast(floor(apply_id / 1000) as bigint)), '/', hex((apply_id % 1000) * 4194304)) as replay_lsn,
       concat(hex(22 + cast(floor((stream_id + 60 * run) / 1000) as bigint)), '/', hex(((stream_id + 60 * run) % 1000) * 4194304)) as write_lsn,
       case when run % 6 = 5 then null
            else concat(hex(22 + cast(floor((source_id + 130 * run) / 1000) as bigint)), '/', hex(((source_id + 130 * run) % 1000) * 4194304)) end as source_lsn
from fx_positions""",
    "fx_seq": """
select p_partkey as seq, cast(p_size as bigint) * 1000 as src_last,
       case when p_partkey % 13 = 0 then null
            when p_partkey % 7 = 0 then cast(p_size as bigint) * 1000 - 5
            else cast(p_size as bigint) * 1000 + 3 end as tgt_last
from part""",
    "fx_inv_src": """
select case p_size % 5 when 0 then 'table' when 1 then 'view' when 2 then 'function' when 3 then 'index' else 'extension' end as kind,
       concat('s', cast(p_size % 10 as varchar(4))) as schema_name, concat('obj_', cast(p_partkey as varchar(20))) as name,
       p_type as definition, p_partkey % 17 <> 0 as readable, p_partkey % 19 = 0 as owned_by_ext
from part""",
    "fx_inv_tgt": """
select kind, schema_name, name,
       case when try_cast(substr(name, 5) as bigint) % 101 = 0 then concat(definition, ' changed') else definition end as definition,
       readable, owned_by_ext
from fx_inv_src where try_cast(substr(name, 5) as bigint) % 97 <> 0
union all
select 'table', concat('s', cast(s_nationkey % 10 as varchar(4))), concat(case when s_suppkey % 4 = 0 then 'awsdms_' else 'extra_' end, cast(s_suppkey as varchar(20))), 'x', true, false
from supplier""",
    # relations with the flags that the read check looks at; schema s4 has no usage right
    "fx_relations": """
select concat('s', cast(p_size % 10 as varchar(4))) as schema_name, concat('rel_', cast(p_partkey as varchar(20))) as name,
       case p_partkey % 4 when 0 then 'sequence' when 1 then 'matview' else 'table' end as kind,
       case when p_size % 10 = 1 then true
            when p_size % 10 = 2 then p_partkey % 4 <> 2
            when p_size % 10 = 3 then p_partkey % 4 <> 0
            else p_partkey % 17 <> 0 end as readable,
       p_size % 10 <> 4 as schema_usable
from part""",
    # scope definitions: eight sections spread over many scopes
    "fx_scopes": """
select s_nationkey as scope_id,
       case s_suppkey % 6 when 0 then 'include-only-table' when 1 then 'exclude-schema' when 2 then 'exclude-table'
                          when 3 then 'include-only-schema' when 4 then 'exclude-extension' else 'exclude-event-trigger' end as section,
       concat('s', cast(s_suppkey % 10 as varchar(4)), '.', s_name) as entry
from supplier""",
    "fx_stats": """
select o_custkey as tbl, case when o_custkey % 50 = 0 then cast(0 as bigint) else cast(count(*) as bigint) end as src_rows,
       cast(sum(case when o_orderkey % 7 = 0 then 0 else 1 end) as bigint) as tgt_rows,
       cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(28,2)) as bytes
from orders group by o_custkey""",
    "fx_samples": """
select user_id % 5 as server, date_trunc('hour', ts) as sample_ts, max(pos) as pos, cast(sum(v) as decimal(28,2)) as size_bytes
from (select k as user_id, ts, pos, v from fx_change_log) x group by user_id % 5, date_trunc('hour', ts)""",
    "fx_polls": """
select user_id as run, event_id as poll,
       case event_type when 'purchase' then 'succeeded' when 'signup' then 'stopped' else 'running' end as status,
       cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as errors,
       event_id % 40 >= 20 as copy_done
from events""",
    "fx_task_polls": """
select user_id as task, event_id as poll,
       case event_type when 'error' then 'failed' when 'signup' then 'starting' else 'running' end as status,
       case when event_id % 3 = 0 then 100 else event_id % 100 end as load_percent
from events""",
    "fx_assessments": """
select user_id as task, event_id as poll,
       case event_type when 'error' then 'failed' when 'click' then 'warning' when 'view' then 'passed' else 'running' end as status
from events""",
    "fx_settings_src": """
select concat('p', cast(s_suppkey as varchar(20))) as name, cast(s_nationkey as varchar(10)) as setting, case when s_suppkey % 2 = 0 then 'kB' else null end as unit from supplier where s_suppkey % 9 <> 0""",
    "fx_settings_tgt": """
select concat('p', cast(s_suppkey as varchar(20))) as name, cast(case when s_suppkey % 4 = 0 then s_nationkey + 1 else s_nationkey end as varchar(10)) as setting, case when s_suppkey % 2 = 0 then 'kB' else null end as unit from supplier where s_suppkey % 11 <> 0""",
    "fx_settings_wanted": """
select concat('p', cast(s_suppkey as varchar(20))) as name, case s_suppkey % 3 when 0 then 'YES' when 1 then 'no' else 'n/a' end as restart,
       concat('category ', cast(s_nationkey % 7 as varchar(4))) as category
from supplier where s_suppkey % 10 <> 3""",
    # status ledger of a source and of a target that has not received every row; (ts, status) is unique
    "fx_ledger": """
select event_id * 60 as ts, case event_id % 4 when 0 then 'initializing' when 1 then 'copying' when 2 then 'replicating' else 'testing' end as status
from events""",
    "fx_ledger_tgt": """
select event_id * 60 as ts, case event_id % 4 when 0 then 'initializing' when 1 then 'copying' when 2 then 'replicating' else 'testing' end as status,
       event_id * 60 + event_id % 45 as arrived_at
from events where event_id % 23 <> 0""",
}


def _needs(sql: str) -> list[str]:
    names = [*BASE, *VIEWS]
    return [n for n in names if re.search(rf"\b(from|join)\s+{n}\b", sql)]


def with_views(sql: str) -> str:
    """The statement with every view it needs, directly or not, in front as a CTE."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        for name in _needs(todo.pop()):
            if name in VIEWS and name not in wanted:
                wanted.add(name)
                todo.append(VIEWS[name])
    if not wanted:
        return sql.strip()
    views = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in VIEWS if n in wanted)
    body = sql.strip()
    if re.match(r"with\b", body):
        return f"with {views},\n{body[4:].strip()}"
    return f"with {views}\n{body}"


_schemas: dict[str, StructType] = {}  # by path; saves a footer job whenever a query reads the same table again


class Tables:
    """Driver tables and views of one folder as DataFrames, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._known: dict[str, DataFrame] = {}
        # views whose SQL holds a window over one key: on Spark they use the operators that split such keys
        self._own: dict[str, Callable[[], DataFrame]] = {"fx_net": self._net, "fx_polls": self._polls}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE:
                path = f"{self.folder}/{name}.parquet"
                reader = self.spark.read.schema(_schemas[path]) if path in _schemas else self.spark.read
                df = reader.parquet(path)
                _schemas[path] = df.schema
            elif name in self._own:
                df = self._own[name]()
            else:
                df = self.sql(VIEWS[name])
            self._known[name] = df
        return self._known[name]

    def statistics(self, name: str) -> DataFrame:
        """A driver table for counts, minimum and maximum."""
        return read_for_statistics(self.spark, f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        needed = _needs(text)
        for name in needed:
            text = re.sub(rf"\b(from|join)(\s+){name}\b", rf"\1\2{{{name}}}", text)
        return self.spark.sql(text, **{n: self[n] for n in needed})

    def _net(self) -> DataFrame:
        log = self["fx_change_log"].select("k", "op", "v", "pos")
        return net_changes(log, ["k"]).filter(F.col("op") != "D").select("k", "op", "v", "pos")

    def _polls(self) -> DataFrame:
        polls = self.sql(
            """
            select user_id as run, event_id as poll,
                   case event_type when 'purchase' then 'succeeded' when 'signup' then 'stopped' else 'running' end as status,
                   case when event_type = 'error' then 1 else 0 end as is_error, event_id % 40 >= 20 as copy_done
            from events"""
        )
        summed = running_sum(polls, ["run"], ["poll"], "errors", F.col("is_error").cast("bigint"))
        return summed.select("run", "poll", "status", "errors", "copy_done")
