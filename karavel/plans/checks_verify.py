"""Registered queries: verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from karavel.operators import verify as V
from karavel.plans.checks import collector
from karavel.plans.fixtures import Tables
from karavel.session import shared_folder
from karavel.sources.sinks import write_snapshot

CHECKS, check = collector()


# the inventories, with the source's extension objects shown as sequences so that all four kinds occur
INV = """
with src as (select case when kind = 'extension' then 'sequence' else kind end as kind, schema_name, name from fx_inv_src),
tgt as (select case when kind = 'extension' then 'sequence' else kind end as kind, schema_name, name from fx_inv_tgt)"""

OBJECT_DIFF = (
    INV
    + """
select kind, schema_name, name, 'missing' as side, 'FAIL' as verdict
from (select * from src except select * from tgt) m where kind in ('table','view','function','sequence')
union all
select kind, schema_name, name, 'extra', 'WARN' from (select * from tgt except select * from src) e where kind = 'table'"""
)


def _inventories(t: Tables) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("kind") == "extension", "sequence").otherwise(F.col("kind"))
    return tuple(t[n].withColumn("kind", kind) for n in ("fx_inv_src", "fx_inv_tgt"))


@check(OBJECT_DIFF)
def v1_object_diff(t: Tables) -> DataFrame:
    return V.object_diff(*_inventories(t))


@check(
    INV
    + """
select kind, src_count, tgt_count, case when src_count = tgt_count then 'PASS' when kind = 'table' then 'FAIL' else 'INFO' end as verdict
from (select coalesce(s.kind, g.kind) as kind, coalesce(src_count, 0) as src_count, coalesce(tgt_count, 0) as tgt_count
      from (select kind, count(*) as src_count from src group by kind) s
      full join (select kind, count(*) as tgt_count from tgt group by kind) g on s.kind = g.kind) x"""
)
def v1_object_counts(t: Tables) -> DataFrame:
    return V.object_counts(*_inventories(t))


# one definition per object; kinds as the definition check knows them
DEFS = """
select case kind when 'table' then 'column' when 'view' then 'constraint' when 'function' then 'constraint' else kind end as kind,
       schema_name as object, name, case when cast(substr(concat(name, '0'), 5, 1) as varchar(1)) = '7' then null else definition end as definition
from {}"""


@check(
    f"""
with s as ({DEFS.format('fx_inv_src')}), g as ({DEFS.format('fx_inv_tgt')}),
j as (select coalesce(s.kind, g.kind) as kind, coalesce(s.object, g.object) as object, coalesce(s.name, g.name) as name,
             case when g.kind is null then 'missing' when s.kind is null then 'extra'
                  when s.definition is distinct from g.definition then 'changed' end as state,
             s.definition as src_definition, g.definition as tgt_definition
      from s full join g on s.kind = g.kind and s.object = g.object and s.name = g.name)
select kind, object, name, state, src_definition, tgt_definition,
       case when state = 'extra' then case when kind in ('column','index') then 'WARN' end
            when kind = 'extension' then 'WARN' else 'FAIL' end as verdict
from j where state is not null"""
)
def v2_definition_diff(t: Tables) -> DataFrame:
    return V.definition_diff(t.sql(DEFS.format("fx_inv_src")), t.sql(DEFS.format("fx_inv_tgt")))


ESTIMATES = "select tbl, src_rows, tgt_rows from fx_stats where tbl % 37 <> 0"


@check(
    """
select tbl, src_rows, tgt_rows, case when src_rows > 0 then abs(src_rows - tgt_rows) * 100 // src_rows end as diff_pct, 'WARN' as verdict
from fx_stats where tbl % 37 <> 0
  and case when src_rows > 0 then abs(src_rows - tgt_rows) * 100 // src_rows > 5 else tgt_rows <> 0 end"""
)
def v3_estimate_diff(t: Tables) -> DataFrame:
    src = t["fx_stats"].select("tbl", F.col("src_rows").alias("est_rows"))
    tgt = t.sql("select tbl, tgt_rows as est_rows from fx_stats where tbl % 37 <> 0")
    return V.estimate_diff(src, tgt, 5)


COUNTED = ("orders", "customer", "lineitem", "part", "events", "nation")


def _sizes(t: Tables) -> DataFrame:
    out = None
    for n in COUNTED:
        one = t.statistics(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), (F.col("n") * 100).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


@check(
    f"""
with b as ({' union all '.join(f"select '{n}' as tbl, count(*) as src_count from {n}" for n in COUNTED)}),
g as (select 'orders' as tbl, count(*) as tgt_count from fx_orders_tgt union all select 'lineitem', count(*) from fx_lineitem_tgt
      union all {' union all '.join(f"select '{n}' as tbl, count(*) as tgt_count from {n}" for n in COUNTED if n not in ('orders', 'lineitem'))}),
c as (select b.tbl, src_count, tgt_count from b join g on b.tbl = g.tbl where src_count * 100 between 1 and 100000000000
      order by md5(concat(b.tbl, 'a')), b.tbl limit 4)
select tbl, case when src_count = tgt_count then 'MATCH' else 'MISSING' end as state, src_count, tgt_count,
       case when src_count <> tgt_count then src_count - tgt_count end as diff,
       case when src_count <> tgt_count then (src_count - tgt_count) * 100 // src_count end as diff_pct,
       case when src_count = tgt_count then 'PASS' else 'FAIL' end as verdict
from c"""
)
def v4_exact_counts(t: Tables) -> DataFrame:
    src = {n: t.statistics(n) for n in COUNTED}
    tgt = {**src, "orders": t["fx_orders_tgt"], "lineitem": t["fx_lineitem_tgt"]}
    out = V.exact_counts(t.spark, src, tgt, _sizes(t), n=4, max_bytes=100_000_000_000, seed="a", timeout=None)
    return out.drop("detail")


@check("select count(*) as rows, true as within_six_deviations from lineitem")
def v5_sampled_count(t: Tables) -> DataFrame:
    """The estimate itself depends on the engine; that it is as near as a sample of this size can be does not."""
    share = 0.1
    both = V.sampled_count(t["lineitem"], 100 * share, seed=7).join(F.broadcast(t["lineitem"].agg(F.count("*").alias("rows"))))
    deviation = F.sqrt(F.col("rows") * F.lit((1 - share) / share))
    return both.select("rows", (F.abs(F.col("est_rows") - F.col("rows")) <= 6 * deviation).alias("within_six_deviations"))


KEYS = (
    ("orders", "o_orderkey", "int8"),
    ("lineitem", "l_shipdate", "timestamp"),
    ("customer", "c_name", "varchar"),
    ("part", "p_partkey", "int8"),
    ("events", "ts", "timestamp"),
    ("supplier", "s_suppkey", "int8"),
)


@check(
    f"""
with k as ({' union all '.join(f"select '{a}' as tbl, '{c}' as column_name, '{y}' as type, count(*) as est_rows from {a}" for a, c, y in KEYS)}),
top as (select * from k order by est_rows desc, tbl limit 5),
s as ({' union all '.join(f"select '{a}' as tbl, cast(min({c}) as varchar) as lo, cast(max({c}) as varchar) as hi from {a}" for a, c, _ in KEYS)}),
g as (select 'orders' as tbl, cast(min(o_orderkey) as varchar) as lo, cast(max(o_orderkey) as varchar) as hi from fx_orders_tgt
      union all {' union all '.join(f"select '{a}' as tbl, cast(min({c}) as varchar) as lo, cast(max({c}) as varchar) as hi from {a}" for a, c, _ in KEYS if a != 'orders')})
select top.tbl, column_name, type, case when type <> 'varchar' then s.lo end as src_min, case when type <> 'varchar' then s.hi end as src_max,
       case when type <> 'varchar' then g.lo end as tgt_min, case when type <> 'varchar' then g.hi end as tgt_max,
       case when type = 'varchar' then 'SKIPPED' when s.lo is not distinct from g.lo and s.hi is not distinct from g.hi then 'PASS' else 'FAIL' end as verdict
from top join s on top.tbl = s.tbl join g on top.tbl = g.tbl"""
)
def v6_minmax_check(t: Tables) -> DataFrame:
    keys = None
    for name, col, kind in KEYS:
        one = t.statistics(name).agg(F.count("*").alias("est_rows"))
        one = one.select(F.lit(name).alias("tbl"), F.lit(col).alias("column_name"), F.lit(kind).alias("type"), "est_rows")
        keys = one if keys is None else keys.unionByName(one)
    src = {name: t.statistics(name) for name, _, _ in KEYS}
    return V.minmax_check(t.spark, src, {**src, "orders": t["fx_orders_tgt"]}, keys, n=5)


@check(
    """
select seq, coalesce(src_last, 0) as src_last, coalesce(tgt_last, 0) as tgt_last,
       coalesce(src_last, 0) - coalesce(tgt_last, 0) as behind, 'WARN' as verdict
from fx_seq where coalesce(tgt_last, 0) < coalesce(src_last, 0)"""
)
def v7_high_water_lag(t: Tables) -> DataFrame:
    marks = t["fx_seq"]
    return V.high_water_lag(
        marks.select("seq", F.col("src_last").alias("last_value")), marks.select("seq", F.col("tgt_last").alias("last_value"))
    )


ROW_DIFF = """
select coalesce(s.o_orderkey, g.o_orderkey) as o_orderkey,
       case when g.o_orderkey is null then 'MISSING_TARGET' when s.o_orderkey is null then 'MISSING_SOURCE' else 'DIFFERENT' end as state,
       case when g.o_orderkey is null or s.o_orderkey is null then '' else concat_ws(',',
         case when s.o_custkey is distinct from g.o_custkey then 'o_custkey' end,
         case when s.o_orderstatus is distinct from g.o_orderstatus then 'o_orderstatus' end,
         case when s.o_totalprice is distinct from g.o_totalprice then 'o_totalprice' end,
         case when s.o_orderdate is distinct from g.o_orderdate then 'o_orderdate' end,
         case when s.o_orderpriority is distinct from g.o_orderpriority then 'o_orderpriority' end) end as columns
from fx_orders s full join fx_orders_tgt g on s.o_orderkey = g.o_orderkey
where g.o_orderkey is null or s.o_orderkey is null or s.o_custkey is distinct from g.o_custkey or s.o_orderstatus is distinct from g.o_orderstatus
   or s.o_totalprice is distinct from g.o_totalprice or s.o_orderdate is distinct from g.o_orderdate or s.o_orderpriority is distinct from g.o_orderpriority"""


def _diff(t: Tables) -> DataFrame:
    return V.row_diff(t["fx_orders"], t["fx_orders_tgt"], ["o_orderkey"], partition_size=1000)


@check(ROW_DIFF)
def v8_row_diff(t: Tables) -> DataFrame:
    return _diff(t)


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


@check(
    f"""
select {LINE}, cast(sum(s) as bigint) as src_copies, cast(sum(g) as bigint) as tgt_copies
from (select {LINE}, 1 as s, 0 as g from fx_lineitem union all select {LINE}, 0, 1 from fx_lineitem_tgt) x
group by {LINE} having sum(s) <> sum(g)"""
)
def v8_row_diff_keyless(t: Tables) -> DataFrame:
    return V.row_diff_keyless(t["fx_lineitem"], t["fx_lineitem_tgt"])


@check(
    f"""
with d as ({ROW_DIFF}),
p as (select o_orderkey % 4 as tbl, count(*) as failures, count(*) filter (where state = 'MISSING_TARGET') as missing_target,
             count(*) filter (where state = 'MISSING_SOURCE') as missing_source, count(*) filter (where state = 'DIFFERENT') as different
      from d group by o_orderkey % 4)
select *, failures >= 90 as suspended, (select sum(failures) from p) >= 300 as task_stopped from p"""
)
def v8_validation_status(t: Tables) -> DataFrame:
    diffs = _diff(t).withColumn("tbl", F.col("o_orderkey") % 4)
    return V.validation_status(diffs, table_max=90, overall_max=300)


CHECK_ROWS = """
select o_custkey % 20 as run,
       case when o_custkey % 20 < 5 then 'PASS'
            when o_custkey % 20 < 10 then case when o_orderkey % 3 = 0 then 'WARN' else 'PASS' end
            when o_custkey % 20 < 18 then case o_orderkey % 5 when 0 then 'FAIL' when 1 then 'WARN' else 'PASS' end
            else case o_orderkey % 7 when 0 then 'ERROR' when 1 then 'FAIL' else 'PASS' end end as status
from orders"""


def _verdict_sql(fail: int, warn: int) -> str:
    return f"""
with c as ({CHECK_ROWS})
select run, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'WARN') as warned,
       count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'ERROR') as errors,
       case when count(*) filter (where status = 'ERROR') > 0 then 3 when count(*) filter (where status = 'FAIL') > 0 then {fail}
            when count(*) filter (where status = 'WARN') > 0 then {warn} else 0 end as exit_code
from c group by run"""


@check(_verdict_sql(2, 1))
def v9_verdict(t: Tables) -> DataFrame:
    return V.verdict(t.sql(CHECK_ROWS), by=["run"])


@check(_verdict_sql(1, 0))
def v9_gate(t: Tables) -> DataFrame:
    return V.verdict(t.sql(CHECK_ROWS), gate=True, by=["run"])


def _loaded(t: Tables, name: str) -> DataFrame:
    """A table after it went through a sink."""
    place = shared_folder(t.spark, "v9")
    write_snapshot(t[name], place)
    return t.spark.read.parquet(place)


def migration_verdict(t: Tables) -> DataFrame:
    """Row, mark, estimate and object checks of one move, added up to one verdict row."""
    diffs = _diff(t).withColumn("status", F.lit("FAIL"))
    estimates = v3_estimate_diff(t)
    objects = v1_object_diff(t)
    checks = (
        V.as_checks("rows", diffs, "status")
        .unionByName(V.as_checks("marks", v7_high_water_lag(t)))
        .unionByName(V.as_checks("estimates", estimates))
        .unionByName(V.as_checks("objects", objects))
        .unionByName(V.run_check(t.spark, "loaded rows", lambda: V.row_diff(t["customer"], _loaded(t, "customer"), ["c_custkey"]).withColumn("status", F.lit("FAIL")), "status"))
    )
    return V.verdict(checks)


CHECKS["v9_migration_verdict"] = (
    migration_verdict,
    f"""
with c as (
  select case when (select count(*) from ({ROW_DIFF}) r) > 0 then 'FAIL' else 'PASS' end as status
  union all select case when (select count(*) from fx_seq where coalesce(tgt_last, 0) < coalesce(src_last, 0)) > 0 then 'WARN' else 'PASS' end
  union all select case when (select count(*) from fx_stats where tbl % 37 <> 0 and case when src_rows > 0 then abs(src_rows - tgt_rows) * 100 // src_rows > 5 else tgt_rows <> 0 end) > 0 then 'WARN' else 'PASS' end
  union all select case when (select count(*) from fx_inv_src s where kind in ('table','view','function','extension')
                              and not exists (select 1 from fx_inv_tgt g where g.kind = s.kind and g.schema_name = s.schema_name and g.name = s.name)) > 0 then 'FAIL' else 'WARN' end
  union all select 'PASS')
select count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'WARN') as warned,
       count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'ERROR') as errors,
       case when count(*) filter (where status = 'FAIL') > 0 then 2 when count(*) filter (where status = 'WARN') > 0 then 1 else 0 end as exit_code
from c""",
)


@check(
    """
with c as (
  select case when (select count(*) from lineitem) = (select count(*) from fx_lineitem_tgt)
               and (select count(*) from orders) = (select count(*) from fx_orders_tgt) then 'PASS' else 'FAIL' end as status
  union all select case when (select count(*) from orders where o_orderkey % 97 = 0) > 0 then 'FAIL' else 'PASS' end
  union all select 'ERROR' union all select 'ERROR')
select count(*) filter (where status = 'PASS') as passed, 0 as warned, count(*) filter (where status = 'FAIL') as failed,
       count(*) filter (where status = 'ERROR') as errors, 3 as exit_code
from c"""
)
def v9_verdict_of_checks_that_cannot_run(t: Tables) -> DataFrame:
    """Counts and rows of whole tables; one table cannot be read, and one check fails as a whole."""
    missing = lambda: t.spark.read.parquet(f"{t.folder}/not_there.parquet")
    src = {"lineitem": t["fx_lineitem"], "orders": t["fx_orders"]}
    tgt = {"lineitem": t["fx_lineitem_tgt"], "orders": t["fx_orders_tgt"]}
    sizes = t.spark.createDataFrame([(name, 100) for name in src], "tbl string, bytes bigint")
    count = lambda tgt: V.exact_counts(t.spark, src, tgt, sizes, timeout=None)
    rows = lambda tgt: V.row_diff(src["orders"], tgt, ["o_orderkey"]).withColumn("verdict", F.lit("FAIL"))
    checks = V.run_check(t.spark, "counts", lambda: count(tgt))
    checks = checks.unionByName(V.run_check(t.spark, "counts of a lost table", lambda: count(tgt | {"orders": missing})))
    checks = checks.unionByName(V.run_check(t.spark, "rows", lambda: rows(tgt["orders"])))
    checks = checks.unionByName(V.run_check(t.spark, "rows of a lost table", lambda: rows(missing())))
    return V.verdict(checks)


@check(
    """
select o_orderkey, case when o_orderkey >= 1000000000 then 'MISSING_SOURCE' else 'MISSING_TARGET' end as state, 0 as first_at, 120 as last_at
from (select o_orderkey from orders where o_orderkey % 97 = 0 and o_orderkey % 2 = 0
      union all select o_orderkey + 1000000000 from orders where o_orderkey % 211 = 0) x"""
)
def v8_rows_that_outlast_the_delay(t: Tables) -> DataFrame:
    """The target lags: rows that are different come right within a minute, every second missing one within two, others never."""
    src, tgt, key = t["fx_orders"], t["fx_orders_tgt"], ["o_orderkey"]
    pending = V.pending_rows(V.row_diff(src, tgt, key), key, 0)
    same = tgt.join(src, key, "left_anti").unionByName(src.join(tgt.select(*key), key, "left_semi").select(*tgt.columns))
    pending = V.recheck_rows(src, same, key, pending, 60, touched=src.select(*key).filter("o_orderkey % 101 = 0"))
    late = same.unionByName(src.filter("o_orderkey % 97 = 0 and o_orderkey % 2 = 1").select(*tgt.columns))
    pending = V.recheck_rows(src, late, key, pending, 120)
    return V.outlasted(pending, 90).drop("columns")


WIDER = """
select o_orderkey, o_custkey, cast(o_totalprice as decimal(18,2)) as price, o_orderdate as placed, o_orderpriority as prio from orders"""


@check(
    """
select o_orderkey, 'DIFFERENT' as state, case when o_orderkey % 3 = 0 and o_orderkey % 5 = 0 then 'price,placed' when o_orderkey % 3 = 0 then 'price' else 'placed' end as columns
from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0"""
)
def v8_row_diff_other_types(t: Tables) -> DataFrame:
    """The target keeps more decimals and finer times, and in some rows uses them; text differs in case only."""
    src = t.sql(WIDER).withColumn("placed", F.col("placed").cast("date"))
    price = F.col("price").cast("decimal(20,4)") + F.when(F.col("o_orderkey") % 3 == 0, F.lit("0.0012").cast("decimal(20,4)")).otherwise(0)
    placed = F.col("placed").cast("timestamp_ntz") + F.when(F.col("o_orderkey") % 5 == 0, F.expr("interval 7 seconds")).otherwise(F.expr("interval 0 seconds"))
    tgt = src.withColumn("price", price.cast("decimal(20,4)")).withColumn("placed", placed).withColumn("prio", F.lower("prio"))
    return V.row_diff(src, tgt, ["o_orderkey"], collation="ignore_case", partition_size=1000)


@check(
    """
with s as (select l_orderkey, count(*) as n from lineitem group by l_orderkey),
g as (select l_orderkey, count(*) as n from lineitem where l_linenumber > 1 and l_orderkey % 4 <> 0 group by l_orderkey)
select s.l_orderkey, case when g.n is null then 'MISSING_TARGET' else 'DIFFERENT' end as state, s.n as src_rows, coalesce(g.n, 0) as tgt_rows
from s left join g on s.l_orderkey = g.l_orderkey where s.n <> coalesce(g.n, 0)"""
)
def v8_row_diff_repeated_keys(t: Tables) -> DataFrame:
    src = t["lineitem"].select("l_orderkey", F.lit("x").alias("v"))
    tgt = t["lineitem"].filter("l_linenumber > 1 and l_orderkey % 4 <> 0").select("l_orderkey", F.lit("x").alias("v"))
    return V.row_diff(src, tgt, ["l_orderkey"], counts=True, partition_size=1000).drop("columns")


SETTINGS = """
select w.name, restart, category, coalesce(concat_ws(' ', s.setting, s.unit), 'N/A') as src_value,
       coalesce(concat_ws(' ', g.setting, g.unit), 'N/A') as tgt_value
from fx_settings_wanted w left join (select * from fx_settings_src) s on w.name = s.name left join (select * from fx_settings_tgt) g on w.name = g.name"""
SETTINGS_DIFF = f"""
select name, restart, category, case when src_value = '' then 'N/A' else src_value end as src_value,
       case when tgt_value = '' then 'N/A' else tgt_value end as tgt_value,
       case when src_value = tgt_value then 'SAME' else 'DIFF' end as status
from ({SETTINGS}) x"""


def _settings(t: Tables) -> DataFrame:
    return V.settings_diff(t["fx_settings_wanted"], t["fx_settings_src"], t["fx_settings_tgt"])


@check(SETTINGS_DIFF)
def v10_settings_diff(t: Tables) -> DataFrame:
    return _settings(t)


@check(
    f"""
select category, restart, count(*) filter (where status = 'SAME') as same, count(*) filter (where status = 'DIFF') as different
from ({SETTINGS_DIFF}) y group by rollup (category, restart)"""
)
def v10_settings_summary(t: Tables) -> DataFrame:
    return V.settings_summary(_settings(t))


CONSTRAINTS = """
select schema_name, name, case try_cast(substr(name, 5) as bigint) % 4 when 0 then 'p' when 1 then 'u' when 2 then 'f' else 'c' end as contype
from fx_inv_src where kind = 'table' and try_cast(substr(name, 5) as bigint) % 5 <> 0"""


@check(
    f"""
select schema_name, name from fx_inv_src
where kind = 'table' and try_cast(substr(name, 5) as bigint) % 3 <> 0
  and concat(schema_name, '.', name) not in (select concat(schema_name, '.', name) from ({CONSTRAINTS}) c where contype in ('p','u'))"""
)
def v11_keyless_tables(t: Tables) -> DataFrame:
    identity = F.when(F.substring("name", 5, 20).cast("bigint") % 3 == 0, "f").otherwise("d")
    return V.keyless_tables(t["fx_inv_src"].withColumn("replica_identity", identity), t.sql(CONSTRAINTS))


@check(
    """
with o as (select o_orderkey, count(*) as n from orders group by o_orderkey), l as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)
select 'orders' as tbl, count(*) as keys, count(*) filter (where n > 1) as duplicated, 0 as null_rows, count(*) filter (where n > 1) = 0 as usable from o
union all select 'lineitem', count(*), count(*) filter (where n > 1), 0, count(*) filter (where n > 1) = 0 from l"""
)
def v11_key_check(t: Tables) -> DataFrame:
    a = V.key_check(t["orders"], ["o_orderkey"]).withColumn("tbl", F.lit("orders"))
    return a.unionByName(V.key_check(t["lineitem"], ["l_orderkey", "l_linenumber"]).withColumn("tbl", F.lit("lineitem")))


def _coverage_sql(sequences: bool) -> str:
    seq = "kind = 'sequence'" if sequences else "false"
    return f"""
with c as (
  select schema_name, bool_and(schema_usable) as usable, count(*) filter (where kind <> 'sequence') as tables,
         count(*) filter (where kind <> 'sequence' and not readable) as tables_unreadable,
         count(*) filter (where kind = 'matview' and not readable) as matviews_unreadable,
         count(*) filter (where {seq}) as sequences, count(*) filter (where {seq} and not readable) as sequences_unreadable
  from fx_relations group by schema_name)
select schema_name, tables, tables_unreadable, matviews_unreadable, sequences, sequences_unreadable,
       case when not usable then 'NO_USAGE' when tables_unreadable > 0 and sequences_unreadable > 0 then 'TABLES_AND_SEQUENCES'
            when tables_unreadable > 0 then 'TABLES' when sequences_unreadable > 0 then 'SEQUENCES' else 'PASS' end as state
from c"""


@check(_coverage_sql(True))
def v12_read_coverage(t: Tables) -> DataFrame:
    return V.read_coverage(t["fx_relations"])


@check(_coverage_sql(False))
def v12_read_coverage_tables(t: Tables) -> DataFrame:
    return V.read_coverage(t["fx_relations"], check_sequences=False)


@check(
    """
with r as (select distinct name from fx_inv_src where kind = 'extension' and not owned_by_ext)
select count(*) as checked, count(*) filter (where name not in (select name from fx_inv_tgt where kind = 'extension')) as missing,
       case when count(*) filter (where name not in (select name from fx_inv_tgt where kind = 'extension')) > 0 then 'missing'
            when count(*) > 0 then 'all there' else 'nothing to check' end as outcome
from r"""
)
def v13_availability(t: Tables) -> DataFrame:
    src = t["fx_inv_src"].filter("kind = 'extension'")
    return V.availability(src, src.filter("owned_by_ext"), t["fx_inv_tgt"].filter("kind = 'extension'"))


@check(
    """
select 'leftover' as "check", name, 'WARN' as status from fx_inv_tgt where name in (select concat('awsdms_', cast(s_suppkey as varchar(20))) from supplier)
union all
select 'hidden rows', cast(tbl as varchar), 'FAIL' from fx_stats where src_rows > 0 and tgt_rows < 3 and tbl % 2 = 0"""
)
def v14_load_readiness(t: Tables) -> DataFrame:
    read = F.when((F.col("tgt_rows") < 3) & (F.col("tbl") % 2 == 0), 0).otherwise(F.col("tgt_rows") + 1)
    stats = t["fx_stats"].select("tbl", F.col("src_rows").alias("est_rows"), read.alias("rows_read"))
    names = t.sql("select concat('awsdms_', cast(s_suppkey as varchar(20))) as name from supplier")
    return V.load_readiness(stats, t["fx_inv_tgt"], names)
