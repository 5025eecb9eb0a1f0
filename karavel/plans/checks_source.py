"""Registered queries: scans, sources, sinks, scope, large values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from karavel.operators import changes as C, scope as P, values as V
from karavel.plans.checks import collector
from karavel.plans.fixtures import Tables
from karavel.session import shared_folder
from karavel.sources import logs, sinks, snapshot

CHECKS, check = collector()


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("tbl"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@check(
    "select * from ("
    + " union all ".join(
        f"select '{t}' as tbl, count(*) as rows from {t}"
        for t in "benchmark conversations customer documents events labels lineitem nation orders pages part region supplier".split()
    )
    + ") x"
)
def s1_read_snapshot(t: Tables) -> DataFrame:
    scope = P.Scope(exclude_table=["public.embeddings"])
    return _counted(snapshot.read_snapshot(t.spark, snapshot.Location(path=t.folder), scope))


PART_STATS = """
select o_custkey as tbl, cast(sum(cast(o_totalprice as decimal(18,2))) as bigint) as bytes,
       min(o_orderkey) as min_key, max(o_orderkey) as max_key
from orders group by o_custkey"""


@check(
    f"""
with st as ({PART_STATS}),
pl as (select *, case when bytes > 500000 then least(16, (bytes + 499999) // 500000, max_key - min_key + 1) else 1 end as parts from st),
ex as (select *, unnest(range(1, parts + 1)) as part from pl)
select tbl, part, parts, min_key + ((part - 1) * (max_key - min_key + 1)) // parts as lo,
       min_key + (part * (max_key - min_key + 1)) // parts - 1 as hi
from ex"""
)
def s2_plan_parts(t: Tables) -> DataFrame:
    return snapshot.plan_parts(t.sql(PART_STATS), 500_000, 16)


@check(
    """
with st as (select count(*) * 100 as bytes, min(o_orderkey) as lo, max(o_orderkey) as hi from orders),
pl as (select lo as k0, hi - lo + 1 as w, least(8, (bytes + 99999) // 100000) as n from st),
pt as (select unnest(range(1, n + 1)) as part, * from pl)
select part, count(*) as rows, cast(sum(o_orderkey) as bigint) as keys
from pt join orders on o_orderkey between k0 + ((part - 1) * w) // n and k0 + (part * w) // n - 1
group by part"""
)
def s2_read_parts(t: Tables) -> DataFrame:
    orders = t["orders"]
    stats = orders.agg(
        F.lit("orders").alias("tbl"),
        (F.count("*") * 100).alias("bytes"),
        F.min("o_orderkey").alias("min_key"),
        F.max("o_orderkey").alias("max_key"),
    )
    out = None
    for p in snapshot.plan_parts(stats, 100_000, 8).orderBy("part").collect():
        rows = snapshot.read_part(orders, "o_orderkey", p["lo"], p["hi"], with_nulls=p["part"] == 1)
        one = rows.agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
        one = one.select(F.lit(p["part"]).cast("bigint").alias("part"), "rows", "keys")
        out = one if out is None else out.unionByName(one)
    return out


ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DecimalType(18, 2)), T.StructField("event_type", T.StringType())])


def change_records(t: Tables, with_errors: bool = False) -> DataFrame:
    """The change log as JSON records; some are cut off or carry an unknown action."""
    image = F.struct("k", "v", "event_type")
    action = F.when(F.lit(with_errors) & (F.col("event_id") % 59 == 0), "?").otherwise(F.col("op"))
    record = F.to_json(
        F.struct(
            "lsn",
            F.floor(F.col("event_id") / 7).alias("xid"),
            action.alias("action"),
            F.concat(F.lit("t"), F.col("k") % 3).alias("table"),
            F.col("k").alias("key"),
            F.when(F.col("op") != "D", image).alias("after"),
            F.when(F.col("op") == "D", image).alias("before"),
        )
    )
    text = F.when(F.lit(with_errors) & (F.col("event_id") % 53 == 0), F.substring(record, 1, 25)).otherwise(record)
    return t["fx_change_log"].select("pos", text.alias("value"))


@check("select pos, op, concat('t', cast(k % 3 as varchar(4))) as tbl, k as key from fx_change_log")
def s3_read_changes(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "s3")
    change_records(t).repartitionByRange(4, "pos").sortWithinPartitions("pos").select("value").write.text(folder)
    rows = C.decode_changes(logs.read_changes(t.spark, folder), ROW)
    return rows.select(F.col("pos").cast("bigint").alias("pos"), "op", "tbl", "key")


@check("select pos, op, concat('t', cast(k % 3 as varchar(4))) as tbl, k as key from fx_change_log")
def s3_read_changes_stream(t: Tables) -> DataFrame:
    folder, out, state = (shared_folder(t.spark, "s3", n) for n in ("in", "out", "state"))
    change_records(t).repartitionByRange(4, "pos").sortWithinPartitions("pos").select("value").write.text(folder)
    rows = C.decode_changes(logs.read_changes(t.spark, folder, streaming=True, files_per_batch=1), ROW)
    query = rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return t.spark.read.parquet(out).select(F.col("pos").cast("bigint").alias("pos"), "op", "tbl", "key")


@check(
    """
select pos, cast(event_id // 7 as bigint) as xid, op, k as key, case when op <> 'D' then cast(v as double) end as after_v,
       case when op = 'D' then event_type end as before_type, false as malformed
from fx_change_log where event_id % 53 <> 0 and event_id % 59 <> 0
union all
select pos, cast(event_id // 7 as bigint), '?', k, case when op <> 'D' then cast(v as double) end, case when op = 'D' then event_type end, true
from fx_change_log where event_id % 53 <> 0 and event_id % 59 = 0
union all
select null, null, null, null, null, null, true from fx_change_log where event_id % 53 = 0"""
)
def c1_decode_changes(t: Tables) -> DataFrame:
    rows = C.decode_changes(change_records(t, with_errors=True), ROW)
    # a record that was cut off has no certain fields
    whole = lambda c: F.when(F.col("raw").endswith("}"), c)
    return rows.select(
        whole(F.col("pos").cast("bigint")).alias("pos"),
        whole(F.col("xid")).alias("xid"),
        whole(F.col("op")).alias("op"),
        whole(F.col("key")).alias("key"),
        whole(F.col("after.v").cast("double")).alias("after_v"),
        whole(F.col("before.event_type")).alias("before_type"),
        "malformed",
    )


@check(
    """
select case when event_id % 53 = 0 then 'cut off' else 'unknown action' end as reason, count(*) as records
from fx_change_log where event_id % 53 = 0 or event_id % 59 = 0 group by 1"""
)
def c1_malformed_records(t: Tables) -> DataFrame:
    rows = C.decode_changes(change_records(t, with_errors=True), ROW).filter("malformed")
    reason = F.when(F.col("raw").endswith("}"), "unknown action").otherwise("cut off")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


@check(
    r"""
select substr(line, 1, 19) as ts, regexp_extract(line, '^\S+ \S+ \S+ (\S+) ', 1) as level,
       regexp_replace(line, '^\S+ \S+ \S+ \S+ ', '') as message
from fx_log_lines"""
)
def s4_read_log(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "s4")
    t["fx_log_lines"].sortWithinPartitions("line_no").select("line").write.text(folder)
    log = logs.read_log(t.spark, folder)
    return log.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "level", "message")


@check(
    """
select 'drop_and_create' as prep, count(*) as rows, cast(sum(o_orderkey) as bigint) as keys from fx_orders
union all select 'truncate', count(*), cast(sum(o_orderkey) as bigint) from fx_orders_tgt
union all select 'nothing', count(*), cast(sum(o_orderkey) as bigint) from (select o_orderkey from fx_orders_tgt union all select o_orderkey from fx_orders) x"""
)
def s5_write_snapshot(t: Tables) -> DataFrame:
    source, other = t["fx_orders"], t["fx_orders_tgt"]
    out = None
    for prep, steps in {
        "drop_and_create": [(other.drop("o_orderdate"), "drop_and_create"), (source, "drop_and_create")],
        "truncate": [(source, "drop_and_create"), (other, "truncate")],
        "nothing": [(source, "drop_and_create"), (other, "nothing")],
    }.items():
        dest = shared_folder(t.spark, "s5")
        for df, step in steps:
            sinks.write_snapshot(df, dest, step)
        one = t.spark.read.parquet(dest).agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))
        one = one.select(F.lit(prep).alias("prep"), "rows", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@check(
    """
select 'first' as place, count(*) as rows, cast(sum(o_orderkey) as bigint) as keys, cast(max(c_custkey) as bigint) as top
from orders join customer on o_custkey = c_custkey
union all
select 'second', count(*), cast(sum(o_orderkey + 1000000000) as bigint), cast(max(c_custkey) as bigint)
from orders join customer on o_custkey = c_custkey"""
)
def s6_foreign_schema(t: Tables) -> DataFrame:
    second = shared_folder(t.spark, "s6")
    t["orders"].withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000).write.parquet(f"{second}/orders.parquet")
    t["customer"].write.parquet(f"{second}/customer.parquet")
    schema = snapshot.ForeignSchema(t.spark, "s6_")
    scope = P.Scope(include_only_table=["public.orders", "public.customer"])
    schema.import_schema(snapshot.Location(path=t.folder), scope)
    sql = """select '{}' as place, count(*) as rows, sum(o_orderkey) as keys, max(c_custkey) as top
             from s6_orders join s6_customer on o_custkey = c_custkey"""
    first = t.spark.sql(sql.format("first"))
    schema.switch(snapshot.Location(path=second))
    return first.unionByName(t.spark.sql(sql.format("second")))


# ---------------------------------------------------------------------------------------------- scope

SYSTEM_SQL = "schema_name not in ('information_schema','pg_catalog','pg_toast') and schema_name not like 'pg\\_%' escape '\\'"
COLUMNS = "kind, schema_name, name"
# tables are in schemas s0 and s5 only; which of these names exist depends on the data, about one in ten does
LISTED = [f"{schema}.obj_{i}" for schema in ("s0", "s5") for i in range(0, 200, 3)]
IN_LIST = "(" + ",".join(f"'{n}'" for n in LISTED) + ")"
NOT_LISTED = f"(kind <> 'table' or concat(schema_name, '.', name) not in {IN_LIST})"
SCOPES = {
    "p1_scope_all": (P.Scope(exclude_table=LISTED), NOT_LISTED),
    "p1_scope_exclude_schema": (P.Scope(exclude_schema=["s1", "s2"], exclude_table=LISTED), f"schema_name not in ('s1','s2') and {NOT_LISTED}"),
    "p1_scope_include_schema": (
        P.Scope(include_only_schema=["s0", "s5", "s7"], exclude_schema=["s0"]),
        "schema_name in ('s0','s5','s7')",
    ),
    "p1_scope_include_table": (
        P.Scope(include_only_table=LISTED, exclude_schema=["s0"]),
        f"schema_name in ('s0','s5') and (kind <> 'table' or concat(schema_name, '.', name) in {IN_LIST})",
    ),
    "p2_scope_extensions": (
        P.Scope(exclude_extension=[f"obj_{i}" for i in range(0, 200, 7)], exclude_event_trigger=["none"]),
        "not (kind = 'extension' and name in (" + ",".join(f"'obj_{i}'" for i in range(0, 200, 7)) + "))",
    ),
}


def _scope_query(scope: P.Scope):
    return lambda t: P.scope_filter(t["fx_inv_src"], scope).select("kind", "schema_name", "name")


for _name, (_scope, _where) in SCOPES.items():
    CHECKS[_name] = (_scope_query(_scope), f"select {COLUMNS} from fx_inv_src where {SYSTEM_SQL} and {_where}")


@check(
    """
select kind, schema_name, name from fx_inv_src i
where not (kind = 'extension' and name in (select concat('obj_', cast(s_suppkey * 3 as varchar(20))) from supplier))"""
)
def p2_exclude_kind(t: Tables) -> DataFrame:
    names = t.sql("select concat('obj_', cast(s_suppkey * 3 as varchar(20))) as name from supplier")
    return P.exclude_kind(t["fx_inv_src"], "extension", names).select("kind", "schema_name", "name")


@check(
    """
with u as (select scope_id, max(case when section = 'include-only-table' then 1 else 0 end) as it,
                  max(case when section = 'include-only-schema' then 1 else 0 end) as i_s,
                  max(case when section = 'exclude-schema' then 1 else 0 end) as es,
                  max(case when section = 'exclude-table' then 1 else 0 end) as et
           from fx_scopes group by scope_id)
select scope_id, 'include-only-table + exclude-schema' as conflict from u where it = 1 and es = 1
union all select scope_id, 'include-only-table + exclude-table' from u where it = 1 and et = 1
union all select scope_id, 'include-only-schema + exclude-schema' from u where i_s = 1 and es = 1"""
)
def p3_scope_conflicts(t: Tables) -> DataFrame:
    return P.scope_conflicts(t["fx_scopes"])


BASE_RULES = """{"rules": [
  {"rule-type": "selection", "rule-id": "1", "rule-name": "all", "rule-action": "include",
   "object-locator": {"schema-name": "s%", "table-name": "%"}},
  {"rule-type": "transformation", "rule-id": "2", "rule-name": "rename", "rule-action": "rename", "rule-target": "schema",
   "object-locator": {"schema-name": "s1", "table-name": "%"}, "value": "main"}]}"""
MORE_RULES = """{"rules": [
  {"rule-type": "selection", "rule-id": "3", "rule-name": "not those", "rule-action": "exclude",
   "object-locator": {"schema-name": "%", "table-name": "%9_"}},
  {"rule-type": "transformation", "rule-id": "4", "rule-name": "later", "rule-action": "rename", "rule-target": "schema",
   "object-locator": {"schema-name": "s_", "table-name": "obj\\\\_1%"}, "value": "ones"}]}"""


@check(
    r"""
select kind, schema_name, name,
       case when schema_name = 's1' then 'main' when schema_name like 's_' and name like 'obj\_1%' escape '\' then 'ones' else schema_name end as target_schema,
       name as target_name
from fx_inv_src where schema_name like 's%' and not name like '%9_'"""
)
def p4_apply_rules(t: Tables) -> DataFrame:
    rules = P.parse_rules(BASE_RULES, MORE_RULES)
    return P.apply_rules(t["fx_inv_src"], rules).select("kind", "schema_name", "name", "target_schema", "target_name")


@check(
    """
select doc_id, case when strlen(text) > 512 then left(text, 512) else text end as text, strlen(text) > 512 as text_cut
from documents"""
)
def p5_limit_lobs(t: Tables) -> DataFrame:
    return V.limit_lobs(t["documents"].select("doc_id", "text"), ["text"], 0.5)


@check("select doc_id, text, false as text_cut from documents")
def p5_full_lobs(t: Tables) -> DataFrame:
    return V.limit_lobs(t["documents"].select("doc_id", "text"), ["text"], None)


def _broken_pages(t: Tables) -> DataFrame:
    """Pages as bytes, each third one with two stray bytes in front."""
    stray = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("FFC0"))).otherwise(F.unhex(F.lit("")))
    return t["pages"].select("page_id", F.concat(stray, F.encode("html", "UTF-8")).alias("html"))


@check("select page_id, concat(case when page_id % 3 = 0 then '??' else '' end, html) as html, case when page_id % 3 = 0 then 2 else 0 end as places from pages")
def p6_repair_text(t: Tables) -> DataFrame:
    fixed = V.repair_text(_broken_pages(t), ["html"], "?")
    return fixed.select("page_id", "html", F.col("html_repaired").alias("places"))


@check(
    "select 'html' as column_name, count(*) filter (where page_id % 3 = 0) as rows_repaired, "
    "cast(sum(case when page_id % 3 = 0 then 2 else 0 end) as bigint) as places from pages"
)
def p6_repair_counts(t: Tables) -> DataFrame:
    return V.repair_counts(V.repair_text(_broken_pages(t), ["html"], "?"), ["html"])
