"""Registered queries: bulk loads and change data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from karavel.functions.expr import WORD
from karavel.operators import changes as C, loads as L
from karavel.plans.checks_source import ROW, change_records
from karavel.plans.checks import collector
from karavel.plans.fixtures import Tables
from karavel.session import shared_folder
from karavel.sources import logs, snapshot
from karavel.streaming import altered, follow as S, group, keyless, markers, transactions

CHECKS, check = collector()


ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as double) as o_totalprice, o_orderdate, o_orderpriority"


def _orders_out(df: DataFrame) -> DataFrame:
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


def _load(t: Tables) -> tuple[str, DataFrame]:
    tables = {n: t[n] for n in ("orders", "lineitem", "customer")}
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}
    stats = None
    for name, df in tables.items():
        one = df.agg(
            F.lit(name).alias("tbl"), (F.count("*") * 100).alias("bytes"), F.min(keys[name]).alias("min_key"), F.max(keys[name]).alias("max_key")
        )
        stats = one if stats is None else stats.unionByName(one)
    parts = snapshot.plan_parts(stats, 2_000_000, 4)
    dest, progress = shared_folder(t.spark, "l1"), shared_folder(t.spark, "l1")
    return dest, L.full_load(tables, dest, parts, keys, progress=progress, table_jobs=4)


@check("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def l1_full_load(t: Tables) -> DataFrame:
    dest, _ = _load(t)
    return L.loaded_table(t.spark, dest, "orders")


@check(
    " union all ".join(
        f"select '{t}' as tbl, least(4, greatest(1, (count(*) * 100 + 1999999) // 2000000)) as tasks, count(*) as rows from {t}"
        for t in ("orders", "lineitem", "customer")
    )
)
def l1_load_progress(t: Tables) -> DataFrame:
    _, progress = _load(t)
    return progress.filter("done_epoch is not null").groupBy("tbl").agg(F.count("*").alias("tasks"), F.sum("rows").alias("rows"))


def _cut(t: Tables, lo: int | None, hi: int | None, threshold: int = 1000) -> DataFrame:
    """A plan of parts of the customer table from statistics that may be old or missing."""
    stats = t.spark.createDataFrame([("customer", 4000, lo, hi)], "tbl string, bytes bigint, min_key bigint, max_key bigint")
    return snapshot.plan_parts(stats, threshold, 4)


CUSTOMERS = "select c_custkey, c_name from customer"


def _customers(t: Tables) -> DataFrame:
    return t["customer"].select("c_custkey", "c_name")


@check(CUSTOMERS)
def l1_load_with_stale_statistics(t: Tables) -> DataFrame:
    """The statistics know the middle of the keys only."""
    dest, progress = shared_folder(t.spark, "l1"), shared_folder(t.spark, "l1")
    top = t["customer"].agg(F.max("c_custkey")).first()[0]
    plan = _cut(t, top // 4, top // 2)
    L.full_load({"customer": _customers(t)}, dest, plan, {"customer": "c_custkey"}, progress=progress, table_jobs=4)
    return L.loaded_table(t.spark, dest, "customer")


@check(CUSTOMERS + " union all select null, 'no key' from region")
def l1_load_without_key_bounds(t: Tables) -> DataFrame:
    dest, progress = shared_folder(t.spark, "l1"), shared_folder(t.spark, "l1")
    rows = _customers(t).unionByName(t.sql("select cast(null as bigint) as c_custkey, 'no key' as c_name from region"))
    plan = _cut(t, None, None)
    L.full_load({"customer": rows}, dest, plan, {"customer": "c_custkey"}, progress=progress)
    return L.loaded_table(t.spark, dest, "customer")


@check(CUSTOMERS)
def l1_second_load_with_fewer_parts(t: Tables) -> DataFrame:
    dest, progress = shared_folder(t.spark, "l1"), shared_folder(t.spark, "l1")
    top = t["customer"].agg(F.max("c_custkey")).first()[0]
    for threshold in (1000, 2000, 1400):
        L.full_load({"customer": _customers(t)}, dest, _cut(t, 0, top, threshold), {"customer": "c_custkey"}, progress=progress, table_jobs=4)
    L.full_load({"customer": _customers(t)}, dest, _cut(t, 0, top, 2000), {"customer": "c_custkey"}, progress=shared_folder(t.spark, "l1"))
    return L.loaded_table(t.spark, dest, "customer")


@check(CUSTOMERS)
def l3_resume_of_a_grown_table(t: Tables) -> DataFrame:
    """Half of the table is there when two of four parts are loaded; the rest of the run plans again."""
    dest, progress = shared_folder(t.spark, "l3"), shared_folder(t.spark, "l3")
    top, keys = t["customer"].agg(F.max("c_custkey")).first()[0], {"customer": "c_custkey"}
    half = _customers(t).filter(F.col("c_custkey") <= top // 2)
    broken = half.filter(F.raise_error(F.lit("stopped")).isNull())
    first = _cut(t, 0, top // 2)
    L.full_load({"customer": half}, dest, first.filter("part in (1, 4)"), keys, progress=progress, table_jobs=2)
    try:
        L.full_load({"customer": broken}, dest, first.filter("part in (2, 3)"), keys, progress=progress, table_jobs=2)
    except Exception:  # noqa: BLE001 - the run is stopped on purpose
        pass
    again = L.resume_plan(_cut(t, 0, top), L.read_progress(t.spark, progress))
    L.full_load({"customer": _customers(t)}, dest, again, keys, progress=progress, table_jobs=4)
    return L.loaded_table(t.spark, dest, "customer")


LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@check(f"select {LINES} from lineitem")
def l1_load_by_files(t: Tables) -> DataFrame:
    """A table in twelve files, not sorted by any key, in four parts; two of them first, then the rest of the plan."""
    place, dest, progress = (shared_folder(t.spark, "l1") for _ in range(3))
    rows = t["lineitem"].selectExpr(*LINES.split(", "))
    rows.repartition(12, "l_partkey").write.parquet(place)
    plan = snapshot.plan_file_parts(t.spark, {"lineitem": place}, 1, 4)
    tables = {"lineitem": lambda files: t.spark.read.schema(rows.schema).parquet(*files)}
    L.full_load(tables, dest, plan.filter("part in (2, 3)"), {}, progress=progress, table_jobs=2)
    L.full_load(tables, dest, L.resume_plan(plan, L.read_progress(t.spark, progress)), {}, progress=progress, prep="truncate", table_jobs=2)
    return L.loaded_table(t.spark, dest, "lineitem")


DOUBLED = """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from fx_orders
union all
select o_orderkey, o_custkey + 1, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from fx_orders"""


@check(
    f"""
select {ORDER_COLS} from fx_orders_tgt
union all
select {ORDER_COLS} from fx_orders where o_orderkey not in (select o_orderkey from fx_orders_tgt)"""
)
def l2_load_ignore_conflicts(t: Tables) -> DataFrame:
    out = L.load_ignore_conflicts(t.sql(DOUBLED), t["fx_orders_tgt"], ["o_orderkey"], ["o_custkey"])
    return _orders_out(out)


def _plan_and_progress(t: Tables) -> tuple[DataFrame, DataFrame]:
    plan = t.sql(
        """select p.oid as tbl, p.partnumber as part, n.parts from fx_s_table_part p
           join (select oid, count(*) as parts from fx_s_table_part group by oid) n on p.oid = n.oid"""
    )
    progress = t.sql(
        """select s.tableoid as tbl, s.partnumber as part, n.parts, s.done_ts from fx_summary s
           join (select oid, count(*) as parts from fx_s_table_part group by oid) n on s.tableoid = n.oid"""
    )
    return plan, progress.withColumn("done_epoch", F.unix_timestamp(F.col("done_ts").cast("timestamp")))


@check("select tableoid as tbl, partnumber as part from fx_summary where done_ts is null")
def l3_resume_plan(t: Tables) -> DataFrame:
    return L.resume_plan(*_plan_and_progress(t)).select("tbl", "part")


@check(
    """
select seq, greatest(src_last, coalesce(top, 0)) as new_last
from fx_seq left join (select l_partkey, max(l_orderkey) as top from lineitem group by l_partkey) m on seq = l_partkey"""
)
def l4_reset_high_water(t: Tables) -> DataFrame:
    seqs = t["fx_seq"].select("seq", F.col("src_last").alias("last_value"))
    keys = t["lineitem"].groupBy(F.col("l_partkey").alias("seq")).agg(F.max("l_orderkey").alias("max_key"))
    return L.reset_high_water(seqs, keys)


STATS_TABLES = ("orders", "customer", "part", "supplier")


@check(" union all ".join(f"select '{n}' as tbl, count(*) as rows from {n}" for n in STATS_TABLES))
def l5_refresh_stats(t: Tables) -> DataFrame:
    names = {}
    for n in STATS_TABLES:
        folder = shared_folder(t.spark, "l5")
        t[n].write.parquet(folder)
        name = f"karavel_l5_{n}_{folder[-12:]}"
        t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder}'")
        names[name] = n
    stats = L.refresh_stats(t.spark, list(names))
    for name in names:
        t.spark.sql(f"DROP TABLE {name}")
    return stats.withColumn("tbl", F.regexp_extract("tbl", "karavel_l5_([a-z]+)_", 1)).select("tbl", "rows")


@check(
    """
select o_orderstatus, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by o_orderstatus"""
)
def l6_refresh_derived(t: Tables) -> DataFrame:
    dest = shared_folder(t.spark, "l6")
    by_customer = t.sql(
        "select o_custkey, o_orderstatus, count(*) as orders, sum(o_totalprice) as total from fx_orders group by o_custkey, o_orderstatus"
    )
    L.refresh_derived({"by_customer": by_customer}, dest)
    # the second table is derived from the first, so the order of the refreshes counts
    first = t.spark.read.parquet(f"{dest}/by_customer")
    L.refresh_derived({"by_status": first.groupBy("o_orderstatus").agg(F.sum("orders").alias("orders"), F.sum("total").alias("total"))}, dest)
    out = t.spark.read.parquet(f"{dest}/by_status")
    return out.withColumn("total", F.col("total").cast("double"))


# ------------------------------------------------------------------------------------------- changes

LAST = "select k, op, v, pos from (select *, row_number() over (partition by k order by pos desc) as rn from fx_change_log) x where rn = 1"
APPLIED = """
select k, cast(v as double) as v from fx_base where k not in (select k from fx_change_log)
union all select k, cast(v as double) from fx_net"""


def _log(t: Tables) -> DataFrame:
    return t["fx_change_log"].select("pos", "op", "k", "v")


def _kv(df: DataFrame) -> DataFrame:
    return df.select("k", F.col("v").cast("double").alias("v"))


@check(f"select k, op, cast(v as double) as v, pos from ({LAST}) y")
def c2_net_changes(t: Tables) -> DataFrame:
    return C.net_changes(_log(t), ["k"]).withColumn("v", F.col("v").cast("double"))


HALF = 22 * WORD + 400 * 4194304


@check(
    f"""
select xid, count(*) as changes, max(pos) as end_pos from (select event_id // 7 as xid, pos from fx_change_log) x
group by xid having max(pos) <= {HALF}"""
)
def c2_whole_transactions(t: Tables) -> DataFrame:
    log = t["fx_change_log"].select(F.floor(F.col("event_id") / 7).alias("xid"), "pos")
    cut = C.whole_transactions(log, HALF)
    return cut.groupBy("xid").agg(F.count("*").alias("changes"), F.max("pos").alias("end_pos"))


@check(APPLIED)
def c3_apply_changes(t: Tables) -> DataFrame:
    return _kv(C.apply_changes(t["fx_base"], _log(t), ["k"]))


def _followed(t: Tables, replay: bool = False, **how) -> S.FollowedTable:
    """The change log written as files, read as a stream (one file per batch) into a table."""
    folder, place = shared_folder(t.spark, "log"), shared_folder(t.spark, "followed")
    change_records(t).repartitionByRange(4, "pos").sortWithinPartitions("pos").select("value").write.text(folder)
    table = S.FollowedTable(t.spark, place, ["k"])
    table.start(t["fx_base"], how.pop("snapshot_pos", 0))
    for _ in range(2 if replay else 1):
        records = logs.read_changes(t.spark, folder, streaming=True, files_per_batch=1)
        rows = C.decode_changes(records, ROW).filter(~F.col("malformed"))
        changes = rows.select("pos", "op", F.col("key").alias("k"), F.col("after.v").alias("v"))
        S.follow(changes, table, shared_folder(t.spark, "state"), **how).awaitTermination()
    return table


@check(APPLIED)
def c3_apply_changes_stream(t: Tables) -> DataFrame:
    return _kv(_followed(t).read())


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


@check(f"select {LINE} from fx_lineitem_tgt")
def c4_apply_changes_keyless(t: Tables) -> DataFrame:
    return C.apply_changes_keyless(t["fx_lineitem"], t["fx_lineitem_changes"])


@check(
    f"""
with ch as (select case when l_partkey % 89 = 0 then -1 else 1 end as step, l_partkey * 1000000 + l_orderkey as pos, {LINE} from lineitem
            where l_partkey % 89 = 0 or l_partkey % 97 = 0),
im as (select {LINE}, cast(sum(step) as bigint) as net from ch group by {LINE}),
ct as (select {LINE}, count(*) as n from fx_lineitem group by {LINE}),
al as (select c.*, c.n + coalesce(i.net, 0) as copies from ct c left join im i using ({LINE}))
select {LINE}, copies from al where copies > 0"""
)
def c4_apply_changes_keyless_ordered(t: Tables) -> DataFrame:
    changes = t.sql(
        f"""select case when l_partkey % 89 = 0 then 'D' else 'I' end as op, l_partkey * 1000000 + l_orderkey as pos, {LINE}
            from lineitem where l_partkey % 89 = 0 or l_partkey % 97 = 0"""
    )
    out = C.apply_changes_keyless(t["fx_lineitem"], changes, "pos")
    return out.groupBy(*LINE.split(", ")).agg(F.count("*").alias("copies"))


def _after(low: int | None, high: int | None) -> str:
    cond = " and ".join([f"pos > {low}"] * (low is not None) + [f"pos <= {high}"] * (high is not None))
    return f"""
with ch as (select * from fx_change_log where {cond}),
nt as (select k, op, v from (select *, row_number() over (partition by k order by pos desc) as rn from ch) x where rn = 1)
select k, cast(v as double) as v from fx_base where k not in (select k from nt)
union all select k, cast(v as double) from nt where op <> 'D'"""


@check(_after(HALF, None))
def c5_load_and_follow(t: Tables) -> DataFrame:
    return _kv(C.load_and_follow(t["fx_base"], HALF, _log(t), ["k"]))


@check(_after(HALF, None))
def c5_load_and_follow_stream(t: Tables) -> DataFrame:
    return _kv(_followed(t, snapshot_pos=HALF).read())


@check(_after(None, HALF))
def c6_bound_changes(t: Tables) -> DataFrame:
    return _kv(C.apply_changes(t["fx_base"], C.bound_changes(_log(t), HALF), ["k"]))


@check(_after(None, HALF))
def c6_bound_changes_stream(t: Tables) -> DataFrame:
    return _kv(_followed(t, endpos=HALF).read())


@check(f"select max(pos) as applied_pos, max(pos) >= {HALF} as reached from fx_change_log where pos <= {HALF}")
def c6_end_reached(t: Tables) -> DataFrame:
    return C.end_reached(C.bound_changes(_log(t), HALF), HALF)


@check(APPLIED)
def c7_resume_changes(t: Tables) -> DataFrame:
    half = C.apply_changes(t["fx_base"], C.bound_changes(_log(t), HALF), ["k"])
    return _kv(C.apply_changes(half, C.resume_changes(_log(t), HALF), ["k"]))


@check(APPLIED)
def c7_replay_stream(t: Tables) -> DataFrame:
    table = _followed(t, replay=True)
    table.compact()
    return _kv(table.read())


# insert into an existing key, update of a missing one: log; delete of a missing one: ignore;
# each 211th change is bad data, each 1999th breaks its table (k modulo 3)
POLICY = """
with ch as (
  select event_id, pos, op, k, v, concat('t', cast(k % 3 as varchar(4))) as tbl,
         event_id % 1999 = 1500 as broken, event_id % 211 = 0 and event_id % 1999 <> 1500 as bad
  from fx_change_log),
st as (
  select ch.*, coalesce(last_value(case when not broken and not bad and op = 'I' then true when not broken and not bad and op = 'D' then false end ignore nulls)
                          over (partition by k order by pos rows between unbounded preceding and 1 preceding),
                        k in (select k from fx_base)) as there
  from ch),
rs as (
  select *, case when broken then 'TABLE_ERROR' when bad then 'BAD_DATA' when op = 'I' and there then 'INSERT_CONFLICT'
                 when op = 'U' and not there then 'UPDATE_MISSING' when op = 'D' and not there then 'DELETE_MISSING' end as reason
  from st),
sp as (select tbl, min(pos) as stop_pos from rs where reason = 'TABLE_ERROR' group by tbl),
lv as (select rs.* from rs left join sp on rs.tbl = sp.tbl where stop_pos is null or pos <= stop_pos)"""


def _policy(t: Tables, policy: C.ErrorPolicy = C.ErrorPolicy()) -> tuple[DataFrame, DataFrame]:
    log = t["fx_change_log"].select("pos", "op", "k", "v", F.concat(F.lit("t"), F.col("k") % 3).alias("tbl"), "event_id")
    return C.apply_with_policy(
        t["fx_base"],
        log,
        ["k"],
        policy,
        bad_data=F.col("event_id") % 211 == 0,
        table_error=F.col("event_id") % 1999 == 1500,
        store=shared_folder(t.spark, "c8"),
    )


@check(
    POLICY
    + """,
nt as (select k, op, v from (select *, row_number() over (partition by k order by pos desc) as rn from lv where reason is null) x where rn = 1)
select k, cast(v as double) as v from fx_base where k not in (select k from nt)
union all select k, cast(v as double) from nt where op <> 'D'"""
)
def c8_policy_table(t: Tables) -> DataFrame:
    return _kv(_policy(t)[0])


@check(POLICY + " select pos, tbl, k, op, reason from lv where reason is not null and reason <> 'DELETE_MISSING'")
def c8_policy_exceptions(t: Tables) -> DataFrame:
    return _policy(t)[1].drop("exception_id")


@check(POLICY + " select pos, tbl, k, op, reason from lv where reason is not null and reason <> 'DELETE_MISSING'")
def c8_policy_exceptions_stream(t: Tables) -> DataFrame:
    return _policy_stream(t).exceptions().select("pos", "tbl", "k", "op", "reason")


@check(
    POLICY
    + """,
nt as (select k, op, v from (select *, row_number() over (partition by k order by pos desc) as rn from lv where reason is null) x where rn = 1)
select k, cast(v as double) as v from fx_base where k not in (select k from nt)
union all select k, cast(v as double) from nt where op <> 'D'"""
)
def c8_policy_table_stream(t: Tables) -> DataFrame:
    return _kv(_policy_stream(t).read())


ESCALATED = POLICY.split("sp as (")[0] + """
nb as (select *, sum(case when reason = 'BAD_DATA' then 1 else 0 end) over (partition by tbl order by pos) as bad_rows from rs),
sp as (select tbl, min(pos) as stop_pos from nb where reason = 'TABLE_ERROR' or (reason = 'BAD_DATA' and bad_rows = 2) group by tbl),
lv as (select rs.* from rs left join sp on rs.tbl = sp.tbl where stop_pos is null or pos <= stop_pos)
select pos, tbl, k, op, reason from lv where reason is not null and reason <> 'DELETE_MISSING'"""
TWO_BAD = C.ErrorPolicy(bad_data_limit=2)


@check(ESCALATED)
def c8_escalation(t: Tables) -> DataFrame:
    """The second bad row of a table suspends it."""
    return _policy(t, TWO_BAD)[1].drop("exception_id")


@check(ESCALATED)
def c8_escalation_stream(t: Tables) -> DataFrame:
    return _policy_stream(t, TWO_BAD).exceptions().select("pos", "tbl", "k", "op", "reason")


def _policy_stream(t: Tables, policy: C.ErrorPolicy = C.ErrorPolicy()) -> S.FollowedTable:
    """The log as three files in order, one per batch, judged batch by batch."""
    folder, place = shared_folder(t.spark, "log"), shared_folder(t.spark, "followed")
    log = t["fx_change_log"].select("pos", "op", "k", "v", F.concat(F.lit("t"), F.col("k") % 3).alias("tbl"), "event_id")
    table = S.FollowedTable(t.spark, place, ["k"])
    table.start(t["fx_base"])
    low, high = log.approxQuantile("pos", [0.33, 0.66], 0.01)
    state = shared_folder(t.spark, "state")
    for part in (F.col("pos") <= low, (F.col("pos") > low) & (F.col("pos") <= high), F.col("pos") > high):
        log.filter(part).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(log.schema).parquet(folder)
        how = {"bad_data": F.col("event_id") % 211 == 0, "table_error": F.col("event_id") % 1999 == 1500}
        S.follow(stream, table, state, policy=policy, **how).awaitTermination()
    return table


KEYED = """
select concat('o-', cast(o_orderkey as varchar(20))) as code, cast(o_custkey as bigint) as part, cast(o_orderkey as bigint) as n from orders"""
# per key of text and number: moved to another text, changed, deleted, or left; all at one position for every fifth order
KEYED_AFTER = f"""
select case when n % 4 = 0 then concat(code, '-moved') else code end as code, part, case when n % 4 <= 1 then n + 1000000 else n end as n
from ({KEYED}) x where n % 4 <> 2"""


def _keyed_log(t: Tables, key: list[str]) -> DataFrame:
    image = F.struct("code", "part", "n")
    moved = F.struct(F.when(F.col("n") % 4 == 0, F.concat("code", F.lit("-moved"))).otherwise(F.col("code")).alias("code"), "part", (F.col("n") + 1_000_000).alias("n"))
    rows = t.sql(KEYED).filter("n % 4 <> 3")
    op = F.when(F.col("n") % 4 == 2, "D").otherwise("U")
    lsn = F.concat(F.lit("1/"), F.hex(F.floor(F.col("n") / 5)))
    record = F.struct(
        lsn.alias("lsn"), F.lit(1).alias("xid"), op.alias("action"), F.lit("t").alias("table"), F.struct("code", "part").alias("key"),
        F.when(op == "U", moved).alias("after"), image.alias("before"),
    )
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("part", T.LongType()), T.StructField("n", T.LongType())])
    of_key = T.StructType(schema.fields[:2])
    return C.row_changes(C.decode_changes(rows.select(F.to_json(record).alias("value")), schema, key_type=of_key), key)


@check(KEYED_AFTER)
def c3_key_of_two_columns(t: Tables) -> DataFrame:
    """A key of text and number; updates that change it; many changes at the same position."""
    return C.apply_changes(t.sql(KEYED), _keyed_log(t, ["code", "part"]), ["code", "part"], ["pos", "seq"])


@check(KEYED_AFTER)
def c3_key_of_two_columns_stream(t: Tables) -> DataFrame:
    log, folder = _keyed_log(t, ["code", "part"]), shared_folder(t.spark, "log")
    table = S.FollowedTable(t.spark, shared_folder(t.spark, "followed"), ["code", "part"], ["pos", "seq"])
    table.start(t.sql(KEYED))
    log.repartition(3).write.parquet(folder)
    stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    S.follow(stream, table, shared_folder(t.spark, "state")).awaitTermination()
    return table.read()


@check(KEYED_AFTER)
def c4_updates_without_a_key(t: Tables) -> DataFrame:
    return C.apply_changes_keyless(t.sql(KEYED), _keyed_log(t, []), ["pos", "seq"])


def _counted(t: Tables, base: DataFrame, log: DataFrame, order: list[str], files: DataFrame, replay: bool) -> keyless.CountedTable:
    """A table without a key after the log's files, one per batch; with ``replay`` they come again through a second checkpoint."""
    table = keyless.CountedTable(t.spark, shared_folder(t.spark, "followed"), order)
    table.start(base)
    folder = shared_folder(t.spark, "log")
    files.write.parquet(folder)
    for _ in range(2 if replay else 1):
        stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        S.follow(stream, table, shared_folder(t.spark, "state")).awaitTermination()
    return table


@check(CHECKS["c4_apply_changes_keyless_ordered"][1])
def c4_apply_changes_keyless_stream(t: Tables) -> DataFrame:
    """The log in three files in order, then the same files again."""
    log = t.sql(
        f"""select case when l_partkey % 89 = 0 then 'D' else 'I' end as op, l_partkey * 1000000 + l_orderkey as pos, {LINE}
            from lineitem where l_partkey % 89 = 0 or l_partkey % 97 = 0"""
    )
    table = _counted(t, t["fx_lineitem"], log, ["pos"], log.repartitionByRange(3, "pos"), replay=True)
    return table.read().groupBy(*LINE.split(", ")).agg(F.count("*").alias("copies"))


@check(KEYED_AFTER)
def c4_updates_without_a_key_stream(t: Tables) -> DataFrame:
    """Files that hold positions of the whole log each, so that all of them overlap."""
    log = _keyed_log(t, [])
    return _counted(t, t.sql(KEYED), log, ["pos", "seq"], log.repartition(3, "pos"), replay=False).read()


# every eleventh transaction never ends, every thirteenth is taken back
ENDED = """
with ch as (select * from fx_change_log where (event_id // 7) % 11 <> 0 and (event_id // 7) % 13 <> 0),
nt as (select k, op, v from (select *, row_number() over (partition by k order by pos desc) as rn from ch) x where rn = 1)
select k, cast(v as double) as v from fx_base where k not in (select k from nt)
union all select k, cast(v as double) from nt where op <> 'D'"""


@check(ENDED)
def c2_transactions_stream(t: Tables) -> DataFrame:
    """Transactions of seven changes in files that end anywhere; the record that ends one comes two changes later."""
    xid = F.floor(F.col("event_id") / 7)
    log = t["fx_change_log"].select(xid.alias("xid"), F.col("pos").cast("decimal(20,0)").alias("pos"), "op", "k", "v")
    ends = log.groupBy("xid").agg((F.max("pos") + 2 * 4194304 + 1).cast("decimal(20,0)").alias("pos")).filter("xid % 11 <> 0")
    ends = ends.withColumn("op", F.when(F.col("xid") % 13 == 0, transactions.ROLLBACK).otherwise(C.COMMIT))
    folder, table = shared_folder(t.spark, "log"), S.FollowedTable(t.spark, shared_folder(t.spark, "followed"), ["k"])
    table.start(t["fx_base"])
    opened, state = transactions.OpenTransactions(t.spark, shared_folder(t.spark, "open")), shared_folder(t.spark, "state")
    whole = log.unionByName(ends, allowMissingColumns=True)
    cuts = [None, *log.approxQuantile("pos", [0.3, 0.6], 0.01), None]
    for low, high in zip(cuts, cuts[1:]):
        part = whole if low is None else whole.filter(F.col("pos") > low)
        (part if high is None else part.filter(F.col("pos") <= high)).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(whole.schema).parquet(folder)
        transactions.follow_transactions(stream, table, opened, state).awaitTermination()
    return _kv(table.read())


TRUNCATED = f"""
with ch as (select * from fx_change_log where pos > {HALF}),
nt as (select k, op, v from (select *, row_number() over (partition by k order by pos desc) as rn from ch) x where rn = 1)
select k, cast(v as double) as v from nt where op <> 'D'"""


def _truncating_log(t: Tables) -> DataFrame:
    """The log with a truncate at half its way."""
    cut = t.spark.range(1).select(F.lit(HALF).cast("decimal(20,0)").alias("pos"), F.lit("T").alias("op"))
    log = _log(t).select(F.col("pos").cast("decimal(20,0)").alias("pos"), "op", "k", "v").filter(F.col("pos") != HALF)
    return log.unionByName(cut, allowMissingColumns=True)


@check(TRUNCATED)
def c9_truncate(t: Tables) -> DataFrame:
    return _kv(C.apply_changes(t["fx_base"], _truncating_log(t), ["k"]))


@check(TRUNCATED)
def c9_truncate_stream(t: Tables) -> DataFrame:
    log, folder = _truncating_log(t), shared_folder(t.spark, "log")
    table = S.FollowedTable(t.spark, shared_folder(t.spark, "followed"), ["k"])
    table.start(t["fx_base"])
    log.repartition(3).write.parquet(folder)
    stream = t.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    S.follow(stream, table, shared_folder(t.spark, "state")).awaitTermination()
    return _kv(table.read())


@check("select k, cast(v as double) as v, cast(null as varchar) as note from fx_base")
def c9_alter(t: Tables) -> DataFrame:
    wide = C.add_columns(t["fx_base"], T.StructType([T.StructField("note", T.StringType()), T.StructField("v", T.LongType())]))
    return wide.select("k", F.col("v").cast("double").alias("v"), "note")


@check(APPLIED)
def c7_late_file_stream(t: Tables) -> DataFrame:
    """The older half of the log comes after a compaction, through a second checkpoint."""
    log, folder, old = _log(t).select("pos", "op", "k", "v"), shared_folder(t.spark, "log"), shared_folder(t.spark, "log")
    table = S.FollowedTable(t.spark, shared_folder(t.spark, "followed"), ["k"])
    table.start(t["fx_base"])
    log.filter(F.col("pos") > HALF).write.parquet(folder)
    log.filter(F.col("pos") <= HALF).write.parquet(old)
    for place in (folder, old):
        S.follow(t.spark.readStream.schema(log.schema).parquet(place), table, shared_folder(t.spark, "state")).awaitTermination()
        table.compact()
    return _kv(table.read())


ALTERED = f"""
with nt as (select k, op, v, pos, event_type from (select *, row_number() over (partition by k order by pos desc) as rn from fx_change_log) x where rn = 1)
select k, cast(v as double) as v, cast(null as varchar) as event_type from fx_base where k not in (select k from nt)
union all select k, cast(case when pos > {HALF} then v else floor(v) end as double), case when pos > {HALF} then event_type end from nt where op <> 'D'"""


@check(ALTERED)
def c9_alter_stream(t: Tables) -> DataFrame:
    """At half the log a number of whole units becomes a decimal and a text column is added; the older half of the log comes last."""
    late, lsn = F.col("pos") > HALF, F.concat(F.hex(F.floor(F.col("pos") / WORD).cast("bigint")), F.lit("/"), F.hex(F.col("pos") % WORD))
    old = F.struct("k", F.floor("v").cast("bigint").alias("v"))
    new = F.struct("k", "v", "event_type")

    def records(rows: DataFrame, image: F.Column) -> DataFrame:
        kept = F.when(F.col("op") != "D", image)
        return rows.select(F.to_json(F.struct(lsn.alias("lsn"), F.col("op").alias("action"), F.lit("t").alias("table"), F.col("k").alias("key"), kept.alias("after"))).alias("value"))

    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("type")) for n, k in (("v", "decimal(38,2)"), ("event_type", "string"))])
    alter = t.spark.range(1).select(F.lit(HALF).alias("pos"))
    alter = alter.select(F.to_json(F.struct(lsn.alias("lsn"), F.lit("A").alias("action"), F.lit("t").alias("table"), columns.alias("columns"))).alias("value"))
    log = t["fx_change_log"]
    base = t["fx_base"].withColumn("v", F.col("v").cast("decimal(38,2)"))
    table = altered.AlteredTable(t.spark, shared_folder(t.spark, "followed"), ["k"], ["pos", "seq"], name="t")
    table.start(base)
    folder, state = shared_folder(t.spark, "log"), shared_folder(t.spark, "state")
    for part in (alter, records(log.filter(late), new), records(log.filter(~late), old)):
        part.write.mode("append").text(folder)
        altered.follow_records(logs.read_changes(t.spark, folder, streaming=True), table, state).awaitTermination()
    return _kv(table.read()).join(table.read().select("k", "event_type"), "k")


DDL = """
select pos, concat('t', cast(k % 11 as varchar(4))) as tbl, case when event_id % 1999 = 5 then 'X' else 'T' end as op
from fx_change_log where event_id % 997 = 3 or event_id % 1999 = 5"""


@check(
    f"""
with ev as ({DDL}), ct as (select tbl, max(pos) as cut from ev group by tbl),
r as (select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl from fx_change_log)
select event_id, pos, r.tbl from r left join ct on r.tbl = ct.tbl where cut is null or pos > cut"""
)
def c9_apply_ddl(t: Tables) -> DataFrame:
    rows = t.sql("select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl from fx_change_log")
    return C.apply_ddl(rows, t.sql(DDL))


@check(
    f"""
with ev as ({DDL})
select distinct concat('t', cast(k % 11 as varchar(4))) as tbl from fx_change_log
where concat('t', cast(k % 11 as varchar(4))) not in (select tbl from ev where op = 'X')"""
)
def c9_ddl_inventory(t: Tables) -> DataFrame:
    inventory = t.sql("select distinct concat('t', cast(k % 11 as varchar(4))) as tbl from fx_change_log")
    return C.ddl_inventory(inventory, t.sql(DDL))


ROUTED = """
select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl, op from fx_change_log
where k % 11 in (select n_nationkey from nation where n_nationkey % 2 = 0)"""


def _published(t: Tables) -> DataFrame:
    return t.sql("select concat('t', cast(n_nationkey as varchar(4))) as tbl from nation where n_nationkey % 2 = 0")


@check(ROUTED)
def c10_route_changes(t: Tables) -> DataFrame:
    rows = t.sql("select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl, op from fx_change_log")
    return C.route_changes(rows, _published(t)).select("event_id", "pos", "tbl", "op")


@check(ROUTED)
def c10_route_stream(t: Tables) -> DataFrame:
    folder, dest, state = (shared_folder(t.spark, "c10", n) for n in ("in", "out", "state"))
    rows = t.sql("select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl, op from fx_change_log")
    rows.repartition(4).write.parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    S.route_stream(stream, _published(t), dest, state).awaitTermination()
    return S.routed(t.spark, dest).select("event_id", "pos", "tbl", "op")


@check(ROUTED)
def c10_route_stream_two_checkpoints(t: Tables) -> DataFrame:
    dest = shared_folder(t.spark, "c10", "out")
    rows = t.sql("select event_id, pos, concat('t', cast(k % 11 as varchar(4))) as tbl, op from fx_change_log")
    for part in ("pos % 2 = 0", "pos % 2 <> 0"):
        folder = shared_folder(t.spark, "c10", "in")
        rows.filter(part).write.parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        S.route_stream(stream, _published(t), dest, shared_folder(t.spark, "c10", "state")).awaitTermination()
    return S.routed(t.spark, dest).select("event_id", "pos", "tbl", "op")


@check(f"select concat('t', cast(k % 3 as varchar(4))) as tbl, k, v from ({APPLIED}) a where k % 3 < 2")
def c10_follow_tables_stream(t: Tables) -> DataFrame:
    """Two of the log's three tables are followed by one stream, the second one without a key."""
    folder = shared_folder(t.spark, "log")
    change_records(t).filter(F.get_json_object("value", "$.table") != "t1").repartitionByRange(3, "pos").sortWithinPartitions("pos").select("value").write.text(folder)
    # table t1 has no key: its changes are the images that each change finds and leaves
    images = t.sql(
        """select pos, op, k, v, event_type, lag(op) over (partition by k order by pos) as old_op, lag(v) over (partition by k order by pos) as old_v,
                  lag(event_type) over (partition by k order by pos) as old_type from fx_change_log where k % 3 = 1"""
    ).join(t["fx_base"].select("k", F.col("v").alias("base_v")), "k", "left")
    first, gone = F.col("old_op").isNull(), F.col("old_op") == "D"
    before = F.when(first & F.col("base_v").isNotNull(), F.struct("k", F.col("base_v").alias("v"), F.lit(None).cast("string").alias("event_type")))
    before = before.when(~first & ~gone, F.struct("k", F.col("old_v").alias("v"), F.col("old_type").alias("event_type")))
    after = F.when(F.col("op") != "D", F.struct("k", "v", "event_type"))
    op = F.when(before.isNull(), F.when(F.col("op") != "D", "I")).when(F.col("op") == "D", "D").otherwise("U")
    lsn = F.concat(F.hex(F.floor(F.col("pos") / WORD).cast("bigint")), F.lit("/"), F.hex(F.col("pos") % WORD))
    record = F.struct(lsn.alias("lsn"), op.alias("action"), F.lit("t1").alias("table"), after.alias("after"), before.alias("before"))
    images.withColumn("act", op).filter("act is not null").select("pos", F.to_json(record).alias("value")).repartitionByRange(2, "pos").select("value").write.mode("append").text(folder)
    members = [group.Member("t0", ROW, ["k"]), group.Member("t1", ROW)]
    tables = group.TableGroup(t.spark, shared_folder(t.spark, "group"), members)
    base = t["fx_base"].withColumn("event_type", F.lit(None).cast("string"))
    tables.start({m.name: base.filter(F.col("k") % 3 == i) for i, m in enumerate(members)})
    group.follow_group(logs.read_changes(t.spark, folder, streaming=True, files_per_batch=2), tables, shared_folder(t.spark, "state")).awaitTermination()
    out = [_kv(tables.read(m.name)).select(F.lit(m.name).alias("tbl"), "k", "v") for m in members]
    return out[0].unionByName(out[1])


CHANGED = "select o_orderkey from orders where o_orderkey % 97 = 0 or o_orderkey % 101 = 0"


@check(
    f"""
select {ORDER_COLS} from fx_orders_tgt where o_orderkey not in ({CHANGED})
union all select {ORDER_COLS} from fx_orders where o_orderkey in ({CHANGED})"""
)
def c11_sync_changed_keys(t: Tables) -> DataFrame:
    return _orders_out(C.sync_changed_keys(t["fx_orders"], t["fx_orders_tgt"], t.sql(CHANGED), ["o_orderkey"]))


@check(
    f"""
select (select count(*) from fx_orders_tgt where o_orderkey in ({CHANGED})) as deleted,
       (select count(*) from fx_orders where o_orderkey in ({CHANGED})) as inserted"""
)
def c11_sync_counts(t: Tables) -> DataFrame:
    return C.sync_counts(t["fx_orders"], t["fx_orders_tgt"], t.sql(CHANGED), ["o_orderkey"])


@check(
    """
select s.ts, s.status, t.ts is not null as arrived, t.arrived_at - s.ts as delay, t.ts is null and 400000 - s.ts > 3600 as timed_out
from fx_ledger s left join fx_ledger_tgt t on s.ts = t.ts and s.status = t.status"""
)
def c12_marker_status(t: Tables) -> DataFrame:
    return C.marker_status(t["fx_ledger"], t["fx_ledger_tgt"], 400_000, timeout=3600)


@check(
    """
select s.ts, s.status, t.ts is not null as arrived, t.arrived_at - s.ts as delay, t.ts is null as timed_out
from fx_ledger s left join fx_ledger_tgt t on s.ts = t.ts and s.status = t.status"""
)
def c12_marker_stream(t: Tables) -> DataFrame:
    """Source and target ledgers in two files each; a heartbeat at the end moves the clock past the last marker's time."""
    places = [shared_folder(t.spark, "ledger") for _ in range(2)]
    end = t["fx_ledger"].agg((F.max("ts") + 100_000).alias("ts")).withColumn("status", F.lit("heartbeat"))
    beats = [end, end.withColumn("arrived_at", F.col("ts"))]
    state, dest = shared_folder(t.spark, "state"), shared_folder(t.spark, "markers")
    half = end.first()["ts"] // 2
    tables = [t["fx_ledger"], t["fx_ledger_tgt"]]
    for cond in (F.col("ts") <= half, F.col("ts") > half, None):
        for place, rows, beat in zip(places, tables, beats):
            rows = beat.select(*rows.columns) if cond is None else rows.filter(cond)
            rows.write.mode("append").parquet(place)
        streams = [t.spark.readStream.schema(rows.schema).parquet(place) for place, rows in zip(places, tables)]
        markers.follow_markers(*streams, dest, state, timeout=3600).awaitTermination()
    return t.spark.read.parquet(dest).filter("status <> 'heartbeat'")
