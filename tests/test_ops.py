from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from karavel.functions.ordered import ROWS_PER_RANGE
from karavel.operators import activity as A, cutover as K, values as V
from karavel.operators.scope import Scope
from karavel.session import shared_folder

T0 = datetime(2024, 1, 1)
AS_OF = 1704067200 + 10_000


@pytest.mark.parametrize(
    "query, want",
    [
        ("copy\n(x)", "copy (x)"),
        ('COPY "public"."t" FROM STDIN', "COPY public"),
        ("BEGIN;\nCREATE INDEX ix ON t (a);\nCOMMIT", "CREATE INDEX ix"),
        ("CREATE UNIQUE INDEX ix ON t (a)", "CREATE UNIQUE INDEX ix ON t (a)"),
        ("ALTER TABLE a.b ADD x int", "ALTER TABLE a.b"),
        ('VACUUM (ANALYZE) "t1"', "VACUUM t1"),
        ("REFRESH MATERIALIZED VIEW mv; COPY x", "REFRESH MATERIALIZED VIEW mv"),
        ("x" * 80, "x" * 60),
    ],
)
def test_operation_names(spark, query, want):
    got = spark.createDataFrame([(query,)], "q string").select(A.operation_name(F.col("q"))).first()[0]
    assert got == want


def sessions(spark, *rows):
    cols = "snap bigint, pid bigint, state string, wait_event_type string, wait_event string, query string, query_start timestamp_ntz, xact_start timestamp_ntz, blocked_by array<bigint>, backend_type string"
    full = []
    for r in rows:
        full.append((r.get("snap", 1), r["pid"], r.get("state", "active"), r.get("wt"), r.get("we"), r.get("q", "select"), T0 + timedelta(seconds=r.get("t", 0)), T0 + timedelta(seconds=r.get("t", 0)), r.get("by", []), r.get("bt", "client")))
    return spark.createDataFrame(full, cols)


def test_blocking_by_several_sessions(spark):
    s = sessions(spark, {"pid": 1, "by": [2, 3, 9], "wt": "Lock", "we": "tuple"}, {"pid": 2, "state": "idle in transaction"}, {"pid": 3, "by": [2]}, {"pid": 2, "snap": 2})
    got = A.blocking_tree(s, AS_OF).collect()
    assert sorted((r["blocked_pid"], r["blocking_pid"], r["blocker_state"], r["waiting_on"]) for r in got) == [
        (1, 2, "idle in transaction", "Lock:tuple"), (1, 3, "active", "Lock:tuple"), (3, 2, "idle in transaction", "-")
    ]
    assert {r["snap"]: r["blocked"] for r in A.blocked_sessions(s).collect()} == {1: 2, 2: 0}
    assert got[0]["blocker_xact_age"] == 10_000


def test_stall_verdict(spark):
    s = sessions(spark, {"pid": 1, "snap": 1}, {"pid": 1, "snap": 2, "by": [4]}, {"pid": 1, "snap": 3})
    locks = spark.createDataFrame([(1, True), (3, False), (3, True)], "snap bigint, granted boolean")
    got = {r["snap"]: (r["blocked"], r["ungranted"], r["verdict"]) for r in A.stall_verdict(s, locks).collect()}
    assert got == {1: (0, 0, "feed or IO"), 2: (1, 0, "lock involved"), 3: (0, 1, "lock involved")}


def test_idle_sessions_keep_the_full_count(spark):
    s = sessions(spark, *[{"pid": i, "state": "idle in transaction", "t": -i, "q": "a\nb"} for i in range(30)], {"pid": 99})
    got = A.idle_in_transaction(s, AS_OF).collect()
    assert len(got) == 20 and {r["sessions"] for r in got} == {30} and got[0]["pid"] == 29 and got[0]["last_query"] == "a b"


def test_vacuum_percent(spark):
    p = spark.createDataFrame([(1, 1, "t", "scan", 3, 1), (1, 2, "t", "scan", 0, 0)], "snap bigint, pid bigint, relation string, phase string, blocks_total bigint, blocks_scanned bigint")
    got = A.vacuum_progress_sessions(p, sessions(spark, {"pid": 1, "t": 5}, {"pid": 2}), AS_OF).collect()
    assert [(r["pid"], r["pct_scanned"]) for r in got] == [(2, None), (1, 33.3)]


@pytest.mark.parametrize("size", [ROWS_PER_RANGE, 3])
def test_throughput_clamps_growth(spark, size):
    rows = [("a", T0 + timedelta(seconds=10 * i), 100 * i, s) for i, s in enumerate([50, 95, 10, 10, 1000, 1005, 2000])]
    out = A.throughput(spark.createDataFrame(rows, "server string, sample_ts timestamp_ntz, pos bigint, size_bytes bigint"), size)
    got = [(r["wal_bytes"], r["growth"], r["growth_per_second"]) for r in out.orderBy("sample_ts").collect()]
    assert got == [(100, 45, 4), (100, 0, 0), (100, 0, 0), (100, 990, 99), (100, 5, 0), (100, 995, 99)]


def test_ledger(spark):
    path = shared_folder(spark, "ledger")
    for ts, status in ((5, "old"), (10, "initializing"), (40, "copying"), (100, "replicating")):
        K.ledger_append(spark, path, status, ts)
    out = K.timeline(spark.read.parquet(path), 10).orderBy("ts").collect()
    assert [(r["status"], r["seconds"]) for r in out] == [("initializing", 30), ("copying", 60), ("replicating", None)]


def test_gate_needs_all_three(spark):
    lag = spark.createDataFrame([(i, i != 1) for i in range(5)], "run bigint, caught_up boolean")
    marker = spark.createDataFrame([(i, i != 2) for i in range(4)], "run bigint, arrived boolean")
    codes = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 3), (4, 0)], "run bigint, exit_code int")
    got = {r["run"]: r["ready"] for r in K.cutover_ready(lag, marker, codes).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_fast_forward(spark):
    s = spark.createDataFrame([("a", 1000, 50, 57), ("b", 1000, 5, 5)], "seq string, ts bigint, t0 bigint, t1 bigint")
    got = {r["seq"]: r["new_last"] for r in K.fast_forward(s, 1039, skip=65).collect()}
    assert got == {"a": 57 + (3 + 6) * 7, "b": 5}


def test_reset_target(spark):
    spark.sql("CREATE DATABASE reset_me")
    for name in ("keep", "a", "b"):
        spark.range(1).write.saveAsTable(f"reset_me.{name}")
    spark.sql("CREATE VIEW reset_me.v AS SELECT * FROM reset_me.a")
    scope = Scope(exclude_table=["reset_me.keep"])
    plan = K.reset_target(spark, "reset_me", scope)
    assert sorted(r["name"] for r in plan.collect()) == ["a", "b", "v"]
    assert len(spark.catalog.listTables("reset_me")) >= 4  # a dry run drops nothing
    K.reset_target(spark, "reset_me", scope, dry_run=False)
    assert [t.name for t in spark.catalog.listTables("reset_me") if not t.isTemporary] == ["keep"]
    spark.sql("DROP DATABASE reset_me CASCADE")


def test_leftovers(spark):
    rows = [("table", "s", "awsdms_x", False), ("table", "s", "my_dms", False), ("publication", "s", "my_dms", False), ("replication slot", "s", "a_dms_b", True), ("replication set", "s", "x" * 51, False), ("replication set", "s", "x" * 50, False)]
    got = K.artefacts(spark.createDataFrame(rows, "kind string, schema_name string, name string, active boolean"))
    assert sorted((r["kind"], r["action"]) for r in got.collect()) == [("publication", "drop"), ("replication set", "drop"), ("replication slot", "warn"), ("table", "drop")]


def test_large_values(spark):
    df = spark.createDataFrame([(1, "é" * 600, bytearray(b"x" * 1100)), (2, "a" * 1024, None), (3, None, bytearray(b""))], "id bigint, t string, b binary")
    got = {r["id"]: r for r in V.limit_lobs(df, ["t", "b"], 1).collect()}
    assert got[1]["t_cut"] and got[1]["t"] == "é" * 600 and len(got[1]["b"]) == 1024 and got[1]["b_cut"]
    assert not got[2]["t_cut"] and len(got[2]["t"]) == 1024 and got[2]["b"] is None and got[3]["t"] is None
    full = V.limit_lobs(df, ["t"], None).collect()
    assert len(full[0]["t"]) == 600 and not any(r["t_cut"] for r in full)


def test_repair(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok \xc3\xa9")), (2, bytearray(b"a\xffb\xc0c")), (3, None)], "id bigint, t binary")
    got = {r["id"]: (r["t"], r["t_repaired"]) for r in V.repair_text(df, ["t"], "?").collect()}
    assert got == {1: ("ok é", 0), 2: ("a?b?c", 2), 3: (None, None)}
    assert tuple(V.repair_counts(V.repair_text(df, ["t"], ""), ["t"]).first()) == ("t", 1, 2)
    # the zero character as replacement
    assert V.repair_text(df, ["t"], "\x00").filter("id = 2").first()["t"] == "a\x00b\x00c"


def test_folder_needs_a_shared_place(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        shared_folder(Cluster())
