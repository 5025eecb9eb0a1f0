import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from karavel.functions.expr import lsn_to_pos
from karavel.operators import changes as C

SCHEMA = "pos bigint, op string, k bigint, v string"


def random_log(n, keys, seed, hot=0.4):
    rnd = random.Random(seed)
    return [
        (i + 1, rnd.choice("IIUUD"), 0 if rnd.random() < hot else rnd.randrange(keys), f"v{i}") for i in range(n)
    ]


def test_net_changes_and_apply(spark):
    log = random_log(2000, 30, 3)
    base = [(k, f"b{k}") for k in range(0, 60, 3)]
    want = dict(base)
    for _, op, k, v in log:
        if op == "D":
            want.pop(k, None)
        else:
            want[k] = v
    target = spark.createDataFrame(base, "k bigint, v string")
    changes = spark.createDataFrame(log, SCHEMA).repartition(5)
    got = C.apply_changes(target, changes, ["k"])
    assert {r["k"]: r["v"] for r in got.collect()} == want and got.count() == len(want)


def test_equal_positions_need_a_second_order_column(spark):
    changes = spark.createDataFrame([(5, 1, "I", 1, "a"), (5, 2, "U", 1, "b")], "pos bigint, seq bigint, op string, k bigint, v string")
    assert C.net_changes(changes, ["k"], ["pos", "seq"]).first()["v"] == "b"


@pytest.mark.parametrize("pieces", [3, 100_000])
def test_repeat_rows(spark, pieces):
    rows = [("a", 10), ("b", 1), ("c", 0), ("d", -2), (None, 7)]
    out = C.repeat_rows(spark.createDataFrame(rows, "x string, n bigint"), "n", pieces)
    assert Counter(r["x"] for r in out.collect()) == Counter({"a": 10, "b": 1, None: 7})


def image(rnd):
    return (rnd.choice([None, 1, 2]), rnd.choice(["x", "y", None]))


@pytest.mark.parametrize("size", [1_000_000, 40])
def test_keyless_in_log_order(spark, size):
    rnd = random.Random(9)
    target = [image(rnd) for _ in range(60)] + [(7, "hot")] * 500
    log = [(i, rnd.choice("ID"), *((7, "hot") if rnd.random() < 0.4 else image(rnd))) for i in range(800)]
    want = Counter(target)
    for _, op, a, b in log:
        if op == "I":
            want[a, b] += 1
        elif want[a, b] > 0:
            want[a, b] -= 1
    got = C.apply_changes_keyless(
        spark.createDataFrame(target, "a bigint, b string").repartition(4),
        spark.createDataFrame(log, "pos bigint, op string, a bigint, b string").repartition(4),
        "pos",
        rows_per_range=size,
        copies_per_row=16,
    )
    assert Counter(tuple(r) for r in got.collect()) == +want


def test_keyless_without_order(spark):
    target = [(1, "x")] * 3 + [(2, "y"), (None, None), (None, None)]
    log = [("D", 1, "x")] * 5 + [("I", 1, "x"), ("D", None, None), ("I", 3, "z"), ("I", 2, "y"), ("D", 9, "q")]
    got = C.apply_changes_keyless(
        spark.createDataFrame(target, "a bigint, b string"), spark.createDataFrame(log, "op string, a bigint, b string")
    )
    want = Counter({(1, "x"): 1, (2, "y"): 2, (None, None): 1, (3, "z"): 1})
    assert Counter(tuple(r) for r in got.collect()) == want


def simulate(base, log, actions, bad, broken):
    """The error policy, one change at a time."""
    table, errors, stopped = dict(base), [], set()
    for pos, op, k, v, tbl in log:
        if tbl in stopped:
            continue
        reason = None
        if broken(pos):
            reason = "TABLE_ERROR"
        elif k is None or op not in "IUD" or bad(pos):
            reason = "BAD_DATA"
        elif op == "I" and k in table:
            reason = "INSERT_CONFLICT"
        elif op == "U" and k not in table:
            reason = "UPDATE_MISSING"
        elif op == "D" and k not in table:
            reason = "DELETE_MISSING"
        if reason is None:
            if op == "D":
                del table[k]
            else:
                table[k] = v
            continue
        if actions[reason] != "ignore":
            errors.append((pos, reason))
        if actions[reason] == "suspend":
            stopped.add(tbl)
    return table, errors


@pytest.mark.parametrize("size", [1_000_000, 50])
@pytest.mark.parametrize(
    "policy", [C.ErrorPolicy(), C.ErrorPolicy(delete_missing="log", table_error="log"), C.ErrorPolicy(bad_data="suspend", table_error="log")]
)
def test_policy_equals_one_by_one(spark, size, policy):
    log = random_log(1500, 25, 5)
    log = [(p, "?" if p % 401 == 0 else op, None if p % 307 == 0 else k, v, f"t{(k or 0) % 3}") for p, op, k, v in log]
    base = [(k, "b") for k in range(0, 25, 2)]
    table, errors = simulate(base, log, policy.actions(), lambda p: p % 97 == 0, lambda p: p in (600, 900))
    after, logged = C.apply_with_policy(
        spark.createDataFrame(base, "k bigint, v string"),
        spark.createDataFrame(log, SCHEMA + ", tbl string").repartition(6),
        ["k"],
        policy,
        bad_data=F.col("pos") % 97 == 0,
        table_error=F.col("pos").isin(600, 900),
        rows_per_range=size,
    )
    assert {r["k"]: r["v"] for r in after.collect()} == table
    assert sorted((r["pos"], r["reason"]) for r in logged.collect()) == errors
    assert logged.select("exception_id").distinct().count() == len(errors)


def test_whole_transactions(spark):
    log = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, 11), (6, 12)], "pos bigint, xid bigint")
    assert sorted(r["pos"] for r in C.whole_transactions(log, 5).collect()) == [1, 2, 3, 5]
    assert C.whole_transactions(log, 0).count() == 0


def test_end_reached(spark):
    log = spark.createDataFrame([(1,), (4,)], "pos bigint")
    assert C.end_reached(log, 4).first()["reached"] and not C.end_reached(log, 5).first()["reached"]
    assert not C.end_reached(log.filter("pos > 9"), 5).first()["reached"]


def test_high_log_positions(spark):
    row = spark.createDataFrame([("FFFFFFFF/FFFFFFFF",)], "l string").select(lsn_to_pos(F.col("l")).alias("p")).first()
    assert int(row["p"]) == 2**64 - 1


def test_decode_marks_bad_records(spark):
    good = {"lsn": "1/A", "xid": 3, "action": "I", "table": "t", "key": 1, "after": {"a": 5}}
    texts = [json.dumps(good), "{broken", json.dumps({**good, "lsn": "zz"}), json.dumps({**good, "action": "?"}), json.dumps({**good, "lsn": None})]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    out = C.decode_changes(rows, T.StructType([T.StructField("a", T.LongType())])).collect()
    assert [r["malformed"] for r in out] == [False, True, True, True, True]
    assert int(out[0]["pos"]) == 2**32 + 10 and out[0]["after"]["a"] == 5 and out[1]["raw"] == "{broken"


def test_ddl(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 3)], "tbl string, pos bigint")
    events = spark.createDataFrame([("a", 3, "T"), ("a", 1, "T"), ("b", 9, "X")], "tbl string, pos bigint, op string")
    assert sorted(map(tuple, C.apply_ddl(rows, events).collect())) == [("a", 5), ("c", 3)]
    assert C.apply_ddl(rows, events, C.DdlPolicy(truncate=False, drop=False)).count() == 4
    left = C.ddl_inventory(rows.select("tbl").distinct(), events)
    assert sorted(r["tbl"] for r in left.collect()) == ["a", "c"]
    added = T.StructType([T.StructField("pos", T.LongType()), T.StructField("note", T.StringType())])
    wide = C.add_columns(rows, added)
    assert wide.columns == ["tbl", "pos", "note"] and wide.filter("note is null").count() == 4
    assert C.add_columns(rows, added, C.DdlPolicy(alter=False)).columns == ["tbl", "pos"]


def test_marker_timeout(spark):
    src = spark.createDataFrame([(100, "testing"), (100, "copying"), (990, "testing")], "ts bigint, status string")
    tgt = spark.createDataFrame([(100, "testing", 103), (100, "testing", 101)], "ts bigint, status string, arrived_at bigint")
    got = {(r["ts"], r["status"]): (r["arrived"], r["delay"], r["timed_out"]) for r in C.marker_status(src, tgt, 1000).collect()}
    assert got == {(100, "testing"): (True, 1, False), (100, "copying"): (False, None, True), (990, "testing"): (False, None, False)}


def test_truncate_empties_the_target_and_is_no_row(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    log = spark.createDataFrame([(1, "I", 3, "c"), (2, "T", None, None), (3, "I", 4, "d"), (4, "A", None, None)], SCHEMA)
    assert sorted(map(tuple, C.apply_changes(target, log, ["k"]).collect())) == [(4, "d")]
    assert sorted(map(tuple, C.apply_changes(target, log.filter("op in ('A', 'I')"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_updates_that_change_the_key_or_have_none(spark):
    row = T.StructType([T.StructField("code", T.StringType()), T.StructField("n", T.LongType())])
    record = lambda lsn, op, before, after: (json.dumps({"lsn": lsn, "xid": 1, "action": op, "table": "t", "key": (before or after)["code"], "before": before, "after": after}),)
    texts = [
        record("0/1", "U", {"code": "a", "n": 1}, {"code": "z", "n": 1}),
        record("0/1", "U", {"code": "b", "n": 2}, {"code": "a", "n": 2}),  # the same position, takes the key just given up
        record("0/2", "D", {"code": "c", "n": 3}, None),
        record("0/3", "U", None, {"code": "d", "n": 40}),
    ]
    decoded = C.decode_changes(spark.createDataFrame(texts, "value string"), row, key_type=T.StringType())
    assert not decoded.filter("malformed").count()
    target = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "code string, n bigint")
    keyed = C.apply_changes(target, C.row_changes(decoded, ["code"]), ["code"], ["pos", "seq"])
    assert sorted(map(tuple, keyed.collect())) == [("a", 2), ("d", 40), ("z", 1)]
    keyless = C.apply_changes_keyless(target, C.row_changes(decoded.filter("before is not null"), []), ["pos", "seq"])
    assert sorted(map(tuple, keyless.collect())) == [("a", 2), ("d", 4), ("z", 1)]


def exchanges_over(df, column):
    """Shuffles in the plan whose rows carry a column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and column in line]


def test_a_small_key_set_does_not_shuffle_the_target(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # the target counts as large
    try:
        target = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("wide_target"))
        log = spark.createDataFrame([(1, "U", 5, "y")], "pos bigint, op string, k bigint, wide_target string")
        after = C.apply_changes(target, log, ["k"])
        assert exchanges_over(after, "k#") == [] and after.filter("wide_target = 'y'").count() == 1
        synced = C.sync_changed_keys(target, target, log.select("k"), ["k"])
        assert exchanges_over(synced, "k#") == [] and synced.count() == 1000
        routed = C.route_changes(target.withColumnRenamed("k", "tbl"), spark.range(3).withColumnRenamed("id", "tbl"))
        assert exchanges_over(routed, "tbl#") == [] and routed.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
