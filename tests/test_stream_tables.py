"""Tables without a key, whole transactions, groups of tables and alters, against plain simulations."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from karavel.session import shared_folder
from karavel.streaming.altered import AlteredTable, altered, widened
from karavel.streaming.follow import FollowedTable
from karavel.streaming.group import Member, TableGroup
from karavel.streaming.keyless import CountedTable
from karavel.streaming.transactions import ApplySettings, OpenTransactions, follow_transactions

IMAGES = "pos bigint, seq int, op string, a bigint, b string"
START = [(7, "hot")] * 40 + [(1, "x")] * 3 + [(None, None)] * 2


def image_log(n, seed):
    rnd = random.Random(seed)
    pick = lambda: (7, "hot") if rnd.random() < 0.4 else (rnd.choice([None, 1, 2]), rnd.choice(["x", None]))
    return [(i + 1, s, rnd.choice("IDD"), *pick()) for i in range(n) for s in range(rnd.choice([1, 1, 2]))]


def simulate(log, start=START):
    have = Counter(start)
    for _, _, op, *row in sorted(log):
        if op == "T":
            have.clear()
        elif op == "I":
            have[tuple(row)] += 1
        elif have[tuple(row)] > 0:
            have[tuple(row)] -= 1
    return +have


def counted(spark, batches, start=START):
    t = CountedTable(spark, shared_folder(spark, "t"), ["pos", "seq"])
    t.start(spark.createDataFrame(start, "a bigint, b string"))
    for i, rows in enumerate(batches):
        t.apply_batch(spark.createDataFrame(rows, IMAGES), f"batch={i}")
    return t


def copies(df):
    return Counter(tuple(r) for r in df.collect())


def by_position(log, *cuts):
    edges = [0, *cuts, 10**9]
    return [[r for r in log if lo < r[0] <= hi] for lo, hi in zip(edges, edges[1:])]


def test_counted_batches_in_any_order(spark):
    log = image_log(150, 1)
    parts = by_position(log, 40, 90)
    want = simulate(log)
    for batches in (parts, parts[::-1], [*parts, parts[1]], [[r for r in log if r[0] % 3 == k] for k in range(3)]):
        t = counted(spark, batches)
        assert copies(t.read()) == want
    assert not t.apply_batch(spark.createDataFrame(parts[0], IMAGES), "batch=0")
    assert copies(t.read()) == want and t.seen_pos() == 150


def test_counted_truncate_and_compaction(spark):
    log = image_log(120, 2)
    log = [r for r in log if r[0] != 70] + [(70, 0, "T", None, None)]
    parts = by_position(log, 30, 60, 100)
    t = counted(spark, parts)
    assert copies(t.read()) == simulate(log)
    t.compact(80)  # in the middle of a batch, after the truncate
    assert copies(t.read()) == simulate(log)
    t.apply_batch(spark.createDataFrame(parts[0], IMAGES), "late")  # dropped: the base holds it
    t.compact(120)
    t.prune(1)
    assert copies(t.read()) == simulate(log) and t.commits().filter("rows > 0").count() == 0
    early = counted(spark, parts[:2])
    early.compact(45)
    assert copies(early.read()) == simulate(parts[0] + parts[1])
    with pytest.raises(ValueError):
        early.compact()


def test_counted_tables_have_no_key(spark):
    with pytest.raises(ValueError):
        FollowedTable(spark, shared_folder(spark, "t"), [])
    t = counted(spark, [[]])
    assert copies(t.read()) == Counter(START)


# ------------------------------------------------------------------------------------ transactions

ROWS = "xid bigint, pos bigint, op string, k bigint, v string"


def kv(df):
    return {r["k"]: r["v"] for r in df.collect()}


def keyed(spark):
    t = FollowedTable(spark, shared_folder(spark, "t"), ["k"])
    t.start(spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"))
    return t


def test_a_transaction_over_two_files_is_applied_at_once(spark):
    t, held = keyed(spark), OpenTransactions(spark, shared_folder(spark, "open"))
    folder, state = shared_folder(spark, "log"), shared_folder(spark, "cp")
    files = [
        [(5, 1, "U", 1, "t5"), (6, 2, "D", 2, None), (None, 3, "I", 9, "alone")],
        [(5, 4, "I", 3, "t5"), (7, 5, "I", 4, "t7"), (6, 6, "R", None, None)],
        [(5, 7, "C", None, None), (8, 8, "I", 5, "t8"), (8, 9, "C", None, None)],
        [(7, 10, "C", None, None)],
    ]
    seen = []
    for rows in files:
        spark.createDataFrame(rows, ROWS).write.mode("append").parquet(folder)
        follow_transactions(spark.readStream.schema(ROWS).parquet(folder), t, held, state).awaitTermination()
        seen.append(kv(t.read()))
    before = {1: "a", 2: "b", 9: "alone"}
    third = {1: "t5", 2: "b", 3: "t5", 5: "t8", 9: "alone"}
    assert seen == [before, before, third, third | {4: "t7"}]
    done = set(t._finished("commits"))
    assert held.open(done).count() == 0
    held.prune(done)
    assert len(t._finished("commits")) == 4 and held._list(done)[0] == 4


def test_a_batch_that_is_tried_again_releases_the_same(spark):
    held = OpenTransactions(spark, shared_folder(spark, "open"))
    df = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    first = df((1, 1, "I", 1, "x"), (2, 2, "I", 2, "y"))
    assert held.release(first, "b0", set()).count() == 0
    second = df((1, 3, "C", None, None), (2, 4, "I", 3, "z"))
    for _ in range(2):  # the commit of b1 is lost once
        assert [r["k"] for r in held.release(second, "b1", {"b0"}).collect()] == [1]
    assert sorted((r["xid"], r["held"], r["rows"]) for r in held.open({"b0", "b1"}).collect()) == [(2, "b0", 1), (2, "b1", 1)]
    last = held.release(df((2, 5, "C", None, None)), "b2", {"b0", "b1"})
    assert sorted(r["k"] for r in last.collect()) == [2, 3]


def test_settings_of_a_task():
    tuning = {"BatchApplyPreserveTransaction": True, "BatchApplyTimeoutMin": 1, "BatchApplyTimeoutMax": 30, "BatchApplyMemoryLimit": 1000}
    s = ApplySettings.of(tuning)
    assert s.trigger() == {"processingTime": "1 seconds"} and s.reader_options() == {"maxBytesPerTrigger": "1000m"} and s.preserve_transactions
    assert ApplySettings.of({"BatchApplyMemoryLimit": 0}).reader_options() == {}


# ------------------------------------------------------------------------------------------ groups

NUMBERS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
NAMES = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())])


def record(pos, action, table, after=None, before=None, **more):
    return json.dumps({"lsn": f"0/{pos:X}", "xid": 1, "action": action, "table": table, "after": after, "before": before} | more)


def test_tables_of_a_group_are_at_the_same_batch(spark):
    members = [Member("numbers", NUMBERS, ["id"]), Member("names, old", NAMES, ["code"], T.StringType()), Member("bag", NUMBERS)]
    g = TableGroup(spark, shared_folder(spark, "g"), members, jobs=1)
    g.start({"numbers": spark.createDataFrame([(1, 10)], NUMBERS), "names, old": spark.createDataFrame([("a", "x")], NAMES), "bag": spark.createDataFrame([(5, 5)] * 2, NUMBERS)})
    state = lambda: [sorted(map(tuple, g.read(m.name).collect())) for m in members]
    lines = [
        record(1, "U", "numbers", {"id": 1, "n": 11}, key=1), record(2, "I", "names, old", {"code": "b", "name": "y"}, key="b"),
        record(3, "D", "bag", None, {"id": 5, "n": 5}), record(4, "I", "elsewhere", {"id": 1}), '{"lsn": "0/9", "action": "C", "xid": 1}', "{cut off",
        record(5, "D", "names, old", None, None, key="a"), record(6, "?", "numbers", {"id": 3, "n": 3}),
    ]
    batch = spark.createDataFrame([(x,) for x in lines], "value string")
    start, store = state(), g.tables["names, old"].store

    def fails(*args, **how):
        store(*args, **how)
        raise RuntimeError("lost")

    g.tables["names, old"].store = fails
    with pytest.raises(RuntimeError):
        g.apply_batch(batch, "b0")
    assert state() == start and g.rejected() is None
    g.tables["names, old"].store = store
    assert g.apply_batch(batch, "b0") and not g.apply_batch(batch, "b0")
    assert state() == [[(1, 11)], [("b", "y")], [(5, 5)]]
    assert sorted(r["value"] for r in g.rejected().collect()) == sorted(["{cut off", lines[-1]])
    assert g.apply_batch(spark.createDataFrame([(record(7, "I", "bag", {"id": 6, "n": 6}),)], "value string"), "b1")
    assert state() == [[(1, 11)], [("b", "y")], [(5, 5), (6, 6)]] and g.tables["bag"].commits().count() == 2


# ------------------------------------------------------------------------------------------ alters


def test_alters_between_batches_and_late_ones(spark):
    t = AlteredTable(spark, shared_folder(spark, "t"), ["id"], ["pos", "seq"], name="t")
    t.start(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id bigint, n int"))
    alter = lambda pos, table="t", **cols: record(pos, "A", table, columns=[{"name": n, "type": k} for n, k in cols.items()])
    batches = [
        [record(10, "U", "t", {"id": 1, "n": 11}, key=1), record(11, "I", "other", {"id": 9, "n": 9}, key=9)],
        [alter(20, n="bigint", note="string"), alter(21, "other", x="int"), record(22, "U", "t", {"id": 2, "n": 3_000_000_000, "note": "big"}, key=2)],
        [alter(30, n="decimal(22,2)"), record(31, "I", "t", {"id": 4, "n": 1.25, "note": None}, key=4)],
        [alter(15, n="int"), record(16, "U", "t", {"id": 3, "n": 33}, key=3), record(17, "U", "t", {"id": 2, "n": 22}, key=2)],
    ]
    for i, lines in enumerate(batches):
        assert t.apply_records(spark.createDataFrame([(x,) for x in lines], "value string"), f"b{i}")
    rows = {r["id"]: (float(r["n"]), r["note"]) for r in t.read().collect()}
    assert rows == {1: (11.0, None), 2: (3_000_000_000.0, "big"), 3: (33.0, None), 4: (1.25, None)}
    assert t.schema().simpleString() == "struct<id:bigint,n:decimal(22,2),note:string>"
    assert not t.apply_records(spark.createDataFrame([("x",)], "value string"), "b0")
    t.compact(t.seen_pos())
    assert {r["id"]: (float(r["n"]), r["note"]) for r in t.read().collect()} == rows


def test_columns_are_only_widened():
    long, narrow = T.LongType(), T.IntegerType()
    assert widened(narrow, long) == long == widened(long, narrow)
    assert widened(long, T.StringType()) == T.StringType() and widened(T.FloatType(), T.DoubleType()) == T.DoubleType()
    for old, new in ((T.StringType(), long), (T.DecimalType(10, 2), T.DecimalType(10, 4)), (T.DoubleType(), T.FloatType())):
        with pytest.raises(ValueError):
            widened(old, new)
    schema = T.StructType([T.StructField("a", narrow)])
    assert altered(schema, [(2, [{"name": "a", "type": "decimal(30,0)"}]), (1, [{"name": "a", "type": "bigint"}])])["a"].dataType == T.DecimalType(30, 0)


# ----------------------------------------------------------------------------------------- markers


def test_a_marker_that_never_arrives_times_out(spark):
    from karavel.streaming.markers import follow_markers

    sent, came, dest, state = (shared_folder(spark, "m") for _ in range(4))
    left, right = "ts bigint, status string", "ts bigint, status string, arrived_at bigint"
    steps = [
        ([(0, "a"), (100, "b"), (130, "c")], [(0, "a", 20)]),
        ([(500, "beat")], [(130, "c", 150), (100, "b", 300), (500, "beat", 500)]),  # b comes after its time
        ([(900, "beat")], [(900, "beat", 900)]),
    ]
    seen = []
    for a, b in steps:
        spark.createDataFrame(a, left).write.mode("append").parquet(sent)
        spark.createDataFrame(b, right).write.mode("append").parquet(came)
        follow_markers(spark.readStream.schema(left).parquet(sent), spark.readStream.schema(right).parquet(came), dest, state).awaitTermination()
        rows = spark.read.parquet(dest).filter("status <> 'beat'").collect()
        seen.append(sorted((r["status"], r["arrived"], r["delay"], r["timed_out"]) for r in rows))
    assert seen[0] == [("a", True, 20, False)]
    assert seen[-1] == [("a", True, 20, False), ("b", False, None, True), ("c", True, 20, False)]
