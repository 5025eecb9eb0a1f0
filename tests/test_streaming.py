import pytest
from pyspark.sql import functions as F

from karavel.operators.activity import alert_events, alert_state
from karavel.operators.changes import ErrorPolicy, apply_changes
from karavel.session import shared_folder
from karavel.streaming.alerts import AlertLog, follow_alerts
from karavel.streaming.follow import FollowedTable, follow, follow_until, route_stream, routed, stream_name
from tests.test_changes import SCHEMA, random_log

BASE = [(k, f"b{k}") for k in range(0, 40, 3)]


@pytest.fixture
def log_folder(spark):
    """A log in four files, given to the stream in any order."""
    folder = shared_folder(spark, "log")
    rows = spark.createDataFrame(random_log(800, 30, 11), SCHEMA)
    rows.repartitionByRange(4, "pos").write.parquet(folder)
    return folder


def table(spark, snapshot_pos=0):
    t = FollowedTable(spark, shared_folder(spark, "table"), ["k"])
    t.start(spark.createDataFrame(BASE, "k bigint, v string"), snapshot_pos)
    return t


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


def expected(spark, folder, where="true"):
    base = spark.createDataFrame(BASE, "k bigint, v string")
    return content(apply_changes(base, spark.read.schema(SCHEMA).parquet(folder).filter(where), ["k"]))


def test_stream_equals_batch_and_replay_changes_nothing(spark, log_folder):
    t = table(spark)
    follow(stream(spark, log_folder), t, shared_folder(spark, "cp")).awaitTermination()
    want = expected(spark, log_folder)
    assert content(t.read()) == want and t.commits().count() == 4 and t.replay_pos() == 800
    # the same files through a new checkpoint: batch numbers start again, the result stays
    follow(stream(spark, log_folder), t, shared_folder(spark, "cp")).awaitTermination()
    assert content(t.read()) == want
    t.compact()
    assert content(t.read()) == want and t.replay_pos() == 800
    t.compact(t.replay_pos())  # everything up to there has come
    t.prune(keep=1)
    assert content(t.read()) == want and t.commits().count() == 0
    # after the compaction everything in the log is in the base
    follow(stream(spark, log_folder), t, shared_folder(spark, "cp")).awaitTermination()
    assert content(t.read()) == want


def test_repeated_batch_is_left_alone(spark):
    t = table(spark)
    first = spark.createDataFrame([(1, "U", 0, "new")], SCHEMA)
    assert t.apply_batch(first, "batch=a-0")
    assert not t.apply_batch(spark.createDataFrame([(2, "D", 0, None)], SCHEMA), "batch=a-0")
    assert content(t.read())[0] == "new"


def test_batch_without_commit_is_not_seen(spark):
    t = table(spark)
    t.apply_batch(spark.createDataFrame([(5, "U", 0, "new")], SCHEMA), "batch=a-0")
    # changes written, commit lost
    spark.createDataFrame([(9, "D", 0, None)], SCHEMA).write.parquet(f"{t.path}/changes/batch=a-1")
    assert content(t.read())[0] == "new" and t.replay_pos() == 5
    # the retry writes the same batch again, whole
    assert t.apply_batch(spark.createDataFrame([(9, "D", 0, None)], SCHEMA), "batch=a-1")
    assert 0 not in content(t.read())


def test_late_batch_does_not_win(spark):
    t = table(spark)
    t.apply_batch(spark.createDataFrame([(9, "U", 0, "late position")], SCHEMA), "batch=a-0")
    t.apply_batch(spark.createDataFrame([(4, "D", 0, None), (4, "I", 3, "x")], SCHEMA), "batch=a-1")
    assert content(t.read())[0] == "late position" and content(t.read())[3] == "x"


def test_hand_over_and_end_position(spark, log_folder):
    t = table(spark, snapshot_pos=300)
    query = follow(stream(spark, log_folder), t, shared_folder(spark, "cp"), endpos=500)
    query.awaitTermination()
    assert content(t.read()) == expected(spark, log_folder, "pos > 300 and pos <= 500")
    assert 300 < t.replay_pos() <= 500


@pytest.mark.parametrize("endpos", [500, 555, 800])
def test_endless_stream_stops_at_a_position(spark, endpos):
    """Even positions only, so 555 is that of no change; the newest file is read first."""
    folder = shared_folder(spark, "log")
    log = [(2 * p, op, k, v) for p, op, k, v in random_log(400, 30, 12)]
    rows = spark.createDataFrame(log, SCHEMA)
    for lo in (600, 400, 200, 0):
        rows.filter((F.col("pos") > lo) & (F.col("pos") <= lo + 200)).coalesce(1).write.mode("append").parquet(folder)
    t = table(spark)
    follow_until(stream(spark, folder), t, shared_folder(spark, "cp"), endpos, interval="0 seconds", poll_seconds=0.2)
    assert content(t.read()) == expected(spark, folder, f"pos <= {endpos}")
    assert t.seen_pos() == 800 and t.replay_pos() == endpos - endpos % 2
    # going on after the end position, with a fresh checkpoint
    follow(stream(spark, folder), t, shared_folder(spark, "cp")).awaitTermination()
    assert content(t.read()) == expected(spark, folder) and t.replay_pos() == 800


def test_a_failing_stream_is_not_taken_for_done(spark):
    folder = shared_folder(spark, "log")
    spark.createDataFrame([(1, "I", 1, "x")], SCHEMA).write.parquet(folder)
    broken = stream(spark, folder).withColumn("pos", F.expr("pos / 0").cast("bigint"))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        follow_until(broken, table(spark), shared_folder(spark, "cp"), 5, interval="0 seconds", poll_seconds=0.2)


def test_a_table_needs_a_base(spark):
    with pytest.raises(ValueError):
        FollowedTable(spark, shared_folder(spark, "none"), ["k"]).read()


def test_route_stream(spark):
    folder, out = shared_folder(spark, "r"), shared_folder(spark, "r")
    rows = spark.range(300).select(F.concat(F.lit("t"), F.col("id") % 5).alias("tbl"), "id")
    rows.repartition(3).write.parquet(folder)
    published = spark.createDataFrame([("t1",), ("t3",), ("t9",)], "tbl string")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    route_stream(source, published, out, shared_folder(spark, "cp")).awaitTermination()
    got = routed(spark, out)
    assert got.count() == 120 and sorted(r["tbl"] for r in got.select("tbl").distinct().collect()) == ["t1", "t3"]


# -------------------------------------------------------------------------------------------- alerts

POLLS = "run string, poll bigint, status string, errors bigint, copy_done boolean"


def simulate(polls):
    """One poll at a time, every delivery succeeds."""
    state, out = {}, []
    for run, poll, status, errors, copy_done in sorted(polls, key=lambda p: p[1]):
        s = state.setdefault(run, {"status": "unknown", "errors": 0, "copy": False, "final": False})
        if copy_done and not s["copy"]:
            out.append((run, poll, "initial copy done", None))
            s["copy"] = True
        elif status in ("succeeded", "failed") and not s["final"]:
            out.append((run, poll, status, None))
            s["final"] = True
        elif status == "stopped" and s["status"] == "running":
            out.append((run, poll, "stopped", None))
        if errors > s["errors"]:
            out.append((run, poll, "new errors", errors - s["errors"]))
        s["status"], s["errors"] = status, errors
    return sorted(out, key=str)


def random_polls(n=600, seed=4):
    import random

    rnd, errors, out = random.Random(seed), {}, []
    for i in range(n):
        run = "hot" if rnd.random() < 0.5 else f"r{rnd.randrange(12)}"
        # a log that is truncated may even show fewer errors
        errors[run] = max(0, errors.get(run, 0) + rnd.choice([0, 0, 1, 3, -1]))
        out.append((run, i, rnd.choice(["running", "running", "stopped", "succeeded", "failed"]), errors[run], rnd.random() < 0.1))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("run", "poll", "alert", "new_errors").collect()), key=str)


@pytest.mark.parametrize("size", [1_000_000, 25])
def test_alerts_equal_one_by_one(spark, size):
    polls = spark.createDataFrame(random_polls(), POLLS).repartition(5)
    assert rows_of(alert_events(polls, rows_per_range=size)) == simulate(random_polls())


def test_alert_stream_equals_batch(spark):
    folder, out, cp = (shared_folder(spark, "alerts") for _ in range(3))
    polls = spark.createDataFrame(random_polls(), POLLS)
    log = AlertLog(spark, out)
    for lo, hi in ((0, 200), (200, 201), (201, 600)):
        polls.filter((F.col("poll") >= lo) & (F.col("poll") < hi)).write.mode("append").parquet(folder)
        follow_alerts(spark.readStream.schema(polls.schema).parquet(folder), log, cp).awaitTermination()
    assert rows_of(log.alerts()) == simulate(random_polls())
    log.apply_batch(polls, 1, stream_name(cp))  # a batch done before
    assert rows_of(log.alerts()) == simulate(random_polls())


def test_failed_delivery_is_raised_again(spark):
    polls = [("a", 1, "running", 0, True), ("a", 2, "succeeded", 0, True), ("a", 3, "succeeded", 0, True)]
    df = lambda *rows: spark.createDataFrame(list(rows), POLLS)
    none = spark.createDataFrame([], "run string, alert string")
    first = alert_events(df(polls[0]))
    assert rows_of(first) == [("a", 1, "initial copy done", None)]
    state = alert_state(df(polls[0]), none)  # could not be sent
    second = alert_events(df(polls[1]), state)
    assert rows_of(second) == [("a", 2, "initial copy done", None)]
    state = alert_state(df(polls[1]), second.select("run", "alert"), state)
    assert rows_of(alert_events(df(polls[2]), state)) == [("a", 3, "succeeded", None)]


def test_second_alert_checkpoint_goes_on_with_the_state(spark):
    polls, out = spark.createDataFrame(random_polls(), POLLS), shared_folder(spark, "alerts")
    log = AlertLog(spark, out)
    for lo, hi in ((0, 150), (150, 400), (400, 600)):
        folder = shared_folder(spark, "polls")
        polls.filter((F.col("poll") >= lo) & (F.col("poll") < hi)).write.parquet(folder)
        follow_alerts(spark.readStream.schema(polls.schema).parquet(folder), log, shared_folder(spark, "cp")).awaitTermination()
    assert rows_of(log.alerts()) == simulate(random_polls())
    assert len(log._batches("state")) == 2 and len(log._batches("done")) == 3


def test_file_that_comes_after_a_compaction(spark, log_folder):
    t, log = table(spark), spark.read.schema(SCHEMA).parquet(log_folder)
    want = expected(spark, log_folder)
    for name, part in (("new", "pos > 400"), ("old", "pos <= 400")):
        t.apply_batch(log.filter(part), name)
        t.compact()
    assert content(t.read()) == want
    t.compact(t.replay_pos())
    t.apply_batch(log.filter("pos <= 400"), "again")
    assert content(t.read()) == want


def test_policy_holds_back_a_table_in_later_batches(spark):
    t = table(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "pos bigint, op string, k bigint, v string, tbl string, bad boolean")
    how = {"policy": ErrorPolicy(), "table_error": F.col("bad")}
    t.apply_batch(rows((1, "I", 100, "a", "x", False), (2, "I", 100, "b", "x", False), (3, "U", 0, "c", "x", True), (4, "U", 3, "d", "x", False)), "1", **how)
    t.apply_batch(rows((5, "U", 6, "e", "x", False), (6, "U", 9, "f", "y", False), (7, "D", 777, "", "y", False)), "2", **how)
    got = content(t.read())
    assert got[100] == "a" and got[0] == "b0" and got[3] == "b3" and got[6] == "b6" and got[9] == "f"
    assert sorted((r["pos"], r["reason"]) for r in t.exceptions().collect()) == [(2, "INSERT_CONFLICT"), (3, "TABLE_ERROR")]


def test_batches_that_are_held_back_whole(spark):
    """Every table is suspended by the first batch; the later ones apply nothing and are passed."""
    t = table(spark)
    folder, state = shared_folder(spark, "log"), shared_folder(spark, "cp")
    schema = "pos bigint, op string, k bigint, v string, tbl string, bad boolean"
    batches = [[(1, "U", 0, "a", "x", False), (2, "U", 3, "b", "x", True), (3, "U", 6, "c", "y", True)]]
    batches += [[(4 + i, "U", 9, "late", "x", False), (5 + i, "D", 0, None, "y", False)] for i in (0, 2)]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        follow(source, t, state, policy=ErrorPolicy(), table_error=F.col("bad")).awaitTermination()
    got = content(t.read())
    assert got[0] == "a" and got[3] == "b3" and got[6] == "b6" and got[9] == "b9"
    assert t.seen_pos() == 7 and t.replay_pos() == 1 and t.commits().count() == 3
    assert sorted(r["pos"] for r in t.exceptions().collect()) == [2, 3]


def test_a_keyed_table_needs_a_key(spark):
    with pytest.raises(ValueError):
        FollowedTable(spark, shared_folder(spark, "none"), [])


def test_a_suspended_table_goes_on_after_a_reload(spark):
    t = table(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "pos bigint, op string, k bigint, v string, tbl string, bad boolean")
    how = {"policy": ErrorPolicy(bad_data_limit=2), "bad_data": F.col("bad")}
    t.apply_batch(rows((1, "U", 0, "a", "x", False), (2, "U", 0, "no", "x", True)), "1", **how)
    t.apply_batch(rows((3, "U", 0, "no", "x", True), (4, "U", 0, "held", "x", False)), "2", **how)
    t.apply_batch(rows((5, "U", 3, "held", "x", False)), "3", **how)
    assert content(t.read())[0] == "a" and [r["pos"] for r in t.exceptions().filter("action = 'suspend'").collect()] == [3]
    with pytest.raises(ValueError):
        t.reload(spark.createDataFrame([(0, "held")], "k bigint, v string"), 4)
    t.reload(spark.createDataFrame([(0, "held"), (3, "held")], "k bigint, v string"), 5)
    t.apply_batch(rows((6, "U", 0, "again", "x", False), (7, "U", 3, "no", "x", True)), "4", **how)
    assert content(t.read()) == {0: "again", 3: "held"} and t.exceptions().filter("action = 'suspend'").count() == 1
