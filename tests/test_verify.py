import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from karavel.operators import verify as V

FOLDER = "/root/testdata/sf0.001"


def diff(spark, src, tgt, schema, key, **how):
    out = V.row_diff(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema), key, **how)
    return sorted((*[r[k] for k in key], r["state"], r["columns"]) for r in out.collect())


def test_row_diff_states(spark):
    src = [(i, f"n{i}", i * 1.5) for i in range(100)]
    tgt = [(i, "changed" if i == 7 else f"n{i}", None if i in (7, 9) else i * 1.5) for i in range(1, 101)]
    schema = "id bigint, name string, x double"
    want = [(0, "MISSING_TARGET", ""), (7, "DIFFERENT", "name,x"), (9, "DIFFERENT", "x"), (100, "MISSING_SOURCE", "")]
    assert diff(spark, src, tgt, schema, ["id"], partition_size=10) == want
    assert diff(spark, src, tgt, schema, ["id"], skip_cols=["x"]) == [
        (0, "MISSING_TARGET", ""), (7, "DIFFERENT", "name"), (100, "MISSING_SOURCE", "")
    ]
    assert diff(spark, src, src, schema, ["id"]) == [] and diff(spark, [], [], schema, ["id"]) == []


def test_row_diff_text_key_and_null_moves(spark):
    # a NULL that changes its column must not look equal
    src = [("a", None, "x"), ("b", "1", "2"), ("é", "1", None)]
    tgt = [("a", "x", None), ("b", "1", "2"), ("é", "1", "")]
    got = diff(spark, src, tgt, "k string, p string, q string", ["k"])
    assert got == [("a", "DIFFERENT", "p,q"), ("é", "DIFFERENT", "q")]


def test_row_diff_with_copies_of_a_key(spark):
    # 400 equal copies of one key: compared by count, never pair by pair
    src = [(1, "a")] * 400 + [(2, "b"), (None, "n")]
    tgt = [(1, "a")] * 399 + [(2, "b"), (2, "b"), (None, "n")]
    got = V.row_diff(spark.createDataFrame(src, "k bigint, v string"), spark.createDataFrame(tgt, "k bigint, v string"), ["k"], counts=True)
    assert sorted((r["k"], r["state"], r["src_rows"], r["tgt_rows"]) for r in got.collect()) == [(1, "DIFFERENT", 400, 399), (2, "DIFFERENT", 1, 2)]


def test_row_diff_other_types_in_target(spark):
    src = spark.createDataFrame([(1, 2.5)], "k bigint, v double")
    tgt = spark.createDataFrame([(1, "2.50")], "k int, v string")
    assert V.row_diff(src, tgt, ["k"]).count() == 0


def test_keyless_diff(spark):
    schema = "a bigint, b string"
    src = spark.createDataFrame([(1, None)] * 3 + [(2, "x")], schema)
    tgt = spark.createDataFrame([(1, None)] * 2 + [(3, "y")], schema)
    got = {(r["a"], r["b"]): (r["src_copies"], r["tgt_copies"]) for r in V.row_diff_keyless(src, tgt).collect()}
    assert got == {(1, None): (3, 2), (2, "x"): (1, 0), (3, "y"): (0, 1)}


def test_exact_counts_never_turn_an_error_into_zero(spark):
    def missing():
        return spark.read.parquet(f"{FOLDER}/not_there.parquet")

    ok, slow = spark.range(10), spark.range(10)
    tables = {"same": ok, "fewer": ok, "more": spark.range(4), "broken": ok, "late": slow, "empty": ok}
    nap = F.udf(lambda x: time.sleep(60) or x, "bigint")
    target = {
        "same": ok, "fewer": spark.range(7), "more": ok, "broken": missing, "empty": ok,
        "late": spark.range(0, 4, 1, 4).filter(nap("id") >= 0),
    }
    stats = spark.createDataFrame([(n, 0 if n == "empty" else 500) for n in tables], "tbl string, bytes bigint")
    out = V.exact_counts(spark, tables, target, stats, n=10, max_bytes=1000, timeout=6, threads=4)
    got = {r["tbl"]: (r["state"], r["diff"], r["diff_pct"], r["verdict"]) for r in out.collect()}
    assert got == {
        "same": ("MATCH", None, None, "PASS"),
        "fewer": ("MISSING", 3, 30, "FAIL"),
        "more": ("MISSING", -6, -150, "FAIL"),
        "broken": ("ERROR", None, None, "ERROR"),
        "late": ("TIMEOUT", None, None, "WARN"),
    }


def test_sample_is_repeatable_and_within_the_size_limit(spark):
    stats = spark.createDataFrame([(f"t{i}", i * 10) for i in range(50)], "tbl string, bytes bigint")
    pick = lambda seed: [r["tbl"] for r in V.sample_tables(stats, 5, 300, seed).collect()]
    assert pick("a") == pick("a") != pick("b") and "t0" not in pick("a")
    assert all(int(t[1:]) <= 30 for t in pick("a"))


def test_sampled_count_is_close(spark):
    est = V.sampled_count(spark.range(200_000), 5.0, seed=1).first()["est_rows"]
    assert abs(est - 200_000) < 10_000


def test_minmax_failures_and_skips(spark):
    def missing():
        return spark.read.parquet(f"{FOLDER}/not_there.parquet")

    rows = [("a", "id", "int8", 50), ("b", "id", "uuid", 40), ("c", "id", "int4", 30), ("d", "id", "int8", 20), ("e", "id", "int8", 10)]
    keys = spark.createDataFrame(rows, "tbl string, column_name string, type string, est_rows bigint")
    nothing = spark.createDataFrame([], "id bigint")
    src = {"a": spark.range(5), "b": spark.range(5), "c": spark.range(5), "d": nothing, "e": spark.range(1)}
    tgt = {"a": spark.range(6), "b": spark.range(5), "c": missing, "d": nothing, "e": spark.range(1)}
    out = V.minmax_check(spark, src, tgt, keys, n=4)
    assert {r["tbl"]: r["verdict"] for r in out.collect()} == {"a": "FAIL", "b": "SKIPPED", "c": "ERROR", "d": "PASS"}


def test_estimates(spark):
    s = spark.createDataFrame([("a", 100), ("b", 100), ("c", 0), ("d", -1), ("e", 10), ("f", 3)], "tbl string, est_rows bigint")
    t = spark.createDataFrame([("a", 94), ("b", 95), ("c", 1), ("d", 0), ("g", 10), ("f", -1)], "tbl string, est_rows bigint")
    got = {r["tbl"]: r["diff_pct"] for r in V.estimate_diff(s, t).collect()}
    assert got == {"a": 6, "c": None, "f": 100}


def test_high_water_null_is_zero(spark):
    s = spark.createDataFrame([("a", None), ("b", 5), ("c", 5), ("d", 5)], "seq string, last_value bigint")
    t = spark.createDataFrame([("a", 3), ("b", None), ("c", 5), ("d", 9)], "seq string, last_value bigint")
    assert [(r["seq"], r["behind"]) for r in V.high_water_lag(s, t).collect()] == [("b", 5)]


@pytest.mark.parametrize(
    "statuses, full, gate",
    [([], 0, 0), (["PASS"], 0, 0), (["PASS", "WARN"], 1, 0), (["WARN", "FAIL"], 2, 1), (["FAIL", "ERROR"], 3, 3), (["ERROR"], 3, 3)],
)
def test_verdict(spark, statuses, full, gate):
    checks = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert V.verdict(checks).first()["exit_code"] == full
    assert V.verdict(checks, gate=True).first()["exit_code"] == gate


def test_as_checks(spark):
    rows = spark.createDataFrame([("WARN",), ("PASS",)], "verdict string")
    assert V.as_checks("x", rows).first()["status"] == "WARN"
    assert V.as_checks("x", rows.filter("verdict = 'FAIL'")).first()["status"] == "PASS"


def test_columns_from_schemas(spark):
    a = {"s.t": spark.createDataFrame([], "id bigint, name string, gone int")}
    b = {"s.t": spark.createDataFrame([], "id bigint, name binary, new int")}
    out = V.definition_diff(V.column_definitions(spark, a), V.column_definitions(spark, b))
    got = {r["name"]: (r["state"], r["verdict"]) for r in out.collect()}
    assert got == {"name": ("changed", "FAIL"), "gone": ("missing", "FAIL"), "new": ("extra", "WARN")}


def test_definitions_that_are_null(spark):
    schema = "kind string, object string, name string, definition string"
    s = spark.createDataFrame([("index", "t", "a", None), ("index", "t", "b", None)], schema)
    t = spark.createDataFrame([("index", "t", "a", None), ("index", "t", "b", "d")], schema)
    assert [(r["name"], r["state"]) for r in V.definition_diff(s, t).collect()] == [("b", "changed")]


def test_settings_absent_and_empty_are_not_available(spark):
    wanted = spark.createDataFrame([(n, "no", "c") for n in "abcd"], "name string, restart string, category string")
    schema = "name string, setting string, unit string"
    src = spark.createDataFrame([("a", "1", "kB"), ("b", "1", None), ("d", "", None)], schema)
    tgt = spark.createDataFrame([("a", "1", "kB"), ("b", "1", "kB")], schema)
    got = {r["name"]: (r["src_value"], r["tgt_value"], r["status"]) for r in V.settings_diff(wanted, src, tgt).collect()}
    assert got == {
        "a": ("1 kB", "1 kB", "SAME"), "b": ("1", "1 kB", "DIFF"), "c": ("N/A", "N/A", "SAME"), "d": ("N/A", "N/A", "SAME")
    }


def test_key_check(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 1)], "a bigint, b bigint")
    r = V.key_check(df, ["a", "b"]).first()
    assert (r["keys"], r["duplicated"], r["null_rows"], r["usable"]) == (2, 1, 1, False)
    assert V.key_check(df.filter("b = 1 and a = 1"), ["a", "b"]).first()["usable"]


def test_validation_limits_keep_all_rows(spark):
    rows = [("a", "DIFFERENT")] * 5 + [("b", "MISSING_TARGET")] * 2
    out = V.validation_status(spark.createDataFrame(rows, "tbl string, state string"), table_max=5, overall_max=7).collect()
    assert Counter((r["tbl"], r["failures"], r["suspended"], r["task_stopped"]) for r in out) == Counter([("a", 5, True, True), ("b", 2, False, True)])


def test_availability_outcomes(spark):
    n = lambda *names: spark.createDataFrame([(x,) for x in names], "name string")
    assert V.availability(n("a", "b"), n("b"), n("a")).first()["outcome"] == "all there"
    assert V.availability(n("a", "b"), n(), n("a")).first()["missing"] == 1
    assert V.availability(n("b"), n("b"), n()).first()["outcome"] == "nothing to check"


def test_a_check_that_cannot_run_gives_code_three(spark):
    good = V.run_check(spark, "a", lambda: spark.createDataFrame([("PASS",)], "verdict string"))
    bad = V.run_check(spark, "b", lambda: spark.read.parquet(f"{FOLDER}/not_there.parquet"))
    assert V.verdict(good.unionByName(bad)).first()["exit_code"] == 3 and V.verdict(good).first()["exit_code"] == 0


def test_types_are_compared_in_one_that_holds_both(spark):
    src = spark.sql("select 1 as k, cast(1.23 as decimal(18,2)) as d, date '2020-01-01' as t, 5 as n, 'A ' as s")
    tgt = spark.sql("select 1L as k, cast(1.2345 as decimal(18,4)) as d, timestamp_ntz '2020-01-01 00:00:01' as t, 5L as n, 'a' as s")
    assert V.row_diff(src, tgt, ["k"]).first()["columns"] == "d,t,s"
    assert V.row_diff(src, tgt, ["k"], collation="ignore_case_and_trailing_blanks").first()["columns"] == "d,t"
    assert V.row_diff_keyless(src, tgt).count() == 2
    text = src.select("k", F.lit("1.2345").alias("d"), F.lit("2020-01-01").alias("t"), F.lit("5.0").alias("n"), "s")
    assert V.row_diff(src, text, ["k"]).first()["columns"] == "d"
    assert V.row_diff(src, src.withColumn("n", F.lit(5).cast("bigint")), ["k"]).count() == 0
    assert {r["column_name"]: r["comparable"] for r in V.type_diff(src, tgt).collect()} == {"k": True, "d": True, "t": True, "n": True}
    assert not V.type_diff(src, src.withColumn("n", F.lit("5"))).first()["comparable"]


def test_rows_of_a_repeated_key_are_counted(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "k bigint, v string")
    out = V.row_diff(df((1, "a"), (1, "b"), (2, "x"), (2, "x"), (3, "z")), df((2, "x"), (3, "z"), (4, "q")), ["k"], counts=True)
    assert sorted((r["k"], r["state"], r["src_rows"], r["tgt_rows"]) for r in out.collect()) == [
        (1, "MISSING_TARGET", 2, 0), (2, "DIFFERENT", 2, 1), (4, "MISSING_SOURCE", 0, 1)]


def test_rows_are_pending_until_the_delay_is_over(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "k bigint, v string")
    src = df((1, "a"), (2, "b"), (3, "c"))
    state = lambda p: {r["k"]: (r["state"], r["first_at"], r["last_at"]) for r in p.collect()}
    pending = V.pending_rows(V.row_diff(src, df((1, "a"), (3, "x")), ["k"]), ["k"], 10)
    assert state(pending) == {2: ("MISSING_TARGET", 10, 10), 3: ("DIFFERENT", 10, 10)}
    assert V.outlasted(pending, 0).count() == 0
    # key 2 has come, key 1 was changed in the source meanwhile, key 3 is still wrong
    pending = V.recheck_rows(df((1, "new"), (2, "b"), (3, "c")), df((1, "a"), (2, "b"), (3, "x")), ["k"], pending, 20, touched=df((1, "")))
    assert state(pending) == {1: ("DIFFERENT", 20, 20), 3: ("DIFFERENT", 10, 20)}
    assert [r["k"] for r in V.outlasted(pending, 5).collect()] == [3] and V.outlasted(pending, 10).count() == 0
    caught_up = df((1, "new"), (2, "b"), (3, "c"))
    assert V.recheck_rows(caught_up, caught_up, ["k"], pending, 30).count() == 0
