import pytest
from pyspark.sql import functions as F

from karavel.operators import loads as L
from karavel.session import shared_folder
from karavel.sources import logs, sinks
from karavel.sources.snapshot import ForeignSchema, Location, plan_parts, read_jdbc_parts, read_part, read_snapshot
from karavel.operators.scope import Scope

FOLDER = "/root/testdata/sf0.001"
STATS = "tbl string, bytes bigint, min_key bigint, max_key bigint"


def test_parts_cover_every_key_once(spark):
    rows = [("big", 1000, -5, 94), ("one value", 10**6, 3, 3), ("small", 10, 0, 9), ("empty", 0, None, None), ("limit", 100, 0, 9)]
    parts = plan_parts(spark.createDataFrame(rows, STATS), 100, 7).collect()
    by = {}
    for p in parts:
        by.setdefault(p["tbl"], []).append((p["part"], p["lo"], p["hi"]))
    assert {t: len(v) for t, v in by.items()} == {"big": 7, "one value": 1, "small": 1, "empty": 1, "limit": 1}
    big = sorted(by["big"])
    assert big[0][1] == -5 and big[-1][2] == 94
    assert all(a[2] + 1 == b[1] for a, b in zip(big, big[1:]))


def test_full_load_resumes_where_it_stopped(spark):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    lo, hi, n = orders.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count("*")).first()
    plan = plan_parts(spark.createDataFrame([("orders", 500, lo, hi)], STATS), 100, 4)
    dest, progress = shared_folder(spark, "t"), shared_folder(spark, "t")
    keys, tables = {"orders": "o_orderkey"}, {"orders": orders}
    # the run is lost after the first two parts
    L.full_load(tables, dest, plan.filter("part <= 2"), keys, progress=progress)
    rest = L.resume_plan(plan, L.read_progress(spark, progress))
    assert sorted(r["part"] for r in rest.collect()) == [3, 4]
    done = L.full_load(tables, dest, rest, keys, progress=progress)
    assert done.count() == 4 and done.agg(F.sum("rows")).first()[0] == n and done.filter("bytes > 0").count() == 4
    assert L.loaded_table(spark, dest, "orders").exceptAll(orders).count() == 0
    assert L.resume_plan(plan, done).count() == 0
    with pytest.raises(L.SplitMismatch):
        L.resume_plan(plan.withColumn("parts", F.lit(9).cast("bigint")), done)


def test_a_column_may_be_called_part(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("part"))
    plan = plan_parts(spark.createDataFrame([("t", 500, 0, 99)], STATS), 100, 3)
    dest = shared_folder(spark, "t")
    L.full_load({"t": df}, dest, plan, {"t": "id"}, progress=shared_folder(spark, "t"))
    assert L.loaded_table(spark, dest, "t").exceptAll(df).count() == 0 and L.loaded_table(spark, dest, "t").count() == 100


def test_a_failed_part_leaves_the_others_done(spark):
    df = spark.range(100).withColumn("x", F.expr("if(id = 70, 1 / (id - 70), 0)"))
    plan = plan_parts(spark.createDataFrame([("t", 500, 0, 99)], STATS), 100, 4)
    dest, progress = shared_folder(spark, "t"), shared_folder(spark, "t")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        L.full_load({"t": df}, dest, plan, {"t": "id"}, progress=progress)
    left = L.resume_plan(plan, L.read_progress(spark, progress)).collect()
    assert [(r["lo"], r["hi"]) for r in left] == [(50, 74)]


def test_rows_without_a_key_are_loaded_once(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "k bigint")
    assert [read_part(df, "k", 0, 2, True).count(), read_part(df, "k", 3, 9).count()] == [2, 1]


def test_preparation_modes(spark):
    dest = shared_folder(spark, "t")
    sinks.write_snapshot(spark.range(5), dest)
    sinks.write_snapshot(spark.range(3), dest, "nothing")
    assert spark.read.parquet(dest).count() == 8
    other = spark.range(2).withColumn("x", F.lit(1))
    for prep in ("truncate", "nothing"):
        with pytest.raises(sinks.SchemaMismatch):
            sinks.write_snapshot(other, dest, prep)
    assert spark.read.parquet(dest).count() == 8
    sinks.write_snapshot(spark.range(2), dest, "truncate")
    assert spark.read.parquet(dest).count() == 2
    sinks.write_snapshot(other, dest, "drop_and_create")
    assert spark.read.parquet(dest).columns == ["id", "x"]
    with pytest.raises(ValueError):
        sinks.write_snapshot(other, dest, "typo")


def test_jdbc_read_in_parts_and_write(spark):
    url = "jdbc:derby:memory:karavel;create=true"  # lives in this process only
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    sinks.write_snapshot(orders, "orders", url=url)
    place = Location(url=url, schema="", tables=("orders",))
    got = read_jdbc_parts(spark, place, "orders", "o_orderkey", 0, 1499, 4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == orders.count()
    some = read_snapshot(spark, place)["orders"].filter("o_orderkey < 10")
    assert some.count() == orders.filter("o_orderkey < 10").count()
    assert "LessThan" in some._jdf.queryExecution().executedPlan().toString()
    sinks.write_snapshot(orders.limit(7), "orders", "truncate", url=url)
    assert place.read(spark, "orders").count() == 7
    sinks.write_snapshot(orders.limit(7), "orders", "nothing", url=url)
    assert place.read(spark, "orders").count() == 14


def test_switch_is_all_or_nothing(spark):
    schema = ForeignSchema(spark, "sw_")
    names = schema.import_schema(Location(path=FOLDER), Scope(include_only_table=["public.nation", "public.region"]))
    assert names == ["sw_nation", "sw_region"]
    half = shared_folder(spark, "t")
    spark.read.parquet(f"{FOLDER}/nation.parquet").limit(3).write.parquet(f"{half}/nation.parquet")
    with pytest.raises(ValueError, match="region"):
        schema.switch(Location(path=half))
    assert spark.table("sw_nation").count() == 25
    spark.range(2).write.parquet(f"{half}/region.parquet")
    with pytest.raises(ValueError, match="schema"):
        schema.switch(Location(path=half))
    assert spark.table("sw_nation").count() == 25


def test_ignore_conflicts(spark):
    target = spark.createDataFrame([(1, "old", 0)], "k bigint, v string, n bigint")
    rows = spark.createDataFrame([(1, "new", 1), (2, "b", 2), (2, "a", 1), (3, "c", 5)], "k bigint, v string, n bigint")
    out = L.load_ignore_conflicts(rows, target, ["k"], ["n"])
    assert sorted(map(tuple, out.collect())) == [(1, "old", 0), (2, "a", 1), (3, "c", 5)]


def test_marks(spark):
    seqs = spark.createDataFrame([("a", 5), ("b", None), ("c", 9)], "seq string, last_value bigint")
    tops = spark.createDataFrame([("a", 7), ("a", 3), ("c", 1)], "seq string, max_key bigint")
    assert {r["seq"]: r["new_last"] for r in L.reset_high_water(seqs, tops).collect()} == {"a": 7, "b": 0, "c": 9}


def test_log_lines(spark):
    folder = shared_folder(spark, "t")
    lines = [
        "2024-01-02 03:04:05.678 123 INFO   copy.c:12 STEP 4: starting",
        "2024-01-02 03:04:06 123 ERROR  it broke: badly",
        "no stamp here",
        "",
    ]
    spark.createDataFrame([(x,) for x in lines], "l string").coalesce(1).write.text(folder)
    got = logs.read_log(spark, folder).orderBy("line_no").collect()
    assert [r["line"] for r in got] == lines
    assert [str(r["ts"]) for r in got[:2]] == ["2024-01-02 03:04:05", "2024-01-02 03:04:06"]
    assert [r["level"] for r in got] == ["INFO", "ERROR", None, None] and got[2]["ts"] is None
    assert got[1]["message"] == "it broke: badly" and got[2]["message"] == "no stamp here"


def test_no_bounds_give_one_part_and_open_ends_take_the_rest(spark):
    plan = plan_parts(spark.createDataFrame([("none", 1000, None, None), ("half", 1000, None, 9)], STATS), 100, 4).collect()
    assert [(p["part"], p["parts"]) for p in plan] == [(1, 1), (1, 1)]
    df = spark.createDataFrame([(k,) for k in (None, -50, 0, 3, 7, 99)], "k bigint")
    cuts = [read_part(df, "k", lo, hi, first=lo == 0, last=hi == 9) for lo, hi in ((0, 3), (4, 9))]
    assert [sorted((r["k"] for r in c.collect()), key=str) for c in cuts] == [sorted([None, -50, 0, 3], key=str), [7, 99]]


def test_growth_between_runs(spark):
    keys, dest, progress = {"t": "id"}, shared_folder(spark, "t"), shared_folder(spark, "p")
    plan = lambda top: plan_parts(spark.createDataFrame([("t", 500, 0, top)], STATS), 100, 4)
    L.full_load({"t": spark.range(100)}, dest, plan(99).filter("part <> 2"), keys, progress=progress)
    L._log_progress(spark, progress, ("t", 2, 4, 25, 49, None, None, None, None))  # planned, not done
    rest = L.resume_plan(plan(199), L.read_progress(spark, progress))
    assert sorted((r["part"], r["lo"], r["hi"]) for r in rest.collect()) == [(2, 25, 49), (4, 75, 99)]
    L.full_load({"t": spark.range(200)}, dest, rest, keys, progress=progress)
    assert sorted(r["id"] for r in L.loaded_table(spark, dest, "t").collect()) == list(range(200))
    assert L.resume_plan(plan(99), L.read_progress(spark, progress)).count() == 0


def test_file_parts_hold_each_file_once(spark):
    from karavel.sources import snapshot

    place = shared_folder(spark, "t")
    for n in (1000, 10, 3000, 20, 500):
        spark.range(n).selectExpr("id", "uuid() as x").coalesce(1).write.mode("append").parquet(place)
    names = {r["f"] for r in spark.read.parquet(place).selectExpr("_metadata.file_path as f").distinct().collect()}
    parts = snapshot.plan_file_parts(spark, {"t": place}, 1, 3).collect()
    held = [f for p in parts for f in p["files"]]
    assert len(parts) == 3 and len(held) == len(set(held)) == 5 and set(held) == names
    assert [p["files"] for p in parts] == [p["files"] for p in snapshot.plan_file_parts(spark, {"t": place}, 1, 3).collect()]
    assert len(snapshot.plan_file_parts(spark, {"t": place}).collect()) == 1  # below the threshold
    assert len(snapshot.plan_file_parts(spark, {"t": place}, 1, 99).collect()) == 5  # at most one part a file
