"""Ordered scans against plain Python, with one key that holds a third and more of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from karavel.functions import ordered


def rows(n=3000, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = None if rnd.random() < 0.05 else ("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}")
        value = None if rnd.random() < 0.4 else rnd.randrange(100)
        out.append((key, i * 3 + rnd.randrange(3), value))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "k string, pos bigint, v bigint").repartition(7)


def by_key():
    groups = {}
    for k, p, v in sorted(rows(), key=lambda r: r[1]):
        groups.setdefault(k, []).append((p, v))
    return groups


# no hot key, one hot key, and so low a limit that nearly every key is cut
SIZES = [10_000, 700, 11]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("following", [False, True])
def test_prior(data, size, following):
    out = ordered.prior(data, ["k"], ["pos"], {"pp": F.col("pos"), "pv": F.col("v")}, following=following, rows_per_range=size)
    got = {(r["k"], r["pos"]): (r["pp"], r["pv"]) for r in out.collect()}
    want = {}
    for k, items in by_key().items():
        for i, (p, _) in enumerate(items):
            j = i + 1 if following else i - 1
            want[k, p] = items[j] if 0 <= j < len(items) else (None, None)
    assert got == want


@pytest.mark.parametrize("size", SIZES)
def test_last_known(data, size):
    out = ordered.last_known(data, ["k"], ["pos"], "before", F.col("v"), rows_per_range=size)
    got = {(r["k"], r["pos"]): r["before"] for r in out.collect()}
    want = {}
    for k, items in by_key().items():
        last = None
        for p, v in items:
            want[k, p] = last
            last = v if v is not None else last
    assert got == want


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("size", SIZES)
def test_running_sum(data, size, limit, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    out = ordered.running_sum(data, ["k"], ["pos"], "total", F.col("v"), rows_per_range=size)
    got = {(r["k"], r["pos"]): r["total"] for r in out.collect()}
    want = {}
    for k, items in by_key().items():
        total = None
        for p, v in items:
            total = total if v is None else (total or 0) + v
            want[k, p] = total
    assert got == want


def test_only_hot_keys_are_cut_and_no_group_is_larger_than_its_range(data):
    ranged, pairs = ordered._add_range(data, ["k"], ["pos"], 100)
    sizes = ranged.groupBy("k", "__range").count()
    assert sizes.agg(F.max("count")).first()[0] <= 150
    assert sizes.count() - sizes.groupBy("k").count().filter("count = 1").count() <= pairs
    cut = sizes.groupBy("k").count().filter("count > 1").collect()
    hot = {k for k, items in by_key().items() if len(items) > 100}
    assert {r["k"] for r in cut} == hot and "hot" in hot and None in hot
    assert ordered._add_range(data, ["k"], ["pos"], 5000) is None


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "decimal(20,0)"])
def test_order_column_types(spark, kind):
    base = spark.range(400).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    if kind.startswith("decimal"):
        o = (F.col("n").cast(kind) + F.lit("18446744073709500000").cast(kind)).cast(kind)
    else:
        o = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n").cast("int")).cast(kind)
    out = ordered.prior(base.withColumn("o", o), ["k"], ["o"], {"p": F.col("n")}, rows_per_range=20)
    assert all(r["p"] == (r["n"] - 2 if r["n"] > 1 else None) for r in out.collect())


def test_ties_of_the_first_order_column_stay_together(spark):
    data = spark.range(1000).select(F.lit(1).alias("k"), F.floor(F.col("id") / 50).alias("a"), F.col("id").alias("b"))
    out = ordered.prior(data, ["k"], ["a", "b"], {"p": F.col("b")}, rows_per_range=60)
    assert all(r["p"] == (r["b"] - 1 if r["b"] else None) for r in out.collect())


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k bigint, pos bigint, v bigint")
    assert ordered.running_sum(empty, ["k"], ["pos"], "s", F.col("v"), rows_per_range=1).count() == 0
