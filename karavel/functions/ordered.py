"""Ordered scans per key that survive a key holding a large share of all rows.

A plain window puts all rows of one key into one task. Here the rows of hot keys, and only these, are
cut into ranges of the order column (cut points from quantiles, so ranges hold about the same number of
rows). The window runs per (key, range), each range of a hot key leaves one summary row, and the
summaries, at most ``MAX_RANGES`` per key, carry the state from range to range. Keys that are not hot
stay in one range. The result is exact for every input; the cuts only decide how the work is spread.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

ROWS_PER_RANGE = 1_000_000  # a key with more rows is hot, unless that is less than its share below
MAX_HOT_KEYS = 10_000  # a hot key has more than one in so many of all rows, so there are at most that many
MAX_RANGES = 1024
BROADCAST_ROWS = 100_000  # summaries are sent to every task up to this number, else joined by shuffle

_RANGE, _HOT = "__range", "__hot"


def _order_number(df: DataFrame, col: str) -> Column:
    """The order column as a double. Rounding keeps the order and ties share a range, which is all we need."""
    c = F.col(col)
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(right[f"__k{i}"])
    return cond


def _add_range(df: DataFrame, keys: list[str], order: list[str], rows_per_range: int) -> tuple[DataFrame, int] | None:
    """Add the range number and the hot flag, or return None when no key is hot. The second value is
    the highest number of (hot key, range) pairs that there can be.

    One pass counts rows per key. Only if there are hot keys, a second one fetches them (few by
    definition) and a third finds the quantiles of their rows. Keys and cut points become constants of
    the plan, so every branch and every retried task sees the same ranges.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    total, largest = per_key.agg(F.sum("__rows"), F.max("__rows")).first()
    limit = max(rows_per_range, (total or 0) // MAX_HOT_KEYS)
    if not total or largest <= limit:
        return None
    found = per_key.filter(F.col("__rows") > limit)
    hot_keys = found.collect()
    hot_rows = sum(r["__rows"] for r in hot_keys)
    hot = df.sparkSession.createDataFrame([tuple(r)[:-1] for r in hot_keys], found.drop("__rows").schema)
    hot = hot.toDF(*[f"__k{i}" for i in range(len(keys))]).withColumn(_HOT, F.lit(True))
    marked = df.join(hot, _same(df, hot, keys), "left").drop(*[f"__k{i}" for i in range(len(keys))])
    marked = marked.withColumn(_HOT, F.coalesce(_HOT, F.lit(False)))

    number = _order_number(df, order[0])
    wanted = min(MAX_RANGES, -(-hot_rows // limit))
    steps = [i / wanted for i in range(1, wanted)]
    points = marked.filter(_HOT).select(number.alias("x")).agg(F.percentile_approx("x", steps, 20_000)).first()[0]
    cuts = sorted(set(points) - {float("-inf")})
    splits = [float("-inf"), *cuts, float("inf")]
    if not cuts:
        return None
    cutter = Bucketizer(splits=splits, inputCol="__number", outputCol=_RANGE, handleInvalid="keep")
    numbered = cutter.transform(marked.withColumn("__number", F.when(F.col(_HOT), number).otherwise(float("-inf"))))
    return numbered.drop("__number"), len(hot_keys) * (len(splits) - 1)


def _attach(rows: DataFrame, carried: DataFrame, keys: list[str], pairs: int) -> DataFrame:
    """Add ``__carry`` to the rows of hot keys."""
    on = [*keys, _RANGE]
    small = carried.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], "__carry")
    if pairs <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return rows.join(small, _same(rows, small, on), "left").drop(*[f"__k{i}" for i in range(len(on))])


def prior(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    cols: dict[str, Column],
    *,
    following: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add, per output name, the value of a column on the previous (or following) row of the same key."""
    value = F.struct(*[c.alias(n) for n, c in cols.items()])
    direction = [F.col(c).desc() if following else F.col(c).asc() for c in order]
    cut = _add_range(df, keys, order, rows_per_range)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*direction)
        out = df.withColumn("__prior", F.lag(value).over(w))
    else:
        ranged, pairs = cut
        local = ranged.withColumn("__local", F.lag(value).over(Window.partitionBy(*keys, _RANGE).orderBy(*direction)))
        position = F.struct(*order)
        edge = F.min_by(value, position) if following else F.max_by(value, position)
        between = Window.partitionBy(*keys).orderBy(F.col(_RANGE).desc() if following else F.col(_RANGE))
        carried = (
            ranged.filter(_HOT).groupBy(*keys, _RANGE).agg(edge.alias("__edge")).withColumn("__carry", F.lag("__edge").over(between))
        )
        out = (
            _attach(local, carried, keys, pairs)
            .withColumn("__prior", F.coalesce("__local", "__carry"))
            .drop("__local", "__carry", _RANGE, _HOT)
        )
    return out.select("*", *[F.col("__prior")[n].alias(n) for n in cols]).drop("__prior")


def last_known(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    col: Column,
    *,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the last value of ``col`` that is not NULL on the rows before this one, per key."""
    before = (Window.unboundedPreceding, -1)
    cut = _add_range(df, keys, order, rows_per_range)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        return df.withColumn(name, F.last(col, ignorenulls=True).over(w))
    ranged, pairs = cut
    w = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(*before)
    local = ranged.withColumn("__local", F.last(col, ignorenulls=True).over(w))
    between = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(*before)
    carried = (
        ranged.filter(_HOT).groupBy(*keys, _RANGE)
        .agg(F.max_by(col, F.when(col.isNotNull(), F.struct(*order))).alias("__edge"))
        .withColumn("__carry", F.last("__edge", ignorenulls=True).over(between))
    )
    return (
        _attach(local, carried, keys, pairs)
        .withColumn(name, F.coalesce("__local", "__carry"))
        .drop("__local", "__carry", _RANGE, _HOT)
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    col: Column,
    *,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add the sum of ``col`` over this row and the rows before it, per key."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    cut = _add_range(df, keys, order, rows_per_range)
    if cut is None:
        return df.withColumn(name, F.sum(col).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)))
    ranged, pairs = cut
    local = ranged.withColumn(
        "__local", F.sum(col).over(Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(*upto))
    )
    between = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.filter(_HOT).groupBy(*keys, _RANGE)
        .agg(F.sum(col).alias("__edge"))
        .withColumn("__carry", F.sum("__edge").over(between))
    )
    total = F.when(F.col("__local").isNull(), F.col("__carry")).otherwise(
        F.col("__local") + F.coalesce(F.col("__carry"), F.lit(0))
    )
    return _attach(local, carried, keys, pairs).withColumn(name, total).drop("__local", "__carry", _RANGE, _HOT)
