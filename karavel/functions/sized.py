"""Join sides whose size is looked at before they are sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from karavel.session import shared_folder

BROADCAST_ROWS = 100_000


def settle(df: DataFrame, name: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """Compute a narrow table that is expected to be small once, in the shared folder, and count it.

    Without this, a join with the result of an aggregation is planned on a guess, and adaptive
    execution starts to shuffle the large side before the small one is known. Up to ``limit`` rows the
    table comes back marked for broadcast, beyond that it is joined by shuffle as usual.
    """
    written, known = settle_known(df, name, limit)
    return written, known["rows"]


def settle_known(df: DataFrame, name: str, limit: int | None = None, **facts: Column) -> tuple[DataFrame, Row]:
    """``settle`` with more aggregates of the written table by the job that counts it: ``rows`` and ``facts``."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    known = written.agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in facts.items()]).first()
    return (F.broadcast(written) if known["rows"] <= (BROADCAST_ROWS if limit is None else limit) else written), known
