"""Large values and broken text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KB = 1024
REPLACEMENT = "�"  # what Spark puts for bytes that are not valid UTF-8


def limit_lobs(df: DataFrame, cols: list[str], max_kb: float | None) -> DataFrame:
    """Limited mode cuts values over the limit and flags them in ``<col>_cut``; full mode (None) keeps all.

    The limit is on bytes; text is cut to as many characters, binary to as many bytes.
    """
    flags, values = {}, {}
    for name in cols:
        c = F.col(name)
        if max_kb is None:
            flags[f"{name}_cut"] = F.lit(False)
            continue
        limit = int(max_kb * KB)
        over = F.coalesce(F.octet_length(c) > limit, F.lit(False))
        flags[f"{name}_cut"] = over
        values[name] = F.when(over, F.substring(c, 1, limit)).otherwise(c)
    return df.select("*", *[f.alias(n) for n, f in flags.items()]).withColumns(values) if values else df.withColumns(flags)


def repair_text(df: DataFrame, cols: list[str], replacement: str = "") -> DataFrame:
    """Make text valid UTF-8 and put ``replacement`` for what does not convert.

    Adds ``<col>_repaired``: the number of places that were replaced. Valid text is left alone.
    """
    out = {}
    for name in cols:
        c = F.col(name)
        valid = F.make_valid_utf8(c)
        broken = ~F.is_valid_utf8(c) | F.contains(valid, F.lit(REPLACEMENT))
        count = F.length(valid) - F.length(F.replace(valid, F.lit(REPLACEMENT), F.lit("")))
        out[f"{name}_repaired"] = F.when(broken, count).otherwise(F.when(c.isNotNull(), 0))
        out[name] = F.when(broken, F.replace(valid, F.lit(REPLACEMENT), F.lit(replacement))).otherwise(valid)
    return df.withColumns(out)


def repair_counts(repaired: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows with a repair and places repaired."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.count_if(F.col(f"{c}_repaired") > 0), F.lit(0)).alias("rows_repaired"),
            F.coalesce(F.sum(f"{c}_repaired"), F.lit(0)).alias("places"),
        )
        for c in cols
    ]
    return repaired.agg(F.array(*rows).alias("r")).select(F.inline("r"))
