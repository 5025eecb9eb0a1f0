"""Change records and text logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Fixed value: how a log line starts.
STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"

RECORD = T.StructType([T.StructField("value", T.StringType())])


def read_changes(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Raw change records, one JSON text per line, as column ``value``; ``decode_changes`` types them."""
    if not streaming:
        return spark.read.schema(RECORD).text(path)
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``ts``, ``level`` and ``message`` to log lines ``timestamp pid LEVEL message``."""
    text: Column = F.col(line)
    stamp = F.regexp_extract(text, STAMP, 1)
    fields = r"^\S+ \S+ (?:\S+ )*?(TRACE|DEBUG|SQL|INFO|NOTICE|WARN|ERROR|FATAL) +(.*)$"
    return lines.withColumns(
        {
            "ts": F.to_timestamp_ntz(F.nullif(stamp, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")),
            "level": F.nullif(F.regexp_extract(text, fields, 1), F.lit("")),
            "message": F.when(text.rlike(fields), F.regexp_extract(text, fields, 2)).otherwise(text),
        }
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as ``(file, line_no, line, ts, level, message)``.

    ``line_no`` orders the lines of one file: it grows along the file, with gaps between splits.
    """
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")
    )
    return parse_log(lines)
