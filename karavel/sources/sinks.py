"""Writing a table with one of three preparation modes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from karavel.sources.files import exists

PREPARATIONS = ("drop_and_create", "truncate", "nothing")


class SchemaMismatch(ValueError):
    pass


def write_snapshot(
    df: DataFrame, dest: str, prep: str = "drop_and_create", *, url: str | None = None, options: dict[str, str] | None = None
) -> None:
    """Write to a parquet folder, or to JDBC table ``dest`` when ``url`` is given.

    ``drop_and_create``: the new schema wins. ``truncate``: the old schema stays, another one is an
    error. ``nothing``: rows are added. The data must not come from ``dest`` itself.
    """
    if prep not in PREPARATIONS:
        raise ValueError(f"unknown preparation {prep!r}, choose one of {PREPARATIONS}")
    mode = "append" if prep == "nothing" else "overwrite"
    if url is not None:
        writer = df.write.format("jdbc").option("url", url).option("dbtable", dest).options(**(options or {}))
        if prep == "truncate":
            writer = writer.option("truncate", "true")
        writer.mode(mode).save()
        return
    if prep != "drop_and_create" and exists(df.sparkSession, dest):
        old = df.sparkSession.read.parquet(dest).schema
        if [(f.name, f.dataType) for f in old] != [(f.name, f.dataType) for f in df.schema]:
            raise SchemaMismatch(f"{dest} holds another schema")
    df.write.mode(mode).parquet(dest)
