"""Scope: which objects take part in a move, from include and exclude lists or pattern rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The six section names of a scope file, and schemas that never take part.
SECTIONS = (
    "exclude-schema",
    "exclude-table",
    "exclude-extension",
    "exclude-event-trigger",
    "include-only-table",
    "include-only-schema",
)
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
SYSTEM_PREFIX = "pg\\_%"

LIST_IN_PLAN = 1000  # longer lists become a table and a join


@dataclass
class Scope:
    exclude_schema: list[str] = field(default_factory=list)
    exclude_table: list[str] = field(default_factory=list)
    exclude_extension: list[str] = field(default_factory=list)
    exclude_event_trigger: list[str] = field(default_factory=list)
    include_only_table: list[str] = field(default_factory=list)
    include_only_schema: list[str] = field(default_factory=list)

    @property
    def mode(self) -> str:
        if self.include_only_table:
            return "include-table"
        if self.include_only_schema:
            return "include-schema"
        return "exclude-schema" if self.exclude_schema else "all"

    @property
    def table_schemas(self) -> list[str]:
        """Schemas of the listed tables."""
        return sorted({t.partition(".")[0] for t in self.include_only_table})


def parse_scope(text: str) -> Scope:
    """Read the sectioned text form. Blank lines, ``#`` lines and unknown sections are skipped."""
    scope, section = Scope(), ""
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
        elif section in SECTIONS:
            getattr(scope, section.replace("-", "_")).append(line)
    return scope


def _in_list(df: DataFrame, col: Column, values: list[str], keep: bool) -> DataFrame:
    if len(values) <= LIST_IN_PLAN:
        return df.filter(col.isin(*values) if keep else ~col.isin(*values))
    listed = df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], "__v string")
    return df.join(listed, col == listed["__v"], "left_semi" if keep else "left_anti")


def drop_system(df: DataFrame, schema: str = "schema_name") -> DataFrame:
    s = F.col(schema)
    return df.filter(~s.isin(*SYSTEM_SCHEMAS) & ~s.like(SYSTEM_PREFIX))


def schema_filter(df: DataFrame, scope: Scope, schema: str = "schema_name") -> DataFrame:
    """The schema clause, for object kinds that have no table."""
    col = F.col(schema)
    if scope.mode == "include-table":
        return _in_list(df, col, scope.table_schemas, True)
    if scope.mode == "include-schema":
        return _in_list(df, col, scope.include_only_schema, True)
    if scope.mode == "exclude-schema":
        return _in_list(df, col, scope.exclude_schema, False)
    return df


def table_filter(df: DataFrame, scope: Scope, schema: str = "schema_name", table: str = "name") -> DataFrame:
    """The table clause, on top of the schema clause, for tables and what belongs to a table."""
    full = F.concat(F.col(schema), F.lit("."), F.col(table))
    if scope.mode == "include-table":
        return _in_list(df, full, scope.include_only_table, True)
    if scope.exclude_table:
        return _in_list(df, full, scope.exclude_table, False)
    return df


def scope_filter(
    inventory: DataFrame,
    scope: Scope,
    *,
    schema: str = "schema_name",
    table: str = "name",
    table_kinds: tuple[str, ...] = ("table",),
) -> DataFrame:
    """The objects of an inventory ``(kind, schema, name, ...)`` that are in scope.

    Extensions and event triggers that the scope names are left out in every mode.
    """
    known = schema_filter(drop_system(inventory, schema), scope, schema)
    for kind, names in (("extension", scope.exclude_extension), ("event trigger", scope.exclude_event_trigger)):
        if names:
            known = _in_list(known.filter(F.col("kind") == kind), F.col(table), names, False).unionByName(
                known.filter(~F.col("kind").eqNullSafe(F.lit(kind)))
            )
    if scope.mode != "include-table" and not scope.exclude_table:
        return known
    has_table = F.col("kind").isin(*table_kinds)
    return table_filter(known.filter(has_table), scope, schema, table).unionByName(known.filter(~has_table))


def exclude_kind(inventory: DataFrame, kind: str, names: list[str] | DataFrame) -> DataFrame:
    """The inventory without the named objects of one kind; long name lists come as a table with ``name``."""
    if isinstance(names, DataFrame):
        listed = names.select(F.lit(kind).alias("kind"), "name")
    elif not names:
        return inventory
    else:
        rows = [(kind, n) for n in sorted(set(names))]
        listed = inventory.sparkSession.createDataFrame(rows, "kind string, name string")
    return inventory.join(listed, ["kind", "name"], "left_anti").select(*inventory.columns)


# Pairs of sections that must not be used together.
FORBIDDEN_PAIRS = (
    ("include-only-table", "exclude-schema"),
    ("include-only-table", "exclude-table"),
    ("include-only-schema", "exclude-schema"),
)


def scope_conflicts(scopes: DataFrame) -> DataFrame:
    """Forbidden pairs per scope, from rows ``(scope_id, section, entry)``."""
    used = scopes.filter(F.col("section").isin(*SECTIONS)).groupBy("scope_id").agg(F.collect_set("section").alias("used"))
    pairs = F.array(
        *[
            F.when(
                F.array_contains("used", a) & F.array_contains("used", b), F.lit(f"{a} + {b}")
            )
            for a, b in FORBIDDEN_PAIRS
        ]
    )
    return used.select("scope_id", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("conflict"))


# ------------------------------------------------------------------------------------- pattern rules


def parse_rules(*documents: str) -> list[dict]:
    """Rules of one or more JSON documents; later documents are appended to the base rules."""
    rules: list[dict] = []
    for text in documents:
        rules += json.loads(text)["rules"]
    return rules


def _matches(rule: dict, schema: Column, table: Column) -> Column:
    where = rule["object-locator"]
    return schema.like(where["schema-name"]) & table.like(where.get("table-name", "%"))


def apply_rules(inventory: DataFrame, rules: list[dict], schema: str = "schema_name", table: str = "name") -> DataFrame:
    """Tables that a selection rule includes (and none excludes), with target schema and name.

    Patterns are ``LIKE`` patterns. They become one predicate of the plan, so no pairs of rules and
    tables are built. Of several rename rules the one with the lowest rule id counts.
    """
    s, t = F.col(schema), F.col(table)
    no = F.lit(False)

    def any_of(action: str) -> Column:
        hits = [_matches(r, s, t) for r in rules if r["rule-type"] == "selection" and r["rule-action"] == action]
        return reduce(lambda a, b: a | b, hits, no)

    chosen = inventory.filter(any_of("include") & ~any_of("exclude"))
    new = {"schema": s, "table": t}
    renames = [r for r in rules if r["rule-type"] == "transformation" and r["rule-action"] == "rename"]
    for rule in sorted(renames, key=lambda r: int(r["rule-id"]), reverse=True):
        part = rule["rule-target"]
        new[part] = F.when(_matches(rule, s, t), F.lit(rule["value"])).otherwise(new[part])
    return chosen.withColumns({"target_schema": new["schema"], "target_name": new["table"]})
