import pytest

from karavel.operators import scope as P

TEXT = """
# a comment
[include-only-table]
  app.users
app.orders
[exclude-extension]
pg_net
[unknown]
x
"""


def inv(spark):
    rows = [("table", s, t) for s in ("app", "auth", "public", "pg_catalog", "pg_temp_1", "pgx") for t in ("users", "orders", "logs")]
    rows += [("view", s, "v") for s in ("app", "auth", "information_schema")]
    return spark.createDataFrame(rows, "kind string, schema_name string, name string")


def names(df):
    return sorted(f"{r['kind']}:{r['schema_name']}.{r['name']}" for r in df.collect())


def test_parse():
    s = P.parse_scope(TEXT)
    assert s.include_only_table == ["app.users", "app.orders"] and s.exclude_extension == ["pg_net"]
    assert s.mode == "include-table" and s.table_schemas == ["app"]


@pytest.mark.parametrize("limit", [1000, 0])
def test_modes(spark, limit, monkeypatch):
    """Lists inside the plan and lists as tables give the same."""
    monkeypatch.setattr(P, "LIST_IN_PLAN", limit)
    i = inv(spark)
    own = ["table:" + s + "." + t for s in ("app", "auth", "pgx", "public") for t in ("logs", "orders", "users")]
    assert names(P.scope_filter(i, P.Scope())) == sorted(own + ["view:app.v", "view:auth.v"])
    got = P.scope_filter(i, P.parse_scope(TEXT))
    assert names(got) == ["table:app.orders", "table:app.users", "view:app.v"]
    got = P.scope_filter(i, P.Scope(include_only_schema=["auth"], exclude_table=["auth.logs"], exclude_schema=["auth"]))
    assert names(got) == ["table:auth.orders", "table:auth.users", "view:auth.v"]
    got = P.scope_filter(i, P.Scope(exclude_schema=["app", "pgx"], exclude_table=["auth.logs", "public.users"]))
    assert names(got) == ["table:auth.orders", "table:auth.users", "table:public.logs", "table:public.orders", "view:auth.v"]


def test_exclude_kind(spark):
    rows = [("extension", "s", "a"), ("extension", "s", "b"), ("event trigger", "s", "a")]
    i = spark.createDataFrame(rows, "kind string, schema_name string, name string")
    assert names(P.exclude_kind(i, "extension", ["a"])) == ["event trigger:s.a", "extension:s.b"]
    assert P.exclude_kind(i, "extension", []).count() == 3


def test_conflicts(spark):
    rows = [(1, "include-only-table"), (1, "exclude-schema"), (1, "exclude-table"), (2, "include-only-schema"), (2, "exclude-table"), (3, "typo")]
    got = P.scope_conflicts(spark.createDataFrame(rows, "scope_id bigint, section string"))
    assert sorted(map(tuple, got.collect())) == [
        (1, "include-only-table + exclude-schema"), (1, "include-only-table + exclude-table")
    ]


def test_rules_lowest_id_renames_first(spark):
    base = '{"rules": [{"rule-type": "selection", "rule-id": "1", "rule-action": "include", "object-locator": {"schema-name": "app", "table-name": "%"}}]}'
    more = """{"rules": [
      {"rule-type": "transformation", "rule-id": "10", "rule-action": "rename", "rule-target": "schema", "object-locator": {"schema-name": "app", "table-name": "%"}, "value": "ten"},
      {"rule-type": "transformation", "rule-id": "9", "rule-action": "rename", "rule-target": "schema", "object-locator": {"schema-name": "app", "table-name": "u%"}, "value": "nine"},
      {"rule-type": "transformation", "rule-id": "11", "rule-action": "rename", "rule-target": "table", "object-locator": {"schema-name": "app", "table-name": "logs"}, "value": "log"}]}"""
    got = P.apply_rules(inv(spark).filter("kind = 'table'"), P.parse_rules(base, more))
    assert {r["name"]: (r["target_schema"], r["target_name"]) for r in got.collect()} == {
        "users": ("nine", "users"), "orders": ("ten", "orders"), "logs": ("ten", "log")
    }
    assert P.apply_rules(inv(spark), P.parse_rules(more)).count() == 0
