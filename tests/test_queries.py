"""Every query of the library against its SQL on the smallest tables, and their plans at a glance."""

import decimal
import math

import duckdb
import pytest

from plumbline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


#: Queries that join a table of one row, such as the newest release or the list of places, without a key.
ONE_ROW = {"timeline_uncertain", "presence_runs", "introduced_first", "resolve_ladder", "foreign_repositories", "c01_version_resolves", "checks_to_verdicts", "c16_affected_range", "claims_to_checks"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_like_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and (name in ONE_ROW or "BroadcastNestedLoopJoin" not in plan)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_query_pairs_all_rows(spark, sf, capsys):
    for name in ("asof_latest_before", "suffix_path_join", "fuzzy_suggest", "containment_join", "interval_overlap_join", "edge_priority", "template_join", "c05_nearby_release", "c06_line_content", "c12_patch_applies", "c15_commits", "c16_fixed_in", "rarest_name", "lint_rows", "inlined_lines"):
        registry.QUERIES[name](spark, sf).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
