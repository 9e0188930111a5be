"""Queries and operators over whole inputs: no bound on a radius, no subset of reports."""

import random

import duckdb

from plumbline.operators import joins
from plumbline.plans import registry, trace_queries
from tests.test_queries import plain


def test_suggestions_for_long_names(spark):
    rng = random.Random(4)
    known = sorted({"".join(rng.choice("abcd_") for _ in range(rng.randrange(8, 45))) for _ in range(60)})
    names = set()
    for word in known:
        for edits in (0, 1, 3, 5, 8, 12):
            text = list(word.upper())
            for _ in range(edits):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice(["", "X", "YZ", text[k]])
                text = text or ["Q"]
            names.add("".join(text))
    names = sorted(names)
    got = joins.suggest(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in known], "word string"), most=1000)
    con = duckdb.connect()
    con.execute("create table a (name varchar)")
    con.executemany("insert into a values (?)", [(n,) for n in names])
    con.execute("create table b (word varchar)")
    con.executemany("insert into b values (?)", [(w,) for w in known])
    expected = con.sql("select name, word, levenshtein(lower(name), word) as d from a, b where d <= greatest(1, length(name) // 4)").fetchall()
    assert max(d for _, _, d in expected) > 5
    assert sorted((r.name, r.word, r.distance) for r in got.collect()) == sorted(expected)


def test_trace_rules_of_every_report(spark, sf):
    formats = trace_queries.FORMATS
    ids = [r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()]
    got = trace_queries.trace_sanity(spark, sf).collect()
    assert sorted(r.report_id for r in got) == sorted(ids)
    # what applies to the formats that show process ids, frame numbers or neither
    for r in got:
        form = formats[r.report_id % len(formats)]
        if form != "asan":
            assert r.one_pid == (True if form == "valgrind" else None) and r.frames_numbered == (True if form in ("gdb", "rust") else None)
            assert (r.addresses_agree, r.region_fits, r.summary_agrees, r.stacks_present, r.size_possible) == (None,) * 5
    asan = {i for i in ids if i % 8 == 0}
    assert {r.report_id for r in trace_queries.asan_region_arithmetic(spark, sf).collect()} == asan
    asked = {i for i in ids if formats[i % len(formats)] in ("asan", "valgrind", "gdb", "rust")}
    found = registry.QUERIES["c11_sanitizer_sanity"](spark, sf).collect()
    assert sorted(r.report_id for r in found) == sorted(asked)
    assert {r.report_id for r in found if r.outcome_key == "violation"} == {i for i in ids if i % 24 == 0}


def test_version_fit_of_every_report(spark, sf):
    """The query's SQL over all events."""
    con = duckdb.connect()
    for name in ("part", "events", "documents"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    sql = registry.ORACLE_SQL["c10_trace_version_fit"]
    found = con.sql(sql)
    got = registry.QUERIES["c10_trace_version_fit"](spark, sf).select(*found.columns).collect()
    expected = con.sql(f"select {', '.join(found.columns)} from ({sql})").fetchall()
    assert len({r.report_id for r in got}) == con.sql("select count(*) from events").fetchall()[0][0]
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted((tuple(map(plain, r)) for r in expected), key=repr)
