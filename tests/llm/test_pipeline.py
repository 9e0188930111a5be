"""The pipeline's stages on a small table against plain versions, and SQL of the queries that have it."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import decontamination, neardup, packing, quality, registry, secrets
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_neardup import brute as components
from tests.llm.test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The output of each stage, each written and read as the next one's input."""
    from plumbline.llm.common import staged

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF))
        out[name] = (before, docs)
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    columns = stages["quality"][0].columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_quality_keeps_what_scores(spark, stages):
    before, after = stages["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"), ~quality.fold())
    assert ids(after) == ids(quality.score(before, model).where(f"score >= {quality.THRESHOLD}"))


def test_one_of_each_component_stays(stages):
    before, after = stages["near_duplicates"]
    expected = components([(r.doc_id, r.text) for r in before.collect()], neardup.SHINGLE, 80)
    assert ids(after) == sorted(d for d, (_, root) in expected.items() if d == root)


def test_no_benchmark_window_stays(spark, stages):
    before, after = stages["decontamination"]
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == sorted(row[0] for row in hits([(r.doc_id, r.text) for r in before.collect()], tests, decontamination.WINDOW) if not row[-1])


def test_secrets_are_masked(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages["secrets"])
    assert before.keys() == after.keys()
    for doc, row in before.items():
        found = spans(row.text)
        got = after[doc]
        assert got.n_chars == len(got.text)
        if not found:
            assert got.text == row.text
        assert all(row.text[a:b] not in got.text for a, _, _, b in found)
    assert len(secrets.RULES) >= 3


def test_packing_covers_every_document(stages):
    before, after = stages["packing"]
    total = {}
    for r in after.collect():
        total.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert sorted(total) == ids(before) and all(a == b for a, b in total.values())
    assert after.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = con.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
