"""Steps that once grew faster than their input: what they write, send or leave in one task."""

from pyspark.sql import functions as F

from plumbline.functions import versions as V
from plumbline.operators import history, scopes, targets
from plumbline.plans import extraction_queries, scope_queries
from plumbline.sources import tables


def test_questions_of_other_histories_are_not_walked(spark, monkeypatch):
    """Thirty histories with a merge each; every newest commit is asked for every oldest one."""
    edges = []
    for k in range(30):
        edges += [(10 * k, None), *[(10 * k + i, 10 * k + i - 1) for i in range(1, 6)], (10 * k + 6, 10 * k + 1), (10 * k + 5, 10 * k + 6)]
    pairs = [(10 * a, 10 * b + 5) for a in range(30) for b in range(30)]
    write, fronts = history.staged, []

    def counted(df):
        out = write(df)
        if {"older", "segment"} <= set(out.columns):
            fronts.append(out.count())
        return out

    monkeypatch.setattr(history, "staged", counted)
    got = history.ancestors(spark.createDataFrame(edges, "commit long, parent long"), spark.createDataFrame(pairs, "older long, newer long"))
    assert {tuple(r) for r in got.collect()} == {(a, b, a // 10 == b // 10) for a, b in pairs}
    assert sum(fronts) <= 120, fronts


def test_claims_of_versions_are_read_once(spark):
    """Texts are searched once for all rungs of the ladder, not once for each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, None, None, 5) for i in range(20)]
    reports = spark.createDataFrame(rows, "report_id long, ref string, version string, epoch long").withColumn("repo", F.lit("r"))
    versions = spark.createDataFrame(
        [(i, 0, "affected_range" if i % 2 else "fixed_in", None if i % 2 else "1.1.0", "1.1.0" if i % 2 else None, True if i % 2 else None, None, None) for i in range(20)],
        "report_id long, start int, relation string, parsed string, upper string, upper_inclusive boolean, special_ref string, commit string",
    )
    versions = versions.mapInArrow(counted, versions.schema)
    releases = spark.range(3).select(F.lit("r").alias("repo"), F.concat(F.lit("v1."), "id", F.lit(".0")).alias("name"), F.concat(F.lit("c"), "id").alias("commit")).withColumn("x", V.tag(F.col("name"))).select("repo", "name", "commit", "x.trimmed", "x.kind")
    empty = lambda schema: spark.createDataFrame([], schema)
    found = targets.resolve(reports, versions, empty("report_id long, ref string, start int"), releases, empty("repo string, sha string"), empty("repo string, branch string, epoch long, commit string"))
    assert {(r["report_id"], r["ref"], r["method"]) for r in found.collect()} == {(i, "v1.1.0" if i % 2 else "v1.0.0", "affected_range" if i % 2 else "fixed_in") for i in range(20)}
    assert seen.value == 20


def test_files_of_definitions_are_shuffled_once_and_not_sent_to_all(spark):
    files = spark.range(40).select(F.col("id").alias("blob"), F.lit("python").alias("lang"), F.concat(F.lit("class C"), "id", F.lit(":\n    def f(a,\n          b):\n        pass\n")).alias("text"))
    found = scopes.symbols(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    assert {(r["blob"], r["line_no"], r["qname"], r["kind"]) for r in found.collect()} == {x for i in range(40) for x in ((i, 1, f"C{i}", "class"), (i, 2, f"C{i}.f", "method"))}


def test_heavy_work_is_dealt_by_rows(spark, tmp_path):
    """A table of few files is dealt into parts of a bounded number of rows, however few cores there are."""
    spark.range(0, 2 * tables.EACH + 1, 1, 1).write.parquet(str(tmp_path / "t.parquet"))
    rows = tables.spread(tables.table(spark, str(tmp_path), "t"))
    assert max(rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) <= tables.EACH
    spark.range(1, numPartitions=1).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    assert scope_queries.files(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_reports_are_searched_after_they_are_dealt_and_once(spark, sf):
    """No pattern is tried below the step that deals reports over all cores, and diffs are cut out once for patches and their hunks."""
    for name in ("location_claims", "symbol_claims"):
        plan = extraction_queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan()
        assert "Filter isnotnull(transform" not in plan.toString(), name
    assert "posexplode(array_sort" not in extraction_queries.patch_claims(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_only_wanted_places_are_shuffled(spark, monkeypatch):
    """Words and pairs of neighbours that no literal is looked up by are left out where lines are read, not by a join."""
    from plumbline.operators import lookup

    rows = [(blob, 1, " ".join(f"w{blob}_{i}" for i in range(50))) for blob in range(200)] + [(200, 1, "a rare line of all"), (201, 1, "said a rare line of all too, and lone")]
    lines = spark.createDataFrame(rows, "blob long, line_no int, line string")
    wanted = spark.createDataFrame([(1, 0, "a rare line of all"), (2, 0, "lone"), (3, 0, "gone for good")], "snippet_id long, rank int, probe string")
    write, indexes = lookup.staged, []

    def counted(df):
        out = write(df)
        if out.columns == ["word", "blob", "line_no"]:
            indexes.append(out.count())
        return out

    monkeypatch.setattr(lookup, "staged", counted)
    found = lookup.found(wanted, lookup.word_index(lines), lines)
    assert sorted((r["snippet_id"], r["blob"]) for r in found.collect()) == [(1, 200), (1, 201), (2, 201)]
    # of 10,000 words the wanted one, and at most what shares its bit
    assert len(indexes) == 1 and indexes[0] < 10
