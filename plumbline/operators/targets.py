"""Which release or commit a report speaks of: a ladder of rungs from what its reader was told to what it says itself, nothing guessed silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.versions import tag
from plumbline.operators.joins import as_of
from plumbline.staging import staged

#: The rungs, best first.
RUNGS = ("explicit_ref", "explicit_version", "permalink", "tested_on", "affected_range", "fixed_in", "commit", "branch")


def resolve(reports: DataFrame, versions: DataFrame, permalinks: DataFrame, releases: DataFrame, commits: DataFrame, tips: DataFrame) -> DataFrame:
    """Per report: ref, commit, method (the rung, or none), confidence, alternatives (other releases that it names).

    reports: report_id, repo, ref, version (both null unless given from outside), epoch (of the report); versions: version claims; permalinks: report_id, ref, start; releases: repo,
    name, commit, trimmed, kind; commits: repo, sha; tips: repo, branch, epoch, commit (commits of the default branch). Versions of another product must be
    left out before. Everything meets on equal keys: releases on their numbers, ids on their first seven digits, neighbours and tips by as-of windows over
    distinct versions and reports of a repository. Claims are written once: each rung takes its own from them, and texts are not read again for each."""
    known = reports.select("report_id", "repo")
    names = releases.select("repo", F.col("name").alias("ref"), "commit").unionByName(commits.select("repo", F.col("sha").alias("ref"), F.col("sha").alias("commit"))).dropDuplicates(["repo", "ref"])

    def rung(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("report_id", F.lit(RUNGS.index(name)).alias("rung"), "start", "ref", "commit")

    told = reports.where("ref IS NOT NULL").select("report_id", "repo", "ref", F.lit(0).alias("start")).join(names, ["repo", "ref"])
    linked = permalinks.join(known, "report_id").join(names, ["repo", "ref"])
    # a version is the release of its numbers and kind, or the last one before it
    claimed = staged(versions.select("report_id", "start", "relation", "parsed", "upper", "upper_inclusive", "special_ref", "commit").join(known, "report_id"))
    wanted = [
        ("explicit_version", reports.where("version IS NOT NULL").select("report_id", "repo", F.lit(0).alias("start"), F.col("version").alias("raw"), F.lit(False).alias("below"))),
        ("tested_on", claimed.where("relation = 'tested_on' AND parsed IS NOT NULL").select("report_id", "repo", "start", F.col("parsed").alias("raw"), F.lit(False).alias("below"))),
        ("affected_range", claimed.where("relation = 'affected_range' AND upper IS NOT NULL").select("report_id", "repo", "start", F.col("upper").alias("raw"), (~F.col("upper_inclusive")).alias("below"))),
        ("fixed_in", claimed.where("relation = 'fixed_in' AND parsed IS NOT NULL").select("report_id", "repo", "start", F.col("parsed").alias("raw"), F.lit(True).alias("below"))),
    ]
    asked = None
    for name, rows in wanted:
        part = rows.withColumn("rung", F.lit(RUNGS.index(name)))
        asked = part if asked is None else asked.unionByName(part)
    asked = staged(asked.withColumn("v", tag(F.col("raw"))).where("v.numbers IS NOT NULL").select("report_id", "repo", "start", "rung", "below", F.col("v.trimmed").alias("trimmed"), F.col("v.kind").alias("kind")))
    same = releases.groupBy("repo", "trimmed", "kind").agg(F.min_by(F.struct(F.col("name").alias("ref"), "commit"), "name").alias("r"))
    exact = asked.where("NOT below").join(same, ["repo", "trimmed", "kind"])
    final = releases.where("kind = 'final'").groupBy("repo", "trimmed").agg(F.min_by(F.struct(F.col("name").alias("ref"), "commit"), "name").alias("r"))
    last = as_of(asked.where("below").select("repo", "trimmed").distinct(), final, ["repo"], "trimmed", "r", strictly=True).where("r IS NOT NULL").select("repo", "trimmed", "r")
    before = asked.where("below").join(last, ["repo", "trimmed"])
    of_versions = exact.select("report_id", "rung", "start", "r.ref", "r.commit").unionByName(before.select("report_id", "rung", "start", "r.ref", "r.commit"))
    heads = commits.select("repo", F.substring("sha", 1, 7).alias("head"), "sha")
    ids = claimed.where("commit IS NOT NULL").select("report_id", "repo", "start", F.col("commit").alias("ref"), F.substring("commit", 1, 7).alias("head")).join(heads, ["repo", "head"]).where(F.startswith("sha", F.col("ref"))).withColumn("commit", F.col("sha"))
    branch = claimed.where("special_ref IS NOT NULL").groupBy("report_id", "repo").agg(F.min("start").alias("start")).join(reports.select("report_id", "epoch"), "report_id").withColumn("epoch", F.coalesce("epoch", F.lit((1 << 62) - 1)))
    tip = as_of(branch, tips.select("repo", "epoch", F.struct(F.col("branch").alias("ref"), "commit").alias("tip")), ["repo"], "epoch", "tip").where("tip IS NOT NULL").select("report_id", "start", "tip.*")
    rows = rung(told, "explicit_ref").unionByName(rung(linked, "permalink")).unionByName(of_versions).unionByName(rung(ids, "commit")).unionByName(rung(tip, "branch"))
    by = Window.partitionBy("report_id").orderBy("rung", "start", "ref")
    ranked = rows.withColumn("place", F.row_number().over(by))
    said = F.col("rung").between(RUNGS.index("tested_on"), RUNGS.index("fixed_in"))
    best = ranked.groupBy("report_id").agg(F.min_by(F.struct("rung", "ref", "commit"), "place").alias("b"), F.collect_list(F.when(said, F.struct("place", "ref"))).alias("named"))
    others = F.array_distinct(F.filter(F.transform(F.array_sort("named"), lambda x: x["ref"]), lambda x: x != F.col("b.ref")))
    of_claims = F.col("b.rung").between(RUNGS.index("tested_on"), RUNGS.index("fixed_in"))
    found = best.select("report_id", "b.*", F.when(of_claims, others).otherwise(F.array().cast("array<string>")).alias("alternatives"))
    method = F.coalesce(F.get(F.array(*[F.lit(r) for r in RUNGS]), F.col("rung")), F.lit("none"))
    sure = F.when(F.col("rung").isNull() | (F.col("rung") == RUNGS.index("branch")), "low").when(F.size("alternatives") > 0, "medium").otherwise("high")
    return reports.select("report_id").join(found, "report_id", "left").select("report_id", "ref", "commit", method.alias("method"), sure.alias("confidence"), F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"))
