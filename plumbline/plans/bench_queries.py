"""Queries of measuring: manifests written and read again, features by check and outcome, places of planted mistakes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import metrics, mutations
from plumbline.plans import claim_table_queries
from plumbline.sources import manifests
from plumbline.sources.tables import table
from plumbline.staging import new_path


def entries(spark, sf_dir) -> DataFrame:
    """Every order is an entry of one of five sources; some are faulty."""
    k = F.col("o_orderkey")
    text = lambda x: x.cast("string")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), k % 5).alias("source"),
        F.when(k % 17 == 0, F.concat(F.lit("bad id "), k)).otherwise(F.concat(F.lit("e-"), k)).alias("id"),
        F.when(k % 19 == 0, "WRONG").otherwise("GENUINE").alias("label"),
        none.alias("expected"),
        F.when(k % 3 == 0, F.when(k % 23 == 0, "../up.md").otherwise(F.concat(F.lit("reports/"), text(k), F.lit(".md")))).alias("path"),
        F.when((k % 3 == 1) | (k % 29 == 0), F.when(k % 31 == 0, "http://x").otherwise(F.concat(F.lit("https://example.org/"), text(k)))).alias("url"),
        F.when(k % 3 == 2, F.concat(F.lit("CVE-2024-"), 1000 + k)).alias("cve_id"),
        F.when((k % 3 == 2) & (k % 37 != 0), F.lit("c" * 40)).alias("cvelist_commit"),
        none.alias("repo"),
        F.lit("1.0").alias("version"),
        none.alias("poc"),
        none.alias("recipe"),
        F.when(k % 41 == 0, F.repeat(F.lit("n"), 300)).otherwise("note").alias("notes"),
    )


def manifest_round_trip(spark, sf_dir):
    """Two of the sources, as they are read from the written folders."""
    path = new_path(spark)
    manifests.write_manifest(entries(spark, sf_dir), path)
    return manifests.read_manifest(spark, path, ["s1", "s3"]).groupBy("source", "label").agg(F.count("*").alias("n"), F.count("path").alias("paths"), F.min("id").alias("first"))


def manifest_faults(spark, sf_dir):
    return manifests.faults(entries(spark, sf_dir))


def blobs_by_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha1(F.encode("text", "utf-8")).alias("sha"), F.encode("text", "utf-8").alias("content"))
    wanted = docs.where(F.octet_length("content") % 3 == 0).select("sha").unionByName(table(spark, sf_dir, "region").select(F.sha1("r_name").alias("sha")))
    found = manifests.read_blobs(wanted, docs, 1500)
    return found.select("sha", "size", F.md5("content").alias("digest"))


def outcome_features(spark, sf_dir):
    """Of every order the outcomes of its items, as checks by line number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.concat(F.lit("C0"), F.col("l_linenumber") % 4).alias("check_id"), F.col("l_returnflag").alias("outcome"))
    found = metrics.outcome_features(rows)
    return found.select("report_id", F.array_join(F.transform(F.array_sort(F.map_entries("features")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), " ").alias("features"))


def planted_places(spark, sf_dir):
    """What each kind of planted mistake changes in reports that have places for most."""
    found = mutations.mutated(claim_table_queries.reports(spark, sf_dir))
    marks = {"M1": "_impl", "M3": "1.9", "M5": " x /* ", "M6": "-planted"}
    held = F.coalesce(*[F.when(F.col("kind") == k, F.contains("body", F.lit(m)) & ~F.contains("original", F.lit(m))) for k, m in marks.items()], F.lit(False))
    return found.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if("applied").alias("applied"), F.count_if(held & F.col("applied")).alias("marked"))


QUERIES = {f.__name__: f for f in (manifest_round_trip, manifest_faults, blobs_by_id, outcome_features, planted_places)}

_ENTRIES = """e AS (SELECT o_orderkey AS k, 's' || (o_orderkey % 5) AS source, CASE WHEN o_orderkey % 17 = 0 THEN 'bad id ' || o_orderkey ELSE 'e-' || o_orderkey END AS id, CASE WHEN o_orderkey % 19 = 0 THEN 'WRONG' ELSE 'GENUINE' END AS label,
 o_orderkey % 3 = 0 AS p, o_orderkey % 3 = 1 OR o_orderkey % 29 = 0 AS u, o_orderkey % 3 = 2 AS c, o_orderkey % 3 = 2 AND o_orderkey % 37 <> 0 AS h FROM orders)"""


ORACLE_SQL = {
    "manifest_round_trip": f"WITH {_ENTRIES} SELECT source, label, count(*) AS n, count(*) FILTER (p) AS paths, min(id) AS first FROM e WHERE source IN ('s1', 's3') GROUP BY 1, 2",
    "manifest_faults": f"""WITH {_ENTRIES} SELECT id, fault FROM e, LATERAL (SELECT unnest([CASE WHEN k % 17 = 0 THEN 'bad_id' END, CASE WHEN k % 19 = 0 THEN 'bad_label' END, CASE WHEN p AND k % 23 = 0 THEN 'bad_path' END, CASE WHEN u AND k % 31 = 0 THEN 'bad_url' END,
 CASE WHEN c <> h THEN 'half_pinned' END, CASE WHEN p::INTEGER + u::INTEGER + h::INTEGER <> 1 THEN 'locators' END, CASE WHEN k % 41 = 0 THEN 'bad_notes' END]) AS fault) WHERE fault IS NOT NULL""",
    "blobs_by_id": "WITH d AS (SELECT DISTINCT sha1(text) AS sha, text, strlen(text) AS n FROM documents WHERE text IS NOT NULL) SELECT sha, n::INTEGER AS size, CASE WHEN n <= 1500 THEN md5(text) END AS digest FROM d WHERE n % 3 = 0 UNION ALL SELECT sha1(r_name), NULL, NULL FROM region",
    "outcome_features": "WITH c AS (SELECT l_orderkey AS report_id, 'C0' || (l_linenumber % 4) || '.' || l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT report_id, string_agg(f || '=' || n, ' ' ORDER BY f) AS features FROM c GROUP BY 1",
    "planted_places": "SELECT k AS kind, 3 * count(*) AS cases, CASE WHEN k IN ('M4', 'M7') THEN 0 ELSE 3 * count(*) END AS applied, CASE WHEN k IN ('M1', 'M5', 'M6') THEN 3 * count(*) WHEN k = 'M3' THEN 3 * count(*) FILTER (event_id % 7 <> 6) ELSE 0 END AS marked FROM events, (VALUES ('M1'), ('M2'), ('M3'), ('M4'), ('M5'), ('M6'), ('M7')) t(k) GROUP BY k",
}
