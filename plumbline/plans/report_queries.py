"""Queries of links, numbers, attribution, attachments, record bodies, controls and samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import bugs
from plumbline.functions import text as T
from plumbline.operators import checks, claims, metrics, spans
from plumbline.plans import source_queries
from plumbline.sources import reports
from plumbline.sources.tables import table

HOSTS = "CASE event_id % 3 WHEN 0 THEN 'https://github.com/o/r.git' WHEN 1 THEN 'https://gitlab.com/o/r' ELSE 'https://example.org/o/r' END"


def permalink(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(HOSTS).alias("repo"))
    return rows.select("event_id", T.permalink(F.col("repo"), F.lit("c0ffee"), F.lit("src/a.c"), (F.col("event_id") % 50).cast("int"), (F.col("event_id") % 70).cast("int")).alias("url"))


def number_texts(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN concat('0x', lower(hex(event_id))) WHEN 1 THEN cast(event_id AS string) WHEN 2 THEN concat(event_id, 'g') ELSE '1234567890123456789' END")
    return table(spark, sf_dir, "events").select("event_id", T.hex_number(raw).cast("long").alias("hex"), T.short_number(raw).alias("number"))


def runtime_errors(spark, sf_dir):
    """Every phrase, in a message of its own."""
    phrases = F.array(*[F.lit(p) for p, _ in bugs.RUNTIME_ERRORS], F.lit("nothing"))
    text = F.concat(F.lit("Runtime error: "), F.get(phrases, (F.col("event_id") % (len(bugs.RUNTIME_ERRORS) + 1)).cast("int")), F.lit(" 3 in x"))
    return table(spark, sf_dir, "events").select("event_id", bugs.runtime_error(text).alias("kind"))


BODY = "concat('Intro text. ', CASE event_id % 4 WHEN 0 THEN 'In LibWidget 1.2 the' WHEN 1 THEN 'LibWidgets fail. The' WHEN 2 THEN 'LibWidget is big.\n\nThe' ELSE 'The' END, ' flag CVE-2024-1000 is bad', CASE event_id % 3 WHEN 0 THEN ' in libwidget. More' ELSE '. libwidget is small.' END)"


def product_attribution(spark, sf_dir):
    body = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.expr(BODY).alias("body"), F.array(F.lit("libwidget"), F.lit("lw+")).alias("names"))
    found = body.select("report_id", F.concat(F.lit("c"), "report_id").alias("claim_id"), F.transform(spans.matches(F.col("body"), "CVE-[0-9-]+"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("spans"), F.lit("unscoped").alias("provenance"))
    return claims.attributed(found, body).select("report_id", "provenance")


def attachment_names(spark, sf_dir):
    """Every order's items come as files; all are named by their flag, some with paths and odd characters."""
    name = F.expr("concat(CASE WHEN l_linenumber % 2 = 0 THEN '../x/' ELSE '' END, lower(l_returnflag), CASE WHEN l_linenumber = 3 THEN ' b' ELSE '' END, '.txt')")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", name.alias("name")))).alias("l"))
    rows = rows.select("l_orderkey", F.transform("l", lambda x: x["name"]).alias("names"))
    return rows.select("l_orderkey", F.posexplode(reports.safe_names(F.col("names"))).alias("pos", "name"))


def cve_bodies(spark, sf_dir):
    found = reports.cve_reports(reports.cve_records(table(spark, sf_dir, "events").select(F.expr(source_queries.CVE_JSON).alias("json"))))
    return found.select("cve_id", "report_id", F.md5(F.col("body").cast("binary")).alias("digest"))


ADVISORIES = """concat('[{"ghsa_id":"G-', event_id, '","summary":"S","severity":"high","vulnerabilities":[{"package":{"name":"p', event_id % 7, '"},"vulnerable_version_range":"< 2"},{"package":{"name":"q"},"first_patched_version":"3"}]},{"ghsa_id":"H-', event_id, '"}]')"""


def advisory_rows(spark, sf_dir):
    return reports.advisories(table(spark, sf_dir, "events").select(F.expr(ADVISORIES).alias("json"))).select("ghsa_id", "severity", "package", "range", "patched")


def verdict_distributions(spark, sf_dir):
    return metrics.distributions(table(spark, sf_dir, "events").withColumn("verdict", F.col("event_id") % 4), ["event_type"], "verdict")


def random_control(spark, sf_dir):
    return metrics.random_control(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "BUILDING", "MACHINERY")


def handcheck_sample(spark, sf_dir):
    return metrics.sampled(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 40, 7)


def c07_other_release(spark, sf_dir):
    """Items of the benchmark as snippets; every second is in another release's files alone, some nowhere."""
    words = F.split("text", " ")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), words.alias("tokens"))
    snippets = items.where(F.size("tokens") >= 5).withColumn("n_lines", F.lit(5))
    here, there = items.where("doc_id % 3 = 0"), items.where("doc_id % 3 = 1")
    return checks.c07_snippet_provenance(snippets, here, others=there).select("report_id", "subject", "outcome_key", "outcome", "strength")


QUERIES = {f.__name__: f for f in (permalink, number_texts, runtime_errors, product_attribution, attachment_names, cve_bodies, advisory_rows, verdict_distributions, random_control, handcheck_sample, c07_other_release)}

_DRAWN = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
ORACLE_SQL = {
    "permalink": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://github.com/o/r' WHEN 1 THEN 'https://gitlab.com/o/r' END || '/blob/c0ffee/src/a.c#L' || greatest(event_id % 50, 1) || CASE WHEN event_id % 70 > event_id % 50 THEN CASE event_id % 3 WHEN 0 THEN '-L' ELSE '-' END || event_id % 70 ELSE '' END AS url FROM events",
    "number_texts": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN ('0x' || event_id)::BIGINT WHEN 2 THEN NULL END AS hex, CASE event_id % 4 WHEN 1 THEN event_id END AS number FROM events",
    "runtime_errors": f"SELECT event_id, {[k for _, k in bugs.RUNTIME_ERRORS] + ['unknown']}[event_id % {len(bugs.RUNTIME_ERRORS) + 1} + 1] AS kind FROM events",
    "product_attribution": "SELECT event_id AS report_id, CASE WHEN event_id % 4 = 0 OR event_id % 3 = 0 THEN 'project_attributed' ELSE 'unscoped' END AS provenance FROM events",
    "attachment_names": """WITH n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lower(l_returnflag)) - 1 AS pos, lower(l_returnflag) || CASE WHEN l_linenumber = 3 THEN '_b' ELSE '' END AS stem FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, stem ORDER BY pos) - 1 AS again FROM n) SELECT l_orderkey, pos::INTEGER AS pos, stem || CASE WHEN again > 0 THEN '-' || again ELSE '' END || '.txt' AS name FROM k""",
    "cve_bodies": """WITH b AS (SELECT 'CVE-2024-' || event_id AS cve_id, concat_ws(chr(10), '# T' || event_id || chr(10), 'State: ' || CASE WHEN event_id % 9 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END || ' · Published: 2024-03-0' || (event_id % 9 + 1) || chr(10), '## Affected' || chr(10) || chr(10) || '- P' || event_id % 5 || chr(10), '## Impact' || chr(10) || chr(10) || '- V' || chr(10), '## Description' || chr(10) || chr(10) || 'D' || chr(10)) AS body FROM events)
 SELECT cve_id, substr(sha256('cve_json' || chr(0) || body), 1, 12) AS report_id, md5(body) AS digest FROM b""",
    "advisory_rows": "SELECT 'G-' || event_id AS ghsa_id, 'high' AS severity, unnest(['p' || event_id % 7, 'q']) AS package, unnest(['< 2', NULL]) AS range, unnest([NULL, '3']) AS patched FROM events UNION ALL SELECT 'H-' || event_id, NULL, NULL, NULL, NULL FROM events",
    "verdict_distributions": "SELECT event_type, event_id % 4 AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 4) AS share FROM events GROUP BY 1, 2",
    "random_control": f"""WITH s AS (SELECT c_mktsegment AS seg, t, floor({_DRAWN.format("t || ':' || c_custkey")} * 1000) AS score FROM customer, range(1, 22) AS r(t)), c AS (SELECT t, score, count(*) FILTER (seg = 'BUILDING') AS p, count(*) FILTER (seg = 'MACHINERY') AS n FROM s GROUP BY 1, 2),
 j AS (SELECT t, sum(p) OVER w / sum(p) OVER (PARTITION BY t) - sum(n) OVER w / sum(n) OVER (PARTITION BY t) AS j FROM c WINDOW w AS (PARTITION BY t ORDER BY score ROWS UNBOUNDED PRECEDING)), b AS (SELECT t, greatest(max(j), 0) AS j FROM j GROUP BY t) SELECT round(median(j), 4) AS control FROM b""",
    "handcheck_sample": f"SELECT event_id, event_type FROM events ORDER BY {_DRAWN.format("7 || ':' || event_id")}, event_id LIMIT 40",
    "c07_other_release": """WITH s AS (SELECT item_id AS report_id, item_id::VARCHAR AS subject, CASE item_id % 3 WHEN 0 THEN 'contained' WHEN 1 THEN 'other_release_only' ELSE 'absent_everywhere' END AS outcome_key, CASE WHEN len(string_split(text, ' ')) < 25 THEN 0.3 ELSE 1.0 END AS f FROM benchmark WHERE len(string_split(text, ' ')) >= 5)
 SELECT report_id, subject, outcome_key, CASE outcome_key WHEN 'contained' THEN 'SUPPORTS' ELSE 'REFUTES' END AS outcome, round(f * CASE outcome_key WHEN 'contained' THEN 2.0 WHEN 'other_release_only' THEN -0.5 ELSE -2.5 END, 6)::DOUBLE AS strength FROM s""",
}
