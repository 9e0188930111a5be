"""Queries of claims: events as reports of known content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import versions as V
from plumbline.operators import checks, claims, extraction, targets
from plumbline.sources.tables import spread, table

#: The report of an event: {i} is its id, {k} its user, {n} a line number.
BODY = "Overflow in `copy_{k}` of version 1.{k}.2.\n\nSee src/mod{k}/util.c:{n} and src/mod{k}/hdr.h, found in /usr/lib/x/base.c; it never calls `check_{k}`. Run with --size-{k} and read https://example.org/CVE-2024-{n}1111 (CWE-787, CVE-2023-{n}2222). The malloc() there and parse_head() there. Severity: high"


def reports(spark, sf_dir: str) -> DataFrame:
    body = F.lit(BODY)
    for name, value in {"{k}": F.col("user_id").cast("string"), "{n}": (F.col("event_id") % 300 + 1).cast("string")}.items():
        body = F.replace(body, F.lit(name), value)
    body = F.when(F.col("event_id") % 10 == 9, F.lit("Nothing to say")).otherwise(body)
    return spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("report_id"), F.concat(F.lit("Bug in copy_"), F.col("user_id").cast("string")).alias("title"), body.alias("body"))


#: Of a report the claims it must give: kind, value, extractor, provenance, negated, role.
EXPECTED = (
    ("symbol", "copy_{k}", "symbols", "unscoped", False, "core"),
    ("version", "1.{k}.2", "versions", "project_attributed", False, "supporting"),
    ("line", "src/mod{k}/util.c:{n}", "paths.line", "project_attributed", False, "supporting"),
    ("file", "src/mod{k}/hdr.h", "paths.file", "project_attributed", False, "supporting"),
    ("file", "/usr/lib/x/base.c", "paths.file", "third_party", False, "supporting"),
    ("symbol", "check_{k}", "symbols", "unscoped", True, "supporting"),
    ("behavior", "check_{k}", "behavior", "project_attributed", False, "supporting"),
    ("option", "--size-{k}", "options.flag", "project_attributed", False, "supporting"),
    ("reference", "https://example.org/CVE-2024-{n}1111", "references.url", "unscoped", False, "peripheral"),
    ("reference", "CWE-787", "references.cwe", "unscoped", False, "peripheral"),
    ("reference", "CVE-2023-{n}2222", "references.cve", "unscoped", False, "peripheral"),
    ("symbol", "malloc", "symbols", "third_party", False, "peripheral"),
    ("symbol", "parse_head", "symbols", "unscoped", False, "supporting"),
    ("impact", "high", "impact.severity", "project_attributed", False, "peripheral"),
)


def extract_claims(spark, sf_dir):
    return claims.extract_claims(reports(spark, sf_dir)).select("report_id", "kind", "value", "extractor", "provenance", "negated", "role", F.size("spans").alias("n_spans"))


def claim_spans(spark, sf_dir):
    # the text stays with its report's claims: nothing is joined
    found = claims.read(reports(spark, sf_dir).withColumn("said", F.col("body")), claims.Reader()).where(F.size("claims") > 0)
    spans = F.flatten(F.transform("claims", lambda c: F.transform(c["spans"], lambda s: F.contains(F.substr("said", s["start"] + 1, s["end"] - s["start"]), c["value"]))))
    return found.select("report_id", spans.alias("spans")).select("report_id", F.size("spans").cast("long").alias("spans"), F.size(F.filter("spans", lambda x: x)).cast("long").alias("exact"))


#: What reports say of their target, by event_id % 10; the last two are told a version and a ref from outside.
SAYS = (
    "Tested on 1.3.0.",
    "It shows from 1.1.0 to 1.5.0.",
    "All is open in all versions before 1.4.0.",
    "It was fixed in 1.7.0.",
    "Seen at commit abcdef0123.",
    "Seen on master.",
    "Nothing.",
    "Tested on 1.3.0 and it affects 1.5.0.",
    "See https://github.com/o/r/blob/v1.2.0/a.c#L1, tested on 1.3.0.",
    "Tested on 1.3.0.",
)


def resolve_ladder(spark, sf_dir):
    i = F.col("event_id")
    body = F.get(F.array(*[F.lit(s) for s in SAYS]), (i % 10).cast("int"))
    rows = spread(table(spark, sf_dir, "events")).select(
        i.alias("report_id"), F.lit("r").alias("repo"), F.lit("t").alias("title"), body.alias("body"), F.when(i % 20 == 19, "v1.8.0").alias("ref"), F.when(i % 20 == 9, "1.9.0").alias("version"), (F.lit(1000) + i % 50).alias("epoch")
    )
    releases = spark.range(12).select(F.lit("r").alias("repo"), F.concat(F.lit("v1."), "id", F.lit(".0")).alias("name"), F.concat(F.lit("c"), "id").alias("commit"), F.col("id").alias("m")).withColumn("x", V.tag(F.col("name"))).select("repo", "name", "commit", "x.trimmed", "x.kind")
    commits = spark.range(1).select(F.lit("r").alias("repo"), F.lit("abcdef0123456789abcdef0123456789abcdef01").alias("sha"))
    tips = spark.range(10).select(F.lit("r").alias("repo"), F.lit("main").alias("branch"), (F.lit(1000) + F.col("id") * 10).alias("epoch"), F.concat(F.lit("t"), "id").alias("commit"))
    links = extraction.location_claims(rows).where("permalink IS NOT NULL").select("report_id", "permalink.ref", "start")
    found = targets.resolve(rows, extraction.version_claims(rows), links, releases, commits, tips)
    return found.select("report_id", "ref", "commit", "method", "confidence", F.array_join("alternatives", ",").alias("alternatives"))


def trace_claims(spark, sf_dir):
    """Symbols and files that a report's trace names, against claims that know no trace."""
    i, k = F.col("event_id"), F.col("user_id").cast("string")
    frames = F.concat(F.lit("==7==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x1\n    #0 0x1 in memcpy (/lib/libc.so+0x1)\n    #1 0x2 in zlib_"), k, F.lit(" /usr/lib/z.c:1:1\n    #2 0x3 in top_"), k, F.lit(" src/top.c:2:1\n    #3 0x4 in low_"), k, F.lit(" src/low.c:3:1\n"))
    rows = spread(table(spark, sf_dir, "events")).select(i.alias("report_id"), F.lit("t").alias("title"), F.concat(F.lit("One.\n\nHere `top_"), k, F.lit("` and `low_"), k, F.lit("` and `far_"), k, F.lit("` are named.\n\n```\n"), frames, F.lit("```\n")).alias("body"))
    return claims.extract_claims(rows, traced=True).select("report_id", "kind", "value", "provenance", "role")


def hygiene_missing(spark, sf_dir):
    rows = reports(spark, sf_dir)
    found = claims.hygiene(rows, claims.extract_claims(rows), rows.where("report_id % 7 = 0"), rows.where("report_id % 3 = 0"))
    return found.select("report_id", F.array_join("missing", ",").alias("missing"))


def foreign_repositories(spark, sf_dir):
    i = F.col("event_id")
    url = F.expr("CASE event_id % 6 WHEN 0 THEN 'https://github.com/Other/Lib.git' WHEN 1 THEN 'https://www.GitHub.com/o/R/issues/4' WHEN 2 THEN 'https://gitlab.com/fork/widget' WHEN 3 THEN 'https://github.com/f/x/commit/abcdef0' WHEN 4 THEN 'https://github.com/f/x/commit/0123456' ELSE '/srv/git/x' END")
    rows = table(spark, sf_dir, "events").select(i.alias("report_id"), F.concat(F.lit("c"), i).alias("claim_id"), url.alias("url"))
    homes = rows.select("report_id", F.when(F.col("report_id") % 5 == 0, "/local/repo").otherwise("https://github.com/o/r.git").alias("repo"), F.array(F.lit("widget"), F.lit("r")).alias("names"))
    commits = spark.range(1).select(F.lit("abcdef0123456789abcdef0123456789abcdef01").alias("sha"))
    return checks.c15_foreign_repositories(rows, homes, commits).select("report_id", "subject", "outcome_key", "outcome", "strength")


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(claims.sentences(F.col("text"))).alias("n"), F.get(claims.sentences(F.col("text")), F.lit(0)).alias("first"))


QUERIES = {f.__name__: f for f in (extract_claims, claim_spans, resolve_ladder, trace_claims, hygiene_missing, foreign_repositories, sentence_split)}


def _value(text: str) -> str:
    return "'" + text.replace("{k}", "' || user_id || '").replace("{n}", "' || (event_id % 300 + 1) || '") + "'"


ORACLE_SQL = {
    "extract_claims": " UNION ALL ".join(f"SELECT event_id AS report_id, '{k}' AS kind, {_value(v)} AS value, '{e}' AS extractor, '{p}' AS provenance, {str(n).lower()} AS negated, '{r}' AS role, 1 AS n_spans FROM events WHERE event_id % 10 <> 9" for k, v, e, p, n, r in EXPECTED),
    "claim_spans": f"SELECT event_id AS report_id, {len(EXPECTED)}::BIGINT AS spans, {len(EXPECTED)}::BIGINT AS exact FROM events WHERE event_id % 10 <> 9",
    "resolve_ladder": """SELECT event_id AS report_id, CASE WHEN event_id % 20 = 19 THEN 'v1.8.0' ELSE ['v1.3.0', 'v1.5.0', 'v1.3.0', 'v1.6.0', 'abcdef0123', 'main', NULL, 'v1.3.0', 'v1.2.0', 'v1.9.0'][event_id % 10 + 1] END AS ref,
 CASE WHEN event_id % 20 = 19 THEN 'c8' WHEN event_id % 10 = 5 THEN 't' || (event_id % 50 // 10) ELSE ['c3', 'c5', 'c3', 'c6', 'abcdef0123456789abcdef0123456789abcdef01', '', NULL, 'c3', 'c2', 'c9'][event_id % 10 + 1] END AS commit,
 CASE WHEN event_id % 20 = 19 THEN 'explicit_ref' ELSE ['tested_on', 'affected_range', 'affected_range', 'fixed_in', 'commit', 'branch', 'none', 'tested_on', 'permalink', 'explicit_version'][event_id % 10 + 1] END AS method,
 ['high', 'high', 'high', 'high', 'high', 'low', 'low', 'medium', 'high', 'high'][event_id % 10 + 1] AS confidence, CASE WHEN event_id % 10 = 7 THEN 'v1.5.0' ELSE '' END AS alternatives FROM events""",
    "trace_claims": "SELECT event_id AS report_id, 'symbol' AS kind, n || user_id AS value, CASE WHEN n = 'far_' THEN 'unscoped' ELSE 'project_attributed' END AS provenance, CASE WHEN n = 'top_' THEN 'core' ELSE 'supporting' END AS role FROM events, (VALUES ('top_'), ('low_'), ('far_')) t(n)",
    "hygiene_missing": "SELECT event_id AS report_id, array_to_string(list_filter([CASE WHEN event_id % 10 = 9 THEN 'version' END, CASE WHEN event_id % 3 <> 0 THEN 'poc' END, CASE WHEN event_id % 7 <> 0 THEN 'trace' END, CASE WHEN event_id % 10 = 9 THEN 'location' END], lambda x: x IS NOT NULL), ',') AS missing FROM events",
    "foreign_repositories": "SELECT event_id AS report_id, CASE event_id % 6 WHEN 0 THEN 'github.com/other/lib' ELSE 'github.com/f/x' END AS subject, 'foreign_repo' AS outcome_key, 'REFUTES' AS outcome, -0.3::DOUBLE AS strength FROM events WHERE event_id % 6 IN (0, 4) AND event_id % 5 <> 0",
    "sentence_split": "WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '\\n[ \\t\\n\\x0B\\f\\r]*\\n', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS l FROM documents) SELECT doc_id, len(l)::INTEGER AS n, l[1] AS first FROM d",
}
