"""Queries of the one claims table, and of checks that are fed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks, claims
from plumbline.plans import check_queries, history_queries
from plumbline.sources.tables import spread, table
from plumbline.staging import staged

#: The report of an event: {k} is its user, {m} a number from 3 to 9.
BODY = "Bug in `fn_{k}`.\n\n`fn_{k}` calls `low_{k}`. It shows from 1.2.0 to 1.{m}.0 here; getline() and tokenize() too.\n\nCode of src/a{k}.c:\n```c\nint part_{k}(int a)\n{\n  return a;\n}\n```\n\nRun:\n```sh\nhdrcat --fold-{k} x\n```\n\n```diff\n--- a/src/p{k}.c\n+++ b/src/p{k}.c\n@@ -1,2 +1,3 @@\n--- old_{k}\n+++ new_{k}\n x\n+y\n```\n\n```\n==7==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x1\n    #0 0x1 in fn_{k} src/a{k}.c:1:1\n```\n\nSee lib/b{k}.c, where the loop at line {m} runs."


def reports(spark, sf_dir) -> DataFrame:
    body = F.lit(BODY)
    for name, value in {"{k}": F.col("user_id").cast("string"), "{m}": (F.col("event_id") % 7 + 3).cast("string")}.items():
        body = F.replace(body, F.lit(name), value)
    return spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("report_id"), F.lit("A report").alias("title"), body.alias("body"))


def claims_table(spark, sf_dir):
    found = claims.claims_table(reports(spark, sf_dir), programs=["hdrcat"])
    return found.select("report_id", "kind", "value", "extractor", "provenance", "role", F.coalesce("details", F.lit("")).alias("details"))


def _said(spark, sf_dir) -> DataFrame:
    """Reports that a function of the project calls the next one, or the one after that, and of a range of releases."""
    n = table(spark, sf_dir, "documents").count()
    e = F.col("event_id")
    a, b = e % n, e % n + 1 + e % 2
    body = F.concat(F.lit("Bug in `fn_"), a, F.lit("`.\n\nThere `fn_"), a, F.lit("` calls `fn_"), b, F.lit("`. It shows from 1."), e % 10, F.lit(".0 to 1."), e % 13, F.lit(".0 in all."))
    return spread(table(spark, sf_dir, "events")).select(e.alias("report_id"), F.lit("A report").alias("title"), body.alias("body"))


def claims_to_checks(spark, sf_dir):
    """From texts to evidence: calls and affected ranges as reports tell them, against the project's functions and releases."""
    found = staged(claims.claims_table(_said(spark, sf_dir)))
    docs = table(spark, sf_dir, "documents")
    name = lambda x: F.concat(F.lit("fn_"), x)
    calls = docs.select(name(F.col("doc_id")).alias("caller"), name(F.col("doc_id") + 1).alias("callee"))
    functions = docs.select(name(F.col("doc_id")).alias("name"), (F.col("doc_id") % 13 != 0).alias("parsed"))
    api = checks.c18_api_usage(claims.said_calls(found), calls, functions)
    releases = check_queries.releases(spark).select(F.lit("r").alias("repo"), "ord", "trimmed")
    ranges = claims.affected_ranges(found).withColumn("repo", F.lit("r"))
    versions = checks.c16_affected_range(ranges, claims.core_symbols(found), history_queries._line(spark, sf_dir), releases)
    return checks.run_checks([api, versions]).select("report_id", "check_id", "subject", "outcome_key", "strength")


QUERIES = {f.__name__: f for f in (claims_table, claims_to_checks)}


def _value(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{k}", "' || user_id || '").replace("{m}", "' || (event_id % 7 + 3) || '") + "'"


_CODE = "int part_{k}(int a)\n{\n  return a;\n}"
#: kind, value, extractor, provenance, role, details.
EXPECTED = (
    ("symbol", "fn_{k}", "symbols", "project_attributed", "core", ""),
    ("symbol", "low_{k}", "symbols", "unscoped", "supporting", ""),
    ("symbol", "getline", "symbols", "third_party", "peripheral", ""),
    ("symbol", "tokenize", "symbols", "unscoped", "supporting", ""),
    ("symbol", "part_{k}", "snippets.defines", "project_attributed", "supporting", '{"block":0}'),
    ("behavior", "fn_{k} calls_api low_{k}", "behavior", "project_attributed", "core", '{"subject":"fn_{k}","predicate":"calls_api","object":"low_{k}"}'),
    ("version", "from 1.2.0 to 1.{m}.0", "versions", "project_attributed", "supporting", '{"relation":"affected_range","lower":"1.2.0","lower_inclusive":true,"upper":"1.{m}.0","upper_inclusive":true}'),
    ("file", "src/a{k}.c", "paths.file", "project_attributed", "core", ""),
    ("file", "lib/b{k}.c", "paths.file", "project_attributed", "supporting", ""),
    ("line", "lib/b{k}.c:{m}", "paths.line", "project_attributed", "supporting", ""),
    ("snippet", "md5", "snippets", "project_attributed", "supporting", '{"path":"src/a{k}.c","n_lines":4,"defines":["part_{k}"]}'),
    ("poc", "hdrcat --fold-{k} x", "pocs", "reporter_artifact", "supporting", '{"poc_kind":"cli"}'),
    ("option", "--fold-{k}", "options", "project_attributed", "supporting", '{"option_kind":"flag"}'),
    ("patch", "src/p{k}.c", "patches", "project_attributed", "supporting", '{"files":["src/p{k}.c"],"n_hunks":1}'),
    ("trace", "asan:heap-buffer-overflow:1", "traces", "unscoped", "supporting", '{"format":"asan","bug_type":"heap-buffer-overflow","frames":1}'),
)
_N = "n AS (SELECT count(*) AS n FROM documents)"

ORACLE_SQL = {
    "claims_table": " UNION ALL ".join(
        f"SELECT event_id AS report_id, '{kind}' AS kind, {'md5(' + _value(_CODE) + ')' if value == 'md5' else _value(value)} AS value, '{extractor}' AS extractor, '{provenance}' AS provenance, '{role}' AS role, {_value(details)} AS details FROM events" for kind, value, extractor, provenance, role, details in EXPECTED
    ),
    "claims_to_checks": f"""WITH {_N}, e AS (SELECT event_id AS report_id, event_id % n AS a, event_id % n + 1 + event_id % 2 AS b, event_id % 10 AS lo, event_id % 13 AS hi FROM events, n),
 c AS (SELECT report_id, 'C18' AS check_id, 'fn_' || a AS subject, CASE WHEN b = a + 1 THEN 'calls_api' WHEN a % 13 = 0 THEN 'parse_incomplete' ELSE 'does_not_call_api' END AS outcome_key FROM e),
 v AS (SELECT report_id, 'C16' AS check_id, 'fn_' || a AS subject, CASE WHEN lo >= a % 12 THEN 'consistent' WHEN a % 5 = 0 AND lo <= a % 12 - 1 THEN 'partial_history' ELSE 'range_predates_symbol' END AS outcome_key FROM e WHERE lo <= hi),
 u AS (SELECT * FROM c UNION ALL SELECT * FROM v) SELECT *, (CASE outcome_key WHEN 'calls_api' THEN 0.8 WHEN 'does_not_call_api' THEN -1.2 WHEN 'consistent' THEN 0.3 WHEN 'range_predates_symbol' THEN -1.0 ELSE 0 END)::DOUBLE AS strength FROM u""",
}
