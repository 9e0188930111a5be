"""Queries of sources: records and Markdown made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.sources import reports
from plumbline.sources.tables import table

MARKDOWN = "concat('# Title ', event_id, chr(10), 'intro', chr(10), '```', CASE event_id % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'c' ELSE '' END, chr(10), CASE event_id % 3 WHEN 1 THEN 'int x;' WHEN 2 THEN '$ ./run' ELSE '-a' END, chr(10), 'l', event_id % 9, chr(10), CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('```', chr(10), 'after', chr(10)) END, CASE WHEN event_id % 4 = 1 THEN concat('~~~sh', chr(10), 'id', chr(10), '~~~', chr(10)) ELSE '' END)"


def markdown_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.expr(MARKDOWN).alias("body"))
    return reports.fenced_blocks(rows).select("report_id", "block", "info", "content", "role")


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(reports.html_text(F.col("html"))).alias("n_chars"))


_JSON = """concat('{{"cveMetadata":{{"cveId":"CVE-2024-', {i}, '","state":"', CASE WHEN {i} % 9 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END, '","datePublished":"2024-03-0', {i} % 9 + 1, 'T00:00:00Z"}},"containers":{{"cna":{{"title":"T', {i}, '","descriptions":[{{"lang":"en","value":"D"}}],"affected":[{{"product":"P', {i} % 5, '","versions":[{{"version":"1.0","status":"affected","lessThan":"2.', {i} % 4, '","changes":[{{"at":"1.', {i} % 3 + 1, '","status":"unaffected"}}]}},{{"version":"3.0","status":', CASE WHEN {i} % 2 = 0 THEN '"affected"' ELSE '"unaffected"' END, '}},{{"version":"4","status":"affected","lessThanOrEqual":"4.', {i} % 6, '"}}]}}],"metrics":[{{"cvssV3_1":{{"vectorString":"V","baseScore":5.0}}}}]}}}}}}')"""
CVE_JSON = _JSON.format(i="event_id")


def _records(spark, sf_dir):
    broken = F.expr(f"CASE WHEN event_id % 50 = 7 THEN '{{\"cveMetadata\": [1]}}' WHEN event_id % 50 = 8 THEN 'no json' ELSE {CVE_JSON} END")
    return reports.cve_records(table(spark, sf_dir, "events").select(broken.alias("json")))


def cve_records(spark, sf_dir):
    return _records(spark, sf_dir).select("cve_id", "state", "published", "title", "description", "vector")


def cve_ranges(spark, sf_dir):
    return reports.cve_ranges(_records(spark, sf_dir))


def mention_windows(spark, sf_dir):
    """Events by hour, as the stream of reports counts them."""
    from plumbline.streaming.reports import mentions_by_hour

    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("see CVE-2024-1234 "), F.when(F.col("event_id") % 2 == 0, "and CVE-2023-99999").otherwise("")).alias("body"))
    return mentions_by_hour(rows)


QUERIES = {f.__name__: f for f in (markdown_blocks, html_to_text, cve_records, cve_ranges, mention_windows)}

_OK = "event_id % 50 NOT IN (7, 8)"

ORACLE_SQL = {
    "markdown_blocks": """SELECT event_id AS report_id, 0 AS block, ['diff', 'c', ''][event_id % 3 + 1] AS info, ['-a', 'int x;', '$ ./run'][event_id % 3 + 1] || chr(10) || 'l' || event_id % 9 AS content, ['patch', 'snippet', 'poc'][event_id % 3 + 1] AS role FROM events
 UNION ALL SELECT event_id, 1, 'sh', 'id', 'poc' FROM events WHERE event_id % 4 = 1""",
    "cve_records": f"SELECT 'CVE-2024-' || event_id AS cve_id, CASE WHEN event_id % 9 = 0 THEN 'REJECTED' ELSE 'PUBLISHED' END AS state, make_date(2024, 3, (event_id % 9 + 1)::INTEGER) AS published, 'T' || event_id AS title, 'D' AS description, 'V' AS vector FROM events WHERE {_OK}",
    "cve_ranges": f"""SELECT 'CVE-2024-' || event_id AS cve_id, 'P' || event_id % 5 AS product, '1.0' AS lower, '1.' || (event_id % 3 + 1) AS upper, false AS inclusive FROM events WHERE {_OK}
 UNION ALL SELECT 'CVE-2024-' || event_id, 'P' || event_id % 5, '3.0', '3.0', true FROM events WHERE {_OK} AND event_id % 2 = 0 UNION ALL SELECT 'CVE-2024-' || event_id, 'P' || event_id % 5, '4', '4.' || event_id % 6, true FROM events WHERE {_OK}""",
    "mention_windows": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS reports, sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS mentions FROM events GROUP BY 1, 2",
}
