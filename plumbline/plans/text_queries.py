"""Queries of text functions, extraction and spans over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import spans
from plumbline.sources.tables import table

DIRTY = "concat(text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(13), chr(10), 'end', chr(13), chr(7)) ELSE chr(10) END)"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_normalize(spark, sf_dir):
    dirty = _docs(spark, sf_dir).select("doc_id", F.expr(DIRTY).alias("text"))
    clean = T.normalized(F.col("text"))
    return dirty.select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).alias("n"))


def text_truncate(spark, sf_dir):
    part = T.truncated(F.col("text"), 500)
    return _docs(spark, sf_dir).select("doc_id", F.md5(part["body"].cast("binary")).alias("digest"), part["cut"].alias("cut"))


def first_line_title(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.title_of(F.concat(F.lit("  \n \n"), F.col("text"))).alias("title"))


def line_explode(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))


def line_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.line_count(F.concat("text", F.lit("\n"))).alias("n_lines"))


def ws_collapse(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapsed(F.col("text")).cast("binary")).alias("digest"))


def stable_id(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.stable_id("report", F.col("text")).alias("id"))


def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws("/", "p_name", "p_brand", "p_type")).alias("slug"))


def name_parts(spark, sf_dir):
    name = F.concat(F.initcap("p_name"), F.lit("_"), F.lower("p_type"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.name_parts(F.regexp_replace(name, " ", "")), ",").alias("parts"))


def name_jaccard(spark, sf_dir):
    a, b = T.name_parts(F.col("p_name")), T.name_parts(F.concat(F.lit("red_"), F.col("p_type"), F.lit("Widget")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"))


def bare_function(spark, sf_dir):
    name = F.concat(F.lit("ns::"), F.regexp_replace("p_name", " ", "::"), F.lit("<int>::"), F.lower("p_type"), F.lit("(char const*, int) const"))
    return table(spark, sf_dir, "part").select("p_partkey", T.bare_function(name).alias("name"))


def path_components(spark, sf_dir):
    path = F.concat(F.lit("C:\\src\\.\\"), F.regexp_replace("url", "^https?://", ""), F.lit("/a/../b"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_parts(path), "|").alias("parts"))


def split_location(spark, sf_dir):
    text = F.concat(F.regexp_replace("url", "[?].*$", ""), F.lit(":"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(":"), (F.col("page_id") % 80).cast("string"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", T.located(text).alias("x")).select("page_id", "x.path", "x.line", "x.col")


def canonical_url(spark, sf_dir):
    url = F.concat(F.lit("HTTPS://user@"), F.upper(F.regexp_extract("url", "^https?://([^/]*)", 1)), F.regexp_replace("url", "^https?://[^/]*", ""))
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(url).alias("url"))


KINDS = "CASE page_id % 7 WHEN 0 THEN '/o/r/commit/0a1b2c3d4e' WHEN 1 THEN '/o/r/pull/12' WHEN 2 THEN '/o/r/issues/7' WHEN 3 THEN '/o/r/security/advisories/x' WHEN 4 THEN '/vuln/CVE-2024-12345' WHEN 5 THEN '/o/r/blob/main/a.c' ELSE '/x' END"


def classify_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), F.expr(KINDS)).alias("url"))
    return pages.select("page_id", T.url_kind(F.col("url")).alias("kind"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escaped_html(F.col("html")).cast("binary")).alias("digest"))


def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def html_drop_script(spark, sf_dir):
    bare = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.collapsed(F.regexp_replace(bare, "<[^>]*>", " ")).cast("binary")).alias("digest"))


ROLE_TEXT = "CASE event_id % 6 WHEN 0 THEN 'Traceback (most recent call last):' WHEN 1 THEN concat('--- a/x', chr(10), '+++ b/x') WHEN 2 THEN '$ ./run' WHEN 3 THEN '2024-01-01 10:00:00 start' WHEN 4 THEN '    #0 0x1 in f a.c:1' ELSE 'int x;' END"


def block_roles(spark, sf_dir):
    info = F.when(F.col("event_id") % 10 == 0, "diff").when(F.col("event_id") % 10 == 1, "bash").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", info.alias("info"), F.expr(ROLE_TEXT).alias("content")).select("event_id", T.block_role(F.col("info"), F.col("content")).alias("role"))


PATHS = "CASE event_id % 8 WHEN 0 THEN 'src/a.c' WHEN 1 THEN '/usr/include/x.h' WHEN 2 THEN '/home/u/p/x.py' WHEN 3 THEN 'poc.c' WHEN 4 THEN 'Node.js' WHEN 5 THEN 'a b.c' WHEN 6 THEN 'README' ELSE '/tmp/t/crash-1.txt' END"


def path_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(PATHS).alias("path"))
    return rows.select("event_id", T.is_path_candidate(F.col("path")).alias("candidate"), T.path_owner(F.col("path")).alias("owner"), T.language_of(F.col("path")).alias("language"))


def negation_window(spark, sf_dir):
    before = F.expr("CASE event_id % 5 WHEN 0 THEN 'this is not ' WHEN 1 THEN 'never seen; then ' WHEN 2 THEN 'calls ' WHEN 3 THEN 'without any ' ELSE '' END")
    after = F.expr("CASE event_id % 3 WHEN 0 THEN ' is not called' WHEN 1 THEN ' is called' ELSE '' END")
    return table(spark, sf_dir, "events").select("event_id", before.alias("b"), after.alias("a")).select("event_id", T.is_negated(F.col("b"), F.col("a")).alias("negated"))


def number_spans(spark, sf_dir):
    found = spans.matches(F.col("text"), "[0-9]+(?:[.-][0-9]+)++")
    return _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.start", "m.end", "m.text")


# spans: every event lasts some minutes of its user's time


def _intervals(spark, sf_dir) -> DataFrame:
    minute = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", minute.alias("start"), (minute + F.col("event_id") % 120).alias("end"))


INTERVALS = "i AS (SELECT event_id, user_id, event_type, floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / 60)::BIGINT AS start, floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / 60)::BIGINT + event_id % 120 AS \"end\" FROM events)"
MERGED = f"""{INTERVALS}, r AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r),
 m AS (SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY user_id, island)"""


def interval_merge(spark, sf_dir):
    return spans.merged(_intervals(spark, sf_dir), ["user_id"])


def interval_gaps(spark, sf_dir):
    return spans.gaps(_intervals(spark, sf_dir), ["user_id"])


def interval_outside(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    return spans.outside(rows, rows.select("user_id").distinct().withColumn("length", F.lit(43200)), ["user_id"])


def interval_overlap_join(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    a = rows.where("event_type = 'click'").withColumnRenamed("event_id", "left_id")
    b = rows.where("event_type = 'purchase'").withColumnRenamed("event_id", "right_id")
    return spans.overlapping(a, b, ["user_id"], 240).select("left_id", "right_id")


def anti_contained(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    return spans.not_contained(rows.where("event_type = 'error'"), rows.where("event_type = 'view'"), ["user_id"])


def drop_overlaps(spark, sf_dir):
    return spans.no_overlaps(_intervals(spark, sf_dir).where("event_type = 'signup'").select("user_id", "start", "end").distinct(), ["user_id"])


def densest_cluster(spark, sf_dir):
    return spans.densest(_intervals(spark, sf_dir), ["user_id"], "start", 300)


QUERIES = {f.__name__: f for f in (text_normalize, text_truncate, first_line_title, line_explode, line_count, ws_collapse, stable_id, slug, name_parts, name_jaccard, bare_function, path_components, split_location, canonical_url, classify_url, html_escape, html_title, html_links, html_drop_script, block_roles, path_roles, negation_window, number_spans, interval_merge, interval_gaps, interval_outside, interval_overlap_join, anti_contained, drop_overlaps, densest_cluster)}

_PART_SET = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x))))"

ORACLE_SQL = {
    "text_normalize": f"WITH d AS (SELECT doc_id, regexp_replace(regexp_replace({DIRTY}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{{FEFF}}]', '', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t)::INTEGER AS n FROM d",
    "text_truncate": "SELECT doc_id, md5(substr(text, 1, 500)) AS digest, length(text) > 500 AS cut FROM documents",
    "first_line_title": "SELECT doc_id, substr(trim(list_filter(string_split('  ' || chr(10) || ' ' || chr(10) || text, chr(10)), lambda x: trim(x) <> '')[1]), 1, 200) AS title FROM documents",
    "line_explode": "WITH d AS (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents) SELECT doc_id, (unnest(range(len(l))))::INTEGER AS line_no, unnest(l) AS line FROM d",
    "line_count": "SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines FROM documents",
    "ws_collapse": "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM documents",
    "stable_id": "SELECT doc_id, substr(sha256('report' || chr(0) || text), 1, 12) AS id FROM documents",
    "slug": "SELECT p_partkey, regexp_replace(lower(p_name || '/' || p_brand || '/' || p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part",
    "name_parts": f"WITH p AS (SELECT p_partkey, replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '_' || lower(p_type) || p_size::VARCHAR, ' ', '') AS n FROM part) SELECT p_partkey, array_to_string({_PART_SET.format('n')}, ',') AS parts FROM p",
    "name_jaccard": f"WITH p AS (SELECT p_partkey, {_PART_SET.format('p_name')} AS a, {_PART_SET.format(chr(39) + 'red_' + chr(39) + ' || p_type || ' + chr(39) + 'Widget' + chr(39))} AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM p",
    "bare_function": "SELECT p_partkey, lower(p_type) AS name FROM part",
    "path_components": "SELECT page_id, 'src|' || array_to_string(list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '' AND x <> '.'), '|') || '|b' AS parts FROM pages",
    "split_location": "SELECT page_id, regexp_replace(url, '[?].*$', '') AS path, page_id::INTEGER AS line, CASE WHEN page_id % 2 = 0 THEN (page_id % 80)::INTEGER END AS col FROM pages",
    "canonical_url": "SELECT page_id, 'https://' || lower(regexp_extract(url, '^https?://([^/]*)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/+$', '') AS url FROM pages",
    "classify_url": "SELECT page_id, ['commit', 'pull', 'issue', 'advisory', 'cve', 'file', 'url'][page_id % 7 + 1] AS kind FROM pages",
    "html_escape": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages",
    "html_title": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "html_links": "WITH p AS (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, (unnest(range(len(l))))::INTEGER AS pos, unnest(l) AS href FROM p",
    "html_drop_script": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM pages",
    "block_roles": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'patch' WHEN event_id % 10 = 1 THEN 'poc' ELSE ['trace', 'patch', 'poc', 'log', 'trace', 'snippet'][event_id % 6 + 1] END AS role FROM events",
    "path_roles": "SELECT event_id, [true, true, true, true, false, false, false, true][event_id % 8 + 1] AS candidate, ['project_attributed', 'third_party', 'unscoped', 'project_attributed', 'project_attributed', 'project_attributed', 'project_attributed', 'reporter_artifact'][event_id % 8 + 1] AS owner, ['c', 'c', 'python', 'c', 'javascript', 'c', NULL, NULL][event_id % 8 + 1] AS language FROM events",
    "negation_window": "SELECT event_id, event_id % 5 IN (0, 3) OR event_id % 3 = 0 AS negated FROM events",
    "number_spans": """WITH d AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:[.-][0-9]+)+') AS m, regexp_split_to_array(text, '[0-9]+(?:[.-][0-9]+)+') AS p FROM documents),
 e AS (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS k FROM d), s AS (SELECT doc_id, m[k] AS text, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS start FROM e)
 SELECT doc_id, start::INTEGER AS start, (start + length(text))::INTEGER AS "end", text FROM s""",
    "interval_merge": f"WITH {MERGED} SELECT * FROM m",
    "interval_gaps": f"WITH {MERGED} SELECT * FROM (SELECT user_id, \"end\" AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS \"end\" FROM m) WHERE \"end\" IS NOT NULL",
    "interval_outside": f"""WITH {INTERVALS.replace('i AS', 'i0 AS')}, i AS (SELECT user_id, start, "end" FROM i0 UNION ALL SELECT DISTINCT user_id, 0, 0 FROM i0 UNION ALL SELECT DISTINCT user_id, 43200, 43200 FROM i0), {MERGED[len(INTERVALS) + 2:]}
 SELECT * FROM (SELECT user_id, "end" AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM m) WHERE "end" > start""",
    "interval_overlap_join": f"WITH {INTERVALS} SELECT a.event_id AS left_id, b.event_id AS right_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.start < b.\"end\" AND b.start < a.\"end\" AND a.\"end\" > a.start AND b.\"end\" > b.start WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "anti_contained": f"WITH {MERGED.replace('FROM i)', 'FROM i WHERE event_type = ' + chr(39) + 'view' + chr(39) + ')')} SELECT user_id, start, \"end\" FROM i WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = i.user_id AND m.start <= i.start AND i.\"end\" <= m.\"end\")",
    "drop_overlaps": f"WITH {INTERVALS}, s AS (SELECT DISTINCT user_id, start, \"end\" FROM i WHERE event_type = 'signup'), r AS (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT user_id, start, \"end\" FROM r WHERE reach IS NULL OR start >= reach",
    "densest_cluster": f"""WITH {INTERVALS}, l AS (SELECT user_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY user_id ORDER BY start) <= 300 THEN 0 ELSE 1 END AS new FROM i),
 g AS (SELECT user_id, start, sum(new) OVER (PARTITION BY user_id ORDER BY start, new DESC ROWS UNBOUNDED PRECEDING) AS run FROM l), c AS (SELECT user_id, min(start) AS first, max(start) AS last, count(*) AS n FROM g GROUP BY user_id, run)
 SELECT user_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM c) WHERE k = 1""",
}
