"""Queries of histories and releases: orders are commits, documents a project's functions, parts its files, events reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import checks, history, joins, options, series, spans, traces
from plumbline.plans import check_queries
from plumbline.sources.tables import spread, table


def commits(spark, sf_dir) -> DataFrame:
    """A customer's orders follow each other; every fourth order also merges the latest order of the next customer that is older than it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    first = rows.select(F.col("o_orderkey").alias("commit"), F.lag("o_orderkey").over(by).alias("parent"))
    merging = rows.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("commit"), F.col("o_orderkey").alias("at"), (F.col("o_custkey") + 1).alias("of"))
    other = rows.select(F.col("o_custkey").alias("of"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("merged"))
    merges = joins.as_of(merging, other.groupBy("of", "at").agg(F.max("merged").alias("merged")), ["of"], "at", "merged", strictly=True)
    return first.unionByName(merges.where("merged IS NOT NULL").select("commit", F.col("merged").alias("parent")))


def commit_ancestors(spark, sf_dir):
    """Of every order: itself, the key before it, half its key, one that is not there, and its customer's third order before it."""
    rows = table(spark, sf_dir, "orders")
    asked = rows.select(F.col("o_orderkey").alias("newer"), F.explode(F.array(F.col("o_orderkey") - 1, F.floor(F.col("o_orderkey") / 2), F.lit(-1).cast("long"), F.col("o_orderkey"))).alias("older"))
    near = rows.select("o_custkey", "o_orderkey").withColumn("older", F.lag("o_orderkey", 3).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("older IS NOT NULL")
    return history.ancestors(commits(spark, sf_dir), asked.unionByName(near.select(F.col("o_orderkey").alias("newer"), "older")))


def commit_segments(spark, sf_dir):
    found = history.segments(commits(spark, sf_dir))
    return found.groupBy("segment").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max("commit").alias("newest"))


def greedy_spans(spark, sf_dir):
    """Items of an order as spans; the longest stay, then those that overlap none of them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90).alias("start"), (F.col("l_partkey") % 90 + F.col("l_quantity").cast("long") % 30).alias("end")).distinct()
    return spans.longest_first(rows, ["l_orderkey"])


def trace_overlaps(spark, sf_dir):
    """A report that holds a sanitizer's trace with lines that look like a debugger's and a script's within."""
    k = F.col("user_id").cast("string")
    asan = F.concat(F.lit("==7==ERROR: AddressSanitizer: heap-buffer-overflow on address 0x1\n    #0 0x1 in f"), k, F.lit(" src/a.c:1:1\nProgram received signal SIGSEGV, fault.\n#0  0x2 in g (x) at src/b.c:2\n    #1 0x3 in h src/c.c:3:1\n    #2 0x3 in i src/c.c:4:1"))
    python = F.lit("\n\nTraceback (most recent call last):\n  File \"a.py\", line 3, in f\n    f()\nValueError: x\n")
    text = F.when(F.col("event_id") % 3 == 0, asan).when(F.col("event_id") % 3 == 1, F.concat(asan, python)).otherwise(F.concat(F.lit("Text."), python))
    rows = spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("report_id"), text.alias("body"))
    return traces.resolved(traces.extents(traces.trace_lines(rows)))


TREE = "concat('m', p_partkey % 7, '/', CASE WHEN p_partkey % 3 = 0 THEN 'src/' ELSE '' END, 'f', p_partkey % 40, '.c')"
CITED = """CASE p_partkey % 6 WHEN 0 THEN {t} WHEN 1 THEN concat('/home/a/', {t}) WHEN 2 THEN concat('f', p_partkey % 40, '.c') WHEN 3 THEN concat('x/f', p_partkey % 50, '.c')
 WHEN 4 THEN concat('b/../src/f', p_partkey % 40, '.c') ELSE concat('none', p_partkey, '.c') END"""


def path_resolution(spark, sf_dir):
    """Paths as they are written, by suffix, and where several fit those of files with an even number of parts."""
    part = table(spark, sf_dir, "part")
    tree = part.select(F.expr(TREE).alias("path"))
    cited = part.select(F.expr(CITED.format(t=TREE)).alias("cited"))
    even = tree.groupBy("path").count().where("count % 2 = 0").select("path")
    found = joins.suffix_join(cited, tree).join(even, "path").select("cited", "path")
    return joins.resolve_paths(cited, tree, found)


def _cores(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.explode(F.array(F.col("event_id") % n, (F.col("event_id") * 7 + 3) % (n + 5))).alias("d"))
    return rows.select("report_id", F.concat(F.lit("fn_"), "d").alias("symbol")).where("report_id % 11 <> 0 OR symbol LIKE '%1'")


def _line(spark, sf_dir) -> DataFrame:
    """A function is there from release doc_id % 12 on; of every fifth the release before could not be read."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("fn_"), "doc_id").alias("symbol"), (F.col("doc_id") % 12).cast("int").alias("from"), F.col("doc_id"))
    held = docs.select("symbol", F.explode(F.sequence("from", F.lit(11))).alias("ord"), F.lit(True).alias("defines"), F.lit(True).alias("parsed"))
    partial = docs.where("doc_id % 5 = 0 AND from > 0").select("symbol", (F.col("from") - 1).alias("ord"), F.lit(False).alias("defines"), F.lit(False).alias("parsed"))
    return series.timeline(spark.range(12).select(F.col("id").cast("int").alias("ord")), held.unionByName(partial))


def _ranges(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    number = lambda x: F.array(F.lit(1), x.cast("int"))
    return table(spark, sf_dir, "events").select(
        e.alias("report_id"),
        F.lit("r").alias("repo"),
        F.concat(F.lit("c"), e).alias("claim_id"),
        F.when(e % 4 != 0, number(e % 10)).alias("lower"),
        (e % 3 != 0).alias("lower_inclusive"),
        F.when(e % 5 != 0, number(e % 13)).alias("upper"),
        (e % 2 == 0).alias("upper_inclusive"),
    )


def _releases(spark) -> DataFrame:
    return spark.range(12).select(F.lit("r").alias("repo"), F.col("id").cast("int").alias("ord"), F.array(F.lit(1), F.col("id").cast("int")).alias("trimmed"))


def range_first(spark, sf_dir):
    return series.covered(_ranges(spark, sf_dir), _releases(spark), ["repo"]).select("report_id", "first")


def c16_affected_range(spark, sf_dir):
    found = checks.c16_affected_range(_ranges(spark, sf_dir), _cores(spark, sf_dir), _line(spark, sf_dir), _releases(spark))
    return found.select("report_id", "subject", "outcome_key", "outcome", "strength")


def c16_fixed_lineage(spark, sf_dir):
    """Fixes of functions that change every third release; each fourth release stands on another branch."""
    n = table(spark, sf_dir, "documents").count()
    graph = spark.range(12).select(F.concat(F.lit("c"), "id").alias("commit"), F.when(F.col("id") % 4 == 3, F.concat(F.lit("c"), F.col("id") - 2)).when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    asked = spark.range(1, 12).select(F.concat(F.lit("c"), F.col("id") - 1).alias("older"), F.concat(F.lit("c"), "id").alias("newer"))
    lineage = history.ancestors(graph, asked).select(F.substring("newer", 2, 9).cast("long").alias("ord"), F.col("ancestor").alias("linear"))
    fixes = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("fn_"), F.col("event_id") % n).alias("subject"), F.array(F.lit("c")).alias("claim_ids"), (F.col("event_id") % 11 + 1).alias("fixed"))
    digests = table(spark, sf_dir, "documents").select(F.concat(F.lit("fn_"), "doc_id").alias("symbol"), F.col("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("ord"))
    digests = digests.select("symbol", "ord", F.concat(F.lit("d"), F.floor((F.col("ord") + F.col("doc_id")) / 3)).alias("digest"))
    return checks.c16_fixed_in(fixes, digests, lineage).select("report_id", "subject", "outcome_key", "outcome", "strength")


RADIUS, USABLE, MOST = 2, 0.8, 12


def outward_scan(spark, sf_dir):
    """From the middle of each customer's orders outwards, the best by a share of their price."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("ord", F.row_number().over(by).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))
    fits = rows.select("o_custkey", "ord", F.when(F.col("o_orderkey") % 5 != 0, F.round((F.col("o_orderkey") * 7 % 100) / 115.0, 4)).alias("ratio"))
    return series.outward(fits, rows.select("o_custkey", F.floor((F.col("n") + 1) / 2).alias("home")).distinct(), ["o_custkey"], RADIUS, USABLE, MOST)


OPTION_LINES = """filter(array(concat('opt --size-', p_partkey % 50, '-x is read'), concat('static int max_lines_', p_partkey % 40, ';'), concat('[server_', p_partkey % 30, '] port_', p_partkey % 30, ' = 1'),
 CASE WHEN p_partkey % 4 = 0 THEN concat('#define LIMIT_', p_partkey % 20, ' 1') END), x -> x IS NOT NULL)"""
OPTION_CLAIMS = """CASE event_id % 8 WHEN 0 THEN concat('--size-', event_id % 61) WHEN 1 THEN concat('--max-lines-', event_id % 61) WHEN 2 THEN concat('server_', event_id % 40, '.port_', event_id % 40) WHEN 3 THEN concat('LIMIT_', event_id % 30)
 WHEN 4 THEN concat('--gone-', event_id % 9) WHEN 5 THEN concat('--SIZE-', event_id % 61) WHEN 6 THEN concat('LIM_', event_id % 9) ELSE concat('--size-', event_id % 61, '-x') END"""
OPTION_PATH = "CASE WHEN p_partkey % 4 = 0 THEN 'src/config.h' WHEN p_partkey % 5 = 0 THEN concat('docs/p', p_partkey, '.md') ELSE concat('src/p', p_partkey, '.c') END"


def c14_options(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    tree = part.select(F.concat(F.lit("v1."), F.col("p_partkey") % 6, F.lit(".0")).alias("release"), F.expr(OPTION_PATH).alias("path"), F.col("p_partkey").alias("blob"), (F.col("p_partkey") % 4 == 0).alias("generated"))
    lines = part.select(F.col("p_partkey").alias("blob"), F.posexplode(F.expr(OPTION_LINES)).alias("line_no", "line"))
    past = table(spark, sf_dir, "supplier").select(F.concat(F.lit("uses --gone-"), F.col("s_suppkey") % 5).alias("line"))
    found = options.c14_options(check_queries.claims(spark, sf_dir, "option", OPTION_CLAIMS), check_queries.targets(spark, sf_dir), tree, lines, past)
    return found.select("report_id", "subject", "outcome_key", "outcome", "strength")


def doc_paths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.expr("CASE p_partkey % 8 WHEN 0 THEN concat('Docs/a', p_partkey, '.c') WHEN 1 THEN concat('src/a', p_partkey, '.MD') WHEN 2 THEN 'README' WHEN 3 THEN 'x/ChangeLog.old' WHEN 4 THEN concat('man/man1/a.', p_partkey % 9) WHEN 5 THEN 'src/news.c' WHEN 6 THEN '.md' ELSE concat('src/document', p_partkey, '.c') END").alias("path"))
    return rows.groupBy("path").agg(F.first(options.is_doc(F.col("path"))).alias("doc"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (commit_ancestors, commit_segments, greedy_spans, trace_overlaps, path_resolution, range_first, c16_affected_range, c16_fixed_lineage, outward_scan, c14_options, doc_paths)}

_COMMITS = """f AS (SELECT o_orderkey AS "commit", lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders),
 g AS (SELECT a.o_orderkey AS "commit", max(b.o_orderkey) AS parent FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey + 1 AND b.o_orderkey < a.o_orderkey WHERE a.o_orderkey % 4 = 0 GROUP BY 1),
 c AS (SELECT DISTINCT * FROM (SELECT * FROM f UNION ALL SELECT * FROM g))"""
_Q = """q AS (SELECT DISTINCT newer, older FROM (SELECT o_orderkey AS newer, unnest([o_orderkey - 1, o_orderkey // 2, -1, o_orderkey]) AS older FROM orders
 UNION ALL SELECT newer, older FROM (SELECT o_orderkey AS newer, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS older FROM orders) WHERE older IS NOT NULL))"""


def _scored(check: str, key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in checks.STRENGTHS[check].items())
    return f"(CASE {key} {cases} ELSE 0 END)::DOUBLE"


_TREE, _CITED = TREE, CITED.format(t=TREE)
_PARTS = "list_reduce(list_concat([[]::VARCHAR[]], list_transform(list_filter(string_split({0}, '/'), lambda x: x NOT IN ('', '.')), lambda x: [x])), lambda a, x: CASE WHEN x = ['..'] THEN a[1:len(a) - 1] ELSE list_concat(a, x) END)"

ORACLE_SQL = {
    "commit_ancestors": f"""WITH RECURSIVE {_COMMITS}, {_Q}, k AS (SELECT DISTINCT "commit" FROM c),
 r(newer, older, seen) AS (SELECT newer, older, newer FROM q UNION SELECT r.newer, r.older, c.parent FROM r JOIN c ON c."commit" = r.seen WHERE c.parent >= r.older)
 SELECT q.older, q.newer, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k."commit" = q.older) THEN EXISTS (SELECT 1 FROM r WHERE r.newer = q.newer AND r.older = q.older AND r.seen = q.older) END AS ancestor FROM q""",
    "commit_segments": f"""WITH RECURSIVE {_COMMITS}, e AS (SELECT * FROM c WHERE parent IS NOT NULL), p1 AS (SELECT "commit" FROM e GROUP BY 1 HAVING count(*) = 1), c1 AS (SELECT parent FROM e GROUP BY 1 HAVING count(*) = 1),
 s AS (SELECT e.* FROM e SEMI JOIN p1 ON p1."commit" = e."commit" SEMI JOIN c1 ON c1.parent = e.parent),
 r("commit", segment, place) AS (SELECT DISTINCT "commit", "commit", 0::BIGINT FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s."commit" = c."commit") UNION ALL SELECT s."commit", r.segment, r.place + 1 FROM r JOIN s ON s.parent = r."commit")
 SELECT segment, count(*) AS n, max(place) AS last, max("commit") AS newest FROM r GROUP BY segment""",
    "greedy_spans": """WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey, l_partkey % 90 AS "start", l_partkey % 90 + l_quantity::BIGINT % 30 AS "end" FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY "start" - "end", "start", "end") AS k FROM d),
 r(l_orderkey, k, taken, fresh) AS (SELECT l_orderkey, 1::BIGINT, [{'s': "start", 'e': "end"}], true FROM o WHERE k = 1
 UNION ALL SELECT o.l_orderkey, o.k, CASE WHEN x THEN r.taken ELSE list_append(r.taken, {'s': o."start", 'e': o."end"}) END, NOT x
 FROM (SELECT r.*, o.k AS nk, len(list_filter(r.taken, lambda y: y.s < greatest(o."end", o."start" + 1) AND o."start" < greatest(y.e, y.s + 1))) > 0 AS x FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.k + 1) r JOIN o ON o.l_orderkey = r.l_orderkey AND o.k = r.nk)
 SELECT o.l_orderkey, o."start", o."end" FROM o JOIN r USING (l_orderkey, k) WHERE fresh""",
    "trace_overlaps": """SELECT event_id AS report_id, 'asan' AS format, 0::BIGINT AS "start", 6::BIGINT AS "end" FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, 'python', CASE WHEN event_id % 3 = 1 THEN 7 ELSE 2 END, CASE WHEN event_id % 3 = 1 THEN 9 ELSE 4 END FROM events WHERE event_id % 3 <> 0""",
    "path_resolution": f"""WITH t AS (SELECT {_TREE} AS path, count(*) % 2 = 0 AS even FROM part GROUP BY 1), c AS (SELECT DISTINCT {_CITED} AS cited FROM part),
 x AS (SELECT cited, {_PARTS.format('cited')} AS a FROM c), y AS (SELECT path, even, string_split(path, '/') AS b FROM t),
 e AS (SELECT cited, a FROM x WHERE EXISTS (SELECT 1 FROM t WHERE path = cited)),
 n AS (SELECT cited, a, path, even, b, list_max(list_transform(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[len(b) - k + 1:]), lambda k: k)) AS depth FROM x JOIN y ON a[-1] = b[-1] WHERE NOT EXISTS (SELECT 1 FROM t WHERE path = cited)),
 m AS (SELECT * FROM n QUALIFY depth = max(depth) OVER (PARTITION BY cited)),
 z AS (SELECT cited, cited AS path, len(a) AS depth, true AS exact, (SELECT even FROM t WHERE path = cited) AND false AS even, a, a AS b FROM e UNION ALL SELECT cited, path, depth, false, even, a, b FROM m),
 w AS (SELECT * FROM z QUALIFY exact OR even = bool_or(even) OVER (PARTITION BY cited))
 SELECT cited, path, depth::INTEGER AS depth, exact, a[len(a) - least(len(a), len(b)) + 1:] = b[len(b) - least(len(a), len(b)) + 1:] AS compatible FROM w""",
    "range_first": """WITH g AS (SELECT event_id AS report_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 10 END AS lower, event_id % 3 <> 0 AS li, CASE WHEN event_id % 5 <> 0 THEN event_id % 13 END AS upper, event_id % 2 = 0 AS ui FROM events),
 h AS (SELECT report_id, CASE WHEN lower IS NULL THEN 0 WHEN li THEN lower ELSE lower + 1 END AS f, upper, ui FROM g)
 SELECT report_id, CASE WHEN f <= 11 AND (upper IS NULL OR f < upper OR (ui AND f = upper)) THEN f END::INTEGER AS first FROM h""",
    "c16_affected_range": f"""WITH g AS (SELECT event_id AS report_id, CASE WHEN event_id % 4 <> 0 THEN event_id % 10 END AS lower, event_id % 3 <> 0 AS li, CASE WHEN event_id % 5 <> 0 THEN event_id % 13 END AS upper, event_id % 2 = 0 AS ui FROM events),
 h AS (SELECT report_id, CASE WHEN lower IS NULL THEN 0 WHEN li THEN lower ELSE lower + 1 END AS f, upper, ui FROM g), r AS (SELECT report_id, f FROM h WHERE f <= 11 AND (upper IS NULL OR f < upper OR (ui AND f = upper))),
 n AS (SELECT count(*) AS n FROM documents), c AS (SELECT DISTINCT event_id AS report_id, unnest([event_id % n, (event_id * 7 + 3) % (n + 5)]) AS d FROM events, n),
 k AS (SELECT report_id, 'fn_' || d AS subject, d FROM c WHERE report_id % 11 <> 0 OR d % 10 = 1),
 o AS (SELECT r.report_id, subject, doc_id % 12 AS i, CASE WHEN doc_id IS NULL THEN 'timeline_blocked' WHEN f >= doc_id % 12 THEN 'consistent' WHEN doc_id % 5 = 0 AND f <= doc_id % 12 - 1 THEN 'partial_history' ELSE 'range_predates_symbol' END AS outcome_key FROM r JOIN k USING (report_id) LEFT JOIN documents ON doc_id = d),
 s AS (SELECT *, {_scored('C16', 'outcome_key')} AS strength FROM o), u AS (SELECT *, CASE WHEN strength > 0 THEN 'SUPPORTS' WHEN strength < 0 THEN 'REFUTES' ELSE 'NEUTRAL' END AS outcome FROM s)
 SELECT report_id, subject, outcome_key, outcome, strength FROM u QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY CASE outcome WHEN 'SUPPORTS' THEN 0 WHEN 'NEUTRAL' THEN 1 ELSE 2 END, i NULLS FIRST, subject) = 1""",
    "c16_fixed_lineage": f"""WITH n AS (SELECT count(*) AS n FROM documents), j AS (SELECT event_id AS report_id, event_id % n AS d, event_id % 11 + 1 AS m FROM events, n),
 o AS (SELECT report_id, 'fn_' || d AS subject, CASE WHEN doc_id IS NULL THEN 'definition_missing' WHEN (m + doc_id) // 3 <> (m - 1 + doc_id) // 3 THEN 'consistent' WHEN m % 4 = 3 THEN 'previous_release_not_ancestor' ELSE 'fixed_in_unchanged' END AS outcome_key FROM j LEFT JOIN documents ON doc_id = d),
 s AS (SELECT *, {_scored('C16', 'outcome_key')} AS strength FROM o) SELECT report_id, subject, outcome_key, CASE WHEN strength > 0 THEN 'SUPPORTS' WHEN strength < 0 THEN 'REFUTES' ELSE 'NEUTRAL' END AS outcome, strength FROM s""",
    "outward_scan": f"""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, count(*) OVER (PARTITION BY o_custkey) AS n, CASE WHEN o_orderkey % 5 <> 0 THEN round((o_orderkey * 7 % 100) / 115.0, 4) END AS ratio FROM orders),
 d AS (SELECT *, abs(ord - (n + 1) // 2) AS distance FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY distance, ord) AS k, {RADIUS} * 2 ** greatest(0, ceil(log2(distance / {RADIUS}.0) - 1e-9)) AS level FROM d),
 l AS (SELECT o_custkey, level, max(ratio) FILTER (k <= {MOST}) AS top FROM k GROUP BY 1, 2), s AS (SELECT o_custkey, min(level) AS stop FROM l WHERE top >= {USABLE} GROUP BY 1),
 v AS (SELECT k.*, stop FROM k LEFT JOIN s USING (o_custkey) WHERE level <= coalesce(stop, level)), f AS (SELECT * FROM v WHERE k <= {MOST})
 SELECT f.o_custkey, arg_max(ord, {{'r': ratio, 'd': -distance, 'o': -ord}}) FILTER (ratio IS NOT NULL) AS best, max(ratio)::DOUBLE AS ratio, count(*)::INTEGER AS looked, max(level)::BIGINT AS radius, count(*) = any_value(t.total) AS complete FROM f JOIN (SELECT o_custkey, count(*) AS total FROM v GROUP BY 1) t ON t.o_custkey = f.o_custkey GROUP BY f.o_custkey""",
    "c14_options": f"""WITH p AS (SELECT p_partkey % 6 AS m, p_partkey % 4 = 0 AS built, p_partkey % 50 AS s, p_partkey % 40 AS l, p_partkey % 30 AS v, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 20 END AS d FROM part), h AS (SELECT DISTINCT s_suppkey % 5 AS g FROM supplier),
 e AS (SELECT event_id AS report_id, event_id % 17 = 0 AS negated, event_id % 12 AS m, event_id % 8 AS kind, event_id % 61 AS k, event_id % 40 AS c, event_id % 30 AS t, event_id % 9 AS g, {OPTION_CLAIMS} AS subject FROM events),
 w AS (SELECT e.*, CASE WHEN kind IN (0, 7) THEN EXISTS (SELECT 1 FROM p WHERE p.m = e.m AND s = k) WHEN kind = 3 THEN EXISTS (SELECT 1 FROM p WHERE p.m = e.m AND d = t) ELSE false END AS here,
 CASE WHEN kind = 1 THEN EXISTS (SELECT 1 FROM p WHERE p.m = e.m AND l = k) WHEN kind = 2 THEN EXISTS (SELECT 1 FROM p WHERE p.m = e.m AND v = c) ELSE false END AS named,
 CASE WHEN kind IN (0, 7) THEN EXISTS (SELECT 1 FROM p WHERE s = k) WHEN kind = 3 THEN EXISTS (SELECT 1 FROM p WHERE d = t) ELSE false END AS elsewhere, kind = 4 AND EXISTS (SELECT 1 FROM h WHERE h.g = e.g) AS ever, kind = 5 AND EXISTS (SELECT 1 FROM p WHERE s = k) AS cased FROM e),
 o AS (SELECT report_id, negated, subject, CASE WHEN here THEN 'present' WHEN named THEN 'name_only' WHEN elsewhere AND kind = 3 THEN 'generated' WHEN elsewhere THEN 'other_release_only' WHEN ever THEN 'history_only' WHEN cased THEN 'case_variant_only' ELSE 'never_in_history' END AS outcome_key FROM w),
 s AS (SELECT *, {_scored('C14', 'outcome_key')} AS raw FROM o), z AS (SELECT *, CASE WHEN negated AND raw < 0 THEN 0.0 ELSE raw END::DOUBLE AS strength FROM s)
 SELECT report_id, subject, outcome_key, CASE WHEN strength > 0 THEN 'SUPPORTS' WHEN strength < 0 THEN 'REFUTES' ELSE 'NEUTRAL' END AS outcome, strength FROM z""",
    "doc_paths": """WITH p AS (SELECT CASE p_partkey % 8 WHEN 0 THEN concat('Docs/a', p_partkey, '.c') WHEN 1 THEN concat('src/a', p_partkey, '.MD') WHEN 2 THEN 'README' WHEN 3 THEN 'x/ChangeLog.old' WHEN 4 THEN concat('man/man1/a.', p_partkey % 9) WHEN 5 THEN 'src/news.c' WHEN 6 THEN '.md' ELSE concat('src/document', p_partkey, '.c') END AS path, p_partkey % 8 AS k FROM part)
 SELECT path, k < 6 AS doc, count(*) AS n FROM p GROUP BY path, k""",
}
