"""Queries of joins, series, fingerprints, versions, scores and call edges over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import versions as V
from plumbline.operators import graph, joins, series
from plumbline.sources.tables import table

SECOND = "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(SECOND).alias("sec"))


EVENTS = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00'))::BIGINT AS sec FROM events)"


def asof_latest_before(spark, sf_dir):
    """The latest click before each purchase of a user."""
    rows = _events(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").groupBy("user_id", "sec").agg(F.max("event_id").alias("click"))
    return joins.as_of(rows.where("event_type = 'purchase'").select("event_id", "user_id", "sec"), clicks, ["user_id"], "sec", "click").select("event_id", "click", "click_at")


def neighbours(spark, sf_dir):
    return joins.neighbours(_events(spark, sf_dir).select("user_id", "sec").distinct(), ["user_id"], "sec")


def band_window(spark, sf_dir):
    """Orders within three places of each customer's dearest."""
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(by).alias("ord"))
    anchors = rows.groupBy("o_custkey").agg(F.max_by("ord", F.struct("o_totalprice", "ord")).alias("anchor"))
    return joins.band(rows, anchors, ["o_custkey"], "ord", 3).select("o_orderkey", "distance")


def _paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^.]*[.]", ""), "[?].*$", "").alias("path"))


PATHS = "p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^.]*[.]', ''), '[?].*$', '') AS path FROM pages)"


def suffix_path_join(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    cited = paths.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/build/"), F.col("path"))).when(F.col("page_id") % 3 == 1, F.regexp_replace("path", "^[^/]*/", "x/")).otherwise(F.col("path")).alias("cited"))
    return joins.suffix_join(cited, paths.select("path"))


GLOBS = ["**/en/*", "theran*/**", "1*", "*9", "*/f?/2??*"]


def glob_join(spark, sf_dir):
    return joins.glob_matches(_paths(spark, sf_dir), GLOBS)


def fuzzy_suggest(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.regexp_replace(F.concat(F.upper(F.substring("p_name", 1, 2)), F.substring("p_name", 4, 50)), " ", "_").alias("name"))
    return joins.suggest(names, part.select(F.regexp_replace("p_name", " ", "_").alias("word")))


# fingerprints


def _tokens():
    return F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r.,;:!?]+"), F.lit(0))


TOKENS = "regexp_extract_all(lower(text), '[^ \\t\\n\\r.,;:!?]+')"
GRAMS = """{name}_t AS (SELECT {id} AS doc_id, {tokens} AS t FROM {table}), {name}_g AS (SELECT doc_id, i AS pos, ('0x' || substr(md5(array_to_string(t[i + 1:i + 5], chr(31))), 1, 15))::BIGINT AS hash
 FROM {name}_t, unnest(range(len(t) - 4)) AS u(i) WHERE len(t) >= 5)"""
WINNOWED = """{name}_b AS (SELECT doc_id, pos, min({{'h': hash, 'b': -pos}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS best, max(pos) OVER (PARTITION BY doc_id) AS last FROM {name}_g),
 {name}_w AS (SELECT DISTINCT doc_id, -best.b AS pos, best.h AS hash FROM {name}_b WHERE pos + 3 <= last OR pos = 0)"""


def _sql(name: str, of: str, key: str) -> str:
    return GRAMS.format(name=name, table=of, id=key, tokens=TOKENS) + ", " + WINNOWED.format(name=name)


def kgram_hash(spark, sf_dir):
    return series.kgrams(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), _tokens())


def winnow_min(spark, sf_dir):
    return series.winnowed(series.kgrams(table(spark, sf_dir, "documents"), _tokens())).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("hash").alias("least"), F.max("pos").alias("last"))


def containment_join(spark, sf_dir):
    small = series.winnowed(series.kgrams(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), _tokens())).withColumnRenamed("doc_id", "small_id")
    large = series.kgrams(table(spark, sf_dir, "documents"), _tokens()).withColumnRenamed("doc_id", "large_id")
    return joins.containment(small, large).where("containment >= 0.5")


# presence over a series: suppliers by month of shipping


def _mentions(spark, sf_dir) -> DataFrame:
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), month.alias("ord"), (F.col("l_quantity") > 25).alias("defines"), (F.col("l_returnflag") != "R").alias("parsed"))


TIMELINE = """m AS (SELECT l_suppkey AS symbol, (year(l_shipdate) * 12 + month(l_shipdate))::INTEGER AS ord, l_quantity > 25 AS defines, l_returnflag <> 'R' AS parsed FROM lineitem),
 s AS (SELECT symbol, ord, bool_or(defines) AS defined, bool_or(NOT parsed) AS partial FROM m GROUP BY 1, 2),
 t AS (SELECT a.symbol, b.ord, coalesce(defined, false) AS defined, defined IS NOT NULL AS referenced, NOT coalesce(defined, false) AND coalesce(partial, false) AS uncertain
 FROM (SELECT DISTINCT symbol FROM m) a CROSS JOIN (SELECT DISTINCT ord FROM m) b LEFT JOIN s ON s.symbol = a.symbol AND s.ord = b.ord)"""


def _timeline(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    return series.timeline(rows.select("ord").distinct(), rows)


def timeline_uncertain(spark, sf_dir):
    return _timeline(spark, sf_dir)


def presence_runs(spark, sf_dir):
    return series.runs(_timeline(spark, sf_dir), ["symbol"], "ord", "defined")


def introduced_first(spark, sf_dir):
    return series.introduced(_timeline(spark, sf_dir))


# versions and scores on grids


TAG = "['v1.2.' || (p_partkey % 30), 'rel-2_' || (p_partkey % 7) || '_0', 'curl-7_' || (p_partkey % 90) || '-rc' || (p_partkey % 4), '3.0.' || (p_partkey % 5) || 'a', '2020-01-' || (10 + p_partkey % 20), 'experimental', 'v4.0-beta2', '1.0.0'][p_partkey % 8 + 1]"


def _tags(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda n, base=0: (k % n + base).cast("string")
    names = F.array(F.concat(F.lit("v1.2."), s(30)), F.concat(F.lit("rel-2_"), s(7), F.lit("_0")), F.concat(F.lit("curl-7_"), s(90), F.lit("-rc"), s(4)), F.concat(F.lit("3.0."), s(5), F.lit("a")), F.concat(F.lit("2020-01-"), s(20, 10)), F.lit("experimental"), F.lit("v4.0-beta2"), F.lit("1.0.0"))
    return table(spark, sf_dir, "part").select(k, F.get(names, (k % 8).cast("int")).alias("name"))


PARSED = f"""n AS (SELECT p_partkey, {TAG} AS name FROM part), g AS (SELECT p_partkey, name, p_partkey % 8 AS c,
 CASE p_partkey % 8 WHEN 0 THEN [1, 2, p_partkey % 30] WHEN 1 THEN [2, p_partkey % 7, 0] WHEN 2 THEN [7, p_partkey % 90] WHEN 3 THEN [3, 0, p_partkey % 5] WHEN 6 THEN [4, 0] WHEN 7 THEN [1, 0, 0] END AS nums FROM n),
 v AS (SELECT *, ['v', 'rel', 'curl', '', NULL, NULL, 'v', ''][c + 1] AS family, ['final', 'final', 'rc', 'post', NULL, NULL, 'beta', 'final'][c + 1] AS kind, [4, 4, 3, 5, NULL, NULL, 2, 4][c + 1] AS rank,
 CASE c WHEN 2 THEN p_partkey % 4 WHEN 6 THEN 2 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 0 END AS qual_num,
 CASE WHEN c = 3 THEN 'a' WHEN c IN (4, 5) THEN NULL ELSE '' END AS letter, nums[1:coalesce(list_max(list_transform(range(1, len(nums) + 1), lambda i: CASE WHEN nums[i] <> 0 THEN i ELSE 0 END)), 0)] AS trimmed FROM g)"""


def tag_parse(spark, sf_dir):
    x = V.tag(F.col("name"))
    return _tags(spark, sf_dir).select("p_partkey", x.alias("x")).select("p_partkey", "x.family", F.array_join(F.transform("x.numbers", lambda n: n.cast("string")), ".").alias("numbers"), F.array_join(F.transform("x.trimmed", lambda n: n.cast("string")), ".").alias("trimmed"), "x.kind", "x.qual_num", "x.letter")


def version_sort(spark, sf_dir):
    """Releases in order: dense places of distinct names by what releases are ordered by."""
    from pyspark.sql import Window

    rows = _tags(spark, sf_dir).select("name").distinct().withColumn("x", V.tag(F.col("name"))).where("x.numbers IS NOT NULL")
    # the list of distinct tags is small whatever the table's size
    return rows.withColumn("ord", F.dense_rank().over(Window.orderBy(V.sort_key(F.col("x"))))).select("name", "ord")


def version_match(spark, sf_dir):
    """For each of a list of wanted versions the tags that are it, preferred family first."""
    from pyspark.sql import Window

    tags = _tags(spark, sf_dir).select("name").distinct().withColumn("x", V.tag(F.col("name"))).where("x.numbers IS NOT NULL")
    wanted = spark.createDataFrame([("1.2.0",), ("1.2",), ("1",), ("2.3",), ("7.11-rc3",), ("3",), ("4.0-beta2",)], "wanted string").withColumn("w", V.tag(F.col("wanted")))
    same = (F.col("x.trimmed") == F.col("w.trimmed")) & (F.col("x.kind") == F.col("w.kind")) & (F.col("x.letter") == F.col("w.letter")) & ((F.col("w.kind") == "final") | (F.col("x.qual_num") == F.col("w.qual_num")))
    by = Window.partitionBy("wanted").orderBy((F.col("x.family") != "v").cast("int"), "name")
    return F.broadcast(wanted).join(tags, same).withColumn("place", F.row_number().over(by)).select("wanted", "name", "place")


AXES = (("AV", "NALP"), ("AC", "LH"), ("PR", "NLH"), ("UI", "NR"), ("S", "UC"), ("C", "HLN"), ("I", "HLN"), ("A", "HLN"))


def _vectors(spark, sf_dir) -> DataFrame:
    parts, size = [F.lit("CVSS:3.1")], 1
    for name, letters in AXES:
        parts.append(F.concat(F.lit(f"/{name}:"), F.substr(F.lit(letters), (F.floor(F.col("id") / size) % len(letters) + 1).cast("int"), F.lit(1))))
        size *= len(letters)
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % size).alias("id")).distinct().select("id", F.concat(*parts).alias("vector"))


def _axis_sql() -> str:
    parts, size = [], 1
    for name, letters in AXES:
        parts.append(f"substr('{letters}', ((id // {size}) % {len(letters)} + 1)::INTEGER, 1) AS {name}")
        size *= len(letters)
    return f"SELECT id, {', '.join(parts)} FROM (SELECT DISTINCT o_orderkey % {size} AS id FROM orders)"


def cvss_base_score(spark, sf_dir):
    scored = _vectors(spark, sf_dir).select("id", "vector", V.base_score(F.col("vector")).alias("score"))
    return scored.withColumn("band", V.severity_band(F.col("score")))


def _case(axis: str, weights: dict[str, float]) -> str:
    return f"(CASE {axis} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in weights.items()) + " END)"


_W = V.WEIGHTS
CVSS = f"""WITH a AS ({_axis_sql()}), w AS (SELECT *, 1 - (1 - {_case("C", _W["C"])}) * (1 - {_case("I", _W["I"])}) * (1 - {_case("A", _W["A"])}) AS miss,
 8.22::DOUBLE * {_case("AV", _W["AV"])} * {_case("AC", _W["AC"])} * (CASE S WHEN 'U' THEN {_case("PR", V.PRIVILEGES["U"])} ELSE {_case("PR", V.PRIVILEGES["C"])} END) * {_case("UI", _W["UI"])} AS ease FROM a),
 i AS (SELECT *, CASE S WHEN 'U' THEN 6.42::DOUBLE * miss ELSE 7.52::DOUBLE * (miss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(miss - 0.02::DOUBLE, 15) END AS impact FROM w),
 t AS (SELECT *, least(CASE S WHEN 'U' THEN impact + ease ELSE 1.08::DOUBLE * (impact + ease) END, 10::DOUBLE) AS total FROM i),
 r AS (SELECT *, floor(total * 100000 + 0.5)::BIGINT AS whole FROM t),
 s AS (SELECT *, CASE WHEN impact <= 0 THEN 0.0::DOUBLE WHEN whole % 10000 = 0 THEN whole / 100000.0::DOUBLE ELSE (whole // 10000 + 1) / 10.0::DOUBLE END AS score FROM r)
 SELECT id, 'CVSS:3.1/AV:' || AV || '/AC:' || AC || '/PR:' || PR || '/UI:' || UI || '/S:' || S || '/C:' || C || '/I:' || I || '/A:' || A AS vector, score,
 CASE WHEN score < 0.1 THEN 'none' WHEN score < 4 THEN 'low' WHEN score < 7 THEN 'medium' WHEN score < 9 THEN 'high' ELSE 'critical' END AS band FROM s"""


# call edges: an event calls the next one of its user


def _calls(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("f", F.concat("event_type", F.lit("_"), (F.col("value") % 40).cast("int").cast("string")))
    steps = graph.consecutive(rows.withColumn("back", -F.col("event_id")), ["user_id"], "back", "f")
    return steps.select("caller", F.col("target").alias("callee"), (F.col("back") % 9 == 0).alias("indirect"))


CALLS = f"{EVENTS}, f AS (SELECT *, event_type || '_' || trunc(value % 40)::INTEGER AS f FROM e), st AS (SELECT f AS callee, lag(f) OVER (PARTITION BY user_id ORDER BY event_id) AS caller, event_id FROM f), calls AS (SELECT caller, callee, event_id % 9 = 0 AS indirect FROM st WHERE caller IS NOT NULL)"


def _edge_inputs(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    names = calls.select(F.col("caller").alias("name")).distinct()
    functions = names.select("name", (F.length("name") * 4).alias("lines"), F.col("name").endswith("7").alias("inline"))
    macros = names.where("name LIKE '%3'").select("name", F.array(F.concat(F.lit("error_"), F.length("name").cast("string"))).alias("calls"))
    pairs = names.select(F.col("name").alias("caller"), F.explode(F.array(*[F.lit(f"{t}_{n}") for t in ("error", "view") for n in (1, 8, 9, 10, 20, 33)])).alias("target"))
    return pairs, calls, functions, macros, names.where("name LIKE 'view%'")


def edge_priority(spark, sf_dir):
    return graph.edges(*_edge_inputs(spark, sf_dir))


def edge_consecutive(spark, sf_dir):
    return _calls(spark, sf_dir).groupBy("caller", "callee").agg(F.count("*").alias("n"), F.count_if("indirect").alias("n_indirect"))


QUERIES = {f.__name__: f for f in (asof_latest_before, neighbours, band_window, suffix_path_join, glob_join, fuzzy_suggest, kgram_hash, winnow_min, containment_join, timeline_uncertain, presence_runs, introduced_first, tag_parse, version_sort, version_match, cvss_base_score, edge_priority, edge_consecutive)}

_TARGETS = ", ".join(f"'{t}_{n}'" for t in ("error", "view") for n in (1, 8, 9, 10, 20, 33))

ORACLE_SQL = {
    "asof_latest_before": f"WITH {EVENTS}, c AS (SELECT user_id, sec, max(event_id) AS click FROM e WHERE event_type = 'click' GROUP BY 1, 2) SELECT e.event_id, arg_max(c.click, c.sec) AS click, max(c.sec) AS click_at FROM e LEFT JOIN c ON c.user_id = e.user_id AND c.sec <= e.sec WHERE e.event_type = 'purchase' GROUP BY e.event_id",
    "neighbours": f"WITH {EVENTS}, d AS (SELECT DISTINCT user_id, sec FROM e) SELECT user_id, sec, lag(sec) OVER w AS below, lead(sec) OVER w AS above FROM d WINDOW w AS (PARTITION BY user_id ORDER BY sec)",
    "band_window": "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders), a AS (SELECT o_custkey, ord AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, ord DESC) AS k FROM r) WHERE k = 1) SELECT o_orderkey, (ord - anchor)::INTEGER AS distance FROM r JOIN a USING (o_custkey) WHERE abs(ord - anchor) <= 3",
    "suffix_path_join": f"""WITH {PATHS}, c AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN '/build/' || path WHEN 1 THEN regexp_replace(path, '^[^/]*/', 'x/') ELSE path END AS cited FROM p), t AS (SELECT DISTINCT path FROM p),
 x AS (SELECT cited, list_filter(string_split(cited, '/'), lambda y: y <> '' AND y <> '.') AS a FROM c), y AS (SELECT path, list_filter(string_split(path, '/'), lambda y: y <> '' AND y <> '.') AS b FROM t),
 s AS (SELECT cited, unnest(range(1, len(a) + 1)) AS depth, a FROM x), u AS (SELECT path, unnest(range(1, len(b) + 1)) AS depth, b FROM y),
 m AS (SELECT cited, path, max(s.depth) AS depth FROM s JOIN u ON s.depth = u.depth AND a[len(a) - s.depth + 1:] = b[len(b) - u.depth + 1:] GROUP BY 1, 2)
 SELECT cited, path, depth::INTEGER AS depth FROM (SELECT *, rank() OVER (PARTITION BY cited ORDER BY depth DESC) AS k FROM m) WHERE k = 1""",
    "glob_join": f"WITH {PATHS} SELECT page_id, path, CASE " + " ".join(f"WHEN regexp_matches(path, '{joins.glob_pattern(g)}') THEN '{g}'" for g in GLOBS) + " END AS glob FROM p",
    "kgram_hash": f"WITH {_sql('b', 'benchmark', 'item_id')} SELECT doc_id, pos::INTEGER AS pos, hash FROM b_g",
    "winnow_min": f"WITH {_sql('d', 'documents', 'doc_id')} SELECT doc_id, count(*) AS n, min(hash) AS least, max(pos)::INTEGER AS last FROM d_w GROUP BY doc_id",
    "containment_join": f"""WITH {_sql('b', 'benchmark', 'item_id')}, {GRAMS.format(name='d', table='documents', id='doc_id', tokens=TOKENS)}, s AS (SELECT DISTINCT doc_id AS small_id, hash FROM b_w), l AS (SELECT DISTINCT doc_id AS large_id, hash FROM d_g),
 z AS (SELECT small_id, count(*) AS size FROM s GROUP BY 1), m AS (SELECT small_id, large_id, count(*) AS shared FROM s JOIN l USING (hash) GROUP BY 1, 2) SELECT small_id, large_id, shared, round(shared / size, 6) AS containment FROM m JOIN z USING (small_id) WHERE round(shared / size, 6) >= 0.5""",
    "timeline_uncertain": f"WITH {TIMELINE} SELECT * FROM t",
    "presence_runs": f"WITH {TIMELINE}, g AS (SELECT symbol, ord, ord - row_number() OVER (PARTITION BY symbol ORDER BY ord) AS k FROM t WHERE defined) SELECT symbol, min(ord) AS first, max(ord) AS last, count(*) AS n FROM g GROUP BY symbol, k",
    "introduced_first": f"WITH {TIMELINE} SELECT symbol, min(ord) FILTER (defined) AS introduced, max(ord) FILTER (defined) AS last_defined, bool_or(defined) AS ever_defined, count(*) FILTER (defined) AS n_defined FROM t GROUP BY symbol",
    "tag_parse": f"WITH {PARSED} SELECT p_partkey, family, array_to_string(nums, '.') AS numbers, array_to_string(trimmed, '.') AS trimmed, kind, qual_num::INTEGER AS qual_num, letter FROM v",
    "version_sort": f"WITH {PARSED} SELECT name, dense_rank() OVER (ORDER BY trimmed, rank, qual_num, letter)::INTEGER AS ord FROM (SELECT DISTINCT name, trimmed, rank, qual_num, letter FROM v WHERE nums IS NOT NULL)",
    "version_match": f"""WITH {PARSED}, d AS (SELECT DISTINCT name, trimmed, kind, qual_num, letter, family FROM v WHERE nums IS NOT NULL),
 w(wanted, t, k, q, l) AS (VALUES ('1.2.0', [1, 2], 'final', 0, ''), ('1.2', [1, 2], 'final', 0, ''), ('1', [1], 'final', 0, ''), ('2.3', [2, 3], 'final', 0, ''), ('7.11-rc3', [7, 11], 'rc', 3, ''), ('3', [3], 'final', 0, ''), ('4.0-beta2', [4], 'beta', 2, ''))
 SELECT wanted, name, (row_number() OVER (PARTITION BY wanted ORDER BY family <> 'v', name))::INTEGER AS place FROM w JOIN d ON trimmed = t AND kind = k AND letter = l AND (k = 'final' OR qual_num = q)""",
    "cvss_base_score": CVSS,
    "edge_priority": f"""WITH {CALLS}, names AS (SELECT DISTINCT caller AS name FROM calls), dc AS (SELECT DISTINCT caller, callee AS target FROM calls WHERE NOT indirect), pr AS (SELECT name AS caller, unnest([{_TARGETS}]) AS target FROM names),
 ma AS (SELECT name, 'error_' || length(name) AS target FROM names WHERE name LIKE '%3'), sm AS (SELECT name FROM names WHERE length(name) * 4 <= 30 OR name LIKE '%7')
 SELECT caller, target, CASE WHEN EXISTS (SELECT 1 FROM dc WHERE dc.caller = pr.caller AND dc.target = pr.target) THEN 'direct'
 WHEN EXISTS (SELECT 1 FROM dc JOIN ma ON ma.name = dc.target WHERE dc.caller = pr.caller AND ma.target = pr.target) THEN 'macro'
 WHEN EXISTS (SELECT 1 FROM dc a JOIN sm ON sm.name = a.target JOIN dc b ON b.caller = a.target WHERE a.caller = pr.caller AND b.target = pr.target) THEN 'inlined_2hop'
 WHEN pr.caller IN (SELECT caller FROM calls WHERE indirect) AND pr.target IN (SELECT name FROM names WHERE name LIKE 'view%') THEN 'indirect_possible' ELSE 'none' END AS kind FROM pr""",
    "edge_consecutive": f"WITH {CALLS} SELECT caller, callee, count(*) AS n, count(*) FILTER (indirect) AS n_indirect FROM calls GROUP BY 1, 2",
}

_SETS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Z]+|[A-Z]?[a-z]+|[0-9]+'), lambda x: lower(x)))"
ORACLE_SQL["fuzzy_suggest"] = f"""WITH a AS (SELECT DISTINCT replace(upper(substr(p_name, 1, 2)) || substr(p_name, 4, 50), ' ', '_') AS name FROM part), b AS (SELECT DISTINCT replace(p_name, ' ', '_') AS word FROM part),
 n AS (SELECT name, word, levenshtein(lower(name), lower(word)) AS distance FROM a CROSS JOIN b WHERE levenshtein(lower(name), lower(word)) <= least(greatest(1, length(name) // 4), 2)),
 j AS (SELECT *, round(len(list_intersect({_SETS.format('name')}, {_SETS.format('word')})) / len(list_distinct({_SETS.format('name')} || {_SETS.format('word')})), 6) AS shared FROM n)
 SELECT name, word, distance::INTEGER AS distance, shared, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, shared DESC, word) AS place FROM j) WHERE place <= 3"""
