"""Queries of the domain checks: documents are the files of a project of twelve releases, events are reports with claims about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import lines_of
from plumbline.functions.versions import tag
from plumbline.operators import checks
from plumbline.plans import trace_queries
from plumbline.sources.tables import spread, table

PATH = "concat('src/m', doc_id % 17, '/f', doc_id, '.c')"


def releases(spark) -> DataFrame:
    rows = spark.range(12).select(F.concat(F.lit("v1."), F.col("id"), F.lit(".0")).alias("name"), F.col("id").cast("int").alias("ord"), (F.lit(1600000000) + F.col("id") * 1000000).alias("epoch"))
    return rows.withColumn("v", tag(F.col("name"))).select("name", "ord", "epoch", "v.trimmed", "v.kind")


def files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("blob"), F.expr(PATH).alias("path"), "text")


def tree(spark, sf_dir) -> DataFrame:
    """A file is there from release doc_id % 12 on."""
    rows = files(spark, sf_dir).select("path", "blob", F.explode(F.sequence((F.col("doc_id") % 12).cast("int"), F.lit(11))).alias("m"))
    return rows.select(F.concat(F.lit("v1."), F.col("m"), F.lit(".0")).alias("release"), "path", "blob")


def blobs(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).select("blob", F.size(lines_of(F.col("text"))).alias("n_lines"), (F.col("doc_id") % 13 != 0).alias("parsed"))


def symbols(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).select("blob", F.concat(F.lit("fn_"), F.col("doc_id")).alias("name"), F.lit(1).alias("start"), (F.floor(F.size(lines_of(F.col("text"))) / 2) + 1).cast("int").alias("end"))


def lines(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).select("blob", F.posexplode(lines_of(F.col("text"))).alias("k", "text")).select("blob", (F.col("k") + 1).alias("line_no"), "text")


def claims(spark, sf_dir, kind: str, value: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("c"), F.col("event_id")).alias("claim_id"), F.lit(kind).alias("kind"), F.expr(value).alias("value"), F.lit("project_attributed").alias("provenance"), (F.col("event_id") % 17 == 0).alias("negated"), F.when(F.col("event_id") % 3 == 0, "core").otherwise("supporting").alias("role"))


def targets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("v1."), F.col("event_id") % 12, F.lit(".0")).alias("release"))


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("report_id", "subject", "outcome_key", "outcome", "strength")


VERSIONS = "CASE event_id % 5 WHEN 0 THEN concat('1.', event_id % 14) WHEN 1 THEN '1.3.5' WHEN 2 THEN '1.4.0-rc1' WHEN 3 THEN 'unknown' ELSE '0.9' END"


def c01_version_resolves(spark, sf_dir):
    reported = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), (F.lit(1600000000) + (F.col("event_id") % 7) * 2000000).alias("epoch"))
    return _out(checks.c01_version_resolves(claims(spark, sf_dir, "version", VERSIONS), releases(spark), reported))


FILES = "concat(CASE event_id % 3 WHEN 0 THEN concat('src/m', event_id % 1100 % 17, '/') WHEN 1 THEN '/build/' ELSE '' END, 'f', event_id % 1100, '.c')"


def c02_file_exists(spark, sf_dir):
    history = files(spark, sf_dir).select("path").unionByName(spark.createDataFrame([("old/f1050.c",)], "path string"))
    return _out(checks.c02_file_exists(claims(spark, sf_dir, "file", FILES), targets(spark, sf_dir), tree(spark, sf_dir), history))


def c03_symbol_exists(spark, sf_dir):
    history = spark.createDataFrame([("fn_1051",)], "name string")
    return _out(checks.c03_symbol_exists(claims(spark, sf_dir, "symbol", "concat('fn_', event_id % 1100)"), targets(spark, sf_dir), tree(spark, sf_dir), symbols(spark, sf_dir), history))


def c04_line_in_bounds(spark, sf_dir):
    return _out(checks.c04_line_in_bounds(claims(spark, sf_dir, "line", "concat('f', event_id % 1100, '.c:', event_id % 30 + 1)"), targets(spark, sf_dir), tree(spark, sf_dir), blobs(spark, sf_dir)))


def _frames(spark, sf_dir) -> DataFrame:
    """Reports show two frames: in a file and at a line of their own, the second in the next file."""
    rows = spread(table(spark, sf_dir, "events")).select(F.col("event_id").alias("report_id"), F.concat(F.lit("v1."), F.col("event_id") % 12, F.lit(".0")).alias("release"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index"))
    doc = (F.col("report_id") + F.col("index")) % 1100
    return rows.select("report_id", "release", "index", F.concat(F.lit("src/m"), doc % 17, F.lit("/f"), doc, F.lit(".c")).alias("path"), (F.col("report_id") % 9 + 1).cast("int").alias("line"), F.concat(F.lit("fn_"), doc).alias("function"), F.array().cast("array<string>").alias("claim_ids"))


LINE_CLAIMS = "concat(CASE event_id % 4 WHEN 0 THEN 'src/m3/' WHEN 1 THEN concat('/home/a/src/m', event_id % 1100 % 17, '/') ELSE '' END, 'f', event_id % 1100, '.c:', event_id % 30 + 1)"


def c04_outcomes(spark, sf_dir):
    """Lines of files that may be links or made by a build, and of paths that name another folder."""
    trees = tree(spark, sf_dir).withColumn("mode", F.when(F.col("blob") % 11 == 0, "120000").otherwise("100644"))
    said = claims(spark, sf_dir, "line", LINE_CLAIMS)
    made = said.where("report_id % 1100 % 19 = 0").select(F.regexp_replace("value", ":[0-9]+$", "").alias("cited"))
    return _out(checks.c04_line_in_bounds(said, targets(spark, sf_dir), trees, blobs(spark, sf_dir), made))


def c08_outcomes(spark, sf_dir):
    """Frames of the project, of libraries by their path or module, and of functions that a runtime names."""
    e = F.col("event_id")
    frames = spread(table(spark, sf_dir, "events")).select(e.alias("report_id"), F.concat(F.lit("v1."), e % 12, F.lit(".0")).alias("release"), F.posexplode(F.expr("array(0, 1, 2, 3)")).alias("index", "k"))
    doc = (F.col("report_id") + F.col("k")) % 1100
    path = F.when(F.col("k") == 1, F.concat(F.lit("/usr/include/x"), doc, F.lit(".h"))).when((F.col("k") == 2) & (F.col("report_id") % 2 == 0), F.lit("lost.c")).otherwise(F.concat(F.lit("src/m"), doc % 17, F.lit("/f"), doc, F.lit(".c")))
    function = F.when((F.col("k") == 3) & (F.col("report_id") % 3 == 0), "run.<locals>.<lambda>").otherwise(F.concat(F.lit("fn_"), doc))
    frames = frames.select("report_id", "release", "index", function.alias("function"), path.alias("path"), (F.col("report_id") % 9 + 1).alias("line"), F.when(F.col("k") == 2, F.when(F.col("report_id") % 4 == 0, "/x/libz.so.1")).alias("module"))
    status = checks.frame_status(frames, tree(spark, sf_dir), blobs(spark, sf_dir), symbols(spark, sf_dir))
    return status.groupBy("report_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in ("consistent", "inconsistent", "uncertain", "third_party")])


def c05_line_in_function(spark, sf_dir):
    rows = _frames(spark, sf_dir).where(F.col("index") == 0)
    return _out(checks.c05_line_in_function(rows, tree(spark, sf_dir), blobs(spark, sf_dir), symbols(spark, sf_dir)))


def c05_nearby_release(spark, sf_dir):
    """In the next two releases every function holds two lines more, in files of their own."""
    rows = _frames(spark, sf_dir).where(F.col("index") == 0)
    longer = symbols(spark, sf_dir).select((-F.col("blob") - 1).alias("blob"), "name", "start", (F.col("end") + 2).alias("end"))
    later = tree(spark, sf_dir).select(F.concat(F.col("release"), F.lit("+")).alias("release"), "path", (-F.col("blob") - 1).alias("blob"))
    nearby = releases(spark).select(F.col("name").alias("release"), F.concat("name", F.lit("+")).alias("near"))
    return _out(checks.c05_line_in_function(rows, tree(spark, sf_dir).unionByName(later), blobs(spark, sf_dir), symbols(spark, sf_dir).unionByName(longer), nearby))


def c06_line_content(spark, sf_dir):
    """Events quote the line two further on than they say, or a line of nowhere, which the history of every other file holds."""
    n = table(spark, sf_dir, "documents").count()
    quotes = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), (F.col("event_id") % n).alias("blob"), (F.col("event_id") % 4 + 1).cast("int").alias("line"), (F.col("event_id") % 3 * 2).alias("by"))
    found = lines(spark, sf_dir).withColumnRenamed("text", "quoted")
    quotes = quotes.join(found, (quotes["blob"] == found["blob"]) & (F.col("line") + F.col("by") == F.col("line_no"))).select("report_id", F.concat(F.lit("q"), F.col("report_id")).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), quotes["blob"], "line", F.when(F.col("report_id") % 7 == 0, F.concat(F.lit("nowhere "), F.col("quoted"))).otherwise(F.concat(F.lit("  "), F.col("quoted"))).alias("quoted"))
    past = lines(spark, sf_dir).where("blob % 2 = 0").select(F.concat(F.lit("nowhere "), "text").alias("text"))
    return _out(checks.c06_line_content(quotes, lines(spark, sf_dir), past))


def c07_snippet_provenance(spark, sf_dir):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[^ \\t\\n\\r.,;:!?]+"), F.lit(0))
    snippets = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), tokens.alias("tokens"), F.lit(5).alias("n_lines"))
    return _out(checks.c07_snippet_provenance(snippets, table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))))


def c08_trace_frames(spark, sf_dir):
    status = checks.frame_status(_frames(spark, sf_dir), tree(spark, sf_dir), blobs(spark, sf_dir), symbols(spark, sf_dir))
    return _out(checks.c08_trace_frames(status))


def c11_sanitizer_sanity(spark, sf_dir):
    return _out(checks.c11_sanitizer_sanity(trace_queries.trace_sanity(spark, sf_dir)))


def c12_patch_applies(spark, sf_dir):
    """Documents are patched by hunks of their own lines: moved, with other context, applied already, or of another document."""
    rows = files(spark, sf_dir).withColumn("l", lines_of(F.col("text"))).where(F.size("l") >= 8)
    kind, shift = F.col("doc_id") % 6, (F.col("doc_id") % 3).cast("int")
    own = F.slice("l", F.lit(1) + shift, F.lit(4))
    odd = F.array(F.lit("not there"))
    context = F.when(kind == 1, F.concat(odd, F.slice(own, 2, 3))).when(kind == 2, F.concat(F.slice(own, 1, 2), odd, F.slice(own, 4, 1))).when(kind == 3, F.concat(F.slice(own, 1, 1), odd, F.slice(own, 3, 2))).otherwise(own)
    target = F.when(kind == 3, own).otherwise(F.concat(F.slice(own, 1, 1), F.array(F.lit("changed")), F.slice(own, 3, 2)))
    hunks = rows.select(F.col("doc_id").alias("report_id"), F.lit(1).alias("hunk"), F.when(kind == 5, -1).otherwise(F.col("blob")).alias("blob"), (F.lit(1) + F.when(kind == 4, F.lit(0)).otherwise(shift)).alias("start"), context.alias("context"), target.alias("target"), F.lit(1).alias("lead"), F.lit(1).alias("trail"))
    others = rows.where("doc_id % 2 = 1").select(F.col("doc_id").alias("report_id"), F.lit(1).alias("hunk"), "blob")
    return _out(checks.c12_patch_applies(hunks, lines(spark, sf_dir), others))


def c09_trace_call_edges(spark, sf_dir):
    from plumbline.operators import graph

    frames = _frames(spark, sf_dir)
    calls = files(spark, sf_dir).where("doc_id % 5 <> 0").select(F.concat(F.lit("fn_"), F.col("doc_id") + 1).alias("caller"), F.concat(F.lit("fn_"), F.col("doc_id")).alias("callee"), F.lit(False).alias("indirect"))
    pairs = graph.consecutive(frames, ["report_id"], "index", "function")
    none = calls.limit(0).select(F.col("caller").alias("name"))
    kinds = graph.edges(pairs, calls, none.select("name", F.lit(1).alias("lines"), F.lit(False).alias("inline")), none.select("name", F.array("name").alias("calls")), none)
    return _out(checks.c09_trace_call_edges(pairs.join(kinds, ["caller", "target"]).select("report_id", "kind")))


def c13_fix_status(spark, sf_dir):
    """Every order is a commit on its customer's path."""
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("f"), F.col("o_custkey")).alias("path"), (F.col("o_orderkey") % 1000).alias("epoch"))
    loci = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("f"), F.col("event_id") % 200).alias("path"), (F.col("event_id") % 1500).alias("epoch"))
    return _out(checks.c13_fix_status(loci, commits))



def c15_commits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sha = lambda key: F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 40)
    commits = orders.select(sha(F.col("o_orderkey")).alias("sha"), F.concat(F.lit("f"), F.col("o_custkey") % 10).alias("path"))
    i = F.col("event_id")
    rows = claims(spark, sf_dir, "reference", "CASE WHEN event_id % 4 = 0 THEN substr(sha2(cast(event_id AS string), 256), 1, 40) ELSE substr(sha2(cast(event_id AS string), 256), 1, 12) END")
    cited = table(spark, sf_dir, "events").select(i.alias("report_id"), F.concat(F.lit("f"), i % 10).alias("path"))
    return _out(checks.c15_commits(rows, commits, cited))


def c16_fixed_in(spark, sf_dir):
    """Functions change in every third release from their first on."""
    digests = files(spark, sf_dir).select(F.concat(F.lit("fn_"), F.col("doc_id")).alias("symbol"), F.explode(F.sequence((F.col("doc_id") % 12).cast("int"), F.lit(11))).alias("ord"), "doc_id").withColumn("digest", F.floor((F.col("ord") + F.col("doc_id")) / 3)).drop("doc_id")
    fixes = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("fn_"), F.col("event_id") % 1100).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), (F.col("event_id") % 12).cast("int").alias("fixed"))
    return _out(checks.c16_fixed_in(fixes, digests))


def c21_hygiene(spark, sf_dir):
    missing = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.filter(F.array(F.when(F.col("event_id") % 2 == 0, "version"), F.when(F.col("event_id") % 3 == 0, "trace")), lambda x: x.isNotNull()).alias("missing"))
    return _out(checks.c21_hygiene(missing))


def c14_option_exists(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.concat(F.lit("v1."), F.col("p_partkey") % 6, F.lit(".0")).alias("release"), F.concat(F.lit("opt-"), F.col("p_partkey") % 50).alias("word"))
    return _out(checks.c14_option_exists(claims(spark, sf_dir, "option", "concat('--opt-', event_id % 70)"), targets(spark, sf_dir), words))


def c15_cve_records(spark, sf_dir):
    records = spark.range(60).select(F.concat(F.lit("CVE-2024-"), F.col("id") + 1000).alias("cve_id"), F.when(F.col("id") % 7 == 0, "REJECTED").otherwise("PUBLISHED").alias("state"), F.concat(F.lit("P"), F.col("id") % 3).alias("product"))
    products = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("p"), F.col("event_id") % 3)).alias("product"))
    return _out(checks.c15_references(claims(spark, sf_dir, "reference", "concat('CVE-2024-', 1000 + event_id % 70)"), records, products))


CWES = [("CWE-787", ["overflow"]), ("CWE-416", ["use_after_free", "double_free"]), ("CWE-20", []), ("CWE-190", ["integer", "overflow"])]


def cwe_compat(spark, sf_dir):
    i = F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("CWE-787", "CWE-416", "CWE-20", "CWE-190", "CWE-9999")])
    families = F.array(*[F.lit(x) for x in ("overflow", "double_free", "integer")], F.lit(None).cast("string"))
    pairs = table(spark, sf_dir, "events").select(i.alias("report_id"), F.get(names, (i % 5).cast("int")).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), F.get(names, (i % 5).cast("int")).alias("cwe"), F.get(families, (i % 4).cast("int")).alias("family"))
    return _out(checks.cwe_compatibility(pairs, spark.createDataFrame(CWES, "cwe string, families array<string>")))


def c16_version_range(spark, sf_dir):
    ranges = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.concat(F.lit("fn_"), F.col("event_id") % 1100).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), (F.col("event_id") % 10).cast("int").alias("lower"))
    introduced = files(spark, sf_dir).select(F.concat(F.lit("fn_"), F.col("doc_id")).alias("symbol"), (F.col("doc_id") % 12).cast("int").alias("introduced"), F.lit(True).alias("ever_defined"))
    return _out(checks.c16_version_range(ranges, introduced))


def c17_modified_scores(spark, sf_dir):
    """Scores that are not the base score, of vectors with and without metrics beside the base ones."""
    e = F.col("event_id")
    vector = F.concat(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), F.get(F.array(F.lit(""), F.lit("/E:X"), F.lit("/E:P/RL:O"), F.lit("/MAV:L")), (e % 4).cast("int")))
    rows = table(spark, sf_dir, "events").select(e.alias("report_id"), F.lit("impact").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), vector.alias("vector"), F.when(e % 3 == 0, 8.8).otherwise(9.8).alias("score"), F.when(e % 5 == 0, "critical").alias("word"))
    return _out(checks.c17_impact(rows))


def c17_impact_consistency(spark, sf_dir):
    i = F.col("event_id")
    vector = F.when(i % 6 == 0, "CVSS:3.1/AV:N").otherwise(F.concat(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:"), F.substr(F.lit("HLN"), (i % 3 + 1).cast("int"), F.lit(1)), F.lit("/I:H/A:H")))
    score = F.when(i % 4 == 0, F.lit(5.0)).when(i % 3 == 0, F.lit(9.8)).when(i % 3 == 1, F.lit(9.4)).otherwise(F.lit(9.1))
    rows = table(spark, sf_dir, "events").select(i.alias("report_id"), F.lit("impact").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), vector.alias("vector"), score.alias("score"), F.when(i % 5 == 0, "High").when(i % 5 == 1, "Critical").alias("word"))
    return _out(checks.c17_impact(rows))


def c18_api_usage(spark, sf_dir):
    i = F.col("event_id")
    calls = files(spark, sf_dir).select(F.concat(F.lit("fn_"), F.col("doc_id")).alias("caller"), F.concat(F.lit("fn_"), F.col("doc_id") + 1).alias("callee"))
    functions = files(spark, sf_dir).select(F.concat(F.lit("fn_"), F.col("doc_id")).alias("name"), (F.col("doc_id") % 13 != 0).alias("parsed"))
    rows = table(spark, sf_dir, "events").select(i.alias("report_id"), F.concat(F.lit("fn_"), i % 1100).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), F.concat(F.lit("fn_"), i % 1100 + i % 2).alias("object"), (i % 3 == 0).alias("denied"))
    return _out(checks.c18_api_usage(rows, calls, functions))


def c10_trace_version_fit(spark, sf_dir):
    frames = _frames(spark, sf_dir).drop("release")
    band = frames.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda m: F.abs(m - F.col("report_id") % 12) <= 3)).alias("m")).withColumn("release", F.concat(F.lit("v1."), F.col("m"), F.lit(".0"))).drop("m")
    status = checks.frame_status(band, tree(spark, sf_dir), blobs(spark, sf_dir), symbols(spark, sf_dir))
    return _out(checks.c10_trace_version_fit(status, targets(spark, sf_dir).withColumnRenamed("release", "claimed_release")))


def checks_to_verdicts(spark, sf_dir):
    """Several checks' evidence of each report, fused and decided."""
    from plumbline.operators import fusion

    parts = [
        checks.c01_version_resolves(claims(spark, sf_dir, "version", VERSIONS), releases(spark), table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.lit(1650000000).alias("epoch"))),
        checks.c03_symbol_exists(claims(spark, sf_dir, "symbol", "concat('fn_', event_id % 1100)"), targets(spark, sf_dir), tree(spark, sf_dir), symbols(spark, sf_dir), spark.createDataFrame([], "name string")),
        checks.c04_line_in_bounds(claims(spark, sf_dir, "line", "concat('f', event_id % 1100, '.c:', event_id % 30 + 1)"), targets(spark, sf_dir), tree(spark, sf_dir), blobs(spark, sf_dir)),
    ]
    rows = checks.run_checks(parts).withColumn("claim_id", F.get("claim_ids", F.lit(0))).withColumn("claim_id", F.concat_ws(":", "check_id", "claim_id"))
    return fusion.verdicts(rows).groupBy("label", "rule").agg(F.count("*").alias("reports"))


QUERIES = {f.__name__: f for f in (c01_version_resolves, c02_file_exists, c03_symbol_exists, c04_line_in_bounds, c04_outcomes, c08_outcomes, c17_modified_scores, c05_line_in_function, c05_nearby_release, c06_line_content, c07_snippet_provenance, c08_trace_frames, c09_trace_call_edges, c10_trace_version_fit, c11_sanitizer_sanity, c12_patch_applies, c13_fix_status, c14_option_exists, c15_commits, c15_cve_records, cwe_compat, c16_fixed_in, c16_version_range, c17_impact_consistency, c18_api_usage, c21_hygiene, checks_to_verdicts)}


def _ladder(check: str, source: str, cases: str, *, gate: bool = True, factor: str = "1.0") -> str:
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in checks.STRENGTHS[check].items())
    closed = "s < 0 AND negated" if gate else "false"
    return f"""k AS (SELECT report_id, subject, {'negated' if gate else 'false AS negated'}, {cases} AS outcome_key, {factor.replace('{key}', f'({cases})')} AS f FROM {source}), z AS (SELECT *, round((CASE outcome_key {weights} ELSE 0.0 END)::DOUBLE * f, 6) AS s FROM k)
 SELECT report_id, subject, outcome_key, CASE WHEN s > 0 THEN 'SUPPORTS' WHEN {closed} THEN 'NEUTRAL' WHEN s < 0 THEN 'REFUTES' ELSE 'NEUTRAL' END AS outcome, CASE WHEN {closed} THEN 0.0 ELSE s END AS strength FROM z"""


_D = "d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, string_split(text, chr(10)) AS l FROM documents)"
_E = f"{_D}, e AS (SELECT event_id AS report_id, event_id % 17 = 0 AS negated, event_id % 3 = 0 AS core, event_id % 1100 AS doc, event_id % 12 AS m FROM events), j AS (SELECT e.*, d.doc_id, n_lines, doc % 12 <= m AS here FROM e LEFT JOIN d ON d.doc_id = doc)"
_STATUS = "CASE WHEN d.doc_id IS NULL OR d.doc_id % 12 > {m} THEN 'inconsistent' WHEN d.doc_id % 13 = 0 THEN 'uncertain' WHEN r % 9 + 1 <= d.n_lines // 2 + 1 THEN 'consistent' ELSE 'inconsistent' END"
_BANDS = "CASE WHEN n = 0 THEN 'no_checkable_frames' WHEN good = n THEN 'all_consistent' WHEN good * 10 >= n * 8 THEN 'mostly' WHEN good * 2 >= n THEN 'mixed' ELSE 'inconsistent' END"

ORACLE_SQL = {
    "c01_version_resolves": "WITH e AS (SELECT event_id AS report_id, event_id % 17 = 0 AS negated, event_id % 5 AS c, event_id % 14 AS minor, 1600000000 + (event_id % 7) * 2000000 AS epoch, " + VERSIONS + " AS subject FROM events), "
    + _ladder("C01", "e", "CASE c WHEN 3 THEN 'version_shape_differs' WHEN 2 THEN 'prerelease_unmatched' WHEN 1 THEN 'gap_in_releases' WHEN 4 THEN 'older_than_all_releases' ELSE CASE WHEN minor > 11 THEN 'newer_than_all_releases' WHEN epoch + 86400 < 1600000000 + minor * 1000000 THEN 'future_release' ELSE 'resolves' END END"),
    "c02_file_exists": f"WITH {_E}, x AS (SELECT *, concat(CASE report_id % 3 WHEN 0 THEN concat('src/m', doc % 17, '/') WHEN 1 THEN '/build/' ELSE '' END, 'f', doc, '.c') AS subject FROM j), "
    + _ladder("C02", "x", "CASE WHEN doc_id IS NOT NULL AND here THEN 'exists' WHEN doc_id IS NOT NULL THEN 'missing_here_present_elsewhere' WHEN doc = 1050 THEN 'absence_not_established' ELSE 'never_in_history' END", factor="CASE WHEN core AND {key} = 'never_in_history' THEN 1.5 ELSE 1.0 END"),
    "c03_symbol_exists": f"WITH {_E}, x AS (SELECT *, concat('fn_', doc) AS subject FROM j), "
    + _ladder("C03", "x", "CASE WHEN doc_id IS NOT NULL AND here AND core THEN 'defined_core' WHEN doc_id IS NOT NULL AND here THEN 'defined' WHEN doc_id IS NOT NULL THEN 'absent_here_present_elsewhere' WHEN doc = 1051 THEN 'in_history_not_released' WHEN core THEN 'never_in_history_core' ELSE 'never_in_history_supporting' END"),
    "c04_line_in_bounds": f"WITH {_E}, x AS (SELECT *, concat('f', doc, '.c:', report_id % 30 + 1) AS subject FROM j WHERE doc_id IS NOT NULL AND here), " + _ladder("C04", "x", "CASE WHEN report_id % 30 + 1 <= n_lines THEN 'in_bounds' ELSE 'past_end' END"),
    "c05_line_in_function": f"WITH {_E}, x AS (SELECT *, concat('src/m', doc % 17, '/f', doc, '.c:', report_id % 9 + 1, ':fn_', doc) AS subject FROM j WHERE doc_id IS NOT NULL AND here), "
    + _ladder("C05", "x", "CASE WHEN report_id % 9 + 1 <= n_lines // 2 + 1 THEN 'in_function' WHEN report_id % 9 + 1 > n_lines THEN 'line_past_end' WHEN doc % 13 = 0 THEN 'parse_incomplete' ELSE 'outside_function' END", gate=False),
    "c05_nearby_release": f"WITH {_E}, x AS (SELECT *, concat('src/m', doc % 17, '/f', doc, '.c:', report_id % 9 + 1, ':fn_', doc) AS subject FROM j WHERE doc_id IS NOT NULL AND here), "
    + _ladder("C05", "x", "CASE WHEN report_id % 9 + 1 <= n_lines // 2 + 1 THEN 'in_function' WHEN report_id % 9 + 1 <= n_lines // 2 + 3 THEN 'fits_nearby_release' WHEN report_id % 9 + 1 > n_lines THEN 'line_past_end' WHEN doc % 13 = 0 THEN 'parse_incomplete' ELSE 'outside_function' END", gate=False),
    "c06_line_content": f"""WITH {_D}, ln AS (SELECT doc_id AS blob, unnest(range(1, n_lines + 1)) AS pos, trim(regexp_replace(unnest(l), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM d),
 h AS (SELECT DISTINCT trim('nowhere ' || t) AS t FROM ln WHERE blob % 2 = 0), q AS (SELECT event_id AS r, event_id % (SELECT count(*) FROM documents) AS blob, event_id % 4 + 1 AS line, event_id % 3 * 2 AS stp FROM events), y AS (SELECT r, q.blob, line, CASE WHEN r % 7 = 0 THEN trim('nowhere ' || t) ELSE t END AS t FROM q JOIN ln ON ln.blob = q.blob AND ln.pos = line + stp),
 b AS (SELECT r AS report_id, 'q' || r AS subject, min(abs(ln.pos - line)) FILTER (abs(ln.pos - line) <= 3 AND (contains(ln.t, y.t) OR (y.t = trim('nowhere ' || ln.t) AND 2.0 * length(ln.t) / (length(ln.t) + length(y.t)) >= 0.9))) AS off, bool_or(ln.t = y.t) AS elsewhere, bool_or(y.t IN (SELECT t FROM h)) AS ever FROM y LEFT JOIN ln ON ln.blob = y.blob WHERE length(y.t) >= 8 GROUP BY r), """
    + _ladder("C06", "b", "CASE WHEN off = 0 THEN 'exact' WHEN off <= 3 THEN 'near_by_offset' WHEN elsewhere THEN 'elsewhere_in_file' WHEN ever THEN 'other_release_only' ELSE 'nowhere_in_history' END", gate=False),
    "c04_outcomes": f"WITH {_E}, x AS (SELECT *, {LINE_CLAIMS.replace('event_id', 'report_id')} AS subject, report_id % 4 <> 0 OR doc % 17 = 3 AS fits FROM j WHERE doc_id IS NOT NULL AND here), "
    + _ladder("C04", "x", "CASE WHEN fits AND doc % 11 <> 0 AND report_id % 30 + 1 <= n_lines THEN 'in_bounds' WHEN doc % 19 = 0 THEN 'generated_or_release_only' WHEN fits AND doc % 11 <> 0 THEN 'past_end' WHEN NOT fits THEN 'other_file' ELSE 'not_a_regular_file' END"),
    "c17_modified_scores": """SELECT event_id AS report_id, 'impact' AS subject, k AS outcome_key, CASE k WHEN 'consistent_impact' THEN 'NEUTRAL' WHEN 'modified_score_possible' THEN 'NEUTRAL' ELSE 'REFUTES' END AS outcome, (CASE k WHEN 'score_mismatch' THEN -0.6 WHEN 'severity_mismatch' THEN -0.3 ELSE 0 END)::DOUBLE AS strength
 FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'consistent_impact' WHEN event_id % 4 > 1 THEN 'modified_score_possible' ELSE 'score_mismatch' END AS k FROM events)""",
    "c08_outcomes": f"""WITH {_D}, e AS (SELECT event_id AS r, unnest(range(4)) AS i FROM events),
 s AS (SELECT r, CASE WHEN i = 1 THEN 'third_party' WHEN i = 2 AND r % 4 = 0 THEN 'third_party' WHEN i = 2 AND r % 2 = 0 THEN 'inconsistent' WHEN i = 3 AND r % 3 = 0 AND d.doc_id IS NOT NULL AND d.doc_id % 12 <= r % 12 THEN 'uncertain' ELSE {_STATUS.format(m='r % 12')} END AS st FROM e LEFT JOIN d ON d.doc_id = (r + i) % 1100)
 SELECT r AS report_id, count(*) FILTER (st = 'consistent') AS consistent, count(*) FILTER (st = 'inconsistent') AS inconsistent, count(*) FILTER (st = 'uncertain') AS uncertain, count(*) FILTER (st = 'third_party') AS third_party FROM s GROUP BY r""",
    "c08_trace_frames": f"WITH {_D}, e AS (SELECT event_id AS r, unnest(range(4)) AS i FROM events), s AS (SELECT r, {_STATUS.format(m='r % 12')} AS st FROM e LEFT JOIN d ON d.doc_id = (r + i) % 1100), b AS (SELECT r AS report_id, 'trace' AS subject, count(*) FILTER (st = 'consistent') AS good, count(*) FILTER (st <> 'uncertain') AS n FROM s GROUP BY r), "
    + _ladder("C08", "b", _BANDS, gate=False),
    "c10_trace_version_fit": f"""WITH {_D}, e AS (SELECT event_id AS r, unnest(range(4)) AS i FROM events), g AS (SELECT r, i, m FROM e, (SELECT unnest(range(12)) AS m) WHERE abs(m - r % 12) <= 3),
 s AS (SELECT r, m, {_STATUS.format(m='m')} AS st FROM g LEFT JOIN d ON d.doc_id = (r + i) % 1100), c AS (SELECT r, m, count(*) FILTER (st = 'consistent') AS good, count(*) FILTER (st <> 'uncertain') AS n FROM s GROUP BY r, m),
 b AS (SELECT r AS report_id, 'fit' AS subject, coalesce(max(good / n) FILTER (m = r % 12), 0) AS h, coalesce(max(good / n) FILTER (m <> r % 12), 0) AS o FROM c WHERE n >= 3 GROUP BY r), """
    + _ladder("C10", "b", "CASE WHEN h = 1 THEN 'claimed_release_fits' WHEN o = 1 THEN 'other_release_fits' WHEN greatest(h, o) < 0.5 THEN 'no_release_fits' ELSE 'partial_fit' END", gate=False),
    "c11_sanitizer_sanity": "WITH b AS (SELECT event_id AS report_id, 'trace 1' AS subject, event_id % 24 = 0 AS bad FROM events WHERE event_id % 8 IN (0, 1, 2, 6)), " + _ladder("C11", "b", "CASE WHEN bad THEN 'violation' ELSE 'consistent' END", gate=False),
    "c12_patch_applies": f"""WITH {_D}, h AS (SELECT doc_id, doc_id % 6 AS kind, doc_id % 3 AS s, n_lines, list_transform(l, lambda x: rtrim(x)) AS l FROM d WHERE n_lines >= 8), o AS (SELECT *, l[1 + s:4 + s] AS own FROM h),
 t AS (SELECT *, CASE kind WHEN 1 THEN ['not there'] || own[2:4] WHEN 2 THEN own[1:2] || ['not there'] || own[4:4] WHEN 3 THEN own[1:1] || ['not there'] || own[3:4] ELSE own END AS c, CASE WHEN kind = 3 THEN own ELSE own[1:1] || ['changed'] || own[3:4] END AS a, CASE WHEN kind = 4 THEN 1 ELSE 1 + s END AS st FROM o),
 u AS (SELECT doc_id, kind, {', '.join(f"list_min(list_transform(list_filter(range(1, n_lines - {n} + 2), lambda i: l[i:i + {n} - 1] = {body}), lambda i: abs(i - {at}))) AS {name}" for name, body, n, at in (("f0", "c", 4, "st"), ("r0", "a", 4, "st"), ("f1", "c[2:3]", 2, "(st + 1)"), ("r1", "a[2:3]", 2, "(st + 1)")))} FROM t),
 b AS (SELECT doc_id AS report_id, 'patch' AS subject, doc_id, kind, f0, r0, f1, r1 FROM u), """
    + _ladder("C12", "b", "CASE WHEN kind = 5 THEN CASE WHEN f0 <= 200 THEN 'other_release_only' ELSE 'context_not_found' END WHEN f0 = 0 THEN 'applies_clean' WHEN f0 <= 200 THEN 'applies_with_fuzz' WHEN r0 <= 200 THEN 'already_applied' WHEN f1 <= 200 THEN 'applies_with_fuzz' WHEN r1 <= 200 THEN 'already_applied' WHEN f0 IS NOT NULL THEN 'context_elsewhere_in_file' ELSE 'context_not_found' END", gate=False),
    "c09_trace_call_edges": f"WITH {_D}, e AS (SELECT event_id AS r, unnest(range(3)) AS i FROM events), b AS (SELECT r AS report_id, 'edges' AS subject, count(*) FILTER (doc_id IS NULL OR doc_id % 5 = 0 OR (r + i) % 1100 = 1099) AS missing FROM e LEFT JOIN d ON doc_id = (r + i) % 1100 GROUP BY r), " + _ladder("C09", "b", "CASE WHEN missing > 0 THEN 'missing_edge' ELSE 'all_edges_real' END", gate=False, factor="CASE WHEN missing > 0 THEN least(missing, 3) ELSE 1 END"),
    "c13_fix_status": "WITH e AS (SELECT DISTINCT event_id AS report_id, 'f' || event_id % 200 AS subject FROM events JOIN orders ON o_custkey = event_id % 200 AND o_orderkey % 1000 > event_id % 1500), " + _ladder("C13", "e", "'modified_after'", gate=False),
    "c15_commits": "WITH e AS (SELECT event_id AS report_id, substr(sha256(event_id::VARCHAR), 1, CASE WHEN event_id % 4 = 0 THEN 40 ELSE 12 END) AS subject, o_orderkey, o_custkey % 10 = event_id % 10 AS touches FROM events LEFT JOIN orders ON o_orderkey = event_id), " + _ladder("C15", "e", "CASE WHEN o_orderkey IS NULL THEN 'commit_missing' WHEN touches THEN 'commit_touches_file' ELSE 'commit_exists' END", gate=False),
    "c16_fixed_in": f"WITH {_E}, x AS (SELECT report_id, concat('fn_', doc) AS subject, doc_id, m FROM j), " + _ladder("C16", "x", "CASE WHEN doc_id IS NULL OR doc_id % 12 > m - 1 THEN 'definition_missing' WHEN (m + doc_id) // 3 = (m - 1 + doc_id) // 3 THEN 'fixed_in_unchanged' ELSE 'consistent' END", gate=False),
    "c21_hygiene": "SELECT event_id AS report_id, array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'version' END, CASE WHEN event_id % 3 = 0 THEN 'trace' END], lambda x: x IS NOT NULL), ',') AS subject, 'hygiene' AS outcome_key, 'NEUTRAL' AS outcome, 0.0::DOUBLE AS strength FROM events",
    "c14_option_exists": "WITH w AS (SELECT DISTINCT p_partkey % 6 AS m, p_partkey % 50 AS k FROM part), e AS (SELECT event_id AS report_id, event_id % 17 = 0 AS negated, concat('--opt-', event_id % 70) AS subject, EXISTS (SELECT 1 FROM w WHERE w.m = event_id % 12 AND k = event_id % 70) AS here, EXISTS (SELECT 1 FROM w WHERE k = event_id % 70) AS anyw FROM events), "
    + _ladder("C14", "e", "CASE WHEN here THEN 'present' WHEN anyw THEN 'other_release_only' ELSE 'never_in_history' END"),
    "c15_cve_records": "WITH e AS (SELECT event_id AS report_id, concat('CVE-2024-', 1000 + event_id % 70) AS subject, event_id % 70 AS k, event_id AS i FROM events), " + _ladder("C15", "e", "CASE WHEN k >= 60 THEN 'cve_not_found' WHEN k % 7 = 0 THEN 'cve_rejected' WHEN i % 4 = 0 THEN 'no_product' WHEN i % 3 = k % 3 THEN 'cve_matches_product' ELSE 'cve_other_product' END", gate=False),
    "cwe_compat": "WITH e AS (SELECT event_id AS report_id, ['CWE-787', 'CWE-416', 'CWE-20', 'CWE-190', 'CWE-9999'][event_id % 5 + 1] AS subject, event_id % 5 AS c, event_id % 4 AS f0 FROM events), "
    + _ladder("C15", "e", "CASE WHEN f0 = 3 THEN 'no_bug_type' WHEN c = 4 THEN 'unknown_cwe' WHEN c = 2 THEN 'universal_cwe' WHEN c = 0 AND f0 = 0 OR c = 1 AND f0 = 1 OR c = 3 AND f0 IN (0, 2) THEN 'compatible' ELSE 'cwe_incompatible' END", gate=False),
    "c16_version_range": f"WITH {_E}, x AS (SELECT report_id, concat('fn_', doc) AS subject, doc_id, report_id % 10 AS lower FROM j), " + _ladder("C16", "x", "CASE WHEN doc_id IS NULL THEN 'timeline_blocked' WHEN lower < doc_id % 12 THEN 'range_predates_symbol' ELSE 'consistent' END", gate=False),
    "c17_impact_consistency": "WITH e AS (SELECT event_id AS report_id, 'impact' AS subject, event_id AS i, [9.8, 9.4, 9.1][event_id % 3 + 1] AS computed, CASE WHEN event_id % 4 = 0 THEN 5.0 ELSE [9.8, 9.4, 9.1][event_id % 3 + 1] END AS score FROM events), "
    + _ladder("C17", "e", "CASE WHEN i % 6 = 0 THEN 'vector_unparseable' WHEN i % 4 = 0 THEN 'score_mismatch' WHEN i % 5 = 0 THEN 'severity_mismatch' ELSE 'consistent_impact' END", gate=False),
    "c18_api_usage": f"WITH {_E}, x AS (SELECT report_id, concat('fn_', doc) AS subject, doc_id, (doc_id IS NOT NULL AND report_id % 2 = 1) <> (report_id % 3 = 0) AS ok FROM j), " + _ladder("C18", "x", "CASE WHEN doc_id IS NULL THEN 'function_unknown' WHEN ok THEN 'calls_api' WHEN doc_id % 13 = 0 THEN 'parse_incomplete' ELSE 'does_not_call_api' END", gate=False),
}
