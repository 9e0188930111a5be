"""Queries of bug classes, crash comparison, sanitizer traces, code tokens, source maps and release lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import bugs
from plumbline.functions.text import normalized
from plumbline.functions.versions import tag
from plumbline.operators import alignment, checks, code, fusion, joins, series, spans, traces
from plumbline.plans import evidence_queries
from plumbline.sources.tables import table


def _literals(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _literals(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _picked(values: list, n: str = "event_id"):
    """One of some literals by a row's id."""
    column = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)
    return F.get(F.array(*[column(v) for v in values]), (F.col(n) % len(values)).cast("int"))


def _sql_picked(values: list, n: str = "event_id") -> str:
    return f"{_literals(values)}[{n} % {len(values)} + 1]"


#: Descriptions with the class each names, in prose.
DESCRIBED = [
    ("A heap-based buffer overflow in parse()", "heap-overflow"),
    ("This is not a use after free but a Heap  Overflow", "heap-overflow"),
    ("stack overflow in the parser", "stack-overflow-or-exhaustion"),
    ("there is no null pointer check, so it crashes", "null-deref"),
    ("rather than a double free, index out of range", "out-of-bounds"),
    ("signed_integer_overflow", "integer-overflow"),
    ("nothing to see", None),
    ("", None),
    ("not a memory leak", None),
    ("stack-buffer-overflow on address", "stack-overflow"),
    ("never uninitialized; a data race", "data-race"),
]
WEAKNESSES = ["CWE-787", " cwe-416 ", "CWE-79", None]
WEAK_CLASSES = ["out-of-bounds", "use-after-free", None, None]


def bug_class_of_text(spark, sf_dir):
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "").otherwise("Seen: "), _picked([a for a, _ in DESCRIBED]))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", bugs.class_of_text(F.col("text"), prose=True).alias("class"))


def bug_class_of_cwe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", bugs.class_of_cwe(_picked(WEAKNESSES)).alias("class"), bugs.class_of_text(_picked([a for a, _ in DESCRIBED])).alias("named"))
    return rows.select("event_id", "class", bugs.same_class(F.col("class"), F.col("named")).alias("same"))


CRASHES = [("asan", "heap-buffer-overflow", "", None, False), ("asan", "SEGV", "", 16, False), ("gdb", "SIGSEGV", "Segmentation fault", 70000, False), ("valgrind", "Invalid write", "", None, True), ("valgrind", "Invalid read", "", None, False), ("go", None, "index out of range [3]", None, False), ("java", "some.Odd Type", "", None, False)]
CRASH_CLASSES = ["heap-overflow", "null-deref", "segv", "heap-overflow", "out-of-bounds", "out-of-bounds", "some.odd-type"]


def bug_class_of_crash(spark, sf_dir):
    parts = [_picked([c[k] for c in CRASHES]) for k in range(5)]
    return table(spark, sf_dir, "events").select("event_id", bugs.class_of_crash(*parts).alias("class"))


NAMES = ["ns::C::parse(int) const", "copy.isra.0", "main.pick", "fill.part.3.cold", "plain", "T<int>::get"]
PLAIN = ["parse", "copy", "pick", "fill", "plain", "get"]


def plain_function(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bugs.plain_function(_picked(NAMES)).alias("name"))


#: Claimed and observed stacks with the length of their anchored alignment.
STACKS = [(["f", "g", "main"], ["f", "g", "main"], 3), (["f", "g", "main"], ["x", "g", "main"], 2), (["f", "g", "main"], ["main", "x"], 0), (["f", "f", "g"], ["f", "h", "f", "g"], 3), ([], ["f"], 0), (["a", "b", "c", "d"], ["b", "d", "c", "a"], 2), (["f"], [], 0)]


def stack_alignment(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", alignment.anchored_alignment(_picked([a for a, _, _ in STACKS]), _picked([b for _, b, _ in STACKS])).alias("aligned"))


#: Runs: failed, timed out, exit code, observed class (None: nothing read), stacks' number, outcome.
RUNS = [(None, False, 134, "heap-overflow", 0, "signature_match"), (None, False, 134, "heap-overflow", 2, "different_signature"), (None, False, 134, "data-race", 0, "different_signature"), (None, False, 0, None, 0, "no_crash"), (None, True, 137, None, 0, "no_crash"), ("build", False, 1, None, 0, "run_failed"), (None, False, 1, None, 0, "crash_unparsed"), (None, False, 134, "out-of-bounds", 1, "signature_match")]
_C19 = {"signature_match": ("SUPPORTS", 6.0), "different_signature": ("SUPPORTS", 0.5), "no_crash": ("REFUTES", -0.5)}


def c19_dynamic_repro(spark, sf_dir):
    read = _picked([r[3] is not None for r in RUNS])
    runs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"),
        F.col("user_id").cast("string").alias("subject"),
        F.array().cast("array<string>").alias("claim_ids"),
        _picked([r[0] for r in RUNS]).alias("failed"),
        _picked([r[1] for r in RUNS]).alias("timed_out"),
        F.lit(False).alias("claims_hang"),
        _picked([r[2] for r in RUNS]).alias("exit_code"),
        F.lit(True).alias("in_project"),
        F.lit("heap-overflow").alias("claimed_class"),
        _picked([STACKS[r[4]][0] for r in RUNS]).alias("claimed_frames"),
        F.lit(None).cast("string").alias("locus"),
        _picked([r[3] for r in RUNS]).alias("observed_class"),
        F.when(read, _picked([STACKS[r[4]][1] for r in RUNS])).alias("observed_frames"),
    )
    return checks.c19_dynamic_repro(runs).select("report_id", "outcome_key", "outcome", "strength")


#: A trace of each further sanitizer, with the frames of its first stack.
SANITIZERS = {
    "lsan": ("=={k}==ERROR: LeakSanitizer: detected memory leaks\n\nDirect leak of 15 byte(s) in 1 object(s) allocated from:\n    #0 0x43 in malloc (/w/bin+0x43)\n    #1 0x44 in copy_{k} /w/src/util.c:{n}:24\n\nSUMMARY: LeakSanitizer: 15 byte(s) leaked in 1 allocation(s).", (("malloc", None, None), ("copy_{k}", "/w/src/util.c", "{n}"))),
    "msan": ("=={k}==WARNING: MemorySanitizer: use-of-uninitialized-value\n    #0 0x4d in copy_{k} /w/src/util.c:{n}:24\n    #1 0x4e in main /w/src/hdr.c:10:3\n\nSUMMARY: MemorySanitizer: use-of-uninitialized-value /w/src/util.c:{n}:24 in copy_{k}", (("copy_{k}", "/w/src/util.c", "{n}"), ("main", "/w/src/hdr.c", "10"))),
    "tsan": ("==================\nWARNING: ThreadSanitizer: data race (pid={k})\n  Write of size 1 at 0x7f by thread T4:\n    #0 fill <null> (bin+0x4a) (BuildId: bf)\n    #1 copy_{k} /w/src/util.c:{n} (bin+0x4b)\n\n  Previous read of size 1 at 0x7f by main thread:\n    #0 main /w/src/hdr.c:10 (bin+0x4c)", (("fill", None, None), ("copy_{k}", "/w/src/util.c", "{n}"))),
    "ubsan": ("src/util.c:{n}:18: runtime error: signed integer overflow: 3 * 4 cannot be represented in type 'int'\n    #0 0x42 in copy_{k} src/util.c:{n}:18\n    #1 0x43 in main src/hdr.c:10:20", (("copy_{k}", "src/util.c", "{n}"), ("main", "src/hdr.c", "10"))),
}


def trace_sanitizers(spark, sf_dir):
    text = _picked([t for t, _ in SANITIZERS.values()])
    for name, value in {"{n}": F.col("event_id") % 400 + 1, "{k}": F.col("user_id")}.items():
        text = F.replace(text, F.lit(name), value.cast("string"))
    found = traces.frames(traces.trace_lines(table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), text.alias("body"))))
    # a leak's only stack is that of its allocation
    first = F.col("stack_no") == F.when(F.col("format") == "lsan", 1).otherwise(0)
    return found.where(first).select("report_id", "format", "index", "function", "path", "line")


CODE = 'int copy_{i}(char *p) { /* n; */\n  if (p[3] >= 0x1F) // no\n    return f("a, b", \'c\') + 2.5;\n}\n'
CODE_TOKENS = "int copy_{i} ( char * p ) { if ( p [ NUM ] >= NUM ) return f ( STR , STR ) + NUM ; }"


def code_tokens(spark, sf_dir):
    text = F.replace(F.lit(CODE), F.lit("{i}"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(code.tokens(text), " ").alias("tokens"))


def distinctive_line(spark, sf_dir):
    from plumbline.plans.code_queries import lines

    return code.distinctive_lines(lines(spark, sf_dir))


def rarest_name(spark, sf_dir):
    """Of each order its part that is ordered least."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("blob"), F.col("l_partkey").cast("string").alias("name"))
    return code.rarest_names(rows, rows)


MADE = "x\n/************** Begin file a.h ****/\na1\n/************** Include b.h in the middle of a.h ****/\n/************** Begin file b.h ****/\nb1\nb{i}\n/************** End of b.h ****/\n/************** Continuing where we left off in a.h ****/\na3\n/************** End of a.h ****/\ny"


def inlined_lines(spark, sf_dir):
    text = F.replace(F.lit(MADE), F.lit("{i}"), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("blob"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return code.inlined(rows.withColumn("line_no", F.col("line_no") + 1)).where("source IS NOT NULL")


def line_likeness(spark, sf_dir):
    """Names of parts with one letter gone, or cut short, against the names."""
    quoted = F.when(F.col("p_partkey") % 2 == 0, F.substring("p_name", 2, 6)).otherwise(F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100)))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(alignment.line_likeness(quoted, F.col("p_name")), 6).alias("likeness"))


def shared_tokens(spark, sf_dir):
    """Items of the benchmark against themselves without their fourth word."""
    words = F.split("text", " ")
    fewer = F.concat(F.slice(words, 1, 3), F.slice(words, F.lit(5), F.greatest(F.size(words) - 4, F.lit(0))))
    return table(spark, sf_dir, "benchmark").select("item_id", alignment.shared_tokens(fewer, words).alias("shared"), F.size(words).alias("n"))


def source_map_lookup(spark, sf_dir):
    """The middle of each text in a copy whose sentences end in double line ends."""
    raw = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    rows = rows.withColumn("offset", (F.length(normalized(F.col("raw"))) / 2).cast("int"))
    return rows.select("doc_id", spans.original_offset(spans.source_map(F.col("raw")), F.col("offset")).alias("at"))


def template_join(spark, sf_dir):
    """Every part stands for a file; each third is a template and the file it makes is missing."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("src/f"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".h").otherwise(".c")).alias("path"))
    made = F.when(F.col("k") % 3 == 0, F.concat("path", F.lit(".in"))).when((F.col("k") % 3 == 1) & (F.col("k") % 2 == 0), F.regexp_replace("path", "\\.h$", "-cmake.h.in")).when((F.col("k") % 3 == 1), F.regexp_replace("path", "\\.c$", ".y")).otherwise(F.col("path"))
    return joins.templates(rows.select("path"), rows.select(made.alias("path")))


TAGS = ["v{a}.{b}", "release-{a}.{b}.1", "v{a}.{b}", "tiny-v{a}.{b}", "v{a}.{b}-rc1"]


def main_families(spark, sf_dir):
    """Families of release tags made of the events of each type: one scheme, a second that goes on with it, a variant, candidates."""
    text = _picked(TAGS)
    for name, value in {"{a}": F.col("event_id") % 7 + 1, "{b}": F.col("event_id") % 11}.items():
        text = F.replace(text, F.lit(name), value.cast("string"))
    found = table(spark, sf_dir, "events").select("event_type", tag(text).alias("t")).where("t.kind = 'final'").select("event_type", "t.family", F.array_join(F.transform("t.trimmed", lambda x: x.cast("string")), ".").alias("version"))
    return series.main_families(found, ["event_type"]).select("event_type", F.array_join("families", ",").alias("families"))


def lint_rows(spark, sf_dir):
    return fusion.lint_rows(fusion.gated(evidence_queries.evidence(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (bug_class_of_text, bug_class_of_cwe, bug_class_of_crash, plain_function, stack_alignment, c19_dynamic_repro, trace_sanitizers, code_tokens, distinctive_line, rarest_name, inlined_lines, line_likeness, shared_tokens, source_map_lookup, template_join, main_families, lint_rows)}


def _value(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("{k}", "' || user_id || '").replace("{i}", "' || event_id || '") + "'"


_WEAK = f"WITH w AS (SELECT event_id, {_sql_picked(WEAK_CLASSES)} AS class, {_sql_picked([('stack-exhaustion' if c == bugs.EITHER_STACK else c) for _, c in DESCRIBED])} AS named FROM events)"
_ROWS = " UNION ALL ".join(
    f"SELECT event_id AS report_id, '{name}' AS format, {index} AS index, {_value(function)} AS function, {_value(path)} AS path, {'NULL' if line is None else '(event_id % 400 + 1)::INTEGER' if line == '{n}' else line} AS line FROM events WHERE event_id % {len(SANITIZERS)} = {k}"
    for k, (name, (_, frames)) in enumerate(SANITIZERS.items())
    for index, (function, path, line) in enumerate(frames)
)
ORACLE_SQL = {
    "bug_class_of_text": f"SELECT event_id, {_sql_picked([c for _, c in DESCRIBED])} AS class FROM events",
    "bug_class_of_cwe": f"{_WEAK} SELECT event_id, class, coalesce(class = named OR (class = 'out-of-bounds' AND named IN ('heap-overflow', 'stack-overflow', 'global-overflow')) OR (named = 'out-of-bounds' AND class IN ('heap-overflow', 'stack-overflow', 'global-overflow')), false) AS same FROM w",
    "bug_class_of_crash": f"SELECT event_id, {_sql_picked(CRASH_CLASSES)} AS class FROM events",
    "plain_function": f"SELECT event_id, {_sql_picked(PLAIN)} AS name FROM events",
    "stack_alignment": f"SELECT event_id, {_sql_picked([n for _, _, n in STACKS])} AS aligned FROM events",
    "c19_dynamic_repro": f"WITH r AS (SELECT event_id AS report_id, {_sql_picked([r[5] for r in RUNS])} AS outcome_key FROM events) SELECT *, CASE outcome_key {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{o}{chr(39)}' for k, (o, _) in _C19.items())} ELSE 'NEUTRAL' END AS outcome, (CASE outcome_key {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {s}' for k, (_, s) in _C19.items())} ELSE 0 END)::DOUBLE AS strength FROM r",
    "trace_sanitizers": _ROWS,
    "code_tokens": f"SELECT event_id, {_value(CODE_TOKENS)} AS tokens FROM events",
    "distinctive_line": "SELECT event_id AS blob, CASE WHEN event_id % 3 = 2 THEN 7 ELSE 3 END AS line_no, CASE WHEN event_id % 3 = 2 THEN 'def copy_' || event_id || '(self, n):' ELSE '#define CHECK(x) check_' || user_id || '((x))' END AS text FROM events",
    "rarest_name": "WITH l AS (SELECT l_orderkey AS blob, l_partkey::VARCHAR AS name FROM lineitem), u AS (SELECT name, count(*) AS n FROM l GROUP BY 1), r AS (SELECT DISTINCT blob, name, n FROM l JOIN u USING (name)) SELECT blob, name, n FROM r QUALIFY row_number() OVER (PARTITION BY blob ORDER BY n, -length(name), name) = 1",
    "inlined_lines": "SELECT event_id AS blob, unnest([3, 6, 7, 10]) AS line_no, unnest(['a.h', 'b.h', 'b.h', 'a.h']) AS source, unnest([1, 1, 2, 3])::BIGINT AS source_line FROM events",
    "line_likeness": "SELECT p_partkey, round(CASE WHEN p_partkey % 2 = 0 THEN 1.0 WHEN contains(p_name, substr(p_name, 1, 2) || substr(p_name, 4)) THEN 1.0 ELSE 2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1) END::DOUBLE, 6) AS likeness FROM part",
    "shared_tokens": "WITH w AS (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark) SELECT item_id, (n - 1)::INTEGER AS shared, n::INTEGER AS n FROM w",
    "source_map_lookup": "WITH d AS (SELECT doc_id, text, length(text) // 2 AS o FROM documents) SELECT doc_id, CASE WHEN length(text) > 0 THEN (o + (length(substr(text, 1, o + 1)) - length(replace(substr(text, 1, o + 1), '. ', ''))) // 2)::INTEGER END AS at FROM d",
    "template_join": "WITH p AS (SELECT p_partkey AS k, 'src/f' || p_partkey AS stem, CASE WHEN p_partkey % 2 = 0 THEN '.h' ELSE '.c' END AS ext FROM part) SELECT stem || ext AS path, CASE WHEN k % 3 = 0 THEN stem || ext || '.in' WHEN ext = '.h' THEN stem || '-cmake.h.in' ELSE stem || '.y' END AS template FROM p WHERE k % 3 <> 2",
    "main_families": """WITH t AS (SELECT DISTINCT event_type, CASE event_id % 5 WHEN 0 THEN 'v' WHEN 1 THEN 'release' WHEN 2 THEN 'v' ELSE 'tiny-v' END AS family,
 (event_id % 7 + 1) || CASE WHEN event_id % 5 = 1 THEN '.' || event_id % 11 || '.1' WHEN event_id % 11 = 0 THEN '' ELSE '.' || event_id % 11 END AS version FROM events WHERE event_id % 5 <> 4),
 f AS (SELECT event_type, family, list(version) AS vs, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, family) AS k FROM t GROUP BY 1, 2),
 w AS (SELECT event_type, max(family) FILTER (k = 1) AS f1, first(vs) FILTER (k = 1) AS v1, max(family) FILTER (k = 2) AS f2, first(vs) FILTER (k = 2) AS v2, max(family) FILTER (k = 3) AS f3, first(vs) FILTER (k = 3) AS v3 FROM f GROUP BY 1),
 x AS (SELECT *, f2 IS NOT NULL AND NOT (f1 NOT IN ('v', 'release') AND contains(f2, f1)) AND len(list_intersect(v2, v1)) <= 0.2 * len(v2) AS in2 FROM w),
 y AS (SELECT *, f3 IS NOT NULL AND NOT (f1 NOT IN ('v', 'release') AND contains(f3, f1)) AND len(list_intersect(v3, CASE WHEN in2 THEN v1 || v2 ELSE v1 END)) <= 0.2 * len(v3) AS in3 FROM x)
 SELECT event_type, array_to_string(list_sort(list_filter([f1, CASE WHEN in2 THEN f2 END, CASE WHEN in3 THEN f3 END], lambda x: x IS NOT NULL)), ',') AS families FROM y""",
    "lint_rows": f"""WITH {evidence_queries.EVIDENCE}, b AS (SELECT *, outcome = 'REFUTES' AND strength < 0 AS against FROM ev),
 r AS (SELECT report_id, claim_id, evidence_id, check_id, outcome, strength, count(*) FILTER (against) OVER (PARTITION BY report_id, claim_id) AS refutations, row_number() OVER (PARTITION BY report_id, claim_id ORDER BY against DESC, abs(strength) DESC, evidence_id) AS k FROM b)
 SELECT report_id, claim_id, evidence_id, check_id, outcome, strength, refutations, (row_number() OVER (PARTITION BY report_id ORDER BY CASE outcome WHEN 'REFUTES' THEN 1 WHEN 'NEUTRAL' THEN 2 WHEN 'ERROR' THEN 3 ELSE 4 END, evidence_id))::INTEGER AS place FROM r WHERE k = 1""",
}
