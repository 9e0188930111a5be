"""Properties of operators, against brute force where there is one."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import external
from plumbline.functions import text as X
from plumbline.functions import versions as V
from plumbline.operators import checks, claims, extraction, fusion, history, joins, lookup, scopes, series, spans, traces
from plumbline.sources import reports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merging_and_gaps_like_brute_force(spark):
    rng = random.Random(1)
    data = [(k, a := rng.randrange(60), a + rng.randrange(9)) for k in range(5) for _ in range(12)]
    df = spark.createDataFrame(data, "k long, start long, end long")
    expected, holes = [], []
    for k in range(5):
        out = []
        for _, a, b in sorted(x for x in data if x[0] == k):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        expected += [(k, a, b) for a, b in out]
        holes += [(k, x[1], y[0]) for x, y in zip(out, out[1:], strict=False)]
    assert rows(spans.merged(df, ["k"]).drop("n")) == sorted(expected)
    assert rows(spans.gaps(df, ["k"])) == sorted(holes)


def test_overlaps_do_not_depend_on_cells(spark):
    rng = random.Random(2)
    make = lambda: [(rng.randrange(3), a := rng.randrange(100), a + rng.randrange(40), i) for i in range(40)]
    left, right = make(), make()
    a = spark.createDataFrame(left, "k long, start long, end long, left_id long")
    b = spark.createDataFrame(right, "k long, start long, end long, right_id long")
    expected = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    for cell in (1, 7, 1000):
        assert rows(spans.overlapping(a, b, ["k"], cell).select("left_id", "right_id")) == expected


def test_match_spans(spark):
    df = spark.createDataFrame([("é😀 v1.2 and 3.4",), ("",), ("none",)], "t string")
    got = [[tuple(m) for m in r[0]] for r in df.select(spans.matches(F.col("t"), r"([0-9])\.[0-9]", 1)).collect()]
    assert got == [[(4, 7, "1"), (12, 15, "3")], [], []]


def test_suggestions_like_brute_force(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abc_") for _ in range(rng.randrange(1, 9))) for _ in range(120)})
    names = sorted({"".join(rng.choice("ABc") for _ in range(rng.randrange(1, 9))) for _ in range(40)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = joins.suggest(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in known], "word string"), most=1000)
    expected = sorted((n, w) for n in names for w in known if distance(n.lower(), w) <= min(2, max(1, len(n) // 4)))
    assert rows(got.select("name", "word")) == expected


def test_as_of_ties_and_absence(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, at long")
    right = spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "k long, at long, v string")
    assert sorted(joins.as_of(left, right, ["k"], "at", "v").collect(), key=str) == [(1, 1, None, None), (1, 5, "b", 5), (2, 9, None, None)]
    assert sorted(joins.as_of(left, right, ["k"], "at", "v", strictly=True).collect(), key=str) == [(1, 1, None, None), (1, 5, "a", 2), (2, 9, None, None)]


@pytest.mark.parametrize(("glob", "hits"), [("*.c", {"a.c", "x/b.c"}), ("x/*", {"x/b.c"}), ("**/b.?", {"x/b.c", "x/y/b.h"}), ("x/**", {"x/b.c", "x/y/b.h"})])
def test_globs(spark, glob, hits):
    df = spark.createDataFrame([("a.c",), ("x/b.c",), ("x/y/b.h",)], "path string")
    assert {r.path for r in joins.glob_matches(df, [glob]).where("glob IS NOT NULL").collect()} == hits


def test_robust_winnowing(spark):
    def brute(hashes, w):
        out, at = [], -1
        for i in range(max(1, len(hashes) - w + 1)):
            part = hashes[i : i + w]
            least = min(part)
            if at >= i and hashes[at] <= least:
                continue
            at = max(j for j in range(i, i + len(part)) if hashes[j] == least)
            out.append(at)
        return out

    rng = random.Random(4)
    data = [(d, [rng.randrange(rng.choice((3, 1000))) for _ in range(rng.randrange(1, 30))]) for d in range(30)]
    df = spark.createDataFrame(data, "doc_id long, hashes array<long>")
    assert rows(series.robust_winnowed(df).select("doc_id", "pos")) == sorted((d, p) for d, h in data for p in brute(h, 4))


def test_versions(spark):
    names = ["v1.2.3", "1.2", "1.2.0", "v1.3-rc2", "v1.3", "v1.3a", "v1.3-beta1", "v1.10"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("x", V.tag(F.col("n"))).orderBy(V.sort_key(F.col("x")), "n")
    assert [r.n for r in df.collect()] == ["1.2", "1.2.0", "v1.2.3", "v1.3-beta1", "v1.3-rc2", "v1.3", "v1.3a", "v1.10"]


def test_base_scores(spark):
    cases = {"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0, "CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N": 2.2, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:3.1/AV:N": None, "junk": None}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert {r.v: r.s for r in df.select("v", V.base_score(F.col("v")).alias("s")).collect()} == cases


EVIDENCE = "report_id long, evidence_id string, check_id string, grp string, outcome string, strength double, outcome_key string, claim_id string, claim_kind string, attributed boolean, negated boolean"


def evidence(spark, *given):
    """Rows of (report, check, group, strength, key)."""
    out = [(r, f"e{i}", c, g, "SUPPORTS" if s > 0 else "REFUTES" if s < 0 else "NEUTRAL", float(s), k, f"c{i}", "symbol", True, False) for i, (r, c, g, s, k) in enumerate(given)]
    return spark.createDataFrame(out, EVIDENCE)


def test_verdicts_of_five_kinds(spark):
    df = evidence(
        spark,
        *[(1, "C03", "symbol", 1.0, "defined_core"), (1, "C08", "trace", 2.0, "all_consistent"), (1, "C06", "content", 1.5, "exact")],
        *[(2, "C03", "symbol", 1.0, "defined_core"), (2, "C10", "trace", -0.3, "other_release_fits"), (2, "C06", "content", 1.5, "exact")],
        *[(3, "C03", "symbol", -3.0, "never_in_history_core"), (3, "C02", "file", -2.0, "never_in_history"), (3, "C14", "option", -2.0, "never_in_history")],
        *[(4, "C01", "version", 0.2, "resolves"), (4, "C04", "location", 0.2, "in_bounds")],
        *[(5, "C03", "symbol", 1.0, "defined"), (5, "C04", "location", -1.5, "past_end")],
    )
    assert [(r.report_id, r.label, r.rule) for r in fusion.verdicts(df).orderBy("report_id").collect()] == [(1, "GROUNDED", "5"), (2, "MIXED", "4"), (3, "UNGROUNDED", "3a"), (4, "INSUFFICIENT", "6a"), (5, "MIXED", "6b")]


def test_fusion_is_damped_and_ignores_order(spark):
    flood = evidence(spark, *[(1, "C03", "symbol", 1.0, "defined")] * 40)
    total = fusion.scores(fusion.ledger(flood)).first()
    assert total.log_odds <= 2.0 and total.groups == 1
    many = [(1, f"C{i:02d}", f"g{i % 3}", s, "x") for i, s in enumerate([1.0, -0.5, 2.0, -2.0, 0.3, 1.0])]
    a, b = (fusion.scores(fusion.ledger(evidence(spark, *order))).first().log_odds for order in (many, many[::-1]))
    assert a == pytest.approx(b)


def test_the_gate(spark):
    df = evidence(spark, (1, "C03", "symbol", -3.0, "never_in_history_core"))
    for column in ("negated", "attributed"):
        shut = df.withColumn(column, ~F.col(column))
        r = fusion.gated(shut).first()
        assert (r.outcome, r.strength, r.withheld_strength) == ("NEUTRAL", 0.0, -3.0)
    assert fusion.gated(df).first().strength == -3.0


def test_consistency_bands(spark):
    cases = {(0, 0): "no_checkable_frames", (5, 5): "all_consistent", (4, 5): "mostly", (3, 5): "mixed", (2, 4): "mixed", (1, 5): "inconsistent"}
    df = spark.createDataFrame(list(cases), "good int, n int")
    assert {(r.good, r.n): r.k for r in df.select("good", "n", checks.consistency(F.col("good"), F.col("n")).alias("k")).collect()} == cases


def test_claims_of_empty_and_hostile_text(spark):
    texts = ["", None, "\r\n\x00", "`" * 3000, "a/" * 3000, "CVE-" * 3000, "https://" * 2000, "version 1." * 2000, "é😀 `née`"]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "report_id long, title string, body string")
    for r in claims.extract_claims(df).collect():
        assert all(texts[r.report_id][s.start : s.end] for s in r.spans)


def test_two_traces_in_one_report(spark):
    body = "==1==ERROR: AddressSanitizer: SEGV on unknown address 0x0\n    #0 0x1 in f a.c:1\n\nTraceback (most recent call last):\n  File \"x.py\", line 3, in g\nValueError: no"
    df = spark.createDataFrame([(1, body), (2, "no trace"), (3, None)], "report_id long, body string")
    got = traces.frames(traces.trace_lines(df)).select("report_id", "trace_no", "format", "function", "line")
    assert rows(got) == [(1, 1, "asan", "f", 1), (1, 2, "python", "g", 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# T\r\n\r\nbody \xff\n")
    (tmp_path / "b").write_text("<!DOCTYPE html><p>x")
    got = {r.uri.rsplit("/", 1)[1]: (r.kind, r.title, r.body) for r in reports.as_reports(reports.files(spark, str(tmp_path))).collect()}
    assert got == {"a.md": ("markdown", "# T", "# T\n\nbody �\n"), "b": ("html", "<!DOCTYPE html><p>x", "<!DOCTYPE html><p>x")}


def test_mails(spark):
    plain = b"From: a@b.c\nSubject: =?utf-8?q?=C3=A9?=\nContent-Type: text/plain; charset=utf-8\n\nhello\n"
    rich = b"Subject: h\nContent-Type: text/html\n\n<p>one</p><script>no</script><p>two &amp; three</p>\n"
    df = spark.createDataFrame([("p", plain), ("r", rich), ("n", None), ("j", b"\xff\xfe")], "uri string, content binary")
    got = {r.uri: (r.title, r.text.strip()) for r in reports.mails(df).collect()}
    assert got["p"] == ("é", "hello") and got["r"] == ("h", "one\n\ntwo & three") and got["n"] == (None, "")


def test_stream_of_claims(spark, tmp_path):
    from plumbline.streaming.reports import read_reports, write_claims

    batch = spark.createDataFrame([(1, "t", "see CVE-2024-12345", None), (2, "t", "no", None)], "report_id long, title string, body string, ts timestamp")
    for part in range(2):
        batch.withColumn("report_id", F.col("report_id") + 10 * part).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        write_claims(read_reports(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("report_id", "value")) == [(1, "CVE-2024-12345"), (11, "CVE-2024-12345")]


def test_results_are_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "id long, a string")
    reports.write_results(df.repartition(3), str(tmp_path / "r"), "id")
    lines = [line for p in sorted((tmp_path / "r").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"a":"x","id":1}', '{"a":null,"id":2}']


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb\rc\x07﻿\x7f",)], "t string")
    assert df.select(X.normalized(F.col("t"))).first()[0] == "a\nb\nc"


def test_common_subsequences_like_brute_force():
    import itertools
    import random

    from plumbline.operators import alignment

    def brute(a, b):
        subs = {s for n in range(len(b) + 1) for s in itertools.combinations(b, n)}
        return max(n for n in range(len(a) + 1) for s in itertools.combinations(a, n) if s in subs)

    rng = random.Random(3)
    for _ in range(150):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(2))
        assert alignment.common(a, b) == brute(a, b)
        best = max((brute(a[:i], b[:j]) + 1 + brute(a[i + 1 :], b[j + 1 :]) for i in range(min(2, len(a))) for j in range(len(b)) if a[i] == b[j]), default=0)
        assert alignment.anchored(a, b) == best
    assert alignment.likeness("", "x") == 0 and alignment.likeness("", "") == 1 and alignment.likeness(None, "x") is None
    assert alignment.shared(["a", "b"], ["a", "b"]) == 0


def test_source_map_leads_back(spark):
    from plumbline.functions.text import normalized
    from plumbline.operators import spans

    rows = [(0, "a\r\nb\rc\x07d\ufeffe\r\r\nf"), (1, ""), (2, "\x00"), (3, None), (4, "\r\n\r\n")]
    df = spark.createDataFrame(rows, "k int, raw string").select("k", "raw", normalized(F.col("raw")).alias("norm"), spans.source_map(F.col("raw")).alias("map"))
    for k, raw, norm, parts in df.collect():
        if raw is None:
            assert parts is None
            continue
        back = [p.orig_start + i for p in parts for i in range(p.length)]
        assert [p.norm_start for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert "".join(raw[i] for i in back).replace("\r", "\n") == norm, k


def test_bug_classes_of_odd_texts(spark):
    from plumbline.functions import bugs

    rows = [(None, None), ("x" * 600 + " double free", None), ("double-free", "double-free"), ("neither a double free nor a heap overflow", None), ("DATA\tRACE", "data-race")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", bugs.class_of_text(F.col("t")).alias("got")).collect())


def test_attachment_names_are_safe_and_unique(spark):
    names = ["a.txt", "a-1.txt", "x/a.txt", "..", "", ".hidden", "b c?.png", "y" * 150 + ".tar", "y" * 150 + ".tar", "no", "no", "C:\\d\\no"]
    got = spark.createDataFrame([(names,)], "n array<string>").select(reports.safe_names(F.col("n"))).first()[0]
    assert len(got) == len(set(got)) == len(names)
    assert got[:7] == ["a.txt", "a-1.txt", "a-2.txt", "attachment", "attachment-1", "hidden", "b_c_.png"]
    assert all(len(n) <= 100 for n in got) and got[7].endswith(".tar") and got[8].endswith("-1.tar") and got[9:] == ["no", "no-1", "no-2"]


def test_sentence_around_a_mention(spark):
    body = "# T\n\nOne. Two is here, at x.c now! Three.\n- item four\n\nlast"
    for word, want in (("here", "Two is here, at x.c now"), ("One", "One"), ("four", "item four"), ("last", "last"), ("T", "T")):
        at = body.index(word)
        got = spark.createDataFrame([(body, at, at + len(word))], "b string, s int, e int").select(claims.sentence_around(F.col("b"), F.col("s"), F.col("e"))).first()[0]
        assert got.strip(" #-\n") == want, word


def test_patch_ladder(spark):
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate("a b c d e".split(), 1)] + [(2, k, t) for k, t in enumerate("v w x y z".split(), 1)], "blob int, line_no int, text string")
    hunks = [
        ("clean", 1, 2, ["b", "c", "d"], ["b", "X", "d"]),
        ("moved", 1, 1, ["b", "c", "d"], ["b", "X", "d"]),
        ("fuzzy", 1, 2, ["?", "c", "d"], ["?", "X", "d"]),
        ("applied", 1, 2, ["b", "OLD", "d"], ["b", "c", "d"]),
        ("other", 1, 2, ["w", "x", "y"], ["w", "X", "y"]),
        ("none", 1, 2, ["p", "q", "r"], ["p", "X", "r"]),
        ("worst", 1, 2, ["b", "c", "d"], ["b", "X", "d"]),
    ]
    rows = [(r, 1, b, s, c, t, 1, 1) for r, b, s, c, t in hunks] + [("worst", 2, 1, 2, ["p"], ["q"], 0, 0)]
    df = spark.createDataFrame(rows, "report_id string, hunk int, blob int, start int, context array<string>, target array<string>, lead int, trail int")
    got = {r.report_id: r.outcome_key for r in checks.c12_patch_applies(df, lines, df.select("report_id", "hunk", F.lit(2).alias("blob"))).collect()}
    assert got == {"clean": "applies_clean", "moved": "applies_with_fuzz", "fuzzy": "applies_with_fuzz", "applied": "already_applied", "other": "other_release_only", "none": "context_not_found", "worst": "context_not_found"}


def test_references_of_html(spark):
    df = spark.createDataFrame([("a &lt;b&gt; &#38;lt; &#x1F600;&#233; &amp;amp; &#0; &#55296; &hellip;&nbsp;x",), ("plain",), (None,)], "t string")
    got = [r[0] for r in df.select(reports.unreferenced(F.col("t"))).collect()]
    assert got == ["a <b> &lt; \U0001f600\u00e9 &amp; &#0; &#55296; \u2026 x", "plain", None]


def test_fences_of_two_kinds(spark):
    body = "~~~\ntext with a ``` fence\n```\nstill inside\n~~~\n```c\nint x;\n\n```\n"
    got = rows(reports.fenced_blocks(spark.createDataFrame([("r", body)], "report_id string, body string")).select("block", "info", "first_line", "content"))
    assert got == [(0, "", 0, "text with a ``` fence\n```\nstill inside"), (1, "c", 5, "int x;\n")]


def test_external_names(spark):
    names = [("getline", True), ("std::sort", True), ("ns::memcpy", True), ("clock_gettime", True), ("SHA256", True), ("tokenize", False), ("isvalid", False), ("total", False), ("SSL_my_custom", False), ("my_lib_call", False)]
    df = spark.createDataFrame(names, "name string, expected boolean")
    assert df.where(external.is_external(F.col("name")) != F.col("expected")).collect() == []
    assert df.where(external.is_external(F.col("name"), ["my_lib_call"]) & (F.col("name") == "my_lib_call")).count() == 1


def test_hunks_follow_their_counts(spark):
    diff = "--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,2 @@\n--- old\n+++ new\n same\n--- a/y.c\n+++ b/y.c\n@@ -5 +5 @@\n-a\n+b\n@@ -9,3 +9,3 @@\n c\ndiff --git a/z.c b/z.c\n--- a/z.c\n+++ b/z.c\n@@ -1 +1 @@\n-d\n+e"
    df = spark.createDataFrame([("r", 0, 0, diff)], "report_id string, patch int, start int, diff string")
    got = [(r.hunk, r.path, [x.op + x.text for x in r.lines], r.sound) for r in extraction.patch_hunks(df).orderBy("hunk").collect()]
    assert got == [(1, "x.c", ["--- old", "+++ new", " same"], True), (2, "y.c", ["-a", "+b"], True), (3, "y.c", [" c"], False), (4, "z.c", ["-d", "+e"], True)]


def test_behaviors_have_functions_as_subjects(spark):
    texts = ["The attacker calls `free_buf` here.", "`parse()` does not check the length. Then read_all() never calls `check_it`.", "A missing NULL check in `open_it`; integer overflow in mul_size().", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id long, body string")
    got = rows(extraction.behavior_claims(df).select("report_id", "subject", "predicate"))
    assert got == [(1, "parse", "missing_bounds_check"), (2, "mul_size", "integer_overflow"), (2, "open_it", "missing_null_check")]


def test_bare_lines_are_of_the_only_path(spark):
    texts = ["In src/a.c the loop at line 12 runs.", "Of src/a.c and src/b.c see line 4.", "See line 7. In src/a.c.", "In src/a.c, lines 3-9; there line 5."]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id long, body string")
    got = rows(extraction.location_claims(df).where("line IS NOT NULL").select("report_id", "path", "line"))
    assert got == [(0, "src/a.c", 12), (3, "src/a.c", 3)]


def test_ancestors_like_brute_force(spark):
    rng = random.Random(8)
    parents = {i: sorted({i - 1 if rng.random() < 0.8 else rng.randrange(i)} | ({rng.randrange(i)} if rng.random() < 0.2 else set())) for i in range(1, 60)}
    edges = [(0, None)] + [(c, p) for c, ps in parents.items() for p in ps]

    def reach(c):
        seen, todo = {c}, [c]
        while todo:
            todo += [p for p in parents.get(todo.pop(), []) if p not in seen and not seen.add(p)]
        return seen

    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(3, 99), (99, 3), (5, 5)]
    got = history.ancestors(spark.createDataFrame(edges, "commit long, parent long"), spark.createDataFrame(pairs, "older long, newer long"))
    known = set(range(60))
    expected = {(a, b, (a in reach(b)) if a in known and b in known else None) for a, b in pairs}
    assert {tuple(r) for r in got.select("older", "newer", "ancestor").collect()} == expected


def test_new_operators_of_no_rows(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    lines = empty("blob long, line_no int, line string")
    index = lookup.word_index(lines)
    assert lookup.provenance(empty("snippet_id long, line_no int, line string"), lines, index).collect() == []
    assert lookup.definitions_of(empty("name string"), empty("blob long, lang string, text string"), index).collect() == []
    assert history.ancestors(empty("commit long, parent long"), empty("older long, newer long")).collect() == []
    assert spans.longest_first(empty("k long, start long, end long"), ["k"]).collect() == []
    assert joins.resolve_paths(empty("cited string"), empty("path string")).collect() == []
    assert scopes.symbols(empty("blob long, lang string, text string")).collect() == []
    assert claims.claims_table(empty("report_id long, title string, body string")).collect() == []
    homes = empty("k long, home long")
    assert series.outward(empty("k long, ord long, ratio double"), homes, ["k"], 2, 0.8, 5).collect() == []


def test_claims_of_null_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "t", ""), (3, None, "```\n"), (4, "t", "@@ \n@@ -1 +1 @@\n" * 50), (5, "", "x " * 60_000 + "`f_x` crash")], "report_id long, title string, body string")
    got = claims.claims_table(df).where("report_id = 5").select("kind", "value").collect()
    assert ("symbol", "f_x") in {tuple(r) for r in got}


def test_lead_paragraph_after_a_line_of_facts(spark):
    texts = ["# T\n\n**Affected:** 1.2.3, CVSS 9.8\n\n`first_one` here.\n\n`second_one` there.", "`first_one` here.\n\n`second_one` there.", "Severity: high\n\n`first_one`", "one paragraph `first_one`"]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "report_id long, title string, body string")
    got = rows(claims.extract_claims(df).where("kind = 'symbol' AND role = 'core'").select("report_id", "value"))
    assert got == [(0, "first_one"), (1, "first_one"), (2, "first_one"), (3, "first_one")]


def test_sentences_reach_600_characters(spark):
    body = "Intro.\n\nIn `helper_x()` " + "and so on " * 20 + "there is a heap overflow."
    df = spark.createDataFrame([(1, "t", body)], "report_id long, title string, body string")
    assert rows(claims.extract_claims(df).where("kind = 'symbol'").select("value", "role")) == [("helper_x", "core")]
