"""Results that larger tables or odd rows once got wrong."""

from pyspark.sql import functions as F


def test_blocks_share_the_most_tokens():
    from plumbline.operators import alignment

    words = "the cat cat sat on a mat".split()
    # the longest block first would begin at the second cat and leave two tokens before it, too few for a block
    assert alignment.shared(["the", "old", "cat", "sat", "on", "a", "mat"], words) == 5
    assert alignment.shared("a b c c e f g".split(), "a b c c c e f g".split()) == 7
    assert alignment.shared([], ["a"]) == 0 and alignment.shared(["a"], []) == 0 and alignment.shared(None, ["a"]) == 0


def test_the_likest_line_counts_before_the_nearest(spark):
    from plumbline.operators import checks

    text = "value of the register number one"
    lines = spark.createDataFrame([(1, 1, text + "s"), (1, 2, text.replace("one", "two")), (1, 3, text)], "blob long, line_no int, text string")
    quotes = spark.createDataFrame([(7, "q", [], 1, 2, text)], "report_id long, subject string, claim_ids array<string>, blob long, line int, quoted string")
    # the cited line is alike, the lines beside it hold the quote
    assert checks.c06_line_content(quotes, lines, lines.select("text").limit(0)).first()["outcome_key"] == "near_by_offset"


def test_sentences_keep_their_digits(spark):
    from plumbline.operators import claims

    df = spark.createDataFrame([("0997 is first. 1 is second 1!   \n\n Third.",)], "t string")
    assert df.select(claims.sentences(F.col("t"))).first()[0] == ["0997 is first.", "1 is second 1!", "Third."]


def test_versions_of_many_digits(spark):
    from plumbline.operators import extraction

    df = spark.createDataFrame([(1, "t", "It shows from 1.123456.0 to 1.123456.9 and in tag curl-8_123456_0; so.")], "report_id long, title string, body string")
    rows = extraction.version_claims(df).orderBy("start").collect()
    assert [(r["raw"], r["lower"], r["upper"], r["parsed"]) for r in rows] == [("from 1.123456.0 to 1.123456.9", "1.123456.0", "1.123456.9", None), ("curl-8_123456_0", None, None, "8.123456.0")]


def test_planted_reports_meet_no_second_copy_of_their_bodies(spark, sf):
    from plumbline.plans import registry

    plan = registry.QUERIES["planted_places"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_what_literals_are_looked_up_in_is_not_broadcast(spark):
    from plumbline.operators import lookup

    rows = [(blob, 1, f"same line of all, number {blob % 2}") for blob in range(30)] + [(30, 1, "call foo(); now"), (31, 1, "call xfoo(); now"), (32, 1, "of all")]
    lines = spark.createDataFrame(rows, "blob long, line_no int, line string")
    wanted = spark.createDataFrame([(1, 0, "same line of all, number 1"), (1, 1, "number"), (2, 0, "foo()"), (3, 0, "of all"), (4, 0, "gone from all"), (5, 0, "--")], "snippet_id long, rank int, probe string")
    index = lookup.word_index(lines)
    found = lookup.found(wanted, index, lines)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    held = {(r["snippet_id"], r["rank"]): set() for r in wanted.collect()}
    for r in found.collect():
        held[r["snippet_id"], r["rank"]].add(r["blob"])
    assert held == {(1, 0): set(range(1, 30, 2)), (1, 1): set(range(30)), (2, 0): {30}, (3, 0): {*range(30), 32}, (4, 0): set(), (5, 0): set()}
    near = lookup.candidates(wanted, index, lines, 12).where("snippet_id IN (1, 3)").orderBy("snippet_id", "place").collect()
    assert [r["blob"] for r in near] == [*range(1, 24, 2), *range(12)] and {r["rank"] for r in near} == {0}


def test_texts_without_sentences(spark, tmp_path):
    from plumbline.plans import registry

    spark.createDataFrame([(1, ""), (2, " \n\n "), (3, None), (4, "One. Two.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["first"]) for r in registry.QUERIES["sentence_split"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (None, None), 4: (2, "One.")}


def test_equal_lines_count_before_alike_ones(spark):
    from plumbline.operators import checks

    whole = "the value of the register number one is kept by all callers"
    alike = whole.replace("is kept", "was kept")
    ending = whole[4:]
    lines = spark.createDataFrame([(1, 1, ending), (1, 9, whole), (2, 1, alike), (3, 1, alike), (4, 1, ending), (5, 1, whole)], "blob long, line_no int, text string")
    quotes = spark.createDataFrame([(b, f"q{b}", [], b, 1, f"{whole} of f" if b == 3 else whole) for b in range(1, 6)], "report_id long, subject string, claim_ids array<string>, blob long, line int, quoted string")
    past = spark.createDataFrame([(whole,)], "text string")
    got = {r["report_id"]: r["outcome_key"] for r in checks.c06_line_content(quotes, lines, past).collect()}
    # likeness alone still counts where the quote is nowhere else
    assert got == {1: "elsewhere_in_file", 2: "other_release_only", 3: "exact", 4: "exact", 5: "exact"}


def test_heads_of_many_lines_define(spark):
    """A body was once looked for in four lines; both forms, of columns and of whole reports, look on."""
    from plumbline.operators import reading, scopes

    text = "int spread(int a,\n" + "".join(f"    int b{i},\n" for i in range(8)) + "    int c)\n{\n  return a;\n}\nint told(int a,\n  int b,\n  int c,\n  int d,\n  int e);\nint last()\n{\n}\n"
    assert spark.createDataFrame([(text,)], "t string").select(scopes.defined_names(F.col("t"))).first()[0] == ["spread", "last"]
    assert reading.Reader().defined_names(reading._patterns(False, (), ()), text) == ["spread", "last"]


def test_heads_of_all_languages_define(spark):
    """Heads of Java with arrays or annotations and private methods of JavaScript were once passed over."""
    from plumbline.operators import reading, scopes

    text = "class A {\n  @Override public String[] parts(int[] at) {\n    return call(at);\n  }\n  #hidden(x) {\n    if (x) { run(x); }\n  }\n  java.util.List<int[]> all(char... c)\n  {\n  }\n}\n"
    assert spark.createDataFrame([(text,)], "t string").select(scopes.defined_names(F.col("t"))).first()[0] == ["parts", "#hidden", "all"]
    assert reading.Reader().defined_names(reading._patterns(False, (), ()), text) == ["parts", "#hidden", "all"]


REPORT = "report_id long, title string, body string"


def test_a_report_keeps_all_its_claims(spark):
    """Once 500 of a report were kept."""
    from plumbline.operators import claims

    body = "Names: " + " ".join(f"`name_{i}`" for i in range(700)) + "."
    df = spark.createDataFrame([(1, "t", body)], REPORT)
    for found in (claims.extract_claims(df), claims.claims_table(df)):
        assert {r["value"] for r in found.where("kind = 'symbol'").collect()} == {f"name_{i}" for i in range(700)}


def test_no_kind_of_claim_needs_a_sign_of_another(spark):
    """Texts that hold none of the signs by which kinds were once left out."""
    from plumbline.operators import claims

    texts = ["the function parseHeader fails", "SCORE: 9.8 of all", "It Validates parse first", "seen at abcdef012345", "as of 2026-05-02", "Latest release"]
    rows = claims.extract_claims(spark.createDataFrame([(i, "t", x) for i, x in enumerate(texts)], REPORT)).select("report_id", "kind", "value").collect()
    assert sorted(tuple(r) for r in rows) == [(0, "symbol", "parseHeader"), (1, "impact", "9.8"), (2, "behavior", "parse"), (3, "version", "abcdef012345"), (4, "version", "as of 2026-05-02"), (5, "version", "Latest release")]


def test_a_sentence_is_seen_whole(spark):
    """What surrounds a mention once ended at the second mention before it; names within links are the links'; a product that a sentence names makes its symbols the project's."""
    from plumbline.operators import claims

    lead = "First words.\n\n"
    body = lead + "A crash is shown by `aa_one` with `bb_two` and `cc_three` and `dd_four`. See https://x.org/ee_five(c) too.\n\nIn Foo Lib the `ff_six` is used. The `gg_seven` is not."
    got = {r["value"]: (r["role"], r["provenance"]) for r in claims.extract_claims(spark.createDataFrame([(1, "t", body)], REPORT), {"Foo Lib": "foolib"}).where("kind = 'symbol'").collect()}
    core = {name: ("core", "unscoped") for name in ("aa_one", "bb_two", "cc_three", "dd_four")}
    assert got == core | {"ff_six": ("supporting", "project_attributed"), "gg_seven": ("supporting", "unscoped")}


def test_claims_are_not_shuffled(spark, sf):
    from plumbline.plans import registry

    for name in ("claims_table", "extract_claims", "claim_spans", "trace_claims"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Join" not in plan, name
