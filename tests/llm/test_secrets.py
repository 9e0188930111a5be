import re
import time

from pyspark.sql import functions as F

from plumbline.llm import secrets as S

PYTHON = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)] + [(r.kind, r.pattern, r.group, r.least) for r in S.MORE]
HEX = "0123456789abcdef" * 2
TEXTS = [
    None,
    "",
    "nothing to see",
    'password="hunter22" and PASSWD : abc123x',
    "token==abcdef token=abc",
    f"é😀 secret = '{HEX}' AKIA{'Q7' * 8} AKIAAKIA{'Z' * 12}",
    f"{HEX}{HEX} {HEX.upper()} api_key:{HEX} apikey='x.y/z+1' API-KEY=abcdef",
    "ghp_" + "a1" * 18 + " xoxb-1234567890-abc AIza" + "k" * 35 + " -----BEGIN RSA PRIVATE KEY-----",
    "eyJabcdefgh.eyJabcdefgh.sig_sig_ AKIA1 ſecret=abcdefg tOKEN = zzzzzz",
    "password=" * 40 + "x" * 200,
    "word " * 50_000 + "token=abcdef1",
]


def brute(text):
    found = [(m.start(), place, kind, m.end()) for place, (kind, pattern, group, least) in enumerate(PYTHON) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def rows(spark):
    return spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(None, "token=abcdef", "x", [1]), (3, "token=abcdef", "x", [1])], "doc_id long, text string, _kinds string, spans array<int>")


def test_spans_like_brute_force(spark):
    docs = rows(spark).withColumn("_id", F.lit(1)).withColumn("id", F.lit(2)).withColumn("kinds", F.lit("k"))
    assert S.scan(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]
    for options in ({}, {"broadcast_ids": -1}):
        got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.spans]) for r in S.scan(docs, **options).collect())
        assert got == sorted((str(r.doc_id), r.text or "", brute(r.text)) for r in docs.collect())


def test_queries():
    assert S.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert S.trigram_query("[0-9a-f]+") is None
    assert S.trigram_query("ab|abcd") is None
    assert S.trigram_query("(foo|ba[rz])x?") == [frozenset({"bar"}), frozenset({"baz"}), frozenset({"foo"})]
    for kind, pattern, _, _ in PYTHON[:1]:
        query = S.trigram_query(next(r.pattern for r in S.RULES if r.kind == kind))
        for text in ("password=abcdef", "API_KEY: abcdef", "apikey=abcdef", "Secret='abcdef'"):
            assert re.search(pattern, text) and any(all(g in text.lower() for g in grams) for grams in query)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f"é a token={HEX} b", 5), (2, "clean", 5), (3, None, 5)], "doc_id long, text string, n_chars int")
    out = S.redact(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é a [SECRET] b", 2: "clean", 3: None}


def test_redaction_keeps_columns_of_any_name(spark):
    docs = rows(spark).withColumn("_id", F.lit(1)).withColumn("id", F.lit(2))
    got = S.redact(docs)
    assert got.columns == docs.columns

    def plain(text):
        out, at = [], 0
        for start, _, _, end in brute(text):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    expected = sorted((str(r.doc_id), None if r.text is None else plain(r.text), r._kinds, r.spans, 1, 2) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected


def test_many_matches_in_one_text(spark):
    text = "é token=abcdef1 " * 20_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    spans = S.scan(docs).first().spans
    assert [(s.start, s.end) for s in spans] == [(16 * k + 2, 16 * k + 15) for k in range(20_000)]
    assert S.redact(docs).first().text == "é [SECRET] " * 20_000
    assert time.time() - began < 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan(docs).collect() == []


def test_no_python_in_the_plan(spark, sf, capsys):
    S.op6_secrets(spark, sf).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
