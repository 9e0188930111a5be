import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html_text as H
from plumbline.llm import language, mixing, neighbours, quality
from plumbline.llm.common import LOWER_AND_SPACE


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op3_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the cat of the house", "en"), (2, "le chat de la maison", "fr"), (3, None, "en"), (4, "12 ?!", "fr"), (5, "", None), (5, "le la les", None), (6, "x" * 300_000, "en")]
    docs = spark.createDataFrame([(a, b, c, "y") for a, b, c in rows], "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()]
    assert len(got) == 7 and all(lang in ("en", "fr", "und") for _, lang, _ in got)
    assert [(d, lang) for d, lang, _ in got if lang == "und"] == [(3, "und"), (4, "und"), (5, "und")]
    empty = docs.limit(0)
    assert language.predict(empty, language.train(empty)).collect() == []
    assert {r.lang_pred for r in language.predict(docs, language.train(empty)).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", "y"), (2, None, "y"), (3, "", "y"), (4, "bad " * 100_000, "y"), (1, "good words here", "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] and got[1] > got[4]
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).collect() == []


def exact(vectors, query, own, k):
    found = sorted(((-float(np.dot(np.float64(v), np.float64(query))), i) for i, v in vectors if i != own and len(v) == len(query)))
    return [(i, round(-s, 9)) for s, i in found[:k]]


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    same = rng.normal(size=16).astype(np.float32).tolist()
    rows += [(2000 + i, same) for i in range(300)]
    odd = [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [None] * 16), (4004, [1.0, 2.0]), (4020, [float("inf")] + [1.0] * 15), (4005, []), (None, same)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, shard int")
    index = neighbours.build_index(table, shard_rows=400)
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 20 = 0"), index, 20, query_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i, _ in rows if i % 20 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    vectors = dict(rows)
    for q in asked:
        best = exact(rows, vectors[q], q, 20)
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(i != q and abs(s - float(np.dot(np.float64(vectors[i]), np.float64(vectors[q])))) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for i, _ in best} & {i for _, i, _ in mine})
    assert hits / (20 * len(asked)) > 0.95
    assert [i for i, _ in exact(rows, same, 2000, 20)] == [i for _, i, _ in sorted(got[2000])]


def test_neighbours_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table.where("vec_id % 20 = 0"), neighbours.build_index(table)).collect()]
    assert sorted(got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert neighbours.nearest(table.limit(0), neighbours.build_index(table.limit(0))).collect() == []


PAGES = [
    ("<nav>Home News</nav><article><h1>A title</h1><p>First &amp; long paragraph of the text that goes on and on for the sake of the test.<p>Short.</article><footer>&copy; x</footer>", "A title\nFirst & long paragraph of the text that goes on and on for the sake of the test.\nShort."),
    ("<article><p>The words of the text are here and they go on and on so that it is long enough to be a block.</p><div class='ad'>Buy the thing of the day now and here for you and all of us in the house.</div><p>tail</p></article>", "The words of the text are here and they go on and on so that it is long enough to be a block.\ntail"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>x", ""),
    (None, ""),
    ("", ""),
    ("<article><p>Broken <b>markup with the words of the text that goes on and on for the sake of the test &am", "Broken markup with the words of the text that goes on and on for the sake of the test &am"),
    ("<article><p>a  b\n\t c of the text that goes on and on for the sake of the test in the house<br>and more</p></article>", "a b c of the text that goes on and on for the sake of the test in the house and more"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_main_text_without_article():
    para = "The river of the town was long and it was in the way of all who came to the house on the hill, and so they had to go over it, which is what the men of the village did for years and years until a bridge was made of stone and of wood."
    page = f"<body><div id='sidebar'><p>{para}</p></div><ul><li><a href='/'>one link of the menu</a></li></ul><p>Lead in.</p><p>{para}</p><p>So it was.</p><p>{para}</p><form><p>{para}</p></form></body>"
    assert H.main_text(page) == f"Lead in.\n{para}\nSo it was.\n{para}"


def test_hostile_markup_is_linear():
    for seed in ("<", "<p ", "<!--", "<script>", '<a href="', "<div class='x", "&", "</p>"):
        H.main_text(seed * 4000)


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article>" + "word of the text " * 20_000 + "</article>", "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    assert got[1].n_chars == len(got[1].text) == 17 * 20_000 - 1 and got[None].text == "" and got[None].n_chars == 0
    assert H.extract(pages.limit(0)).collect() == []


def test_mixing_counts_like_brute_force(spark):
    rng = random.Random(8)
    stock = [f"wörd{i}" for i in range(300)]
    texts = [" ".join(rng.choice(stock[: rng.randrange(5, 300)]) for _ in range(rng.randrange(0, 80))) for _ in range(150)] + [None, "", "A a\ta  B", "x" * 50_000, "again " * 300, "\0 b"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    mark = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0
    got = {r.doc_id: r for r in mixing.score(docs, mark).collect()}
    words = {i: [*(t or "").encode().translate(LOWER_AND_SPACE).split(), b"\n"] for i, t in enumerate(texts)}
    count = Counter(w for i in words if zlib.crc32(str(i).encode()) % 10 for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        assert got[i].training == (zlib.crc32(str(i).encode()) % 10 != 0)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert got[i].score < 0
    assert got[154].score > got[154].base_score  # repeats are foreseen


def test_mixing_is_a_distribution():
    """The probabilities of all bytes at a place add up to one."""
    total = np.zeros((1 << mixing.LEAST_BITS, 2), np.float32)
    mixing.counted([b"abc", b"abd"], np.array([0, 1]), np.array([3.0, 2.0]), total)
    zeros, ones = total[:, 0].copy(), total[:, 1].copy()
    model = mixing.Mixer.new(zeros, ones)
    model.learn([b"abc", b"abd"] * 20, np.array([0, 1] * 20), (zeros, ones))
    first = model.scores([b"ab"], np.array([0]))[0]
    total = 0.0
    for c in range(256):
        bits, p = model.foreseen(mixing.spelled([b"ab" + bytes([c])], np.array([0])), slice(2, 3))
        total += np.prod(np.where(bits == 1, p, 1 - p))
    assert total == pytest.approx(1, abs=1e-4) and first < 0


def test_mixing_without_training(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = mixing.score(docs, F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert mixing.score(docs.limit(0), F.lit(True)).collect() == []


def test_neighbours_of_vectors_of_very_different_length(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=32).astype(np.float32) for i in range(3000)}
    for i, factor in ((7, 1e4), (20, 1e20), (40, 1e-20), (1000, 300.0)):
        vectors[i] = vectors[i] * np.float32(factor)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    index = neighbours.build_index(table, shard_rows=1000)
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 20 = 0"), index, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(i, v) for i, v in vectors.items()]
    asked = [i for i in vectors if i % 20 == 0]
    hits = sum(len({i for i, _ in exact(rows, vectors[q], q, 20)} & got[q]) for q in asked)
    assert hits / (20 * len(asked)) > 0.95


KEPT = "A paragraph of the article which is about what has been said of this and that, and of all the other things there are."


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'title="a hidden gem"', 'data-id="menu"', 'data-class="ad"', 'class="social-history"', 'id="related-work"', "data-x='class=\"ad\"'", 'data-hidden="1"', "title=hidden-gem"],
)
def test_attributes_that_say_nothing_of_a_part(attributes):
    assert H.main_text(f"<html><body><article><p>{KEPT}</p><div {attributes}><p>{KEPT} Twice.</p></div></article></body></html>") == f"{KEPT}\n{KEPT} Twice."


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'hidden="hidden"', 'HIDDEN="until-found"', 'class="ad"', 'class="x related"', 'role="navigation"', 'aria-hidden="true"', 'title="x" id=menu'])
def test_attributes_of_parts_that_are_left_out(attributes):
    assert H.main_text(f"<html><body><article><p>{KEPT}</p><div {attributes}><p>{KEPT} Twice.</p></div></article></body></html>") == KEPT


def test_pages_keep_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{KEPT}</p></article>", 3)], "page_id long, url string, html string, `a.b` int")
    row = H.extract(pages).collect()[0]
    assert (row["a.b"], row.text) == (3, KEPT)


def test_good_documents_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, ("a good text of words " if i % 2 else "%% xx 11 ") * 9, i) for i in range(40)], "doc_id long, text string, `a.b` long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and {(r.doc_id, r["a.b"]) for r in kept.collect()} == {(i, i) for i in range(1, 40, 2)}
