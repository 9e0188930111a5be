import hashlib
import random

from plumbline.llm import decontamination as D
from plumbline.llm.common import LOWER_ALNUM


def words(text):
    return (text or "").encode().translate(LOWER_ALNUM).split()


def brute(docs, tests, window=10):
    out = []
    for doc, text in docs:
        have, hit, items = words(text), set(), set()
        for item, passage in tests:
            want = words(passage)
            for start in range(max(1, len(want) - window + 1) if want else 0):
                part = want[start : start + window]
                for i in range(len(have) - len(part) + 1):
                    if have[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        items.add(str(item))
        out.append((doc, len(have), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def digest(spark, docs, tests, **options):
    from pyspark.sql import functions as F

    rows = D.contaminated_words(docs, tests, **options).select("doc_id", "n_words", F.size("hit"), F.size("items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256), F.size("hit") > 0)
    return sorted(tuple(r) for r in rows.collect())


def case(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    tests = [(i, make(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(25)]
    docs = []
    for d in range(60):
        text = make(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            item = rng.choice(tests)[1]
            a = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[a : a + rng.randrange(1, 25)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(100, None), (101, ""), (102, "?! --")], [(i, " ".join(t).upper()) for i, t in tests] + [(90, None), (91, ""), (92, "...")]


def test_like_brute_force_in_one_and_in_many_blocks(spark):
    docs, tests = case()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, hit int")
    t = spark.createDataFrame([(a, b, 1) for a, b in tests], "item_id long, text string, doc_id int")
    expected = brute(docs, tests)
    assert digest(spark, d, t) == expected
    assert digest(spark, d, t, block_words=40) == expected
    clean = D.decontaminate(d, t, block_words=40)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(row[0] for row in expected if not row[-1])


def test_longest_matches(spark):
    item = " ".join(f"t{i}" for i in range(40))
    text = "x y " + " ".join(f"t{i}" for i in range(5, 30)) + " z " + " ".join(f"t{i}" for i in range(12))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(tuple(r) for r in D.longest_matches(d, t).collect()) == [(1, "7", 2, 5, 25), (1, "7", 28, 0, 12)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in D.contaminated_words(docs, none).collect()] == [(1, 2, [], [])]
    assert D.decontaminate(docs, none).count() == 1
    assert D.contaminated_words(docs.limit(0), none).collect() == []


def test_very_long_and_repeated(spark):
    text = "tick " * 100_000 + "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j")], "item_id long, text string")
    assert [(r.n_words, len(r.hit), r["items"]) for r in D.contaminated_words(docs, tests).collect()] == [(100_010, 10, ["1", "2"])] * 2


def test_rows_are_kept_over_several_blocks_of_items(spark):
    words = [f"w{i}" for i in range(60)]
    tests = spark.createDataFrame([(str(k), " ".join(words[k * 10 : k * 10 + 10])) for k in range(6)], "item_id string, text string")
    texts = [(1, " ".join(words[:10])), (1, " ".join(words[:10])), (None, " ".join(words[20:40])), (None, "x y"), (None, None), (2, " ".join(words[30:45])), (1, "other")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, several = (sorted((tuple(r) for r in D.contaminated_words(docs, tests, block_words=n).collect()), key=repr) for n in (1_000_000, 10))
    assert len(one) == len(texts) and several == one
    assert sum(len(r[2]) for r in one) == 10 + 10 + 20 + 10
