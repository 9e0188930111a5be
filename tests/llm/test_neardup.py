import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import neardup
from plumbline.llm.common import LOWER_AND_SPACE

SCHEMA = "doc_id long, text string, token string, found int"


def sets_of(texts, k):
    out = {}
    for doc, text in texts:
        words = (text or "").encode().translate(LOWER_AND_SPACE).split()
        out[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    return out


def brute(texts, k, percent):
    sets, parent = sets_of(texts, k), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


def variants(rng, words, n, edits):
    for _ in range(n):
        out = list(words)
        for _ in range(rng.randrange(edits + 1)):
            out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
        yield " ".join(out)


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        texts += list(variants(rng, words, rng.randrange(1, 9), 4))
    # many close copies, of which not all pairs are linked
    words = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    texts += list(variants(rng, words, 80, 6))
    texts += texts[:10]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("options", [{}, {"block_classes": 16, "block_shingles": 2000}])
def test_components_like_brute_force(spark, options):
    texts = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85, **options).collect()}
    assert got == brute(texts, 3, 85)


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one\ttwo"), (6, "one"), (7, long), (8, long.upper()), (9, "a b c"), (9, "a b c"), (None, "a b c")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    for name in ("class", "cluster", "central", "parts", "set_a", "tokens", "n_shingles", "component_id"):
        docs = docs.withColumn(name, F.lit(7))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 29_998, 7, True), (8, 29_998, 7, False), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, None)], key=str)
    kept = neardup.deduplicate(docs, shingle=3, percent=85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 9, None], key=str)


def test_several_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:299], "else"]
    rows = [(1, " ".join(words)), (1, "quite another text of some words"), (2, " ".join(near)), (2, " ".join(near)), (3, "quite another text of some words")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got[(1, 298)] == got[(2, 298)] == 1 and got[(3, 4)] == 1


def test_components_of_a_star_with_hot_node(spark):
    n = neardup.HOT_EDGES + 500
    edges = spark.createDataFrame([(0, i) for i in range(1, n)] + [(i, i + n) for i in range(1, 50)], "a long, b long")
    rows = neardup.components(edges).collect()
    assert {r.root for r in rows} == {0} and {r.node for r in rows} == {*range(n), *range(n + 1, n + 50)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(docs).collect() == []
    assert neardup.deduplicate(docs).collect() == []


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(200, 100), (100, 100)], "a long, b long")
    got = defaultdict(set)
    for r in neardup.components(edges).collect():
        got[r.root].add(r.node)
    assert got == {1: set(range(1, n + 1)), 100: {100, 200}}


def test_signatures_agree_as_sets_do():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    other = [w if rng.random() > 0.05 else f"v{i}" for i, w in enumerate(words)]
    texts = [" ".join(words).encode(), " ".join(other).encode()]
    found, edges = neardup.distinct_sets(texts, 3)
    a, b = set(found[: edges[1]].tolist()), set(found[edges[1] :].tolist())
    tokens = neardup.minima(found, edges, 64)
    assert abs(np.mean(tokens[0] == tokens[1]) - len(a & b) / len(a | b)) < 0.2
