"""What reaches the driver, how often components go round, and what of a text is tokenized anew."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from plumbline.llm import neardup, packing, quality


def test_texts_of_the_quality_sample_stay_off_the_driver(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 3000), x -> concat('w', id * 3000 + x)))").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        quality.train(docs, labels, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 25_000_000
    finally:
        tracemalloc.stop()


def test_quality_learns_from_counts():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["good", "bad", "so", "so-so"], [3, 1, 1, 1] if i % 2 else [1, 3, 1, 1], k=30)).encode() for i in range(60)]
    at, bounds = quality.features(texts, 18)
    model = quality.fit([at[a:b] for a, b in zip(bounds, bounds[1:])], [i % 2 for i in range(60)])
    assert ((model.scores(texts) > 0.5) == [i % 2 for i in range(60)]).mean() > 0.9


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written, staged = [], neardup.staged
    monkeypatch.setattr(neardup, "staged", lambda df: written.append(1) or staged(df))
    edges = spark.createDataFrame([(5, 1), (1, 6), (9, 2), (9, 2), (3, 3)], "a long, b long")
    assert sorted(map(tuple, neardup.components(edges).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)]
    assert len(written) == 1


def test_components_of_drawn_graphs(spark):
    for seed, (nodes, n) in enumerate([(60, 40), (200, 300), (50, 400)]):
        rng = random.Random(seed)
        edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
        root = list(range(nodes))
        for _ in range(nodes):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        met = {x for a, b in edges if a != b for x in (a, b)}
        got = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, root[x]) for x in met)


@pytest.fixture
def tokens():
    return packing.WordTokens(packing.default_tokenizer())


def learned(tokens, monkeypatch):
    seen, learn = [], tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda parts: seen.extend(parts) or learn(parts))
    return seen


def test_words_with_marks_are_tokenized_as_their_words(tokens, monkeypatch):
    seen = learned(tokens, monkeypatch)
    tokens.batch(["A mumblefoo, mumblefoo.", "A mumblefoo?! mumblefoo"])
    assert [x for x in seen if "mumblefoo" in x] == [" mumblefoo"]


def test_words_of_several_batches_stay(tokens, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 5)
    seen = learned(tokens, monkeypatch)
    for i in range(4):
        tokens.batch([f"a often w{i}a w{i}b w{i}c"])
    assert seen.count(" often") == 1 and seen.count(" w0a") == 1


def test_ids_are_those_of_the_library(tokens, monkeypatch):
    rng = random.Random(3)
    pieces = ["don't", "it's,", "''", "x'", "x's.", "é.", "日本。", "日本.", "á,", "12,", "12", "_a_", "a_", "<|endoftext|>", "b<|endoftext|>", "<|endoftext|", "a\nb,", "a\n\nb.", "\t", "", " ", "a .", "ª.", "...", "Z!?", "Ωm,", " "]
    texts = ["", *pieces, *(" ".join(rng.choices(pieces, k=rng.randrange(2, 9))) for _ in range(1500))]
    for most in (700_000, 20):
        monkeypatch.setattr(packing, "KEPT_WORDS", most)
        for at in range(0, len(texts), 40):
            part = texts[at : at + 40]
            assert [x.tolist() for x in tokens.batch(part)] == [x.ids for x in tokens.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
