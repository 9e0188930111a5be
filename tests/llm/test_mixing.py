"""Mixing: the kind is followed to the end of a text; all training texts are learned from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.mixing import KIND_STEP, Kinds


def _two_kinds() -> tuple[Kinds, list[bytes], list[bytes]]:
    one, two = ([b"%c%d" % (c, k) for k in range(40)] for c in b"ab")
    rng = np.random.default_rng(5)
    texts = [[words[i] for i in rng.integers(0, 40, 60)] for words in (one, two) for _ in range(20)]
    top = sorted({*one, *two})
    grid = np.array([[text.count(w) for w in top] for text in texts], float)
    kinds = Kinds.started(top, grid, kinds=2)
    for _ in range(5):
        kinds = Kinds(top, kinds.expected(grid[:25]) + kinds.expected(grid[25:]), kinds=2)
    return kinds, one, two


def test_kind_changes_late_in_a_text():
    kinds, one, two = _two_kinds()
    first, second = kinds.of(one * 3)[-1], kinds.of(two * 3)[-1]
    assert first != second
    found = kinds.of(one * 20 + two * 60)
    assert found[len(one) * 20] == first and found[-1] == second


def test_kind_is_that_of_all_words_before_the_step():
    kinds, one, two = _two_kinds()
    words = (one * 7 + two * 30 + one * 40)[:-3]
    found = kinds.of(words)
    assert len(found) == len(words) + 1
    for n in range(0, len(words) + 1, 37):
        seen = words[: n // KIND_STEP * KIND_STEP]
        total = kinds.start + sum((kinds.rows[kinds.place.get(w, -1)] for w in seen), np.zeros(2))
        assert found[n] == np.argmax(total)


def test_kinds_come_from_every_training_text(spark, monkeypatch):
    """The most frequent words are those of all 3,000 texts: one that only a few texts have, but often, is among them."""
    monkeypatch.setattr(mixing, "KIND_WORDS", 50)
    monkeypatch.setattr(mixing, "KIND_ROUNDS", 1)
    docs = spark.createDataFrame([(i, "a b c d e f " + (f"seldom{i // 60} " * 90 if i % 60 == 0 else f"x{i}")) for i in range(3000)], "doc_id long, text string")
    kinds = mixing.mixtures(docs, F.lit(True))
    assert set(kinds.place) == {*b"a b c d e f".split(), *(b"seldom%d" % k for k in sorted(range(50), key=str)[:44])}


def test_every_occurrence_is_learned_from(spark):
    """Words of less than one unit are met too: each pair's units add up to its share of all occurrences."""
    rows = [(f"r{i}".encode(), 1, *([1] + [None] * (mixing.KINDS - 1))) for i in range(200)] + [(b"often", 90_000, *([None] * (mixing.KINDS - 1) + [90_000]))]
    schema = "word binary, c long, " + ", ".join(f"k{k} long" for k in range(mixing.KINDS))
    met = mixing.units_met(spark.createDataFrame(rows, schema), 90_200, 225).groupBy("word").agg(F.sum("unit").alias("units"), F.max("unit").alias("most")).collect()
    assert len(met) == 201
    assert all(abs(r.units - (90_000 if bytes(r.word) == b"often" else 1) * 225 / 90_200) < 1e-6 and r.most <= 1 for r in met)
