import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bestfit as B

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def in_turn(sizes, capacity):
    """Sequences of best-fit, largest first, one piece after the other."""
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, size)
        gap = gaps.pop(k) - size if k < len(gaps) else capacity - size
        n += gap == capacity - size and k >= len(gaps)
        if gap:
            bisect.insort(gaps, gap)
    return n


def layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


@pytest.fixture
def spread(spark):
    """Sorted tables fall into many ranges, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sizes_of(kind, rng):
    return {
        "mixed": [min(2048, int(rng.expovariate(1 / 400)) + 1) for _ in range(3000)],
        "one size": [700] * 2500,
        "two sizes": [1500] * 400 + [5] * 9000,
        "tiny": [rng.randrange(1, 4) for _ in range(4000)],
    }[kind]


@pytest.mark.parametrize("kind, most", [("mixed", 1.03), ("one size", 1.02), ("two sizes", 1.02), ("tiny", 4.5)])
def test_about_as_few_as_in_turn(spread, kind, most):
    sizes = sizes_of(kind, random.Random(1))
    df = spread.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], SCHEMA).repartition(5)
    rows = B.pack(df).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    assert len(layout(rows, 2048)) <= most * in_turn(sizes, 2048) + 2


def test_runs_bring_every_piece_that_can_to_a_gap():
    # ranges upwards: (part, pieces, largest, gaps, smallest)
    assert B.runs([(0, 3, 10, 0, 0), (1, 2, 20, 0, 0), (2, 0, 0, 4, 25)]) == [(1, 0, 2, 2, 0, 1), (0, 0, 3, 2, 2, 2)]
    assert B.runs([(0, 0, 0, 5, 3), (1, 5, 9, 0, 0)]) == []
    found = B.runs([(0, 100, 5, 0, 0), (1, 0, 0, 3, 50), (2, 7, 60, 2, 70)])
    assert found == [(0, 70, 30, 1, 0, 10), (0, 42, 28, 2, 0, 14)]


def test_cuts():
    for n in (1, 2047, 2048, 2049, 4096, 5000):
        parts = B.cuts(n, 2048)
        assert [a for a, _ in parts] == np.cumsum([0] + [b for _, b in parts])[:-1].tolist()
        assert sum(b for _, b in parts) == n and all(b == 2048 for _, b in parts[1:])


def test_packing_of_texts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(B.default_tokenizer())
    rng = random.Random(6)
    texts = ["", None, " ", "ünïcode wörds " * 1900, "<|endoftext|> x"] + [" ".join(rng.choice(["alpha", "Beta,", "ß", "don't", "\nnew"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("kind", F.lit(1))
    rows = B.pack_documents(docs).collect()
    layout(rows, 2048)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, *cut) for k, cut in enumerate(B.cuts(len(ids), 2048))]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "the same text of a row " * 5)] * 3000 + [(1, None)] * 500, "doc_id long, text string")
    rows = B.pack_documents(docs).collect()
    assert len(rows) == 3500
    layout(rows, 2048)


def test_packing_of_no_rows(spark):
    assert B.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
