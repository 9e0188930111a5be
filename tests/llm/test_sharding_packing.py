import random
import zlib

import numpy as np

from plumbline.llm import packing as P
from plumbline.llm import sharding as S

SCHEMA = "doc_id long, text string, shard int, range int"


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "hot text of a group " * 3, 1, 1) for i in range(700)] + [(1000 + i, "x" * rng.randrange(1, 300) + f"é{i}", 1, 1) for i in range(1300)]
    rows += [(5000, None, 1, 1), (5001, "", 1, 1), (5001, "", 1, 1), (None, "n", 1, 1), (5002, "long " * 200, 1, 1)]
    got = S.shard(spark.createDataFrame(rows, SCHEMA), 8, ranges=32).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) < 1.1 * min(sizes)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_equal_texts_of_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 4}" * 5, 1, 1) for i in range(2000)]
    got = S.shard(spark.createDataFrame(rows, SCHEMA), 4, ranges=16).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 8


def test_repeated_rows_are_dealt(spark):
    rows = [(7, "the same row " * 3)] * 4000 + [(i, f"text {i} " * (1 + i % 9)) for i in range(100, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = S.shard(docs, 8).toPandas()
    assert len(got) == len(rows)
    total = got["size"].sum()
    by = got.groupby("shard")
    assert len(by) == 8 and (by["size"].sum() - total / 8).abs().max() < 0.02 * total
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in by)


def test_shard_of_few_and_no_rows(spark):
    assert S.shard(spark.createDataFrame([], SCHEMA)).collect() == []
    got = S.shard(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA)).collect()
    assert [(r["size"], r.slot) for r in got] == [(2, 0)]


def test_differencing_is_near_equal():
    rng = random.Random(4)
    for n, windows in ((1, 3), (40, 7), (200, 30), (3, 5)):
        sizes = [rng.randrange(1, 300) for _ in range(n)]
        groups = P.differenced(sizes, windows)
        assert sorted(i for g in groups for i in g) == list(range(n))
        assert len(groups) <= windows
        if n > 4 * windows:
            sums = [sum(sizes[i] for i in g) for g in groups]
            assert max(sums) - min(sums) < 60
    groups = P.packed([600, 600, 600], 1024)
    assert sorted(map(len, groups)) == [1, 1, 1]


def test_cuts_cover_every_token_once():
    for n in (1, 319, 320, 321, 1023, 1024, 1025, 5000):
        parts = P.cuts(n)
        assert [a for a, _ in parts] == np.cumsum([0] + [b for _, b in parts])[:-1].tolist()
        assert sum(b for _, b in parts) == n and max(b for _, b in parts) <= 1024


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(6)
    odd = ["", " ", "a  b", " lead", "trail ", "tab\t x", "x y z", "<|endoftext|> it's 12,000 é😀\n\n end", "don't  stop\r\nnow", None, "ünïcode wörds " * 900]
    texts = odd + [" ".join(rng.choice(["alpha", "Beta,", "x1", "ß", "don't", "…", "\nnew"]) for _ in range(rng.randrange(1, 900))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    placed = P.pack_documents(docs, block_docs=50)
    rows = placed.collect()
    expected = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts)}
    for i, ids in expected.items():
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(ids) == parts[0].doc_tokens
        for r in parts:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, expected.values()))
    assert len(by) <= 1.05 * total / 1024 + 4
    whole = {r.sequence_id: r for r in P.sequences(docs, placed, path).collect()}
    for r in rows[:50]:
        ids = whole[r.sequence_id].input_ids
        assert len(ids) == 1024
        assert ids[r.offset : r.offset + r.length] == expected[r.doc_id][r.start : r.start + r.length].tolist()


def test_many_equal_rows_are_dealt_over_blocks(spark):
    docs = spark.createDataFrame([(None, "the same text of a row " * 4)] * 30_000 + [(7, "x")] * 20_000, "doc_id long, text string")
    rows = P.pack_documents(docs).select("doc_id", "sequence_id", "length").collect()
    assert len(rows) == 50_000
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * total / 1024 + 60


def test_packing_of_no_rows(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
