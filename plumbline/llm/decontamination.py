"""Benchmark decontamination with training suffix arrays.

Each Arrow slice of the training documents is a shard. Its suffix array holds the word positions whose first
words occur in some test item (no other suffix can match so far), sorted by their first `window` words. Every test
suffix is binary-searched in it; the matching range gives all verbatim occurrences with their places, and runs of
occurrences along the same diagonal give the longest matches with their locations. Hit words, items and what is
removed all follow from these longest matches.

Test items are fetched and broadcast in blocks of at most BLOCK_WORDS words. With several, each has its own scan of the documents,
whose result is written before the next block is fetched: the driver and the executors hold one block at a time, however many items there are.

Words are lower-cased (A-Z) runs of ASCII letters, digits and bytes over 0x7F. A window is `window` consecutive words of
an item; an item with fewer words, but not none, is one window. Null or empty texts have no words and are never hit.
Repeated items count by their own item_id; equal (item_id, text) rows count once; a null item_id or text is no item.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER_ALNUM, discard, sliced, staged

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: A training suffix is indexed if so many of its first words occur in a row in a test item.
HEAD = 3

MATCHES = "doc_id long, item_id string, doc_start int, item_start int, length int"
HITS = "doc_id long, n_words long, hit array<int>, items array<string>"


class Tests:
    """The windows of a block of test items: word numbers, and every suffix that starts a window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.words = window, {}
        self.ids, rows, self.starts, self.owner, self.size = [], [], [], [], []
        heads = set()
        for item, text in items:
            words = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(LOWER_ALNUM).split()]
            if not words:
                continue
            owner = len(self.ids)
            self.ids.append(item)
            for start in range(max(1, len(words) - window + 1)):
                part = words[start : start + window]
                rows.append(part + [0] * (window - len(part)))
                self.starts.append(start)
                self.owner.append(owner)
                self.size.append(len(part))
                heads.add(tuple(part[:HEAD]))
        self.rows = np.array(rows, np.int64).reshape(-1, window)
        self.size = np.array(self.size, np.int64)
        self.short = {min(len(h), HEAD) for h in heads}
        # sorted keys of the first words, by how many there are
        base = np.int64(len(self.words) + 2)
        self.base = base
        self.heads = {n: np.unique(np.array([self._key(h) for h in heads if len(h) == n], np.uint64)) for n in self.short}

    def _key(self, words) -> int:
        key = 0
        for w in words:
            key = (key * int(self.base) + int(w)) % (1 << 64)
        return key

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows as (text, place in it, window), and each text's count of words."""
        get = self.words.get
        parts = [[get(w, 0) for w in t.translate(LOWER_ALNUM).split()] if t else [] for t in texts]
        counts = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not counts.sum():
            return none, none, none, counts
        # texts in a row; window zeros after each stop every match at its end
        gap = [0] * self.window
        row: list[int] = []
        for part in parts:
            row += part
            row += gap
        flat = np.array(row, np.int64)
        base = (np.cumsum(counts + self.window)) - counts - self.window
        known = flat > 0
        held = np.zeros(len(flat), bool)
        for n, keys in self.heads.items():
            ok = known.copy()
            key = np.zeros(len(flat), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    ok[: len(flat) - j] &= known[j:]
                    key *= np.uint64(self.base)
                    key[: len(flat) - j] += flat[j:].astype(np.uint64)
            at = np.flatnonzero(ok)
            found = np.searchsorted(keys, key[at])
            held[at[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == key[at])]] = True
        places = np.flatnonzero(held)
        if not len(places):
            return none, none, none, counts
        # the suffix array: places by their first `window` words, as big-endian bytes that compare like the words
        width = f"S{4 * self.window}"
        spread = flat[np.minimum(places[:, None] + np.arange(self.window), len(flat) - 1)]
        for j in range(1, self.window):
            spread[:, j] *= spread[:, j - 1] > 0  # a foreign word ends what can match
        keys = np.ascontiguousarray(spread.astype(">u4")).view(width).ravel()
        order = np.argsort(keys, kind="stable")
        array, places = keys[order], places[order]
        tests = np.ascontiguousarray(self.rows.astype(">u4")).view(width).ravel()
        low = np.searchsorted(array, tests, "left")
        # a test suffix of fewer words than the window matches every suffix that begins with it
        top = self.rows.copy()
        top[np.arange(self.window)[None, :] >= self.size[:, None]] = 0xFFFFFFFF
        high = np.searchsorted(array, np.ascontiguousarray(top.astype(">u4")).view(width).ravel(), "right")
        n = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(n)), n)
        place = places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        text = np.searchsorted(base, place, "right") - 1
        return text, place - base[text], window, counts

    def runs(self, texts: list[bytes | None]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The longest matches as (text, item, place in the text, place in the item, words), and each text's count of words."""
        text, place, which, counts = self.search(texts)
        item, start, size = np.array(self.owner, np.int64)[which], np.array(self.starts, np.int64)[which], self.size[which]
        order = np.lexsort((place, place - start, item, text))
        text, place, item, start, size = (x[order] for x in (text, place, item, start, size))
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(place - start) != 0) | (np.diff(place) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(text))[: len(first)] - 1
        return (text[first], item[first], place[first], start[first], place[last] - place[first] + size[last]), counts


def _passes(tests: DataFrame, id_col: str, text_col: str, block_words: int, work) -> list[DataFrame]:
    """work(broadcast items, None) for the only block of test items; with several of a bounded number of words, work(items, what the block before gave
    or False) for each, written before the next is fetched."""
    spark = tests.sparkSession
    items = tests.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).distinct()
    words = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, -(-words // (2 * block_words)))
    fetched = lambda rows: spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in sorted(rows.select("item_id", "text").collect())])
    if n == 1:
        return [work(fetched(items), None)]
    dealt = staged(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    out = []
    for b in range(n):
        held = fetched(dealt.where(F.col("block") == b))
        out.append(staged(work(held, out[-1] if out else False)))
        held.destroy()
    discard(dealt)
    return out


def _hits(docs: DataFrame, held, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(held.value, window)
        names = np.array(tests.ids, object)
        for ids, texts in sliced(batches):
            (text, item, place, _, length), counts = tests.runs(texts)
            hit: list = [[] for _ in ids]
            items: list = [[] for _ in ids]
            edge = np.flatnonzero(np.diff(text, prepend=-1))
            for a, b in zip(edge, np.append(edge, len(text))[1:], strict=True):
                spans = np.unique(np.stack([place[a:b], length[a:b]], 1), axis=0)
                hit[text[a]] = np.unique(np.concatenate([np.arange(s, s + n) for s, n in spans])).tolist()
                items[text[a]] = sorted(set(names[item[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "hit", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, HITS)


def contaminated_words(docs: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, the numbers of its words that lie in an occurrence of a test window, and the items that
    occur in it. One scan for each block of test items, usually one; for several, rows get a number first, by which blocks are then joined.

    Rows of docs keep their count for any number of blocks: repeated and null doc_ids give a row each. Extra columns of
    docs and tests are ignored. Without any item nothing is hit."""
    rows = None

    def work(held, before: DataFrame | bool | None) -> DataFrame:
        nonlocal rows
        if before is None:
            return _hits(docs, held, window)
        if rows is None:  # written once, so that every scan sees the same numbers
            rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
        return _hits(rows.select(F.col("row").alias("doc_id"), "text"), held, window)

    parts = _passes(tests, id_col, text_col, block_words, work)
    if rows is None:
        return parts[0]
    whole = functools.reduce(DataFrame.unionByName, parts)
    found = whole.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def longest_matches(docs: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every longest verbatim match of at least a window: doc_id, item_id, first word in document and item, words."""

    def work(held, _before: DataFrame | bool | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Tests(held.value, window)
            names = np.array(found.ids, object)
            for ids, texts in sliced(batches):
                (text, item, *rest), _ = found.runs(texts)
                columns = [pa.array(np.array(ids, object)[text], pa.int64()), pa.array(names[item], pa.string()), *(pa.array(x, pa.int32()) for x in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_start", "item_start", "length"])

        return docs.select("doc_id", "text").mapInArrow(run, MATCHES)

    return functools.reduce(DataFrame.unionByName, _passes(tests, id_col, text_col, block_words, work))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs without any occurrence of a test window, with all their columns; one pass for each block of items."""

    def work(held, before: DataFrame | bool | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Tests(held.value, window)
            for batch in batches:
                at = 0
                for ids, texts in sliced(iter([batch])):
                    clean = np.ones(len(ids), bool)
                    clean[found.runs(texts)[0][0]] = False
                    yield batch.slice(at, len(ids)).filter(pa.array(clean))
                    at += len(ids)

        return (before if isinstance(before, DataFrame) else docs).mapInArrow(run, docs.schema)

    return _passes(tests, id_col, text_col, block_words, work)[-1]


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, tests = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated_words(docs, tests).select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )
