"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates,
scored as sparse dot products.

Features are word unigrams and bigrams, hashed into 2**bits weights. A word that repeats the one before it is hashed as
a fixed mark in the bigram, so that runs of one word share a feature. A feature's value is its share of the text's
n-grams times SCALE. Scoring gathers weights over the whole text.

Fitting takes at most about `bound` labelled texts (a documented bound, drawn by a hash of doc_id). Rows with a null
text or quality teach nothing; several labels of one document count as their rounded mean. A text without words (null,
empty) is scored by the bias alone. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fraction_of, id_crc, mixed, numbered, sliced, word_hashes

BITS, SCALE, BOUND, THRESHOLD = 18, 24.0, 6000, 0.3
#: Bytes map to themselves but for ASCII white space: letter case and marks are what tells good from bad.
KEEP_CASE = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c for c in range(256))


@dataclass
class QualityModel:
    weights: np.ndarray  # float32, 2**bits
    bias: float
    bits: int = BITS

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        at, bounds = ngrams(texts, self.bits)
        n = np.diff(bounds)
        total = np.zeros(len(texts))
        full = np.flatnonzero(n)
        if len(full):
            total[full] = np.add.reduceat(self.weights[at].astype(np.float64), bounds[:-1][full])
        return 1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / np.maximum(n, 1), -40, 40)))


def ngrams(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' unigrams and bigrams in a row, and where each text's begin (one more at the end)."""
    words, bounds = word_hashes(texts, KEEP_CASE)
    n = len(words)
    before = np.empty(n, np.uint64)
    if n:
        before[1:] = words[:-1]
        first = bounds[:-1][np.diff(bounds) > 0]
        before[first] = np.uint64(1)
    second = np.where(before == words, np.uint64(2), words)
    before = np.where(before == words, np.uint64(2), before)
    shift = np.uint64(64 - bits)
    out = np.empty(2 * n, np.int64)
    with np.errstate(over="ignore"):
        out[::2] = mixed(words * np.uint64(0xD6E8FEB86659FD93)) >> shift
        out[1::2] = mixed(before * np.uint64(0xA0761D6478BD642F) + second) >> shift
    return out, 2 * bounds


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's buckets in order, repeats too, in a row, and where each text's begin (one more at the end)."""
    at, bounds = ngrams(texts, bits)
    keys = np.repeat(np.arange(len(texts)) << bits, np.diff(bounds)) | at
    keys.sort()
    return (keys & ((1 << bits) - 1)).astype(np.int32), bounds


def fit(rows: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0, seed: int = 7) -> QualityModel:
    """Follow-the-regularised-leader over the sample's features, text by text, in a drawn order for each epoch."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            first = np.flatnonzero(np.diff(rows[i], prepend=-1))
            own = np.append(rows[i][first], 1 << bits)
            x = np.append(SCALE * np.diff(first, append=len(rows[i])) / max(1, len(rows[i])), 1.0)
            w = weights(own)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - labels[i]) * x
            z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / alpha * w
            n[own] += g * g
    w = weights(slice(None))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), bits)


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, bound: int = BOUND, bits: int = BITS, **options) -> QualityModel:
    """Fits on docs (doc_id, text) with a quality in labels (doc_id, quality); where: a condition on doc_id. The driver gets the drawn texts' features, not the texts."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.where(where) if where is not None else marked
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    count = marked.count()
    drawn = marked.where(fraction_of(F.col("doc_id")) < bound / max(1, count)).limit(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, texts in sliced(iter([batch])):
                at, bounds = features(texts, bits)
                kept = [batch.column(c).slice(done, len(ids)) for c in ("doc_id", "key", "quality")]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at))], names=["doc_id", "key", "quality", "at"])
                done += len(ids)

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("key")).join(F.broadcast(drawn), "doc_id")
    table = rows.mapInArrow(run, "doc_id long, key long, quality int, at array<int>").toArrow()
    # views of the few large arrays that came: an array for each text would stay in the driver's memory in pieces
    views = [values[a:b] for x in table.column("at").chunks for values, edges in [(x.values.to_numpy(), x.offsets.to_numpy())] for a, b in itertools.pairwise(edges)]
    order, marks = np.lexsort([table.column(c).to_numpy() for c in ("key", "doc_id")]).tolist(), table.column("quality").to_pylist()
    return fit([views[i] for i in order], [marks[i] for i in order], bits, **options)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score, the probability of quality 1, for every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns, in one pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in sliced(iter([batch])):
                yield batch.slice(at, len(ids)).filter(pa.array(held.value.scores(texts) >= threshold))
                at += len(ids)

    rows = numbered(docs, "doc_id", "text")
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def fold() -> Column:
    """Whether a document is held out; a null doc_id is not."""
    return F.coalesce(F.pmod(id_crc("doc_id"), F.lit(5)) == 0, F.lit(False))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold())
    return score(docs, model).select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
