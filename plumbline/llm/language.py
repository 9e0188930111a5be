"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection.

A text's subwords are the byte n-grams of its lower-cased words, with word edges marked, and the words themselves. Each is hashed to a row of an
embedding table; a text is the average of its subwords' rows, over the whole text. After training, table and
softmax are one matrix (a row of logits a bucket), so that scoring sums rows, kept by word while a worker lives.

A temperature, fitted on a part of the sample that training never saw, calibrates the probabilities, and the rejection
threshold is the smallest score at which predictions on that part are right often enough.

Fitting takes at most `per_language` labelled texts of each language (a documented bound, drawn by a hash of doc_id);
prediction reads every whole text. A text that is null or has no letter gets `und`, score 0 and is not accepted. A
table without labelled texts teaches nothing: everything is `und`. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fraction_of, id_crc, sliced

BITS, WIDTH, SHORTEST, LONGEST = 16, 16, 2, 5
PER_LANGUAGE = 500
#: Words whose summed rows a worker keeps; beyond it they are worked out anew for each slice.
KEPT_WORDS = 300_000

UND = "und"


def subwords(words: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and the word that each belongs to."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes of the word from here on
    out, own = [], []
    key = np.zeros(len(data), np.uint64)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            key[: len(data) - n + 1] = key[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
            if n >= SHORTEST:
                ok = left >= n
                out.append((key[ok] * np.uint64(0x9E3779B97F4A7C15)) >> shift)
                own.append(owner[ok])
        whole = np.add.reduceat(data * (np.arange(len(data), dtype=np.uint64) - np.repeat(np.cumsum(size) - size, size).astype(np.uint64) + np.uint64(3)) ** np.uint64(5), np.cumsum(size) - size) if len(words) else np.zeros(0, np.uint64)
        out.append((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift)
        own.append(np.arange(len(words)))
    return np.concatenate(out).astype(np.int64), np.concatenate(own)


@dataclass
class LanguageModel:
    languages: list[str]
    rows: np.ndarray  # buckets x languages, float32
    temperature: float = 1.0
    threshold: float = 0.0
    bits: int = BITS

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def _features(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their shares of all its subwords."""
    out = []
    for text in texts:
        words = text.lower().encode().split()
        found = np.bincount(subwords(words, bits)[0]) if words else np.zeros(0, np.int64)
        at = np.flatnonzero(found)
        out.append((at, (found[at] / max(1, found.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[str], bits: int = BITS, width: int = WIDTH, epochs: int = 8, rate: float = 40.0, right: float = 0.98, seed: int = 7) -> LanguageModel:
    """Trains on labelled texts; a fifth of them, at least one, only calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32))
    rng = np.random.default_rng(seed)
    x, y = _features(texts, bits), np.array([languages.index(v) for v in labels])
    order = rng.permutation(len(x))
    held, kept = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
    kept = kept if len(kept) else order
    table = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    out = rng.normal(0, 0.3, (width, len(languages))).astype(np.float32)
    steps, done = epochs * len(kept), 0
    for _ in range(epochs):
        for i in rng.permutation(kept):
            at, share = x[i]
            done += 1
            if not len(at):
                continue
            lr = 0.2 * (1 - done / (steps + 1))
            mean = share @ table[at]
            p = mean @ out
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            table[at] -= (lr * rate * share)[:, None] * back[None, :]
    model = LanguageModel(languages, (table @ out).astype(np.float32), bits=bits)
    logits = np.array([s @ model.rows[a] if len(a) else np.zeros(len(languages)) for a, s in (x[i] for i in held)])
    truth = y[held]

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(model.probabilities(logits)[np.arange(len(truth)), truth] + 1e-12).mean()

    model.temperature = min(np.exp(np.linspace(-3, 2, 51)), key=loss)
    p = model.probabilities(logits)
    score, hit = p.max(1), p.argmax(1) == truth
    by = np.argsort(-score)
    share = np.cumsum(hit[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(share >= right)
    model.threshold = float(score[by][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, where: Column | None = None, per_language: int = PER_LANGUAGE, **options) -> LanguageModel:
    """Fits on a sample of docs (doc_id, text, lang) of about per_language texts of each language, drawn by hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(where) if where is not None else rows
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([], [])
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_language / r["count"]))) for r in counts])
    drawn = rows.where(fraction_of(F.col("doc_id")) < share).select("doc_id", "lang", "text").collect()
    drawn.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in drawn], [r.lang for r in drawn], **options)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability), accepted (the score reaches the rejection threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = held.value
        place: dict[bytes, int] = {}
        kept = np.zeros((0, len(m.languages) + 1), np.float32)
        for ids, raw in sliced(batches):
            if len(place) > KEPT_WORDS:
                place, kept = {}, kept[:0]
            texts = [t.decode().lower() if t else "" for t in raw]
            letters = [any(map(str.isalpha, t)) for t in texts]
            before, flat, size = len(place), [], []
            for t in texts:
                words = t.encode().split()
                flat += [place.setdefault(w, len(place)) for w in words]
                size.append(len(words))
            new = list(place)[before:]
            if new:
                at, own = subwords(new, m.bits)
                order = np.argsort(own, kind="stable")
                rows, own = m.rows[at[order]], own[order]
                edge = np.flatnonzero(np.diff(own, prepend=-1))
                kept = np.concatenate([kept, np.concatenate([np.add.reduceat(rows, edge, axis=0), np.diff(edge, append=len(own))[:, None].astype(np.float32)], 1)])
            names, scores, accepted = [UND] * len(ids), np.zeros(len(ids)), np.zeros(len(ids), bool)
            full = [i for i, ok in enumerate(letters) if ok and size[i]]
            if full and m.languages:
                size = np.array(size)
                begin = (np.cumsum(size) - size)[full]
                total = np.add.reduceat(kept[np.array(flat, np.int64)].astype(np.float64), begin, axis=0)
                p = m.probabilities(total[:, :-1] / total[:, -1:])
                for i, best, s in zip(full, p.argmax(1), p.max(1), strict=True):
                    names[i], scores[i], accepted[i] = m.languages[best], s, s >= m.threshold
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.coalesce(F.pmod(id_crc("doc_id"), F.lit(3)) == 1, F.lit(False))  # a null doc_id is in no fold; it is predicted but teaches nothing
    model = train(docs, ~fold)
    return predict(docs, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score", "accepted")
