"""LM scoring by online logistic context mixing.

A text is the sequence of its words (lower-cased A-Z runs of what is not ASCII white space) and one end, which is an empty word. A flag
tells whether a word repeats the one before it; any other word is spelled in bytes, closed by a space, and each byte in eight bits. For every bit
several predictors, each a counter at a hashed context (the last 1 to 4 bytes of the word, the whole word so far, with or without the
text's kind), give a probability. Their logits are added with weights that a gate chooses (how much the long contexts have been seen, and
the place in the word), and the sum is refined by an adaptive map from (logit, last byte) to probability. The bits of a text add
up to its log probability and its bits per byte.

The kind is followed online: after every KIND_STEP words of a text, to its end, the frequent words so far say which of KINDS
mixtures of words the text most resembles.

What is learned grows with the training texts. Counters come from all of them, by way of their word counts, in 2**LEAST_BITS slots or, up to
2**MOST_BITS, as many as there are distinct words. The kinds come from all of them too, by expectation maximisation whose sums Spark
adds up; only where it starts is taken from a few texts. The gated weights and the map are trained online, in small groups of words, on every word occurrence,
each left out of its own counters: every distinct (word, kind) pair is met with the weight of its count, in units of UNIT occurrences (smaller
ones for few, so that there are LEAST_UNITS), a frequent pair once for each unit. Tasks of about TASK_UNITS units go on from the same weights, which are averaged after each round.
Predictors then stay as they are, so that a text's score depends on the training texts alone.

Contexts end at a word's start, but for repeats and the kind; the README gives what contexts over words before would have cost.

Spark counts words, sums counters by slot, and scores each distinct word once; texts meet word scores by a join. The most frequent words, at
most FREQUENT, are broadcast; the rest of each text's words is joined by shuffling, so that no frequent word makes a hot key.

A null or empty text is the end alone. Repeated rows are scored each, and each counts in training. Without training texts all counts are
0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER_AND_SPACE, discard, id_crc, mixed, powers, sliced, staged

#: log2 of the counters' slots, least and most (5 bytes a slot are broadcast); for each predictor the reach in bytes (-1: the whole word so far) and whether it knows the kind.
LEAST_BITS, MOST_BITS = 22, 24
PREDICTORS = ((1, True), (2, True), (3, True), (4, False), (-1, False), (-1, True))
UNIT, LEAST_UNITS, TASK_UNITS, ROUNDS = 400, 20_000, 20_000, 1
FREQUENT, KEPT_COUNTS = 150_000, 150_000
KINDS, KIND_WORDS, KIND_STEP, KIND_ROUNDS = 12, 1000, 8, 10
#: Texts that the mixtures start from: the ones that lie farthest apart among so many.
START_TEXTS = 400
CLIP, MAP_STEPS, MAP_CONTEXTS, GATES = 12.0, 33, 256, 64
CHUNK = 12_000
END, CLOSE = b"", b" "
#: Counts of flags by the last three flags.
FLAG_CONTEXTS = 8


class Kinds:
    """Mixtures of frequent words. top: the words; sums: (kinds x words and one for size) of expected counts, None for no kinds at all."""

    def __init__(self, top: list[bytes], sums: np.ndarray | None, kinds: int = KINDS):
        self.place = {w: i for i, w in enumerate(top)}
        self.start, self.rows = np.zeros(kinds), np.zeros((len(top) + 1, kinds))
        self.likely = np.zeros((len(top), kinds))
        if sums is None or not len(top):
            return
        words_of = sums[:, :-1] + 0.5
        self.likely = np.log(words_of / words_of.sum(1, keepdims=True)).T
        size = sums[:, -1] + 1
        self.start = np.log(size / size.sum())
        self.rows[:-1] = self.likely - self.likely.mean(1, keepdims=True)

    @classmethod
    def started(cls, top: list[bytes], texts: np.ndarray, kinds: int = KINDS) -> Kinds:
        """From counts of the top words in some texts (texts x words): each kind begins with the texts nearest to one of those that lie farthest apart."""
        texts = texts[texts.sum(1) > 5]
        if not len(texts):
            return cls(top, None, kinds)
        unit = np.sqrt(texts / texts.sum(1, keepdims=True))
        far = [0]
        for _ in range(kinds - 1):
            far.append(int(np.argmin((unit @ unit[far].T).max(1))))
        share = np.eye(kinds)[np.argmax(unit @ unit[far].T, 1)]
        return cls(top, np.concatenate([share.T @ texts, share.sum(0)[:, None]], 1), kinds)

    def expected(self, texts: np.ndarray) -> np.ndarray:
        """The sums that texts (texts x words) add to the next mixtures."""
        likely = np.minimum(texts, 3) @ self.likely + self.start
        share = np.exp(likely - likely.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        return np.concatenate([share.T @ texts, share.sum(0)[:, None]], 1)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The kind at each word, from the words before its step, and at the end."""
        n = len(words)
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, n)
        steps = np.arange(0, n, KIND_STEP)
        total = np.zeros((len(steps) + 1, len(self.start)))
        if n:
            np.cumsum(np.add.reduceat(self.rows[at], steps, axis=0), axis=0, out=total[1:])
        kinds = np.argmax(total + self.start, 1)
        # the step that was last complete before each word
        return kinds[np.arange(n + 1) // KIND_STEP]


def runs(kinds: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, from, to) of the runs of one kind."""
    edge = np.flatnonzero(np.diff(kinds, prepend=-1))
    return [(int(kinds[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(kinds)], strict=True)]


@dataclass
class Spelled:
    """The bytes of words in a row, each closed, and hashed contexts of each byte."""

    data: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    contexts: np.ndarray  # predictors x bytes, uint64
    last: np.ndarray  # the byte before, 0 at a word's start


def spelled(words: list[bytes], kinds: np.ndarray) -> Spelled:
    data = np.frombuffer(b"".join(w + CLOSE for w in words), np.uint8)
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(data)) - begin[owner]
    wide = data.astype(np.uint64) + np.uint64(1)
    rows = np.zeros((len(PREDICTORS), len(data)), np.uint64)
    kind = (np.asarray(kinds).astype(np.uint64) + np.uint64(1))[owner] * np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        for k, (row, (reach, knows)) in enumerate(zip(rows, PREDICTORS, strict=True)):
            if reach < 0:
                terms = wide * powers(int(size.max()) + 1)[place]
                total = np.cumsum(terms) - terms
                row[:] = total - total[begin][owner] + place.astype(np.uint64)
            for j in range(1, reach + 1):
                ok = place >= j
                row[ok] = row[ok] * np.uint64(0x100000001B3) + wide[np.flatnonzero(ok) - j]
            row[:] = mixed(row + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            if knows:
                row[:] = mixed(row + kind)
    last = np.where(place > 0, np.roll(data, 1), 0)
    return Spelled(data, owner, place, rows, last)


def bits_of(s: Spelled, part: slice, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a run of bytes: bits (bytes x 8) and counters' slots (predictors x bytes x 8)."""
    data = s.data[part].astype(np.int64)
    shift = np.arange(7, -1, -1)
    bits = (data[:, None] >> shift) & 1
    node = (data[:, None] >> (shift + 1)) | (1 << np.arange(8))
    with np.errstate(over="ignore"):
        keys = s.contexts[:, part, None] + node.astype(np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93)
        slots = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - log2)
    return bits, slots.astype(np.int64)


def distinct(s: Spelled) -> tuple[Spelled, np.ndarray]:
    """One byte for each distinct (kind, word so far, byte), which fixes all contexts, and the place of every byte among them."""
    with np.errstate(over="ignore"):
        key = s.contexts[-1] ^ (s.data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    _, first, place = np.unique(key, return_index=True, return_inverse=True)
    return replace(s, data=s.data[first], owner=s.owner[first], place=s.place[first], contexts=s.contexts[:, first], last=s.last[first]), place


def chunks(s: Spelled) -> Iterator[slice]:
    for a in range(0, len(s.data), CHUNK):
        yield slice(a, min(a + CHUNK, len(s.data)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _inputs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3)))


def _seen(n: np.ndarray) -> np.ndarray:
    return (n > 0.5).astype(np.uint8) + (n > 6.5) + (n > 60.5)


def _gates(word: np.ndarray, three: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The weight set of each bit: how often the whole-word and the three-byte context were seen, and the place in the word."""
    return (word.astype(np.int64) * 4 + three) * 4 + np.minimum(place, 3)[:, None]


@dataclass
class Mixer:
    weights: np.ndarray  # gates x predictors
    map: np.ndarray  # last byte x steps, probabilities
    inputs: np.ndarray  # of each slot the logit, float32
    seen: np.ndarray  # and how often it was seen, in four grades
    hits: np.ndarray  # how much the map has learned at each place

    @property
    def log2(self) -> int:
        return len(self.inputs).bit_length() - 1

    @classmethod
    def new(cls, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
        start = 1 / (1 + np.exp(-np.linspace(-CLIP, CLIP, MAP_STEPS)))
        return cls(np.full((GATES, len(PREDICTORS)), 0.2, np.float32), np.tile(start, (MAP_CONTEXTS, 1)).astype(np.float32), _inputs(zeros, ones), _seen(zeros + ones), np.zeros(MAP_CONTEXTS * MAP_STEPS, np.float32))

    def predict(self, x: np.ndarray, gate: np.ndarray, last: np.ndarray):
        weights = self.weights[gate]
        dot = x[0] * weights[..., 0]
        for k in range(1, len(PREDICTORS)):
            dot += x[k] * weights[..., k]
        np.clip(dot, np.float32(-CLIP + 1e-4), np.float32(CLIP - 1e-4), out=dot)
        first = 1 / (1 + np.exp(-dot))
        at = (dot + np.float32(CLIP)) * np.float32((MAP_STEPS - 1) / (2 * CLIP))
        low = at.astype(np.int64)
        share = at - low
        context = last.astype(np.int64)[:, None] * MAP_STEPS + low
        flat = self.map.ravel()
        second = flat[context] * (1 - share) + flat[context + 1] * share
        return first, context, share, (first + second) / 2

    def foreseen(self, s: Spelled, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a run of bytes and their probabilities of being set."""
        bits, slots = bits_of(s, part, self.log2)
        gate = _gates(self.seen[slots[-1]], self.seen[slots[2]], s.place[part])
        return bits, self.predict(self.inputs[slots], gate, s.last[part])[-1]

    def learn(self, words: list[bytes], kinds: np.ndarray, units: np.ndarray, counts: tuple[np.ndarray, np.ndarray], rate: float = 0.02, group: int = 24, seed: int = 7) -> None:
        """Trains weights and map on words that weigh so many units each (at most 1), each left out of its own counters (zeros and ones)."""
        rows = np.arange(len(words))
        np.random.default_rng(seed).shuffle(rows)
        n, flat_map = self.hits, self.map.ravel()
        # groups weigh about as many units as words of a whole unit each would
        edges = np.flatnonzero(np.diff(np.cumsum(units[rows]) // group, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(rows)], strict=True):
            at = rows[a:b]
            s = spelled([words[i] for i in at], kinds[at])
            for part in chunks(s):
                bits, slots = bits_of(s, part, self.log2)
                zeros = np.maximum(counts[0][slots] - (1 - bits), 0).astype(np.float32)
                ones = np.maximum(counts[1][slots] - bits, 0).astype(np.float32)
                x = _inputs(zeros, ones)
                gate = _gates(_seen(zeros[-1] + ones[-1]), _seen(zeros[2] + ones[2]), s.place[part])
                first, context, share, _ = self.predict(x, gate, s.last[part])
                unit = np.repeat(units[at][s.owner[part]], 8).reshape(bits.shape)
                error = (bits - first) * unit
                step = np.zeros(self.weights.shape)
                flat = gate.ravel()
                for k in range(len(PREDICTORS)):
                    step[:, k] = np.bincount(flat, (x[k] * error).ravel(), GATES)
                self.weights += (rate * step / np.sqrt(np.maximum(np.bincount(flat, unit.ravel(), GATES), 1))[:, None]).astype(np.float32)
                for side, amount in ((context, (1 - share) * unit), (context + 1, share * unit)):
                    n += np.bincount(side.ravel(), amount.ravel(), len(n)).astype(np.float32)
                    flat_map += np.bincount(side.ravel(), (amount * (bits - flat_map[side]) / (n[side] + 12)).ravel(), len(flat_map)).astype(np.float32)

    def averaged(self, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Takes on the weights that several tasks went on to (occurrences, weights, map, hits), by how much each has learned from."""
        total = sum(n for n, *_ in parts)
        self.weights = (sum(n * w for n, w, _, _ in parts) / total).astype(np.float32)
        new = [np.maximum(h - self.hits, 0).reshape(self.map.shape) for *_, h in parts]
        over = sum(new)
        self.map = np.where(over > 0, sum(m * h for (_, _, m, _), h in zip(parts, new, strict=True)) / np.maximum(over, 1e-9), self.map).astype(np.float32)
        self.hits = self.hits + over.ravel() / len(parts)

    def scores(self, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """log10 probability of each word, spelled and closed."""
        s = spelled(words, kinds)
        one, place = distinct(s)
        total = np.empty(len(one.data))
        for part in chunks(one):
            bits, p = self.foreseen(one, part)
            total[part] = np.log10(np.where(bits == 1, p, 1 - p)).sum(1, dtype=np.float64)
        return np.bincount(s.owner, total[place], len(words))


def counted(words: list[bytes], kinds: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds words' bits, each word `counts` times, to the counters (slots x bit, float32)."""
    s = spelled(words, kinds)
    log2 = len(out).bit_length() - 1
    one, place = distinct(s)
    weight = np.bincount(place, counts[s.owner], len(one.data)).astype(np.float32)
    flat = out.ravel()
    for part in chunks(one):
        bits, slots = bits_of(one, part, log2)
        at = (2 * slots + bits).ravel()
        np.add.at(flat, at, np.broadcast_to(weight[part][:, None], slots.shape).ravel())


def _groups(table: pa.RecordBatch, least: int, most: int = 300_000) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """The (word, kind) pairs of a vocabulary batch with a count of at least `least`, in runs: words, kinds, counts, rows."""
    counts = np.stack([table.column(f"k{k}").fill_null(-1).to_numpy() for k in range(KINDS)], 1)
    rows, kinds = np.nonzero(counts >= least)
    words = table.column("word").to_pylist()
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[rows] + 1)
    edges = np.unique(np.append(np.searchsorted(size, np.arange(most, int(size[-1]) + most, most)), len(rows))) if len(rows) else []
    begin = 0
    for end in edges:
        if end > begin:
            part = slice(begin, end)
            yield [words[i] for i in rows[part].tolist()], kinds[part], counts[rows[part], kinds[part]].astype(np.float64), rows[part]
            begin = end


def split(text: bytes | None) -> list[bytes]:
    """The words of a text and its end."""
    return [*text.translate(LOWER_AND_SPACE).split(), END] if text else [END]


def word_counts(docs: DataFrame, training: Column, kinds: Kinds) -> DataFrame:
    """Of every word of docs, ends included: c, the count in training texts, and k0, k1, ..., by kind; null for a kind in which it never is."""
    held = docs.sparkSession.sparkContext.broadcast(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Counter] = [Counter() for _ in range(KINDS)]
        rest: list[set] = [set() for _ in range(KINDS)]

        def out() -> pa.RecordBatch:
            words, of, counts = [], [], []
            for kind in range(KINDS):
                more = rest[kind].difference(found[kind])
                words += [*found[kind], *more]
                counts += [*found[kind].values(), *([0] * len(more))]
                of += [kind] * (len(words) - len(of))
                found[kind].clear()
                rest[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(of, pa.int32()), pa.array(counts, pa.int64())], names=["word", "kind", "c"])

        for batch in batches:
            at = 0
            for ids, texts in sliced(iter([batch]), "training"):
                for mark, text in zip(ids, texts, strict=True):
                    words = split(text)
                    for kind, a, b in runs(held.value.of(words[:-1])):
                        (found if mark else rest)[kind].update(words[a:b])
                at += len(ids)
                if sum(map(len, found)) + sum(map(len, rest)) > KEPT_COUNTS:
                    yield out()
        yield out()

    rows = docs.select(training.alias("training"), "text").mapInArrow(run, "word binary, kind int, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(f"k{k}") for k in range(KINDS)])


SUMMED = "slot int, zeros float, ones float"


def counters(vocabulary: DataFrame, log2: int) -> DataFrame:
    """The counters of all predictors from a vocabulary, summed by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << log2, 2), np.float32)
        for batch in batches:
            for words, kinds, counts, _ in _groups(batch, 1):
                counted(words, kinds, counts, total)
        at = np.flatnonzero(total.any(1))
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part, 0]), pa.array(total[part, 1])], names=["slot", "zeros", "ones"])

    rows = vocabulary.where("c > 0").select("word", *[f"k{k}" for k in range(KINDS)]).mapInArrow(run, SUMMED)
    return rows.groupBy("slot").agg(F.sum("zeros").cast("float").alias("zeros"), F.sum("ones").cast("float").alias("ones"))


SCORED = "word binary, c long, base double, cost array<float>"


def mixtures(docs: DataFrame, training: Column) -> Kinds:
    """The kinds of the training texts: their most frequent words, then mixtures of them, each round's sums added up by Spark."""
    spark = docs.sparkSession
    texts = docs.where(training & F.col("text").isNotNull()).select("text")

    def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found.update(split(text)[:-1])
                if len(found) > KEPT_COUNTS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counts = texts.mapInArrow(counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(KIND_WORDS).collect()]
    place = {w: i for i, w in enumerate(top)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                at = np.fromiter(map(place.get, split(text)[:-1], repeat(-1)), np.int32)
                lists.append(at[at >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], names=["bag"])

    bagged = staged(texts.mapInArrow(bags, "bag array<int>").where(F.size("bag") > 5))

    def grid(column: pa.Array) -> np.ndarray:
        size, at = column.value_lengths().to_numpy(), column.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        return np.bincount(row * len(top) + at, minlength=len(size) * len(top)).reshape(len(size), len(top)).astype(np.float32)

    first = bagged.orderBy(F.xxhash64("bag"), "bag").limit(START_TEXTS).toArrow().column("bag").combine_chunks()
    kinds = Kinds.started(top, grid(first))
    width = len(top) + 1
    for _ in range(KIND_ROUNDS if len(first) else 0):
        held = spark.sparkContext.broadcast(kinds)

        def sums(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros((KINDS, width))
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    total += held.value.expected(grid(batch.column("bag").slice(a, 500)))
            yield pa.RecordBatch.from_arrays([pa.array(range(KINDS), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["kind", "sums"])

        added = bagged.mapInArrow(sums, "kind int, sums array<double>").select("kind", F.posexplode("sums").alias("at", "x")).groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros((KINDS, width))
        out[added.column("kind").to_numpy(), added.column("at").to_numpy()] = added.column("x").to_numpy()
        kinds = Kinds(top, out)
        held.destroy()
    discard(bagged)
    return kinds


LEARNED = "n long, weights binary, map binary, hits binary"


def units_met(vocabulary: DataFrame, n: int, size: int) -> DataFrame:
    """Every (word, kind) pair that occurs, its share of `size` units of all n occurrences: word, kind, unit, one; a pair of more than one unit in several rows, which share evenly."""
    units = F.col("n") * (size / n)
    times = F.ceil(units).cast("int")
    pairs = vocabulary.where("c > 0").select("word", F.posexplode(F.array(*[f"k{k}" for k in range(KINDS)])).alias("kind", "n")).where("n > 0")
    return pairs.select("word", "kind", (units / times).alias("unit"), F.explode(F.sequence(F.lit(1), times)).alias("one"))


def mixed_weights(vocabulary: DataFrame, zeros: np.ndarray, ones: np.ndarray, n: int) -> Mixer:
    """Weights and map, trained in tasks on all word occurrences and averaged after each round."""
    spark = vocabulary.sparkSession
    model = Mixer.new(zeros, ones)
    size = max(LEAST_UNITS, n // UNIT)
    tasks = max(1, size // TASK_UNITS)
    met = units_met(vocabulary, n, size)
    drawn = staged(met.select("word", "kind", "unit", F.pmod(F.xxhash64("word", "kind", "one"), F.lit(tasks)).cast("int").alias("task")))
    counts = spark.sparkContext.broadcast((zeros, ones))

    def learner(turn: int, state: tuple[np.ndarray, np.ndarray, np.ndarray]):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            order = table.sort_by([("word", "ascending"), ("kind", "ascending")])
            weights, map_, hits = (x.copy() for x in state)
            own = Mixer(weights, map_, np.empty(len(counts.value[0]), np.uint8), np.zeros(0, np.uint8), hits)
            own.learn(order.column("word").to_pylist(), order.column("kind").to_numpy(), order.column("unit").to_numpy(), counts.value, rate=0.02 / (1 + turn), seed=7 + turn)
            return pa.table({"n": [table.num_rows], "weights": [own.weights.tobytes()], "map": [own.map.tobytes()], "hits": [own.hits.tobytes()]})

        return run

    for turn in range(ROUNDS):
        found = drawn.groupBy("task").applyInArrow(learner(turn, (model.weights, model.map, model.hits)), LEARNED).collect()
        if found:
            found.sort(key=lambda r: (r.n, bytes(r.weights)))
            model.averaged([(r.n, np.frombuffer(r.weights, np.float32).reshape(model.weights.shape), np.frombuffer(r.map, np.float32).reshape(model.map.shape), np.frombuffer(r.hits, np.float32)) for r in found])
    np.clip(model.map, 1e-5, 1 - 1e-5, out=model.map)
    counts.destroy()
    discard(drawn)
    return model


def train(docs: DataFrame, training: Column) -> tuple[Kinds, DataFrame, dict]:
    """The kinds; every word of docs with its training count and its log10 probabilities (base; the model's by kind); the corpus's numbers."""
    spark = docs.sparkSession
    kinds = mixtures(docs, training)
    # in the order of words, so that words in a row share what is worked out for their common beginning
    vocabulary = staged(word_counts(docs, training, kinds).sort("word"))
    n, v = vocabulary.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = n or 0, v or 0
    log2 = min(MOST_BITS, max(LEAST_BITS, int(v).bit_length()))
    summed = staged(counters(vocabulary, log2))
    zeros, ones = np.zeros(1 << log2, np.float32), np.zeros(1 << log2, np.float32)
    for column, out in (("zeros", zeros), ("ones", ones)):
        part = summed.select("slot", column).toArrow()
        out[part.column("slot").to_numpy()] = part.column(column).to_numpy()
        del part
    model = mixed_weights(vocabulary, zeros, ones, n) if n else Mixer.new(zeros, ones)
    del zeros, ones
    held = spark.sparkContext.broadcast(model)
    floor, over = 0.1, n + 0.1 * (v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = np.full((batch.num_rows, KINDS), np.nan, np.float32)
            for words, of, _, rows in _groups(batch, 0):
                cost[rows, of] = held.value.scores(words, of)
            flat = pa.array(cost.ravel(), mask=np.isnan(cost.ravel()))
            base = np.log10((batch.column("c").to_numpy() + floor) / over)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * KINDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(base), lists], names=["word", "c", "base", "cost"])

    scored = staged(vocabulary.mapInArrow(run, SCORED))
    # the most frequent words: those over the least count that at most FREQUENT words reach
    least, total = 1 << 62, 0
    for r in scored.where("c > 0").groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT).collect():
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["c"]
    return kinds, scored, {"n": n, "least": least}


PARTS = "row long, doc_id long, training boolean, bytes long, tokens long, known long, base double, cost double, flags array<long>, word binary, kind int, times long, spelled long"


def _flags(repeat: np.ndarray) -> np.ndarray:
    """Counts of (last three flags, flag) of one text, as 16 numbers."""
    padded = np.concatenate([np.zeros(3, np.int64), repeat])
    context = padded[:-3] * 4 + padded[1:-2] * 2 + padded[2:-1]
    return np.bincount(context * 2 + repeat, minlength=2 * FLAG_CONTEXTS)


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Per row of docs: doc_id, training, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    kinds, scored, corpus = train(docs, training)
    rows = scored.where(F.col("c") >= F.lit(corpus["least"])).select("word", "base", "cost").toArrow()
    table = {w: i for i, w in enumerate(rows.column("word").to_pylist())}
    costs = np.nan_to_num(np.array(rows.column("cost").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32)).reshape(-1, KINDS)
    held = spark.sparkContext.broadcast((kinds, table, np.append(rows.column("base").to_numpy(), 0.0), np.concatenate([costs, np.zeros((1, KINDS), np.float32)])))
    del rows, costs, table
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, place, base, cost = held.value
        get = place.get
        context = TaskContext.get()
        number = context.partitionId() << 33 if context else 0
        for batch in batches:
            at = 0
            for ids, texts in sliced(iter([batch])):
                out: list[list] = [[] for _ in names[:9]]
                rest: tuple[list, ...] = ([], [], [], [], [])
                marks = batch.column("training").slice(at, len(ids)).to_pylist()
                at += len(ids)
                for doc, mark, text in zip(ids, marks, texts, strict=True):
                    number += 1
                    words = split(text)
                    n = len(words)
                    of = kinds.of(words[:-1])
                    index = np.fromiter(map(get, words, repeat(-1)), np.int64, n)
                    again = np.zeros(n, bool)
                    again[1:] = np.fromiter(map(eq, words[1:], words), bool, n - 1)
                    fresh = ~again
                    values = (number, doc, mark, len(text or b""), n, int((index >= 0).sum()), float(base[index].sum()), float(cost[index[fresh], of[fresh]].sum(dtype=np.float64)), _flags(again.astype(np.int64)).tolist())
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    rare = np.flatnonzero(index < 0)
                    for kind, a, b in runs(of[rare]) if len(rare) else ():
                        places = rare[a:b].tolist()
                        times = Counter([words[i] for i in places])
                        new = Counter(times)
                        new.subtract([words[i] for i in rare[a:b][again[rare[a:b]]].tolist()])
                        for column, value in zip(rest, ([number] * len(times), times, [kind] * len(times), times.values(), new.values()), strict=True):
                            column += value
                # the texts' own rows, then those of their rare words: what a row doesn't have is null without being listed
                heads = [pa.array(c, k) for c, k in zip(out, types, strict=False)] + [pa.nulls(len(ids), k) for k in types[9:]]
                yield pa.RecordBatch.from_arrays(heads, names=names)
                if rest[0]:
                    n = len(rest[0])
                    yield pa.RecordBatch.from_arrays([pa.array(rest[0], types[0]), *(pa.nulls(n, k) for k in types[1:9]), *(pa.array(c, k) for c, k in zip(rest[1:], types[9:], strict=True))], names=names)

    parts = staged(docs.select("doc_id", training.alias("training"), "text").mapInArrow(run, PARTS))
    heads = parts.where("word IS NULL")
    # flags: every context's share of repeats in training texts
    sums = heads.where("training").agg(*[F.sum(F.get("flags", F.lit(k))).alias(str(k)) for k in range(2 * FLAG_CONTEXTS)]).first()
    counts = np.array([x or 0 for x in sums], np.float64).reshape(-1, 2) + np.array([1.0, 0.02])
    cost = np.log10(counts / counts.sum(1, keepdims=True)).ravel()
    flags = sum((F.get("flags", F.lit(k)) * float(c) for k, c in enumerate(cost)), F.lit(0.0))
    rare = parts.where("word IS NOT NULL").select("row", "word", "kind", "times", "spelled").join(scored, "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_"),
        F.sum(F.col("times") * F.col("base")).alias("base_"),
        F.sum(F.col("spelled") * F.coalesce(F.get("cost", F.col("kind")).cast("double"), F.lit(0.0))).alias("cost_"),
    )
    none = F.lit(0.0)
    total = F.col("cost") + F.coalesce("cost_", none) + flags
    return heads.join(rare, "row", "left").select(
        "doc_id",
        "training",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("known_", F.lit(0))).alias("n_known"),
        F.lit(corpus["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_", none)).alias("base_score"),
        total.alias("score"),
        (-total * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = F.pmod(id_crc("doc_id"), F.lit(10)) != 0
    return score(docs, F.coalesce(training, F.lit(True))).select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
