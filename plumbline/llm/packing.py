"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows of `capacity` tokens and a rest, the rest into even pieces of at most
`longest` tokens. Rests are packed in blocks of some hundred documents: partial partitions with opposing imbalances are merged, the one
with the widest spread with the next, its largest windows with the other's smallest, until one partition into near-equal
windows is left. If a window exceeds the capacity, the block is packed again with one window more.

A null text is packed like an empty one: the end token alone. Repeated rows are packed each, as documents of their own.
Strings of added tokens in texts become the ids that the library gives them. Extra columns are ignored. Only pieces' numbers are shuffled, never tokens;
`sequences` gathers the tokens themselves.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import sliced, staged

CAPACITY, LONGEST, BLOCK_DOCS, END = 1024, 320, 400, 0
#: Words whose ids a worker keeps; beyond, those met in one batch alone are worked out anew.
KEPT_WORDS = 450_000
#: Fixed value: ASCII marks, which the split of byte-level vocabularies always parts from the letters before them.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of sizes in `windows` groups of near-equal sums."""
    count = itertools.count()
    heap = [(-size, next(count), [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    spread = lambda part: part[0][0] - (part[-1][0] if len(part) == windows else 0)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(left) + len(right) - windows
        if both > 0:  # the smallest windows of one take the largest of the other, where no empty window is left
            tail = left[len(left) - both :]
            head = right[windows - len(left) :] if windows > len(left) else right
            spare = right[: windows - len(left)]
            met = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(tail, reversed(head), strict=True)]
            part = left[: len(left) - both] + spare + met
        else:
            part = left + right
        part.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-spread(part), next(count), part))
    return [group for _, group in heap[0][2]] if heap else []


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most capacity tokens; as few windows as differencing manages."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differenced(sizes, windows)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        windows += 1


def cuts(tokens: int, capacity: int = CAPACITY, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens."""
    full, rest = divmod(tokens, capacity)
    out = [(k * capacity, capacity) for k in range(full)]
    if rest:
        n = -(-rest // longest)
        edges = [full * capacity + rest * k // n for k in range(n + 1)]
        out += [(a, b - a) for a, b in itertools.pairwise(edges)]
    return out


#: Fixed value: characters that count as white space to this language or to the tokenizer.
_SPACES = frozenset(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


#: White space but for single spaces and line ends.
_ODD = re.compile("[" + "".join(sorted(_SPACES - {" ", "\n"})) + "]")


def _plain(text: str) -> bool:
    """Whether each space of a text stands alone between characters that are no white space."""
    return text[0] not in " \n" and text[-1] not in " \n" and "  " not in text and " \n" not in text and "\n " not in text and not _ODD.search(text)


def _parts(text: str) -> list[str]:
    """A text cut at each single space between two characters that are no white space: byte-level vocabularies always split a text before it."""
    words = text.split(" ")
    if _plain(text):
        return words
    closed = [k for i, w in enumerate(words) if not w or w[0] in _SPACES or w[-1] in _SPACES for k in ((i, i + 1) if not w else (i,) * (w[0] in _SPACES) + (i + 1,) * (w[-1] in _SPACES))]
    if not closed:
        return words
    # places between words, other than the ends, at which the text is not cut
    out, begin = [], 0
    for run in _runs(sorted({k for k in closed if 0 < k < len(words)})):
        out += words[begin : run[0] - 1]
        begin = run[1] + 1
        out.append(" ".join(words[run[0] - 1 : begin]))
    return out + words[begin:]


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """First and last of the runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


class WordTokens:
    """Token ids of texts, as `tokenizers` gives them for the vocabulary file (added tokens in a text are ids of their own, as the library has it).

    A text is cut before single spaces between characters that are no white space, where the tokenizer always splits too; the ids of each
    distinct part are kept, so that a worker pays for a part once; marks that end a part have ids apart from those of its letters. Parts with other white space are tokenized whole."""

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        # tokens that begin with a space: words after a space start with one and hold no other
        n = self.tokenizer.get_vocab_size()
        self.spaced = np.fromiter(((self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)), bool, n)
        held = json.loads(self.tokenizer.to_str())
        split = held["pre_tokenizer"] or {}
        self.parted = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not held["normalizer"]
        self.added = [x["content"] for x in held["added_tokens"]]
        self.clear()

    def clear(self) -> None:
        self.heads: dict[str, int] = {}  # parts that begin a text, and marks that end a part
        self.place: dict[str, int] = {}  # parts after a space
        # of each part where its ids begin and how many there are, and in how many batches it was met
        self.begin, self.size, self.met, self.parts = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.ids, self.used = np.zeros(1024, np.uint32), 0

    def forget(self) -> None:
        """Keeps what was met in several batches, if that is less than half."""
        keep = np.flatnonzero(self.met[: self.parts] > 1)
        if 2 * len(keep) > self.parts:
            self.clear()
            return
        number = np.full(self.parts, -1)
        number[keep] = np.arange(len(keep))
        self.heads, self.place = ({word: n for word, n in zip(of, number[np.fromiter(of.values(), np.int64, len(of))].tolist(), strict=True) if n >= 0} for of in (self.heads, self.place))
        self.ids = self._gathered(keep)
        size = self.size[keep]
        self.begin, self.size, self.met, self.parts, self.used = np.cumsum(size) - size, size, np.zeros(len(keep), np.int32), len(keep), len(self.ids)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of parts by number, in a row."""
        size = self.size[at]
        where = np.cumsum(size) - size
        return self.ids[np.repeat(self.begin[at] - where, size) + np.arange(int(size.sum()))]

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _keep(self, where: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> None:
        """Stores the ids of the parts numbered `where`; begin: where each one's start in flat."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[where], self.size[where] = self.used + begin, np.diff(begin, append=len(flat))
        self.used += len(flat)

    def _room(self, n: int) -> None:
        if self.parts + n > len(self.size):
            more = np.zeros(self.parts + 2 * n, np.int64)
            self.begin, self.size, self.met = np.concatenate([self.begin, more]), np.concatenate([self.size, more]), np.concatenate([self.met, more.astype(np.int32)])

    def _learn(self, parts: list[str]) -> None:
        """Parts that begin a text come as they are, all others after their space."""
        self._room(len(parts))
        plain = np.fromiter((part[:1] == " " and " " not in part[1:] for part in parts), bool, len(parts))
        joined = list(itertools.compress(parts, plain))
        where = self.parts + np.flatnonzero(plain)
        for at in range(0, len(joined), 20_000):
            flat = np.array(self._encoded(["".join(joined[at : at + 20_000])])[0], np.uint32)
            self._keep(where[at : at + 20_000], flat, np.flatnonzero(self.spaced[flat]))
        rest = self._encoded(list(itertools.compress(parts, ~plain)))
        if rest:
            size = np.fromiter(map(len, rest), np.int64, len(rest))
            self._keep(self.parts + np.flatnonzero(~plain), np.fromiter(itertools.chain.from_iterable(rest), np.uint32), np.cumsum(size) - size)
        self.parts += len(parts)

    def _numbers(self, of: dict[str, int], words: list[str], lead: str) -> np.ndarray:
        """The numbers of distinct parts in a table of parts; new ones are learned, each after `lead`."""
        at = np.fromiter(map(of.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new = [words[i] for i in missing.tolist()]
        bare = [word.rstrip(_MARKS) for word in new] if lead and self.parted and not any(x in " ".join(new) for x in self.added) else new
        # letters and the marks after them have ids of their own
        cut = [i for i, (a, b) in enumerate(zip(bare, new, strict=True)) if len(a) < len(b) and a[-1:].isalpha() and a[-1] < "\u0250"]
        marked = set(cut)
        first = [*(word for i, word in enumerate(new) if i not in marked)]
        first += dict.fromkeys(bare[i] for i in cut if bare[i] not in of).keys() - set(first)
        if first:
            of.update(zip(first, range(self.parts, self.parts + len(first)), strict=True))
            self._learn([lead + word for word in first])
        if cut:
            tails = [new[i][len(bare[i]) :] for i in cut]
            kinds = list(dict.fromkeys(tails))
            tail = dict(zip(kinds, self._numbers(self.heads, kinds, "").tolist(), strict=True))
            two = np.fromiter(itertools.chain.from_iterable(zip([of[bare[i]] for i in cut], map(tail.__getitem__, tails), strict=True)), np.int64, 2 * len(cut))
            size = self.size[two].reshape(-1, 2).sum(1)
            self._room(len(cut))
            number = np.arange(self.parts, self.parts + len(cut))
            self._keep(number, self._gathered(two), np.cumsum(size) - size)
            of.update(zip([new[i] for i in cut], number.tolist(), strict=True))
            self.parts += len(cut)
        at[missing] = np.fromiter(map(of.__getitem__, new), np.int64, len(new))
        self.met[at] += 1
        return at

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.parts > (self.kept or KEPT_WORDS):
            self.forget()
        # plain texts are cut, and equal parts found, in Arrow: a part costs Python something once a batch
        plain = [i for i, text in enumerate(texts) if text and _plain(text)]
        kept = set(plain)
        rest = [i for i, text in enumerate(texts) if text and i not in kept]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        others = [_parts(texts[i]) for i in rest]
        order = np.array(plain + rest, np.int64)
        many = np.concatenate([lists.value_lengths().to_numpy(), np.fromiter(map(len, others), np.int64, len(others))]).astype(np.int64)
        if not len(order):
            return [np.zeros(0, np.uint32) for _ in texts]
        parts = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array(list(itertools.chain.from_iterable(others)), pa.large_string())])
        heads = np.cumsum(many) - many
        first = np.zeros(len(parts), bool)
        first[heads] = True
        at = np.empty(len(parts), np.int64)
        for mask, of, lead in ((first, self.heads, ""), (~first, self.place, " ")):
            coded = parts.filter(pa.array(mask)).dictionary_encode()
            at[mask] = self._numbers(of, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), lead)[coded.indices.to_numpy()]
        del parts, coded, lists, others
        size = self.size[at]
        where = np.cumsum(size) - size
        gathered = self._gathered(at)
        out = [gathered[:0]] * len(texts)
        for i, ids in zip(order.tolist(), np.split(gathered, where[heads[1:]]), strict=True):
            out[i] = ids
        return out


_TOKENS: dict[str, WordTokens] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, longest: int = LONGEST) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32 and doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        for ids, raw in sliced(batches):
            rows = []
            for doc, tokens in zip(ids, _TOKENS[path].batch([t.decode() if t else "" for t in raw]), strict=True):
                data = memoryview(np.append(tokens, np.uint32(END)).astype("<u4").tobytes())
                n = len(tokens) + 1
                rows += [(doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n) for start, length in cuts(n, capacity, longest)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(parts: DataFrame, documents: int, capacity: int = CAPACITY, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces; documents: about how many there are, which sets the number of blocks."""
    blocks = max(1, documents // block_docs)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = table.sort_by("number")
        sizes = order.column("length").to_pylist()
        block = key[0].as_py()
        full = [[i] for i, n in enumerate(sizes) if n >= capacity]
        rest = [i for i, n in enumerate(sizes) if n < capacity]
        groups = full + [[rest[k] for k in sorted(g)] for g in (packed([sizes[i] for i in rest], capacity) if rest else [])]
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for number, group in enumerate(groups):
            at = 0
            for i in group:
                sequence[i], offset[i] = (block << 32) + number, at
                at += sizes[i]
        return order.drop_columns(["block", "number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # each piece is dealt by a number of its own, written first, so that however many rows are alike no block holds more than its share
    dealt = staged(parts.withColumn("number", F.monotonically_increasing_id())).withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, PACKED)


def sequences(docs: DataFrame, placed: DataFrame, path: str, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """The padded sequences themselves: sequence_id, length and input_ids, from unique doc_ids and their placed pieces."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        rows = table.to_pylist()
        text = rows[0]["text"] or ""
        ids = np.append(_TOKENS[path].batch([text])[0], np.uint32(END)).astype(np.int32)
        cut = [ids[r["start"] : r["start"] + r["length"]].tolist() for r in rows]
        return pa.table({"sequence_id": [r["sequence_id"] for r in rows], "offset": [r["offset"] for r in rows], "ids": pa.array(cut, pa.list_(pa.int32()))})

    parts = placed.join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").applyInArrow(run, "sequence_id long, offset long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("sequence_id", F.size("ids").alias("length"), F.concat("ids", F.array_repeat(F.lit(pad), F.lit(capacity) - F.size("ids"))).alias("input_ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, longest: int = LONGEST, block_docs: int = BLOCK_DOCS) -> DataFrame:
    return pack(pieces(docs, path or default_tokenizer(), capacity, longest), docs.select("doc_id").count(), capacity, block_docs)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
