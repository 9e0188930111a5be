"""Best-fit packing in bulk-synchronous rounds: documents and gaps range-sorted, matched by successor sweeps, conflicts resolved by rank.

A document's tokens longer than the capacity are cut into full pieces, the first piece being the rest. Full pieces and those over half the capacity open a
sequence each. The others meet the gaps in rounds:

* Sweep: waiting pieces and gaps are range-sorted by size, pieces before gaps of their size. Within a partition gaps are swept upwards; each takes the largest
  piece waiting below it, and again while one fits what is left. What the partition can't match is ranked: gaps by size, pieces by size.
* Between partitions: only the partitions' numbers of unmatched pieces and gaps reach the driver. A scan upwards gives each run of gaps the nearest run of pieces
  below (the last ones put by are taken first), as many pieces a gap as surely fit. Pieces and gaps of a run meet by an equality join on run and rank, so none of them
  wants what another has.
* Gaps are updated, and the sweep is repeated while it places a share of what waits.
* Then the larger half of the sizes that still wait opens new sequences, filled in order of size, and the rounds begin anew with their gaps.

Every round writes its tables to the shared folder, so a lost executor costs one round. Nothing of a round is held whole anywhere: a partition
holds its own range, sizes that many pieces have are split over partitions by number, and the driver gets one row for each partition.

A null text is packed like an empty one: the end token alone. Repeated rows are packed each, as documents of their own, null ids too. Extra columns, of any name, are
ignored. An empty table gives no rows. Tokens are never shuffled, only pieces' numbers.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import sliced, staged
from plumbline.llm.packing import END, WordTokens, default_tokenizer

CAPACITY = 2048
#: A sweep is repeated while it places more than this share of the pieces that wait.
SHARE = 0.02
#: Words whose ids a worker keeps; more than in packing, as no other step has left anything in these workers.
KEPT_WORDS = 1_200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
#: Waiting pieces, gaps and placed pieces in one table: kind, number (of a piece, or its sequence), size (of a piece, or the gap); a piece's place once it has one.
ROWS = f"kind int, number long, size long, {PIECES}, sequence_id long, offset long, part int, rank long"
WAITING, GAP, DONE = 0, 1, 2

_TOKENS: dict[str, WordTokens] = {}


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the rest, then full ones."""
    first = tokens % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, tokens, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path, KEPT_WORDS)
        for ids, raw in sliced(batches):
            rows = []
            for doc, tokens in zip(ids, _TOKENS[path].batch([t.decode() if t else "" for t in raw]), strict=True):
                data = memoryview(np.append(tokens, np.uint32(END)).astype("<u4").tobytes())
                rows += [(doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])) for k, (start, length) in enumerate(cuts(len(tokens) + 1, capacity))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Waiting:
    """Pieces that wait, by size, numbered as they come; the last come of a size goes first."""

    def __init__(self) -> None:
        self.by: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, piece: int) -> None:
        if size not in self.by:
            self.by[size] = []
            bisect.insort(self.sizes, size)
        self.by[size].append(piece)

    def take(self, most: int) -> tuple[int, int] | None:
        """(size, piece) of a largest piece of at most this size."""
        k = bisect.bisect_right(self.sizes, most) - 1
        if k < 0:
            return None
        size = self.sizes[k]
        piece = self.by[size].pop()
        if not self.by[size]:
            del self.by[size]
            del self.sizes[k]
        return size, piece


def swept(kind: list[int], size: list[int], number: list[int], capacity: int) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Of sorted rows: (sequence, offset) of the pieces placed, by row; what is left of the gaps that took some, by row."""
    waiting, placed, left = Waiting(), {}, {}
    for row, (k, n) in enumerate(zip(kind, size, strict=True)):
        if k == WAITING:
            waiting.add(n, row)
            continue
        gap = n
        while gap and (found := waiting.take(gap)):
            placed[found[1]] = (number[row], capacity - gap)
            gap -= found[0]
        if gap < n:
            left[row] = gap
    return placed, left


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _with(table: pa.Table, **columns: np.ndarray | pa.Array) -> pa.Table:
    for name, values in columns.items():
        k = table.schema.get_field_index(name)
        table = table.set_column(k, table.schema.field(k), pa.array(values).cast(table.schema.field(k).type))
    return table


def sweep(rows: DataFrame, capacity: int) -> DataFrame:
    """Rows after a sweep within each range; what isn't matched has its range as part and its rank there, from 0 for the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        kind, size = table.column("kind").to_numpy().copy(), table.column("size").to_numpy().copy()
        number = table.column("number").to_numpy()
        placed, left = swept(kind.tolist(), size.tolist(), number.tolist(), capacity)
        fresh = np.ones(len(kind), bool)
        sequence, offset = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for row, (sequence_id, at) in placed.items():
            sequence[row], offset[row] = sequence_id, at
        where = np.fromiter(placed, np.int64, len(placed))
        kind[where] = DONE
        touched = np.fromiter(left, np.int64, len(left))
        size[touched] = np.fromiter(left.values(), np.int64, len(left))
        fresh[touched] = False
        rank = np.full(len(kind), -1)
        for k in (WAITING, GAP):
            at = np.flatnonzero((kind == k) & fresh)
            rank[at] = np.arange(len(at))
        null = pa.array(kind != DONE)
        out = _with(table, kind=kind, size=size, part=np.full(len(kind), TaskContext.get().partitionId(), np.int32), rank=rank)
        masked = {"sequence_id": pa.array(sequence, mask=np.asarray(null)), "offset": pa.array(offset, mask=np.asarray(null))}
        out = _with(out, **masked)
        # a gap that is filled is a gap no more
        yield from out.filter(pa.array((kind != GAP) | (size > 0))).to_batches()

    order = ("size", "kind", "number")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ROWS)


def runs(counts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(part, first piece, pieces, part of the gaps, first gap, pieces a gap) for ranges upwards with their numbers of (part, pieces, largest piece, gaps,
    smallest gap): each run of gaps takes the nearest pieces of lower ranges."""
    stack, out = [], []
    for part, waiting, largest, gaps, smallest in sorted(counts):
        first = 0
        while gaps and stack:
            below, count, of = stack.pop()
            each = max(1, smallest // of)
            used = min(gaps, -(-count // each))
            taken = min(count, used * each)
            out.append((below, count - taken, taken, part, first, each))
            first, gaps = first + used, gaps - used
            if taken < count:
                stack.append((below, count - taken, of))
        if waiting:
            stack.append((part, waiting, largest))
    return out


def matched(rows: DataFrame, counts: list[tuple[int, int, int, int, int]], capacity: int) -> DataFrame | None:
    """Rows of a sweep, runs of pieces and gaps of different ranges brought together; None if there are no such runs."""
    found = [(k, *run) for k, run in enumerate(runs(counts))]
    if not found:
        return None
    spark = rows.sparkSession
    # a row for each partition at most twice over
    table = F.broadcast(spark.createDataFrame(found, "run int, low int, first long, pieces long, high int, gap long, each long"))
    waiting = (F.col("kind") == WAITING) & (F.col("rank") >= 0)
    gap = (F.col("kind") == GAP) & (F.col("rank") >= 0)
    place = F.col("rank") - F.col("first")
    below = rows.where(waiting).join(table.select("run", "low", "first", "pieces", "each"), (F.col("part") == F.col("low")) & (place >= 0) & (place < F.col("pieces")), "left")
    below = below.withColumn("slot", F.expr("(rank - first) div each")).drop("low", "first", "pieces", "each")
    at = F.col("rank") - F.col("gap")
    above = rows.where(gap).join(table.select("run", "high", "gap", F.expr("(pieces + each - 1) div each").alias("gaps")), (F.col("part") == F.col("high")) & (at >= 0) & (at < F.col("gaps")), "left")
    above = above.withColumn("slot", at).drop("high", "gap", "gaps")
    taken = above.where("run is not null").select("run", "slot", F.col("number").alias("to"), F.col("size").alias("room"))
    together = Window.partitionBy("run", "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    met = below.where("run is not null").join(taken, ["run", "slot"])
    met = met.withColumn("sequence_id", F.col("to")).withColumn("offset", F.lit(capacity) - F.col("room") + F.coalesce(F.sum("size").over(together), F.lit(0)))
    met = met.withColumn("kind", F.lit(DONE))
    used = below.where("run is not null").groupBy("run", "slot").agg(F.sum("size").alias("used"))
    smaller = above.where("run is not null").join(used, ["run", "slot"]).withColumn("size", F.col("size") - F.col("used")).where("size > 0")
    columns = rows.columns
    rest = rows.where(~(waiting | gap)).select(columns)
    return functools.reduce(DataFrame.unionByName, [x.select(columns) for x in (rest, below.where("run is null"), above.where("run is null"), met, smaller)])


def opened(rows: DataFrame, least: int, capacity: int, turn: int) -> DataFrame:
    """Waiting pieces over `least` placed in new sequences in order of size, with these as gaps; turn: of the opening, which numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        size = table.column("size").to_pylist()
        first = (turn << 55) | (TaskContext.get().partitionId() << 32)
        number, room, sequence, offset, gaps = first - 1, 0, [], [], []
        for n in size:
            if n > room:
                gaps.append([number, room])
                number, room = number + 1, capacity
            sequence.append(number)
            offset.append(capacity - room)
            room -= n
        gaps = [g for g in [*gaps[1:], [number, room]] if g[1]]
        out = _with(table, kind=np.full(len(size), DONE, np.int32), sequence_id=np.array(sequence), offset=np.array(offset))
        yield from out.to_batches()
        empty = {f.name: pa.nulls(len(gaps), f.type) for f in table.schema}
        new = {"kind": pa.array([GAP] * len(gaps), pa.int32()), "number": pa.array([g[0] for g in gaps], pa.int64()), "size": pa.array([g[1] for g in gaps], pa.int64())}
        yield pa.RecordBatch.from_pydict(empty | new, schema=table.schema)

    top = rows.where((F.col("kind") == WAITING) & (F.col("size") > least))
    return top.repartitionByRange(F.desc("size"), "number").sortWithinPartitions(F.desc("size"), "number").mapInArrow(run, ROWS)


def _counts(rows: DataFrame) -> list:
    """Of every range: waiting pieces, the largest, gaps, the smallest, pieces placed; -1 holds what took part in no range."""
    free = F.col("rank") >= 0
    of = lambda kind, x: F.when((F.col("kind") == kind) & free, x)
    return rows.groupBy("part").agg(
        F.count(of(WAITING, F.lit(1))).alias("waiting"), F.coalesce(F.max(of(WAITING, F.col("size"))), F.lit(0)).alias("largest"), F.count(of(GAP, F.lit(1))).alias("gaps"), F.coalesce(F.min(of(GAP, F.col("size"))), F.lit(0)).alias("smallest"), F.count(F.when(F.col("kind") == DONE, 1)).alias("done")
    ).collect()


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, each of at most capacity tokens."""
    numbered = staged(parts.withColumn("number", F.monotonically_increasing_id()))
    none = lambda kind: F.lit(None).cast(kind)
    own = F.col("length") > capacity // 2
    rows = numbered.select(F.when(own, DONE).otherwise(WAITING).alias("kind"), "number", F.col("length").alias("size"), *parts.columns, F.when(own, F.col("number")).alias("sequence_id"), F.when(own, 0).cast("long").alias("offset"), none("int").alias("part"), none("long").alias("rank"))
    done = [rows.where(F.col("kind") == DONE)]
    gaps = done[0].where(F.col("size") < capacity).select(F.lit(GAP).alias("kind"), "number", (F.lit(capacity) - F.col("size")).alias("size"), *[none(t).alias(c) for c, t in rows.dtypes[3:]])
    live, turn = rows.where(F.col("kind") == WAITING).unionByName(gaps), 0
    while True:
        step = staged(sweep(live, capacity))
        counts = _counts(step)
        before, ranges = sum(r.waiting + r.done for r in counts), len(counts)
        joined = matched(step, [(r.part, r.waiting, r.largest, r.gaps, r.smallest) for r in counts], capacity)
        if joined is not None:
            step = staged(joined)
        done.append(step.where(F.col("kind") == DONE))
        left = step.where(F.col("kind") == WAITING).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).first()
        if not left.n:
            break
        # gaps that are too small for all that waits are closed
        live = step.where((F.col("kind") == WAITING) | (F.col("kind") == GAP) & (F.col("size") >= left.least))
        if ranges > 1 and before - left.n > SHARE * before:
            continue  # one range has nothing left to match after its sweep
        turn += 1
        new = staged(opened(live, left.most // 2, capacity, turn))
        done.append(new.where(F.col("kind") == DONE))
        live = live.where((F.col("kind") == GAP) | (F.col("size") <= left.most // 2)).unionByName(new.where(F.col("kind") == GAP))
    return functools.reduce(DataFrame.unionByName, done).select(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path or default_tokenizer(), capacity), capacity)


def op12_bestfit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
