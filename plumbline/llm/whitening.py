"""Whitening of embeddings by principal components, from moments that partitions merge by Chan's formula.

Entries become integers of 1/64 with an offset. The covariance is that of the distinct integer vectors. Each partition works out the count, exact sums and the scatter
about its own mean; partial moments are merged pairwise by treeReduce, where each merge adds the scatter of the two means. The driver takes the
eigenvectors of a matrix whose size depends on the vectors' length alone. A second pass whitens the distinct vectors, takes their covariance by the same moments and
reports its largest distance from the identity. A third one whitens every row.

Vectors of each length are a space of their own (one matrix of length x length for each; a table has few lengths, at most `MOST_LENGTHS`, or it is an error).
Rows whose vector is null or holds null or non-finite entries are left out; an empty vector has no components and gives no rows. A null vec_id is kept,
as are repeated rows. Entries whose integer would pass 2^53 are taken as that bound. A deviation that no long can hold is null. Components
without variance (eigenvalue below the rounding error of the largest) give null for whitened and 0 for explained, and are no part of the identity error; a single
distinct vector so has only such. An empty table gives no rows. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import staged

COMPONENTS, SCALE, OFFSET, MOST_LENGTHS = 16, 64, 1_000_000, 64
#: Vectors of which the scatter is worked out in one product, so that a worker's memory is bounded.
BLOCK = 4096
_BOUND = float(1 << 53)

WHITENED = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclasses.dataclass
class Moments:
    """Count, exact sums, mean and scatter (sum of outer products about the mean) of some vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        centred = x - mean
        # a block of integers below 2^50 can't overflow; whitened values need no exact sums
        whole = x.astype(np.int64)
        sums = whole.sum(0).astype(object) if np.abs(x).max(initial=0) < 1 << 50 else np.array([sum(c) for c in whole.T.tolist()], object)
        return cls(len(x), sums, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula for two parts."""
        n = self.n + other.n
        between = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(between, between) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + between * (other.n / n), scatter)


@dataclasses.dataclass
class Whitening:
    """Of vectors of one length: how many distinct there are, their sums, the mean, components (rows) over their deviations, and shares of variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    full: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, moments: Moments, components: int) -> Whitening:
        covariance = moments.scatter / moments.n
        value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components].T
        least = len(covariance) * np.finfo(float).eps * max(value[0], 0)
        full = value > least
        total = np.trace(covariance)
        explained = np.where(full, value / total, 0.0) if total > 0 else np.zeros(len(value))
        axes = np.where(full[:, None], vector / np.sqrt(np.where(full, value, 1))[:, None], 0.0)
        return cls(moments.n, [int(s) for s in moments.sums], np.array([s / moments.n for s in moments.sums], float), axes, explained, full)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Each vector's whitened components."""
        return (x - self.mean) @ self.axes.T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2 of integer vectors."""
        n, sums = self.n, np.array(self.sums, object)
        reach = max((abs(n * int(edge) - s) for edge in (x.min(initial=0), x.max(initial=0)) for s in self.sums), default=0)
        if len(self.sums) * reach * reach < 1 << 63 and max(map(abs, self.sums), default=0) < 1 << 63:
            away = n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return (away * away).sum(1).tolist()
        exact = (((n * x.astype(np.int64).astype(object) - sums) ** 2).sum(1)).tolist()
        return [d if d < 1 << 63 else None for d in exact]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the integer vector, of rows whose vectors have finite entries alone."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    within = lambda c: F.greatest(F.lit(-_BOUND), F.least(F.lit(_BOUND), c * SCALE))
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: (F.floor(within(c)) + OFFSET).cast("long"))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in blocks of at most BLOCK vectors of one length, and these as a matrix; empty vectors left out."""
    for batch in batches:
        lengths = np.diff(batch.column("x").offsets.to_numpy())
        for dim in np.unique(lengths[lengths > 0]).tolist():
            where = np.flatnonzero(lengths == dim)
            for at in range(0, len(where), BLOCK):
                part = batch.take(pa.array(where[at : at + BLOCK]))
                yield part, part.column("x").flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    out = a | {dim: a[dim].merged(m) if dim in a else m for dim, m in b.items()}
    if len(out) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return out


_PARTS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())])


def moments(distinct: DataFrame, model: dict[int, Whitening] | None = None) -> dict[int, Moments]:
    """Moments of the vectors x of each length, or of what a model makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for _, x in _blocks(batches):
            found = _merged(found, {x.shape[1]: Moments.of(x if model is None else model[x.shape[1]].apply(x))})
        rows = [{"dim": dim, "n": m.n, "sums": [str(s) for s in m.sums], "mean": m.mean.tobytes(), "scatter": m.scatter.tobytes()} for dim, m in found.items()]
        yield pa.RecordBatch.from_pylist(rows, _PARTS)

    def read(row) -> dict[int, Moments]:
        mean = np.frombuffer(row["mean"])
        return {row["dim"]: Moments(row["n"], np.array([int(s) for s in row["sums"]], object), mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1))}

    parts = distinct.where(F.size("x") > 0)
    if parts.isEmpty():
        return {}
    return parts.mapInArrow(run, "dim int, n long, sums array<string>, mean binary, scatter binary").rdd.map(read).treeReduce(_merged)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of the vectors x of each length; distinct: each of them once, in a table that is read twice."""
    model = {dim: Whitening.of(m, components) for dim, m in moments(distinct).items()}
    for dim, m in moments(distinct, model).items():
        full = model[dim].full
        away = np.abs(m.scatter / m.n - np.eye(len(full)))[np.ix_(full, full)]
        model[dim].identity_error = float(away.max(initial=0.0))
    return model


def whiten(rows: DataFrame, model: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of all rows of vec_id and x."""
    schema = pa.schema([("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            m = model[x.shape[1]]
            count, k = len(x), len(m.full)
            value = m.apply(x)
            columns = [
                np.tile(np.arange(1, k + 1, dtype=np.int32), count),
                np.full(count * k, m.n),
                pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
                pa.array(value.ravel(), mask=np.tile(~m.full, count)),
                np.tile(m.explained, count),
                np.full(count * k, m.identity_error),
            ]
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(count), k)))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]], names=["vec_id", *schema.names])

    return rows.mapInArrow(run, WHITENED.format(dict(rows.dtypes)["vec_id"]))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whiten(rows, fit(staged(rows.select("x").distinct())))
