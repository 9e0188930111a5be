"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard,
stored as flat neighbour arrays, with shard results merged.

Vectors are dealt by a hash of vec_id to shards of about `shard_rows`, up to MOST_SHARDS of them; beyond that shards grow, up to `most_rows`. Within a shard
equal vectors are one node. Nodes get levels drawn from a geometric law. On each level a node's candidates are its nearest nodes, found by matrix products
in blocks (a shard is bounded, and this costs a fraction of searching the growing graph in numpy), and its nearest nodes of the next level, so that every
node hangs on one that is met earlier. Neighbours are chosen among them so that none is nearer to another chosen one than to the node, and the links back are
pruned alike. One more component makes all norms equal, so that the largest inner product is the least distance. That component would hide all else beside a much longer
vector, so vectors are dealt by the nearest power of two of their norm first: within a shard norms differ by little, and a few long vectors are shards of their own.

A graph is one row of flat arrays, written to the shared folder. Blocks of queries meet each shard by an equality join on (shard, block);
both sides of a task are bounded. Every shard returns its k nearest with inner products of the original vectors in double
precision; the k best of all are kept, ties to the smaller vec_id.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id; vectors of another length
are not compared. Repeated vec_ids are rows of their own; a query is never its own neighbour. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import staged

SHARD_ROWS, MOST_SHARDS, MOST_ROWS, QUERY_ROWS = 16_384, 64, 131_072, 4096
LINKS, CANDIDATES, PARENTS, SEARCH_BEAM, BATCH, STEP = 16, 40, 8, 128, 256, 8


#: Tasks that build at most; with more shards some tasks build several.
MOST_TASKS = 20_000


def distances(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of ids (all vectors have one norm, up to a constant); -1 is nowhere."""
    d = -2 * np.matmul(vectors[ids], queries[:, :, None])[:, :, 0]
    d[ids < 0] = np.inf
    return d


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest `width` nodes that a best-first walk finds from the entries (queries x entries, -1 for none); nearest first."""
    n = len(queries)
    seen = np.zeros((n, size + 1), bool)  # the last column takes the marks of -1
    seen[:, size] = True
    rows = np.arange(n)[:, None]
    ids = np.full((n, width), -1)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)

    def meet(active: np.ndarray, new: np.ndarray) -> None:
        d = distances(vectors, new, queries[active])
        all_d, all_i = np.concatenate([dist[active], d], 1), np.concatenate([ids[active], new], 1)
        all_done = np.concatenate([done[active], new < 0], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :width]
        at = np.arange(len(active))[:, None]
        dist[active], ids[active], done[active] = all_d[at, best], all_i[at, best], all_done[at, best]

    entries = np.where(entries < 0, size, entries)
    seen[rows, entries] = True
    meet(np.arange(n), np.where(entries == size, -1, entries))
    active = np.arange(n)
    while len(active):
        open_d = np.where(done[active], np.inf, dist[active])
        pick = np.argsort(open_d, 1)[:, :STEP]
        at = np.arange(len(active))[:, None]
        ok = np.isfinite(open_d[at, pick])
        alive = ok.any(1)
        active, pick, ok = active[alive], pick[alive], ok[alive]
        if not len(active):
            break
        at = active[:, None]
        chosen = np.where(ok, ids[at, pick], -1)
        done[at, pick] = True
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        near = np.where(near < 0, size, near)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = size
        near[seen[at, near]] = size
        seen[at, near] = True
        meet(active, np.where(near == size, -1, near))
    return ids, dist


def diverse(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates, nearest first, at most `most` that are nearer to the node than to any chosen one; room left
    is filled with the nearest others."""
    n, width = ids.shape
    x = vectors[ids]
    between = -2 * np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    for c in range(width):
        nearest = np.where(chosen, between[:, c, :], np.inf).min(1)
        ok = (ids[:, c] >= 0) & (dist[:, c] < nearest) & (count < most)
        chosen[:, c] = ok
        count += ok
    rank = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _least(d: np.ndarray, count: int) -> np.ndarray:
    """Columns of the `count` least values of each row, or of all."""
    return np.argpartition(d, count - 1, 1)[:, :count] if d.shape[1] > count else np.tile(np.arange(d.shape[1]), (len(d), 1))


class Graph:
    """Flat arrays: nodes' vectors, for each level links (nodes x links, -1 for none), the entry node of the top level."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], entry: int):
        self.vectors, self.links, self.entry = vectors, links, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
        # nodes of high levels first, so that the entry never changes
        order = np.argsort(-level, kind="stable")
        vectors, level = vectors[order], level[order]
        graph = cls(vectors, [np.full((n, LINKS * 2 if k == 0 else LINKS), -1) for k in range(level[0] + 1)], 0)
        for k in range(len(graph.links)):
            graph._link(k, int((level >= k).sum()), int((level > k).sum()))
        graph.order = order
        return graph

    def _link(self, k: int, nodes: int, above: int) -> None:
        """Links of level k, whose nodes are the first `nodes`; the first `above` are on the next level too."""
        most = self.links[k].shape[1]
        source, target = [], []
        for a in range(0, nodes, BATCH):
            new = np.arange(a, min(a + BATCH, nodes))
            d = -2 * (self.vectors[new] @ self.vectors[:nodes].T)
            d[np.arange(len(new)), new] = np.inf
            near = _least(d, CANDIDATES)
            ids = np.concatenate([near, _least(d[:, :above], PARENTS)], 1) if above else near
            ids = np.sort(ids, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            dist = np.where(ids < 0, np.inf, np.take_along_axis(d, np.maximum(ids, 0), 1))
            best = np.argsort(dist, 1, kind="stable")
            ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
            ids = np.where(np.isfinite(dist), ids, -1)
            self.links[k][new] = picked = diverse(self.vectors, ids, dist, most)
            source.append(np.repeat(new, most))
            target.append(picked.ravel())
        if source:
            self._back(k, np.concatenate(source), np.concatenate(target))

    def _back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        ok = target >= 0
        order = np.argsort(target[ok], kind="stable")
        source, target = source[ok][order], target[ok][order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        most = self.links[k].shape[1]
        for a in range(0, len(nodes), BATCH):
            part = slice(a, a + BATCH)
            extra = np.full((len(nodes[part]), count[part].max()), -1)
            place = np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            extra[np.repeat(np.arange(len(extra)), count[part]), place] = source[first[part][0] : first[part][0] + count[part].sum()]
            ids = np.sort(np.concatenate([self.links[k][nodes[part]], extra], 1), 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            dist = distances(self.vectors, ids, self.vectors[nodes[part]])
            best = np.argsort(dist, 1, kind="stable")[:, : 2 * most]
            self.links[k][nodes[part]] = diverse(self.vectors, np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1), most)

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        entries = np.full((len(queries), 1), self.entry)
        for k in range(len(self.links) - 1, -1, -1):
            ids, _ = beam(self.vectors, self.links[k], queries, entries, width if k == 0 else 8, len(self.vectors))
            entries = ids[:, :4]
        return ids


def level_norms(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors, scaled by their largest entry, with one more component that makes all norms equal."""
    vectors = vectors / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)
    square = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


INDEX = "dim int, shard int, nodes int, vectors binary, levels int, links binary, starts binary, ids binary"
FOUND = "query_id long, vec_id long, score double"


def _valid(vectors: DataFrame) -> DataFrame:
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim")).withColumn("band", _band(F.col("embedding")))


def _band(vector: Column) -> Column:
    """The power of two that is nearest a vector's norm, worked out so that no square is too large."""
    largest = F.array_max(F.transform(vector, F.abs))
    rest = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + (x / largest) * (x / largest))
    return F.floor(F.log2(largest) + F.log2(rest) / 2 + 0.5).cast("int")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row of flat arrays for each shard, written to the shared folder; a shard is a task of its own."""
    rows = _valid(vectors)
    shards = F.greatest(F.least(F.ceil(F.count("*") / shard_rows), F.lit(MOST_SHARDS)), F.ceil(F.count("*") / most_rows))
    counts = rows.groupBy("dim", "band").agg(shards.cast("int").alias("shards"))
    below = F.coalesce(F.sum("shards").over(Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.withColumn("first", below.cast("int")))
    total = counts.agg(F.sum("shards")).first()[0] or 1
    dealt = rows.join(counts, ["dim", "band"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    dealt = dealt.repartition(min(8 * total, MOST_TASKS), "dim", "shard")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        x, ids = _matrix(table.column("embedding"), dim), table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = np.ascontiguousarray(x[order]) + 0.0, ids[order]
        _, first, node = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        graph = Graph.build(level_norms(x[first]), seed=shard)
        place = np.empty(len(first), np.int64)
        place[graph.order] = np.arange(len(first))
        node = place[node]
        member = np.argsort(node, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(first)))])
        links = b"".join(level.astype(np.int32).tobytes() for level in graph.links)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "nodes": pa.array([len(first)], pa.int32()), "vectors": [x[first][graph.order].tobytes()], "levels": pa.array([len(graph.links)], pa.int32()), "links": [links], "starts": [starts.astype(np.int64).tobytes()], "ids": [ids[member].tobytes()]})

    return staged(dealt.select("dim", "shard", "vec_id", "embedding").groupBy("dim", "shard").applyInArrow(run, INDEX))


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    n = row["nodes"]
    x = np.frombuffer(row["vectors"]).reshape(n, row["dim"])
    flat = np.frombuffer(row["links"], np.int32).astype(np.int64)
    links = [flat[: 2 * LINKS * n].reshape(n, -1)] + [flat[(k + 1) * LINKS * n : (k + 2) * LINKS * n].reshape(n, -1) for k in range(1, row["levels"])]
    return Graph(level_norms(x), links, 0), x, np.frombuffer(row["starts"], np.int64), np.frombuffer(row["ids"], np.int64)


def nearest(queries: DataFrame, index: DataFrame, k: int = 20, width: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest of the index, the query's own id left out."""
    asked = _valid(queries)
    blocks = max(1, -(-asked.count() // query_rows))
    shards = index.select(F.col("dim").alias("of"), (F.col("shard") + 0).alias("in_shard"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"))
    asked = asked.join(shards, F.col("dim") == F.col("of")).select("dim", F.col("in_shard").alias("shard"), "block", "vec_id", "embedding")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            graph, x, starts, ids = _load(row)
            names, asked = right.column("vec_id").to_numpy(), _matrix(right.column("embedding"), row["dim"])
            for a in range(0, len(asked), BATCH):
                q, own = asked[a : a + BATCH], names[a : a + BATCH]
                # scaled, which changes no order, so that float32 distances keep their precision
                scaled = q / np.abs(q).max(1, keepdims=True)
                nodes = graph.search(np.concatenate([scaled, np.zeros((len(q), 1))], 1).astype(np.float32), max(width, k + 1))
                for i in range(len(q)):
                    at = nodes[i][nodes[i] >= 0]
                    score = (x[at] * q[i]).sum(1)
                    # of one node's members only the k + 1 smallest ids can matter
                    size = np.minimum(starts[at + 1] - starts[at], k + 1)
                    member = ids[np.repeat(starts[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                    score = np.repeat(score, size)
                    other = member != own[i]
                    member, score = member[other], score[other]
                    best = np.lexsort((member, -score))[:k]
                    out[0].append(np.full(len(best), own[i]))
                    out[1].append(member[best])
                    out[2].append(score[best])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    keys = ("dim", "shard", "block")
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), build_index(vectors), 20)
