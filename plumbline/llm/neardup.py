"""MinHash near-duplicates by a signature-coordinate inverted join.

Each document's set of word shingles gives COORDINATES minima. Documents with equal sets become one class (by a 128-bit
hash of the set). Classes are posted under their (coordinate, value) pairs. Two classes whose signatures agree in at least `matches`
coordinates must meet in the prefixes of their pairs, taken rarest first: pairs of one document alone are skipped, as is every class with
fewer than `matches` shared pairs, and only the rarest (shared - matches + 1) pairs are posted. Frequent pairs, such as those of
a passage that many documents share, are so skipped unless whole documents agree.

Classes that meet in a posting form loose clusters (connected components of class and smallest class of the posting). Within a
cluster, in blocks of bounded size, the collisions of every pair are counted by merging the postings of the block (a sparse-count product over its
tokens); pairs of at least `matches` collisions are retained, and those alone are confirmed on full sets. Only a spanning
forest of links leaves a task. A cluster too large for a block is first compared with some central classes; classes linked to them
are done, and the rest is compared with all blocks. So no task holds a group, no group is expanded into pairs, and no
link is lost but for signatures that agree in fewer than `matches` coordinates: with 40 of 64 at a similarity of 0.85 about one pair in a million.

Words are lower-cased (A-Z) runs of what is not ASCII white space. Texts of fewer words than a shingle are one shingle; texts without
words (null, empty, blank) have none, are linked with nothing and are their own component. Rows of one doc_id
are one document for linking, represented by the text of the set that names its class if texts differ; they all get a component. A null doc_id is linked with nothing, and its component is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER_AND_SPACE, discard, mixed, sliced, staged, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
COORDINATES = 64
#: Agreements asked of signatures: so many standard deviations fewer than expected of a pair at the threshold.
DEVIATIONS = 5
#: A block holds at most so many classes, and about so many shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 600, 600_000
#: Clustered classes (40 bytes each) up to which they are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Central classes with which a large cluster is compared first.
PIVOTS = 3

_SEEDS = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles in a row (a shingle may repeat), and where each text's begin (one more at the end)."""
    words, bounds = word_hashes(texts, LOWER_AND_SPACE)
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(n)])
    if not edges[-1]:
        return np.zeros(0, np.uint64), edges
    first = np.repeat(bounds[:-1] - edges[:-1], n) + np.arange(edges[-1])
    size = np.repeat(np.minimum(counts, k), n)
    out = size.astype(np.uint64)
    short = bool((size < k).any())
    with np.errstate(over="ignore"):
        for j in range(k):
            at = words[np.minimum(first + j, len(words) - 1)]
            term = mixed(out * np.uint64(0x9E3779B97F4A7C15) + at)
            out = np.where(size > j, term, out) if short else term
    return out, edges


def distinct_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_hashes, each text's hashes sorted and distinct."""
    found, edges = shingle_hashes(texts, k)
    if not len(found):
        return found, edges
    owner = np.repeat(np.arange(len(texts)), np.diff(edges))
    order = np.argsort(found)
    order = order[np.argsort(owner[order], kind="stable")]
    found, owner = found[order], owner[order]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])


def minima(found: np.ndarray, edges: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Tokens, one for each coordinate and its least value, for every text with shingles (others: zeros)."""
    out = np.zeros((len(edges) - 1, coordinates), np.uint64)
    full = np.flatnonzero(np.diff(edges))
    if not len(full):
        return out
    begin = edges[:-1][full]
    with np.errstate(over="ignore"):
        for c in range(coordinates):
            least = np.minimum.reduceat((found ^ _SEEDS[2 * c]) * (_SEEDS[2 * c + 1] | np.uint64(1)), begin)
            out[full, c] = mixed(least + _SEEDS[c])
    return out


SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, tokens array<long>"


def _sums(found: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each set, in two rows."""
    out = np.zeros((2, len(edges) - 1), np.uint64)
    full = np.flatnonzero(np.diff(edges))
    with np.errstate(over="ignore"):
        for row, seed in zip(out, (0xA24BAED4963EE407, 0x9FB21C651E98DF25), strict=True):
            if len(full):
                row[full] = np.add.reduceat(mixed(found ^ np.uint64(seed)), edges[:-1][full])
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, and the signature as tokens of (coordinate, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sliced(batches):
            found, edges = distinct_sets(texts, shingle)
            n = np.diff(edges)
            full = np.flatnonzero(n)
            sums, tokens = _sums(found, edges), minima(found, edges)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, tokens.shape[1], 0))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[full].view(np.int64).ravel()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


#: Edges of one node from which it is hot: at least so many, and so many that only HOT_NODES nodes can have them.
HOT_EDGES, HOT_NODES = 1000, 10_000


def shape(edges: DataFrame) -> tuple[int, int, bool]:
    """Of edges (a, b), each once: how many there are, the most that one node has, and whether every node has one root at most, and no root has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    open_ = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))
    size, most, unfinished = nodes.agg(F.sum("out"), F.max(F.col("out") + F.col("into")), F.max(open_.cast("int"))).first()
    return size or 0, most or 0, not unfinished


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, each written to the shared folder, until every node points to a root. Nodes of very many edges, of
    which there are few, are broadcast with their smallest neighbour, so that no task gathers such a node's edges."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        size, most, done = shape(edges)
        if done:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count("*").alias("n"))
        up = both.where("b > a")
        many = max(HOT_EDGES, 2 * size // HOT_NODES)
        cold = up
        if most > many:
            hot = F.broadcast(least.where(F.col("n") > many).select("a", "root"))
            cold = up.join(hot, "a", "left_anti")
        large = cold.join(least.select("a", "root"), "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        if most > many:
            large = large.union(up.join(hot, "a").select(F.col("b").alias("a"), F.col("root").alias("b")))
        # a root is no greater than the node it is of, and so less than its greater neighbours
        small_least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).union(small_least.select("a", F.col("root").alias("b")))
        before, edges = edges, staged(small.where("a <> b").distinct())
        discard(before)
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own)


def matches_of(percent: int, coordinates: int = COORDINATES) -> int:
    """Agreements that all but about one in a million pairs at the threshold reach."""
    share = percent / 100
    return max(1, int(coordinates * share - DEVIATIONS * (coordinates * share * (1 - share)) ** 0.5))


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, class, central) of the rarest shared tokens of every class that shares at least `matches` tokens.

    central: higher for classes whose tokens are frequent, as those of the text that others are copies of."""
    tokens = classes.select("class", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = tokens.join(shared, "token").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("held"), F.sum(F.log2("n")).alias("central"))
    kept = held.where(F.size("held") >= matches).select("class", "central", F.explode(F.slice("held", F.lit(1), F.size("held") - (matches - 1))).alias("x"))
    return kept.select(F.col("x.token").alias("token"), "class", "central")


def _counts(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all others, by matrix products over the shingles that both sides hold."""
    both = np.intersect1d(np.unique(np.concatenate(sets)), np.unique(np.concatenate(others)), assume_unique=True)
    out = np.zeros((len(sets), len(others)), np.float32)

    def rows(part: list[np.ndarray], low: int, high: int) -> np.ndarray:
        grid = np.zeros((len(part), high - low), np.float32)
        flat = np.concatenate(part)
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        at = np.searchsorted(both, flat)
        ok = (at < len(both)) & (at >= low) & (at < high)
        ok[ok] = both[at[ok]] == flat[ok]
        grid[owner[ok], at[ok] - low] = 1
        return grid

    step = max(64, 4_000_000 // max(len(sets), len(others), 1))
    for low in range(0, len(both), step):
        high = min(low + step, len(both))
        out += rows(sets, low, high) @ rows(others, low, high).T
    return out


def _forest(ids: np.ndarray, others: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (rows with columns)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(ids[i])), root(int(others[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(others[j])))
    return out


def _linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    both = _counts(sets, others).astype(np.int64)
    union = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in others])[None, :] - both
    return 100 * both >= percent * union


def _lists(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, edges = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[edges[i] : edges[i + 1]] for i in order]


EDGES = "a long, b long"


def _compare(percent: int, matches: int):
    """Links of a block's left classes with its others, or of all with each other: retained by collisions, confirmed on full sets."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, left = ids[order], table.column("left").to_numpy()[order]
        sets, tokens = _lists(table.column("found"), order), _lists(table.column("tokens"), order)
        rows, others = np.flatnonzero(left), np.flatnonzero(~left) if not left.all() else np.arange(len(ids))
        edges_out = []
        if len(rows) and len(others):
            retained = _counts([tokens[i] for i in rows], [tokens[i] for i in others]) >= matches
            retained &= ids[rows][:, None] != ids[others][None, :]
            rows_at, others_at = np.flatnonzero(retained.any(1)), np.flatnonzero(retained.any(0))
            if len(rows_at):
                confirmed = _linked([sets[i] for i in rows[rows_at]], [sets[i] for i in others[others_at]], percent)
                edges_out = _forest(ids[rows[rows_at]], ids[others[others_at]], confirmed & retained[np.ix_(rows_at, others_at)])
        return pa.table({"a": pa.array([a for a, _ in edges_out], pa.int64()), "b": pa.array([b for _, b in edges_out], pa.int64())})

    return run


def links(docs: DataFrame, clustered: DataFrame, percent: int, shingle: int, repeated: bool = True, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, list[DataFrame]]:
    """A spanning forest (a, b) of the links within clusters, and what was written for it. clustered: class, cluster, central, n_shingles, set_a,
    set_b; docs: doc_id, text; repeated: whether a doc_id may have several rows."""
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / block_classes), F.ceil(F.col("total") / block_shingles)).cast("int")
    placed = clustered.drop("n_shingles").join(sizes.select("cluster", parts.alias("parts")), "cluster")
    placed = F.broadcast(placed) if clustered.count() <= BROADCAST_ROWS else placed
    members = docs.select(F.col("doc_id").alias("class"), "text").join(placed, "class").select("class", "cluster", "central", "parts", "set_a", "set_b", "text")
    matches = matches_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in sliced(iter([batch]), "class"):
                found, edges = distinct_sets(texts, shingle)
                columns = [batch.column(c).slice(at, len(ids)) for c in ("class", "cluster", "central", "parts")]
                # of several texts of one doc_id only that of the class's own set counts
                mine = np.all(_sums(found, edges) == np.stack([batch.column(c).slice(at, len(ids)).to_numpy() for c in ("set_a", "set_b")]), axis=0)
                at += len(ids)
                tokens = minima(found, edges)
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * tokens.shape[1], pa.int32()), pa.array(tokens.view(np.int64).ravel()))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["class", "cluster", "central", "parts", "found", "tokens"]).filter(pa.array(mine))

    sets = members.mapInArrow(run, "class long, cluster long, central double, parts int, found array<long>, tokens array<long>")
    sets = staged(sets.dropDuplicates(["class"]) if repeated else sets)
    held = ["class", "cluster", "found", "tokens"]
    compare = _compare(percent, matches)
    small = sets.where("parts = 1").select(*held, F.lit(True).alias("left")).groupBy("cluster").applyInArrow(compare, EDGES)
    if not sets.where("parts > 1").limit(1).count():
        return small, [sets]
    # large clusters: first against their central classes
    large = sets.where("parts > 1")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("central"), "class"))
    tops = large.select("class", "cluster", "central").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    pivots = staged(large.join(tops.select("class"), "class", "left_semi").select(*held))
    block = F.pmod(F.xxhash64("class"), F.col("parts"))
    dealt = large.select(*held, "parts", block.alias("block"))
    spread = pivots.join(large.select("cluster", "parts").distinct(), "cluster").select(*held, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    first = dealt.select(*held, "block", F.lit(True).alias("left")).unionByName(spread.select(*held, "block", F.lit(False).alias("left")))
    star = staged(first.repartition("cluster", "block").groupBy("cluster", "block").applyInArrow(compare, EDGES))
    done = components(star)
    labelled = large.join(done, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    # the component of each cluster's most central class needs no more comparisons within itself
    main = staged(labelled.join(pivots.select(F.col("class").alias("pivot")), F.col("class") == F.col("pivot")).groupBy("cluster").agg(F.max_by("root", F.struct("central", "root")).alias("main")))
    few = (lambda x: F.broadcast(x)) if main.count() <= BROADCAST_ROWS else (lambda x: x)  # a row for each large cluster
    rest = staged(labelled.join(few(main), "cluster").where("root <> main").select(*held, "parts"))
    counts = staged(rest.groupBy("cluster").agg(F.ceil(F.count("*") / block_classes).cast("int").alias("rows")))
    left = rest.join(few(counts), "cluster").withColumn("row", F.pmod(F.xxhash64("class"), F.col("rows"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*held, "row", "block", F.lit(True).alias("left"))
    right = dealt.join(few(counts), "cluster").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(*held, "row", "block", F.lit(False).alias("left"))
    second = left.unionByName(right).repartition("cluster", "row", "block").groupBy("cluster", "row", "block").applyInArrow(compare, EDGES)
    return small.unionByName(star).unionByName(second), [sets, pivots, star, main, rest, counts]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = round(100 * THRESHOLD), **options) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    docs = docs.select("doc_id", "text")
    rows = staged(signatures(docs, shingle))
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one class, named by its smallest document
    classes = staged(full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class"), F.min_by("tokens", "doc_id").alias("tokens")))
    postings = staged(prefix_postings(classes, matches_of(percent)))
    meet = postings.groupBy("token").agg(F.min("class").alias("b"), F.count("*").alias("n")).where("n > 1").select("token", "b")
    clusters = components(postings.join(meet, "token").select(F.col("class").alias("a"), "b"))
    central = postings.groupBy("class").agg(F.max("central").alias("central"))
    clustered = staged(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(central, "class").join(classes.select("class", "n_shingles", "set_a", "set_b"), "class"))
    repeated = full.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    found, written = links(docs, clustered, percent, shingle, repeated, **options)
    named = components(found)
    discard(postings, clustered, *written)
    of_class = classes.select("set_a", "set_b", "n_shingles", "class").join(named, F.col("class") == F.col("node"), "left").select("set_a", "set_b", "n_shingles", F.coalesce("root", "class").alias("component_id"))
    out = rows.drop("tokens").join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def deduplicate(docs: DataFrame, broadcast_ids: int = 2 * BROADCAST_ROWS, **options) -> DataFrame:
    """The documents that stay, one row of each component, with all their columns; rows with a null doc_id all stay."""
    found = staged(near_duplicates(docs, **options).select("doc_id", "kept").where("doc_id IS NOT NULL"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    gone = F.broadcast(gone) if found.where("NOT kept").count() <= broadcast_ids else gone
    out = docs.join(gone, "doc_id", "left_anti")
    if found.where("kept").groupBy("doc_id").count().where("count > 1").limit(1).count():  # repeated rows
        named = F.col("doc_id").isNotNull()
        out = out.where(named).dropDuplicates(["doc_id"]).unionByName(out.where(~named))
    return out


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)
