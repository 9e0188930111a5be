"""Sharding by sampled splitters.

Records are ordered by a hash of their text, so that equal texts lie together, and within a text by a hash of doc_id and row.
From size-weighted samples of these keys, quantile boundaries for many ranges are chosen. A boundary falls between
two texts unless one text's copies are heavier than a range; then it falls inside them. Every record goes to its
range; ranges whose exact size comes out overfull are subdivided by that hash. Ranges in order then fill the shards.

Sizes are UTF-8 bytes of the text plus 1. A null text has the size, checksum and order of an empty one. Repeated rows
are placed each; the hash within a text takes in a number of the row, fixed when keys are written, so that they are told apart. An empty table gives no rows. Extra columns are ignored. Only keys and sizes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import fraction_of, staged

#: Ranges for each shard at least, rows of a range at most on average, key samples drawn for each range.
RANGES, ROWS, SAMPLES = 256, 50_000, 8
#: Ranges at most; beyond it they hold more rows. So the samples (24 bytes each) and the plan that reach the driver have a bound.
MOST_RANGES = 100_000
#: A range this many times the mean size is overfull.
OVERFULL = 2.0

KEYS = "doc_id long, size long, text_crc32 long, h long, g long"


def _order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Keys as bytes that compare like (h, g)."""
    out = np.empty((len(h), 2), ">u8")
    out[:, 0], out[:, 1] = h.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), g.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16").ravel()


def splitters(h: np.ndarray, g: np.ndarray, weight: np.ndarray, ranges: int) -> np.ndarray:
    """Boundaries between `ranges` ranges at quantiles of the sampled weight, at text starts where these are not too heavy."""
    if not len(h):
        return np.zeros(0, "S16")
    order = np.lexsort((g, h))
    h, g, weight = h[order], g[order], weight[order]
    total = np.cumsum(weight)
    at = np.unique(np.minimum(np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges), len(h) - 1))
    texts, counts = np.unique(h[at], return_counts=True)
    heavy = counts[np.searchsorted(texts, h[at])] > 1
    return np.unique(_order(h[at], np.where(heavy, g[at], np.iinfo(np.int64).min)))


def shard(docs: DataFrame, shards: int = 8, ranges: int = RANGES, rows: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row; shards' bytes near equal."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit("order")).alias("g")))
    total, count = keys.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    wanted = max(shards * ranges, min(count // rows, MOST_RANGES))
    step = total / (wanted * SAMPLES)  # a row is drawn with the probability size / step, a larger one always
    drawn = keys.where(fraction_of(F.col("g")) * step < F.col("size")).select("h", "g", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight")).toPandas()
    held = spark.sparkContext.broadcast(splitters(drawn.h.to_numpy(np.int64), drawn.g.to_numpy(np.int64), drawn.weight.to_numpy(), wanted))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _order(batch.column("h").to_numpy(), batch.column("g").to_numpy())
            yield batch.append_column("range", pa.array(np.searchsorted(held.value, key, "right"), pa.int32()))

    placed = staged(keys.mapInArrow(dealt, f"{KEYS}, range int"))
    sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range").collect()
    most = OVERFULL * total / len(sizes)
    parts = {r["range"]: int(-(-r["bytes"] // most)) for r in sizes if r["bytes"] > most and r["n"] > 1}
    if parts:
        cuts = spark.createDataFrame(list(parts.items()), "range int, parts int")
        placed = placed.join(F.broadcast(cuts), "range", "left").withColumn("part", F.floor((F.col("g") / float(1 << 64) + 0.5) * F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        sizes = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range", "part").collect()
    else:
        placed = placed.withColumn("part", F.lit(0))
        sizes = [r.asDict() | {"part": 0} for r in sizes]
    plan, before, slots = [], 0, [0] * shards
    for r in sizes:
        s = min(shards - 1, int((before + r["bytes"] / 2) * shards / total))
        plan.append((r["range"], r["part"], s, slots[s]))
        before += r["bytes"]
        slots[s] += r["n"]
    table = spark.createDataFrame(plan, "range int, part int, shard int, first long")
    number = F.row_number().over(Window.partitionBy("range", "part").orderBy("h", "g", "doc_id", "size"))
    return placed.withColumn("number", number).join(F.broadcast(table), ["range", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
