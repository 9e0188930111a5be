"""Shared helpers of the training-data operators: staging, Arrow batches, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and the lower-casing of A-Z.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER_AND_SPACE = bytes(c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in range(256))
#: For words of letters, digits and all bytes over 0x7F: everything else becomes a space.
LOWER_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents are worked on in slices of about so many bytes, so that a worker's memory is bounded.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only local runs, such as tests, may leave it unset; they get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what staged wrote for these frames; nothing that reads them may run later."""
    for frame in frames:
        path = getattr(frame, "staged_path", None)
        if path:
            context = frame.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *kept: str) -> DataFrame:
    """df with numbers for the names of all columns but some: functions over Arrow batches look columns up by name, which fails for names with dots."""
    return df.toDF(*[name if name in kept else f"_{i}" for i, name in enumerate(df.columns)])


def fresh(df: DataFrame, name: str, *others: str) -> str:
    """A column name that neither df nor the others have."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while name.lower() in taken:
        name += "_"
    return name


def fraction_of(column: Column) -> Column:
    """A deterministic number in [0, 1) from a column's value, for samples that every attempt draws alike."""
    return F.pmod(F.xxhash64(column.cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def id_crc(column: Column | str) -> Column:
    """crc32 of an id as text, which fixes the folds."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text; None where null."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(n):
        yield None if valid is not None and not valid[i] else bytes(view[where[i] : where[i + 1]])


def slices(ids: list, texts: Iterator[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """Rows in runs of about `most` bytes; a longer text is a run of its own."""
    keys, held, size = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        if held and size + len(text or b"") > most:
            yield keys, held
            keys, held, size = [], [], 0
        keys.append(key)
        held.append(text)
        size += len(text or b"")
    if held:
        yield keys, held


def sliced(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text") -> Iterator[tuple[list, list[bytes | None]]]:
    for batch in batches:
        if batch.num_rows:
            yield from slices(batch.column(key).to_pylist(), text_bytes(batch.column(text)))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiplicative hash; x is uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed base, or more."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 1 << 10), _BASE, np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


def word_hashes(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in a row, and for each text the index of its first word (one more at the end).

    table maps each byte; words are runs of what is not a space after it."""
    joined = b" ".join(t.translate(table) if t else b"" for t in texts) + b" "
    lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(joined, np.uint8)
    full = data != 32
    edge = np.flatnonzero(np.diff(full.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    size = ends - starts
    total = int(size.sum())
    begin = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        terms = (data[full].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) + 1)[place]
        return mixed(np.add.reduceat(terms, begin) + size.astype(np.uint64)), bounds
