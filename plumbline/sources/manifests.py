"""Manifests of labelled reports: one folder for each source, read by source without opening the others; and blobs by their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, label string, expected string, path string, url string, cve_id string, cvelist_commit string, repo string, version string, poc string, recipe string, notes string"
#: Labels of entries, and how long a note may be.
LABELS = ("GENUINE", "FABRICATED", "MIXED", "VAGUE")
NOTE_CHARS = 200


def write_manifest(entries: DataFrame, path: str) -> None:
    """entries: source and the columns of ENTRY. Each source is a folder of JSON lines."""
    entries.select("source", *[c.split()[0] for c in ENTRY.split(", ")]).write.partitionBy("source").json(path)


def read_manifest(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The entries of a manifest; of some sources alone, whose folders are the only ones read (the filter prunes them before any file is opened)."""
    rows = spark.read.schema(f"{ENTRY}, source string").json(path)
    return rows if sources is None else rows.where(F.col("source").isin(*sources))


def _bad_path(path: Column) -> Column:
    return (F.trim(path) == "") | path.rlike(r"^[./]*$|^/|(^|/)\.\.(/|$)|[\\:]")


def faults(entries: DataFrame) -> DataFrame:
    """id and what is wrong with an entry: bad_id, bad_label, bad_path, bad_url, bad_cve, locators (not exactly one of path, url and pinned record), half_pinned, bad_notes."""
    located = sum(F.col(c).isNotNull().cast("int") for c in ("path", "url")) + (F.col("cve_id").isNotNull() & F.col("cvelist_commit").isNotNull()).cast("int")
    rules = {
        "bad_id": ~F.col("id").rlike(r"^[A-Za-z0-9][\w.-]{0,99}$"),
        "bad_label": ~F.col("label").isin(*LABELS),
        "bad_path": _bad_path(F.col("path")) | _bad_path(F.col("poc")),
        "bad_url": ~F.col("url").rlike(r"^https://[^\s]+$"),
        "bad_cve": ~F.col("cve_id").rlike(r"^CVE-[0-9]{4}-[0-9]{4,}$"),
        "half_pinned": F.col("cve_id").isNull() != F.col("cvelist_commit").isNull(),
        "locators": located != 1,
        "bad_notes": (F.length("notes") > NOTE_CHARS) | F.col("notes").rlike(r"[\n\r]"),
    }
    # an empty column breaks no rule but that of the id and the label
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(name in ("bad_id", "bad_label"))), F.lit(name)) for name, rule in rules.items()]))
    return entries.select("id", F.explode(wrong).alias("fault"))


def read_blobs(wanted: DataFrame, blobs: DataFrame, most: int = 20 << 20) -> DataFrame:
    """sha, size and content of the wanted ids, each once: content is null where a blob is larger than `most` bytes, size too where there is none.

    wanted: sha; blobs: sha, content. Contents of other blobs are dropped by a semi-join before the wanted ones are met."""
    ids = wanted.select("sha").distinct()
    held = blobs.join(ids, "sha", "left_semi").groupBy("sha").agg(F.any_value("content").alias("content"))
    size = F.octet_length("content")
    return ids.join(held, "sha", "left").select("sha", size.alias("size"), F.when(size <= most, F.col("content")).alias("content"))
