"""Frames that many reports share are looked up once."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import checks


def _parts(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_frame_status_of_shared_frames(spark, monkeypatch):
    """Null paths and functions keep their status, statuses of one place are found for every report, and parts grow with the frames."""
    monkeypatch.setattr(checks, "FRAMES_EACH", 20)
    said = [("r", "a.c", "f", 2), ("r", "a.c", "f", 9), ("r", "a.c", None, 2), ("r", "lost.c", "f", 1), ("r", None, "f", 1), ("r", "/usr/lib/x.c", "f", 1), ("r", "b.c", "f", 1), ("r", "a.c", "f", None)]
    frames = spark.createDataFrame([(i, k, *f) for i in range(100) for k, f in enumerate(said)], "report_id long, index int, release string, path string, function string, line int")
    tree = spark.createDataFrame([("r", "a.c", 1), ("r", "b.c", 2)], "release string, path string, blob long")
    blobs = spark.createDataFrame([(1, 9, True), (2, 9, False)], "blob long, n_lines int, parsed boolean")
    symbols = spark.createDataFrame([(1, "f", 1, 3)], "blob long, name string, start int, end int")
    found = checks.frame_status(frames, tree, blobs, symbols)
    want = ["consistent", "inconsistent", "inconsistent", "inconsistent", "skipped", "third_party", "uncertain", "inconsistent"]
    assert sorted((r.report_id, r["index"], r.status) for r in found.collect()) == [(i, k, s) for i in range(100) for k, s in enumerate(want)]
    assert _parts(found) > 20
