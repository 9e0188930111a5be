"""Traces: parts grow in number with the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import traces


def _parts(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_trace_lines_have_parts_by_reports(spark, monkeypatch):
    monkeypatch.setattr(traces, "REPORTS_EACH", 20)
    reports = spark.range(600).select(F.col("id").alias("report_id"), F.lit("Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nE: x").alias("body"))
    assert _parts(traces.trace_lines(reports)) > 20
