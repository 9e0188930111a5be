"""Code lines: parts grow in number with the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import code


def _parts(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_code_lines_have_parts_by_files(spark, monkeypatch):
    monkeypatch.setattr(code, "FILES_EACH", 20)
    files = spark.range(600).select(F.col("id").alias("blob"), F.lit("c").alias("lang"), F.lit("int f(int a) {\n}\n").alias("text"))
    assert _parts(code.code_lines(files)) > 20
    monkeypatch.setattr(code, "LINES_EACH", 20)
    lines = spark.range(600).select(F.col("id").alias("blob"), F.lit(1).alias("line_no"), F.lit("x").alias("line"))
    assert _parts(code.inlined(lines)) > 20
