"""Reading tables, and rows of the library's own schemas from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task takes before heavy work.
EACH = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores before heavy work, and into parts of a bounded number of rows: a task's time doesn't grow with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // EACH))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
