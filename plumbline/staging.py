"""Tables written to the shared folder, which cut lineage where a plan is repeated."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only local sessions, such as tests, may leave it unset; they get a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def dealt(df: DataFrame, key: str, each: int) -> DataFrame:
    """Rows dealt by a key into parts of about `each` rows, and as many parts as there are cores at least: what then happens within a key needs no further shuffle, and a task's memory doesn't grow with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))
    return df.repartition(parts, key)


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: what follows doesn't repeat what came before, nor depends on executors that may be lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
