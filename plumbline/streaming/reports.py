"""Reports as a stream: the stateless extraction of claims, and counts by window with late rows bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import claims


def read_reports(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder to which report tables (Parquet: report_id, title, body, ts) are added."""
    return spark.readStream.schema("report_id long, title string, body string, ts timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_claims(reports: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Claims of each micro-batch, written under its number, so that a repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        claims.extract_claims(rows.select("report_id", "title", "body")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reports.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mentions_by_hour(reports: DataFrame, late: str = "2 hours") -> DataFrame:
    """Reports and mentions of CVE ids for each hour of event time; rows later than `late` are dropped."""
    found = F.size(F.regexp_extract_all("body", F.lit(r"\bCVE-[0-9]{4}-[0-9]{4,7}\b"), F.lit(0)))
    return reports.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("reports"), F.sum(found).alias("mentions")).select("w.start", "w.end", "reports", "mentions")
