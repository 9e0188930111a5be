"""Seven kinds of planted mistakes, for measuring whether the checks find them: one row for each report, kind and seed.

Choices follow from a hash of (report, kind, seed), so that every run plants alike. A report without a place for a kind keeps its text and is
marked as not applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds and the label that each should lead to.
KINDS = {"M1": "UNGROUNDED", "M2": "UNGROUNDED", "M3": "MIXED", "M4": "UNGROUNDED", "M5": "UNGROUNDED", "M6": "UNGROUNDED", "M7": "UNGROUNDED"}


def _planted(body: Column, kind: Column, pick: Column) -> Column:
    """The body with one mistake; pick: a number from 0 to 99 as text."""
    symbol = F.nullif(F.regexp_extract(body, "`([A-Za-z_]\\w*)", 1), F.lit(""))
    option = F.nullif(F.regexp_extract(body, "(--[a-z][a-z-]+)", 1), F.lit(""))
    version = F.nullif(F.regexp_extract(body, "\\b([0-9]+\\.[0-9]+\\.[0-9]+)\\b", 1), F.lit(""))
    frame = F.nullif(F.regexp_extract(body, "(?m)^(\\s*#1 .*)$", 1), F.lit(""))
    context = F.nullif(F.regexp_extract(body, "(?m)^( \\S.*)$", 1), F.lit(""))
    swap = lambda found, new: F.when(found.isNotNull(), F.replace(body, found, new))
    return F.coalesce(
        F.when(kind == "M1", swap(symbol, F.concat(symbol, F.lit("_impl"), pick)))
        .when(kind == "M2", F.regexp_replace(body, "(\\.[a-z]{1,4}:)([0-9]+)", F.concat(F.lit("$1"), F.lit("9"), F.lpad(pick, 2, "0"), F.lit("$2"))))
        .when(kind == "M3", swap(version, F.concat(F.regexp_extract(version, "^([0-9]+\\.)", 1), F.lit("9"), pick, F.lit(".0"))))
        .when(kind == "M4", swap(frame, F.concat(F.lit("    #1 0x1 in planted_"), pick, F.lit(" none.c:1\n"), frame)))
        .when(kind == "M5", swap(context, F.concat(context, F.lit(" /* "), pick, F.lit(" */"))))
        .when(kind == "M6", swap(option, F.concat(option, F.lit("-planted"), pick)))
        .when(kind == "M7", F.regexp_replace(body, "is located ([0-9]+) bytes", F.concat(F.lit("is located 1"), F.lpad(pick, 2, "0"), F.lit("$1 bytes")))),
        body,
    )


def mutated(reports: DataFrame, seeds: int = 3) -> DataFrame:
    """report_id, kind, seed, expected, body, original (the body before) and applied, for every report, kind and seed."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("expected")) for k, v in KINDS.items()])
    spread = reports.select("report_id", "body", F.explode(kinds).alias("m")).select("report_id", "body", "m.kind", "m.expected", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    pick = F.pmod(F.crc32(F.concat_ws(":", "report_id", "kind", "seed").cast("binary")), F.lit(100)).cast("string")
    out = spread.withColumn("new", _planted(F.col("body"), F.col("kind"), pick))
    return out.select("report_id", "kind", "seed", "expected", F.col("new").alias("body"), F.col("body").alias("original"), (F.col("new") != F.col("body")).alias("applied"))
