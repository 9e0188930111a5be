"""Text views as columns: the ledger line by line, and a Markdown summary of a report's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import escaped_markdown

#: Fixed value: the longest comment that hosts of Markdown comments take.
MOST_CHARS = 65_536


def explain_lines(running: DataFrame) -> DataFrame:
    """One line for each ledger row: check, outcome key, strength, rank, what it adds, and the log-odds so far."""
    line = F.format_string("%-4s %-32s %+.2f x 0.5^%d = %+.6f -> %+.6f", "check_id", "outcome_key", "strength", "rank", "contribution", "total")
    return running.select("report_id", "grp", "rank", line.alias("line"))


def markdown(verdicts: DataFrame, key_rows: DataFrame) -> DataFrame:
    """report_id and a Markdown text: the verdict, then its key evidence in order; cut to what hosts take."""
    items = F.concat(F.lit("- "), F.col("check_id"), F.lit(": "), escaped_markdown(F.col("outcome_key")), F.format_string(" (%+.2f)", F.col("strength")))
    lines = key_rows.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("place", items.alias("item")))).alias("items"))
    rows = verdicts.join(lines, "report_id", "left")
    head = F.format_string("**%s** (score %d, %s confidence, rule %s)", "label", "score", "confidence", "rule")
    text = F.concat_ws("\n", head, F.array_join(F.transform("items", lambda x: x["item"]), "\n"))
    return rows.select("report_id", F.substring(text, 1, MOST_CHARS).alias("markdown"))
