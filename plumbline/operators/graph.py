"""Call edges: how a function can have called another, from tables of calls, definitions, macros and addresses taken.

calls: caller, callee, indirect; functions: name, lines, inline; macros: name, calls; addr_taken: name. pairs: caller, target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of edges, the first that holds wins; lines up to which a callee counts as inlined.
KINDS = ("direct", "macro", "inlined_2hop", "indirect_possible")
INLINED_LINES = 30


def edges(pairs: DataFrame, calls: DataFrame, functions: DataFrame, macros: DataFrame, addr_taken: DataFrame) -> DataFrame:
    """pairs with the kind of their edge; `none` if there is none. Each kind is an equality join; there are at most two hops."""
    direct = calls.where("NOT indirect").select("caller", F.col("callee").alias("target")).distinct()
    wanted = pairs.select("caller", "target").distinct()
    via_macro = direct.withColumnRenamed("target", "name").join(macros.select("name", F.explode("calls").alias("target")), "name").select("caller", "target")
    small = functions.where((F.col("lines") <= INLINED_LINES) | F.col("inline")).select(F.col("name").alias("mid")).distinct()
    hops = direct.withColumnRenamed("target", "mid").join(small, "mid").join(direct.select(F.col("caller").alias("mid"), "target"), "mid").select("caller", "target")
    taken = wanted.join(calls.where("indirect").select("caller").distinct(), "caller", "left_semi").join(addr_taken.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("caller", "target")
    found = None
    for rank, part in enumerate((direct, via_macro, hops, taken)):
        rows = wanted.join(part.distinct(), ["caller", "target"], "left_semi").withColumn("rank", F.lit(rank))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("caller", "target").agg(F.min("rank").alias("rank"))
    kind = F.coalesce(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("rank")), F.lit("none"))
    return wanted.join(best, ["caller", "target"], "left").select("caller", "target", kind.alias("kind"))


def consecutive(frames: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """Pairs (caller, target) of frames that follow each other: frame i + 1 called frame i."""
    by = Window.partitionBy(*key).orderBy(order)
    return frames.withColumn("caller", F.lead(name).over(by)).where("caller IS NOT NULL").select(*key, order, "caller", F.col(name).alias("target"))


def enclosing(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Of each point (blob, line) the innermost function that holds its line. functions: blob, name, start, end."""
    met = points.join(functions, "blob", "left").where(F.col("start").isNull() | F.col("line").between(F.col("start"), F.col("end")))
    return points.join(met.where("start IS NOT NULL").groupBy("blob", "line").agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), "start", "name")).alias("function")), ["blob", "line"], "left")
