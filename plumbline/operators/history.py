"""Commit graphs: which commits are in the history of which.

Histories are long and mostly straight. Runs of commits with one parent whose parent has one child become segments first, by pointer doubling: a run of n takes log2(n)
rounds. A commit's label is its segment and its place there; within a segment, places answer alone. A segment's level is its generation and two words of bits, one in each for every segment of its
history: most questions are refused by them without a walk. For the others, frontiers of (question, segment) walk back over the segments' parents, all questions at once, each segment at most
once a question, and only where the level leaves the older commit possible. Every round is written, so lineage stays short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.staging import staged


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def segments(parents: DataFrame) -> DataFrame:
    """commit, segment (the oldest commit of its straight run) and place in it (from 0). parents: commit, parent (null for a root), one row for each."""
    parents = staged(parents.select("commit", "parent"))
    edges = parents.where("parent IS NOT NULL")
    one_parent = edges.groupBy("commit").agg(F.min("parent").alias("least"), F.max("parent").alias("most")).where("least = most").select("commit")
    one_child = edges.groupBy("parent").agg(F.min("commit").alias("commit"), F.max("commit").alias("most")).where("commit = most").select("commit", "parent")
    none = F.lit(None).cast(parents.schema["parent"].dataType)
    every = parents.select("commit", none.alias("up")).unionByName(edges.select(F.col("parent").alias("commit"), none.alias("up")))
    at = staged(every.unionByName(one_child.join(one_parent, "commit", "left_semi").withColumnRenamed("parent", "up")).groupBy("commit").agg(F.max("up").alias("up")))
    done = [at.where("up IS NULL").select("commit", F.col("commit").alias("segment"), F.lit(0).cast("long").alias("place"))]
    settled, moving = [], at.where("up IS NOT NULL").withColumn("steps", F.lit(1).cast("long"))
    while moving.limit(1).count():
        above = _all([*settled, moving]).select(F.col("commit").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        found = staged(moving.join(above, "up", "left").select("commit", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")))
        settled.append(found.where("NOT moved").drop("moved"))
        moving = found.where("moved").drop("moved")
    return _all([*done, *[part.select("commit", F.col("up").alias("segment"), F.col("steps").alias("place")) for part in settled]])


def _links(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """segment, to and at: the segments and places that a segment's oldest commit has as parents, of several places of one segment the highest."""
    edges = parents.where("parent IS NOT NULL").select(F.col("commit").alias("segment"), "parent")
    roots = edges.join(labels.where("place = 0").select("segment"), "segment", "left_semi")
    rows = roots.join(labels.select(F.col("commit").alias("parent"), F.col("segment").alias("to"), F.col("place").alias("at")), "parent")
    return rows.groupBy("segment", "to").agg(F.max("at").alias("at"))


#: Bits of a segment in the two words of a level, from two parts of one hash.
BITS = ("shiftleft(1L, CAST(xxhash64({0}) & 63 AS INT))", "shiftleft(1L, CAST(shiftright(xxhash64({0}), 6) & 63 AS INT))")


def generations(labels: DataFrame, links: DataFrame) -> DataFrame:
    """segment, generation (one more than the highest of its parents'), low and high: bits of it and of all segments in its history. A segment is settled once all it links to are;
    a link is written again only until its end is settled."""
    own = [F.expr(b.format("segment")) for b in BITS]
    first = labels.where("place = 0").select("segment").join(links.select("segment").distinct(), "segment", "left_anti")
    done = staged(first.select("segment", F.lit(0).cast("long").alias("generation"), own[0].alias("low"), own[1].alias("high")))
    parts, waiting = [done], None
    counts = links.groupBy("segment").agg(F.count("*").alias("n"))
    open_ = staged(links.select("segment", "to").join(counts, "segment"))
    while True:
        met = staged(open_.join(done.select(F.col("segment").alias("to"), (F.col("generation") + 1).alias("generation"), "low", "high"), "to", "left"))
        open_ = met.where("generation IS NULL").select("segment", "to", "n")
        told = met.where("generation IS NOT NULL").select("segment", "n", F.lit(1).cast("long").alias("got"), "generation", "low", "high")
        told = told if waiting is None else told.unionByName(waiting)
        state = staged(told.groupBy("segment", "n").agg(F.sum("got").alias("got"), F.max("generation").alias("generation"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high")))
        waiting = state.where("got < n")
        done = state.where("got = n").select("segment", "generation", F.col("low").bitwiseOR(own[0]).alias("low"), F.col("high").bitwiseOR(own[1]).alias("high"))
        if not done.limit(1).count():
            return _all(parts)  # links that stay open are those of a circle, which no history has; its commits stay without a generation
        parts.append(done)


def _possible(generation: str, low: str, high: str) -> Column:
    """Whether the level of a segment (null in a circle) leaves it possible that the older commit's segment is in its history."""
    bits = [F.expr(f"({word} & {b.format('old_segment')}) <> 0") for word, b in zip((low, high), BITS, strict=True)]
    return F.coalesce((F.col(generation) > F.col("floor")) & bits[0] & bits[1], F.lit(True))


def ancestors(parents: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether `older` is `newer` or in its history: older, newer, ancestor (null if a commit is not in the graph).

    parents: commit, parent; questions: older, newer."""
    parents = staged(parents.select("commit", "parent"))
    labels = segments(parents)
    links = staged(_links(parents, labels))
    level = staged(generations(labels, links))
    labels = staged(labels.join(level, "segment", "left"))
    links = staged(links.join(level.withColumnRenamed("segment", "to"), "to", "left"))
    old = labels.select(F.col("commit").alias("older"), F.col("segment").alias("old_segment"), F.col("place").alias("old_place"), F.col("generation").alias("floor"))
    new = labels.select(F.col("commit").alias("newer"), F.col("segment").alias("new_segment"), F.col("place").alias("new_place"), "generation", "low", "high")
    placed = questions.select("older", "newer").distinct().join(old, "older", "left").join(new, "newer", "left")
    same = F.col("old_segment") == F.col("new_segment")
    sure = F.when(F.col("old_segment").isNull() | F.col("new_segment").isNull(), None).when(same, F.col("new_place") >= F.col("old_place")).when(~_possible("generation", "low", "high"), False)
    walked = F.col("old_segment").isNotNull() & F.col("new_segment").isNotNull() & ~same & _possible("generation", "low", "high")
    kept = lambda name: F.when(F.col("walks"), F.col(name)).alias(name)
    key = ["older", "newer", "old_segment", "old_place", "floor"]
    asked = staged(placed.withColumn("ancestor", sure).withColumn("walks", F.coalesce(walked, F.lit(False))).select("older", "newer", "ancestor", "walks", *map(kept, key[2:]), kept("new_segment")))
    front, seen, hits = asked.where("walks").select(*key, F.col("new_segment").alias("segment")), [], []
    while True:
        # what is beyond a segment doesn't depend on the place at which it is met; the older commit's own segment leads only further down
        found = F.col("to") == F.col("old_segment")
        met = front.join(links, "segment").withColumn("hit", found & (F.col("at") >= F.col("old_place"))).where(F.col("hit") | (~found & _possible("generation", "low", "high")))
        met = staged(met.groupBy(*key).agg(F.max("hit").alias("hit"), F.collect_set("to").alias("to")))
        hits.append(met.where("hit").select("older", "newer"))
        front = met.where("NOT hit").select(*key, F.explode("to").alias("segment"))
        if seen:
            front = front.join(_all(seen), ["older", "newer", "segment"], "left_anti")
        front = staged(front)
        if not front.limit(1).count():
            break
        seen.append(front.select("older", "newer", "segment"))
    walks = asked.where("walks").select("older", "newer").join(_all(hits).withColumn("ancestor", F.lit(True)), ["older", "newer"], "left")
    return asked.where("NOT walks").select("older", "newer", "ancestor").unionByName(walks.select("older", "newer", F.coalesce("ancestor", F.lit(False)).alias("ancestor")))
