"""Interval operators over half-open spans [start, end) within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import bound, running


def _before(key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)


def merged(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans that overlap or touch become one."""
    ordered = Window.partitionBy(*key).orderBy("start", "end")
    far = spans.withColumn("reach", F.max("end").over(_before(key)))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return far.withColumn("island", island).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def gaps(spans: DataFrame, key: list[str]) -> DataFrame:
    """What lies between merged spans of a key."""
    one = merged(spans, key)
    by = Window.partitionBy(*key).orderBy("start")
    return one.select(*key, F.col("end").alias("start"), F.lead("start").over(by).alias("end")).where("end IS NOT NULL")


def outside(spans: DataFrame, extents: DataFrame, key: list[str]) -> DataFrame:
    """Parts of [0, length) of each key that no span covers. extents: key, length."""
    edges = spans.select(*key, "start", "end").unionByName(extents.select(*key, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).unionByName(extents.select(*key, F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end")))
    return gaps(edges, key).where("end > start")


def overlapping(left: DataFrame, right: DataFrame, key: list[str], cell: int) -> DataFrame:
    """Pairs of spans that overlap, by an equality join on (key, cell): long keys are cut into cells, each pair is given once.

    left and right: key, start, end and an id column named left_id and right_id."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / cell), F.floor((F.col(e) - 1) / cell)))
    a = left.where("end > start").select(*key, F.col("start").alias("a_start"), F.col("end").alias("a_end"), "left_id", cells("start", "end").alias("cell"))
    b = right.where("end > start").select(*key, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "right_id", cells("start", "end").alias("cell"))
    both = a.join(b, [*key, "cell"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    first = F.floor(F.greatest("a_start", "b_start") / cell) == F.col("cell")
    return both.where(first).drop("cell")


def not_contained(spans: DataFrame, covers: DataFrame, key: list[str]) -> DataFrame:
    """Spans that no cover of their key contains. Covers are merged first, so that a span meets few."""
    one = merged(covers, key).select(*key, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    # the last cover that starts no later than the span is the only one that can contain it
    rows = spans.select(*key, "start", "end", F.lit(1).alias("is_span"), F.lit(None).cast("long").alias("reach")).unionByName(one.select(*key, F.col("c_start").alias("start"), F.col("c_end").alias("end"), F.lit(0).alias("is_span"), F.col("c_end").cast("long").alias("reach")))
    by = Window.partitionBy(*key).orderBy("start", "is_span").rowsBetween(Window.unboundedPreceding, 0)
    reached = rows.withColumn("last", F.last("reach", ignorenulls=True).over(by))
    return reached.where((F.col("is_span") == 1) & (F.col("last").isNull() | (F.col("last") < F.col("end")))).select(*key, "start", "end")


def no_overlaps(spans: DataFrame, key: list[str]) -> DataFrame:
    """Sorted spans without those that begin within what earlier ones reach."""
    return spans.withColumn("reach", F.max("end").over(_before(key))).where("reach IS NULL OR start >= reach").drop("reach")


def accepted(spans: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Spans taken one by one in the order given, each unless it overlaps one that was taken before it: an ordered fold over each key's spans.

    A key's spans are one array (the traces or regions of one report)."""
    columns = [c for c in spans.columns if c not in key]
    ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *columns)
    one = "struct<start:bigint,end:bigint>"
    start = F.array().cast(f"array<{one}>")
    pair = lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))
    # an empty span has a place of its own
    clash = lambda a, b: (a["start"] < F.greatest(b["end"], b["start"] + 1)) & (b["start"] < F.greatest(a["end"], a["start"] + 1))
    take = lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(pair(x))))
    rows = spans.groupBy(*key).agg(F.array_sort(F.collect_list(ranked)).alias("all")).withColumn("taken", F.aggregate("all", start, take))
    # equal spans: the first in order is the one that was taken
    firsts = F.filter("all", lambda x, i: F.array_contains("taken", pair(x)) & ~F.exists(F.slice("all", 1, i), lambda y: pair(y) == pair(x)))
    return rows.select(*key, F.explode(firsts).alias("x")).select(*key, *[F.col(f"x.{c}") for c in columns])


def longest_first(spans: DataFrame, key: list[str], *ties: Column) -> DataFrame:
    """Overlaps resolved for the longer span, then the earlier one."""
    return accepted(spans, key, [F.col("start") - F.col("end"), F.col("start"), *ties])


def clusters(points: DataFrame, key: list[str], position: str, gap: int) -> DataFrame:
    """Runs of positions no more than `gap` apart: key, first, last, n."""
    by = Window.partitionBy(*key).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(by) <= gap, 0).otherwise(1)
    return points.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("_run")


def densest(points: DataFrame, key: list[str], position: str, gap: int) -> DataFrame:
    """Of each key the run with most positions, the earliest of equals."""
    return clusters(points, key, position, gap).groupBy(*key).agg(F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first"))).alias("run")).select(*key, "run.*")


#: A noncharacter, which marks the edges of matches.
_EDGE = "\uffff"


def _around(text: Column, pattern: str) -> Column:
    """Array of (lead, text, tail) of a pattern's matches: what lies before and after each up to the next one. One search, with the pattern compiled once."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_EDGE}$0{_EDGE}")), _EDGE, -1)
    row = lambda lead, match, tail: F.struct(lead.alias("lead"), match.alias("text"), tail.alias("tail"))
    empty = F.array().cast("array<struct<lead:string,text:string,tail:string>>")

    def zipped(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 2, F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: row(F.get(pieces, i - 1), F.get(pieces, i), F.get(pieces, i + 1)))).when(pieces.isNotNull(), empty)

    def slowly(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        return bound(pieces, lambda ps: F.transform(found, lambda m, i: row(F.get(ps, i), m, F.get(ps, i + 1))))

    # a text that holds the mark itself is searched twice
    return F.when(F.contains(text, F.lit(_EDGE)), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), slowly)).otherwise(bound(parts, zipped))


def matches(text: Column, pattern: str, group: int = 0, inner: bool = False) -> Column:
    """Array of (start, end, text) of a pattern's matches, leftmost and non-overlapping, in code points.

    text is that of the group; start and end are those of the whole match, or with inner those of the group's text, which
    then stands at its first place in the match."""
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None)

    def placed(rows: Column) -> Column:
        sizes = F.transform(rows, lambda x: F.length(x["lead"]) + F.length(x["text"]))

        def within(sums: Column, shown) -> Column:
            def one(x: Column, i: Column) -> Column:
                part = shown(x, i)
                start = F.get(sums, i) + F.length(x["lead"])
                start = start + F.greatest(F.instr(x["text"], part) - 1, F.lit(0)) if inner else start
                return F.struct(start.alias("start"), (start + F.length(part if inner else x["text"])).alias("end"), part.alias("text"))

            return F.transform(rows, one)

        if group:
            return bound(groups, lambda all_: bound(running(sizes), lambda sums: within(sums, lambda x, i: F.get(all_, i))))
        return bound(running(sizes), lambda sums: within(sums, lambda x, i: x["text"]))

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return bound(_around(text, pattern), lambda rows: F.when(F.size(rows) > 0, placed(rows)).when(rows.isNotNull(), none))


def mentions(text: Column, pattern: str, reach: int = 160) -> Column:
    """Array of (start, end, text, before, after) of a pattern's matches with up to `reach` characters around, taken from what lies between matches."""

    def placed(rows: Column) -> Column:
        none = F.lit("")
        cut = lambda i: F.get(rows, i)

        def within(sums: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(sums, i) + F.length(x["lead"])
                before = F.concat(F.coalesce(F.right(cut(i - 1)["lead"], F.lit(reach)), none), F.coalesce(cut(i - 1)["text"], none), F.right(x["lead"], F.lit(reach)))
                after = F.concat(F.left(x["tail"], F.lit(reach)), F.coalesce(cut(i + 1)["text"], none), F.coalesce(F.left(cut(i + 1)["tail"], F.lit(reach)), none))
                return F.struct(start.alias("start"), (start + F.length(x["text"])).alias("end"), x["text"].alias("text"), F.right(before, F.lit(reach)).alias("before"), F.left(after, F.lit(reach)).alias("after"))

            return F.transform(rows, one)

        return bound(running(F.transform(rows, lambda x: F.length(x["lead"]) + F.length(x["text"]))), within)

    return bound(_around(text, pattern), lambda rows: F.when(F.size(rows) > 0, placed(rows)))


def source_map(raw: Column) -> Column:
    """Where the characters of a normalized text stood in the raw one: an array of (norm_start, orig_start, length), without gaps in the normalized text.

    Normalizing drops single characters (control characters, the first half of a double line end), so each one moves what follows by one."""
    # characters that are dropped are told apart from the line ends that stay
    dropped = F.transform(matches(raw, "\r(?=\n)|[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}\\x{FEFF}]"), lambda m: m["start"])
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda at: at + 1))
    ends = F.concat(dropped, F.array(F.length(raw)))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x, i: F.struct((x["a"] - i).alias("norm_start"), x["a"].alias("orig_start"), (x["b"] - x["a"]).alias("length")))
    return F.filter(parts, lambda x: x["length"] > 0)


def original_offset(parts: Column, offset: Column) -> Column:
    """The place in the raw text of an offset in the normalized one; null before the first part."""
    last = F.try_element_at(F.filter(parts, lambda x: x["norm_start"] <= offset), F.lit(-1))
    return last["orig_start"] + (offset - last["norm_start"])
