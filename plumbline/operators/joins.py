"""Joins that Spark has no single operator for: as-of, neighbours, bands, path suffixes, fuzzy names, globs, containment.

All are equality joins or windows with a residual; none pairs all rows with all rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import jaccard, name_parts, path_parts


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, strictly: bool = False) -> DataFrame:
    """left with the right row's value at the latest time not after (or before) its own; null if there is none.

    Both sides are laid in one ordered window within the key; right: key, at, value."""
    rows = left.select("*", F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(None).cast(dict(right.dtypes)[at]).alias("_t"), F.lit(0 if strictly else 1).alias("_side"))
    other = right.select(*key, at, F.col(value).alias("_v"), F.col(at).alias("_t"), F.lit(1 if strictly else 0).alias("_side"))
    both = rows.withColumn("_left", F.lit(True)).unionByName(other.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("_left"), F.struct("_v", "_t")), ignorenulls=True).over(by)
    return both.withColumn("_seen", seen).where("_left").select(*left.columns, F.col("_seen._v").alias(value), F.col("_seen._t").alias(f"{value}_at"))


def neighbours(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every row with the order values just below and just above its own."""
    by = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("below", F.lag(order).over(by)).withColumn("above", F.lead(order).over(by))


def band(rows: DataFrame, anchors: DataFrame, key: list[str], order: str, radius: int) -> DataFrame:
    """Rows at most `radius` places from an anchor of their key. anchors: key, anchor."""
    return rows.join(anchors, key).where(F.abs(F.col(order) - F.col("anchor")) <= radius).withColumn("distance", F.col(order) - F.col("anchor"))


def _suffixes(df: DataFrame, column: str) -> DataFrame:
    """column, depth and suffix (of so many whole components) of each distinct path."""
    parts = path_parts(F.col(column))
    rows = df.select(column).distinct().where(F.size(parts) > 0).select(column, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("parts"))
    return rows.select(column, "depth", F.array_join(F.slice("parts", F.size("parts") - F.col("depth") + 1, F.col("depth")), "/").alias("suffix"))


def suffix_join(cited: DataFrame, tree: DataFrame) -> DataFrame:
    """For each cited path all tree paths that share the longest suffix of whole components with it: cited, path, depth.

    cited: cited; tree: path. Which depth is the deepest is settled by a semi-join with the tree's distinct suffixes, paths not carried; only
    at that depth cited paths and tree paths are paired, so that paths of one base name meet only where nothing deeper does."""
    asked, held = _suffixes(cited, "cited"), _suffixes(tree, "path")
    known = held.select("suffix", "depth").distinct()
    deepest = asked.join(known, ["suffix", "depth"], "left_semi").groupBy("cited").agg(F.max(F.struct("depth", "suffix")).alias("best")).select("cited", "best.*")
    return deepest.join(held, ["suffix", "depth"]).select("cited", "path", "depth")


def compatible(cited, real):
    """Whether a cited path can name a real one that shares a suffix with it: one of the two is a suffix of the other, by whole components."""
    a, b = path_parts(cited), path_parts(real)
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.size(b) - n + 1, n))


def resolve_paths(cited: DataFrame, tree: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """The tree's paths that each cited one may name: cited, path, depth, exact, compatible.

    A path that is in the tree as it is written names itself alone; only the others go on to be matched by suffix. preferred: cited, path of pairs that a
    predicate holds for, such as that the file defines the function of the frame; where it holds for one of a path's candidates, the others go."""
    exact = cited.select("cited").distinct().join(tree.select(F.col("path").alias("cited")).distinct(), "cited", "left_semi")
    rest = suffix_join(cited.select("cited").join(exact, "cited", "left_anti"), tree)
    own = exact.select("cited", F.col("cited").alias("path"), F.size(path_parts(F.col("cited"))).alias("depth"), F.lit(True).alias("exact"))
    rows = own.unionByName(rest.withColumn("exact", F.lit(False)))
    if preferred is not None:
        rows = rows.join(preferred.select("cited", "path", F.lit(True).alias("_holds")).distinct(), ["cited", "path"], "left")
        best = F.max(F.coalesce("_holds", F.lit(False))).over(Window.partitionBy("cited"))
        rows = rows.withColumn("_best", best).where(F.coalesce("_holds", F.lit(False)) == F.col("_best")).drop("_holds", "_best")
    return rows.withColumn("compatible", compatible(F.col("cited"), F.col("path")))


def deletions(word, distance: int):
    """A word and what is left of it after deleting up to `distance` (1 or 2) characters: blocks in which near words meet."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
    out = F.concat(F.array(word), F.when(F.length(word) > 0, one(word)).otherwise(F.array().cast("array<string>")))
    if distance > 1:
        out = F.concat(out, F.flatten(F.transform(F.filter(out, lambda w: F.length(w) > 0), one)))
    return F.array_distinct(out)


#: Characters of a cell of places and lengths.
CELL = 8


def suggest(names: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """For each name the nearest known ones: edit distance, lower-cased, of at most max(1, a quarter of its length);
    then the more shared name parts, then the word. names: name; known: word.

    Names of a radius up to 2 meet known words where both give one block of deletions. A longer name is cut into one piece more than its
    radius, so that one piece at least stands unchanged in any near word, at most the radius away: there they meet."""
    radius = F.greatest(F.lit(1), F.floor(F.length("name") / 4).cast("int"))
    a = names.select("name").distinct().withColumn("low", F.lower("name")).withColumn("radius", radius)
    b = known.select("word").distinct().withColumn("low_word", F.lower("word"))
    band = F.abs(F.length("low") - F.length("low_word")) <= F.col("radius")
    # a name of a radius up to 2 has at most 11 characters, lower-cased at most 22
    short = a.where("radius <= 2").withColumn("block", F.explode(deletions(F.col("low"), 2)))
    met = short.join(b.where(F.length("low_word") <= 24).withColumn("block", F.explode(deletions(F.col("low_word"), 2))), "block").where(band)
    # pieces have 3 characters or more, of which up to 4 are compared
    edge = lambda k: F.floor(k * F.length("low") / (F.col("radius") + 1)).cast("int")
    piece = lambda k: F.struct(edge(k).alias("start"), F.substr(F.col("low"), edge(k) + 1, F.least(F.lit(4), edge(k + 1) - edge(k))).alias("block"))
    gram = lambda i: F.array(*[F.struct((i - 1).alias("at"), F.substr(F.col("low_word"), i, F.lit(n)).alias("block")) for n in (3, 4)])
    long = a.where("radius > 2").withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("radius")), piece))).select("name", "low", "radius", "p.*")
    grams = b.where(F.length("low_word") >= 3).withColumn("p", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("low_word") - 2), gram)))).select("word", "low_word", "p.*")
    # common pieces are hot blocks: places and lengths, in cells, are part of the key, so that a piece meets only words of about its name's length that hold it about there
    cell = lambda x: F.floor(x / CELL).cast("int")
    around = lambda x: F.explode(F.sequence(cell(x - F.col("radius")), cell(x + F.col("radius"))))
    long = long.withColumn("place", around(F.col("start"))).withColumn("size", around(F.length("low")))
    grams = grams.withColumn("place", cell(F.col("at"))).withColumn("size", cell(F.length("low_word")))
    met = met.drop("block").unionByName(long.join(grams, ["block", "place", "size"]).where(band & (F.abs(F.col("start") - F.col("at")) <= F.col("radius"))).drop("block", "start", "at", "place", "size")).distinct()
    near = met.withColumn("distance", F.call_function("levenshtein", F.col("low"), F.col("low_word"), F.col("radius"))).where("distance >= 0")
    near = near.withColumn("shared", F.round(jaccard(name_parts(F.col("name")), name_parts(F.col("word"))), 6))
    by = Window.partitionBy("name").orderBy("distance", F.desc("shared"), "word")
    return near.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("name", "word", "distance", "shared", "place")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: * and ? stay within a component, ** crosses; a glob without / matches base names."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return ("^" if "/" in glob else "(?:^|/)") + out + "$"


def glob_matches(paths: DataFrame, globs: list[str], column: str = "path") -> DataFrame:
    """paths with the first glob of the list that matches, null if none does; the list is a literal."""
    out = F.lit(None).cast("string")
    for glob in reversed(globs):
        out = F.when(F.col(column).rlike(glob_pattern(glob)), F.lit(glob)).otherwise(out)
    return paths.withColumn("glob", out)


def containment(small: DataFrame, large: DataFrame) -> DataFrame:
    """Share of each small document's distinct hashes that occur in a large one. small: small_id, hash; large: large_id, hash."""
    s = small.select("small_id", "hash").distinct()
    sizes = s.groupBy("small_id").agg(F.count("*").alias("size"))
    met = s.join(large.select("large_id", "hash").distinct(), "hash").groupBy("small_id", "large_id").agg(F.count("*").alias("shared"))
    return met.join(sizes, "small_id").select("small_id", "large_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("containment"))


def templates(missing: DataFrame, tree: DataFrame) -> DataFrame:
    """Missing paths that a file of the tree is a template of: path, template (the first kind that is there). missing, tree: path."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    kinds = F.array(F.concat("path", F.lit(".in")), F.concat("path", F.lit(".cmake")), F.concat("path", F.lit(".in.cmake")), F.when(F.col("path").endswith(".h"), F.concat(stem, F.lit("-cmake.h.in"))), F.when(F.col("path").endswith(".c"), F.concat(stem, F.lit(".y"))))
    asked = missing.select("path").distinct().join(tree.select("path"), "path", "left_anti").select("path", F.posexplode(kinds).alias("kind", "template"))
    met = asked.join(tree.select(F.col("path").alias("template")).distinct(), "template", "left_semi")
    return met.groupBy("path").agg(F.min_by("template", "kind").alias("template"))
