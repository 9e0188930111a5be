"""Ordered series: presence over releases, runs, and fingerprints of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: list[str], order: str, flag: str) -> DataFrame:
    """Maximal stretches of consecutive places where the flag holds: key, first, last, n."""
    held = rows.where(F.col(flag))
    by = Window.partitionBy(*key).orderBy(order)
    return held.withColumn("_island", F.col(order) - F.row_number().over(by)).groupBy(*key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def timeline(places: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every symbol that is ever mentioned at every place of the series.

    places: ord; mentions: symbol, ord, defines (boolean), parsed (boolean). defined, referenced, and uncertain: not defined there, but
    mentioned where something could not be read."""
    seen = mentions.groupBy("symbol", "ord").agg(F.bool_or("defines").alias("defined"), F.lit(True).alias("referenced"), F.bool_or(~F.col("parsed")).alias("partial"))
    # the series is short (releases), so each symbol is spread over it by exploding, not by pairing tables
    series = places.agg(F.array_sort(F.collect_set("ord")).alias("ords"))
    symbols = mentions.select("symbol").distinct().join(F.broadcast(series)).select("symbol", F.explode("ords").alias("ord"))
    none = F.lit(False)
    return symbols.join(seen, ["symbol", "ord"], "left").select("symbol", "ord", F.coalesce("defined", none).alias("defined"), F.coalesce("referenced", none).alias("referenced"), (~F.coalesce("defined", none) & F.coalesce("partial", none)).alias("uncertain"))


def introduced(line: DataFrame) -> DataFrame:
    """Per symbol where it is first and last defined, whether ever, and in how many places."""
    return line.groupBy("symbol").agg(F.min(F.when(F.col("defined"), F.col("ord"))).alias("introduced"), F.max(F.when(F.col("defined"), F.col("ord"))).alias("last_defined"), F.bool_or("defined").alias("ever_defined"), F.count_if("defined").alias("n_defined"))


def token_hash(text: Column) -> Column:
    """60 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def kgrams(docs: DataFrame, tokens: Column, k: int = 5) -> DataFrame:
    """doc_id, pos (from 0) and hash of every run of k tokens."""
    grams = F.transform(F.sequence(F.lit(0), F.size("tokens") - k), lambda i: token_hash(F.array_join(F.slice("tokens", i + 1, k), "\x1f")))
    return docs.select("doc_id", tokens.alias("tokens")).where(F.size("tokens") >= k).select("doc_id", F.posexplode(grams).alias("pos", "hash"))


def winnowed(grams: DataFrame, window: int = 4) -> DataFrame:
    """Of every `window` k-grams in a row the least hash, the rightmost of equals; each chosen place once.

    A document with fewer k-grams than a window gives its least one."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    ahead = by.rowsBetween(0, window - 1)
    best = F.min(F.struct("hash", (-F.col("pos")).alias("back"))).over(ahead)
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    full = (F.col("pos") + (window - 1) <= last) | (F.col("pos") == 0)
    return grams.withColumn("best", best).withColumn("full", full).where("full").select("doc_id", (-F.col("best.back")).alias("pos"), F.col("best.hash").alias("hash")).distinct()


def robust_winnowed(docs: DataFrame, hashes: str = "hashes", window: int = 4) -> DataFrame:
    """Winnowing with the robust rule for ties: the last choice stays while it is in the window, unless a smaller hash comes.

    docs: doc_id and an array of hashes; a fold over the array, so that repeated hashes give few fingerprints."""
    n = F.size(hashes)
    kind = "struct<at:int,out:array<int>>"
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(acc: Column, i: Column) -> Column:
        part = F.slice(hashes, i + 1, window)
        least = F.array_min(part)
        right = i + F.size(part) - F.array_position(F.reverse(part), least).cast("int")
        keep = (acc["at"] >= i) & (F.get(F.col(hashes), acc["at"]) <= least)
        at = F.when(keep, acc["at"]).otherwise(right)
        return F.struct(at.cast("int").alias("at"), F.when(keep, acc["out"]).otherwise(F.concat(acc["out"], F.array(right.cast("int")))).alias("out"))

    chosen = F.aggregate(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), start, step, lambda acc: acc["out"])
    return docs.where(n > 0).select("doc_id", hashes, F.explode(chosen).alias("pos")).select("doc_id", "pos", F.get(hashes, F.col("pos")).alias("hash"))


#: Families whose names say nothing of the project; share of a family's versions that may stand on the line already.
GENERIC_FAMILIES, MOST_SHARED = ("v", "version", "release", ""), 0.2


def main_families(releases: DataFrame, key: list[str]) -> DataFrame:
    """Families of tags that make up the main line of releases: key, families. releases: key, family, version (of final releases).

    The largest family begins; others follow by size if at most MOST_SHARED of their versions are on the line and their name doesn't extend the
    first one's. A project has few families with some hundred releases each, so the fold is over one small array a project."""
    sets = releases.groupBy(*key, "family").agg(F.collect_set("version").alias("versions"))
    order = F.array_sort(F.collect_list(F.struct((-F.size("versions")).alias("size"), "family", "versions")))
    start = F.struct(F.array().cast("array<string>").alias("families"), F.array().cast("array<string>").alias("covered"))

    def step(acc: Column, one: Column) -> Column:
        first = F.get(acc["families"], F.lit(0))
        variant = ~first.isin(*GENERIC_FAMILIES) & F.contains(one["family"], first)
        overlap = F.size(F.array_intersect(one["versions"], acc["covered"])) > MOST_SHARED * F.size(one["versions"])
        out = F.coalesce(first.isNotNull() & (variant | overlap), F.lit(False))
        return F.struct(F.when(out, acc["families"]).otherwise(F.concat(acc["families"], F.array(one["family"]))).alias("families"), F.when(out, acc["covered"]).otherwise(F.array_union(acc["covered"], one["versions"])).alias("covered"))

    return sets.groupBy(*key).agg(order.alias("all")).select(*key, F.aggregate("all", start, step, lambda acc: F.array_sort(acc["families"])).alias("families"))


def outward(fits: DataFrame, homes: DataFrame, key: list[str], radius: int, usable: float, most: int) -> DataFrame:
    """From each home outwards the place that fits best: key, best, ratio, looked, radius, complete.

    fits: key, ord, ratio (null where nothing could be compared); homes: key, home. Places are looked at by distance, the earlier of two first. A window of `radius`
    doubles until a usable ratio is found or all is seen; after `most` places the scan ends, incomplete. One fold over the band of a home's places, which stops looking, though
    not counting, at its end; of equal ratios the nearer wins."""
    distance = F.abs(F.col("ord") - F.col("home"))
    rows = fits.join(homes, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(distance.alias("distance"), "ord", "ratio"))).alias("places"))
    kind = "struct<best:struct<ratio:double,back:bigint,behind:bigint>,looked:int,radius:bigint,open:boolean,complete:boolean>"
    start = F.struct(F.lit(None).cast("struct<ratio:double,back:bigint,behind:bigint>").alias("best"), F.lit(0).alias("looked"), F.lit(radius).cast("long").alias("radius"), F.lit(True).alias("open"), F.lit(True).alias("complete")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        beyond = x["distance"] > acc["radius"]
        enough = F.coalesce(acc["best"]["ratio"] >= usable, F.lit(False))
        ends = ~acc["open"] | (beyond & enough)
        capped = ~ends & (acc["looked"] >= most)
        wider = F.when(beyond, acc["radius"] * F.pow(F.lit(2.0), F.ceil(F.log2(x["distance"] / acc["radius"]) - 1e-9)).cast("long")).otherwise(acc["radius"])
        here = F.when(x["ratio"].isNotNull(), F.struct(x["ratio"].alias("ratio"), (-x["distance"]).cast("long").alias("back"), (-x["ord"]).cast("long").alias("behind")))
        new = F.struct(F.greatest(acc["best"], here).alias("best"), (acc["looked"] + 1).alias("looked"), wider.alias("radius"), F.lit(True).alias("open"), acc["complete"].alias("complete"))
        shut = F.struct(acc["best"].alias("best"), acc["looked"].alias("looked"), acc["radius"].alias("radius"), F.lit(False).alias("open"), (acc["complete"] & ~capped).alias("complete"))
        return F.when(ends | capped, shut).otherwise(new).cast(kind)

    found = rows.select(*key, F.aggregate("places", start, step).alias("x"))
    return found.select(*key, (-F.col("x.best.behind")).alias("best"), F.col("x.best.ratio").alias("ratio"), "x.looked", "x.radius", "x.complete")


def covered(ranges: DataFrame, releases: DataFrame, key: list[str]) -> DataFrame:
    """ranges with `first`, the ord of the earliest release that a range covers; null if there is none.

    ranges: key, lower, lower_inclusive, upper, upper_inclusive (bounds as arrays of numbers, null for an open end); releases: key, ord, trimmed, in one order. Distinct lower
    bounds and releases are laid in one ordered window for each key: the next release from a bound on is its first, if it is within the upper bound."""
    bound = F.coalesce("lower", F.array().cast("array<int>"))
    inclusive = F.coalesce("lower_inclusive", F.lit(True))
    asked = ranges.select("*", bound.alias("_bound"), F.when(inclusive, 0).otherwise(2).alias("_side"))
    points = asked.select(*key, "_bound", "_side").distinct().withColumn("_at", F.lit(None).cast("struct<ord:int,trimmed:array<int>>"))
    every = points.unionByName(releases.select(*key, F.col("trimmed").cast("array<int>").alias("_bound"), F.lit(1).alias("_side"), F.struct(F.col("ord").cast("int").alias("ord"), F.col("trimmed").cast("array<int>").alias("trimmed")).alias("_at")))
    ahead = Window.partitionBy(*key).orderBy("_bound", "_side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nearest = every.withColumn("_next", F.first("_at", ignorenulls=True).over(ahead)).where("_side <> 1").select(*key, "_bound", "_side", "_next")
    rows = asked.join(nearest, [*key, "_bound", "_side"], "left")
    within = F.col("upper").isNull() | (F.col("_next.trimmed") < F.col("upper")) | (F.coalesce("upper_inclusive", F.lit(False)) & (F.col("_next.trimmed") == F.col("upper")))
    return rows.select(*ranges.columns, F.when(within, F.col("_next.ord")).alias("first"))
