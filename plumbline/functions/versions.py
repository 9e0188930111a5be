"""Versions, tags and severity scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of release kinds.
KINDS = {"dev": 0, "alpha": 1, "beta": 2, "pre": 2, "rc": 3, "final": 4, "post": 5}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbers_of(raw: Column) -> Column:
    """The leading dotted numbers of a version, as integers; null if there is none."""
    found = F.regexp_extract(raw, "^[vV]?([0-9]{1,9}(?:[._-][0-9]{1,9})*+)", 1)
    return F.when(found != "", F.transform(F.split(found, "[._-]"), lambda x: x.try_cast("int")))


def trimmed(numbers: Column) -> Column:
    """Numbers without closing zeros, so that 1.2 and 1.2.0 are one."""
    last = F.array_max(F.transform(F.sequence(F.lit(0), F.size(numbers)), lambda i: F.when((i > 0) & (F.get(numbers, i - 1) != 0), i).otherwise(0)))
    return F.slice(numbers, F.lit(1), last)


def tag(name: Column) -> Column:
    """Struct of a tag's family, numbers, trimmed numbers, kind, its rank, number and letter; null fields if the name has no version.

    A name is family, separator, numbers and an optional qualifier (alpha, beta, pre, rc, dev, post with a number, or one
    letter, which is a later release). Names whose numbers are a date are no versions."""
    pattern = "^(|.*?[^0-9.])([0-9]{1,9}(?:[._-][0-9]{1,9})*+)(?:[._-]?(alpha|beta|pre|rc|dev|post|[a-z])[._-]?([0-9]{0,9}))?(?:-candidate)?$"
    part = lambda k: F.regexp_extract(F.lower(name), pattern, k)
    raw = part(2)
    numbers = F.transform(F.split(raw, "[._-]"), lambda x: x.try_cast("int"))
    dated = (F.size(numbers) >= 3) & F.get(numbers, F.lit(0)).between(1970, 2100) & ~raw.contains(".")
    ok = (raw != "") & ~dated
    word = part(3)
    kind = F.when(word == "", "final").when(F.length(word) == 1, "post").otherwise(word)
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), kind)
    return F.struct(
        F.when(ok, F.regexp_replace(part(1), "[._-]+$", "")).alias("family"),
        F.when(ok, numbers).alias("numbers"),
        F.when(ok, trimmed(numbers)).alias("trimmed"),
        F.when(ok, kind).alias("kind"),
        F.when(ok, rank).alias("rank"),
        F.when(ok, F.coalesce(F.when(part(4) != "", part(4).try_cast("int")), F.lit(0))).alias("qual_num"),
        F.when(ok, F.when(F.length(word) == 1, word).otherwise("")).alias("letter"),
    )


def sort_key(parsed: Column) -> Column:
    """What releases are ordered by."""
    return F.struct(parsed["trimmed"], parsed["rank"], parsed["qual_num"], parsed["letter"])


def roundup(x: Column) -> Column:
    """The least tenth not under x, by integers, as severity scores round."""
    whole = F.floor(x * 100000 + 0.5).cast("long")
    return F.when(F.pmod(whole, F.lit(10000)) == 0, whole / 100000.0).otherwise((F.floor(whole / 10000) + 1) / 10.0)


#: Weights of the base metrics, version 3.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


def base_score(vector: Column) -> Column:
    """The base score of a version 3.0 or 3.1 vector; null if it can't be read."""

    def weight(metrics: Column, key: str, table: dict[str, float]) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.try_element_at(metrics, F.lit(key)))

    def parts(metrics: Column) -> Column:
        changed = F.try_element_at(metrics, F.lit("S")) == "C"
        privileges = F.when(changed, weight(metrics, "PR", PRIVILEGES["C"])).otherwise(weight(metrics, "PR", PRIVILEGES["U"]))
        miss = 1 - (1 - weight(metrics, "C", WEIGHTS["C"])) * (1 - weight(metrics, "I", WEIGHTS["I"])) * (1 - weight(metrics, "A", WEIGHTS["A"]))
        ease = 8.22 * weight(metrics, "AV", WEIGHTS["AV"]) * weight(metrics, "AC", WEIGHTS["AC"]) * privileges * weight(metrics, "UI", WEIGHTS["UI"])
        known = F.try_element_at(metrics, F.lit("S")).isin("U", "C")
        return F.struct(F.when(known, changed).alias("changed"), miss.alias("miss"), ease.alias("ease"))

    def score(x: Column) -> Column:
        impact = F.when(x["changed"], 7.52 * (x["miss"] - 0.029) - 3.25 * F.pow(x["miss"] - 0.02, F.lit(15.0))).otherwise(6.42 * x["miss"])
        return let(impact, lambda i: F.when(i <= 0, F.lit(0.0)).otherwise(let(F.least(F.when(x["changed"], 1.08 * (i + x["ease"])).otherwise(i + x["ease"]), F.lit(10.0)), roundup)))

    metrics = F.str_to_map(F.regexp_replace(vector, "^CVSS:3\\.[01]/", ""), F.lit("/"), F.lit(":"))
    known = lambda x: x["changed"].isNotNull() & x["miss"].isNotNull() & x["ease"].isNotNull()
    return F.when(vector.rlike("^CVSS:3\\.[01]/"), let(let(metrics, parts), lambda x: F.when(known(x), score(x))))


#: Metrics beside the base ones, version 3: a vector that sets one has a second score, and a report may give either.
MODIFIERS = "E RL RC CR IR AR MAV MAC MPR MUI MS MC MI MA".split()


def modifiers(vector: Column) -> Column:
    """The metrics beside the base ones that a vector sets to something, sorted; X sets nothing."""
    parts = F.transform(F.split(F.upper(F.trim(vector)), "/", -1), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), F.split_part(x, F.lit(":"), F.lit(2)).alias("value")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda x: x["key"].isin(MODIFIERS) & ~x["value"].isin("X", "")), lambda x: x["key"])))


def severity_band(score: Column, generation: int = 3) -> Column:
    if generation < 3:
        return F.when(score < 4, "low").when(score < 7, "medium").when(score.isNotNull(), "high")
    return F.when(score < 0.1, "none").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").when(score.isNotNull(), "critical")
