"""Options of a program looked up in its trees: as they are written, by the parts of their names, in another case, in history alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks, lookup

#: Folders, endings and stems of documentation; kinds of options that a generated file may hold.
DOC_FOLDERS = ("doc", "docs", "documentation", "man", "manpages")
DOC_ENDINGS = (".1", ".3", ".8", ".adoc", ".html", ".md", ".pod", ".rst", ".txt")
DOC_STEMS = ("changelog", "changes", "news", "readme")
GENERATED_KINDS = ("constant", "config_key")


def is_doc(path: Column) -> Column:
    """Whether a path is one of documentation: by its folders, its ending or its stem."""
    parts = F.split(F.lower(path), "/", -1)
    name = F.element_at(parts, -1)
    ending, stem = F.regexp_extract(name, r".(\.[^.]*)$", 1), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in DOC_FOLDERS])) | ending.isin(*DOC_ENDINGS) | stem.isin(*DOC_STEMS)


def option_kind(token: Column) -> Column:
    """cli_flag, config_key (parts with dots between) or constant."""
    return F.when(token.startswith("-"), "cli_flag").when(F.contains(token, F.lit(".")), "config_key").otherwise("constant")


def name_forms(token: Column) -> Column:
    """What code may call an option by: a flag without its dashes, with _ for -; the parts of a key; nothing else of a constant."""
    bare = F.regexp_replace(token, "^-+", "")
    forms = F.when(option_kind(token) == "cli_flag", F.array(bare, F.translate(bare, "-", "_"))).when(option_kind(token) == "config_key", F.split(token, r"\.", -1)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(forms, lambda f: (f != "") & (f != token)))


def _lookup(probes: DataFrame, lines: DataFrame) -> DataFrame:
    return lookup.found(probes, lookup.word_index(lines), lines, apart=True)


def c14_options(claims: DataFrame, targets: DataFrame, tree: DataFrame, lines: DataFrame, history: DataFrame, complete: bool = True) -> DataFrame:
    """Does an option exist in the release that a report speaks of? claims: of kind option; targets: report_id, release; tree: release, path, blob, generated;
    lines: blob, line_no, line; history: line, of all that commits ever added or removed.

    Blobs, not files of releases, are indexed by words; options, their name forms and their lower-cased spelling are looked up by their rarest word. Present as written; else
    named only (one form of a flag, all parts of a key); else in another release, where a file that is generated decides nothing; else in no release but in history, or there in another case."""
    # what files and blobs come to is not known beforehand: none of it is broadcast
    tree = tree.hint("merge")
    rows = checks.subjects(claims, ["option"]).join(targets, "report_id", "left").withColumn("option_kind", option_kind(F.col("subject")))
    tokens = rows.select("subject").distinct()
    exact = _lookup(tokens.select("subject", F.col("subject").alias("probe")), lines).select("subject", "blob").distinct().join(tree, "blob")
    forms = tokens.select("subject", F.explode(name_forms(F.col("subject"))).alias("probe"))
    named = _lookup(forms, lines).select("subject", "probe", "blob").distinct().join(tree, "blob").select("subject", "release", "probe").distinct()
    # lines of history have no places: each distinct one is a file of its own
    apart = lambda text: text.distinct().select(F.xxhash64("line").alias("blob"), F.lit(0).alias("line_no"), "line")
    past = apart(history.select("line"))
    folded = apart(history.select(F.lower("line").alias("line")).unionByName(lines.select(F.lower("line").alias("line"))))
    ever = _lookup(tokens.select("subject", F.col("subject").alias("probe")), past).select("subject").distinct().withColumn("ever", F.lit(True))
    any_case = _lookup(tokens.select("subject", F.lower("subject").alias("probe")), folded).select("subject").distinct().withColumn("any_case", F.lit(True))
    here = exact.groupBy("subject", "release").agg(F.lit(True).alias("here"), F.bool_or(is_doc(F.col("path"))).alias("documented"))
    elsewhere = exact.groupBy("subject").agg(F.lit(True).alias("elsewhere"), F.bool_and("generated").alias("built"))
    wanted = F.size(name_forms(F.col("subject")))
    names = named.groupBy("subject", "release").agg(F.count("*").alias("forms"))
    rows = rows.join(here, ["subject", "release"], "left").join(names, ["subject", "release"], "left")
    for other in (elsewhere, ever, any_case):
        rows = rows.join(other, "subject", "left")
    by_name = F.when(F.col("option_kind") == "config_key", F.col("forms") >= wanted).otherwise(F.col("forms") > 0)
    key = (
        F.when(F.col("here"), "present")
        .when(F.coalesce(by_name, F.lit(False)), "name_only")
        .when(F.col("elsewhere") & F.col("built") & F.col("option_kind").isin(*GENERATED_KINDS), "generated")
        .when(F.col("elsewhere"), "other_release_only")
        .when(F.lit(not complete), "search_incomplete")
        .when(F.col("ever"), "history_only")
        .when(F.col("any_case"), "case_variant_only")
        .otherwise("never_in_history")
    )
    return checks.evidence(rows, "C14", "option", key)
