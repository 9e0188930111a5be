"""Domain checks: joins of claims with facts of a project, ending in a ladder of outcomes and strengths.

Facts (all keyed for equality joins): releases(name, ord, epoch, trimmed, kind), tree(release, path, blob), blobs(blob, n_lines, parsed), symbols(blob,
name, start, end), lines(blob, line_no, text), history_paths(path), history_names(name), history_lines(text), commits(sha, path, epoch).
Evidence rows: report_id, check_id, grp, subject, outcome_key, outcome, strength, claim_ids. One fact is one row: claims of one subject are
gathered before it is scored. What can't be decided is neutral; absence refutes only if the search was complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.bugs import same_class
from plumbline.functions.text import collapsed, path_owner, path_parts, repository
from plumbline.functions.versions import base_score, modifiers, severity_band, tag
from plumbline.operators.alignment import anchored_alignment, line_likeness
from plumbline.operators.fusion import gated
from plumbline.operators.joins import compatible, suffix_join
from plumbline.operators.series import covered, introduced, kgrams, winnowed

#: Strengths by check and outcome; what is not named is neutral.
STRENGTHS = {
    "C01": {"resolves": 0.2, "future_release": -1.5, "gap_in_releases": -1.0},
    "C02": {"exists": 0.5, "missing_here_present_elsewhere": -0.8, "never_in_history": -2.0},
    "C03": {"defined": 0.6, "defined_core": 1.0, "absent_here_present_elsewhere": -0.8, "never_in_history_core": -3.0, "never_in_history_supporting": -1.5},
    "C04": {"in_bounds": 0.2, "past_end": -1.5},
    "C05": {"in_function": 1.0, "outside_function": -0.8, "fits_nearby_release": -0.3},
    "C06": {"exact": 1.5, "near_by_offset": 0.8, "elsewhere_in_file": -0.3, "other_release_only": -0.4, "nowhere_in_history": -2.0},
    "C07": {"contained": 2.0, "partial": 0.5, "other_release_only": -0.5, "absent_everywhere": -2.5},
    "C08": {"all_consistent": 2.0, "mostly": 0.8, "mixed": -0.5, "inconsistent": -2.0},
    "C09": {"all_edges_real": 1.5, "missing_edge": -1.0},
    "C10": {"claimed_release_fits": 1.0, "other_release_fits": -0.3, "no_release_fits": -1.5},
    "C11": {"consistent": 0.3, "violation": -0.7},
    "C12": {"applies_clean": 1.5, "applies_with_fuzz": 0.6, "already_applied": 0.0, "other_release_only": -0.4, "context_not_found": -1.8},
    "C13": {"modified_after": 0.0},
    "C14": {"present": 0.4, "other_release_only": -0.5, "never_in_history": -2.0},
    "C15": {"commit_exists": 0.3, "commit_touches_file": 0.5, "commit_missing": 0.0, "foreign_repo": -0.3, "cve_matches_product": 0.3, "cve_other_product": -1.0, "cve_rejected": -0.5, "cve_not_found": -0.3, "cwe_incompatible": -0.4},
    "C16": {"consistent": 0.3, "range_predates_symbol": -1.0, "fixed_in_unchanged": -0.6},
    "C17": {"vector_unparseable": -0.3, "score_mismatch": -0.6, "severity_mismatch": -0.3},
    "C18": {"calls_api": 0.8, "does_not_call_api": -1.2},
    "C19": {"signature_match": 6.0, "different_signature": 0.5, "no_crash": -0.5},
    "C21": {"hygiene": 0.0},
}


def strength(check: str, key: Column) -> Column:
    out = F.lit(0.0)
    for name, value in STRENGTHS[check].items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def evidence(rows: DataFrame, check: str, group: str, key: Column, factor: Column | None = None) -> DataFrame:
    """rows (report_id, subject, claim_ids, and maybe attributed and negated) as evidence, through the refutation gate."""
    value = strength(check, F.col("outcome_key"))
    value = F.round(value * factor, 6) if factor is not None else value
    extra = [c for c in ("attributed", "negated") if c in rows.columns]
    base = rows.withColumn("outcome_key", key).withColumn("strength", value)
    base = base.withColumn("outcome", F.when(F.col("strength") > 0, "SUPPORTS").when(F.col("strength") < 0, "REFUTES").otherwise("NEUTRAL"))
    if not extra:
        return base.select("report_id", F.lit(check).alias("check_id"), F.lit(group).alias("grp"), "subject", "outcome_key", "outcome", "strength", "claim_ids")
    closed = gated(base.withColumn("claim_id", F.get("claim_ids", F.lit(0))))
    return closed.select("report_id", F.lit(check).alias("check_id"), F.lit(group).alias("grp"), "subject", "outcome_key", "outcome", "strength", "claim_ids")


def subjects(claims: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each (report, subject): its claims, whether all are the project's, any is negated, any is core."""
    rows = claims.where(F.col("kind").isin(kinds))
    return rows.groupBy("report_id", F.col("value").alias("subject")).agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"), F.bool_and(F.col("provenance") == "project_attributed").alias("attributed"), F.bool_or("negated").alias("negated"), F.bool_or(F.col("role") == "core").alias("core"))


def c01_version_resolves(claims: DataFrame, releases: DataFrame, reported: DataFrame) -> DataFrame:
    """Does the version exist? reported: report_id, epoch (end of the report's day)."""
    rows = subjects(claims, ["version"]).withColumn("v", tag(F.col("subject"))).join(reported, "report_id", "left")
    same = releases.groupBy("trimmed", "kind").agg(F.min("epoch").alias("released"))
    final = releases.where("kind = 'final'").agg(F.max("trimmed").alias("newest"), F.min("trimmed").alias("oldest"))
    met = rows.join(same, (F.col("v.trimmed") == F.col("trimmed")) & (F.col("v.kind") == F.col("kind")), "left").drop("kind", "trimmed").join(F.broadcast(final))
    key = (
        F.when(F.col("v.numbers").isNull(), "version_shape_differs")
        .when(F.col("released").isNotNull() & (F.col("epoch") + 86400 < F.col("released")) & (F.col("v.kind") == "final"), "future_release")
        .when(F.col("released").isNotNull(), "resolves")
        .when(F.col("v.kind") != "final", "prerelease_unmatched")
        .when(F.col("v.trimmed") > F.col("newest"), "newer_than_all_releases")
        .when(F.col("v.trimmed") < F.col("oldest"), "older_than_all_releases")
        .otherwise("gap_in_releases")
    )
    return evidence(met, "C01", "version", key)


def c02_file_exists(claims: DataFrame, targets: DataFrame, tree: DataFrame, history_paths: DataFrame, complete: bool = True, generated: DataFrame | None = None) -> DataFrame:
    """Is there such a file in the target release, in another one, or ever? targets: report_id, release. Paths meet on suffixes.

    generated: cited paths that a build makes or only releases hold (from globs and templates); these, and paths outside the repository, are neutral where missing."""
    rows = subjects(claims, ["file"]).join(targets, "report_id", "left")
    met = suffix_join(rows.select(F.col("subject").alias("cited")), tree.select("path"))
    base = F.element_at(path_parts(F.col("subject")), -1)
    here = met.join(tree, "path").select("cited", F.col("release").alias("r")).distinct()
    rows = rows.join(here, (F.col("subject") == F.col("cited")) & (F.col("release") == F.col("r")), "left").withColumn("here", F.col("r").isNotNull()).drop("cited", "r")
    rows = rows.join(met.select(F.col("cited").alias("any")).distinct(), F.col("subject") == F.col("any"), "left")
    ever = history_paths.select(F.element_at(path_parts(F.col("path")), -1).alias("base")).distinct()
    rows = rows.withColumn("name", base).join(ever, F.col("name") == F.col("base"), "left")
    made = F.lit(False)
    if generated is not None:
        rows, made = rows.join(generated.select(F.col("cited").alias("subject"), F.lit(True).alias("made")).distinct(), "subject", "left"), F.coalesce("made", F.lit(False))
    out = path_owner(F.col("subject")) != "project_attributed"
    key = F.when(F.col("here"), "exists").when(made, "generated_or_release_only").when(out, "outside_repository").when(F.col("any").isNotNull(), "missing_here_present_elsewhere").when(F.col("base").isNull() & F.lit(complete), "never_in_history").otherwise("absence_not_established")
    return evidence(rows, "C02", "file", key, F.when(F.col("core") & (F.col("outcome_key") == "never_in_history"), 1.5).otherwise(1.0))


def c03_symbol_exists(claims: DataFrame, targets: DataFrame, tree: DataFrame, symbols: DataFrame, history_names: DataFrame, complete: bool = True) -> DataFrame:
    rows = subjects(claims, ["symbol"]).join(targets, "report_id", "left")
    defined = tree.join(symbols, "blob").select("release", F.col("name").alias("subject")).distinct()
    rows = rows.join(defined.withColumn("here", F.lit(True)), ["release", "subject"], "left")
    rows = rows.join(defined.select("subject").distinct().withColumn("elsewhere", F.lit(True)), "subject", "left")
    rows = rows.join(history_names.select(F.col("name").alias("subject")).distinct().withColumn("ever", F.lit(True)), "subject", "left")
    key = (
        F.when(F.col("here") & F.col("core"), "defined_core")
        .when(F.col("here"), "defined")
        .when(F.col("elsewhere"), "absent_here_present_elsewhere")
        .when(F.col("ever"), "in_history_not_released")
        .when(~F.lit(complete), "history_incomplete")
        .when(F.col("core"), "never_in_history_core")
        .otherwise("never_in_history_supporting")
    )
    return evidence(rows, "C03", "symbol", key)


def _located(claims: DataFrame, targets: DataFrame, tree: DataFrame) -> DataFrame:
    """Line claims with the blobs that their path means in the target release: path, line, blob."""
    rows = subjects(claims, ["line"]).withColumn("path_", F.regexp_extract("subject", "^(.*):([0-9]+)$", 1)).withColumn("line", F.regexp_extract("subject", "^(.*):([0-9]+)$", 2).try_cast("int"))
    met = suffix_join(rows.select(F.col("path_").alias("cited")), tree.select("path")).select("cited", "path")
    return rows.join(targets, "report_id").join(met, F.col("path_") == F.col("cited")).join(tree, ["release", "path"])


def c04_line_in_bounds(claims: DataFrame, targets: DataFrame, tree: DataFrame, blobs: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Does the file have so many lines? Any of the files that the path can mean is enough; a missing file is another check's matter.

    What can't be judged is neutral: a path that a build makes (generated: cited), one that is no regular file (tree may have mode), and one that shares but its end with a file elsewhere."""
    rows = _located(claims, targets, tree)
    regular = F.coalesce(F.col("mode").startswith("100"), F.lit(True)) if "mode" in tree.columns else F.lit(True)
    fits = compatible(F.col("path_"), F.col("path"))
    known = rows.join(blobs, "blob", "left").withColumn("regular", regular).withColumn("fits", fits)
    judged = F.col("regular") & F.col("fits") & F.col("n_lines").isNotNull()
    found = known.groupBy("report_id", "subject", "claim_ids", "attributed", "negated", "path_").agg(F.bool_or(judged & (F.col("line") <= F.col("n_lines"))).alias("ok"), F.bool_or(judged).alias("judged"), F.bool_or("fits").alias("fits"), F.bool_or("regular").alias("regular"))
    made = F.lit(False)
    if generated is not None:
        found, made = found.join(generated.select(F.col("cited").alias("path_"), F.lit(True).alias("made")).distinct(), "path_", "left"), F.coalesce("made", F.lit(False))
    key = F.when(F.coalesce("ok", F.lit(False)), "in_bounds").when(made, "generated_or_release_only").when(F.col("judged"), "past_end").when(~F.col("fits"), "other_file").when(~F.col("regular"), "not_a_regular_file").otherwise("unreadable")
    return evidence(found, "C04", "location", key)


def c05_line_in_function(frames: DataFrame, tree: DataFrame, blobs: DataFrame, symbols: DataFrame, nearby: DataFrame | None = None) -> DataFrame:
    """Does the function hold the line? frames: report_id, release, path, line, function, claim_ids; nearby: release, near (the releases around each),
    in which a line that is outside the function here may be inside."""
    met = frames.join(tree, ["release", "path"]).join(blobs, "blob")
    held = met.join(symbols.select("blob", F.col("name").alias("function"), "start", "end"), ["blob", "function"], "left")
    rows = held.groupBy("report_id", F.concat_ws(":", "path", "line", "function").alias("subject"), "claim_ids").agg(F.bool_or(F.col("line").between(F.col("start"), F.col("end"))).alias("inside"), F.bool_or(F.col("start").isNotNull()).alias("defined"), F.bool_and("parsed").alias("parsed"), F.bool_or(F.col("line") <= F.col("n_lines")).alias("bounded"))
    fits = F.lit(False)
    if nearby is not None:
        there = frames.join(nearby, "release").join(tree.select(F.col("release").alias("near"), "path", "blob"), ["near", "path"]).join(symbols.select("blob", F.col("name").alias("function"), "start", "end"), ["blob", "function"])
        there = there.where(F.col("line").between(F.col("start"), F.col("end"))).select("report_id", F.concat_ws(":", "path", "line", "function").alias("subject"), F.lit(True).alias("fits")).distinct()
        rows, fits = rows.join(there, ["report_id", "subject"], "left"), F.coalesce("fits", F.lit(False))
    key = F.when(F.col("inside"), "in_function").when(fits, "fits_nearby_release").when(~F.col("bounded"), "line_past_end").when(~F.col("parsed"), "parse_incomplete").when(F.col("defined"), "outside_function").otherwise("function_not_defined")
    return evidence(rows, "C05", "location", key)


#: From which likeness on a line counts as the quoted one.
LEAST_LIKE = 0.9


def c06_line_content(quotes: DataFrame, lines: DataFrame, history_lines: DataFrame, radius: int = 3, least: int = 8) -> DataFrame:
    """Is the quoted text on the line or near it? quotes: report_id, subject, claim_ids, blob, line, quoted. Texts are compared with white space as one blank.

    Lines around the cited one are met by (blob, line) and compared by likeness if their lengths allow it; the likest counts, of equals the nearest. Others must be equal.
    A line of the file that equals the quote counts before lines around the cited one that are only alike, and so does an equal one of another release before lines of which neither holds the other."""
    rows = quotes.withColumn("text_", collapsed(F.col("quoted"))).where(F.length("text_") >= least)
    found = lines.select("blob", F.col("line_no").alias("at"), collapsed(F.col("text")).alias("have"))
    met = rows.join(found.select("blob", F.col("have").alias("text_"), F.lit(True).alias("elsewhere")).distinct(), ["blob", "text_"], "left")
    around = rows.select("report_id", "subject", "blob", "line", "text_", F.explode(F.sequence(F.col("line") - radius, F.col("line") + radius)).alias("at")).join(found, ["blob", "at"])
    possible = 2 * F.least(F.length("text_"), F.length("have")) >= LEAST_LIKE * (F.length("text_") + F.length("have"))
    like = around.where(F.contains("have", F.col("text_")) | possible).withColumn("like", line_likeness(F.col("text_"), F.col("have"))).where(F.col("like") >= LEAST_LIKE)
    far = F.abs(F.col("at") - F.col("line"))
    # the line holds the quote, the quote holds the line, or they are only alike
    how = F.when(F.contains("have", F.col("text_")), 0).when(F.contains("text_", F.col("have")), 1).otherwise(2)
    off = like.groupBy("report_id", "subject", "line", "text_").agg(F.array(*[F.min_by(F.when(how == k, far), F.when(how == k, F.struct(-F.col("like"), far))) for k in range(3)]).alias("off"))
    ever = history_lines.select(collapsed(F.col("text")).alias("text_")).distinct().withColumn("ever", F.lit(True))
    best = met.join(off, ["report_id", "subject", "line", "text_"], "left").join(ever, "text_", "left")
    here = lambda k: F.when(F.col("off")[k] == 0, "exact").when(F.col("off")[k].isNotNull(), "near_by_offset")
    key = F.coalesce(here(0), F.when(F.col("elsewhere"), "elsewhere_in_file"), here(1), F.when(F.col("ever"), "other_release_only"), here(2), F.lit("nowhere_in_history"))
    return evidence(best, "C06", "content", key)


def c07_snippet_provenance(snippets: DataFrame, files: DataFrame, complete: bool = True, others: DataFrame | None = None) -> DataFrame:
    """Does a snippet come from the project? snippets: doc_id (report), tokens, n_lines; files: doc_id, tokens; others: the same of other releases. By shared fingerprints."""
    prints = winnowed(kgrams(snippets, F.col("tokens"))).select("doc_id", "hash").distinct()
    sizes = prints.groupBy("doc_id").agg(F.count("*").alias("size"))

    def best(of: DataFrame, name: str) -> DataFrame:
        met = prints.join(kgrams(of, F.col("tokens")).select(F.col("doc_id").alias("file"), "hash").distinct(), "hash").groupBy("doc_id", "file").agg(F.count("*").alias("shared"))
        return met.groupBy("doc_id").agg(F.max("shared").alias(name))

    small = (F.col("n_lines") < 3) | (F.size("tokens") < 25)
    rows = snippets.join(sizes, "doc_id").join(best(files, "shared"), "doc_id", "left")
    rows = rows.join(best(others, "there"), "doc_id", "left") if others is not None else rows.withColumn("there", F.lit(None).cast("long"))
    share = lambda name: F.coalesce(name, F.lit(0)) / F.col("size")
    rows = rows.select(F.col("doc_id").alias("report_id"), F.col("doc_id").cast("string").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), share("shared").alias("share"), share("there").alias("there"), small.alias("small"))
    key = F.when(F.col("share") >= 0.85, "contained").when(F.col("there") >= 0.85, "other_release_only").when(F.col("share") >= 0.5, "partial").when((F.greatest("share", "there") < 0.3) & F.lit(complete), "absent_everywhere").otherwise("insufficient_containment")
    return evidence(rows, "C07", "content", key, F.when(F.col("small"), 0.3).otherwise(1.0))


def consistency(good: Column, all_: Column) -> Column:
    """Bands of a share by integers."""
    return F.when(all_ == 0, "no_checkable_frames").when(good == all_, "all_consistent").when(good * 10 >= all_ * 8, "mostly").when(good * 2 >= all_, "mixed").otherwise("inconsistent")


#: Folders of other people's code.
OTHERS = ("/.cargo/registry/", "/.m2/repository/", "/dist-packages/", "/external/", "/go/pkg/mod/", "/node_modules/", "/site-packages/", "/third_party/", "/thirdparty/", "/usr/include/", "/usr/lib/", "/usr/lib64/", "/usr/local/", "/usr/share/", "/usr/src/", "/vendor/")


def others_code(path: Column, module: Column) -> Column:
    """Whether a frame says of itself that it lies in a shared library or in a folder of other people's code."""
    slashed = lambda x: F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\\\\", "/"), "^/+", ""))
    library = F.regexp_replace(slashed(module), "^.*/", "").rlike(r"\.(?:so|dll|dylib)$|\.so\.")
    inside = lambda x: F.coalesce(*[F.when(F.contains(slashed(x), F.lit(mark)), True) for mark in OTHERS], F.lit(False))
    return library | inside(path) | inside(module)


def made_by_runtime(function: Column) -> Column:
    """Whether no source defines a function of this name: <module>, <init>, {closure#0}, func1."""
    return F.coalesce(function.rlike(r"(?:^|[.:])(?:<[^<>]*>|\{[^{}]*\}|func[0-9]{1,9}(?:\.[0-9]{1,9})*)$"), F.lit(False))


#: What a frame can be, the best first: of several finds for one frame the first counts.
STATUSES = ("consistent", "uncertain", "inconsistent", "third_party", "skipped")
#: Frames in one part.
FRAMES_EACH = 250_000


def frame_status(frames: DataFrame, tree: DataFrame, blobs: DataFrame, symbols: DataFrame) -> DataFrame:
    """frames (report_id, release, function, path, line, maybe module) with a status: skipped, third_party (no file of the project, and other people's by its own
    words), uncertain (the file can't be read, or no source has such a name), consistent or inconsistent.

    Each distinct place is looked up once, so that a frame that many reports show, or no file of the project has, makes no large group."""
    place = ["release", "path", "function", "line"]
    met = frames.select(*place).distinct().join(tree.where("blob IS NOT NULL"), ["release", "path"]).join(blobs, "blob", "left")
    held = met.join(symbols.select("blob", F.col("name").alias("function"), "start", "end"), ["blob", "function"], "left")
    found = F.when(~F.col("parsed") | made_by_runtime(F.col("function")), 1).when(F.col("line").between(F.col("start"), F.col("end")), 0).otherwise(2)
    known = held.groupBy(*[F.col(c).alias(f"{c}_") for c in place]).agg(F.min(found).alias("found"))
    same = (F.col("release") == F.col("release_")) & (F.col("path") == F.col("path_")) & F.col("function").eqNullSafe(F.col("function_")) & F.col("line").eqNullSafe(F.col("line_"))
    module = F.col("module") if "module" in frames.columns else F.lit(None).cast("string")
    status = F.coalesce("found", F.when(others_code(F.col("path"), module), 3).when(F.col("path").isNull(), 4).otherwise(2))
    rows = frames.join(known, same, "left").select("report_id", "release", "index", status.alias("status"))
    parts = max(frames.sparkSession.sparkContext.defaultParallelism, -(-frames.count() // FRAMES_EACH))
    best = rows.repartition(parts, "report_id").groupBy("report_id", "release", "index").agg(F.min("status").alias("status"))
    return best.withColumn("status", F.get(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")))


def c08_trace_frames(status: DataFrame) -> DataFrame:
    rows = status.groupBy("report_id").agg(F.count_if(F.col("status") == "consistent").alias("good"), F.count_if(F.col("status").isin("consistent", "inconsistent")).alias("n"))
    return evidence(rows.select("*", F.lit("trace").alias("subject"), F.array().cast("array<string>").alias("claim_ids")), "C08", "trace", consistency(F.col("good"), F.col("n")))


def c09_trace_call_edges(edges: DataFrame) -> DataFrame:
    """edges: report_id, kind of each pair of frames. Missing edges add up to a floor."""
    rows = edges.groupBy("report_id").agg(F.count_if(F.col("kind") == "none").alias("missing"), F.count_if(F.col("kind") == "indirect_possible").alias("open"), F.count("*").alias("n"))
    rows = rows.select("report_id", F.lit("edges").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), "missing", "open")
    key = F.when(F.col("missing") > 0, "missing_edge").when(F.col("open") > 0, "indirect_possible").otherwise("all_edges_real")
    return evidence(rows, "C09", "trace", key, F.when(F.col("missing") > 0, F.least(F.col("missing"), F.lit(3)).cast("double")).otherwise(1.0))


def c10_trace_version_fit(status: DataFrame, claimed: DataFrame, least: int = 3) -> DataFrame:
    """Which release do the frames fit? status: of every release in the band; claimed: report_id, release as claimed_release."""
    share = status.groupBy("report_id", "release").agg(F.count_if(F.col("status") == "consistent").alias("good"), F.count_if(F.col("status").isin("consistent", "inconsistent")).alias("n")).where(F.col("n") >= least)
    rows = share.join(claimed, "report_id").groupBy("report_id").agg(F.max(F.when(F.col("release") == F.col("claimed_release"), F.col("good") / F.col("n"))).alias("here"), F.max(F.when(F.col("release") != F.col("claimed_release"), F.col("good") / F.col("n"))).alias("other"))
    rows = rows.select("report_id", F.lit("fit").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), F.coalesce("here", F.lit(0.0)).alias("here"), F.coalesce("other", F.lit(0.0)).alias("other"))
    key = F.when(F.col("here") == 1, "claimed_release_fits").when(F.col("other") == 1, "other_release_fits").when(F.greatest("here", "other") < 0.5, "no_release_fits").otherwise("partial_fit")
    return evidence(rows, "C10", "trace", key)


RULES = ("one_pid", "frames_numbered", "addresses_agree", "region_fits", "summary_agrees", "stacks_present", "size_possible")


def c11_sanitizer_sanity(found: DataFrame) -> DataFrame:
    """found: the rules' outcomes for each trace. Traces to which no rule applies give no row; violations add up to a floor of -2.5."""
    broken = sum((F.coalesce((~F.col(r)).cast("int"), F.lit(0)) for r in RULES), F.lit(0))
    asked = sum((F.col(r).isNotNull().cast("int") for r in RULES), F.lit(0))
    rows = found.withColumn("broken", broken).where(asked > 0).select("report_id", F.concat(F.lit("trace "), F.col("trace_no")).alias("subject"), F.array().cast("array<string>").alias("claim_ids"), "broken")
    factor = F.when(F.col("broken") > 0, F.least(F.col("broken").cast("double"), F.lit(2.5 / 0.7))).otherwise(1.0)
    return evidence(rows, "C11", "trace", F.when(F.col("broken") > 0, "violation").otherwise("consistent"), factor)


def _places(blocks: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Of each block of lines how far from its start it stands in the file: key, off. blocks: key, blob, start, body.

    Every place where the block's first line stands is a candidate; the lines from there on must equal it."""
    first = lines.select("blob", "line_no", F.rtrim("text").alias("first"))
    starts = blocks.select("*", F.rtrim(F.get("body", F.lit(0))).alias("first")).join(first, ["blob", "first"]).select(*key, "blob", F.col("line_no").alias("at"))
    want = blocks.select(*key, "blob", "start", F.size("body").alias("size"), F.posexplode("body").alias("k", "want"))
    met = starts.join(want, [*key, "blob"]).withColumn("line_no", F.col("at") + F.col("k")).join(lines.select("blob", "line_no", F.rtrim("text").alias("have")), ["blob", "line_no"])
    whole = met.where(F.col("have") == F.rtrim("want")).groupBy(*key, "at", "start", "size").agg(F.count("*").alias("n")).where(F.col("n") == F.col("size"))
    return whole.groupBy(*key).agg(F.min(F.abs(F.col("at") - F.col("start"))).alias("off"))


#: Context lines at either end of a hunk that may differ; the rungs of a hunk, best first.
MOST_FUZZ = 2
RUNGS = ("applies_clean", "applies_with_fuzz", "already_applied", "context_elsewhere_in_file", "other_release_only", "context_not_found")


def c12_patch_applies(hunks: DataFrame, lines: DataFrame, others: DataFrame | None = None, radius: int = 200) -> DataFrame:
    """Does a hunk apply to the file? hunks: report_id, hunk, blob, start, context (the lines before), target (after), lead and trail (context lines at
    either end); others: report_id, hunk, blob: the file in other releases. A patch is its worst hunk.

    In this order: the lines before stand near; the lines after do; either does without up to MOST_FUZZ outer context lines; the lines before stand anywhere."""
    key, body = ["report_id", "hunk", "side", "fuzz"], F.col("whole")
    sides = hunks.select("report_id", "hunk", "blob", "start", "lead", "trail", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("context").alias("whole")), F.struct(F.lit(1).alias("side"), F.when(F.col("target") != F.col("context"), F.col("target")).alias("whole")))).alias("s")).select("*", "s.*").where("whole IS NOT NULL")
    cut = sides.select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_FUZZ))).alias("fuzz")).withColumn("head", F.least("fuzz", "lead")).withColumn("tail", F.least("fuzz", "trail")).where("fuzz = 0 OR head > 0 OR tail > 0")
    size = F.size(body) - F.col("head") - F.col("tail")
    blocks = cut.where(size > 0).select(*key, "blob", (F.col("start") + F.col("head")).alias("start"), F.slice(body, F.col("head") + 1, size).alias("body"))
    near = F.col("off") <= radius
    rank = F.when(near, F.when(F.col("fuzz") == 0, F.col("side")).otherwise(F.col("side") + 2)).when((F.col("fuzz") == 0) & (F.col("side") == 0), 4)
    best = _places(blocks, lines, key).withColumn("rank", rank).where("rank IS NOT NULL").groupBy("report_id", "hunk").agg(F.min_by(F.struct("side", "fuzz", "off", "rank"), "rank").alias("m"))
    rung = F.when(F.col("m.rank") == 4, 3).when(F.col("m.side") == 1, 2).when((F.col("m.fuzz") == 0) & (F.col("m.off") == 0), 0).when(F.col("m").isNotNull(), 1)
    rows = hunks.select("report_id", "hunk").join(best, ["report_id", "hunk"], "left")
    elsewhere = F.lit(False)
    if others is not None:
        asked = hunks.select("report_id", "hunk", "start", F.col("context").alias("body")).join(others, ["report_id", "hunk"])
        there = _places(asked.withColumn("of", F.col("blob")), lines, ["report_id", "hunk", "of"]).where(near).select("report_id", "hunk", F.lit(True).alias("there")).distinct()
        rows, elsewhere = rows.join(there, ["report_id", "hunk"], "left"), F.coalesce("there", F.lit(False))
    worst = rows.groupBy("report_id").agg(F.max(F.coalesce(rung, F.when(elsewhere, 4).otherwise(5))).alias("rung"))
    rows = worst.select("report_id", F.lit("patch").alias("subject"), F.array().cast("array<string>").alias("claim_ids"), "rung")
    return evidence(rows, "C12", "patch", F.get(F.array(*[F.lit(k) for k in RUNGS]), F.col("rung")))


def c13_fix_status(loci: DataFrame, commits: DataFrame) -> DataFrame:
    """Later commits on a path: informational. loci: report_id, path, epoch."""
    met = loci.join(commits.select("path", F.col("epoch").alias("later"), "sha"), "path").where(F.col("later") > F.col("epoch"))
    rows = met.groupBy("report_id", F.col("path").alias("subject")).agg(F.slice(F.array_sort(F.collect_set("sha")), 1, 20).alias("claim_ids"))
    return evidence(rows, "C13", "history", F.lit("modified_after"))


def c14_option_exists(claims: DataFrame, targets: DataFrame, words: DataFrame, complete: bool = True) -> DataFrame:
    """Does an option's word stand in the release's files? words: release, word, from an exploded index of lines."""
    rows = subjects(claims, ["option"]).withColumn("word", F.regexp_replace("subject", "^-+", "")).join(targets, "report_id", "left")
    here = words.select("release", "word").distinct().withColumn("here", F.lit(True))
    rows = rows.join(here, ["release", "word"], "left").join(words.select("word").distinct().withColumn("any", F.lit(True)), "word", "left")
    key = F.when(F.col("here"), "present").when(F.col("any"), "other_release_only").when(F.lit(complete), "never_in_history").otherwise("search_incomplete")
    return evidence(rows, "C14", "option", key)


def c15_references(claims: DataFrame, records: DataFrame, products: DataFrame) -> DataFrame:
    """CVE ids against records (cve_id, state, product); products: report_id, product."""
    rows = subjects(claims, ["reference"]).where(F.col("subject").rlike("^CVE-")).join(products, "report_id", "left")
    rows = rows.join(records.select(F.col("cve_id").alias("subject"), "state", F.col("product").alias("recorded")), "subject", "left")
    key = F.when(F.col("state").isNull(), "cve_not_found").when(F.col("state") == "REJECTED", "cve_rejected").when(F.col("product").isNull(), "no_product").when(F.lower("product") == F.lower("recorded"), "cve_matches_product").otherwise("cve_other_product")
    return evidence(rows.drop("attributed", "negated"), "C15", "reference", key)


def c15_commits(claims: DataFrame, commits: DataFrame, cited: DataFrame, complete: bool = True) -> DataFrame:
    """Commit ids, whole or shortened to 7 digits or more, against commits (sha, path); cited: report_id, path. Ids meet on their first 7 digits."""
    rows = subjects(claims, ["reference"]).where(F.col("subject").rlike("^[0-9a-f]{7,40}$")).withColumn("head", F.substring("subject", 1, 7))
    met = rows.select("report_id", "subject", "head").join(commits.select(F.substring("sha", 1, 7).alias("head"), "sha", "path"), "head").where(F.startswith("sha", F.col("subject")))
    touched = met.join(cited.select("report_id", "path", F.lit(True).alias("cited")).distinct(), ["report_id", "path"], "left").groupBy("report_id", "subject").agg(F.bool_or(F.coalesce("cited", F.lit(False))).alias("touches"))
    rows = rows.join(touched, ["report_id", "subject"], "left")
    key = F.when(F.col("touches"), "commit_touches_file").when(F.col("touches").isNotNull(), "commit_exists").when(F.lit(complete), "commit_missing").otherwise("history_incomplete")
    return evidence(rows.drop("attributed", "negated"), "C15", "reference", key)


def c15_foreign_repositories(references: DataFrame, homes: DataFrame, commits: DataFrame) -> DataFrame:
    """Links into other repositories than the report's own. references: report_id, claim_id, url; homes: report_id, repo (its link), names (what the project answers to,
    lower-case); commits: sha. A mirror of the project's name is no other project, nor is a fork whose linked commit is the project's."""
    sha = F.lower(F.regexp_extract("url", "/commits?/([0-9a-fA-F]{7,40})", 1))
    rows = references.join(homes.select("report_id", repository(F.col("repo")).alias("home"), "names"), "report_id").withColumn("subject", repository(F.col("url"))).withColumn("sha", sha)
    rows = rows.where((F.col("home") != "") & (F.col("subject") != "") & (F.col("subject") != F.col("home")) & ~F.array_contains("names", F.regexp_extract("subject", "([^/]+)$", 1)))
    here = rows.where("sha <> ''").select("claim_id", "sha", F.substring("sha", 1, 7).alias("head")).join(commits.select(F.substring("sha", 1, 7).alias("head"), F.col("sha").alias("whole")), "head").where(F.startswith("whole", F.col("sha"))).select("claim_id").distinct()
    rows = rows.join(here, "claim_id", "left_anti").groupBy("report_id", "subject").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    return evidence(rows, "C15", "reference", F.lit("foreign_repo"))


def cwe_compatibility(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs: report_id, subject, claim_ids, cwe, family; table: cwe, families (array; empty means any)."""
    rows = pairs.join(F.broadcast(table), "cwe", "left")
    key = F.when(F.col("family").isNull(), "no_bug_type").when(F.col("families").isNull(), "unknown_cwe").when(F.size("families") == 0, "universal_cwe").when(F.array_contains("families", F.col("family")), "compatible").otherwise("cwe_incompatible")
    return evidence(rows, "C15", "reference", key)


def c16_version_range(ranges: DataFrame, introduced: DataFrame) -> DataFrame:
    """ranges: report_id, subject (symbol), claim_ids, lower (ord); introduced: symbol, introduced, ever_defined."""
    rows = ranges.join(introduced.select(F.col("symbol").alias("subject"), "introduced", "ever_defined"), "subject", "left")
    key = F.when(~F.coalesce("ever_defined", F.lit(False)), "timeline_blocked").when(F.col("lower") < F.col("introduced"), "range_predates_symbol").otherwise("consistent")
    return evidence(rows, "C16", "version", key)


#: Which finding of several stands for a claim: support, then what can't be decided, then a refutation.
PREFERENCE = ("SUPPORTS", "NEUTRAL", "REFUTES")


def preferred(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of a key's evidence the row of the best outcome, then the first by `order`: a claim is refuted only if all refute it."""
    rank = F.coalesce(*[F.when(F.col("outcome") == name, i) for i, name in enumerate(PREFERENCE)])
    by = Window.partitionBy(*key).orderBy(rank, *order)
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def c16_affected_range(ranges: DataFrame, cores: DataFrame, line: DataFrame, releases: DataFrame) -> DataFrame:
    """Does an affected range begin where one of the report's core symbols exists? The range's first release lies within both its bounds.

    ranges: report_id, repo, claim_id, lower, lower_inclusive, upper, upper_inclusive; cores: report_id, symbol; line: a timeline (symbol, ord, defined, uncertain); releases: repo,
    ord, trimmed. Each range is held against each core symbol; a range that covers no release is another check's matter."""
    rows = covered(ranges, releases, ["repo"]).where("first IS NOT NULL").join(cores.select("report_id", F.col("symbol").alias("subject")).distinct(), "report_id")
    known = introduced(line).select(F.col("symbol").alias("subject"), "introduced", "ever_defined")
    rows = rows.join(known, "subject", "left")
    doubts = line.where("uncertain").groupBy(F.col("symbol").alias("subject")).agg(F.collect_set("ord").alias("doubts"))
    rows = rows.join(doubts, "subject", "left")
    doubted = F.coalesce(F.exists("doubts", lambda o: (o >= F.col("first")) & (o < F.col("introduced"))), F.lit(False))
    key = F.when(~F.coalesce("ever_defined", F.lit(False)), "timeline_blocked").when(F.col("first") >= F.col("introduced"), "consistent").when(doubted, "partial_history").otherwise("range_predates_symbol")
    found = evidence(rows.withColumn("claim_ids", F.array("claim_id")), "C16", "version", key)
    found = found.join(known.select("subject", "introduced"), "subject", "left").withColumn("claim_id", F.get("claim_ids", F.lit(0)))
    return preferred(found, ["report_id", "claim_id"], ["introduced", "subject"]).drop("introduced", "claim_id")


def c16_fixed_in(fixes: DataFrame, digests: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Does the release that is said to hold the fix change the function? fixes: report_id, subject (symbol), claim_ids, fixed (ord); digests: symbol, ord, digest.

    lineage: ord, linear (whether the release before is in its history); where it isn't, an unchanged function says nothing of the fix."""
    at = lambda name: digests.select(F.col("symbol").alias("subject"), F.col("ord").alias("at"), F.col("digest").alias(name))
    rows = fixes.withColumn("at", F.col("fixed")).join(at("after"), ["subject", "at"], "left").withColumn("at", F.col("fixed") - 1).join(at("before"), ["subject", "at"], "left")
    if lineage is not None:
        rows = rows.join(lineage.select(F.col("ord").alias("fixed"), "linear"), "fixed", "left")
    else:
        rows = rows.withColumn("linear", F.lit(True))
    same = F.col("before") == F.col("after")
    key = F.when(F.col("before").isNull() | F.col("after").isNull(), "definition_missing").when(same & ~F.coalesce("linear", F.lit(False)), "previous_release_not_ancestor").when(same, "fixed_in_unchanged").otherwise("consistent")
    return evidence(rows, "C16", "version", key)


def c17_impact(impacts: DataFrame) -> DataFrame:
    """impacts: report_id, subject, claim_ids, vector, score, word. The vector must give the score, the word must be its band's. A vector with metrics beside the base
    ones has a second score, so that another number than the base score says nothing."""
    rows = impacts.withColumn("computed", base_score(F.col("vector")))
    word = F.when(F.lower("word") == "moderate", "medium").otherwise(F.lower("word"))
    band = severity_band(F.coalesce("score", "computed"))
    key = F.when(F.col("computed").isNull(), "vector_unparseable").when(F.abs(F.col("computed") - F.col("score")) > 0.1 + 1e-9, F.when(F.size(modifiers(F.col("vector"))) > 0, "modified_score_possible").otherwise("score_mismatch")).when(word.isNotNull() & (word != band), "severity_mismatch").otherwise("consistent_impact")
    return evidence(rows, "C17", "impact", key)


def c18_api_usage(behaviors: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """behaviors: report_id, subject (function), claim_ids, object (callee), denied; calls: caller, callee; functions: name, parsed."""
    rows = behaviors.join(calls.select(F.col("caller").alias("subject"), F.col("callee").alias("object")).distinct().withColumn("found", F.lit(True)), ["subject", "object"], "left")
    rows = rows.join(functions.groupBy(F.col("name").alias("subject")).agg(F.bool_and("parsed").alias("parsed")), "subject", "left")
    true_ = F.coalesce("found", F.lit(False)) != F.col("denied")
    key = F.when(F.col("parsed").isNull(), "function_unknown").when(true_, "calls_api").when(~F.col("parsed"), "parse_incomplete").otherwise("does_not_call_api")
    return evidence(rows, "C18", "behavior", key)


#: Frames that must align, and frames from the top among which the named function must be.
LEAST_ALIGNED, LOCUS_DEPTH = 2, 5


def c19_dynamic_repro(runs: DataFrame) -> DataFrame:
    """Does the crash of a run look like the one that is claimed? runs, one row a run that was made elsewhere: report_id, subject, claim_ids, failed (stage
    or null), timed_out, claims_hang, exit_code, in_project, claimed_class, claimed_frames, locus, observed_class, observed_frames (null if nothing was read)."""
    same = same_class(F.col("claimed_class"), F.col("observed_class"))
    stacks = F.size("claimed_frames") > 0
    aligned = anchored_alignment(F.col("claimed_frames"), F.col("observed_frames")) >= LEAST_ALIGNED
    rows = runs.withColumn("aligned", F.when(stacks, aligned).otherwise(F.array_contains(F.slice("observed_frames", 1, LOCUS_DEPTH), F.col("locus"))))
    key = (
        F.when(F.col("failed").isNotNull(), "run_failed")
        .when(F.col("timed_out") & F.col("claims_hang"), "timeout_consistent_with_hang")
        .when(F.col("timed_out") | (F.col("exit_code") == 0), "no_crash")
        .when(F.col("observed_frames").isNull(), "crash_unparsed")
        .when(~F.col("in_project"), "crash_not_in_project")
        .when(~stacks & F.col("claimed_class").isNull() & F.col("locus").isNull(), "crash_uncompared")
        .when(same & F.coalesce("aligned", F.lit(False)), "signature_match")
        .otherwise("different_signature")
    )
    return evidence(rows, "C19", "dynamic", key)


def c21_hygiene(missing: DataFrame) -> DataFrame:
    """One neutral row a report; missing: report_id, missing (array)."""
    return evidence(missing.select("report_id", F.array_join("missing", ",").alias("subject"), F.array().cast("array<string>").alias("claim_ids")), "C21", "hygiene", F.lit("hygiene"))


def run_checks(parts: list[DataFrame]) -> DataFrame:
    """All checks' evidence with ids that follow from its content."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    payload = F.to_json(F.struct("check_id", "outcome_key", "report_id", "subject"))
    number = F.row_number().over(Window.partitionBy("report_id", "check_id", "subject", "outcome_key").orderBy("strength"))
    return rows.withColumn("evidence_id", F.concat(F.substring(F.sha2(payload.cast("binary"), 256), 1, 12), F.when(number > 1, F.concat(F.lit("-"), number)).otherwise(F.lit(""))))
