"""From evidence to verdicts: the refutation gate, the damped ledger, scores, labels and questions.

evidence: report_id, evidence_id, check_id, grp (what a row's weight is shared with), outcome, strength, outcome_key, claim_id, attributed, negated.
Every step is a window or a group over report_id; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import sigmoid

#: Outcomes of which a report is never cleared, and those that speak of another version.
NEVER_EXISTED = [("C02", "never_in_history"), ("C03", "never_in_history_core"), ("C03", "never_in_history_supporting"), ("C06", "nowhere_in_history"), ("C07", "absent_everywhere"), ("C14", "never_in_history")]
VERSION_MISMATCH = [("C10", "other_release_fits"), ("C12", "already_applied"), ("C12", "other_release_only"), ("C02", "missing_here_present_elsewhere"), ("C03", "absent_here_present_elsewhere")]


def _among(pairs: list[tuple[str, str]]) -> Column:
    return F.concat_ws(":", "check_id", "outcome_key").isin([":".join(p) for p in pairs])


def gated(evidence: DataFrame) -> DataFrame:
    """A refutation counts only if the cited claim is the project's and not negated; else it is neutral, and what it had is kept."""
    closed = (F.col("outcome") == "REFUTES") & (F.coalesce("negated", F.lit(False)) | ~F.coalesce("attributed", F.lit(True)))
    return (
        evidence.withColumn("withheld_strength", F.when(closed, F.col("strength")))
        .withColumn("gate", F.when(closed, F.when(F.col("negated"), "negated").otherwise("provenance")))
        .withColumn("strength", F.when(closed | (F.col("outcome") == "NEUTRAL"), F.lit(0.0)).otherwise(F.col("strength")))
        .withColumn("outcome", F.when(closed, "NEUTRAL").otherwise(F.col("outcome")))
    )


def scoring(evidence: DataFrame) -> DataFrame:
    return evidence.where((F.col("strength") != 0) & F.col("outcome").isin("SUPPORTS", "REFUTES"))


def ledger(evidence: DataFrame) -> DataFrame:
    """Scoring rows with their rank within (report, group), by strength, and their damped contribution."""
    by = Window.partitionBy("report_id", "grp").orderBy(F.desc(F.abs("strength")), "evidence_id")
    ranked = scoring(evidence).withColumn("rank", F.row_number().over(by) - 1)
    return ranked.withColumn("contribution", F.bround(F.col("strength") * F.pow(F.lit(0.5), F.col("rank")), 6))


def running(entries: DataFrame) -> DataFrame:
    """The ledger with the log-odds so far, in the order of group and rank."""
    return entries.withColumn("total", F.sum(F.col("contribution").cast("decimal(18,6)")).over(Window.partitionBy("report_id").orderBy("grp", "rank").rowsBetween(Window.unboundedPreceding, 0)).cast("double"))


def scores(entries: DataFrame, prior: float = 0.0) -> DataFrame:
    """Per report the log-odds, the score from 0 to 100, and how many groups and how much strength speak."""
    return (
        entries.groupBy("report_id")
        .agg(F.bround(F.sum("contribution") + prior, 6).alias("log_odds"), F.count_distinct(F.when(F.col("contribution") != 0, F.col("grp"))).alias("groups"), F.sum(F.abs("strength")).alias("weight"))
        .withColumn("score", F.bround(100 * sigmoid(F.col("log_odds")), 0).cast("int"))
        .withColumn("confidence", confidence(F.col("log_odds"), F.col("groups")))
    )


def confidence(log_odds: Column, groups: Column) -> Column:
    return F.when((F.abs(log_odds) >= 4) & (groups >= 3), "high").when(F.abs(log_odds) >= 2, "medium").otherwise("low")


def facts(evidence: DataFrame) -> DataFrame:
    """Per report what the ladder asks for besides the score."""
    sound = F.coalesce(F.col("produced_by"), F.lit("check")) != "llm" if "produced_by" in evidence.columns else F.lit(True)
    refutes = (F.col("outcome") == "REFUTES") & sound
    checkable = F.col("claim_kind").isin("trace", "snippet", "patch", "poc") if "claim_kind" in evidence.columns else F.lit(False)
    return evidence.groupBy("report_id").agg(
        F.coalesce(F.bool_or((F.col("check_id") == "C19") & (F.col("outcome") == "SUPPORTS") & (F.col("outcome_key") == "signature_match") & sound), F.lit(False)).alias("reproduced"),
        F.count_distinct(F.when(F.col("outcome") != "ERROR", F.col("claim_id"))).alias("claims"),
        F.coalesce(F.bool_or(checkable), F.lit(False)).alias("checkable"),
        F.coalesce(F.bool_or(refutes & _among(NEVER_EXISTED) & (F.col("strength") <= -2.0)), F.lit(False)).alias("never_existed"),
        F.count_distinct(F.when(refutes, F.col("grp"))).alias("refuting_groups"),
        F.count_distinct(F.when(refutes & (F.col("strength") <= -1.5), F.col("grp"))).alias("strong_refuting_groups"),
        F.coalesce(F.bool_or((F.col("outcome") != "ERROR") & _among(VERSION_MISMATCH)), F.lit(False)).alias("mismatch"),
        F.coalesce(F.min(F.when(sound, F.col("strength"))), F.lit(0.0)).alias("weakest"),
    )


def verdicts(evidence: DataFrame, prior: float = 0.0) -> DataFrame:
    """Per report the label, the rule that gave it, score and confidence; the first rule that holds decides."""
    rows = facts(evidence).join(scores(ledger(evidence), prior), "report_id", "left")
    score, weight = F.coalesce("score", F.lit(50)), F.coalesce("weight", F.lit(0.0))
    rules = [
        ("1", "REPRODUCED", F.col("reproduced")),
        ("2", "INSUFFICIENT", (F.col("claims") < 2) & ~F.col("checkable")),
        ("3a", "UNGROUNDED", (score < 15) & F.col("never_existed") & (F.col("refuting_groups") >= 2)),
        ("3b", "UNGROUNDED", (score < 10) & (F.col("strong_refuting_groups") >= 3)),
        ("4", "MIXED", F.col("mismatch")),
        ("5", "GROUNDED", (score >= 75) & (F.col("weakest") > -1.2)),
        ("6a", "INSUFFICIENT", weight < 1.5),
    ]
    rule, label = F.lit("6b"), F.lit("MIXED")
    for name, word, holds in reversed(rules):
        rule, label = F.when(holds, name).otherwise(rule), F.when(holds, word).otherwise(label)
    sure = F.when(F.col("reproduced"), "high").otherwise(F.coalesce("confidence", F.lit("low")))
    return rows.select("report_id", label.alias("label"), rule.alias("rule"), score.alias("score"), sure.alias("confidence"), (rule == "4").alias("capped"))


def key_evidence(evidence: DataFrame, most: int = 5) -> DataFrame:
    """The strongest scoring rows of each report."""
    by = Window.partitionBy("report_id").orderBy(F.desc(F.abs("strength")), "evidence_id")
    return scoring(evidence).withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def ablated(evidence: DataFrame) -> DataFrame:
    """Per report and check: the label without that check's rows, beside the label with them."""
    narrow = evidence.select(*[c for c in ("report_id", "evidence_id", "check_id", "grp", "outcome", "strength", "outcome_key", "claim_id", "claim_kind", "produced_by") if c in evidence.columns])
    present = narrow.select(F.col("report_id").alias("r"), F.col("check_id").alias("dropped")).distinct()
    # every report's rows once for each other check of that report: an equality join on the report, never across reports
    rest = narrow.join(present, (F.col("report_id") == F.col("r")) & (F.col("check_id") != F.col("dropped")))
    key = F.struct("report_id", "dropped")
    without = verdicts(rest.withColumn("report_id", key)).select(F.col("report_id.report_id").alias("report_id"), F.col("report_id.dropped").alias("dropped"), F.col("label").alias("without"))
    pairs = present.select(F.col("r").alias("report_id"), "dropped")
    return pairs.join(without, ["report_id", "dropped"], "left").withColumn("without", F.coalesce("without", F.lit("INSUFFICIENT"))).join(verdicts(evidence).select("report_id", "label"), "report_id")


def questions(evidence: DataFrame, templates: DataFrame, most: int = 6) -> DataFrame:
    """At most `most` questions a report, for its strongest refutations; one question for each text."""
    asked = evidence.where(F.col("outcome") == "REFUTES").join(F.broadcast(templates), ["check_id", "outcome_key"])
    text = F.replace(F.col("template"), F.lit("{claim}"), F.col("claim_id").cast("string"))
    first = Window.partitionBy("report_id", "question").orderBy(F.desc(F.abs("strength")), "evidence_id")
    one = asked.withColumn("question", text).withColumn("n", F.row_number().over(first)).where("n = 1")
    by = Window.partitionBy("report_id").orderBy(F.desc(F.abs("strength")), "evidence_id")
    return one.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("report_id", "place", "question")


#: The order in which findings are listed.
OUTCOMES = ("REFUTES", "NEUTRAL", "ERROR", "SUPPORTS")


def lint_rows(evidence: DataFrame) -> DataFrame:
    """Per claim of a report the finding to show: its strongest refutation, else its strongest finding; ties by id. place: refutations first.

    evidence: report_id, claim_id, evidence_id, outcome, strength."""
    against = (F.col("outcome") == "REFUTES") & (F.col("strength") < 0)
    shown = F.struct("evidence_id", "check_id", "outcome", "strength")
    best = evidence.groupBy("report_id", "claim_id").agg(F.min_by(shown, F.struct((~against).cast("int"), -F.abs("strength"), "evidence_id")).alias("e"), F.count_if(against).alias("refutations"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("e.outcome")), F.lit(0)), F.lit(9))
    by = Window.partitionBy("report_id").orderBy(rank, "e.evidence_id")
    return best.withColumn("place", F.row_number().over(by)).select("report_id", "claim_id", "e.*", "refutations", "place")
