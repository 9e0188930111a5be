"""Queries of evidence, ledgers, verdicts and measures over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import fusion, metrics
from plumbline.sources.tables import table

KEYS = ["never_in_history", "defined", "other_release_fits", "absent_everywhere", "resolves", "contained", "nowhere_in_history", "in_bounds"]
CLAIM_KINDS = ["symbol", "file", "trace", "version"]


def evidence(spark, sf_dir: str) -> DataFrame:
    """Events as evidence: the user is the report, the type the group, the strength follows from the id."""
    i = F.col("event_id")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (i % n).cast("int"))
    strength = (F.pmod(i * 7, F.lit(13)) - 6) * F.lit(0.5)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("report_id"),
        i.alias("evidence_id"),
        F.concat(F.lit("C"), F.lpad((i % 21 + 1).cast("string"), 2, "0")).alias("check_id"),
        F.col("event_type").alias("grp"),
        F.when(strength > 0, "SUPPORTS").when(strength < 0, "REFUTES").otherwise("NEUTRAL").alias("outcome"),
        strength.alias("strength"),
        pick(KEYS, len(KEYS)).alias("outcome_key"),
        (i % 5).alias("claim_id"),
        (i % 11 != 0).alias("attributed"),
        (i % 17 == 0).alias("negated"),
        pick(CLAIM_KINDS, len(CLAIM_KINDS)).alias("claim_kind"),
        F.when(i % 19 == 0, "llm").otherwise("check").alias("produced_by"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


EVIDENCE = f"""raw AS (SELECT user_id AS report_id, event_id AS evidence_id, 'C' || lpad((event_id % 21 + 1)::VARCHAR, 2, '0') AS check_id, event_type AS grp,
 ((event_id * 7) % 13 - 6) * 0.5::DOUBLE AS strength, {_list(KEYS)}[event_id % {len(KEYS)} + 1] AS outcome_key, event_id % 5 AS claim_id,
 event_id % 11 <> 0 AS attributed, event_id % 17 = 0 AS negated, {_list(CLAIM_KINDS)}[event_id % {len(CLAIM_KINDS)} + 1] AS claim_kind,
 CASE WHEN event_id % 19 = 0 THEN 'llm' ELSE 'check' END AS produced_by FROM events),
rawo AS (SELECT *, CASE WHEN strength > 0 THEN 'SUPPORTS' WHEN strength < 0 THEN 'REFUTES' ELSE 'NEUTRAL' END AS outcome0 FROM raw),
ev AS (SELECT report_id, evidence_id, check_id, grp, outcome_key, claim_id, claim_kind, produced_by,
 CASE WHEN outcome0 = 'REFUTES' AND (negated OR NOT attributed) THEN 'NEUTRAL' ELSE outcome0 END AS outcome,
 CASE WHEN outcome0 = 'REFUTES' AND (negated OR NOT attributed) THEN 0.0 ELSE strength END AS strength,
 CASE WHEN outcome0 = 'REFUTES' AND (negated OR NOT attributed) THEN strength END AS withheld_strength,
 CASE WHEN outcome0 = 'REFUTES' AND (negated OR NOT attributed) THEN CASE WHEN negated THEN 'negated' ELSE 'provenance' END END AS gate FROM rawo)"""


def ledger_sql(source: str = "ev", key: str = "report_id") -> str:
    return f"""SELECT *, round_even(strength * pow(0.5, rank), 6) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY {key}, grp ORDER BY abs(strength) DESC, evidence_id) - 1 AS rank
 FROM {source} WHERE strength <> 0 AND outcome IN ('SUPPORTS', 'REFUTES'))"""


def _in(pairs: list[tuple[str, str]]) -> str:
    return "(check_id || ':' || outcome_key) IN (" + ", ".join(f"'{a}:{b}'" for a, b in pairs) + ")"


def verdict_sql(source: str = "ev", key: str = "report_id") -> str:
    sound = "produced_by <> 'llm'"
    return f"""SELECT {key}, CASE rule WHEN '1' THEN 'REPRODUCED' WHEN '2' THEN 'INSUFFICIENT' WHEN '3a' THEN 'UNGROUNDED' WHEN '3b' THEN 'UNGROUNDED' WHEN '5' THEN 'GROUNDED' WHEN '6a' THEN 'INSUFFICIENT' ELSE 'MIXED' END AS label,
 rule, score, confidence, rule = '4' AS capped FROM (SELECT f.*, coalesce(s.score, 50) AS score, CASE WHEN reproduced THEN 'high' ELSE coalesce(s.confidence, 'low') END AS confidence,
 CASE WHEN reproduced THEN '1' WHEN claims < 2 AND NOT checkable THEN '2' WHEN coalesce(s.score, 50) < 15 AND never_existed AND refuting_groups >= 2 THEN '3a'
 WHEN coalesce(s.score, 50) < 10 AND strong_refuting_groups >= 3 THEN '3b' WHEN mismatch THEN '4' WHEN coalesce(s.score, 50) >= 75 AND weakest > -1.2 THEN '5'
 WHEN coalesce(weight, 0) < 1.5 THEN '6a' ELSE '6b' END AS rule
 FROM (SELECT {key}, coalesce(bool_or(check_id = 'C19' AND outcome = 'SUPPORTS' AND outcome_key = 'signature_match' AND {sound}), false) AS reproduced,
  count(DISTINCT CASE WHEN outcome <> 'ERROR' THEN claim_id END) AS claims, coalesce(bool_or(claim_kind IN ('trace', 'snippet', 'patch', 'poc')), false) AS checkable,
  coalesce(bool_or(outcome = 'REFUTES' AND {sound} AND {_in(fusion.NEVER_EXISTED)} AND strength <= -2.0), false) AS never_existed,
  count(DISTINCT CASE WHEN outcome = 'REFUTES' AND {sound} THEN grp END) AS refuting_groups,
  count(DISTINCT CASE WHEN outcome = 'REFUTES' AND {sound} AND strength <= -1.5 THEN grp END) AS strong_refuting_groups,
  coalesce(bool_or(outcome <> 'ERROR' AND {_in(fusion.VERSION_MISMATCH)}), false) AS mismatch,
  coalesce(min(CASE WHEN {sound} THEN strength END), 0.0) AS weakest FROM {source} GROUP BY {key}) f
 LEFT JOIN ({scores_sql(source, key)}) s USING ({key}))"""


def scores_sql(source: str = "ev", key: str = "report_id") -> str:
    return f"""SELECT {key}, log_odds, groups, weight, round_even(100 / (1 + exp(-log_odds)), 0)::INTEGER AS score,
 CASE WHEN abs(log_odds) >= 4 AND groups >= 3 THEN 'high' WHEN abs(log_odds) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM (
 SELECT {key}, round_even(sum(contribution), 6) AS log_odds, count(DISTINCT CASE WHEN contribution <> 0 THEN grp END) AS groups, sum(abs(strength)) AS weight FROM ({ledger_sql(source, key)}) GROUP BY {key})"""


def refutation_gate(spark, sf_dir):
    return fusion.gated(evidence(spark, sf_dir)).select("evidence_id", "outcome", "strength", "withheld_strength", "gate")


def ledger_damped(spark, sf_dir):
    return fusion.ledger(fusion.gated(evidence(spark, sf_dir))).select("report_id", "grp", "evidence_id", "rank", "contribution")


def ledger_running(spark, sf_dir):
    rows = fusion.running(fusion.ledger(fusion.gated(evidence(spark, sf_dir))))
    return rows.select("report_id", "grp", "rank", "total")


def report_scores(spark, sf_dir):
    return fusion.scores(fusion.ledger(fusion.gated(evidence(spark, sf_dir))))


def verdict_ladder(spark, sf_dir):
    return fusion.verdicts(fusion.gated(evidence(spark, sf_dir)))


def key_evidence(spark, sf_dir):
    return fusion.key_evidence(fusion.gated(evidence(spark, sf_dir))).select("report_id", "place", "evidence_id", "strength")


def drop_one_ablation(spark, sf_dir):
    return fusion.ablated(fusion.gated(evidence(spark, sf_dir)))


TRUTH = "CASE WHEN report_id % 3 = 0 THEN 'UNGROUNDED' WHEN report_id % 3 = 1 THEN 'MIXED' ELSE 'GROUNDED' END"


def ablation_summary(spark, sf_dir):
    rows = fusion.ablated(fusion.gated(evidence(spark, sf_dir)))
    truth = rows.select("report_id").distinct().withColumn("expected", F.expr(TRUTH))
    return metrics.ablation_summary(rows, truth)


ABLATED = f"""{EVIDENCE}, present AS (SELECT DISTINCT report_id AS r, check_id AS dropped FROM ev),
rest AS (SELECT ev.*, dropped, report_id::VARCHAR || '|' || dropped AS k FROM ev JOIN present ON report_id = r AND check_id <> dropped),
wo AS ({verdict_sql("rest", "k")}), ab AS (SELECT r AS report_id, dropped, coalesce(wo.label, 'INSUFFICIENT') AS without, v.label AS label
 FROM present LEFT JOIN wo ON wo.k = r::VARCHAR || '|' || dropped JOIN ({verdict_sql()}) v ON v.report_id = r)"""

TEMPLATES = [(f"C{c:02d}", k, f"{k} by C{c:02d}: what about claim {{claim}}?") for c in range(1, 22) for k in KEYS if (c + len(k)) % 3]


def question_topk(spark, sf_dir):
    templates = spark.createDataFrame(TEMPLATES, "check_id string, outcome_key string, template string")
    return fusion.questions(fusion.gated(evidence(spark, sf_dir)), templates)


def feature_matrix(spark, sf_dir):
    return metrics.features(fusion.gated(evidence(spark, sf_dir)), ["SUPPORTS", "REFUTES", "NEUTRAL"])


# measures: labelled documents with a score that follows from the id


def cases(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    score = F.pmod(F.col("doc_id") * 37, F.lit(101)).cast("int")
    verdict = F.when(score < 15, "UNGROUNDED").when(score < 50, "INSUFFICIENT").when(score < 75, "MIXED").otherwise("GROUNDED")
    return rows.select("doc_id", "quality", "toxic", "lang", "n_chars", score.alias("score"), (score / 100.0).alias("p"), verdict.alias("verdict"))


CASES = """c AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.n_chars, ((l.doc_id * 37) % 101)::INTEGER AS score, ((l.doc_id * 37) % 101) / 100.0::DOUBLE AS p,
 CASE WHEN (l.doc_id * 37) % 101 < 15 THEN 'UNGROUNDED' WHEN (l.doc_id * 37) % 101 < 50 THEN 'INSUFFICIENT' WHEN (l.doc_id * 37) % 101 < 75 THEN 'MIXED' ELSE 'GROUNDED' END AS verdict
 FROM labels l JOIN documents d USING (doc_id))"""
VERDICTS = ["REPRODUCED", "GROUNDED", "MIXED", "INSUFFICIENT", "UNGROUNDED"]


def confusion_grid(spark, sf_dir):
    return metrics.confusion(cases(spark, sf_dir), "quality", "verdict", [0, 1], VERDICTS)


def rate_null_safe(spark, sf_dir):
    return cases(spark, sf_dir).groupBy("lang").agg(metrics.rate(F.col("verdict") == "GROUNDED").alias("grounded"), metrics.rate(F.col("verdict") == "UNGROUNDED", (F.col("toxic") == 1) & (F.col("score") < 3)).alias("recall"))


def percentile_nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(cases(spark, sf_dir), "n_chars", [0.5, 0.9, 0.95], ["lang"])


def brier(spark, sf_dir):
    return cases(spark, sf_dir).agg(metrics.brier(F.col("p"), F.col("quality")).alias("brier"))


def reliability_bins(spark, sf_dir):
    part = metrics.reliability(cases(spark, sf_dir), "p", "quality")
    return part.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def ece10(spark, sf_dir):
    return metrics.calibration_error(cases(spark, sf_dir), "p", "quality")


def wilson_upper(spark, sf_dir):
    return cases(spark, sf_dir).groupBy("lang").agg(metrics.wilson_upper(F.count_if(F.col("verdict") == "UNGROUNDED"), F.count("*")).alias("upper"))


def youden_j(spark, sf_dir):
    return metrics.youden(cases(spark, sf_dir), "quality", F.col("score") < 30, 0, 1)


def j_sweep(spark, sf_dir):
    return metrics.threshold_sweep(cases(spark, sf_dir), "quality", "score", 0, 1)


def best_j_sweep(spark, sf_dir):
    return metrics.best_threshold(cases(spark, sf_dir), "quality", "score", 0, 1)


def flag_rate(spark, sf_dir):
    rows = fusion.gated(evidence(spark, sf_dir)).groupBy("report_id").agg(F.bool_or((F.col("outcome") == "REFUTES") & (F.col("strength") <= -2.5)).alias("flagged"))
    return rows.agg(metrics.rate(F.col("flagged")).alias("flag_rate"), F.count("*").alias("reports"))


def explain_view(spark, sf_dir):
    from plumbline.operators import render

    return render.explain_lines(fusion.running(fusion.ledger(fusion.gated(evidence(spark, sf_dir)))))


def markdown_view(spark, sf_dir):
    from plumbline.operators import render

    rows = fusion.gated(evidence(spark, sf_dir))
    return render.markdown(fusion.verdicts(rows), fusion.key_evidence(rows))


def calibrated_error(spark, sf_dir):
    """Users' outcome counts as features; the label follows from the user."""
    from plumbline.operators import calibration

    rows = feature_matrix(spark, sf_dir).withColumn("label", ((F.col("n_supports") * 3 + F.col("report_id") % 5) % 2).cast("int"))
    found = calibration.calibrated(rows, "report_id", ["n_supports", "n_refutes", "n_neutral"], "label", least=2)
    return metrics.calibration_error(found, "p", "label")


_SWEEP = f"WITH {CASES}, s AS (SELECT score, count(*) FILTER (quality = 0) AS pos, count(*) FILTER (quality = 1) AS neg FROM c GROUP BY score), w AS (SELECT score, round(sum(pos) OVER (ORDER BY score) / nullif(sum(pos) OVER (), 0) - sum(neg) OVER (ORDER BY score) / nullif(sum(neg) OVER (), 0), 6) AS j FROM s)"

QUERIES = {f.__name__: f for f in (verdict_ladder, refutation_gate, ledger_damped, ledger_running, report_scores, key_evidence, drop_one_ablation, ablation_summary, question_topk, feature_matrix, confusion_grid, rate_null_safe, percentile_nearest_rank, brier, reliability_bins, ece10, wilson_upper, youden_j, j_sweep, best_j_sweep, flag_rate, explain_view, markdown_view, calibrated_error)}

_KEY = "SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY abs(strength) DESC, evidence_id) AS place FROM ev WHERE strength <> 0 AND outcome IN ('SUPPORTS', 'REFUTES')"

ORACLE_SQL = {
    "explain_view": f"WITH {EVIDENCE} SELECT report_id, grp, rank::INTEGER AS rank, printf('%-4s %-32s %+.2f x 0.5^%d = %+.6f -> %+.6f', check_id, outcome_key, strength, rank, contribution + 0.0, (sum(contribution::DECIMAL(18, 6)) OVER (PARTITION BY report_id ORDER BY grp, rank ROWS UNBOUNDED PRECEDING))::DOUBLE) AS line FROM ({ledger_sql()})",
    "markdown_view": f"WITH {EVIDENCE}, k AS ({_KEY}), l AS (SELECT report_id, string_agg('- ' || check_id || ': ' || replace(outcome_key, '_', chr(92) || '_') || printf(' (%+.2f)', strength), chr(10) ORDER BY place) AS items FROM k WHERE place <= 5 GROUP BY 1) SELECT report_id, printf('**%s** (score %d, %s confidence, rule %s)', label, score, confidence, rule) || chr(10) || items AS markdown FROM ({verdict_sql()}) JOIN l USING (report_id)",
    "refutation_gate": f"WITH {EVIDENCE} SELECT evidence_id, outcome, strength, withheld_strength, gate FROM ev",
    "ledger_damped": f"WITH {EVIDENCE} SELECT report_id, grp, evidence_id, rank::INTEGER AS rank, contribution FROM ({ledger_sql()})",
    "ledger_running": f"WITH {EVIDENCE} SELECT report_id, grp, rank::INTEGER AS rank, (sum(contribution::DECIMAL(18, 6)) OVER (PARTITION BY report_id ORDER BY grp, rank ROWS UNBOUNDED PRECEDING))::DOUBLE AS total FROM ({ledger_sql()})",
    "report_scores": f"WITH {EVIDENCE} {scores_sql()}",
    "verdict_ladder": f"WITH {EVIDENCE} {verdict_sql()}",
    "key_evidence": f"WITH {EVIDENCE} SELECT report_id, place::INTEGER AS place, evidence_id, strength FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY abs(strength) DESC, evidence_id) AS place FROM ev WHERE strength <> 0 AND outcome IN ('SUPPORTS', 'REFUTES')) WHERE place <= 5",
    "drop_one_ablation": f"WITH {ABLATED} SELECT * FROM ab",
    "ablation_summary": f"WITH {ABLATED}, t AS (SELECT *, {TRUTH} AS expected FROM ab) SELECT dropped, count(*) AS reports, count(*) FILTER (label <> without) AS changed, count(*) FILTER (label = expected AND without <> expected) AS became_wrong, count(*) FILTER (label <> expected AND without = expected) AS became_right FROM t GROUP BY dropped",
    "question_topk": f"""WITH {EVIDENCE}, tpl(check_id, outcome_key, template) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in TEMPLATES)}),
 q AS (SELECT ev.*, replace(template, '{{claim}}', claim_id::VARCHAR) AS question FROM ev JOIN tpl USING (check_id, outcome_key) WHERE outcome = 'REFUTES'),
 o AS (SELECT *, row_number() OVER (PARTITION BY report_id, question ORDER BY abs(strength) DESC, evidence_id) AS n FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY abs(strength) DESC, evidence_id) AS place FROM o WHERE n = 1)
 SELECT report_id, place::INTEGER AS place, question FROM r WHERE place <= 6""",
    "feature_matrix": f"WITH {EVIDENCE} SELECT report_id, count(*) FILTER (outcome = 'SUPPORTS') AS n_supports, count(*) FILTER (outcome = 'REFUTES') AS n_refutes, count(*) FILTER (outcome = 'NEUTRAL') AS n_neutral FROM ev GROUP BY report_id",
    "confusion_grid": f"WITH {CASES}, g AS (SELECT q AS quality, v AS verdict FROM (VALUES (0), (1)) a(q), (VALUES {', '.join(f'({chr(39)}{v}{chr(39)})' for v in VERDICTS)}) b(v)) SELECT g.quality, g.verdict, count(c.doc_id) AS n FROM g LEFT JOIN c ON c.quality = g.quality AND c.verdict = g.verdict GROUP BY g.quality, g.verdict",
    "rate_null_safe": f"WITH {CASES} SELECT lang, round(count(*) FILTER (verdict = 'GROUNDED') / count(*), 4) AS grounded, round(count(*) FILTER (verdict = 'UNGROUNDED' AND toxic = 1 AND score < 3) / nullif(count(*) FILTER (toxic = 1 AND score < 3), 0), 4) AS recall FROM c GROUP BY lang",
    "percentile_nearest_rank": f"WITH {CASES} SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95 FROM c GROUP BY lang",
    "brier": f"WITH {CASES} SELECT round(avg(pow(p - quality, 2)), 6) AS brier FROM c",
    "reliability_bins": f"WITH {CASES} SELECT least(floor(p * 10)::INTEGER, 9) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(quality), 6) AS mean_y FROM c GROUP BY 1",
    "ece10": f"WITH {CASES}, b AS (SELECT least(floor(p * 10)::INTEGER, 9) AS bin, count(*) AS n, avg(p) AS mp, avg(quality) AS my FROM c GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b",
    "wilson_upper": f"WITH {CASES}, r AS (SELECT lang, count(*) AS n, count(*) FILTER (verdict = 'UNGROUNDED') / count(*)::DOUBLE AS p FROM c GROUP BY lang) SELECT lang, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS upper FROM r",
    "youden_j": f"WITH {CASES} SELECT round(count(*) FILTER (score < 30 AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0) - count(*) FILTER (score < 30 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 6) AS j FROM c",
    "j_sweep": f"{_SWEEP} SELECT score, j FROM w",
    "best_j_sweep": f"{_SWEEP} SELECT greatest(max(j), 0.0) AS best_j, arg_max(score, [j, -score]) AS threshold FROM w",
    "flag_rate": f"WITH {EVIDENCE}, f AS (SELECT report_id, bool_or(outcome = 'REFUTES' AND strength <= -2.5) AS flagged FROM ev GROUP BY report_id) SELECT round(count(*) FILTER (flagged) / count(*), 4) AS flag_rate, count(*) AS reports FROM f",
}
