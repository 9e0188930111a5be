"""Measures of labelled decisions: rates, calibration, separation and ablation. A row is (label, score or probability, verdict)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def rate(hit: Column, total: Column | None = None) -> Column:
    """Share of hits, four places; null over nothing."""
    n = F.count_if(total) if total is not None else F.count("*")
    k = F.count_if(hit & total) if total is not None else F.count_if(hit)
    return F.round(k / F.nullif(n, F.lit(0)), 4)


def confusion(rows: DataFrame, label: str, verdict: str, labels: list, verdicts: list) -> DataFrame:
    """Counts for every label and verdict, zeros included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in verdicts], rows.select(label, verdict).schema)
    return grid.join(rows.groupBy(label, verdict).count(), [label, verdict], "left").select(label, verdict, F.coalesce("count", F.lit(0)).alias("n"))


def nearest_rank(rows: DataFrame, value: str, quantiles: list[float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles for each group."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * q)}") for q in quantiles])


def brier(p: Column, y: Column) -> Column:
    return F.round(F.avg(F.pow(p - y, F.lit(2.0))), 6)


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Per bin of equal width: count, mean prediction and mean outcome; 1 belongs to the last bin."""
    bin_ = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    part = reliability(rows, p, y, bins)
    return part.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"))


def wilson_upper(hits: Column, n: Column, z: float = Z) -> Column:
    """The upper bound of the score interval; null over nothing."""
    p = hits / F.nullif(n, F.lit(0))
    return F.round((p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6)


def youden(rows: DataFrame, label: str, flagged: Column, positive, negative) -> DataFrame:
    """Share flagged among positives less share flagged among negatives."""
    share = lambda v: F.count_if(flagged & (F.col(label) == v)) / F.nullif(F.count_if(F.col(label) == v), F.lit(0))
    return rows.agg(F.round(share(positive) - share(negative), 6).alias("j"))


def threshold_sweep(rows: DataFrame, label: str, score: str, positive, negative) -> DataFrame:
    """For every distinct score as threshold the separation of (score <= threshold); scores are few, rows may be many.

    Rows are counted by score before the running sums, so that the one ordered window runs over distinct scores."""
    counts = rows.groupBy(score).agg(F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) == negative).alias("neg"))
    up_to = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    return counts.select(score, F.round(F.sum("pos").over(up_to) / F.nullif(F.sum("pos").over(all_), F.lit(0)) - F.sum("neg").over(up_to) / F.nullif(F.sum("neg").over(all_), F.lit(0)), 6).alias("j"))


def best_threshold(rows: DataFrame, label: str, score: str, positive, negative) -> DataFrame:
    """The best separation, at least 0, and the smallest threshold that gives it."""
    sweep = threshold_sweep(rows, label, score, positive, negative)
    return sweep.agg(F.greatest(F.max("j"), F.lit(0.0)).alias("best_j"), F.max_by(score, F.struct("j", -F.col(score))).alias("threshold"))


def ablation_summary(ablated: DataFrame, truth: DataFrame) -> DataFrame:
    """Per dropped check: reports whose label changed, became wrong, became right. truth: report_id, expected."""
    rows = ablated.join(truth, "report_id")
    was, now = F.col("label") == F.col("expected"), F.col("without") == F.col("expected")
    return rows.groupBy("dropped").agg(F.count("*").alias("reports"), F.count_if(F.col("label") != F.col("without")).alias("changed"), F.count_if(was & ~now).alias("became_wrong"), F.count_if(~was & now).alias("became_right"))


def features(evidence: DataFrame, outcomes: list[str]) -> DataFrame:
    """Per report how often each outcome came, as columns."""
    return evidence.groupBy("report_id").agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in outcomes])


def outcome_features(evidence: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Per report how often each check gave each outcome: report_id and a map of check.outcome to its count, zeros left out; or with the known names, one column for each, zeros too."""
    name = F.concat_ws(".", "check_id", "outcome")
    if known is not None:
        return evidence.groupBy("report_id").agg(*[F.count_if(name == k).alias(k.replace(".", "_").lower()) for k in known])
    counts = evidence.groupBy("report_id", name.alias("feature")).agg(F.count("*").alias("n"))
    return counts.groupBy("report_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "n")))).alias("features"))


def distributions(rows: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """Of each group how often every verdict came, and its share."""
    return rows.groupBy(*by, verdict).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 4))


def drawn(key: Column, trial: Column | None = None) -> Column:
    """A number in [0, 1) that a key and a trial fix: the same on every run and however rows are dealt."""
    text = F.concat_ws(":", *([trial.cast("string")] if trial is not None else []), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_control(rows: DataFrame, key: str, label: str, positive, negative, trials: int = 21) -> DataFrame:
    """The median over trials of the best separation that drawn scores reach: what a threshold picked after the fact is worth.

    Scores are drawn to a thousandth, so that running sums are over few thresholds."""
    scores = rows.select(label, F.col(key).alias("_key"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).withColumn("score", F.floor(drawn(F.col("_key"), F.col("trial")) * 1000))
    counts = scores.groupBy("trial", "score").agg(F.count_if(F.col(label) == positive).alias("pos"), F.count_if(F.col(label) == negative).alias("neg"))
    up_to = Window.partitionBy("trial").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("trial")
    j = F.sum("pos").over(up_to) / F.nullif(F.sum("pos").over(all_), F.lit(0)) - F.sum("neg").over(up_to) / F.nullif(F.sum("neg").over(all_), F.lit(0))
    best = counts.select("trial", j.alias("j")).groupBy("trial").agg(F.greatest(F.max("j"), F.lit(0.0)).alias("j"))
    return best.agg(F.round(F.median("j"), 4).alias("control"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows picked by the digest of seed and key: the same ones on every run."""
    return rows.orderBy(drawn(F.col(key), F.lit(seed)), key).limit(n)
