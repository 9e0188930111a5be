"""Calibration of outcome counts into probabilities by logistic regression, cross-validated by hash folds."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folds, rows of each class that are asked for, and the weight of the penalty.
FOLDS, LEAST, PENALTY = 5, 50, 1.0


def calibrated(rows: DataFrame, key: str, features: list[str], label: str, folds: int = FOLDS, least: int = LEAST) -> DataFrame | None:
    """key, label and p: each row's probability from a model that was fitted without its fold; None if a class has too few rows."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if any(counts.get(v, 0) < least for v in (0, 1)):
        return None
    n = sum(counts.values())
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds))))
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=PENALTY / n, standardization=False)
    whole = None
    for fold in range(folds):
        part = model.fit(data.where(F.col("fold") != fold)).transform(data.where(F.col("fold") == fold))
        part = part.select(key, label, vector_to_array("probability")[1].alias("p"))
        whole = part if whole is None else whole.unionByName(part)
    return whole
