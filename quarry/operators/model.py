"""Train/test split, logistic regression and ROC AUC with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window, functions as F

from quarry.session import scratch_path


def hash_split(df: DataFrame, key: str, train_percent: int = 70, seed: int = 42,
               flag: str = "is_train") -> DataFrame:
    """Deterministic split by the MD5 of ``seed:key`` (its first 32 bits modulo 100): the
    same row lands on the same side whatever the partitioning, the executor or the engine
    that computes it (a seeded ``randomSplit`` depends on the partition layout). Rows
    with a null key share one side."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.withColumn(flag, bucket < F.lit(train_percent))


def random_split(df: DataFrame, weights=(0.7, 0.3), seed: int = 42):
    return df.randomSplit(list(weights), seed)


def fit_logistic(train: DataFrame, feature_cols: list[str], label: str,
                 features: str = "features", tol: float = 1e-6):
    """Pipeline of a vector assembler and a default logistic regression."""
    asm = VectorAssembler(inputCols=feature_cols, outputCol=features)
    lr = LogisticRegression(featuresCol=features, labelCol=label, tol=tol)
    return Pipeline(stages=[asm, lr]).fit(train)


def log_loss(scored: DataFrame, features: list[str], label: str, coefficients: list[float], intercept: float) -> DataFrame:
    """``n, log_loss, gradient_norm`` of a logistic model's coefficients over rows, in one
    aggregation: a certificate that a fit has converged (at the maximum of the likelihood
    the gradient is 0)."""
    margin = sum((F.col(c).cast("double") * b for c, b in zip(features, coefficients)), F.lit(float(intercept)))
    y = F.col(label).cast("double")
    # log(1 + e^m) without overflow
    loss = F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - y * margin
    off = 1 / (1 + F.exp(-margin)) - y
    parts = [F.avg(off)] + [F.avg(off * F.col(c)) for c in features]
    norm = F.sqrt(sum((x * x for x in parts), F.lit(0.0)))
    return scored.agg(F.count(y).alias("n"), F.avg(loss).alias("log_loss"), norm.alias("gradient_norm"))


def rank_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """``n_positive, n_negative, auc`` (one row) by the rank-sum statistic with mid-ranks for ties:
    the share of (positive, negative) pairs in which the positive has the higher score,
    ties counted half.

    Scores are counted per distinct value, dealt by ranges and written once; a range's
    negatives below come from one total per range. No curve reaches the driver and scores are
    not binned. Rows without label or score (null or NaN) do not count; with one class
    only the area is null."""
    y, x = F.col(label).cast("double"), F.col(score).cast("double")
    rows = scored.select(y.alias("y"), (x + F.lit(0.0)).alias("x")).filter("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    one = F.count(F.when(F.col("y") > 0, 1)), F.count(F.when(F.col("y") <= 0, 1))
    counts = rows.groupBy("x").agg(one[0].alias("pos"), one[1].alias("neg"))
    path = scratch_path(scored.sparkSession, "auc-counts")
    dealt = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = scored.sparkSession.read.schema(dealt.schema).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = dealt.groupBy("part").agg(F.sum("neg").alias("neg")).select(
        "part", F.coalesce(F.sum("neg").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    below = dealt.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(ranges, "part")
    won = F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return below.agg(F.coalesce(pos, F.lit(0)).alias("n_positive"), F.coalesce(neg, F.lit(0)).alias("n_negative"),
                     F.when((pos > 0) & (neg > 0), won / (pos.cast("double") * neg)).alias("auc"))


def roc_auc(scored: DataFrame, label: str, score_col: str = "rawPrediction") -> float | None:
    """Area under the ROC curve (:func:`rank_auc`). ``score_col='prediction'`` scores the hard
    0/1 prediction, as the reference did; ``rawPrediction`` ranks by margin."""
    if isinstance(scored.schema[score_col].dataType, VectorUDT):
        scored = scored.withColumn("_score", vector_to_array(score_col)[1])
        score_col = "_score"
    return rank_auc(scored, label, score_col).first()["auc"]
