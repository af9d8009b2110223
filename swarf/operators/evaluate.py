"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.operators.quantile import quantiles
from swarf.operators.scan import BLOCK, BLOCK_ROWS, core_rows, with_neighbours
from pyspark.sql import Window as W


def regression_metrics(df: DataFrame, by: Sequence[str] = (), target: str = "target", predicted: str = "predicted", constant_r2: float | None = 0.0) -> DataFrame:
    """MAE, RMSE, R² and symmetric MAPE; R² of a constant target is ``constant_r2`` (None for null)."""
    y, p = F.col(target).cast("double"), F.col(predicted).cast("double")
    e = p - y
    spread = F.var_pop(y) * F.count(F.lit(1))
    fallback = F.lit(constant_r2).cast("double")
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 1e-12, 1.0 - F.sum(e * e) / spread).otherwise(fallback).alias("r2"),
        F.avg(2.0 * F.abs(e) / (F.abs(y) + F.abs(p) + 1e-12)).alias("smape"),
    )


def _label_counts(df: DataFrame, by: Sequence[str], target: str, predicted: str) -> DataFrame:
    """True positives, predictions and truths per label: one pass, two rows per prediction."""
    sides = F.array(
        F.struct(F.col(target).alias("label"), F.lit(1).alias("truth"), F.lit(0).alias("called")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("truth"), F.lit(1).alias("called")),
    )
    hit = (F.col(target) == F.col(predicted)).cast("int")
    rows = df.select(*by, hit.alias("_hit"), F.explode(sides).alias("s"))
    return rows.groupBy(*by, "s.label").agg(
        F.sum(F.col("s.truth") * F.col("_hit")).alias("tp"), F.sum("s.truth").alias("truth"), F.sum("s.called").alias("called")
    )


def classification_metrics(df: DataFrame, by: Sequence[str] = (), target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro F1 over the labels seen in truth or prediction."""
    f1 = F.when(F.col("truth") + F.col("called") > 0, 2.0 * F.col("tp") / (F.col("truth") + F.col("called"))).otherwise(0.0)
    labels = _label_counts(df, by, target, predicted).withColumn("_f1", f1)
    return labels.groupBy(*by).agg((F.sum("tp") / F.sum("truth")).alias("accuracy"), F.avg("_f1").alias("macro_f1"))


def confusion_matrix(df: DataFrame, labels: Sequence, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Counts of all pairs of the closed label list, zeros included."""
    counts = df.groupBy(F.col(target).alias("truth")).pivot(predicted, list(labels)).count()
    spark = df.sparkSession
    rows = spark.createDataFrame([(l,) for l in labels], ["truth"])
    wide = rows.join(counts, "truth", "left").na.fill(0)
    return wide.unpivot(["truth"], [str(l) for l in labels], "called", "n")


def residual_score(df: DataFrame, target: str = "target", predicted: str = "predicted", spread: str = "predicted_std") -> DataFrame:
    return df.withColumn("score", F.abs(F.col(target) - F.col(predicted)) / F.greatest(F.col(spread), F.lit(1e-6)))


def conformal_threshold(scores: DataFrame, coverage: float = 0.95, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Interpolated coverage quantile of the calibration scores; infinite without scores."""
    q = min(1.0, max(0.0, coverage))
    found = quantiles(scores, by, score, {"threshold": q})
    if by:
        found = scores.select(*by).distinct().join(found, list(by), "left")
    return found.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


def flag_anomalies(scores: DataFrame, threshold: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Rows above their group's threshold; null scores and groups without a threshold are no anomalies."""
    limit = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    # one threshold per group; a shuffle by group would gather all its scores in one task
    return scores.join(F.broadcast(threshold), list(by), "left").withColumn("anomaly", F.coalesce(F.col(score) > limit, F.lit(False)))


def huber(error: Column) -> Column:
    return F.when(F.abs(error) < 1.0, 0.5 * error * error).otherwise(F.abs(error) - 0.5)


def forecast_error_components(df: DataFrame, by: Sequence[str], seq: str = "seq", rows: int = BLOCK_ROWS) -> DataFrame:
    """Huber error, rms gap, Huber error of first differences and Student-t likelihood per group.

    Needs ``target, predicted, log_var`` and a dense position; differences run inside position blocks.
    """
    held = with_neighbours(df, 1, 0, seq=seq, rows=rows)
    step = W.partitionBy(*by, BLOCK).orderBy(seq)
    diff = lambda c: F.col(c) - F.lag(c, 1).over(step)
    moved = core_rows(held.withColumn("_d", diff("predicted") - diff("target")))
    y, p = F.col("target"), F.col("predicted")
    z = (y - p) * (y - p) / F.greatest(F.exp("log_var"), F.lit(1e-6))
    rms = lambda c: F.sqrt(F.greatest(F.avg(c * c), F.lit(1e-8)))
    return moved.groupBy(*by).agg(
        F.avg(huber(p - y)).alias("huber"),
        F.abs(rms(p) - rms(y)).alias("rms_gap"),
        F.avg(huber(F.col("_d"))).alias("derivative"),
        F.avg(0.5 * F.col("log_var") + 2.0 * F.log1p(z / 3.0)).alias("nll"),
    )


def finalize_class(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Index of the largest score, the first of equals."""
    return df.withColumn("predicted_class", (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def prediction_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sample deviation of repeated predictions, null below two."""
    return df.groupBy(*by).agg(F.stddev_samp(value).alias("uncertainty"))


def ablation_pivot(results: DataFrame, shots: Sequence[int], value: str = "test_mae") -> DataFrame:
    """Variant × shot-count matrix."""
    wide = results.groupBy("name").pivot("few_shot_n", list(shots)).agg(F.first(value))
    return wide.select("name", *[F.col(f"`{s}`").alias(f"n_{s}") for s in shots])


def release_gate(model: DataFrame, baseline: DataFrame, required: float = 0.15, by: str = "horizon") -> DataFrame:
    """RMSE gain over the baseline per horizon and whether every horizon reaches ``required``."""
    joined = model.select(by, F.col("rmse").alias("model_rmse")).join(baseline.select(by, F.col("rmse").alias("baseline_rmse")), by, "left")
    gain = F.when(F.col("baseline_rmse") > 0, (F.col("baseline_rmse") - F.col("model_rmse")) / F.col("baseline_rmse"))
    horizons = joined.withColumn("rmse_improvement", gain).withColumn("reached", F.coalesce(F.col("rmse_improvement") >= required, F.lit(True)))
    # one row per horizon, a handful
    return horizons.withColumn("passed", horizons.agg(F.bool_and("reached") & (F.count(F.lit(1)) > 0)).scalar())


def evaluate_few_shot(df: DataFrame, numeric: bool, by: Sequence[str] = ()) -> DataFrame:
    """Regression metrics for numeric labels, else accuracy."""
    if numeric:
        return regression_metrics(df, by)
    return df.groupBy(*by).agg(F.avg((F.col("target") == F.col("predicted")).cast("double")).alias("accuracy"))


def performance_gap(result: Column, baseline: Column, higher_is_better: bool = False) -> Column:
    """Signed distance to a baseline, positive when worse; null without a baseline."""
    return baseline - result if higher_is_better else result - baseline
