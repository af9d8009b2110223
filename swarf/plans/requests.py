"""Batch form of the few-shot prediction request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.operators import fewshot, models
from swarf.operators.splits import cap_support

METHODS = ("prototype", "knn", "ridge", "linear_probe", "one_shot")
FORECASTS = ("residual", "knn", "ridge")


def predict_few_shot(query: DataFrame, support: DataFrame, task: str, method: str = "prototype", limit: int = 20) -> DataFrame:
    """Answer every query row with the chosen method.

    Numeric labels make prototypes fall back to neighbours and allow ridge, over the whole support; other labels are
    classes, for which the request takes the first ``limit`` support rows.  One-shot takes the first row.
    ``support(id, embedding, label)``, ``query(id, embedding)``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown few-shot method {method!r}")
    labelled = support.filter(F.col("label").isNotNull())
    checked = labelled.select(F.col("label").cast("string").alias("label_value"))
    numeric = fewshot.is_regression(checked).first()["regression"]
    if numeric is None:
        raise ValueError(f"no labelled support row for task {task!r}")
    query = query.select("id", "embedding")
    taken = labelled if numeric else cap_support(support, "id", limit).filter(F.col("label").isNotNull())
    if method == "one_shot":
        return fewshot.one_shot_predict(query, taken)
    if numeric and method in ("ridge", "linear_probe"):
        held = taken.withColumn("label", F.col("label").cast("double"))
        return models.apply_ridge(models.fit_ridge(held, "embedding", "label"), query, "embedding", "prediction")
    if method == "linear_probe":
        # class labels are numbered in sorted order; at most as many as support rows
        names = taken.agg(F.array_sort(F.collect_set("label")).alias("n"))
        held = taken.withColumn("_n", names.scalar()).withColumn("_y", (F.array_position("_n", F.col("label")) - 1).cast("double"))
        found = models.apply_logistic(models.fit_logistic(held, "embedding", "_y", scale=False, iterations=200), query, "embedding", "_c")
        return found.withColumn("_n", names.scalar()).withColumn("prediction", F.get("_n", F.col("_c"))).drop("_n", "_c")
    if numeric or method == "knn":
        return fewshot.knn_predict(query, taken, 3, bool(numeric))
    return fewshot.prototype_predict(query, taken)


def forecast_few_shot(query: DataFrame, support: DataFrame, size: int, method: str = "residual") -> DataFrame:
    """Forecast ``size`` values (channels laid end to end) of every query row from the whole support.

    ``support(id, embedding, target, base)``, ``query(id, embedding, base)``; support rows without a target of that size
    do not take part.
    """
    if method not in FORECASTS:
        raise ValueError(f"unknown forecast method {method!r}")
    taken = support.filter(F.size("target") == size)
    if method == "residual":
        return fewshot.residual_forecast(query, taken, size)
    if method == "knn":
        return fewshot.knn_forecast(query, taken, size)
    return models.ridge_forecast(query, taken, size)
