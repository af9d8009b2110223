"""Zero-shot forecast evaluation against persistence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.operators import evaluate, series


def evaluate_forecast(readings: DataFrame, predictions: DataFrame, context: int, horizons: Sequence[int], required: float = 0.15) -> DataFrame:
    """Release gate per horizon in physical units.

    ``predictions(series_id, channel, horizon, step, predicted)`` are in normalised units of the context.
    """
    keys = ["series_id", "channel", "horizon", "step"]
    targets = series.persistence_forecast(readings, series.horizon_targets(readings, context, horizons), context)
    joined = targets.join(predictions.select(*keys, "predicted"), keys)
    physical = series.denormalize(joined, "predicted", "model").withColumnRenamed("value", "target")
    return evaluate.release_gate(
        evaluate.regression_metrics(physical, ["horizon"], predicted="model", constant_r2=None),
        evaluate.regression_metrics(physical, ["horizon"], predicted="persistence", constant_r2=None),
        required,
    ).select("horizon", "model_rmse", "baseline_rmse", "rmse_improvement", "reached", F.col("passed"))
