"""Wear benchmark: cut lake to features, splits, ridge model, physics calibration and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.operators import features, models, physics, series, splits
from swarf.operators.evaluate import regression_metrics
from swarf.operators.lineage import checkpointed
from swarf.sources.files import SENSOR_CHANNELS, lake_readings

# Nominal cutting conditions of the cut lake.
NOMINAL = {"cutting_speed": 250.0, "feed": 0.25, "axial_depth": 0.125, "radial_depth": 0.2}
TIME_PER_CUT_MIN = 1.5


def cut_features(cuts: DataFrame, time_per_cut: float = TIME_PER_CUT_MIN) -> DataFrame:
    """One row per cut: statistics of every sensor channel, wear label and nominal conditions."""
    channels = [c for c in SENSOR_CHANNELS if c in cuts.columns]
    by = ["condition_id", "cut"]
    stats = features.time_features(lake_readings(cuts), [*by, "channel"])
    wide = features.features_wide(stats, channels, by)
    labels = cuts.groupBy(*by).agg(F.first("wear_vb_mm").alias("wear_vb_mm"))
    return wide.join(labels, by).withColumns({**{k: F.lit(v) for k, v in NOMINAL.items()}, "elapsed_min": F.col("cut") * time_per_cut})


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if any(c.startswith(p + "_") for p in SENSOR_CHANNELS) and c.rsplit("_", 1)[-1] != "mm"]


def wear_benchmark(
    spark: SparkSession, cuts: DataFrame, material: str = "generic_steel", test: Sequence[str] = ("c6",), val: Sequence[str] = ("c5",), calibrate: bool = True
) -> DataFrame:
    """Metrics per split of the wear model with optional tool-life calibration.

    Feature scaling, model and calibrator see training cuts only; the blend weight sees validation cuts only.
    """
    rows = cut_features(cuts).withColumn("material", F.lit(material))
    rows = physics.tool_life_features(physics.join_params(rows, physics.material_parameters(spark)))
    rows = splits.condition_split(rows, test, val).na.fill(0.0)
    rows = checkpointed(rows)
    columns = feature_columns(rows)
    train = rows.filter("split = 'train'")
    scaled = series.apply_standardizer(rows, series.fit_standardizer(train, columns), columns)
    model = models.fit_ridge(scaled.filter("split = 'train'"), columns, "wear_vb_mm")
    predicted = models.apply_ridge(model, scaled, columns)
    if calibrate:
        fitted = models.fit_calibrator(predicted.filter("split = 'train'"), "predicted", ["tool_life_ratio"], "wear_vb_mm")
        corrected = models.apply_calibrator(predicted, fitted, "predicted", ["tool_life_ratio"])
        alpha = models.select_alpha(corrected.filter("split = 'val'"), "predicted", "corrected", "wear_vb_mm").first()["alpha"]
        predicted = corrected.withColumn("predicted", models.blend(F.lit(alpha), F.col("predicted"), F.col("corrected")))
    return regression_metrics(predicted, ["split"], "wear_vb_mm")
