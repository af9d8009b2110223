"""Few-shot prediction of query rows from a support set.

Class methods take a few-shot support of at most twenty rows, which travels as one array value, so every query row is
answered on its own: no join and no shuffle of the queries.  Regression and forecasts take a support of any size, held
against the query set in bounded blocks (``swarf.operators.metric``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.functions.vectors import euclidean, total
from swarf.operators.metric import nearest, weighted_means

# Label columns of each task in the order they are tried.
TASK_LABELS = {
    "toolwear_regression": ["tool_wear_vb", "tool_wear", "wear", "vb", "value", "target", "label", "y"],
    "rul_prediction": ["rul", "remaining_useful_life", "value", "target", "label", "y"],
    "wear_state_classification": ["wear_state", "class", "state", "value", "target", "label", "y"],
    "chatter_detection": ["chatter", "chatter_state", "class", "value", "target", "label", "y"],
    "surface_roughness_prediction": ["surface_roughness", "roughness", "ra", "value", "target", "label", "y"],
    "quality_prediction": ["quality_class", "quality", "class", "value", "target", "label", "y"],
    "anomaly_detection": ["anomaly_state", "anomaly", "class", "value", "target", "label", "y"],
    "future_forecasting": ["future_series", "forecast", "target_series", "future", "value", "target", "label", "y"],
}


def label_value(samples: DataFrame, task: str, scalar: str = "label_scalar", labels: str = "label_map", extra: str = "columns") -> DataFrame:
    """Label of a sample: scalar, first known key of the label map, its only entry, or a known column."""
    keys = TASK_LABELS.get(task, [task, "value", "target", "label", "y"])
    by_key = [F.when(F.map_contains_key(labels, k), F.element_at(labels, F.lit(k))) for k in keys]
    only = F.when(F.size(labels) == 1, F.element_at(F.map_values(labels), 1))
    by_column = [F.element_at(extra, F.lit(k)) for k in keys]
    return samples.withColumn("label_value", F.coalesce(F.col(scalar), *by_key, only, *by_column))


def is_regression(labels: DataFrame, column: str = "label_value", by: tuple[str, ...] = ()) -> DataFrame:
    """True when every label parses as a number."""
    return labels.groupBy(*by).agg(F.bool_and(F.col(column).try_cast("double").isNotNull()).alias("regression"))


def pack_support(support: DataFrame, *columns: str) -> Column:
    """The support rows, ordered by id, as one array constant."""
    rows = support.agg(F.array_sort(F.collect_list(F.struct("id", "embedding", *columns))).alias("s"))
    return rows.scalar()


def _ranked(embedding: Column, support: Column, payload: list[str]) -> Column:
    near = F.transform(
        support, lambda s: F.struct(euclidean(embedding, s["embedding"]).alias("distance"), s["id"].alias("support_id"), *[s[p].alias(p) for p in payload])
    )
    return F.array_sort(near)


def knn_join(query: DataFrame, support: DataFrame, k: int, payload: tuple[str, ...] = ("label",)) -> DataFrame:
    """Each query row with ``neighbors``: its ``k`` nearest rows of a few-shot support by distance, then support id."""
    if k <= 0:
        raise ValueError("k must be positive")
    if support.isEmpty():
        raise ValueError("at least one support row is required")
    packed = query.withColumn("_s", pack_support(support, *payload))
    return packed.withColumn("neighbors", F.slice(_ranked(F.col("embedding"), F.col("_s"), list(payload)), 1, k)).drop("_s")


def _weights(distances: Column) -> Column:
    return F.transform(distances, lambda d: 1.0 / (d + 1e-8))


def knn_predict(query: DataFrame, support: DataFrame, k: int = 3, regression: bool = True) -> DataFrame:
    """Distance-weighted mean and range, or majority class (earliest neighbour on ties) with its share.

    Regression finds its neighbours in a support of any size, classes in a few-shot support.
    """
    near = nearest(query, support, k, ("label",)).drop("measured") if regression else knn_join(query, support, k)
    labels = F.transform("neighbors", lambda n: n["label"])
    if regression:
        numbers = F.transform(labels, lambda v: v.cast("double"))
        held = near.withColumns({"_w": _weights(F.transform("neighbors", lambda n: n["distance"])), "_y": numbers})
        return held.withColumns(
            {
                "prediction": total(F.zip_with("_w", "_y", lambda w, y: w * y)) / total(F.col("_w")),
                "uncertainty": F.when(F.size("_y") > 1, F.array_max("_y") - F.array_min("_y")),
            }
        ).drop("_w", "_y", "neighbors")
    held = near.withColumn("_l", labels)
    count = lambda v: F.size(F.filter("_l", lambda x: x == v))
    votes = F.transform("_l", lambda v, i: F.struct((-count(v)).alias("less"), i.alias("at"), v.alias("label"), (count(v) / F.size("_l")).alias("share")))
    return held.withColumn("_best", F.array_min(votes)).withColumns(
        {"prediction": F.col("_best.label"), "share": F.col("_best.share")}
    ).drop("_l", "_best", "neighbors")


def prototypes(support: DataFrame) -> DataFrame:
    """Mean vector per label: (id, embedding, label), the id being the first support id of the label."""
    elements = support.select("label", "id", F.posexplode("embedding").alias("pos", "x"))
    means = elements.groupBy("label", "pos").agg(F.avg("x").alias("x"), F.min("id").alias("id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return means.groupBy("label").agg(F.min("id").alias("id"), ordered.alias("embedding")).select("id", "embedding", "label")


def prototype_predict(query: DataFrame, support: DataFrame) -> DataFrame:
    """Nearest class mean and the share of every class by inverse distance."""
    means = prototypes(support)
    held = query.withColumn("_s", pack_support(means, "label")).withColumn("_n", _ranked(F.col("embedding"), F.col("_s"), ["label"]))
    weights = held.withColumn("_t", total(_weights(F.transform("_n", lambda n: n["distance"]))))
    shares = F.map_from_entries(
        F.transform("_n", lambda n: F.struct(n["label"].alias("label"), (1.0 / (n["distance"] + 1e-8) / F.col("_t")).alias("share")))
    )
    return weights.withColumns({"prediction": F.col("_n")[0]["label"], "distance": F.col("_n")[0]["distance"], "shares": shares}).drop("_s", "_n", "_t")


def one_shot_predict(query: DataFrame, support: DataFrame) -> DataFrame:
    """Label of the first support row and its influence."""
    first = support.orderBy("id").limit(1)
    near = knn_join(query, first, 1)
    return near.withColumns(
        {"prediction": F.col("neighbors")[0]["label"], "influence": 1.0 / (F.col("neighbors")[0]["distance"] + 1e-8)}
    ).drop("neighbors")


def _mean_abs(values: Column) -> Column:
    return total(F.transform(values, lambda v: F.abs(v))) / F.size(values)


def residual_forecast(query: DataFrame, support: DataFrame, size: int) -> DataFrame:
    """Base forecast plus the weighted mean residual of the support (channel-major flat arrays of ``size``).

    ``support(id, embedding, target, base)`` and ``query(id, embedding, base)``.
    """
    whole = support.filter((F.size("target") == size) & (F.size("base") == size))
    held = whole.select("id", "embedding", F.zip_with("target", "base", lambda t, b: t - b).alias("residual"))
    corrected = weighted_means(query, held, "residual", "correction")
    return corrected.withColumns(
        {"prediction": F.zip_with("base", "correction", lambda b, c: b + c), "uncertainty": _mean_abs(F.col("correction"))}
    )


def knn_forecast(query: DataFrame, support: DataFrame, size: int) -> DataFrame:
    """Weighted mean of all support futures; uncertainty is the mean distance to the base forecast."""
    blended = weighted_means(query, support.filter(F.size("target") == size), "target", "prediction")
    return blended.withColumn("uncertainty", _mean_abs(F.zip_with("prediction", "base", lambda p, b: p - b)))


def similarity_blend(df: DataFrame, base: str, label: str, similarity: str) -> DataFrame:
    """Blend of a base prediction and a support label by a similarity limited to [0, 1]."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(similarity)))
    return df.withColumn("prediction", (1.0 - w) * F.col(base) + w * F.col(label))
