"""Ridge, logistic, calibration and clustering models.

Single models use Spark ML.  Families of small ridge models (few-shot grids, ablations) are fitted in one
pass: covariances are grouped aggregates and only a few coefficients per group are solved outside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.functions.vectors import as_doubles, euclidean, total
from swarf.operators.evaluate import regression_metrics
from swarf.operators.lineage import checkpointed
from swarf.operators.quantile import medians

# Cluster families and their sizes; blend weights, support sizes and variants of the ablation.
CLUSTER_FAMILIES = {"latent_tool": 12, "latent_material": 12, "latent_machine": 8, "latent_process": 8}
ALPHA_GRID = [round(0.1 * i, 1) for i in range(11)]
SHOTS = [None, 50, 25, 10, 5]
# variant name, uses the sensor features, physics columns of the calibrator
VARIANTS = [
    ("physics_only", False, ["tool_life_ratio"]),
    ("backbone_only", True, []),
    ("backbone_taylor", True, ["tool_life_ratio"]),
    ("backbone_kienzle", True, ["force_ratio"]),
    ("backbone_energy", True, ["specific_cutting_energy_j_per_mm3"]),
    ("backbone_taylor_kienzle", True, ["tool_life_ratio", "force_ratio"]),
    ("backbone_all_physics", True, ["tool_life_ratio", "force_ratio", "specific_cutting_energy_j_per_mm3"]),
]
PHYSICS = ["tool_life_ratio", "force_ratio", "specific_cutting_energy_j_per_mm3"]


# --- single models on Spark ML -----------------------------------------------------------------------


def fit_ridge(train: DataFrame, features: Sequence[str] | str, label: str, alpha: float = 1.0) -> DataFrame:
    """Least squares with an L2 penalty ``alpha`` on the unscaled features, as one row of weights; nothing runs yet.

    Any number of rows: a list of columns is fitted from one aggregate, one array column (an embedding) from matrix sums.
    """
    if isinstance(features, str):
        return array_ridge(train, features, F.array(F.col(label)), alpha)
    return grouped_ridge(train, [], features, label, alpha)


def _task_products(batches):
    """Task code: the products of the first ``d`` entries of each row with all of it, summed over the task's rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if len(set(zip(batch.column("d").to_pylist(), pc.list_value_length(batch.column("z")).to_pylist()))) > 1:
            raise ValueError("embeddings and targets must each have one length")
        z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        part = z[:, : batch.column("d")[0].as_py()].T @ z
        if held is not None and held.shape != part.shape:
            raise ValueError("embeddings and targets must each have one length")
        held = part if held is None else held + part
    if held is not None:
        yield pa.RecordBatch.from_pydict({"at": np.arange(held.size, dtype=np.int64), "value": held.ravel()})


def summed_products(rows: DataFrame) -> Column:
    """Sum over all rows ``(d, z)`` of the products of the first ``d`` entries of ``z`` with all entries, row by row.

    A task hands on one matrix however many rows it reads; matrices are added cell by cell with map-side combine.
    """
    cells = rows.select(F.col("d").cast("int").alias("d"), "z").mapInArrow(_task_products, "at long, value double")
    added = cells.groupBy("at").agg(F.sum("value").alias("value"))
    return added.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]).alias("cells")).scalar()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _solve_products(cells: pd.Series, means: pd.Series, width: pd.Series, alpha: pd.Series) -> pd.Series:
    """Per target its weights and intercept from the centred products X'[X Y]."""
    solved = []
    for flat, centre, d, a in zip(cells, means, width, alpha):
        if flat is None or not len(flat):
            solved.append(None)
            continue
        products, centre, d = np.asarray(flat, dtype=float).reshape(int(d), -1), np.asarray(centre, dtype=float), int(d)
        weights = np.linalg.lstsq(products[:, :d] + a * np.eye(d), products[:, d:], rcond=None)[0]
        solved.append(np.column_stack([weights.T, centre[d:] - centre[:d] @ weights]).tolist())
    return pd.Series(solved)


def array_ridge(train: DataFrame, embedding: str, targets: Column, alpha: float = 1.0) -> DataFrame:
    """One row with ``lines``: for every target the weights and, last, the intercept, from any number of rows.

    Two passes: means first, then products of the centred values, so large means cost no digits.  Rows with a null in
    embedding or targets take no part; without rows ``lines`` is null.  Only one matrix of embedding size squared meets
    in one place.
    """
    whole = "x IS NOT NULL AND y IS NOT NULL AND forall(x, v -> v IS NOT NULL) AND forall(y, v -> v IS NOT NULL)"
    pairs = train.select(as_doubles(embedding).alias("x"), as_doubles(targets).alias("y")).filter(whole)
    joint = pairs.select(F.size("x").alias("d"), F.concat("x", "y").alias("z"))
    # a leading one makes the same sums give the row count and the totals
    sums = summed_products(joint.select(F.lit(1).alias("d"), F.concat(F.array(F.lit(1.0)), "z").alias("z")))
    centred = joint.withColumn("_t", sums).select("d", F.zip_with("z", F.slice("_t", 2, F.size("_t") - 1), lambda v, t: v - t / F.col("_t")[0]).alias("z"))
    widths = joint.agg(F.max("d").alias("_d"))
    held = widths.withColumns({"_t": sums, "_g": summed_products(centred)})
    means = F.transform(F.slice("_t", 2, F.greatest(F.lit(0), F.size("_t") - 1)), lambda t: t / F.col("_t")[0])
    return held.select(_solve_products("_g", means, F.col("_d"), F.lit(float(alpha))).alias("lines"))


def array_predictions(df: DataFrame, lines: DataFrame, embedding: str, output: str) -> DataFrame:
    """The array of all targets' predictions."""
    one = lambda line: total(F.zip_with(embedding, F.slice(line, 1, F.size(embedding)), lambda v, w: v * w)) + F.element_at(line, -1)
    return df.withColumn("_lines", lines.scalar()).withColumn(output, F.transform("_lines", one)).drop("_lines")


def _assembled(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    if isinstance(features, str):
        return df.withColumn("_x", array_to_vector(features))
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


def apply_ridge(model, df: DataFrame, features: Sequence[str] | str, output: str = "predicted", floor: float | None = None) -> DataFrame:
    """Predictions as a column; ``floor`` limits them from below (remaining life is never negative)."""
    if isinstance(features, str):
        found = array_predictions(df, model, features, "_p").withColumn(output, F.col("_p")[0]).drop("_p")
    else:
        found = apply_grouped(df, model, [], features, output)
    return found if floor is None else found.withColumn(output, F.greatest(F.lit(float(floor)), F.col(output)))


def fit_logistic(train: DataFrame, features: Sequence[str] | str, label: str, c: float = 1.0, scale: bool = True, iterations: int = 1000):
    """Multinomial logistic model on standardised features with inverse penalty ``c``."""
    names = [features] if isinstance(features, str) else list(features)
    train = checkpointed(train.select(*names, label))
    n = train.count()
    stages = []
    source = "_raw"
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True))
        source = "_x"
    stages.append(
        LogisticRegression(featuresCol=source, labelCol=label, family="multinomial", regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False, maxIter=iterations)
    )
    return Pipeline(stages=stages).fit(_assembled(train, features).withColumnRenamed("_x", "_raw"))


def apply_logistic(model, df: DataFrame, features: Sequence[str] | str, output: str = "predicted") -> DataFrame:
    held = _assembled(df, features).withColumnRenamed("_x", "_raw")
    found = model.transform(held).withColumn("class_probabilities", vector_to_array("probability"))
    return found.withColumn(output, F.col("prediction").cast("int")).drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def ridge_forecast(query: DataFrame, support: DataFrame, size: int, alpha: float = 1.0) -> DataFrame:
    """Ridge from the embedding to every step of a flat future array of ``size``: one matrix sum, many right-hand sides."""
    lines = array_ridge(support, "embedding", F.slice("target", 1, size), alpha)
    return array_predictions(query, lines, "embedding", "prediction")


# --- grouped ridge -----------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(covariances: pd.Series, targets: pd.Series, rows: pd.Series, alpha: pd.Series) -> pd.Series:
    """Ridge weights from the upper covariance triangle; a tiny penalty is used when none is wanted."""
    solved = []
    for upper, xy, n, a in zip(covariances, targets, rows, alpha):
        d = len(xy)
        m = np.zeros((d, d))
        m[np.triu_indices(d)] = upper
        m = m + np.triu(m, 1).T
        system, right = m * n + a * np.eye(d), np.asarray(xy, dtype=float) * n
        solved.append(np.linalg.lstsq(system, right, rcond=None)[0])
    return pd.Series(solved)


def grouped_ridge(train: DataFrame, by: Sequence[str], features: Sequence[str], label: str, alpha: float = 1.0, standardize: bool = False) -> DataFrame:
    """Weights and intercept per group: (by…, weights, centers, scales, intercept)."""
    d = len(features)
    train = train.dropna(subset=[*features, label])  # sums of complete rows only
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col(f).cast("double") for f in features]
    stats = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_ym"),
        F.array(*[F.avg(c) for c in x]).alias("centers"),
        F.array(*[F.stddev_pop(c) for c in x]).alias("_sd"),
        F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_cov"),
        F.array(*[F.covar_pop(c, F.col(label)) for c in x]).alias("_xy"),
    )
    unit = F.transform("_sd", lambda s: F.when(s > 1e-12, s).otherwise(1.0)) if standardize else F.array_repeat(F.lit(1.0), d)
    scaled = stats.withColumn("scales", unit)
    first = F.expr("array(" + ", ".join(str(i) for i, _ in pairs) + ")")
    second = F.expr("array(" + ", ".join(str(j) for _, j in pairs) + ")")
    cov = F.transform("_cov", lambda c, k: c / (F.get(F.col("scales"), F.get(first, k)) * F.get(F.col("scales"), F.get(second, k))))
    xy = F.zip_with("_xy", "scales", lambda c, s: c / s)
    solved = scaled.withColumn("weights", _solve(cov, xy, F.col("_n").cast("double"), F.lit(float(alpha))))
    return solved.select(*by, "weights", "centers", "scales", F.col("_ym").alias("intercept"))


def apply_grouped(df: DataFrame, weights: DataFrame, by: Sequence[str], features: Sequence[str], output: str) -> DataFrame:
    """Predictions of the group's model; one weight row per group."""
    # models are few, and a shuffle by their keys would gather the rows of each in one task
    held = df.join(F.broadcast(weights), list(by)) if by else df.withColumn("_w", weights.select(F.struct("*")).scalar()).select(*df.columns, "_w.*")
    # written out term by term, which compiles; functions over arrays are interpreted for every row
    terms = [(F.col(f).cast("double") - F.get("centers", F.lit(i))) / F.get("scales", F.lit(i)) * F.get("weights", F.lit(i)) for i, f in enumerate(features)]
    return held.withColumn(output, F.col("intercept") + sum(terms, F.lit(0.0))).drop("weights", "centers", "scales", "intercept")


# --- calibration -------------------------------------------------------------------------------------


def fit_calibrator(train: DataFrame, predicted: str, physics: Sequence[str], label: str, method: str = "ridge", alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Standardised linear or ridge map from (prediction, physics…) to the label, fitted on training rows."""
    if method not in ("linear", "ridge"):
        raise ValueError(f"method must be 'linear' or 'ridge', got {method!r}")
    return grouped_ridge(train, by, [predicted, *physics], label, alpha if method == "ridge" else 0.0, standardize=True)


def apply_calibrator(df: DataFrame, calibrator: DataFrame | None, predicted: str, physics: Sequence[str], by: Sequence[str] = (), output: str = "corrected") -> DataFrame:
    if calibrator is None:
        raise RuntimeError("the calibrator must be fitted first")
    return apply_grouped(df, calibrator, by, [predicted, *physics], output)


def blend(alpha: Column, predicted: Column, corrected: Column) -> Column:
    """(1 - alpha) · prediction + alpha · correction."""
    return (1.0 - alpha) * predicted + alpha * corrected


def select_alpha(val: DataFrame, predicted: str, corrected: str, label: str, by: Sequence[str] = (), grid: Sequence[float] = tuple(ALPHA_GRID)) -> DataFrame:
    """Blend weight with the smallest validation MAE, the smaller weight on ties; one pass over the rows."""
    errors = [F.avg(F.abs(blend(F.lit(a), F.col(predicted), F.col(corrected)) - F.col(label))) for a in grid]
    scored = val.groupBy(*by).agg(F.array(*[F.struct(e.alias("mae"), F.lit(a).alias("alpha")) for e, a in zip(errors, grid)]).alias("_g"))
    best = F.array_min("_g")
    return scored.select(*by, best["alpha"].alias("alpha"), best["mae"].alias("val_mae"))


def ablation_study(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str, variants=VARIANTS, alpha: float = 1.0) -> DataFrame:
    """Validation and test metrics of every variant and shot count.

    ``train`` carries ``shots`` (see ``few_shot_grid``).  Rows keep their own physics values, base models are
    fitted per shot count, calibrators per variant and shot count, and blend weights on validation only.  The three
    frames are read several times and not written here: give stored ones (see ``stored``).  Models are a few rows each
    and are checkpointed, so no pass over the rows is repeated.
    """
    spark = train.sparkSession
    train = train.select("shots", *dict.fromkeys([*features, label, *PHYSICS]))
    val, test = (rows.select(*train.columns[1:]) for rows in (val, test))
    flags = [(name, backbone, *[p in used for p in PHYSICS]) for name, backbone, used in variants]
    table = spark.createDataFrame(flags, "name string, backbone boolean, use_0 boolean, use_1 boolean, use_2 boolean")
    packed = table.agg(F.collect_list(F.struct("*")).alias("v")).scalar()
    sensor = checkpointed(grouped_ridge(train, ["shots"], features, label, alpha))
    physics = checkpointed(grouped_ridge(train, ["shots"], ["tool_life_ratio"], label, alpha))
    shot_list = F.lit([row["shots"] for row in train.select("shots").distinct().collect()])

    def scored(rows: DataFrame) -> DataFrame:
        base = apply_grouped(apply_grouped(rows, sensor, ["shots"], features, "_sensor"), physics, ["shots"], ["tool_life_ratio"], "_physics")
        each = base.withColumn("v", F.explode(packed)).select(*base.columns, "v.*")
        masked = {f"m_{i}": F.when(F.col(f"use_{i}"), F.coalesce(F.col(p), F.lit(0.0))).otherwise(0.0) for i, p in enumerate(PHYSICS)}
        return each.withColumn("predicted", F.when(F.col("backbone"), F.col("_sensor")).otherwise(F.col("_physics"))).withColumns(masked)

    columns, key = ["m_0", "m_1", "m_2"], ["name", "shots"]
    calibrator = checkpointed(fit_calibrator(scored(train), "predicted", columns, label, "ridge", alpha, key))
    spread = lambda rows: apply_calibrator(scored(rows.withColumn("shots", F.explode(shot_list))), calibrator, "predicted", columns, key)
    checked, held = spread(val), spread(test)
    chosen = checkpointed(select_alpha(checked, "predicted", "corrected", label, key))
    used = F.col("use_0") | F.col("use_1") | F.col("use_2")
    final = lambda rows: rows.join(F.broadcast(chosen.select(*key, "alpha")), key).withColumn(
        "final", F.when(used, blend(F.col("alpha"), F.col("predicted"), F.col("corrected"))).otherwise(F.col("predicted"))
    )
    metric = lambda rows, prefix: regression_metrics(final(rows), key, label, "final").select(
        *key, *[F.col(c).alias(f"{prefix}_{c}") for c in ("mae", "rmse", "r2")]
    )
    return metric(checked, "val").join(metric(held, "test"), key).join(chosen.select(*key, "alpha"), key)


def few_shot_curve(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Test errors without and with physics calibration per shot count, and the improvement in percent."""
    pair = [v for v in VARIANTS if v[0] in ("backbone_only", "backbone_taylor")]
    rows = ablation_study(train, val, test, features, label, pair)
    # one row per variant and shot count: an aggregate, where a join of two selections would score every row twice
    pick = lambda name, prefix: [F.max(F.when(F.col("name") == name, F.col(f"test_{m}"))).alias(f"{prefix}_{m}") for m in ("mae", "rmse", "r2")]
    joined = rows.groupBy("shots").agg(*pick("backbone_only", "without_physics"), *pick("backbone_taylor", "with_physics"))
    gain = (F.col("without_physics_mae") - F.col("with_physics_mae")) / (F.col("without_physics_mae") + 1e-9) * 100
    return joined.withColumn("mae_improvement_pct", gain)


# --- clusters ----------------------------------------------------------------------------------------


def fit_clusters(profile: DataFrame, columns: Sequence[str], families: dict[str, int] = CLUSTER_FAMILIES, seed: int = 42, iterations: int = 50):
    """Standardised k-means per family; returns (statistics row, {family: centers}, {family: distance scale}).

    The profile is read once per iteration, so it is written to the checkpoint folder first.
    """
    profile = checkpointed(profile)
    stats = profile.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"{c}__std") for c in columns]).first()
    held = standardized_profile(profile, columns, stats)
    vectors = held.withColumn("features", array_to_vector("z"))
    n = vectors.count()
    centers, scales = {}, {}
    for index, (family, count) in enumerate(families.items()):
        k = min(max(1, count), n)
        if k > 1:
            model = KMeans(k=k, seed=seed + index * 997, maxIter=iterations, featuresCol="features").fit(vectors)
            centers[family] = [c.tolist() for c in model.clusterCenters()]
        else:
            centers[family] = [[0.0] * len(columns)]
    nearest = assign_families(held, centers, {f: 1.0 for f in centers})
    for row in medians(nearest, ["family"], "distance").collect():  # one row per family
        scales[row["family"]] = float(row["median"]) + 1e-6
    return stats, centers, scales


def assign_families(df: DataFrame, centers: dict[str, list], scales: dict[str, float], vector: str = "z") -> DataFrame:
    """One row per input row and family: nearest center, distance and confidence, in one pass."""
    entries = [
        f"named_struct('family', '{f}', 'centers', {_vectors(c)}, 'scale', {float(scales[f])!r}D)" for f, c in centers.items()
    ]
    each = df.withColumn("_f", F.explode(F.expr("array(" + ", ".join(entries) + ")")))
    return assign_clusters(each, F.col("_f.centers"), F.col("_f.scale"), vector).withColumn("family", F.col("_f.family")).drop("_f")


def _vectors(centers) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in c) + ")" for c in centers) + ")"


def standardized_profile(profile: DataFrame, columns: Sequence[str], stats) -> DataFrame:
    return profile.withColumn("z", F.array(*[(F.col(c) - stats[f"{c}__mean"]) / stats[f"{c}__std"] for c in columns]))


def assign_clusters(df: DataFrame, centers, scale, vector: str = "z") -> DataFrame:
    """Nearest center, its distance and a confidence level; the centers are a small constant.

    ``centers`` is a list of vectors or a column holding an array of vectors; ``scale`` a number or column.
    """
    if not isinstance(centers, Column):
        centers = F.expr(_vectors(centers))
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    near = F.array_min(F.transform(centers, lambda c, i: F.struct(euclidean(F.col(vector), c).alias("distance"), i.alias("cluster"))))
    level = F.when(F.col("distance") <= scale, "high").when(F.col("distance") <= scale * 2.0, "medium").otherwise("low")
    return df.withColumn("_near", near).withColumns({"cluster": F.col("_near.cluster"), "distance": F.col("_near.distance")}).withColumn("confidence", level).drop("_near")
