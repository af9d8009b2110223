"""Channel names, few-shot prediction and models against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarf.operators import channels, fewshot, models
from swarf.plans.requests import predict_few_shot

# Raw spellings and their canonical names.
EXAMPLES = {
    "vibration_data:0": "external_sensor.unknown.vibration.x.raw",
    "signals_sensor/force_sensor_x": "external_sensor.unknown.force.x.raw",
    "signals_machine/force_axis_x": "machine_controller.axis_drive.force.x.actual",
    "signals_machine/torque_spindle": "machine_controller.spindle.torque.none.actual",
    "signals_machine/tool_position_y": "machine_controller.tool.position.y.actual",
    "signals_machine/position_control_deviation_axis_x": "machine_controller.axis_drive.position_error.x.actual",
    "vibration_x_rms": "derived_feature.unknown.vibration.x.rms",
    "virtual_spindle_vibration_x": "external_sensor.spindle.vibration.x.raw",
    "ｖibration_x": "external_sensor.unknown.vibration.x.raw",
    "machine_controller.motor.current.u.actual": "machine_controller.motor.current.u.actual",
}


def test_channel_examples(spark):
    names = spark.createDataFrame([(n,) for n in EXAMPLES], "raw_name string")
    found = {r["raw_name"]: r["canonical_name"] for r in channels.canonicalize_channels(names, unicode_names=True).collect()}
    assert found == EXAMPLES


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = np.clip(0.1 + 0.2 * x[:, 0] + rng.normal(0, 0.01, 60), 0, 0.5)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    return x, y, df


def closed_form(x, y, alpha):
    xc = x - x.mean(0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    return y.mean() + xc @ w


def test_ridge_closed_form(data):
    x, y, df = data
    want = closed_form(x, y, 1.0)
    ml = models.apply_ridge(models.fit_ridge(df, ["a", "b", "c"], "y"), df, ["a", "b", "c"]).orderBy("id").toPandas()["predicted"]
    assert np.allclose(ml, want, atol=1e-8)
    weights = models.grouped_ridge(df, [], ["a", "b", "c"], "y")
    own = models.apply_grouped(df, weights, [], ["a", "b", "c"], "p").orderBy("id").toPandas()["p"]
    assert np.allclose(own, want)


def test_calibrator(data):
    x, y, df = data
    fitted = models.fit_calibrator(df, "a", ["b", "c"], "y", "linear")
    out = models.apply_calibrator(df, fitted, "a", ["b", "c"]).withColumn("kept", models.blend(F.lit(0.0), F.col("a"), F.col("corrected")))
    pdf = out.orderBy("id").toPandas()
    assert np.allclose(pdf["kept"], x[:, 0]) and np.allclose(pdf["corrected"], closed_form(x, y, 0.0))
    with pytest.raises(RuntimeError):
        models.apply_calibrator(df, None, "a", ["b"])
    with pytest.raises(ValueError):
        models.fit_calibrator(df, "a", ["b"], "y", "mlp")
    best = models.select_alpha(out.withColumn("predicted", F.col("a")), "predicted", "corrected", "y").first()
    errors = [np.abs((1 - a) * x[:, 0] + a * pdf["corrected"] - y).mean() for a in models.ALPHA_GRID]
    assert best["alpha"] == models.ALPHA_GRID[int(np.argmin(errors))]


def test_few_shot_methods(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], float(i)) for i in range(10)], "id int, embedding array<double>, label double")
    named = df.withColumn("label", F.when(F.col("id") < 5, "low").otherwise("high"))
    assert predict_few_shot(df, named, "chatter_detection", "prototype").filter("id = 0").first()["prediction"] == "low"
    assert predict_few_shot(df, named, "chatter_detection", "linear_probe").filter("id = 9").first()["prediction"] == "high"
    assert abs(predict_few_shot(df, df, "rul_prediction", "ridge").filter("id = 9").first()["prediction"] - 9) < 0.5
    assert predict_few_shot(df, df, "rul_prediction", "prototype").filter("id = 4").first()["prediction"] == pytest.approx(4.0, abs=1e-5)
    with pytest.raises(ValueError):
        predict_few_shot(df, df, "rul_prediction", "svr")
    with pytest.raises(ValueError):
        fewshot.knn_join(df, df.filter("id < 0"), 3)


def test_forecast_requests(spark):
    from swarf.plans.requests import forecast_few_shot

    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 3))
    y = np.column_stack([x @ [1.0, 2.0, 0.5] + 1, x @ [0.0, -1.0, 1.0]])
    rows = [(i, x[i].tolist(), y[i].tolist(), [0.0, 0.0]) for i in range(12)] + [(12, [0.0] * 3, None, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>, target array<double>, base array<double>")
    for method in ("residual", "knn", "ridge"):
        found = forecast_few_shot(df.select("id", "embedding", "base"), df, 2, method).collect()
        assert len(found) == 13 and all(len(r["prediction"]) == 2 for r in found)
    free = x - x.mean(0)
    w = np.linalg.solve(free.T @ free + np.eye(3), free.T @ (y - y.mean(0)))
    want = (x - x.mean(0)) @ w + y.mean(0)
    got = {r["id"]: r["prediction"] for r in found}
    assert np.allclose([got[i] for i in range(12)], want)


def test_ridge_on_arrays_uses_every_row(spark):
    """Many rows over many tasks, means far from zero, several targets, rows with nulls, and no rows at all."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 6)) + 1e6
    y = np.column_stack([x @ rng.normal(size=6), rng.normal(size=5000)])
    rows = [(x[i].tolist(), y[i].tolist()) for i in range(5000)] + [(None, [1.0, 1.0]), ([None] * 6, [1.0, 1.0]), ([0.0] * 6, None), ([0.0] * 6, [None, 1.0])]
    df = spark.createDataFrame(rows, "embedding array<double>, y array<double>").repartition(13)
    lines = np.array(models.array_ridge(df, "embedding", F.col("y"), 2.0).first()["lines"])
    free = x - x.mean(0)
    w = np.linalg.solve(free.T @ free + 2 * np.eye(6), free.T @ (y - y.mean(0)))
    assert np.allclose(lines[:, :-1], w.T, atol=1e-7) and np.allclose(lines[:, -1], y.mean(0) - x.mean(0) @ w, rtol=1e-6)
    assert models.array_ridge(df.limit(0), "embedding", F.col("y")).first()["lines"] is None
    mixed = spark.createDataFrame([([1.0], [1.0]), ([1.0, 2.0], [1.0])], "embedding array<double>, y array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        models.array_ridge(mixed, "embedding", F.col("y")).collect()


def test_grouped_ridge_uses_complete_rows(spark):
    rows = [(1, 1.0, 1.0), (1, 2.0, 3.0), (1, 4.0, 4.0), (1, None, 9.0), (1, 7.0, None)]
    df = spark.createDataFrame(rows, "g int, a double, y double")
    full = spark.createDataFrame(rows[:3], "g int, a double, y double")
    fit = lambda d: models.grouped_ridge(d, ["g"], ["a"], "y").first()
    assert np.isclose(fit(df)["weights"][0], fit(full)["weights"][0]) and np.isclose(fit(df)["intercept"], fit(full)["intercept"])
