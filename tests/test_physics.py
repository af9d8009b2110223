"""Hand-calculated physics cases, wear stages, remaining life and offsets."""

import math

import pytest
from pyspark.sql import functions as F

from swarf.operators import physics, series, splits


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in values.items()))


TAYLOR = {"taylor_c": 200.0, "taylor_n": 0.25, "taylor_m": 0.0, "taylor_p": 0.0}


@pytest.mark.parametrize(
    "speed,elapsed,m,life,ratio", [(100.0, 8.0, 0.0, 16.0, 0.5), (0.0, 8.0, 0.0, math.inf, 0.0), (100.0, 99.0, 0.0, 16.0, 1.0), (100.0, 0.0, 0.5, 4096.0, 0.0)]
)
def test_tool_life(spark, speed, elapsed, m, life, ratio):
    row = physics.tool_life_features(
        one(spark, cutting_speed=speed, feed=0.25, axial_depth=0.25, elapsed_min=elapsed, **{**TAYLOR, "taylor_m": m, "taylor_p": m})
    ).first()
    assert row["tool_life_min"] == pytest.approx(life) and row["tool_life_ratio"] == pytest.approx(ratio)


def test_force(spark):
    row = physics.force_features(one(spark, feed=0.1, engagement=0.25, kc11=1800.0, mc=0.26, cutting_width=2.0, measured_force_n=500.0)).first()
    assert row["chip_thickness_mm"] == pytest.approx(0.05)
    assert row["specific_force"] == pytest.approx(1800 * 0.05**-0.26)
    assert row["model_force_n"] == pytest.approx(3600 * 0.05**0.74)
    assert row["force_ratio"] == pytest.approx(500 / (3600 * 0.05**0.74))


def test_energy(spark):
    row = physics.energy_features(one(spark, force_n=500.0, cutting_speed=100.0, feed=0.1, axial_depth=10.0, radial_depth=10.0)).first()
    assert row["cutting_power_w"] == pytest.approx(833.3333, abs=1e-3) and row["mrr_mm3_per_min"] == pytest.approx(1e6)
    cuts = spark.createDataFrame([(1, i, f, 60.0) for i, f in enumerate([100.0, 200.0, 300.0])], "tool_id int, cut long, force_n double, cutting_speed double")
    for rows in (1, 100):
        assert series.cumulative_energy(cuts, 0.1, rows=rows).agg(F.max("cumulative_energy_j")).first()[0] == pytest.approx(60.0)


def test_optional_wear_models(spark):
    base = dict(archard_k=1e-4, normal_force_n=500.0, sliding_distance_mm=200.0, hardness=2000.0)
    assert physics.wear_volume(one(spark, archard_available=True, **base)).first()["wear_volume_mm3"] == pytest.approx(0.005)
    assert physics.wear_volume(one(spark, archard_available=False, **base)).first()["wear_volume_mm3"] is None


def test_physics_vector_slots(spark):
    row = physics.physics_vector(one(spark, tool_life_ratio=0.5, force_delta_n=3.0)).first()
    assert row["physics"] == [0.5, 0, 3.0, 0, 0, 0] and row["physics_names"] == ["tool_life_ratio", "force_delta_n"]


def test_invalid_conditions_are_rejected_not_lost(spark):
    rows = [(100.0, 0.1, 1.0), (-1.0, 0.1, 1.0), (100.0, 0.0, 1.0), (100.0, 0.1, 0.0)]
    checked = physics.validate_conditions(spark.createDataFrame(rows, "cutting_speed double, feed double, axial_depth double"))
    assert physics.valid_cuts(checked).count() == 1 and physics.rejected_cuts(checked).count() == 3


def test_wear_stage_boundaries(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.09, 0.1, 0.15, 0.2, 0.35)], "wear_vb_mm double")
    assert [r["wear_stage"] for r in physics.wear_stage(df).orderBy("wear_vb_mm").collect()] == [0, 0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("wear,per_cut,want", [([0, 0.1, 0.3, 0.35], 1.0, [2, 1, 0, 0]), ([0, 0.05, 0.1], 2.0, [6, 4, 2])])
def test_rul(spark, wear, per_cut, want):
    df = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(wear)], "tool_id int, cut long, wear_vb_mm double")
    assert [r["rul_min"] for r in series.rul_labels(df, 0.3, per_cut).orderBy("cut").collect()] == want


def test_tool_offset(spark):
    df = spark.createDataFrame([(0.1, 10.0, 10.02), (0.1, 10.0, None), (-0.1, 10.0, None)], "wear_vb_mm double, nominal_mm double, measured_mm double")
    rows = physics.tool_offset(df).collect()
    assert rows[0]["offset_mm"] == -0.02 and rows[0]["confidence"] == 0.9
    assert rows[1]["offset_mm"] == -0.04 and rows[1]["confidence"] == 0.6
    assert rows[2]["offset_rejected"]


def test_flute_labels(spark):
    df = spark.createDataFrame([(0.1, 0.2, None)], "flute_1_wear_mm double, flute_2_wear_mm double, flute_3_wear_mm double")
    assert physics.label_wear(df).first()["wear_vb_mm"] == pytest.approx(0.15)
    with pytest.raises(ValueError):
        physics.label_wear(spark.range(1))


def test_group_split_has_no_leakage(spark):
    df = spark.range(500).select((F.col("id") % 40).alias("run_id"), F.col("id").cast("string").alias("file_path"))
    split = splits.group_hash_split(df, val=0.3, test=0.3)
    assert {r["split"] for r in split.select("split").distinct().collect()} == {"train", "val", "test"}
    splits.assert_no_leakage(split, "run_id")
    with pytest.raises(ValueError):
        splits.assert_no_leakage(df.withColumn("split", F.col("file_path").substr(1, 1)), "run_id")


def test_few_shot_samples_are_nested(spark):
    df = spark.range(100)
    grid = splits.few_shot_grid(df, "id", [None, 25, 5])
    counts = {r["shots"]: r["count"] for r in grid.groupBy("shots").count().collect()}
    assert counts == {-1: 100, 25: 25, 5: 5}
    small = {r["id"] for r in grid.filter("shots = 5").collect()}
    assert small <= {r["id"] for r in splits.few_shot_sample(df, "id", 25).collect()}
