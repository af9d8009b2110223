"""Single readings and equal distances to an order: the query and its SQL, or a stated rule, must agree."""

import numpy as np
import pytest

from swarf.functions import spectra


@pytest.fixture(scope="module")
def short_series(spark, tmp_path_factory):
    """Events whose series hold one to four readings."""
    folder = str(tmp_path_factory.mktemp("short"))
    rows = [(10 * u + i, u, e, 1.5 * u - i * i) for u in range(1, 5) for e in ("click", "error") for i in range(u)]
    events = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "event_id long, user_id long, event_type string, value double")
    events.selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def agree(spark, folder, name):
    import duckdb

    import __spark_entry__ as entry
    from tests.oracle import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])


def test_band_profile_of_a_single_reading(spark, short_series):
    assert agree(spark, short_series, "band_profile") == ""


def test_orders_midway_between_two_bins_take_the_lower():
    rng = np.random.default_rng(3)
    found = 0
    for n in range(3, 40):
        x = rng.normal(size=n)
        freqs, mags = np.fft.rfftfreq(n, 1 / 2000.0), np.abs(spectra.hann_spectrum(x))
        for low in range(len(freqs) - 1):
            rpm = (freqs[low] + freqs[low + 1]) / 2 * 60.0
            for order in (1, 2, 4, 8):
                got = spectra.order_amplitudes(x, rpm / order, 2000.0, 8)
                gaps = np.abs(freqs[None, :] - rpm / order / 60.0 * np.arange(1, 9)[:, None])
                first = [int(np.flatnonzero(g <= g.min() + 1e-7)[0]) for g in gaps]
                assert np.allclose(got, spectra.standard(mags[first]))
                found += first != gaps.argmin(axis=1).tolist()
    assert found > 0  # the plain comparison decides some of these by rounding errors


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_do_not_gather_by_material_model_or_slice(spark):
    from pyspark.sql import functions as F

    from swarf.operators import models, physics, scan

    cuts = spark.range(1000).withColumns({"material": F.lit("Ti6Al4V"), "x": F.rand(1), "y": F.rand(2), "shots": F.col("id") % 2})
    assert "SortMergeJoin" not in _plan(physics.join_params(cuts, physics.material_parameters(spark)))
    assert "SortMergeJoin" not in _plan(models.apply_grouped(cuts, models.grouped_ridge(cuts, ["shots"], ["x"], "y"), ["shots"], ["x"], "p"))
    assert "SortMergeJoin" not in _plan(scan.order_blocks(cuts, [], ["x", "id"], rows=10))


@pytest.mark.parametrize("rows", [4, 16, 4096])
def test_grids_from_blocks_of_readings(readings, arrays, rows):
    from swarf.operators import spectral

    got = {(r["series_id"], r["channel"]): r["values"] for r in spectral.resampled_arrays(readings, 64, rows=rows).collect()}
    assert got.keys() == arrays.keys()
    for key, x in arrays.items():
        assert np.allclose(got[key], spectra.stretch(x, 64), atol=1e-12)


def test_views_of_short_and_long_series_agree(readings):
    from swarf.operators import spectral

    both = [{(r["series_id"], r["channel"]): r["frequency"] for r in spectral.frequency_view(readings, 100.0, rows=n).collect()} for n in (4096, 40)]
    assert both[0].keys() == both[1].keys() and all(np.allclose(v, both[1][k], atol=1e-9) for k, v in both[0].items())


@pytest.mark.parametrize("window", [None, 64])
def test_views_pass_through_python_once(readings, window):
    """Each further pass would hold another worker per task, and batches of wide arrays on both sides."""
    from swarf.operators import spectral

    plan = _plan(spectral.frequency_view(readings, 100.0, window=window, rows=1 << 20))
    branches = 1 if window else 2  # long series have a branch of their own
    assert plan.count("MapInArrow") == 1 and (branches == 2 or "ArrowEvalPython" not in plan)


def test_batches_of_views_stay_small(monkeypatch):
    import pyarrow as pa

    from swarf.functions import spectra

    series = pa.array([[float(k), 1.0, 2.0 + k] for k in range(1300)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), series], ["id", "values"])
    parts = list(spectra.frequency_batches([batch], 100.0, {"fft", "stft", "cwt"}, 512, 256, [("all", 0.0, None)]))
    assert max(p.num_rows for p in parts) == spectra.ROWS and sum(p.num_rows for p in parts) == 1300
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(1300))
    one = spectra.frequency_rows(np.array([[700.0, 1.0, 702.0]]), 100.0, {"fft", "stft", "cwt"}, 512, 256, [("all", 0.0, None)])[0]
    assert np.allclose(parts[700 // spectra.ROWS].column(1)[700 % spectra.ROWS].as_py(), one)


def test_resampling_sends_arrays_not_one_row_per_place(readings):
    from swarf.operators import spectral

    plan = _plan(spectral.fft_magnitude(readings))
    assert "sequence(0" not in plan.lower()


def test_quantiles_and_flags_do_not_gather_by_group(spark):
    from pyspark.sql import functions as F

    from swarf.operators import evaluate, quantile

    scores = spark.range(2000).select((F.col("id") % 2).alias("task"), (F.col("id") * 7919 % 2000).cast("double").alias("score"))
    flagged = evaluate.flag_anomalies(scores, scores.groupBy("task").agg(F.max("score").alias("threshold")), ["task"])
    assert "SortMergeJoin" not in _plan(flagged)
    cut = quantile.quantiles(scores, ["task"], "score", {"m": 0.5, "q": 0.95}, group_rows=100, slices=16)
    assert "BroadcastHashJoin" in _plan(cut)
    for row in cut.collect():
        values = np.array([r["score"] for r in scores.filter(F.col("task") == row["task"]).collect()])
        assert np.isclose(row["m"], np.quantile(values, 0.5)) and np.isclose(row["q"], np.quantile(values, 0.95))


def test_files_of_a_lake_are_opened_once(spark, tmp_path):
    from swarf.sources import files

    for k in range(3):
        (tmp_path / f"m{k}.csv").write_text("time;force_x\n0;1.5\n1;2.5\n")
    readings = files.read_delimited(spark, str(tmp_path))
    assert "FileScan text" not in _plan(readings) and readings.count() == 6
