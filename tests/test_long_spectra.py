"""Whole long series: transforms and frame moments over many tasks against one pass of NumPy."""

import numpy as np
import pytest

from swarf.functions import spectra
from swarf.operators import fourier, spectral

SERIES = "series_id int, channel string, seq long, value double"


def rows_of(spark, arrays):
    return spark.createDataFrame([(s, "a", k, float(v)) for s, x in arrays.items() for k, v in enumerate(x)], SERIES)


@pytest.mark.parametrize("block", [4, 64, 1 << 16])
def test_spectrum_of_any_length_equals_numpy(spark, block):
    rng = np.random.default_rng(1)
    arrays = {n: rng.normal(size=n) for n in (1, 2, 3, 8, 97, 100, 256)}
    got = fourier.spectrum(rows_of(spark, arrays), block=block).toPandas().sort_values("pos")
    for n, x in arrays.items():
        part = got[got["series_id"] == n]
        want = np.fft.rfft(x)
        assert part["pos"].to_list() == list(range(len(want)))
        assert np.allclose(part["re"] + 1j * part["im"], want, atol=1e-9)


def test_long_series_in_blocks_of_bounded_arrays(spark):
    n = 1 << 20
    df = spark.range(n).selectExpr("1 AS series_id", "'a' AS channel", "id AS seq", "sin(id * 0.37D) + (id % 7) / 5.0D + (id * 7919 % 1013) / 1013.0D AS value")
    k = np.arange(n)
    want = np.fft.rfft(np.sin(k * 0.37) + (k % 7) / 5.0 + (k * 7919 % 1013) / 1013.0)
    got = fourier.spectrum(df, block=1 << 14).toPandas().sort_values("pos")
    assert len(got) == len(want) and np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - want).max() < 1e-6


def test_features_equal_those_of_arrays(spark):
    rng = np.random.default_rng(2)
    df = rows_of(spark, {n: rng.normal(size=n) for n in (5, 64, 130)})
    by = ["series_id", "channel"]
    plain = spectral.dft_features(df, 50.0).toPandas().sort_values(by).set_index(by)
    long = fourier.spectrum_features(df, 50.0, block=16).toPandas().sort_values(by).set_index(by)
    assert np.allclose(long[plain.columns].to_numpy(), plain.to_numpy())


@pytest.mark.parametrize("rows", [128, 512, 4096])
def test_frame_moments_merge_over_blocks(spark, rows):
    rng = np.random.default_rng(3)
    arrays = {1: rng.normal(size=10_000), 2: rng.normal(size=128), 3: rng.normal(size=40), 4: rng.normal(size=rows + 64)}
    got = {r["series_id"]: np.array(r["summary"]) for r in spectral.stft_summary(rows_of(spark, arrays), rows=rows).collect()}
    for s, x in arrays.items():
        assert np.allclose(got[s], spectra.frame_stats(x), atol=1e-9)
