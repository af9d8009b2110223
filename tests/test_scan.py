"""Blocked scans and exact quantiles against brute force with tiny blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from series_rows import by_key
from swarf.operators import scan, series
from swarf.operators.quantile import quantiles
from swarf.operators.scan import order_blocks, ordered_index, running, seq_blocks

KEYS = ["series_id", "channel"]


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_running_matches_prefix_results(readings, arrays, rows):
    flagged = F.when(F.col("seq") % 5 == 2, F.col("value"))
    out = running(seq_blocks(readings, rows=rows), KEYS, ["seq"], index="i", sums={"total": F.col("value")}, lasts={"mark": flagged})
    totals, index, marks = by_key(out, "total"), by_key(out, "i"), by_key(out, "mark")
    for key, x in arrays.items():
        assert np.allclose(totals[key], np.cumsum(x))
        assert (index[key] == np.arange(len(x))).all()
        held, want = np.nan, []
        for i, v in enumerate(x):
            held = v if i % 5 == 2 else held
            want.append(held)
        assert np.allclose(marks[key].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("keys", [KEYS, []])
def test_index_over_several_blocks(readings, keys):
    out = ordered_index(readings, keys, ["seq", *KEYS], "i", rows=5).toPandas()
    groups = out.groupby(keys) if keys else [((), out)]
    for _, g in groups:
        assert sorted(g["i"]) == list(range(len(g)))
        assert g.sort_values(["seq", *KEYS])["i"].is_monotonic_increasing


def test_blocks_split_only_large_keys(readings):
    found = {r["series_id"]: r["b"] for r in order_blocks(readings, ["series_id"], ["seq"], rows=10).groupBy("series_id").agg(F.countDistinct("_block").alias("b")).collect()}
    assert found[1] > 5 and found[2] == 1


def test_bursts_constants_and_texts_give_bounded_blocks(spark):
    burst = spark.range(10_000).selectExpr("id", "cast(if(id < 10, id * 1000000, 500) AS long) AS at", "7 AS same", "concat('sample-', lpad(id, 7, '0')) AS name")
    for order in (["at", "id"], ["same", "id"], ["name"]):
        for keys in ([], ["same"]):
            sizes = [r["count"] for r in order_blocks(burst, keys, order, rows=100).groupBy("_block").count().collect()]
            assert sum(sizes) == 10_000 and max(sizes) < 250 and len(sizes) > 70
        placed = ordered_index(burst, [], order, "i", rows=100).toPandas().sort_values(order)
        assert (placed["i"].to_numpy() == np.arange(10_000)).all()


def test_two_levels_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(scan, "SLICES", 4)
    rows = spark.range(20_000).selectExpr("id", "cast(null AS int) AS k", "cast(id % 3 AS string) AS text")
    blocks = order_blocks(rows, [], ["k", "text", "id"], rows=70)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert blocks.selectExpr("_block div 1048576 AS s").distinct().count() > 30 and max(sizes) < 250
    spans = blocks.groupBy("_block").agg(F.min(F.struct("text", "id")).alias("lo"), F.max(F.struct("text", "id")).alias("hi")).orderBy("_block").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("rows", [4, 8, 1000])
@pytest.mark.parametrize("width", [1, 3, 4, 5])
def test_moving_average_over_block_borders(readings, arrays, rows, width):
    if width > rows:
        return
    smooth = by_key(series.moving_average(readings, width, rows=rows), "smooth")
    for key, x in arrays.items():
        want = np.convolve(x, np.ones(width) / width, "same")[: len(x)] if len(x) >= width else None
        if want is not None:
            assert np.allclose(smooth[key], want)


def test_first_difference_over_block_borders(readings, arrays):
    diffs = by_key(series.first_difference(readings, rows=4), "diff")
    for key, x in arrays.items():
        assert np.allclose(diffs[key], np.diff(x, prepend=x[:1]))


@pytest.mark.parametrize("group_rows,slices", [(10**6, 256), (3, 8), (0, 256)])
@pytest.mark.parametrize("method", ["linear", "floor"])
def test_quantiles_are_exact(readings, arrays, group_rows, slices, method):
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    out = quantiles(readings, KEYS, "value", wanted, method, group_rows, slices).collect()
    assert len(out) == len(arrays)
    for row in out:
        x = np.sort(arrays[(row["series_id"], row["channel"])])
        for name, q in wanted.items():
            want = np.quantile(x, q) if method == "linear" else x[int(q * (len(x) - 1))]
            assert np.isclose(row[name], want), (row, name, want)


def test_quantiles_without_keys(readings, arrays):
    x = np.concatenate(list(arrays.values()))
    for limit in (10**6, 2):
        assert np.isclose(quantiles(readings, [], "value", {"m": 0.5}, group_rows=limit, slices=16).first()["m"], np.median(x))
