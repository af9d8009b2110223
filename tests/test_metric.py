"""Exact neighbours and weighted means in blocks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarf.operators import fewshot, metric

SCHEMA = "id long, embedding array<double>, label double, extra string"


def brute(x, ids, point, k):
    far = np.sqrt(((x[ids] - point) ** 2).sum(axis=1))
    return ids[np.lexsort((ids, far))[:k]].tolist()


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors in twelve clusters, one of which holds a third; copies of one vector make ties."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 6
    member = np.where(rng.random(2000) < 0.33, 0, rng.integers(0, 12, 2000))
    x = centres[member] + rng.normal(size=(2000, 8))
    x[1001:1031] = x[1000]
    return x, spark.createDataFrame([(i, r.tolist(), float(i % 7), "e") for i, r in enumerate(x)], SCHEMA).cache()


@pytest.mark.parametrize("rows", [60, 4096])
def test_neighbours_are_exact_and_most_pairs_unmeasured(clustered, rows):
    x, df = clustered
    ids = np.array([i for i in range(2000) if i % 5])
    found = metric.nearest(df.filter("id % 5 = 0"), df.filter("id % 5 <> 0"), 5, ["label"], rows=rows).collect()
    assert len(found) == 400
    for row in found:
        assert [n.support_id for n in row.neighbors] == brute(x, ids, x[row.id], 5)
        assert [n.label for n in row.neighbors] == [float(n.support_id % 7) for n in row.neighbors]
    assert sum(r.measured for r in found) < 0.5 * 400 * len(ids)


def test_small_and_broken_supports(spark):
    rows = [(1, [0.0, 0.0], 1.0, "a"), (2, [1.0, 0.0], 2.0, "a"), (3, None, 3.0, "a"), (4, [None, 1.0], 4.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.id: r.neighbors for r in metric.nearest(df, df, 5).collect()}
    assert [n.support_id for n in found[2]] == [2, 1] and found[3] is None and found[4] is None
    assert all(r.neighbors is None for r in metric.nearest(df, df.limit(0), 3).collect())
    assert metric.nearest(df.limit(0), df, 3).count() == 0
    with pytest.raises(ValueError):
        metric.nearest(df, df, 0)


def test_weighted_means_over_all_rows(clustered):
    x, df = clustered
    support, query = df.filter("id % 5 <> 0").withColumn("v", F.slice("embedding", 1, 3)), df.filter("id % 50 = 0")
    ids = np.array([i for i in range(2000) if i % 5])
    for row in metric.weighted_means(query, support, "v", "m", rows=150).collect():
        w = 1 / (np.sqrt(((x[ids] - x[row.id]) ** 2).sum(axis=1)) + 1e-8)
        assert np.allclose(row.m, w @ x[ids][:, :3] / w.sum())
    assert metric.weighted_means(query, support.limit(0), "v", "m").filter("m IS NOT NULL").count() == 0


def test_regression_takes_the_whole_support(clustered):
    """More than twenty support rows decide."""
    x, df = clustered
    ids = np.array([i for i in range(2000) if i % 5])
    for row in fewshot.knn_predict(df.filter("id % 100 = 0"), df.filter("id % 5 <> 0"), 3).collect():
        near = np.array(brute(x, ids, x[row.id], 3))
        w = 1 / (np.sqrt(((x[near] - x[row.id]) ** 2).sum(axis=1)) + 1e-8)
        assert np.isclose(row.prediction, w @ (near % 7) / w.sum())
