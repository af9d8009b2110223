"""Registered queries against their SQL twins and plan shape checks.

A spread of queries runs by default; ``SWARF_ALL_QUERIES=1`` runs all of them.
"""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "time_features_cut", "robust_scale", "sliding_windows", "rotation_angle", "horizon_targets", "channel_graph", "signal_channels",
    "describe_inventory", "version_snapshot", "encode_tokens", "nc_vector", "dft_features", "tool_life_features", "chronological_split",
    "conformal_threshold", "as_of_join", "knn_class", "calibrator", "augment_frequency", "pad_batches",
]
NAMES = list(entry.queries()) if os.environ.get("SWARF_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    assert (oracle.compare(df, con, sql) if sql else "" if df.count() else "no rows") == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
