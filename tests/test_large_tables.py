"""Plans and pieces that decide whether a query grows with its input."""

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_study_rows_are_derived_and_written_once(spark):
    from swarf.operators import models
    from swarf.queries import learning
    from swarf.sources.tables import Tables

    for rows in learning._study_frames(Tables(spark, SF)):
        assert "Window" not in _plan(rows) and "lineitem" not in _plan(rows) and len(rows.columns) < 15
    scored = models.apply_grouped(spark.range(9).selectExpr("id", "id * 2.0D AS x"), spark.sql("SELECT array(3.0D) AS weights, array(1.0D) AS centers, array(2.0D) AS scales, 5.0D AS intercept"), [], ["x"], "p")
    assert "lambda" not in _plan(scored) and [r["p"] for r in scored.orderBy("id").collect()] == [5 + (2 * i - 1) / 2 * 3 for i in range(9)]


def test_short_series_are_not_dealt_out(spark):
    from swarf.operators import fourier

    df = spark.range(3000).selectExpr("id % 30 AS series_id", "'a' AS channel", "id div 30 AS seq", "sin(id) AS value")
    whole = fourier.spectrum_features(df, 50.0)
    assert "FlatMapGroupsInPandas" not in _plan(whole) and whole.count() == 30
    mixed = df.filter("series_id % 3 = 0 OR seq < 50")  # series of 100 and of 50 readings, on both sides of the limit
    key, both = ["series_id", "channel"], [fourier.spectrum_features(mixed, 50.0, block=b).toPandas() for b in (64, 1 << 16)]
    dealt, arrays = (f.sort_values(key).set_index(key) for f in both)
    assert len(dealt) == 30 and np.allclose(dealt[arrays.columns].to_numpy(), arrays.to_numpy())


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e160])
def test_blocks_measured_by_products_are_exact(scale):
    """Random vectors on a grid of few values (many ties), far from zero, and ids beyond the whole numbers a double holds."""
    import pandas as pd

    from swarf.operators import metric

    rng = np.random.default_rng(5)
    points, wanted = ((rng.integers(0, 3, (n, 6)) + 1000.0) * scale for n in (300, 70))
    ids = (1 << 60) + rng.permutation(300)
    far = np.sqrt(((wanted[:, None] - points) ** 2).sum(axis=2))
    frame = lambda x, **more: pd.DataFrame({"embedding": list(x), "_d": [np.zeros(1)] * len(x), **more})
    found = metric._measure(4, [])(frame(wanted, id=np.arange(70), _limit=np.inf), frame(points, id=ids))
    for q in range(70):
        mine = found[found["id"] == q]
        best = np.lexsort((ids, far[q]))[:4]
        assert mine["support_id"].tolist() == ids[best].tolist() and mine["distance"].tolist() == far[q][best].tolist()
    assert found["measured"].sum() == 70 * 300
    closed = metric._measure(4, [])(frame(wanted, id=np.arange(70), _limit=-1.0), frame(points, id=ids))
    assert len(closed) == 70 and closed["support_id"].isna().all() and closed["measured"].sum() == 0


def test_a_block_is_measured_at_once():
    """Rows measured one by one are the few that a product puts near the best."""
    from swarf.operators import metric

    rng = np.random.default_rng(6)
    points, wanted = rng.normal(size=(4000, 64)), rng.normal(size=(50, 64))
    i, _ = metric._candidates(wanted, points, np.full(50, np.inf), np.ones((50, 4000), bool), 3)
    assert len(i) == 150


def test_words_of_control_programs_are_found_once_per_line(spark):
    from swarf.operators import nc

    texts = ["N1 G1 X2 (a) F3", "(all) G2", "M3; G9 (b", "Y1 (c; d) Z2", "", "% O1", "G0 X-.5"]
    lines = spark.createDataFrame([(p, i, t) for p in (1, 2) for i, t in enumerate(texts)], "program_id long, line_no long, text string")
    for made in (nc.nc_vector(lines), nc.nc_block_matrix(lines)):
        assert "regexp" not in _plan(made)
    blocks = {r["line_no"]: r["block"] for r in nc.nc_blocks(lines).filter("program_id = 1").collect()}
    assert blocks == {0: "N1 G1 X2   F3", 1: "G2", 2: "M3", 3: "Y1   Z2", 6: "G0 X-.5"}
    rows = nc.nc_block_matrix(lines).filter("program_id = 1").orderBy("row").collect()
    # words in a comment count here, a line that starts with one does not
    assert [(r["row"], r["values"][0], r["values"][5]) for r in rows] == [(0, 0.01, 0.002), (1, 0.01, 0.0), (2, 0.01, 0.0), (3, 0.01, 0.0), (4, 0.0, -0.0005)]
