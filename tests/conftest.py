import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from swarf.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "tests", small_partitions=True)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def readings(spark):
    """Two channels with ties, one short channel: (series_id, channel, seq, value)."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(s, c, i, float(np.round(rng.normal(), 1))) for s, c, n in ((1, "vx", 37), (1, "rpm", 53), (2, "vx", 3)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id int, channel string, seq long, value double").cache()


@pytest.fixture(scope="session")
def arrays(readings):
    import numpy as np

    pdf = readings.toPandas().sort_values(["series_id", "channel", "seq"])
    return {k: np.asarray(g["value"]) for k, g in pdf.groupby(["series_id", "channel"])}
