import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_rows import make  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank, short, very long and repeated texts, ties, non-ASCII, repeated rows."""
    rng = random.Random(4)
    words = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, base = prose(30_000), prose(120)
    edited = base.split()
    edited[60] = "changed"
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "One", "b"), (6, "a b c d", None), (None, prose(40), "a"), (None, None, None)]
    rows += [(10, base, "a"), (11, base, "c"), (12, " ".join(edited), "c"), (12, " ".join(edited), "c"), (13, long, "b"), (14, "tie " * 50, "é"), (15, "tie " * 50, "é")]
    rows += [(20 + k, prose(rng.randint(1, 90)), rng.choice(["a", "b", "c", None])) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return make(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [(1, "x", "a")]).limit(0)
