import zlib

import numpy as np
import pytest
from llm_rows import make
from pyspark.sql import functions as F

from swarf.llm import neighbours, sharding, toxicity


@pytest.mark.parametrize("kind", ["float", "double"])
def test_repeated_query_ids_get_full_answers(spark, kind):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8))
    data = data.astype(np.float32).astype(float) if kind == "float" else data
    rows = [(k + 1, v.tolist()) for k, v in enumerate(data)]
    rows += [(20, rows[19][1]), (40, rng.normal(size=8).astype(np.float32).tolist()), (5, rows[6][1])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = neighbours.op9_neighbours(frame).toPandas()
    vectors = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    want = []
    for q, (i, v) in enumerate(rows):
        if i % 20 == 0:
            score = vectors @ np.array(v)
            order = [k for k in np.lexsort((ids, -score)) if k != q][:20]
            want += [(i, r, int(ids[k]), round(float(score[k]), 9)) for r, k in enumerate(order, 1)]
    assert len(got) == len(want)
    found = [(a, b, c, round(d, 9)) for a, b, c, d in zip(got["query_id"], got["rank"], got["vec_id"], got["score"])]
    assert len(set(found) & set(want)) >= 0.97 * len(set(want))


def test_training_sample_is_bounded_for_repeated_ids(spark):
    kept = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = make(spark, [(kept[0], f"text {k}", "a") for k in range(300)] + [(k, f"other {k}", "a") for k in kept])
    labels = spark.createDataFrame([(k, int(k % 2)) for k in kept], "doc_id long, toxic int")
    drawn = toxicity.sample(docs, labels, 1000).groupBy("doc_id").count().collect()
    assert len(drawn) == len(kept) and all(r["count"] == 1 for r in drawn)
    assert toxicity.sample(docs, labels, 5).count() == 10


def test_ranges_are_cut_into_blocks(spark, monkeypatch):
    from swarf.operators import scan

    monkeypatch.setattr(scan.order_blocks, "__defaults__", (50,))
    docs = make(spark, [(k, "x" * (k % 40) if k % 3 else "same text", "a") for k in range(3000)])
    got = sharding.digest(sharding.shard(docs, ranges=4, keep=["doc_id"])).toPandas()
    assert len(got) == 3000 and set(got["doc_id"]) == set(range(3000))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * 41
    plain = sharding.op8_shard(docs.withColumn("text", F.col("text"))).toPandas()
    assert plain.groupby("shard")["size"].sum().max() - plain.groupby("shard")["size"].sum().min() <= 2 * 41
