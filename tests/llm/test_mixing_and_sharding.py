import itertools
import random
import re
import zlib

import numpy as np
from llm_rows import make

from swarf.llm import mixing, sharding


def water(sizes, weights, most=3):
    """Targets by repeated resharing, with the sources stopped so far."""
    target, total = {}, sum(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        rest = total - sum(target.values())
        over = [i for i in open_ if rest * weights[i] / sum(weights[j] for j in open_) > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / sum(weights[j] for j in open_)
            break
        target |= {i: most * sizes[i] for i in over}
        open_ -= set(over)
    return [target[i] for i in range(len(sizes))]


def test_budget_is_met_like_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        budget = rng.randint(0, int((sizes * counts).sum()))
        take = mixing.fit_budget(sizes, counts, budget)
        reach = max(s for s in {sum(a * b for a, b in zip(c, sizes)) for c in itertools.product(*[range(n + 1) for n in counts])} if s <= budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * sizes).sum()) == reach


def test_mix(spark, edge_docs, edge_rows):
    got = mixing.op1_mix(edge_docs).toPandas()
    assert len(got) == len(edge_rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {"": 0}
    for _, t, s in edge_rows:
        source[s] = source.get(s, 0) + size(t)
    source.pop("")
    order = sorted((s for s in source if s is not None)) + [None]
    target = dict(zip(order, water([source[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    for doc_id, t, s in edge_rows:
        if doc_id is not None:
            row = got[got.doc_id == doc_id].iloc[0]
            assert row["size"] == size(t) and row.source_size == source[s] and abs(row.target - target[s]) < 1e-6 * max(target[s], 1)
            assert row.taken <= 3 * row["size"]
    assert (got["taken"] == got["size"] * got["copies"]).all()
    again = mixing.op1_mix(edge_docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_mix_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.op1_mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).toPandas()
    assert (abs(got["sum(taken)"] - got["max(target)"]) <= 0.01 * got["max(target)"] + 2).all()


def test_mixed_documents(spark, edge_docs, no_docs):
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == mixing.op1_mix(edge_docs).agg({"copies": "sum"}).first()[0]
    assert mixing.op1_mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_rows_of_one_id_are_chosen_by_text(spark):
    rows = [(1, f"t{k} same size", "a") for k in range(30)] + [(2, "other words of another source " * 9, "b")]
    chosen = lambda parts: sorted(r.text for r in mixing.mixed_documents(make(spark, rows).repartition(parts)).collect())
    assert len({str(chosen(parts)) for parts in (1, 3, 7)}) == 1


def test_shards(spark, edge_docs, edge_rows, no_docs):
    got = sharding.op8_shard(edge_docs).toPandas()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in edge_rows)
    assert sorted(zip(got["size"].tolist(), got["text_crc32"].tolist())) == want
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert set(got["shard"]) <= set(range(8)) and got["grown_shard"].isna().all()
    assert sharding.op8_shard(no_docs).count() == 0
    full = sharding.shard(edge_docs)
    assert set(edge_docs.columns) <= set(full.columns) and full.count() == len(edge_rows)


def test_shards_are_even_with_a_hot_text(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE repeat(concat('t', id), 1 + id % 50) END AS text")
    got = sharding.op8_shard(rows).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * got["size"].max()
    hot = got[got["size"] == len("the same text") + 1]
    assert hot["shard"].nunique() < 8  # equal texts are neighbours
    again = sharding.op8_shard(rows.repartition(7)).toPandas()
    assert (got.sort_values("doc_id")["shard"].to_numpy() == again.sort_values("doc_id")["shard"].to_numpy()).all()


def test_overfull_ranges_are_subdivided(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.lit(7).cast("long").alias("_hash"), F.xxhash64("id").alias("_tie"), F.lit(1 / 20_000).alias("_weight"))
    found = sharding.splitters(keys, 16, 2, 1)
    counts = keys.groupBy(sharding._range_of(found).alias("r")).count().toPandas()["count"]
    assert counts.max() <= 2 * 20_000 / 16 + 1
