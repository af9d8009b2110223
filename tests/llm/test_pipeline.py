import collections
import random
import zlib

import numpy as np
from plain_texts import brute_components, brute_leaks, words
from pyspark.sql import functions as F
from test_mixing_and_sharding import water

import __spark_entry__ as entry
import corpus_pipeline
from swarf.llm import queries, toxicity
from swarf.llm.mixing import fit_budget

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_keep_their_columns(spark, edge_docs, no_docs):
    docs, empty = edge_docs, no_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, SMALL).cache(), stage(spark, empty, SMALL)
        assert docs.columns == edge_docs.columns and empty.columns == edge_docs.columns and empty.count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert placed.count() == docs.count() > 0


def written_tables(spark, folder):
    """Tables of the smallest scale with near copies, repeated rows, leaks and odd rows among the documents."""
    rng = random.Random(6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [r.asDict() for r in docs.collect()]
    passages = [t for t in (r.text for r in items.collect()) if t and len(t.split()) >= 12]
    planted = []
    for k, r in enumerate(rng.sample([r for r in rows if len((r["text"] or "").split()) > 60], 12)):
        w = r["text"].split()
        w[len(w) // 2] = "edited"
        planted += [{**r, "doc_id": 90_000 + k, "text": " ".join(w)}, dict(r)]
    planted += [{**rows[k], "doc_id": 91_000 + k, "text": f"before {p} after"} for k, p in enumerate(passages[:8])]
    planted += [{**rows[0], "doc_id": 92_000 + k, "text": t, "source": s} for k, (t, s) in enumerate([(None, "a"), ("", None), (" \t", None), ("few words", None), ("few words", "a")])]
    spark.createDataFrame(rows + planted, docs.schema).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return rows + planted, [(r.item_id, r.text) for r in items.collect()]


def test_pipeline_like_plain_decisions(spark, tmp_path):
    rows, items = written_tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    # toxicity: the classifier's scores are given
    scores = {(r.doc_id, r.crc): r.score for r in scored(spark, str(tmp_path)).collect()}
    crc = lambda r: zlib.crc32((r["text"] or "").encode())
    left = [r for r in rows if scores[r["doc_id"], crc(r)] < 0.3]
    assert 0 < len(left) < len(rows)
    # near copies: the smallest id of each component, one row of it
    found, kept, seen = brute_components([(r["doc_id"], r["text"]) for r in left]), [], set()
    for r, (doc_id, size, first) in zip(left, found):
        if not size or (doc_id == first and first not in seen):
            kept.append(r)
            seen |= {first} if size else set()
    assert len(kept) <= len(left) - 24
    # leaks
    leaked = {doc_id for doc_id, _ in brute_leaks([(r["doc_id"], r["text"]) for r in kept], items)}
    clean = [r for r in kept if r["doc_id"] not in leaked]
    assert any(i >= 91_000 for i in leaked)
    # mixing: whole rounds, and as many of each source and size as the budget fitting takes
    cells = collections.defaultdict(lambda: collections.Counter())
    for r in clean:
        cells[r["source"]][len(words(r["text"]))] += 1
    order = sorted(s for s in cells if s is not None) + [None] * (None in cells)
    whole = {s: sum(n * c for n, c in cells[s].items()) for s in order}
    targets = water([whole[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])
    copies = collections.Counter(zip(got.doc_id, got["size"], got.text_crc32))
    assert set(copies) <= {(r["doc_id"], len((r["text"] or "").encode()) + 1, crc(r)) for r in clean}
    for s, target in zip(order, targets):
        rounds = int(target // whole[s]) if whole[s] else 0
        sizes = np.array(sorted(n for n in cells[s] if n))
        picked = dict(zip(sizes.tolist(), fit_budget(sizes, np.array([cells[s][n] for n in sizes]), int(round(target)) - rounds * whole[s]).tolist()))
        for n, count in cells[s].items():
            taken = [copies[r["doc_id"], len((r["text"] or "").encode()) + 1, crc(r)] - rounds for r in clean if r["source"] == s and len(words(r["text"])) == n]
            assert set(taken) <= {0, 1} and sum(taken) == picked.get(n, 0)
    # sharding: in the order of shards and slots, a row belongs to the equal part of all bytes in which it begins
    placed = got.sort_values(["shard", "slot"])
    begin = placed["size"].cumsum() - placed["size"]
    assert (placed["shard"] == begin * 8 // placed["size"].sum()).all()
    assert (placed["slot"] == placed.groupby("shard").cumcount()).all()


def scored(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    named = toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return named.select("_row.doc_id", F.crc32(F.coalesce("_row.text", F.lit("")).cast("binary")).alias("crc"), F.col("_score").alias("score"))
