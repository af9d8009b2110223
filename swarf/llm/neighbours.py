"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard, searched by beams."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarf.llm.common import checkpointed

SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
DEGREE, ROOM = 32, 64
BUILD_BEAM, SEARCH_BEAM, STEP = 72, 160, 4
RELAX = 1.2
BATCH = 256


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that gives all the same length, so that nearness and inner product agree."""
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    scale = np.sqrt(squares.max()) if len(squares) else 1.0
    extra = np.sqrt(np.maximum(squares.max() - squares, 0)) if len(squares) else squares
    return (np.column_stack([vectors, extra]) / scale).astype(np.float32)


def beam_search(links: np.ndarray, vectors: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, inner products) of the ``width`` best found for each query, best first; -1 where there are fewer.

    All queries of a block take a step together: each opens the links of its ``STEP`` best rows not yet opened.
    """
    n, size = len(queries), max(width, len(entries))
    ids = np.full((n, size), -1, np.int32)
    score = np.full((n, size), -np.inf, np.float32)
    opened = np.ones((n, size), bool)
    seen = np.zeros((n, len(vectors) + 1), bool)
    seen[:, -1] = True
    column = np.zeros((n, len(vectors) + 1), np.int16)
    row = np.arange(n)[:, None]
    ids[:, : len(entries)] = entries
    score[:, : len(entries)] = queries @ vectors[entries].T
    opened[:, : len(entries)] = False
    seen[:, entries] = True
    order = np.argsort(-score, 1, kind="stable")[:, :width]
    ids, score, opened = (np.take_along_axis(x, order, 1) for x in (ids, score, opened))
    while True:
        closed = np.cumsum(~opened, 1)
        pick = ~opened & (closed <= STEP)
        if not pick.any():
            return ids, score
        slot = np.where(pick.any(1)[:, None], np.argsort(~pick, 1, kind="stable")[:, :STEP], 0)
        chosen = np.where(np.take_along_axis(pick, slot, 1), np.take_along_axis(ids, slot, 1), -1)
        opened |= pick
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(n, -1)
        places = np.arange(near.shape[1], dtype=np.int16)[None, :]
        column[row, near] = places
        fresh = ~seen[row, near] & (column[row, near] == places)
        width_now = int(fresh.sum(1).max())
        if width_now == 0:
            continue
        front = np.argsort(~fresh, 1, kind="stable")[:, :width_now]
        near, fresh = np.take_along_axis(near, front, 1), np.take_along_axis(fresh, front, 1)
        near = np.where(fresh, near, -1)
        seen[row, near] = True
        found = np.where(fresh, np.matmul(vectors[near], queries[:, :, None])[:, :, 0], -np.inf)
        both = np.concatenate([score, found], 1)
        order = np.argsort(-both, 1, kind="stable")[:, :width]
        score = np.take_along_axis(both, order, 1)
        ids = np.take_along_axis(np.concatenate([ids, near], 1), order, 1)
        opened = np.take_along_axis(np.concatenate([opened, ~fresh], 1), order, 1)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE links per node: the nearest candidate, then the nearest that no chosen one covers, and so on.

    A chosen candidate covers another when it is RELAX times nearer to it than the node is.  ``candidates`` is padded
    with -1; repeats and the node itself are left out.
    """
    own = vectors[nodes]
    near = np.where(candidates >= 0, np.matmul(vectors[candidates], own[:, :, None])[:, :, 0], -np.inf)
    near[candidates == nodes[:, None]] = -np.inf
    order = np.argsort(-near, 1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    spread = vectors[candidates]
    away = 2.0 - 2.0 * near
    alive = np.isfinite(near)
    picked = np.full((len(nodes), DEGREE), -1, np.int32)
    row = np.arange(len(nodes))
    for k in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        first = np.where(some, alive.argmax(1), 0)
        picked[:, k] = np.where(some, candidates[row, first], -1)
        between = 2.0 - 2.0 * np.matmul(spread, spread[row, first][:, :, None])[:, :, 0]
        alive &= (RELAX * RELAX * between > away) & (candidates != picked[:, k][:, None])
        alive[row, first] = False
    return picked


def _link_back(links: np.ndarray, degree: np.ndarray, vectors: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add target -> source for every new link; a node whose room is full is pruned first."""
    while len(targets):
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        begin = np.flatnonzero(np.r_[True, targets[1:] != targets[:-1]])
        rank = np.arange(len(targets)) - np.repeat(begin, np.diff(np.r_[begin, len(targets)]))
        place = degree[targets] + rank
        fits = place < ROOM
        links[targets[fits], place[fits]] = sources[fits]
        np.maximum.at(degree, targets[fits], place[fits] + 1)
        full = np.unique(targets[~fits])
        for k in range(0, len(full), 4 * BATCH):
            part = full[k : k + 4 * BATCH]
            kept = robust_prune(vectors, part, links[part])
            links[part] = -1
            links[part, :DEGREE] = kept
            degree[part] = (kept >= 0).sum(1)
        sources, targets = sources[~fits], targets[~fits]


def build_graph(vectors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(links padded with -1, entry rows) over lifted vectors.

    Rows enter in random order and in batches: a beam search over the graph so far proposes neighbours, pruning keeps
    diverse ones, and every link is also tried backwards.
    """
    n = len(vectors)
    links, degree = np.full((n, ROOM), -1, np.int32), np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    done = min(n, BATCH)
    first = order[:done]
    links[first, :DEGREE] = robust_prune(vectors, first, np.tile(first, (done, 1)))
    degree[first] = (links[first] >= 0).sum(1)
    entries = first[:16]
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        found, _ = beam_search(links, vectors, entries, vectors[batch], BUILD_BEAM)
        picked = robust_prune(vectors, batch, np.concatenate([found, np.tile(batch, (len(batch), 1))[:, :BUILD_BEAM // 4]], 1))
        links[batch, :DEGREE] = picked
        degree[batch] = (picked >= 0).sum(1)
        source, place = np.nonzero(picked >= 0)
        _link_back(links, degree, vectors, batch[source], picked[source, place])
        done += len(batch)
    return links, entries


def _packed(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def halved(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled together by a power of two so that the largest component lies near 1; order of nearness stays."""
    most = np.abs(vectors).max(initial=0.0)
    return np.ldexp(vectors, -int(np.frexp(most)[1])) if most else vectors


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_id")
    plain = np.stack(pdf["_vector"].to_numpy()).astype(np.float64)
    vectors = lifted(halved(plain))
    links, entries = build_graph(vectors)
    members = pdf["_ids"].map(len).to_numpy()
    blob = _packed(plain=plain, vectors=vectors, links=links, entries=entries, members=members, ids=np.concatenate(pdf["_ids"].to_list()))
    return pd.DataFrame({"_shard": [pdf["_shard"].iloc[0]], "_graph": [blob]})


def _search_shard(k: int, width: int):
    def search(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(graphs) and len(queries):
            index = np.load(io.BytesIO(graphs["_graph"].iloc[0]))
            plain, vectors, links, members, ids = (index[x] for x in ("plain", "vectors", "links", "members", "ids"))
            begin = np.cumsum(members) - members
            asked, numbers, points = queries["_id"].to_numpy(np.int64), queries["_q"].to_numpy(np.int64), np.stack(queries["_vector"].to_numpy()).astype(np.float64)
            level = np.column_stack([np.stack([halved(p) for p in points]), np.zeros(len(points))]).astype(np.float32)
            for a in range(0, len(asked), BATCH):
                found, _ = beam_search(links, vectors, index["entries"], level[a : a + BATCH], width)
                found = found[:, : 2 * k]
                score = np.where(found >= 0, np.matmul(plain[found], points[a : a + BATCH][:, :, None])[:, :, 0], -np.inf)
                own = (plain[found] == points[a : a + BATCH][:, None, :]).all(-1) & (found >= 0)
                for i in range(len(found)):
                    rows = found[i][found[i] >= 0]
                    size = members[rows]
                    each = np.repeat(begin[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    near, value = ids[each], np.repeat(score[i, : len(rows)], size)
                    # the query itself is one row of the node with its vector; equal ids elsewhere are other rows
                    mine = np.flatnonzero((near == asked[a + i]) & np.repeat(own[i, : len(rows)], size))[:1]
                    near, value = np.delete(near, mine), np.delete(value, mine)
                    best = np.lexsort((near, -value))[:k]
                    parts.append((np.full(len(best), numbers[a + i]), np.full(len(best), asked[a + i]), near[best], value[best]))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [*[np.zeros(0, np.int64)] * 3, np.zeros(0)]
        return pd.DataFrame(dict(zip(("_q", "query_id", "vec_id", "score"), columns)))

    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _vector) of the rows that take part."""
    good = F.expr(f"`{vector_col}` IS NOT NULL AND `{id_col}` IS NOT NULL AND forall(`{vector_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(`{vector_col}`, x -> x != 0)")
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, width: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score.

    Every row is indexed.  Equal vectors are one node that keeps their k + 1 smallest ids, which is all an answer can
    need; they are gathered in slices first, so a very common vector never meets in one task.  Nodes are dealt by hash to
    shards of about SHARD_ROWS rows, the size of one task's graph; the queries are cut into blocks of QUERY_BLOCK, and each
    block searches each shard.  Answers of all shards are merged by exact score, ties to the smaller id.

    Rows with null id or vector, without any component other than 0, or with a null, NaN or infinite component take no
    part; vectors of another length form shards of their own; repeated ids are separate rows, each with ``k`` answers
    among all others, those of its id included; scores are double-precision products of the vectors as given; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    sliced = rows.select("*", F.xxhash64("_vector").alias("_code"), F.pmod(F.xxhash64("_id"), F.lit(64)).alias("_slice"))
    per_slice = Window.partitionBy("_code", "_vector", "_slice").orderBy("_id")
    few = sliced.withColumn("_nth", F.row_number().over(per_slice)).filter(F.col("_nth") <= k + 1)
    nodes = few.groupBy("_code", "_vector").agg(F.slice(F.sort_array(F.collect_list("_id")), 1, k + 1).alias("_ids"))
    nodes = checkpointed(nodes.select(F.col("_ids")[0].alias("_id"), "_ids", "_vector"))
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    placed = nodes.withColumn("_shard", F.concat_ws(":", F.size("_vector"), F.pmod(F.xxhash64("_id"), F.lit(shards))))
    graphs = checkpointed(placed.groupBy("_shard").applyInPandas(_index_shard, "_shard string, _graph binary"))
    # every query row has a number of its own, so repeated ids are answered one by one
    asked = checkpointed(rows.filter(F.col("_id") % every == 0)).withColumn("_q", F.monotonically_increasing_id())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("_q"), F.lit(blocks)).alias("_block")
    spread = asked.select("_id", "_q", "_vector", block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s")).withColumn("_shard", F.concat_ws(":", F.size("_vector"), F.col("_s"))).drop("_s")
    copies = graphs.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = copies.groupBy("_shard", "_block").cogroup(spread.groupBy("_shard", "_block")).applyInPandas(_search_shard(k, width), "_q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return search(vectors.select("vec_id", "embedding"))
