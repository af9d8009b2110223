"""Exact neighbours and distance-weighted means of a stated query set over a support of any size.

Both sides have ``id`` (unique, not null) and ``embedding``; rows without an embedding take no part as support and get a
null answer as a query.  No side is packed into one value: support and queries meet in bounded blocks.

Neighbours use a metric index.  A few support rows serve as pivots; each support row belongs to the cell of its nearest
pivot, and cells are cut into blocks at quantiles of the distance to it.  By the triangle inequality a block, and then a
single row, whose pivot distances differ from the query's by more than the k-th best distance so far cannot hold a
neighbour and is not measured.  Where these bounds leave most rows of a block open, as with random vectors, whole blocks are
measured by a matrix product, and only rows it puts within rounding of the k best are measured again, one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.functions.vectors import as_doubles, euclidean
from swarf.operators.lineage import checkpointed
from swarf.operators.scan import BLOCK, order_blocks

#: Pivots, rows of one block, and queries that meet a block at a time.
PIVOTS, BLOCK_ROWS, CHUNK_ROWS = 16, 4096, 4096
#: Copies of the block table, so that the few cells spread over many tasks.
SALTS = 64
#: Queries of a chunk taken at a time, and every how manieth row of a block tells whether row bounds pay.
STEP, SAMPLED = 256, 32


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in rows])


def _portions(df: DataFrame, rows: int) -> Column:
    """How many portions of ``rows`` rows the frame makes, at least one, known when the plan runs."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("n")).scalar()


def _usable(df: DataFrame, *extra: str) -> DataFrame:
    held = df.select("id", as_doubles("embedding").alias("embedding"), *extra)
    return held.filter("id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, v -> v IS NOT NULL)")


def _open(query_pivots: np.ndarray, to_pivots: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Per query and row, whether their pivot distances leave room for a distance within the query's limit."""
    low = np.zeros((len(query_pivots), len(to_pivots)))
    for j in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(query_pivots[:, j, None] - to_pivots[None, :, j]), out=low)
    return low <= limits[:, None]


def _candidates(wanted: np.ndarray, points: np.ndarray, limits: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) among which are the ``k`` nearest open rows of each query that lie within its limit.

    One matrix product gives all squared distances up to rounding; what lies beyond the k-th by more than the rounding can
    make is left out.  Values too large for the product, or not finite, leave all open rows.
    """
    rows = np.flatnonzero(near.any(axis=0))
    with np.errstate(over="ignore"):
        left, right = (wanted**2).sum(axis=1), (points[rows] ** 2).sum(axis=1)
    if not len(rows) or not np.isfinite(left.max() + right.max()) or left.max() + right.max() > 1e300:
        return np.nonzero(near)
    square = left[:, None] + right - 2.0 * (wanted @ points[rows].T)
    square[~near[:, rows]] = np.inf
    slack = 8.0 * (points.shape[1] + 8) * np.finfo(float).eps * (left + right.max())
    reach = limits**2 + slack
    found = square <= reach[:, None]
    if found.sum() > 4 * k * len(wanted):
        kth = np.partition(square, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        found &= square <= (kth + 2 * slack)[:, None]
    i, j = np.nonzero(found & np.isfinite(square))
    return i, rows[j]


def _measure(k: int, payload: Sequence[str]):
    """Task code: the ``k`` nearest rows of one block for each query of a chunk, within the query's limit."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "measured", "distance", "support_id", *payload]
        if asked.empty or held.empty:
            return pd.DataFrame(columns=columns)
        held = held.rename(columns=lambda c: c.removeprefix("held")).sort_values("id", kind="stable")
        points, to_pivots = _matrix(held["embedding"]), _matrix(held["_d"])
        wanted, query_pivots, limits = _matrix(asked["embedding"]), _matrix(asked["_d"]), asked["_limit"].to_numpy(float)
        who, chosen, distances, measured = [], [], [], []
        some = np.arange(0, len(points), SAMPLED)
        for start in range(0, len(asked), STEP):
            part = slice(start, start + STEP)
            limit = limits[part]
            near = _open(query_pivots[part], to_pivots[some], limit)
            # bounds that save little cost more than the products they would save
            near = np.ones((len(limit), len(points)), bool) if near.mean() > 0.5 else _open(query_pivots[part], to_pivots, limit)
            i, j = _candidates(wanted[part], points, limit, near, k)
            far = np.sqrt(((points[j] - wanted[part][i]) ** 2).sum(axis=1))
            order = np.lexsort((j, far, i))
            i, j, far = i[order], j[order], far[order]
            counts = np.bincount(i, minlength=len(limit))
            rank = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            i, j, far, rank = (v[rank < k] for v in (i, j, far, rank))
            # a query without a row still reports how many it measured
            none = np.flatnonzero(counts == 0)
            opened = near.sum(axis=1)
            who += [start + i, start + none]
            measured += [np.where(rank == 0, opened[i], 0), opened[none]]
            chosen += [j, np.full(len(none), -1)]
            distances += [far, np.full(len(none), np.nan)]
        who, measured, chosen, distances = (np.concatenate(v) for v in (who, measured, chosen, distances))
        # whole numbers and nulls in one column, without a detour over floating point
        found = held[["id", *payload]].rename(columns={"id": "support_id"}).iloc[np.maximum(chosen, 0)].reset_index(drop=True).astype(object)
        found[chosen < 0] = None
        found.insert(0, "distance", distances)
        found.insert(0, "measured", measured)
        found.insert(0, "id", asked["id"].to_numpy()[who])
        return found[columns]

    return run


def _visit(visits: DataFrame, support: DataFrame, k: int, payload: Sequence[str]) -> DataFrame:
    """The best rows of every visited block: (id, measured, distance, support_id, …)."""
    place = ["_cell", BLOCK, "_chunk"]
    # a block travels only to the chunks of queries that visit it
    brought = support.join(visits.select(*place).distinct(), ["_cell", BLOCK]).select(*place, "id", "embedding", "_d", *payload)
    brought = brought.select(*[F.col(c).alias(f"held{c}") for c in brought.columns])  # names apart from the queries' own
    kinds = {f.name: f.dataType for f in support.schema.fields}
    schema = T.StructType(
        [T.StructField("id", dict((f.name, f.dataType) for f in visits.schema.fields)["id"]), T.StructField("measured", T.LongType()), T.StructField("distance", T.DoubleType()),
         T.StructField("support_id", kinds["id"]), *[T.StructField(p, kinds[p]) for p in payload]]
    )
    return visits.groupBy(*place).cogroup(brought.groupBy(*[f"held{c}" for c in place])).applyInPandas(_measure(k, payload), schema)


def _limit(distance: Column) -> Column:
    """The distance with room for rounding, so that the bounds never lose a row."""
    return distance * (1 + 1e-9) + 1e-12


def nearest(query: DataFrame, support: DataFrame, k: int, payload: Sequence[str] = (), pivots: int = PIVOTS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query with ``neighbors``, its ``k`` nearest support rows by distance, then id (all, if fewer), and ``measured``.

    ``measured`` counts the support rows whose distance to the query was calculated, pivots not counted.  Exact for any
    data; how much the bounds save depends on it.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    payload = list(payload)
    held = _usable(support, *payload)
    some = held.orderBy(F.xxhash64("id"), "id").limit(pivots).agg(F.collect_list("embedding").alias("p"))
    distances = F.transform("_p", lambda p: euclidean(F.col("embedding"), p))
    placed = held.withColumn("_p", some.scalar()).withColumn("_d", distances).drop("_p")
    placed = placed.withColumn("_r", F.array_min("_d")).withColumn("_cell", F.array_position("_d", F.col("_r")).cast("int"))
    placed = checkpointed(order_blocks(placed, ["_cell"], ["_r", "id"], rows))  # read by the block table and by both visits

    edges = lambda pick: F.array(*[pick(F.get("_d", F.lit(j))) for j in range(pivots)])
    blocks = placed.groupBy("_cell", BLOCK).agg(edges(F.min).alias("_low"), edges(F.max).alias("_high"))
    asked = _usable(query).withColumn("_p", some.scalar()).withColumn("_d", distances).drop("_p")
    # pivots are support rows, so the k-th nearest of them bounds the k-th neighbour
    bound = F.coalesce(F.get(F.array_sort("_d"), F.lit(k - 1)), F.lit(float("inf")))
    asked = asked.withColumns({"_limit": _limit(bound), "_chunk": F.pmod(F.xxhash64("id"), _portions(query, CHUNK_ROWS)).cast("int")})
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SALTS)).cast("int"))
    copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gaps = F.array(*[F.greatest(F.get("_d", F.lit(j)) - F.get("_high", F.lit(j)), F.get("_low", F.lit(j)) - F.get("_d", F.lit(j))) for j in range(pivots)])
    cells = asked.withColumn("_cell", F.explode(F.sequence(F.lit(1), F.size("_d")))).filter("size(_d) > 0")
    visits = cells.join(copies, ["_cell", "_salt"]).withColumn("_gap", F.greatest(F.lit(0.0), F.array_max(gaps))).filter("_gap <= _limit")
    visits = visits.select("id", "embedding", "_d", "_limit", "_chunk", "_cell", BLOCK, "_gap")

    # the closest block first: it gives most queries their final limit
    order = F.struct("_gap", F.get("_d", F.col("_cell") - 1), "_cell", BLOCK)
    home = visits.groupBy("id").agg(F.min_by(F.struct("_cell", BLOCK), order).alias("_home"))
    homes = home.select("id", "_home.*").join(asked, "id")
    first = checkpointed(_visit(homes.select("id", "embedding", "_d", "_limit", "_chunk", "_cell", BLOCK), placed, k, payload))
    reached = first.groupBy("id").agg(F.count("distance").alias("_n"), F.max("distance").alias("_far"))
    tight = F.when(F.col("_n") >= k, F.least("_limit", _limit(F.col("_far")))).otherwise(F.col("_limit"))
    rest = visits.join(home, "id").join(reached, "id").withColumn("_limit", tight)
    rest = rest.filter((F.col("_gap") <= F.col("_limit")) & (F.struct("_cell", BLOCK) != F.col("_home")))
    second = _visit(rest.select("id", "embedding", "_d", "_limit", "_chunk", "_cell", BLOCK), placed, k, payload)

    found = first.unionByName(second)
    counts = found.groupBy("id").agg(F.sum("measured").alias("measured"))
    ranked = found.filter("support_id IS NOT NULL").withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("distance", "support_id"))).filter(F.col("_k") <= k)
    lists = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "support_id", *payload))).alias("neighbors"))
    return query.join(lists, "id", "left").join(counts, "id", "left")


def _weigh(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Task code: for each query of a chunk the sum of weights and of weighted values over one block."""
    points, values, wanted = _matrix(held["embedding"]), _matrix(held["_v"]), _matrix(asked["embedding"])
    sums = np.empty((len(wanted), values.shape[1] + 1))
    for i, point in enumerate(wanted):
        weights = 1.0 / (np.sqrt(((points - point) ** 2).sum(axis=1)) + 1e-8)
        sums[i, 0], sums[i, 1:] = weights.sum(), weights @ values
    return pd.DataFrame({"id": asked["id"].to_numpy(), "sums": list(sums)})


def weighted_means(query: DataFrame, support: DataFrame, values: str, output: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``output``: the mean of an array column over all support rows, weighted by inverse distance.

    Every query meets every block of ``rows`` support rows once, because every row has a weight.  Sums of blocks are
    added position by position, so no task gathers the blocks of a query.  Arrays must have one length; a null array or
    one with null entries takes no part.
    """
    held = _usable(support, as_doubles(values).alias("_v")).filter("_v IS NOT NULL AND forall(_v, v -> v IS NOT NULL)")
    asked = _usable(query)
    blocks, chunks = _portions(held, rows), _portions(asked, CHUNK_ROWS)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = held.withColumns({"_b": F.pmod(F.xxhash64("id"), blocks).cast("int"), "_c": numbers(chunks)})
    asked = asked.withColumns({"_c": F.pmod(F.xxhash64("id"), chunks).cast("int"), "_b": numbers(blocks)})
    schema = T.StructType([T.StructField("id", query.schema["id"].dataType), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    task = lambda a, h: _weigh(a, h) if len(a) and len(h) else pd.DataFrame(columns=["id", "sums"])
    parts = asked.groupBy("_b", "_c").cogroup(held.groupBy("_b", "_c")).applyInPandas(task, schema)
    added = parts.select("id", F.posexplode("sums").alias("pos", "v")).groupBy("id", "pos").agg(F.sum("v").alias("v"))
    whole = added.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("_s"))
    means = F.transform(F.slice("_s", 2, F.size("_s") - 1), lambda v: v / F.col("_s")[0])
    return query.join(whole.select("id", means.alias(output)), "id", "left")
