"""Exact grouped quantiles, also for groups too large for one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, so it is used only where the
caller declares groups bounded (windows).  Otherwise values are reduced to (value, count) pairs, a
bounded sketch per group proposes split points, and only the slices that contain a wanted rank are
sorted.  The sketch only steers the slicing; the result is exact either way, and no job runs while the
plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 256
GROUP_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    method: str = "linear",
    group_rows: int = GROUP_ROWS,
    slices: int = SLICES,
    bounded: bool = False,
) -> DataFrame:
    """One row per key with the named quantiles; null values are ignored, keys must not be null.

    ``method`` is ``linear`` (interpolated between the two neighbouring ranks) or ``floor`` (the value at
    rank ``int(q * (n - 1))``).  Groups of more than ``group_rows`` distinct values are sorted in slices.
    """
    if method not in ("linear", "floor"):
        raise ValueError(f"unknown quantile method {method!r}")
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    if not bounded:
        return _sliced(present, keys, value, wanted, method, group_rows, slices)
    if method == "linear":
        return present.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(q))).alias(n) for n, q in wanted.items()])
    ordered = present.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    at = lambda q: F.element_at("_v", F.floor(F.lit(float(q)) * (F.size("_v") - 1)).cast("int") + 1)
    return ordered.select(*keys, *[at(q).alias(n) for n, q in wanted.items()])


def _sliced(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], method: str, group_rows: int, slices: int) -> DataFrame:
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    cuts = [i / slices for i in range(1, slices)]
    shape = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_distinct"),
        F.percentile_approx("_v", cuts, 4 * slices).alias("_cuts"),
    )
    # only groups above ``group_rows`` distinct values are cut, so this side has few rows; a shuffle by key would gather a
    # large group in one task
    large = shape.filter(F.col("_distinct") > group_rows).select(*keys, "_cuts")
    if keys:
        cut = counted.join(F.broadcast(large), keys, "left")
    else:
        cut = counted.withColumn("_cuts", large.select("_cuts").scalar())
    slot = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))), F.lit(0))
    sliced = cut.select(*keys, "_v", "_n", F.greatest(slot, F.lit(0)).alias("_slice"))
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_in"))
    per_slice = per_slice.withColumn("_total", F.sum("_in").over(W.partitionBy(*keys)))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ranks = []
    for name, q in wanted.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        ranks.append(F.struct(F.lit(name).alias("name"), F.lit("lo").alias("side"), F.floor(at).alias("rank")))
        if method == "linear":
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit("hi").alias("side"), F.ceil(at).alias("rank")))
    targets = (
        per_slice.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .withColumn("_want", F.filter(F.array(*ranks), lambda r: (r.rank >= F.col("_before")) & (r.rank < F.col("_before") + F.col("_in"))))
        .filter(F.size("_want") > 0)
        .select(*[F.col(k) for k in keys], "_slice", "_total", "_before", "_want")
    )
    hits = sliced.join(targets, keys + ["_slice"])
    inside = W.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    picked = (
        hits.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_hit", F.explode(F.filter("_want", lambda r: (r.rank >= F.col("_upto") - F.col("_n")) & (r.rank < F.col("_upto")))))
    )
    outputs = []
    for name, q in wanted.items():
        at = lambda side: F.max(F.when((F.col("_hit.name") == name) & (F.col("_hit.side") == side), F.col("_v")))
        if method == "floor":
            outputs.append(at("lo").alias(name))
        else:
            position = F.lit(float(q)) * (F.first("_total") - 1)
            outputs.append((at("lo") + (at("hi") - at("lo")) * (position - F.floor(position))).alias(name))
    return picked.groupBy(*keys).agg(*outputs)


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median", **options) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, **options)
