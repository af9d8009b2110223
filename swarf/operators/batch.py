"""Batch assembly for training: padded batches, preflight checks and replay mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.functions.vectors import pad_right
from swarf.operators.scan import order_blocks, running


def number_batches(samples: DataFrame, batch: int, order: str = "sample_id") -> DataFrame:
    """Consecutive batches of ``batch`` samples in sample order, ranked block by block; ids are numbers or text."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    ranked = running(order_blocks(samples, [], [order]), [], [order], index="_i")
    return ranked.withColumn("batch", F.floor(F.col("_i") / batch)).drop("_i")


def pad_batches(channels: DataFrame, batch: int, sample: str = "sample_id") -> DataFrame:
    """Zero-pad (sample, slot, values) to the channel count and length of the batch, with a channel mask."""
    numbered = number_batches(channels.select(sample).distinct(), batch, sample)
    held = channels.join(numbered, sample)
    shape = held.groupBy("batch").agg((F.max("slot") + 1).alias("_c"), F.max(F.size("values")).alias("_t"))
    wanted = numbered.join(shape, "batch").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("_c").cast("int") - 1)))
    joined = wanted.join(channels.select(sample, F.col("slot").cast("int").alias("slot"), "values"), [sample, "slot"], "left")
    empty = F.expr("cast(array() AS array<double>)")
    return joined.select(
        "batch", sample, "slot", F.col("values").isNotNull().alias("mask"),
        pad_right(F.coalesce("values", empty), F.col("_t"), F.lit(0.0)).alias("values"),
    )


def preflight(table: DataFrame, arrays: list[str], sample: str = "sample_id", first: int | None = None) -> DataFrame:
    """Length and finiteness of the array columns of each sample (of the first ``first`` samples if given)."""
    head = table.orderBy(sample).limit(first) if first else table
    finite = lambda c: F.forall(c, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")) & v.isNotNull())
    return head.select(sample, *[F.size(c).alias(f"{c}_size") for c in arrays], *[finite(c).alias(f"{c}_finite") for c in arrays])


def replay_mix(new: DataFrame, old: DataFrame, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """All new rows and hash-chosen old rows so that old rows make up ``ratio`` of the mixture (as far as they go)."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be in [0, 1)")
    quota = F.round(new.agg(F.count(F.lit(1))).scalar() * F.lit(ratio / (1.0 - ratio)))
    placed = old.withColumn("_h", F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = running(order_blocks(placed, [], ["_h", key]), [], ["_h", key], index="_i").filter(F.col("_i") < quota).drop("_h", "_i")
    return new.withColumn("origin", F.lit("new")).unionByName(ranked.withColumn("origin", F.lit("replay")))
