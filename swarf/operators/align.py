"""Time alignment: range joins, common ranges and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.operators.scan import order_blocks, running


def time_axis(df: DataFrame, rate: float | None, start: float = 0.0, seq: str = "seq") -> DataFrame:
    """Seconds of each position; unit steps when the rate is unknown."""
    step = F.col(seq) / float(rate) if rate and rate > 0 else F.col(seq).cast("double")
    return df.withColumn("time_s", F.lit(float(start)) + step)


def range_align(fast: DataFrame, windows: DataFrame, width: float, by: Sequence[str] = ("series_id",), time: str = "time_s") -> DataFrame:
    """Fast rows inside half-open windows ``[start, end)``.

    Both sides get the time slots of ``width`` seconds they touch, so it is an equi-join on (key, slot)
    that also spreads one large key; ``width`` should be near the usual window length.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    slot = lambda c: F.floor(F.col(c) / width).cast("long")
    spans = windows.filter(F.col("end") > F.col("start")).withColumn("_slot", F.explode(F.sequence(slot("start"), slot("end"))))
    rows = fast.withColumn("_slot", slot(time))
    inside = (F.col(time) >= F.col("start")) & (F.col(time) < F.col("end"))
    return rows.join(spans, [*by, "_slot"]).filter(inside).drop("_slot")


def overlap_range(df: DataFrame, by: Sequence[str] = ("series_id",), channel: str = "channel", time: str = "time_s") -> DataFrame:
    """Common time range of all channels of a series; nulls when it is empty."""
    spans = df.groupBy(*by, channel).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    common = spans.groupBy(*by).agg(F.max("_a").alias("start"), F.min("_b").alias("end"))
    keep = lambda c: F.when(F.col("end") > F.col("start"), F.col(c))
    return common.select(*by, keep("start").alias("start"), keep("end").alias("end"))


def as_of_join(query: DataFrame, keys: DataFrame, value: str, by: str = "series_id", time: str = "time", tie: str = "id") -> DataFrame:
    """For each query row the last key at or before its time and the number of keys it may see.

    Visible keys of a query are always a prefix in time order, so the causal mask is given by that count
    instead of by all pairs.  Of several keys at one time the one with the
    largest ``tie`` counts, if keys have that column, else the one with the largest value.  All query columns come back.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in query.columns])
    kind = query.schema[tie].dataType
    own = F.col(tie).cast(kind) if tie in keys.columns else F.lit(None).cast(kind)
    left = query.select(by, time, F.col(tie).alias("_tie"), F.lit(None).cast(keys.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"), row.alias("_row"))
    right = keys.select(by, time, own.alias("_tie"), F.col(value).alias("_value"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = left.unionByName(right)
    order = [time, "_side", "_tie", "_value"]
    seen = running(
        order_blocks(both, [by], order), [by], order,
        sums={"visible_keys": (F.col("_side") == 0).cast("long")}, lasts={"as_of": F.when(F.col("_side") == 0, F.col("_value"))},
    )
    return seen.filter(F.col("_side") == 1).select(*[F.col(f"_row.`{c}`") for c in query.columns], "as_of", "visible_keys")
