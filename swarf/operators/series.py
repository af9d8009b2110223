"""Scaling, windowing and sequence operators on long reading tables.

``readings(series_id, channel, seq, value)`` carries a dense position ``seq`` per channel.  Statistics are
map-side combined and joined back; bounded frames run inside position blocks (see ``scan``), so no
operator needs a whole channel in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swarf.functions.hashing import sha1_head
from swarf.operators.quantile import medians, quantiles
from swarf.operators.scan import BLOCK, BLOCK_ROWS, core_rows, running, seq_blocks, with_neighbours

KEYS = ["series_id", "channel"]


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def _blocked(by: Sequence[str], seq: str = "seq"):
    return W.partitionBy(*by, BLOCK).orderBy(seq)


# --- scaling -----------------------------------------------------------------------------------------


def fit_standardizer(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; fit it on the training split only."""
    return train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}__std") for c in columns]
    )


def apply_standardizer(df: DataFrame, stats: DataFrame | None, columns: Sequence[str], epsilon: float = 1e-8) -> DataFrame:
    if stats is None:
        raise ValueError("standardizer statistics of the training split are required")
    one = stats.select(F.struct(*stats.columns)).scalar()
    held = df.withColumn("_fit", one)
    scaled = {c: (F.col(c) - F.col(f"_fit.{c}__mean")) / (F.col(f"_fit.{c}__std") + epsilon) for c in columns}
    return held.withColumns(scaled).drop("_fit")


def zscore(df: DataFrame, by: Sequence[str] = KEYS, epsilon: float = 1e-8) -> DataFrame:
    stats = df.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return df.join(stats, list(by)).withColumn("scaled", (F.col("value") - F.col("_m")) / (F.col("_s") + epsilon)).drop("_m", "_s")


def minmax(df: DataFrame, by: Sequence[str] = KEYS, epsilon: float = 1e-8) -> DataFrame:
    stats = df.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    scaled = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon)
    return df.join(stats, list(by)).withColumn("scaled", scaled).drop("_lo", "_hi")


def robust_scale(df: DataFrame, by: Sequence[str] = KEYS, epsilon: float = 1e-8) -> DataFrame:
    """Median / interquartile scaling with floor-index quartiles."""
    stats = quantiles(df, by, "value", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}, method="floor")
    scaled = (F.col("value") - F.col("_q2")) / (F.col("_q3") - F.col("_q1") + epsilon)
    return df.join(stats, list(by)).withColumn("scaled", scaled).drop("_q1", "_q2", "_q3")


def clip_standardize(df: DataFrame, by: Sequence[str] = KEYS, limit: float = 10.0, floor: float = 1e-6) -> DataFrame:
    """Standard scores clipped to ``limit``; a group without spread becomes zero."""
    stats = df.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    score = (F.col("value") - F.col("_m")) / F.col("_s")
    clipped = F.greatest(F.lit(-limit), F.least(F.lit(limit), score))
    flat = (F.col("_s") < floor) | F.isnan("_s") | F.col("_s").isNull()
    return df.join(stats, list(by)).withColumn("scaled", F.when(flat, 0.0).otherwise(clipped)).drop("_m", "_s")


def robust_stats(df: DataFrame, by: Sequence[str] = KEYS, floor: float = 1e-4, bounded: bool = False) -> DataFrame:
    """Median centre and MAD-based scale per group.

    ``bounded=True`` states that every group is already limited to a window (such as a forecast context)
    and lets the built-in median do the work.
    """
    by = list(by)
    median = (lambda d, c, n: d.groupBy(*by).agg(F.median(c).alias(n))) if bounded else (lambda d, c, n: medians(d, by, c, n))
    centers = median(df, "value", "center")
    off = df.join(centers, by).withColumn("_dev", F.abs(F.col("value") - F.col("center")))
    spread = median(off, "_dev", "_mad")
    stds = df.groupBy(*by).agg(F.stddev_pop("value").alias("_std"))
    mad = F.col("_mad") * 1.4826
    scale = F.greatest(F.when(mad > 1e-6, mad).otherwise(F.col("_std")), F.lit(max(1e-8, floor)))
    return centers.join(spread, by).join(stds, by).select(*by, "center", scale.alias("scale"))


def robust_normalize(df: DataFrame, stats: DataFrame, by: Sequence[str] = KEYS, transform: str = "asinh") -> DataFrame:
    if transform not in ("asinh", "linear"):
        raise ValueError(f"unknown transform {transform!r}")
    score = (F.col("value") - F.col("center")) / F.greatest("scale", F.lit(1e-8))
    shaped = F.asinh(score) if transform == "asinh" else score
    return df.join(stats, list(by)).withColumn("normalized", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), shaped)))


def denormalize(df: DataFrame, column: str, output: str, transform: str = "asinh") -> DataFrame:
    """Back to physical units for rows that carry ``center`` and ``scale``."""
    clipped = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(column)))
    inner = F.sinh(clipped) if transform == "asinh" else F.col(column)
    return df.withColumn(output, inner * F.col("scale") + F.col("center"))


def finite_or_null(column: str = "value") -> Column:
    c = F.col(column).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def fill_missing(df: DataFrame, mode: str = "constant", by: Sequence[str] = KEYS, fill: float = 0.0) -> DataFrame:
    """Replace null, NaN and infinite readings by a constant or by the group median (0 without any)."""
    if mode not in ("constant", "median"):
        raise ValueError(f"unknown fill mode {mode!r}")
    clean = df.withColumn("value", finite_or_null())
    if mode == "constant":
        return clean.withColumn("value", F.coalesce("value", F.lit(fill)))
    stats = medians(clean, by, "value", "_fill")
    return clean.join(stats, list(by), "left").withColumn("value", F.coalesce("value", "_fill", F.lit(0.0))).drop("_fill")


def estimate_rate(df: DataFrame, by: Sequence[str] = KEYS, time: str = "time_s") -> DataFrame:
    """1 / median positive step over all readings."""
    held = with_neighbours(df.select(*by, "seq", time), 1, 0)
    step = F.col(time) - F.lag(time).over(W.partitionBy(*by, BLOCK).orderBy("seq"))
    steps = core_rows(held.withColumn("_d", step)).filter(F.col("_d") > 0)
    return medians(steps, list(by), "_d", "_m").select(*by, (1.0 / F.col("_m")).alias("rate"))


# --- windows -----------------------------------------------------------------------------------------


def group_sizes(df: DataFrame, by: Sequence[str] = KEYS, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def sliding_windows(df: DataFrame, size: int, stride: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Assign readings to full windows only: adds ``window_id`` and ``pos``; a row may be in many windows."""
    _positive(size=size, stride=stride)
    last = F.least(F.floor(F.col("seq") / stride), F.floor((F.col("n") - size) / stride))
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / stride))
    held = df.join(group_sizes(df, by), list(by)).filter(F.col("n") >= size).withColumns({"_a": first, "_b": last})
    windows = held.filter(F.col("_a") <= F.col("_b")).withColumn("window_id", F.explode(F.sequence("_a", "_b")))
    return windows.withColumn("pos", F.col("seq") - F.col("window_id") * stride).drop("n", "_a", "_b")


def sample_window(df: DataFrame, length: int, salt: str, by: Sequence[str] = KEYS) -> DataFrame:
    """One hash-placed run of at most ``length`` consecutive readings per group."""
    _positive(length=length)
    starts = group_sizes(df, by).withColumn("_room", F.greatest(F.lit(0), F.col("n") - length) + 1)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in by], F.lit(salt))
    starts = starts.select(*by, (sha1_head(key) % F.col("_room")).alias("start"))
    return df.join(starts, list(by)).filter((F.col("seq") >= F.col("start")) & (F.col("seq") < F.col("start") + length))


def patchify(df: DataFrame, size: int, stride: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Overlapping patches covering the whole series; the tail patch is filled up with zeros."""
    _positive(size=size, stride=stride)
    by = list(by)
    shape = group_sizes(df, by).withColumn("patches", F.ceil(F.greatest(F.lit(0), F.col("n") - size) / stride) + 1)
    span = (F.col("patches") - 1) * stride + size
    padding = shape.filter(span > F.col("n")).select(
        *by, "patches", F.explode(F.sequence(F.col("n"), span - 1)).alias("seq"), F.lit(0.0).alias("value")
    )
    rows = df.join(shape, by).select(*by, "patches", "seq", "value").unionByName(padding)
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") - size + 1) / stride))
    last = F.least(F.floor(F.col("seq") / stride), F.col("patches") - 1)
    placed = rows.withColumns({"_a": first, "_b": last}).filter(F.col("_a") <= F.col("_b"))
    return placed.withColumn("patch", F.explode(F.sequence("_a", "_b"))).select(
        *by, "patch", (F.col("seq") - F.col("patch") * stride).alias("pos"), "value"
    )


def tail_window(df: DataFrame, max_len: int, by: Sequence[str] = KEYS) -> DataFrame:
    """The last ``max_len`` readings as an array, zero-filled on the left."""
    from swarf.functions.vectors import pad_left

    _positive(max_len=max_len)
    tail = df.join(group_sizes(df, by), list(by)).filter(F.col("seq") >= F.col("n") - max_len)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
    return tail.groupBy(*by).agg(ordered.alias("_v")).select(*by, pad_left(F.col("_v"), max_len).alias("values"))


def first_difference(df: DataFrame, by: Sequence[str] = KEYS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``diff``: value minus the previous one, 0 for the first reading."""
    held = with_neighbours(df, 1, 0, rows=rows)
    diff = F.col("value") - F.lag("value", 1).over(_blocked(by))
    return core_rows(held.withColumn("diff", F.coalesce(diff, F.lit(0.0))))


def moving_average(df: DataFrame, width: int, by: Sequence[str] = KEYS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred box mean over ``width`` readings, missing neighbours counting as zero."""
    _positive(width=width)
    before, after = width // 2, (width - 1) // 2
    held = with_neighbours(df, before, after, rows=rows)
    box = F.sum("value").over(_blocked(by).rowsBetween(-before, after)) / width
    return core_rows(held.withColumn("smooth", box))


def monotonic_violation(df: DataFrame, by: Sequence[str], value: str, seq: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Share of falling steps per group, 0 for at most one point."""
    held = with_neighbours(df, 1, 0, seq=seq, rows=rows)
    step = F.col(value) - F.lag(value, 1).over(W.partitionBy(*by, BLOCK).orderBy(seq))
    falling = core_rows(held.withColumn("_d", step)).groupBy(*by).agg(F.avg((F.col("_d") < 0).cast("double")).alias("_share"))
    return falling.select(*by, F.coalesce("_share", F.lit(0.0)).alias("violation_rate"))


def multiscale_summary(df: DataFrame, sizes: Sequence[int], by: Sequence[str] = KEYS) -> DataFrame:
    """Per scale: mean and deviation of patch means, mean and maximum of patch rms."""
    by = list(by)
    scaled = df.join(group_sizes(df, by), by).withColumn("scale", F.explode(F.array(*[F.lit(s) for s in sizes])))
    patch = F.floor(F.col("seq") / F.least(F.col("scale"), F.col("n")))
    patches = scaled.groupBy(*by, "scale", patch.alias("_patch")).agg(
        F.avg("value").alias("_m"), F.sqrt(F.greatest(F.avg(F.col("value") * F.col("value")), F.lit(1e-8))).alias("_r")
    )
    return patches.groupBy(*by, "scale").agg(
        F.avg("_m").alias("mean_of_means"), F.stddev_pop("_m").alias("std_of_means"),
        F.avg("_r").alias("mean_rms"), F.max("_r").alias("max_rms"),
    )


def cnc_summary(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Mean, sample deviation, range, and mean / deviation of first differences."""
    return first_difference(df, by).groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg("diff").alias("diff_mean"), F.stddev_samp("diff").alias("diff_std"),
    )


def rank_top(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; the rank filter lets Spark prune each task to k rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


# --- tool and machine signals ------------------------------------------------------------------------


def rul_labels(cuts: DataFrame, limit: float = 0.3, time_per_cut: float = 1.0, by: str = "tool_id") -> DataFrame:
    """Remaining life per cut: cuts until wear first reaches ``limit``, else until past the last cut."""
    ends = cuts.groupBy(by).agg(
        F.min(F.when(F.col("wear_vb_mm") >= limit, F.col("cut"))).alias("_eol"), F.count(F.lit(1)).alias("_n")
    )
    left = F.when(F.col("_eol").isNull(), F.col("_n") - F.col("cut")).otherwise(F.greatest(F.lit(0), F.col("_eol") - F.col("cut")))
    return cuts.join(ends, by).withColumn("rul_min", left * F.lit(float(time_per_cut))).drop("_eol", "_n")


def cumulative_energy(cuts: DataFrame, step_s: float, by: str = "tool_id", rows: int = BLOCK_ROWS) -> DataFrame:
    """Energy per cut and its running total over the cuts of a tool."""
    if step_s <= 0:
        raise ValueError("step_s must be positive")
    energy = cuts.withColumn("energy_j", F.col("force_n") * F.col("cutting_speed") / 60.0 * step_s)
    return running(seq_blocks(energy, "cut", rows), [by], ["cut"], sums={"cumulative_energy_j": F.col("energy_j")})


def clean_rpm(df: DataFrame, default: float, by: str = "series_id") -> DataFrame:
    """Spindle speeds at or below 10 take the median of the plausible ones; range-limited."""
    plausible = df.withColumn("_p", F.when(F.col("value") > 10.0, F.col("value")))
    fill = medians(plausible, [by], "_p", "_fill")
    rpm = F.when(F.col("value") > 10.0, F.col("value")).otherwise(F.coalesce("_fill", F.lit(float(default))))
    return df.join(fill, by, "left").withColumn("rpm", F.greatest(F.lit(1.0), F.least(F.lit(100000.0), rpm))).drop("_fill")


def rotation_angle(df: DataFrame, rate: float, by: str = "series_id", rows: int = BLOCK_ROWS) -> DataFrame:
    """Angle reached before each reading: exclusive running sum of 2·pi·rpm/60/rate."""
    step = F.lit(6.283185307179586) * F.col("rpm") / 60.0 / max(rate, 1.0)
    held = df.withColumn("_step", step)
    total = running(seq_blocks(held, "seq", rows), [by], ["seq"], sums={"_total": F.col("_step")})
    return total.withColumn("angle", F.col("_total") - F.col("_step")).drop("_total", "_step")


# Channel weights by name part.
ENVELOPE_WEIGHTS = [
    (("load", "torque", "current", "power", "force"), 1.8),
    (("rpm", "speed", "spindle"), 1.2),
    (("feed", "position", "axis"), 1.1),
]


def load_envelope(df: DataFrame, scaled: str = "scaled", rows: int = BLOCK_ROWS) -> DataFrame:
    """Smoothed, range-mapped mean load per position over all channels of a series."""
    name, weight = F.lower("channel"), None
    for words, factor in ENVELOPE_WEIGHTS:
        hit = name.rlike("|".join(words))
        weight = F.when(hit, factor) if weight is None else weight.when(hit, factor)
    weighted = df.withColumn("_w", weight.otherwise(1.0))
    energy = weighted.groupBy("series_id", "seq").agg(
        (F.sum(F.col("_w") * F.abs(scaled)) / F.sum("_w")).alias("value")
    )
    sizes = group_sizes(energy, ["series_id"]).withColumn("_t", F.floor(F.col("n") / 16))
    sizes = sizes.select("series_id", F.greatest(F.lit(3), F.least(F.lit(33), F.when(F.col("_t") == 0, 3).otherwise(F.col("_t")))).alias("_w"))
    held = with_neighbours(energy.join(sizes, "series_id"), 16, 16, rows=rows)
    span = W.partitionBy("series_id", BLOCK).orderBy("seq").rowsBetween(-16, 16)
    near = F.filter(
        F.col("_near"),
        lambda p: (p.seq >= F.col("seq") - F.floor(F.col("_w") / 2)) & (p.seq <= F.col("seq") + F.floor((F.col("_w") - 1) / 2)),
    )
    smooth = core_rows(
        held.withColumn("_near", F.collect_list(F.struct("seq", "value")).over(span)).withColumn(
            "smooth", F.aggregate(near, F.lit(0.0), lambda a, p: a + p.value) / F.col("_w")
        )
    ).select("series_id", "seq", "smooth")
    lim = smooth.groupBy("series_id").agg(F.min("smooth").alias("_lo"), F.max("smooth").alias("_hi"))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col("smooth") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return smooth.join(lim, "series_id").select("series_id", "seq", "smooth", (0.35 + 0.65 * unit).alias("envelope"))


# --- forecasting frames ------------------------------------------------------------------------------


def horizon_targets(df: DataFrame, context: int, horizons: Sequence[int], by: Sequence[str] = KEYS) -> DataFrame:
    """Rows after a context of ``context`` readings, once per horizon that fits, scaled by context statistics."""
    _positive(context=context)
    by = list(by)
    stats = robust_stats(df.filter(F.col("seq") < context), by, bounded=True)
    step = F.col("seq") - context
    fits = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: (step < h) & (F.col("n") >= h + context))
    future = df.join(group_sizes(df, by), by).filter(F.col("seq") >= context)
    rows = future.withColumn("horizon", F.explode(fits)).withColumn("step", step).drop("n")
    return robust_normalize(rows, stats, by)


def persistence_forecast(df: DataFrame, targets: DataFrame, context: int, by: Sequence[str] = KEYS) -> DataFrame:
    """Repeat the last context value over all target steps."""
    last = df.filter(F.col("seq") == context - 1).select(*by, F.col("value").alias("persistence"))
    return targets.join(last, list(by))
