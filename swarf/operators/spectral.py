"""Spectral operators: Spark selects or resamples bounded arrays, NumPy transforms them in Arrow batches.

A group of readings is one window and one array.  Series of any length are cut first by ``cut_windows``, which makes the
window part of the key; no operator looks at a prefix of its group only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.functions import spectra
from swarf.functions.vectors import total
from swarf.operators.lineage import stored
from swarf.operators.scan import BLOCK, with_neighbours
from swarf.operators.series import KEYS, group_sizes

# Band edges in Hz, None = Nyquist.
BANDS = [("low", 0.0, 100.0), ("mid", 100.0, 1000.0), ("high", 1000.0, None)]
GRID = 256
WINDOWED = [*KEYS, "window"]


def cut_windows(df: DataFrame, length: int) -> DataFrame:
    """Add ``window``, the number of each run of ``length`` positions, and count ``seq`` from 0 within it.

    The last window of a series may be shorter; with ``by=WINDOWED`` every operator here takes the windows as groups.
    """
    return df.withColumns({"window": F.floor(F.col("seq") / length).cast("long"), "seq": F.col("seq") % length})


def window_arrays(df: DataFrame, by: Sequence[str] = KEYS, name: str = "values") -> DataFrame:
    """All readings of each group as an array in position order; groups are windows and so bounded."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
    return df.groupBy(*by).agg(ordered.alias(name))


def resample_linear(
    df: DataFrame, points: Column | int | None = None, source_rate: float | None = None, target_rate: float | None = None,
    by: Sequence[str] = KEYS,
) -> DataFrame:
    """Endpoint-aligned linear interpolation to ``points`` positions, or to a rate ratio (half-even rounding).

    Each target asks for its two neighbours by position, so the work is one equi-join on (group, seq).
    """
    by = list(by)
    sizes = group_sizes(df, by)
    if points is None:
        count = F.greatest(F.lit(1), F.bround(F.col("n") * float(target_rate) / float(source_rate)).cast("long"))
    else:
        count = F.lit(points) if isinstance(points, int) else points
    grid = sizes.withColumn("_m", count.cast("long")).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    at = F.when(F.col("_m") > 1, F.col("pos") * (F.col("n") - 1) / (F.col("_m") - 1)).otherwise(0.0)
    asked = grid.withColumn("_at", at).withColumn("_lo", F.floor("_at")).withColumn("_f", F.col("_at") - F.col("_lo"))
    hi = F.least(F.col("n") - 1, F.col("_lo") + 1)
    pair = F.array(F.struct(F.col("_lo").alias("seq"), (1 - F.col("_f")).alias("w")), F.struct(hi.alias("seq"), F.col("_f").alias("w")))
    needs = asked.select(*by, "pos", F.explode(pair).alias("p")).select(*by, "pos", "p.seq", "p.w").filter(F.col("w") > 0)
    return needs.join(df.select(*by, "seq", "value"), by + ["seq"]).groupBy(*by, "pos").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def resampled_arrays(df: DataFrame, points: Column | int, by: Sequence[str] = KEYS, name: str = "values", rows: int = 4096) -> DataFrame:
    """The grid of ``points`` places of each group as one array.

    Blocks of ``rows`` readings, with the reading after them, give the places that fall into them; only the grid itself
    meets in one place.
    """
    by = list(by)
    held = with_neighbours(df.select(*by, "seq", "value"), 0, 1, rows=rows)
    blocks = held.groupBy(*by, BLOCK).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("_b")).join(group_sizes(df, by), by)
    start = F.col(BLOCK) * rows
    count = (F.lit(points) if isinstance(points, int) else points).cast("long")
    part = spectra.stretched_part(F.transform("_b", lambda b: b["value"].cast("double")), start, start + rows, F.col("n"), count)
    parts = blocks.select(*by, F.struct(BLOCK, part.alias("part")).alias("_p"))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["part"]))
    return parts.groupBy(*by).agg(ordered.alias(name))


def resize_series(df: DataFrame, channels: int, steps: int, by: str = "id") -> DataFrame:
    """Bring (id, channel_index, seq, value) to ``channels`` × ``steps``: repeat the last channel, resample each."""
    last = df.groupBy(by).agg((F.max("channel_index") + 1).alias("_c"))
    wanted = last.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn(
        "channel_index", F.least(F.col("channel"), F.col("_c") - 1)
    )
    held = df.join(wanted.drop("_c"), [by, "channel_index"]).select(by, "channel", "seq", "value")
    return resample_linear(held, steps, by=[by, "channel"])


def _share(values: Column, low: Column, high: Column, whole: Column) -> Column:
    picked = F.filter(values, lambda v, i: (i >= low) & (i < high))
    return total(picked) / whole


def dft_features(df: DataFrame, rate: float = 1.0, by: Sequence[str] = KEYS) -> DataFrame:
    """Energy, centroid, dominant frequency and entropy of each window."""
    held = window_arrays(df, by).withColumn("_p", spectra.power_spectrum("values")).withColumn("_n", F.size("values"))
    energy = total(F.col("_p")) + 1e-12
    freq = lambda i: i * F.lit(float(rate)) / F.col("_n")
    share = F.transform("_p", lambda v: v / F.col("band_energy"))
    summed = held.withColumn("band_energy", energy).withColumn("_q", share)
    return summed.select(
        *by,
        "band_energy",
        total(F.transform("_q", lambda q, i: q * freq(i))).alias("spectral_centroid"),
        freq(F.array_position("_p", F.array_max("_p")) - 1).alias("dominant_frequency"),
        (-total(F.transform("_q", lambda q: q * F.log(q + 1e-12)))).alias("spectral_entropy"),
    )


def profile_spectrum(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Centroid, entropy and quarter-band shares of the mean-free window; zeros below four readings."""
    by = list(by)
    means = df.groupBy(*by).agg(F.avg("value").alias("_m"), F.count(F.lit(1)).alias("_rows"))
    held = window_arrays(df, by).join(means, by).withColumn("_x", F.transform("values", lambda v: v - F.col("_m")))
    power = held.withColumn("_p", spectra.power_spectrum("_x")).withColumn("_t", total(F.col("_p")) + 1e-12)
    share = power.withColumn("_q", F.transform("_p", lambda v: v / F.col("_t"))).withColumn("_k", F.size("_q"))
    q, k = F.col("_q"), F.col("_k")
    quarter, half, zero = F.floor(k / 4), F.floor(k / 2), F.lit(0)
    long_enough = F.col("_rows") >= 4
    pick = lambda c: F.when(long_enough, c).otherwise(0.0)
    return share.select(
        *by,
        pick(total(F.transform(q, lambda v, i: v * i / (k - 1)))).alias("centroid"),
        pick(-total(F.transform(q, lambda v: v * F.log(v + 1e-12)))).alias("entropy"),
        pick(_share(q, half, k, F.lit(1.0))).alias("high"),
        pick(_share(q, quarter, F.greatest(quarter + 1, half), F.lit(1.0))).alias("mid"),
        pick(_share(q, zero, F.greatest(F.lit(1), quarter), F.lit(1.0))).alias("low"),
    )


def band_profile(df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Eighth-band shares, centroid, spread and peak position of a window's power spectrum."""
    held = window_arrays(df, by).withColumn("_p", spectra.power_spectrum("values"))
    power = held.withColumns({"_t": F.greatest(total(F.col("_p")), F.lit(1e-8)), "_k": F.size("_p")})
    p, k, whole = F.col("_p"), F.col("_k"), F.col("_t")
    axis = lambda i: F.when(k > 1, i / (k - 1)).otherwise(0.0)
    eighth, half = F.floor(k / 8), F.floor(k / 2)
    centred = power.withColumn("centroid", total(F.transform(p, lambda v, i: v * axis(i))) / whole)
    return centred.select(
        *by,
        _share(p, F.lit(0), F.greatest(F.lit(1), eighth), whole).alias("low"),
        _share(p, eighth, F.greatest(half, eighth + 1), whole).alias("mid"),
        _share(p, F.greatest(F.lit(1), half), k, whole).alias("high"),
        "centroid",
        F.sqrt(total(F.transform(p, lambda v, i: v * (axis(i) - F.col("centroid")) * (axis(i) - F.col("centroid")))) / whole).alias("spread"),
        axis(F.array_position(p, F.array_max(p)) - 1).alias("peak"),
    )


def fft_magnitude(df: DataFrame, length: int = GRID, by: Sequence[str] = KEYS) -> DataFrame:
    """log1p magnitudes of the Hann-weighted resampled series and log1p of their squares."""
    held = resampled_arrays(df, length, by).withColumn("_m", spectra.hann_magnitude("values"))
    mags = held.withColumn("magnitude", F.transform("_m", lambda v: F.log1p(v)))
    return mags.select(*by, "magnitude", F.transform("magnitude", lambda v: F.log1p(v * v)).alias("log_power"))


def _grid_points(n: Column, least: int = 64, most: int = 2048) -> Column:
    """Power of two covering ``n``, between ``least`` and ``most``: the resolution of the band grid, not a cut of the series."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(8), n).cast("double"))))))


def _bands(magnitudes: DataFrame, rate: float | None, bands, keep: Sequence[str]) -> DataFrame:
    """Band shares, centroid and peak from ``_m`` (Hann magnitudes) of a grid of ``_n`` points."""
    power = magnitudes.withColumn("_p", F.transform("_m", lambda v: v * v)).withColumn("_t", total(F.col("_p")) + 1e-8)
    known = rate is not None and rate > 0
    freq = (lambda i: i * float(rate) / F.col("_n")) if known else (lambda i: i / (F.size("_p") - 1))
    nyquist = float(rate) / 2.0 if known else 1.0
    shares = []
    for name, low, high in bands:
        top = nyquist if high is None else float(high)
        shares.append((total(F.filter("_p", lambda v, i: (freq(i) >= low) & (freq(i) <= top))) / F.col("_t")).alias(f"{name}_ratio"))
    return power.select(
        *keep, *shares,
        (total(F.transform("_p", lambda v, i: v * freq(i))) / F.col("_t")).alias("centroid"),
        freq(F.array_position("_p", F.array_max("_p")) - 1).alias("peak"),
    )


def band_energy(df: DataFrame, rate: float | None, bands=BANDS, by: Sequence[str] = KEYS, most_points: int = 2048) -> DataFrame:
    """Energy share of each closed band, centroid and peak on a power-of-two grid.

    As a vector the share of the last band is repeated at the end; ``frequency_view`` adds it there.
    """
    held = resampled_arrays(df, _grid_points(F.col("n"), most=most_points), by)
    return _bands(held.withColumns({"_m": spectra.hann_magnitude("values"), "_n": F.size("values")}), rate, bands, by)


def frame_moments(df: DataFrame, by: Sequence[str] = KEYS, rows: int = 4096) -> DataFrame:
    """(by, bin, frames, mean, deviation) of the log magnitudes over all Hann frames of 128 readings, hop 64, of whole series.

    Series are cut into blocks of ``rows`` positions (a multiple of 64) that also see the next 64 readings.  A block gives
    number, mean and squared deviations of the frames starting in it; these add up over blocks, so no task holds a series.
    """
    by = list(by)
    if rows % 64:
        raise ValueError("a block holds whole hops of 64 readings")
    held = with_neighbours(df, 0, 64, rows=rows)
    blocks = held.groupBy(*by, BLOCK).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("_b")).join(group_sizes(df, by), by)
    parts = blocks.select(*by, spectra.frame_block(F.transform("_b", lambda b: b["value"]), F.col("n"), F.lit(rows // 64)).alias("_m")).filter("_m.frames > 0")
    bins = parts.select(*by, "_m.frames", F.posexplode(F.arrays_zip("_m.mean", "_m.spread")).alias("bin", "_s"))
    count, mean = F.col("frames"), F.col("_s.mean")
    merged = bins.groupBy(*by, "bin").agg(F.sum(count).alias("frames"), F.sum(count * mean).alias("_a"), F.sum(F.col("_s.spread")).alias("_in"), F.sum(count * mean * mean).alias("_sq"))
    centre = F.col("_a") / F.col("frames")
    between = F.greatest(F.col("_sq") - F.col("_a") * centre, F.lit(0.0))
    return merged.select(*by, "bin", "frames", centre.alias("mean"), F.sqrt((F.col("_in") + between) / F.col("frames")).alias("deviation"))


def stft_summary(df: DataFrame, by: Sequence[str] = KEYS, rows: int = 4096) -> DataFrame:
    """Mean and deviation over all Hann frames of 128 readings, hop 64, of each series, however long."""
    by = list(by)
    sizes = group_sizes(df, by)
    # a series of one block is one array; only longer ones add up moments of blocks
    short = window_arrays(df.join(sizes.filter(F.col("n") <= rows), by, "left_semi"), by).select(*by, spectra.short_time_summary("values").alias("summary"))
    ordered = F.array_sort(F.collect_list(F.struct("bin", "mean", "deviation")))
    held = frame_moments(df.join(sizes.filter(F.col("n") > rows), by, "left_semi"), by, rows).groupBy(*by).agg(ordered.alias("_b"))
    return short.unionByName(held.select(*by, F.concat(F.transform("_b", lambda b: b["mean"]), F.transform("_b", lambda b: b["deviation"])).alias("summary")))


def width_energies(df: DataFrame, limit: int = 64, scales: int = 32, by: Sequence[str] = KEYS, rows: int = 4096) -> DataFrame:
    """log1p rms of the series minus its centred box mean for ``scales`` widths.

    Long series are cut into position blocks with borders; each block is one bounded array that yields sums
    of squares, which are added up per width.
    """
    by = list(by)
    held = with_neighbours(df, limit // 2 + 1, limit // 2 + 1, rows=rows)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value", "_core")))
    blocks = held.groupBy(*by, BLOCK).agg(ordered.alias("_b")).join(group_sizes(df, by), by)
    sums = spectra.box_block(
        F.transform("_b", lambda b: b["value"]), F.array_position(F.transform("_b", lambda b: b["_core"]), F.lit(True)) - 1,
        F.size(F.filter("_b", lambda b: b["_core"])), F.col("n"), F.lit(limit),
    )
    widest = F.least(F.lit(limit), F.greatest(F.lit(3), F.floor(F.col("n") / 4)))
    width = F.greatest(F.lit(2), F.floor(2 + F.col("scale") * ((widest - 2) / float(scales - 1)) + 1e-12)).cast("int")
    parts = blocks.select(*by, "n", F.posexplode(sums).alias("scale", "_s"))
    summed = parts.groupBy(*by, "n", "scale").agg(F.sum("_s").alias("_s"))
    return summed.select(*by, "scale", width.alias("width"), F.log1p(F.sqrt(F.col("_s") / F.col("n"))).alias("energy"))


def repaired(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null, NaN and infinite readings replaced by the median of their group's finite ones, 0 without any."""
    from swarf.operators.quantile import medians

    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    marked = df.withColumn("value", finite)
    holed = stored(marked.filter(F.col("value").isNull()).select(*by).distinct())  # other groups need no median
    middle = medians(marked.join(holed, list(by), "left_semi"), list(by), "value", "_middle")
    return marked.join(middle, list(by), "left").withColumn("value", F.coalesce("value", "_middle", F.lit(0.0))).drop("_middle")


def frequency_view(
    df: DataFrame, rate: float | None, transforms: Sequence[str] = ("fft", "stft", "cwt"), length: int = 512, by: Sequence[str] = KEYS, window: int | None = None,
    rows: int = 4096,
) -> DataFrame:
    """Chosen transforms side by side, resampled to ``length`` and standardised.

    Missing and non-finite readings take the median of their group first.  With ``window`` series are cut into windows
    of so many readings, each one bounded array, and ``window`` joins the keys; without it, series of up to ``rows``
    readings are one array each, and longer ones are resampled and smoothed by blocks.
    """
    by = list(by)
    df = repaired(df, by)
    wanted = {t.lower() for t in transforms}
    if window:
        return _array_view(cut_windows(df, window), rate, wanted, length, [*by, "window"])
    df = stored(df.select(*by, "seq", "value"))  # read by both kinds of series
    sizes = group_sizes(df, by)
    kind = lambda which: df.join(sizes.filter(which), by, "left_semi")
    short = _array_view(kind(F.col("n") <= rows), rate, wanted, length, by)
    return short.unionByName(_block_view(kind(F.col("n") > rows), rate, wanted, length, by))


def _array_view(df: DataFrame, rate: float | None, wanted: set[str], length: int, by: list[str]) -> DataFrame:
    """The view of groups that are one bounded array each: one grouping and one pass for all transforms.

    Transforms are up to 40 times larger than a short series, so they never go back and forth between Spark and Python.
    """
    held, grid = window_arrays(df, by), min(GRID, length)
    kinds = T.StructType([*(held.schema[c] for c in by), T.StructField("frequency", spectra.DOUBLES)])
    return held.mapInArrow(lambda batches: spectra.frequency_batches(batches, rate, wanted, length, grid, BANDS), kinds)


def _block_view(df: DataFrame, rate: float | None, wanted: set[str], length: int, by: list[str]) -> DataFrame:
    """The view of groups of any size, from blocks."""
    grid, held = min(GRID, length), df.select(*by).distinct()
    if "fft" in wanted or not wanted:
        grids = resampled_arrays(df, grid, by)
        held = held.join(grids.select(*by, spectra.hann_magnitude("values").alias("_g")), by)
    if "fft" in wanted:
        held = held.join(band_energy(df, rate, by=by), by)
    if "stft" in wanted:
        held = held.join(stft_summary(df, by), by)
    if "cwt" in wanted:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("scale", "energy"))), lambda s: s["energy"])
        held = held.join(width_energies(df, 64, by=by).groupBy(*by).agg(ordered.alias("_wide")), by)
    return _view(held, wanted, length, by)


def _view(held: DataFrame, wanted: set[str], length: int, by: list[str]) -> DataFrame:
    parts = []
    if "fft" in wanted or not wanted:
        held = held.withColumn("_g", F.transform("_g", lambda v: F.log1p(v)))
        parts.append(F.col("_g"))
    if "fft" in wanted:
        names = [f"{name}_ratio" for name, _, _ in BANDS]
        parts += [F.transform("_g", lambda v: F.log1p(v * v)), F.array(*names, "centroid", "peak", names[-1])]
    if "stft" in wanted:
        parts.append(F.col("summary"))
    if "cwt" in wanted:
        parts.append(F.col("_wide"))
    return held.select(*by, spectra.stretch_and_scale(F.concat(*parts), F.lit(length)).alias("frequency"))


def first_rpm(df: DataFrame, channel_order: DataFrame, by: str = "series_id") -> DataFrame:
    """Median of the first channel of a series named after rpm or spindle; null unless positive."""
    from swarf.operators.quantile import medians

    named = channel_order.filter(F.lower("channel").rlike("rpm|spindle"))
    first = named.groupBy(by).agg(F.min_by("channel", "position").alias("channel"))
    values = df.join(first, [by, "channel"]).select(by, "value")
    return medians(values, [by], "value", "rpm").withColumn("rpm", F.when(F.col("rpm") > 0, F.col("rpm")))


def order_features(df: DataFrame, rpm: DataFrame, rate: float, orders: int = 8, by: Sequence[str] = KEYS) -> DataFrame:
    """Standardised amplitudes at multiples of the rotation frequency; zeros without a speed."""
    held = window_arrays(df, by).join(rpm, "series_id", "left")
    return held.select(*by, _orders(rate, orders).alias("orders"))


def _orders(rate: float, orders: int) -> Column:
    return spectra.order_profile("values", F.col("rpm").cast("double"), F.lit(float(rate)), F.lit(orders))


def multirate_spectrum(
    df: DataFrame, rpm: DataFrame, rate: float, transforms: Sequence[str] = ("fft", "stft", "cwt"), length: int = 512,
    by: Sequence[str] = KEYS,
) -> DataFrame:
    """Magnitude, phase, short-time, box-width and order features of a window, resampled and standardised.

    The window is one bounded array per group, so all features come from one grouping.
    """
    by, wanted, parts = list(by), {t.lower() for t in transforms}, []
    held = window_arrays(df, by).join(rpm, "series_id", "left").withColumn("orders", _orders(rate, 8))
    if "fft" in wanted:
        held = held.withColumn("_g", spectra.stretched("values", F.lit(GRID)))
        held = held.withColumns({"_mag": spectra.hann_magnitude("_g"), "_phase": spectra.unwrapped_phase("_g")})
        parts += [F.transform("_mag", lambda v: F.log1p(v)), F.col("_phase")]
    if "stft" in wanted:
        held = held.withColumn("summary", spectra.short_time_summary("values"))
        parts.append(F.col("summary"))
    if "cwt" in wanted:
        held = held.withColumn("_wide", spectra.box_profile("values", F.lit(96)))
        parts.append(F.col("_wide"))
    return held.select(*by, spectra.stretch_and_scale(F.concat(*parts, F.col("orders")), F.lit(length)).alias("spectral"))
