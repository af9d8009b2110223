"""Arrow-batched Fourier helpers on bounded ``array<double>`` columns.

Spark prepares one short array per series and channel (a resampled grid, a window); these
functions only turn such an array into its transform.  The NumPy helpers work along the last axis; a batch is taken
as matrices of its rows of one length, at most ``CELLS`` values at a time, so a task holds no object per value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
#: Values of one matrix of a batch.
CELLS = 1 << 18
#: Rows that go back to Spark at a time from steps whose results are much larger than their input.
ROWS = 512


def _grouped(arrays: pa.Array, params: Sequence[pa.Array], fn: Callable, spare: int = 1, least: int = 1) -> list[np.ndarray | None]:
    """``fn(matrix, rows, *whole-number params)`` over the rows of equal length and parameters; one result per row, null arrays none.

    ``fn`` may return a tuple of matrices; ``spare`` is how many times larger than the matrix its own work is, and ``least``
    how many values that work has for a row at least.
    """
    lengths = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False)
    flat = arrays.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    keys = np.stack([lengths, *[p.cast(pa.int64()).to_numpy(zero_copy_only=False) for p in params]], axis=1)
    kinds, which = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))
    found: list = [None] * len(lengths)
    for kind, begin, end in zip(kinds.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        if kind[0] < 0:
            continue
        some = max(1, CELLS // max(1, kind[0] * spare, least))
        for at in range(begin, end, some):
            rows = order[at : min(end, at + some)]
            matrix = flat[starts[rows][:, None] + np.arange(kind[0])]
            out = fn(matrix, rows, *kind[1:])
            for k, row in enumerate(rows.tolist()):
                found[row] = tuple(o[k] for o in out) if isinstance(out, tuple) else out[k]
    return found


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """A list column of float rows; None is null."""
    sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate([r for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(r is None for r in rows), False]))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))


def stretch(x: np.ndarray, length: int) -> np.ndarray:
    """Linear interpolation onto ``length`` places between the first and the last reading; zeros without readings."""
    n = x.shape[-1]
    if not n:
        return np.zeros((*x.shape[:-1], length))
    place = np.arange(length) * (n - 1) / max(length - 1, 1)
    below = np.floor(place).astype(int)
    above = np.minimum(below + 1, n - 1)
    return x[..., below] + (place - below) * (x[..., above] - x[..., below])


def stretch_part(x: np.ndarray, start: int, until: int, n: int, length: int) -> np.ndarray:
    """The places of ``stretch`` of a series of ``n`` that fall into [start, until); ``x`` holds it from ``start`` to one reading beyond."""
    place = np.arange(length) * (n - 1) / max(length - 1, 1)
    place = place[(place >= start) & (place < until)]
    below = np.floor(place).astype(int)
    above, f = np.minimum(below + 1, n - 1), place - below
    return x[..., below - start] * (1 - f) + np.where(f > 0, x[..., above - start] * f, 0.0)


def standard(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=-1, keepdims=True)
    varied = np.isfinite(spread) & (spread >= 1e-6)
    return np.where(varied, np.clip((x - x.mean(axis=-1, keepdims=True)) / np.where(varied, spread, 1.0), -10, 10), 0.0)


def hann_spectrum(x: np.ndarray) -> np.ndarray:
    return np.fft.rfft(x * np.hanning(x.shape[-1]))


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    cut = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::hop, :]
    return np.log1p(np.abs(np.fft.rfft(cut * np.hanning(size))))


def frame_stats(x: np.ndarray, size: int = 128, hop: int = 64) -> np.ndarray:
    """Mean and deviation of the log magnitudes over all whole frames."""
    mags = _frames(stretch(x, size) if x.shape[-1] < size else x, size, hop)
    return np.concatenate([mags.mean(axis=-2), mags.std(axis=-2)], axis=-1)


def frame_moments(x: np.ndarray, frames: int | None = None, size: int = 128, hop: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and summed squared deviations of the log magnitudes over the whole frames, at most the first ``frames``."""
    if x.shape[-1] < size or frames == 0:
        return 0, np.zeros((*x.shape[:-1], size // 2 + 1)), np.zeros((*x.shape[:-1], size // 2 + 1))
    mags = _frames(x if frames is None else x[..., : (frames - 1) * hop + size], size, hop)
    mean = mags.mean(axis=-2)
    return mags.shape[-2], mean, np.square(mags - mean[..., None, :]).sum(axis=-2)


@F.arrow_udf(T.StructType().add("frames", T.LongType()).add("mean", DOUBLES).add("spread", DOUBLES))
def frame_block(values: pa.Array, n: pa.Array, frames: pa.Array) -> pa.Array:
    """Moments of the frames that start in a block; a series shorter than a frame is stretched to one."""

    def moments(x, rows, short, most):
        count, mean, spread = frame_moments(stretch(x, 128) if short else x, most)
        return np.full(len(rows), count), mean, spread

    found = _grouped(values, [pc.less(n, 128).cast(pa.int64()), frames], moments, spare=4)
    return pa.StructArray.from_arrays([pa.array([int(c) for c, _, _ in found], pa.int64()), _lists([m for _, m, _ in found]), _lists([s for _, _, s in found])], ["frames", "mean", "spread"])


def box_widths(n: int, limit: int, count: int = 32) -> np.ndarray:
    return np.maximum(2, np.linspace(2, min(limit, max(3, n // 4)), count).astype(int))


def box_means(x: np.ndarray, width: int) -> np.ndarray:
    """Centred means over ``width`` points with zeros outside, same length as ``x``."""
    size = x.shape[-1]
    total = np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)
    at = np.arange(size)
    lo = np.clip(at - width // 2, 0, size)
    hi = np.clip(at + (width - 1) // 2 + 1, 0, size)
    return (total[..., hi] - total[..., lo]) / width


def order_amplitudes(x: np.ndarray, rpm: np.ndarray | float | None, rate: float, orders: int) -> np.ndarray:
    rpm = np.asarray(np.nan if rpm is None else rpm, dtype=float)
    known = np.isfinite(rpm) & (rpm > 0) & (rate > 0)
    if not known.any():
        return np.zeros((*x.shape[:-1], orders))
    mags = np.abs(hann_spectrum(x))
    freqs = np.fft.rfftfreq(x.shape[-1], 1.0 / rate)
    wanted = np.where(known, rpm, 1.0)[..., None] / 60.0 * np.arange(1, orders + 1)
    # distances equal to nine digits are equal, and the lower frequency counts
    near = np.round(np.abs(freqs - wanted[..., None]), 9).argmin(axis=-1)
    return np.where(known[..., None], standard(np.take_along_axis(mags, near, axis=-1)), 0.0)


@F.arrow_udf(DOUBLES)
def power_spectrum(values: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [], lambda x, rows: np.abs(np.fft.rfft(x)) ** 2))


@F.arrow_udf(DOUBLES)
def hann_magnitude(values: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [], lambda x, rows: np.abs(hann_spectrum(x))))


@F.arrow_udf(DOUBLES)
def short_time_summary(values: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [], lambda x, rows: frame_stats(x), spare=4))


@F.arrow_udf(DOUBLES)
def stretch_and_scale(values: pa.Array, length: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [length], lambda x, rows, n: standard(stretch(x, n))))


@F.arrow_udf(DOUBLES)
def order_profile(values: pa.Array, rpm: pa.Array, rate: pa.Array, orders: pa.Array) -> pa.Array:
    speeds, hertz = (pc.fill_null(c.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in (rpm, rate))
    if len(set(hertz.tolist())) > 1:
        raise ValueError("one rate for all windows is expected")
    return _lists(_grouped(values, [orders], lambda x, rows, k: order_amplitudes(x, speeds[rows], float(hertz[0]), k), spare=8))


@F.arrow_udf(DOUBLES)
def unwrapped_phase(values: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [], lambda x, rows: standard(np.unwrap(np.angle(hann_spectrum(x)), axis=-1))))


@F.arrow_udf(DOUBLES)
def stretched(values: pa.Array, length: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [length], lambda x, rows, n: stretch(x, n)))


@F.arrow_udf(DOUBLES)
def stretched_part(values: pa.Array, start: pa.Array, until: pa.Array, n: pa.Array, length: pa.Array) -> pa.Array:
    """The places of a stretched series that fall into one of its blocks; a missing reading counts as 0."""
    plain = pa.ListArray.from_arrays(values.offsets, pc.fill_null(values.values, 0.0)) if values.values.null_count else values
    return _lists(_grouped(plain, [start, until, n, length], lambda x, rows, *at: stretch_part(x, *at)))


def box_residuals(x: np.ndarray, first: int, last: int, n: int, limit: int) -> np.ndarray:
    """Sum of squares of ``x`` minus its box mean over ``[first, last)`` for every width of a series of ``n``."""
    widths, back = np.unique(box_widths(n, limit), return_inverse=True)
    sums = np.stack([np.square((x - box_means(x, w))[..., first:last]).sum(axis=-1) for w in widths], axis=-1)
    return sums[..., back]


@F.arrow_udf(DOUBLES)
def box_profile(values: pa.Array, limit: pa.Array) -> pa.Array:
    whole = lambda x, rows, top: np.log1p(np.sqrt(box_residuals(x, 0, x.shape[-1], x.shape[-1], top) / x.shape[-1]))
    return _lists(_grouped(values, [limit], whole, spare=4))


@F.arrow_udf(DOUBLES)
def box_block(values: pa.Array, first: pa.Array, core: pa.Array, n: pa.Array, limit: pa.Array) -> pa.Array:
    return _lists(_grouped(values, [first, core, n, limit], lambda x, rows, f, c, k, top: box_residuals(x, f, f + c, k, top), spare=4))


def band_values(magnitudes: np.ndarray, n: int, rate: float | None, bands: Sequence[tuple]) -> np.ndarray:
    """Energy shares of the closed bands, centroid, peak and the last share again, from the Hann magnitudes of ``n`` points."""
    power = magnitudes**2
    known = rate is not None and rate > 0
    freq = np.arange(power.shape[-1]) * (rate / n) if known else np.arange(power.shape[-1]) / (power.shape[-1] - 1)
    nyquist, whole = rate / 2.0 if known else 1.0, power.sum(axis=-1) + 1e-8
    inside = [(freq >= low) & (freq <= (nyquist if high is None else high)) for _, low, high in bands]
    shares = [power[..., i].sum(axis=-1) / whole for i in inside]
    return np.stack([*shares, (power * freq).sum(axis=-1) / whole, freq[power.argmax(axis=-1)], shares[-1]], axis=-1)


def grid_points(n: int, least: int = 64, most: int = 2048) -> int:
    """Power of two covering ``n``, between ``least`` and ``most``."""
    return max(least, min(most, 1 << (max(8, n) - 1).bit_length()))


def frequency_rows(x: np.ndarray, rate: float | None, wanted: set[str], length: int, grid: int, bands: Sequence[tuple]) -> np.ndarray:
    """The wanted transforms of each row side by side, resampled to ``length`` and standardised."""
    parts, n = [], x.shape[-1]
    if "fft" in wanted or not wanted:
        parts.append(np.log1p(np.abs(hann_spectrum(stretch(x, grid)))))
    if "fft" in wanted:
        points = grid_points(n)
        parts += [np.log1p(parts[0] * parts[0]), band_values(np.abs(hann_spectrum(stretch(x, points))), points, rate, bands)]
    if "stft" in wanted:
        parts.append(frame_stats(x))
    if "cwt" in wanted:
        parts.append(np.log1p(np.sqrt(box_residuals(x, 0, n, n, 64) / n)))
    return standard(stretch(np.concatenate(parts, axis=-1), length))


def frequency_batches(batches, rate: float | None, wanted: set[str], length: int, grid: int, bands: Sequence[tuple]):
    """Arrow batches (keys, ``values``) to batches (keys, ``frequency``) of at most ROWS rows."""
    for batch in batches:
        at = batch.schema.get_field_index("values")
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            found = _grouped(part.column(at), [], lambda x, rows: frequency_rows(x, rate, wanted, length, grid, bands), spare=4, least=max(length, 2048))
            keys = [k for k in range(part.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _lists(found)], [*(part.schema.names[k] for k in keys), "frequency"])
