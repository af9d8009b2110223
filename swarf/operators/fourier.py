"""Exact Fourier transforms of one long series over many tasks.

A transform of length L = P * M takes the readings of each remainder modulo P apart, transforms these parts (length M) in
tasks of their own, multiplies by twiddle factors, and transforms across the remainders (length P) for runs of frequencies.
No task holds more than about ``block`` readings of a series.  Lengths that are no power of two go through a convolution
with a chirp of the next sufficient power of two, so every length is exact.  Features of a series of at most ``block``
readings come from its array, many series to a batch: dealing out a series that fits a task costs far more than it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.operators.lineage import checkpointed, stored
from swarf.operators.series import KEYS, group_sizes
from swarf.operators.spectral import dft_features

BLOCK = 1 << 16


def _layout(l: int, block: int) -> tuple[int, int, int, int]:
    """(parts P, their length M, parts per task, frequencies per task) of a transform of length 2^l."""
    parts, length = 1 << l // 2, 1 << l - l // 2
    return parts, length, min(parts, max(1, block // length)), min(length, max(1, block // parts))


def transform(rows: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The transform of each group of (by, _l, pos, re, im): values at positions 0 to 2^_l - 1, absent ones being 0."""
    by = list(by)
    heads = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def named(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        out = pd.DataFrame(columns)
        for k, c in enumerate([*by, "_l"]):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        l, group = int(pdf["_l"].iloc[0]), int(pdf["_g"].iloc[0])
        parts, length, some, run = _layout(l, block)
        pos = pdf["pos"].to_numpy(np.int64)
        x = np.zeros((some, length), complex)
        x[pos % parts - group * some, pos // parts] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        part = group * some + np.arange(some)
        y = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi * (part[:, None] * np.arange(length)) / (1 << l))
        cuts = [y[:, k : k + run].ravel() for k in range(0, length, run)]
        return named(pdf, _g=np.full(len(cuts), group), _c=np.arange(len(cuts)), re=[c.real for c in cuts], im=[c.imag for c in cuts])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        l, cut = int(pdf["_l"].iloc[0]), int(pdf["_c"].iloc[0])
        parts, length, some, run = _layout(l, block)
        y = np.zeros((parts, run), complex)
        for group, re, im in zip(pdf["_g"], pdf["re"], pdf["im"]):
            y[group * some : (group + 1) * some] = (np.asarray(re) + 1j * np.asarray(im)).reshape(some, run)
        found = np.fft.fft(y, axis=0).ravel()
        pos = (np.arange(parts)[:, None] * length + cut * run + np.arange(run)).ravel()
        return named(pdf, pos=pos, re=found.real, im=found.imag)

    parts = "shiftleft(1L, cast(_l div 2 AS int))"
    some = f"least({parts}, greatest(1L, {block}L div shiftleft(1L, cast(_l - _l div 2 AS int))))"
    dealt = rows.select(*by, "_l", "pos", "re", "im", F.expr(f"(pos % {parts}) div {some}").alias("_g"))
    first = dealt.groupBy(*by, "_l", "_g").applyInPandas(within, f"{heads}, _l int, _g long, _c long, re array<double>, im array<double>")
    return first.groupBy(*by, "_l", "_c").applyInPandas(across, f"{heads}, _l int, pos long, re double, im double")


def spectrum(df: DataFrame, by: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """(by, n, pos, re, im): the transform of each whole series at frequencies 0 to n // 2."""
    by = list(by)
    two = F.log2(F.col("n").cast("double"))
    held = df.select(*by, F.col("seq").cast("long").alias("pos"), F.col("value").cast("double").alias("re")).join(group_sizes(df, by), by)
    held = held.withColumns({"im": F.lit(0.0), "_even": F.expr("(n & (n - 1)) = 0")})
    plain = held.filter("_even").withColumn("_l", F.round(two).cast("int"))
    odd = held.filter("NOT _even").withColumn("_l", F.ceil(F.log2((2 * F.col("n") - 1).cast("double"))).cast("int"))
    # the chirp exp(-i pi k^2 / n); k^2 is taken modulo 2 n, so that its angle stays exact
    angle = F.pmod(F.col("pos") * F.col("pos"), 2 * F.col("n")) * F.lit(np.pi) / F.col("n")
    turned = odd.withColumns({"_cos": F.cos(angle), "_sin": F.sin(angle), "_x": F.col("re")})
    size = F.expr("shiftleft(1L, _l)")
    term = lambda side, pos, re, im: F.struct(F.lit(side).alias("_side"), pos.alias("pos"), re.alias("re"), im.alias("im"))
    zero = F.lit(0.0)
    terms = F.array(
        term(0, F.col("pos"), F.col("_x") * F.col("_cos"), -F.col("_x") * F.col("_sin")),
        term(1, F.col("pos"), F.col("_cos"), F.col("_sin")),
        term(1, F.when(F.col("pos") > 0, size - F.col("pos")), F.col("_cos"), F.col("_sin")),
    )
    both = transform(turned.select(*by, "_l", F.explode(terms).alias("t")).select(*by, "_l", "t.*").filter("pos IS NOT NULL"), [*by, "_side"], block)
    pair = both.groupBy(*by, "_l", "pos").agg(
        *[F.sum(F.when(F.col("_side") == s, F.col(c)).otherwise(zero)).alias(f"{c}{s}") for s in (0, 1) for c in ("re", "im")]
    )
    # the inverse transform of the product, by conjugates
    product = pair.select(*by, "_l", "pos", (F.col("re0") * F.col("re1") - F.col("im0") * F.col("im1")).alias("re"), (-F.col("re0") * F.col("im1") - F.col("im0") * F.col("re1")).alias("im"))
    back = transform(product, by, block)
    chirp = turned.select(*by, "n", "pos", "_cos", "_sin").filter("pos <= n div 2")
    unchirped = back.withColumns({"_re": F.col("re") / size, "_im": -F.col("im") / size}).drop("re", "im").join(chirp, [*by, "pos"]).select(
        *by, "n", "pos", (F.col("_re") * F.col("_cos") + F.col("_im") * F.col("_sin")).alias("re"), (F.col("_im") * F.col("_cos") - F.col("_re") * F.col("_sin")).alias("im")
    )
    direct = transform(plain, by, block).join(group_sizes(df, by), by).filter("pos <= n div 2").select(*by, "n", "pos", "re", "im")
    return direct.unionByName(unchirped)


def spectrum_features(df: DataFrame, rate: float = 1.0, by: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Energy, centroid, dominant frequency and entropy of whole series of any length, no array holding over ``block`` readings."""
    by = list(by)
    held = stored(df.select(*by, "seq", "value"))
    # a series of over ``block`` readings has that many rows, so this side is small at any size
    large = checkpointed(group_sizes(held, by).filter(F.col("n") > block).select(*by))
    short = dft_features(held.join(F.broadcast(large), by, "left_anti"), rate, by)
    return short if large.isEmpty() else short.unionByName(_large_features(held.join(F.broadcast(large), by, "left_semi"), rate, by, block))


def _large_features(df: DataFrame, rate: float, by: list[str], block: int) -> DataFrame:
    power = spectrum(df, by, block).select(*by, F.col("pos"), (F.col("pos") * F.lit(float(rate)) / F.col("n")).alias("_f"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p"))
    whole = power.groupBy(*by).agg((F.sum("_p") + 1e-12).alias("band_energy"), F.max_by("_f", F.struct("_p", -F.col("pos"))).alias("dominant_frequency"))
    shares = power.join(whole, by).withColumn("_q", F.col("_p") / F.col("band_energy"))
    return shares.groupBy(*by, "band_energy", "dominant_frequency").agg(
        F.sum(F.col("_q") * F.col("_f")).alias("spectral_centroid"), (-F.sum(F.col("_q") * F.log(F.col("_q") + 1e-12))).alias("spectral_entropy")
    ).select(*by, "band_energy", "spectral_centroid", "dominant_frequency", "spectral_entropy")
