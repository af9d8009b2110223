"""Per-channel statistics, cross-channel correlation and profile vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES_CHANNEL = ["series_id", "channel"]
# Order of the statistics of one channel.
STATISTICS = ["mean", "std", "rms", "peak", "kurtosis", "skewness", "crest_factor"]


def time_features(df: DataFrame, by: Sequence[str] = SERIES_CHANNEL, flavor: str = "cut", value: str = "value") -> DataFrame:
    """Seven moment statistics per group in one map-side combined aggregate.

    ``cut``: excess kurtosis and plain skewness, null on a constant group.  ``plain``: moments divided by
    powers of the standard deviation plus 1e-12, so a constant group gives zero.
    """
    if flavor not in ("cut", "plain"):
        raise ValueError(f"unknown flavor {flavor!r}")
    v = F.col(value).cast("double")
    base = df.groupBy(*by).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.max(F.abs(v)).alias("peak"),
        F.kurtosis(v).alias("kurtosis"),
        F.skewness(v).alias("skewness"),
    )
    if flavor == "cut":
        return base.withColumn("crest_factor", F.col("peak") / (F.col("rms") + 1e-10))
    s3, s4 = F.pow("std", F.lit(3)), F.pow("std", F.lit(4))
    return (
        base.withColumn("kurtosis", F.coalesce((F.col("kurtosis") + 3.0) * s4 / (s4 + 1e-12), F.lit(0.0)))
        .withColumn("skewness", F.coalesce(F.col("skewness") * s3 / (s3 + 1e-12), F.lit(0.0)))
        .withColumn("crest_factor", F.col("peak") / (F.col("rms") + 1e-12))
    )


def features_wide(features: DataFrame, channels: Sequence[str], by: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series with ``channel_statistic`` columns in fixed order."""
    wide = features.groupBy(*by).agg(
        *[
            F.first(F.when(F.col("channel") == c, F.col(s)), ignorenulls=True).alias(f"{c}_{s}")
            for c in channels
            for s in STATISTICS
        ]
    )
    return wide


def channel_corr(
    df: DataFrame, channels: Sequence[str] | None = None, series: str = "series_id", seq: str = "seq", value: str = "value"
) -> DataFrame:
    """Pearson correlation of every channel pair of a series, aligned on the position.

    All channels present take part, or those listed.  Channels meet by an equi-join on (series, position), one row per
    pair of readings, and every pair is one mergeable aggregate.  Pairs with a nearly constant member are left out.
    """
    held = df if channels is None else df.filter(F.col("channel").isin(list(channels)))
    spread = held.groupBy(series, "channel").agg(F.stddev_pop(value).alias("_s"))
    moving = held.join(spread.filter(F.col("_s") > 1e-6).drop("_s"), [series, "channel"], "left_semi")
    side = lambda name: moving.select(series, seq, F.col("channel").alias(f"channel_{name}"), F.col(value).alias(f"_{name}"))
    pairs = side("a").join(side("b"), [series, seq]).filter(F.col("channel_a") < F.col("channel_b"))
    found = pairs.groupBy(series, "channel_a", "channel_b").agg(F.corr("_a", "_b").alias("r"))
    return found.filter(F.col("r").isNotNull() & ~F.isnan("r"))


def mean_abs_corr(corr: DataFrame, series: DataFrame, by: str = "series_id") -> DataFrame:
    """Mean absolute correlation per series, 0 where no pair qualifies."""
    means = corr.groupBy(by).agg(F.avg(F.abs("r")).alias("mean_abs_corr"))
    return series.select(by).distinct().join(means, by, "left").withColumn(
        "mean_abs_corr", F.coalesce("mean_abs_corr", F.lit(0.0))
    )


def channel_graph(corr: DataFrame, nodes: DataFrame, top_k: int, threshold: float, by: str = "series_id") -> DataFrame:
    """Sparse row-normalised affinity edges per series from absolute correlations.

    Every node has a self edge of 1; each row keeps its ``top_k`` strongest edges (ties by channel name)
    and drops those below ``threshold``.
    """
    one_way = corr.select(by, F.col("channel_a").alias("source"), F.col("channel_b").alias("target"), F.abs("r").alias("affinity"))
    other = one_way.select(by, F.col("target").alias("source"), F.col("source").alias("target"), "affinity")
    loops = nodes.select(by, F.col("channel").alias("source"), F.col("channel").alias("target"), F.lit(1.0).alias("affinity"))
    row = W.partitionBy(by, "source")
    ranked = one_way.unionByName(other).unionByName(loops).withColumn(
        "_rank", F.row_number().over(row.orderBy(F.desc("affinity"), "target"))
    )
    kept = ranked.filter((F.col("_rank") <= top_k) & (F.col("affinity") >= threshold))
    return kept.withColumn("weight", F.col("affinity") / F.sum("affinity").over(row)).drop("_rank")


def graph_summary(edges: DataFrame, nodes: DataFrame, by: str = "series_id") -> DataFrame:
    """Edge count, density and mean affinity per series."""
    counted = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"))
    return (
        counted.join(edges.groupBy(by).agg(F.count(F.lit(1)).alias("edges"), F.avg("affinity").alias("mean_affinity")), by, "left")
        .withColumn("edge_count", F.coalesce("edges", F.lit(0)))
        .withColumn("density", F.col("edge_count") / F.pow(F.greatest("nodes", F.lit(1)), F.lit(2)))
        .select(by, "nodes", "edge_count", "density", F.coalesce("mean_affinity", F.lit(0.0)).alias("mean_affinity"))
    )


def subgraph_pool(features: DataFrame, groups: DataFrame, columns: Sequence[str], by: str = "series_id") -> DataFrame:
    """Mean feature vector of the channels sharing a group; ``groups(channel, tag)`` is a small dimension."""
    return features.join(groups, "channel").groupBy(by, "tag").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(c) for c in columns]
    )


def signal_profile(
    per_channel: DataFrame, spectral: DataFrame, corr: DataFrame, descriptors: DataFrame, by: str = "series_id"
) -> DataFrame:
    """21 profile numbers per series from channel statistics, spectra, correlations and descriptors.

    ``per_channel(mean, std, rms, peak, m4)``, ``spectral(centroid, entropy, high, mid, low)`` are one row per
    series and channel, ``descriptors(channel, source, quantity)`` one row per channel name.
    """
    joined = per_channel.join(spectral, [by, "channel"], "left").join(descriptors, "channel", "left")
    share = lambda column, wanted: F.avg((F.coalesce(F.col(column), F.lit("unknown")) == wanted).cast("double"))
    std = F.col("std") + 1e-6
    means = joined.groupBy(by).agg(
        F.count(F.lit(1)).cast("double").alias("channel_count"),
        share("source", "external_sensor").alias("external_sensor_ratio"),
        share("source", "machine_controller").alias("machine_controller_ratio"),
        *[
            share("quantity", q).alias(f"{q}_ratio")
            for q in ("vibration", "force", "torque", "current", "position", "position_error")
        ],
        F.avg("rms").alias("mean_rms"),
        F.stddev_pop("rms").alias("std_rms"),
        F.max("rms").alias("max_rms"),
        F.avg("peak").alias("mean_peak"),
        F.avg(F.col("peak") / (F.col("rms") + 1e-6)).alias("mean_crest_factor"),
        F.avg(F.col("m4") / F.pow(std, F.lit(4))).alias("mean_kurtosis"),
        F.avg("centroid").alias("mean_spectral_centroid"),
        F.avg("entropy").alias("mean_spectral_entropy"),
        F.avg("high").alias("mean_high_band_ratio"),
        F.avg("mid").alias("mean_mid_band_ratio"),
        F.avg("low").alias("mean_low_band_ratio"),
    )
    correlated = corr.groupBy(by).agg(F.avg(F.abs("r")).alias("mean_abs_corr"))
    full = means.join(correlated, by, "left")
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    return full.select(by, *[finite(c).alias(c) for c in full.columns if c != by])


# Upper bounds of the low / medium / high levels per profile number.
TOKEN_LEVELS = [
    ("latent_channel_count", "channel_count", (3.0, 8.0, 16.0)),
    ("latent_dynamic", "mean_crest_factor", (1.8, 2.8, 4.0)),
    ("latent_spectral_entropy", "mean_spectral_entropy", (1.0, 2.0, 3.0)),
    ("latent_high_band", "mean_high_band_ratio", (0.15, 0.35, 0.55)),
    ("latent_cross_channel", "mean_abs_corr", (0.15, 0.35, 0.60)),
]


def latent_tokens(profile: DataFrame, quantities: DataFrame, by: str = "series_id", most: int | None = None) -> DataFrame:
    """Level tokens of the profile after its sorted quantity tokens (the first ``most`` if given).

    ``quantities(series_id, quantity)`` holds the channel quantities seen in a series.
    """
    named = quantities.filter(F.col("quantity") != "unknown").groupBy(by).agg(F.array_sort(F.collect_set("quantity")).alias("_q"))
    levels = [
        F.concat(
            F.lit(prefix + "_"),
            F.when(F.col(c) < cut[0], "low").when(F.col(c) < cut[1], "medium").when(F.col(c) < cut[2], "high").otherwise("very_high"),
        )
        for prefix, c, cut in TOKEN_LEVELS
    ]
    listed = F.coalesce("_q", F.array().cast("array<string>"))
    lead = F.transform(listed if most is None else F.slice(listed, 1, most), lambda q: F.concat(F.lit("latent_quantity_"), q))
    return profile.join(named, by, "left").select(by, F.concat(lead, F.array(*levels)).alias("tokens"))
