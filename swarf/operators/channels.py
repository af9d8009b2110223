"""Mapping of raw channel spellings onto the canonical five-part vocabulary.

All rules run on the distinct names only: the result is a small dimension that is joined back to the
readings, so rule evaluation does not grow with the number of readings.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.functions.hashing import vocabulary_id
from swarf.functions.matching import (
    contains_any, first_contained, first_match, literals, lookup, normalize_name, one_of, stem, word_match,
)
from swarf.rules import channels as rules
from swarf.operators.scan import core_rows, with_neighbours, BLOCK


@F.pandas_udf(T.StringType())
def compatibility_form(names: pd.Series) -> pd.Series:
    """NFKC form; Spark has no built-in for it."""
    return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def canonicalize_channels(names: DataFrame, column: str = "raw_name", unicode_names: bool = True) -> DataFrame:
    """One row per distinct raw name with its canonical name and five attributes.

    Non-ASCII spellings of ASCII letters take their compatibility form first; unset ``unicode_names`` to leave them.
    """
    distinct = names.select(F.col(column).alias("raw_name")).distinct()
    # plain ASCII names do not pass through Python
    plain = F.col("raw_name").rlike(r"^[\x00-\x7F]*$")
    base = F.coalesce(compatibility_form(F.when(~plain, F.col("raw_name"))), F.col("raw_name")) if unicode_names else F.col("raw_name")
    named = distinct.withColumn("_base", base).withColumn("normalized", normalize_name(F.col("_base"))).drop("_base")
    text, tokens, raw = F.col("normalized"), F.split("normalized", "_"), F.col("raw_name")

    given = F.split(raw, r"\.")
    order = ["source", "component", "quantity", "axis", "representation"]
    is_canonical = F.size(given) >= 5
    for i, name in enumerate(order):
        is_canonical = is_canonical & F.coalesce(one_of(F.get(given, F.lit(i)), rules.ATTRIBUTES[name]), F.lit(False))
    exact = F.when(is_canonical, raw).otherwise(lookup(rules.EXACT_NAMES, text))

    quantity = first_match(rules.QUANTITY_WORDS, text, tokens, F.lit("unknown"))
    number = F.coalesce(
        F.nullif(F.regexp_extract(raw, r"(?::|[_-])(\d+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(text, r"(?:^|_)(\d+)$", 1), F.lit("")),
    ).cast("decimal(38,0)")
    numbered = (
        F.when(one_of(F.col("_q"), rules.VECTOR_QUANTITIES) & (number < 3), F.element_at(literals(["x", "y", "z"]), number.cast("int") + 1))
        .when(number < 32, F.concat(F.lit("channel_"), number.cast("int").cast("string")))
        .otherwise(F.lit("none"))
    )
    axis = first_match(rules.AXIS_WORDS, text, tokens, numbered)
    explicit = first_match(rules.REPRESENTATION_WORDS, text, tokens, F.lit(None).cast("string"))
    source = (
        F.when(one_of(F.col("_r"), rules.DERIVED_REPRESENTATIONS), "derived_feature")
        .when(one_of(F.col("_q"), rules.PROCESS_CONDITION_QUANTITIES), "process_condition")
        .when(word_match(text, tokens, rules.CONTROLLER_WORDS), "machine_controller")
        .when(word_match(text, tokens, rules.SENSOR_WORDS), "external_sensor")
        .when(one_of(F.col("_q"), rules.EXTERNAL_SENSOR_QUANTITIES), "external_sensor")
        .when(F.col("_q") != "unknown", "machine_controller")
        .otherwise("unknown")
    )
    inferred = (
        named.withColumns({"_exact": exact, "_q": quantity, "_r": explicit})
        .withColumns({"_a": axis, "_s": source, "_c": first_match(rules.COMPONENT_WORDS, text, tokens, F.lit("unknown"))})
        .withColumn("_r", F.coalesce("_r", F.when(F.col("_s") == "machine_controller", "actual").otherwise("raw")))
    )
    tail = F.when(F.length(text) == 0, F.substring(F.sha1(raw), 1, 12)).otherwise(F.expr("right(normalized, 64)"))
    built = F.concat_ws(".", "_s", "_c", "_q", "_a", "_r", F.when(F.col("_q") == "unknown", tail))
    parts = F.split("_exact", r"\.")
    use = lambda i, guess: F.when(F.col("_exact").isNotNull(), F.get(parts, F.lit(i))).otherwise(F.col(guess))
    described = F.struct(
        "normalized", F.coalesce("_exact", built).alias("canonical_name"),
        *[use(i, g).alias(n) for i, (n, g) in enumerate(zip(order, ["_s", "_c", "_q", "_a", "_r"]))],
    )
    # Grouping by the already distributed name costs no exchange and keeps later filters from being
    # merged into the long rule expressions.
    return inferred.groupBy("raw_name").agg(F.first(described).alias("_d")).select("raw_name", "_d.*")


def channel_ids(dim: DataFrame, vocabulary: int) -> DataFrame:
    """Stable identity of each canonical name and the vocabulary position of each attribute."""
    position = lambda name: (F.array_position(literals(rules.ATTRIBUTES[name]), F.col(name)) - 1).cast("int")
    return dim.withColumn("channel_id", vocabulary_id("canonical_name", vocabulary)).withColumns(
        {f"{n}_id": position(n) for n in rules.ATTRIBUTES}
    )


def is_metadata_name(normalized: Column) -> Column:
    return normalized.rlike("|".join(rules.METADATA_PATTERNS))


def signal_channels(dim: DataFrame) -> DataFrame:
    """Known, non-label, non-derived channels whose name is not bookkeeping."""
    return dim.filter(
        (F.col("quantity") != "unknown")
        & ~one_of(F.col("quantity"), rules.NON_SIGNAL_QUANTITIES)
        & (F.col("source") != "derived_feature")
        & ~one_of(F.col("representation"), rules.DERIVED_REPRESENTATIONS)
        & ~is_metadata_name(F.col("normalized"))
    )


def dedup_channels(channels: DataFrame, dim: DataFrame, max_channels: int, by: str = "series_id", order: str = "position") -> DataFrame:
    """First channel per canonical name in source order, then at most ``max_channels`` per series.

    Works on the channel list of a series (names, not readings).
    """
    known = channels.join(signal_channels(dim).select("raw_name", "canonical_name"), "raw_name")
    first = known.withColumn("_k", F.row_number().over(W.partitionBy(by, "canonical_name").orderBy(order))).filter("_k = 1")
    ranked = first.withColumn("slot", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return ranked.filter(F.col("slot") <= max_channels).drop("_k")


def split_channel_roles(channels: DataFrame, max_raw: int, max_controller: int, by: str = "series_id", order: str = "position") -> DataFrame:
    """High-rate waveform and controller channels by name hints, with the two fallbacks by position.

    ``channels(series_id, position, raw_name, path)``: names of a series, not readings.
    """
    name, path, group = F.lower("raw_name"), F.lower("path"), W.partitionBy(by)
    high = contains_any(name, rules.HIGH_RATE_HINTS) | one_of(name, rules.WAVEFORM_NAMES)
    only_controller = contains_any(path, rules.CONTROLLER_PATHS) & ~contains_any(path, rules.HIGH_RATE_HINTS)
    hinted = channels.withColumns(
        {"_high": high, "_slot": F.row_number().over(group.orderBy(order)), "_ctrl": ~high & contains_any(name, rules.CONTROLLER_HINTS)}
    )
    any_high = F.max("_high").over(group)
    any_ctrl = F.max("_ctrl").over(group)
    first_three = ~any_high & ~only_controller & (F.col("_slot") <= 3)
    raw = hinted.withColumn("_raw", F.col("_high") | first_three).withColumn("_anyctrl", any_ctrl)
    role = F.when(F.col("_raw"), "raw").when(F.col("_ctrl") | ~F.col("_anyctrl"), "cnc")
    # a channel taken by the position fallback stays a controller channel too when it is hinted as one
    both = F.when(F.col("_raw") & F.col("_ctrl"), F.array(F.lit("raw"), F.lit("cnc"))).otherwise(F.array(role))
    roles = raw.withColumn("role", F.explode(both)).filter(F.col("role").isNotNull())
    ranked = roles.withColumn("slot", F.row_number().over(W.partitionBy(by, "role").orderBy(order)))
    limit = F.when(F.col("role") == "raw", max_raw).otherwise(max_controller)
    return ranked.filter(F.col("slot") <= limit).select(*channels.columns, "role", "slot")


def sefc_group(dim: DataFrame, name: str = "raw_name") -> DataFrame:
    """Setpoint / effort / feedback / context group and its number."""
    group = first_contained(rules.SEFC_GROUPS, F.lower(name), "context")
    order = literals([g for g, _ in rules.SEFC_GROUPS])
    return dim.withColumn("sefc_group", group).withColumn("sefc_id", (F.array_position(order, F.col("sefc_group")) - 1).cast("int"))


def sensor_view(dim: DataFrame, name: str = "raw_name", rate: str = "sampling_rate") -> DataFrame:
    """Rate class and view of a channel from its sampling rate and name."""
    text, hz = F.lower(name), F.col(rate).try_cast("double")
    high, low = F.lit("high_rate_raw_timeseries"), F.lit("cnc_low_rate_timeseries")
    view = (
        F.when(hz >= 1000.0, high)
        .when(contains_any(text, rules.VIEW_HIGH_WORDS), high)
        .when(contains_any(text, rules.VIEW_LOW_WORDS), low)
        .when(hz >= 500.0, high)
        .otherwise(low)
    )
    group = F.when(hz >= 1000.0, "high_rate").when(hz > 0, "low_rate").otherwise("unknown")
    return dim.withColumn("sensor_view", view).withColumn("rate_group", group)


def map_alias(df: DataFrame, aliases: DataFrame, name: str = "raw_name") -> DataFrame:
    """Canonical variable of a name by ``aliases(canonical, alias, priority)``, else the trimmed lower-case name."""
    listed = aliases.select(F.lower("alias").alias("_key"), "canonical", "priority")
    own = aliases.select(F.col("canonical").alias("_key"), "canonical", "priority")
    table = listed.unionByName(own).groupBy("_key").agg(F.min_by("canonical", "priority").alias("variable"))
    return df.withColumn("_key", F.lower(F.trim(name))).join(table, "_key", "left").withColumn(
        "variable", F.coalesce("variable", "_key")
    ).drop("_key")


def name_headerless(columns: DataFrame, path: str = "path", index: str = "column_index") -> DataFrame:
    """Names for numbered columns of files without a header, from hints in the last path parts."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 3), F.least(F.lit(3), F.size(parts) - 1))
    clue = F.array_join(F.transform(F.concat(dirs, F.array(stem(F.col(path)))), lambda p: F.regexp_replace(F.lower(p), r"[^a-z0-9]+", "_")), "_")
    at = F.col(index)
    axis = F.coalesce(F.get(literals(rules.VECTOR_AXES), at), F.concat(F.lit("channel_"), at.cast("string")))
    force = F.coalesce(F.get(literals(rules.FORCE_TORQUE_NAMES), at), F.concat(F.lit("force_channel_"), at.cast("string")))
    prefix = F.concat(stem(F.col(path)), F.lit("/"))
    name = (
        F.when(contains_any(clue, ["vib", "acc"]), F.concat(prefix, F.lit("vibration_"), axis))
        .when(contains_any(clue, ["force", "torque"]), F.concat(prefix, force))
        .when(contains_any(clue, ["current"]), F.concat(prefix, F.lit("current_"), axis))
        .otherwise(at.cast("string"))
    )
    return columns.withColumn("raw_name", name)


def drop_time_channel(readings: DataFrame, channels: DataFrame, by: str = "series_id") -> DataFrame:
    """Remove the first channel of a series when it is bookkeeping or a steadily rising or falling axis.

    ``channels(series_id, channel, position)`` orders the channels; only first channels are examined.
    """
    several = channels.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min_by("channel", "position").alias("channel")).filter("_n > 1")
    first = readings.join(several.select(by, "channel"), [by, "channel"]).filter(~F.isnan("value") & F.col("value").isNotNull())
    step = F.col("value") - F.lag("value", 1).over(W.partitionBy(by, "channel", BLOCK).orderBy("seq"))
    steps = core_rows(with_neighbours(first, 1, 0).withColumn("_d", step))
    shape = steps.groupBy(by, "channel").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"),
        F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"),
    )
    named = is_metadata_name(normalize_name(F.col("channel")))
    steady = (F.col("_rows") >= 8) & ((F.col("_lo") >= 0) | (F.col("_hi") <= 0)) & (
        F.col("_s") <= F.greatest(F.abs("_m") * 0.01, F.lit(1e-12))
    )
    timelike = shape.filter(named | steady).select(by, "channel")
    return readings.join(timelike, [by, "channel"], "left_anti")
