"""Corpus preparation: inventory to registry, manifest and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.functions.spectra import stretched
from swarf.operators import catalog, channels, nc, series, spectral, text
from swarf.operators.lineage import checkpointed


def prepare_corpus(files: DataFrame) -> dict[str, DataFrame]:
    """Described inventory, registry, grades and manifest of a file listing with channel names."""
    dim = channels.canonicalize_channels(files.select(F.explode("raw_channel_names").alias("raw_name")))
    inventory = catalog.describe_inventory(files, dim)
    registry = catalog.build_registry(inventory)
    return {
        "channels": dim,
        "inventory": inventory,
        "registry": registry,
        "grades": catalog.grade_datasets(inventory),
        "manifest": catalog.build_manifest(inventory, registry),
    }


def training_table(
    samples: DataFrame, readings: DataFrame, programs: DataFrame | None = None, window: int = 4096, vocabulary: int = 4096, rate: float | None = None,
    frequency_length: int = 512, text_length: int | None = None, salt: str = "0", vectors: DataFrame | None = None,
) -> DataFrame:
    """One row per sample and channel: window, ids, frequency view, text ids, program match and program vector.

    ``samples(series_id, dataset_id, file_path, …)``, ``readings(series_id, channel, seq, value)`` and, if given,
    ``programs`` as returned by ``nc.program_keys`` and ``vectors`` by ``nc.nc_vector``.  All words of a text context are
    coded unless ``text_length`` is given.
    """
    keys = ["series_id", "channel"]
    dim = channels.channel_ids(channels.signal_channels(channels.canonicalize_channels(readings, "channel")), vocabulary)
    dim = dim.withColumnRenamed("raw_name", "channel").select(
        "channel", "canonical_name", "channel_id", F.array(*[F.col(f"{n}_id") for n in ("quantity", "axis", "source", "component", "representation")]).alias("attribute_ids"),
        "quantity", "source",
    )
    kept = readings.join(dim.select("channel"), "channel", "left_semi")
    cut = series.sample_window(kept, window, salt)
    # the sampled windows are a fraction of the readings and feed several branches: written once
    cut = checkpointed(cut.select(*keys, (F.col("seq") - F.col("start")).alias("seq"), "value"))
    cut = spectral.repaired(cut, keys)
    values = spectral.window_arrays(series.clip_standardize(cut).select(*keys, "seq", F.col("scaled").alias("value")))
    # rows of one length: shorter series are stretched over the window
    values = values.withColumn("values", stretched("values", F.lit(window)))
    views = spectral.frequency_view(cut, rate, length=frequency_length, window=window).drop("window")
    described = cut.select(*keys).distinct().join(dim, "channel").groupBy("series_id").agg(
        F.collect_set("quantity").alias("quantities"), F.collect_set("source").alias("sources")
    )
    named = samples.join(described, "series_id", "left").withColumn("_none", F.expr("cast(map() AS map<string,string>)"))
    empty = F.expr("cast(array() AS array<string>)")
    named = named.withColumns({c: F.coalesce(c, empty) for c in ("quantities", "sources")})
    contexts = text.record_context(named, "_none", "quantities", "sources")
    coded = text.encode_tokens(text.tokenize(contexts, "text_context"), length=text_length).drop("tokens", "_none", "quantities", "sources")
    if programs is not None:
        fields = [c for c in ("file_path", "sample_id", "dataset_id") if c in coded.columns]
        coded = nc.match_context(coded, programs, fields)
        if vectors is not None:
            coded = nc.attach_context(coded, vectors)
    return values.join(views, keys).join(dim.drop("quantity", "source"), "channel").join(coded, "series_id")
