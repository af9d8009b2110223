"""File inventory, dataset registry and manifest operators.

Inventories are long and their dataset sizes very uneven, so per-dataset work is either a map-side
combined aggregate or a rank filter that Spark prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swarf.functions.matching import (
    contains_any, extension, first_contained, literals, lookup, matching_values, path_parts, slug, stem,
)
from swarf.operators.channels import signal_channels
from swarf.operators.scan import running
from swarf.rules import catalog as rules
from swarf.rules.channels import SCHEMA_VERSION

NO_STRINGS = "cast(array() AS array<string>)"


def classify_files(files: DataFrame, root_name: str = "root") -> DataFrame:
    """Dataset, extension, depth and type class from ``relative_path``."""
    parts = path_parts(F.col("relative_path"))
    types = {e: kind for kind, exts in rules.FILE_TYPES for e in exts}
    return files.withColumns(
        {
            "dataset_name": F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(root_name)),
            "file_extension": extension(F.col("relative_path")),
            "directory_depth": F.greatest(F.lit(0), F.size(parts) - 1),
        }
    ).withColumn("file_type", F.coalesce(lookup(types, F.col("file_extension")), F.lit("unknown")))


def inspect_sample(files: DataFrame, k: int) -> DataFrame:
    """Mark the first ``k`` files per dataset and extension as sampled, the others as metadata only."""
    group = W.partitionBy("dataset_name", "file_extension").orderBy("relative_path")
    chosen = (
        files.select("dataset_name", "file_extension", "relative_path")
        .withColumn("_k", F.row_number().over(group))
        .filter(F.col("_k") <= k)
        .select("relative_path", F.lit("sampled").alias("_mode"))
    )
    return files.join(chosen, "relative_path", "left").withColumn(
        "inspection_mode", F.coalesce("_mode", F.lit("metadata_only"))
    ).drop("_mode")


def attach_channels(files: DataFrame, dim: DataFrame, key: str = "file_id") -> DataFrame:
    """Canonical signal channels and quantities of each file, in first-seen order.

    Only the channel list of a file is grouped, which is bounded by the width of one file.
    """
    exploded = files.select(key, F.posexplode("raw_channel_names").alias("_p", "raw_name"))
    known = exploded.join(signal_channels(dim).select("raw_name", "canonical_name", "quantity"), "raw_name")
    grouped = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "canonical_name", "quantity"))).alias("_c"))
    listed = grouped.select(
        key,
        F.array_distinct(F.transform("_c", lambda c: c["canonical_name"])).alias("sensor_channels"),
        F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["quantity"]))).alias("sensor_quantities"),
    )
    return files.join(listed, key, "left").withColumns(
        {n: F.coalesce(n, F.expr(NO_STRINGS)) for n in ("sensor_channels", "sensor_quantities")}
    )


def _detect(rule_list, haystack: Column, mode: str) -> Column:
    if mode == "compat":
        return matching_values(rule_list, lambda words: contains_any(haystack, words))
    tokens = F.regexp_extract_all(haystack, F.lit("[a-z0-9_]+"), F.lit(0))
    return matching_values(rule_list, lambda words: F.arrays_overlap(tokens, literals(words)))


def describe_inventory(files: DataFrame, dim: DataFrame, mode: str = "compat", raw_bytes: int = rules.RAW_SIGNAL_BYTES) -> DataFrame:
    """Labels, conditions, modalities, tasks and corpus flags of each file.

    ``compat`` finds words anywhere in path and channel names, ``token`` only as whole tokens.
    """
    if mode not in ("compat", "token"):
        raise ValueError(f"unknown mode {mode!r}")
    known = attach_channels(classify_files(files), dim)
    hay = known.withColumn("haystack", F.lower(F.concat_ws(" ", "relative_path", F.array_join("raw_channel_names", " "))))
    text, kind, sensors = F.col("haystack"), F.col("file_type"), F.size("sensor_channels") > 0
    found = hay.withColumns({"label_columns": _detect(rules.LABEL_WORDS, text, mode), "condition_columns": _detect(rules.CONDITION_WORDS, text, mode)})
    tasks = F.concat(
        F.transform("label_columns", lambda l: lookup(rules.LABEL_TASKS, l)),
        F.when(contains_any(text, rules.FORECASTING_WORDS), F.expr("array('future_forecasting')")).otherwise(F.expr(NO_STRINGS)),
    )
    modalities = F.array_compact(
        F.array(
            F.when(kind == "audio", "audio"),
            F.when(kind == "image", "image"),
            F.when(kind.isin("tabular", "txt"), "process_condition"),
            F.when(sensors | kind.isin("hdf5", "numpy", "audio"), "sensor_series"),
        )
    )
    return found.withColumns(
        {
            "raw_signal": kind.isin("audio", "hdf5", "numpy") | (kind.isin("tabular", "txt") & sensors & (F.col("file_size") >= raw_bytes)),
            "feature_only": text.rlike(rules.FEATURE_ONLY_PATTERN),
            "synthetic_suspected": text.rlike(rules.SYNTHETIC_PATTERN),
            "available_modalities": modalities,
            "downstream_tasks": F.array_sort(F.array_distinct(tasks)),
        }
    ).withColumn("unavailable_modalities", F.array_except(literals(rules.MODALITIES), "available_modalities"))


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """File counts, bytes and errors per dataset, type, extension and in total in one pass."""
    base = inventory.select("dataset_name", "file_type", "file_extension", "file_size", (F.col("error") != "").cast("long").alias("_e"))
    return base.groupingSets(
        [["dataset_name"], ["file_type"], ["file_extension"], []], "dataset_name", "file_type", "file_extension"
    ).agg(
        F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("files"),
        F.sum("file_size").alias("bytes"), F.sum("_e").alias("errors"),
    )


def dominant_types(inventory: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` most frequent file types per dataset."""
    counts = inventory.groupBy("dataset_name", "file_type").agg(F.count(F.lit(1)).alias("files"))
    order = W.partitionBy("dataset_name").orderBy(F.desc("files"), "file_type")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def value_frequencies(inventory: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Occurrences of each entry of the named array columns."""
    tag = lambda column: F.transform(column, lambda v: F.struct(F.lit(column).alias("kind"), v.alias("value")))
    tagged = F.flatten(F.array(*[tag(c) for c in columns]))
    return inventory.select(F.explode(tagged).alias("t")).groupBy("t.kind", "t.value").agg(F.count(F.lit(1)).alias("files"))


def task_datasets(inventory: DataFrame) -> DataFrame:
    """Distinct (task, dataset) pairs."""
    return inventory.select(F.explode("downstream_tasks").alias("task"), "dataset_name").distinct()


def _union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def known_metadata(haystack: Column) -> Column:
    """Rate and material struct of datasets recognised by name, null otherwise."""
    chain = None
    for words, (rate, material, family, source, confidence) in rules.KNOWN_DATASETS:
        entry = F.struct(
            F.lit(rate).alias("sampling_rate"), F.lit(material).alias("material"), F.lit(family).alias("material_family"),
            F.lit(source).alias("material_source"), F.lit(confidence).alias("material_confidence"),
        )
        hit = contains_any(haystack, words)
        chain = F.when(hit, entry) if chain is None else chain.when(hit, entry)
    return chain


def build_registry(inventory: DataFrame) -> DataFrame:
    """One row per dataset; list columns collect distinct lists, of which few exist, not rows."""
    grouped = inventory.groupBy("dataset_name").agg(
        _union("available_modalities").alias("available_modalities"), _union("downstream_tasks").alias("downstream_tasks"),
        F.bool_or("raw_signal").alias("raw_available"), F.bool_or("feature_only").alias("feature_only"),
        F.bool_or("synthetic_suspected").alias("synthetic_suspected"), F.count(F.lit(1)).alias("file_count"),
    )
    known = known_metadata(F.lower("dataset_name"))
    return grouped.withColumns(
        {
            "dataset_id": slug(F.col("dataset_name")),
            "missing_modalities": F.array_except(literals(rules.MODALITIES), "available_modalities"),
            "workpiece_material": known["material"],
            "known_sampling_rate": known["sampling_rate"],
        }
    )


def grade_datasets(inventory: DataFrame) -> DataFrame:
    """Quality grade and use flags per dataset."""
    stats = inventory.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("files"), F.avg(F.col("readable").cast("double")).alias("readable_ratio"),
        F.count_if(F.col("error") != "").alias("inspection_errors"), F.count_if("raw_signal").alias("raw_signal_files"),
        F.bool_or(F.size("sensor_channels") > 0).alias("has_sensors"), F.bool_or(F.size("label_columns") > 0).alias("downstream_candidate"),
    )
    raw = F.col("raw_signal_files") > 0
    grade = (
        F.when(F.col("readable_ratio") < 0.5, "E")
        .when(F.col("inspection_errors") > F.col("files") * 0.5, "D")
        .when(raw & F.col("has_sensors"), "A").when(raw, "B").when(F.col("has_sensors"), "C").otherwise("D")
    )
    graded = stats.withColumn("grade", grade)
    return graded.withColumns(
        {
            "pretraining_candidate": F.col("grade").isin("A", "B") & raw,
            "manual_review_required": F.col("grade").isin("D", "E") | ~F.col("has_sensors"),
        }
    )


def join_registry(inventory: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry id and material of each file's dataset, with defaults for unlisted datasets."""
    listed = registry.select("dataset_name", "dataset_id", "workpiece_material")
    return inventory.join(listed, "dataset_name", "left").withColumn("dataset_id", F.coalesce("dataset_id", "dataset_name"))


def resolve_material(files: DataFrame) -> DataFrame:
    """Material with source and confidence: known dataset, registry, condition column hint, unknown."""
    entry = lambda m, f, s, c: F.struct(m.alias("material"), F.lit(f).alias("material_family"), F.lit(s).alias("material_source"), F.lit(c).alias("material_confidence"))
    known = known_metadata(F.lower(F.concat_ws(" ", "dataset_name", "relative_path")))
    listed = F.coalesce("workpiece_material", F.lit("")) != ""
    hinted = F.lower(F.array_join("process_condition_columns", " ")).contains("material")
    unknown = F.lit("unknown")
    chosen = (
        F.when(known.isNotNull(), F.struct(*[known[n].alias(n) for n in ("material", "material_family", "material_source", "material_confidence")]))
        .when(listed, entry(F.col("workpiece_material"), "unknown", "registry", "medium"))
        .when(hinted, entry(unknown, "unknown", "column_metadata", "low"))
        .otherwise(entry(unknown, "unknown", "unavailable", "low"))
    )
    return files.withColumn("_m", chosen).select(*files.columns, "_m.*")


def resolve_sampling_rate(files: DataFrame) -> DataFrame:
    """Known rate, else the first finite positive estimate."""
    known = known_metadata(F.lower(F.concat_ws(" ", "dataset_name", "relative_path")))
    number = lambda c: F.col(c).try_cast("double")
    usable = lambda c: F.when((number(c) > 0) & ~F.isnan(number(c)) & (number(c) < float("inf")), number(c))
    return files.withColumn("sampling_rate", F.coalesce(known["sampling_rate"], usable("sampling_rate_estimate"), usable("audio_sampling_rate")))


def split_group_key(files: DataFrame) -> DataFrame:
    """dataset :: last three parent directories :: file stem."""
    parts = path_parts(F.col("relative_path"))
    parents = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    last = F.when(F.size(parents) > 3, F.slice(parents, -3, 3)).otherwise(parents)
    return files.withColumn("split_group", F.array_join(F.concat(F.array("dataset_name"), last, F.array(stem(F.col("relative_path")))), "::"))


def manifest_flags(files: DataFrame) -> DataFrame:
    """High-rate, controller and frequency flags, and the controller channels."""
    joined = lambda *cols: F.lower(F.concat_ws(" ", "relative_path", *[F.array_join(c, " ") for c in cols]))
    names = F.concat("sensor_channels", "process_condition_columns")
    path = F.lower("relative_path")
    return files.withColumns(
        {
            "has_high_sampling_timeseries": F.coalesce(F.col("sampling_rate") >= 1000.0, F.lit(False))
            | contains_any(joined("sensor_quantities", "sensor_channels"), rules.HIGH_SAMPLING_WORDS),
            "has_cnc_timeseries": contains_any(joined("process_condition_columns", "sensor_channels"), rules.CONTROLLER_SERIES_WORDS),
            "has_frequency_view": contains_any(path, rules.FREQUENCY_WORDS),
            "has_time_frequency_view": contains_any(path, rules.TIME_FREQUENCY_WORDS),
            "cnc_channels": F.filter(names, lambda n: contains_any(F.lower(n), rules.CONTROLLER_CHANNEL_WORDS)),
        }
    )


def subgraph_tags(files: DataFrame) -> DataFrame:
    """Sorted multi-label group tags from path, channels, conditions and material."""
    text = F.lower(F.concat_ws(" ", "relative_path", F.array_join("sensor_channels", " "), F.array_join("process_condition_columns", " ")))
    tags = matching_values(rules.SUBGRAPH_WORDS, lambda words: contains_any(text, words))
    with_material = F.when(F.col("material") != "unknown", F.array_append(tags, F.lit(rules.MATERIAL_SUBGRAPH))).otherwise(tags)
    return files.withColumn("subgraph_candidates", F.array_sort(with_material))


def subgraph_of(channels: DataFrame, patterns, name: str = "channel") -> DataFrame:
    """Single group of a channel: the first group one of whose patterns occurs in the name, else the first group."""
    lowered = [(group, [p.lower() for p in words]) for group, words in patterns]
    return channels.withColumn("subgraph", first_contained(lowered, F.lower(name), lowered[0][0]))


def union_variables(files: DataFrame) -> DataFrame:
    """Sorted union of channel quantities and condition columns."""
    return files.withColumn("available_variables", F.array_sort(F.array_union("sensor_quantities", "process_condition_columns")))


def build_manifest(inventory: DataFrame, registry: DataFrame) -> DataFrame:
    """One record per file with identity, rate, material, split key, flags and read status."""
    base = join_registry(inventory, registry)
    for step in (resolve_sampling_rate, resolve_material, split_group_key, manifest_flags, subgraph_tags, union_variables):
        base = step(base)
    status = F.when(F.col("error") != "", "inspect_error").when(F.col("readable"), "readable").otherwise("not_readable")
    return base.withColumns(
        {
            "sample_id": F.substring(F.sha1(F.concat_ws(":", "dataset_name", "relative_path")), 1, 20),
            "channel_schema_version": F.lit(SCHEMA_VERSION),
            "source_type": F.when(F.col("synthetic_suspected"), "synthetic_suspected").otherwise("raw"),
            "has_image": F.array_contains("available_modalities", "image"),
            "has_audio": F.array_contains("available_modalities", "audio"),
            "dynamic_graph_enabled": (F.size("sensor_channels") > 0) | F.col("raw_signal"),
            "subgraph_confidence": F.when(F.size("subgraph_candidates") == 0, "low").otherwise("medium"),
            "read_status": status,
        }
    )


def filter_manifest(
    manifest: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] | DataFrame = (),
    extensions: Sequence[str] = (),
    max_files: int | None = None,
    drop_unpaired: bool = False,
) -> DataFrame:
    """Extension and dataset filters, then at most ``max_files`` records in path order (a feature, off by default).

    Excluded datasets are a short list or a frame with ``dataset_id``.
    """
    out = manifest
    if extensions:
        dotted = ["" if e in ("", "(none)") else e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
        out = out.filter(extension(F.col("relative_path")).isin(dotted))
    if include:
        out = out.filter(F.col("dataset_id").isin(list(include)))
    if isinstance(exclude, DataFrame):
        out = out.join(exclude.select("dataset_id").distinct(), "dataset_id", "left_anti")
    elif exclude:
        out = out.filter(~F.col("dataset_id").isin(list(exclude)))
    if drop_unpaired:
        path = F.concat(F.lit("/"), F.lower("relative_path"), F.lit("/"))
        out = out.filter(~contains_any(path, rules.UNPAIRED_PATHS))
    return out.orderBy("relative_path").limit(max_files) if max_files else out


def dataset_counts(manifest: DataFrame, by: str = "dataset_id") -> DataFrame:
    return manifest.groupBy(by).agg(F.count(F.lit(1)).alias("samples"))


def registry_plan(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sample count, training recommendation and risks per registered dataset."""
    counts = dataset_counts(manifest)
    has = lambda c: F.size(c) > 0
    advice = (
        F.when(F.col("raw_available") & has("available_modalities"), "smoke_test_only, then incremental_pretraining")
        .when(has("downstream_tasks"), "downstream_only")
        .otherwise("no_train pending manual review")
    )
    risks = F.array_compact(
        F.array(
            F.when(F.col("synthetic_suspected"), "synthetic suspected"), F.when(~has("available_modalities"), "modality unknown"),
            F.when(~has("downstream_tasks"), "labels/tasks unknown"), F.lit("verify units, sampling rate, split leakage"),
        )
    )
    return registry.join(counts, "dataset_id", "left").select(
        "dataset_id", F.coalesce("samples", F.lit(0)).alias("samples"), advice.alias("recommendation"), risks.alias("risks")
    )


# --- change detection and versions -------------------------------------------------------------------


def snapshot_diff(previous: DataFrame, current: DataFrame, compare: Sequence[str], key: str = "path") -> DataFrame:
    """Status of every path of two snapshots: added, deleted, modified or unchanged."""
    old = previous.select(F.col(key), F.struct(*compare).alias("_old"))
    new = current.select(F.col(key), F.struct(*compare).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    )
    return old.join(new, key, "full").select(key, status.alias("status"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("paths"))


def added_paths(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return current.select(key).subtract(previous.select(key))


def common_paths(previous: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return previous.select(key).intersect(current.select(key))


def snapshot_hash(files: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash per dataset.

    Each row digest is cut into four 60-bit numbers; their exact sums do not depend on row order and are
    map-side combined, so no list of rows is ever built.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda i: F.conv(F.substring("_d", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = files.select(by, digest.alias("_d")).groupBy(by).agg(*[F.sum(part(i)).alias(f"_s{i}") for i in range(4)], F.count(F.lit(1)).alias("files"))
    whole = F.concat_ws("|", F.col("files").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return sums.select(by, F.sha2(whole, 256).alias("snapshot_hash"), "files")


def version_snapshot(hashes: DataFrame, history: DataFrame, by: str = "dataset_id") -> DataFrame:
    """New version rows ``v{n+1}`` for datasets whose hash differs from their latest version."""
    latest = history.groupBy(by).agg(F.max("version_number").alias("_last"), F.max_by("snapshot_hash", "version_number").alias("_hash"))
    changed = hashes.join(latest, by, "left").filter(~F.col("snapshot_hash").eqNullSafe(F.col("_hash")))
    number = F.coalesce("_last", F.lit(0)) + 1
    return changed.select(by, number.alias("version_number"), F.concat(F.lit("v"), number).alias("dataset_version"), "snapshot_hash", "files")


# --- sets and presence masks -------------------------------------------------------------------------


def missing_variables(samples: DataFrame, available: str, expected: Sequence[str] = tuple(rules.EXPECTED_VARIABLES)) -> DataFrame:
    have = F.array_sort(F.array_distinct(available))
    return samples.withColumns({"available": have, "missing": F.array_sort(F.array_except(literals(list(expected)), available))})


def ordered_distinct(df: DataFrame, column: str) -> DataFrame:
    """First-seen distinct entries of an array column, empties left out."""
    return df.withColumn(column, F.array_distinct(F.filter(column, lambda v: v != "")))


def presence_mask(samples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Boolean map of which modality columns are present."""
    entries = [x for name, c in columns.items() for x in (F.lit(name), F.col(c).isNotNull())]
    return samples.withColumn("mask", F.create_map(*entries))


def input_warnings(samples: DataFrame, modalities: Sequence[str], series: str, condition: str) -> DataFrame:
    """Validity flag and the warnings for absent inputs."""
    any_present = F.lit(False)
    for c in modalities:
        any_present = any_present | F.col(c).isNotNull()
    warnings = F.array_compact(
        F.array(
            F.when(~any_present, "No supported input modality is available."),
            F.when(F.col(series).isNull(), "sensor_series is missing"),
            F.when(F.col(condition).isNull(), "process_condition is missing"),
        )
    )
    return samples.withColumns({"valid": any_present, "warnings": warnings})


def map_mask(samples: DataFrame, column: str) -> DataFrame:
    """Presence of each entry of a label or condition map."""
    return samples.withColumn("mask", F.transform_values(column, lambda k, v: v.isNotNull()))


def numeric_conditions(samples: DataFrame, column: str) -> DataFrame:
    """Sorted names of condition entries with a finite numeric value."""
    number = lambda v: v.try_cast("double")
    kept = F.map_filter(column, lambda k, v: number(v).isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")))
    return samples.withColumn("numeric_keys", F.array_sort(F.map_keys(kept)))


def profile_columns(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Numeric or categorical verdict and missing ratio per column of ``cells(..., column, row, text)``.

    A column is numeric when all its present values are numbers, also without any.
    """
    by = list(by)
    text = F.trim("text")
    absent = (text == "") | F.lower(text).isin("nan", "null", "none")
    marked = cells.withColumn("_absent", F.coalesce(absent, F.lit(True)))
    return marked.groupBy(*by).agg(
        F.avg(F.col("_absent").cast("double")).alias("missing_ratio"),
        F.bool_and(F.col("_absent") | text.try_cast("double").isNotNull()).alias("numeric"),
    )
