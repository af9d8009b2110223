"""Queries on inventories, registries, manifests and snapshots."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from swarf.functions.rounding import round_columns
from swarf.operators import catalog
from swarf.operators.channels import canonicalize_channels
from swarf.queries.channels import FILE_DIM, _has, _list
from swarf.queries.registry import query, r
from swarf.rules import catalog as rules
from swarf.sources.tables import with_tables

RAW_BYTES = 4000


def described(t, mode="compat"):
    dim = canonicalize_channels(t.inventory.select(F.explode("raw_channel_names").alias("raw_name")))
    return catalog.describe_inventory(t.inventory, dim, mode, RAW_BYTES)


def joined(df, *columns):
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


EXT = "lower(regexp_extract(string_split(relative_path, '/')[-1], '^.+(\\.[^.]+)$', 1))"
KIND = "CASE " + " ".join(f"WHEN list_contains({_list(e)}, file_extension) THEN '{k}'" for k, e in rules.FILE_TYPES) + " ELSE 'unknown' END"
CLASSIFIED = f""", cl0 AS (SELECT *, string_split(relative_path, '/')[1] AS dataset_name, {EXT} AS file_extension, len(string_split(relative_path, '/')) - 1 AS directory_depth FROM inventory),
 cl AS (SELECT *, {KIND} AS file_type FROM cl0)"""


@query(with_tables("inventory", body=CLASSIFIED + " SELECT file_id, dataset_name, file_extension, directory_depth::INTEGER AS directory_depth, file_type, file_size FROM cl"))
def classify_files(t):
    return catalog.classify_files(t.inventory).select("file_id", "dataset_name", "file_extension", "directory_depth", "file_type", "file_size")


@query(with_tables("inventory", body=CLASSIFIED + """ SELECT file_id, CASE WHEN row_number() OVER (PARTITION BY file_type, file_extension ORDER BY relative_path) <= 3 THEN 'sampled' ELSE 'metadata_only' END AS inspection_mode
 FROM cl"""))
def inspect_sample(t):
    files = catalog.classify_files(t.inventory).withColumn("dataset_name", F.col("file_type"))
    return catalog.inspect_sample(files, 3).select("file_id", "inspection_mode")


def _found(rule_list, mode):
    test = (lambda w: _has("haystack", w)) if mode == "compat" else (lambda w: f"list_has_any(tokens, {_list(w)})")
    return "list_filter([" + ", ".join(f"CASE WHEN {test(w)} THEN '{v}' END" for v, w in rule_list) + "], lambda x: x IS NOT NULL)"


@cache
def described_ctes(mode="compat"):
    task = "CASE l " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.LABEL_TASKS.items()) + " END"
    return FILE_DIM + CLASSIFIED + f""", sn AS (SELECT series_id AS file_id, list(canonical_name ORDER BY position) AS cs, list_sort(list_distinct(list(quantity))) AS sensor_quantities FROM fc JOIN sig USING (raw_name) GROUP BY series_id),
 att AS (SELECT cl.*, coalesce(list_filter(cs, lambda x, i: list_position(cs, x) = i), []) AS sensor_channels, coalesce(sensor_quantities, []) AS sensor_quantities,
  lower(relative_path || ' ' || array_to_string(raw_channel_names, ' ')) AS haystack FROM cl LEFT JOIN sn USING (file_id)),
 tk AS (SELECT *, regexp_extract_all(haystack, '[a-z0-9_]+') AS tokens FROM att),
 lb AS (SELECT *, {_found(rules.LABEL_WORDS, mode)} AS label_columns, {_found(rules.CONDITION_WORDS, mode)} AS condition_columns FROM tk),
 inv AS (SELECT *, file_type IN ('audio','hdf5','numpy') OR (file_type IN ('tabular','txt') AND len(sensor_channels) > 0 AND file_size >= {RAW_BYTES}) AS raw_signal,
  regexp_matches(haystack, '{rules.FEATURE_ONLY_PATTERN}') AS feature_only, regexp_matches(haystack, '{rules.SYNTHETIC_PATTERN}') AS synthetic_suspected,
  list_filter([CASE WHEN file_type='audio' THEN 'audio' END, CASE WHEN file_type='image' THEN 'image' END, CASE WHEN file_type IN ('tabular','txt') THEN 'process_condition' END,
   CASE WHEN len(sensor_channels) > 0 OR file_type IN ('hdf5','numpy','audio') THEN 'sensor_series' END], lambda x: x IS NOT NULL) AS available_modalities,
  list_sort(list_distinct(list_concat(list_transform(label_columns, lambda l: {task}), CASE WHEN {_has('haystack', rules.FORECASTING_WORDS)} THEN ['future_forecasting'] ELSE [] END))) AS downstream_tasks FROM lb)"""


def j(c):
    return f"array_to_string({c}, ',') AS {c}"


LISTS = ["sensor_channels", "sensor_quantities", "label_columns", "condition_columns", "available_modalities", "downstream_tasks"]
FLAGS = ["raw_signal", "feature_only", "synthetic_suspected"]


def _described_sql(mode):
    return with_tables("inventory", body=described_ctes(mode) + f""" SELECT file_id, {', '.join(j(c) for c in LISTS)}, {', '.join(FLAGS)},
 array_to_string(list_filter({_list(rules.MODALITIES)}, lambda m: NOT list_contains(available_modalities, m)), ',') AS unavailable_modalities FROM inv""")


def _described(t, mode):
    return joined(described(t, mode), *LISTS, "unavailable_modalities").select("file_id", *LISTS, *FLAGS, "unavailable_modalities")


@query(_described_sql("compat"))
def describe_inventory(t):
    return _described(t, "compat")


@query(_described_sql("token"))
def describe_inventory_tokens(t):
    return _described(t, "token")


def inv_sql(body):
    return with_tables("inventory", body=described_ctes() + body)


@query(with_tables("inventory", body=CLASSIFIED + """ SELECT dataset_name, file_type, file_extension, grouping(dataset_name, file_type, file_extension)::BIGINT AS level, count(*) AS files, sum(file_size)::BIGINT AS bytes,
 sum((error <> '')::INT)::BIGINT AS errors FROM cl GROUP BY GROUPING SETS ((dataset_name), (file_type), (file_extension), ())"""))
def inventory_summary(t):
    return catalog.inventory_summary(catalog.classify_files(t.inventory))


@query(with_tables("inventory", body=CLASSIFIED + """, k AS (SELECT dataset_name, file_type, count(*) AS files FROM cl GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY files DESC, file_type) AS rank FROM k) SELECT dataset_name, file_type, files, rank::INTEGER AS rank FROM o WHERE rank <= 2"""))
def dominant_types(t):
    return catalog.dominant_types(catalog.classify_files(t.inventory), 2)


@query(inv_sql(""", vf AS (SELECT 'sensor_channels' AS kind, unnest(sensor_channels) AS value FROM inv UNION ALL SELECT 'label_columns', unnest(label_columns) FROM inv
 UNION ALL SELECT 'condition_columns', unnest(condition_columns) FROM inv) SELECT kind, value, count(*) AS files FROM vf GROUP BY ALL"""))
def value_frequencies(t):
    return catalog.value_frequencies(described(t), ["sensor_channels", "label_columns", "condition_columns"])


@query(inv_sql(" SELECT DISTINCT unnest(downstream_tasks) AS task, dataset_name FROM inv"))
def task_datasets(t):
    return catalog.task_datasets(described(t))


KNOWN_RATE = "CASE " + " ".join(f"WHEN {_has('kh', w)} THEN {v[0]}::DOUBLE" for w, v in rules.KNOWN_DATASETS) + " END"
KNOWN_MAT = "CASE " + " ".join(f"WHEN {_has('kh', w)} THEN {list(v[1:])!r}" for w, v in rules.KNOWN_DATASETS) + " END"
REGISTRY = """, reg AS (SELECT dataset_name, trim(regexp_replace(lower(dataset_name), '[^a-z0-9]+', '_', 'g'), '_') AS dataset_id, bool_or(raw_signal) AS raw_available, bool_or(feature_only) AS feature_only,
 bool_or(synthetic_suspected) AS synthetic_suspected, count(*) AS file_count, list_sort(list_distinct(flatten(list(available_modalities)))) AS available_modalities,
 list_sort(list_distinct(flatten(list(downstream_tasks)))) AS downstream_tasks FROM inv GROUP BY dataset_name)"""


@query(inv_sql(REGISTRY + f""" SELECT dataset_name, dataset_id, raw_available, feature_only, synthetic_suspected, file_count, {j('available_modalities')}, {j('downstream_tasks')},
 array_to_string(list_filter({_list(rules.MODALITIES)}, lambda m: NOT list_contains(available_modalities, m)), ',') AS missing_modalities FROM reg"""))
def build_registry(t):
    out = joined(catalog.build_registry(described(t)), "available_modalities", "downstream_tasks", "missing_modalities")
    return out.drop("workpiece_material", "known_sampling_rate")


@query(inv_sql(f""", g AS (SELECT dataset_name, count(*) AS files, avg(readable::INT) AS rr, count_if(error <> '') AS inspection_errors, count_if(raw_signal) AS raw_signal_files, bool_or(len(sensor_channels) > 0) AS has_sensors,
 bool_or(len(label_columns) > 0) AS downstream_candidate FROM inv GROUP BY dataset_name),
 h AS (SELECT *, CASE WHEN rr < 0.5 THEN 'E' WHEN inspection_errors > files * 0.5 THEN 'D' WHEN raw_signal_files > 0 AND has_sensors THEN 'A' WHEN raw_signal_files > 0 THEN 'B' WHEN has_sensors THEN 'C' ELSE 'D' END AS grade FROM g)
 SELECT dataset_name, files, {r('rr', 6, 'readable_ratio')}, inspection_errors::BIGINT AS inspection_errors, raw_signal_files::BIGINT AS raw_signal_files, has_sensors, downstream_candidate, grade,
 grade IN ('A','B') AND raw_signal_files > 0 AS pretraining_candidate, grade IN ('D','E') OR NOT has_sensors AS manual_review_required FROM h"""))
def grade_datasets(t):
    return round_columns(catalog.grade_datasets(described(t)), ["readable_ratio"])


MANIFEST = REGISTRY + f""", m0 AS (SELECT inv.*, dataset_id, lower(dataset_name || ' ' || relative_path) AS kh, CASE WHEN dataset_id LIKE '%1%' OR dataset_id LIKE 'th%' THEN 'titanium' END AS wm FROM inv JOIN reg USING (dataset_name)),
 m1 AS (SELECT *, coalesce({KNOWN_RATE}, CASE WHEN try_cast(sampling_rate_estimate AS DOUBLE) > 0 THEN sampling_rate_estimate::DOUBLE END, CASE WHEN try_cast(audio_sampling_rate AS DOUBLE) > 0 THEN audio_sampling_rate::DOUBLE END) AS sampling_rate,
  coalesce({KNOWN_MAT}, CASE WHEN wm IS NOT NULL THEN [wm,'unknown','registry','medium'] WHEN contains(lower(array_to_string(process_condition_columns,' ')),'material') THEN ['unknown','unknown','column_metadata','low'] ELSE ['unknown','unknown','unavailable','low'] END) AS mat,
  lower(relative_path) AS lp, lower(relative_path || ' ' || array_to_string(sensor_quantities,' ') || ' ' || array_to_string(sensor_channels,' ')) AS h1,
  lower(relative_path || ' ' || array_to_string(process_condition_columns,' ') || ' ' || array_to_string(sensor_channels,' ')) AS h2,
  string_split(relative_path,'/') AS pp FROM m0),
 man AS (SELECT *, dataset_name || '::' || array_to_string(pp[greatest(1, len(pp)-3):len(pp)-1], '::') || '::' || regexp_replace(pp[-1], '^(.+)\\.[^.]+$', '\\1') AS split_group,
  coalesce(sampling_rate >= 1000, false) OR {_has('h1', rules.HIGH_SAMPLING_WORDS)} AS has_high_sampling_timeseries, {_has('h2', rules.CONTROLLER_SERIES_WORDS)} AS has_cnc_timeseries,
  {_has('lp', rules.FREQUENCY_WORDS)} AS has_frequency_view, {_has('lp', rules.TIME_FREQUENCY_WORDS)} AS has_time_frequency_view,
  list_filter(list_concat(sensor_channels, process_condition_columns), lambda n: {_has('lower(n)', rules.CONTROLLER_CHANNEL_WORDS)}) AS cnc_channels,
  list_sort(list_filter([{', '.join(f"CASE WHEN {_has('h2', w)} THEN '{v}' END" for v, w in rules.SUBGRAPH_WORDS)}, CASE WHEN mat[1] <> 'unknown' THEN '{rules.MATERIAL_SUBGRAPH}' END], lambda x: x IS NOT NULL)) AS subgraph_candidates,
  list_sort(list_distinct(list_concat(sensor_quantities, process_condition_columns))) AS available_variables, substr(sha1(dataset_name || ':' || relative_path),1,20) AS sample_id,
  CASE WHEN error <> '' THEN 'inspect_error' WHEN readable THEN 'readable' ELSE 'not_readable' END AS read_status FROM m1)"""


def _registry(t):
    reg = catalog.build_registry(described(t))
    # the test datasets have no known material, so some get one to exercise the registry branch
    hit = F.col("dataset_id").like("%1%") | F.col("dataset_id").like("th%")
    return reg.withColumn("workpiece_material", F.when(hit, "titanium"))


def manifest(t):
    return catalog.build_manifest(described(t), _registry(t))


@query(inv_sql(MANIFEST + f""" SELECT file_id, dataset_id, sample_id, {r('sampling_rate', 3, 'sampling_rate')}, mat[1] AS material, mat[2] AS material_family, mat[3] AS material_source, mat[4] AS material_confidence, split_group, read_status FROM man"""))
def build_manifest(t):
    out = manifest(t).select("file_id", "dataset_id", "sample_id", "sampling_rate", "material", "material_family", "material_source", "material_confidence", "split_group", "read_status")
    return round_columns(out, ["sampling_rate"], 3)


@query(inv_sql(MANIFEST + f""" SELECT file_id, has_high_sampling_timeseries, has_cnc_timeseries, has_frequency_view, has_time_frequency_view, {j('cnc_channels')}, {j('subgraph_candidates')}, {j('available_variables')} FROM man"""))
def manifest_flags(t):
    cols = ["cnc_channels", "subgraph_candidates", "available_variables"]
    return joined(manifest(t), *cols).select("file_id", "has_high_sampling_timeseries", "has_cnc_timeseries", "has_frequency_view", "has_time_frequency_view", *cols)


@query(inv_sql(MANIFEST + """ SELECT file_id, relative_path FROM man WHERE file_extension IN ('.csv','.wav','') AND dataset_id NOT LIKE '%example_org' AND NOT contains('/' || lp || '/', '/cnc_data/') ORDER BY relative_path LIMIT 40"""))
def filter_manifest(t):
    records = manifest(t)
    excluded = records.filter(F.col("dataset_id").like("%example_org"))
    return catalog.filter_manifest(records, (), excluded, ["csv", ".wav", "(none)"], 40, True).select("file_id", "relative_path")


@query(inv_sql(REGISTRY + " SELECT dataset_id, file_count AS samples FROM reg"))
def dataset_counts(t):
    return catalog.dataset_counts(manifest(t))


@query(inv_sql(REGISTRY + """ SELECT dataset_id, file_count AS samples, CASE WHEN raw_available AND len(available_modalities) > 0 THEN 'smoke_test_only, then incremental_pretraining' WHEN len(downstream_tasks) > 0 THEN 'downstream_only' ELSE 'no_train pending manual review' END AS recommendation,
 array_to_string(list_filter([CASE WHEN synthetic_suspected THEN 'synthetic suspected' END, CASE WHEN len(available_modalities)=0 THEN 'modality unknown' END, CASE WHEN len(downstream_tasks)=0 THEN 'labels/tasks unknown' END, 'verify units, sampling rate, split leakage'], lambda x: x IS NOT NULL), ',') AS risks FROM reg"""))
def registry_plan(t):
    return joined(catalog.registry_plan(_registry(t), manifest(t)), "risks")


SNAP = """WITH prev AS (SELECT doc_id AS path, n_chars AS size, sha256(text) AS sha256, source FROM documents WHERE doc_id % 10 <> 3),
 cur AS (SELECT doc_id AS path, n_chars + (doc_id % 7 = 0)::INT AS size, CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256, source FROM documents WHERE doc_id % 9 <> 4)"""


def _snapshots(t):
    docs, key = t.read("documents"), F.col("doc_id")
    prev = docs.filter(key % 10 != 3).select(key.alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), "source")
    sha = F.when(key % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    cur = docs.filter(key % 9 != 4).select(key.alias("path"), (F.col("n_chars") + (key % 7 == 0).cast("long")).alias("size"), sha.alias("sha256"), "source")
    return prev, cur


@query(SNAP + """ SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.size = c.size AND p.sha256 = c.sha256 THEN 'unchanged' ELSE 'modified' END AS status
 FROM prev p FULL JOIN cur c ON p.path = c.path""")
def snapshot_diff(t):
    return catalog.snapshot_diff(*_snapshots(t), ["size", "sha256"])


@query(SNAP + """ SELECT CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN p.size = c.size AND p.sha256 = c.sha256 THEN 'unchanged' ELSE 'modified' END AS status, count(*) AS paths
 FROM prev p FULL JOIN cur c ON p.path = c.path GROUP BY 1""")
def diff_summary(t):
    return catalog.diff_summary(catalog.snapshot_diff(*_snapshots(t), ["size", "sha256"]))


@query(SNAP + " SELECT path FROM cur EXCEPT SELECT path FROM prev")
def added_paths(t):
    return catalog.added_paths(*_snapshots(t))


@query(SNAP + " SELECT path FROM prev INTERSECT SELECT path FROM cur")
def common_paths(t):
    return catalog.common_paths(*_snapshots(t))


HASH = """, dg AS (SELECT source AS dataset_id, sha256(path || '|' || size || '|' || sha256) AS d FROM cur),
 sm AS (SELECT dataset_id, count(*) AS files, """ + ", ".join(f"sum(('0x' || substr(d,{15 * i + 1},15))::HUGEINT) AS s{i}" for i in range(4)) + """ FROM dg GROUP BY dataset_id),
 hs AS (SELECT dataset_id, sha256(files || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS snapshot_hash, files FROM sm)"""


@query(SNAP + HASH + """, hist AS (SELECT dataset_id, n AS version_number, CASE WHEN right(dataset_id,1) IN ('1','2') THEN snapshot_hash ELSE 'stale' END AS snapshot_hash FROM hs, (SELECT unnest(range(1,3)) AS n) WHERE n < 2 OR right(dataset_id,1) <> '5')
 , la AS (SELECT dataset_id, max(version_number) AS v, arg_max(snapshot_hash, version_number) AS sh FROM hist GROUP BY dataset_id)
 SELECT dataset_id, v + 1 AS version_number, 'v' || (v + 1) AS dataset_version, hs.snapshot_hash, files FROM hs JOIN la USING (dataset_id) WHERE hs.snapshot_hash <> sh""")
def version_snapshot(t):
    cur = _snapshots(t)[1].withColumnRenamed("source", "dataset_id")
    hashes = catalog.snapshot_hash(cur, "dataset_id", ["path", "size", "sha256"])
    last = F.expr("right(dataset_id, 1)")
    history = hashes.select(
        "dataset_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("version_number"),
        F.when(last.isin("1", "2"), F.col("snapshot_hash")).otherwise("stale").alias("snapshot_hash"),
    ).filter((F.col("version_number") < 2) | (last != "5"))
    return catalog.version_snapshot(hashes, history)


@query(inv_sql(f""" SELECT file_id, array_to_string(list_sort(sensor_quantities), ',') AS available, array_to_string(list_sort(list_filter({_list(rules.EXPECTED_VARIABLES)}, lambda v: NOT list_contains(sensor_quantities, v))), ',') AS missing FROM inv"""))
def missing_variables(t):
    out = catalog.missing_variables(described(t), "sensor_quantities")
    return joined(out.select("file_id", "available", "missing"), "available", "missing")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS words FROM w""")
def ordered_distinct(t):
    words = t.read("conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return catalog.ordered_distinct(words, "words").withColumn("words", F.array_join("words", " "))


MASKED = """WITH s AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS series, CASE WHEN event_id % 4 <> 0 THEN props END AS cond, CASE WHEN event_id % 5 = 0 THEN event_type END AS img FROM events)"""


def _masked(t):
    key = F.col("event_id")
    return t.read("events").select(
        "event_id", F.when(key % 3 != 0, F.col("value")).alias("series"), F.when(key % 4 != 0, F.col("props")).alias("cond"), F.when(key % 5 == 0, F.col("event_type")).alias("img")
    )


@query(MASKED + " SELECT event_id, series IS NOT NULL AS sensor_series, cond IS NOT NULL AS condition, img IS NOT NULL AS image FROM s")
def presence_mask(t):
    out = catalog.presence_mask(_masked(t), {"sensor_series": "series", "condition": "cond", "image": "img"})
    return out.select("event_id", *[F.col("mask")[n].alias(n) for n in ("sensor_series", "condition", "image")])


@query(MASKED + """ SELECT event_id, series IS NOT NULL OR cond IS NOT NULL OR img IS NOT NULL AS valid,
 array_to_string(list_filter([CASE WHEN series IS NULL AND cond IS NULL AND img IS NULL THEN 'No supported input modality is available.' END, CASE WHEN series IS NULL THEN 'sensor_series is missing' END, CASE WHEN cond IS NULL THEN 'process_condition is missing' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s""")
def input_warnings(t):
    out = catalog.input_warnings(_masked(t), ["series", "cond", "img"], "series", "cond")
    return out.select("event_id", "valid", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS k, event_id % 2 = 0 AS extra FROM events")
def label_mask(t):
    parsed = F.from_json("props", "map<string,string>")
    extra = F.create_map(F.lit("extra"), F.when(F.col("event_id") % 2 == 0, F.lit("1")))
    out = catalog.map_mask(t.read("events").select("event_id", F.map_concat(parsed, extra).alias("labels")), "labels")
    return out.select("event_id", F.col("mask")["k"].alias("k"), F.col("mask")["extra"].alias("extra"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL THEN 'k' END, CASE WHEN event_id % 3 = 0 THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS numeric_keys FROM events")
def numeric_conditions(t):
    rate = F.when(F.col("event_id") % 3 == 0, F.lit("2.5")).when(F.col("event_id") % 3 == 1, F.lit("fast")).otherwise(F.lit("NaN"))
    conditions = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("rate"), rate))
    out = catalog.numeric_conditions(t.read("events").select("event_id", conditions.alias("c")), "c")
    return out.select("event_id", F.array_join("numeric_keys", ",").alias("numeric_keys"))


@query(f"""WITH c AS (SELECT l_returnflag, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS row, 'qty' AS col, l_quantity::BIGINT::VARCHAR AS text FROM lineitem
 UNION ALL SELECT l_returnflag, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey, 'status', CASE WHEN l_orderkey % 5 = 0 THEN ' ' WHEN l_orderkey % 7 = 0 THEN 'NaN' ELSE l_linestatus END FROM lineitem),
 a AS (SELECT *, trim(text) = '' OR lower(trim(text)) IN ('nan','null','none') AS ab FROM c)
 SELECT l_returnflag, col AS "column", {r('avg(ab::INT)', 6, 'missing_ratio')}, col = 'qty' AS "numeric" FROM a GROUP BY ALL""")
def profile_columns(t):
    line = t.read("lineitem")
    row = (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("row")
    status = F.when(F.col("l_orderkey") % 5 == 0, " ").when(F.col("l_orderkey") % 7 == 0, "NaN").otherwise(F.col("l_linestatus"))
    cells = line.select("l_returnflag", row, F.col("l_quantity").cast("long").cast("string").alias("qty"), status.alias("status")).unpivot(
        ["l_returnflag", "row"], ["qty", "status"], "column", "text"
    )
    return round_columns(catalog.profile_columns(cells, ["l_returnflag", "column"]), ["missing_ratio"])


@query(SNAP + " SELECT path FROM prev EXCEPT SELECT path FROM cur")
def deleted_paths(t):
    previous, current = _snapshots(t)
    return catalog.added_paths(current, previous)


PATTERNS = [("motion", ["feed", "rpm"]), ("Force", ["FORCE", "load"]), ("vibration", ["vib"])]


@query(with_tables("readings", body=" SELECT channel, CASE WHEN contains(channel,'feed') OR contains(channel,'rpm') THEN 'motion' WHEN contains(channel,'force') OR contains(channel,'load') THEN 'Force' WHEN contains(channel,'vib') THEN 'vibration' ELSE 'motion' END AS subgraph, count(*) AS rows FROM readings GROUP BY ALL"))
def subgraph_of(t):
    return catalog.subgraph_of(t.events.groupBy("channel").agg(F.count(F.lit(1)).alias("rows")), PATTERNS).select("channel", "subgraph", "rows")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS cell FROM events")
def json_cells(t):
    from swarf.sources.records import decode_cells, encode_cells

    parsed = decode_cells(t.read("events").select("event_id", "props"), {"props": "struct<k:bigint>"})
    return encode_cells(parsed.withColumn("k", F.col("props.k"))).select("event_id", "k", F.col("props").alias("cell"))
