"""Queries on channel names."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.operators import channels
from swarf.queries.registry import query
from swarf.rules import channels as rules
from swarf.sources.tables import with_tables


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(text, tokens, words):
    parts = [f"contains({text}, '{w}')" for w in words if "_" in w]
    whole = [w for w in words if "_" not in w]
    if whole:
        parts.append(f"list_has_any({tokens}, {_list(whole)})")
    return "(" + " OR ".join(parts) + ")"


def _first(rule_list, default, text="nm", tokens="tk"):
    return "CASE " + " ".join(f"WHEN {_words(text, tokens, w)} THEN '{v}'" for v, w in rule_list) + f" ELSE {default} END"


def _has(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


METADATA_SQL = "(" + " OR ".join(f"regexp_matches(normalized, '{p}')" for p in rules.METADATA_PATTERNS) + ")"


def dimension_ctes(source: str, column: str = "raw_name") -> str:
    """CTE text ending in ``dim``: the canonical channel dimension of a table of raw names."""
    order = ["source", "component", "quantity", "axis", "representation"]
    canonical = " AND ".join(f"list_contains({_list(rules.ATTRIBUTES[n])}, string_split(raw_name, '.')[{i + 1}])" for i, n in enumerate(order))
    exact = "CASE " + " ".join(f"WHEN nm = '{k}' THEN '{v}'" for k, v in rules.EXACT_NAMES.items()) + " END"
    return f""", d0 AS (SELECT DISTINCT {column} AS raw_name FROM {source}),
 d1 AS (SELECT raw_name, trim(regexp_replace(lower(regexp_replace(regexp_replace(raw_name, '\\[[^\\]]*\\]', '', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS nm FROM d0),
 d2 AS (SELECT *, string_split(nm, '_') AS tk, CASE WHEN len(string_split(raw_name, '.')) >= 5 AND {canonical} THEN raw_name ELSE {exact} END AS exact_name,
  coalesce(nullif(regexp_extract(raw_name, '(?::|[_-])(\\d+)$', 1), ''), nullif(regexp_extract(nm, '(?:^|_)(\\d+)$', 1), ''))::BIGINT AS num FROM d1),
 d3 AS (SELECT *, {_first(rules.QUANTITY_WORDS, "'unknown'")} AS q, {_first(rules.REPRESENTATION_WORDS, 'NULL')} AS rp, {_first(rules.COMPONENT_WORDS, "'unknown'")} AS cp FROM d2),
 d4 AS (SELECT *, {_first(rules.AXIS_WORDS, f"CASE WHEN list_contains({_list(rules.VECTOR_QUANTITIES)}, q) AND num < 3 THEN ['x','y','z'][num+1] WHEN num < 32 THEN 'channel_' || num ELSE 'none' END")} AS ax,
  CASE WHEN list_contains({_list(rules.DERIVED_REPRESENTATIONS)}, rp) THEN 'derived_feature' WHEN list_contains({_list(rules.PROCESS_CONDITION_QUANTITIES)}, q) THEN 'process_condition'
   WHEN {_words('nm', 'tk', rules.CONTROLLER_WORDS)} THEN 'machine_controller' WHEN {_words('nm', 'tk', rules.SENSOR_WORDS)} THEN 'external_sensor'
   WHEN list_contains({_list(rules.EXTERNAL_SENSOR_QUANTITIES)}, q) THEN 'external_sensor' WHEN q <> 'unknown' THEN 'machine_controller' ELSE 'unknown' END AS sr FROM d3),
 d5 AS (SELECT *, coalesce(rp, CASE WHEN sr = 'machine_controller' THEN 'actual' ELSE 'raw' END) AS r2 FROM d4),
 dim AS (SELECT raw_name, nm AS normalized,
  coalesce(exact_name, sr || '.' || cp || '.' || q || '.' || ax || '.' || r2 || CASE WHEN q = 'unknown' THEN '.' || CASE WHEN nm = '' THEN substr(sha1(raw_name),1,12) ELSE right(nm, 64) END ELSE '' END) AS canonical_name,
  coalesce(string_split(exact_name, '.')[1], sr) AS source, coalesce(string_split(exact_name, '.')[2], cp) AS component, coalesce(string_split(exact_name, '.')[3], q) AS quantity,
  coalesce(string_split(exact_name, '.')[4], ax) AS axis, coalesce(string_split(exact_name, '.')[5], r2) AS representation FROM d5),
 sig AS (SELECT * FROM dim WHERE quantity <> 'unknown' AND NOT list_contains({_list(rules.NON_SIGNAL_QUANTITIES)}, quantity) AND source <> 'derived_feature'
  AND NOT list_contains({_list(rules.DERIVED_REPRESENTATIONS)}, representation) AND NOT {METADATA_SQL})"""


DIM = dimension_ctes("channel_names")
SWAPPED = "('0x'||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2))::BIGINT"


@query(with_tables("channel_names", body=DIM + " SELECT * FROM dim"))
def canonicalize_channels(t):
    return channels.canonicalize_channels(t.channel_names)


@query(with_tables("channel_names", body=DIM + f", hd AS (SELECT *, sha1(canonical_name) AS h FROM dim) SELECT raw_name, 1 + {SWAPPED} % 4095 AS channel_id, "
       + ", ".join(f"(list_position({_list(v)}, {n}) - 1)::INTEGER AS {n}_id" for n, v in rules.ATTRIBUTES.items()) + " FROM hd"))
def channel_ids(t):
    out = channels.channel_ids(channels.canonicalize_channels(t.channel_names), 4096)
    return out.select("raw_name", "channel_id", *[f"{n}_id" for n in rules.ATTRIBUTES])


@query(with_tables("channel_names", body=DIM + " SELECT raw_name, canonical_name FROM sig"))
def signal_channels(t):
    return channels.signal_channels(channels.canonicalize_channels(t.channel_names)).select("raw_name", "canonical_name")


FILES = """, fc AS (SELECT file_id AS series_id, relative_path AS path, unnest(raw_channel_names) AS raw_name, generate_subscripts(raw_channel_names, 1) - 1 AS position FROM inventory)"""
FILE_DIM = FILES + dimension_ctes("fc")


def file_channels(t):
    return t.inventory.select(F.col("file_id").alias("series_id"), F.col("relative_path").alias("path"), F.posexplode("raw_channel_names").alias("position", "raw_name"))


@query(with_tables("inventory", body=FILE_DIM + """, k AS (SELECT fc.series_id, raw_name, position, canonical_name, row_number() OVER (PARTITION BY series_id, canonical_name ORDER BY position) AS kk FROM fc JOIN sig USING (raw_name)),
 s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY position) AS slot FROM k WHERE kk = 1) SELECT series_id, raw_name, canonical_name, slot::INTEGER AS slot FROM s WHERE slot <= 2"""))
def dedup_channels(t):
    names = file_channels(t)
    out = channels.dedup_channels(names, channels.canonicalize_channels(names), 2)
    return out.select("series_id", "raw_name", "canonical_name", "slot")


@query(with_tables("inventory", body=FILES + f""", a AS (SELECT *, lower(raw_name) AS nm, lower(path) AS lp FROM fc),
 b AS (SELECT *, ({_has('nm', rules.HIGH_RATE_HINTS)} OR nm IN ({', '.join(repr(w) for w in rules.WAVEFORM_NAMES)})) AS hi, {_has('lp', rules.CONTROLLER_PATHS)} AND NOT {_has('lp', rules.HIGH_RATE_HINTS)} AS only_c,
  {_has('nm', rules.CONTROLLER_HINTS)} AS ch FROM a),
 c AS (SELECT *, bool_or(hi) OVER (PARTITION BY series_id) AS ah, bool_or(ch AND NOT hi) OVER (PARTITION BY series_id) AS ac FROM b),
 d AS (SELECT *, hi OR (NOT ah AND NOT only_c AND position < 3) AS raw FROM c),
 e AS (SELECT series_id, position, raw_name, 'raw' AS role FROM d WHERE raw UNION ALL SELECT series_id, position, raw_name, 'cnc' FROM d WHERE (ch AND NOT hi) OR (NOT ac AND NOT raw)),
 f AS (SELECT *, row_number() OVER (PARTITION BY series_id, role ORDER BY position) AS slot FROM e)
 SELECT series_id, raw_name, role, slot::INTEGER AS slot FROM f WHERE slot <= CASE role WHEN 'raw' THEN 32 ELSE 128 END"""))
def split_channel_roles(t):
    return channels.split_channel_roles(file_channels(t), 32, 128).select("series_id", "raw_name", "role", "slot")


@query(with_tables("channel_names", body=f""", d AS (SELECT DISTINCT raw_name, lower(raw_name) AS nm FROM channel_names),
 g AS (SELECT raw_name, CASE {' '.join(f"WHEN {_has('nm', w)} THEN '{g}'" for g, w in rules.SEFC_GROUPS)} ELSE 'context' END AS sefc_group FROM d)
 SELECT *, (list_position({_list([g for g, _ in rules.SEFC_GROUPS])}, sefc_group) - 1)::INTEGER AS sefc_id FROM g"""))
def sefc_group(t):
    return channels.sefc_group(t.channel_names.distinct())


@query(with_tables("inventory", body=FILES + f""", x AS (SELECT fc.series_id, raw_name, lower(raw_name) AS nm, try_cast(sampling_rate_estimate AS DOUBLE) AS hz FROM fc JOIN inventory i ON i.file_id = fc.series_id)
 SELECT series_id, raw_name, CASE WHEN hz >= 1000 OR {_has('nm', rules.VIEW_HIGH_WORDS)} THEN 'high_rate_raw_timeseries' WHEN {_has('nm', rules.VIEW_LOW_WORDS)} THEN 'cnc_low_rate_timeseries'
 WHEN hz >= 500 THEN 'high_rate_raw_timeseries' ELSE 'cnc_low_rate_timeseries' END AS sensor_view, CASE WHEN hz >= 1000 THEN 'high_rate' WHEN hz > 0 THEN 'low_rate' ELSE 'unknown' END AS rate_group FROM x"""))
def sensor_view(t):
    named = t.inventory.select(F.col("file_id").alias("series_id"), F.col("sampling_rate_estimate").alias("sampling_rate"), F.explode("raw_channel_names").alias("raw_name"))
    return channels.sensor_view(named).drop("sampling_rate")


ALIASES = [("vibration_x", "vibration_x"), ("vibration_x", "vx"), ("force_x", "FX"), ("spindle_speed", "rpm"), ("feed_rate", "feedrate"), ("spindle_load", "load_x"), ("torque", "rpm")]


@query(with_tables("channel_names", body=f""", al AS (SELECT * FROM (VALUES {', '.join(f"('{c}','{a}',{i})" for i, (c, a) in enumerate(ALIASES))}) v(canonical, alias, priority)),
 k AS (SELECT lower(alias) AS key, canonical, priority FROM al UNION ALL SELECT canonical, canonical, priority FROM al), m AS (SELECT key, arg_min(canonical, priority) AS variable FROM k GROUP BY key)
 SELECT raw_name, coalesce(variable, lower(trim(raw_name))) AS variable, count(*) AS uses FROM channel_names LEFT JOIN m ON key = lower(trim(raw_name)) GROUP BY ALL"""))
def map_alias(t):
    aliases = t.spark.createDataFrame([(c, a, i) for i, (c, a) in enumerate(ALIASES)], "canonical string, alias string, priority int")
    return channels.map_alias(t.channel_names, aliases).groupBy("raw_name", "variable").agg(F.count(F.lit(1)).alias("uses"))


@query(with_tables("inventory", body="""
 , p AS (SELECT file_id, relative_path AS path, unnest(range(0, 8)) AS column_index FROM inventory),
 q AS (SELECT *, string_split(path, '/') AS pp, regexp_replace(string_split(path, '/')[-1], '^(.+)\\.[^.]+$', '\\1') AS stem FROM p),
 c AS (SELECT *, array_to_string(list_transform(list_concat(pp[greatest(1, len(pp)-3):len(pp)-1], [stem]), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g')), '_') AS clue FROM q)
 SELECT file_id, column_index, CASE WHEN contains(clue,'vib') OR contains(clue,'acc') THEN stem || '/vibration_' || coalesce(['x','y','z','u','v','w'][column_index+1], 'channel_' || column_index)
 WHEN contains(clue,'force') OR contains(clue,'torque') THEN stem || '/' || coalesce(['force_x','force_y','force_z','torque_z','torque_x','torque_y'][column_index+1], 'force_channel_' || column_index)
 WHEN contains(clue,'current') THEN stem || '/current_' || coalesce(['x','y','z','u','v','w'][column_index+1], 'channel_' || column_index) ELSE column_index::VARCHAR END AS raw_name FROM c"""))
def name_headerless(t):
    columns = t.inventory.select("file_id", F.col("relative_path").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("column_index"))
    return channels.name_headerless(columns).select("file_id", F.col("column_index").cast("long").alias("column_index"), "raw_name")


@query(with_tables("readings", body="""
 , x AS (SELECT series_id, channel, seq, CASE WHEN channel = 'feed_rate' AND series_id % 3 = 0 THEN seq * 0.5::DOUBLE ELSE value END AS value FROM readings),
 n AS (SELECT series_id, min(channel) AS channel FROM x GROUP BY series_id HAVING count(DISTINCT channel) > 1),
 d AS (SELECT series_id, channel, value - lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS d FROM x JOIN n USING (series_id, channel)),
 s AS (SELECT series_id, channel FROM d GROUP BY ALL HAVING count(*) >= 8 AND (min(d) >= 0 OR max(d) <= 0) AND stddev_pop(d) <= greatest(abs(avg(d))*0.01, 1e-12))
 SELECT series_id, channel, count(*) AS rows FROM x ANTI JOIN s USING (series_id, channel) GROUP BY ALL"""))
def drop_time_channel(t):
    axis = (F.col("channel") == "feed_rate") & (F.col("series_id") % 3 == 0)
    readings = t.readings.select("series_id", "channel", "seq", F.when(axis, F.col("seq") * 0.5).otherwise(F.col("value")).alias("value"))
    order = t.events.select("series_id", "channel").distinct().withColumn("position", F.col("channel"))
    return channels.drop_time_channel(readings, order).groupBy("series_id", "channel").agg(F.count(F.lit(1)).alias("rows"))
