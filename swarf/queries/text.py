"""Queries on documents, path contexts and control programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarf.functions.hashing import digest_bytes
from swarf.functions.rounding import round_columns, rounded
from swarf.operators import nc, text
from swarf.queries.channels import SWAPPED, _list
from swarf.queries.registry import query, r
from swarf.rules import nc as nc_rules
from swarf.rules import text as rules
from swarf.sources.tables import pick, with_tables

TOKENS = f"""WITH tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{rules.TOKEN_PATTERN}') AS tokens FROM documents)"""


def _tokens(t):
    return text.tokenize(t.spread("documents").select("doc_id", "text")).drop("text")


@query(TOKENS + " SELECT doc_id, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM tk")
def tokenize(t):
    return _tokens(t).select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


LEAKY = """WITH d AS (SELECT doc_id, lower(text || ' good WEAR ' || source || ' bad target') AS text FROM documents)"""


@query(LEAKY + f" SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '{rules.TOKEN_PATTERN}'), lambda w: NOT list_contains({_list(rules.BLOCKED_WORDS)}, w)), ' ') AS redacted FROM d")
def redact_tokens(t):
    docs = t.spread("documents").select("doc_id", F.concat("text", F.lit(" good WEAR "), "source", F.lit(" bad target")).alias("text"))
    return text.redact_tokens(text.tokenize(docs)).select("doc_id", "redacted")


@query(TOKENS + f""", e AS (SELECT doc_id, unnest(range(0, len(tokens))) AS pos, tokens FROM tk), h AS (SELECT doc_id, pos, pos < len(tokens) AS mask, sha1(coalesce(tokens[pos+1], '')) AS h FROM e)
 SELECT doc_id, pos::INTEGER AS pos, CASE WHEN mask THEN 1 + {SWAPPED} % 8191 ELSE 0 END AS id, mask FROM h""")
def encode_tokens(t):
    coded = text.encode_tokens(_tokens(t))
    return coded.select("doc_id", F.posexplode(F.arrays_zip(F.col("text_ids").alias("id"), F.col("text_mask").alias("mask"))).alias("pos", "e")).select(
        "doc_id", "pos", "e.id", "e.mask"
    )


PATHS = ["m1/milling", "op20/t7", "AISI 1045/Slot", "m01t02r03", "al6061/turning", "steel-face", "surface/chatter", "titanium_SUS304"]
PATH_SQL = f"""WITH p AS (SELECT page_id, '/data/' || {_list(PATHS)}[page_id % {len(PATHS)} + 1] || '/' || {_list(PATHS)}[page_id // 3 % {len(PATHS)} + 1] || '/f' || page_id || '.csv' AS file_path FROM pages),
 q AS (SELECT *, list_filter(list_transform(string_split(file_path, '/'), lambda x: trim(regexp_replace(lower(x), '[^0-9a-zA-Z가-힣]+', '_', 'g'), '_')), lambda x: x <> '') AS parts FROM p),
 c AS (SELECT *, flatten(list_transform(parts, lambda x: list_concat(list_filter([CASE WHEN list_contains({_list(rules.OPERATION_WORDS)}, x) THEN x END, CASE WHEN regexp_full_match(x, 'm\\d+') THEN 'machine ' || x END,
  CASE WHEN regexp_full_match(x, 'op\\d+') THEN 'operation ' || x END, CASE WHEN regexp_full_match(x, 't\\d+') THEN 'tool ' || x END], lambda y: y IS NOT NULL),
  {', '.join(f"regexp_extract_all(x, '{p}')" for p in rules.MATERIAL_PATTERNS)},
  CASE WHEN regexp_matches(x, '\\bm(\\d+)t(\\d+)r(\\d+)') THEN ['machine m' || regexp_extract(x, 'm(\\d+)t(\\d+)r(\\d+)', 1), 'tool t' || regexp_extract(x, 'm(\\d+)t(\\d+)r(\\d+)', 2), 'run r' || regexp_extract(x, 'm(\\d+)t(\\d+)r(\\d+)', 3)] ELSE [] END))) AS words FROM q),
 s AS (SELECT *, array_to_string(list_filter(regexp_extract_all(array_to_string(words, ' '), '{rules.TOKEN_PATTERN}'), lambda w: NOT list_contains({_list(rules.BLOCKED_WORDS)}, w)), ' ') AS path_context FROM c)"""


def _records(t):
    key = F.col("page_id")
    path = F.concat_ws("/", F.lit("/data"), pick(PATHS, key), pick(PATHS, F.floor(key / 3)), F.concat(F.lit("f"), key, F.lit(".csv")))
    return t.read("pages").select("page_id", path.alias("file_path"))


@query(PATH_SQL + " SELECT page_id, path_context FROM s")
def path_context(t):
    return text.path_context(_records(t)).select("page_id", "path_context")


SAFE = f"array_to_string(list_filter(regexp_extract_all(lower({{}}), '{rules.TOKEN_PATTERN}'), lambda w: NOT list_contains({_list(rules.BLOCKED_WORDS)}, w)), ' ')"


@query(PATH_SQL + f""" SELECT page_id, {SAFE.format("'cnc machining sample dataset Set-' || page_id % 4 || ' tool id ' || page_id % 9 || ' ' || path_context || ' process conditions ' || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'rpm ' || page_id % 50 || ' ' END || 'wear good feed 0.5 sensor quantities force vibration sensor sources external_sensor'")} AS text_context FROM s""")
def record_context(t):
    key = F.col("page_id")
    conditions = F.create_map(F.lit("wear"), F.lit("good"), F.lit("xfeed"), F.lit("feed 0.5"), F.lit("rpm"), F.when(key % 3 != 0, (key % 50).cast("string")))
    names = F.map_concat(F.map_filter(conditions, lambda k, v: k == "rpm"), F.create_map(F.lit("wear good feed"), F.lit("0.5")))
    records = _records(t).withColumns(
        {"dataset_id": F.concat(F.lit("Set-"), key % 4), "tool_id": key % 9, "conditions": names,
         "quantities": F.array(F.lit("vibration"), F.lit("force"), F.lit("vibration")), "sources": F.array(F.lit("external_sensor"))}
    )
    return text.record_context(records, "conditions", "quantities", "sources").select("page_id", "text_context")


@query("""SELECT conv_id, turn, trim(CASE WHEN text <> '' THEN 'context: ' || text ELSE '' END || CASE WHEN turn % 2 = 0 THEN ' tool: T' || conv_id ELSE '' END || ' operation: ' || role || CASE WHEN turn % 3 = 0 THEN '' ELSE ' process conditions rpm ' || turn END || ' sensors: a.b c.d') AS request_context
 FROM conversations""")
def request_context(t):
    requests = t.read("conversations").select(
        "conv_id", "turn", F.col("text").alias("text_context"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("T"), "conv_id")).alias("tool_info"),
        F.col("role").alias("operation_info"), F.create_map(F.lit("rpm"), F.when(F.col("turn") % 3 != 0, F.col("turn").cast("string"))).alias("c"),
        F.expr("array('a.b', 'c.d')").alias("s"),
    )
    return text.request_context(requests, "c", "s").select("conv_id", "turn", "request_context")


@query(f"""WITH h AS (SELECT doc_id, sha256(text) AS h, unnest(range(0, 40)) AS pos FROM documents) SELECT doc_id, pos::INTEGER AS pos, {r("('0x' || substr(h, (pos % 32 * 2 + 1)::INTEGER, 2))::BIGINT / 127.5 - 1", 6, 'value')} FROM h""")
def hash_bytes_vector(t):
    out = t.spread("documents").select("doc_id", F.posexplode(digest_bytes("text", 40)).alias("pos", "value"))
    return round_columns(out, ["value"])


WORD = nc_rules.WORD_PATTERN
BLOCKS = f""", b0 AS (SELECT program_id, line_no, upper(trim(string_split(regexp_replace(text, '\\([^)]*\\)', ' ', 'g'), ';')[1])) AS block FROM nc_lines),
 b AS (SELECT *, regexp_extract_all(block, '{WORD}', 1) AS ls, regexp_extract_all(block, '{WORD}', 2)::DOUBLE[] AS vs FROM b0 WHERE block <> '' AND NOT starts_with(block, '%')),
 w AS (SELECT program_id, line_no, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS letter, unnest(vs) AS value FROM b),
 wc AS (SELECT *, round_even(value, 0)::BIGINT AS code FROM w)"""


@query(with_tables("nc_lines", body=BLOCKS + " SELECT program_id, line_no, pos::INTEGER AS pos, letter, value, code FROM wc"))
def nc_words(t):
    return nc.nc_words(t.nc_lines)


KEPT = f""", k0 AS (SELECT program_id, line_no, upper(trim(string_split(text, ';')[1])) AS block FROM nc_lines),
 k AS (SELECT *, regexp_extract_all(block, '{WORD}', 1) AS ls, regexp_extract_all(block, '{WORD}', 2)::DOUBLE[] AS vs FROM k0 WHERE block <> '' AND NOT starts_with(block, '(') AND len(regexp_extract_all(block, '{WORD}', 1)) > 0),
 kl AS (SELECT program_id, line_no, {', '.join(f"list_filter(vs, lambda v, i: ls[i] = '{l}')[-1] AS {l}" for l in nc_rules.MATRIX_SCALES)} FROM k),
 ms AS (SELECT program_id, line_no, {', '.join(f"last_value({l} IGNORE NULLS) OVER p AS {l}" if l in nc_rules.MODAL_LETTERS else l for l in nc_rules.MATRIX_SCALES)},
  row_number() OVER (PARTITION BY program_id ORDER BY line_no) - 1 AS row FROM kl WINDOW p AS (PARTITION BY program_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query(with_tables("nc_lines", body=KEPT + f" SELECT program_id, line_no, {', '.join(f'{l} AS modal_{l}' for l in nc_rules.MODAL_LETTERS)} FROM ms"))
def modal_state(t):
    return nc.modal_state(t.nc_lines).select("program_id", "line_no", *[f"modal_{l}" for l in nc_rules.MODAL_LETTERS])


@query(with_tables("nc_lines", body=KEPT + f""" SELECT program_id, row, {', '.join(r(f'greatest(-10, least(10, coalesce({l}, 0) / {s}.0))', 6, l.lower()) for l, s in nc_rules.MATRIX_SCALES.items())} FROM ms"""))
def nc_block_matrix(t):
    out = nc.nc_block_matrix(t.nc_lines)
    return out.select("program_id", "row", *[rounded(F.col("values")[i]).alias(l.lower()) for i, l in enumerate(nc_rules.MATRIX_SCALES)])


def _cnt(letter, cond):
    return f"count_if(letter = '{letter}' AND {cond})::BIGINT"


STATS = BLOCKS + f""", mo AS (SELECT program_id, line_no, last_value(gm IGNORE NULLS) OVER (PARTITION BY program_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS motion, ax OR gm IS NOT NULL AS acts FROM
  (SELECT program_id, line_no, list_filter(list_filter(vs, lambda v, i: ls[i] = 'G'), lambda v: round_even(v,0) BETWEEN 0 AND 3)[-1] AS gm, list_has_any(ls, {_list(nc_rules.MOTION_LETTERS)}) AS ax FROM b)),
 mc AS (SELECT program_id, count(*) AS block_count, count_if(acts AND round_even(motion,0)=0)::BIGINT AS rapid, count_if(acts AND round_even(motion,0)=1)::BIGINT AS linear, count_if(acts AND round_even(motion,0)=2)::BIGINT AS cw_arc, count_if(acts AND round_even(motion,0)=3)::BIGINT AS ccw_arc FROM mo GROUP BY program_id),
 ws AS (SELECT program_id, count(*) AS word_count, {_cnt('G','code BETWEEN 80 AND 89')} AS cycle_count, {_cnt('G','code=90')} AS absolute_count, {_cnt('G','code=91')} AS incremental_count, {_cnt('G','code BETWEEN 54 AND 59')} AS work_offset_count,
  {_cnt('M','code IN (3,4)')} AS spindle_on_count, {_cnt('M','code=5')} AS spindle_stop_count, {_cnt('M','code=6')} AS tool_change_count, {_cnt('M','code IN (7,8)')} AS coolant_on_count, {_cnt('M','code=9')} AS coolant_off_count, {_cnt('M','code=1')} AS optional_stop_count,
  coalesce(min(value) FILTER (letter='F'),0) AS feed_min, coalesce(max(value) FILTER (letter='F'),0) AS feed_max, coalesce(avg(value) FILTER (letter='F'),0) AS feed_mean,
  coalesce(min(value) FILTER (letter='S'),0) AS spindle_min, coalesce(max(value) FILTER (letter='S'),0) AS spindle_max, coalesce(avg(value) FILTER (letter='S'),0) AS spindle_mean, count(DISTINCT code) FILTER (letter='T') AS tool_count FROM wc GROUP BY program_id),
 st AS (SELECT * FROM mc JOIN ws USING (program_id))"""
COUNTS = ["block_count", "word_count", "rapid", "linear", "cw_arc", "ccw_arc", "cycle_count", "absolute_count", "incremental_count", "work_offset_count", "spindle_on_count",
          "spindle_stop_count", "tool_change_count", "coolant_on_count", "coolant_off_count", "optional_stop_count", "tool_count"]
RANGES = ["feed_min", "feed_max", "feed_mean", "spindle_min", "spindle_max", "spindle_mean"]


@query(with_tables("nc_lines", body=STATS + f" SELECT program_id, {', '.join(COUNTS)}, {', '.join(r(c, 5, c) for c in RANGES)} FROM st"))
def nc_program_stats(t):
    return round_columns(nc.nc_program_stats(t.nc_lines).select("program_id", *COUNTS, *RANGES), RANGES, 5)


@query(with_tables("nc_lines", body=BLOCKS + f" SELECT program_id, lower(letter) AS axis, min(value) AS axis_min, max(value) AS axis_max, {r('max(value)-min(value)', 6, 'axis_span')} FROM wc WHERE list_contains({_list(nc_rules.AXIS_LETTERS)}, letter) GROUP BY ALL"))
def nc_axis_spans(t):
    return round_columns(nc.nc_axis_spans(t.nc_unordered), ["axis_span"])


@query(with_tables("nc_lines", body=BLOCKS + " SELECT program_id, letter, code, count(*) AS uses FROM wc WHERE letter IN ('G','M') GROUP BY ALL"))
def nc_code_counts(t):
    return nc.nc_code_counts(t.nc_unordered)


@query(with_tables("nc_lines", body=BLOCKS + " SELECT program_id, ('0x' || substr(sha1(letter || code), 1, 8))::BIGINT % 32 AS bucket, count(*) AS uses FROM wc GROUP BY ALL"))
def nc_buckets(t):
    return nc.nc_buckets(t.nc_unordered)


def _scalar(name, divisor):
    return f"{name} / greatest(1, rapid+linear+cw_arc+ccw_arc)" if divisor is None else f"least(1.0, ln(1 + abs({name}::DOUBLE)) / {divisor})"


VECTOR = STATS + f""", v1 AS (SELECT program_id, generate_subscripts(a, 1) - 1 AS dim, unnest(a) AS value FROM (SELECT program_id, [{', '.join('(' + _scalar(n, d) + ')::DOUBLE' for n, d in nc_rules.VECTOR_SCALARS)}] AS a FROM st)),
 v2 AS (SELECT program_id, 22 + list_position({_list([a.lower() for a in nc_rules.AXIS_LETTERS])}, lower(letter)) - 1 AS dim, tanh((max(value) - min(value)) / 500) AS value FROM wc WHERE list_contains({_list(nc_rules.AXIS_LETTERS)}, letter) GROUP BY program_id, letter),
 v3 AS (SELECT program_id, 32 + ('0x' || substr(sha1(letter || code), 1, 8))::BIGINT % 32 AS dim, least(1.0, ln(1 + count(*)) / 8) AS value FROM wc GROUP BY ALL),
 v3b AS (SELECT program_id, b + 32 AS dim, least(1.0, ln(1 + count(*)) / 8) AS value FROM (SELECT program_id, ('0x' || substr(sha1(letter || code), 1, 8))::BIGINT % 32 AS b FROM wc) GROUP BY program_id, b),
 v4 AS (SELECT program_id, 64 + ('0x' || substr(sha1(lower(letter) || '_codes:' || code), 1, 8))::BIGINT % 64 AS dim, least(1.0, ln(1 + n) / 7) AS value FROM (SELECT program_id, letter, code, count(*) AS n FROM wc WHERE letter IN ('G','M') GROUP BY ALL)),
 vs AS (SELECT program_id, dim, sum(value) AS value FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3b UNION ALL SELECT * FROM v4) GROUP BY ALL HAVING sum(value) <> 0),
 vec AS (SELECT program_id, dim, greatest(-1, least(1, value / sqrt(sum(value * value) OVER (PARTITION BY program_id)))) AS value FROM vs)"""


@query(with_tables("nc_lines", body=VECTOR + f" SELECT program_id, dim::INTEGER AS dim, {r('value', 6, 'value')} FROM vec"))
def nc_vector(t):
    return round_columns(nc.nc_vector(t.nc_lines), ["value"])


@query(with_tables("nc_lines", body=VECTOR + f""", mv AS (SELECT dim, sum(value) / (SELECT count(DISTINCT program_id) FROM vec) AS value FROM vec GROUP BY dim)
 SELECT dim::INTEGER AS dim, {r('value / sqrt(sum(value * value) OVER ())', 6, 'value')} FROM mv"""))
def nc_corpus_vector(t):
    return round_columns(nc.nc_corpus_vector(nc.nc_vector(t.nc_lines)), ["value"])


NKEY = "regexp_replace(regexp_replace(string_split(lower({}), '/')[-1], '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', '', 'g')"
STEM = "regexp_replace(string_split({0}, '/')[-1], '^(.+)\\.[^.]+$', '\\1')"


def _record_keys():
    fields = ["file_path", "sample_id", "dataset_id"]
    return ", ".join(NKEY.format(e) for f in fields for e in (f, f"string_split({f}, '/')[-1]", STEM.format(f)))


@query(with_tables("nc_lines", body=f""", pg AS (SELECT DISTINCT program_id, 'nc/O' || program_id || '.nc' AS path FROM nc_lines),
 o AS (SELECT DISTINCT program_id, unnest(regexp_extract_all(text, '{nc_rules.PROGRAM_PATTERN}', 1)) AS o FROM nc_lines),
 ks AS (SELECT program_id, path, {NKEY.format('path')} AS key FROM pg UNION ALL SELECT program_id, path, o FROM o JOIN pg USING (program_id) UNION ALL SELECT program_id, path, 'o' || o FROM o JOIN pg USING (program_id)),
 kk AS (SELECT key, arg_max(program_id, path) AS program_id FROM ks WHERE key <> '' GROUP BY key),
 rec AS (SELECT page_id AS record_id, 'raw/f' || page_id || '.csv' AS file_path, CASE WHEN page_id % 3 = 0 THEN 'O' || page_id % 150 ELSE 's.' || page_id END AS sample_id, 'set/O' || page_id % 170 || '.x' AS dataset_id FROM pages),
 of AS (SELECT record_id, generate_subscripts(a, 1) AS p, unnest(a) AS key FROM (SELECT record_id, [{_record_keys()}] AS a FROM rec)),
 hit AS (SELECT record_id, arg_min(program_id, p) AS program_id, arg_min(of.key, p) AS matching_key FROM of JOIN kk USING (key) GROUP BY record_id)
 SELECT record_id, coalesce(program_id, -1) AS program_id, matching_key, CASE WHEN program_id IS NULL THEN 'global_nc_corpus' ELSE 'matched_program' END AS context_source FROM rec LEFT JOIN hit USING (record_id)"""))
def match_context(t):
    programs = t.nc_lines.select("program_id", F.concat(F.lit("nc/O"), "program_id", F.lit(".nc")).alias("path")).distinct()
    key = F.col("page_id")
    records = t.read("pages").select(
        key.alias("record_id"), F.concat(F.lit("raw/f"), key, F.lit(".csv")).alias("file_path"),
        F.when(key % 3 == 0, F.concat(F.lit("O"), key % 150)).otherwise(F.concat(F.lit("s."), key)).alias("sample_id"),
        F.concat(F.lit("set/O"), key % 170, F.lit(".x")).alias("dataset_id"),
    )
    out = nc.match_context(records, nc.program_keys(t.nc_lines, programs), ["file_path", "sample_id", "dataset_id"])
    return out.select("record_id", F.coalesce("program_id", F.lit(-1).cast("long")).alias("program_id"), "matching_key", "context_source")
