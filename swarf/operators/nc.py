"""Control-program operators on ``nc_lines(program_id, line_no, text)``.

Cleaning and word extraction are row-local.  Only modal values need line order; they are carried across
line blocks by ``scan.running``, so a very long program is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.functions.hashing import sha1_head
from swarf.functions.matching import literals
from swarf.operators.lineage import checkpointed, stored
from swarf.operators.scan import BLOCK_ROWS, running, seq_blocks
from swarf.rules import nc as rules

BY = "program_id"


def nc_blocks(lines: DataFrame, comments: str = "strip") -> DataFrame:
    """Cleaned upper-case blocks with their words.

    ``strip`` removes parenthesised comments and skips ``%`` lines; ``keep`` only skips lines that start
    with a parenthesis and lines without words.
    """
    if comments not in ("strip", "keep"):
        raise ValueError(f"unknown comment mode {comments!r}")
    # the pattern runs on lines that hold a comment only
    bare = F.when(F.contains("text", F.lit("(")), F.regexp_replace("text", r"\([^)]*\)", " ")).otherwise(F.col("text"))
    block = F.upper(F.trim(F.substring_index(bare if comments == "strip" else F.col("text"), ";", 1)))
    skip = "%" if comments == "strip" else "("
    cleaned = lines.withColumn("block", block).filter((F.col("block") != "") & ~F.startswith("block", F.lit(skip)))
    found = F.regexp_extract_all("block", F.lit(rules.WORD_PATTERN), F.lit(0))
    words = F.transform(
        found, lambda w: F.struct(F.substring(w, 1, 1).alias("letter"), F.trim(F.substr(w, F.lit(2))).cast("double").alias("value"))
    )
    out = cleaned.withColumn("words", words)
    return out.filter(F.size("words") > 0) if comments == "keep" else out


def nc_words(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row per word: position, letter, numeric value and rounded code; ``blocks`` are ready ``nc_blocks`` of the lines."""
    exploded = (nc_blocks(lines) if blocks is None else blocks).select(BY, "line_no", F.posexplode("words").alias("pos", "w"))
    return exploded.select(BY, "line_no", "pos", "w.letter", "w.value", F.bround("w.value").cast("long").alias("code"))


def code_table(lines: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Use count, range and sum of the values per program, letter and rounded code.

    This is the one pass over all words; every word statistic below is a small aggregate of it.
    """
    return nc_words(lines, blocks).groupBy(BY, "letter", "code").agg(
        F.count(F.lit(1)).alias("uses"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total")
    )


def _last_of(letter: str) -> Column:
    hits = F.filter("words", lambda w: w["letter"] == letter)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


def modal_state(lines: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Value of each modal letter in force at every block, and the block's own words by letter."""
    blocks = nc_blocks(lines, "keep")
    carried = running(seq_blocks(blocks, "line_no", rows), [BY], ["line_no"], lasts={f"modal_{l}": _last_of(l) for l in rules.MODAL_LETTERS})
    return carried.drop("text")


def nc_block_matrix(lines: DataFrame, blocks: int | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """Scaled 14-column rows of all blocks of each program; with ``blocks``, so many rows, cut or filled with zeros."""
    # words are found once per line; values carried forward and row numbers come from one scan of these columns
    own = stored(nc_blocks(lines, "keep").select(BY, "line_no", *[_last_of(l).alias(f"own_{l}") for l in rules.MATRIX_SCALES]))
    state = running(seq_blocks(own, "line_no", rows), [BY], ["line_no"], index="row", lasts={f"modal_{l}": F.col(f"own_{l}") for l in rules.MODAL_LETTERS})
    if blocks is not None:
        state = state.filter(F.col("row") < blocks)
    columns = []
    for letter, scale in rules.MATRIX_SCALES.items():
        value = F.col(f"modal_{letter}") if letter in rules.MODAL_LETTERS else F.col(f"own_{letter}")
        scaled = F.coalesce(value, F.lit(0.0)) / float(scale)
        columns.append(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), scaled)))
    filled = state.select(BY, "row", F.array(*columns).alias("values"))
    if blocks is None:
        return filled
    counts = filled.groupBy(BY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < blocks)
    padding = counts.select(
        BY, F.explode(F.sequence("_n", F.lit(blocks - 1).cast("long"))).alias("row"),
        F.array_repeat(F.lit(0.0), len(columns)).alias("values"),
    )
    return filled.unionByName(padding)


def nc_motion_counts(lines: DataFrame, rows: int = BLOCK_ROWS, blocks: DataFrame | None = None) -> DataFrame:
    """Block count and blocks per motion kind; the motion code stays in force until the next one."""
    code = lambda w: F.bround(w["value"]).cast("long")
    g_motion = F.filter("words", lambda w: (w["letter"] == "G") & code(w).between(0, 3))
    has_axis = F.exists("words", lambda w: F.array_contains(literals(rules.MOTION_LETTERS), w["letter"]))
    # only two small columns per line take part in the scan
    compact = (nc_blocks(lines) if blocks is None else blocks).select(BY, "line_no", g_motion.alias("_g"), has_axis.alias("_axis")).select(
        BY, "line_no", F.when(F.size("_g") > 0, code(F.element_at("_g", -1))).alias("_moved"), F.col("_axis")
    )
    state = running(seq_blocks(compact, "line_no", rows), [BY], ["line_no"], lasts={"motion": F.col("_moved")})
    acts = F.col("_axis") | F.col("_moved").isNotNull()
    return state.groupBy(BY).agg(
        F.count(F.lit(1)).alias("block_count"),
        *[F.count_if(acts & (F.col("motion") == i)).alias(n) for i, n in enumerate(("rapid", "linear", "cw_arc", "ccw_arc"))],
    )


def nc_program_stats(lines: DataFrame, rows: int = BLOCK_ROWS, codes: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Counts and feed / spindle ranges per program; ``codes`` is a ready ``code_table`` and ``blocks`` ready ``nc_blocks`` of the lines."""
    count = lambda letter, test: F.sum(F.when((F.col("letter") == letter) & test(F.col("code")), F.col("uses")).otherwise(0))
    of = lambda letter, column: F.when(F.col("letter") == letter, F.col(column))
    words = (code_table(lines) if codes is None else codes).groupBy(BY).agg(
        F.sum("uses").alias("word_count"),
        count("G", lambda c: c.between(80, 89)).alias("cycle_count"),
        count("G", lambda c: c == 90).alias("absolute_count"),
        count("G", lambda c: c == 91).alias("incremental_count"),
        count("G", lambda c: c.between(54, 59)).alias("work_offset_count"),
        count("M", lambda c: c.isin(3, 4)).alias("spindle_on_count"),
        count("M", lambda c: c == 5).alias("spindle_stop_count"),
        count("M", lambda c: c == 6).alias("tool_change_count"),
        count("M", lambda c: c.isin(7, 8)).alias("coolant_on_count"),
        count("M", lambda c: c == 9).alias("coolant_off_count"),
        count("M", lambda c: c == 1).alias("optional_stop_count"),
        F.count_if(F.col("letter") == "T").alias("tool_count"),
        *[
            F.coalesce(agg, F.lit(0.0)).alias(f"{name}_{kind}")
            for letter, name in (("F", "feed"), ("S", "spindle"))
            for kind, agg in (
                ("min", F.min(of(letter, "low"))), ("max", F.max(of(letter, "high"))),
                ("mean", F.sum(of(letter, "total")) / F.sum(of(letter, "uses"))),
            )
        ],
    )
    joined = nc_motion_counts(lines, rows, blocks).join(words, BY, "left")
    zero = {f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in words.schema.fields if f.name != BY}
    return joined.withColumns(zero)


def nc_axis_spans(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Smallest and largest coordinate and their span per program and axis letter."""
    axes = (code_table(lines) if codes is None else codes).filter(F.col("letter").isin(rules.AXIS_LETTERS))
    return axes.groupBy(BY, F.lower("letter").alias("axis")).agg(
        F.min("low").alias("axis_min"), F.max("high").alias("axis_max"), (F.max("high") - F.min("low")).alias("axis_span")
    )


def nc_code_counts(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Occurrences of every G and M code per program."""
    return (code_table(lines) if codes is None else codes).filter(F.col("letter").isin("G", "M")).select(BY, "letter", "code", "uses")


def nc_buckets(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Occurrences per hash bucket of the letter-code tokens; codes are written out in full."""
    token = F.concat("letter", F.col("code").cast("string"))
    table = code_table(lines) if codes is None else codes
    return table.groupBy(BY, (sha1_head(token) % rules.BUCKETS).alias("bucket")).agg(F.sum("uses").alias("uses"))


def _log_scale(value: Column, divisor: float) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.abs(value.cast("double"))) / divisor)


def _unit_entries(entries: Column) -> Column:
    """Divide the values of (dim, value) entries by their length, at most ``dim`` entries."""
    norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"] * e["value"]))
    unit = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / norm))
    return F.transform(entries, lambda e: F.struct(e["dim"].alias("dim"), F.when(norm < 1e-6, 0.0).otherwise(unit(e["value"])).alias("value")))


def nc_vector(lines: DataFrame, dim: int = rules.CONTEXT_DIM) -> DataFrame:
    """Unit context vector per program as rows (program_id, dim, value), zero entries left out."""
    # words are found once per line; the reduced code table feeds four branches and is written once too
    blocks = stored(nc_blocks(lines).select(BY, "line_no", "words"))
    table = checkpointed(code_table(lines, blocks))
    stats = nc_program_stats(lines, codes=table, blocks=blocks)
    motion = F.greatest(F.lit(1), F.col("rapid") + F.col("linear") + F.col("cw_arc") + F.col("ccw_arc"))
    scalars = [(F.col(n) / motion) if d is None else _log_scale(F.col(n), d) for n, d in rules.VECTOR_SCALARS]
    first = stats.select(BY, F.posexplode(F.array(*scalars)).alias("dim", "value"))
    offset = len(scalars)
    axis_at = F.array_position(literals([a.lower() for a in rules.AXIS_LETTERS]), F.col("axis")) - 1
    spans = nc_axis_spans(lines, table).select(BY, (axis_at + offset).cast("int").alias("dim"), F.tanh(F.col("axis_span") / rules.SPAN_SCALE).alias("value"))
    offset += len(rules.AXIS_LETTERS)
    buckets = nc_buckets(lines, table).select(BY, (F.col("bucket") + offset).cast("int").alias("dim"), _log_scale(F.col("uses"), rules.BUCKET_DIVISOR).alias("value"))
    offset += rules.BUCKETS
    group = F.concat(F.lower("letter"), F.lit("_codes:"), F.col("code").cast("string"))
    codes = nc_code_counts(lines, table).select(
        BY, (sha1_head(group) % (dim - offset) + offset).cast("int").alias("dim"), _log_scale(F.col("uses"), rules.CODE_DIVISOR).alias("value")
    )
    parts = first.unionByName(spans).unionByName(buckets)
    if dim > offset:
        parts = parts.unionByName(codes)
    summed = parts.filter(F.col("dim") < dim).groupBy(BY, "dim").agg(F.sum("value").alias("value")).filter(F.col("value") != 0)
    packed = summed.groupBy(BY).agg(F.collect_list(F.struct("dim", "value")).alias("_e"))
    return packed.select(BY, F.explode(_unit_entries(F.col("_e"))).alias("e")).select(BY, "e.*")


def nc_corpus_vector(vectors: DataFrame) -> DataFrame:
    """Normalised mean of all program vectors as rows (dim, value).

    Scaling by the number of programs does not change the direction, so the sums are normalised.
    """
    sums = vectors.groupBy("dim").agg(F.sum("value").alias("value"))
    packed = sums.agg(F.collect_list(F.struct("dim", "value")).alias("_e"))
    return packed.select(F.explode(_unit_entries(F.col("_e"))).alias("e")).select("e.*")


def normalize_key(value: Column) -> Column:
    """Base name without extension, lower-case letters and digits only."""
    base = F.regexp_extract(F.regexp_replace(F.lower(value), r"\\", "/"), "([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.[a-z0-9]+$", ""), "[^a-z0-9]+", "")


def program_keys(lines: DataFrame, programs: DataFrame) -> DataFrame:
    """Matching keys of each program; of programs sharing a key the last path wins.

    ``programs(program_id, path)``; keys are the file name and the O-numbers found in the text.
    """
    numbers = lines.select(BY, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rules.PROGRAM_PATTERN), F.lit(1)))).alias("_o"))
    numbers = numbers.join(programs, BY).select(BY, "path", F.explode(F.array(F.col("_o"), F.concat(F.lit("o"), F.col("_o")))).alias("key"))
    names = programs.select(BY, "path", normalize_key(F.col("path")).alias("key"))
    return names.unionByName(numbers).filter(F.col("key") != "").groupBy("key").agg(F.max_by(BY, "path").alias(BY))


def match_context(records: DataFrame, keys: DataFrame, fields: list[str]) -> DataFrame:
    """First program matched by the record's keys in field order, else the corpus context.

    Every field offers the full value, its name and its stem.  Each spelling is resolved once and joined back, so a value
    that many records share is one row of its field's dictionary.
    """
    stem = lambda c: F.regexp_replace(c, r"^(.+)\.[^.]+$", "$1")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    found, value = records, F.col("_value")
    for i, field in enumerate(fields):
        spelled = records.select(F.col(field).cast("string").alias("_value")).filter("_value IS NOT NULL").distinct()
        tried = F.array(normalize_key(value), normalize_key(name(value)), normalize_key(stem(name(value))))
        offered = spelled.select("_value", F.posexplode(tried).alias("_p", "key")).filter(F.col("key") != "")
        hits = offered.join(keys, "key").groupBy("_value").agg(F.min_by(F.struct(BY, "key"), "_p").alias(f"_hit{i}"))
        found = found.withColumn("_value", F.col(field).cast("string")).join(hits, "_value", "left").drop("_value")
    hit = F.coalesce(*[F.col(f"_hit{i}") for i in range(len(fields))])
    source = F.when(F.col(BY).isNotNull(), "matched_program").otherwise("global_nc_corpus")
    named = found.withColumns({BY: hit[BY], "matching_key": hit["key"]}).drop(*[f"_hit{i}" for i in range(len(fields))])
    return named.withColumn("context_source", source)


def dense_vectors(vectors: DataFrame, dim: int = rules.CONTEXT_DIM, by: tuple[str, ...] = (BY,), output: str = "nc_context") -> DataFrame:
    """Rows (key, dim, value) as one array of ``dim`` entries per key, missing entries zero; without keys one row."""
    packed = vectors.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.try_element_at("_m", d), F.lit(0.0)))
    return packed.select(*by, F.when(F.size("_m") > 0, filled).alias(output))


def attach_context(records: DataFrame, vectors: DataFrame, dim: int = rules.CONTEXT_DIM) -> DataFrame:
    """Add ``nc_context``, the matched program's vector or else the corpus vector, and ``nc_context_mask``.

    ``records`` come from ``match_context``, ``vectors`` from ``nc_vector``.  A matched program without a vector takes the
    corpus vector; without any program the vector is null and the mask false.
    """
    corpus = dense_vectors(nc_corpus_vector(vectors), dim, (), "v").select("v")
    held = records.join(dense_vectors(vectors, dim), BY, "left")
    held = held.withColumn("nc_context", F.coalesce("nc_context", corpus.scalar()))
    return held.withColumn("nc_context_mask", F.col("nc_context").isNotNull())
