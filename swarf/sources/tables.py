"""Logical sensor tables derived from the shared test tables.

``Tables`` turns the generic star-schema and event tables into the logical tables the operators work
on; ``CTES`` holds the same derivations as SQL so that every query can be checked independently.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.functions.matching import literals, lookup
from swarf.operators.lineage import checkpointed
from swarf.operators.scan import order_blocks, ordered_index, running

# Fixed word lists from which raw channel names, path segments and labels are composed.
CHANNEL_PREFIXES = ["", "signals_machine/", "signals_sensor/", "Spindle ", "tool_", "plc.", "M1 "]
CHANNEL_CORES = [
    "vibration", "force_axis", "torque_spindle", "Current", "position_control_deviation_axis", "acc", "temp", "AE",
    "feedRate", "rpm", "doc", "voltage", "wearVb", "fx", "iu", "humidity", "load", "abs_x", "spindle_load", "mic",
    "timestamp", "sample_index", "power [W]",
]
CHANNEL_SUFFIXES = ["", "_x", "_y", ":0", ":7", "_rms", "_peak_to_peak", "_cmd", "_z", "_41", " actual", "_axial"]
CUTTING_CIRCUMFERENCE = 5.026548245743669
PATH_WORDS = [
    "spindle_vibration", "tool_wear_vb", "t4000_feed", "edge_oti_fft", "cnc_data_rpm", "m01t02r03", "milling_al6061",
    "chatter_signal", "summary_feature", "simulated_quality",
]
EXTENSIONS = [".csv", ".parquet", ".wav", ".png", ".json", ".txt", ".h5", ""]
EVENT_CHANNELS = {"click": "vibration_x", "view": "force_z", "purchase": "spindle_load", "error": "rpm", "signup": "feed_rate"}
CHANNELS = list(EVENT_CHANNELS.values())
CONDITION_WORDS = ["feed_rate", "spindle_speed", "material", "depth_of_cut"]


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(literals(words), (index % len(words) + 1).cast("int"))


def _pick_sql(words: list[str], index: str) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + f"][({index}) % {len(words)} + 1]"


def event_channel() -> Column:
    return lookup(EVENT_CHANNELS, F.col("event_type"))


EVENT_CHANNEL_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_CHANNELS.items()) + " END"


def nc_text() -> Column:
    """Control-program line of an order line."""
    whole = lambda c: F.col(c).cast("long").cast("string")
    key = F.col("l_orderkey")
    text = F.concat(
        F.lit("n"), whole("l_linenumber"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" G"), F.when(key % 7 == 0, key % 92).otherwise(key % 4))),
        F.when(key % 3 == 0, F.concat(F.lit(" X-"), whole("l_quantity"), F.lit(".5"))).otherwise(F.concat(F.lit(" Y"), whole("l_quantity"))),
        F.when(key % 11 == 0, F.concat(F.lit(" F"), key % 300, F.lit(" S"), key % 9000)).otherwise(F.lit("")),
        F.when(key % 13 == 0, F.concat(F.lit(" M"), key % 10, F.lit(" T"), key % 20)).otherwise(F.lit("")),
        F.when(key % 17 == 0, F.lit(" (tool X9 note)")).otherwise(F.lit("")),
        F.when(key % 19 == 0, F.lit("; Z99")).otherwise(F.lit("")),
    )
    return F.when(key % 97 == 0, F.concat(F.lit("% O"), key)).otherwise(text)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """Like ``read``; a table of fewer input splits than cores is dealt out first, for costly row-local work."""
        table = self.read(name)
        cores = self.spark.sparkContext.defaultParallelism
        return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table

    @cached_property
    def events(self) -> DataFrame:
        """Unnumbered readings, for operators that need no order."""
        return self.read("events").select(
            F.col("user_id").alias("series_id"), event_channel().alias("channel"), "ts", "value"
        )

    @cached_property
    def readings(self) -> DataFrame:
        """``readings(series_id, channel, seq, ts, value)`` with a dense position per channel."""
        raw = self.read("events").select(
            F.col("user_id").alias("series_id"), event_channel().alias("channel"), "event_id", "ts", "value"
        )
        return ordered_index(raw, ["series_id", "channel"], ["ts", "event_id"]).drop("event_id")

    @cached_property
    def grid(self) -> DataFrame:
        """Readings of one series laid on a common position axis: all channels share ``seq``."""
        return self.readings.select("series_id", "channel", "seq", "value")

    @cached_property
    def cuts(self) -> DataFrame:
        """One row per cut: tool, condition, position, running wear and cutting conditions."""
        line = self.read("lineitem").withColumn("cents", F.round(F.col("l_discount") * 100).cast("long"))
        keys, order = ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
        blocked = order_blocks(line, keys, order)
        numbered = running(blocked, keys, order, index="cut", sums={"wear_units": F.col("cents")})
        return numbered.select(
            F.col("l_suppkey").alias("tool_id"),
            F.concat(F.lit("c"), F.col("l_suppkey") % 6 + 1).alias("condition_id"),
            "cut",
            (F.col("wear_units") / 10000.0).alias("wear_vb_mm"),
            (F.col("l_quantity") * CUTTING_CIRCUMFERENCE).alias("cutting_speed"),
            (F.col("l_linenumber") * 0.05).alias("feed"),
            (F.col("l_tax") + 0.1).alias("axial_depth"),
            (F.col("l_extendedprice") / 50.0).alias("force_n"),
            F.col("l_partkey").alias("part_id"),
        )

    @cached_property
    def channel_names(self) -> DataFrame:
        """Raw channel spellings composed from part attributes."""
        key = F.col("p_partkey")
        return self.read("part").select(
            F.concat(
                pick(CHANNEL_PREFIXES, key), pick(CHANNEL_CORES, key + F.col("p_size")), pick(CHANNEL_SUFFIXES, F.col("p_size") + F.floor(key / 7))
            ).alias("raw_name")
        )

    @cached_property
    def inventory(self) -> DataFrame:
        """One row per file: path parts from page urls, size from the page body."""
        page = F.col("page_id")
        host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/]+)/", 1)
        lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
        two = F.transform(
            F.array(F.lit(0), F.lit(1)),
            lambda i: F.concat(pick(CHANNEL_CORES, page + i * 5), pick(CHANNEL_SUFFIXES, page * 3 + i)),
        )
        path = F.concat_ws("/", host, pick(PATH_WORDS, page), lang, F.concat(F.lit("f"), page, pick(EXTENSIONS, page * 3 + 1)))
        return self.read("pages").select(
            page.alias("file_id"),
            path.alias("relative_path"),
            F.length("html").cast("long").alias("file_size"),
            (page % 13 != 0).alias("readable"),
            F.when(page % 17 == 0, F.lit("ValueError: bad header")).otherwise(F.lit("")).alias("error"),
            F.when(page % 4 == 3, F.array().cast("array<string>")).otherwise(two).alias("raw_channel_names"),
            F.when(page % 5 == 0, F.lit(None).cast("string")).otherwise((page % 7 * 200).cast("string")).alias("sampling_rate_estimate"),
            F.when(page % 9 == 0, F.lit("44100")).otherwise(F.lit("unknown")).alias("audio_sampling_rate"),
            F.array(pick(CONDITION_WORDS, page)).alias("process_condition_columns"),
        )

    @cached_property
    def nc_lines(self) -> DataFrame:
        """Control-program lines: one program per supplier, in cut order.

        Programs arrive as stored, numbered lines; the numbered stand-in is therefore written once and read
        from there by the branches of a query.
        """
        keys, order = ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
        line = self.spread("lineitem").select(*keys, *order, "l_quantity")
        numbered = ordered_index(line, keys, order, "line_no")
        return checkpointed(numbered.select(F.col("l_suppkey").alias("program_id"), "line_no", nc_text().alias("text")))

    @cached_property
    def nc_unordered(self) -> DataFrame:
        """The same lines without their number, for word statistics."""
        return self.spread("lineitem").select(F.col("l_suppkey").alias("program_id"), F.lit(0).alias("line_no"), nc_text().alias("text"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label"
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Targets and predictions per order line: list price share against a flat estimate."""
        return self.read("lineitem").select(
            F.col("l_suppkey").alias("tool_id"),
            F.col("l_returnflag").alias("task"),
            F.col("l_quantity").alias("target"),
            (F.col("l_extendedprice") / 2000.0 + F.col("l_tax") * 10.0).alias("predicted"),
            (F.col("l_discount") * 10.0 - 0.5).alias("log_var"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        )


CTES: dict[str, str] = {
    "readings": f"""SELECT user_id AS series_id, {EVENT_CHANNEL_SQL} AS channel,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq, ts, value FROM events""",
    "cuts": f"""SELECT l_suppkey AS tool_id, 'c' || (l_suppkey % 6 + 1) AS condition_id,
        row_number() OVER w - 1 AS cut,
        (sum(round(l_discount * 100)::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT / 10000.0::DOUBLE AS wear_vb_mm,
        l_quantity * {CUTTING_CIRCUMFERENCE}::DOUBLE AS cutting_speed, l_linenumber * 0.05::DOUBLE AS feed, l_tax + 0.1::DOUBLE AS axial_depth,
        l_extendedprice / 50.0::DOUBLE AS force_n, l_partkey AS part_id
        FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)""",
    "channel_names": f"""SELECT {_pick_sql(CHANNEL_PREFIXES, 'p_partkey')} || {_pick_sql(CHANNEL_CORES, 'p_partkey + p_size')}
        || {_pick_sql(CHANNEL_SUFFIXES, 'p_size + p_partkey // 7')} AS raw_name FROM part""",
    "inventory": f"""SELECT page_id AS file_id,
        regexp_extract(url, '^https?://(?:www\\.)?([^/]+)/', 1) || '/' || {_pick_sql(PATH_WORDS, 'page_id')} || '/'
        || regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) || '/f' || page_id || {_pick_sql(EXTENSIONS, 'page_id * 3 + 1')} AS relative_path,
        length(html)::BIGINT AS file_size, page_id % 13 <> 0 AS readable,
        CASE WHEN page_id % 17 = 0 THEN 'ValueError: bad header' ELSE '' END AS error,
        CASE WHEN page_id % 4 = 3 THEN [] ELSE [
            {_pick_sql(CHANNEL_CORES, 'page_id')} || {_pick_sql(CHANNEL_SUFFIXES, 'page_id * 3')},
            {_pick_sql(CHANNEL_CORES, 'page_id + 5')} || {_pick_sql(CHANNEL_SUFFIXES, 'page_id * 3 + 1')}] END AS raw_channel_names,
        CASE WHEN page_id % 5 = 0 THEN NULL ELSE (page_id % 7 * 200)::VARCHAR END AS sampling_rate_estimate,
        CASE WHEN page_id % 9 = 0 THEN '44100' ELSE 'unknown' END AS audio_sampling_rate,
        [{_pick_sql(CONDITION_WORDS, 'page_id')}] AS process_condition_columns FROM pages""",
    "nc_lines": """SELECT l_suppkey AS program_id,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS line_no,
        CASE WHEN l_orderkey % 97 = 0 THEN '% O' || l_orderkey ELSE
        'n' || l_linenumber
        || CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE ' G' || CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 92 ELSE l_orderkey % 4 END END
        || CASE WHEN l_orderkey % 3 = 0 THEN ' X-' || l_quantity::BIGINT || '.5' ELSE ' Y' || l_quantity::BIGINT END
        || CASE WHEN l_orderkey % 11 = 0 THEN ' F' || l_orderkey % 300 || ' S' || l_orderkey % 9000 ELSE '' END
        || CASE WHEN l_orderkey % 13 = 0 THEN ' M' || l_orderkey % 10 || ' T' || l_orderkey % 20 ELSE '' END
        || CASE WHEN l_orderkey % 17 = 0 THEN ' (tool X9 note)' ELSE '' END
        || CASE WHEN l_orderkey % 19 = 0 THEN '; Z99' ELSE '' END END AS text FROM lineitem""",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label FROM embeddings",
    "predictions": """SELECT l_suppkey AS tool_id, l_returnflag AS task, l_quantity AS target,
        l_extendedprice / 2000.0::DOUBLE + l_tax * 10.0::DOUBLE AS predicted, l_discount * 10.0::DOUBLE - 0.5::DOUBLE AS log_var,
        l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem""",
}


def with_tables(*names: str, body: str) -> str:
    """Prefix ``body`` (which may itself start with further CTEs after a comma) with the named tables."""
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {parts} {body}"
