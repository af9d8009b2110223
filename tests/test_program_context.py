"""Program vectors and condition maps of training records, by hand."""

import math

from pyspark.sql import functions as F

from swarf.operators import augment, nc

KEYS = [("o1001", 1), ("partb", 2)]
VECTORS = [(1, 0, 0.6), (1, 3, 0.8), (2, 1, 1.0)]


def _matched(spark, records):
    keys = spark.createDataFrame(KEYS, "key string, program_id long")
    return nc.match_context(spark.createDataFrame(records, "record_id long, file_path string, dataset_id string"), keys, ["file_path", "dataset_id"])


def test_fields_match_in_order_and_repeated_records_stay(spark):
    records = [(1, "raw/O1001.nc", "partB"), (2, "raw/x.csv", "set/Part-B.v2"), (3, None, "none"), (3, None, "none"), (4, "", None)]
    found = sorted((r.record_id, r.program_id, r.matching_key, r.context_source) for r in _matched(spark, records).fillna(-1, ["program_id"]).fillna("", ["matching_key"]).collect())
    none = "global_nc_corpus"
    assert found == [(1, 1, "o1001", "matched_program"), (2, 2, "partb", "matched_program"), (3, -1, "", none), (3, -1, "", none), (4, -1, "", none)]


def test_a_hot_value_is_one_dictionary_row(spark):
    """5,000 records share one data set: each keeps its row, and the value is resolved once."""
    records = spark.range(5000).select(F.col("id").alias("record_id"), F.lit(None).cast("string").alias("file_path"), F.lit("partB").alias("dataset_id"))
    keys = spark.createDataFrame(KEYS, "key string, program_id long")
    found = nc.match_context(records, keys, ["file_path", "dataset_id"])
    assert found.count() == 5000 and found.filter("program_id = 2").count() == 5000


def test_vectors_and_mask(spark):
    vectors = spark.createDataFrame(VECTORS, "program_id long, dim int, value double")
    records = _matched(spark, [(1, "O1001.nc", None), (2, "x.csv", None)])
    found = {r.record_id: r for r in nc.attach_context(records, vectors, 4).collect()}
    assert found[1].nc_context == [0.6, 0.0, 0.0, 0.8] and found[1].nc_context_mask
    length = math.sqrt(0.36 + 1 + 0.64)
    assert all(math.isclose(a, b) for a, b in zip(found[2].nc_context, [0.6 / length, 1 / length, 0.0, 0.8 / length])) and found[2].nc_context_mask
    none = nc.attach_context(records, vectors.limit(0), 4).collect()
    assert len(none) == 2 and all(r.nc_context is None and not r.nc_context_mask for r in none)


def test_condition_entries_drop_one_by_one(spark):
    rows = [(k, {"speed": float(k), "feed": 1.0, "none": None}) for k in range(400)] + [(400, None), (401, {})]
    df = spark.createDataFrame(rows, "id long, conditions map<string,double>")
    found = {r.id: r for r in augment.condition_dropout(df, ["id"], 0.25, "s").collect()}
    kept = [found[k].conditions_mask[name] for k in range(400) for name in ("speed", "feed")]
    assert 0.7 < sum(kept) / len(kept) < 0.8
    assert any(found[k].conditions_mask["speed"] != found[k].conditions_mask["feed"] for k in range(400))
    for k in range(400):
        assert found[k].conditions["speed"] == (float(k) if found[k].conditions_mask["speed"] else None) and set(found[k].conditions) == {"speed", "feed", "none"}
    assert found[400].conditions is None and found[400].conditions_mask == {} and found[401].conditions == {}
