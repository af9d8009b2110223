"""File sources and sinks, the wear benchmark on a generated lake, and the streaming job."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swarf.operators import catalog
from swarf.plans.wear import wear_benchmark
from swarf.sources import cut_files, files, records
from swarf.sources import lake as lakes
from swarf.streaming.features import stream_time_features


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    rng = np.random.default_rng(0)
    names = files.SENSOR_CHANNELS
    labels = ["condition,cut,flute_1_wear_mm,flute_2_wear_mm,average_wear_mm"]
    for c in ("c1", "c2", "c5", "c6"):
        folder = root / "train" / c
        folder.mkdir(parents=True)
        for cut in range(1, 7):
            wear = 0.35 * cut / 6
            labels.append(f"{c},{cut},{wear},{wear},{wear}")
            rows = rng.normal(0, 1 + wear, size=(20, len(names)))
            body = "\n".join(f"{i * 0.01}," + ",".join(f"{v:.6f}" for v in r) for i, r in enumerate(rows))
            (folder / f"{c}_{cut:03d}.csv").write_text("time, " + ", ".join(n.replace("_", " ").title() for n in names) + "\n" + body + "\n")
        (folder / f"{c}_099.csv").write_text("time,force_x\n0,1\n")
    (root / "train_labels.csv").write_text("\n".join(labels) + "\n")
    return root


def test_cut_lake_and_benchmark(spark, lake):
    labels = records.read_records(spark, str(lake / "train_labels.csv"), "csv")
    cuts = files.read_cut_lake(spark, str(lake / "train"), labels)
    keys = cuts.select("condition_id", "cut").distinct()
    assert keys.count() == 24 and cuts.count() == 24 * 20
    found = {r["split"]: r for r in wear_benchmark(spark, cuts).collect()}
    assert set(found) == {"train", "val", "test"} and found["train"]["mae"] < 0.1


def test_cut_files_keep_their_own_columns(spark, tmp_path):
    folder = tmp_path / "train" / "c1"
    folder.mkdir(parents=True)
    (folder / "c1_001.csv").write_text("time,Force X,force_y\n0,1,2\n1,3,4\nbroken\n")
    (folder / "c1_002.csv").write_text("force_y,time,force_x,extra\n20,0,10,\n40,1,30,\n")
    labels = spark.createDataFrame([("c1", 1, 0.1), ("c1", 2, 0.2)], "condition string, cut int, average_wear_mm double")
    rows = files.read_cut_lake(spark, str(tmp_path / "train"), labels).select("cut", "force_x", "force_y").collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 2), (1, 3, 4), (2, 10, 20), (2, 30, 40)]
    assert [r["line"] for r in files.cut_lake_rejects(spark, str(tmp_path / "train")).collect()] == ["broken"]


def test_written_cut_lake(spark, tmp_path):
    import csv

    rows = [("c1", 1, k, k + 0.1, f'a "{k}", b') for k in range(200)] + [("c2", 1, 0, None, None), ("c2", 12, 0, 1e-17, "x")]
    cuts = spark.createDataFrame(rows, "condition_id string, cut int, seq int, force_x double, note string").repartition(7)
    root = tmp_path / "lake"
    cut_files.write_cut_lake(cuts, f"file:{root}", ["seq"], ["note", "force_x"], rows=16)
    found = sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file())
    parts = [p for p in found if p.startswith("c1/cut_001_")]
    # a large cut is split, its parts follow each other, and nothing else is left below the root
    assert len(parts) > 3 and found == [*parts, "c2/cut_001_00000.csv", "c2/cut_012_00000.csv"] and {p.name for p in root.iterdir()} == {"c1", "c2"}
    read = [r for p in parts for r in csv.DictReader(open(root / p, newline=""))]
    assert [(r["note"], float(r["force_x"])) for r in read] == [(n, v) for c, _, _, v, n in rows if c == "c1"]
    labels = spark.createDataFrame([("c1", 1, 0.1), ("c2", 12, 0.2), ("c2", 1, 0.3)], "condition string, cut int, average_wear_mm double")
    back = files.read_cut_lake(spark, str(root), labels).select("condition_id", "cut", "force_x").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((c, n, v)) for c, n, _, v, _ in rows) and files.cut_lake_rejects(spark, str(root)).count() == 0
    cut_files.write_cut_lake(cuts.limit(0), str(tmp_path / "none"), ["seq"], ["force_x"])
    assert not list((tmp_path / "none").rglob("*.csv"))
    for name in (None, "a/b", "..", ""):
        with pytest.raises(Exception, match="cannot name a file"):
            cut_files.write_cut_lake(cuts.withColumn("condition_id", F.lit(name).cast("string")), str(tmp_path / "bad"), ["seq"], ["force_x"])
    assert not list((tmp_path / "bad").rglob("*")) and pytest.raises(ValueError, cut_files.write_cut_lake, cuts, "x", ["seq"], ["force_x"], "a_1")


def test_failed_attempts_leave_nothing(tmp_path):
    import pyarrow as pa

    writer = cut_files.CutFileWriter(str(tmp_path), "cut")
    batch = pa.RecordBatch.from_pydict({"_condition": ["c", "c", "d"], "_cut": [1, 1, 2], "_part": [0, 0, 0], "force_x": [1.0, 2.0, 3.0]})
    writer.write(iter([batch]))  # an attempt whose message is lost
    writer.commit([writer.write(iter([batch, batch.slice(2)])), None, writer.write(iter([]))])
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.csv")) == ["c/cut_001_00000.csv", "d/cut_002_00000.csv"]
    assert (tmp_path / "d/cut_002_00000.csv").read_text().split() == ['"force_x"', "3", "3"] and len(list(tmp_path.iterdir())) == 2


def test_inventory_of_a_folder(spark, lake):
    listed = catalog.classify_files(files.file_inventory(spark, str(lake)))
    assert listed.count() == 29
    kinds = {(r["dataset_name"], r["file_type"]) for r in listed.select("dataset_name", "file_type").distinct().collect()}
    assert kinds == {("train", "tabular"), ("root", "tabular")}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("machine report\nserial;12\ntime;force_x;note\n0;1.5;x\n1;2.5;y\nbroken\n2;3.5;z\n")
    (tmp_path / "b.txt").write_bytes("설비 기록\ntime,vibration_x\n0,7\n1,8\n".encode("cp949"))
    (tmp_path / "c.txt").write_bytes("﻿1\t2\n3\t4\n".encode("utf-8"))
    rows = files.read_delimited(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1)).collect()
    pick = lambda name, channel: [r["value"] for r in sorted(rows, key=lambda r: r["seq"]) if r["name"] == name and r["raw_name"] == channel]
    assert pick("a.csv", "force_x") == [1.5, 2.5, 3.5] and pick("a.csv", "note") == []
    assert pick("b.txt", "vibration_x") == [7, 8]
    assert pick("c.txt", "1") == [2, 4]
    assert pick("a.csv", "time") == [] and [r["line"] for r in files.rejected_lines(spark, str(tmp_path)).collect()] == ["broken"]
    codes = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in files.read_lines(spark, str(tmp_path)).select("file", "encoding").distinct().collect()}
    assert codes == {"a.csv": "UTF-8", "b.txt": "cp949", "c.txt": "UTF-8"}


@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"a\r\nbb\r\r\n\nccc\rd", b"\xef\xbb\xbfx\ny\n\n", b"\r\n\r\n", b"abc\r\n" * 4 + b"\r"])
def test_chunks_of_a_file_hold_each_line_once(tmp_path, text):
    (tmp_path / "f").write_bytes(text)
    want = text.removeprefix(b"\xef\xbb\xbf").splitlines()
    for step in range(1, len(text) + 2):
        assert [x for a in range(0, len(text), step) for x in lakes.chunk_lines(str(tmp_path / "f"), a, min(a + step, len(text)))] == want, step


def test_lakes_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """Neither the driver nor Spark's reader lists the files, and files of several chunks give the same lines."""
    (tmp_path / "a b" / "c").mkdir(parents=True)
    (tmp_path / "a b" / "c" / "x%.csv").write_bytes("설비 기록\nforce_x,힘\n0,1\n".encode("cp949") * 3)
    (tmp_path / "a b" / "y.csv").write_text("force_x,é\r\n1,2\r\n3,4")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "z.csv").write_text("1,2\n")
    (tmp_path / "n.txt").write_text("1,2\n")
    row = lambda r: (r["file"], r["line_no"], r["line"], r["encoding"])
    got = [sorted(map(row, files.read_lines(spark, path, "*.csv", **more).collect())) for path, more in ((str(tmp_path), {}), (f"file:{tmp_path}", {"chunk": 7}))]
    monkeypatch.setattr(lakes, "local_folder", lambda *a: None)
    assert got[0] == got[1] == sorted(map(row, files.read_lines(spark, str(tmp_path), "*.csv").collect())) and len(got[0]) == 12


def test_a_committed_lake_is_not_listed_by_messages(tmp_path):
    writer = cut_files.CutFileWriter(str(tmp_path / "lake"), "cut")
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{k // 50}" for k in range(200)]), pa.array(range(200)), pa.array([0] * 200), pa.array([1.5] * 200)], ["_condition", "_cut", "_part", "force_x"])
    message = writer.write(iter([batch]))
    assert len(pickle.dumps(message)) < 1000 and not list((tmp_path / "lake").glob("c*"))
    writer.commit([message, None])
    assert len(list((tmp_path / "lake").glob("c*/cut_*.csv"))) == 200 and {p.name for p in (tmp_path / "lake").iterdir()} == {"c0", "c1", "c2", "c3"}


@pytest.mark.parametrize("fmt", ["csv", "parquet", "jsonl"])
def test_record_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, ["a", "b,\"c"], "x"), (2, [], "y")], "id int, tags array<string>, name string")
    path = str(tmp_path / fmt)
    records.write_records(df, path, fmt)
    nested = {"tags": "array<string>"} if fmt == "csv" else {}
    back = records.read_records(spark, path, fmt, nested=nested).select(F.col("id").cast("int").alias("id"), "tags", "name")
    assert sorted(back.collect()) == sorted(df.collect())


def test_streaming_statistics(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    rows = stream.select(F.col("user_id").alias("series_id"), F.col("event_type").alias("channel"), "ts", "value")
    query = stream_time_features(rows, "1 day").writeStream.outputMode("complete").format("memory").queryName("stream_out").start()
    query.processAllAvailable()
    query.stop()
    want = spark.read.parquet(path).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "user_id", "event_type").agg(F.avg("value").alias("m"))
    got = spark.table("stream_out")
    assert got.count() == want.count()
    assert np.isclose(got.agg(F.sum("mean")).first()[0], want.agg(F.sum("m")).first()[0])
