from pyspark.sql import functions as F

from quarryframe.streaming import frames as fs

SCHEMA = "scene string, id long, ts timestamp, label string, flag boolean, reason string"


def source(spark, tmp_path):
    rows = [("s", 1, "00:00:00", None), ("s", 2, "00:00:01", "BAD_GAP"), ("s", 2, "00:00:01", "BAD_GAP"), ("s", 3, "00:05:00", None), ("t", 4, "00:05:01", None), ("t", 5, "02:00:00", None)]
    lines = [f'{{"scene":"{s}","id":{i},"ts":"2024-01-01T{t}","label":"{"a" if i % 2 else "b"}","flag":{str(i > 2).lower()}' + (f',"reason":"{r}"' if r else "") + "}" for s, i, t, r in rows]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    return spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))


def finished(spark, stream, tmp_path, mode, name):
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_resume_and_running_labels(spark, tmp_path):
    stream = source(spark, tmp_path)
    assert sorted(r.id for r in finished(spark, fs.resume_stream(stream, "id", "ts", "10 minutes"), tmp_path, "append", "once")) == [1, 2, 3, 4, 5]
    assert {(r.label, r.n, r.n_flag) for r in finished(spark, fs.running_labels(stream, "label", "flag"), tmp_path, "complete", "labels")} == {("a", 3, 2), ("b", 3, 1)}


def test_gap_sessions(spark, tmp_path):
    got = finished(spark, fs.gap_sessions(source(spark, tmp_path), "scene", "ts", "30 seconds", "1 minute"), tmp_path, "append", "gaps")
    assert {(r.scene, r.n) for r in got} >= {("s", 3), ("s", 1), ("t", 1)}


def test_record_sinks(spark, tmp_path):
    stream = source(spark, tmp_path)
    fs.start_record_sinks(stream, "reason", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/valid")).count() == 4
    assert spark.read.parquet(str(tmp_path / "out/quarantine")).agg(F.max("reason")).first()[0] == "BAD_GAP"
