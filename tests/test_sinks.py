"""Sinks leave what they should, also when they are run again."""

from datetime import datetime

from pyspark.sql import functions as F

from marlstone.sources import sinks


def test_pages_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/pages"
    first = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, page int, text string")
    sinks.append_pages(first, path)
    sinks.append_pages(first.unionByName(spark.createDataFrame([(2, 1, "c")], first.schema)), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_notes_are_replaced_by_document(spark, tmp_path):
    path = f"{tmp_path}/notes"
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id int, number int, note string")
    sinks.replace_notes(rows((1, 1, "old"), (1, 2, "old"), (2, 1, "kept")), path)
    sinks.replace_notes(rows((1, 1, "new")), path)
    assert sorted((r.doc_id, r.number, r.note) for r in spark.read.parquet(path).collect()) == [(1, 1, "new"), (2, 1, "kept")]


def test_state_counts_when_it_is_complete(spark, tmp_path):
    path, schema = f"{tmp_path}/state", "key string, value int"
    assert sinks.read_state(spark, path, schema) is None
    assert sinks.write_state(spark.createDataFrame([("a", 1)], schema), path) == 1
    assert sinks.write_state(spark.createDataFrame([("a", 2), ("b", 3)], schema), path) == 2
    cut_off = tmp_path / "state" / "version=3"
    cut_off.mkdir()
    (cut_off / "part-0.json").write_text('{"key":"a","value":9}\n')
    assert sorted(map(tuple, sinks.read_state(spark, path, schema).collect())) == [("a", 2), ("b", 3)]
    assert sinks.write_state(spark.createDataFrame([("a", 4)], schema), path) == 3
    assert [tuple(r) for r in sinks.read_state(spark, path, schema).collect()] == [("a", 4)]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["version=3"]


def test_diary_has_silences(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, 1, at(0), "vivo", True), (1, 2, at(7), "finito", True)], "run_id int, event_id int, ts timestamp, fact string, alive boolean")
    lines = sinks.diary(events).select(F.from_json("line", "event_id int, silence_s double").alias("x")).collect()
    assert sorted((r.x.event_id, r.x.silence_s) for r in lines) == [(1, 0.0), (2, 7.0)]
