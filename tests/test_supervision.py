"""Runs, silence and outcomes, in batch and as a stream; readers and sinks."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.sources import readers
from marlstone.streaming import supervision

START = datetime(2026, 1, 1)
SCHEMA = "run_id string, event_id long, ts timestamp, fact string, alive boolean"


def events(spark, runs):
    rows = [(run, i, START + timedelta(seconds=s), fact, alive) for run, items in runs.items() for i, (s, fact, alive) in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


RUNS = {
    "good": [(0, "vivo", True), (50, "vivo", True), (60, "finito", True)],
    "failed": [(0, "vivo", True), (10, "fallito", True), (20, "finito", True)],
    "closed": [(0, "vivo", True), (5, "chiuso", True)],
    "silent": [(0, "vivo", True), (10, "vivo", True)],
    "just": [(0, "vivo", True), (100, "finito", True)],
    "before": [(0, "vivo", True), (99, "vivo", True), (150, "finito", True)],
    "dead_signs": [(0, "vivo", True), (60, "vivo", False), (120, "finito", True)],
    "talks": [(i * 50, "vivo", True) for i in range(12)],
}
OUTCOMES = {"good": "finito_bene", "failed": "fallito", "closed": "fallito", "silent": "ucciso_per_silenzio", "just": "ucciso_per_silenzio", "before": "finito_bene", "dead_signs": "ucciso_per_silenzio", "talks": "ucciso_per_durata"}


def test_outcomes(spark):
    got = {r.run_id: r for r in supervision.outcomes(events(spark, RUNS), silence=100, longest=400).collect()}
    assert {k: r.outcome for k, r in got.items()} == OUTCOMES
    assert got["silent"].ended == START + timedelta(seconds=110) and got["failed"].n_events == 2
    assert supervision.outcomes(events(spark, {"a": RUNS["talks"]}), silence=100).first().outcome == "ucciso_per_silenzio"


def test_silence_has_a_clock_of_its_own(spark):
    got = supervision.silences(events(spark, {"a": RUNS["dead_signs"]})).orderBy("event_id").collect()
    assert [r.silence_s for r in got] == [0.0, 60.0, 60.0]


def test_outcome_stream(spark, tmp_path):
    source, late = f"{tmp_path}/in", {"end": [(100_000, "vivo", True)]}
    runs = {k: v for k, v in RUNS.items() if k != "dead_signs"}
    events(spark, runs).coalesce(1).write.parquet(f"{source}/a")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
    query = supervision.outcome_stream(stream, silence=100, longest=400, delay="1 second").writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        for n, shift in enumerate((0, 100_000)):  # time goes on, so that timers run
            events(spark, {f"end{n}": [(s + shift, f, a) for s, f, a in late["end"]]}).coalesce(1).write.parquet(f"{source}/b{n}")
            query.processAllAvailable()
        got = {r.run_id: r.outcome for r in spark.table("outcomes").collect()}
    finally:
        query.stop()
    assert {k: v for k, v in got.items() if not k.startswith("end")} == {k: v for k, v in OUTCOMES.items() if k in runs}


def test_normalized(spark):
    lines = ["", "not json", json.dumps({"event": "result", "result": {"status": "ok"}}), json.dumps({"event": "result", "result": {"status": "x"}}), json.dumps({"event": "step_update", "step_update": {"step_type": "tool"}}), json.dumps({"event": "closed"}), json.dumps({"event": "init"})]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(supervision.normalized(F.col("x")).alias("e")).collect()
    assert [(r.e.fact, r.e.type) for r in got] == [("vivo", "riga_vuota"), ("vivo", "riga_non_json"), ("finito", "result"), ("fallito", "result"), ("vivo", "tool"), ("chiuso", "closed"), ("vivo", "init")]


def test_health_and_confirmation(spark):
    outcome = spark.createDataFrame([(1, "finito_bene"), (2, "finito_bene"), (3, "finito_bene"), (4, "fallito")], "run_id int, outcome string")
    outputs = spark.createDataFrame([(1, "ok"), (2, "  "), (3, "ok"), (4, "ok")], "run_id int, output string")
    expected = spark.createDataFrame([(1, "a"), (3, "a"), (3, "b")], "run_id int, path string")
    present = spark.createDataFrame([(1, "a"), (3, "b")], "run_id int, path string")
    got = {r.run_id: (r.healthy, r.missing) for r in supervision.healthy(outcome, outputs, expected, present).collect()}
    assert got == {1: (True, []), 2: (False, []), 3: (False, ["a"]), 4: (False, [])}
    idle = spark.createDataFrame([(1, 1), (1, 5), (1, 9), (2, 1)], "run_id int, ts int")
    messages = spark.createDataFrame([(1, 3, "assistant", True, "x"), (1, 1, "assistant", True, " "), (2, 0, "assistant", False, "x")], "run_id int, ts int, role string, completed boolean, text string")
    assert [(r.run_id, r.finished) for r in supervision.confirmed(idle, messages).collect()] == [(1, 5)]


def test_decisions(spark):
    row = spark.sql("SELECT map('edit', 'allow', '*', 'ask') p, map('x', 'y') q, 'bash' k").select(supervision.answer(F.col("p"), F.lit("edit")).alias("a"), supervision.answer(F.col("p"), F.col("k")).alias("b"), supervision.answer(F.col("q"), F.col("k")).alias("c"), supervision.reasons_to_stay({"gpu": F.lit(True), "user": F.lit(False)}).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("allow", "ask", "reject", ["gpu"])
    checks = spark.createDataFrame([("h", 1, 0.0), ("h", 2, 60.0), ("h", 3, 121.0)], "host string, ts int, slept_s double")
    assert [r.woke for r in supervision.wakes(checks).orderBy("ts").collect()] == [False, False, True]
    states = [(0, True), (1, False), (2, False), (30, False), (50, False), (51, True), (52, True)]
    df = spark.createDataFrame([("h", START + timedelta(hours=h), ok) for h, ok in states], "host string, ts timestamp, ok boolean")
    assert [r.notice for r in supervision.notices(df).orderBy("ts").collect()] == ["red", "still red", "still red", "green"]


def test_readers(spark, tmp_path):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v
    assert one("# x\n## Fatti\n- a\n - b \ntesto\n## Altro\n- c\n## Fatti\n- d", readers.bullets) == ["a", "b"]
    assert one("nothing\n- a", readers.bullets) == []
    assert one("# c\n A = 1\nB=x=y\nno\nA=2", readers.settings) == {"A": "2", "B": "x=y"}
    assert one("---\ntitolo: \"A: b\"\ntags:\n  - x: y\n- z: w\npagina: 3\n---\nsezione: 9", readers.front_matter) == {"titolo": '"A: b"', "tags": "", "pagina": "3"}
    assert one("Title: A\nAuthor:  \nPages: 3", readers.metadata) == {"Title": "A"}
    assert one("data: {\"a\":1}", readers.sse_data) == '{"a":1}' and one("event: x", readers.sse_data) is None
    notes = spark.createDataFrame([("a", '---\nsezione: 2\npagina: 5\ntitolo: "Uno"\n---'), ("b", "---\nsezione: 1\n---"), ("c", "---\nsezione: 3\npagina: 6\npagina_fine: 9\n---")], "path string, text string")
    assert [(r.path, r.section, r.title, r.page, r.page_end) for r in readers.section_notes(notes).orderBy("path").collect()] == [("a", 2, "Uno", 5, 5), ("c", 3, "", 6, 9)]
    pages = spark.createDataFrame([(1, 1, '<word xMin="1.5" yMin="2" xMax="3" yMax="4">a&amp;b</word><word yMin="1">c</word>')], "doc_id int, page int, xhtml string")
    assert [(r.x0, r.y1, r.txt) for r in readers.page_words(pages).orderBy("txt").collect()] == [(1.5, 4.0, "a&b"), (0.0, 0.0, "c")]
    listing = spark.createDataFrame([("page num type width height",), ("1 0 image 640 480 x",), ("1 1 smask 6 4",), ("x 1 image 6 4",)], "line string")
    assert [tuple(r) for r in readers.image_list(listing).collect()] == [(1, 0, 640, 480)]
    outline = spark.createDataFrame([(1, 0, " A  b ", 1, 0), (1, 1, " ", 1, 1), (1, 2, "c", 2, None)], "doc_id int, seq int, title string, level int, page0 int")
    assert [(r.title, r.page) for r in readers.outline_rows(outline).collect()] == [("A b", 1)]
    pairs = spark.createDataFrame([("k", "1", 1), ("k", "2", 5), ("j", "3", 2)], "key string, value string, ts int")
    assert {r.key: r.value for r in readers.latest(pairs).collect()} == {"k": "2", "j": "3"}
    good, bad = readers.quarantined(pairs, F.when(F.col("ts") > 4, "late"))
    assert (good.count(), bad.first().reason) == (2, "late")
    asked = spark.createDataFrame([(1, 9, 5), (2, 8, 3), (3, 8, 7)], "request_id int, chat_id int, ts int")
    assert {r.request_id for r in readers.owned(asked).collect()} == {2, 3}
    pairs.select(F.lit(1).alias("conv_id"), F.lit(None).cast("string").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/m")
    assert readers.messages(spark, f"{tmp_path}/m").first().text == "" and readers.said(readers.messages(spark, f"{tmp_path}/m")).count() == 0
    with pytest.raises(ValueError):
        readers.messages(spark, f"{tmp_path}/m", least_files=3)


def test_queue_and_diary(spark, tmp_path):
    spark.range(3).write.json(f"{tmp_path}/q/a")
    query = readers.write_diary(readers.file_queue(spark, f"{tmp_path}/q/*", "id long", format="json"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    spark.range(3, 5).write.json(f"{tmp_path}/q/b")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.id for r in spark.read.schema("id long").json(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]
