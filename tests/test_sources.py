"""Sources on small files written here."""

import datetime
import json

from pyspark.sql import functions as F

from stepfold.sources import entities, logs


def test_step_log(spark, tmp_path):
    (tmp_path / "desktop_13.csv").write_text(
        "﻿title,,\nSequence Number,Sequence Name,Tool Utility,Notes\n1,Initial condition,,\n2, CPU Fan Screw 1 ,Philips PH2,\"a, b\"\n3,,,\n4,RAM,,x\nDesktop ID,13\nDesktop Brand,Acme X\nCollection Date,2025-06-03 00:00:00\n,left door open\n"
    )
    cells = logs.read_cells(spark, str(tmp_path), 6)
    rows = logs.step_rows(cells).orderBy("line").collect()
    assert [r.row["Sequence Name"] for r in rows] == ["Initial condition", "CPU Fan Screw 1", "RAM"]
    assert rows[1].row["Notes"] == "a, b"
    meta = logs.meta_rows(cells).withColumn("date", logs.collection_date(F.col("meta"))).first()
    assert meta.meta["Desktop Brand"] == "Acme X" and meta.notes == "left door open" and meta.date == datetime.date(2025, 6, 3)


def test_wide_and_quoted_log(spark, tmp_path):
    far = "," * 30 + "end"
    (tmp_path / "a.csv").write_text('Sequence Number,Sequence Name,Notes\n\n1,"RAM ""A""","two\nlines, one cell"' + far + "\n")
    (tmp_path / "b.csv").write_text("")
    rows = logs.read_cells(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.line, len(r.cells)) for r in rows] == [(1, 33), (2, 33)]
    assert rows[1].cells[1:3] == ['RAM "A"', "two\nlines, one cell"] and rows[1].cells[-1] == "end"


def test_logs_are_read_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Desktop ID,9\nSequence Number,Sequence Name\n1,RAM\nSequence Number,Sequence Name\nDesktop ID,13\n2,late\n,note\n")
    (tmp_path / "b.csv").write_text("no,table\n")
    cells = logs.read_cells(spark, str(tmp_path))
    steps, meta = logs.step_rows(cells), logs.meta_rows(cells.where("line > 1"))
    assert [df._jdf.queryExecution().sparkPlan().toString().count("FileScan") for df in (steps, meta)] == [1, 1]
    assert [(r.line, r.row["Sequence Name"]) for r in steps.orderBy("line").collect()] == [(3, "RAM"), (4, "Sequence Name")]
    assert [(r.meta, r.notes) for r in meta.collect()] == [({"Desktop ID": "13"}, "note")]


def test_listings(spark):
    files = spark.createDataFrame([("a/desktop_01.csv",), ("b/Desktop 1.csv",), ("a/desktop_13_meta.csv",), ("a/desktop_13.csv",), ("x.txt",)], "path string")
    assert {(r.desktop, r.path) for r in logs.log_files(files).collect()} == {(1, "b/Desktop 1.csv"), (13, "a/desktop_13.csv")}
    caps = spark.createDataFrame([("d", "rgb_20250531_104736_629.png"), ("d", "depth_20250531_104736_629.png"), ("d", "notes.txt")], "dir string, file string")
    got = logs.capture_groups(caps).first()
    assert set(got.files) == {"rgb", "depth"} and got.ts == datetime.datetime(2025, 5, 31, 10, 47, 36, 629000)


def test_label_export(spark, tmp_path):
    result = [{"id": "r1", "type": "polygonlabels", "value": {"x": 1.0, "y": 2.0, "polygonlabels": ["screw", "b"]}}, {"id": "r2", "type": "rectanglelabels", "value": {"rectanglelabels": ["board"]}}, {"type": "relation", "from_id": "r1", "to_id": "r2"}, {"type": "relation", "from_id": "r1", "to_id": "gone"}]
    task = lambda image: {"data": {"image": image}, "annotations": [{"result": result}]}
    (tmp_path / "e.json").write_text(json.dumps({"projects": [{"title": "P", "tasks": [task("i1")]}, {"title": "Metadata", "tasks": [task("i2")]}]}))
    rows = logs.label_results(spark, str(tmp_path / "e.json"))
    assert {r.image for r in rows.collect()} == {"i1"}
    assert [tuple(r) for r in logs.relations(rows).collect()] == [("i1", "screw", "board")]


def test_snapshots(spark, tmp_path):
    to = logs.write_snapshot(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(to).count() == 3
    v = spark.createDataFrame([(f"v{i}", datetime.datetime(2025, 1, 1 + i // 3, i)) for i in range(9)], "path string, ts timestamp_ntz")
    assert {r.path for r in logs.retained(v, 2).collect()} == {"v8", "v7", "v5", "v2"}


def test_entities(spark):
    rows = spark.createDataFrame(
        [(1, 1, "screw", 1, "unscrew", True), (1, 2, "screw", 1, "remove", True), (1, 3, "screw", 1, "remove", True), (1, 4, "screw", 2, "remove", False), (1, 5, "screw", None, "remove", True), (1, 6, "fan", None, "remove", True), (2, 1, "screw", None, "open", True)],
        "desktop int, step int, cls string, number int, verb string, ok boolean",
    )
    got = {(r.desktop, r.step): r.key for r in entities.resolve(rows).collect()}
    assert got == {(1, 1): "screw.01", (1, 2): "screw.01", (1, 3): "screw.02", (1, 4): "screw.03", (1, 5): "screw.03", (1, 6): "fan.01", (2, 1): "screw.01"}
