"""Annotation documents, progress records and the log import on small fixtures."""

import pytest
from pyspark.sql import functions as F

from stepfold.operators import aggregates, documents, imports, tasks
from stepfold.sources import shapes

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_documents(spark, tmp_path):
    frames = spark.createDataFrame(
        [(1, 1, 11, "initial", None, None), (1, 2, 12, None, "verified", (5.0, 5.0, 20.0, 20.0)), (1, 3, 13, "ignore", None, None), (2, 1, 21, "normal", None, None), (2, 2, 22, "normal", None, None)],
        f"machine long, step long, image_id long, step_type string, review_status string, region {BOX}",
    )
    rows = spark.createDataFrame(
        [
            (1, 1, "a", "lid", "verified", (0.0, 0.0, 4.0, 2.0), 7.0, None),
            (1, 1, "b", "lid", "auto", (0.0, 0.0, 4.0, 2.0), 7.0, None),
            (1, 2, "a", "fan", "verified", None, None, (0.0, 0.0, 10.0, 10.5)),
            (1, 2, "b", "fan", "verified", None, None, (0.0, 0.0, 5.0, 5.0)),
            (1, 2, "c", "odd", "verified", None, None, (6.0, 6.0, 9.0, 9.0)),
            (1, 3, "a", "lid", "verified", (0.0, 0.0, 4.0, 2.0), 7.0, None),
            (2, 1, "a", "lid", "verified", (0.0, 0.0, 4.0, 2.0), 6.5, None),
            (2, 2, "a", "lid", None, None, None, None),
        ],
        f"machine long, step long, key string, cls string, status string, mask_box {BOX}, mask_area double, box {BOX}",
    )
    conflicts = spark.createDataFrame([(2, 1), (2, 1)], "machine long, step long")
    with pytest.raises(ValueError):
        documents.refuse_conflicts(conflicts, allow=False)
    disputed = documents.refuse_conflicts(conflicts, allow=True)
    classes = documents.categories(spark, [("lid", "cover"), ("fan", None)])
    assert [tuple(r) for r in classes.orderBy("id").collect()] == [(1, "lid", "cover"), (2, "fan", "other")]
    shown = documents.images(frames, rows, disputed, "gold")
    assert {(r.image_id, r.verified) for r in shown.collect()} == {(11, False), (12, True), (21, False)}
    got = documents.annotations(shown, rows, disputed, classes, ["machine", "step", "key"], include_boxes=True)
    want = [(1, 11, 1, [0, 0, 4, 2], 7, True), (2, 12, 2, [0, 0, 5, 5.5], 27.5, True), (3, 21, 1, [0, 0, 4, 2], 6.5, False)]
    assert [(r.id, r.image_id, r.category_id, r.bbox, r.area, r.verified) for r in got.orderBy("id").collect()] == want
    assert documents.annotations(shown, rows, disputed, classes, ["machine", "step", "key"]).count() == 2
    assert [r[0] for r in got.orderBy("id").select(documents.json_number(F.col("area"))).collect()] == ["7", "27.5", "6.5"]
    documents.write_document(str(tmp_path / "d"), classes, shown, got)
    assert spark.read.json(str(tmp_path / "d" / "annotations")).count() == 3
    assert documents.images(frames, rows.limit(0), disputed, "gold").count() == 0


def test_progress_of_unnamed_and_empty_logs(spark):
    frames = spark.createDataFrame([(m, s) for m in (1, 2, 3) for s in (1, 2, 4)], "machine long, step long")
    actions = spark.createDataFrame([(1, 2, "turn", "box"), (1, 3, "turn", "box"), (1, 5, "open", "lid"), (2, 1, "open", "lid.?")], "machine long, step long, verb string, target string")
    got = tasks.progress_records(frames, actions, "machine", "step", ["a", "b", "c", "d"]).orderBy("step").collect()
    assert [(r.machine, r.step, [tuple(d) for d in r.done], r.remaining, r.bin) for r in got] == [(1, 1, [], 3, "a"), (1, 2, [("turn", "box")], 2, "b"), (1, 4, [("turn", "box")], 1, "c")]


def test_import_logs(spark):
    rows = [
        (1, 1, "start", None, None, None, None, None, None, None),
        (1, 2, "blue lid", "cover", None, None, None, None, None, "hand"),
        (1, 3, "bolt 1", "screw", 1, None, None, None, None, "bit"),
        (1, 4, "bolt 1 again", "screw", 1, "remove", None, None, None, None),
        (1, 5, "bolt 1 other", "screw", 1, None, None, None, None, "bit"),
        (1, 6, "try the fan", "fan", None, None, None, True, None, None),
        (1, 7, "fan", "fan", None, None, None, None, None, None),
        (1, 8, "plugs a and b", "connector", None, None, None, None, True, None),
        (1, 9, "something", "", None, None, None, None, None, None),
        (1, 10, "turn it", None, None, None, "reorient", None, None, None),
        (1, 11, "same again", "fan", None, None, "dupli", None, None, None),
        (2, 2, "start over", None, None, None, "initial", None, None, None),
    ]
    parsed = spark.createDataFrame(rows, "machine long, step long, raw string, cls string, number long, verb string, hint string, attempt boolean, multi boolean, tool string")
    got = imports.import_logs(parsed)
    assert [r.step_type for r in got["steps"].where("machine = 1").orderBy("step").collect()] == ["initial", *["normal"] * 4, "failed", "normal", "compound", "normal", "reorient", "dupli"]
    acts = {r.step: (r.target, r.verb, r.tool, r.result) for r in got["actions"].collect()}
    assert acts == {
        2: ("cover.01", "open", "hand", "success"),
        3: ("screw.01", "unscrew", "bit", "success"),
        4: ("screw.01", "remove", "unknown", "success"),
        5: ("screw.02", "unscrew", "bit", "success"),
        6: ("fan.01", "remove", "none", "failed"),
        7: ("fan.01", "remove", "none", "success"),
        8: ("connector.?", "disconnect", "none", "success"),
        9: ("?", "remove", "none", "success"),
        10: ("chassis", "reorient", "none", "success"),
    }
    assert {(r.step, r.issue) for r in got["issues"].collect()} == {(4, "no tool"), (8, "names several targets"), (9, "names no target class")}
    held = {(r.machine, r.key): r.raw_names for r in got["instances"].collect()}
    assert held[1, "screw.01"] == ["bolt 1", "bolt 1 again"] and held[1, "fan.01"] == ["try the fan", "fan"] and held[2, "chassis"] == [] and len(held) == 6
    assert all(df.count() == 0 for df in imports.import_logs(parsed.limit(0)).values())


def test_pixel_boxes(spark):
    value = "struct<x:double,y:double,width:double,height:double,rotation:double,radiusX:double,radiusY:double,points:array<array<double>>>"
    rows = [
        ("rectangle", (10.0, 10.0, 20.0, 10.0, None, None, None, None)),
        ("rectangle", (50.0, 50.0, 20.0, 10.0, 90.0, None, None, None)),
        ("ellipse", (50.0, 50.0, None, None, 0.0, 10.0, 5.0, None)),
        ("polygon", (None, None, None, None, None, None, None, [[1.0, 2.0], [5.0, 2.0], [3.0, 120.0]])),
        ("polygon", (None, None, None, None, None, None, None, [[1.0, 2.0], [5.0, 2.0]])),
        ("rectangle", (100.0, 10.0, 20.0, 10.0, None, None, None, None)),
        ("choices", (10.0, 10.0, 20.0, 10.0, None, None, None, None)),
        ("rectangle", None),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], f"i long, kind string, value {value}")
    got = df.select("i", shapes.pixel_box(F.col("kind"), F.col("value"), F.lit(200), F.lit(100)).alias("b")).orderBy("i").collect()
    assert [r.b and tuple(r.b) for r in got] == [(20, 10, 61, 21), (90, 50, 101, 91), (80, 45, 121, 56), (2, 2, 11, 100), None, None, None, None]


def test_bands_of_ties_and_nulls(spark):
    values = [1.0] * 5 + [2.0] * 3 + [9.0, None, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    assert [tuple(r) for r in aggregates.bands(df, ["k"], "v", 2).collect()] == [("a", 1.0, 1.0, 9.0, 9)]


def test_document_lists_are_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('name ', id) as name", "array(1.0D * id, null) as bbox")
    documents.write_document(str(tmp_path / "d"), rows, rows, rows)
    for name in ("categories", "images", "annotations"):
        files = [f for f in (tmp_path / "d" / name).iterdir() if f.name.startswith("part-")]
        assert files and all(f.name.endswith(".json.gz") for f in files)
        assert sorted(spark.read.schema(rows.schema).json(str(tmp_path / "d" / name)).collect()) == sorted(rows.collect())
