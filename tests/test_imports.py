"""Listings, published tables and the ledger against plain walks, earlier states and a search."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stepfold.sources import entities, listing, publish


def tree(root):
    for path in ("desktop_01/scan/001/a.png", "desktop_01/scan/002/b.png", "desktop_01/scan/002/c.png", "desktop_12/x.png", "desktop_7/.hidden/y", "other/z.png", "_tmp/q"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    (root / "desktop_12" / "empty").mkdir()
    os.symlink("loop", root / "desktop_12" / "loop")  # a path that cannot be resolved


def test_listing_has_files_and_errors(spark, tmp_path):
    tree(tmp_path)
    df = listing.read_listing(spark, str(tmp_path), "desktop_([0-9]+)")
    rows = {(r.machine, r.dir, r.file, r.bytes, r.error is not None) for r in df.collect()}
    assert rows == {(1, "scan/001", "a.png", 25, False), (1, "scan/002", "b.png", 25, False), (1, "scan/002", "c.png", 25, False), (12, ".", "x.png", 16, False), (12, ".", "loop", None, True)}
    assert df.rdd.getNumPartitions() == 3  # one for each machine's folder
    missing = listing.read_listing(spark, str(tmp_path / "gone"), "desktop_([0-9]+)").collect()
    assert [(r.machine, r.dir, r.file) for r in missing] == [(None, ".", None)] and "FileNotFoundError" in missing[0].error
    assert listing.read_listing(spark, str(tmp_path / "other"), "desktop_([0-9]+)").count() == 0


def test_many_folders_share_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"desktop_{i}/scan/{i % 7}/é.txt", f"é{i}\nx") for i in range(300)], "path string, text string")
    listing.write_files(files, str(tmp_path))
    listing.write_files(files, f"file:{tmp_path}")  # once more: nothing is written twice
    df = listing.read_listing(spark, str(tmp_path), "desktop_([0-9]+)")
    assert df.rdd.getNumPartitions() == listing.TASKS
    assert {(r.machine, r.dir, r.file, r.bytes) for r in df.collect()} == {(i, f"scan/{i % 7}", "é.txt", len(f"é{i}\nx".encode())) for i in range(300)} and df.count() == 300


def test_machine_filters_choose_folders(spark, tmp_path):
    tree(tmp_path)
    df = listing.read_listing(spark, str(tmp_path), "desktop_([0-9]+)")
    one = df.where("machine = 12")
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1
    assert df.where("machine in (1, 7) and file like 'b%'").count() == 1 and df.where("machine in (1, 7)").rdd.getNumPartitions() == 2
    assert df.where("machine = 99").count() == 0


def test_unreadable_folders_are_rows(tmp_path, monkeypatch):
    tree(tmp_path)
    real = os.scandir

    def scandir(path):
        if str(path).endswith("002"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    got = list(listing.walk(str(tmp_path / "desktop_01"), str(tmp_path / "desktop_01")))
    assert [g[:2] for g in got] == [("scan/001", "a.png"), ("scan/002", None)] and got[1][-1] == "PermissionError: Permission denied"


def tables(spark, rows):
    steps = spark.createDataFrame([(m, s, t) for m, s, t in rows], "machine long, step int, raw string")
    return {"steps": steps, "actions": steps.where("step > 1").select("machine", "step", F.lit("remove").alias("verb"))}


def test_published_tables_change_together(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    first = tables(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, None), (None, 1, "lost")])
    read = lambda name: sorted(tuple(map(str, r)) for r in publish.published(spark, folder, name, first[name].schema).collect())
    said = lambda df: {r.machine: r.outcome for r in df.collect()}
    assert read("steps") == []
    assert said(publish.publish(first, folder)) == {1: "published", 2: "published", 3: "published"}
    steps = [("1", "1", "a"), ("1", "2", "b"), ("2", "1", "a"), ("3", "1", "None")]
    assert read("steps") == steps and read("actions") == [("1", "2", "remove")]
    assert said(publish.publish(first, folder)) == {1: "unchanged", 2: "unchanged", 3: "unchanged"}

    second = tables(spark, [(1, 1, "a"), (2, 1, "z"), (2, 2, "z"), (4, 1, "n")])  # 1 loses its action, 3 is not there
    whole = publish._overwrite
    def broken(df, path, *by):
        if path.endswith("manifest") or path.endswith("actions"):
            raise OSError("disk full")
        whole(df, path, *by)

    monkeypatch.setattr(publish, "_overwrite", broken)
    with pytest.raises(OSError):
        publish.publish(second, folder)
    assert read("steps") == steps and read("actions") == [("1", "2", "remove")]
    monkeypatch.setattr(publish, "_overwrite", whole)
    held = spark.createDataFrame([(2,)], "machine int")
    assert said(publish.publish(second, folder, held)) == {1: "published", 2: "held", 4: "published"}
    assert read("steps") == [("1", "1", "a"), ("2", "1", "a"), ("3", "1", "None"), ("4", "1", "n")] and read("actions") == []
    for rows in ([(1, 1, "c")], [(1, 1, "d"), (1, 2, "d")]):
        publish.publish(tables(spark, rows), folder)
    assert [r for r in read("steps") if r[0] == "1"] == [("1", "1", "d"), ("1", "2", "d")] and read("actions") == [("1", "2", "remove")]


def test_folders_do_not_grow_with_machines(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(m, s, f"{m}") for m in range(3 * publish.BUCKETS) for s in (1, 2)]
    publish.publish(tables(spark, rows), folder)
    publish.publish(tables(spark, [(5, 1, "new")]), folder)  # the others of its bucket come along
    assert len([n for n in os.listdir(f"{folder}/steps") if "=" in n]) == publish.BUCKETS
    got = publish.published(spark, folder, "steps", tables(spark, rows)["steps"].schema).collect()
    assert sorted((r.machine, r.step, r.raw) for r in got) == sorted([r for r in rows if r[0] != 5] + [(5, 1, "new")])


def searched(rows):
    """The ledger by search: books of made instances, one row after the other."""
    books, ordinals, out = {}, {}, {}
    for m, step, seq, cls, disc, number, owner, verb, ok, gone in sorted(rows, key=lambda r: r[1:3]):
        book = books.setdefault((m, cls, disc or "", number, owner or ""), [])
        found, rivals = None, False
        if number is not None:
            found = next((i for i in book if verb not in i["verbs"]), None)
        elif ok and verb == "remove":
            alive = [i for i in book if i["open"]]
            found, rivals = (alive[0] if len(alive) == 1 else None), len(alive) > 1
        made = found is None
        if made:
            n = ordinals[m, cls, disc or ""] = ordinals.get((m, cls, disc or ""), 0) + 1
            key = "chassis" if cls == "chassis" else ".".join([cls, *([disc] if disc else []), f"{n:02d}"])
            found = {"key": key, "verbs": set(), "open": number is None and not gone and (not ok or verb in entities.NON_TERMINAL)}
            book.append(found)
        else:
            found["open"] = False
        found["verbs"].add(verb)
        out[m, seq] = (found["key"], made, rivals)
    return out


def test_ledger_against_search(spark):
    rng = random.Random(8)
    rows = [(rng.randint(1, 4), rng.randint(1, 60), seq, rng.choice(["screw", "screw", "ram", "chassis"]), rng.choice([None, "", "board"]), rng.choice([None, None, 1, 2]), rng.choice([None, "psu"]), rng.choice(["open", "remove", "remove", "unscrew", "reorient"]), rng.random() < 0.8, rng.random() < 0.1) for seq in range(900)]
    schema = "machine int, step int, seq int, cls string, disc string, number int, owner string, verb string, ok boolean, gone boolean"
    df = spark.createDataFrame(rows, schema).select("*", F.lit(None).cast("string").alias("qualifier"), F.lit("").alias("of")).repartition(5)
    got = {(r.machine, r.seq): (r.key, r.made, r.rivals) for r in entities.ledger(df).collect()}
    assert got == searched(rows)
    assert any(v[2] for v in got.values()) and any(not v[1] for v in got.values()) and any(k.endswith(".10") for k, _, _ in got.values())
    assert entities.ledger(df.limit(0)).count() == 0
