"""Queries of imports: listings read back from folders, tables published together, the ledger of instances."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepfold.operators import frames as R
from stepfold.operators.imports import import_logs
from stepfold.plans.registry import query
from stepfold.plans.tables import table
from stepfold.session import shared_folder
from stepfold.sources import entities, logs, publish
from stepfold.sources.listing import read_listing, write_files

VIEWS = [("scan",), ("oak",)]


@query("listed_frame_index", """
WITH e AS (SELECT user_id AS desktop, event_id % 5 AS step, CASE event_type WHEN 'click' THEN 'scan' WHEN 'purchase' THEN 'oak' END AS view FROM events),
s AS (SELECT DISTINCT desktop, step FROM e), f AS (SELECT DISTINCT desktop, step, view FROM e WHERE view IS NOT NULL)
SELECT s.desktop, v.view, s.step, f.view IS NOT NULL AS there FROM s CROSS JOIN (VALUES ('scan'), ('oak')) v(view) LEFT JOIN f ON f.desktop = s.desktop AND f.step = s.step AND f.view = v.view""")
def listed_frame_index(spark, sf_dir):
    """Capture folders, written machine by machine and listed again, against the steps that the log expects."""
    view = F.when(F.col("event_type") == "click", "scan").when(F.col("event_type") == "purchase", "oak")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("desktop"), (F.col("event_id") % 5).alias("step"), view.alias("view"), F.col("event_id").cast("string").alias("text"))
    root = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    path = F.concat(F.lit("desktop="), "desktop", F.lit("/view="), "view", F.lit("/step="), "step", F.lit("/events.txt"))
    text = F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")  # the events of one folder
    write_files(e.groupBy(path.alias("path")).agg(text).where("path is not null"), root)
    listed = read_listing(spark, root, "desktop=([0-9]+)")
    named = listed.where("error is null").select(F.col("machine").alias("desktop"), F.regexp_extract("dir", "view=([a-z]+)", 1).alias("view"), R.folder_step(F.col("dir")).alias("step"), F.concat_ws("/", "dir", "file").alias("path"))
    index = R.frame_index(e.select("desktop", "step").distinct(), {v: named.where(F.col("view") == v) for v, in VIEWS}, spark.createDataFrame(VIEWS, "view string"))
    return index.select("desktop", "view", "step", (F.col("shots") > 0).alias("there"))


def _sheets(spark, sf_dir):
    """A step log of every user, written as CSV and read again: a title, a wide table, the machine's data and a note."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "event_id", "event_type")
    far = F.concat(F.lit("," * 17), (F.col("event_id") % 3).cast("string"))  # the cell in the 20th column
    name = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type"))
    row = F.concat(F.col("event_id").cast("string"), F.lit(","), name, F.lit(',"see '), F.col("event_id").cast("string"), F.lit(', ""twice"""'), far)
    steps = e.select("machine", (F.col("event_id") + 2).alias("n"), row.alias("value"))
    head = [(0, "a title,,"), (1, "Sequence Number,Sequence Name,Notes" + "," * 17 + "Far")]
    tail = [("Desktop ID", F.col("machine").cast("string")), ("Desktop Brand", F.concat(F.lit("B"), (F.col("machine") % 4).cast("string"))), ("Collection Date", F.lit("2025-06-03 00:00:00")), ("", F.concat(F.lit("note "), "machine"))]
    fixed = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(text).alias("value")) for n, text in head], *[F.struct(F.lit(2**40 + n).alias("n"), F.concat(F.lit(f"{label},"), v).alias("value")) for n, (label, v) in enumerate(tail)])
    rest = e.select("machine").distinct().select("machine", F.explode(fixed).alias("f")).select("machine", "f.*")
    root = f"{shared_folder(spark)}/sheets-{uuid.uuid4().hex}"
    lines = F.array_sort(F.collect_list(F.struct("n", "value")))  # one machine's sheet
    text = F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("text")
    path = F.concat(F.lit("part="), F.pmod("machine", F.lit(64)), F.lit("/machine="), "machine", F.lit(".csv"))
    write_files(steps.union(rest).groupBy("machine").agg(text).select(path.alias("path"), "text").where("path is not null"), root)
    return logs.read_cells(spark, root)


@query("step_log_rows", """SELECT user_id AS machine, event_id::VARCHAR AS number, event_type AS name, 'see ' || event_id || ', "twice"' AS notes, (event_id % 3)::VARCHAR AS far
FROM events WHERE event_id % 7 <> 0""")
def step_log_rows(spark, sf_dir):
    """The named steps of every log, cells by their header."""
    rows = logs.step_rows(_sheets(spark, sf_dir))
    cell = {"number": "Sequence Number", "name": "Sequence Name", "notes": "Notes", "far": "Far"}
    return rows.select(_machine(), *[F.col("row")[header].alias(out) for out, header in cell.items()])


@query("step_log_machines", """SELECT DISTINCT user_id AS machine, user_id::VARCHAR AS id, 'B' || (user_id % 4) AS brand, DATE '2025-06-03' AS collected, 'note ' || user_id AS notes FROM events""")
def step_log_machines(spark, sf_dir):
    """The data of every log's machine, with its notes."""
    rows = logs.meta_rows(_sheets(spark, sf_dir))
    return rows.select(_machine(), F.col("meta")["Desktop ID"].alias("id"), F.col("meta")["Desktop Brand"].alias("brand"), logs.collection_date(F.col("meta")).alias("collected"), "notes")


def _machine():
    return F.regexp_extract("file", "machine=([0-9]+)", 1).cast("long").alias("machine")


def _parsed(spark, sf_dir):
    """Log rows of the users: what was done to which part."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    cls = F.when(F.col("k") % 3 == 0, "screw").when(F.col("k") % 3 == 1, "connector").otherwise("ram_module")
    none = F.lit(None).cast("string")
    return e.select(F.col("user_id").alias("machine"), F.col("event_id").alias("step"), F.concat("event_type", F.lit(" "), "k").alias("raw"), cls.alias("cls"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("number"), none.alias("verb"), none.alias("hint"), (F.col("value") < 1).alias("attempt"), F.lit(False).alias("multi"), F.lit("PH2").alias("tool"))


@query("published_import", """
SELECT user_id AS machine, CASE WHEN user_id % 5 = 0 THEN 'held' WHEN user_id % 3 = 0 THEN 'published' ELSE 'unchanged' END AS outcome,
  count(*) FILTER (user_id % 5 = 0 OR user_id % 3 <> 0 OR event_id % 2 = 0) AS steps, count(*) FILTER (event_id <> 1 AND (user_id % 5 = 0 OR user_id % 3 <> 0 OR event_id % 2 = 0)) AS actions, 0::BIGINT AS again
FROM events GROUP BY user_id""")
def published_import(spark, sf_dir):
    """A log import written as tables, then imported again with changed logs of a third of the machines while a fifth are
    held back, then once more as it is: what each machine has at the end, and how many the last run wrote."""
    folder = f"{shared_folder(spark)}/import-{uuid.uuid4().hex}"
    parsed = _parsed(spark, sf_dir)
    first = import_logs(parsed)
    publish.publish(first, folder)
    held = parsed.where("machine % 5 = 0").select("machine").distinct()
    changed = import_logs(parsed.where("machine % 3 <> 0 or step % 2 = 0"))
    outcome = publish.publish(changed, folder, held)
    again = publish.publish(changed, folder, held).where("outcome = 'published'").agg(F.count("*").alias("again"))
    count = lambda name: publish.published(spark, folder, name, first[name].schema).groupBy("machine").agg(F.count("*").alias(name))
    return outcome.join(count("steps"), "machine").join(count("actions"), "machine").join(F.broadcast(again))  # one row


NUMBERED_SQL = """
r AS (SELECT user_id AS machine, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'screw' WHEN 1 THEN 'connector' ELSE 'cover' END AS cls, CASE WHEN event_id % 3 = 0 THEN 'board' ELSE '' END AS disc, event_id % 4 AS number, event_type AS verb FROM events),
j AS (SELECT *, row_number() OVER (PARTITION BY machine, cls, disc, number, verb ORDER BY seq) AS j FROM r),
m AS (SELECT *, j > coalesce(max(j) OVER (PARTITION BY machine, cls, disc, number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS made FROM j),
o AS (SELECT *, sum(made::INTEGER) OVER (PARTITION BY machine, cls, disc ORDER BY seq) AS nth FROM m)"""


@query("ledger_numbered", f"""
WITH {NUMBERED_SQL}
SELECT a.machine, a.seq, a.cls || CASE WHEN a.disc <> '' THEN '.' || a.disc ELSE '' END || '.' || CASE WHEN b.nth < 10 THEN '0' ELSE '' END || b.nth AS key, a.made
FROM o a JOIN o b ON a.machine = b.machine AND a.cls = b.cls AND a.disc = b.disc AND a.number = b.number AND a.j = b.j AND b.made""")
def ledger_numbered(spark, sf_dir):
    """Numbered rows of the users' logs: which instance each operates."""
    return entities.ledger(_rows(spark, sf_dir, F.col("event_id") % 4)).select("machine", "seq", "key", "made")


def _rows(spark, sf_dir, number):
    turn, none = F.col("event_id") % 3, F.lit(None).cast("string")
    cls = F.when(turn == 0, "screw").when(turn == 1, "connector").otherwise("cover")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), F.lit(1).alias("step"), F.col("event_id").alias("seq"), cls.alias("cls"), F.when(turn == 0, "board").alias("disc"), number.alias("number"), none.alias("owner"), none.alias("qualifier"), none.alias("of"), F.col("event_type").alias("verb"), (F.col("value") >= 2).alias("ok"), F.lit(False).alias("gone"))


@query("ledger_keys")
def ledger_keys(spark, sf_dir):
    """All rows, two in five unnumbered, with removals that find the open part again (tested against a search)."""
    verb = F.when(F.col("verb") == "purchase", "remove").when(F.col("verb") == "click", "open").otherwise(F.col("verb"))
    rows = _rows(spark, sf_dir, F.when(F.col("event_id") % 5 < 3, F.col("event_id") % 4)).withColumn("verb", verb)
    return entities.ledger(rows).select("machine", "seq", "key", "made", "rivals")
