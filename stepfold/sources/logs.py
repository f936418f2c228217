"""Step-log CSV files, capture-folder listings, label-tool exports, versioned snapshots."""

from __future__ import annotations

import csv
import io
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The header cell that begins a step table and the labels of a machine table.
MARK = "Sequence Number"
META_LABELS = ["Desktop ID", "Desktop Brand", "Desktop Size", "Total Disassembly Steps", "Total Disassembly Time", "Collection Date"]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _rows_of_cells(texts: pd.Series) -> pd.Series:
    """The records of each text that have a cell with text, padded to the widest of them."""

    def rows(text: str) -> list[list[str]]:
        csv.field_size_limit(max(len(text), 1))
        read = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text.replace("\ufeff", ""), newline=""))]
        kept = [row for row in read if row]
        wide = max([2, *map(len, kept)])
        return [row + [""] * (wide - len(row)) for row in kept]

    return texts.map(rows)


def read_cells(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """(file, line, cells) of CSV files without an assumed header, however wide: lines that are not blank are counted in
    their file and padded to its widest line and to `columns`. A log is one machine's sheet, so a file is one row's text."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), _rows_of_cells("value").alias("rows"))
    each = text.select("file", F.posexplode("rows").alias("at", "cells"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(columns) - F.size("cells"), F.lit(0))))
    return each.select("file", padded.alias("cells"), (F.col("at") + 1).cast("long").alias("line"))


def step_rows(cells: DataFrame) -> DataFrame:
    """(file, line, row): map of header to cell for rows under the located header that have a sequence name."""
    of = Window.partitionBy("file").orderBy("line")
    head = F.first(F.when(F.array_contains("cells", MARK), F.struct("line", "cells")), ignorenulls=True).over(of)
    body = cells.withColumn("head", head).where(F.col("line") > F.col("head.line"))
    pairs = F.filter(F.arrays_zip(F.col("head.cells").alias("k"), F.col("cells").alias("v")), lambda p: p["k"] != "")
    row = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    stop = F.max(F.array_contains(F.array(*[F.lit(x) for x in META_LABELS]), F.col("cells")[0]).cast("int")).over(of)
    return body.withColumn("row", row).withColumn("_stop", stop).where("_stop = 0").where(F.coalesce(F.try_element_at("row", F.lit("Sequence Name")), F.lit("")) != "").select("file", "line", "row")


def meta_rows(cells: DataFrame) -> DataFrame:
    """(file, meta, notes): the label and value table; a blank label with a value is a note."""
    labels = F.array(*[F.lit(x) for x in META_LABELS])
    begun = F.max(F.array_contains(labels, F.col("cells")[0])).over(Window.partitionBy("file").orderBy("line"))
    rows = cells.withColumn("_begun", begun).where("_begun")
    entry = F.when(F.array_contains(labels, F.col("cells")[0]), F.struct(F.col("cells")[0], F.col("cells")[1]))
    note = F.when((F.col("cells")[0] == "") & (F.col("cells")[1] != ""), F.struct("line", F.col("cells")[1].alias("note")))
    g = rows.groupBy("file").agg(F.collect_list(entry).alias("e"), F.sort_array(F.collect_list(note)).alias("n"))
    return g.select("file", F.map_from_entries(F.filter("e", lambda x: x.isNotNull())).alias("meta"), F.array_join(F.col("n.note"), "\n").alias("notes"))


def collection_date(meta: Column) -> Column:
    return F.try_to_date(F.regexp_extract(F.element_at(meta, "Collection Date"), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))


def log_files(listing: DataFrame) -> DataFrame:
    """One path for each desktop number of `desktop_NN.csv` names, sidecars left out, the last path winning."""
    n = F.regexp_extract("path", r"(?i)desktop[_ ]?([0-9]+)[^/]*\.csv$", 1)
    rows = listing.withColumn("desktop", n).where((F.col("desktop") != "") & ~F.col("path").rlike(r"(?i)_meta\.csv$"))
    return rows.groupBy(F.col("desktop").cast("int").alias("desktop")).agg(F.max("path").alias("path"))


def capture_groups(listing: DataFrame) -> DataFrame:
    """Files (dir, file) grouped by capture token into (dir, token, ts, files by role)."""
    token, role = F.regexp_extract("file", r"([0-9]{8}_[0-9]{6}_[0-9]{3})", 1), F.regexp_extract("file", r"^([A-Za-z]+)", 1)
    rows = listing.select("dir", token.alias("token"), F.lower(role).alias("role"), "file").where("token <> '' and role <> ''")
    one = rows.groupBy("dir", "token", "role").agg(F.min("file").alias("file"))
    g = one.groupBy("dir", "token").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "file")))).alias("files"))
    return g.withColumn("ts", F.try_to_timestamp("token", F.lit("yyyyMMdd_HHmmss_SSS")).cast("timestamp_ntz"))


RESULT = "array<struct<id: string, type: string, from_id: string, to_id: string, labels: array<string>, value: struct<x: double, y: double, width: double, height: double, rotation: double, radiusX: double, radiusY: double, points: array<array<double>>, labels: array<string>, polygonlabels: array<string>, rectanglelabels: array<string>>>>"
TASK = "struct<data: struct<image: string>, annotations: array<struct<result: string>>>"
EXPORT = f"projects array<struct<title: string, tasks: array<{TASK}>>>"


def label_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result of a label-tool export: (image, id, type, label, x, y, from_id, to_id, value).

    `Metadata` projects are skipped and the first label of a result wins; the order within an image is x, y, id.
    """
    doc = spark.read.schema(EXPORT).json(path, multiLine=True)
    projects = doc.select(F.explode("projects").alias("p")).where("p.title <> 'Metadata'")
    tasks = projects.select(F.explode("p.tasks").alias("t"))
    results = tasks.select(F.col("t.data.image").alias("image"), F.explode("t.annotations").alias("a")).select("image", F.explode(F.from_json("a.result", RESULT)).alias("r"))
    label = F.coalesce(*[F.get(F.col(c), 0) for c in ("r.value.labels", "r.value.polygonlabels", "r.value.rectanglelabels", "r.labels")])
    return results.select("image", F.col("r.id").alias("id"), F.col("r.type").alias("type"), label.alias("label"), F.col("r.value.x").alias("x"), F.col("r.value.y").alias("y"), F.col("r.from_id").alias("from_id"), F.col("r.to_id").alias("to_id"), F.col("r.value").alias("value"))


def relations(results: DataFrame) -> DataFrame:
    """(image, blocker, target) labels of the relation results, both ends resolved in their image."""
    ends = results.where("label is not null").select("image", "id", "label")
    r = results.where("type = 'relation'").select("image", "from_id", "to_id")
    r = r.join(ends.select("image", F.col("id").alias("from_id"), F.col("label").alias("blocker")), ["image", "from_id"])
    return r.join(ends.select("image", F.col("id").alias("to_id"), F.col("label").alias("target")), ["image", "to_id"]).select("image", "blocker", "target")


def write_snapshot(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """A new version beside the others; readers see it whole once its success mark is there."""
    to = f"{folder}/v-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(to)
    return to


def retained(versions: DataFrame, keep: int) -> DataFrame:
    """Versions (path, ts) to keep: the newest `keep`, and the newest of each day."""
    newest = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ts").desc(), "path"))  # a listing: one row a version
    of_day = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy(F.col("ts").desc(), "path"))
    return versions.withColumn("_a", newest).withColumn("_b", of_day).where((F.col("_a") <= keep) | (F.col("_b") == 1)).drop("_a", "_b")
