"""Several tables published together, machine by machine, behind one manifest.

Machines are dealt to BUCKETS buckets, whose rows lie in one of two places in every table. A run writes the buckets of
the machines that changed to their other place, with what the bucket's other machines have, stamped with the run, and
then the manifest: one row a machine that says where and of which run its rows are. Readers follow the manifest, so all
tables of a machine change at once and a run that fails is not seen. Folders do not grow in number with the machines.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.session import cut

BUCKETS = 64  #: not to be changed while tables are there
MANIFEST = "machine long, place int, run string, digest string, serial long, slot int"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _bucket() -> Column:
    return F.pmod("machine", F.lit(BUCKETS)).cast("int").alias("_bucket")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(machine, place, run, digest, serial) of the newest finished run: one row a machine."""
    rows = _read(spark, f"{folder}/manifest", MANIFEST)
    return rows.where(F.col("serial") == (rows.agg(F.max("serial")).first()[0] or 0)).drop("slot")


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(machine, digest): equal for equal rows of all tables, in whatever order."""
    parts = []
    for name, df in sorted(tables.items()):
        cols = sorted(c for c in df.columns if c != "machine")
        row = F.xxhash64(F.lit(name), *[x for c in cols for x in (F.col(c).isNull(), F.coalesce(F.to_json(F.struct(c)), F.lit("")))])
        parts.append(df.select(F.col("machine").cast("long").alias("machine"), row.alias("h")))
    every = reduce(DataFrame.union, parts)
    total = [F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "h").cast("decimal(38,0)")), F.count("*")]
    return every.groupBy("machine").agg(F.sha1(F.concat_ws("|", *[t.cast("string") for t in total])).alias("digest"))


def publish(tables: dict[str, DataFrame], folder: str, held: DataFrame | None = None) -> DataFrame:
    """Writes the tables (each with a `machine`) of all machines that changed and gives (machine, outcome).

    outcome: `published`, `unchanged` where the rows are those already there, so that a rerun writes nothing, or `held`
    for the machines of `held`, which are not touched. Machines that the tables do not have keep what they have; so do
    those with a null number, which are left out. One writer at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    old = manifest(spark, folder)
    run = uuid.uuid4().hex
    # cut: what is compared is what is written
    known = {name: cut(df.where("machine is not null").withColumn("machine", F.col("machine").cast("long"))) for name, df in tables.items()}
    had = old.select("machine", F.col("digest").alias("_was"), "place")
    marks = held.select(F.col("machine").cast("long").alias("machine")).distinct().withColumn("_held", F.lit(True)) if held is not None else None
    both = digests(known).join(had, "machine", "left")
    both = both.withColumn("_held", F.lit(None).cast("boolean")) if marks is None else both.join(marks, "machine", "left")
    outcome = F.when(F.col("_held"), "held").when(F.col("digest").eqNullSafe(F.col("_was")), "unchanged").otherwise("published")
    # cut: what is written is decided once, whatever is computed again
    plan = cut(both.select("machine", outcome.alias("outcome"), "digest"))
    new = plan.where("outcome = 'published'").select("machine", "digest")
    if new.take(1):
        places = old.groupBy(_bucket()).agg(F.max("place").alias("_had"))  # a bucket's machines share one place
        touched = new.select(_bucket()).distinct().join(places, "_bucket", "left")
        to = F.broadcast(cut(touched.select("_bucket", (1 - F.coalesce("_had", F.lit(1))).alias("_place"))))  # at most BUCKETS rows
        for name, df in known.items():
            fresh = df.join(new.select("machine"), "machine")
            stay = published(spark, folder, name, df.schema).join(new.select("machine"), "machine", "left_anti")
            rows = fresh.unionByName(stay).withColumn("_run", F.lit(run)).withColumn("_bucket", _bucket()).join(to, "_bucket")
            _overwrite(rows.repartition("_bucket"), f"{folder}/{name}", "_bucket", "_place")
        serial = (old.agg(F.max("serial")).first()[0] or 0) + 1
        kept = old.select("machine", "digest", "place", F.col("run").alias("_old")).join(new.select("machine"), "machine", "left_anti")
        every = kept.unionByName(new, allowMissingColumns=True).withColumn("_bucket", _bucket()).join(to, "_bucket", "left")
        now = every.select("machine", F.coalesce("_place", "place").alias("place"), F.when(F.col("_place").isNull(), F.col("_old")).otherwise(run).alias("run"), "digest", F.lit(serial).cast("long").alias("serial"))
        _overwrite(now.withColumn("slot", F.lit(serial % 2)).coalesce(1), f"{folder}/manifest", "slot")
    return plan.select("machine", "outcome")


def published(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as the newest manifest has it; `schema` is that of the table given to `publish`."""
    fields = [f for f in schema.fields if f.name != "machine"]
    full = T.StructType([*fields, T.StructField("_run", T.StringType()), T.StructField("machine", T.LongType()), T.StructField("_bucket", T.IntegerType()), T.StructField("_place", T.IntegerType())])
    now = manifest(spark, folder).select("machine", F.col("place").alias("_place"), F.col("run").alias("_run"))
    return _read(spark, f"{folder}/{name}", full).join(now, ["machine", "_place", "_run"]).select("machine", *[f.name for f in fields])
