"""Queries of dataset exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import tasks
from stepfold.plans.registry import query
from stepfold.plans.tables import table

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("annotations", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS id, l_orderkey AS image_id,
  list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type)::BIGINT AS category_id, l_quantity * l_tax AS area
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25""")
def annotations(spark, sf_dir):
    """Annotation rows with dense ids in (image, line) order and category ids in vocabulary order."""
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    category = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("p_type"))
    return tasks.annotation_ids(rows, order).select("id", F.col("l_orderkey").alias("image_id"), category.alias("category_id"), (F.col("l_quantity") * F.col("l_tax")).alias("area"))


@query("verified_frames", """
SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS every FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' OR coalesce(every, false)""")
def verified_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("flag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", "verified").otherwise("auto").alias("status"))
    return tasks.verified(frames, rows, ["o_orderkey"], "flag", "status").select("o_orderkey")


def _generators(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entity"), F.col("turn").alias("step"), "role")
    pool = spark.createDataFrame([("user",), ("assistant",), ("system",), ("tool",)], "role string")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").cast("long").alias("step"), "l_returnflag", "l_linestatus").distinct()
    return {
        "V1": lambda: tasks.visible_sets(lines, "entity", "step", "l_returnflag"),
        "V2": lambda: tasks.state_questions(turns, "entity", "step", "role", ["user", "assistant"]),
        "V3": lambda: tasks.step_actions(turns, "entity", "step", "role"),
        "V6": lambda: tasks.options(turns, "entity", "step", "role", pool, 2),
        "V12": lambda: tasks.balanced_changes(turns, "entity", "step", "role"),
        "V15": lambda: tasks.cross_view(lines, "entity", "step", "l_returnflag", "l_linestatus"),
    }


ID_SQL = "'q_' || substr(sha256({t} || '|' || {e} || '|' || {s}), 1, 16)"


@query("question_records", f"""
WITH t AS (SELECT conv_id AS entity, turn AS step, role FROM conversations), l AS (SELECT DISTINCT l_orderkey AS entity, l_linenumber::BIGINT AS step, l_returnflag AS f, l_linestatus AS s FROM lineitem),
r AS (
  SELECT 'V1' AS task, entity, step, 'Which are there?' AS question, string_agg(DISTINCT f, ',' ORDER BY f) AS answer FROM l GROUP BY entity, step
  UNION ALL SELECT 'V2', entity, step, 'Which state?', role FROM t WHERE role IN ('user', 'assistant')
  UNION ALL SELECT 'V3', a.entity, a.step, 'What follows ' || b.role || '?', a.role FROM t a JOIN t b ON a.entity = b.entity AND b.step = a.step - 1
  UNION ALL SELECT 'V15', a.entity, a.step, 'Same in ' || a.f || ' and ' || b.f, CASE WHEN a.s = b.s THEN 'yes' ELSE 'no' END FROM l a JOIN l b ON a.entity = b.entity AND a.step = b.step AND a.f < b.f)
SELECT {ID_SQL.format(t="task", e="entity", s="step")} AS id, * FROM r""")
def question_records(spark, sf_dir):
    g = _generators(spark, sf_dir)
    return tasks.export({k: g[k] for k in ("V1", "V2", "V3", "V15")})


@query("question_samples")
def question_samples(spark, sf_dir):
    """The generators whose choices follow the hash order (DuckDB has no crc32; their balance is tested)."""
    g = _generators(spark, sf_dir)
    return tasks.export({k: g[k] for k in ("V6", "V12")})
