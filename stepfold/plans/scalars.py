"""Queries of scalar functions: parsing, keys, digests, maps, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import text as T
from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, table

TYPOS = {"widgit": "widget", r"\bgear\b": "cog"}


@query("normalize_name", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' -' || p_brand)), '\bgear\b', 'cog', 'g'), '\s*[-–—]\s*', ' - ', 'g'), '\s+', ' ', 'g')) AS name FROM part""")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize(F.concat("p_name", F.lit(" -"), "p_brand"), TYPOS).alias("name"))


@query("split_qualifier", r"""
WITH r AS (SELECT p_partkey, p_name || ' (' || p_type || ') [x' || p_size || '] tail (' || p_brand AS s FROM part)
SELECT p_partkey, p_name || ' tail' AS bare, p_type || ' | x' || p_size || ' | ' || p_brand AS quals FROM part""")
def split_qualifier(spark, sf_dir):
    s = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") [x"), F.col("p_size").cast("string"), F.lit("] tail ("), "p_brand")
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    return rows.select("p_partkey", T.without_qualifiers(F.col("s")).alias("bare"), F.array_join(T.qualifiers(F.col("s")), " | ").alias("quals"))


@query("read_numbers", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ',' || (p_size + 1) WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size::VARCHAR ELSE '' END AS numbers FROM part""")
def read_numbers(spark, sf_dir):
    n = F.col("p_size").cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("screws "), n, F.lit(" & "), (F.col("p_size") + 1).cast("string"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("screw "), n)).when(F.col("p_partkey") % 4 == 2, F.concat(n, F.lit(" case connector"))).otherwise("cover")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.numbers(name), ",").alias("numbers"))


RULES = [(1, "^red", "paint"), (2, "widget|bolt", "fastener"), (3, "ring$", "seal"), (4, "economy", "cheap")]


@query("first_rule", """
SELECT p_partkey, coalesce(CASE WHEN regexp_matches(p_name, '^red') THEN 'paint' WHEN regexp_matches(p_name, 'widget|bolt') THEN 'fastener' WHEN regexp_matches(p_name, 'ring$') THEN 'seal' WHEN regexp_matches(p_name, 'economy') THEN 'cheap' END,
  CASE WHEN lower(p_type) LIKE '%economy%' AND FALSE THEN '' WHEN regexp_matches(p_name || ' nest: ' || lower(p_type), 'economy') THEN 'cheap' END, 'none') AS rule FROM part""")
def first_rule(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "prio int, pattern string, label string")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" nest: "), F.lower("p_type")).alias("nested"))
    return T.first_rule(rows, ["p_partkey"], ["p_name", "nested"], rules).select("p_partkey", F.coalesce("rule", F.lit("none")).alias("rule"))


@query("resolve_verb", """
SELECT p_partkey, CASE WHEN p_size > 45 THEN 'reorient' WHEN p_name LIKE 'small%' THEN CASE WHEN p_type = 'ECONOMY' THEN 'unscrew' ELSE 'remove' END WHEN p_name LIKE 'red%' THEN 'open' ELSE '' END AS verb FROM part""")
def resolve_verb(spark, sf_dir):
    pinned = F.when(F.col("p_size") > 45, F.lit("reorient"))
    verb = T.resolve_verb(F.col("p_name"), F.col("p_type"), pinned, {"^small": "remove", "^red": "open"}, {("ECONOMY", "remove"): "unscrew"})
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(verb, F.lit("")).alias("verb"))


@query("instance_keys", """
SELECT p_partkey, p_type || '.' || p_brand || '.' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS key FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS n FROM part)""")
def instance_keys(spark, sf_dir):
    from stepfold.operators.windows import ordinals

    rows = ordinals(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), ["p_type", "p_brand"], ["p_partkey"], "n")
    return rows.select("p_partkey", T.instance_key(F.col("p_type"), F.col("p_brand"), ordinal=F.col("n")).alias("key"))


@query("edge_digest", """
SELECT l_suppkey, substr(sha256(string_agg(x, chr(10) ORDER BY x)), 1, 16) AS digest FROM (SELECT l_suppkey, l_partkey || '|' || l_returnflag || '|' || l_linestatus AS x FROM lineitem) GROUP BY l_suppkey""")
def edge_digest(spark, sf_dir):
    return T.edge_digest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_partkey", "l_returnflag", "l_linestatus"])


@query("opaque_ids", "SELECT doc_id, 'img_' || substr(sha256('salt|' || doc_id || '|' || source || '|' || lang), 1, 16) AS id FROM documents")
def opaque_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.opaque_id("img_", "salt", F.col("doc_id"), F.col("source"), F.col("lang")).alias("id"))


@query("image_ids", "SELECT conv_id, turn, conv_id * 100000 + turn * 10 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS image_id FROM conversations")
def image_ids(spark, sf_dir):
    view = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.image_id(F.col("conv_id"), F.col("turn"), view).alias("image_id"))


@query("merge_notes", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'keep me' || chr(10) ELSE '' END || 'LS: v=' || lang || '; w' AS notes FROM documents""")
def merge_notes(spark, sf_dir):
    old = F.when(F.col("doc_id") % 3 == 0, F.lit("keep me\nLS: old")).otherwise(F.lit("LS: old"))
    return table(spark, sf_dir, "documents").select("doc_id", T.merge_notes(old, F.concat(F.lit("v="), "lang", F.lit("\n w")), "LS:").alias("notes"))


@query("note_prefix", "SELECT doc_id FROM documents WHERE starts_with(text, 'The') OR contains(text, chr(10) || 'The')")
def note_prefix(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.has_note(F.col("text"), "The")).select("doc_id")


@query("capture_times", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) END AS captured FROM events""")
def capture_times(spark, sf_dir):
    token = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd_HHmmss_SSS")).otherwise(F.lit("20241_x"))
    return table(spark, sf_dir, "events").select("event_id", T.capture_time(token).alias("captured"))


@query("respell_paths", r"""
SELECT page_id, CASE WHEN starts_with(lower(url), 'https://') THEN 'store/' || substr(url, 8) ELSE url END AS path FROM pages""")
def respell_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.respell(F.col("url"), "HTTPS:", "store").alias("path"))


@query("parse_image_name", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1) AS BIGINT), -1) AS number FROM pages""")
def parse_image_name(spark, sf_dir):
    number = F.regexp_extract("url", r"/([0-9]+)(?:[?#].*)?$", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.coalesce(F.when(number != "", number.cast("long")), F.lit(-1).cast("long")).alias("number"))


@query("wording", "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE lower(p_type) END || ' ' || replace(p_name, 'small', 'SMALL') AS label FROM part")
def wording(spark, sf_dir):
    key = F.concat(F.lower("p_type"), F.lit("_"), F.regexp_replace("p_name", " ", "_"))
    return table(spark, sf_dir, "part").select("p_partkey", T.wording(key, ["promo", "small"]).alias("label"))


@query("merge_attrs", """
SELECT event_id, event_type || ',' || coalesce(json_extract_string(props, '$.k'), '') AS merged, CASE WHEN event_type <> 'view' THEN 'a' ELSE '' END AS conflicts FROM events""")
def merge_attrs(spark, sf_dir):
    stored = F.create_map(F.lit("a"), F.col("event_type"))
    new = F.create_map(F.lit("a"), F.lit("view"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("hash"), F.lit("x"))
    merged = T.merge_attrs(stored, new, ["hash"])
    listed = F.concat_ws(",", F.element_at(merged, "a"), F.element_at(merged, "k"), F.try_element_at(merged, F.lit("hash")))
    return table(spark, sf_dir, "events").select("event_id", listed.alias("merged"), F.array_join(T.attr_conflicts(stored, new), ",").alias("conflicts"))


@query("json_rows", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS again FROM events""")
def json_rows(spark, sf_dir):
    parsed = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("visibility_ladder", """
SELECT p_partkey, CASE WHEN p_size = 7 THEN 'out_of_view' WHEN o >= 0.95 THEN 'occluded_full' WHEN p_size < 6 THEN 'too_small' WHEN p_size < 12 THEN 'visible_tiny' WHEN o >= 0.3 THEN 'occluded_partial' ELSE 'visible' END AS visibility
FROM (SELECT *, CASE WHEN p_partkey % 100 > 0 THEN least(1, greatest(0, 1 - (p_partkey % 77) / (p_partkey % 100))) ELSE 0 END AS o FROM part)""")
def visibility_ladder(spark, sf_dir):
    o = T.occlusion_ratio(F.col("p_partkey") % 77, F.col("p_partkey") % 100)
    side = F.when(F.col("p_size") != 7, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", T.visibility(side, o).alias("visibility"))


@query("tools_vocabulary", r"""
SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt') THEN 'PH' || (1 + p_size % 3) WHEN regexp_matches(p_name, 'ring|gear') THEN 'T' || CASE WHEN p_size > 25 THEN '20' ELSE '15' END WHEN p_type = 'SMALL' THEN 'hand' ELSE 'none' END AS tool FROM part""")
def tools_vocabulary(spark, sf_dir):
    n = F.col("p_size")
    tool = F.when(F.col("p_name").rlike("bolt"), F.concat(F.lit("PH"), (1 + n % 3).cast("string"))).when(F.col("p_name").rlike("ring|gear"), F.concat(F.lit("T"), F.when(n > 25, "20").otherwise("15"))).when(F.col("p_type") == "SMALL", "hand").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", tool.alias("tool"))


@query("stable_order")
def stable_order(spark, sf_dir):
    """The hash permutation of a user's events and the template that an event picks (DuckDB has no crc32)."""
    from stepfold.operators.windows import hash_rank

    key = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", hash_rank([ENTITY], key, "seed").alias("rank"), F.pmod(F.crc32(key), F.lit(7)).alias("template"))


@query("selected_ids", "SELECT doc_id, lang FROM documents WHERE doc_id BETWEEN 1 AND 3 OR doc_id = 13 OR doc_id BETWEEN 40 AND 42")
def selected_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("doc_id").isin(T.desktops("1-3, 13,40-42"))).select("doc_id", "lang")
