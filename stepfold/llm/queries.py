"""One query for each operator, over its whole table; ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.llm import chat, decontam, lines, lm, merkle, mixing, pii, quality, search, simhash, substrings, toxicity, trie
from stepfold.llm.common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digested(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from their strings and loss spans."""

    def run(batches):
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = b.to_pylist()
            turns = [chat.read_turns(r["formatted"]) for r in rows]
            loss = ["".join(chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]) for r in rows]
            out = {
                "conv_id": b.column(0),
                "n_turns": [len(t) for t in turns],
                "turns_sha256": [sha("".join(f"{role}\n{text}\n" for role, text in t)) for t in turns],
                "loss_chars": [len(x) for x in loss],
                "loss_sha256": [sha(x) for x in loss],
                "formatted_chars": [len(r["formatted"]) for r in rows],
            }
            yield pa.RecordBatch.from_pydict(out)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digested(chat.format_chats(turns.unionByName(probe)))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op2_lm_score_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    both = F.concat("base", "added")
    place = lambda s: F.struct(s["start"], F.array_position(F.array(*[F.lit(k) for k in pii.KINDS]), s["kind"]).alias("rank"), s["kind"], s["end"])
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.array_sort(F.transform(both, place))).alias("spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.placed_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    found = trie.members(*trie.respliced(turns, convs, conv - conv % 5, F.crc32(conv.cast("string")) % 9))
    ended = trie.ends_digest(found)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return trie.nodes(found).join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = lambda text: merkle.leaf_of(*[F.col(c) for c in columns[:-1]], text)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(F.translate("text", UPPER, UPPER.lower())))
    leaves = docs.select("doc_id", "lang", leaf(F.col("text")).alias("leaf"), changed.alias("changed"))
    proven = merkle.manifest(cut(leaves), "lang", ["doc_id"])
    folded = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_score": op2_lm_score,
    "op2_lm_score_trigrams": op2_lm_score_trigrams,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_search": op10_search,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality": op12_quality,
    "op13_manifest": op13_manifest,
}

def manifest_sql(leaf_levels: int = 8, group_levels: int = 4) -> str:
    """A common table for each level: digests `d` by group `g` and place `i`, then siblings by run, then the folds."""

    def levels(name: str, n: int, deal: str) -> str:
        """Nodes of a level, with what stands left and right of each in its run; a group that is down to one node stays."""
        made = ""
        for k in range(n):
            made += f"""
{name}{k}s AS (SELECT *, count(*) OVER ({deal}) AS n, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k}s GROUP BY g, i // 8),"""
        return made

    deal = "PARTITION BY g"
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    joins = "".join(f" JOIN a{k}s ON a{k}s.g = x.g AND a{k}s.i = x.i // {8**k}" for k in range(leaf_levels)) + "".join(f" JOIN b{k}s ON b{k}s.i = x.t // {8**k}" for k in range(group_levels))
    steps = [f"{t}{k}s" for t, n in (("a", leaf_levels), ("b", group_levels)) for k in range(n)]
    folds, last = "", "x0"
    for k, s in enumerate(steps):
        folds += f"f{k} AS (SELECT *, CASE WHEN n{k} = 1 THEN {last} ELSE sha256(l{k} || {last} || r{k}) END AS x{k + 1} FROM {f'f{k - 1}' if k else 'p'}),\n"
        last = f"x{k + 1}"
    paths = ", ".join(f"{s}.n AS n{k}, {s}.l AS l{k}, {s}.r AS r{k}" for k, s in enumerate(steps))
    return f"""
WITH o AS (SELECT *, sha256({head} || {field("text")}) AS leaf, CASE WHEN c % 3 = 0 THEN sha256({head} || {field(low)}) END AS changed
  FROM (SELECT *, {CRC_SQL.format("doc_id")} AS c FROM documents)),
x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM o),
a0 AS (SELECT g, i, leaf AS d FROM x),{levels("a", leaf_levels, deal)}
b0 AS (SELECT 0 AS g, g AS i, d FROM a{leaf_levels}),{levels("b", group_levels, deal)}
p AS (SELECT doc_id, leaf, a{leaf_levels}.d AS subroot, b{group_levels}.d AS root, coalesce(changed, leaf) AS x0, {paths} FROM x{joins} JOIN a{leaf_levels} ON a{leaf_levels}.g = x.g CROSS JOIN b{group_levels}),
{folds}z AS (SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"l{k} || r{k}" for k in range(len(steps)))}) AS proof_sha256, {last} AS folded_root FROM f{len(steps) - 1})
SELECT *, folded_root = root AS verified FROM z
"""


#: CRC-32 of a number's digits, byte by byte and bit by bit; DuckDB has no function for it.
CRC_SQL = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(CAST({0} AS VARCHAR)) + 1), lambda i: ascii(CAST({0} AS VARCHAR)[i])::UBIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda z: z::UBIGINT)), lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1))))"
CRC_SQL = f"xor({CRC_SQL}, 4294967295::UBIGINT)"

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} + 2 * length(role || text) - length(regexp_replace(role || text, '[<\\[\\\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op2_lm_score": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents)),
g AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
u AS (SELECT w, count(*) AS c FROM w GROUP BY w),
ud AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY doc_id, w),
b AS (SELECT p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, w),
bd AS (SELECT doc_id, p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY doc_id, p, w),
n AS (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents),
s AS (
  SELECT g.doc_id, n.n, (SELECT sum(n) FROM n) - n.n AS rest, u.c - ud.c AS cw, b.c - bd.c AS cb, up.c - udp.c AS cp, g.p
  FROM g JOIN n USING (doc_id) JOIN u ON u.w = g.w JOIN ud ON ud.doc_id = g.doc_id AND ud.w = g.w
  LEFT JOIN b ON b.p = g.p AND b.w = g.w LEFT JOIN bd ON bd.doc_id = g.doc_id AND bd.p = g.p AND bd.w = g.w
  LEFT JOIN u up ON up.w = g.p LEFT JOIN ud udp ON udp.doc_id = g.doc_id AND udp.w = g.p),
l AS (SELECT *, CASE WHEN cw > 0 THEN ln(cw) - ln(rest) ELSE -ln(1 + rest) END AS one FROM s),
t AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN one WHEN cb > 0 THEN ln(cb) - ln(cp) ELSE one + ln(0.4) END) AS total FROM l GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, round(coalesce(total, 0) / greatest(n.n, 1), 6) AS mean_log_score FROM n LEFT JOIN t USING (doc_id)
""",
    "op2_lm_score_trigrams": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {WORDS_SQL} AS ws FROM documents)),
g AS (SELECT *, lag(w) OVER o AS p, lag(w, 2) OVER o AS q FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ud AS (SELECT doc_id, w, count(*) AS own FROM g GROUP BY ALL), u AS (SELECT w, sum(own) AS c FROM ud GROUP BY ALL),
bd AS (SELECT doc_id, p, w, count(*) AS own FROM g WHERE p IS NOT NULL GROUP BY ALL), b AS (SELECT p, w, sum(own) AS c FROM bd GROUP BY ALL),
td AS (SELECT doc_id, q, p, w, count(*) AS own FROM g WHERE q IS NOT NULL GROUP BY ALL), t AS (SELECT q, p, w, sum(own) AS c FROM td GROUP BY ALL),
ul AS (SELECT doc_id, w, c - own AS c FROM ud JOIN u USING (w)), bl AS (SELECT doc_id, p, w, c - own AS c FROM bd JOIN b USING (p, w)),
tl AS (SELECT doc_id, q, p, w, c - own AS c FROM td JOIN t USING (q, p, w)),
n AS (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents),
s AS (
  SELECT g.doc_id, g.p, g.q, (SELECT sum(n) FROM n) - n.n AS rest, x.c AS c1, y.c AS c2, z.c AS c3, px.c AS of2, py.c AS of3
  FROM g JOIN n USING (doc_id) JOIN ul x ON x.doc_id = g.doc_id AND x.w = g.w LEFT JOIN ul px ON px.doc_id = g.doc_id AND px.w = g.p
  LEFT JOIN bl y ON y.doc_id = g.doc_id AND y.p = g.p AND y.w = g.w LEFT JOIN bl py ON py.doc_id = g.doc_id AND py.p = g.q AND py.w = g.p
  LEFT JOIN tl z ON z.doc_id = g.doc_id AND z.q = g.q AND z.p = g.p AND z.w = g.w),
l1 AS (SELECT *, CASE WHEN c1 > 0 THEN ln(c1) - ln(rest) ELSE -ln(1 + rest) END AS one FROM s),
l2 AS (SELECT *, CASE WHEN p IS NULL THEN one WHEN c2 > 0 THEN ln(c2) - ln(of2) ELSE one + ln(0.4) END AS two FROM l1),
l3 AS (SELECT doc_id, sum(CASE WHEN q IS NULL THEN two WHEN c3 > 0 THEN ln(c3) - ln(of3) ELSE two + ln(0.4) END) AS total FROM l2 GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, round(coalesce(total, 0) / greatest(n.n, 1), 6) AS mean_log_score FROM n LEFT JOIN l3 USING (doc_id)
""",
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, coalesce(source, chr(1)) AS source, string_split(text, chr(10)) AS ls FROM documents)),
b AS (SELECT trim(line) AS t, min((doc_id, i)) AS first FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= {lines.MIN_SITES}),
k AS (SELECT l.*, coalesce((l.doc_id, l.i) <> b.first, false) AS gone FROM l LEFT JOIN b ON trim(l.line) = b.t),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id)
""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.replace("text", "lower(text)")} AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL.replace("text", "lower(text)")} AS w FROM benchmark),
ib AS (SELECT item_id, least({decontam.SHINGLE}, len(w)) AS k, w FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, w[p:p + k - 1] AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM ib)),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
sd AS (SELECT DISTINCT doc_id, w[p:p + k - 1] AS s FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ib)))
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_found FROM sd JOIN si USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= {decontam.CONTAINMENT} * any_value(n)
""",
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS donor, h, a.n, least(h, coalesce(b.n, 0)) AS k, least(h, coalesce(b.n, 0)) + greatest(a.n - h, 0) AS len
  FROM (SELECT *, ({CRC_SQL.format("conv_id")} % 9)::BIGINT AS h FROM n) a LEFT JOIN n b ON b.conv_id = a.conv_id - a.conv_id % 5),
s AS (SELECT c.conv_id, i AS pos, role, text FROM c JOIN t ON t.conv_id = c.donor AND i < k UNION ALL SELECT c.conv_id, i - h + k, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
p AS (SELECT conv_id, pos + 1 AS depth, strlen(text) AS size, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
g AS (SELECT depth, key, min(conv_id) AS node, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY 1, 2),
m AS (SELECT p.conv_id, p.depth, node, n_convs FROM p JOIN g USING (depth, key)),
k AS (SELECT g.node, g.depth, u.node AS parent FROM g LEFT JOIN m u ON u.conv_id = g.node AND u.depth = g.depth - 1),
q AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM k GROUP BY 1, 2),
w AS (SELECT m.node, m.depth, count(*) FILTER (q.n_children IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.size) AS saved_tokens
  FROM g JOIN m ON m.conv_id = g.node AND m.depth <= g.depth LEFT JOIN q ON q.node = g.node AND q.depth = g.depth GROUP BY 1, 2),
e AS (SELECT m.node, m.depth, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ended FROM m JOIN c ON c.conv_id = m.conv_id AND c.len = m.depth GROUP BY 1, 2)
SELECT g.node AS conv_id, g.depth, k.parent AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ended, '')) AS ends_sha256
FROM g JOIN k USING (node, depth) JOIN w USING (node, depth) LEFT JOIN q USING (node, depth) LEFT JOIN e USING (node, depth)
""",
    "op13_manifest": manifest_sql(),
    "op10_search": f"""
WITH w AS (SELECT doc_id, unnest({WORDS_SQL.replace("text", "lower(text)")}) AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY doc_id, w),
l AS (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT count(*) AS n, sum(n) / count(*) AS mean FROM l),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
s AS (
  SELECT q.doc_id AS query_id, t.doc_id, round(sum(q.c * ln(1 + (a.n - f.df + 0.5) / (f.df + 0.5)) * t.c * 2.2 / (t.c + 1.2 * (0.25 + 0.75 * l.n / a.mean))), {search.DIGITS}) AS score
  FROM t q JOIN t USING (w) JOIN f USING (w) JOIN l ON l.doc_id = t.doc_id, a WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, t.doc_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {search.K}
""",
}
