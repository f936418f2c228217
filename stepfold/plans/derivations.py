"""Queries of constraint derivation: a hundred parts are a machine, whose attributes come from name, size and number."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import derivation as D
from stepfold.plans.registry import query
from stepfold.plans.tables import table

INSTANCES = """
WITH n AS (SELECT p_partkey // 100 AS machine, p_partkey % 100 AS n, p_size AS s, p_partkey AS k FROM part),
c AS (SELECT *, CASE WHEN n = 0 THEN 'psu' WHEN n = 1 THEN 'cpu' WHEN n = 2 THEN 'cpu_cooler' WHEN n = 3 THEN 'motherboard' WHEN n = 4 THEN 'cpu_socket_lever' WHEN n % 6 = 0 THEN 'screw' WHEN n % 6 = 1 THEN 'connector' WHEN n % 6 = 2 THEN 'ram_latch' WHEN n % 6 = 3 THEN 'cover' WHEN n % 6 = 4 THEN 'ram_module' ELSE 'storage_drive' END AS cls FROM n)
SELECT machine, CASE WHEN k % 41 = 0 THEN 'ls:' ELSE '' END || cls || '.' || lpad(CAST(n AS VARCHAR), 2, '0') AS key, cls,
  CASE WHEN cls = 'screw' THEN CASE s % 3 WHEN 0 THEN 'motherboard' WHEN 1 THEN 'drive' END END AS role,
  CASE WHEN cls = 'connector' THEN CASE s % 5 WHEN 0 THEN 'atx_24pin' WHEN 1 THEN 'sata_data' WHEN 2 THEN 'usb' END WHEN cls = 'cpu_cooler' THEN CASE s % 2 WHEN 0 THEN 'fan' ELSE 'heatsink' END END AS kind,
  CASE WHEN cls = 'screw' THEN CASE s % 4 WHEN 0 THEN 'motherboard.03' WHEN 1 THEN 'cpu_cooler' WHEN 2 THEN 'storage_drive' END END AS fastens,
  CASE WHEN cls = 'connector' THEN CASE s % 3 WHEN 0 THEN 'motherboard' WHEN 1 THEN 'psu.00' WHEN 2 THEN 'connector' END END AS socket_host,
  CASE WHEN cls = 'connector' THEN CASE s % 4 WHEN 0 THEN 'cable:psu' WHEN 1 THEN 'cable:cpu_fan' WHEN 2 THEN 'cable:drive' END END AS cable,
  CASE WHEN cls = 'cover' THEN CASE s % 4 WHEN 0 THEN 'ram' WHEN 1 THEN 'motherboard_screws' WHEN 2 THEN 'cpu.01' ELSE 'front_bezel' END WHEN cls = 'ram_latch' AND s % 2 = 0 THEN 'ram_module.10' END AS of,
  CAST(NULL AS VARCHAR) AS parent, false AS attached, k % 37 = 0 AS extra, s % 7 = 0 AS captive FROM c
"""


def instances(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_derivation_part")
    return spark.sql(INSTANCES.replace("FROM part)", "FROM _derivation_part)").replace("//", "div").replace("VARCHAR", "STRING"))


BASE_SQL = f"""
i AS MATERIALIZED ({INSTANCES}), r AS (SELECT * FROM i WHERE key NOT LIKE 'ls:%'),
u AS (SELECT machine, cls, min(key) AS key FROM r GROUP BY 1, 2 HAVING count(*) = 1),
ref AS (SELECT machine, key AS ref, key AS target FROM r UNION ALL SELECT machine, cls, key FROM u),
ow AS (SELECT r.*, CASE WHEN kind IN ('atx_24pin', 'cpu_power', 'sata_power', 'molex') THEN 'psu' WHEN kind = 'sata_data' THEN NULL WHEN cable = 'cable:psu' THEN 'psu' WHEN cable = 'cable:cpu_fan' THEN 'cpu_cooler' END AS w FROM r WHERE cls = 'connector'),
co AS (SELECT ow.*, u.key AS found, o.kind AS fk FROM ow LEFT JOIN u ON u.machine = ow.machine AND u.cls = ow.w LEFT JOIN r o ON o.machine = u.machine AND o.key = u.key),
cn AS (SELECT co.*, CASE WHEN w = 'cpu_cooler' AND NOT coalesce(fk IN ('fan', 'heatsink_fan'), false) THEN NULL ELSE found END AS owner, ref.target AS host FROM co LEFT JOIN ref ON ref.machine = co.machine AND ref.ref = co.socket_host)"""
EDGES_SQL = f"""{BASE_SQL},
e AS (
  SELECT r.machine, 'fastened_by' AS type, target, key AS blocker, key || ' fastens ' || target AS reason, 0 AS place FROM r JOIN ref ON ref.machine = r.machine AND ref.ref = r.fastens WHERE cls = 'screw'
  UNION ALL SELECT machine, 'connected_to', host, key, key || ' plugs into ' || host, 1 FROM cn WHERE host IS NOT NULL
  UNION ALL SELECT machine, 'connected_to', owner, key, key || ' is on the cable of ' || owner, 2 FROM cn WHERE owner IS NOT NULL AND (NOT extra OR cable IS NOT NULL) AND (host IS NULL OR owner <> host)
  UNION ALL SELECT r.machine, 'locked_by', target, key, key || ' locks ' || target, 3 FROM r JOIN ref ON ref.machine = r.machine AND ref.ref = r.of WHERE cls = 'ram_latch'
  UNION ALL SELECT r.machine, 'locked_by', u.key, r.key, r.key || ' locks ' || u.key, 3 FROM r JOIN u ON u.machine = r.machine AND u.cls = 'cpu' WHERE r.cls = 'cpu_socket_lever' AND NOT extra
  UNION ALL SELECT r.machine, 'covered_by', t.key, r.key, r.key || ' covers ' || t.key, 4 FROM r JOIN r t ON t.machine = r.machine AND (t.key = r.of OR (NOT t.extra AND ((r.of = 'ram' AND t.cls = 'ram_module') OR (r.of = 'motherboard_screws' AND t.cls = 'screw' AND t.role = 'motherboard')))) WHERE r.cls = 'cover'
  UNION ALL SELECT a.machine, 'covered_by', a.key, b.key, b.key || ' sits on ' || a.key, 5 FROM u a JOIN u b ON a.machine = b.machine AND a.cls = 'cpu' AND b.cls = 'cpu_cooler' JOIN r ra ON ra.machine = a.machine AND ra.key = a.key AND NOT ra.extra JOIN r rb ON rb.machine = b.machine AND rb.key = b.key AND NOT rb.extra),
p AS (SELECT machine, type, target, blocker, arg_min(reason, place) AS reason FROM e GROUP BY ALL)"""


@query("propose_edges", f"WITH {EDGES_SQL} SELECT * FROM p")
def propose_edges(spark, sf_dir):
    return D.propose_edges(instances(spark, sf_dir))


@query("unresolved_fan_owners", f"WITH {BASE_SQL} SELECT machine, key, found AS cooler FROM co WHERE w = 'cpu_cooler' AND found IS NOT NULL AND NOT coalesce(fk IN ('fan', 'heatsink_fan'), false)")
def unresolved_fan_owners(spark, sf_dir):
    return D.unresolved_fan_owners(instances(spark, sf_dir))


@query("cover_targets", f"WITH {EDGES_SQL} SELECT machine, blocker AS key, target AS held FROM e WHERE place = 4")
def cover_targets(spark, sf_dir):
    return D.cover_targets(instances(spark, sf_dir))


@query("settled_instances", f"WITH i AS ({INSTANCES}) SELECT machine, key, cls FROM i WHERE key NOT LIKE 'ls:%'")
def settled_instances(spark, sf_dir):
    return D.settled(instances(spark, sf_dir)).select("machine", "key", "cls")


@query("virtual_targets", f"WITH {EDGES_SQL}, x AS (SELECT machine, type, CASE WHEN hash_ = 0 THEN 'cable:psu' ELSE target END AS target, blocker FROM (SELECT *, CAST(right(blocker, 2) AS INTEGER) % 5 AS hash_ FROM p)) SELECT x.* FROM x LEFT JOIN i ON i.machine = x.machine AND i.key = x.target WHERE x.target LIKE 'cable:%' OR i.key IS NULL")
def virtual_targets(spark, sf_dir):
    own = instances(spark, sf_dir)
    moved = F.when(F.right("blocker", F.lit(2)).cast("int") % 5 == 0, "cable:psu").otherwise(F.col("target"))
    return D.virtual_targets(D.propose_edges(own).withColumn("target", moved), own).select("machine", "type", "target", "blocker")


@query("cable_nodes", f"WITH {BASE_SQL}, b AS (SELECT DISTINCT machine, cable AS key FROM r WHERE cable IS NOT NULL), s AS (SELECT machine, key, 'unplugged' AS state FROM b WHERE machine % 2 = 0 AND key <> 'cable:psu') SELECT b.machine, b.key, coalesce(s.state, 'routed') AS state FROM b LEFT JOIN s USING (machine, key)")
def cable_nodes(spark, sf_dir):
    edges = D.settled(instances(spark, sf_dir)).where("cable is not null").select("machine", F.col("cable").alias("blocker"))
    state = edges.where("machine % 2 = 0 and blocker <> 'cable:psu'").select("machine", F.col("blocker").alias("key"), F.lit("unplugged").alias("state")).distinct()
    return D.cable_nodes(edges, state)


SCREW_HOSTS, CLASS_HOSTS = {"motherboard": "motherboard", "drive": "storage_drive"}, {"ram_latch": "motherboard", "cpu_socket_lever": "motherboard"}
INFER_SQL = f"""{BASE_SQL},
f AS (SELECT i.*, CASE WHEN i.cls = 'screw' AND NOT i.extra AND i.key NOT LIKE 'ls:%' AND fastens IS NULL THEN h.key ELSE fastens END AS fs FROM i LEFT JOIN u h ON h.machine = i.machine AND h.cls = CASE i.role WHEN 'motherboard' THEN 'motherboard' WHEN 'drive' THEN 'storage_drive' END),
g AS (SELECT f.*, ref.target AS ft FROM f LEFT JOIN ref ON ref.machine = f.machine AND ref.ref = f.fs),
m AS (SELECT machine, key, row_number() OVER (PARTITION BY machine ORDER BY key) - 1 AS at, count(*) OVER (PARTITION BY machine) AS m FROM r WHERE cls = 'ram_module' AND NOT extra),
l AS (SELECT machine, key, row_number() OVER (PARTITION BY machine ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY machine) AS n FROM r WHERE cls = 'ram_latch' AND NOT extra),
lm AS (SELECT l.machine, l.key, m.key AS module FROM l JOIN m ON m.machine = l.machine AND m.at = l.i * m.m // l.n)
SELECT g.machine, g.key, g.fs AS fastens,
  CASE WHEN g.cls = 'screw' AND captive AND NOT extra AND g.key NOT LIKE 'ls:%' AND ft IS NOT NULL THEN ft WHEN g.cls IN ('ram_latch', 'cpu_socket_lever') AND g.key NOT LIKE 'ls:%' THEN mb.key END AS parent,
  coalesce(CASE WHEN g.cls = 'connector' AND g.key NOT LIKE 'ls:%' THEN sh.target END, g.socket_host) AS socket_host, coalesce(g.of, lm.module) AS of
FROM g LEFT JOIN u mb ON mb.machine = g.machine AND mb.cls = 'motherboard' LEFT JOIN ref sh ON sh.machine = g.machine AND sh.ref = g.socket_host LEFT JOIN lm ON lm.machine = g.machine AND lm.key = g.key"""


@query("infer_relations", f"WITH {INFER_SQL}")
def infer_relations(spark, sf_dir):
    return D.infer_relations(instances(spark, sf_dir), SCREW_HOSTS, CLASS_HOSTS).select("machine", "key", "fastens", "parent", "socket_host", "of")


@query("unresolved_relations", f"""WITH {BASE_SQL}, n AS (SELECT machine, cls, count(*) AS n FROM r GROUP BY 1, 2),
w AS (SELECT machine, key, 'fastens' AS field, CASE role WHEN 'motherboard' THEN 'motherboard' WHEN 'drive' THEN 'storage_drive' END AS cls FROM r WHERE cls = 'screw' AND NOT extra AND fastens IS NULL
  UNION ALL SELECT machine, key, 'socket_host', socket_host FROM r WHERE cls = 'connector' AND socket_host IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r x WHERE x.machine = r.machine AND x.key = r.socket_host))
SELECT w.machine, w.key, field, CASE WHEN n IS NULL THEN 'no candidate' ELSE 'ambiguous' END AS why FROM w LEFT JOIN n ON n.machine = w.machine AND n.cls = w.cls WHERE n IS NULL OR n <> 1""")
def unresolved_relations(spark, sf_dir):
    return D.unresolved_relations(instances(spark, sf_dir), SCREW_HOSTS)


@query("edge_decisions", f"""WITH {EDGES_SQL}, t AS (SELECT *, CAST(right(blocker, 2) AS INTEGER) AS n FROM p),
s AS (SELECT machine, type, target, blocker, n, CASE n % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'override' ELSE 'rule' END AS source, CASE n % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted_orphan' WHEN 2 THEN 'proposed' ELSE 'rejected' END AS status FROM t WHERE n % 11 <> 0),
d AS (SELECT machine, type, target, blocker, n, CASE n % 3 WHEN 0 THEN CASE WHEN n % 11 = 0 THEN 'add' ELSE 'remove' END WHEN 1 THEN 'accept' ELSE 'adopt' END AS action FROM t)
SELECT machine, type, target, blocker,
  CASE WHEN source IS NULL THEN 'manual' WHEN n % 4 IN (2, 3) AND action = 'accept' THEN 'override' WHEN n % 4 = 1 AND action = 'adopt' THEN 'manual' ELSE source END AS source,
  CASE WHEN source IS NULL THEN 'accepted' WHEN n % 4 IN (2, 3) AND action = 'accept' THEN 'accepted' WHEN n % 4 = 1 AND action = 'adopt' THEN 'accepted' ELSE status END AS status
FROM d LEFT JOIN s USING (machine, type, target, blocker, n) WHERE NOT (coalesce(source, '') = 'manual' AND action = 'remove') AND (source IS NOT NULL OR action = 'add')""")
def edge_decisions(spark, sf_dir):
    n = F.right("blocker", F.lit(2)).cast("int")
    p = D.propose_edges(instances(spark, sf_dir)).withColumn("n", n)
    stored = p.where("n % 11 <> 0").select(*D.EDGE_KEYS, F.expr("CASE n % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'override' ELSE 'rule' END AS source"), F.expr("CASE n % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted_orphan' WHEN 2 THEN 'proposed' ELSE 'rejected' END AS status"))
    asked = p.select(*D.EDGE_KEYS, F.expr("CASE n % 3 WHEN 0 THEN CASE WHEN n % 11 = 0 THEN 'add' ELSE 'remove' END WHEN 1 THEN 'accept' ELSE 'adopt' END AS action"))
    return D.decide(stored, asked)


@query("edge_template", f"WITH {EDGES_SQL}, t AS (SELECT p.type, a.cls AS target, b.cls AS blocker, count(DISTINCT p.machine) AS machines FROM p JOIN u a ON a.machine = p.machine AND a.key = p.target JOIN u b ON b.machine = p.machine AND b.key = p.blocker GROUP BY ALL) SELECT * FROM t")
def edge_template(spark, sf_dir):
    own = instances(spark, sf_dir)
    return D.save_template(D.propose_edges(own), own)


@query("templated_edges", f"WITH {EDGES_SQL}, t AS (SELECT DISTINCT p.type, a.cls AS target, b.cls AS blocker FROM p JOIN u a ON a.machine = p.machine AND a.key = p.target JOIN u b ON b.machine = p.machine AND b.key = p.blocker) SELECT a.machine, t.type, a.key AS target, b.key AS blocker FROM t JOIN u a ON a.cls = t.target JOIN u b ON b.cls = t.blocker AND b.machine = a.machine")
def templated_edges(spark, sf_dir):
    own = instances(spark, sf_dir)
    return D.apply_template(D.save_template(D.propose_edges(own), own), own)


@query("initial_state", f"WITH i AS ({INSTANCES}) SELECT machine, key, cls, CASE WHEN key LIKE '%5' THEN 'loosened' WHEN cls = 'screw' THEN 'tight' WHEN cls = 'connector' THEN 'plugged' ELSE 'installed' END AS state, 'in_chassis' AS placement FROM i")
def initial_state(spark, sf_dir):
    own = instances(spark, sf_dir)
    given = own.where("key like '%5'").select("machine", "key", F.lit("loosened").alias("state"))
    return D.initial_state(own, {"screw": "tight", "connector": "plugged"}, given)


@query("needs_geometry", f"""WITH i AS ({INSTANCES}),
s AS (SELECT machine, key, cls, CASE WHEN captive THEN 'removed' ELSE 'tight' END AS state, CASE WHEN key LIKE '%7' THEN 'on_bench' WHEN key LIKE '%8' THEN 'elsewhere' ELSE 'in_chassis' END AS placement, CASE WHEN cls = 'screw' THEN 'motherboard.03' END AS left_with FROM i)
SELECT s.machine, s.key, CASE WHEN s.placement = 'in_chassis' THEN 'mask' ELSE 'box' END AS geometry FROM s LEFT JOIN s p ON p.machine = s.machine AND p.key = s.left_with
WHERE s.key NOT LIKE 'ls:%' AND NOT (s.left_with IS NOT NULL AND (p.key IS NULL OR p.state = 'removed' OR p.placement <> 'in_chassis'))
  AND ((s.placement = 'in_chassis' AND s.state = 'tight' AND s.cls IN ('screw', 'cover')) OR s.placement = 'on_bench')""")
def needs_geometry(spark, sf_dir):
    own = instances(spark, sf_dir)
    state = own.select("machine", "key", "cls", F.expr("CASE WHEN captive THEN 'removed' ELSE 'tight' END AS state"), F.expr("CASE WHEN key LIKE '%7' THEN 'on_bench' WHEN key LIKE '%8' THEN 'elsewhere' ELSE 'in_chassis' END AS placement"), F.expr("CASE WHEN cls = 'screw' THEN 'motherboard.03' END AS left_with"))
    policy = spark.createDataFrame([("screw", "tight"), ("cover", "tight")], "cls string, state string")
    return D.needs_geometry(state, policy)
