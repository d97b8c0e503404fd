"""Graphs and planning tables on orders, parts, suppliers and generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.operators import extract as X
from evidex.operators import graph as G
from evidex.operators import planning as L
from evidex.plans.corpora import CODE_SQL, gen_code
from evidex.plans.extract import PART_SQL, part_classes
from evidex.plans.registry import query
from evidex.plans.schema import _cat


@query("domain_graph", f"""
WITH {CODE_SQL} SELECT DISTINCT regexp_replace(cls, '(Dao|DAO|Service|Facade|Controller|Data|Job)$', '') AS src,
  regexp_replace(peer, '(Dao|DAO|Service|Facade|Controller|Data|Job)$', '') AS dst FROM cls WHERE cls <> peer""")
def domain_graph(t):
    c = X.class_table(gen_code(t.events)).select(
        "class_name", N.domain_key(F.col("class_name")).alias("domain"), F.col("source").alias("text"))
    return G.domain_graph(c)


# A DAG whose depth is the logarithm of its size: each order depends on two smaller keys.
EDGE_SQL = """
e0 AS (SELECT o_orderkey AS src, o_orderkey // 3 AS dst FROM orders
       UNION SELECT o_orderkey, (o_custkey * 31) % (o_orderkey // 2 + 1) FROM orders),
e AS (SELECT DISTINCT src, dst FROM e0 WHERE src <> dst)
"""


def order_edges(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = t.orders.select(k.alias("src"), F.floor(k / 3).alias("dst"))
    b = t.orders.select(k.alias("src"), ((c * 31) % (F.floor(k / 2) + 1)).alias("dst"))
    return a.unionByName(b)


LEVEL_SQL = f"""
{EDGE_SQL},
lv(node, level) AS (
  SELECT node, 0 FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT src FROM e)
  UNION SELECT e.src, lv.level + 1 FROM lv JOIN e ON e.dst = lv.node),
levels AS (SELECT node, max(level)::BIGINT AS level FROM lv GROUP BY node)
"""


@query("wavefront_levels", f"WITH RECURSIVE {LEVEL_SQL} SELECT node, level FROM levels")
def wavefront_levels(t):
    return G.wavefront_levels(order_edges(t))


@query("topological_schedule", f"""
WITH RECURSIVE {LEVEL_SQL} SELECT node, level, row_number() OVER (ORDER BY level, node) AS position FROM levels""")
def topological_schedule(t):
    return G.topological_schedule(order_edges(t))


@query("transitive_closure", """
WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey // 3 AS dst FROM orders WHERE o_orderkey > 0
  UNION SELECT o_orderkey // 3, o_orderkey FROM orders WHERE o_orderkey % 1000 = 7),
r AS (SELECT src AS node, dst AS reach FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.reach)
SELECT node, reach FROM r""")
def transitive_closure(t):
    k = F.col("o_orderkey")
    tree = t.orders.select(k.alias("src"), F.floor(k / 3).alias("dst"))
    back = t.orders.filter(k % 1000 == 7).select(F.floor(k / 3).alias("src"), k.alias("dst"))
    return G.transitive_closure(tree.unionByName(back))


@query("method_calls", f"""
WITH {CODE_SQL},
ms AS (SELECT cls.file_id, cls, 'm' || event_id AS m, text, peer FROM code JOIN cls USING (file_id, cls, peer)
  UNION ALL SELECT file_id, cls, 'getLabel', text, peer FROM cls)
SELECT DISTINCT cls || '.' || m AS source, peer || '.m' || (40 * (file_id // 2)) AS target FROM ms
WHERE contains(text, 'peer.m' || (40 * (file_id // 2)) || '(') AND m IN (SELECT 'm' || event_id FROM events WHERE event_type = 'click')""")
def method_calls(t):
    return G.method_calls(gen_code(t.events))[1]


@query("method_nodes", f"""
WITH {CODE_SQL}, ms AS (SELECT cls, 'm' || event_id AS m FROM code UNION ALL SELECT cls, 'getLabel' FROM cls)
SELECT cls || '.' || m AS id, cls AS class_name, CASE WHEN cls LIKE '%Controller' THEN 'Controller' WHEN cls LIKE '%Facade' THEN 'Facade'
 WHEN cls LIKE '%Service' THEN 'Service' WHEN cls LIKE '%Dao' THEN 'DAO' ELSE 'Utility' END AS layer FROM ms""")
def method_nodes(t):
    return G.method_calls(gen_code(t.events))[0]


BLAST_SQL = f"""
{EDGE_SQL},
own AS (SELECT DISTINCT o_orderkey // 10 AS target, o_orderkey AS c FROM orders),
d1 AS (SELECT DISTINCT own.target, e.src AS c FROM own JOIN e ON e.dst = own.c),
d2 AS (SELECT DISTINCT d1.target, e.src AS c FROM d1 JOIN e ON e.dst = d1.c),
d3 AS (SELECT DISTINCT d2.target, e.src AS c FROM d2 JOIN e ON e.dst = d2.c),
blast AS (SELECT target, c, min(d)::BIGINT AS distance FROM (SELECT target, c, 1 AS d FROM d1 UNION ALL SELECT target, c, 2 FROM d2
   UNION ALL SELECT target, c, 3 FROM d3) WHERE (target, c) NOT IN (SELECT target, c FROM own) GROUP BY ALL),
art AS (SELECT o_orderkey // 10 AS target, count(*) FILTER (o_orderstatus = 'F') AS rules, max(o_orderpriority = '1-URGENT') AS tested FROM orders GROUP BY 1)
"""


def own_classes(t):
    return t.orders.select(F.floor(F.col("o_orderkey") / 10).alias("target"), F.col("o_orderkey").alias("class_name"))


def order_artifacts(t):
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 10).alias("target")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("rules"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", "x")).alias("test_text"))


@query("blast_radius", f"WITH {BLAST_SQL} SELECT target, c AS class_name, distance FROM blast")
def blast_radius(t):
    return G.blast_radius(order_edges(t), own_classes(t))


ROLL_SQL = f"""
{BLAST_SQL},
aff AS (SELECT b.target, b.c // 10 AS affected, min(distance) AS distance, count(*) AS n_via FROM blast b WHERE b.c // 10 <> b.target
  GROUP BY ALL),
roll AS (SELECT aff.*, art.rules, CASE WHEN tested THEN affected || 'Test' END AS test_class, distance = 1 AS direct
  FROM aff JOIN art ON art.target = aff.affected)
"""


@query("blast_rollup", f"WITH {ROLL_SQL} SELECT * FROM roll")
def blast_rollup(t):
    return G.blast_rollup(G.blast_radius(order_edges(t), own_classes(t)), own_classes(t).distinct(), order_artifacts(t))


@query("blast_summary", f"""
WITH {ROLL_SQL}
SELECT art.target, count(affected) FILTER (direct) AS direct, count(affected) FILTER (NOT direct) AS indirect,
  count(test_class) + any_value(CASE WHEN tested THEN 1 ELSE 0 END) AS tests,
  (any_value(art.rules) + coalesce(sum(roll.rules) FILTER (direct), 0))::BIGINT AS rules_at_risk
FROM art LEFT JOIN roll ON roll.target = art.target GROUP BY art.target""")
def blast_summary(t):
    return G.blast_summary(blast_rollup(t), order_artifacts(t))


@query("shared_objects", """
WITH r AS (SELECT DISTINCT l_suppkey AS target, l_partkey AS object FROM lineitem)
SELECT target, object FROM r WHERE object IN (SELECT object FROM r GROUP BY object HAVING count(*) > 1)""")
def shared_objects(t):
    r = t.lineitem.select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("object"))
    return G.shared_objects(r)


PLAN_SQL = f"""
{PART_SQL},
lay AS (SELECT p_partkey, cls, 'src/' || p_brand || '/' || cls || '.java' AS file, regexp_replace(regexp_replace(cls, '^Default', ''), '(Dao|DAO|Service|Facade|Controller|Data|Job)$', '') AS dom,
  CASE WHEN p_size % 12 = 10 THEN 'Job' WHEN p_size % 12 IN (0, 1) THEN 'Controller' WHEN p_size % 12 = 2 THEN 'Facade'
  WHEN p_size % 12 = 3 THEN 'Service' WHEN p_size % 12 IN (4, 5, 6) THEN 'DAO' WHEN p_size % 12 IN (7, 8, 9) THEN 'Model' ELSE 'Utility' END AS layer FROM pc),
tg AS (SELECT CASE layer WHEN 'DAO' THEN dom || 'Selector' WHEN 'Controller' THEN dom || 'Controller' WHEN 'Utility' THEN cls
   WHEN 'Job' THEN dom || 'Scheduler' ELSE dom || 'Service' END AS target, CASE layer WHEN 'Facade' THEN 'Service' ELSE layer END AS layer,
   cls AS class_name, file, p_partkey, layer = 'Facade' AS folded FROM lay WHERE layer <> 'Model')
"""


def layered(t):
    none = F.array().cast("array<string>")
    c = part_classes(t)
    layer = N.infer_layer(F.col("class_name"), none, F.lit(None).cast("string"), none)
    return c.select("class_name", layer.alias("layer"), _cat("src/", F.col("p_brand"), "/", F.col("class_name"), ".java").alias("file"),
                    F.col("p_partkey").alias("ord"))


@query("plan_targets", f"WITH {PLAN_SQL} SELECT target, layer, class_name, file FROM tg")
def plan_targets(t):
    return L.plan_targets(layered(t)).drop("at")


@query("merge_targets", f"""
WITH {PLAN_SQL} SELECT target, arg_min(layer, folded::INT * 1000000000 + p_partkey) AS layer, count(DISTINCT (class_name, file)) AS n_sources FROM tg GROUP BY target""")
def merge_targets(t):
    return L.merge_targets(L.plan_targets(layered(t)))[0]


@query("apply_overrides", """
WITH p AS (SELECT o_orderkey AS target, CASE o_orderstatus WHEN 'F' THEN 'Skip' WHEN 'O' THEN 'Convert' ELSE 'Native' END AS kind, o_orderpriority AS rationale,
   CASE o_orderkey % 4 WHEN 0 THEN 'Skip' WHEN 1 THEN 'Convert' WHEN 2 THEN 'Other' END AS dec FROM orders)
SELECT target, CASE WHEN dec = 'Skip' THEN 'Skip' WHEN dec = 'Convert' AND kind = 'Skip' THEN 'Convert' ELSE kind END AS target_kind,
  CASE WHEN dec = 'Skip' AND kind <> 'Skip' THEN 'excluded by reviewer' WHEN dec = 'Convert' AND kind = 'Skip' THEN 'included by reviewer' ELSE rationale END AS rationale,
  coalesce((dec = 'Skip' AND kind <> 'Skip') OR (dec = 'Convert' AND kind = 'Skip'), false) AS changed FROM p""")
def apply_overrides(t):
    k = F.col("o_orderkey")
    s = F.col("o_orderstatus")
    plan = t.orders.select(k.alias("target"), F.when(s == "F", "Skip").when(s == "O", "Convert").otherwise("Native").alias("target_kind"),
                           F.col("o_orderpriority").alias("rationale"))
    over = t.orders.filter(k % 4 < 3).select(k.alias("target"), F.when(k % 4 == 0, "Skip").when(k % 4 == 1, "Convert").otherwise("Other").alias("decision"))
    return L.apply_overrides(plan, over)


ART_SQL = """
a AS (SELECT s_suppkey AS artifact_id, 'T' || (CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 1 ELSE s_suppkey END) AS target,
   CASE WHEN s_suppkey % 20 = 8 THEN 'Component' ELSE 'Service' END AS layer, CASE WHEN s_acctbal < 0 THEN 'check; balance' ELSE '' END AS flags FROM supplier),
ap AS (SELECT *, CASE WHEN layer = 'Component' THEN 'lwc/' || target ELSE target || '.cls' END AS path FROM a),
hit AS (SELECT path FROM ap GROUP BY path HAVING count(*) > 1)
"""


def supplier_artifacts(t):
    k = F.col("s_suppkey")
    base = F.when(k % 10 == 9, k - 1).otherwise(k)
    flags = F.when(F.col("s_acctbal") < 0, F.array(F.lit("check"), F.lit("balance"))).otherwise(F.array().cast("array<string>"))
    return t.supplier.select(k.alias("artifact_id"), _cat("T", base.cast("string")).alias("target"),
                             F.when(k % 20 == 8, "Component").otherwise("Service").alias("layer"), flags.alias("review_flags"))


@query("output_collisions", f"WITH {ART_SQL} SELECT path, artifact_id, target, layer FROM ap WHERE path IN (SELECT path FROM hit)")
def output_collisions(t):
    return L.output_collisions(supplier_artifacts(t))


LEDGER_SQL = f"""
{ART_SQL},
src AS (SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 1000000000 + l_suppkey) AS artifact_id FROM lineitem GROUP BY 1),
led AS (
 SELECT 'P' || p_partkey AS source, CASE WHEN p_size % 9 = 0 THEN 'Model' ELSE p_type END AS layer,
  CASE WHEN p_size % 9 = 0 THEN 'converted' WHEN path IS NOT NULL AND path IN (SELECT path FROM hit) THEN 'overwritten'
    WHEN path IS NOT NULL AND flags <> '' THEN 'flagged' WHEN path IS NOT NULL THEN 'converted' WHEN p_size % 5 = 0 THEN 'skipped' ELSE 'unaccounted' END AS outcome,
  CASE WHEN p_size % 9 = 0 THEN 'SObject metadata' WHEN path IS NOT NULL THEN path ELSE '—' END AS target,
  CASE WHEN p_size % 9 = 0 THEN 'data model → custom object' WHEN path IS NOT NULL AND path IN (SELECT path FROM hit)
     THEN 'more than one artifact writes `' || path || '` — only one survived, so this class''s logic may not be in the output'
    WHEN path IS NOT NULL THEN flags WHEN p_size % 5 = 0 THEN p_name ELSE 'NOT represented in output — investigate' END AS note
 FROM part LEFT JOIN src ON l_partkey = p_partkey LEFT JOIN ap USING (artifact_id)
 UNION ALL SELECT 'U' || page_id, '—', 'unreadable', '—', 'not a text file (' || url || ') — migrate this file by hand' FROM pages WHERE page_id % 7 = 0
 UNION ALL SELECT 'G' || page_id, 'Module', 'skipped', '—', 'glue' FROM pages WHERE page_id % 7 <> 0)
"""


def ledger(t):
    k = F.col("p_partkey")
    classes = t.part.select(_cat("P", k.cast("string")).alias("class_name"),
                            F.when(F.col("p_size") % 9 == 0, "Model").otherwise(F.col("p_type")).alias("layer"))
    sources = t.lineitem.select(
        F.col("l_suppkey").alias("artifact_id"), _cat("P", F.col("l_partkey").cast("string")).alias("class_name"),
        F.col("l_orderkey").alias("ord"))
    skips = t.part.filter("p_size % 5 = 0").select(_cat("P", k.cast("string")).alias("class_name"),
                                                   F.col("p_name").alias("rationale"), k.alias("ord"))
    p = F.col("page_id")
    bad = t.pages.filter(p % 7 == 0).select(_cat("U", p.cast("string")).alias("class_name"), F.lit("not a text file").alias("reason"), F.col("url").alias("file"))
    glue = t.pages.filter(p % 7 != 0).select(_cat("G", p.cast("string")).alias("class_name"), F.lit("Module").alias("layer"), F.lit("glue").alias("reason"))
    return L.completeness_ledger(classes, supplier_artifacts(t), sources, skips, bad, None, glue)


@query("completeness_ledger", f"WITH {LEDGER_SQL} SELECT * FROM led")
def completeness_ledger(t):
    return ledger(t)


@query("outcome_counts", f"WITH {LEDGER_SQL} SELECT outcome, count(*) AS n FROM led GROUP BY outcome")
def outcome_counts(t):
    return L.outcome_counts(ledger(t))


@query("comprehension_rollup", """
WITH c AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
f AS (SELECT conv_id, turn, UNNEST(ls) AS l, UNNEST(generate_series(1, len(ls))) AS pos FROM c),
r AS (SELECT conv_id, string_agg(md5(l), '|' ORDER BY turn, pos) AS rules FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS rn FROM f) GROUP BY 1),
k AS (SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS risks FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM c WHERE turn % 2 = 0) GROUP BY 1),
h AS (SELECT conv_id, coalesce(arg_min(md5(text), turn) FILTER (role <> 'system'), '') AS purpose,
  CASE WHEN bool_or(length(text) > 800) THEN 'High' WHEN bool_or(length(text) > 300) THEN 'Medium' ELSE 'Low' END AS complexity FROM c GROUP BY 1)
SELECT 'T' || conv_id AS target, purpose, coalesce(rules, '') AS rules, coalesce(risks, '') AS risks, complexity FROM h LEFT JOIN r USING (conv_id) LEFT JOIN k USING (conv_id)""")
def comprehension_rollup(t):
    name = _cat("C", F.col("conv_id").cast("string"), ".", F.col("turn").cast("string"))
    n = F.length("text")
    sources = t.conversations.select(_cat("T", F.col("conv_id").cast("string")).alias("target"), name.alias("class_name"), F.col("turn").alias("ord"))
    profiles = t.conversations.select(
        name.alias("class_name"), F.when(F.col("role") != "system", F.md5("text")).otherwise("").alias("purpose"),
        F.transform(F.split("text", "\n"), lambda x: F.md5(x)).alias("business_rules"),
        F.when(F.col("turn") % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("risks"),
        F.when(n > 800, "High").when(n > 300, "Medium").otherwise("Low").alias("complexity"))
    r = L.comprehension_rollup(sources, profiles)
    return r.select("target", "purpose", F.array_join("business_rules", "|").alias("rules"), F.array_join("risks", "|").alias("risks"), "complexity")
