"""Data files, schedules and processes written from customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.operators import impex as I
from evidex.operators import processes as W
from evidex.operators import schedules as C
from evidex.operators.scale import settled
from evidex.plans.corpora import CODE_SQL, _unit, joined
from evidex.plans.registry import query
from evidex.plans.schema import _cat


def gen_impex(customer):
    """files(file, text): per 50 customers a Customer block, a second one, a Trigger block."""
    k = F.col("c_custkey")
    ks = k.cast("string")
    row = (F.when(k % 10 == 3, _cat(";C", ks, "; ", F.col("c_name"), " "))
           .when(k % 10 == 4, _cat(";C", ks, ";", F.col("c_name"), ";", F.col("c_nationkey").cast("string"), ";en;a,b;extra;more"))
           .otherwise(_cat(";C", ks, "; ", F.col("c_name"), " ;", F.col("c_nationkey").cast("string"), ";en;", F.col("c_mktsegment"))))
    rows = customer.select(F.floor(k / 50).alias("file_id"), "c_custkey", row.alias("line"))
    f = joined(rows, "file_id", "c_custkey", "line")
    fs = F.col("file_id").cast("string")
    text = _cat(
        ";before;any;header\n# customers of block ", fs, "\n$lang=en\n\n",
        "INSERT_UPDATE Customer; uid[unique=true]; name[lang=$lang,trim='yes']; nation(code); $catalog[default=x]; addr(street,town(code))\n",
        F.col("body"), "\n\nUPDATE Customer; uid[unique=true]; balance[flag]\n;C", (F.col("file_id") * 50).cast("string"),
        "; 12.5 \nREMOVE Segment; code\n;S", (F.col("file_id") % 3).cast("string"),
        "\nINSERT_UPDATE Trigger; cronJob(code)[unique=true]; cronExpression; active\n;job", fs,
        F.when(F.col("file_id") % 4 == 1, ";").otherwise(";0 0 2 * * ?"),
        F.when(F.col("file_id") % 3 == 0, ";FALSE").otherwise(";"), "\nINSERT Empty; code[unique=true]; label[lang=en]; label[lang=de]\n")
    return f.select("file_id", _cat("data/f", F.lpad(fs, 9, "0"), ".impex").alias("file"), text.alias("text"))


IMPEX_SQL = """
c AS (SELECT *, c_custkey // 50 AS f, 'data/f' || lpad((c_custkey // 50)::VARCHAR, 9, '0') || '.impex' AS file,
   6 + row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) - 1 AS line_no, c_custkey % 10 AS m FROM customer),
n AS (SELECT f, file, count(*) AS n FROM c GROUP BY ALL),
ln AS (
  SELECT file, 1 AS block_no, 'INSERT_UPDATE' AS mode, 'Customer' AS type, line_no,
   CASE m WHEN 3 THEN ';C' || c_custkey || '; ' || c_name || ' ' WHEN 4 THEN ';C' || c_custkey || ';' || c_name || ';' || c_nationkey || ';en;a,b;extra;more'
     ELSE ';C' || c_custkey || '; ' || c_name || ' ;' || c_nationkey || ';en;' || c_mktsegment END AS raw FROM c
  UNION ALL SELECT file, 2, 'UPDATE', 'Customer', n + 8, ';C' || (f * 50) || '; 12.5 ' FROM n
  UNION ALL SELECT file, 3, 'REMOVE', 'Segment', n + 10, ';S' || (f % 3) FROM n
  UNION ALL SELECT file, 4, 'INSERT_UPDATE', 'Trigger', n + 12, ';job' || f || CASE WHEN f % 4 = 1 THEN ';' ELSE ';0 0 2 * * ?' END ||
     CASE WHEN f % 3 = 0 THEN ';FALSE' ELSE ';' END FROM n),
col(type, block_no, pos, attr, is_ref, ref_key, composite, is_macro, is_unique, mods) AS (VALUES
  ('Customer', 1, 0, 'uid', false, NULL, false, false, true, 'unique=true'),
  ('Customer', 1, 1, 'name', false, NULL, false, false, false, 'lang=$lang,trim=yes'),
  ('Customer', 1, 2, 'nation', true, 'code', false, false, false, ''),
  ('Customer', 1, 3, '$catalog', false, NULL, false, true, false, 'default=x'),
  ('Customer', 1, 4, 'addr', true, NULL, true, false, false, ''),
  ('Customer', 2, 0, 'uid', false, NULL, false, false, true, 'unique=true'),
  ('Customer', 2, 1, 'balance', false, NULL, false, false, false, 'flag=true'),
  ('Segment', 3, 0, 'code', false, NULL, false, false, false, ''),
  ('Trigger', 4, 0, 'cronJob', true, 'code', false, false, true, 'unique=true'),
  ('Trigger', 4, 1, 'cronExpression', false, NULL, false, false, false, ''),
  ('Trigger', 4, 2, 'active', false, NULL, false, false, false, ''),
  ('Empty', 5, 0, 'code', false, NULL, false, false, true, 'unique=true'),
  ('Empty', 5, 1, 'label', false, NULL, false, false, false, 'lang=en'),
  ('Empty', 5, 2, 'label', false, NULL, false, false, false, 'lang=de')),
cell AS (SELECT ln.file, ln.block_no, ln.line_no, ln.type, col.pos, CASE WHEN is_macro THEN '$catalog[default=x]' ELSE attr END AS attr,
   trim(string_split(raw, ';')[pos + 2]) AS value FROM ln JOIN col USING (type, block_no) WHERE pos + 2 <= len(string_split(raw, ';')))
"""


def blocks_of(t):
    return I.impex_blocks(gen_impex(t.customer))


@query("blocks_from_lines", f"WITH {IMPEX_SQL} SELECT file, block_no, mode, type, line_no, raw FROM ln")
def blocks_from_lines(t):
    return I.impex_lines(blocks_of(t)).drop("header")


@query("header_columns", f"""
WITH {IMPEX_SQL} SELECT file, block_no, type, pos, attr, is_ref, ref_key, composite, is_macro, is_unique, mods AS modifiers
FROM n, col""")
def header_columns(t):
    c = I.header_columns(blocks_of(t))
    mods = F.array_join(F.array_sort(F.transform(F.map_entries("modifiers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return c.select("file", "block_no", "type", "pos", "attr", "is_ref", "ref_key", "composite", "is_macro", "is_unique",
                    mods.alias("modifiers"))


@query("cells", f"WITH {IMPEX_SQL} SELECT * FROM cell")
def cells(t):
    return I.cells(blocks_of(t)).drop("mode")


RECORD_SQL = f"""
{IMPEX_SQL},
hdr(type, block_no, pos, header) AS (VALUES ('Customer', 1, 0, 'Uid__c'), ('Customer', 1, 1, 'Name__c'), ('Customer', 1, 2, 'Nation__r.Code__c'),
  ('Customer', 2, 0, 'Uid__c'), ('Customer', 2, 1, 'Balance__c'), ('Segment', 3, 0, 'Code__c'), ('Trigger', 4, 0, 'CronJob__r.Code__c'),
  ('Trigger', 4, 1, 'CronExpression__c'), ('Trigger', 4, 2, 'Active__c')),
rec AS (SELECT ln.type || '__c' AS object, mode, ln.file, ln.line_no, header, coalesce(value, '') AS value
  FROM ln JOIN hdr USING (type, block_no) LEFT JOIN cell ON cell.file = ln.file AND cell.line_no = ln.line_no AND cell.pos = hdr.pos)
"""


@query("load_plan", f"WITH {RECORD_SQL} SELECT * FROM rec")
def load_plan(t):
    return I.load_records(blocks_of(t))


@query("load_objects", f"""
WITH {IMPEX_SQL} SELECT DISTINCT type || '__c' AS object, type, CASE type WHEN 'Customer' THEN 'INSERT_UPDATE|UPDATE' WHEN 'Segment' THEN 'REMOVE' ELSE 'INSERT_UPDATE' END AS modes,
  CASE WHEN type = 'Customer' THEN 'addr → addr(street,town(code))' ELSE '' END AS manual_relationships FROM ln
UNION ALL SELECT 'Empty__c', 'Empty', 'INSERT', ''""")
def load_objects(t):
    o = I.load_objects(blocks_of(t))
    return o.withColumn("modes", F.array_join("modes", "|")).withColumn("manual_relationships", F.array_join("manual_relationships", "|"))


@query("load_headers", """
SELECT * FROM (VALUES ('Customer__c', 'Uid__c', 1), ('Customer__c', 'Name__c', 2), ('Customer__c', 'Nation__r.Code__c', 3),
 ('Customer__c', 'Balance__c', 4), ('Segment__c', 'Code__c', 1), ('Trigger__c', 'CronJob__r.Code__c', 1),
 ('Trigger__c', 'CronExpression__c', 2), ('Trigger__c', 'Active__c', 3), ('Empty__c', 'Code__c', 1), ('Empty__c', 'Label__c', 2)) AS v(object, header, ord)""")
def load_headers(t):
    return I.load_headers(blocks_of(t))


@query("external_key", f"""
WITH {IMPEX_SQL} SELECT DISTINCT type || '__c' AS object, CASE WHEN type = 'Customer' THEN 'Uid__c' END AS external_id,
 CASE WHEN type = 'Customer' THEN '' ELSE 'no [unique=true] attribute found — pick an External ID manually before upserting' END AS note FROM ln
UNION ALL SELECT 'Empty__c', 'Code__c', ''""")
def external_key(t):
    return I.external_keys(blocks_of(t))


@query("mark_keys", f"""
WITH {RECORD_SQL} SELECT DISTINCT object, header AS field, header = 'Uid__c' AS uniq, header = 'Uid__c' AS external_id
FROM rec WHERE header NOT LIKE '%.%'
UNION ALL SELECT 'Empty__c', 'Code__c', true, true UNION ALL SELECT 'Empty__c', 'Label__c', false, false""")
def mark_keys(t):
    ls = blocks_of(t)
    schema = I.load_headers(ls).filter(~F.col("header").contains(".")).select(
        "object", F.col("header").alias("field"), F.lit(False).alias("unique"))
    return I.mark_keys(schema, I.external_keys(ls)).withColumnRenamed("unique", "uniq")


@query("load_summary", f"""
WITH {IMPEX_SQL} SELECT type || '__c' AS object, count(*) AS records, CASE WHEN type = 'Customer' THEN 'Uid__c' END AS external_id,
 CASE type WHEN 'Customer' THEN 'INSERT_UPDATE,UPDATE' WHEN 'Segment' THEN 'REMOVE' ELSE 'INSERT_UPDATE' END AS modes FROM ln GROUP BY type
UNION ALL SELECT 'Empty__c', 0, 'Code__c', 'INSERT'""")
def load_summary(t):
    return I.load_summary(blocks_of(t)).withColumn("modes", F.array_join("modes", ","))


@query("impex_triggers", f"""
WITH {IMPEX_SQL} SELECT file, n + 12 AS line_no, 'job' || f AS job_class, '0 0 2 * * ?' AS cron_expression, f % 3 <> 0 AS active, true AS resolved
FROM n WHERE f % 4 <> 1""")
def impex_triggers(t):
    return C.impex_triggers(I.cells(blocks_of(t)))


def gen_beans(orders):
    """files(file, text): per 20 orders a bean chain each; every tenth chain is broken."""
    k = F.col("o_orderkey")
    ks = k.cast("string")
    d = F.col("o_orderdate")
    cron = F.when(k % 9 == 0, F.lit("0 5 *")).otherwise(_cat("0 ", F.minute(d).cast("string"), " ", (k % 24).cast("string"), " ",
                F.when(k % 2 == 0, F.dayofmonth(d).cast("string")).otherwise("?"), " * ",
                F.when(k % 4 == 0, "MON").otherwise("?")))
    link = F.when(k % 10 == 1, _cat('<property name="job"><ref bean="jb', ks, '"/></property>')).otherwise(
        _cat('<property name="cronJob" ref="cj', ks, '"/>'))
    act = F.when(k % 5 == 0, '<property name="active"><value> false </value></property>').otherwise("")
    line = _cat('<bean id="tr', ks, '" class="x.TriggerModel"><property name="cronExpression" value="', cron, '"/>', link, act, "</bean>",
                F.when(k % 10 != 1, _cat('<bean id="cj', ks, '"><property name="job" ref="jb', ks, '"/></bean>')).otherwise(""),
                F.when(k % 10 != 0, _cat('<bean id="jb', ks, '" class="com.shop.jobs.DefaultOrder', ks, 'Job"/>')).otherwise(""))
    rows = orders.select(F.floor(k / 20).alias("file_id"), "o_orderkey", line.alias("line"))
    f = joined(rows, "file_id", "o_orderkey", "line")
    return f.select(_cat("spring/f", F.col("file_id").cast("string"), "-spring.xml").alias("file"),
                    _cat('<beans xmlns="http://x/beans">', F.col("body"), "</beans>").alias("text"))


BEAN_SQL = """
tr AS (SELECT o_orderkey AS k, 'spring/f' || (o_orderkey // 20) || '-spring.xml' AS file, 'tr' || o_orderkey AS bean,
  o_orderkey % 10 <> 0 AS resolved, o_orderkey % 5 <> 0 AS active,
  CASE WHEN o_orderkey % 10 <> 0 THEN 'DefaultOrder' || o_orderkey || 'Job' ELSE '(unresolved: trigger bean ''tr' || o_orderkey || ''')' END AS job_class,
  CASE WHEN o_orderkey % 9 = 0 THEN '0 5 *' ELSE '0 ' || minute(o_orderdate) || ' ' || (o_orderkey % 24) || ' ' ||
    CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate)::VARCHAR ELSE '?' END || ' * ' || CASE WHEN o_orderkey % 4 = 0 THEN 'MON' ELSE '?' END END AS cron_expression
  FROM orders)
"""


def triggers_of(t):
    return C.spring_triggers(C.beans(gen_beans(t.orders)))


@query("spring_triggers", f"WITH {BEAN_SQL} SELECT file, bean, job_class, cron_expression, active, resolved FROM tr")
def spring_triggers(t):
    return triggers_of(t)


@query("schedule_checks", f"""
WITH {BEAN_SQL} SELECT bean, CASE WHEN k % 9 = 0 THEN 'Expected 6 or 7 cron fields (seconds..[year]), got 3: ''0 5 *'''
  WHEN k % 4 = 0 THEN 'Both day-of-month and day-of-week are concrete values; Salesforce requires one of them to be ''?''.' ELSE '' END AS warnings FROM tr""")
def schedule_checks(t):
    return triggers_of(t).select("bean", F.array_join(C.cron_warnings(F.col("cron_expression")), "; ").alias("warnings"))


@query("schedule_plan", f"""
WITH {BEAN_SQL} SELECT file, job_class, cron_expression, CASE WHEN resolved THEN 'Order' || k || 'Scheduler' END AS scheduler,
  CASE WHEN NOT resolved THEN 'unresolved' WHEN active THEN 'scheduled' ELSE 'inactive' END AS disposition FROM tr""")
def schedule_plan(t):
    return C.schedule_plan(triggers_of(t)).drop("warnings")


@query("schedule_counts", f"""
WITH {BEAN_SQL} SELECT count(*) FILTER (resolved) AS resolved_count, count(*) FILTER (NOT resolved) AS unresolved_count FROM tr""")
def schedule_counts(t):
    return C.schedule_counts(triggers_of(t))


def gen_process(events):
    """files(file, text): one process per 40 events; each 17th malformed, each 11th another root."""
    e = F.col("event_id")
    es, nxt = e.cast("string"), (e + 1).cast("string")
    f = F.floor(e / 40)
    unit = _unit(f)
    low = F.concat(F.lit("u"), F.substring(unit, F.lit(2), F.length(unit)))
    t = F.col("event_type")
    line = (F.when(t == "click", _cat('<action id="s', es, '" bean="', low, '"><transition name="OK" to="s', nxt, '"/></action>'))
            .when(t == "view", _cat('<action id="s', es, '" bean="shop.', low, '"><transition name="OK" to="s', nxt,
                                    '"/><transition name="RETRY" to="s', es, '"/></action>'))
            .when(t == "purchase", _cat('<scriptAction id="s', es, '" bean="ghost.Action"><transition name="OK" to="s', nxt, '"/></scriptAction>'))
            .when(t == "error", _cat('<wait id="s', es, '" then="s', nxt, '"><event>ev', es, '</event><timeout delay="PT',
                                     (e % 5).cast("string"), 'H" then="s', (F.floor(e / 40) * 40).cast("string"), '"/></wait>'))
            .otherwise(_cat('<end id="s', es, '" state="SUCCEEDED">done</end>')))
    rows = events.select(f.alias("file_id"), "event_id", line.alias("line"))
    j = joined(rows, "file_id", "event_id", "line")
    n = F.col("file_id")
    ns = n.cast("string")
    root = F.when(n % 11 == 7, "items").otherwise("process")
    start = F.when(n % 3 != 0, _cat(' start="s', (n * 40 + 1).cast("string"), '"')).otherwise("")
    text = _cat('<?xml version="1.0"?>\n<', root, ' xmlns="http://x/p" name="proc-', ns, '"', start, ">", F.col("body"),
                F.when(n % 17 == 4, "<open>").otherwise(""), "</", root, ">")
    return j.select(_cat("process/f", ns, ".xml").alias("file"), text.alias("text"))


PROC_SQL = f"""
{CODE_SQL},
pf AS (SELECT file_id AS f, cls, 'process/f' || file_id || '.xml' AS pfile, file_id % 17 = 4 AS unreadable,
   CASE WHEN file_id % 17 = 4 THEN 'f' || file_id ELSE 'proc-' || file_id END AS process FROM cls WHERE file_id % 11 <> 7),
nd AS (SELECT pf.*, e.event_id AS id, 's' || e.event_id AS node, CASE event_type WHEN 'error' THEN 'wait' WHEN 'signup' THEN 'end' ELSE 'action' END AS kind,
   event_type, CASE WHEN event_type IN ('click', 'view') THEN pf.cls ELSE '' END AS impl, e.event_id + 1 = (e.file_id + 1) * 40 OR e.event_id = (SELECT max(event_id) FROM events) AS is_last
   FROM pf JOIN ev e ON e.file_id = pf.f WHERE NOT unreadable),
eg AS (SELECT *, 0 AS ord, CASE event_type WHEN 'error' THEN 'then' ELSE 'OK' END AS name, 's' || (id + 1) AS target FROM nd WHERE event_type <> 'signup'
   UNION ALL SELECT *, 1, 'RETRY', node FROM nd WHERE event_type = 'view'
   UNION ALL SELECT *, 1, 'timeout', 's' || (f * 40) FROM nd WHERE event_type = 'error'),
conv AS (SELECT cls AS impl FROM cls WHERE file_id % 2 = 0)
"""


def procs_of(t):
    return W.process_files(gen_process(t.events))


def code_classes(t):
    return t.events.select(_unit(F.floor(F.col("event_id") / 40)).alias("class_name")).distinct()


def even_classes(t):
    f = F.floor(F.col("event_id") / 40)
    return t.events.filter(f % 2 == 0).select(_unit(f).alias("class_name")).distinct()


def resolved(t, p):
    return settled(W.resolve_bean(W.process_nodes(p), code_classes(t)), "nodes")


@query("process_tables", f"""
WITH {PROC_SQL}
SELECT pf.pfile AS file, pf.process, CASE WHEN NOT pf.unreadable AND f % 3 <> 0 THEN 's' || (f * 40 + 1) END AS start, pf.unreadable,
  (SELECT count(*) FROM nd WHERE nd.f = pf.f AND kind = 'action') AS actions, (SELECT count(*) FROM nd WHERE nd.f = pf.f AND kind = 'wait') AS flow_nodes,
  (SELECT count(*) FROM nd WHERE nd.f = pf.f AND kind = 'end') AS ends, (SELECT count(*) FROM eg WHERE eg.f = pf.f) AS transitions FROM pf""")
def process_tables(t):
    p = procs_of(t)
    return W.process_tables(p, W.process_nodes(p))


@query("process_edges", f"WITH {PROC_SQL} SELECT pfile AS file, process, node, ord, name, target FROM eg")
def process_edges(t):
    return W.process_edges(W.process_nodes(procs_of(t)))


@query("resolve_bean", f"WITH {PROC_SQL} SELECT pfile AS file, node, impl AS implemented_by FROM nd")
def resolve_bean(t):
    return resolved(t, procs_of(t)).select("file", "node", "implemented_by")


@query("process_summary", f"""
WITH {PROC_SQL}
SELECT (SELECT count(*) FROM pf) AS processes, count(*) FILTER (kind = 'action') AS actions, (SELECT count(*) FROM pf WHERE unreadable) AS unreadable,
 (SELECT count(*) FROM eg) AS transitions, (SELECT count(*) FROM pf WHERE NOT unreadable) AS scaffolded, count(*) FILTER (impl <> '') AS actions_resolved,
 count(*) FILTER (impl IN (SELECT impl FROM conv)) AS wired,
 count(*) FILTER (kind = 'action' AND impl NOT IN (SELECT impl FROM conv)) + count(*) FILTER (event_type = 'view') + count(*) FILTER (kind = 'wait') AS review_items
FROM nd""")
def process_summary(t):
    p = procs_of(t)
    return W.process_summary(W.process_tables(p, W.process_nodes(p)), W.coverage(resolved(t, p), even_classes(t)))


@query("covered_classes", f"WITH {PROC_SQL} SELECT DISTINCT impl AS class_name FROM nd WHERE impl <> ''")
def covered_classes(t):
    return W.covered_classes(resolved(t, procs_of(t)))


@query("process_ledger", f"""
WITH {PROC_SQL}
SELECT process AS source, pfile AS file, CASE WHEN unreadable THEN 'unreadable' WHEN f % 5 <> 0 THEN 'scaffolded' ELSE 'manual' END AS outcome,
  CASE WHEN NOT unreadable AND f % 5 <> 0 THEN 'flows/proc_' || f ELSE '—' END AS target,
  (SELECT count(*) FROM nd WHERE nd.f = pf.f AND impl IN (SELECT impl FROM conv)) AS wired,
  (SELECT count(*) FROM nd WHERE nd.f = pf.f AND kind = 'action') AS actions, (SELECT count(*) FROM eg WHERE eg.f = pf.f) AS transitions FROM pf""")
def process_ledger(t):
    p = procs_of(t)
    f = F.floor(F.col("event_id") / 40)
    flows = t.events.filter(f % 5 != 0).select(_cat("proc-", f.cast("string")).alias("process")).distinct()
    return W.process_ledger(W.process_tables(p, W.process_nodes(p)), W.coverage(resolved(t, p), even_classes(t)), flows)


@query("flow_topology", f"""
WITH {PROC_SQL},
st AS (SELECT pf.f, coalesce(CASE WHEN f % 3 <> 0 THEN (SELECT min(node) FROM nd WHERE nd.f = pf.f AND id = pf.f * 40 + 1) END,
    (SELECT arg_min(node, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END * 1000000000 + id) FROM nd WHERE nd.f = pf.f AND kind = 'action')) AS start FROM pf),
base AS (SELECT nd.pfile AS file, nd.process, nd.node AS element, kind, impl IN (SELECT impl FROM conv) AS wired, coalesce(nd.node = st.start, false) AS is_start,
   CASE WHEN kind = 'wait' THEN nullif(nd.id % 5 * 60, 0) END AS minutes, event_type, nd.id, is_last, nd.f FROM nd JOIN st USING (f))
SELECT file, process, element, kind, wired, is_start, minutes, CASE event_type WHEN 'signup' THEN 'none' WHEN 'view' THEN 'decision' ELSE 'connector' END AS link,
  CASE WHEN event_type = 'view' THEN 'OK' END AS outcome, CASE WHEN event_type <> 'signup' AND NOT is_last THEN 's' || (id + 1) END AS target FROM base
UNION ALL SELECT file, process, element, kind, wired, is_start, minutes, 'decision', 'RETRY', element FROM base WHERE event_type = 'view'
UNION ALL SELECT file, process, element, kind, wired, is_start, minutes, 'connector', NULL, 's' || (f * 40) FROM base WHERE event_type = 'error'""")
def flow_topology(t):
    p = procs_of(t)
    return W.flow_topology(resolved(t, p), p, even_classes(t))


@query("review_notes", f"""
WITH {PROC_SQL}
SELECT pfile AS file, process, node, CASE WHEN impl = '' THEN 'bean did not resolve to a class' ELSE 'class was not generated' END AS note
  FROM nd WHERE kind = 'action' AND impl NOT IN (SELECT impl FROM conv)
UNION ALL SELECT pfile, process, node, 'branches 2 ways' FROM nd WHERE event_type = 'view'
UNION ALL SELECT pfile, process, node, 'resume event is not wired' FROM nd WHERE kind = 'wait'""")
def review_notes(t):
    return W.review_notes(resolved(t, procs_of(t)), even_classes(t))


@query("duration_minutes", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 100 = 0 THEN NULL ELSE event_id % 100 * 60 END
  WHEN 1 THEN (event_id % 9) * 1440 + 150 WHEN 2 THEN CASE WHEN event_id % 60 > 0 THEN 1 END WHEN 3 THEN NULL
  WHEN 4 THEN greatest(event_id % 50, 1) ELSE NULL END AS minutes FROM events""")
def duration_minutes(t):
    e = F.col("event_id")
    n = lambda m: (e % m).cast("string")
    text = (F.when(e % 6 == 0, _cat("PT", n(100), "H")).when(e % 6 == 1, _cat("P", n(9), "DT2H30M"))
            .when(e % 6 == 2, _cat("PT", n(60), "S")).when(e % 6 == 3, _cat("4H", n(10)))
            .when(e % 6 == 4, _cat(" PT", n(50), "M12S ")).otherwise("P"))

    return t.events.select("event_id", N.duration_minutes(text).cast("bigint").alias("minutes"))
