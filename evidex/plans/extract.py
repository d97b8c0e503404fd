"""Extraction operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.functions import text as T
from evidex.operators import extract as X
from evidex.operators.scale import computed
from evidex.plans.corpora import CODE_SQL, gen_code, gen_components
from evidex.plans.registry import query
from evidex.plans.text import PAGE_SQL, page_files

PART_SQL = """
pc AS (SELECT p_partkey, p_size, p_brand,
  (CASE WHEN p_partkey % 7 = 0 THEN 'Default' ELSE '' END) || list_aggregate(list_transform(
     string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') ||
  ['Controller','Resource','Facade','Service','Dao','DAO','Repository','Data','DTO','Model','Job','Helper'][(p_size % 12) + 1] AS cls
  FROM part)
"""


def part_classes(t):
    """Parts as class names: words of the name plus one of twelve endings."""
    ends = F.array(*[F.lit(s) for s in (
        "Controller", "Resource", "Facade", "Service", "Dao", "DAO", "Repository", "Data", "DTO",
        "Model", "Job", "Helper")])
    lead = F.when(F.col("p_partkey") % 7 == 0, F.lit("Default")).otherwise(F.lit(""))
    name = F.concat(lead, F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")),
                    F.get(ends, F.col("p_size") % 12))
    return computed(t.part.select("p_partkey", "p_name", "p_size", "p_brand"), class_name=name)


@query("infer_layer", f"""
WITH {PART_SQL}
SELECT p_partkey, cls AS class_name, CASE
  WHEN p_partkey % 50 = 1 THEN 'Job' WHEN p_partkey % 50 = 2 THEN 'Job'
  WHEN p_partkey % 11 = 0 THEN 'Controller' WHEN p_partkey % 13 = 0 THEN 'DAO'
  WHEN p_size % 12 = 10 THEN 'Job' WHEN p_size % 12 IN (0, 1) THEN 'Controller' WHEN p_size % 12 = 2 THEN 'Facade'
  WHEN p_size % 12 = 3 THEN 'Service' WHEN p_size % 12 IN (4, 5, 6) THEN 'DAO'
  WHEN p_size % 12 IN (7, 8, 9) THEN 'Model' ELSE 'Utility' END AS layer FROM pc""")
def infer_layer(t):
    k = F.col("p_partkey")
    ann = F.when(k % 11 == 0, F.array(F.lit("Generated"), F.lit("RestController"), F.lit("Service"))).when(
        k % 13 == 0, F.array(F.lit("Repository"))).otherwise(F.array(F.lit("Generated")))
    ext = F.when(k % 50 == 1, F.lit("AbstractJobPerformable"))
    imp = F.when(k % 50 == 2, F.array(F.lit("Serializable"), F.lit("JobPerformable")))
    return part_classes(t).select("p_partkey", "class_name", N.infer_layer(
        F.col("class_name"), ann, ext, imp).alias("layer"))


CLASS_SQL = f"""
{CODE_SQL},
layers AS (SELECT *, CASE WHEN file_id % 10 = 3 THEN 'Job' WHEN file_id % 2 = 0 THEN 'Service'
   ELSE ['Service','DAO','Facade','Controller','Job'][(file_id % 5) + 1] END AS layer,
   CASE WHEN file_id % 10 = 3 THEN 'AbstractJobPerformable' ELSE 'Base' || (file_id % 5) END AS base FROM cls),
ms AS (SELECT file_id, count(*) AS n, string_agg('m' || event_id || ':' || CASE event_type WHEN 'signup' THEN 'String'
   WHEN 'click' THEN 'void' WHEN 'error' THEN 'void' WHEN 'purchase' THEN 'Object' ELSE 'int' END || ':' ||
   CASE event_type WHEN 'signup' THEN 'int a String b' WHEN 'error' THEN 'List items' WHEN 'purchase' THEN 'String k' ELSE '' END,
   '|' ORDER BY event_id) AS methods, bool_or(event_type = 'purchase') AS buys, bool_or(event_type = 'error') AS errs
   FROM code GROUP BY file_id)
"""


@query("class_table", f"""
WITH {CLASS_SQL}
SELECT file, cls AS class_name, layer, CASE WHEN file_id % 2 = 0 THEN 'Service' ELSE 'Tagged' END AS annotations,
  'peer:' || peer || '|label:String|cache:Map' AS fields, 'getLabel:String:|' || methods AS methods, n + 1 AS n_methods
FROM layers JOIN ms USING (file_id)""")
def class_table(t):
    c = X.class_table(gen_code(t.events))
    params = lambda m: F.array_join(F.transform(m["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), " ")
    return c.select(
        "file", "class_name", "layer", F.array_join("annotations", "|").alias("annotations"),
        F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"])), "|").alias("fields"),
        F.array_join(F.transform("methods", lambda m: F.concat_ws(
            ":", m["name"], m["return_type"], params(m))), "|").alias("methods"),
        F.size("methods").cast("bigint").alias("n_methods"))


@query("type_reference_edges", f"""
WITH {CODE_SQL} SELECT cls AS src, peer AS dst FROM cls WHERE cls <> peer""")
def type_reference_edges(t):
    return X.type_reference_edges(X.class_table(gen_code(t.events)))


COMP_SQL = f"""
{PAGE_SQL},
pg AS (SELECT page_id, 'Page' || page_id || 'Component' AS class_name, path, html,
   'Host' || (length(path) % 5) || 'Service' AS s1, 'Lang' || (page_id % 3) || 'Service' AS s2,
   len(regexp_extract_all(html, '<li>')) AS n_links FROM p)
"""


@query("component_table", f"""
WITH {COMP_SQL}
SELECT class_name, path AS selector, s1 || '|' || s2 AS injected, n_links,
  'load|total' AS methods, md5(html) AS template_md5, '.a' || page_id || '{{}}' || chr(10) || '.b{{}}' AS styles,
  array_to_string(list_sort([class_name_ref FOR class_name_ref IN [s1, s2, 'Store']]), '|') AS refs FROM pg""")
def component_table(t):
    c = X.component_table(gen_components(t.pages))
    return c.select("class_name", "selector", F.array_join("injected", "|").alias("injected"),
                    F.size("inputs").cast("bigint").alias("n_links"), F.array_join("methods", "|").alias("methods"),
                    F.md5("template").alias("template_md5"), "styles",
                    F.array_join("referenced_types", "|").alias("refs"))


@query("attach_service_source", f"""
WITH {COMP_SQL}, svc AS (SELECT DISTINCT 'Lang' || (page_id % 3) || 'Service' AS s FROM pages WHERE page_id % 3 < 2)
SELECT class_name, s2 AS service, 'export class ' || s2 || ' {{}}' AS text FROM pg JOIN svc ON svc.s = pg.s2""")
def attach_service_source(t):
    files = gen_components(t.pages)
    return X.attach_service_source(X.component_table(files), X.service_sources(files))


@query("skipped_glue_rows", f"""
WITH {PAGE_SQL}
SELECT CASE WHEN page_id % 2 = 0 THEN 'Glue' || page_id ELSE 'g' || page_id || CASE WHEN page_id % 3 = 0 THEN '.module' ELSE '.model' END END AS class_name,
  CASE WHEN page_id % 3 = 0 THEN 'Module' ELSE 'Model' END AS layer,
  CASE WHEN page_id % 3 = 0 THEN 'Angular NgModule — framework glue, no business logic'
    ELSE 'TypeScript interface — type declaration only (maps to existing SObject fields)' END AS reason
FROM p WHERE page_id % 3 < 2""")
def skipped_glue_rows(t):
    k = F.col("page_id")
    end = F.when(k % 3 == 0, ".module.ts").when(k % 3 == 1, ".model.ts").otherwise(".ts")
    text = F.when(k % 2 == 0, F.concat(F.lit("export class Glue"), k.cast("string"), F.lit(" {}"))).otherwise(F.col("text"))
    files = page_files(t).select(F.concat(F.lit("g"), k.cast("string"), end).alias("name"), text.alias("text"))
    return X.skipped_glue_rows(files)


@query("symbol_table", f"""
WITH {CODE_SQL}
SELECT file, 'getLabel' AS name, 15 AS line_start, 15 AS line_end FROM cls
UNION ALL SELECT file, 'm' || event_id, line0, line0 + n_lines - 1 FROM code""")
def symbol_table(t):
    files = gen_code(t.events).select("file", T.strip_code_comments(F.col("text")).alias("text"))
    return X.symbol_table(files).drop("ord")


@query("public_signatures", f"""
WITH {CODE_SQL}
SELECT file, cls || '.getLabel() : String' AS signature FROM cls
UNION ALL SELECT file, cls || '.m' || event_id || CASE event_type WHEN 'signup' THEN '(int a, String b) : String'
  WHEN 'click' THEN '() : void' WHEN 'error' THEN '(List items) : void' WHEN 'purchase' THEN '(String k) : Object'
  ELSE '() : int' END FROM code""")
def public_signatures(t):
    files = gen_code(t.events)
    return X.public_signatures(files.withColumn("class_name", T.file_stem(F.col("name"))))


NAME_SQL = """
nm AS (SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 'test' WHEN p_partkey % 3 = 1 THEN 'should' ELSE '' END)
  || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')
  || '_' || p_size AS name, p_size || '-' || p_name || '!!' AS raw, p_name FROM part)
"""


@query("name_columns", f"""
WITH {NAME_SQL}
SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' ' || p_size AS readable
FROM nm JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)""")
def name_columns(t):
    k = F.col("p_partkey")
    lead = F.when(k % 3 == 0, "test").when(k % 3 == 1, "should").otherwise("")
    name = F.concat(lead, F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", N.readable(name).alias("readable"))


@query("safe_name_and_label", """
SELECT p_partkey, 'X' || p_size || '_' || replace(p_name, ' ', '_') AS api,
  upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' ||
  upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' ' || p_size AS label FROM part""")
def safe_name_and_label(t):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_name"), F.lit("!!"))
    camel = F.concat(F.substring_index("p_name", " ", 1), F.initcap(F.substring_index("p_name", " ", -1)),
                     F.lit("_"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", N.safe_name(raw).alias("api"), N.label(camel).alias("label"))


SLIM_SQL = f"""
{CODE_SQL},
slim0 AS (SELECT file, file_id, text, '// imports: de.hybris.platform, org.springframework.stereotype' || chr(10) ||
  replace(replace(text, 'import java.util.List;' || chr(10) || 'import de.hybris.platform.servicelayer.model' ||
    (file_id % 3) || '.ModelService;' || chr(10) || 'import org.springframework.stereotype.Service;' || chr(10) || chr(10), ''),
    '    public String getLabel() {{ return label; }}', '') || chr(10) || chr(10) || '// (1 trivial getter/setter(s) omitted — no logic)' || chr(10) AS cut
  FROM cls),
slim AS (SELECT file, file_id, length(text) AS original, 1 - length(cut) / length(text) >= 0.05 AS applied,
  CASE WHEN 1 - length(cut) / length(text) >= 0.05 THEN cut ELSE text END AS slimmed_text FROM slim0)
"""


@query("slim_text", f"""
WITH {SLIM_SQL}
SELECT file, original, length(slimmed_text) AS slimmed, md5(slimmed_text) AS text_md5, applied,
  CASE WHEN applied THEN round_even(100 * (1 - length(slimmed_text) / original), 0)::BIGINT ELSE 0 END AS saved_pct,
  CASE WHEN applied THEN 3 ELSE 0 END AS imports_removed, CASE WHEN applied THEN 1 ELSE 0 END AS accessors_removed FROM slim""")
def slim_text(t):
    s = X.slim_text(gen_code(t.events))
    return s.select("file", "slim.original", "slim.slimmed", F.md5("slim.text").alias("text_md5"), "slim.applied",
                    "slim.saved_pct", "slim.imports_removed", "slim.accessors_removed")


@query("import_summary", f"""
WITH {CODE_SQL} SELECT file, 'de.hybris.platform, org.springframework.stereotype' AS imports FROM cls""")
def import_summary(t):
    return gen_code(t.events).select("file", X.import_summary(F.col("text")).alias("imports"))


@query("slim_stats", f"""
WITH {SLIM_SQL}
SELECT file_id % 7 AS unit, count(*) AS classes, count(*) FILTER (applied) AS slimmed, sum(original)::BIGINT AS before,
  sum(length(slimmed_text))::BIGINT AS after, round_even(100 * (1 - sum(length(slimmed_text)) / sum(original)), 0)::BIGINT AS saved_pct
FROM slim GROUP BY 1""")
def slim_stats(t):
    files = gen_code(t.events).withColumn("unit", F.col("file_id") % 7)
    return X.slim_stats(X.slim_text(files), ["unit"])


@query("infer_field_type", """
SELECT 'M' || event_id || '__c' AS field, CASE event_type WHEN 'signup' THEN 'Text' WHEN 'view' THEN 'Number' ELSE 'Text' END AS type
FROM events UNION ALL SELECT 'Label__c', 'Text' UNION ALL SELECT 'A__c', 'Number' UNION ALL SELECT 'Nowhere__c', 'Text'""")
def infer_field_type(t):
    asked = t.events.select(F.concat(F.lit("M"), F.col("event_id").cast("string"), F.lit("__c")).alias("field"))
    extra = t.spark.createDataFrame([("Label__c",), ("A__c",), ("Nowhere__c",)], "field string")
    return X.infer_field_type(asked.unionByName(extra), gen_code(t.events))


@query("domain_key", f"""
WITH {PART_SQL}, n AS (SELECT p_partkey, regexp_replace(cls, '^Default', '') AS c, cls FROM pc)
SELECT p_partkey, regexp_replace(c, '(Dao|DAO|Service|Facade|Controller|Data|Job)$', '') AS domain,
  regexp_replace(cls, '(Controller|Service)$', '') AS ui_domain FROM n""")
def domain_key(t):
    c = F.col("class_name")
    return part_classes(t).select("p_partkey", N.domain_key(c).alias("domain"), N.ui_domain_key(c).alias("ui_domain"))


@query("discovery_counts", f"""
WITH {CLASS_SQL}
SELECT layer, count(*) AS classes, sum(len(string_split(text, chr(10))))::BIGINT AS loc FROM layers GROUP BY layer""")
def discovery_counts(t):
    return X.discovery_counts(X.class_table(gen_code(t.events)))


@query("class_profile", f"""
WITH {CLASS_SQL}
SELECT cls AS class_name, layer || ' class: ' || cls AS purpose, n + 1 AS n_inputs, n + 1 AS n_outputs,
  array_to_string(list_sort(list_distinct([x FOR x IN [base, CASE WHEN peer <> cls THEN peer END,
     CASE WHEN buys THEN 'FlexibleSearchQuery' END] IF x IS NOT NULL])), '|') AS dependencies,
  CASE WHEN n + 1 > 8 THEN 'High' ELSE 'Medium' END AS complexity, len(string_split(text, chr(10))) AS loc,
  n + 1 AS n_methods
FROM layers JOIN ms USING (file_id)""")
def class_profile(t):
    p = X.class_profile(X.class_table(gen_code(t.events)))
    n = lambda c: F.size(c).cast("bigint")
    return p.select("class_name", "purpose", n("inputs").alias("n_inputs"), n("outputs").alias("n_outputs"),
                    F.array_join("dependencies", "|").alias("dependencies"), "complexity", "loc",
                    n("methods").alias("n_methods"))


@query("discovery_summary", f"""
WITH {CODE_SQL} SELECT count(*) AS classes, sum(len(string_split(text, chr(10))))::BIGINT AS loc, count(DISTINCT file_id) AS domains,
  (SELECT count(DISTINCT p_brand) FROM part) AS objects, (SELECT count(*) FROM orders) AS processes FROM cls""")
def discovery_summary(t):
    c = X.class_table(gen_code(t.events))
    return X.discovery_summary(c, t.part.select(F.col("p_brand").alias("object")), t.orders)
