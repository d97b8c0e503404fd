"""Text formats written by Spark from the driver tables, so that the table is the oracle.

Every file is a block of consecutive ids, so its size is bounded whatever the keys do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS_PER_FILE = 40
HEADER_LINES = 15


def joined(rows: DataFrame, key: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """Concatenate the ordered lines of each bounded block."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    # A given partition count keeps AQE from folding the CPU-heavy scans into one task.
    return rows.repartition(n, key).groupBy(key).agg(
        F.array_join(F.transform(parts, lambda x: x[text]), sep).alias("body"))


def _unit(n: Column) -> Column:
    kinds = F.array(*[F.lit(s) for s in ("Service", "Dao", "Facade", "Controller", "Job")])
    return F.concat(F.lit("Unit"), n.cast("string"), F.get(kinds, (n % 5).cast("int")))


def gen_code(events: DataFrame) -> DataFrame:
    """files(file_id, file, name, suffix, text, length): one class per 40 events.

    The peer of file n is file n div 2, so class references form a DAG.
    """
    e, t = F.col("event_id").cast("string"), F.col("event_type")
    body = (
        F.when(t == "signup", F.concat(
            F.lit("    public String m"), e, F.lit("(int a, String b) {\n"
            '        return "for (;;) { modelService.save(q); }";\n    }')))
        .when(t == "click", F.concat(
            F.lit("    public void m"), e, F.lit("() {\n        modelService.save(item); q.setCount(5);\n"
            "        peer.m"), (F.floor(F.col("file_id") / 2) * EVENTS_PER_FILE).cast("string"),
            F.lit("();\n    }")))
        .when(t == "error", F.concat(
            F.lit("    public void m"), e, F.lit("(List items) {\n        for (Object item : items) {\n"
            "            modelService.save(item);\n        }\n    }")))
        .when(t == "purchase", F.concat(
            F.lit("    @Transactional\n    public Object m"), e, F.lit(
                "(String k) {\n        while (it.hasNext()) { flexibleSearchService.search(\"a { b\"); }\n"
                '        return new FlexibleSearchQuery("x");\n    }')))
        .otherwise(F.concat(
            F.lit("    public int m"), e, F.lit(
                "() {\n        for (int i = 0; i < n; i++) priceService.getTotal(i);\n"
                "        while (x) {\n            flexibleSearchService.search(q); // comment }\n"
                "        }\n    }"))))
    rows = events.select(F.floor(F.col("event_id") / EVENTS_PER_FILE).alias("file_id"),
                         "event_id", body_of(body))
    files = joined(rows, "file_id", "event_id", "line")
    n = F.col("file_id")
    head = F.concat(
        F.lit("package com.shop.unit"), (n % 7).cast("string"), F.lit(";\n\nimport java.util.List;\n"
        "import de.hybris.platform.servicelayer.model"), (n % 3).cast("string"),
        F.lit(".ModelService;\nimport org.springframework.stereotype.Service;\n\n"
              "/* modelService.save(x) while (true) {\n   flexibleSearchService.search(y) */\n"
              "@"), F.when(n % 2 == 0, "Service").otherwise("Tagged"), F.lit("\npublic class "),
        _unit(n), F.lit(" extends "),
        F.when(n % 10 == 3, F.lit("AbstractJobPerformable"))
        .otherwise(F.concat(F.lit("Base"), (n % 5).cast("string"))),
        F.lit(" {\n    private "), _unit(F.floor(n / 2)), F.lit(" peer;\n    private String label;\n"
              "    private static Map cache;\n    // new Thread() modelService.save(z)\n"
              "    public String getLabel() { return label; }\n"))
    out = files.select(
        "file_id", F.concat(F.lit("src/"), _unit(n), F.lit(".java")).alias("file"),
        F.concat(_unit(n), F.lit(".java")).alias("name"), F.lit(".java").alias("suffix"),
        F.concat(head, F.col("body"), F.lit("\n}")).alias("text"))
    return out.withColumn("length", F.length("text"))


def body_of(c: Column) -> Column:
    return c.alias("line")


# The same layout for the SQL twins: the text itself, and one row per event with its first line.
CODE_SQL = """
ev AS (
  SELECT event_id, event_type, event_id // 40 AS file_id,
    'Unit' || (event_id // 40) || ['Service','Dao','Facade','Controller','Job'][((event_id // 40) % 5) + 1] AS cls,
    'Unit' || (event_id // 80) || ['Service','Dao','Facade','Controller','Job'][((event_id // 80) % 5) + 1] AS peer,
    CASE event_type WHEN 'signup' THEN 3 WHEN 'click' THEN 4 WHEN 'error' THEN 5
                    WHEN 'purchase' THEN 5 ELSE 6 END AS n_lines,
    replace(CASE event_type
      WHEN 'signup' THEN '    public String m' || event_id || '(int a, String b) {~        return "for (;;) { modelService.save(q); }";~    }'
      WHEN 'click' THEN '    public void m' || event_id || '() {~        modelService.save(item); q.setCount(5);~        peer.m' || (40 * (event_id // 80)) || '();~    }'
      WHEN 'error' THEN '    public void m' || event_id || '(List items) {~        for (Object item : items) {~            modelService.save(item);~        }~    }'
      WHEN 'purchase' THEN '    @Transactional~    public Object m' || event_id || '(String k) {~        while (it.hasNext()) { flexibleSearchService.search("a { b"); }~        return new FlexibleSearchQuery("x");~    }'
      ELSE '    public int m' || event_id || '() {~        for (int i = 0; i < n; i++) priceService.getTotal(i);~        while (x) {~            flexibleSearchService.search(q); // comment }~        }~    }' END, '~', chr(10)) AS body
  FROM events),
code AS (
  SELECT *, 16 + COALESCE(SUM(n_lines) OVER (PARTITION BY file_id ORDER BY event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line0,
    'src/' || cls || '.java' AS file
  FROM ev),
cls AS (SELECT file_id, cls, peer, file,
    'package com.shop.unit' || (file_id % 7) || ';' || chr(10) || chr(10) || 'import java.util.List;' || chr(10) ||
    'import de.hybris.platform.servicelayer.model' || (file_id % 3) || '.ModelService;' || chr(10) ||
    'import org.springframework.stereotype.Service;' || chr(10) || chr(10) ||
    '/* modelService.save(x) while (true) {' || chr(10) || '   flexibleSearchService.search(y) */' || chr(10) ||
    CASE WHEN file_id % 2 = 0 THEN '@Service' ELSE '@Tagged' END || chr(10) || 'public class ' || cls || ' extends ' ||
    CASE WHEN file_id % 10 = 3 THEN 'AbstractJobPerformable' ELSE 'Base' || (file_id % 5) END || ' {' || chr(10) ||
    '    private ' || peer || ' peer;' || chr(10) || '    private String label;' || chr(10) ||
    '    private static Map cache;' || chr(10) || '    // new Thread() modelService.save(z)' || chr(10) ||
    '    public String getLabel() { return label; }' || chr(10) || string_agg(body, chr(10) ORDER BY event_id) ||
    chr(10) || '}' AS text, string_agg(body, chr(10) ORDER BY event_id) AS bodies
  FROM code GROUP BY file_id, cls, peer, file)
"""

# Hazards the generated code holds, straight from the events.
HAZARD_SQL = """
haz AS (
  SELECT 'DML_IN_LOOP' AS rule, 'critical' AS severity, file, cls AS source_class, line0 + 2 AS line,
         'modelService.save(item);' AS snippet FROM code WHERE event_type = 'error'
  UNION ALL SELECT 'DAO_CALL_IN_LOOP', 'high', file, cls, line0 + 1,
         'for (int i = 0; i < n; i++) priceService.getTotal(i);' FROM code WHERE event_type = 'view'
  UNION ALL SELECT 'DAO_CALL_IN_LOOP', 'high', file, cls, line0 + 3,
         'flexibleSearchService.search(q);' FROM code WHERE event_type = 'view'
  UNION ALL SELECT 'SOQL_IN_LOOP', 'critical', file, cls, line0 + 3,
         'flexibleSearchService.search(q);' FROM code WHERE event_type = 'view'
  UNION ALL SELECT 'TRANSACTIONAL', 'high', file, cls, line0, '@Transactional'
         FROM code WHERE event_type = 'purchase'
  UNION ALL SELECT 'STATIC_MUTABLE_STATE', 'medium', file, cls, 13,
         'private static Map cache;' FROM cls)
"""


def gen_components(pages: DataFrame) -> DataFrame:
    """files(file, name, suffix, text): a component, its template and styles per page, three services."""
    from evidex.functions.text import file_name, file_suffix
    from evidex.sources.files import url_path

    k = F.col("page_id").cast("string")
    path = url_path(F.col("url"))
    links = F.regexp_count("html", F.lit("<li>"))
    inputs = F.array_join(F.transform(
        F.when(links > 0, F.sequence(F.lit(1), links)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("  @Input() link"), i.cast("string"), F.lit(": string;\n"))), "")
    lang = F.concat(F.lit("Lang"), (F.col("page_id") % 3).cast("string"), F.lit("Service"))
    text = F.concat(
        F.lit("import { Component, Input } from '@angular/core';\n@Component({ selector: '"), path,
        F.lit("', templateUrl: './view/../page"), k, F.lit(".html',\n  styleUrls: ['./page"), k,
        F.lit(".css', './base"), k, F.lit(".css'] })\nexport class Page"), k,
        F.lit("Component implements OnInit {\n"), inputs,
        F.lit("  @Output() done = 1;\n  constructor(private readonly a: Host"),
        (F.length(path) % 5).cast("string"), F.lit("Service, private b: "), lang,
        F.lit(", private c: Store) {}\n  ngOnInit() {\n  }\n  load(): void {\n  }\n"
              "  get total(): number {\n  }\n}\n"))
    base = F.concat(F.lit("app/page"), k)
    rows = F.array(
        F.struct(F.concat(base, F.lit(".component.ts")).alias("file"),
                 text.alias("text")),
        F.struct(F.concat(base, F.lit(".html")).alias("file"), F.col("html").alias("text")),
        F.struct(F.concat(base, F.lit(".css")).alias("file"),
                 F.concat(F.lit(".a"), k, F.lit("{}")).alias("text")),
        F.struct(F.concat(F.lit("app/base"), k, F.lit(".css")).alias("file"), F.lit(".b{}").alias("text")))
    made = pages.select(F.explode(rows).alias("r")).select("r.*")
    svc = pages.filter(F.col("page_id") % 3 < 2).select(lang.alias("s")).distinct().select(
        F.concat(F.lit("app/"), F.lower("s"), F.lit(".service.ts")).alias("file"),
        F.concat(F.lit("export class "), F.col("s"), F.lit(" {}")).alias("text"))
    out = made.unionByName(svc).withColumn("name", file_name(F.col("file")))
    return out.withColumn("suffix", file_suffix(F.col("name")))
