"""Sources, text predicates and scans on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators import textscan as S
from evidex.plans.corpora import CODE_SQL, HAZARD_SQL, gen_code
from evidex.plans.registry import query
from evidex.sources import files as files_

PAGE_SKIP = files_.SKIP_DIRS + ("de",)
PAGE_SQL = """
p0 AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, html FROM pages),
p AS (SELECT page_id, path, split_part(path, '/', -1) AS name,
        lower(regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]+)$', 1)) AS suffix, html FROM p0)
"""


def page_files(t):
    """Pages as files: the URL path is the path, the markup the text."""
    df = t.pages.select("page_id", files_.url_path(F.col("url")).alias("path"),
                        F.col("html").alias("text"))
    return files_.describe_paths(df).withColumn("length", F.octet_length("text")).withColumn(
        "file", F.col("path"))


def doc_files(t):
    name = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    df = t.documents.select("doc_id", "source", "lang", name.alias("path"), "text")
    return files_.describe_paths(df).withColumn("length", F.octet_length("text")).withColumn(
        "file", F.col("path"))


DOC_SQL = """
d AS (SELECT *, source || '/d' || doc_id || '.txt' AS file FROM documents),
dl AS (SELECT doc_id, file, source, UNNEST(string_split(text, chr(10))) AS line_text,
         UNNEST(generate_series(1, len(string_split(text, chr(10))))) AS line FROM d)
"""


@query("scan_corpus", f"""
WITH {PAGE_SQL}
SELECT path, name, suffix, strlen(html) AS bytes FROM p
WHERE NOT list_contains(string_split(path, '/'), 'de')""")
def scan_corpus(t):
    return files_.drop_skipped(page_files(t), PAGE_SKIP).select(
        "path", "name", "suffix", F.col("length").cast("bigint").alias("bytes"))


@query("file_tree", f"""
WITH {PAGE_SQL}
SELECT path, strlen(html) AS bytes FROM p WHERE NOT list_contains(string_split(path, '/'), 'de')
ORDER BY path, bytes""")
def file_tree(t):
    df = files_.drop_skipped(page_files(t), PAGE_SKIP)
    return files_.file_tree(df.withColumn("length", F.col("length").cast("bigint")))


@query("decode_text", r"""
WITH b AS (SELECT doc_id, lang, doc_id % 13 = 0 AS is_binary,
  CASE WHEN lang IN ('de', 'fr') THEN regexp_replace(text, '[^\x00-\xFF]', '?', 'g') ELSE text END AS body
  FROM documents)
SELECT doc_id, is_binary,
  CASE WHEN is_binary THEN NULL WHEN lang = 'de' THEN 'cp1252' WHEN lang = 'fr' THEN 'iso-8859-1'
       ELSE 'utf-8-sig' END AS encoding,
  CASE WHEN is_binary THEN NULL ELSE md5(CASE lang WHEN 'de' THEN body || '€' WHEN 'fr' THEN body || chr(129)
       ELSE body END) END AS text_md5,
  CASE WHEN is_binary THEN 'not a text file' END AS reason
FROM b""")
def decode_text(t):
    """Documents written as bytes: single-byte for de and fr, BOM for es, a NUL for each 13th."""
    lang = F.col("lang")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    utf8 = F.encode(F.col("text"), "UTF-8")
    raw = (F.when(lang == "de", F.concat(latin, F.lit(b"\x80")))
           .when(lang == "fr", F.concat(latin, F.lit(b"\x81")))
           .when(lang == "es", F.concat(F.lit(b"\xef\xbb\xbf"), utf8)).otherwise(utf8))
    raw = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit(b"\x00"), raw)).otherwise(raw)
    out = files_.decode_text(t.documents.select("doc_id", raw.alias("content")))
    return out.select("doc_id", "is_binary", "encoding", F.md5("text").alias("text_md5"), "reason")


@query("strip_code_comments", f"""
WITH {CODE_SQL}
SELECT file, len(string_split(text, chr(10))) AS n_lines,
  md5(replace(replace(replace(replace(bodies, '"for (;;) {{ modelService.save(q); }}"', '""'),
    '"a {{ b"', '""'), '"x"', '""'), '// comment }}', '')) AS body_md5 FROM cls""")
def strip_code_comments(t):
    bare = T.strip_code_comments(F.col("text"))
    df = gen_code(t.events).select("file", bare.alias("bare"))
    ls = T.lines(F.col("bare"))
    body = F.array_join(F.slice(ls, F.lit(16), F.size(ls) - 16), "\n")
    return df.select("file", F.size(ls).cast("bigint").alias("n_lines"), F.md5(body).alias("body_md5"))


@query("strip_markup_comments", r"""
SELECT page_id, md5(regexp_replace(html, '<!--(.|\n)*?-->', '', 'g')) AS text_md5
FROM pages""")
def strip_markup_comments(t):
    return t.pages.select("page_id", F.md5(T.strip_markup_comments(F.col("html"))).alias("text_md5"))


@query("strip_comments_simple", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '/\*(.|\n)*?\*/', ' ', 'g'),
   '//[^\n]*', ' ', 'g'), '"([^"\\]|\\.)*"', '""', 'g')) AS text_md5
FROM pages""")
def strip_comments_simple(t):
    return t.pages.select("page_id", F.md5(T.strip_comments_simple(F.col("html"))).alias("text_md5"))


DOC_RULES = (
    ("EMAIL", "critical", r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]+"),
    ("PHONE", "high", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("LICENSE", "medium", r"[Ll]icen[cs]e"),
    ("REPEATED_MARK", "info", r"#{3}|\*{3}"),
)
DOC_HITS_SQL = f"""
{DOC_SQL},
r(rule, severity, pat) AS (VALUES ('EMAIL','critical','[A-Za-z0-9.]+@[A-Za-z0-9]+\\.[a-z]+'),
  ('PHONE','high','\\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}'), ('LICENSE','medium','[Ll]icen[cs]e'),
  ('REPEATED_MARK','info','#{{3}}|\\*{{3}}')),
hit AS (SELECT rule, severity, file, line, trim(line_text, ' ') AS snippet,
   UNNEST(generate_series(1, len(regexp_extract_all(line_text, pat)))) AS k FROM dl, r
   WHERE regexp_matches(line_text, pat)),
hits AS (SELECT rule, severity, file, line, snippet FROM hit)
"""


def doc_hits(t):
    return S.regex_scan(doc_files(t), DOC_RULES)


@query("regex_scan", f"WITH {DOC_HITS_SQL} SELECT * FROM hits")
def regex_scan(t):
    return doc_hits(t)


@query("block_lines", f"""
WITH {CODE_SQL}
SELECT file, line0 + 2 AS line FROM code WHERE event_type = 'error'
UNION ALL SELECT file, line0 + 3 FROM code WHERE event_type = 'error'
UNION ALL SELECT file, line0 + 1 FROM code WHERE event_type = 'view'
UNION ALL SELECT file, line0 + 3 FROM code WHERE event_type = 'view'
UNION ALL SELECT file, line0 + 4 FROM code WHERE event_type = 'view'""")
def block_lines(t):
    files = gen_code(t.events).withColumn("text", T.strip_code_comments(F.col("text")))
    return S.block_lines(files)


_said = lambda text: "'" + text.replace("'", "''") + "'"
NOTES_SQL = "notes(rule, hazard, fix) AS (VALUES " + ", ".join(f"('{r}', {_said(h)}, {_said(f)})" for r, (h, f) in R.HAZARD_NOTES.items()) + ")"


@query("hazard_scan", f"WITH {CODE_SQL}, {HAZARD_SQL}, {NOTES_SQL} SELECT * FROM haz JOIN notes USING (rule)")
def hazard_scan(t):
    return S.hazard_scan(gen_code(t.events))


@query("unbounded_window_rule", f"""
WITH {CODE_SQL}, {NOTES_SQL}
SELECT notes.*, 'medium' AS severity, c.file, c.cls AS source_class, c.line0 + 3 AS line,
  'return new FlexibleSearchQuery("");' AS snippet
FROM notes JOIN code c ON rule = 'QUERY_NO_LIMIT' WHERE c.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM code k WHERE k.file_id = c.file_id AND k.event_type = 'click'
    AND k.line0 + 1 BETWEEN c.line0 + 3 AND c.line0 + 15)""")
def unbounded_window_rule(t):
    return S.unbounded_window(gen_code(t.events))


@query("file_hazards", f"""
WITH {PAGE_SQL}, h AS (SELECT *, regexp_replace(html, '<!--(.|\\n)*?-->', '', 'g') AS bare FROM p)
SELECT 'AD_BLOCK' AS rule, 'high' AS severity, path AS file,
  regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS source_class,
  1 + len(regexp_extract(bare, '^((?:.|\\n)*?)class="ad"', 1)) - len(replace(regexp_extract(bare, '^((?:.|\\n)*?)class="ad"', 1), chr(10), '')) AS line,
  '' AS snippet, '' AS hazard, '' AS fix FROM h WHERE contains(bare, 'class="ad"') AND suffix = '.html'
UNION ALL
SELECT 'PARAGRAPHS', 'medium', path, regexp_replace(name, '(.)\\.[^.]+$', '\\1'), 1, '', len(regexp_extract_all(html, '<p>')) || ' paragraphs.', 'Split it.'
FROM h WHERE len(regexp_extract_all(html, '<p>')) > 5 AND suffix = '.html'
UNION ALL
SELECT 'TOP_HEADING', 'high', path, regexp_replace(name, '(.)\\.[^.]+$', '\\1'), line, '', '', '' FROM (
  SELECT path, name, suffix, line, UNNEST(generate_series(1, len(regexp_extract_all(line_text, '<h1>')))) AS k FROM (
    SELECT path, name, suffix, UNNEST(string_split(bare, chr(10))) AS line_text,
      UNNEST(generate_series(1, len(string_split(bare, chr(10))))) AS line FROM h)
  WHERE contains(line_text, '<h1>'))
WHERE suffix = '.html'""")
def file_hazards(t):
    rules = (("AD_BLOCK", "high", ".html", r'class="ad"', "first", "markup"),
             ("TOP_HEADING", "high", ".html", r"<h1>", "every", "markup"),
             ("PARAGRAPHS", "medium", ".html", r"<p>", "more than 5", "raw"))
    return S.file_hazards(page_files(t), rules, {"PARAGRAPHS": ("{n} paragraphs.", "Split it.")})


@query("hazard_rank", f"""
WITH {DOC_HITS_SQL}
SELECT rule, severity, file, line, snippet, 'H-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id
FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1
   WHEN 'medium' THEN 2 ELSE 3 END, file, line, rule, snippet) AS n FROM hits)""")
def hazard_rank(t):
    return S.hazard_rank(doc_hits(t))


@query("hazard_summary", f"""
WITH {CODE_SQL}, {HAZARD_SQL}
SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'info') AS info, count(DISTINCT file) AS files_affected FROM haz""")
def hazard_summary(t):
    return S.hazard_summary(S.hazard_scan(gen_code(t.events)))


@query("hazard_by_rule", f"WITH {DOC_HITS_SQL} SELECT rule, count(*) AS n FROM hits GROUP BY rule")
def hazard_by_rule(t):
    return S.hazard_by_rule(doc_hits(t))


@query("secret_scan", f"""
WITH {DOC_SQL}, s AS (SELECT file, line, CASE
    WHEN regexp_matches(line_text, 'token = "[0-9a-f]{{20,}}') THEN 1
    WHEN regexp_matches(line_text, '[A-Za-z0-9.]+@[A-Za-z0-9]+\\.[a-z]+') THEN 2
    WHEN regexp_matches(line_text, '\\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}') THEN 3 END AS k,
    line_text FROM dl),
a AS (SELECT file, 1 AS k, min(line) AS line FROM s WHERE regexp_matches(line_text, 'token = "[0-9a-f]{{20,}}') GROUP BY 1
  UNION ALL SELECT file, 2, min(line) FROM s WHERE regexp_matches(line_text, '[A-Za-z0-9.]+@[A-Za-z0-9]+\\.[a-z]+') GROUP BY 1
  UNION ALL SELECT file, 3, min(line) FROM s WHERE regexp_matches(line_text, '\\([0-9]{{3}}\\) [0-9]{{3}}-[0-9]{{4}}') GROUP BY 1)
SELECT file, ['a token', 'a mail address', 'a phone number'][arg_min(k, k)] AS what, arg_min(line, k) AS line
FROM a GROUP BY file""")
def secret_scan(t):
    patterns = ((r'token = "[0-9a-f]{20,}', "a token"),
                (r"[A-Za-z0-9.]+@[A-Za-z0-9]+\.[a-z]+", "a mail address"),
                (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "a phone number"))
    return S.secret_scan(doc_files(t), patterns, (".txt",))


SIGNALS = {
    "names": (("25", 45, "page 25"), ("474.html", 25, "page 474")),
    "patterns": ((r"^[0-9]+\.html$", 30, "numbered html"), (r".*\.html$", 5, "any html"),
                 (r"^[0-9]+$", 12, "numbered page")),
    "content": (r"\bclass=.ad\b", 25, "advert markup"),
    "components": (35, "trailing slash"), "code": (12, "html pages"),
    "code_suffix": ".html", "component_end": "/",
}
SIGNAL_SQL = f"""
{PAGE_SQL}, marks AS (
  SELECT path, 'page 25' AS why, 45 AS points FROM p WHERE name = '25'
  UNION ALL SELECT path, 'page 474', 25 FROM p WHERE name = '474.html'
  UNION ALL SELECT path, 'numbered html', 30 FROM p WHERE regexp_matches(name, '^[0-9]+\\.html$')
  UNION ALL SELECT path, 'any html', 5 FROM p WHERE suffix = '.html' AND NOT regexp_matches(name, '^[0-9]+\\.html$')
  UNION ALL SELECT path, 'numbered page', 12 FROM p WHERE regexp_matches(name, '^[0-9]+$')
  UNION ALL SELECT path, 'advert markup', 25 FROM p WHERE suffix = '.html' AND regexp_matches(html, '\\bclass=.ad\\b')),
sig AS (SELECT why, max(points)::BIGINT AS points, min(path) AS file FROM marks GROUP BY why
  UNION ALL SELECT 'html pages', least(12, count(*)), count(*) || ' file(s)' FROM p WHERE suffix = '.html' HAVING count(*) > 0)
"""


@query("corpus_score", f"WITH {SIGNAL_SQL} SELECT why, points, file FROM sig")
def corpus_score(t):
    return S.corpus_signals(page_files(t), **SIGNALS)


@query("corpus_verdict", f"""
WITH {SIGNAL_SQL}, s AS (SELECT least(100, sum(points))::BIGINT AS score FROM sig),
c AS (SELECT count(*) AS total_files, count(*) FILTER (suffix = '.html') AS java_files FROM p),
x AS (SELECT count(*) AS secrets FROM p WHERE regexp_matches(html, 'ref=[a-z]')),
y AS (SELECT count(*) AS type_files FROM p WHERE name = '25')
SELECT score, total_files, java_files, 0 AS components, secrets, score >= 25 AS is_match,
  CASE WHEN java_files = 0 OR score < 25 THEN 'reject'
       WHEN type_files = 0 OR java_files > 800 OR secrets > 0 THEN 'warn' ELSE 'ok' END AS verdict
FROM s, c, x, y""")
def corpus_verdict(t):
    files = page_files(t)
    counts = S.inventory(files, "/", {"java": ".html"})
    secrets = files.filter(F.col("text").rlike("ref=[a-z]"))
    return S.corpus_verdict(counts, S.corpus_signals(files, **SIGNALS), secrets,
                            files.filter(F.col("name") == "25"))


@query("inventory", f"""
WITH {PAGE_SQL}
SELECT count(*) AS total_files, count(*) FILTER (suffix = '.html') AS html_files,
  count(*) FILTER (suffix = '') AS plain_files, count(*) FILTER (name LIKE '%5.html') AS components,
  count(DISTINCT split_part(path, '/', 2)) AS extensions FROM p""")
def inventory(t):
    return S.inventory(page_files(t), "5.html", {"html": ".html", "plain": ""},
                       F.get(F.split("path", "/"), 1))


@query("first_version_hint", f"""
WITH {PAGE_SQL}, v AS (SELECT path, coalesce(nullif(regexp_extract(html, 'track\\(([0-9]+)\\)', 1), ''),
    regexp_extract(html, '<!-- ad ([0-9]+) -->', 1)) AS version,
    CASE WHEN regexp_matches(html, 'track\\(([0-9]+)\\)') THEN 'script' ELSE 'comment' END AS src
  FROM p WHERE regexp_matches(html, 'track\\(([0-9]+)\\)') OR regexp_matches(html, '<!-- ad ([0-9]+) -->'))
SELECT arg_min(version, path) AS version, min(path) || ' (' || arg_min(src, path) || ')' AS source FROM v""")
def first_version_hint(t):
    hints = ((r"track\(([0-9]+)\)", "script"), (r"<!-- ad ([0-9]+) -->", "comment"))
    return S.first_version_hint(page_files(t), hints, None)


@query("is_test_file", """
SELECT doc_id, contains(text, 'MIT License') OR (contains(text, 'the')
   AND regexp_matches(source, '(1|2|5)$')) AS is_test FROM documents""")
def is_test_file(t):
    """Documents as test sources: a license line stands for the framework import."""
    body = F.when(F.col("text").contains("MIT License"),
                  F.concat(F.lit("import org.junit.Assert; "), F.col("text"))).otherwise(F.col("text"))
    body = F.when(F.col("text").contains("the"), F.concat(body, F.lit(" @Test"))).otherwise(body)
    name = F.concat(F.col("source"), F.when(F.col("source").rlike("(1|2|5)$"), F.lit("Test.java"))
                    .otherwise(F.lit("Impl.java")))
    return t.documents.select("doc_id", S.is_test_file(name, body).alias("is_test"))


@query("validate_code_rules", f"""
WITH {CODE_SQL}
SELECT file, 'java_syntax_leak' AS rule, 'ERROR' AS severity, m AS message FROM (
  SELECT * FROM cls, (VALUES ('Java ''package'' statement found.'), ('Java/Spring ''import'' statement found.'),
          ('Java/Spring annotation found.')) AS v(m)) WHERE m NOT LIKE '%annotation%' OR file_id % 2 = 0
UNION ALL SELECT file, 'missing_with_sharing', 'WARNING', 'Service/Controller class missing ''with sharing''.'
  FROM cls WHERE cls LIKE '%Service' OR cls LIKE '%Controller'
UNION ALL SELECT file, 'balanced_braces', 'ERROR',
  'Unbalanced braces: ' || o || ' open vs ' || c || ' close.' FROM (
    SELECT c.file, 3 + sum(CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 2
         WHEN 'purchase' THEN 3 ELSE 2 END)::BIGINT AS o,
       2 + sum(CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 2
         WHEN 'purchase' THEN 2 ELSE 3 END)::BIGINT AS c
    FROM code c GROUP BY c.file) WHERE o <> c""")
def validate_code_rules(t):
    return S.validate_code_rules(gen_code(t.events))


@query("validate_markup_bindings", r"""
WITH b AS (SELECT page_id, html, UNNEST(regexp_extract_all(html, '\{([^{}]+)\}', 1)) AS e FROM pages)
SELECT page_id, 'lwc_template_expression' AS rule, 'ERROR' AS severity, 'Template binding ''{' || trim(e)
  || '}'' is an expression; LWC allows only a property or getter reference — lift it into a JS getter.' AS message FROM b
  WHERE trim(e) <> '' AND NOT regexp_matches(trim(e), '^[A-Za-z_$][A-Za-z0-9_$]*(\??\.[A-Za-z_$][A-Za-z0-9_$]*)*$')
UNION ALL SELECT page_id, 'lwc_class', 'ERROR', 'LWC JS must define a class that extends LightningElement.' FROM pages
UNION ALL SELECT page_id, 'lwc_export', 'ERROR', 'LWC JS must have a default export.' FROM pages WHERE NOT contains(html, 'track(')
UNION ALL SELECT page_id, 'lwc_template_root', 'ERROR', 'LWC markup must be wrapped in a <template> root element.' FROM pages
UNION ALL SELECT page_id, 'lwc_meta_apiversion', 'ERROR', '.js-meta.xml must declare <apiVersion>.' FROM pages WHERE page_id % 2 = 1
UNION ALL SELECT page_id, 'lwc_meta_isexposed', 'WARNING', '.js-meta.xml should declare <isExposed>.' FROM pages WHERE page_id % 3 <> 0""")
def validate_markup_bindings(t):
    even = F.when(F.col("page_id") % 2 == 0, F.lit("<apiVersion>60</apiVersion>")).otherwise(F.lit(""))
    third = F.when(F.col("page_id") % 3 == 0, F.lit("<isExposed>true</isExposed>")).otherwise(F.lit(""))
    df = t.pages.select("page_id", "html", F.concat(even, third).alias("meta"),
                        F.when(F.col("html").contains("track("), "export default x").alias("js"))
    return S.validate_markup_bindings(df, ("page_id",))


@query("extension_names", f"""
WITH {PAGE_SQL}
SELECT DISTINCT extension FROM (SELECT CASE WHEN page_id % 3 = 0 AND regexp_extract(html, 'lang="([a-z]+)"', 1) <> '' THEN regexp_extract(html, 'lang="([a-z]+)"', 1)
  ELSE regexp_extract(path, '([^/]+)/[^/]+$', 1) END AS extension FROM p) WHERE extension <> ''""")
def extension_names(t):
    """Every page as a descriptor; each third one states its own name."""
    f = page_files(t)
    named = F.concat(F.lit('<extension name="'), F.regexp_extract("text", 'lang="([a-z]+)"', 1), F.lit('"/>'))
    f = f.withColumn("text", F.when(F.col("page_id") % 3 == 0, named).otherwise("<x/>"))
    return S.extension_names(f.withColumn("name", F.lit("extensioninfo.xml")))
