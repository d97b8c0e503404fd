"""Rule scans over files(file, name, suffix, text): hazards, secrets, corpus score, checks.

Every scan works inside the row: hits are arrays of line numbers, and only files with hits
are exploded. Rules are literals, so each pattern is compiled once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators.scale import computed, global_rank, side_by_side


def _hits(files: DataFrame, found: Sequence[tuple], keep: Sequence[str],
          snippet: bool = True, width: int | None = None, notes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Explode (rule, severity, lines[, count]) into one row per hit, with its snippet.

    Snippets are whole lines, or their first ``width`` characters, and are taken from the lines
    before the rows are made, so no hit carries the text. ``notes`` gives hazard and fix of a rule.
    """
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), c.alias("at"),
                      (n[0] if n else F.lit(0)).cast("bigint").alias("n")) for r, s, c, *n in found]
    some = computed(files, _f=F.filter(F.array(*parts), lambda x: F.size(x["at"]) > 0))
    some = computed(some.filter(F.size("_f") > 0), _l=T.lines(F.col("text")))

    def said(n: Column) -> Column:
        if not snippet:
            return F.lit("")
        line = F.coalesce(T.strip(F.get("_l", n - 1)), F.lit(""))
        return line if width is None else F.substring(line, 1, width)

    each = F.flatten(F.transform("_f", lambda x: F.transform(x["at"], lambda n: F.struct(
        x["rule"].alias("rule"), x["severity"].alias("severity"), n.cast("bigint").alias("line"), said(n).alias("snippet"), x["n"].alias("n")))))
    out = computed(some, _h=each).select(*keep, F.explode("_h").alias("_h"))
    more = []
    if notes is not None:
        for i, name in enumerate(("hazard", "fix")):
            table = {r: n[i] for r, n in notes.items()}
            text = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.col("_h.rule")] if table else F.lit(None)
            more.append(F.coalesce(F.replace(text, F.lit("{n}"), F.col("_h.n").cast("string")), F.lit("")).alias(name))
    return out.select("_h.rule", "_h.severity", *keep, "_h.line", "_h.snippet", *more)


def regex_scan(files: DataFrame, rules: Sequence[tuple[str, str, str]],
               keep: Sequence[str] = ("file",), width: int | None = None) -> DataFrame:
    """One row per match of each (rule, severity, pattern) over the whole text."""
    text = F.col("text")
    return _hits(files, [(r, s, T.match_lines(text, p)) for r, s, p in rules], keep, width=width)


def block_lines(files: DataFrame, keep: Sequence[str] = ("file",)) -> DataFrame:
    """(file, line) for every line inside a loop body."""
    spans = computed(files.select(*keep, "text"), _r=T.loop_ranges(F.col("text")))
    inside = F.array_distinct(F.flatten(F.transform("_r", lambda r: F.sequence(r["lo"], r["hi"]))))
    each = spans.select(*keep, F.explode(inside).alias("line"))
    return each.select(*keep, F.col("line").cast("bigint").alias("line"))


def hazard_scan(files: DataFrame, rules=R.HAZARD_RULES, suffix: str | None = ".java", notes=R.HAZARD_NOTES) -> DataFrame:
    """Line rules on stripped code, the loop rules only on lines inside loops."""
    src = files.filter(F.col("suffix") == suffix) if suffix else files
    src = computed(src, text=T.strip_code_comments(F.col("text")))
    src = computed(src, source_class=T.class_of(F.col("text"), T.file_stem(F.col("name"))),
                   _loops=T.loop_ranges(F.col("text")))
    src = computed(src, _loops=T.range_flags(F.col("_loops")))
    found = []
    for rule, severity, pattern, in_loop in rules:
        at = T.match_lines(F.col("text"), pattern)
        found.append((rule, severity,
                      F.filter(at, lambda n: F.coalesce(F.get("_loops", n - 1), F.lit(False))) if in_loop else at))
    return _hits(src, found, ("file", "source_class"), notes=notes)


def unbounded_window(files: DataFrame, opens: str = R.QUERY_OPEN, bound: str = R.QUERY_BOUND,
                     window: int = R.QUERY_WINDOW, rule: str = "QUERY_NO_LIMIT",
                     strip: bool = True) -> DataFrame:
    """Matches of ``opens`` with no ``bound`` in the ``window`` lines from the match on."""
    src = files
    if strip:
        src = computed(src, text=T.strip_code_comments(F.col("text")))
    src = src.withColumn("source_class", T.class_of(F.col("text"), T.file_stem(F.col("name"))))
    src = computed(src.filter(F.col("text").rlike(opens)), _ls=T.lines(F.col("text")))
    ls = F.col("_ls")
    at = F.filter(T.match_lines(F.col("text"), opens), lambda n: ~F.array_join(
        F.slice(ls, n, F.lit(window)), "\n").rlike(bound))
    return _hits(src, [(rule, "medium", at)], ("file", "source_class"), notes=R.HAZARD_NOTES)


def file_hazards(files: DataFrame, rules=R.FILE_RULES, notes=R.HAZARD_NOTES) -> DataFrame:
    """File rules: first hit, every hit, or more than n matching lines."""
    prepared = {"raw": F.col("text"), "markup": F.col("_markup"), "code": F.col("_code")}
    text, suffix = F.col("text"), F.col("suffix")
    forms = {f: [r[2] for r in rules if r[5] == f] for f in ("markup", "code")}
    src = computed(files, _markup=F.when(suffix.isin(forms["markup"]), T.strip_markup_comments(text)),
                   _code=F.when(suffix.isin(forms["code"]), T.strip_code_comments(text)))
    src = src.withColumn("source_class", T.file_stem(F.col("name")))
    found = []
    for rule, severity, suffix, pattern, mode, form in rules:
        t, n = prepared[form], F.lit(0)
        if mode == "every":
            at = T.match_lines(t, pattern)
        elif mode == "first":
            at = F.array_compact(F.array(T.first_match_line(t, pattern)))
        else:
            limit = int(mode.rsplit(" ", 1)[1])
            n = F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0))
            at = F.when(n > limit, F.array(F.lit(1)))
            at = F.coalesce(at, F.array().cast("array<int>"))
        fits = F.col("suffix") == suffix
        found.append((rule, severity, F.when(fits, at).otherwise(F.array().cast("array<int>")), n))
    return _hits(src, found, ("file", "source_class"), snippet=False, notes=notes)


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for i, s in reversed(list(enumerate(R.SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def hazard_rank(hazards: DataFrame, ties: Sequence[str] = ("rule", "snippet")) -> DataFrame:
    """Number hazards H-001... worst first, then by file and line."""
    order = [severity_rank(F.col("severity")), F.col("file"), F.col("line"),
             *[F.col(t) for t in ties]]
    ranked = global_rank(hazards, order, "_n")
    text = F.col("_n").cast("string")
    return ranked.withColumn("id", F.concat(F.lit("H-"), F.when(
        F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))).drop("_n")


def hazard_summary(hazards: DataFrame) -> DataFrame:
    """One row: total, the four severities zero-filled, distinct files."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITIES]
    return hazards.agg(F.count(F.lit(1)).alias("total"), *counts,
                       F.countDistinct("file").alias("files_affected"))


def hazard_by_rule(hazards: DataFrame) -> DataFrame:
    return hazards.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def secret_scan(files: DataFrame, patterns=R.SECRET_PATTERNS,
                suffixes: Sequence[str] | None = R.SECRET_SUFFIXES,
                max_bytes: int | None = None) -> DataFrame:
    """One finding per file: the first pattern in list order that matches. Never the value.

    The suffix is tested before any pattern. Files of any size are read whole, unless a
    ``max_bytes`` is asked for.
    """
    src = files
    if suffixes is not None:
        src = src.filter(F.col("suffix").isin(*suffixes))
    if max_bytes is not None:
        src = src.filter(F.col("length") <= max_bytes)
    text = F.col("text")
    hit = F.coalesce(*[
        F.when(text.rlike(p), F.struct(F.lit(w).alias("what"),
                                       T.first_match_line(text, p).alias("line")))
        for p, w in patterns])
    return computed(src, h=hit).filter("h is not null").select(
        "file", "h.what", F.col("h.line").cast("bigint").alias("line"))


def corpus_signals(files: DataFrame, names=R.CORPUS_NAMES, patterns=R.CORPUS_PATTERNS,
                   content=R.CORPUS_IMPORT, components=R.CORPUS_COMPONENTS, code=R.CORPUS_CODE,
                   code_suffix: str = ".java", component_end: str = ".component.ts") -> DataFrame:
    """signals(why, points, file): each reason once, with its first file by path."""
    def mark(points: int, why: str) -> Column:
        return F.struct(F.lit(why).alias("why"), F.lit(points).alias("points"))

    name = F.col("name")
    exact = [F.when(name == n, mark(p, w)) for n, p, w in names]
    first = F.coalesce(*[F.when(name.rlike(p), mark(pts, w)) for p, pts, w in patterns])
    is_code, is_part = F.col("suffix") == code_suffix, name.endswith(component_end)
    seen = F.when(is_code & F.col("text").rlike(content[0]), mark(content[1], content[2]))
    part = F.when(is_part, mark(*components))
    src = F.when(is_code, mark(*code))
    marks = files.select("file", F.explode(
        F.array_compact(F.array(*exact, first, seen, part, src))).alias("m"))
    found = marks.groupBy("m.why").agg(
        F.min("file").alias("file"), F.max("m.points").alias("points"),
        F.count(F.lit(1)).alias("n"))
    counted = F.col("why").isin(components[1], code[1])
    return found.select(
        "why",
        F.when(F.col("why") == code[1], F.least(F.lit(code[0]).cast("bigint"), F.col("n")))
        .otherwise(F.col("points")).cast("bigint").alias("points"),
        F.when(counted, F.concat(F.col("n").cast("string"), F.lit(" file(s)")))
        .otherwise(F.col("file")).alias("file"))


def corpus_score(signals: DataFrame) -> DataFrame:
    return signals.agg(F.least(F.lit(100).cast("bigint"),
                               F.coalesce(F.sum("points"), F.lit(0))).alias("score"))


def inventory(files: DataFrame, component_end: str = ".component.ts",
              kinds: dict[str, str] | None = None, extension: Column | None = None) -> DataFrame:
    """One row of counts by kind, total and the distinct extensions."""
    kinds = kinds or {"java": ".java", "xml": ".xml", "impex": ".impex"}
    counts = [F.count_if(F.col("suffix") == s).alias(f"{k}_files") for k, s in kinds.items()]
    ext = F.countDistinct(extension) if extension is not None else F.lit(0).cast("bigint")
    return files.agg(F.count(F.lit(1)).alias("total_files"), *counts,
                     F.count_if(F.col("name").endswith(component_end)).alias("components"),
                     ext.alias("extensions"))


def extension_names(files: DataFrame, descriptor: str = "extensioninfo.xml") -> DataFrame:
    """Distinct extensions: the name in each descriptor, else its folder."""
    named = F.nullif(F.regexp_extract("text", r'<extension\b[^>]*\bname\s*=\s*"([^"]+)"', 1), F.lit(""))
    parent = F.nullif(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1), F.lit(""))
    return files.filter(F.col("name") == descriptor).select(F.coalesce(named, parent).alias("extension")).filter(
        "extension is not null").distinct()


def corpus_verdict(counts: DataFrame, signals: DataFrame, secrets: DataFrame,
                   type_files: DataFrame) -> DataFrame:
    """reject / warn / ok from four one-row aggregates."""
    one = side_by_side(counts, corpus_score(signals), secrets.agg(F.count(F.lit(1)).alias("secrets")),
                       type_files.agg(F.count(F.lit(1)).alias("type_files")))
    code, parts = F.col("java_files"), F.col("components")
    reject = ((code == 0) & (parts == 0)) | (F.col("score") < 25)
    warn = ((code > 0) & (F.col("type_files") == 0)) | (code > 800) | (F.col("secrets") > 0)
    return one.select("score", "total_files", F.col("java_files"), "components", "secrets",
                      (F.col("score") >= 25).alias("is_match"),
                      F.when(reject, "reject").when(warn, "warn").otherwise("ok").alias("verdict"))


def first_version_hint(files: DataFrame, hints=R.VERSION_HINTS,
                       names: Sequence[str] | None = ("build.number", "package.json")) -> DataFrame:
    """Version from the first file by path that matches, patterns tried in order."""
    src = files.filter(F.col("name").isin(*names)) if names else files
    got = F.coalesce(*[F.when(F.col("text").rlike(p), F.struct(
        F.regexp_extract("text", p, 1).alias("version"),
        F.concat(F.col("file"), F.lit(f" ({s})")).alias("source"))) for p, s in hints])
    best = src.select("file", got.alias("v")).filter("v is not null").agg(
        F.min_by("v", "file").alias("v"))
    return best.filter("v is not null").select("v.version", "v.source")


def is_test_file(name: Column, text: Column) -> Column:
    """A test framework is named, or ``@Test`` and a test-like stem; a name alone never is."""
    stem = T.file_stem(name)
    named = text.contains("org.junit") | text.contains("junit.framework") | text.contains("org.testng")
    return named | (text.contains("@Test") & stem.rlike("(Test|Tests|TestCase|IT)$"))


def _clean_line(x: Column) -> Column:
    return T.strip(F.regexp_replace(x, r"//.*|/\*.*?\*/", ""))


def _loop_flags(text: Column) -> Column:
    """Per line whether it lies in, or starts, a loop: a fold over lines and their braces."""
    def one(s: Column, line: Column) -> dict[str, Column]:
        starts = line.rlike(R.LOOP_WORD) & (line.contains("(") | line.contains("{"))
        braces = F.regexp_extract_all(line, F.lit("[{}]"), F.lit(0))
        inner = F.aggregate(
            braces, F.struct(s["stack"].alias("stack"), starts.alias("start")),
            lambda a, b: F.struct(
                F.when(b == "{", F.array_append(a["stack"], a["start"]))
                .when(F.size(a["stack"]) > 0,
                      F.slice(a["stack"], F.lit(1), F.size(a["stack"]) - 1))
                .otherwise(a["stack"]).alias("stack"),
                (a["start"] & (b != "{")).alias("start")))
        return {"stack": inner["stack"], "out": F.array(F.array_contains(inner["stack"], True) | inner["start"])}

    return T.fold(T.line_blocks(text), lambda b: F.transform(T.block_lines(b), _clean_line),
                  {"stack": F.array().cast("array<boolean>")}, one, "out", "array<boolean>")


def validate_code_rules(files: DataFrame, keep: Sequence[str] = ("file",)) -> DataFrame:
    """issues(file, rule, severity, message) for generated code(file, name, text)."""
    text, name = F.col("text"), F.col("name")
    is_test = name.endswith("Test.cls") | name.contains("Test")
    opened, closed = T.occurrences(text, "{"), T.occurrences(text, "}")
    src = computed(files, _l=F.transform(T.lines(text), _clean_line))
    # The fold is only worth running where a loop word and a query or DML occur at all.
    busy = text.rlike(R.LOOP_WORD) & (text.rlike(R.CODE_QUERY) | text.rlike(R.CODE_DML))
    src = computed(src, _in=F.when(busy, _loop_flags(text)))

    def issue(rule: str, severity: str, message: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                        message.alias("message"))

    def at_lines(rule: str, what: str, hit) -> Column:
        rows = F.transform(F.col("_l"), lambda x, i: F.when(
            F.get("_in", i) & hit(x), issue(rule, "ERROR", F.concat(
                F.lit("Line "), (i + 1).cast("string"), F.lit(f": {what} inside a loop.")))))
        return F.when(F.col("_in").isNotNull(), F.array_compact(rows))

    def flag(cond: Column, rule: str, severity: str, message: str | Column) -> Column:
        m = F.lit(message) if isinstance(message, str) else message
        return F.array_compact(F.array(F.when(cond, issue(rule, severity, m))))

    has_assert = text.rlike(r"(?i)System\.assert|Assert\.")
    needs_sharing = name.contains("Service") | name.contains("Controller")
    groups = [
        flag(opened != closed, "balanced_braces", "ERROR", F.concat(
            F.lit("Unbalanced braces: "), opened.cast("string"), F.lit(" open vs "),
            closed.cast("string"), F.lit(" close."))),
        at_lines("soql_in_loop", "SOQL query", lambda x: x.rlike(R.CODE_QUERY)),
        at_lines("dml_in_loop", "DML operation", lambda x: x.rlike(R.CODE_DML)
                 & ~x.startswith("System.") & ~x.startswith("Assert.")),
        flag(is_test & ~text.contains("@isTest"), "missing_istest", "ERROR",
             "Test class missing '@isTest' annotation."),
        flag(is_test & ~has_assert, "missing_assert", "ERROR",
             "Test class has no System.assert / Assert statement."),
        flag(~is_test & needs_sharing & ~text.contains("with sharing"), "missing_with_sharing",
             "WARNING", "Service/Controller class missing 'with sharing'."),
        flag(text.rlike(r"\bpackage\s+[\w\.]+;"), "java_syntax_leak", "ERROR",
             "Java 'package' statement found."),
        flag(text.contains("import org.springframework") | text.contains("import java."),
             "java_syntax_leak", "ERROR", "Java/Spring 'import' statement found."),
        flag(text.rlike("@Autowired|@Service|@Component|@RestController"), "java_syntax_leak",
             "ERROR", "Java/Spring annotation found."),
    ]
    empty = F.array().cast("array<struct<rule:string,severity:string,message:string>>")
    found = F.concat(*[F.coalesce(g, empty) for g in groups])
    return src.select(*keep, F.explode(found).alias("i")).select(
        *keep, "i.rule", "i.severity", "i.message")


# A bare property path, and directives whose braces are legitimate.
PROPERTY_PATH = r"^[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*$"
ALLOWED_BINDINGS = ("for:each", "for:item", "for:index", "iterator:", "key=", "if:true",
                    "if:false", "lwc:if", "lwc:elseif", "lwc:else")


def validate_markup_bindings(bundles: DataFrame, keep: Sequence[str] = ("file",)) -> DataFrame:
    """issues for bundles(html, js, meta): module shape, template root, bindings, keys, meta."""
    html, js, meta = (F.coalesce(F.col(c), F.lit("")) for c in ("html", "js", "meta"))

    def issue(rule: str, severity: str, expression: Column | None = None) -> Column:
        said = F.lit(R.MARKUP_MESSAGES[rule])
        if expression is not None:
            said = F.replace(said, F.lit("{x}"), expression)
        return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), said.alias("message"))

    def flag(cond: Column, rule: str, severity: str) -> Column:
        return F.array_compact(F.array(F.when(cond, issue(rule, severity))))

    exprs = F.transform(F.regexp_extract_all(html, F.lit(r"\{([^{}]+)\}"), F.lit(1)), lambda e: T.strip(e))
    allowed = "|".join(ALLOWED_BINDINGS)
    bad = F.filter(exprs, lambda e: (e != "") & ~e.rlike(allowed) & ~e.rlike(PROPERTY_PATH))
    # A for:each with no key= up to the next one; one warning per bundle.
    loops = F.split(html, r"(?=<template[^>]*for:each=)")
    keyless = F.exists(loops, lambda x: x.rlike("^<template[^>]*for:each=") & ~x.contains("key="))
    found = F.concat(
        flag(~js.contains("extends LightningElement"), "lwc_class", "ERROR"),
        flag(~js.contains("export default"), "lwc_export", "ERROR"),
        flag((html != "") & ~html.contains("<template"), "lwc_template_root", "ERROR"),
        F.transform(bad, lambda e: issue("lwc_template_expression", "ERROR", e)),
        flag(keyless, "lwc_iterator_key", "WARNING"),
        flag(~meta.contains("<apiVersion>"), "lwc_meta_apiversion", "ERROR"),
        flag(~meta.contains("<isExposed>"), "lwc_meta_isexposed", "WARNING"))
    return bundles.select(*keep, F.explode(found).alias("i")).select(
        *keep, "i.rule", "i.severity", "i.message")
