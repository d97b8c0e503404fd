"""From texts to tables: classes, references, components, symbols, slimmed text, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators.scale import computed, settled, side_by_side
from evidex.operators.textscan import is_test_file


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parameters(raw: Column) -> Column:
    """``Type name, Type name`` as array<struct<name,type>>."""
    parts = F.filter(F.split(raw, ","), lambda p: T.strip(p) != "")
    return F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"(\w+)\s*$", 1).alias("name"),
        F.regexp_extract(T.strip(p), r"^(?:final\s+)?(.*?)\s+\w+$", 1).alias("type")))


def class_table(files: DataFrame, suffix: str = ".java") -> DataFrame:
    """classes(class_name, layer, file, annotations, fields, methods, referenced_types, ...).

    The first class of a file wins, else its first interface. Files without either keep a
    row with ``unreadable`` set.
    """
    src = files.filter(F.col("suffix") == suffix)
    src = computed(src, _code=T.strip_code_comments(F.col("text")))
    code = F.col("_code")
    is_class = code.rlike(r"\bclass\s+\w+")
    kind = F.when(is_class, "class").otherwise("interface")
    name = F.when(is_class, F.regexp_extract(code, r"\bclass\s+(\w+)", 1)).otherwise(
        F.regexp_extract(code, r"\binterface\s+(\w+)", 1))
    head = F.when(is_class, F.regexp_extract(code, r"^([\s\S]*?)\bclass\s+\w+", 1)).otherwise(
        F.regexp_extract(code, r"^([\s\S]*?)\binterface\s+\w+", 1))
    after = F.when(is_class, F.regexp_extract(code, r"\bclass\s+\w+([^{]*)\{", 1)).otherwise(
        F.regexp_extract(code, r"\binterface\s+\w+([^{]*)\{", 1))
    src = computed(src, kind=kind, class_name=name, _head=head, _after=after)
    src = src.withColumn("extends", F.nullif(
        F.regexp_extract("_after", r"\bextends\s+([\w.]+)", 1), F.lit("")))
    src = src.withColumn("implements", F.filter(F.split(
        F.regexp_extract("_after", r"\bimplements\s+([^{]*)", 1), r"\s*,\s*"), lambda x: x != ""))
    types, fields = _all(code, R.FIELD, 1), _all(code, R.FIELD, 2)
    returns, methods, params = (_all(code, R.PUBLIC_METHOD, g) for g in (1, 2, 3))
    noise = F.regexp_replace(code, r"(?m)^[ \t]*(?:import|package)\b[^;]*;|@\w+", "")
    refs = F.array_distinct(_all(noise, r"\b[A-Z]\w*", 0))
    drop = F.array(*[F.lit(c) for c in R.COMMON_TYPES])
    src = computed(
        src,
        annotations=_all(F.col("_head"), r"@(\w+)", 1),
        fields=F.zip_with(types, fields, lambda t, f: F.struct(f.alias("name"), t.alias("type"))),
        _m=F.arrays_zip(methods.alias("name"), returns.alias("return_type"), params.alias("raw")),
        referenced_types=F.sort_array(F.array_except(
            F.array_except(refs, drop), F.array(F.col("class_name")))))
    layer = N.infer_layer(F.col("class_name"), F.col("annotations"), F.col("extends"), F.col("implements"))
    return src.select(
        "class_name", layer.alias("layer"), "file", "annotations", "fields",
        F.transform("_m", lambda m: F.struct(
            m["name"].alias("name"), m["return_type"].alias("return_type"),
            parameters(m["raw"]).alias("parameters"))).alias("methods"),
        "referenced_types", F.col("text").alias("source"),
        is_test_file(F.col("name"), F.col("text")).alias("is_test"),
        F.when(F.col("class_name") == "", "no class or interface").alias("unreadable"))


def type_reference_edges(classes: DataFrame) -> DataFrame:
    """Distinct edges(src, dst) from a class to the known classes it references."""
    refs = classes.select(F.col("class_name").alias("src"), F.explode("referenced_types").alias("dst"))
    known = classes.select(F.col("class_name").alias("dst")).distinct()
    return refs.filter("src <> dst").distinct().join(known, "dst", "left_semi").select("src", "dst")


def _resolved(base: Column, rel: Column) -> Column:
    """The path that ``rel`` names from the folder of ``base``; any number of ``.`` and ``..`` steps."""
    parts = F.split(F.concat(F.regexp_replace(base, r"[^/]*$", ""), rel), "/")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part == ".", kept).when(up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def component_table(files: DataFrame) -> DataFrame:
    """UI components with template and styles taken from sibling files by equi-join."""
    s = F.col("text")
    src = files.filter(F.col("name").endswith(".component.ts") & s.contains("@Component")
                       & s.rlike(r"export\s+class\s+\w+"))
    quote = r"['\"]([^'\"]+)['\"]"
    ctor = F.regexp_extract(s, r"constructor\s*\(([^)]*)\)", 1)
    method = (r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?(?:async\s+)?(?:get\s+)?(\w+)\s*"
              r"\([^)]*\)\s*(?::[^\{]+)?\{")
    life = F.array(*[F.lit(x) for x in R.LIFECYCLE])
    frame = F.array(*[F.lit(x) for x in R.FRAMEWORK_TYPES])
    name = F.regexp_extract(s, r"export\s+class\s+(\w+)", 1)
    comp = computed(
        src, class_name=name,
        selector=F.regexp_extract(s, r"selector\s*:\s*" + quote, 1),
        inputs=_all(s, r"@Input\(\)\s+(\w+)", 1), outputs=_all(s, r"@Output\(\)\s+(\w+)", 1),
        injected=F.filter(_all(ctor, r"(?:private|public|protected|readonly|\s)+\w+\s*:\s*(\w+)", 1),
                          lambda t: t.endswith("Service")),
        methods=F.array_except(F.array_distinct(_all(s, method, 1)), life),
        referenced_types=F.sort_array(F.array_except(F.array_except(
            F.array_distinct(_all(s, r"\b([A-Z]\w+)\b", 1)), frame), F.array(name))),
        _tpl=_resolved(F.col("file"), F.regexp_extract(s, r"templateUrl\s*:\s*" + quote, 1)),
        _css=_all(F.regexp_extract(s, r"styleUrls\s*:\s*\[([^\]]*)\]", 1), quote, 1))
    texts = files.select(F.col("file").alias("_path"), F.col("text").alias("_text"))
    tpl = texts.select(F.col("_path").alias("_tpl"), T.strip("_text").alias("template"))
    css = comp.select("file", F.posexplode("_css").alias("_o", "_rel")).withColumn(
        "_path", _resolved(F.col("file"), F.col("_rel"))).join(texts, "_path")
    # At most the style files one component names, a list that stands in its own text.
    css = css.groupBy("file").agg(T.strip(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_o", "_text"))), lambda x: x["_text"]), "\n")).alias("styles"))
    out = comp.join(tpl, "_tpl", "left").join(css, "file", "left")
    return out.select("class_name", "file", "selector", "inputs", "outputs", "injected", "methods",
                      "referenced_types", F.coalesce("template", F.lit("")).alias("template"),
                      F.coalesce("styles", F.lit("")).alias("styles"))


def service_sources(files: DataFrame) -> DataFrame:
    """services(class_name, text) from service files."""
    s = files.filter(F.col("name").endswith(".service.ts"))
    return s.select(F.regexp_extract("text", r"export\s+class\s+(\w+)", 1).alias("class_name"),
                    "text").filter("class_name <> ''")


def attach_service_source(components: DataFrame, services: DataFrame) -> DataFrame:
    """(class_name, service, text) for every injected service that exists."""
    want = components.select("class_name", F.explode(F.array_distinct("injected")).alias("service"))
    return want.join(services.select(F.col("class_name").alias("service"), "text"), "service")


def skipped_glue_rows(files: DataFrame) -> DataFrame:
    """Framework glue and type-only files with their fixed reason."""
    out = None
    for end, (layer, reason) in R.GLUE_REASONS.items():
        found = F.nullif(F.regexp_extract("text", r"export\s+class\s+(\w+)", 1), F.lit(""))
        part = files.filter(F.col("name").endswith(end)).select(
            F.coalesce(found, T.file_stem(F.col("name"))).alias("class_name"),
            F.lit(layer).alias("layer"), F.lit(reason).alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out


def symbols_of(text: Column) -> Column:
    """array<struct<name,line_start,line_end>> of method declarations, by matching braces."""
    marked = F.regexp_replace(F.translate(text, "\u0001", " "), f"({R.METHOD})\\{{", "$1\u0001{")
    bare = F.regexp_replace(marked, "[^\\n{}\u0001]+", "")
    tokens = lambda piece: F.regexp_extract_all(piece, F.lit("\\n+|[{}\u0001]"), F.lit(0))
    done = "array<struct<i:int,hi:int>>"
    zero = {"line": F.lit(1), "depth": F.lit(0), "n": F.lit(0), "open": F.array().cast("array<struct<i:int,depth:int>>")}

    def entry(a: Column, b: Column, name: str) -> Column:
        return F.struct(a.cast("int").alias("i"), b.cast("int").alias(name))

    def step(s: Column, t: Column) -> dict[str, Column]:
        top = F.when(F.size(s["open"]) > 0, F.element_at(s["open"], -1)["depth"]).otherwise(F.lit(-1))
        closes = (t == "}") & (top == s["depth"]) & (F.size(s["open"]) > 0)
        return {
            "line": F.when(t.startswith("\n"), s["line"] + F.length(t)).otherwise(s["line"]),
            "depth": F.when(t == "{", s["depth"] + 1).when(t == "}", s["depth"] - 1).otherwise(s["depth"]),
            "n": F.when(t == "\u0001", s["n"] + 1).otherwise(s["n"]),
            "open": F.when(t == "\u0001", F.array_append(s["open"], entry(s["n"], s["depth"] + 1, "depth")))
            .when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"]),
            "out": F.when(closes, F.array(entry(F.element_at(s["open"], -1)["i"], s["line"], "hi")))
            .otherwise(F.array().cast(done))}

    ends = F.array_sort(T.fold(T.pieces(bare), tokens, zero, step, "out", done, lambda s: F.transform(
        s["open"], lambda o: entry(o["i"], s["line"], "hi"))))
    names = _all(text, R.METHOD + r"\{", 1)
    starts = T.match_lines(text, R.METHOD + r"\{")
    zipped = F.arrays_zip(names.alias("name"), starts.alias("lo"), ends.alias("end"))
    return F.transform(zipped, lambda z: F.struct(
        z["name"].alias("name"), z["lo"].cast("bigint").alias("line_start"),
        F.greatest(z["lo"], z["end"]["hi"]).cast("bigint").alias("line_end")))


def symbol_table(files: DataFrame, keep: Sequence[str] = ("file",)) -> DataFrame:
    """symbols(file, ord, name, line_start, line_end)."""
    made = computed(files.select(*keep, "text"), _s=symbols_of(F.col("text")))
    return made.select(*keep, F.posexplode("_s").alias("ord", "s")).select(
        *keep, F.col("ord").cast("bigint").alias("ord"), "s.name", "s.line_start", "s.line_end")


def public_signatures(code: DataFrame) -> DataFrame:
    """(file, signature) as ``Class.method(params) : type`` for public and global methods."""
    t = F.col("text")
    z = F.arrays_zip(_all(t, R.SIGNATURE, 1).alias("r"), _all(t, R.SIGNATURE, 2).alias("m"),
                     _all(t, R.SIGNATURE, 3).alias("p"))
    return code.select("file", "class_name", F.explode(z).alias("z")).select("file", F.concat(
        F.col("class_name"), F.lit("."), F.col("z.m"), F.lit("("), T.strip("z.p"), F.lit(") : "),
        F.col("z.r")).alias("signature"))


def import_summary(text: Column) -> Column:
    raw = _all(text, r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", 1)
    kept = F.filter(raw, lambda p: ~p.rlike(r"^java\.(lang|util|io)"))
    short = F.transform(kept, lambda p: F.when(
        F.size(F.split(p, r"\.")) > 3, F.substring_index(p, ".", 3)).otherwise(
        F.regexp_replace(p, r"\.[^.]*$", "")))
    return F.array_join(F.array_distinct(short), ", ")


def ts_import_summary(text: Column) -> Column:
    return F.array_join(F.array_distinct(_all(text, r"""from\s+['"]([^'"]+)['"]""", 1)), ", ")


def slim_text(df: DataFrame, text: str = "text", min_chars: int = 0, min_gain: float = R.SLIM_MIN_GAIN) -> DataFrame:
    """Add slim(text, original, slimmed, saved_pct, imports_removed, accessors_removed, applied).

    Falls back to the original on a changed brace balance and for a saving under five percent
    (``min_gain``), for texts of any size unless ``min_chars`` asks for a least one.
    """
    t = F.col(text)
    ts = t.contains("@Component") | t.contains("from '@angular") | t.contains('from "@angular')
    step = computed(
        df, _ts=ts,
        _imports=F.when(ts, F.regexp_count(t, F.lit(R.TS_IMPORT))).otherwise(
            F.regexp_count(t, F.lit(R.IMPORT))),
        _kept=F.when(ts, ts_import_summary(t)).otherwise(import_summary(t)),
        _bare=F.when(ts, F.regexp_replace(t, R.TS_IMPORT, "")).otherwise(
            F.regexp_replace(t, R.IMPORT, "")))
    bare = F.col("_bare")
    step = computed(
        step, _acc=F.when(F.col("_ts"), 0).otherwise(F.regexp_count(bare, F.lit(R.ACCESSOR))),
        _body=F.when(F.col("_ts"), bare).otherwise(F.regexp_replace(bare, R.ACCESSOR, "")))
    clean = F.concat(T.strip(F.regexp_replace(F.col("_body"), R.BLANK_RUN, "\n\n"), T.ASCII_SPACE), F.lit("\n"))
    acc = F.col("_acc")
    whole = F.concat(
        F.when(F.col("_kept") != "", F.concat(F.lit("// imports: "), F.col("_kept"), F.lit("\n")))
        .otherwise(""), clean,
        F.when(acc > 0, F.concat(F.lit("\n// ("), acc.cast("string"), F.lit(
            " trivial getter/setter(s) omitted — no logic)\n"))).otherwise(""))
    step = computed(step, _new=whole)
    new, n = F.col("_new"), F.length(t)
    balance = (T.occurrences(new, "{") - T.occurrences(new, "}")) == (
        T.occurrences(t, "{") - T.occurrences(t, "}"))
    saved = F.lit(1.0) - F.length(new) / F.nullif(n, F.lit(0))
    ok = (n >= min_chars) & balance & (saved >= min_gain)
    step = step.withColumn("_ok", F.coalesce(ok, F.lit(False)))

    def when_ok(c: Column, other: Column) -> Column:
        return F.when(F.col("_ok"), c).otherwise(other)

    zero = F.lit(0).cast("bigint")
    return step.withColumn("slim", F.struct(
        when_ok(new, t).alias("text"), n.cast("bigint").alias("original"),
        when_ok(F.length(new), n).cast("bigint").alias("slimmed"),
        when_ok(F.bround(100 * saved, 0).cast("bigint"), zero).alias("saved_pct"),
        when_ok(F.col("_imports").cast("bigint"), zero).alias("imports_removed"),
        when_ok(acc.cast("bigint"), zero).alias("accessors_removed"),
        F.col("_ok").alias("applied"))).select(*df.columns, "slim")


def slim_stats(slimmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    before, after = F.sum("slim.original"), F.sum("slim.slimmed")
    pct = F.bround(100 * (1 - after / F.nullif(before, F.lit(0))), 0)
    return slimmed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("classes"), F.count_if("slim.applied").alias("slimmed"),
        before.alias("before"), after.alias("after"),
        F.coalesce(pct, F.lit(0)).cast("bigint").alias("saved_pct"))


def type_pairs(files: DataFrame) -> DataFrame:
    """Declared (type, identifier) pairs of the corpus: one scan for all fields asked for."""
    words = "|".join(sorted(R.DECLARED_TYPES, key=len, reverse=True))
    p = rf"(?i)\b({words})(?=\s+(\w+)\b(\s*\()?)"
    t = F.col("text")
    z = F.arrays_zip(_all(t, p, 1).alias("type"), _all(t, p, 2).alias("ident"), _all(t, p, 3).alias("call"))
    return files.select("file", F.posexplode(z).alias("pos", "z")).select(
        "file", "pos", F.lower("z.type").alias("type"), F.lower("z.ident").alias("ident"),
        (F.col("z.call") != "").alias("is_call"))


def infer_field_type(fields: DataFrame, files: DataFrame, field: str = "field") -> DataFrame:
    """Add ``type`` from the first getter, else the first declaration, else Text."""
    at = F.struct("file", "pos")
    call = F.col("is_call")
    per = settled(type_pairs(files).groupBy("ident").agg(
        F.min_by("type", at).alias("_decl"), F.min_by(F.when(call, F.col("type")), F.when(call, at)).alias("_get")))
    core = F.lower(F.regexp_replace(F.col(field), "__c$", ""))
    asked = fields.withColumn("_core", core).withColumn("_getter", F.concat(F.lit("get"), core))
    out = (asked.join(per.select(F.col("ident").alias("_core"), "_decl"), "_core", "left")
           .join(per.select(F.col("ident").alias("_getter"), "_get"), "_getter", "left"))
    got = N.lookup(F.coalesce("_get", "_decl"), R.DECLARED_TYPES)
    return out.select(*fields.columns, F.coalesce(got, F.lit("Text")).alias("type"))


def discovery_counts(classes: DataFrame) -> DataFrame:
    """Per layer: classes and lines of code."""
    return classes.groupBy("layer").agg(
        F.count(F.lit(1)).alias("classes"),
        F.sum((T.newlines(F.col("source")) + 1).cast("bigint")).alias("loc"))


def discovery_summary(classes: DataFrame, objects: DataFrame, processes: DataFrame) -> DataFrame:
    """One row for the first gate: classes, lines, objects, processes, domains."""
    loc = (T.newlines(F.col("source")) + 1).cast("bigint")
    return side_by_side(
        classes.agg(F.count(F.lit(1)).alias("classes"), F.sum(loc).alias("loc"),
                    F.countDistinct(N.domain_key(F.col("class_name"))).alias("domains")),
        objects.agg(F.countDistinct("object").alias("objects")),
        processes.agg(F.count(F.lit(1)).alias("processes")))


def class_profile(classes: DataFrame) -> DataFrame:
    """The profile used without a model: purpose, inputs, outputs, dependencies, complexity."""
    m = F.col("methods")
    return classes.select(
        "class_name",
        F.when(F.col("layer") != "", F.concat("layer", F.lit(" class: "), "class_name"))
        .otherwise(F.col("class_name")).alias("purpose"),
        F.filter(m["name"], lambda x: x != "").alias("inputs"),
        F.filter(m["return_type"], lambda x: x != "").alias("outputs"),
        F.col("referenced_types").alias("dependencies"),
        F.when(F.size(m) > 8, "High").otherwise("Medium").alias("complexity"),
        (T.newlines(F.col("source")) + 1).cast("bigint").alias("loc"),
        m["name"].alias("methods"), F.col("fields")["name"].alias("fields"),
        F.col("referenced_types").alias("refs"))
