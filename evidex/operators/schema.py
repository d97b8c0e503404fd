"""Schema derivation and grounding of code against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators.extract import infer_field_type
from evidex.operators.scale import computed, global_rank, settled, sorted_neighbour, split_join

FIELDS = ("object", "code", "field", "type", "picklist", "required", "unique", "default")


def object_name(code: Column) -> Column:
    return F.concat(code, F.lit("__c"))


def field_name(attribute: Column) -> Column:
    return F.concat(F.upper(F.substring(attribute, 1, 1)),
                    F.substring(attribute, F.lit(2), F.length(attribute)), F.lit("__c"))


def _last(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """The last declaration per key, by file and place in the file."""
    at = F.struct("file", "ord")
    return df.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in cols])


def derive_schema(item_types: DataFrame, enums: DataFrame) -> DataFrame:
    """schema_fields of the last declaration of each type; enum-typed attributes are picklists."""
    last = _last(item_types.filter("name <> ''"), "name", "fields")
    rows = last.select(F.col("name").alias("code"), F.posexplode("fields").alias("pos", "f"))
    rows = rows.filter("f.name <> ''").withColumn("_raw", T.strip("f.type")).withColumn(
        "_base", F.substring_index("_raw", ".", -1))
    values = _last(enums, "name", "values")
    full = values.select(F.col("name").alias("_raw"), F.col("values").alias("_v1"))
    base = values.select(F.col("name").alias("_base"), F.col("values").alias("_v2"))
    # A type such as String stands at a third of all attributes: its rows meet the enums in salted parts.
    rows = split_join(split_join(rows.drop("_base"), full, "_raw").withColumn("_base", F.substring_index("_raw", ".", -1)), base, "_base")
    picks = F.coalesce("_v1", "_v2")
    flag = lambda k, v: F.coalesce(F.lower(F.try_element_at("f.modifiers", F.lit(k))) == v, F.lit(False))
    made = rows.select(
        object_name(F.col("code")).alias("object"), "code",
        field_name(F.col("f.name")).alias("field"),
        F.when(picks.isNotNull(), "Picklist").otherwise(
            N.lookup(F.col("_raw"), R.ATTRIBUTE_TYPES, F.lit("Text"))).alias("type"),
        picks.alias("picklist"), flag("optional", "false").alias("required"),
        flag("unique", "true").alias("unique"),
        F.nullif(F.col("f.default"), F.lit("")).alias("default"), "pos")
    # One attribute twice in a type: the last one wins.
    rest = [c for c in FIELDS if c not in ("object", "field")]
    return made.groupBy("object", "field").agg(
        *[F.max_by(F.struct(c), "pos").alias(c) for c in rest]).select(
        *[F.col(f"{c}.{c}").alias(c) if c in rest else F.col(c) for c in FIELDS])


def relation_lookups(relations: DataFrame) -> DataFrame:
    """Lookup fields on the child of every one-to-many relation, as schema_fields."""
    r = relations.filter("source_card = 'one' and target_card = 'many'")
    return r.select(
        object_name(F.col("target_type")).alias("object"), F.col("target_type").alias("code"),
        object_name(F.col("source_type")).alias("field"), F.lit("Lookup").alias("type"),
        F.lit(None).cast("array<string>").alias("picklist"), F.lit(False).alias("required"),
        F.lit(False).alias("unique"), F.lit(None).cast("string").alias("default")).distinct()


def with_lookups(schema: DataFrame, lookups: DataFrame) -> DataFrame:
    """A lookup replaces a plain field of the same name."""
    kept = schema.join(lookups.select("object", "field"), ["object", "field"], "left_anti")
    return kept.unionByName(lookups)


CATALOG_WIDTH = 1000


def schema_catalog(schema: DataFrame, width: int = CATALOG_WIDTH) -> DataFrame:
    """(object, part, line): fields sorted, ``width`` to a line; most objects have one part.

    Fields are ranked by a range sort, so an object with a third of all fields is no single
    group: it gives as many lines as it needs.
    """
    entry = F.concat(F.col("field"), F.lit(" ("), F.col("type"), F.lit(")"))
    rows = global_rank(schema.select("object", entry.alias("e")).distinct(), [F.col("object"), F.col("e")], "n")
    first = rows.groupBy("object").agg(F.min("n").alias("n0"))
    part = F.floor((F.col("n") - F.col("n0")) / width).alias("part")
    lines = rows.join(first, "object").select("object", part, "e").groupBy("object", "part").agg(
        F.array_sort(F.collect_list("e")).alias("e"))
    return lines.select("object", "part", F.concat(F.lit("- "), "object", F.lit(": "), F.array_join("e", ", ")).alias("line"))


def code_references(code: DataFrame) -> DataFrame:
    """refs(file, place, object, field) of code(file, text) without comments, in one pass.

    Places: ``object`` positions, ``select`` lists with their FROM object, ``dotted`` access.
    """
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    src = computed(code.select("file", "text"), _t=bare)
    t, none = F.col("_t"), F.lit(None).cast("string")

    def ref(place: str, obj: Column, field: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), obj.alias("object"), field.alias("field"))

    find = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    objects = F.transform(F.concat(*[find(p, 1) for p in R.OBJECT_POSITIONS]), lambda o: ref("object", o, none))
    last = lambda f: T.strip(F.substring_index(T.strip(f), ".", -1))
    selects = F.flatten(F.zip_with(find(R.SELECT_FROM, 1), find(R.SELECT_FROM, 2), lambda fs, o: F.transform(
        F.split(fs, ","), lambda f: ref("select", o, last(f)))))
    dotted = F.transform(find(R.DOTTED_FIELD, 1), lambda f: ref("dotted", none, f))
    return src.select("file", F.explode(F.array_distinct(F.concat(objects, selects, dotted))).alias("r")).select("file", "r.*")


def _issue(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select("file", F.lit(rule).alias("rule"), message.alias("message"), F.lit("WARNING").alias("severity"),
                     "object", "field")


def unknown_objects(refs: DataFrame, schema: DataFrame) -> DataFrame:
    """Objects in object positions that the schema lacks, once per file."""
    lost = refs.filter("place = 'object'").join(schema.select("object").distinct(), "object", "left_anti")
    return _issue(lost, "unknown_sobject", F.concat(
        F.lit("References custom object '"), F.col("object"), F.lit("' which is not defined in items.xml schema.")))


def unknown_fields(refs: DataFrame, schema: DataFrame) -> DataFrame:
    """Custom fields of ``[SELECT ... FROM X]`` that X lacks; skipped where X is unknown."""
    used = refs.filter((F.col("place") == "select") & F.col("field").endswith("__c")).withColumn("_k", F.lower("field"))
    used = used.join(schema.select("object").distinct(), "object", "left_semi")
    have = schema.select("object", F.lower("field").alias("_k")).distinct()
    return _issue(used.join(have, ["object", "_k"], "left_anti"), "unknown_field", F.concat(
        F.lit("SOQL selects '"), F.col("field"), F.lit("' from "), F.col("object"),
        F.lit(", but that field is not in the schema.")))


def unknown_dotted_fields(refs: DataFrame, schema: DataFrame) -> DataFrame:
    """``x.Y__c`` where no object has Y__c."""
    used = refs.filter("place = 'dotted'").withColumn("_k", F.lower("field")).filter(~F.col("_k").isin(*R.STANDARD_FIELDS))
    lost = used.join(schema.select(F.lower("field").alias("_k")).distinct(), "_k", "left_anti")
    return _issue(lost, "unknown_field", F.concat(
        F.lit("References custom field '"), F.col("field"), F.lit("' which exists on no object in the schema.")))


def field_references(code: DataFrame, schema: DataFrame) -> DataFrame:
    """All three checks over one scan of the code, one issue per message and file."""
    refs = settled(code_references(code), "refs")
    parts = [f(refs, schema) for f in (unknown_objects, unknown_fields, unknown_dotted_fields)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["file", "message"])


def evidenced(asked: DataFrame, corpus: DataFrame, name: str) -> DataFrame:
    """Rows whose base name (at least 3 characters) ends a word of the corpus.

    Words are made distinct first. Read from behind, a name ends a word iff it begins the first
    word that sorts at or after it, so one range sort of words and names answers for all of them.
    """
    words = corpus.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w")).distinct()
    base = F.lower(F.regexp_replace(F.col(name), "__c$", ""))
    rows = asked.withColumn("_back", F.reverse(base)).filter(F.length("_back") >= 3)
    hit = sorted_neighbour(rows, words.select(F.reverse("w").alias("_back")), "_back", name="_word")
    return hit.filter(F.col("_word").startswith(F.col("_back"))).select(*asked.columns)


def reconcile_schema(issues: DataFrame, schema: DataFrame, corpus: DataFrame) -> DataFrame:
    """outcome rows (kind added_object | added_field | flagged, object, field, type, reason)."""
    asked = settled(issues.filter(F.col("rule").isin("unknown_field", "unknown_sobject")).select(
        "rule", "object", "field").distinct())
    known = schema.select("object").distinct()
    none = F.lit(None).cast("string")

    def row(df: DataFrame, kind: str, obj: Column, field: Column, typ: Column, why: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), obj.alias("object"), field.alias("field"),
                         typ.alias("type"), why.alias("reason"))

    objs = asked.filter("rule = 'unknown_sobject' and object is not null").select("object").join(
        known, "object", "left_anti").distinct()
    fields = asked.filter("rule = 'unknown_field' and field is not null")
    have = schema.select("object", "field").distinct()
    placed = fields.filter("object is not null").join(known, "object", "left_semi").join(
        have, ["object", "field"], "left_anti").select("object", "field")
    loose = fields.join(known, "object", "left_anti").select("field").distinct()
    # One pass over the corpus answers for objects and fields alike.
    names = objs.select(F.col("object").alias("name")).unionByName(placed.select(F.col("field").alias("name"))).distinct()
    found = settled(evidenced(names, corpus, "name"), "evidence")
    obj_yes = objs.join(found.select(F.col("name").alias("object")), "object", "left_semi")
    obj_no = objs.join(found.select(F.col("name").alias("object")), "object", "left_anti")
    yes = placed.join(found.select(F.col("name").alias("field")), "field", "left_semi").select("object", "field")
    no = placed.join(found.select(F.col("name").alias("field")), "field", "left_anti").select("object", "field")
    typed = infer_field_type(yes, corpus)
    o, f = F.col("object"), F.col("field")
    parts = [
        row(obj_yes, "added_object", o, none, none,
            F.lit("referenced in Hybris source; not declared in items.xml")),
        row(obj_no, "flagged", o, none, none,
            F.lit("no source evidence — likely a hallucinated object")),
        row(typed, "added_field", o, f, F.col("type"), F.concat(F.lit(
            "used in Hybris source; not declared in items.xml (type inferred as "), "type", F.lit(")"))),
        row(no, "flagged", o, f, none, F.lit("no source evidence — likely a hallucinated field")),
        row(loose, "flagged", none, f, none,
            F.lit("object not determinable from a dotted access; left for review")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def field_metadata_rows(schema: DataFrame) -> DataFrame:
    """Physical properties per field: length, precision, default, required, unique, picklist."""
    t, d = F.col("type"), F.col("default")
    number = t.isin("Number", "Currency")
    return schema.select(
        "object", "field", "type", F.regexp_replace("field", "__c$", "").alias("label"),
        F.when(t == "Text", 255).cast("bigint").alias("length"),
        F.when(number, 18).cast("bigint").alias("precision"),
        F.when(number, 2).cast("bigint").alias("scale"),
        F.when(t == "Checkbox", F.coalesce(F.lower(d).isin("true", "1"), F.lit(False)).cast("string"))
        .when(t == "Text", d).alias("default_value"),
        F.when(t.isin("Checkbox", "Lookup"), F.lit(None)).otherwise(F.col("required")).alias("required"),
        F.when(F.col("unique") & (number | (t == "Text")), F.lit(True)).alias("unique"),
        F.when(t == "Lookup", F.col("field")).alias("reference_to"),
        F.when(t == "Picklist", F.transform("picklist", lambda v: F.struct(
            v.alias("value"), v.eqNullSafe(d).alias("is_default")))).alias("values"))


def namespaces(objects: DataFrame, name: str = "object") -> DataFrame:
    parts = F.split(F.col(name), "__")
    return objects.filter(F.size(parts) >= 3).select(F.get(parts, F.lit(0)).alias("namespace")).distinct()


def target_fit(planned: DataFrame, inventory: DataFrame, limits: DataFrame) -> DataFrame:
    """findings(kind, severity, object, detail) of planned(object, n_fields) against the target.

    ``inventory(object)`` lists what exists, ``limits(name, max, remaining)`` the headroom. A
    collision stops further checks of that object.
    """
    api = F.when(F.col("object").endswith("__c"), F.col("object")).otherwise(object_name(F.col("object")))
    plan = planned.select(api.alias("api"), F.upper(F.replace("object", F.lit("__c"), F.lit(""))).alias("base"),
                          "n_fields")
    have = inventory.select(F.lower("object").alias("_low")).distinct()
    hit = plan.withColumn("_low", F.lower("api")).join(have, "_low", "left_semi")
    free = plan.withColumn("_low", F.lower("api")).join(have, "_low", "left_anti")
    std = free.withColumn("std", N.lookup(F.col("base"), R.STANDARD_OBJECTS)).filter("std is not null")
    std = std.withColumn("_low", F.lower("std")).join(have, "_low", "left_semi")
    packs = namespaces(inventory).withColumn(
        "pack", N.lookup(F.col("namespace"), R.PACKAGES)).filter("pack is not null")
    need = plan.agg(F.count(F.lit(1)).alias("CustomObjects"), F.sum("n_fields").alias("CustomFields"))
    need = need.selectExpr("stack(2, 'CustomObjects', CustomObjects, 'custom object', "
                           "'CustomFields', CustomFields, 'custom field') as (name, need, label)")
    short = need.join(limits, "name").filter("need > remaining")

    def rows(df: DataFrame, kind: str, severity: str, obj: str, detail: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
                         F.col(obj).alias("object"), detail.alias("detail"))

    parts = [
        rows(hit, "collision", "critical", "api", F.col("api")),
        rows(std, "reusable", "high", "api", F.col("std")),
        rows(packs, "package", "high", "pack", F.col("namespace")),
        rows(short, "headroom", "critical", "label", F.concat_ws(
            " of ", F.col("need").cast("string"), F.col("remaining").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.when(F.col("severity") == "critical", 0).otherwise(1), "object")


def missing_from_errors(errors: DataFrame, text: str = "problem") -> DataFrame:
    """Distinct missing(object, field, kind) named by error messages."""
    t = F.col(text)
    found = []
    for p, o, f in R.MISSING_PATTERNS:
        objs = F.regexp_extract_all(t, F.lit(p), F.lit(o))
        if f is None:
            found.append(F.transform(objs, lambda x: F.struct(
                x.alias("object"), F.lit(None).cast("string").alias("field"))))
        else:
            fields = F.regexp_extract_all(t, F.lit(p), F.lit(f))
            found.append(F.zip_with(objs, fields, lambda a, b: F.struct(a.alias("object"), b.alias("field"))))
    rows = errors.select(F.explode(F.concat(*found)).alias("m")).select("m.object", "m.field").distinct()
    return rows.withColumn("kind", F.when(F.col("field").isNull(), "object").otherwise("field"))


def route_errors(errors: DataFrame, added: DataFrame, artifacts: DataFrame) -> DataFrame:
    """routed(file, disposition) of errors(file, problem) given added(token) and artifacts(file).

    Tokens end in ``__c``, so a token occurs in a message iff it ends a beginning of one of its
    words that stops at ``__c``. Tokens that another one ends are left out, as that one occurs
    wherever they do. Read from behind, a beginning then holds a token iff the last token that
    sorts at or before it begins it, so one range sort of both answers for all of them.
    """
    rows = errors.select("file", F.lower("problem").alias("p")).distinct()
    prefixes = F.regexp_extract_all("p", F.lit(r"\w*__c"), F.lit(0))
    inner = F.flatten(F.transform(prefixes, lambda w: F.transform(
        F.filter(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, F.lit(3)) == "__c"),
        lambda i: F.substring(w, F.lit(1), i + 2))))
    said = settled(rows.select("file", "p", F.explode(F.array_distinct(inner)).alias("word")), "said")
    tokens = settled(added.select(F.lower("token").alias("token")).filter("token <> ''").distinct(), "tokens")
    shorter = tokens.select("token", F.explode(F.expr("transform(sequence(1, length(token)), i -> substring(token, i + 1))")).alias("end"))
    whole = tokens.join(shorter.join(tokens.select(F.col("token").alias("end")), "end").select("token").distinct(), "token", "left_anti")
    asked = said.select(F.reverse("word").alias("back")).distinct()
    found = sorted_neighbour(asked, whole.select(F.reverse("token").alias("back")), "back", after=False, name="token")
    found = found.filter(F.col("back").startswith(F.col("token"))).select(F.reverse("back").alias("word"))
    hit = said.join(found, "word", "left_semi").select("file", "p").distinct()
    state = rows.select("file", "p").join(hit.withColumn("ok", F.lit(True)), ["file", "p"], "left")
    per = state.groupBy("file").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("resolved"))
    known = artifacts.select("file").distinct().withColumn("_known", F.lit(True))
    return per.join(known, "file", "left").select("file", F.when(
        F.col("resolved"), "resolved via metadata").when(
        F.col("_known").isNull(), "not a generated class").otherwise("needs repair").alias("disposition"))


def coverage_rollup(rows: DataFrame, threshold: int = R.COVERAGE_THRESHOLD) -> DataFrame:
    """Per class coverage to one decimal, zero totals dropped, with the strengthen mark."""
    per = rows.groupBy("name").agg(F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    pct = F.bround(F.lit(100.0) * F.col("covered") / F.col("total"), 1)
    return per.filter("total > 0").select("name", pct.alias("coverage"), (
        (pct < threshold) & ~F.col("name").endswith("Test")).alias("strengthen"))


def coverage_overall(rows: DataFrame) -> DataFrame:
    return rows.agg(F.bround(F.try_divide(F.lit(100.0) * F.sum("covered"), F.sum("total")), 1).alias("coverage"))
