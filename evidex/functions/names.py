"""Names: layers, domains, readable and safe forms, folded keys, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.functions import text as T


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of ``key`` in a small fixed table."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    got = F.try_element_at(F.create_map(*pairs), key)
    return got if default is None else F.coalesce(got, default)


def infer_layer(name: Column, annotations: Column, extends: Column, implements: Column) -> Column:
    """Base class, then the first known annotation, then ...Job, then name parts, else Utility."""
    bases = "|".join(R.JOB_BASES)
    is_job = F.coalesce(extends.rlike(bases), F.lit(False)) | F.coalesce(
        F.exists(implements, lambda i: i.rlike(bases)), F.lit(False))
    known = F.filter(F.transform(annotations, lambda a: lookup(a, R.ANNOTATION_LAYERS)),
                     lambda x: x.isNotNull())
    out = F.when(is_job, "Job").when(F.size(known) > 0, F.get(known, F.lit(0)))
    out = out.when(name.endswith("Job"), "Job")
    for part, layer in R.NAME_LAYERS:
        out = out.when(name.contains(part), layer)
    return out.otherwise("Utility")


def strip_first_suffix(name: Column, suffixes, keep_some: bool = False) -> Column:
    out = None
    for s in suffixes:
        cond = name.endswith(s)
        if keep_some:
            cond = cond & (F.length(name) > len(s))
        cut = F.substring(name, F.lit(1), F.length(name) - len(s))
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(name)


def domain_key(name: Column) -> Column:
    return strip_first_suffix(F.regexp_replace(name, "^Default", ""), R.DOMAIN_SUFFIXES)


def ui_domain_key(name: Column) -> Column:
    return strip_first_suffix(name, R.UI_DOMAIN_SUFFIXES, keep_some=True)


def readable(name: Column) -> Column:
    """Without a leading test/should, camel case split, first letter upper, _ as space."""
    s = F.regexp_replace(F.regexp_replace(name, "^(test|should)", ""), "([a-z0-9])([A-Z])", "$1 $2")
    return T.strip(F.replace(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s))),
                            F.lit("_"), F.lit(" ")))


def safe_name(name: Column) -> Column:
    s = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    s = F.when(s == "", "Step").otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("X"), s)).otherwise(s)


def label(name: Column) -> Column:
    s = F.regexp_replace(F.coalesce(name, F.lit("")), "(?<!^)(?=[A-Z])", " ")
    words = F.filter(F.split(F.replace(s, F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    cap = F.transform(words, lambda w: F.when(
        (w == F.lower(w)) & (w != F.upper(w)), F.initcap(w)).otherwise(w))
    return F.when(F.size(cap) > 0, F.array_join(cap, " ")).otherwise("Step")


def split_camel(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)(?=[A-Z])", " "))


# Affixes and verb synonyms, folded in this order.
NAME_FOLDS = (
    ("^(do|perform|execute|handle)", ""),
    ("(s|es|List|Bulk|All)$", ""),
    ("^(get|fetch|find|load|retrieve|select|query)", "get"),
    ("^(create|place|make|build|new)", "create"),
    ("^(update|modify|change|edit)", "update"),
    ("^(delete|remove|cancel|destroy)", "delete"),
)


def normal_name(name: Column) -> Column:
    n = F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    for pattern, to in NAME_FOLDS:
        n = F.regexp_replace(n, pattern, to)
    return F.lower(n)


def duration_minutes(text: Column) -> Column:
    """ISO-8601 PnDTnHnMnS as whole minutes; seconds count one only alone; else null."""
    p = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    t = T.strip(text)

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(t, p, i).try_cast("int"), F.lit(0))

    d, h, m, s = part(1), part(2), part(3), part(4)
    only = F.when((s > 0) & (d + h + m == 0), 1).otherwise(0)
    return F.when(t.rlike(p), F.nullif(d * 1440 + h * 60 + m + only, F.lit(0)))


def rule_id(source_class: Column, rule: Column) -> Column:
    return F.concat(F.lit("R-"), F.substring(
        F.md5(T.strip(F.concat_ws("|", source_class, rule))), 1, 8))


def behaviour_id(test_class: Column, method: Column, n: Column) -> Column:
    return F.concat(F.lit("B-"), F.substring(
        F.md5(F.concat_ws("#", test_class, method, n.cast("string"))), 1, 8))
