"""Cron triggers from bean XML and data files, their checks and the schedule plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators.scale import computed, settled

_PROP = "struct<_name:string,_value:string,_ref:string,value:string,ref:struct<_bean:string,_VALUE:string>>"
_BEANS = f"bean array<struct<_id:string,_class:string,_parent:string,property:array<{_PROP}>>>"


def beans(files: DataFrame) -> DataFrame:
    """beans(file, id, class, props map<name, struct<value, ref>>); malformed files give none."""
    src = files.filter(F.col("text").contains("<bean") & ~F.col("file").rlike(r"(^|/|-)items\.xml$"))
    x = computed(src.select("file", "text"), _x=F.from_xml("text", _BEANS, {"ignoreNamespace": "true"}))
    b = x.select("file", F.explode("_x.bean").alias("b")).filter("b._id <> ''")
    named = F.filter(F.coalesce("b.property", F.array()), lambda p: p["_name"].isNotNull())
    inner = lambda p: p["_value"].isNull() & p["_ref"].isNull()
    value = lambda p: F.when(inner(p), T.strip(p["value"])).otherwise(p["_value"])
    ref = lambda p: F.when(inner(p), F.coalesce(p["ref"]["_bean"], p["ref"]["_VALUE"])).otherwise(p["_ref"])
    props = F.transform(named, lambda p: F.struct(
        p["_name"].alias("name"), value(p).alias("value"), ref(p).alias("ref")))
    return b.select("file", F.col("b._id").alias("id"), F.col("b._class").alias("class"), props.alias("props"))


def _prop(name: str, part: str) -> Column:
    """Value or reference of the last property of that name."""
    return F.try_element_at(F.filter("props", lambda p: p["name"] == name), F.lit(-1))[part]


def _props(b: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    return b.select("*", *[_prop(n, part).alias(alias) for alias, (n, part) in names.items()])


def spring_triggers(b: DataFrame) -> DataFrame:
    """triggers(file, bean, job_class, cron_expression, active, resolved).

    trigger -> cronJob -> job by two equi-joins on (file, id), else trigger -> job directly.
    """
    b = settled(b, "beans")
    t = _props(b, {"cron": ("cronExpression", "value"), "cj": ("cronJob", "ref"),
                   "direct": ("job", "ref"), "act": ("active", "value")}).filter("cron <> ''")
    links = _props(b, {"job": ("job", "ref")}).select("file", F.col("id").alias("cj"), F.col("job").alias("via"))
    klass = b.select("file", F.col("id").alias("_id"),
                     F.substring_index("class", ".", -1).alias("simple")).filter("simple <> ''")
    t = t.select("file", "id", "cron", "cj", "direct", "act").join(links, ["file", "cj"], "left")
    one = klass.select("file", F.col("_id").alias("via"), F.col("simple").alias("c1"))
    two = klass.select("file", F.col("_id").alias("direct"), F.col("simple").alias("c2"))
    t = t.join(one, ["file", "via"], "left").join(two, ["file", "direct"], "left")
    job = F.coalesce("c1", "c2")
    return t.select(
        "file", F.col("id").alias("bean"),
        F.coalesce(job, F.concat(F.lit("(unresolved: trigger bean '"), "id", F.lit("')"))).alias("job_class"),
        F.col("cron").alias("cron_expression"),
        (F.lower(F.coalesce(F.nullif("act", F.lit("")), F.lit("true"))) != "false").alias("active"),
        job.isNotNull().alias("resolved"))


def impex_triggers(cells: DataFrame) -> DataFrame:
    """Rows of type Trigger with a cron expression and a cronJob or job."""
    c = cells.filter("type = 'Trigger'")
    pick = lambda a: F.max(F.when(F.col("attr") == a, F.nullif("value", F.lit(""))))
    rows = c.groupBy("file", "line_no").agg(
        pick("cronExpression").alias("cron_expression"),
        F.coalesce(pick("cronJob"), pick("job")).alias("job_class"),
        F.coalesce(pick("active"), F.lit("true")).alias("a"))
    return rows.filter("cron_expression is not null and job_class is not null").select(
        "file", "line_no", "job_class", "cron_expression", (F.lower("a") != "false").alias("active"),
        F.lit(True).alias("resolved"))


def cron_warnings(expr: Column) -> Column:
    """array<string>: wrong field count, or both day fields concrete."""
    f = F.split(T.strip(expr), r"\s+")
    n = F.when(T.strip(expr) == "", 0).otherwise(F.size(f))
    free = lambda i: F.get(f, F.lit(i)).isin("?", "*")
    bad = ~n.isin(6, 7)
    return F.array_compact(F.array(
        F.when(bad, F.concat(F.lit("Expected 6 or 7 cron fields (seconds..[year]), got "),
                             n.cast("string"), F.lit(": '"), expr, F.lit("'"))),
        F.when(~bad & ~free(3) & ~free(5), F.lit(
            "Both day-of-month and day-of-week are concrete values; "
            "Salesforce requires one of them to be '?'."))))


def scheduler_name(job_class: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(job_class, "^Default", ""), "Job$", ""), F.lit("Scheduler"))


def schedule_plan(triggers: DataFrame) -> DataFrame:
    """Per trigger: scheduler, warnings and disposition (scheduled, inactive, unresolved)."""
    return triggers.select(
        "file", "job_class", "cron_expression",
        F.when(F.col("resolved"), scheduler_name(F.col("job_class"))).alias("scheduler"),
        F.array_join(cron_warnings(F.col("cron_expression")), "; ").alias("warnings"),
        F.when(~F.col("resolved"), "unresolved").when(F.col("active"), "scheduled").otherwise("inactive")
        .alias("disposition"))


def schedule_counts(triggers: DataFrame) -> DataFrame:
    return triggers.agg(F.count_if("resolved").alias("resolved_count"),
                        F.count_if(~F.col("resolved")).alias("unresolved_count"))
