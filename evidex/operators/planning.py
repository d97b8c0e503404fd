"""Targets, overrides, collisions and the completeness ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.operators.scale import computed


def plan_targets(classes: DataFrame) -> DataFrame:
    """target_sources(target, layer, class_name, file, ord) of classes(class_name, layer, file, ord).

    Every facade folds into the Service target of its domain, which exists by that very name
    whether or not the domain has a service; so no facade is lost and no pairs are formed.
    """
    classes = computed(classes, _domain=N.domain_key(F.col("class_name")))
    d, l, c = F.col("_domain"), F.col("layer"), F.col("class_name")
    bundle = F.regexp_replace(c, "(?<=.)Component$", "")
    name = (F.when(l == "DAO", F.concat(d, F.lit("Selector")))
            .when(l.isin("Service", "Facade"), F.concat(d, F.lit("Service")))
            .when(l == "Controller", F.concat(d, F.lit("Controller")))
            .when(l == "Utility", c).when(l == "Job", F.concat(d, F.lit("Scheduler")))
            .when(l == "Component", F.concat(F.lower(F.substring(bundle, 1, 1)),
                                             F.substring(bundle, F.lit(2), F.length(bundle)))))
    return classes.select(
        name.alias("target"), F.when(l == "Facade", "Service").otherwise(l).alias("layer"), "class_name", "file",
        # Services come before the facades folded into them.
        F.struct((l == "Facade").cast("int").alias("folded"), F.col("ord").alias("ord")).alias("at")
    ).filter("target is not null")


def merge_targets(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets(target, layer, n_sources), target_sources without repeats of (class, file))."""
    once = sources.groupBy("target", "class_name", "file").agg(
        F.min("at").alias("at"), F.min_by("layer", "at").alias("layer"))
    targets = once.groupBy("target").agg(
        F.min_by("layer", "at").alias("layer"), F.count(F.lit(1)).alias("n_sources"))
    return targets, once.select("target", "class_name", "file", "at")


def apply_overrides(plan: DataFrame, overrides: DataFrame) -> DataFrame:
    """plan(target, target_kind, rationale) with reviewer decisions; ``changed`` marks flips."""
    out = plan.join(overrides.select("target", "decision"), "target", "left")
    skip, kind = F.lit("Skip"), F.col("target_kind")
    out_of = (F.col("decision") == "Skip") & (kind != skip)
    into = (F.col("decision") == "Convert") & (kind == skip)
    out = out.withColumn("_o", F.coalesce(out_of, F.lit(False))).withColumn("_i", F.coalesce(into, F.lit(False)))
    return out.select(
        "target", F.when(F.col("_o"), skip).when(F.col("_i"), "Convert").otherwise(kind).alias("target_kind"),
        F.when(F.col("_o"), "excluded by reviewer").when(F.col("_i"), "included by reviewer")
        .otherwise(F.col("rationale")).alias("rationale"), (F.col("_o") | F.col("_i")).alias("changed"))


def output_path():
    return F.when(F.col("layer") == "Component", F.concat(F.lit("lwc/"), "target")).otherwise(
        F.concat("target", F.lit(".cls")))


def output_collisions(artifacts: DataFrame) -> DataFrame:
    """Members (path, artifact_id, target, layer) of every path more than one artifact writes."""
    a = artifacts.withColumn("path", output_path())
    many = a.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path")
    return a.join(many, "path", "left_semi").select("path", "artifact_id", "target", "layer")


def last_carrier(sources: DataFrame) -> DataFrame:
    """(class_name, artifact_id): a class carried twice belongs to the last artifact."""
    return sources.groupBy("class_name").agg(
        F.max_by("artifact_id", F.struct("ord", "artifact_id")).alias("artifact_id"))


def completeness_ledger(classes: DataFrame, artifacts: DataFrame, sources: DataFrame, plan_skips: DataFrame,
                        unreadable: DataFrame | None = None, processes: DataFrame | None = None,
                        glue: DataFrame | None = None) -> DataFrame:
    """ledger(source, layer, outcome, target, note): one outcome for every source class.

    ``artifacts(artifact_id, target, layer, review_flags)``, ``sources(artifact_id, class_name,
    ord)``, ``plan_skips(class_name, rationale, ord)``.
    """
    collided = output_collisions(artifacts).select("artifact_id", F.lit(True).alias("_hit"))
    arts = artifacts.join(collided, "artifact_id", "left").withColumn("path", output_path()).select(
        "artifact_id", "path", F.array_join("review_flags", "; ").alias("flags"), "_hit")
    carried = last_carrier(sources).join(arts, "artifact_id")
    skips = plan_skips.groupBy("class_name").agg(F.max_by("rationale", F.struct("ord", "rationale")).alias("why"))
    rows = classes.select("class_name", "layer").join(
        carried.select("class_name", "path", "flags", "_hit"), "class_name", "left").join(skips, "class_name", "left")
    model, has = F.col("layer") == "Model", F.col("path").isNotNull()
    hit, flag = F.coalesce("_hit", F.lit(False)), F.col("flags") != ""
    skip = F.col("why").isNotNull()
    out = rows.select(
        F.col("class_name").alias("source"), "layer",
        F.when(model, "converted").when(has & hit, "overwritten").when(has & flag, "flagged")
        .when(has, "converted").when(skip, "skipped").otherwise("unaccounted").alias("outcome"),
        F.when(model, "SObject metadata").when(has, F.col("path")).otherwise("—").alias("target"),
        F.when(model, "data model → custom object")
        .when(has & hit, F.concat(F.lit("more than one artifact writes `"), "path", F.lit(
            "` — only one survived, so this class's logic may not be in the output")))
        .when(has, F.col("flags")).when(skip, F.coalesce(F.nullif("why", F.lit("")), F.lit("no reason recorded")))
        .otherwise("NOT represented in output — investigate").alias("note"))
    dash = F.lit("—")
    if unreadable is not None:
        out = out.unionByName(unreadable.select(
            F.col("class_name").alias("source"), dash.alias("layer"), F.lit("unreadable").alias("outcome"),
            dash.alias("target"), F.concat("reason", F.lit(" ("), "file", F.lit(") — migrate this file by hand")).alias("note")))
    if processes is not None:
        out = out.unionByName(processes.select(
            "source", F.lit("Process").alias("layer"), "outcome", "target", F.lit("").alias("note")))
    if glue is not None:
        out = out.unionByName(glue.select(
            F.col("class_name").alias("source"), "layer", F.lit("skipped").alias("outcome"), dash.alias("target"),
            F.col("reason").alias("note")))
    return out


def outcome_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def comprehension_rollup(sources: DataFrame, profiles: DataFrame, keep: int | None = None) -> DataFrame:
    """Per target: first purpose, rules and risks in order, highest complexity.

    ``sources(target, class_name, ord)``, ``profiles(class_name, purpose, business_rules,
    risks, complexity)``. All entries of a target are kept, or the first ``keep``, which then
    are all that reaches a group.
    """
    p = sources.join(profiles, "class_name")
    rank = F.when(F.col("complexity") == "High", 3).when(F.col("complexity") == "Medium", 2).when(
        F.col("complexity") == "Low", 1).otherwise(0)
    said = F.when(F.coalesce("purpose", F.lit("")) != "", F.col("purpose"))
    head = p.groupBy("target").agg(
        F.min_by(said, F.when(said.isNotNull(), F.col("ord"))).alias("purpose"),
        F.max_by("complexity", rank).alias("complexity"))

    def first(col: str) -> DataFrame:
        one = p.select("target", "ord", F.posexplode(col).alias("pos", "x"))
        if keep is not None:
            w = Window.partitionBy("target").orderBy("ord", "pos")
            one = one.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
        return one.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "x"))),
                                                     lambda e: e["x"]).alias(col))

    none = F.array().cast("array<string>")
    out = head.join(first("business_rules"), "target", "left").join(first("risks"), "target", "left")
    return out.select("target", F.coalesce("purpose", F.lit("")).alias("purpose"),
                      F.coalesce("business_rules", none).alias("business_rules"),
                      F.coalesce("risks", none).alias("risks"), "complexity")
