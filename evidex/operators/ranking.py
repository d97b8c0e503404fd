"""What a person must look at: triage, confidence, status, sign-off, caveats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.operators.scale import side_by_side, split_join


def own_hazards(sources: DataFrame, hazards: DataFrame) -> DataFrame:
    """Distinct (target, hazard_id, severity, rule): hazards matched by file or by class.

    ``sources(target, class_name, file)`` with file as a bare name, ``hazards(id, severity,
    rule, file, source_class)``.
    """
    keys = lambda f, c: F.explode(F.array_distinct(F.array(F.concat(F.lit("f:"), f), F.concat(F.lit("c:"), c)))).alias("_k")
    h = hazards.select(F.col("id").alias("hazard_id"), "severity", "rule", keys(F.col("file"), F.col("source_class")))
    s = sources.select("target", keys(F.col("file"), F.col("class_name"))).distinct()
    # A file or class may have a third of all sources: their rows meet its hazards in salted parts.
    return split_join(s, h, "_k", "inner").drop("_k").dropDuplicates(["target", "hazard_id"])


def triage(artifacts: DataFrame, sources: DataFrame, hazards: DataFrame, findings: DataFrame,
           profiles: DataFrame) -> DataFrame:
    """(target, layer, score, band, critical, high, medium, errors, warnings, rules, complexity, reasons).

    ``artifacts(target, layer, status, review_flags array, rules)``, ``findings(target,
    severity)``, ``profiles(class_name, complexity)``. Counts are aggregated before they meet
    the artifacts.
    """
    sev = F.lower("severity")
    hz = own_hazards(sources, hazards).groupBy("target").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")],
        F.array_sort(F.collect_set(F.when(F.col("severity") == "critical", F.col("rule")))).alias("crit_rules"))
    fd = findings.groupBy("target").agg(
        F.count_if(sev.isin("error", "critical")).alias("errors"),
        F.count_if(sev.isin("warning", "warn", "medium")).alias("warnings"))
    cx = F.lower("complexity")
    cp = sources.select("target", "class_name").distinct().join(profiles, "class_name").groupBy("target").agg(
        F.max(F.when(cx == "high", 2).when(cx == "medium", 1).otherwise(0)).alias("cx"))
    a = artifacts.join(hz, "target", "left").join(fd, "target", "left").join(cp, "target", "left")
    for c in ("critical", "high", "medium", "errors", "warnings", "cx"):
        a = a.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    w = R.WEIGHTS
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    flags = F.size("review_flags")
    score = (F.when(failed, w["failed"]).otherwise(0) + w["critical"] * F.col("critical") + w["high"] * F.col("high")
             + w["medium"] * F.col("medium") + w["error"] * F.col("errors") + w["warning"] * F.col("warnings")
             + w["flag"] * flags + w["rule"] * F.col("rules")
             + F.when(F.col("cx") == 2, w["complex_high"]).when(F.col("cx") == 1, w["complex_medium"]).otherwise(0))
    a = a.withColumn("score", score.cast("bigint"))
    forced = failed | (F.col("critical") > 0) | (F.col("errors") > 0) | (F.col("score") >= R.MUST_REVIEW)
    band = F.when(forced, "must").when(F.col("score") >= R.ELEVATED, "review").otherwise("routine")
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    text = lambda c: F.col(c).cast("string")
    reasons = F.array_compact(F.array(
        say(failed, "did not build — needs manual migration"),
        say(F.col("critical") > 0, text("critical"), " critical migration hazard(s) in its source (",
            F.array_join("crit_rules", ", "), ")"),
        say(F.col("high") > 0, text("high"), " high-severity hazard(s) in its source"),
        say(F.col("errors") > 0, "the Critic raised ", text("errors"), " unresolved error(s)"),
        say(flags > 0, "flagged for review: ", F.array_join("review_flags", "; ")),
        say(F.col("rules") > 0, "carries ", text("rules"), " business rule(s)"),
        say(F.col("cx") == 2, "the source was assessed as high complexity")))
    a = a.withColumn("band", band).withColumn("_r", reasons)
    plain = F.col("layer").isin(*R.MECHANICAL_LAYERS) & (F.size("_r") == 0) & (F.col("band") == "routine")
    clean = F.array(F.lit("mechanical layer, built clean, carries no business rules"))
    return a.select("target", "layer", "score", "band", "critical", "high", "medium", "errors", "warnings", "rules",
                    F.when(F.col("cx") == 2, "High").when(F.col("cx") == 1, "Medium").otherwise("—").alias("complexity"),
                    F.when(plain, clean).otherwise(F.col("_r")).alias("reasons")).orderBy(F.desc("score"), "target")


def triage_summary(items: DataFrame) -> DataFrame:
    n = lambda b: F.count_if(F.col("band") == b)
    return items.agg(F.count(F.lit(1)).alias("total"), *[n(b).alias(b) for b in ("must", "review", "routine")],
                     (n("must") + n("review")).alias("needs_you"))


def confidence(artifacts: DataFrame, issues: DataFrame) -> DataFrame:
    """(target, score, label, basis) of artifacts(target, ran, deploy_ok, failed, healed, verified) and issues(target, severity)."""
    per = issues.groupBy("target").agg(F.count_if(F.col("severity") == "ERROR").alias("e"),
                                       F.count_if(F.col("severity") != "ERROR").alias("w"))
    a = artifacts.join(per, "target", "left").withColumn("e", F.coalesce("e", F.lit(0))).withColumn(
        "w", F.coalesce("w", F.lit(0)))
    base = 100 - 22 * F.col("e") - 7 * F.col("w")
    ran, bad, ok = F.col("ran"), F.col("failed"), F.col("deploy_ok")
    raw = (F.when(ran & bad, F.least(base, F.lit(45))).when(ran & ok & (F.col("e") == 0), F.greatest(base, F.lit(88)))
           .when(ran, base).otherwise(F.least(base, F.lit(75))))
    score = F.greatest(F.lit(5), F.least(F.lit(99), raw)).cast("bigint")
    basis = F.array_compact(F.array(
        F.when(ran & bad, "failed org deploy").when(ran & ok, "deployed cleanly to org"),
        F.when(ran & F.col("healed"), "auto-healed from compiler errors"),
        F.when(~ran, F.when(F.col("verified"), "unverified — no org deploy").otherwise("offline validation only")),
        F.when(F.col("e") > 0, F.concat(F.col("e").cast("string"), F.lit(" offline error(s)"))),
        F.when(F.col("w") > 0, F.concat(F.col("w").cast("string"), F.lit(" warning(s)")))))
    text = F.array_join(basis, ", ")
    return a.select("target", score.alias("score"), F.when(score >= 85, "High").when(score >= 60, "Medium").otherwise("Low").alias("label"),
                    F.when(text == "", "offline validation clean").otherwise(text).alias("basis"))


def artifact_status(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """error if the build failed, accepted without a critic or without errors, else needs_review."""
    per = findings.groupBy("target").agg(F.bool_or(F.col("severity") == "ERROR").alias("_bad"))
    out = artifacts.join(per, "target", "left")
    bad = F.coalesce("_bad", F.lit(False)) & F.col("critic")
    return out.select("target", F.when(~F.col("built"), "error").when(bad, "needs_review").otherwise("accepted").alias("status"))


def approval_rollup(approvals: DataFrame) -> DataFrame:
    """One row: supervised, reviewers, gates reviewed and auto-approved (few fixed gates)."""
    s = F.col("supervised")
    some = lambda c, cond: F.array_sort(F.collect_set(F.when(cond, F.col(c))))
    return approvals.agg(
        F.coalesce(F.bool_or(s), F.lit(False)).alias("supervised"),
        F.countDistinct(F.when(s, F.nullif("actor", F.lit("")))).alias("reviewers"),
        some("gate", s).alias("gates_reviewed"), some("gate", ~s).alias("gates_auto"))


def signoff_rollup(approvals: DataFrame, *summaries: DataFrame) -> DataFrame:
    """One row of one-row tables; ``contract_id`` hashes the facts, so equal facts agree."""
    out = side_by_side(approval_rollup(approvals), *summaries)
    return out.withColumn("contract_id", F.substring(F.sha2(F.to_json(F.struct(*out.columns)), 256), 1, 16))


def decision_log(decisions: DataFrame) -> DataFrame:
    """Per agent: entries and open questions of decisions(agent, action, detail)."""
    return decisions.groupBy("agent").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("action") == "question").alias("open_questions"))


def caveat_rows(contract: DataFrame) -> DataFrame:
    """caveats(ord, kind, n): one row per claim the contract row does not meet."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint")
    missing = F.size(F.array_except(F.array(*[F.lit(g) for g in R.GATES]), "gates_reviewed"))
    made = [
        ("no reviewer", ~F.col("supervised"), F.lit(0)),
        ("gates without a reviewer", F.col("supervised") & (missing > 0), missing),
        ("unaccounted", c("unaccounted") > 0, c("unaccounted")), ("overwritten", c("overwritten") > 0, c("overwritten")),
        ("unreadable", c("unreadable") > 0, c("unreadable")), ("rules dropped", c("dropped") > 0, c("dropped")),
        ("rules at risk", c("at_risk") > 0, c("at_risk")),
        ("rules not asserted", (c("rules") > 0) & (c("asserted") < c("rules")), c("rules") - c("asserted")),
        ("behaviours not replayed", (c("behaviours") > 0) & (c("runnable") < c("behaviours")), c("behaviours") - c("runnable")),
        ("no recorded behaviours", c("behaviours") == 0, F.lit(0)),
        ("source methods without target", c("without_target") > 0, c("without_target")),
        ("generated methods without origin", c("without_origin") > 0, c("without_origin")),
        ("critical or high hazards", c("critical") + c("high") > 0, c("critical") + c("high")),
        ("never deployed", ~F.col("org_verified"), F.lit(0)),
    ]
    rows = F.array(*[F.when(cond, F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(k).alias("kind"),
                                           n.cast("bigint").alias("n"))) for i, (k, cond, n) in enumerate(made, 1)])
    return contract.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")
