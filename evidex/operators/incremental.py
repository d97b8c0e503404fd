"""Re-runs and snapshots: hashes, fingerprints, reuse, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.graph import transitive_closure
from evidex.operators.scale import SALTS, digest_of, digest_words, hot_keys, set_digest, side_by_side


def class_hashes(classes: DataFrame) -> DataFrame:
    return classes.select("class_name", F.md5(F.coalesce("source", F.lit(""))).alias("hash"))


def domain_hashes(classes: DataFrame, domain: str = "domain") -> DataFrame:
    """(domain, n, digest) over a domain's (class, text) pairs.

    The digest is a sum of hashes instead of a hash of one long concatenation: it changes
    with any class or text and a domain of any size needs constant state.
    """
    return set_digest(classes, [domain], F.concat_ws(":", F.col("class_name"), F.md5("source")))


def recipe_hash(version: Column, provider: Column, model: Column, schema_json: Column, mappings_json: Column) -> Column:
    v = F.concat(F.lit("v"), version.cast("string"))
    return F.md5(F.concat_ws("|", v, F.coalesce(provider, F.lit("")), F.coalesce(model, F.lit("")),
                             F.md5(schema_json), F.md5(mappings_json)))


def transitive_deps(own: DataFrame, deps: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, class_name): ``deps`` and all that a class of ``own`` or ``deps`` reaches.

    ``edges(src, dst)`` are the dependencies of all classes; cycles are allowed.
    """
    start = own.select("target", "class_name").unionByName(deps.select("target", "class_name"))
    return deps.select("target", "class_name").unionByName(reached(start, edges)).distinct()


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, class_name) that the classes of ``start`` reach over ``edges``, with repeats.

    Where ``deps`` has all that the classes of ``own`` need themselves, what these reach is in
    ``deps`` or reached from there, so ``deps`` is start enough.
    """
    reach = transitive_closure(edges).withColumnRenamed("node", "class_name")
    return start.select("target", "class_name").distinct().join(reach, "class_name").select(
        "target", F.col("reach").alias("class_name"))


def target_fingerprint(plan: DataFrame, own: DataFrame, deps: DataFrame, hashes: DataFrame, recipe: Column,
                       fields: list[str]) -> DataFrame:
    """(target, fingerprint) over recipe, plan fields, own hashes and dependency hashes minus own.

    ``own(target, class_name)``, ``deps(target, class_name)``, ``hashes(class_name, hash)``. A
    change counts at the depth that ``deps`` has; ``transitive_deps`` gives all of it. Rows meet
    the hash of their class once; repeats, own classes among dependencies and digests are then
    settled by target in one shuffle. Targets with many classes of their own are dealt over salts.
    """
    rows = own.select("target", "class_name", F.lit(False).alias("_dep")).unionByName(
        deps.select("target", "class_name", F.lit(True).alias("_dep"))).join(hashes, "class_name", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("class_name"), F.lit(SALTS))).otherwise(0)
    rows = rows.join(F.broadcast(hot_keys(own.select("target"), "target")), "target", "left").withColumn("_salt", salt.cast("int"))
    # All repeats of a class lie in one partition then; a class of the target's own is no dependency.
    near = rows.select("target", "_salt", "class_name", "hash", "_dep").repartition("target", "_salt")
    once = near.groupBy("target", "_salt", "class_name", "hash").agg(F.min("_dep").alias("_dep"))
    item = F.concat(F.when(F.col("_dep"), "dep:").otherwise(""), "class_name", F.lit(":"), F.coalesce("hash", F.lit("")))
    d = once.withColumn("_h", F.md5(item)).groupBy("target").agg(F.count(F.lit(1)).alias("n"), *digest_words(F.col("_h")))
    d = d.select("target", digest_of(F.col("n")).alias("digest"))
    head = F.concat_ws("|", "target", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    out = plan.join(d, "target", "left")
    return out.select("target", F.md5(F.concat_ws("||", recipe, head, F.coalesce("digest", F.lit("")))).alias("fingerprint"))


def reuse_or_rebuild(new: DataFrame, state: DataFrame, recipe: Column, version: int = 1) -> DataFrame:
    """(target, decision): reuse on an equal stored fingerprint with a result, same recipe and version."""
    ok = state.filter((F.col("recipe") == recipe) & (F.col("version") == version)).select(
        "target", F.col("fingerprint").alias("_old"), F.col("result").isNotNull().alias("_has"))
    j = new.join(ok, "target", "left")
    same = F.col("fingerprint").eqNullSafe(F.col("_old")) & F.coalesce("_has", F.lit(False))
    return j.select("target", F.when(same, "reuse").otherwise("rebuild").alias("decision"))


def reuse_counts(decisions: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("decision") == d)
    return decisions.agg(n("reuse").alias("reused"), n("rebuild").alias("rebuilt"))


def merged_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored rows not rebuilt plus the fresh ones."""
    return state.join(fresh.select("target"), "target", "left_anti").unionByName(fresh)


def prefix_invalidation(domains: DataFrame) -> DataFrame:
    """Add ``reuse`` to domains(domain, pos, changed): unchanged, and nothing changed before.

    The first changed position is one aggregate value, so no ordered pass over all domains.
    """
    first = domains.agg(F.min(F.when(F.col("changed"), F.col("pos")))).scalar()
    return domains.withColumn("reuse", ~F.col("changed") & F.coalesce(F.col("pos") < first, F.lit(True)))


def source_fingerprint(classes: DataFrame) -> DataFrame:
    """One row: 16 hex characters over all class names and texts, independent of order."""
    h = F.md5(F.concat_ws(":", F.col("class_name"), F.sha2(F.coalesce("source", F.lit("")), 256)))
    one = classes.select(h.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *digest_words(F.col("_h")))
    return one.select(F.substring(F.sha2(digest_of(F.col("n")), 256), 1, 16).alias("fingerprint"))


def snapshot_list(manifest: DataFrame, plan: DataFrame, artifacts: DataFrame, classes: DataFrame) -> DataFrame:
    """Snapshots with class, plan, convert, skip, artifact and failed counts, keyed by snapshot_id."""
    k = "snapshot_id"
    p = plan.groupBy(k).agg(F.count(F.lit(1)).alias("plan_items"), F.count_if(F.col("target_kind") != "Skip").alias("convert"),
                            F.count_if(F.col("target_kind") == "Skip").alias("skip"))
    a = artifacts.groupBy(k).agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("status") == "error").alias("failed"))
    c = classes.groupBy(k).agg(F.count(F.lit(1)).alias("classes"))
    out = manifest.join(p, k, "left").join(a, k, "left").join(c, k, "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
    counts = [z(n) for n in ("classes", "plan_items", "convert", "skip", "artifacts", "failed")]
    return out.select(*manifest.columns, *counts).orderBy(F.desc("at"), F.desc(k))


def snapshot_plan_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """changes(target, kind, from_kind, to_kind) between plans(target, target_kind, recommendation)."""
    side = lambda d, p: d.select("target", F.struct("target_kind", "recommendation").alias(p))
    j = side(a, "x").join(side(b, "y"), "target", "full_outer")
    kind = (F.when(F.col("y").isNull(), "removed").when(F.col("x").isNull(), "added")
            .when(~F.col("x").eqNullSafe(F.col("y")), "changed"))
    return j.withColumn("kind", kind).filter("kind is not null").select(
        "target", "kind", F.col("x.target_kind").alias("from_kind"), F.col("y.target_kind").alias("to_kind"))


def snapshot_artifact_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """changes(target, kind, from_status, to_status) between artifacts(target, main_text, test_text, status).

    Code is compared by hash, so texts do not travel.
    """
    def side(d: DataFrame, p: str) -> DataFrame:
        code = F.md5(F.concat(F.coalesce("main_text", F.lit("")), F.lit("\0"), F.coalesce("test_text", F.lit(""))))
        return d.select("target", F.struct(code.alias("code"), F.col("status").alias("status")).alias(p))

    j = side(a, "x").join(side(b, "y"), "target", "full_outer")
    kind = (F.when(F.col("y").isNull(), "gone").when(F.col("x").isNull(), "new")
            .when(F.col("x.code") != F.col("y.code"), "regenerated")
            .when(~F.col("x.status").eqNullSafe(F.col("y.status")), "status"))
    return j.withColumn("kind", kind).filter("kind is not null").select(
        "target", "kind", F.col("x.status").alias("from_status"), F.col("y.status").alias("to_status"))


def snapshot_summary(plan_a: DataFrame, plan_b: DataFrame, arts_a: DataFrame, arts_b: DataFrame) -> DataFrame:
    """One row: changes of both kinds, and the deltas in converted and failed."""
    n = lambda d, cond, name: d.agg(F.count_if(cond).alias(name))
    conv, fail = F.col("target_kind") != "Skip", F.col("status") == "error"
    one = side_by_side(
        snapshot_plan_diff(plan_a, plan_b).agg(F.count(F.lit(1)).alias("plan_changed")),
        snapshot_artifact_diff(arts_a, arts_b).agg(F.count(F.lit(1)).alias("artifacts_changed")),
        n(plan_a, conv, "_ca"), n(plan_b, conv, "_cb"), n(arts_a, fail, "_fa"), n(arts_b, fail, "_fb"))
    return one.select("plan_changed", "artifacts_changed", (F.col("_cb") - F.col("_ca")).alias("convert_delta"),
                      (F.col("_fb") - F.col("_fa")).alias("failed_delta"))
