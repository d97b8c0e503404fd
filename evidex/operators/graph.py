"""Dependency graphs: domain edges, levels, closure, calls, blast radius.

Iterative jobs write the frontier to the reliable checkpoint folder each round, so lineage
stays short and a lost executor costs one round at most. Nothing but the question whether
rows are left returns to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators.extract import symbols_of
from evidex.operators.scale import computed, global_rank, settled


def domain_graph(classes: DataFrame) -> DataFrame:
    """domain_edges(src, dst): a class of src names a class of dst as a whole word.

    ``classes(class_name, domain, text)``. Words are made distinct per domain before the
    equi-join on class names, so a popular name costs one row per domain.
    """
    words = F.array_distinct(F.regexp_extract_all(
        T.strip_comments_simple(F.col("text")), F.lit(r"\w+"), F.lit(0)))
    said = classes.select(F.col("domain").alias("src"), F.explode(words).alias("class_name")).distinct()
    home = classes.groupBy("class_name").agg(F.max("domain").alias("dst"))
    return said.join(home, "class_name").filter("src <> dst").select("src", "dst").distinct()


def _plain(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def _back_edges(left: DataFrame) -> DataFrame:
    """Edges to a smaller name in the cyclic core: what is left after peeling both ends."""
    core, n = left, -1
    while True:
        users = core.select(F.col("dst").alias("src")).distinct()
        core = settled(core.join(users, "src", "left_semi").select("src", "dst"))
        last, n = n, core.count()
        if n == last:
            return core.filter("dst < src")


LONGEST = 1 << 40


def peeled_levels(plain: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame | None]:
    """(node, level) of nodes with edges (src, dst), and the weighted edges that are left if only cycles are.

    ``left(src, dst, w)`` says that src lies at least w above dst, ``known(node, level)`` what
    resolved edges say already. Each round resolves edges into leaves, and an edge into a
    node with one edge of its own jumps over it, so a chain halves in length each round.
    """
    left = plain.withColumn("w", F.lit(1).cast("bigint"))
    known = left.limit(0).select(F.col("src").alias("node"), F.col("w").alias("level"))
    for _ in range(max_rounds):
        if left.isEmpty():
            return known, None
        own = left.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("on"), F.max("w").alias("w2"))
        step = left.join(own.withColumnRenamed("src", "dst"), "dst", "left").join(
            known.withColumnRenamed("node", "dst"), "dst", "left")
        step = settled(step)
        if step.filter("n is null").isEmpty():
            return known, left
        said = step.filter("n is null or (n = 1 and level is not null)").select(
            F.col("src").alias("node"), (F.col("w") + F.coalesce("level", F.lit(0))).alias("level"))
        known = settled(known.unionByName(said).groupBy("node").agg(F.max("level").alias("level")))
        jumps = (F.col("n") == 1) & (F.col("on") != F.col("src"))
        ahead = step.filter("n is not null").select(
            "src", F.when(jumps, F.col("on")).otherwise(F.col("dst")).alias("dst"),
            F.when(jumps, F.least(F.col("w") + F.col("w2"), F.lit(LONGEST))).otherwise(F.col("w")).alias("w"))
        left = settled(ahead.groupBy("src", "dst").agg(F.max("w").alias("w")))
    raise RuntimeError("levels did not settle")


def wavefront_levels(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(node, level): longest path to a leaf dependency; src depends on dst.

    Rounds grow with the logarithm of chains and with the depth of what branches; each is a
    few written tables. Where only cycles are left, edges of the cyclic core that point to a
    smaller name count as back edges; the levels are then those of the graph without them, so
    every node gets one.
    """
    plain = settled(_plain(edges))
    ends = plain.select(F.col("src").alias("node")).union(plain.select("dst"))
    while True:
        known, left = peeled_levels(plain, max_rounds)
        if left is None:
            break
        open_ = left.select("src").distinct()
        core = plain.join(open_, "src", "left_semi").join(open_.withColumnRenamed("src", "dst"), "dst", "left_semi")
        plain = settled(plain.join(_back_edges(core.select("src", "dst")), ["src", "dst"], "left_anti"))
    every = ends if nodes is None else ends.union(nodes.select("node"))
    return every.distinct().join(known, "node", "left").select(
        "node", F.coalesce("level", F.lit(0)).cast("bigint").alias("level"))


def topological_schedule(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level, position): dependencies before dependents, ties by name."""
    return global_rank(wavefront_levels(edges, nodes), [F.col("level"), F.col("node")], "position")


def transitive_closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, reach): everything reachable, in as many rounds as the logarithm of the depth.

    Round k knows the pairs joined by 1..2^k edges (``seen``) and by exactly 2^k (``leap``);
    a leap followed by a seen path gives the next 2^k lengths. It stops when a round adds
    nothing, so cycles end it too.
    """
    base = _plain(edges).select(F.col("src").alias("node"), F.col("dst").alias("reach"))
    seen = leap = settled(base)
    for _ in range(max_rounds):
        first = leap.select("node", F.col("reach").alias("_mid"))

        def then(paths: DataFrame) -> DataFrame:
            second = paths.select(F.col("node").alias("_mid"), "reach")
            return first.join(second, "_mid").select("node", "reach").distinct()

        fresh = settled(then(seen).join(seen, ["node", "reach"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = seen.unionByName(fresh)
        leap = settled(then(leap))
    raise RuntimeError("closure did not settle")


_DECL = r"\bpublic\s+(?:[a-zA-Z0-9_<>]+\s+)?([a-zA-Z0-9_]+)\s*\(([^)]*)\)"
_VAR = r"\b(?:private|protected|public)?\s+(\w+)\s+(\w+)\s*;"
# Words that look like a declared method.
_NOT_METHODS = ("if", "for", "while", "switch", "return", "catch", "synchronized")
_CALL = r"\b(\w+)\.(\w+)\s*\("


def _layer(name):
    return (F.when(name.contains("Controller"), "Controller").when(name.contains("Facade"), "Facade")
            .when(name.contains("Service"), "Service").when(name.contains("Dao") | name.contains("DAO"), "DAO")
            .when(name.contains("Model") | name.contains("DTO"), "Model").otherwise("Utility"))


def declared_methods(files: DataFrame) -> DataFrame:
    """(class_name, ord, method, text position of its first hit) per public method."""
    t = F.col("text")
    names = F.filter(F.regexp_extract_all(t, F.lit(_DECL), F.lit(1)), lambda m: ~m.isin(*_NOT_METHODS))
    src = files.filter(t.rlike(r"\b(?:class|interface)\s+\w+")).withColumn(
        "class_name", F.regexp_extract("text", r"\b(?:class|interface)\s+(\w+)\b", 1))
    return computed(src.select("class_name", "text"), names=names)


def method_calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, class_name, layer), links(source, target)).

    Calls ``x.y(`` in a method's own lines (see ``symbol_table``); x is resolved by field
    type, else by itself; kept if that class declares y. Without any link, classes that name
    a class of the next layer are linked by their first methods. Bodies are read inside the row
    of their file; only calls become rows.
    """
    src = declared_methods(files)
    methods = src.select("class_name", F.posexplode("names").alias("ord", "method"))
    nodes = methods.select(F.concat_ws(".", "class_name", "method").alias("id"), "class_name",
                           _layer(F.col("class_name")).alias("layer")).distinct()
    t = F.col("text")
    own = computed(src, _s=F.filter(symbols_of(T.strip_code_comments(t)), lambda s: F.array_contains("names", s["name"])), _l=T.lines(t))

    def said(s: Column) -> Column:
        body = F.array_join(F.slice("_l", s["line_start"].cast("int"), (s["line_end"] - s["line_start"] + 1).cast("int")), "\n")
        found = F.regexp_extract_all(body, F.lit(_CALL), F.lit(0))
        return F.transform(F.array_distinct(found), lambda c: F.struct(
            s["name"].alias("method"), F.regexp_extract(c, _CALL, 1).alias("who"), F.regexp_extract(c, _CALL, 2).alias("callee")))

    calls = computed(own, _c=F.flatten(F.transform("_s", said))).select("class_name", F.explode("_c").alias("c")).select(
        "class_name", "c.method", "c.who", "c.callee").distinct()
    v = F.arrays_zip(F.regexp_extract_all(t, F.lit(_VAR), F.lit(1)).alias("type"),
                     F.regexp_extract_all(t, F.lit(_VAR), F.lit(2)).alias("who"))
    fields = src.select("class_name", F.posexplode(v).alias("_o", "f")).groupBy(
        "class_name", F.col("f.who").alias("who")).agg(F.max_by("f.type", "_o").alias("type"))
    known = methods.select(F.col("class_name").alias("target_class"), F.col("method").alias("callee")).distinct()
    links = (calls.join(fields, ["class_name", "who"], "left")
             .withColumn("target_class", F.coalesce("type", "who")).join(known, ["target_class", "callee"])
             .select(F.concat_ws(".", "class_name", "method").alias("source"),
                     F.concat_ws(".", "target_class", "callee").alias("target")).distinct())
    first = methods.groupBy("class_name").agg(F.min_by("method", "ord").alias("first"))
    said = src.select("class_name", F.explode(F.array_distinct(F.regexp_extract_all(
        t, F.lit(r"\w+"), F.lit(0)))).alias("named"))
    pair = (said.join(first, "class_name").join(first.select(F.col("class_name").alias("named"),
                                                            F.col("first").alias("first2")), "named"))
    c, d = F.col("class_name"), F.col("named")
    dao = d.contains("Dao") | d.contains("DAO")
    pair = pair.filter((c.contains("Controller") & d.contains("Service")) | (c.contains("Service") & dao)).filter(
        "class_name <> named")
    none = links.limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    spare = pair.filter(none).select(
        F.concat_ws(".", "class_name", "first").alias("source"), F.concat_ws(".", "named", "first2").alias("target"))
    return nodes, links.unionByName(spare.distinct())


def blast_radius(edges: DataFrame, own: DataFrame, max_depth: int = 3) -> DataFrame:
    """(target, class_name, distance): dependents within ``max_depth`` of the target's classes.

    ``edges(src, dst)``: src depends on dst. All targets walk at once; a round joins the new
    classes only, and a class keeps its smallest distance.
    """
    rev = _plain(edges).select(F.col("dst").alias("class_name"), F.col("src").alias("dependent"))
    mine = own.select("target", "class_name").distinct()
    frontier, parts = mine, []
    seen = mine
    for d in range(1, max_depth + 1):
        step = frontier.join(rev, "class_name").select("target", F.col("dependent").alias("class_name")).distinct()
        frontier = settled(step.join(seen, ["target", "class_name"], "left_anti"))
        parts.append(frontier.withColumn("distance", F.lit(d).cast("bigint")))
        seen = seen.unionByName(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blast_rollup(radius: DataFrame, carriers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """affected(target, affected, distance, n_via, rules, test_class, direct).

    ``carriers(class_name, target)`` names the artifact of each class, ``artifacts(target,
    rules, test_text)``. The via classes themselves are the rows of ``radius``.
    """
    c = carriers.select("class_name", F.col("target").alias("affected"))
    hit = radius.join(c, "class_name").filter("affected <> target")
    per = hit.groupBy("target", "affected").agg(
        F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_via"))
    a = artifacts.select(F.col("target").alias("affected"), "rules", F.when(
        T.strip(F.coalesce("test_text", F.lit(""))) != "", F.concat("target", F.lit("Test"))).alias("test_class"))
    return per.join(a, "affected").select(
        "target", "affected", "distance", "n_via", "rules", "test_class", (F.col("distance") == 1).alias("direct"))


def blast_summary(affected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per target: direct, indirect, tests to rerun, rules at risk (own plus direct)."""
    per = affected.groupBy("target").agg(
        F.count_if("direct").alias("direct"), F.count_if(~F.col("direct")).alias("indirect"),
        F.count("test_class").alias("tests"),
        F.coalesce(F.sum(F.when(F.col("direct"), F.col("rules"))), F.lit(0)).alias("r"))
    a = artifacts.select("target", F.col("rules").alias("own"), (
        T.strip(F.coalesce("test_text", F.lit(""))) != "").cast("int").alias("own_test"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return a.join(per, "target", "left").select(
        "target", z("direct").alias("direct"), z("indirect").alias("indirect"),
        (z("tests") + F.col("own_test")).alias("tests"), (F.col("own") + z("r")).cast("bigint").alias("rules_at_risk"))


def shared_objects(refs: DataFrame) -> DataFrame:
    """(target, object) for objects that another target writes too.

    An object is shared iff its smallest and largest writer differ: no self-join, so a
    popular object costs no pairs.
    """
    r = refs.select("target", "object").distinct()
    shared = r.groupBy("object").agg(F.min("target").alias("a"), F.max("target").alias("b")).filter("a <> b")
    return r.join(shared.select("object"), "object", "left_semi").select("target", "object")
