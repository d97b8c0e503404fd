"""Graphs, targets, ledgers on literal rows."""

import random

from pyspark.sql import functions as F

from evidex.operators import graph as G
from evidex.operators import planning as L


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_levels_of_a_dag(spark):
    e = edges(spark, ("c", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "c"))
    nodes = spark.createDataFrame([("d",)], "node string")
    got = {r["node"]: r["level"] for r in G.wavefront_levels(e, nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "e": 3, "d": 0}
    order = [r["node"] for r in G.topological_schedule(e, nodes).orderBy("position").collect()]
    assert order == ["a", "d", "b", "c", "e"]


def test_levels_with_cycles_cover_every_node(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "leaf"), ("m", "n"), ("n", "m"))
    got = {r["node"]: r["level"] for r in G.wavefront_levels(e).collect()}
    assert set(got) == {"a", "b", "c", "x", "leaf", "m", "n"}
    assert got["leaf"] == 0 and got["c"] == 1 and got["b"] == 2 and got["a"] == 3 and got["x"] == 4
    assert got["n"] == 0 and got["m"] == 1


def test_closure_with_cycle(spark):
    got = {(r["node"], r["reach"]) for r in G.transitive_closure(edges(spark, ("a", "b"), ("b", "c"), ("c", "b"))).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "b"), ("c", "b"), ("c", "c")}


def test_domain_graph_ignores_comments_and_parts_of_words(spark):
    rows = [("Order", "Order", "class Order { OrderEntryX e; /* Cart */ String s = \"Cart\"; Price p; }"),
            ("Cart", "Cart", "Order o; // Price"), ("Price", "Price", "")]
    c = spark.createDataFrame(rows, "class_name string, domain string, text string")
    assert {tuple(r) for r in G.domain_graph(c).collect()} == {("Order", "Price"), ("Cart", "Order")}


def test_method_calls_and_fallback(spark):
    a = "public class ACtl {\n private BService svc;\n public void go() { svc.run(); other.run(); CDao.load(); }\n}"
    b = "public class BService {\n public void run() { }\n}"
    c = "public class CDao {\n public Foo load(int i) { }\n}"
    files = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "file string, text string")
    nodes, links = G.method_calls(files)
    assert {tuple(r) for r in links.collect()} == {("ACtl.go", "BService.run"), ("ACtl.go", "CDao.load")}
    assert {r["id"]: r["layer"] for r in nodes.collect()} == {"ACtl.go": "Utility", "BService.run": "Service", "CDao.load": "DAO"}
    plain = [("a", "public class AController { BService x; public void go() { } }"), ("b", b)]
    _, links = G.method_calls(spark.createDataFrame(plain, "file string, text string"))
    assert [tuple(r) for r in links.collect()] == [("AController.go", "BService.run")]


def test_blast(spark):
    e = edges(spark, ("B", "A"), ("C", "B"), ("D", "C"), ("E", "D"), ("C", "A2"), ("A2", "A"))
    own = spark.createDataFrame([("T", "A"), ("T", "A2"), ("U", "C")], "target string, class_name string")
    r = G.blast_radius(e, own)
    got = {(x["target"], x["class_name"]): x["distance"] for x in r.collect()}
    assert got == {("T", "B"): 1, ("T", "C"): 1, ("T", "D"): 2, ("T", "E"): 3, ("U", "D"): 1, ("U", "E"): 2}
    carriers = spark.createDataFrame([("A", "T"), ("B", "V"), ("C", "U"), ("D", "V"), ("E", "W")], "class_name string, target string")
    arts = spark.createDataFrame([("T", 1, "x"), ("U", 2, " "), ("V", 5, "t"), ("W", 7, None)], "target string, rules long, test_text string")
    aff = G.blast_rollup(r, carriers, arts)
    rows = {(x["target"], x["affected"]): (x["distance"], x["n_via"], x["test_class"], x["direct"]) for x in aff.collect()}
    assert rows == {("T", "V"): (1, 2, "VTest", True), ("T", "U"): (1, 1, None, True), ("T", "W"): (3, 1, None, False),
                    ("U", "V"): (1, 1, "VTest", True), ("U", "W"): (2, 1, None, False)}
    s = {x["target"]: (x["direct"], x["indirect"], x["tests"], x["rules_at_risk"]) for x in G.blast_summary(aff, arts).collect()}
    assert s["T"] == (2, 1, 2, 8) and s["W"] == (0, 0, 0, 7)


def test_shared_objects(spark):
    refs = spark.createDataFrame([("A", "O"), ("A", "O"), ("B", "O"), ("A", "P")], "target string, object string")
    assert {tuple(r) for r in G.shared_objects(refs).collect()} == {("A", "O"), ("B", "O")}


def test_targets(spark):
    rows = [("PricingService", "Service", "a", 1), ("DefaultPricingService", "Service", "b", 2), ("DefaultPricingService", "Service", "b", 3),
            ("DefaultPricingService", "Service", "c", 4), ("PricingFacade", "Facade", "d", 0), ("CartFacade", "Facade", "e", 5), ("OrderDao", "DAO", "f", 6),
            ("Order", "Model", "g", 7), ("StaleCartJob", "Job", "h", 8), ("Util", "Utility", "i", 9), ("ProductListComponent", "Component", "j", 10)]
    src = L.plan_targets(spark.createDataFrame(rows, "class_name string, layer string, file string, ord int"))
    targets, sources = L.merge_targets(src)
    assert {(r["target"], r["layer"], r["n_sources"]) for r in targets.collect()} == {
        ("PricingService", "Service", 4), ("CartService", "Service", 1), ("OrderSelector", "DAO", 1), ("StaleCartScheduler", "Job", 1),
        ("Util", "Utility", 1), ("productList", "Component", 1)}
    first = [r["file"] for r in sources.filter("target = 'PricingService'").orderBy("at").collect()]
    assert first == ["a", "b", "c", "d"]


def test_overrides(spark):
    plan = spark.createDataFrame([("A", "Convert", "r"), ("B", "Skip", "r"), ("C", "Skip", "r"), ("D", "Flow", "r")], "target string, target_kind string, rationale string")
    over = spark.createDataFrame([("A", "Skip"), ("B", "Convert"), ("C", "Skip"), ("D", "Convert")], "target string, decision string")
    got = {r["target"]: (r["target_kind"], r["rationale"], r["changed"]) for r in L.apply_overrides(plan, over).collect()}
    assert got == {"A": ("Skip", "excluded by reviewer", True), "B": ("Convert", "included by reviewer", True), "C": ("Skip", "r", False), "D": ("Flow", "r", False)}


def test_collisions_and_ledger(spark):
    arts = spark.createDataFrame([(1, "Pricing", "Service", []), (2, "Pricing", "Service", []), (3, "Pricing", "Component", []), (4, "Cart", "Service", ["CPQ"]),
                                  (5, "Late", "DAO", [])], "artifact_id int, target string, layer string, review_flags array<string>")
    assert {r["artifact_id"] for r in L.output_collisions(arts).collect()} == {1, 2}
    sources = spark.createDataFrame([(1, "P", 1), (3, "L", 1), (4, "C", 1), (1, "Twice", 1), (5, "Twice", 2)], "artifact_id int, class_name string, ord int")
    classes = spark.createDataFrame([("P", "Service"), ("L", "Component"), ("C", "Service"), ("M", "Model"), ("S", "DAO"), ("U", "DAO"), ("Twice", "DAO")],
                                    "class_name string, layer string")
    skips = spark.createDataFrame([("S", "native", 1), ("S", "", 2)], "class_name string, rationale string, ord int")
    bad = spark.createDataFrame([("X", "not a text file", "X.java")], "class_name string, reason string, file string")
    led = L.completeness_ledger(classes, arts, sources, skips, bad)
    got = {r["source"]: (r["outcome"], r["target"]) for r in led.collect()}
    assert got == {"P": ("overwritten", "Pricing.cls"), "L": ("converted", "lwc/Pricing"), "C": ("flagged", "Cart.cls"), "M": ("converted", "SObject metadata"),
                   "S": ("skipped", "—"), "U": ("unaccounted", "—"), "Twice": ("converted", "Late.cls"), "X": ("unreadable", "—")}
    assert {r["source"]: r["note"] for r in led.collect()}["S"] == "no reason recorded"
    assert {r["outcome"]: r["n"] for r in L.outcome_counts(led).collect()}["converted"] == 3


def test_comprehension_rollup(spark):
    sources = spark.createDataFrame([("T", "A", 1), ("T", "B", 2), ("E", "Z", 1)], "target string, class_name string, ord int")
    prof = spark.createDataFrame([("A", "", [f"r{i}" for i in range(4)], [], "Low"), ("B", "does b", [f"s{i}" for i in range(4)], ["k"], "High"), ("Z", None, [], [], "")],
                                 "class_name string, purpose string, business_rules array<string>, risks array<string>, complexity string")
    got = {r["target"]: (r["purpose"], r["business_rules"], r["risks"], r["complexity"]) for r in L.comprehension_rollup(sources, prof).collect()}
    every = ["r0", "r1", "r2", "r3", "s0", "s1", "s2", "s3"]
    assert got == {"T": ("does b", every, ["k"], "High"), "E": ("", [], [], "")}
    some = {r["target"]: r["business_rules"] for r in L.comprehension_rollup(sources, prof, 6).collect()}
    assert some["T"] == every[:6]


def test_levels_of_a_long_chain_and_a_random_graph(spark):
    chain = spark.range(100_000).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    got = G.wavefront_levels(chain).agg(F.count("*").alias("n"), F.count_if(F.col("node") == F.col("level")).alias("ok")).first()
    assert (got["n"], got["ok"]) == (100_001, 100_001)
    r = random.Random(4)
    pairs = {(a, r.randrange(a)) for a in range(1, 300) for _ in range(r.choice((1, 1, 1, 2, 5)))}
    level: dict[int, int] = {}
    for node in range(300):
        level[node] = max((level[b] + 1 for a, b in pairs if a == node), default=0)
    rows = G.wavefront_levels(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()
    assert {x["node"]: x["level"] for x in rows} == level
