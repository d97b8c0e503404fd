"""Rules, provenance, alignment, replay, triage, sign-off on literal rows."""

import hashlib

from pyspark.sql import functions as F

from evidex.operators import assurance as A
from evidex.operators import extract as X
from evidex.operators import ranking as K


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_rule_ledger(spark):
    rules = df(spark, "class_name string, rule string", ("A", " Orders above limit receive discount "), ("A", "Gold customers get free shipping"), ("A", " "),
               ("F", "Failed things stay"), ("S", "Skipped rule"), ("N", "Nobody carries this"), ("W", "Weak test rule"))
    carriers = df(spark, "class_name string, target string", ("A", "TA"), ("F", "TF"), ("W", "TW"))
    arts = df(spark, "target string, status string, test_text string", ("TA", "ok", "System.assert(ordersAboveLimit) // orders limit discount"),
              ("TF", "error", "Assert.x failed things stay"), ("TW", "ok", "weak test rule"))
    skips = df(spark, "class_name string, reason string", ("S", "native product"))
    led = A.rule_ledger(rules, carriers, arts, skips)
    got = {r["rule"]: (r["status"], r["evidence"]) for r in led.collect()}
    assert got == {
        "Orders above limit receive discount": ("asserted", "the generated test references this rule's terms"),
        "Gold customers get free shipping": ("implemented", "tests exist but none clearly cover this rule"),
        "Failed things stay": ("at_risk", "the target failed to generate — migrate this rule by hand"),
        "Skipped rule": ("dropped", "native product"), "Nobody carries this": ("dropped", "no generated artifact carries this rule"),
        "Weak test rule": ("implemented", "no assertions in the generated test")}
    ids = {r["rule"]: r["id"] for r in led.collect()}
    assert ids["Skipped rule"] == "R-" + hashlib.md5(b"S|Skipped rule").hexdigest()[:8]
    s = A.rule_ledger_summary(led).first()
    assert (s["total"], s["asserted"], s["implemented"], s["at_risk"], s["dropped"], s["assured_pct"], s["preserved_pct"]) == (6, 1, 2, 1, 2, 17, 50)
    first = led.orderBy(A.status_rank(F.col("status")), "source", "rule").first()
    assert first["status"] == "dropped"


def test_parity(spark):
    rules = df(spark, "target string, rule string", ("T", "alpha beta gamma delta epsilon"), ("T", "omega zeta"), ("U", "the and for"))
    arts = df(spark, "target string, test_text string", ("T", "Assert.eq alpha, beta alphabet"), ("U", "Assert. the and for"), ("V", None))
    s = {r["target"]: (r["rules"], r["covered"], r["score"], r["asserts"]) for r in A.parity_scores(rules, arts).collect()}
    assert s == {"T": (2, 1, 50, True), "U": (1, 0, 0, True), "V": (0, 0, None, False)}
    o = A.parity_overall(A.parity_scores(rules, arts)).first()
    assert (o["rules_total"], o["rules_covered"], o["score"], o["targets_with_tests"], o["targets_total"]) == (3, 1, 33, 2, 3)
    better = df(spark, "target string, test_text string", ("T", "Assert.eq alpha beta omega"), ("U", ""))
    assert [tuple(r) for r in A.coverage_gained(rules, arts, better).collect()] == [("T", 1)]
    assert {r["rule"] for r in A.uncovered_rules(rules, arts).collect()} == {"omega zeta", "the and for"}


JAVA = ("public class DefaultPricingService {\n    public BigDecimal applySpendDiscount(final BigDecimal subtotal) {\n        return subtotal;\n    }\n"
        "    public OrderModel placeOrder(final CartModel cart) {\n        return null;\n    }\n    private BigDecimal scale(final BigDecimal v) {\n        return v;\n    }\n}")
APEX = ("public with sharing class PricingService {\n    public PricingService() {\n    }\n    public Decimal applySpendDiscount(Decimal subtotal) {\n        return subtotal;\n    }\n"
        "    public List<Order__c> createOrders(List<OrderRequest> reqs) {\n        return null;\n    }\n    public Decimal roundIt(Decimal v) {\n        return v;\n    }\n}")


def test_provenance(spark):
    f = df(spark, "file string, text string", ("java", JAVA), ("apex", APEX))
    sym = X.symbol_table(f)
    apex = {r["name"]: (r["line_start"], r["line_end"]) for r in sym.filter("file = 'apex'").collect()}
    assert apex["applySpendDiscount"] == (4, 6)
    out = sym.filter("file = 'apex'").select(F.lit("PricingService").alias("target"), "name", F.lit("PricingService").alias("ctor"))
    ins = sym.filter("file = 'java'").select(F.lit("PricingService").alias("target"), F.lit("DefaultPricingService").alias("source_class"), "name", "ord")
    links = A.provenance_links(out, ins)
    got = {r["name"]: (r["origin"], r["basis"], r["confidence"]) for r in links.collect()}
    assert got == {"applySpendDiscount": ("applySpendDiscount", "exact name", "high"), "createOrders": ("placeOrder", "normalised name", "medium"),
                   "roundIt": (None, None, None)}
    assert [r["name"] for r in A.without_target(links, ins).collect()] == ["scale"]
    s = A.provenance_summary(links, ins).first()
    assert (s["linked"], s["without_origin"], s["coverage"], s["high"], s["without_target"]) == (2, 1, 67, 1, 1)
    run = A.provenance_links(df(spark, "target string, name string, ctor string", ("X", "run", "X")), df(
        spark, "target string, source_class string, name string, ord long", ("X", "Y", "doRun", 0), ("X", "Y", "execute", 1)))
    assert run.first()["origin"] is None


def test_best_method_matches_brute_force(spark):
    import random
    import re

    rnd = random.Random(3)
    words = [f"{a}{b}word" for a in "abcdefgh" for b in "rstuv"]
    rules = [(f"R{i}", f"C{0 if i % 3 == 0 else i % 5}", " ".join(rnd.sample(words, rnd.randrange(1, 8)))) for i in range(60)]
    methods = [(f"C{i % 5}", f"m{i}", i, " ".join(rnd.sample(words, rnd.randrange(1, 15)))) for i in range(60)]
    got = {r["rule_id"]: (r["method"], round(r["score"], 9)) for r in A.best_method(
        df(spark, "rule_id string, class_name string, rule string", *rules), df(spark, "class_name string, name string, ord int, body string", *methods)).collect()}
    want = {}
    for rid, c, rule in rules:
        need, best, top = set(re.findall("[a-z]{4,}", rule)), None, 0.0
        for mc, name, _, body in methods:
            share = len(need & set(re.findall("[a-z]{4,}", body))) / len(need)
            if mc == c and share > top:
                best, top = name, share
        if top >= 0.34:
            want[rid] = (best, round(top, 9))
    assert got == want


JUNIT = """public class DefaultPricingServiceTest {
  @Before public void setUp() { svc = new X(); }
  @Test
  public void spendDiscountAppliesTenPercent() {
    assertEquals(new BigDecimal("4500.00"), pricingService.applySpendDiscount(new BigDecimal("5000.00")));
  }
  @Test public void goldCustomersGetTwelvePercentOff() throws Exception {
    assertEquals(new BigDecimal("88.00"),
        pricingService.applyLoyaltyDiscount(new BigDecimal("100.00"), customerWithTier(LoyaltyTier.GOLD)));
    assertTrue("must hold", svc.isGold(LoyaltyTier.GOLD, 'c', 5L));
    assertFalse(flag);
  }
  @org.junit.Test(expected = IllegalArgumentException.class)
  public void shouldRejectNegative() { svc.charge(-1, null); }
  public void helper() { assertNull(svc.find(BigDecimal.TEN)); }
}"""


def test_mined_behaviours_and_replay(spark):
    b = A.mine_assertions(df(spark, "class_name string, source string", ("DefaultPricingServiceTest", JUNIT)))
    got = {(r["test_method"], r["n"]): r for r in b.collect()}
    one = got["spendDiscountAppliesTenPercent", 1]
    assert (one["expected"]["value"], one["target_method"], [a["value"] for a in one["args"]]) == ("4500.00", "applySpendDiscount", ["5000.00"])
    assert one["id"] == "B-" + hashlib.md5(b"DefaultPricingServiceTest#spendDiscountAppliesTenPercent#1").hexdigest()[:8]
    gold = got["goldCustomersGetTwelvePercentOff", 1]
    assert [a["value"] for a in gold["args"]] == ["100.00", None] and gold["source_class"] == "DefaultPricingService"
    true = got["goldCustomersGetTwelvePercentOff", 2]
    assert (true["expected"]["value"], [a["value"] for a in true["args"]]) == ("true", ["'GOLD'", "'c'", "5"])
    neg = got["shouldRejectNegative", 1]
    assert (neg["expects_exception"], neg["target_method"], [a["value"] for a in neg["args"]], neg["label"]) == (
        "IllegalArgumentException", "charge", ["-1", "null"], "Reject Negative")
    carriers = df(spark, "class_name string, target string", ("DefaultPricingService", "P"))
    arts = df(spark, "target string, status string, main_text string", ("P", "ok", "public static Decimal applySpendDiscount(Decimal d) {} global void charge(Integer i) {} public Decimal applyLoyaltyDiscount(Decimal d) {}"))
    plan = A.replay_plan(b, carriers, arts)
    mode = {(r["test_method"], r["n"]): r["mode"] for r in plan.collect()}
    assert mode["spendDiscountAppliesTenPercent", 1] == "direct" and mode["shouldRejectNegative", 1] == "direct"
    assert mode["goldCustomersGetTwelvePercentOff", 1] == "adapter" and mode["goldCustomersGetTwelvePercentOff", 2] == "adapter"
    s = A.replay_summary(plan).first()
    assert (s["direct"], s["adapter"], s["manual"], s["runnable"]) == (2, len(mode) - 2, 0, 2)
    failed = A.replay_plan(b, carriers, df(spark, "target string, status string, main_text string", ("P", "error", "public static Decimal applySpendDiscount(Decimal d) {}")))
    assert {r["mode"] for r in failed.collect()} == {"manual"}


def test_triage(spark):
    schema = "target string, layer string, status string, review_flags array<string>, rules long"
    arts = df(spark, schema, ("Broken", "Service", "error", [], 0), ("Crit", "Service", "ok", [], 0), ("Clean", "DAO", "ok", [], 0), ("Rich", "Service", "ok", [], 6),
              ("Flag", "Service", "ok", ["Salesforce CPQ may be a better home"], 0), ("Warn", "Service", "ok", [], 0), ("Err", "Service", "ok", [], 0))
    src = df(spark, "target string, class_name string, file string", *[(t, f"Default{t}", f"Default{t}.java") for t in ("Broken", "Crit", "Clean", "Rich", "Flag", "Warn", "Err")])
    hz = df(spark, "id string, severity string, rule string, file string, source_class string", ("H-001", "critical", "DML_IN_LOOP", "DefaultCrit.java", "DefaultCrit"),
            ("H-002", "medium", "X", "other.xml", "DefaultWarn"))
    fd = df(spark, "target string, severity string", ("Warn", "warning"), ("Err", "ERROR"))
    pr = df(spark, "class_name string, complexity string", ("DefaultRich", "High"))
    got = {r["target"]: r for r in K.triage(arts, src, hz, fd, pr).collect()}
    assert (got["Broken"]["band"], got["Broken"]["score"]) == ("must", 100)
    assert (got["Crit"]["band"], got["Crit"]["critical"], got["Crit"]["score"]) == ("must", 1, 30) and "DML_IN_LOOP" in got["Crit"]["reasons"][0]
    assert got["Clean"]["band"] == "routine" and "mechanical" in got["Clean"]["reasons"][0]
    assert (got["Rich"]["band"], got["Rich"]["score"], got["Rich"]["complexity"]) == ("review", 28, "High")
    assert got["Flag"]["band"] == "review" and got["Warn"]["score"] == 10 and got["Err"]["band"] == "must"
    s = K.triage_summary(K.triage(arts, src, hz, fd, pr)).first()
    assert (s["total"], s["must"], s["review"], s["routine"], s["needs_you"]) == (7, 3, 2, 2, 5)


def test_confidence_and_status(spark):
    schema = "target string, ran boolean, deploy_ok boolean, failed boolean, healed boolean, verified boolean"
    arts = df(spark, schema, ("clean", True, True, False, False, True), ("fail", True, False, True, True, True), ("off", False, False, False, False, False),
              ("bad", True, True, False, False, True), ("worst", False, False, False, False, True))
    issues = df(spark, "target string, severity string", ("clean", "WARNING"), ("clean", "WARNING"), ("bad", "ERROR"), *[("worst", "ERROR")] * 5)
    got = {r["target"]: (r["score"], r["label"], r["basis"]) for r in K.confidence(arts, issues).collect()}
    assert got == {"clean": (88, "High", "deployed cleanly to org, 2 warning(s)"), "fail": (45, "Low", "failed org deploy, auto-healed from compiler errors"),
                   "off": (75, "Medium", "offline validation only"), "bad": (78, "Medium", "deployed cleanly to org, 1 offline error(s)"),
                   "worst": (5, "Low", "unverified — no org deploy, 5 offline error(s)")}
    a = df(spark, "target string, built boolean, critic boolean", ("a", True, True), ("b", True, True), ("c", True, False), ("d", False, True))
    f = df(spark, "target string, severity string", ("a", "ERROR"), ("b", "WARNING"), ("c", "ERROR"))
    assert {r["target"]: r["status"] for r in K.artifact_status(a, f).collect()} == {"a": "needs_review", "b": "accepted", "c": "accepted", "d": "error"}


def test_contract_id_depends_on_facts_only(spark):
    ap = [("discovery", "ada", True), ("plan", "ada", False)]
    make = lambda rows, n: K.signoff_rollup(df(spark, "gate string, actor string, supervised boolean", *rows), df(spark, "rules long", (n,))).first()
    one, two, other = make(ap, 5), make(ap[::-1], 5), make(ap, 6)
    assert one["contract_id"] == two["contract_id"] != other["contract_id"]
    assert (one["supervised"], one["reviewers"], one["gates_reviewed"], one["gates_auto"]) == (True, 1, ["discovery"], ["plan"])


def test_caveats(spark):
    schema = ("supervised boolean, gates_reviewed array<string>, unaccounted long, overwritten long, unreadable long, dropped long, at_risk long, rules long, asserted long, "
              "behaviours long, runnable long, without_target long, without_origin long, critical long, high long, org_verified boolean")
    clean = df(spark, schema, (True, ["discovery", "plan", "build"], 0, 0, 0, 0, 0, 3, 3, 2, 2, 0, 0, 0, 0, True))
    assert K.caveat_rows(clean).count() == 0
    poor = df(spark, schema, (False, [], 1, 0, 2, 1, 0, 3, 1, 0, 0, 4, 0, 1, 2, False))
    assert {r["kind"]: r["n"] for r in K.caveat_rows(poor).collect()} == {
        "no reviewer": 0, "unaccounted": 1, "unreadable": 2, "rules dropped": 1, "rules not asserted": 2, "no recorded behaviours": 0,
        "source methods without target": 4, "critical or high hazards": 3, "never deployed": 0}
