"""Names, durations, slimming, classes, symbols, schema, data files, schedules, processes."""

from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.operators import extract as X
from evidex.operators import impex as I
from evidex.operators import processes as W
from evidex.operators import schedules as C
from evidex.operators import schema as S
from evidex.sources import files as files_
from evidex.sources import types_xml
from evidex.sources.sinks import read_object_csv, write_object_csv


def column(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def files(spark, rows):
    return files_.describe_paths(spark.createDataFrame(rows, "file string, text string"), "file")


def test_durations(spark):
    iso = ["PT4H", "PT30M", "P1D", "P1DT2H30M", "", "garbage", "PT45S", "PT0S", "PT1M30S"]
    assert column(spark, iso, N.duration_minutes) == [240, 30, 1440, 1590, None, None, 1, None, 1]


def test_names(spark):
    raw = ["order-fulfilment", "2ndStep", "a  b", "", "__x__"]
    assert column(spark, raw, N.safe_name) == ["order_fulfilment", "X2ndStep", "a_b", "Step", "x"]
    assert column(spark, ["authorizePayment", "wait_for", "", "HTTPCall"], N.label) == [
        "Authorize Payment", "Wait For", "Step", "H T T P Call"]
    assert column(spark, ["testGoldCustomersGetTwelvePercentOff", "shouldFail_now"], N.readable) == [
        "Gold Customers Get Twelve Percent Off", "Fail now"]
    assert column(spark, ["DefaultOrderService", "OrderDao", "CartFacade", "Order"], N.domain_key) == [
        "Order", "Order", "Cart", "Order"]
    assert column(spark, ["ProductListComponent", "Component"], N.ui_domain_key) == ["ProductList", "Component"]
    pairs = ["placeOrder", "createOrders", "getFoo", "fetchFooList", "execute", "Delete"]
    assert column(spark, pairs, N.normal_name) == ["createorder", "createorder", "getfoo", "getfoo", "", "delete"]


def test_layers(spark):
    rows = [("StaleCart", [], "AbstractJobPerformable", []), ("X", ["Foo", "Repository"], None, []), ("CleanupJob", [], None, []),
            ("JobTitleService", [], None, []), ("DataService", [], None, []), ("OrderData", [], None, []), ("Util", [], None, []),
            ("Y", [], None, ["Serializable", "Performable"])]
    df = spark.createDataFrame(rows, "n string, a array<string>, e string, i array<string>")
    got = [r[0] for r in df.select(N.infer_layer(F.col("n"), F.col("a"), F.col("e"), F.col("i"))).collect()]
    assert got == ["Job", "DAO", "Job", "Service", "Service", "Model", "Utility", "Job"]


MODEL = ("package de.shop;\n\n" + "".join(f"import de.hybris.platform.core.model.m{i}.Model{i};\n" for i in range(8))
         + "import java.util.List;\nimport static org.x.Y;\n\n\n\n/** Orders above 5000 receive a 10 percent discount. */\npublic class OrderModel {\n"
         "    private String code;\n    public String getCode()\n    {\n        return code;\n    }\n"
         "    public void setCode(String c) { this.code = c; }\n    public BigDecimal getNet()\n    {\n"
         "        if (net == null) { return BigDecimal.ZERO; }\n        return net.multiply(RATE);\n    }\n"
         + "    // kept\n" * 20 + "}\n")


def test_slimming(spark):
    big = "public class Big {\n" + "\n".join(f"    public int compute{i}(int x) {{ return x * {i} + 1; }}" for i in range(60)) + "\n}"
    small = "import java.util.List;\npublic class Tiny { public int getA() { return a; } }"
    df = spark.createDataFrame([("m", MODEL), ("b", big), ("s", small)], "k string, text string")
    got = {r["k"]: r["slim"] for r in X.slim_text(df).collect()}
    m = got["m"]
    assert m["applied"] and m["imports_removed"] == 10 and m["accessors_removed"] == 2 and m["saved_pct"] >= 10
    assert "net.multiply(RATE)" in m["text"] and "Orders above 5000" in m["text"] and "private String code;" in m["text"]
    assert m["text"].startswith("// imports: de.hybris.platform, org.x\n") and "\n\n\n" not in m["text"]
    assert got["b"]["text"] == big and not got["b"]["applied"]
    assert got["s"]["applied"] and got["s"]["imports_removed"] == 1
    some = X.slim_text(df, min_chars=900).filter("k = 's'").first()["slim"]
    assert some["text"] == small and not some["applied"]


def test_classes_and_symbols(spark):
    src = ('import a.B;\n/* class Hidden {} */\n@Service\npublic class OrderService extends Base<X> implements Api, Other {\n'
           "  private final Map<String, Foo> cache = new HashMap();\n  protected OrderDao dao;\n  OrderService() {\n  }\n"
           "  @Override\n  public Map<String, List<Order>> find(final String code, int n) throws E {\n    if (n > 1) { x(); }\n    return null;\n  }\n"
           "  private void hide() { }\n}")
    c = X.class_table(files(spark, [("a/OrderService.java", src), ("a/package-info.java", "package a;")])).orderBy("file").collect()
    r = c[0]
    assert (r["class_name"], r["layer"], r["annotations"], r["unreadable"]) == ("OrderService", "Service", ["Service"], None)
    assert [tuple(f) for f in r["fields"]] == [("cache", "Map<String, Foo>"), ("dao", "OrderDao")]
    assert [(m["name"], m["return_type"]) for m in r["methods"]] == [("find", "Map<String, List<Order>>")]
    assert [(p["name"], p["type"]) for p in r["methods"][0]["parameters"]] == [("code", "String"), ("n", "int")]
    assert "OrderDao" in r["referenced_types"] and "OrderService" not in r["referenced_types"] and "Hidden" not in r["referenced_types"]
    assert c[1]["unreadable"] is not None
    s = X.symbol_table(files(spark, [("f", src)])).orderBy("ord").collect()
    assert [(x["name"], x["line_start"], x["line_end"]) for x in s] == [("find", 9, 13), ("hide", 14, 14)]
    open_end = X.symbol_table(files(spark, [("f", "public void a() {\n  b();\n\n")])).collect()
    assert [(x["name"], x["line_end"]) for x in open_end] == [("a", 4)]


def test_components(spark):
    ts = ("import { Component } from '@angular/core';\n@Component({ selector: 'app-x', templateUrl: '../t/x.html', styleUrls: ['./a.css', './b.css'] })\n"
          "export class XComponent {\n  @Input() item: Item;\n  @Output() done = new EventEmitter();\n"
          "  constructor(private readonly cart: CartService, protected http: HttpClient, public o: OtherService) {}\n"
          "  ngOnInit() {\n  }\n  get total(): number {\n  }\n}")
    rows = [("app/c/x.component.ts", ts), ("app/t/x.html", " <p/> "), ("app/c/b.css", ".b{}"), ("app/c/a.css", ".a{}"),
            ("app/cart.service.ts", "export class CartService { }"), ("app/a.module.ts", "export class AModule {}"), ("app/b.model.ts", "interface B {}")]
    f = files(spark, rows)
    c = X.component_table(f)
    r = c.first()
    assert (r["class_name"], r["selector"], r["inputs"], r["outputs"]) == ("XComponent", "app-x", ["item"], ["done"])
    assert r["injected"] == ["CartService", "OtherService"] and r["template"] == "<p/>" and r["styles"] == ".a{}\n.b{}"
    assert r["methods"] == ["total"] and r["referenced_types"] == ["CartService", "Item", "OtherService", "XComponent"][:3]
    s = X.attach_service_source(c, X.service_sources(f)).collect()
    assert [(x["service"], x["text"]) for x in s] == [("CartService", "export class CartService { }")]
    g = sorted((x["class_name"], x["layer"]) for x in X.skipped_glue_rows(f).collect())
    assert g == [("AModule", "Module"), ("b.model", "Model")]


def test_type_inference(spark):
    corpus = files(spark, [("b", "boolean dealerCode;"), ("a", "private String dealerCode; BigDecimal getDealerCode() {}\nString String late;"), ("c", "Date when;")])
    asked = spark.createDataFrame([("DealerCode__c",), ("When__c",), ("Late__c",), ("Nothing__c",)], "field string")
    got = {r["field"]: r["type"] for r in X.infer_field_type(asked, corpus).collect()}
    assert got == {"DealerCode__c": "Currency", "When__c": "DateTime", "Late__c": "Text", "Nothing__c": "Text"}


TYPES = """<items xmlns="urn:x"><enumtypes><enumtype code="OrderStatus"><value code="NEW"/><value code=""/></enumtype><enumtype code="Empty"/></enumtypes>
<relations><relation code="c2o"><sourceElement type="Customer" cardinality="one"/><targetElement type="Order" cardinality="many"/></relation>
<relation code="m"><sourceElement type="A"/><targetElement type="B"/></relation><relation code="half"><sourceElement type="A"/></relation></relations>
<itemtypes><itemtype code="Order"><description>An order</description><attributes>
<attribute qualifier="code" type="java.lang.String"><modifiers optional="false" unique="true"/></attribute>
<attribute qualifier="status" type="de.shop.OrderStatus"><defaultvalue> NEW </defaultvalue></attribute>
<attribute qualifier="total" type="java.math.BigDecimal" default="0"/><attribute qualifier="odd" type="Foo"/></attributes></itemtype></itemtypes></items>"""


def schema_of(spark):
    late = '<items><itemtype code="Order"><attributes><attribute qualifier="only" type="String"/></attributes></itemtype></items>'
    f = files(spark, [("1/a-items.xml", late), ("2/b-items.xml", TYPES), ("3/bad-items.xml", "<items><itemtype code='X'></items>")])
    plain = S.derive_schema(types_xml.item_types(f), types_xml.enum_types(f))
    return f, S.with_lookups(plain, S.relation_lookups(types_xml.relations(f)))


def test_schema(spark):
    f, schema = schema_of(spark)
    assert {r["file"]: r["malformed"] for r in types_xml.type_files(f).collect()} == {
        "1/a-items.xml": False, "2/b-items.xml": False, "3/bad-items.xml": True}
    got = {r["field"]: (r["type"], r["picklist"], r["required"], r["unique"], r["default"]) for r in schema.filter("object = 'Order__c'").collect()}
    assert got == {"Code__c": ("Text", None, True, True, None), "Status__c": ("Picklist", ["NEW"], False, False, "NEW"),
                   "Total__c": ("Currency", None, False, False, "0"), "Odd__c": ("Text", None, False, False, None),
                   "Customer__c": ("Lookup", None, False, False, None)}
    assert [tuple(r)[2:] for r in types_xml.relations(f).orderBy("ord").collect()] == [("Customer", "one", "Order", "many"), ("A", "many", "B", "many")]
    assert S.schema_catalog(schema).first()["line"].startswith("- Order__c: Code__c (Text), Customer__c (Lookup), Odd__c")
    assert [(r["part"], r["line"].count("(")) for r in S.schema_catalog(schema, 2).orderBy("part").collect()] == [(0, 2), (1, 2), (2, 1)]
    meta = {r["field"]: r for r in S.field_metadata_rows(schema).collect()}
    assert meta["Status__c"]["values"][0]["is_default"] and meta["Total__c"]["precision"] == 18 and meta["Customer__c"]["reference_to"] == "Customer__c"


def test_grounding(spark):
    _, schema = schema_of(spark)
    code = spark.createDataFrame([("A.cls", "List<Order__c> r = [SELECT Id, code__c, Priority__c, Wizbang__c\n FROM Order__c];\n// Fake__c x;\n"
                                            "Ghost__c g = new Ghost__c(); o.Status__c = 1; /* o.No__c */ o.Loose__c = 2;")], "file string, text string")
    issues = S.field_references(code, schema)
    assert {(r["rule"], r["object"], r["field"]) for r in issues.collect()} == {
        ("unknown_sobject", "Ghost__c", None), ("unknown_field", "Order__c", "Priority__c"), ("unknown_field", "Order__c", "Wizbang__c"),
        ("unknown_field", None, "Loose__c")}
    corpus = spark.createDataFrame([("x", "int getPriority() ; class MyGhost {} wizbanger")], "file string, text string")
    got = {(r["kind"], r["object"], r["field"], r["type"]) for r in S.reconcile_schema(issues, schema, corpus).collect()}
    assert got == {("added_object", "Ghost__c", None, None), ("added_field", "Order__c", "Priority__c", "Number"),
                   ("flagged", "Order__c", "Wizbang__c", None), ("flagged", None, "Loose__c", None)}


def test_evidence_with_very_long_words(spark):
    word = "x" * 200 + "name"
    corpus = spark.createDataFrame([("a", f"abc {word} end")], "file string, text string")
    asked = spark.createDataFrame([(f"{word}__c",), ("y" + word[1:] + "__c",), ("ab__c",), ("End__c",)], "field string")
    assert sorted(len(r[0]) for r in S.evidenced(asked, corpus, "field").collect()) == [6, 207]


def test_target_fit(spark):
    planned = spark.createDataFrame([("LoyaltyAccount", 3), ("Order", 2), ("SubscriptionPlan", 1)], "object string, n_fields long")
    have = spark.createDataFrame([("LoyaltyAccount__c",), ("Order",), ("SBQQ__Quote__c",)], "object string")
    limits = spark.createDataFrame([("CustomObjects", 400, 2), ("CustomFields", 900, 800)], "name string, max long, remaining long")
    got = {(r["kind"], r["object"]) for r in S.target_fit(planned, have, limits).collect()}
    assert got == {("collision", "LoyaltyAccount__c"), ("reusable", "Order__c"), ("package", "Salesforce CPQ"), ("headroom", "custom object")}


def test_errors(spark):
    rows = [("A.cls", "No such column 'Code__c' on entity 'Order__c'"), ("A.cls", "sObject type 'Ghost__c' is not supported"),
            ("B.cls", "Unexpected token"), ("C.cls", "No such column 'DealerCode__c2'"), ("D.cls", "bad code__c here")]
    e = spark.createDataFrame(rows, "file string, problem string")
    assert {(r["object"], r["field"], r["kind"]) for r in S.missing_from_errors(e).collect()} == {
        ("Order__c", "Code__c", "field"), ("Ghost__c", None, "object")}
    added = spark.createDataFrame([("Code__c",), ("Ghost__c",)], "token string")
    arts = spark.createDataFrame([("A.cls",), ("B.cls",)], "file string")
    got = {r["file"]: r["disposition"] for r in S.route_errors(e, added, arts).collect()}
    assert got == {"A.cls": "resolved via metadata", "B.cls": "needs repair", "C.cls": "resolved via metadata", "D.cls": "resolved via metadata"}


def test_coverage(spark):
    rows = spark.createDataFrame([("A", 10, 20), ("A", 1, 0), ("B", 3, 4), ("CTest", 0, 5), ("Z", 0, 0)], "name string, covered int, total int")
    got = {r["name"]: (r["coverage"], r["strengthen"]) for r in S.coverage_rollup(rows).collect()}
    assert got == {"A": (55.0, True), "B": (75.0, False), "CTest": (0.0, False)}


IMPEX = """# essential data
$lang = en
;stray;row
INSERT_UPDATE CronJob; code[unique=true]           ; job(code)           ; sessionLanguage(isocode)
\t; staleCartCleanupCronJob     ; staleCartCleanupJob ; $lang

INSERT_UPDATE Trigger; cronJob(code)[unique=true]  ; cronExpression
                     ; staleCartCleanupCronJob     ; 0 0 2 * * ?
REMOVE CronJob; code[unique=true]
; old
INSERT_UPDATE Customer; uid[unique=true,trim='x']; addr(street,town(code)); $cat[default=y]; name; nick[lang=de,lang=en]
; u1 ; a,b ; m ; Ada ; N ; extra
; u2
"""


def test_impex(spark, tmp_path):
    lines = I.impex_blocks(files(spark, [("a.impex", IMPEX)]))
    assert [(r["block_no"], r["mode"], r["type"]) for r in I.impex_lines(lines).orderBy("line_no").collect()] == [
        (1, "INSERT_UPDATE", "CronJob"), (2, "INSERT_UPDATE", "Trigger"), (3, "REMOVE", "CronJob"), (4, "INSERT_UPDATE", "Customer"), (4, "INSERT_UPDATE", "Customer")]
    cols = {(r["type"], r["block_no"], r["attr"]): r for r in I.header_columns(lines).collect()}
    assert cols["Customer", 4, "uid"]["modifiers"] == {"unique": "true", "trim": "x"} and cols["Customer", 4, "addr"]["composite"]
    assert cols["Customer", 4, "$cat"]["is_macro"] and cols["Customer", 4, "nick"]["modifiers"] == {"lang": "en"}
    assert cols["CronJob", 1, "job"]["ref_key"] == "code"
    keys = {r["object"]: r["external_id"] for r in I.external_keys(lines).collect()}
    assert keys == {"CronJob__c": "Code__c", "Trigger__c": None, "Customer__c": "Uid__c"}
    rec = I.load_records(lines)
    got = {(r["object"], r["line_no"], r["header"]): r["value"] for r in rec.collect()}
    assert got["CronJob__c", 5, "SessionLanguage__r.Isocode__c"] == "$lang" and got["Customer__c", 13, "Name__c"] == ""
    assert ("Customer__c", 12, "Addr__c") not in got and got["Customer__c", 12, "Nick__c"] == "N"
    assert [tuple(r)[1:] for r in I.load_objects(lines).filter("type = 'Customer'").select("type", "modes", "manual_relationships").collect()] == [
        (["INSERT_UPDATE"], ["addr → addr(street,town(code))"])]
    t = C.impex_triggers(I.cells(lines)).collect()
    assert [(r["job_class"], r["cron_expression"], r["active"]) for r in t] == [("staleCartCleanupCronJob", "0 0 2 * * ?", True)]
    write_object_csv(rec.withColumn("row_no", F.col("line_no")), I.load_headers(lines), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("object=")) == ["object=CronJob__c", "object=Customer__c", "object=Trigger__c"]
    back = read_object_csv(spark, str(tmp_path), "Customer__c")
    assert back.columns == ["Uid__c", "Name__c", "Nick__c"] and back.count() == 2


def test_impex_repeated_columns_and_blocks_without_rows(spark, tmp_path):
    text = "INSERT Empty; code[unique=true]\nINSERT Book; id; name[lang=en]; name[lang=de]\n;1;the, \"end\";das Ende\n;2;only\n;3\n"
    b = I.impex_blocks(files(spark, [("a.impex", text)]))
    assert [(r["object"], r["external_id"]) for r in I.external_keys(b).orderBy("object").collect()] == [("Book__c", None), ("Empty__c", "Code__c")]
    assert [(r["object"], r["header"], r["ord"]) for r in I.load_headers(b).orderBy("object", "ord").collect()] == [
        ("Book__c", "Id__c", 1), ("Book__c", "Name__c", 2), ("Empty__c", "Code__c", 1)]
    rec = I.load_records(b)
    assert sorted((r["line_no"], r["header"], r["value"]) for r in rec.collect()) == [
        (3, "Id__c", "1"), (3, "Name__c", "das Ende"), (4, "Id__c", "2"), (4, "Name__c", "only"), (5, "Id__c", "3"), (5, "Name__c", "")]
    assert {(r["object"], r["records"]) for r in I.load_summary(b).collect()} == {("Book__c", 3), ("Empty__c", 0)}
    odd = rec.withColumn("value", F.when(F.col("value") == "only", 'a "b", c').otherwise(F.col("value"))).withColumn("row_no", F.col("line_no"))
    write_object_csv(odd, I.load_headers(b), str(tmp_path))
    back = read_object_csv(spark, str(tmp_path), "Book__c").na.fill("")
    assert sorted(map(tuple, back.collect())) == [("1", "das Ende"), ("2", 'a "b", c'), ("3", "")]


def test_csv_keeps_the_order_of_records_and_the_last_cell(spark, tmp_path):
    rows = [("Big__c", n, "A__c", f"a{n}", 1) for n in range(500)] + [("Big__c", 7, "A__c", "Z", 0), ("Big__c", 8, "A__c", "0 last", 2), ("Small__c", 1, "A__c", None, 1)]
    rec = spark.createDataFrame(rows, "object string, row_no int, header string, value string, pos int").repartition(7)
    heads = spark.createDataFrame([("Big__c", "A__c", 1), ("Small__c", "A__c", 1)], "object string, header string, ord int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of few rows
    try:
        write_object_csv(rec, heads, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "object=Big__c").glob("part=*/*.txt"))
    lines = [f.read_text().splitlines() for f in files]
    assert len(files) > 1 and all(x[0] == "A__c" for x in lines)
    want = [f"a{n}" for n in range(500)]
    want[8] = "0 last"
    assert [v for x in lines for v in x[1:]] == want
    assert read_object_csv(spark, str(tmp_path), "Big__c").count() == 500


def test_spring_triggers(spark):
    xml = """<beans xmlns="http://x"><bean id="t1" class="T"><property name="cronExpression" value="0 0 2 * * ?"/><property name="cronJob"><ref bean="c1"/></property>
<property name="active" value="FALSE"/></bean><bean id="c1"><property name="job" ref="j1"/></bean><bean id="j1" class="com.x.DefaultStaleCartJob"/>
<bean id="t2"><property name="cronExpression"><value> 0 0 3 1 * MON </value></property><property name="job" ref="j1"/></bean>
<bean id="t3"><property name="cronExpression" value="bad"/><property name="cronJob" ref="nope"/></bean></beans>"""
    t = C.spring_triggers(C.beans(files(spark, [("s-spring.xml", xml), ("a-items.xml", xml), ("bad.xml", "<beans><bean></beans>")])))
    got = {r["bean"]: (r["job_class"], r["cron_expression"], r["active"], r["resolved"]) for r in t.collect()}
    assert got == {"t1": ("DefaultStaleCartJob", "0 0 2 * * ?", False, True), "t2": ("DefaultStaleCartJob", "0 0 3 1 * MON", True, True),
                   "t3": ("(unresolved: trigger bean 't3')", "bad", True, False)}
    plan = {r["cron_expression"]: (r["scheduler"], r["disposition"], bool(r["warnings"])) for r in C.schedule_plan(t).collect()}
    assert plan == {"0 0 2 * * ?": ("StaleCartScheduler", "inactive", False), "0 0 3 1 * MON": ("StaleCartScheduler", "scheduled", True),
                    "bad": (None, "unresolved", True)}


ORDER_PROCESS = """<?xml version="1.0"?><process xmlns="http://www.hybris.de/xsd/processdefinition" name="order-fulfilment-process" start="checkOrder">
<action id="checkOrder" bean="checkOrderAction"><transition name="OK" to="pay"/><transition name="NOK" to="nowhere"/></action>
<action id="pay" bean="core.payAction"><transition name="OK" to="hold"/><transition name="RETRY" to="pay"/></action>
<wait id="hold" then="ship" ><event>WarehouseConfirmedEvent</event><timeout delay="PT4H" then="failed"/></wait>
<action id="ship" bean="ghost"><transition name="OK" to="done"/></action>
<end id="done" state="SUCCEEDED">x</end><end id="failed" state="ERROR">y</end></process>"""


def test_processes(spark):
    f = files(spark, [("a/any.xml", ORDER_PROCESS), ("process/b.xml", "<items/>"), ("c.xml", "<process name='z'><open></process>")])
    p = W.process_files(f)
    classes = spark.createDataFrame([("CheckOrderAction",), ("PayAction",)], "class_name string")
    done = spark.createDataFrame([("PayAction",)], "class_name string")
    nodes = W.resolve_bean(W.process_nodes(p), classes)
    assert {r["node"]: r["implemented_by"] for r in nodes.filter("kind = 'action'").collect()} == {
        "checkOrder": "CheckOrderAction", "pay": "PayAction", "ship": ""}
    t = {r["process"]: (r["actions"], r["flow_nodes"], r["ends"], r["transitions"], r["unreadable"]) for r in W.process_tables(p, nodes).collect()}
    assert t == {"order-fulfilment-process": (3, 1, 2, 7, False), "c": (0, 0, 0, 0, True)}
    top = {(r["element"], r["outcome"], r["target"]): (r["link"], r["wired"], r["is_start"], r["minutes"]) for r in W.flow_topology(nodes, p, done).collect()}
    assert top["checkOrder", "NOK", None] == ("decision", False, True, None)
    assert top["pay", "RETRY", "pay"] == ("decision", True, False, None)
    assert top["hold", None, "ship"] == ("connector", False, False, 240) and ("hold", None, "failed") in top
    assert top["done", None, None][0] == "none"
    led = {r["source"]: r["outcome"] for r in W.process_ledger(W.process_tables(p, nodes), W.coverage(nodes, done), spark.createDataFrame(
        [("order-fulfilment-process",)], "process string")).collect()}
    assert led == {"order-fulfilment-process": "scaffolded", "c": "unreadable"}
    notes = sorted((r["node"], r["note"]) for r in W.review_notes(nodes, done).collect())
    assert notes == [("checkOrder", "branches 2 ways"), ("checkOrder", "class was not generated"), ("hold", "resume event is not wired"),
                     ("pay", "branches 2 ways"), ("ship", "bean did not resolve to a class")]


def test_inputs_beyond_the_old_limits(spark):
    comp = ("@Component({ selector: 'x', templateUrl: '../../../../../../v/./t.html', styleUrls: ['./s.css'] })\nexport class Deep {}")
    rows = [("r/a/b/c/d/e/f/x.component.ts", comp), ("r/v/t.html", "<p/>"), ("r/a/b/c/d/e/f/s.css", ".a{}")]
    got = X.component_table(files(spark, rows)).first()
    assert (got["template"], got["styles"]) == ("<p/>", ".a{}")
    process = "<?xml version='1.0'?>\n<!-- " + "note " * 2000 + "<items> -->\n<process name='p'><end id='e'/></process>"
    other = "<items><process name='q'/></items>"
    found = W.process_files(files(spark, [("a.xml", process), ("b.xml", other)])).select("file", "process").collect()
    assert [tuple(r) for r in found] == [("a.xml", "p")]
    many = "import a.b.C0;\n" + "".join(f"import p{i}.q{i}.r{i}.X{i};\n" for i in range(30))
    text = spark.createDataFrame([(many,)], "text string").select(X.import_summary(F.col("text"))).first()[0]
    assert text.count(",") == 30


def test_a_doctype_with_declarations_keeps_the_process(spark):
    body = "<process name='%s'><end id='e'/></process>"
    heads = {"a": "<!DOCTYPE process [<!ENTITY one 'x'> <!ENTITY two 'y'>]>", "b": "<?xml version='1.0'?>\n<!DOCTYPE process SYSTEM \"p.dtd\" [\n<!-- it's ] > -->\n<!ENTITY one \"<items> ]>\">\n<!ELEMENT end EMPTY>\n]>\n",
             "c": "<!DOCTYPE process SYSTEM 'p.dtd'>", "d": "<!DOCTYPE process [<!ENTITY one 'x'>"}
    rows = [(f"{k}.xml", h + body % k) for k, h in heads.items()]
    rows += [("e.xml", "<!DOCTYPE items [<!ENTITY one '<process>'> <!ENTITY two 'y'>]><items><process name='q'/></items>")]
    found = {r["file"]: (r["process"], r["unreadable"]) for r in W.process_files(files(spark, rows)).collect()}
    assert set(found) == {"a.xml", "b.xml", "c.xml", "d.xml"} and all(found[f"{k}.xml"] == (k, False) for k in "abc")
