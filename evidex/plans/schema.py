"""Schema derivation on type definitions written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import schema as S
from evidex.operators.scale import settled
from evidex.plans.corpora import joined
from evidex.plans.registry import query
from evidex.sources import types_xml as X

PER = 50


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def gen_types(part):
    """files(file, name, text): one type-definition file per 50 parts, each 13th malformed."""
    k, f = F.col("p_partkey"), F.col("file_id")
    ks, fs = k.cast("string"), f.cast("string")
    kinds = F.array(*[F.lit(x) for x in ("java.lang.String", "java.lang.Integer", "java.math.BigDecimal",
                                         "java.lang.Boolean", "java.util.Date")])
    typ = F.when(k % 7 == 5, _cat("Kind", fs)).when(k % 7 == 6, _cat("com.shop.Kind", fs)).otherwise(
        F.get(kinds, (k % 7).cast("int")))
    flag = lambda c: F.when(c, "true").otherwise("false")
    line = _cat(
        '<attribute qualifier="attr', ks, '" type="', typ, '"',
        F.when(k % 4 == 1, _cat(' default="', F.col("p_name"), '"')).otherwise(""), ">",
        F.when(k % 4 == 0, _cat("<defaultvalue> ", F.col("p_size").cast("string"), " </defaultvalue>")).otherwise(""),
        '<modifiers optional="', flag(F.col("p_size") % 3 != 0), '" unique="', flag(F.col("p_size") % 5 == 0),
        '"/></attribute>')
    rows = part.select(F.floor(k / PER).alias("file_id"), "p_partkey", "p_name", "p_size").select(
        "file_id", "p_partkey", line.alias("line"))
    files = joined(rows, "file_id", "p_partkey", "line")
    last = F.when(f % 10 == 9, _cat('<itemtype code="Item', (f - 1).cast("string"),
                                    '"><attributes><attribute qualifier="late" type="String"/></attributes></itemtype>')
                  ).otherwise("")
    rel = (F.when(f % 5 == 0, _cat('<relation code="R"><sourceElement type="Item', fs, '" cardinality="one"/></relation>'))
           .when(f % 2 == 0, _cat('<relation code="R"><sourceElement type="Item', fs,
                                  '" cardinality="one"/><targetElement type="Item', F.floor(f / 2).cast("string"),
                                  '" cardinality="many"/></relation>'))
           .otherwise(_cat('<relation code="R"><sourceElement type="Item', fs,
                           '"/><targetElement type="Item', F.floor(f / 2).cast("string"), '"/></relation>')))
    text = _cat('<?xml version="1.0"?>\n<items><!-- <enumtype code="No"><value code="x"/></enumtype> --><enumtypes><enumtype code="Kind',
                fs, '"><value code="V', (f * PER).cast("string"), '"/><value code="W', fs, '"/><value code=""/></enumtype><enumtype code="Empty', fs,
                '"/></enumtypes><relations>', rel, '</relations><itemtypes><typegroup name="g"><itemtype code="Item', fs,
                '"><description>Type ', fs, "</description><attributes>", F.col("body"), "</attributes></itemtype>", last,
                F.when(f % 13 == 5, "").otherwise("</typegroup>"), "</itemtypes></items>")
    return files.select("file_id", _cat("types/f", F.lpad(fs, 9, "0"), "-items.xml").alias("file"),
                        _cat("f", F.lpad(fs, 9, "0"), "-items.xml").alias("name"), text.alias("text"))


TYPES_SQL = """
pf AS (SELECT p_partkey, p_name, p_size, p_partkey // 50 AS f FROM part),
fs AS (SELECT DISTINCT f, 'types/f' || lpad(f::VARCHAR, 9, '0') || '-items.xml' AS file FROM pf WHERE f % 13 <> 5),
attr AS (SELECT f, 'Item' || f AS name, 'attr' || p_partkey AS attr, CASE p_partkey % 7
    WHEN 0 THEN 'java.lang.String' WHEN 1 THEN 'java.lang.Integer' WHEN 2 THEN 'java.math.BigDecimal'
    WHEN 3 THEN 'java.lang.Boolean' WHEN 4 THEN 'java.util.Date' WHEN 5 THEN 'Kind' || f ELSE 'com.shop.Kind' || f END AS typ,
    CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_name END AS dflt,
    p_size % 3 = 0 AS required, p_size % 5 = 0 AS uniq, p_partkey FROM pf JOIN fs USING (f)),
late AS (SELECT f, 'Item' || (f - 1) AS name FROM fs WHERE f % 10 = 9),
sf AS (
  SELECT name || '__c' AS object, name AS code, 'A' || attr[2:] || '__c' AS field,
    CASE p_partkey % 7 WHEN 0 THEN 'Text' WHEN 1 THEN 'Number' WHEN 2 THEN 'Currency' WHEN 3 THEN 'Checkbox'
      WHEN 4 THEN 'DateTime' ELSE 'Picklist' END AS type,
    CASE WHEN p_partkey % 7 >= 5 THEN 'V' || (f * 50) || '|W' || f END AS picklist, required, uniq, dflt
  FROM attr WHERE name NOT IN (SELECT name FROM late)
  UNION ALL SELECT name || '__c', name, 'Late__c', 'Text', NULL, false, false, NULL FROM late),
rel AS (SELECT f, file, 'Item' || f AS source_type, CASE WHEN f % 2 = 0 THEN 'one' ELSE 'many' END AS source_card,
   'Item' || (f // 2) AS target_type FROM fs WHERE f % 5 <> 0),
lk AS (SELECT DISTINCT target_type || '__c' AS object, target_type AS code, source_type || '__c' AS field FROM rel WHERE source_card = 'one'),
full_schema AS (SELECT * FROM sf UNION ALL SELECT object, code, field, 'Lookup', NULL, false, false, NULL FROM lk)
"""


def types(t):
    return gen_types(t.part)


def schema_of(t):
    f = types(t)
    return S.derive_schema(X.item_types(f), X.enum_types(f))


def full_schema(t):
    """The schema as a settled table: the checks below read it several times."""
    return settled(S.with_lookups(schema_of(t), S.relation_lookups(X.relations(types(t)))))


@query("scan_type_xml", f"""
WITH {TYPES_SQL} SELECT DISTINCT 'types/f' || lpad(f::VARCHAR, 9, '0') || '-items.xml' AS file, f % 13 = 5 AS malformed FROM pf""")
def scan_type_xml(t):
    return X.type_files(types(t)).select("file", "malformed")


@query("item_types", f"""
WITH {TYPES_SQL}
SELECT name, file, 'Type ' || f AS description, attr AS field, typ AS type, CASE WHEN required THEN 'false' ELSE 'true' END AS optional,
  CASE WHEN uniq THEN 'true' ELSE 'false' END AS uniq, dflt AS default_value FROM attr JOIN fs USING (f)
UNION ALL SELECT name, file, '', 'late', 'String', NULL, NULL, NULL FROM late JOIN fs USING (f)""")
def item_types(t):
    i = X.item_types(types(t)).select("name", "file", "description", F.explode("fields").alias("f"))
    mod = lambda k: F.try_element_at("f.modifiers", F.lit(k))
    return i.select("name", "file", "description", F.col("f.name").alias("field"), "f.type",
                    mod("optional").alias("optional"), mod("unique").alias("uniq"),
                    F.col("f.default").alias("default_value"))


@query("enum_types", f"WITH {TYPES_SQL} SELECT file, 'Kind' || f AS name, 'V' || (f * 50) || '|W' || f AS vals FROM fs")
def enum_types(t):
    return X.enum_types(types(t)).select("file", "name", F.array_join("values", "|").alias("vals"))


@query("relations", f"""
WITH {TYPES_SQL} SELECT file, source_type, source_card, target_type, 'many' AS target_card FROM rel""")
def relations(t):
    return X.relations(types(t)).drop("ord")


def _flat(df):
    return df.withColumn("picklist", F.array_join("picklist", "|")).withColumnsRenamed(
        {"unique": "uniq", "default": "dflt"})


@query("derive_schema", f"WITH {TYPES_SQL} SELECT * FROM sf")
def derive_schema(t):
    return _flat(schema_of(t))


@query("relation_lookups", f"""
WITH {TYPES_SQL} SELECT object, code, field, 'Lookup' AS type FROM lk""")
def relation_lookups(t):
    return S.relation_lookups(X.relations(types(t))).select("object", "code", "field", "type")


@query("schema_catalog", f"""
WITH {TYPES_SQL}
SELECT object, 0 AS part, '- ' || object || ': ' || string_agg(field || ' (' || type || ')', ', ' ORDER BY field || ' (' || type || ')') AS line
FROM full_schema GROUP BY object""")
def schema_catalog(t):
    return S.schema_catalog(full_schema(t))


def gen_refs(part):
    """code(file, text): object and field references, one file per 50 parts."""
    k = F.col("p_partkey")
    ks, f = k.cast("string"), F.floor(k / PER)
    fs = f.cast("string")
    line = (F.when(k % 6 == 0, _cat("List<Item", fs, "__c> rows = [SELECT Id, Attr", ks, "__c, p.Ghost", ks, "__c FROM Item", fs, "__c];"))
            .when(k % 6 == 1, _cat("Other", fs, "__c x = new Other", fs, "__c();"))
            .when(k % 6 == 2, _cat("y.ATTR", ks, "__c = 1; // y.Hidden", ks, "__c"))
            .when(k % 6 == 3, _cat("z.Phantom", ks, "__c = 2; /* new Nothing", ks, "__c() */"))
            .when(k % 6 == 4, _cat("Map<Id, Missing", ks, "__c> m;")).otherwise("w.Id = 3;"))
    rows = part.select(f.alias("file_id"), "p_partkey", line.alias("line"))
    return joined(rows, "file_id", "p_partkey", "line").select(
        "file_id", _cat("Ref", F.col("file_id").cast("string"), ".cls").alias("file"), F.col("body").alias("text"))


ISSUES_SQL = f"""
{TYPES_SQL},
rp AS (SELECT p_partkey AS k, f, 'Ref' || f || '.cls' AS file FROM pf),
objs AS (SELECT DISTINCT object FROM full_schema),
fields AS (SELECT DISTINCT object, lower(field) AS fl FROM full_schema),
anyf AS (SELECT DISTINCT lower(field) AS fl FROM full_schema),
uo AS (SELECT DISTINCT file, object FROM (
    SELECT file, 'Item' || f || '__c' AS object FROM rp WHERE k % 6 = 0
    UNION ALL SELECT file, 'Other' || f || '__c' FROM rp WHERE k % 6 = 1
    UNION ALL SELECT file, 'Missing' || k || '__c' FROM rp WHERE k % 6 = 4) WHERE object NOT IN (SELECT object FROM objs)),
uf AS (SELECT file, 'Item' || f || '__c' AS object, fld AS field FROM (
    SELECT file, f, UNNEST(['Attr' || k || '__c', 'Ghost' || k || '__c']) AS fld FROM rp WHERE k % 6 = 0) x
  WHERE 'Item' || f || '__c' IN (SELECT object FROM objs)
    AND NOT EXISTS (SELECT 1 FROM fields y WHERE y.object = 'Item' || x.f || '__c' AND y.fl = lower(x.fld))),
ud AS (SELECT file, field FROM (
    SELECT file, 'Ghost' || k || '__c' AS field FROM rp WHERE k % 6 = 0
    UNION ALL SELECT file, 'ATTR' || k || '__c' FROM rp WHERE k % 6 = 2
    UNION ALL SELECT file, 'Phantom' || k || '__c' FROM rp WHERE k % 6 = 3) WHERE lower(field) NOT IN (SELECT fl FROM anyf))
"""


@query("unknown_objects", f"""
WITH {ISSUES_SQL}
SELECT file, 'unknown_sobject' AS rule, 'References custom object ''' || object || ''' which is not defined in items.xml schema.' AS message,
  'WARNING' AS severity, object FROM uo""")
def unknown_objects(t):
    return S.unknown_objects(S.code_references(gen_refs(t.part)), full_schema(t)).drop("field")


@query("unknown_fields", f"""
WITH {ISSUES_SQL}
SELECT file, object, field, 'SOQL selects ''' || field || ''' from ' || object || ', but that field is not in the schema.' AS message FROM uf""")
def unknown_fields(t):
    return S.unknown_fields(S.code_references(gen_refs(t.part)), full_schema(t)).select("file", "object", "field", "message")


@query("unknown_dotted_fields", f"""
WITH {ISSUES_SQL}
SELECT file, field, 'References custom field ''' || field || ''' which exists on no object in the schema.' AS message FROM ud""")
def unknown_dotted_fields(t):
    return S.unknown_dotted_fields(S.code_references(gen_refs(t.part)), full_schema(t)).select("file", "field", "message")


@query("field_references", f"""
WITH {ISSUES_SQL}
SELECT file, 'unknown_sobject' AS rule, object, NULL AS field FROM uo
UNION ALL SELECT file, 'unknown_field', object, field FROM uf UNION ALL SELECT file, 'unknown_field', NULL, field FROM ud""")
def field_references(t):
    return S.field_references(gen_refs(t.part), full_schema(t)).select("file", "rule", "object", "field")


@query("reconcile_schema", f"""
WITH {ISSUES_SQL}
SELECT DISTINCT CASE WHEN object LIKE 'Other%' AND try_cast(regexp_extract(object, '[0-9]+', 0) AS BIGINT) % 2 = 0 THEN 'added_object' ELSE 'flagged' END AS kind,
  object, NULL AS field, NULL AS type, CASE WHEN object LIKE 'Other%' AND try_cast(regexp_extract(object, '[0-9]+', 0) AS BIGINT) % 2 = 0
    THEN 'referenced in Hybris source; not declared in items.xml' ELSE 'no source evidence — likely a hallucinated object' END AS reason
FROM uo WHERE object NOT LIKE 'Item%'
UNION ALL SELECT DISTINCT 'flagged', object, NULL, NULL, 'no source evidence — likely a hallucinated object' FROM uo WHERE object LIKE 'Item%'
UNION ALL SELECT DISTINCT CASE WHEN kk % 12 = 0 THEN 'added_field' ELSE 'flagged' END, object, field,
  CASE WHEN kk % 12 = 0 THEN CASE WHEN kk % 24 = 0 THEN 'Currency' ELSE 'Checkbox' END END,
  CASE WHEN kk % 12 = 0 THEN 'used in Hybris source; not declared in items.xml (type inferred as ' ||
     CASE WHEN kk % 24 = 0 THEN 'Currency' ELSE 'Checkbox' END || ')' ELSE 'no source evidence — likely a hallucinated field' END
  FROM (SELECT *, regexp_extract(field, '[0-9]+', 0)::BIGINT AS kk FROM uf WHERE field LIKE 'Ghost%')
UNION ALL SELECT DISTINCT 'flagged', object, field, NULL, 'no source evidence — likely a hallucinated field' FROM uf WHERE field NOT LIKE 'Ghost%'
UNION ALL SELECT DISTINCT 'flagged', NULL, field, NULL, 'object not determinable from a dotted access; left for review' FROM ud""")
def reconcile_schema(t):
    """The corpus names every 12th field and the objects of even blocks."""
    k, ks = F.col("p_partkey"), F.col("p_partkey").cast("string")
    line = (F.when(k % 24 == 0, _cat("private BigDecimal ghost", ks, ";"))
            .when(k % 12 == 0, _cat("public boolean getGhost", ks, "() { }"))
            .when((k % PER == 1) & (F.floor(k / PER) % 2 == 0), _cat("class MyOther", F.floor(k / PER).cast("string"), " {}")))
    corpus = t.part.select(_cat("c", ks).alias("file"), line.alias("text")).filter("text is not null")
    schema = full_schema(t)
    return S.reconcile_schema(S.field_references(gen_refs(t.part), schema), schema, corpus)


@query("field_metadata_rows", f"""
WITH {TYPES_SQL}
SELECT object, field, type, field[:-4] AS label, CASE WHEN type = 'Text' THEN 255 END AS length,
  CASE WHEN type IN ('Number', 'Currency') THEN 18 END AS precision, CASE WHEN type IN ('Number', 'Currency') THEN 2 END AS scale,
  CASE WHEN type = 'Checkbox' THEN CASE WHEN lower(dflt) IN ('true', '1') THEN 'true' ELSE 'false' END WHEN type = 'Text' THEN dflt END AS default_value,
  CASE WHEN type NOT IN ('Checkbox', 'Lookup') THEN required END AS required,
  CASE WHEN uniq AND type IN ('Number', 'Currency', 'Text') THEN true END AS uniq,
  CASE WHEN type = 'Lookup' THEN field END AS reference_to,
  CASE WHEN type = 'Picklist' THEN 2 END AS n_values FROM full_schema""")
def field_metadata_rows(t):
    m = S.field_metadata_rows(full_schema(t)).withColumnRenamed("unique", "uniq")
    return m.withColumn("n_values", F.when(F.col("values").isNotNull(), F.size("values")).cast("bigint")).drop("values")


@query("target_fit", f"""
WITH {TYPES_SQL},
planned AS (SELECT name AS object, count(*) AS n_fields FROM attr GROUP BY 1
  UNION ALL SELECT DISTINCT ['Order','Product','Cart','Price'][(p_partkey % 4) + 1], 1 FROM part),
inv AS (SELECT DISTINCT lower('Item' || f || '__c') AS o FROM fs WHERE f % 4 = 0 UNION ALL VALUES ('order'), ('product2'))
SELECT 'collision' AS kind, 'critical' AS severity, object || '__c' AS object, object || '__c' AS detail
  FROM planned WHERE lower(object || '__c') IN (SELECT o FROM inv)
UNION ALL SELECT 'reusable', 'high', object || '__c', CASE object WHEN 'Product' THEN 'Product2' ELSE 'Order' END FROM planned
  WHERE object IN ('Order', 'Product', 'Cart')
UNION ALL SELECT 'package', 'high', 'Salesforce CPQ', 'SBQQ'
UNION ALL SELECT 'headroom', 'critical', 'custom field', (SELECT sum(n_fields) FROM planned)::BIGINT || ' of 50'""")
def target_fit(t):
    items = X.item_types(types(t)).filter(F.size("fields") > 1)
    plan = items.select(F.col("name").alias("object"), F.size("fields").cast("bigint").alias("n_fields"))
    std = F.get(F.array(*[F.lit(x) for x in ("Order", "Product", "Cart", "Price")]), (F.col("p_partkey") % 4).cast("int"))
    plan = plan.unionByName(t.part.select(std.alias("object"), F.lit(1).cast("bigint").alias("n_fields")).distinct())
    even = items.filter(F.substring("name", F.lit(5), F.length("name")).cast("bigint") % 4 == 0)
    inv = even.select(F.concat("name", F.lit("__c")).alias("object")).unionByName(t.spark.createDataFrame(
        [("Order",), ("Product2",), ("SBQQ__Quote__c",)], "object string"))
    limits = t.spark.createDataFrame([("CustomObjects", 10**9, 10**9), ("CustomFields", 900, 50)],
                                     "name string, max bigint, remaining bigint")
    return S.target_fit(plan, inv, limits)


@query("namespaces", "SELECT DISTINCT 'N' || (p_size % 9) AS namespace FROM part WHERE p_partkey % 3 = 0")
def namespaces(t):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, _cat("N", (F.col("p_size") % 9).cast("string"), "__O", k.cast("string"), "__c")).otherwise(
        _cat("O", k.cast("string"), "__c"))
    return S.namespaces(t.part.select(name.alias("object")))


def gen_errors(part):
    """errors(file, problem): compiler-like messages, one per part."""
    k = F.col("p_partkey")
    ks, fs = k.cast("string"), F.floor(k / PER).cast("string")
    msg = (F.when(k % 5 == 0, _cat("No such column 'Attr", ks, "__c' on entity 'Item", fs, "__c'. Check the name."))
           .when(k % 5 == 1, _cat("no CustomField named Item", fs, "__c.Attr", ks, "__c found"))
           .when(k % 5 == 2, _cat("sObject type 'Item", fs, "__c' is not supported."))
           .when(k % 5 == 3, _cat("Invalid type: Ghost", fs, "__c")).otherwise("Unexpected token '('."))
    return part.select("p_partkey", _cat("Ref", F.floor(k / 3).cast("string"), ".cls").alias("file"), msg.alias("problem"))


@query("missing_from_errors", """
WITH e AS (SELECT p_partkey AS k, p_partkey // 50 AS f FROM part)
SELECT DISTINCT 'Item' || f || '__c' AS object, 'Attr' || k || '__c' AS field, 'field' AS kind FROM e WHERE k % 5 IN (0, 1)
UNION ALL SELECT DISTINCT CASE WHEN k % 5 = 2 THEN 'Item' ELSE 'Ghost' END || f || '__c', NULL, 'object' FROM e WHERE k % 5 IN (2, 3)""")
def missing_from_errors(t):
    return S.missing_from_errors(gen_errors(t.part))


@query("route_errors", """
WITH e AS (SELECT p_partkey AS k, p_partkey // 3 AS file_id, p_partkey // 50 AS f FROM part),
r AS (SELECT file_id, bool_and(CASE WHEN k % 5 IN (0, 1) THEN k % 2 = 0 OR f % 3 = 0 WHEN k % 5 = 2 THEN f % 3 = 0 ELSE false END) AS ok FROM e GROUP BY 1)
SELECT 'Ref' || file_id || '.cls' AS file, CASE WHEN ok THEN 'resolved via metadata' WHEN file_id % 7 = 0 THEN 'not a generated class'
  ELSE 'needs repair' END AS disposition FROM r""")
def route_errors(t):
    k = F.col("p_partkey")
    fields = t.part.filter(k % 2 == 0).select(_cat("tr", k.cast("string"), "__c").alias("token"))
    f = F.floor(k / PER)
    objs = t.part.filter(f % 3 == 0).select(_cat("Item", f.cast("string"), "__c").alias("token")).distinct()
    arts = t.part.select(F.floor(k / 3).alias("f")).filter("f % 7 <> 0").select(
        _cat("Ref", F.col("f").cast("string"), ".cls").alias("file"))
    return S.route_errors(gen_errors(t.part), fields.unionByName(objs), arts)


COVER_SQL = """
cov AS (SELECT CASE WHEN l_partkey % 10 = 0 THEN 'P' || l_partkey || 'Test' ELSE 'P' || l_partkey END AS name,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS covered, 1 AS total FROM lineitem)
"""


def coverage_rows(t):
    k = F.col("l_partkey")
    name = F.when(k % 10 == 0, _cat("P", k.cast("string"), "Test")).otherwise(_cat("P", k.cast("string")))
    return t.lineitem.select(name.alias("name"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("covered"),
                             F.lit(1).alias("total"))


@query("coverage_rollup", f"""
WITH {COVER_SQL}, p AS (SELECT name, round_even(100.0 * sum(covered)::DOUBLE / sum(total), 1) AS coverage FROM cov GROUP BY name)
SELECT name, coverage, coverage < 75 AND name NOT LIKE '%Test' AS strengthen FROM p""")
def coverage_rollup(t):
    return S.coverage_rollup(coverage_rows(t))


@query("coverage_overall", f"WITH {COVER_SQL} SELECT round_even(100.0 * sum(covered)::DOUBLE / sum(total), 1) AS coverage FROM cov")
def coverage_overall(t):
    return S.coverage_overall(coverage_rows(t))
