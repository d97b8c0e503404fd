"""Type-definition XML as tables: item types, enums, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.functions.rules import MODIFIERS
from evidex.operators.scale import computed

_MOD = ",".join(f"_{m}:string" for m in MODIFIERS)
_ITEM = ("_code string, description string, attributes struct<attribute:array<struct<"
         "_qualifier:string,_type:string,_default:string,description:string,defaultvalue:string,"
         f"modifiers:struct<{_MOD}>>>>")
_ENUM = "_code string, value array<struct<_code:string>>"
_END = "struct<_type:string,_cardinality:string>"
_REL = f"_code string, sourceElement {_END}, targetElement {_END}"
_CORRUPT = {"columnNameOfCorruptRecord": "_corrupt_record"}


def type_files(files: DataFrame) -> DataFrame:
    """Type-definition files with ``malformed``: a bad file costs its own rows and is kept."""
    src = files.filter((F.col("name") == "items.xml") | F.col("name").endswith("-items.xml"))
    parsed = computed(src, _x=F.from_xml("text", "_corrupt_record string", _CORRUPT))
    return parsed.withColumn("malformed", F.col("_x._corrupt_record").isNotNull()).drop("_x")


def _elements(files: DataFrame, tag: str, schema: str) -> DataFrame:
    """One row per element at any depth, numbered in document order."""
    pattern = rf"(?s)<{tag}\b(?:[^>]*/>|.*?</{tag}>)"
    good = type_files(files).filter("not malformed")
    raw = good.select("file", F.posexplode(F.regexp_extract_all(
        F.regexp_replace("text", r"(?s)<!--.*?-->", ""), F.lit(pattern), F.lit(0))).alias("ord", "_e"))
    return computed(raw, _x=F.from_xml("_e", schema)).drop("_e")


def _modifiers(m: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), m[f"_{n}"].alias("value")) for n in MODIFIERS])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def item_types(files: DataFrame) -> DataFrame:
    """item_types(file, ord, name, description, fields array<struct<...>>)."""
    e = _elements(files, "itemtype", _ITEM)
    fields = F.transform(
        F.coalesce(F.col("_x.attributes.attribute"), F.array()), lambda a: F.struct(
            F.coalesce(a["_qualifier"], F.lit("")).alias("name"),
            F.coalesce(a["_type"], F.lit("")).alias("type"),
            F.coalesce(a["description"], F.lit("")).alias("description"),
            _modifiers(a["modifiers"]).alias("modifiers"),
            F.coalesce(F.nullif(T.strip(a["defaultvalue"]), F.lit("")), a["_default"]).alias("default")))
    return e.select("file", F.col("ord").cast("bigint").alias("ord"),
                    F.coalesce("_x._code", F.lit("Unknown")).alias("name"),
                    F.coalesce("_x.description", F.lit("")).alias("description"), fields.alias("fields"))


def enum_types(files: DataFrame) -> DataFrame:
    """enums(file, ord, name, values); enums without values are dropped."""
    e = _elements(files, "enumtype", _ENUM)
    values = F.filter(F.transform(F.coalesce(F.col("_x.value"), F.array()), lambda v: v["_code"]),
                      lambda c: c.isNotNull() & (c != ""))
    out = e.select("file", F.col("ord").cast("bigint").alias("ord"), F.col("_x._code").alias("name"),
                   values.alias("values"))
    return out.filter((F.col("name") != "") & (F.size("values") > 0))


def relations(files: DataFrame) -> DataFrame:
    """relations(file, ord, source_type, source_card, target_type, target_card); many by default."""
    e = _elements(files, "relation", _REL)
    card = lambda c: F.coalesce(F.col(f"_x.{c}._cardinality"), F.lit("many"))
    return e.filter("_x.sourceElement is not null and _x.targetElement is not null").select(
        "file", F.col("ord").cast("bigint").alias("ord"),
        F.col("_x.sourceElement._type").alias("source_type"), card("sourceElement").alias("source_card"),
        F.col("_x.targetElement._type").alias("target_type"), card("targetElement").alias("target_card"))
