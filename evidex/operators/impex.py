"""Header-typed data files to load tables. A file is one row of files(file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.functions import text as T
from evidex.operators.schema import field_name, object_name
from evidex.operators.scale import computed


def impex_blocks(files: DataFrame) -> DataFrame:
    """impex_blocks(file, block_no, mode, type, header, columns, rows array<struct<line_no, raw>>).

    Comments, blanks and macro lines are dropped, and rows before the first header. A block
    without rows is a block all the same. Lines are cut into blocks inside the row of their
    file, so nothing is shuffled.
    """
    every = F.transform(F.split("text", "\r?\n"), lambda raw, n: F.struct(
        (n + 1).cast("bigint").alias("line_no"), raw.alias("raw"), T.strip(raw).alias("s")))
    every = F.transform(every, lambda x: F.struct(x["line_no"], x["raw"], x["s"], x["s"].rlike(R.IMPEX_HEADER).alias("head")))
    kept = computed(files.select("file", "text"), lines=F.filter(every, lambda x: x["head"] | x["s"].startswith(";")))
    heads = F.transform(F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), x["s"].alias("s"), x["head"].alias("head"))),
                                 lambda x: x["head"]), lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s")))
    kept = computed(kept, heads=heads)
    one = kept.select("file", "lines", "heads", F.posexplode("heads").alias("i", "h"))
    after = F.coalesce(F.get("heads", F.col("i") + 1)["at"], F.size("lines") + 1)
    rows = F.transform(F.slice("lines", F.col("h.at") + 1, after - F.col("h.at") - 1), lambda x: F.struct(x["line_no"].alias("line_no"), x["raw"].alias("raw")))
    part = lambda k: F.regexp_extract("h.s", R.IMPEX_HEADER, k)
    out = one.select("file", (F.col("i") + 1).cast("bigint").alias("block_no"), part(1).alias("mode"), part(2).alias("type"),
                     part(3).alias("header"), rows.alias("rows"))
    return computed(out, columns=columns_of(F.col("header"))).select("file", "block_no", "mode", "type", "header", "columns", "rows")


def impex_lines(blocks: DataFrame) -> DataFrame:
    """impex_lines(file, block_no, mode, type, header, line_no, raw): the ``;``-led rows."""
    return blocks.select("file", "block_no", "mode", "type", "header", F.explode("rows").alias("r")).select(
        "file", "block_no", "mode", "type", "header", "r.line_no", "r.raw")


def columns_of(header: Column) -> Column:
    """array<struct<pos, raw, attr, modifiers, is_ref, ref_key, composite, is_macro, is_unique>>."""
    def one(raw: Column, pos: Column) -> Column:
        t = T.strip(raw)
        inside = F.regexp_extract(t, r"\[([^\[\]]*)\]\s*$", 1)
        core = T.strip(F.regexp_replace(t, r"\[[^\[\]]*\]\s*$", ""))
        parts = F.filter(F.transform(F.split(inside, ","), lambda p: T.strip(p)), lambda p: p != "")
        mods = F.aggregate(
            parts, F.create_map().cast("map<string,string>"),
            lambda m, p: F.map_concat(
                F.map_filter(m, lambda k, v: k != T.strip(F.substring_index(p, "=", 1))),
                F.create_map(T.strip(F.substring_index(p, "=", 1)), F.when(
                    p.contains("="), F.regexp_replace(T.strip(F.regexp_replace(p, "^[^=]*=", "")),
                                                      "^['\"]+|['\"]+$", "")).otherwise("true"))))
        macro, ref = core.startswith("$"), core.contains("(")
        inner = F.regexp_extract(core, r"^[^(]*\((.*)\)[^)]*$", 1)
        composite = ref & (inner.contains("(") | inner.contains(","))
        return F.struct(
            pos.cast("bigint").alias("pos"), t.alias("raw"),
            F.when(macro | ~ref, core).otherwise(T.strip(F.substring_index(core, "(", 1))).alias("attr"),
            mods.alias("modifiers"), (~macro & ref).alias("is_ref"),
            F.when(~macro & ref & ~composite, T.strip(inner)).alias("ref_key"),
            (~macro & composite).alias("composite"), macro.alias("is_macro"),
            F.coalesce(F.lower(F.try_element_at(mods, F.lit("unique"))) == "true", F.lit(False))
            .alias("is_unique"))

    return F.transform(F.split(header, ";"), one)


def header_columns(blocks: DataFrame) -> DataFrame:
    """impex_columns(file, block_no, type, pos, raw, attr, modifiers, is_ref, ...)."""
    return blocks.select("file", "block_no", "mode", "type", F.explode("columns").alias("c")).select(
        "file", "block_no", "mode", "type", "c.*")


def _values(raw: Column) -> Column:
    return F.slice(F.split(raw, ";"), F.lit(2), F.size(F.split(raw, ";")))


def cells(blocks: DataFrame) -> DataFrame:
    """impex_cells(file, block_no, line_no, type, mode, pos, attr, value) by positional zip.

    Short rows leave trailing cells unset, extra cells are dropped.
    """
    rows = blocks.select("file", "block_no", "type", "mode", "columns", F.explode("rows").alias("r"))
    rows = rows.select("file", "block_no", "r.line_no", "type", "mode", "columns", _values(F.col("r.raw")).alias("v"))
    n = F.least(F.size("columns"), F.size("v"))
    zipped = F.arrays_zip(F.slice("columns", F.lit(1), n).alias("c"), F.slice("v", F.lit(1), n).alias("v"))
    out = rows.select("file", "block_no", "line_no", "type", "mode", F.explode(zipped).alias("z"))
    return out.select("file", "block_no", "line_no", "type", "mode", F.col("z.c.pos").alias("pos"),
                      F.when(F.col("z.c.is_macro"), F.col("z.c.raw")).otherwise(F.col("z.c.attr")).alias("attr"),
                      T.strip("z.v").alias("value"))


def load_header(c: Column) -> Column:
    """CSV header of a column, null for macros and composite references."""
    api = field_name(c["attr"])
    ref = F.concat(F.regexp_replace(api, "__c$", ""), F.lit("__r."), field_name(c["ref_key"]))
    return F.when(c["is_macro"] | c["composite"], F.lit(None)).when(
        c["is_ref"], F.when(c["ref_key"] != "", ref).otherwise(api)).otherwise(api)


def load_headers(blocks: DataFrame) -> DataFrame:
    """(object, header, ord): first-seen order of the headers per object."""
    b = blocks.select("file", "block_no", "type", F.explode("columns").alias("c"))
    h = b.select(object_name(F.col("type")).alias("object"), load_header(F.col("c")).alias("header"),
                 F.struct("file", "block_no", "c.pos").alias("at")).filter("header is not null")
    first = h.groupBy("object", "header").agg(F.min("at").alias("at"))
    # One row per distinct header of an object: column names, not data.
    w = Window.partitionBy("object").orderBy("at")
    return first.select("object", "header", F.row_number().over(w).cast("bigint").alias("ord"))


def load_objects(blocks: DataFrame) -> DataFrame:
    """load_objects(object, type, modes, manual_relationships)."""
    b = blocks
    spec = F.transform(F.filter("columns", lambda c: c["composite"]),
                       lambda c: F.concat(c["attr"], F.lit(" → "), c["raw"]))
    return b.select("type", "mode", F.explode_outer(spec).alias("spec")).groupBy("type").agg(
        F.array_sort(F.collect_set("mode")).alias("modes"),
        F.array_sort(F.collect_set("spec")).alias("manual_relationships")).select(
        object_name(F.col("type")).alias("object"), "type", "modes", "manual_relationships")


def load_records(blocks: DataFrame) -> DataFrame:
    """load_records(object, mode, file, line_no, header, value), long form; unset cells are ''.

    One row per line and header. Where several columns name one attribute, the last cell that
    the line has counts.
    """
    named = F.filter(F.transform("columns", lambda c: F.struct(load_header(c).alias("header"), c["attr"].alias("attr"), c["pos"].cast("int").alias("pos"))),
                     lambda c: c["header"].isNotNull())
    b = computed(blocks, _n=named)

    def spots(header: Column) -> Column:
        attr = F.element_at(F.filter("_n", lambda c: c["header"] == header), -1)["attr"]
        same = F.filter("_n", lambda c: c["attr"] == attr)
        return F.reverse(F.transform(same, lambda c: c["pos"]))

    heads = F.transform(F.array_distinct(F.transform("_n", lambda c: c["header"])), lambda h: F.struct(h.alias("header"), spots(h).alias("spots")))
    b = computed(b, _h=heads)
    rows = b.select(object_name(F.col("type")).alias("object"), "mode", "file", "_h", F.explode("rows").alias("r"))
    rows = rows.select("object", "mode", "file", "r.line_no", "_h", _values(F.col("r.raw")).alias("v"))
    value = lambda h: F.get("v", F.get(F.filter(h["spots"], lambda p: p < F.size("v")), F.lit(0)))
    cells_ = F.transform("_h", lambda h: F.struct(h["header"].alias("header"), F.coalesce(T.strip(value(h)), F.lit("")).alias("value")))
    return rows.select("object", "mode", "file", "line_no", F.explode(cells_).alias("c")).select("object", "mode", "file", "line_no", "c.header", "c.value")


def external_keys(blocks: DataFrame) -> DataFrame:
    """(object, external_id, note): the first unique plain column, never a reference."""
    b = blocks.select("file", "block_no", "type", F.explode("columns").alias("c"))
    at = F.struct("file", "block_no", "c.pos")
    key = F.col("c.is_unique") & ~F.col("c.is_ref") & ~F.col("c.is_macro")
    out = b.groupBy(object_name(F.col("type")).alias("object")).agg(
        F.min_by(F.when(key, field_name(F.col("c.attr"))), F.when(key, at)).alias("external_id"))
    return out.withColumn("note", F.when(F.col("external_id").isNull(), F.lit(R.NO_KEY_NOTE)).otherwise(""))


def mark_keys(schema: DataFrame, keys: DataFrame) -> DataFrame:
    """Add external_id to schema_fields and force unique on the key, where the field exists."""
    k = keys.filter("external_id is not null").select(
        "object", F.col("external_id").alias("field"), F.lit(True).alias("_k"))
    out = schema.join(k, ["object", "field"], "left")
    hit = F.coalesce("_k", F.lit(False))
    return out.withColumn("external_id", hit).withColumn("unique", F.col("unique") | hit).drop("_k")


def load_summary(blocks: DataFrame) -> DataFrame:
    """Per object: records, key, sorted modes."""
    n = blocks.groupBy(object_name(F.col("type")).alias("object")).agg(F.sum(F.size("rows")).cast("bigint").alias("records"))
    return (n.join(external_keys(blocks).select("object", "external_id"), "object", "left")
            .join(load_objects(blocks).select("object", "modes"), "object", "left"))
