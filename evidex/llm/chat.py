"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.graph import peeled_levels
from evidex.operators.scale import computed, global_rank, settled

#: Tools whose parameter lists are broadcast at most.
BROADCAST_TOOLS = 10_000
TYPES = ("string", "integer", "number", "boolean", "object", "array")


def quoted(text: Column) -> Column:
    """A JSON string of ``text``, or null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(listed.substr(F.lit(2), F.length(listed) - 2))


def _kind(value: Column) -> Column:
    """JSON type of a variant: integers are numbers without a fraction."""
    said = F.upper(F.schema_of_variant(value))
    return (F.when(said.startswith("OBJECT"), "object").when(said.startswith("ARRAY"), "array").when(said == "STRING", "string")
            .when(said == "BOOLEAN", "boolean").when(said.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(said.startswith("DECIMAL") | said.isin("DOUBLE", "FLOAT"), "number").otherwise("null"))


def _problem(x: Column) -> Column:
    """What is wrong with one parameter (p, kind of its value), or null."""
    p, kind = x["p"], x["kind"]
    value = p["value"]
    fits = (kind == p["type"]) | ((p["type"] == "number") & (kind == "integer"))
    amount = F.when(kind.isin("integer", "number"), value.cast("double"))
    return (F.when(value.isNull() & p["required"], F.concat(p["param"], F.lit(": missing")))
            .when(value.isNotNull() & ~fits, F.concat(p["param"], F.lit(": not "), p["type"]))
            .when(F.coalesce(amount < p["minimum"], F.lit(False)), F.concat(p["param"], F.lit(": too small"))))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls by ``edges`` (conv_id, call_id, after); level 0 waits for nothing.

    Edges to calls that are not there do not count. Calls on a cycle, or behind one, have no
    row. Rounds grow with the logarithm of a chain and the depth of what branches.
    """
    before = nodes.select("conv_id", F.col("call_id").alias("after"))
    inside = edges.distinct().join(before, ["conv_id", "after"], "left_semi")
    plain = settled(inside.select(F.struct("conv_id", "call_id").alias("src"), F.struct("conv_id", F.col("after").alias("call_id")).alias("dst")), "waits")
    known, left = peeled_levels(plain)
    every = nodes.select(F.struct("conv_id", "call_id").alias("node"))
    if left is not None:
        every = every.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return every.join(known, "node", "left").select("node.conv_id", "node.call_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, level, tool, valid, problems, answered, message) of every call.

    ``calls`` has conv_id, call_id, tool, arguments (JSON text) and after (array of call ids);
    ``results`` conv_id, call_id, seq, content; ``schemas`` tool, param, type (one of TYPES),
    required, minimum (null: none). position counts the calls of a conversation from 0 in
    topological order: by level, then call_id; calls on a cycle come last without a level and are not valid. message
    is JSON without blanks, keys in order at every depth: arguments, call_id, name, result.

    Arguments that are no JSON object, parameters that are missing, of another type, too small or not in
    the schema, and tools without a schema make a call invalid; problems names them, sorted.
    Such text is written as a JSON string. Of calls of one id that with the least tool and
    arguments counts, of results that of least seq and then content; results without a call
    are left out, and a call without one has the result null. Rows with a null conversation
    or call id are left out; other columns are not read; empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    one = F.struct(F.coalesce("tool", F.lit("")).alias("tool"), F.coalesce("arguments", F.lit("")).alias("arguments"), F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    calls = settled(calls.select(*key, one.alias("one")).dropna(subset=key).groupBy(*key).agg(F.min("one").alias("one")).select(*key, "one.*"), "calls")
    first = results.select(*key, F.struct("seq", "content").alias("one")).dropna(subset=key).groupBy(*key).agg(F.min("one").alias("one"))
    first = first.select(*key, F.col("one.content").alias("content"), F.lit(True).alias("answered"))
    tools = schemas.dropna(subset=["tool", "param"]).groupBy("tool").agg(F.collect_set(F.struct(
        "param", F.lower("type").alias("type"), F.coalesce("required", F.lit(False)).alias("required"), F.col("minimum").cast("double").alias("minimum"))).alias("params"))
    tools = F.broadcast(tools) if tools.count() <= BROADCAST_TOOLS else tools

    ordered = levels(calls, calls.select(*key, F.explode("after").alias("after")))
    rows = calls.drop("after").hint("shuffle_hash").join(first, key, "left").join(ordered, key, "left").join(tools, "tool", "left")
    # Each step is computed once for a row, not at every use in the lambdas below.
    rows = computed(rows, v=F.try_parse_json("arguments"))
    rows = computed(rows, v=F.when(_kind(F.col("v")) == "object", F.col("v")))
    rows = computed(rows, m=F.col("v").cast("map<string,variant>"))
    found = F.transform("params", lambda p: F.struct(p["param"].alias("param"), p["type"].alias("type"), p["required"].alias("required"),
                                                     p["minimum"].alias("minimum"), F.element_at("m", p["param"]).alias("value")))
    rows = computed(rows, found=F.transform(found, lambda p: F.struct(p.alias("p"), _kind(p["value"]).alias("kind"))))
    wrong = F.array_compact(F.transform("found", _problem))
    known = F.transform("params", lambda p: p["param"])
    other = F.transform(F.filter(F.map_keys("m"), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(k, F.lit(": unknown")))
    own = (F.when(F.col("params").isNull(), F.array(F.lit("tool: unknown")))
           .when(F.col("v").isNull(), F.array(F.lit("arguments: not an object"))).otherwise(F.concat(wrong, other)))
    rows = computed(rows, own=own)
    problems = F.array_sort(F.when(F.col("level").isNull(), F.concat("own", F.array(F.lit("order: cycle")))).otherwise(F.col("own")))
    rows = computed(rows, problems=problems)
    message = F.concat(F.lit('{"arguments":'), F.when(F.col("v").isNull(), quoted(F.col("arguments"))).otherwise(F.to_json("v")),
                       F.lit(',"call_id":'), quoted(F.col("call_id").cast("string")), F.lit(',"name":'), quoted(F.col("tool")),
                       F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    rows = rows.select(*key, "level", "tool", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"),
                       F.coalesce("answered", F.lit(False)).alias("answered"), message.alias("message"))
    ranked = settled(global_rank(rows, [F.asc("conv_id"), F.asc_nulls_last("level"), F.asc("call_id")]), "ranked")
    low = ranked.groupBy("conv_id").agg(F.min("rank").alias("low"))
    return ranked.join(low, "conv_id").select(*key, (F.col("rank") - F.col("low")).alias("position"), "level", "tool", "valid", "problems", "answered", "message")
