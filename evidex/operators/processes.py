"""Business-process XML as node and edge tables, their ledger and flow topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions import names as N
from evidex.functions import text as T
from evidex.operators.scale import computed, dealt_key, side_by_side

_TR = "array<struct<_name:string,_to:string>>"
_ACT = f"array<struct<_id:string,_bean:string,_class:string,transition:{_TR}>>"
_FLOW = (f"array<struct<_id:string,_then:string,event:string,timeout:struct<_delay:string,_then:string>,"
         f"transition:{_TR}>>")
_END = "array<struct<_id:string,_state:string>>"
_PROC = (f"_name string, _start string, _processClass string, _onError string, action {_ACT}, scriptAction {_ACT}, "
         f"wait {_FLOW}, split {_FLOW}, join {_FLOW}, notify {_FLOW}, end {_END}, _corrupt_record string")


def process_files(files: DataFrame) -> DataFrame:
    """Process definitions by root element; malformed ones stay, marked unreadable."""
    # The first tag that is no declaration, doctype or comment; a doctype may hold declarations of its own.
    subset = r"""\[(?:<!--.*?-->|<\?.*?\?>|"[^"]*"|'[^']*'|[^\]"'])*+\]\s*"""
    doctype = r"""<!DOCTYPE(?:"[^"<]*"|'[^'<]*'|[^\["'<>])*+(?:""" + subset + r")?>|<!DOCTYPE[^>]*>"
    root = r"(?s)^(?>(?:[^<]|<!--.*?-->|<\?.*?\?>|" + doctype + r")*+)<\s*(?:\w+:)?process\b"
    src = files.filter(F.col("file").endswith(".xml") & F.col("text").rlike(root))
    x = computed(src.select("file", "text"), _x=F.from_xml("text", _PROC, {
        "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}))
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.[^.]*$", "")
    return x.withColumn("unreadable", F.col("_x._corrupt_record").isNotNull()).withColumn(
        "process", F.when(F.col("unreadable"), stem).otherwise(F.coalesce("_x._name", stem)))


def _first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def process_nodes(procs: DataFrame) -> DataFrame:
    """process_nodes(file, process, node, kind, ord, bean, edges array<name,to>, event, delay, state)."""
    no = F.array().cast("array<struct<name:string,to:string>>")
    edge = lambda n, to: F.struct(n.alias("name"), to.alias("to"))
    some = lambda a: F.filter(a, lambda e: F.coalesce(e["to"], F.lit("")) != "")
    named = lambda x: F.transform(F.coalesce(x["transition"], F.array()), lambda t: edge(
        F.coalesce(t["_name"], F.lit("")), F.coalesce(t["_to"], F.lit(""))))
    s = lambda c=None: (F.lit(None).cast("string") if c is None else c)

    def rec(kind: str, x: Column, bean: Column, edges: Column, event: Column, delay: Column, state: Column) -> Column:
        return F.struct(F.coalesce(x["_id"], F.lit("")).alias("node"), F.lit(kind).alias("kind"),
                        bean.alias("bean"), edges.alias("edges"), event.alias("event"),
                        delay.alias("delay"), state.alias("state"))

    def acts(tag: str) -> Column:
        return F.transform(F.coalesce(F.col(f"_x.{tag}"), F.array()), lambda x: rec(
            "action", x, F.coalesce(F.nullif(x["_bean"], F.lit("")), x["_class"], F.lit("")), named(x), s(), s(), s()))

    def flows(tag: str) -> Column:
        def one(x: Column) -> Column:
            outs = F.concat(F.array(edge(F.lit("then"), x["_then"]), edge(F.lit("timeout"), x["timeout"]["_then"])),
                            named(x))
            return rec(tag, x, s(), some(outs), T.strip(x["event"]), x["timeout"]["_delay"], s())
        return F.transform(F.coalesce(F.col(f"_x.{tag}"), F.array()), one)

    ends = F.transform(F.coalesce(F.col("_x.end"), F.array()), lambda x: rec(
        "end", x, s(), no, s(), s(), x["_state"]))
    everything = F.concat(acts("action"), acts("scriptAction"), flows("wait"), flows("split"),
                          flows("join"), flows("notify"), ends)
    rows = procs.filter("not unreadable").select("file", "process", F.posexplode(everything).alias("ord", "n"))
    return rows.select("file", "process", F.col("ord").cast("bigint").alias("ord"), "n.*")


def process_edges(nodes: DataFrame) -> DataFrame:
    """process_edges(file, process, node, ord, name, target)."""
    return nodes.select("file", "process", "node", F.posexplode("edges").alias("ord", "e")).select(
        "file", "process", "node", F.col("ord").cast("bigint").alias("ord"), "e.name", F.col("e.to").alias("target"))


def resolve_bean(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Add implemented_by: the bean, else its part after the last dot, as a known class; else ''."""
    known = classes.select("class_name").distinct()
    whole = known.select(F.col("class_name").alias("_c1"), F.col("class_name").alias("_hit1"))
    tail = known.select(F.col("class_name").alias("_c2"), F.col("class_name").alias("_hit2"))
    n = nodes.withColumns({"_c1": dealt_key(nodes, _first_upper(F.col("bean"))),
                           "_c2": dealt_key(nodes, _first_upper(F.substring_index("bean", ".", -1)))})
    out = n.join(whole, "_c1", "left").join(tail, "_c2", "left")
    return out.withColumn("implemented_by", F.coalesce("_hit1", "_hit2", F.lit(""))).drop(
        "_c1", "_c2", "_hit1", "_hit2")


def process_tables(procs: DataFrame, nodes: DataFrame) -> DataFrame:
    """processes(file, process, actions, flow_nodes, ends, transitions, unreadable)."""
    act, end = F.col("kind") == "action", F.col("kind") == "end"
    per = nodes.groupBy("file").agg(
        F.count_if(act).alias("actions"), F.count_if(~act & ~end).alias("flow_nodes"),
        F.count_if(end).alias("ends"), F.sum(F.size("edges")).alias("transitions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = procs.select("file", "process", F.col("_x._start").alias("start"), "unreadable").join(per, "file", "left")
    return out.select("file", "process", "start", "unreadable", zero("actions"), zero("flow_nodes"),
                      zero("ends"), zero("transitions"))


def _with_class(nodes: DataFrame, converted: DataFrame, flag: str) -> DataFrame:
    """Nodes with ``flag`` true where their class is among ``converted``; unresolved ones are dealt out, not one key."""
    done = converted.select(F.col("class_name").alias("_key"), F.lit(True).alias(flag)).distinct()
    return nodes.withColumn("_key", dealt_key(nodes, "implemented_by")).join(done, "_key", "left").drop("_key")


def coverage(nodes: DataFrame, converted: DataFrame) -> DataFrame:
    """Per process of resolved nodes: actions, resolved, wired (class converted), waits."""
    n = _with_class(nodes, converted, "_w")
    act = F.col("kind") == "action"
    return n.groupBy("file", "process").agg(
        F.count_if(act).alias("actions"), F.count_if(act & (F.col("implemented_by") != "")).alias("resolved"),
        F.count_if(act & F.coalesce("_w", F.lit(False))).alias("wired"),
        F.count_if(~act & (F.col("kind") != "end")).alias("waits"),
        F.count_if(act & (F.size(F.filter("edges", lambda e: e["to"] != "")) > 1)).alias("branches"))


def process_summary(tables: DataFrame, cover: DataFrame) -> DataFrame:
    """One row over all processes; every readable one has a scaffold."""
    c = cover.agg(F.coalesce(F.sum("resolved"), F.lit(0)).alias("actions_resolved"),
                  F.coalesce(F.sum("wired"), F.lit(0)).alias("wired"),
                  F.coalesce(F.sum(F.col("actions") - F.col("wired") + F.col("branches") + F.col("waits")),
                             F.lit(0)).alias("review_items"))
    t = tables.agg(F.count(F.lit(1)).alias("processes"), F.sum("actions").alias("actions"),
                   F.count_if("unreadable").alias("unreadable"), F.sum("transitions").alias("transitions"),
                   F.count_if(~F.col("unreadable")).alias("scaffolded"))
    return side_by_side(t, c)


def covered_classes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'action' and implemented_by <> ''").select(
        F.col("implemented_by").alias("class_name")).distinct()


def process_ledger(tables: DataFrame, cover: DataFrame, flows: DataFrame) -> DataFrame:
    """(source, outcome, target, wired, actions): unreadable, scaffolded (a flow exists) or manual."""
    f = flows.select("process", F.lit(True).alias("_flow")).distinct()
    out = tables.join(cover.select("file", "wired"), "file", "left").join(f, "process", "left")
    flow = F.col("_flow").isNotNull() & ~F.col("unreadable")
    return out.select(
        F.col("process").alias("source"), "file",
        F.when(F.col("unreadable"), "unreadable").when(flow, "scaffolded").otherwise("manual").alias("outcome"),
        F.when(flow, F.concat(F.lit("flows/"), N.safe_name(F.col("process")))).otherwise("—").alias("target"),
        F.coalesce("wired", F.lit(0)).cast("bigint").alias("wired"), "actions", "transitions")


def flow_topology(nodes: DataFrame, procs: DataFrame, converted: DataFrame) -> DataFrame:
    """One row per edge or edgeless node: element, element kind, connector target, wired, minutes.

    Dangling targets lose their target. More than one outgoing edge makes a decision on the
    transition name. The start of a process is its declared start, else its first action.
    """
    named = nodes.select("file", F.col("node").alias("target"), N.safe_name(F.col("node")).alias("target_el")).distinct()
    act = F.col("kind") == "action"
    first = nodes.filter(act).groupBy("file").agg(F.min_by("node", "ord").alias("_first"))
    start = procs.select("file", F.col("_x._start").alias("_declared"))
    known = nodes.select("file", F.col("node").alias("_declared"), F.lit(True).alias("_ok")).distinct()
    start = start.join(known, ["file", "_declared"], "left").join(first, "file", "left").select(
        "file", F.when(F.col("_ok"), F.col("_declared")).otherwise(F.col("_first")).alias("_start"))
    live = F.filter("edges", lambda e: e["to"] != "")
    n = _with_class(nodes, converted, "wired").join(start, "file", "left")
    n = n.select("file", "process", "node", "kind", N.safe_name(F.col("node")).alias("element"),
                 F.coalesce("wired", F.lit(False)).alias("wired"), (F.col("node") == F.col("_start")).alias("is_start"),
                 F.when(~act & (F.col("kind") != "end"), N.duration_minutes(F.col("delay"))).alias("minutes"),
                 F.size(live).alias("n_out"), F.explode_outer(live).alias("e"))
    out = n.withColumn("target", F.col("e.to")).join(named, ["file", "target"], "left")
    many = act & (F.col("n_out") > 1)
    return out.select(
        "file", "process", "element", "kind", "wired", F.coalesce("is_start", F.lit(False)).alias("is_start"),
        F.col("minutes").cast("bigint").alias("minutes"),
        F.when(F.col("n_out") == 0, "none").when(many, "decision").otherwise("connector").alias("link"),
        F.when(many, F.col("e.name")).alias("outcome"), F.col("target_el").alias("target"))


def review_notes(nodes: DataFrame, converted: DataFrame) -> DataFrame:
    """One note per unwired action, per branching action and per wait."""
    n = _with_class(nodes, converted, "_w")
    act = F.col("kind") == "action"
    n_out = F.size(F.filter("edges", lambda e: e["to"] != ""))
    note = lambda cond, what: F.when(cond, F.lit(what))
    notes = F.array_compact(F.array(
        note(act & F.col("_w").isNull() & (F.col("implemented_by") == ""), "bean did not resolve to a class"),
        note(act & F.col("_w").isNull() & (F.col("implemented_by") != ""), "class was not generated"),
        F.when(act & (n_out > 1), F.concat(F.lit("branches "), n_out.cast("string"), F.lit(" ways"))),
        note(~act & (F.col("kind") != "end"), "resume event is not wired")))
    return n.select("file", "process", "node", F.explode(notes).alias("note"))
