"""Mixing sources to target weights by pivotal rounding of copies in a reduction tree, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.scale import global_rank, settled, split_join

#: Rows of a group of the tree, and the share of a source from which a document is rounded before the tree.
FAN, GIANTS = 64, 1000
_NONE = "cast(null as struct<pos:bigint,w:double,m:double>)"
_DONE = "cast(array() as array<struct<pos:bigint,up:boolean>>)"


def shares(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, n) with ``target``: ``share`` of all sizes dealt by weight.

    Sources by code point, null last, weigh ``weights``, repeating. No target is over ``most``
    times the source's size; the excess goes to the others by weight until none is above. Each
    round sets those above to their limit and deals the rest anew; the driver sees sums only.
    """
    ranked = global_rank(sources, [F.col("source").isNull(), F.asc("source")])
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = settled(ranked.select(*sources.columns, listed[F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")].alias("weight"),
                                 (F.lit(float(most)) * F.col("source_size")).alias("limit")), "sources")
    wanted = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        above = F.col("limit") <= F.lit(level) * F.col("weight")
        used, free = rows.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        after = (wanted - (used or 0.0)) / free
        if after <= level:
            break
        level = after
    return rows.withColumn("target", F.least(F.col("limit"), F.lit(level) * F.col("weight")))


def _uniform(seed: int, level: int, a: str, b: str) -> str:
    """A number from 0 to 1 that hangs on the seed, the level and the two places."""
    return f"shiftrightunsigned(xxhash64({seed}L, {level}, {a}, {b}), 11) / 9007199254740992D"


def _pivot(seed: int, level: int, members: str) -> Column:
    """Fold ``members`` (pos, w, m) into (o, done): the one still open, if any, and the decided.

    A member takes its size w with mass m, 0 < m < w. The open one and the next pair up: either
    the open one gains a mass of a and the next loses it, or the open one loses b to the next,
    whichever amount makes one of them 0 or whole; the first with probability b / (a + b), so that
    every expected mass, and at each step the sum of masses, is as before.
    """
    return F.expr(f"""
aggregate({members}, named_struct('o', {_NONE}, 'done', {_DONE}),
  (s, x) -> if(s.o is null, named_struct('o', x, 'done', s.done),
    transform(array(named_struct('a', least(s.o.w - s.o.m, x.m), 'b', least(s.o.m, x.w - x.m), 'u', {_uniform(seed, level, "s.o.pos", "x.pos")})),
    t -> transform(array(t.u * (t.a + t.b) < t.b),
    up -> transform(array(named_struct(
        'first', if(up, s.o.w - s.o.m <= x.m, s.o.m <= x.w - x.m),
        'second', if(up, x.m <= s.o.w - s.o.m, x.w - x.m <= s.o.m))),
    f -> named_struct(
        'o', case when f.first and f.second then {_NONE}
                  when f.first then named_struct('pos', x.pos, 'w', x.w, 'm', if(up, x.m - t.a, x.m + t.b))
                  else named_struct('pos', s.o.pos, 'w', s.o.w, 'm', if(up, s.o.m + t.a, s.o.m - t.b)) end,
        'done', concat(s.done, if(f.first, array(named_struct('pos', s.o.pos, 'up', up)), {_DONE}),
                               if(f.second, array(named_struct('pos', x.pos, 'up', not up)), {_DONE})))
    )[0])[0])[0]))""")


def _folded(rows: DataFrame, keys: Sequence[str | Column], seed: int, level: int, name: str) -> DataFrame:
    """(keys, members, o, done) per group of ``rows`` (pos, w, m), larger members first, as a written table."""
    largest = F.sort_array(F.collect_list(F.struct(F.col("w").alias("by"), (-F.col("pos")).alias("back"), "pos", "w", "m")), asc=False)
    members = F.transform(largest, lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"), x["m"].alias("m")))
    made = rows.groupBy(*keys).agg(members.alias("members")).withColumn("fold", _pivot(seed, level, "members"))
    return settled(made.select(*[c for c in made.columns if c != "fold"], "fold.o", "fold.done"), name)


def _decided(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("done").alias("d")).select("d.pos", "d.up")


def _giants(rows: DataFrame, sources: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Round the documents with over a thousandth of their source, fewer than a thousand of each:
    (pos, up) of them, and (key, part) with the share of a copy that is left for every other one.

    Largest first, each pairs up with all smaller ones of its source at once, as one member of
    their size, so that what it gains or loses is spread over them. Where they cannot take it
    all, the document goes to the nearer whole number.
    """
    largest = F.sort_array(F.collect_list(F.struct("w", "pos")), asc=False)
    made = rows.groupBy("key").agg(largest.alias("members")).join(sources.select("key", "source_size", "part"), "key")
    fold = F.expr(f"""
aggregate(members, named_struct('w', cast(source_size as double), 'part', part, 'done', {_DONE}),
  (s, x) -> transform(array(named_struct('w', s.w - x.w, 'm', (s.w - x.w) * s.part, 'xm', x.w * s.part)),
    p -> transform(array(named_struct('a', least(x.w - p.xm, p.m), 'b', least(p.xm, p.w - p.m), 'u', {_uniform(seed, -1, "x.pos", "0L")})),
    t -> transform(array(t.u * (t.a + t.b) < t.b),
    up -> named_struct(
        'w', p.w, 'part', if(p.w > 0, least(greatest(if(up, p.m - t.a, p.m + t.b) / p.w, 0D), 1D), s.part),
        'done', concat(s.done, array(named_struct('pos', x.pos, 'up',
            if(if(up, x.w - p.xm <= p.m, p.xm <= p.w - p.m), up, 2 * if(up, p.xm + t.a, p.xm - t.b) > x.w)))))
    )[0])[0])[0])""")
    folded = settled(made.select("key", fold.alias("fold")), "giants")
    return _decided(folded.select("fold.done")), folded.select("key", "fold.part")


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3, seed: int = 1, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole copies of each document so that each source's words come near its target:
    (doc_id, source, size, source_size, target, copies, taken), a row per row of ``docs``.

    size counts words, runs of anything but blank, tab and the four line ends; null texts have
    none. ``shares`` sets the targets. A document of a source gets target / source_size copies in
    expectation, at most ``most``, rounded up or down. The fractions are rounded together: what
    is taken from a source differs from its target by at most half a document, one of its smaller
    ones unless a few make up the source. Null sources are one
    source; rows with a null or repeated id count each; documents without words are never
    taken; an empty table gives no rows; other columns are not read. The draw hangs on ids,
    sizes, texts and the seed, not on partitions: reruns agree, and of wholly equal rows it does
    not matter which one is taken.

    Rows are numbered by a range sort over source and a hash. The tree folds 64 neighbours of a
    source in one row, its open ones 64 at a time again, until one is left of each source and
    goes to the nearer whole number: no group holds more than that, but for the fewer than a
    thousand largest of a source, and each level is a written table a 64th of the last.
    """
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source))
    read = settled(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), source.alias("source"), key.alias("key"), F.xxhash64(text_col).alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size")), "sizes")
    sources = read.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    sources = shares(sources, weights, share, most).select("*", copies.alias("each")).select(
        "key", "source_size", "target", F.floor("each").cast("bigint").alias("whole"), (F.col("each") - F.floor("each")).alias("part"))
    sources = settled(sources, "shares")
    rows = split_join(read, sources, "key")
    rows = global_rank(rows, [F.col("source").isNull(), F.asc("source"), F.xxhash64(F.lit(seed), "doc_id"), F.asc("doc_id"), F.asc("size"), F.asc("h")], "pos")
    large = F.col("size") * GIANTS > F.col("source_size")
    fraction = (F.col("part") > 0) & (F.col("size") > 0)
    member = lambda part: ("key", "pos", F.col("size").cast("double").alias("w"), (F.col("size") * part).alias("m"))
    ups, parts = _giants(rows.filter(fraction & large).select("key", "pos", F.col("size").cast("double").alias("w")), sources, seed)
    parts = parts.withColumnRenamed("part", "left")
    small = rows.filter(fraction & ~large).select("key", "pos", "size", "part")
    small = split_join(small, parts, "key").select(*member(F.coalesce("left", "part")))
    small = settled(small, "members")
    leaf = small.filter("m > 0 and m < w")
    whole = small.filter("m >= w").select("pos", F.lit(True).alias("up"))
    level, top = 0, (rows.agg(F.max("pos")).first()[0] or 0)
    decided, span, now = [ups, whole], FAN, leaf
    while True:
        folded = _folded(now, ["key", F.expr(f"pos div {span}L").alias("g")], seed, level, "level")
        decided.append(_decided(folded))
        now = folded.filter("o is not null").select("key", "o.pos", "o.w", "o.m")
        if span > top:
            break
        level, span = level + 1, span * FAN
    decided.append(now.select("pos", (2 * F.col("m") > F.col("w")).alias("up")))
    up = reduce(DataFrame.unionByName, decided).filter("up")
    out = rows.join(up, "pos", "left")
    taken = F.col("whole") + F.when(F.col("up"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("copies"), (taken * F.col("size")).cast("bigint").alias("taken"))
