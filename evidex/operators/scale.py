"""Building blocks that keep hot keys from landing in one task.

* ``global_rank`` numbers a whole table without a single-partition window.
* ``running`` gives per-key positions and prefix sums over runs of neighbouring rows, so that one
  key may hold any share of the rows.
* ``digest`` identifies a set of rows of any size with constant state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import scratch


def settled(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it back.

    It is computed once however many branches read it, its lineage is cut, and a lost
    executor costs a re-read. Used for rounds of iterative jobs and for shared inputs.
    ``options`` are those of the writer.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_files(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` sorted by range and written once, with the file of each row (``_part``, in order) and its index there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "rank")
    df.orderBy(*order).write.parquet(path)
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    part = F.concat_ws("-", *[F.lpad(F.regexp_extract(file, p, 1), 10, "0")
                              for p in (r"^part-(\d+)", r"-c(\d+)\.")])
    return spark.read.schema(df.schema).parquet(path).select("*", part.alias("_part"), row.alias("_row"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in ``order`` (which must be total).

    The range-sorted rows are written once, which fixes the partitions; the rank of a row is
    its index in its file plus the rows of the files before. The offset table has one row per
    file, so broadcasting it is bounded by the number of partitions, not by the data.
    """
    rows = in_files(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = rows.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.col("_off") + F.col("_row") + 1).cast("bigint").alias(name))


def sorted_neighbour(asked: DataFrame, held: DataFrame, key: str, after: bool = True, name: str = "found",
                     chunk: int = 50_000) -> DataFrame:
    """``asked`` with the first ``key`` of ``held`` that is at or after its own, or the last at or before it.

    Both tables are sorted together by range, once, so a row is sent once whatever it meets. The
    neighbour is sought among ``chunk`` rows next to each other; where it lies beyond them it is the
    first, or last, of a table with one row per chunk. Null keys of ``asked`` have none.
    """
    none, value = F.lit(None).cast(asked.schema[key].dataType), F.col(key)
    rows = asked.withColumn("_held", none).withColumn("_ask", F.lit(True)).unionByName(
        held.filter(value.isNotNull()).select(value, value.alias("_held"), F.lit(False).alias("_ask")), allowMissingColumns=True)
    turn = F.desc("_ask") if after else F.asc("_ask")
    ranked = global_rank(rows, [F.asc_nulls_last(key), turn], "_rank").withColumn("_chunk", F.floor((F.col("_rank") - 1) / chunk))
    own = Window.partitionBy("_chunk").orderBy("_rank")
    far = Window.orderBy("_chunk")
    if after:
        own, far = own.rowsBetween(0, Window.unboundedFollowing), far.rowsBetween(1, Window.unboundedFollowing)
        near, edge, pick = F.first("_held", ignorenulls=True), F.min_by("_held", F.when(~F.col("_ask"), F.col("_rank"))), F.first
    else:
        own, far = own.rowsBetween(Window.unboundedPreceding, 0), far.rowsBetween(Window.unboundedPreceding, -1)
        near, edge, pick = F.last("_held", ignorenulls=True), F.max_by("_held", F.when(~F.col("_ask"), F.col("_rank"))), F.last
    edges = ranked.groupBy("_chunk").agg(edge.alias("_edge"))
    edges = edges.select("_chunk", pick("_edge", ignorenulls=True).over(far).alias("_far"))
    out = ranked.withColumn("_near", near.over(own)).filter("_ask").join(edges, "_chunk")
    return out.select(*asked.columns, F.when(value.isNotNull(), F.coalesce("_near", "_far")).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input has fewer splits than cores; large inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


#: Neighbouring rows that one window takes.
CHUNK = 100_000


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], seq: str = "seq", value: Column | None = None,
            before: str = "before", chunk: int = CHUNK) -> DataFrame:
    """0-based position and, with ``value``, the exclusive prefix sum, per key in ``order`` (which must be total).

    Rows are sorted by range over key and order, so a key with most of the rows is spread by count,
    however they lie in time. Windows run over the rows of a key among ``chunk`` neighbours. Only
    the first key of a chunk has rows before it, in chunks whose last key it is: their totals,
    one row per chunk, are summed in order and joined by chunk. Nulls in ``value`` count as zero.
    """
    keys = list(keys)
    ident = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("k"))
    base = df.withColumn("_amt", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0))
    rows = in_files(base, [*[F.asc(k) for k in keys], *order])
    rows = rows.withColumn("_chunk", F.struct("_part", F.floor(F.col("_row") / chunk).alias("_n")))
    near = Window.partitionBy(*keys, "_chunk").orderBy("_row")
    inner = rows.withColumn("_pos", F.row_number().over(near) - 1)
    if value is not None:
        inner = inner.withColumn("_sum", F.coalesce(F.sum("_amt").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = rows.groupBy(ident.alias("_k"), "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.sum("_amt").alias("_s"), F.min("_row").alias("_at"))
    edges = settled(parts.groupBy("_chunk").agg(F.min_by("_k", "_at").alias("_first"), F.max_by(F.struct("_k", "_n", "_s"), "_at").alias("_last")), "chunks")
    none = F.lit(None)
    marks = edges.select(F.col("_first").alias("_k"), "_chunk", F.lit(0).alias("_t"), none.cast(edges.select("_last._n").dtypes[0][1]).alias("_n"),
                         none.cast(edges.select("_last._s").dtypes[0][1]).alias("_s")).unionByName(
        edges.select("_last._k", "_chunk", F.lit(1).alias("_t"), "_last._n", "_last._s"))
    past = Window.partitionBy("_k").orderBy("_chunk", "_t").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(F.col("_k").alias("_first"), "_chunk", "_t", F.sum("_n").over(past).alias("_cnt0"), F.sum("_s").over(past).alias("_amt0"))
    out = inner.join(carried.filter("_t = 0 and _cnt0 is not null").drop("_t"), "_chunk", "left")
    own = ident.eqNullSafe(F.col("_first"))
    out = out.withColumn(seq, (F.col("_pos") + F.when(own, F.col("_cnt0")).otherwise(0)).cast("bigint"))
    made = [seq]
    if value is not None:
        out = out.withColumn(before, F.col("_sum") + F.when(own, F.col("_amt0")).otherwise(F.lit(0)))
        made.append(before)
    return out.select(*[c for c in df.columns if c not in made], *made)


HOT_SHARE, SALTS = 10_000, 32
#: Rows a key has at least before its copies pay; below that, all keys of a small table would be hot.
HOT_ROWS = 500


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _hot) of keys with more than 1/10,000 of the rows, and 500: at most 10,000 of them."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter((F.col("_n") * HOT_SHARE > total) & (F.col("_n") > HOT_ROWS) & F.col(key).isNotNull()).select(
        key, F.lit(True).alias("_hot"))


def split_join(big: DataFrame, small: DataFrame, key: str, how: str = "left",
               keys: DataFrame | None = None) -> DataFrame:
    """Join where a key of ``big`` may hold a third of the rows and an aggregate by it follows.

    Rows of hot keys are dealt over 32 salts by a hash of their content and meet 32 copies of
    the matching row of ``small``; other keys join as they are. The table of hot keys has at
    most 10,000 rows, so it is broadcast. ``keys`` gives the key column alone where that is
    cheaper to count than ``big``. ``how`` is left or inner.
    """
    hot = F.broadcast(hot_keys((big if keys is None else keys).select(key), key))
    content = [c for c, kind in big.dtypes if "map<" not in kind]  # maps have no hash
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*content), F.lit(SALTS))).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    right = small.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def dealt_key(df: DataFrame, key: str | Column) -> Column:
    """``key`` for a left join that blank keys cannot match: null and '' are dealt over 1,024 values."""
    c = F.col(key) if isinstance(key, str) else key
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(1024)).cast("string")
    return F.when(c.isNull() | (c == ""), F.concat(F.lit("\u0000"), salt)).otherwise(c)


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Projections on top of each other are merged, which repeats a costly expression at every
    use, and inside lambdas per element. A one-row generator keeps them apart.
    """
    one = F.struct(*[c.alias(n) for n, c in cols.items()])
    keep = [c for c in df.columns if c not in cols]
    made = df.select(*keep, F.explode(F.array(one)).alias("_made"))
    return made.select(*keep, *[F.col(f"_made.{n}").alias(n) for n in cols])


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row aggregates, without a join."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


DIGEST_WORDS = 5


def digest_words(text_hash: Column, prefix: str = "_w") -> list[Column]:
    """Order-free sums of five 24-bit words of an md5; state per group is constant.

    A 64-bit sum of 24-bit words holds for half a trillion rows per group.
    """
    return [
        F.sum(F.conv(F.substring(text_hash, 1 + 6 * i, 6), 16, 10).cast("bigint")).alias(f"{prefix}{i}")
        for i in range(DIGEST_WORDS)
    ]


def digest_of(count: Column, prefix: str = "_w") -> Column:
    """Fold the sums of ``digest_words`` and the row count into one md5."""
    words = [F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).cast("string") for i in range(DIGEST_WORDS)]
    return F.md5(F.concat_ws(":", count.cast("string"), *words))


def set_digest(df: DataFrame, keys: Sequence[str], item: Column, name: str = "digest",
               count: str = "n") -> DataFrame:
    """Digest of the multiset of ``item`` strings per key; equal sets give equal digests.

    Sums combine map-side, so a key with a third of all rows costs no more than the rest.
    """
    grouped = df.withColumn("_h", F.md5(item)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), *digest_words(F.col("_h")))
    return grouped.select(*keys, count, digest_of(F.col(count)).alias(name))
