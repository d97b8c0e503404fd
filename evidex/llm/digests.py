"""Exact dedup by a persistent digest index: bucketed and sorted by digest, anti-joined and appended."""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators.scale import settled, split_join

BUCKETS = 64


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with A-Z lowered; null counts as empty."""
    return F.sha2(F.encode(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), "UTF-8"), 256)


class DigestIndex:
    """A table (text_sha256, keep_id) in ``buckets`` buckets by digest, each file sorted by it.

    The table is in the session's warehouse, or at ``path``, where a later session opens it
    again under the same bucket count. A join on the digest reads it without a shuffle or sort
    of its own. Appends add a sorted file to each bucket.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        where = f" LOCATION '{path}'" if path else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (text_sha256 STRING, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS{where}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Remove the table; results of ``dedup`` do not read it any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, rows: DataFrame) -> None:
        """Add (text_sha256, keep_id) rows whose digests are new; one writer at a time."""
        (rows.select("text_sha256", "keep_id").repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256")
         .write.insertInto(self.name))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Match new documents with the index and among themselves, append what is new, and return
        (doc_id, keep_id, group_size, kept, text_sha256), a row per document.

        keep_id is the index's id where the digest was there before, else the largest id of
        the new documents with that digest; group_size counts the new documents only. kept is
        true for one row with that id of a digest not seen before. Null text counts as empty;
        rows with a null id never stay unless all rows of the digest have none; of repeated
        rows one stays. Other columns are not read; an empty table adds nothing.

        Only digests are shuffled, never texts; groups are counted before the shuffle, and the
        rows of a hot group meet its entry in salted parts.
        """
        return self._dedup(self._digests(docs, id_col, text_col))

    def dedup_all(self, docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``dedup`` of all documents at once, fed to the index batch by batch: of each digest that was
        not there before the row with the largest id stays, and group_size counts all of ``docs``.

        Batches are ranges of ids, the largest first and null ids last, so that what a later batch
        finds in the index has a larger id than its own.
        """
        new = self._digests(docs, id_col, text_col)
        share = [1 - k / batches for k in range(1, batches)]
        cuts = new.agg(F.percentile_approx("doc_id", share, 1000)).first()[0] or [] if share else []
        above, done = F.lit(False), []
        for cut in [*sorted(set(cuts), reverse=True), None]:
            here = F.lit(True) if cut is None else F.coalesce(F.col("doc_id") >= cut, F.lit(False))
            done.append(settled(self._dedup(new.filter(here & ~above)), "batch"))
            above = here
        rows = reduce(DataFrame.unionByName, done).drop("group_size")
        sizes = rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
        return split_join(rows, sizes, "text_sha256").select(
            "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "kept", "text_sha256")

    @staticmethod
    def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return settled(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
                       .withColumn("place", F.monotonically_increasing_id()), "digests")

    def _dedup(self, new: DataFrame) -> DataFrame:
        groups = settled(new.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "place")).alias("top"), F.count(F.lit(1)).alias("group_size")), "groups")
        fresh = groups.hint("merge").join(self.rows().hint("merge"), "text_sha256", "left_anti")
        fresh = settled(fresh.select("text_sha256", F.col("top.doc_id").alias("keep_id"), "top", "group_size"), "fresh")
        repeated = groups.join(fresh.select("text_sha256", F.lit(True).alias("is_new")), "text_sha256", "left").filter(
            "group_size > 1 or is_new is null").select("text_sha256", "top", "group_size", "is_new")
        old = self.rows().groupBy("text_sha256").agg(F.max("keep_id").alias("old_id"))
        repeated = settled(repeated.join(old, "text_sha256", "left"), "repeated")
        self.append(fresh)
        rows = split_join(new, repeated, "text_sha256")
        known = F.col("group_size").isNotNull()
        first = F.coalesce(F.col("is_new"), ~known)
        return rows.select(
            "doc_id", F.when(known & ~first, F.col("old_id")).when(known, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            (first & (~known | (F.col("top.place") == F.col("place")))).alias("kept"), "text_sha256")
