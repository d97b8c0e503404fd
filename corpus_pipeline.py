"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, personal data, packing.

Each stage takes the documents that the one before kept, read back from Parquet; ``run``
applies all of them. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm import digests, jaccard, langid, packing, pii
from evidex.llm.ship import ship
from evidex.operators.scale import settled
from evidex.session import scratch

#: Rows that a join with texts broadcasts at most; beyond that both sides are shuffled.
BROADCAST_ROWS = 200_000
#: No SQL can express the learned stages; tests hold run() against brute force.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it as long as ``docs`` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _counted(rows: DataFrame) -> DataFrame:
    """``rows``, written, and broadcast where their number is counted to be small: then no text is shuffled."""
    rows = settled(rows, "few")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without any letter, which have no language, and those of 32 letters
    or more whose cosine is below ``langid.floor``, set by the labelled rows of the held-out fold.

    Where nothing was learned, every document with a letter stays.
    """
    ship(spark)
    learned = langid.fit(docs.filter(~langid.held_out()))
    if not learned:
        return docs.filter(langid.letters() > 0)
    least = langid.floor(docs.filter(langid.held_out()), learned)
    lang, score = _fresh(docs, "_lang"), _fresh(docs, "_score")
    found = langid.annotate(docs, learned, names=(lang, score)).filter(F.col(lang) != "und")
    return found.filter((F.col(score) >= least) | (langid.letters() < langid.LETTERS)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lowered) the one with the largest id stays, one row of it.

    Decided per row: different texts under one id, or without an id, all stay. Of several rows of
    one id and one text the one that sorts first stays. Only pairs of id and digest that lose a
    row meet the texts again, and only rows of a pair that occurs more than once are grouped.
    """
    ship(spark)
    index = digests.DigestIndex(spark)
    found = index.dedup_all(docs)
    index.drop()
    # concat_ws leaves out a null id, so the pair of such a row is its digest alone.
    name, row = _fresh(docs, "_pair"), _fresh(docs, "_row")
    pair = lambda sha: F.concat_ws(":", F.col("doc_id").cast("bigint").cast("string"), sha).alias(name)
    pairs = found.groupBy(pair(F.col("text_sha256"))).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1")
    pairs = settled(pairs, "pairs")
    rows = docs.withColumn(name, pair(digests.digest(F.col("text"))))
    once = rows.join(_counted(pairs.select(name)), name, "left_anti").select(*docs.columns)
    many = rows.join(_counted(pairs.filter("kept").select(name)), name, "left_semi").groupBy(name).agg(F.min(F.struct(*docs.columns)).alias(row))
    return once.unionByName(many.select(f"{row}.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of three quarters the one with the smallest id stays.

    Decided per row: texts under one id are classed apart, and rows without an id always stay.
    """
    ship(spark)
    t = _fresh(docs, "_t")
    dropped = jaccard.classed(docs).filter("component_id <> doc_id").select("doc_id", F.col("t").alias(t)).distinct()
    return docs.withColumn(t, F.xxhash64("text")).join(_counted(dropped), ["doc_id", t], "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by [EMAIL], [IP], [CARD] and [PHONE]; n_chars follows the text."""
    ship(spark)
    model = pii.trained(spark)
    return pii.replace(docs, model).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of what is left, with the ids of each piece."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each writes below the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
