"""The ``files`` table: listing, skipping, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.rules import SKIP_DIRS
from evidex.functions.text import file_name, file_suffix

# cp1252 for 0x80-0x9F where it differs from ISO-8859-1; five bytes have none.
_HIGH = [bytes([b]) for b in range(0x80, 0xA0)]
_CP1252 = [(b.decode("latin-1"), b.decode("cp1252")) for b in _HIGH
           if b.decode("cp1252", "ignore")]
_UNDEFINED = "".join(b.decode("latin-1") for b in _HIGH if not b.decode("cp1252", "ignore"))


def describe_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``name`` and ``suffix`` of the path."""
    name = file_name(F.col(path))
    return df.withColumn("name", name).withColumn("suffix", file_suffix(F.col("name")))


def drop_skipped(df: DataFrame, skip: Sequence[str] = SKIP_DIRS, path: str = "path") -> DataFrame:
    """Keep rows whose path has no component in ``skip``."""
    parts = F.split(F.col(path), "/")
    return df.filter(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in skip])))


def scan_corpus(spark: SparkSession, root: str, skip: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """Every regular file below ``root``: path (relative), name, suffix, length, content.

    There is no cap on the number of files. Content is read only if a later step uses it. Paths
    are cut at the length of the resolved root, so a root may recur below itself.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(root)
    whole = base.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    rel = F.substring(F.col("path"), F.lit(len(whole) + 1), F.length("path"))
    return drop_skipped(describe_paths(raw.withColumn("path", rel)), skip).select(
        "path", "name", "suffix", "length", "content")


def file_tree(files: DataFrame, size: str = "length", limit: int | None = None) -> DataFrame:
    """All paths with their byte size, in order, or the first ``limit``."""
    tree = files.select("path", F.col(size).alias("bytes")).orderBy("path", "bytes")
    return tree if limit is None else tree.limit(limit)


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text``, ``encoding``, ``is_binary``, ``reason``; no row is dropped.

    A NUL anywhere means binary. Encodings are tried in the order utf-8 (BOM
    dropped), cp1252, iso-8859-1; the first always reports as utf-8-sig.
    """
    raw = F.col(content)
    binary = F.contains(raw, F.lit(b"\x00"))
    latin = F.decode(raw, "ISO-8859-1")
    odd, good = "".join(a for a, _ in _CP1252), "".join(b for _, b in _CP1252)
    utf8 = F.is_valid_utf8(raw.cast("string"))
    plain = F.regexp_replace(raw.cast("string"), "^﻿", "")
    encoding = (F.when(utf8, "utf-8-sig")
                .when(~latin.rlike(f"[{_UNDEFINED}]"), "cp1252").otherwise("iso-8859-1"))
    out = df.withColumn("is_binary", binary).withColumn(
        "encoding", F.when(~F.col("is_binary"), encoding))
    text = (F.when(F.col("encoding") == "utf-8-sig", plain)
            .when(F.col("encoding") == "cp1252", F.translate(latin, odd, good))
            .when(F.col("encoding") == "iso-8859-1", latin))
    return out.withColumn("text", text).withColumn(
        "reason", F.when(F.col("is_binary"), "not a text file"))


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_extract(url, r"^https?://([^?#]*)", 1)
