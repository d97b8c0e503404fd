"""Writers: CSV per object, event log, immutable snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators.scale import in_files

def write_object_csv(records: DataFrame, headers: DataFrame, out: str) -> None:
    """One CSV folder per object, each row with the object's headers in first-seen order.

    ``records(object, row_no, header, value)``, ``headers(object, header, ord)``. One job for
    all objects: a row gathers its own cells, puts them in the order of its object's header list
    and is written as a line under ``object=...``; every file starts with its header line. Rows
    are in the order of ``row_no`` within a file and from file to file by name. Of several values
    of one header in a row the last by ``pos`` counts, where records have that column, else the
    last by value. Cells are quoted where CSV needs it.
    """
    place = F.col("pos") if "pos" in records.columns else F.lit(None).cast("bigint")
    lists = headers.groupBy("object").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "header"))), lambda h: h["header"]).alias("names"))
    rows = records.groupBy("object", "row_no").agg(F.collect_list(F.struct("header", place.alias("pos"), "value")).alias("cells"))
    given = F.map_from_entries(F.transform(F.array_distinct(F.transform("cells", lambda c: c["header"])), lambda h: F.struct(
        h.alias("key"), F.array_max(F.transform(F.filter("cells", lambda c: c["header"] == h), lambda c: F.struct(
            c["pos"].alias("pos"), c["value"].alias("value"))))["value"].alias("value"))))
    wide = rows.withColumn("given", given).join(lists, "object")

    def quoted(v: Column) -> Column:
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    line = F.array_join(F.transform("names", lambda n: quoted(F.coalesce(F.try_element_at("given", n), F.lit("")))), ",")
    head = F.array_join(F.transform("names", quoted), ",")
    _write_lines(wide.select("object", "row_no", line.alias("value"), head.alias("head")), out)


def _write_lines(body: DataFrame, out: str) -> None:
    """Write (object, row_no, value, head) as text below ``object=``, the header first in each file.

    Rows are sorted by range over object and row, so a large object is many files, each a part of
    its rows in order, and no task holds it whole.
    """
    rows = in_files(body, [F.col("object"), F.col("row_no")])
    rows = rows.select("object", F.col("_part").alias("part"), F.col("_row").alias("ord"), "value", "head")
    heads = rows.select("object", "part", "head").distinct().select("object", "part", F.lit(-1).cast("bigint").alias("ord"), F.col("head").alias("value"))
    n = int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.drop("head").unionByName(heads).repartition(n, "object", "part").sortWithinPartitions("object", "part", "ord")
    rows.select("object", "part", "value").write.mode("overwrite").partitionBy("object", "part").text(out)


def read_object_csv(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of one object as written by ``write_object_csv``."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("quote", '"').option("escape", '"').option(
        "multiLine", True).csv(f"{out}/object={name}")


def append_events(events: DataFrame, path: str) -> None:
    """Append run events; readers take the tail or the latest row per run."""
    events.write.mode("append").parquet(path)


def snapshot_id(millis: Column, clash: Column | None = None) -> Column:
    """Hex of the time in ms, which sorts by time, plus a suffix on a clash."""
    base = F.lower(F.lpad(F.hex(millis), 12, "0"))
    if clash is None:
        return base
    return F.when(clash > 0, F.concat(base, F.lit("-"), clash.cast("string"))).otherwise(base)


def read_snapshots(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All whole snapshots of a table: those whose manifest, written last, is there. A corrupt file
    does not hide the intact ones."""
    read = lambda name: spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(f"{path}/{name}")
    return read(table).join(read("manifest").select("snapshot_id").distinct(), "snapshot_id", "left_semi")


def _claim(spark: SparkSession, path: str, base: str) -> str:
    """Take the first free id of ``base``, ``base-1``, ... by creating its claim file, which only one writer can."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    n = 0
    while True:
        sid = base if n == 0 else f"{base}-{n}"
        place = jvm.Path(f"{path}/claims/{sid}")
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.createNewFile(place):
            return sid
        n += 1


def write_snapshot(tables: dict[str, DataFrame], path: str, millis: int, name: str = "",
                   phase: str = "", note: str = "") -> str:
    """Append one immutable snapshot of the tables under a fresh id; never overwrites.

    The id is claimed first and the manifest written last, so two writers of one millisecond get
    two ids and a snapshot that was cut off is not read.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    sid = _claim(spark, path, f"{millis:012x}")
    for table, df in tables.items():
        df.withColumn("snapshot_id", F.lit(sid)).write.mode("append").partitionBy(
            "snapshot_id").parquet(f"{path}/{table}")
    manifest = spark.range(1).select(
        F.lit(sid).alias("snapshot_id"), F.lit(name).alias("name"), F.lit(phase).alias("phase"),
        F.lit(note).alias("note"), F.lit(millis).cast("bigint").alias("at"))
    manifest.write.mode("append").partitionBy("snapshot_id").parquet(f"{path}/manifest")
    return sid
