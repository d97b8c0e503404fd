"""Live runs as Structured Streaming jobs, each with the schema of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evidex.functions import rules as R
from evidex.operators.scale import running


def event_source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Events as they arrive in a parquet table; a new reader replays from the first file.

    ``path`` is a folder of part files, as any large table is, or a single file.
    """
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(place) and not fs.getFileStatus(place).isDirectory():
        return r.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return r.parquet(path)


def live_event_stream(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append events to a table that any number of readers can follow, exactly once.

    ``trigger`` is as for a stream writer, such as {"processingTime": "5 seconds"}; by default
    what is there now is taken.
    """
    w = events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start(out)


def run_ends(events: DataFrame, end_type: str = "run_complete") -> DataFrame:
    """Per run: events so far and whether its end marker has been seen (update mode)."""
    return events.groupBy("run").agg(F.count(F.lit(1)).alias("events"),
                                     F.max((F.col("type") == end_type).cast("int")).alias("ended"))


def idle_sessions(events: DataFrame, beat: int = R.HEARTBEAT_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """Sessions (run, start, last, n) of events closer than one heartbeat, in append mode.

    A session comes out once the watermark is a heartbeat past its last event, and its state goes
    with it. The silence between two sessions of a run is a gap; see ``history.idle_gaps``, and
    ``stateful.live_beats`` for silences that still last.
    """
    windowed = events.withWatermark("ts", watermark).groupBy("run", F.session_window("ts", f"{beat} seconds"))
    return windowed.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).select(
        "run", "start", "last", "n")


#: When an end mark is set, later than any event.
END, END_MARK = "9000-01-01", "run bigint, ts timestamp"


def end_marks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of end marks: rows without a run, to be put beside the events."""
    spark.createDataFrame([], END_MARK).write.mode("append").parquet(folder)
    return spark.readStream.schema(END_MARK).parquet(folder)


def mark_end(spark: SparkSession, folder: str) -> None:
    """Say that no more events come: the next drain closes every session still open."""
    spark.createDataFrame([(None,)], "run bigint").select("run", F.lit(END).cast("timestamp").alias("ts")).write.mode("append").parquet(folder)


def spend_totals(calls: DataFrame) -> DataFrame:
    """Spend per run so far (update mode); partial sums combine before the shuffle."""
    return calls.groupBy("run").agg(F.sum(F.col("usd").cast("decimal(18,6)")).alias("spent"),
                                    F.count(F.lit(1)).alias("calls"))


def spend_log(calls: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every call (run, seq, usd, ...) once, in whatever order calls arrive; nothing is rewritten."""
    w = calls.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start(out)


def spend_meter(calls: DataFrame, cap: float) -> DataFrame:
    """Every call with its spend before it, by ``seq``, and whether it was admitted under the cap.

    ``calls`` is the log of ``spend_log``, so the answer does not depend on the batches calls
    came in. Calls of one run are summed over many tasks. ``stateful.live_spend_meter`` judges
    calls as they arrive.
    """
    amount = F.col("usd").cast("decimal(18,6)")
    rows = running(calls, ["run"], [F.col("seq")], seq="_n", value=amount, before="_b")
    before = F.col("_b").cast("decimal(38,6)")
    return rows.withColumn("spent_before", before).withColumn(
        "admitted", F.col("spent_before") < F.lit(str(cap)).cast("decimal(18,6)")).drop("_b", "_n")


def latched_at(metered: DataFrame) -> DataFrame:
    """(run, refused_from): the first refused call per run."""
    return metered.filter(~F.col("admitted")).groupBy("run").agg(F.min("seq").alias("refused_from"))


def upsert_sink(saves: DataFrame, out: str, checkpoint: str, key: str, order: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Append the latest state per id of each batch; ``history.upsert_latest`` of the folder is the table.

    Each batch has a folder of its own that a replay overwrites; earlier ones are not rewritten.
    """
    from evidex.operators.history import upsert_latest

    def step(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch, key, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = saves.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
