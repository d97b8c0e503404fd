"""Run events and run history, as batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import rules as R
from evidex.operators.scale import global_rank, running, split_join


def event_sequence(events: DataFrame, run: str = "run", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Add seq (0-based per run) and elapsed seconds since the run's first event.

    A run with most of the events, even on one day, is spread by count.
    """
    out = running(events, [run], [F.col(ts), F.col(tie)])
    start = events.groupBy(run).agg(F.min(ts).alias("_t0"))
    secs = F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col(ts)) / F.lit(1e6)
    return split_join(out, start, run, "inner").withColumn("elapsed", F.bround(secs, 2)).drop("_t0")


def latest_result(events: DataFrame, end_type: str = "run_complete", run: str = "run", ts: str = "ts",
                  tie: str = "event_id") -> DataFrame:
    """(run, result, event_count): payload of the last end event per run, by map-side maxima."""
    done = F.col("type") == end_type
    return events.groupBy(run).agg(
        F.max_by(F.when(done, F.col("payload")), F.when(done, F.struct(ts, tie))).alias("result"),
        F.count(F.lit(1)).alias("event_count"))


def upsert_latest(saves: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last saved state per id wins."""
    rest = [c for c in saves.columns if c != key]
    top = saves.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return top.select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def history_page(runs: DataFrame, limit: int, owner=None, tie: str = "run") -> DataFrame:
    """Newest first, one owner or all.

    The status column overrides the stored summary; its error column fills a missing one.
    """
    src = runs if owner is None else runs.filter(F.col("owner") == owner)
    page = src.withColumn("status", F.coalesce("status", "summary_status")).withColumn(
        "error", F.coalesce(F.nullif("summary_error", F.lit("")), F.col("error")))
    return page.orderBy(F.desc("started"), F.desc(tie)).limit(limit).drop("summary_status", "summary_error")


def tail_events(events: DataFrame, n: int = R.EVENT_TAIL, run: str = "run", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest n events per run, counted from the newest back."""
    out = running(events, [run], [F.desc(ts), F.desc(tie)], seq="_back")
    return out.filter(F.col("_back") < n).drop("_back")


def mark_interrupted(runs: DataFrame, now: Column) -> DataFrame:
    """Queued or running rows become interrupted; an existing error is kept."""
    live = F.col("status").isin("queued", "running")
    return runs.withColumn("error", F.when(live, F.coalesce("error", F.lit(R.INTERRUPTED_ERROR)))
                           .otherwise(F.col("error"))).withColumn(
        "finished", F.when(live, now).otherwise(F.col("finished"))).withColumn("changed", live).withColumn(
        "status", F.when(live, "interrupted").otherwise(F.col("status")))


def live_and_history(live: DataFrame, stored: DataFrame, key: str = "run") -> DataFrame:
    """Live runs, then stored runs that are not live; ``part`` 0 sorts the live ones first."""
    rest = stored.join(live.select(key), key, "left_anti")
    return live.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1)))


def queue_position(runs: DataFrame, arrival: list[str], pending: str = "queued", run: str = "run") -> DataFrame:
    """(run, position): 1-based among pending by arrival, 0 otherwise."""
    waiting = global_rank(runs.filter(F.col("status") == pending).select(run, *[c for c in arrival if c != run]),
                          [F.col(c) for c in arrival], "position")
    out = runs.select(run).join(waiting.select(run, "position"), run, "left")
    return out.select(run, F.coalesce("position", F.lit(0)).cast("bigint").alias("position"))


def queue_summary(runs: DataFrame, capacity: int) -> DataFrame:
    return runs.agg(F.count_if(F.col("status") == "running").alias("active"),
                    F.count_if(F.col("status") == "queued").alias("waiting"),
                    F.lit(capacity).cast("bigint").alias("capacity"))


def idle_gaps(events: DataFrame, beat: int = R.HEARTBEAT_SECONDS, slot: str = "day", run: str = "run",
              ts: str = "ts") -> DataFrame:
    """gaps(run, start, end, beats): silences of at least one heartbeat between events.

    Within a slot the previous event is a lag; the first event of a slot takes the last of
    the slot before, from a table with one row per (run, slot).
    """
    e = events.select(run, F.col(ts).alias("end"), F.date_trunc(slot, F.col(ts)).alias("_slot"))
    near = Window.partitionBy(run, "_slot").orderBy("end")
    e = e.withColumn("_prev", F.lag("end").over(near))
    last = e.groupBy(run, "_slot").agg(F.max("end").alias("_last"))
    far = Window.partitionBy(run).orderBy("_slot")
    last = last.select(run, "_slot", F.lag("_last").over(far).alias("_before"))
    e = e.join(last, [run, "_slot"]).withColumn("start", F.coalesce("_prev", "_before"))
    beats = F.floor(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) / (beat * 1_000_000))
    return e.select(run, "start", "end", beats.cast("bigint").alias("beats")).filter("beats >= 1")


def tenant_filter(runs: DataFrame, caller=None, owner: str = "owner") -> DataFrame:
    """Own or unowned rows; without a caller all rows. The filter reaches the scan."""
    if caller is None:
        return runs
    return runs.filter(F.col(owner).isNull() | (F.col(owner) == caller))
