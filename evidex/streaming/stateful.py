"""Keyed state in streams: spend latched at a cap, beats of silent runs, readers that end with their run.

State is kept per run in RocksDB below the checkpoint folder, which must be shared on a cluster, so
it outlives a lost executor and may be larger than memory. The processors run in Python workers.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from evidex.functions import rules as R

# Workers get the processors with the query, whether or not they have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a processor takes at a time, and places of a run in one entry of its waiting rows.
FRAME, BLOCK = 10_000, 1_000


def started(writer: DataStreamWriter, spark: SparkSession, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query with keyed state that appends parquet to ``out``; the session keeps its own settings."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        w = writer.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"availableNow": True})).start(out)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Takes the rows of a run in the order of ``seq``, which counts from 0 without gaps.

    A row that comes early waits in a map until all before it have come; a repeated row is left
    out. The map holds BLOCK places to an entry, so a batch reads and writes an entry of a run
    once, not a row. ``step`` gives the output row of the next one and the new tally. The row
    marked as the run's last removes all state of the run.
    """

    #: Columns that wait besides seq and ends, their types, the columns given back, and whether
    #: rows may follow the last one, which a mark of the ended run then keeps out.
    held: tuple[tuple[str, str], ...] = ()
    names: tuple[str, ...] = ()
    goes_on = False

    def init(self, handle) -> None:
        self.place = handle.getValueState("place", "next bigint, waiting bigint, tally bigint")
        self.columns, self.made = ("ends", *(n for n, _ in self.held)), Row(*self.names)
        kept = "".join(f", {n} array<{t}>" for n, t in self.held)
        self.early = handle.getMapState("early", "block bigint", f"seqs array<bigint>, ends array<boolean>{kept}")

    def step(self, run, seq: int, row: tuple, tally: int) -> tuple[tuple, int]:
        raise NotImplementedError

    def _stored(self, block: int, waiting: int) -> dict[int, tuple]:
        """The rows of a block that wait, by seq."""
        entry = self.early.getValue((block,)) if waiting else None
        return dict(zip(entry[0], zip(*entry[1:], strict=True), strict=True)) if entry else {}

    def _store(self, block: int, rows: dict[int, tuple], before: int) -> int:
        """Let ``rows`` wait in place of the ``before`` rows of a block; how many more wait now."""
        if rows:
            self.early.updateValue((block,), (list(rows), *(list(c) for c in zip(*rows.values(), strict=True))))
        elif before:
            self.early.removeKey((block,))
        return len(rows) - before

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, waiting, tally = self.place.get() or (0, 0, 0)
        if at < 0:
            return
        over = False
        while not over and (frame := list(islice(rows, FRAME))):
            fresh: dict[int, dict[int, tuple]] = {}
            for row in frame:
                if row["seq"] >= at:
                    fresh.setdefault(row["seq"] // BLOCK, {})[row["seq"]] = tuple(row[c] for c in self.columns)
            more = at in fresh.get(at // BLOCK, ())  # the next row never waits
            while more:
                block = at // BLOCK
                have = self._stored(block, waiting)
                before = len(have)
                have.update(fresh.pop(block, {}))
                while at in have and not over:
                    row = have.pop(at)
                    made, tally = self.step(key[0], at, row, tally)
                    yield self.made(*made)
                    over, at = bool(row[0]), at + 1
                if over:
                    break
                waiting += self._store(block, have, before)
                more = at // BLOCK != block
            if not over:
                for block, new in fresh.items():
                    have = self._stored(block, waiting)
                    waiting += self._store(block, {**have, **new}, len(have))
        if over:
            if waiting:
                self.early.clear()
            self.place.update((-1, 0, 0)) if self.goes_on else self.place.clear()
        else:
            self.place.update((at, waiting, tally))

    def close(self) -> None:
        pass


class SpendMeter(InOrder):
    """Spend before each call in millionths, and whether it was admitted under the cap."""

    held = (("micros", "bigint"),)
    names = ("run", "seq", "spent_before", "admitted")

    def __init__(self, cap: int):
        self.cap = cap

    def step(self, run, seq, row, tally):
        return (run, seq, tally, tally < self.cap), tally + (row[1] or 0)


class Reader(InOrder):
    """The events themselves, in order, up to the run's end."""

    held = (("type", "string"), ("payload", "string"))
    names = ("run", "seq", "type", "payload", "ends")
    goes_on = True

    def step(self, run, seq, row, tally):
        return (run, seq, row[1], row[2], bool(row[0])), tally


def live_spend_meter(calls: DataFrame, cap: float, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """(run, seq, spent_before decimal(38,6), admitted) of every call, as calls arrive.

    ``calls(run, seq, usd, ends)``: seq counts the calls of a run from 0, ``ends`` marks the last. A call
    is judged in the batch in which the last of those before it arrives, so the order of arrival
    does not change the answer; from the call at which the spend has reached ``cap`` on, all are
    refused. State of a run is its place, its spend and the calls that wait, and goes at its
    end. Unpriced calls add nothing. A task holds one run's rows of one batch a frame at a time.
    """
    micros = (F.col("usd").cast("decimal(18,6)") * 1_000_000).cast("bigint")
    rows = calls.select("run", F.col("seq").cast("bigint").alias("seq"), F.coalesce("ends", F.lit(False)).alias("ends"), micros.alias("micros"))
    kind = rows.schema["run"].dataType.simpleString()
    met = rows.groupBy("run").transformWithState(
        SpendMeter(round(cap * 1_000_000)), f"run {kind}, seq bigint, spent_before bigint, admitted boolean", "Append", "None")
    spent = (F.col("spent_before").cast("decimal(38,6)") / 1_000_000).cast("decimal(38,6)")
    return started(met.withColumn("spent_before", spent).writeStream, calls.sparkSession, out, checkpoint, trigger)


def live_reader(events: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the events of each run to ``out`` in order, from the first to the end marker.

    ``events(run, seq, type, payload, ends)``; offsets are the checkpoint's, so each reader has its own.
    """
    rows = events.select("run", F.col("seq").cast("bigint").alias("seq"), F.coalesce("ends", F.lit(False)).alias("ends"), "type", "payload")
    kind = rows.schema["run"].dataType.simpleString()
    read = rows.groupBy("run").transformWithState(Reader(), f"run {kind}, seq bigint, type string, payload string, ends boolean", "Append", "None")
    return started(read.writeStream, events.sparkSession, out, checkpoint, trigger)


def follow(source, runs: DataFrame, out: str, checkpoint: str, poll: float = 1.0, give_up: float | None = None) -> bool:
    """Read the events of ``runs`` (run) until each has ended; True when all have.

    ``source()`` gives the stream of events as for ``live_reader``. A reader that starts late replays
    from the first event; one that starts again goes on from its own offsets. It returns by
    itself once the end marker of every run has been read, or after ``give_up`` seconds.
    """
    spark, until = runs.sparkSession, None if give_up is None else time.monotonic() + give_up
    wanted = runs.select("run").distinct()
    while True:
        live_reader(source().join(wanted, "run", "left_semi"), out, checkpoint).awaitTermination()
        ended = spark.read.schema(f"run {wanted.schema['run'].dataType.simpleString()}, ends boolean").parquet(out).filter("ends")
        if wanted.join(ended, "run", "left_anti").isEmpty():
            return True
        if until is not None and time.monotonic() >= until:
            return False
        time.sleep(poll)


class Beats(StatefulProcessor):
    """Silences of a run, as the watermark passes them.

    Events wait until the watermark is past them, so they are taken in order of time. A timer
    stands at the next event that waits or the next beat of silence, whichever comes first.
    After ``give_up`` of silence the run counts as gone and its state is removed.
    """

    def __init__(self, beat: int, give_up: int):
        self.beat, self.give_up = beat, give_up

    def init(self, handle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", "last bigint, beats bigint")
        self.waiting = handle.getListState("waiting", "at array<bigint>")  # those of a frame together

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = [int(x) for x in frame["at"].tolist()]
            self.waiting.appendValue((at,))
            first = min([*at, *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        at = sorted(x for (frame,) in self.waiting.get() for x in frame) if self.waiting.exists() else []
        past, ahead = [x for x in at if x <= now], [x for x in at if x > now]
        last, beats = self.said.get() if self.said.exists() else (None, 0)
        out = []
        for x in past:
            gap = 0 if last is None else x - last
            if gap >= self.give_up:
                out.append((key[0], last, None, self.give_up // self.beat))
            elif gap >= self.beat:
                out.append((key[0], last, x, gap // self.beat))
            last, beats = x, 0
        if past:
            self.waiting.put([(ahead,)]) if ahead else self.waiting.clear()
        if last is not None:
            silent = min(now - last, self.give_up)
            if silent // self.beat > beats:
                beats = silent // self.beat
                out.append((key[0], last, None, beats))
            if now - last >= self.give_up:
                self.said.clear()
            else:
                self.said.update((last, beats))
                self.handle.registerTimer(min([last + (beats + 1) * self.beat, *ahead]) // 1000 + 1)
        elif ahead:
            self.handle.registerTimer(ahead[0] // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["run", "start", "end", "beats"]).astype({"start": "Int64", "end": "Int64", "beats": "Int64"})

    def close(self) -> None:
        pass


def live_beats(events: DataFrame, out: str, checkpoint: str, beat: int = R.HEARTBEAT_SECONDS, watermark: str = "1 minute",
               give_up: int = 3600, trigger: dict | None = None) -> StreamingQuery:
    """(run, start, end, beats) while runs are silent, from events(run, ts).

    A silence of at least one ``beat`` (seconds) after ``start`` gives a row with a null end and the
    beats so far each time the watermark has passed another beat, and a last one with its end
    once the run speaks again. The watermark is that of all runs, so a run that never speaks
    again goes on beating as long as others speak, until ``give_up`` seconds; then its state is
    removed, and an event after that begins anew. ``beat`` should be over a millisecond.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.select("run", ts.alias("ts"), F.unix_micros(ts).alias("at")).withWatermark("ts", watermark)
    kind = rows.schema["run"].dataType.simpleString()
    beats = rows.groupBy("run").transformWithStateInPandas(
        Beats(beat * 1_000_000, give_up * 1_000_000), f"run {kind}, start bigint, end bigint, beats bigint", "Append", "EventTime")
    times = [F.timestamp_micros(c).alias(c) for c in ("start", "end")]
    return started(beats.select("run", *times, "beats").writeStream, events.sparkSession, out, checkpoint, trigger)
