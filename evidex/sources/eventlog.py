"""An event log that stays bounded: appended folders, merged level by level, behind a versioned manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions import rules as R

#: Folders of a level that are merged into one of the next.
FAN = 4


class EventLog:
    """The newest ``keep`` events of each run, the latest save of each event, below ``path``.

    Data folders are written once and never changed. A version of the log is a small file that
    lists them with their levels; it is claimed by number, written beside and renamed into place,
    so a reader sees one whole version or the one before. One writer at a time: a second one,
    or one after a writer that died, finds the number claimed and raises; ``recover`` frees it.
    Any number of readers may read while events are appended, merged or removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = R.EVENT_TAIL, fan: int = FAN,
                 run: str = "run", event: str = "event_id", ts: str = "ts"):
        self.spark, self.path, self.keep, self.fan = spark, path.rstrip("/"), keep, fan
        self.run, self.event, self.ts = run, event, ts
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._paths.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    # ── versions ──────────────────────────────────────────────────────────────

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names("versions") if n.startswith("v"))

    def folders(self, version: int | None = None) -> list[tuple[int, str]]:
        """(level, folder) of a version, by default the newest; none before the first append."""
        if version is None:
            known = self.versions()
            if not known:
                return []
            version = known[-1]
        text = self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        stream = self._fs.open(self._place(f"versions/v{version:012d}"))
        try:
            lines = bytes(text.readFullyToByteArray(stream)).decode().split("\n")
        finally:
            stream.close()
        return [(int(level), name) for level, name in (x.split("\t") for x in lines if x)]

    def _commit(self, base: int, entries: list[tuple[int, str]]) -> int:
        number = base + 1
        if not self._fs.createNewFile(self._place(f"claims/v{number:012d}")):
            raise RuntimeError(f"version {number} is claimed by another writer")
        beside = self._place(f"claims/.{uuid.uuid4().hex}")
        stream = self._fs.create(beside, False)
        stream.write(bytearray("\n".join(f"{level}\t{name}" for level, name in entries).encode()))
        stream.close()
        self._fs.mkdirs(self._place("versions"))
        if not self._fs.rename(beside, self._place(f"versions/v{number:012d}")):
            raise RuntimeError(f"version {number} was not put in place")
        return number

    def recover(self) -> None:
        """Free the numbers that writers claimed and never put in place; only while none is at work."""
        known = set(self.versions())
        for name in self._names("claims"):
            if name.startswith(".") or int(name[1:]) not in known:
                self._fs.delete(self._place(f"claims/{name}"), False)

    # ── rows ──────────────────────────────────────────────────────────────────

    def _base(self) -> int:
        known = self.versions()
        return known[-1] if known else 0

    def append(self, events: DataFrame, merge: bool = True) -> int:
        """Save events as one folder of a new version; with ``merge``, levels that are full go up."""
        base = self._base()
        name = f"data/{uuid.uuid4().hex}"
        events.withColumn("_save", F.lit(base + 1).cast("bigint")).write.parquet(f"{self.path}/{name}")
        number = self._commit(base, [*(self.folders(base) if base else []), (0, name)])
        return self.merge() if merge else number

    def _rows(self, names: list[str]) -> DataFrame:
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names])
        key = [self.run, self.event]
        rest = [c for c in rows.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_save").alias("_r"))
        rows = last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
        newest = Window.partitionBy(self.run).orderBy(F.desc(self.ts), F.desc(self.event))
        # The rank limit also works per task before the shuffle, so a run sends at most keep rows of each.
        return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= self.keep).drop("_n")

    def read(self, version: int | None = None) -> DataFrame:
        """The newest events per run of a version, by default the newest one."""
        names = [n for _, n in self.folders(version)]
        if not names:
            raise ValueError("nothing was saved yet")
        return self._rows(names).drop("_save")

    def merge(self) -> int:
        """Merge every level of ``fan`` folders into one folder of the next.

        A row that is not among the newest of its run in some folders is not so in all, and an
        older save of an event never returns, so a merged folder holds all that readers need.
        """
        while True:
            base = self._base()
            entries = self.folders(base) if base else []
            full = [k for k in sorted({k for k, _ in entries}) if sum(x == k for x, _ in entries) >= self.fan]
            if not full:
                return base
            level, name = full[0], f"data/{uuid.uuid4().hex}"
            self._rows([n for x, n in entries if x == level]).write.parquet(f"{self.path}/{name}")
            self._commit(base, [*[e for e in entries if e[0] != level], (level + 1, name)])

    def vacuum(self, versions: int = 2) -> int:
        """Remove the data that none of the newest ``versions`` lists; returns how many folders went.

        A reader of one of these versions goes on undisturbed; give a number that covers the
        longest read. Folders of a writer at work are in no version yet, so run it from the writer.
        """
        known = self.versions()
        live = {n for v in known[-versions:] for _, n in self.folders(v)}
        dead = [n for n in self._names("data") if f"data/{n}" not in live]
        for v in known[:-versions]:
            self._fs.delete(self._place(f"versions/v{v:012d}"), False)
        for n in dead:
            self._fs.delete(self._place(f"data/{n}"), True)
        return len(dead)
