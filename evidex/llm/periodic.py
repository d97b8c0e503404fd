"""Periodic runs of words by a sparse diagonal DP over earlier occurrences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import ends, grouped, run_hash

#: A run has at least LEAST words and at least REPEATS periods.
LEAST, REPEATS = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _diagonals(at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, steps, lag) of each diagonal: the match length of a lag at a place is that at the
    place before plus one, so a diagonal is a stretch of neighbouring places with one lag."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(lag) != 0)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), lag[first]


def runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts ``ids[first[k]:first[k + 1]]``, by start, then period.

    Lags go by classes from c to 3c/2, and the key of a place is its next 3c words. A run of
    period q has 3q matches in a row, so its places meet the key q words earlier. Of the earlier
    occurrences of a key only the nearest, at d, counts: d and another lag q of the class give
    the key both periods, and as d + q <= 3c also their divisor's, so q is a multiple of d and its
    diagonal the same stretch with a period that is not the smallest. Hence each place extends at
    most one diagonal per class, and each run comes out once, also in a text of one single word.
    Places whose key occurs once in their text cannot match in a later class, whose keys are
    longer, so prose is through after the class of two.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][doc]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(at: np.ndarray, lag: np.ndarray, key: int) -> None:
        a, steps, q = _diagonals(at, lag)
        matched = steps + key - 1
        enough = matched + q >= np.maximum(LEAST, REPEATS * q)
        found.append((a[enough] - q[enough], matched[enough] + q[enough], q[enough]))

    again = np.flatnonzero((ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])) + 1
    emit(again, np.ones(len(again), np.int64), 1)
    at, c = np.arange(len(ids)), 2
    while True:
        at = at[at + 3 * c <= stop[at]]
        if len(at) < 2:
            break
        key = run_hash(ids, at, at + 3 * c)
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        same = (key[1:] == key[:-1]) & (doc[place[1:]] == doc[place[:-1]])
        here, lag = place[1:][same], np.diff(place)[same]
        fits = (lag >= c) & (lag <= c * 3 // 2)
        here, lag = here[fits], lag[fits]
        by = np.argsort(here)
        emit(here[by], lag[by], 3 * c)
        shared = np.zeros(len(place), bool)
        shared[1:] |= same
        shared[:-1] |= same
        at, c = np.sort(place[shared]), c * 3 // 2 + 1
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def find(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, collapsed text in UTF-8) of each text; runs are (start, length, period)."""
    words = [t.encode().split() for t in texts]  # bytes split at blank, tab and the four line ends only
    first = ends(len(w) for w in words)
    number = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for ws in words for w in ws), np.int64, int(first[-1]))
    start, length, period = runs(ids, first)
    cut = np.searchsorted(start, first)
    for k, ws in enumerate(words):
        lo, hi = cut[k], cut[k + 1]
        if lo == hi:
            yield len(ws), [], b" ".join(ws)
            continue
        s, n, q = start[lo:hi] - first[k], length[lo:hi], period[lo:hi]
        edge = np.zeros(len(ws) + 1, np.int64)
        np.add.at(edge, s + q, 1)
        np.add.at(edge, s + n, -1)
        keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
        yield len(ws), list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)), b" ".join([ws[i] for i in keep])


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every whole text.

    Words are runs of anything but blank, tab and the four line ends, numbered from 0. A run is
    a stretch with smallest period q, at least six words and four periods long, that no
    neighbouring word extends; ``runs`` holds all of them by start, then period. ``collapsed`` are
    the words, joined by one space, that no run contains after its first q words. Null and
    empty texts have no words, no runs and an empty collapsed text; rows with a null or a
    repeated id are kept as they are; other columns are not read; an empty table gives no rows.
    A map over the scan: no shuffle, memory in proportion to the longest text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in grouped(batch.column(1).to_pylist()):
                n, found, kept = zip(*find(texts), strict=True)
                struct = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(struct, pa.list_(RUN)),
                                       pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        each, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a periodic end in a tenth of the texts.

    With h the CRC-32 of the decimal id and g = floor(h / 10): where h % 10 = 0 and there are n > 0
    words, each word i >= a becomes word a + (i - a) % p of the original, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts stay as they are, also those without an id.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    rows = ids.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return rows.selectExpr("doc_id", """case when size(words) > 0 then array_join(
        transform(array(named_struct('g', h div 10, 'n', size(words))), t ->
        transform(array(named_struct('a', cast(t.g % t.n as int), 'p', 1 + (t.n - cast(t.g % t.n as int)) div (3 + t.g % 8))), u ->
        transform(words, (w, i) -> if(i < u.a, w, words[cast(u.a + (i - u.a) % u.p as int)])))[0])[0], ' ') else text end as text""")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``collapse``.

    start, length and period are of the longest run, ties to the smallest start, then period, and
    null without one; runs_sha256 is of all runs as lines start,length,period.
    """
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    rows = collapse(docs).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("top"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, start, period = F.col("top.length"), -F.col("top.back"), -F.col("top.least")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
