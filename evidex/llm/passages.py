"""Substring dedup: windows of fifty words, counted in the buckets of their minimisers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import CHUNK, ends, grouped, mix, run_hash, segments, words
from evidex.operators.scale import settled

WINDOW = 50
#: Words of a minimiser; a window has WINDOW - MINIMISER + 1 candidates.
MINIMISER = 12
#: Words of one bucket that are sorted together; a minimiser with more is counted window by window.
BUCKET_WORDS = 500_000
SORT_WORDS = 1_000_000


def _hashes(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) of groups of whole texts."""
    for first, held in grouped(texts):
        if max(map(len, held)) > CHUNK:
            parts = [[words([p])[0] for p in segments(t)] for t in held]
            yield first, np.concatenate([h for p in parts for h in p]), ends(sum(map(len, p)) for p in parts)
        else:
            yield first, *words(held)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW, size: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser, content) of runs of consecutive windows with the same minimiser.

    The minimiser of a window is the least hash of the ``size`` words in a row in it; content
    is a hash of all words of the run.
    """
    n = len(hashes) - window + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = run_hash(mix(hashes), np.arange(len(hashes) - size + 1), np.arange(size, len(hashes) + 1))
    least = _least(grams, window - size + 1)
    text = np.searchsorted(at, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= at[text + 1]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
    content = run_hash(hashes, start, stop + window - 1)
    return text[start], start - at[text[start]], stop - start, least[start], content


_RUN = "doc_id bigint, t bigint, start bigint, n bigint, h bigint, c bigint"


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, n, h, c) of the super-k-mers of (doc_id, t, text): n windows from word ``start`` on."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, hashes, at in _hashes(batch.column(2).to_pylist()):
                text, start, n, h, c = super_kmers(hashes, at)
                yield pa.record_batch([pa.array(ids[first + text]), pa.array(marks[first + text]), pa.array(start), pa.array(n), _signed(h), _signed(c)],
                                      names=["doc_id", "t", "start", "n", "h", "c"])

    return docs.mapInArrow(each, _RUN)


def packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, c, n, doc_id, words) of the ``wanted`` super-k-mers (doc_id, t, start, n, h, c): their words joined by blanks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, n, doc, text = [], [], [], [], []
            size = 0
            for key, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = value.as_py().encode().split()
                for run in runs.as_py():
                    h.append(run["h"])
                    c.append(run["c"])
                    n.append(run["n"])
                    doc.append(key)
                    text.append(b" ".join(own[run["start"]:run["start"] + run["n"] + WINDOW - 1]))
                    size += len(text[-1])
                if size > 4 * CHUNK:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in (h, c, n, doc)] + [pa.array(text, pa.binary())], names=["h", "c", "n", "doc_id", "words"])
                    h, c, n, doc, text, size = [], [], [], [], [], 0
            if h:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (h, c, n, doc)] + [pa.array(text, pa.binary())], names=["h", "c", "n", "doc_id", "words"])

    lists = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n", "h", "c")).alias("runs"))
    return docs.join(lists, ["doc_id", "t"]).select("doc_id", "text", "runs").mapInArrow(each, "h bigint, c bigint, n bigint, doc_id bigint, words binary")


def first_documents(rows: list[list[bytes]], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each row of words, the least document of all rows that hold the same window, per window.

    Words become numbers, and runs of 2, 4, ... words the number of their pair of halves, so
    equal windows get equal numbers exactly; sorting these counts them.
    """
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in r), np.int64)
    at = ends(map(len, rows))
    have, level = 1, flat
    while have < window:
        step = min(have, window - have)
        level = np.unique((level[:-step] << 32) | level[step:], return_inverse=True)[1]
        have += step
    owner = np.repeat(np.arange(len(rows)), np.diff(at))[:len(level)]
    inside = np.arange(len(level)) + window <= at[owner + 1]
    kind, who = level[inside], owner[inside]
    least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs[who])
    found = least[kind]
    return np.split(found, np.flatnonzero(np.diff(who)) + 1)


def _runs(found: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """(first, last, document) of the stretches of one document below ``top``."""
    cut = np.flatnonzero(np.diff(found)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(found)]]) - 1
    return [(a, b, int(found[a])) for a, b in zip(first.tolist(), last.tolist(), strict=True) if found[a] < top]


_REPLY = "h bigint, c bigint, runs array<struct<first: bigint, last: bigint, doc: bigint>>"


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the windows of rows (h, c, top, doc_id, words) that come sorted by h."""
    held: list[tuple[int, int, int, int, list[bytes]]] = []
    size = 0

    def flush(rows):
        found = first_documents([r[4] for r in rows], np.array([r[3] for r in rows]))
        runs = [_runs(f, r[2]) for f, r in zip(found, rows, strict=True)]
        keep = [k for k, r in enumerate(runs) if r]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("doc", pa.int64())]))
        return pa.record_batch([pa.array([rows[k][0] for k in keep], pa.int64()), pa.array([rows[k][1] for k in keep], pa.int64()),
                                pa.array([[{"first": a, "last": b, "doc": d} for a, b, d in runs[k]] for k in keep], kind)], names=["h", "c", "runs"])

    for batch in batches:
        for h, c, top, doc, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if size > SORT_WORDS and held[-1][0] != h:
                yield flush(held)
                held, size = [], 0
            held.append((h, c, top, doc, text.split()))
            size += len(held[-1][4])
    if held:
        yield flush(held)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, top, place, one, two, doc_id) of each window of rows (h, c, top, doc_id, words)."""
    for batch in batches:
        for h, c, top, doc, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            hashes, _ = words([text.decode()])
            n = len(hashes) - WINDOW + 1
            one = run_hash(hashes, np.arange(n), np.arange(WINDOW, n + WINDOW))
            two = run_hash(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.arange(n), np.arange(WINDOW, n + WINDOW))
            yield pa.record_batch([pa.array(np.full(n, x)) for x in (h, c, top)] + [pa.array(np.arange(n)), _signed(one), _signed(two), pa.array(np.full(n, doc))],
                                  names=["h", "c", "top", "place", "one", "two", "doc_id"])


def removals(docs: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(doc_id, t, cuts array<struct<from, to>>): the words, from 0 and end exclusive, of (doc_id, t, text)
    that a window covers which also starts in a document of smaller id. t tells texts of one id apart.

    Windows travel as super-k-mers to the bucket of their minimiser. Equal super-k-mers are
    one class, kept with its smallest document, so groups of copies shrink before any text
    moves; a minimiser with one class is answered from that. Only classes that share a
    minimiser with another send their words, sorted and compared exactly in the bucket. A
    minimiser with more than ``bucket_words`` words is counted window by window instead, by
    128-bit hashes whose minima combine before the shuffle.
    """
    runs = settled(occurrences(docs), "runs")
    shared = settled(runs.groupBy("h").agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n"))
        .filter("first < last"), "shared")
    alone = shared.filter("low = high").select("h", F.col("low").alias("c"), F.array(F.struct(
        F.lit(0).cast("bigint").alias("first"), (F.col("n") - 1).alias("last"), F.col("first").alias("doc"))).alias("runs"))
    several = settled(runs.join(shared.filter("low < high").select("h"), "h").groupBy("h", "c").agg(
        F.min(F.struct("doc_id", "t", "start")).alias("rep"), F.max("doc_id").alias("top"), F.max("n").alias("n")), "several")
    wanted = several.select("rep.doc_id", "rep.t", "rep.start", "n", "h", "c")
    tops = several.select("h", "c", "top")
    hot = several.groupBy("h").agg(F.sum(F.col("n") + WINDOW - 1).alias("size")).filter(F.col("size") > bucket_words).select("h", F.lit(True).alias("hot"))
    sent = packed(docs, wanted).join(tops, ["h", "c"]).join(hot, "h", "left")
    sent = settled(sent.select("h", "c", "top", "doc_id", "words", F.coalesce("hot", F.lit(False)).alias("hot")), "sent")
    plain = (sent.filter("not hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_buckets, _REPLY))
    windows = settled(sent.filter("hot").drop("hot").mapInArrow(
        _window_hashes, "h bigint, c bigint, top bigint, place bigint, one bigint, two bigint, doc_id bigint"), "windows")
    least = windows.groupBy("one", "two").agg(F.min("doc_id").alias("doc"), F.max("top").alias("most")).filter("doc < most").drop("most")
    large = windows.join(least, ["one", "two"]).filter("doc < top").groupBy("h", "c").agg(
        F.collect_list(F.struct(F.col("place").alias("first"), F.col("place").alias("last"), "doc")).alias("runs"))
    reply = settled(alone.unionByName(plain).unionByName(large), "reply")
    hits = runs.select("doc_id", "t", "start", "h", "c").join(reply, ["h", "c"]).select("doc_id", "t", "start", F.explode("runs").alias("run")).filter("run.doc < doc_id")
    return hits.groupBy("doc_id", "t").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("run.first")).alias("from"), (F.col("start") + F.col("run.last") + WINDOW).alias("to"))).alias("cuts"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_words: int = BUCKET_WORDS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every document, kept words joined by one blank.

    Null, empty and blank texts have no words and an empty kept text; texts under fifty words
    lose nothing; rows with a null id are left out; rows of one id never cut each other, and
    each is cut by its own text. Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for value, cuts in zip(batch.column(1), batch.column(2), strict=True):
                own = value.as_py().encode().split()
                gone = np.zeros(len(own) + 1, np.int64)
                spans = cuts.as_py() or []
                if spans:
                    np.add.at(gone, [s["from"] for s in spans], 1)
                    np.add.at(gone, [s["to"] for s in spans], -1)
                keep = np.cumsum(gone[:-1]) <= 0
                kept = b" ".join(own if keep.all() else [own[k] for k in np.flatnonzero(keep)])
                for column, v in zip(out, (len(own), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    column.append(v)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.record_batch(columns + [pa.array(out[3], pa.string())] * with_text, names=names)

    return docs.join(removals(docs, bucket_words), ["doc_id", "t"], "left").select("doc_id", "text", "cuts").mapInArrow(
        each, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
