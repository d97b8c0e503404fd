"""Helpers shared by the operators: text chunks, run hashes and gathers in numpy, components in Spark."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.scale import settled

#: Characters, and whole texts at most, that numpy works on at a time.
CHUNK, TEXTS = 1 << 19, 512
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Base of the polynomial hash of byte and symbol runs, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the system. Workers stay for later tasks, and beside them the
    executor needs it for the stages that have none."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(each: Callable) -> Callable:
    """A function over batches that gives its memory back when the rows of a task are through."""

    @functools.wraps(each)
    def run(batches):
        try:
            yield from each(batches)
        finally:
            release()

    return run


def segments(text: str, limit: int = CHUNK) -> Iterator[str]:
    """Cut a long text before single blanks between words, each piece of about ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def chunks(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, segments) lists of about ``limit`` characters in all; null counts as empty."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for part in segments(text or "", limit):
            rows.append(row)
            parts.append(part)
            size += len(part) + 64
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def grouped(texts: Sequence[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, whole texts) of about ``limit`` characters and at most TEXTS texts; null counts as empty."""
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1]) + 64
        if size >= limit or len(held) >= TEXTS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def ends(lengths: Iterable[int]) -> np.ndarray:
    """0 and the running total of ``lengths``."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, kept up to a few million."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 4 * CHUNK:
            _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[start:end]`` for each pair, from one prefix sum."""
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(symbols)), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * _powers(BASE_INVERSE, len(symbols) + 1)[start]
    return mix(value ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + length]`` one after the other."""
    off = np.cumsum(length) - length
    return flat[np.arange(int(length.sum())) + np.repeat(start - off, length)]


_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(texts: Sequence[str], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total).

    Words are runs of anything but blank, tab and the four line ends; ``fold`` lowers A-Z.
    """
    code = codepoints("\n".join(texts) + "\n")
    if fold:
        code = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint32)
    gap = _SPACE[np.minimum(code, 127)]
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    at = ends(len(t) + 1 for t in texts)
    return run_hash(code, start, end), np.searchsorted(start, at)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Alternating stars: first the larger neighbours of each node move to its smallest
    neighbour, then the smaller ones, until nothing changes; rounds grow with the logarithm
    of the longest path. Minima combine before the shuffle, and rows of a hot node are
    dealt by its other end, so no task holds all neighbours of a node. Each round is a written
    table. Loops and repeated or reversed pairs are allowed; an empty table gives no rows.
    """
    now = settled(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .filter("a < b").distinct(), "pairs")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
                 .filter("a < b").distinct())
        large = settled(large, "pairs")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        after = settled(small.select("e.a", "e.b").filter("a < b").distinct(), "pairs")
        if not after.exceptAll(now).take(1) and not now.exceptAll(after).take(1):
            break
        now = after
    return after.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node").unionByName(
        after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
