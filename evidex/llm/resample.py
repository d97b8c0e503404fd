"""Importance resampling towards a target: hashed word runs, their bucket by CRCs taken in length-bucketed matrices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import CHUNK
from evidex.operators.scale import global_rank, settled

BUCKETS = 10_000
#: Reversed polynomial of CRC-32; bytes of a longer feature go through the matrices in pieces of BLOCK.
POLYNOMIAL, BLOCK = 0xEDB88320, 1024


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()


def _fed(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """CRC states after one byte of every row at a time; ``columns`` is (bytes, rows)."""
    for column in columns:
        state = _TABLE[(state ^ column) & 255] ^ (state >> 8)
    return state


def _past_block() -> np.ndarray:
    """(4, 256) table of what BLOCK zero bytes make of each byte of a state; states are linear."""
    basis = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    return _fed(basis, np.zeros((BLOCK, 1), np.uint8)).reshape(4, 256)


_PAST: list[np.ndarray] = []


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each kind, kind of each row) of a matrix of bytes."""
    n = rows.shape[1]
    if n <= 8:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :n] = rows
        keys = wide.view(np.uint64).ravel()
    else:
        keys = np.ascontiguousarray(rows).view(np.dtype((np.void, n))).ravel()
    _, one, kind = np.unique(keys, return_index=True, return_inverse=True)
    return one, kind


def crc32s(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``flat[start:start + length]``, by matrices of the distinct ones of equal length.

    A state is linear in the state before and the bytes, so a feature over BLOCK bytes is cut
    into pieces, its first of what is left over; all pieces of one length share a matrix, and
    the states of a feature are put together piece by piece.
    """
    out = np.zeros(len(start), np.uint32)
    if not len(start):
        return out
    order = np.argsort(length, kind="stable")
    sizes, at = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, at[1:]), strict=True):
        if size > BLOCK:
            out[rows] = _long(flat, start[rows], size)
            continue
        matrix = flat[start[rows][:, None] + np.arange(size)]
        one, kind = _distinct(matrix)
        state = np.full(len(one), 0xFFFFFFFF, np.uint32)
        out[rows] = _fed(state, np.ascontiguousarray(matrix[one].T))[kind] ^ np.uint32(0xFFFFFFFF)
    return out


def _long(flat: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    if not _PAST:
        _PAST.append(_past_block())
    past, (pieces, left) = _PAST[0], divmod(size, BLOCK)
    out = np.empty(len(start), np.uint32)
    for k, s in enumerate(start.tolist()):
        state = _fed(np.full(1, 0xFFFFFFFF, np.uint32), flat[s:s + left].reshape(left, 1))[0]
        matrix = flat[s + left:s + size].reshape(pieces, BLOCK)
        for piece in _fed(np.zeros(pieces, np.uint32), np.ascontiguousarray(matrix.T)).tolist():
            b = int(state)
            state = int(past[0, b & 255] ^ past[1, b >> 8 & 255] ^ past[2, b >> 16 & 255] ^ past[3, b >> 24]) ^ piece
        out[k] = state ^ 0xFFFFFFFF
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: Bytes outside words, before A-Z are lowered.
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered words, each with one space behind it, place of each space, first word of each part and the total)."""
    code = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    word = _IN_WORD[code]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    keep = word.copy()
    keep[1:] |= word[:-1]
    flat = np.where(word, code, 32).astype(np.uint8)[keep]
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return flat, np.flatnonzero(flat == 32), np.searchsorted(np.flatnonzero(opens), at)


def _cut(texts: list[bytes | None], most: int, limit: int = CHUNK) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(rows, parts, words counted before) of about ``limit`` bytes; null counts as empty.

    A long text is cut at a gap; the ``most - 1`` words before it come again, as counted.
    """
    rows, parts, counted, size = [], [], [], 0
    for row, text in enumerate(texts):
        text, start, carried = text or b"", 0, []
        while True:
            cut = _GAP.search(text, start + limit) if len(text) - start > limit else None
            rows.append(row)
            parts.append(b" ".join([*carried, text[start:cut.start() if cut else len(text)]]))
            counted.append(len(carried))
            size += len(parts[-1]) + 64
            if cut and most > 1:
                flat, space, _ = _words([parts[-1]])
                begin = np.concatenate([[0], space + 1])[max(len(space) - most + 1, 0)]
                carried = flat[begin:].tobytes().split(b" ")[:-1]
            if size >= limit:
                yield rows, parts, counted
                rows, parts, counted, size = [], [], [], 0
            if not cut:
                break
            start = cut.start()
    if rows:
        yield rows, parts, counted


def _features(texts: list[bytes | None], least: int, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each feature, its bucket, row of each word), some texts at a time."""
    for rows, parts, counted in _cut(texts, most):
        flat, space, first = _words(parts)
        part = np.repeat(np.arange(len(parts)), np.diff(first))
        begin = np.concatenate([[0], space[:-1] + 1]).astype(np.int64) if len(space) else space
        fresh = np.arange(len(space)) - first[part] >= np.array(counted)[part]
        row, starts, lengths = [], [], []
        for n in range(least, most + 1):
            last = np.arange(n - 1, len(space))
            last = last[fresh[last] & (part[last] == part[last - n + 1])]
            row.append(part[last])
            starts.append(begin[last - n + 1])
            lengths.append(space[last] - starts[-1])
        by = np.array(rows, np.int64)
        bucket = crc32s(flat, np.concatenate(starts), np.concatenate(lengths)) % np.uint32(buckets)
        yield by[np.concatenate(row)], bucket.astype(np.int64), by[part[fresh]]


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, text_col: str = "text", ngram: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all whole texts fall in each bucket that has any.

    A task sends at most ``buckets`` rows, whatever it reads. Null and empty texts have none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _ in _features(_bytes(batch.column(0)), *ngram, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(each, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", ngram: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), s of S features in ``docs``, t of T in ``target``.

    The driver takes at most ``buckets`` rows of each table.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, docs), (t, target)):
        for r in bucket_counts(table, text_col, ngram, buckets).collect():
            counts[r.bucket] = r.n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: tuple[int, int] = (1, 1)) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: weight is the sum of its features' gains."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = np.zeros((3, rows), np.int64)
            for row, bucket, word_row in _features(_bytes(batch.column(1)), *ngram, len(gain)):
                n_words += np.bincount(word_row, minlength=rows)
                n_features += np.bincount(row, minlength=rows)
                # Sums of whole numbers below 2^53 are exact in doubles.
                weight += np.bincount(row, weights=gain[bucket], minlength=rows).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                  names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        each, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) that hangs on the id and the seed only."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(said, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(docs: DataFrame, target: DataFrame, percent: int, min_words: int, seed: int, id_col: str = "doc_id", text_col: str = "text",
         ngram: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """Draw a share of ``docs`` that resembles ``target``, without replacement:
    (doc_id, n_words, n_features, weight, score, rank), a row per row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lowered) and code points over 127. Features are
    runs of ``ngram`` words, joined by one space, repeats counted; a bucket is their CRC-32
    modulo ``buckets``. score is weight plus a Gumbel number of the id, so the highest scores are
    a weighted draw. Of the N rows with ``min_words`` words, the floor(percent * N / 100) highest get
    rank 1, 2, ..., ties to the smaller id, null ids last; of rows with one id those with fewer
    features, then less weight go first, and wholly equal ones in any order. Null and empty texts
    have no features and weight 0; an empty table gives no rows; other columns are not read.

    Two maps over the texts; only bucket counts and the narrow rows of the result are shuffled.
    The order is a range sort, so no task sees all rows, and ranks are file offsets.
    """
    gain = gains(docs, target, text_col, ngram, buckets)
    scored = weigh(docs, gain, id_col, text_col, ngram)
    scored = settled(scored.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("bigint")), "scored")
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.filter(enough).count() // 100
    ranked = global_rank(scored.withColumn("short", ~enough), [F.asc("short"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")])
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
