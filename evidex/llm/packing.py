"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import chunks, ends, tidy
from evidex.llm.pieces import Pieces

SEQUENCE = 2048
END = 1
#: Tokens that are packed together: some two thousand sequences, 16 MB of ids.
GROUP = 4_000_000
#: Cost of n tokens that attend to each other: LINEAR * n + QUADRATIC * n^2.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
_TOKENIZERS: dict[str, Ids] = {}


class Ids:
    """Ids by the tokenizer file, asked once for each distinct piece of text.

    The strings of the file's added tokens are cut out of a text first, the longest where several
    begin at one place, and stand for their own ids; what is between them is split into pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(lambda found: [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast([p.decode() for p in found], add_special_tokens=False)])
        self.added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.mark = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where those of each text begin and the total)."""
        marked = [k for k, t in enumerate(texts) if self.mark and self.mark.search(t)]
        if not marked:
            return self.pieces.ids(texts)
        parts, owner, said = [], [], []
        for k, text in enumerate(texts):
            at = 0
            for m in self.mark.finditer(text):
                parts.append(text[at:m.start()])
                said.append(self.added[m.group()])
                owner.append(k)
                at = m.end()
            parts.append(text[at:])
            said.append(-1)
            owner.append(k)
        found, bound = self.pieces.ids(parts)
        out = [x for p, i in enumerate(said) for x in (found[bound[p]:bound[p + 1]], [i] if i >= 0 else [])]
        length = np.diff(bound) + (np.array(said) >= 0)
        return np.concatenate(out).astype(np.int32), ends(np.bincount(owner, weights=length, minlength=len(texts)).astype(np.int64))


def _ids(path: str) -> Ids:
    """The tables of a tokenizer, made once in each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


def balance(lengths: np.ndarray, capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every token run, sequences numbered from 0.

    Documents go in descending order, which is also that of their cost, to the sequence of
    lowest cost that has room for them; as many sequences are open as the tokens fill. A
    document longer than a sequence first gives off whole ones. One that fits nowhere is cut:
    the cheapest sequence with any room is filled with its head. What is left when all are
    full, less than a sequence, becomes sequences of powers of two. So nothing is padded. Ties
    go to the earlier document and the lower sequence; empty documents have no piece.
    """
    total = int(lengths.sum())
    full, out, pool = total // capacity, [], []
    number = 0
    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left >= capacity:
            out.append((int(doc), start, capacity, number, 0))
            number, start, left = number + 1, start + capacity, left - capacity
        if left:
            pool.append((int(doc), start, left))
    pool.sort(key=lambda p: (-p[2], p[0]))
    cost, room = np.zeros(full - number), np.full(full - number, capacity)
    tail = []
    for doc, start, left in pool:
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            if not fits.any():
                tail.append((doc, start, left))
                break
            at = int(np.where(fits, cost, np.inf).argmin())
            n = min(left, int(room[at]))
            out.append((doc, start, n, number + at, capacity - int(room[at])))
            room[at] -= n
            cost[at] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    number, rest = full, total - full * capacity
    size = filled = 0
    for doc, start, left in tail:
        while left:
            if filled == size:
                size, filled = 1 << (rest.bit_length() - 1), 0
                rest -= size
                number += 1
            n = min(left, size - filled)
            out.append((doc, start, n, number - 1, filled))
            filled, start, left = filled + n, start + n, left - n
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE,
         group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """Pack every text's ids and the end id into sequences of at most ``capacity`` tokens.

    Gives (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids), a row per
    piece; ids only with ``with_ids``. Each task packs ``group`` tokens at a time, so there is
    no shuffle and memory is bounded; a sequence number is made of the task and a counter, so
    a repeated task gives the same rows. Ids are those of the library without special tokens put
    in, so the string of an added token in a text is its one id. Null and empty texts are the end id alone; rows with
    a null or repeated id are packed each by itself; other columns are not read; an empty
    table gives no rows.
    """

    def rows(ids: list[int | None], tokens: list[np.ndarray], before: np.ndarray, whole: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = balance(lengths, capacity)
        doc, start, n, seq, off = (np.array(c, np.int64) for c in zip(*out, strict=True))
        runs = [tokens[d][s:s + k] for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
        crc = np.fromiter((zlib.crc32(r.astype("<u4").tobytes()) for r in runs), np.int64, len(runs))
        columns = [pa.array([ids[d] for d in doc.tolist()], pa.int64()), start + before[doc], n, crc, whole[doc], first + seq, off,
                   pa.array(runs if with_ids else [None] * len(runs), pa.list_(pa.int32()))]
        return pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_SCHEMA), first + int(seq.max()) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _ids(path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, np.ndarray, int, int]] = []
        size = 0

        def flush():
            nonlocal held, size, number
            batch, number = rows([h[0] for h in held], [h[1] for h in held], np.array([h[2] for h in held]), np.array([h[3] for h in held]), number)
            held, size = [], 0
            return batch

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, parts_of = 0, []

            def close(row, parts):
                ids = np.concatenate([*parts, [END]]).astype(np.int32)
                for s in range(0, len(ids), group):
                    yield keys[row], ids[s:s + group], s, len(ids)

            for r, parts in chunks(texts):
                ids, bound = pieces.ids(parts)
                for k, row in enumerate(r):
                    if row != at:
                        for piece in close(at, parts_of):
                            held.append(piece)
                            size += len(piece[1])
                            if size >= group:
                                yield flush()
                        at, parts_of = row, []
                    parts_of.append(ids[bound[k]:bound[k + 1]])
            for piece in close(at, parts_of) if len(texts) else ():
                held.append(piece)
                size += len(piece[1])
                if size >= group:
                    yield flush()
        if held:
            yield flush()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(each), schema)
    return out if with_ids else out.drop("ids")
