"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import chunks
from evidex.llm.pieces import BytePairs, Pieces

_MERGERS: dict[str, tuple[BytePairs, Pieces]] = {}


def _merger(path: str) -> tuple[BytePairs, Pieces]:
    """The tables of a vocabulary, made once in each Python worker."""
    if path not in _MERGERS:
        pairs = BytePairs(path)
        _MERGERS[path] = pairs, Pieces(pairs.encode)
    return _MERGERS[path]


def _run(docs: DataFrame, id_col: str, text_col: str, schema: str, each) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, by the ranks in ``path``.

    Each match of the tokenizers' pattern is merged by itself; there are no special tokens.
    Null and empty texts give an empty array; rows with a null or repeated id are kept as
    they are; other columns are not read. Long texts are cut between words, which does not
    change the ids. A map over the scan: no shuffle, memory bounded by one Arrow batch.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = _merger(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            found: list[list[np.ndarray]] = [[] for _ in texts]
            for rows, parts in chunks(texts):
                ids, at = pieces.ids(parts)
                for k, row in enumerate(rows):
                    found[row].append(ids[at[k]:at[k + 1]])
            lists = [np.concatenate(x) if x else np.empty(0, np.int32) for x in found]
            yield pa.record_batch([keys, pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _run(docs, id_col, text_col, "doc_id bigint, ids array<int>", each)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids array<int>); a null array gives empty bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, _ = _merger(path)
        for batch in batches:
            out = [pairs.decode(np.array(x or [], np.int32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(each, "doc_id bigint, data binary")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from its ids.

    ids_sha256 is of the decimal ids joined by commas. Nulls, empty and repeated rows as in
    ``encode``. Texts go through in parts, so a long one costs no more memory than a short one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, pieces = _merger(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            count = np.zeros(len(texts), np.int64)
            said, back = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            for rows, parts in chunks(texts):
                ids, at = pieces.ids(parts)
                decimals, data = pairs.decimals(ids).tobytes(), pairs.decode(ids).tobytes()
                said_at = np.concatenate([[0], np.cumsum(pairs.said_length[ids])])[at].tolist()
                data_at = np.concatenate([[0], np.cumsum(pairs.token_length[ids])])[at].tolist()
                for k, row in enumerate(rows):
                    said[row].update(decimals[said_at[k] + (not count[row]):said_at[k + 1]])
                    back[row].update(data[data_at[k]:data_at[k + 1]])
                    count[row] += at[k + 1] - at[k]
            yield pa.record_batch([keys, pa.array(count), pa.array([h.hexdigest() for h in said], pa.string()), pa.array([h.hexdigest() for h in back], pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, id_col, text_col, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", each)
