"""Byte pairs and packing against the tokenizer libraries."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from evidex.llm import bpe, packing
from evidex.llm.pieces import BytePairs, Pieces

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["'s", "'re", "'l", "'ll", "'ve", "'d", "'", " '", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "​", "a", "s", "t", "re", "É", "1", "٣", "½", "!", "--", "日本", "😀", "é"]


@pytest.fixture(scope="module")
def pairs():
    return BytePairs(MULTI)


@pytest.fixture(scope="module")
def library(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def test_ids_equal_the_library_on_random_strings(pairs, library):
    r = random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    ids, at = Pieces(pairs.encode, limit=500).ids(texts)
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == library.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("text", ["ab" * 5000, "=-" * 3000, "日本語" * 3000, "x" * 9000, " " * 5000 + "a", "e" * 2047, "e" * 2049])
def test_long_pieces_equal_the_library(pairs, library, text):
    assert Pieces(pairs.encode).ids([text])[0].tolist() == library.encode_ordinary(text)


def test_digests_and_round_trip(spark, odd, library):
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    rows = bpe.token_digests(odd, MULTI).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, MULTI), MULTI).collect()
    assert all(bytes(r.data).decode() == texts[r.doc_id] for r in back)


def test_long_text_is_cut_without_effect(spark, library):
    text = "the end, isn't it? " * 100_000
    row = bpe.token_digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), MULTI).first()
    ids = library.encode_ordinary(text)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_tables(none):
    assert bpe.token_digests(none, MULTI).count() == bpe.encode(none, MULTI).count() == packing.pack(none, JSON).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1], [5000, 3, 3, 3], [700] * 9, [2047, 2047, 2, 1]])
def test_balance_covers_every_token_once(lengths):
    covered, used = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, off in packing.balance(np.array(lengths, np.int64)):
        assert n > 0
        covered[doc].append((start, n))
        used[seq].append((off, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(covered[k]):
            assert start == at
            at += size
        assert at == n
    for runs in used.values():
        at = 0
        for off, n in sorted(runs):
            assert off == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_balance_evens_out_the_cost():
    r = np.random.default_rng(1)
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.balance(r.integers(1, 1500, 2000)):
        cost[seq] += packing.LINEAR * n + packing.QUADRATIC * n * n
    values = [c for s, c in cost.items() if s < len(cost) - 11]
    assert np.std(values) < 0.2 * np.mean(values)


@pytest.mark.parametrize("group", [packing.GROUP, 3000])
def test_packed_pieces_are_the_tokenizers(odd, group):
    tokenizer = Tokenizer.from_file(JSON)
    rows = packing.pack(odd, JSON, group=group).collect()
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    whole = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    seen, used = defaultdict(int), defaultdict(list)
    for r in rows:
        piece = whole[r.doc_id][r.start:r.start + r.length]
        assert r.ids == piece and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    times = defaultdict(int)
    for r in odd.select("doc_id").collect():
        times[r.doc_id] += 1
    assert all(seen[k] == times[k] * len(whole[k]) for k in whole)
    for runs in used.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(n for _, n in runs[:k]) for k in range(len(runs))]
        assert sum(n for _, n in runs) <= packing.SEQUENCE


def test_added_tokens_are_their_own_ids(spark):
    tokenizer, mark, r = Tokenizer.from_file(JSON), "<|endoftext|>", random.Random(4)
    texts = ["hi " + mark + " yo", mark, mark * 3, mark + "\n", "<|endoftext|", "<|end" + mark + "oftext|>", ("some words, " * 60_000) + mark + " end", "no mark", "", None]
    texts += ["".join(r.choice([mark, "<|", "|>", " ", "\n", "a b", "It's", "é ", "endoftext"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = defaultdict(list)
    for row in packing.pack(docs, JSON).collect():
        got[row.doc_id].append((row.start, row.ids))
    for k, text in enumerate(texts):
        assert [i for _, ids in sorted(got[k]) for i in ids] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_queries(spark):
    from evidex.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert QUERIES["op9_byte_pairs"](spark, "/root/testdata/sf0.001").count() == docs.count()
    sizes = QUERIES["op1_packing"](spark, "/root/testdata/sf0.001").groupBy("sequence_id").sum("length").collect()
    assert all(n == 2048 or n & (n - 1) == 0 for _, n in sizes)


def test_the_field_works_on_part_of_a_chunk_and_tables_go_with_the_task(monkeypatch):
    from evidex.llm import common, pii
    sizes = []
    monkeypatch.setattr(pii, "field_spans", lambda texts, model: sizes.append(sum(map(len, texts))) or [[] for _ in texts])
    pii._field(["x" * 1000] * 1000, None)
    assert sum(sizes) == 1_000_000 and max(sizes) <= common.CHUNK // 2 + 1000
    common._powers(common.BASE, 10)
    common.release()
    assert not common._POWERS
