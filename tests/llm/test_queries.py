"""The registered queries over whole tables at the smallest scale, against brute force."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from evidex.llm import langid, pii, sharding
from evidex.llm.queries import QUERIES, SHARDS

from .test_dedup import brute_classes, brute_cut
from .test_search import brute_neighbours, plain_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def trigrams(text):
    letters = [[c if c.isalpha() else " " for c in w] for w in [f" {text} ".lower()]][0]
    run = re.sub(" +", " ", "".join(letters))
    return [run[k:k + 3] for k in range(len(run) - 2)]


def plain_bundle(grams, dimensions=langid.DIMENSIONS):
    out = np.zeros(dimensions)
    for gram, n in zip(*np.unique(grams, return_counts=True), strict=True):
        a, b, c = (langid.letter_vector(0 if x == " " else ord(x), dimensions).astype(np.float64) for x in str(gram).ljust(3))
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_language_query_equals_plain_cosines(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    bundles = {k: plain_bundle(trigrams(t or "")) for k, t, _ in docs}
    learned = {}
    for k, t, lang in docs:
        if lang is not None and t is not None and not out(k):
            learned[lang] = learned.get(lang, 0) + bundles[k]
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, t, _ in docs:
        if not any(c.isalpha() for c in t or ""):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        cosine = {n: float(bundles[k] @ v / np.linalg.norm(bundles[k]) / np.linalg.norm(v)) for n, v in learned.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[k].lang_pred == best and got[k].held_out == out(k) and got[k].score == pytest.approx(max(cosine[best], 0), abs=1e-4)


def test_sharding_query_equals_plain_placement(spark, texts):
    table = sharding.fill(sorted(SHARDS))
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, sorted(SHARDS)[table[slot]])


def test_personal_data_query_keeps_the_plain_spans(spark, texts):
    model = pii.trained(spark)
    for r in QUERIES["op6_personal_data"](spark, SF).collect():
        base = plain_spans(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.all_spans(base, pii.field_spans([texts[r.doc_id] or ""], model)[0]))


def test_passages_query_equals_brute_force(spark, texts):
    want = brute_cut(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_passages"](spark, SF).collect()}
    assert got == {k: (n, m, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, m, kept) in want.items()}


def test_neighbours_query_has_recall(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = brute_neighbours(rows, [k for k in rows if k % 20 == 0], 20)
    got: dict = {}
    for r in QUERIES["op8_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(want) and all(sorted(v) == list(range(1, len(want[q]) + 1)) for q, v in got.items())
    assert np.mean([len(set(want[q]) & set(got[q].values())) / len(want[q]) for q in want]) >= 0.9


def test_jaccard_query_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op10_jaccard_classes"](spark, SF).collect()}
    assert got == brute_classes(texts)
