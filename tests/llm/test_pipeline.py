"""The pipeline against a brute-force version of its stages."""

import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from evidex.llm import pii

from .test_dedup import FOLD, brute_classes

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, prose, tmp_path_factory):
    rows = [(k, t, "en" if k % 3 else None, "s", len(t)) for k, t in prose.items()]
    top = len(rows)
    rows += [(top + k, rows[k][1].upper() if k % 2 else rows[k][1], "en", None, None) for k in range(10)]
    rows += [(top + 20, None, "en", "s", 0), (top + 21, "", None, "s", 0), (top + 22, "12 + 34 = 46", "en", "s", 12),
             (top + 23, "write to bob.1@mail2.example.com or +1 (988) 555-2485 soon", "en", "s", 1), rows[3]]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    return rows, str(folder)


def brute(rows):
    docs = {r[0]: r[1] for r in rows if any(c.isalpha() for c in r[1] or "")}
    newest = {}
    for k, t in docs.items():
        key = t.translate(FOLD)
        newest[key] = max(newest.get(key, k), k)
    docs = {k: docs[k] for k in newest.values()}
    docs = {k: docs[k] for k, (_, c) in brute_classes(docs).items() if c == k}
    model = pii.train(pii.labelled_rows())
    return {k: pii.redacted(t, spans) for (k, t), (_, spans) in zip(docs.items(), pii.find(list(docs.values()), model), strict=True)}


def test_run_equals_brute_force(spark, corpus):
    rows, folder = corpus
    want = brute(rows)
    assert sum("[EMAIL]" in t and "[PHONE]" in t for t in want.values()) == 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    got = {k: [i for _, ids in sorted(p) for i in ids] for k, p in pieces.items()}
    assert got == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in want.items()}


def test_stages_keep_the_columns_and_take_empty_tables(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
        if name != "packing":
            assert empty.dtypes == docs.dtypes


def test_exact_dedup_decides_per_row(spark):
    rows = [(None, "one", "en", "s", 3), (None, "two", None, "s", 3), (None, "TWO", None, "s", 3), (None, None, None, None, None),
            (1, "three", "en", "s", 5), (1, "four", "en", "s", 4), (2, "Three", "en", "s", 5), (3, "five", "en", "s", 4), (3, "five", "en", "s", 4)]
    kept = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, ""), (0, "one"), (0, "two"), (1, "four"), (2, "three"), (3, "five")]


RUSSIAN = "Привет мир, как дела сегодня у вас в городе, и что нового"


def test_language_id_without_labels_keeps_letters(spark):
    rows = [(1, "some words", None, "s", 10), (None, RUSSIAN, None, "s", 50), (3, "12 + 34", None, "s", 7), (4, None, None, "s", 0)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert {r.text for r in kept} == {"some words", RUSSIAN}


def test_language_id_rejects_a_script_never_learned(spark, prose):
    texts = list(prose.values())
    rows = [(k, " ".join(texts[(k + j) % len(texts)] for j in range(3)), "en", "s", 1) for k in range(700)]
    rows += [(1000, RUSSIAN, None, "s", 1), (1001, "日本語の文章です。" * 20, None, "s", 1), (1002, "日本", None, "s", 1), (1003, texts[0] + texts[1], None, "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} - {1000, 1001}
    few = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.filter("doc_id < 20 or doc_id >= 1000"), "").collect()}
    assert {1000, 1001} <= few  # too few labelled rows to set a floor


def test_near_dedup_decides_per_row(spark, prose):
    one = max(prose.values(), key=len)
    rows = [(1, one, "en", "s", 1), (2, one + " more", "en", "s", 1), (2, "a clean text", "en", "s", 1), (None, one + " end", "en", "s", 1)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(r[0], r[1]) for r in rows} - {(2, one + " more")}


def test_stages_take_clashing_names_and_long_texts(spark, prose):
    one = max(prose.values(), key=len)
    long = " ".join(prose.values()) * 40
    rows = [(k, t, "en", "s", len(t), "x", 1.0, "y", "z", 5) for k, t in enumerate([one, one.upper(), one + " more", long, long + " end", "bob.1@mail2.example.com"])]
    schema = COLUMNS + ", _lang string, _score double, _row string, _pair string, _t bigint"
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for (name, stage), left in zip(corpus_pipeline.STAGES[:4], (6, 5, 3, 6), strict=True):
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert len(got) == left and all((r._lang, r._score, r._row, r._pair, r._t) == ("x", 1.0, "y", "z", 5) for r in got), name
