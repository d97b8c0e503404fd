"""Exact, near and passage dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import digests, jaccard, passages
from evidex.llm.common import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in sets}

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("limits", [{}, {"block_docs": 2, "broadcast_rows": 0}])
def test_classes_equal_brute_force(spark, prose, limits):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(rows_of(spark, prose), **limits).collect()}
    assert got == brute_classes(prose)


def test_classes_of_odd_rows(odd, none):
    texts = {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    rows = jaccard.classes(odd).collect()
    want = brute_classes(texts)
    assert len(rows) == odd.count() and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows)
    assert jaccard.classes(none).count() == 0


def test_classes_of_two_texts_under_one_id(spark, prose):
    one, two, *_ = sorted(prose.values(), key=len, reverse=True)
    two = two.translate(str.maketrans("abcdefg", "ABCDEFG")).replace("A", "q")  # apart from the first
    rows = [(9, one), (9, two), (4, one + " more"), (5, two + " more"), (9, one.upper()), (7, "short"), (7, "another"), (8, "another")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for limits in ({}, {"block_docs": 1, "broadcast_rows": 0}):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, **limits).collect())
        n, m = len(shingles(one)), len(shingles(two))
        assert got == sorted([(9, n, 4), (9, n, 4), (4, len(shingles(one + " more")), 4), (9, m, 5), (5, len(shingles(two + " more")), 5),
                              (7, 1, 7), (7, 1, 7), (8, 1, 7)])


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(400):
        own = list(base)
        own[int(r.integers(100))] = f"x{k}"
        texts[k] = " ".join(own)
    got = {row.component_id for row in jaccard.classes(rows_of(spark, texts), block_docs=150).collect()}
    assert got == {0}


def test_forest_prunes_but_keeps_components():
    r = np.random.default_rng(7)
    for _ in range(100):
        bases = [r.choice(300, r.integers(1, 50), replace=False) for _ in range(3)]
        sets = []
        for _ in range(int(r.integers(2, 20))):
            own = set(bases[int(r.integers(3))].tolist())
            for x in r.choice(300, int(r.integers(0, 6)), replace=False).tolist():
                own ^= {x}
            sets.append(np.array(sorted(own or {0})))
        links = jaccard.forest(sets, np.arange(len(sets)), np.arange(len(sets)))
        text = {k: " ".join(map(str, s)) for k, s in enumerate(sets)}
        assert len(links) < len(text)
        near = lambda a, b: 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b]))
        label = list(range(len(sets)))
        for pairs, check in ((links, True), ([(a, b) for a in range(len(sets)) for b in range(a) if near(a, b)], False)):
            for a, b in pairs:
                if check:
                    assert near(a, b)
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
                else:
                    assert label[a] == label[b]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(3, 2), (2, 3), (5, 5), (100, 60), (7, 9), (9, 8)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 10 for k in [*range(10, 61), 100]}, 2: 2, 3: 2, 7: 7, 8: 7, 9: 7}
    assert components(edges.limit(0)).count() == 0


def brute_cut(texts, window=50):
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    first = {}
    for k in sorted(words):
        for at in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][at:at + window]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < k:
                gone[at:at + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("bucket_words", [passages.BUCKET_WORDS, 100])
def test_cut_equals_brute_force(spark, prose, bucket_words):
    want = brute_cut(prose)
    rows = passages.cut(rows_of(spark, prose), bucket_words=bucket_words).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in rows)
    assert any(n for _, n, _ in want.values())


def test_cut_of_odd_rows(odd, none):
    want = brute_cut({r.doc_id: r.text for r in odd.select("doc_id", "text").collect()})
    rows = passages.cut(odd).collect()
    assert len(rows) == odd.count() and all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in rows)
    assert passages.cut(none).count() == 0


def test_cut_of_two_texts_under_one_id(spark, prose):
    texts = sorted(prose.values(), key=len)
    rows = [(1, texts[-1]), (2, texts[-1] + " more"), (2, "short"), (2, texts[-2]), (3, texts[-2])]
    got = passages.cut(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    one = {(r.doc_id, r.n_words): r.n_removed for r in got}
    n, m = len(texts[-1].split()), len(texts[-2].split())
    assert len(got) == 5 and one[1, n] == 0 and one[2, n + 1] == n and one[2, 1] == 0 and one[3, m] == m


def test_super_kmers_hold_every_window_once():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 5, 700).astype(np.uint64)
    at = np.array([0, 30, 30, 400, 450, 700])
    text, start, n, _, _ = passages.super_kmers(hashes, at)
    got = sorted((int(t), int(s) + k) for t, s, m in zip(text, start, n, strict=True) for k in range(m))
    assert got == [(t, k) for t in range(5) for k in range(int(at[t + 1] - at[t]) - 49)]


def test_digest_index_persists_and_grows(spark, tmp_path):
    first = spark.createDataFrame([(1, "Abc"), (5, "aBC"), (2, "ÀB"), (3, "àb"), (4, None), (9, "")], "doc_id bigint, text string")
    path = f"{tmp_path}/index"
    got = {r.doc_id: r for r in digests.DigestIndex(spark, "digests_a", path, 4).dedup(first).collect()}
    assert [(got[k].keep_id, got[k].group_size, got[k].kept) for k in (1, 5, 2, 3, 4, 9)] == [
        (5, 2, False), (5, 2, True), (2, 1, True), (3, 1, True), (9, 2, False), (9, 2, True)]
    assert got[5].text_sha256 == hashlib.sha256(b"abc").hexdigest()
    again = digests.DigestIndex(spark, "digests_b", path, 4)
    more = spark.createDataFrame([(20, "ABC"), (21, "new"), (22, "NEW")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in again.dedup(more).collect()}
    assert got == {20: (5, 1, False), 21: (22, 2, False), 22: (22, 2, True)}
    assert again.rows().count() == 5
    plan = more.withColumn("text_sha256", digests.digest(more.text)).join(again.rows().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    spark.sql("DROP TABLE digests_a")
    spark.sql("DROP TABLE digests_b")


def test_digests_of_odd_rows(spark, odd, none):
    rows = digests.DigestIndex(spark).dedup(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert digests.DigestIndex(spark).dedup(none).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_batches_give_what_one_table_gives(spark, batches):
    r = np.random.default_rng(batches)
    rows = [(None if k % 17 == 0 else int(r.integers(400)), None if k % 31 == 0 else f"Text {int(r.integers(90))}"[: 6 + k % 3]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("place", F.lit("p")).withColumn("kept", F.lit(1))
    index = digests.DigestIndex(spark)
    got = index.dedup_all(docs, batches).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest(), []).append(k)
    assert len(got) == len(rows)
    for x in got:
        mine = groups[x.text_sha256]
        assert x.group_size == len(mine) and x.keep_id == max((k for k in mine if k is not None), default=None)
    stay = [(x.text_sha256, x.doc_id) for x in got if x.kept]
    assert sorted(k for k, _ in stay) == sorted(groups) and all(groups[k].count(i) and i == max((j for j in groups[k] if j is not None), default=None) for k, i in stay)
    assert index.rows().count() == len(groups)
    index.drop()


def test_a_large_block_with_far_and_near_sets_equals_brute_force(spark):
    r = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(60)], {}
    for k in range(220):
        own = list(base) + ["common words that all of them share"]
        for _ in range(int(r.integers(0, 9))):
            own[int(r.integers(60))] = f"x{int(r.integers(40))}"
        texts[k] = " ".join(own)
    for limit in (7, 40):
        got = {row.doc_id: (row.n_shingles, row.component_id) for row in jaccard.classes(rows_of(spark, texts), block_docs=limit).collect()}
        assert got == brute_classes(texts)
    assert 1 < len({c for _, c in brute_classes(texts).values()}) < 220
