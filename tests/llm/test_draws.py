"""Resampling, mixing and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import mixing, periodic, queries, resample

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(spark, table="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id" if table == "documents" else "item_id", "text").collect()]


# Resampling


def test_crc_matrices_equal_zlib():
    r = random.Random(3)
    made = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 7, 8, 9, 30, 1023, 1024, 1025, 2048, 5000, 0) for _ in range(3)] * 2
    flat = np.frombuffer(b"".join(made), np.uint8)
    length = np.array([len(m) for m in made])
    got = resample.crc32s(flat, np.cumsum(length) - length, length)
    assert got.tolist() == [zlib.crc32(m) for m in made]


def features(text, least, most):
    ws = FEATURE.findall((text or "").translate(LOW))
    return [" ".join(ws[i:i + n]) for n in range(least, most + 1) for i in range(len(ws) - n + 1)], len(ws)


def brute_draw(docs, target, percent, min_words, seed, ngram=(1, 1), buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in table for f in features(x, *ngram)[0]) for table in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for key, text in docs:
        fs, n = features(text, *ngram)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ok = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = ok[:percent * len(ok) // 100]
    return out, drawn


def seen(rows):
    return sorted((tuple(-9 if v is None else v for v in r) for r in rows))


@pytest.mark.parametrize("ngram", [(1, 1), (1, 3)])
def test_draw_equals_brute_force(spark, odd, ngram):
    from .conftest import odd_rows
    docs = [(r[0], r[1]) for r in odd_rows()] + [(None, "one two three " * 9), (3, "another text " * 12)]
    target = [(1, "word one two"), (2, None), (3, "bob mail É")]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(docs[-2:], "doc_id bigint, text string"))
    got = resample.draw(table, spark.createDataFrame(target, "doc_id bigint, text string"), 50, 3, 7, ngram=ngram).collect()
    out, drawn = brute_draw(docs, target, 50, 3, 7, ngram)
    assert seen(r[:5] for r in got) == seen(out)
    assert seen((*r[:5], r.rank) for r in got if r.rank) == seen((*r, k + 1) for k, r in enumerate(drawn))


def test_cut_texts_give_the_same_features(monkeypatch):
    text = (" ".join(f"w{k % 97} Ünï{k % 31}" for k in range(3000)) + " " + "x" * 4000 + " end").encode()
    whole = Counter()
    for _, bucket, words in resample._features([b"a b c", text, None], 1, 3, 1000):
        whole.update(bucket.tolist())
    original = resample._cut
    monkeypatch.setattr(resample, "_cut", lambda texts, most: original(texts, most, 500))
    parts = Counter()
    for _, bucket, words in resample._features([b"a b c", text, None], 1, 3, 1000):
        parts.update(bucket.tolist())
    assert parts == whole


def test_draw_of_empty_tables(spark, none, odd):
    from .conftest import odd_rows
    assert resample.draw(none, odd, 10, 20, 1).count() == 0
    got = resample.draw(odd, none, 10, 1, 1)
    assert got.count() == odd.count() and got.filter("rank is not null").count() == sum(bool(features(r[1], 1, 1)[1]) for r in odd_rows()) * 10 // 100


def test_resampling_query_equals_brute_force(spark):
    docs, target = rows_of(spark), rows_of(spark, "benchmark")
    out, drawn = brute_draw(docs, target, 10, 20, 2024)
    got = queries.QUERIES["op11_importance_resampling"](spark, SF).collect()
    assert seen(r[:4] for r in got) == seen((r[0], *r[2:]) for r in out)
    assert [r.doc_id for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [r[0] for r in drawn] != []


# Mixing


def brute_targets(sizes, weights=(1, 2, 3), share=1.0, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed = {}
    wanted = share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        now = {s: (wanted - sum(fixed.values())) * weight[s] / total for s in free}
        above = {s: most * sizes[s] for s in free if now[s] > most * sizes[s]}
        if not above:
            return {**fixed, **now}
        fixed.update(above)
        if len(fixed) == len(names):
            return fixed


def check_mix(rows, docs, share=1.0, weights=(1, 2, 3), most=3):
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    want = brute_targets(sizes, weights, share, most)
    taken, largest = Counter(), Counter()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((k, len(WORD.findall(t or "")), s) for k, t, s in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        each = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and math.floor(each + 1e-9) <= r.copies + (r.size == 0) and r.copies <= math.ceil(each - 1e-9) <= most
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size if r.size * 1000 <= r.source_size else 0)
    return {s: (taken[s], want[s], largest[s]) for s in sizes}


def corpus(n, r):
    out = []
    for k in range(n):
        size = min(int(r.lognormvariate(3, 1.2)), 2000)
        out.append((k, None if k % 50 == 0 else " ".join(["w"] * size), r.choice((None, "b", "é", "Z", "B", "B", "B", "B"))))
    return out


def test_mix_meets_targets_whole_and_again(spark):
    docs = corpus(6000, random.Random(2))
    docs += [(9000, "giant " * 30_000, "Z"), (9001, "giant " * 9_000, "b"), (9001, "giant " * 9_000, "b"), (None, "x y z", "b"), (None, "x y z", "b"),
             (9002, "alone " * 40, "q"), (9003, "\t \n", "empty")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))
    one = mixing.mix(table.repartition(3), (1, 2, 3)).collect()
    for source, (taken, target, largest) in check_mix(one, docs).items():
        if source not in ("q", "empty"):
            assert abs(taken - target) <= largest, source
    two = mixing.mix(table.repartition(7), (1, 2, 3)).collect()
    assert Counter(one) == Counter(two)
    other = mixing.mix(table, (1, 2, 3), seed=5).collect()
    assert Counter(one) != Counter(other)


def test_expected_copies_are_those_of_the_source(spark):
    docs = [(k, " ".join(["w"] * (1 + k % 9)), "a" if k % 3 else "b") for k in range(3600)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), (1, 4), share=0.9).collect()
    total, each = Counter(), {r.source: r.target / r.source_size for r in rows}
    for r in rows:
        total[r.source, r.size] += r.copies / 400
    for (source, size), got in total.items():
        assert got == pytest.approx(each[source], abs=0.1), (source, size)


def test_mix_of_odd_and_empty_tables(spark, odd, none):
    from .conftest import odd_rows
    docs = [(r[0], r[1], None) for r in odd_rows()]
    check_mix(mixing.mix(odd, (1, 2, 3)).collect(), docs)
    assert mixing.mix(none, (1, 2, 3)).count() == 0
    check_mix(mixing.mix(odd, (1,), share=10.0).collect(), docs, share=10.0, weights=(1,))


def test_mixing_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    by = {k: s for k, _, s in docs}
    rows = queries.QUERIES["op12_source_mixing"](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    rows = rows.collect()
    taken, largest, target = Counter(), Counter(), {}
    for r in rows:
        taken[by[r.doc_id]] += r.taken
        target[by[r.doc_id]] = r.target
        largest[by[r.doc_id]] = max(largest[by[r.doc_id]], r.size)
        assert r.taken <= 3 * r.size
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s] / 2) for s in target)


# Periodic runs


def brute_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - a + q >= max(6, 4 * q):
                best.setdefault((a - q, i - a + q), q)  # the smallest period of a stretch comes first
    return sorted((s, length, q) for (s, length), q in best.items())


def brute_collapse(words):
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force():
    r = random.Random(1)
    texts = ["", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "a " * 300, "a a b " * 90, ("a " * 100 + "b ") * 6, "aab aab " * 3]
    for _ in range(600):
        words, letters = [], "ab" if r.random() < 0.5 else "abcd"
        for _ in range(r.randint(1, 6)):
            block = [r.choice(letters) for _ in range(r.randint(1, 12))]
            words += (block * r.randint(1, 7))[:r.randint(1, 90)]
        texts.append(" ".join(words))
    for text, (n, runs, kept) in zip(texts, periodic.find(texts), strict=True):
        found, want = brute_collapse(text.split())
        assert (n, runs, kept.decode()) == (len(text.split()), found, want), text


def test_long_runs_take_little_time():
    texts = ["w " * 300_000, "a b c a b d " * 60_000, ("x " * 400 + "y ") * 300]
    got = list(periodic.find(texts))
    assert [g[1] for g in got[:2]] == [[(0, 300_000, 1)], [(0, 360_000, 6)]]
    assert (0, 300 * 401, 401) in got[2][1] and len(got[2][1]) == 301


def brute_query(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs, kept = brute_collapse(words)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (key, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_periodic_query_equals_brute_force(spark):
    docs = [d for d in rows_of(spark) if len((d[1] or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows_of(spark))
    want = [brute_query(*d) for d in docs]
    assert [got[w[0]] for w in want] == want and sum(w[1] > 0 for w in want) > 5


def test_periodic_runs_of_odd_rows(spark, odd, none):
    from .conftest import odd_rows
    docs = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 20_000]
    got = Counter(tuple(r) for r in periodic.digests(periodic.planted(odd)).collect())
    assert sum(got.values()) == len(odd_rows()) and all(got[brute_query(*d)] for d in docs)
    assert periodic.collapse(none).count() == 0
