"""Language ID, personal data, neighbours, tool calls and sharding."""

import json
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.llm import chat, langid, neighbours, pii, sharding

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = langid.fit(docs.filter(~langid.held_out()))
    rows = langid.predict(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    assert rows.filter("lang = lang_pred").count() >= 0.95 * rows.count()
    assert rows.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(odd, none):
    learned = langid.fit(odd)
    rows = {r.doc_id: r for r in langid.predict(odd, learned).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (0, 1, 2, 13))
    assert all(rows[k].lang_pred == "en" for k in (3, 9, 16, 17))
    assert langid.predict(none, learned).count() == 0 and langid.fit(none) == {}
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_trigrams():
    want = np.zeros(64)
    for a, b, c in (" Éa", "Éa ", "a é", " é "):
        code = [0 if x == " " else ord(x.lower()) for x in (a, b, c)]
        v = [langid.letter_vector(x, 64) for x in code]
        want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    got = langid.bundle(["Éa--é!", "zzz"], np.array([0, 1]), 2, 64)
    assert np.array_equal(got[0], want)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.%+-0149 ()\né", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_on_labelled_text():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for text, _ in pii.labelled_rows(300, 3):
        assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_rows(), rounds=60)


def test_field_on_held_out_sentences(model):
    test = pii.labelled_rows(300, 99)
    found = pii.field_spans([t for t, _ in test], model)
    hit = sum(len(set(g) & set(f)) for (_, g), f in zip(test, found, strict=True))
    assert hit >= 0.95 * sum(len(g) for _, g in test)
    assert sum(len(set(f) - set(g)) for (_, g), f in zip(test, found, strict=True)) <= 0.05 * hit


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    line = np.repeat(np.arange(6), [1, 3, 5, 2, 4, 1])
    emit, pair = r.normal(size=(len(line), 3)), r.normal(size=(3, 3))
    got = pii.viterbi(emit, line, pair)
    for k in range(6):
        own, e = got[line == k], emit[line == k]
        score = lambda p: sum(e[i, a] for i, a in enumerate(p)) + sum(pair[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(score(p) for p in np.ndindex(*[3] * len(e)))
        assert score(own.tolist()) == pytest.approx(best)


def test_labelled_table_runs_no_python_workers(spark):
    table = pii.labelled_table(spark, 50)
    assert table._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"
    assert [(r.text, [tuple(s) for s in r.spans]) for r in table.collect()] == pii.labelled_rows(50)


def test_personal_data_of_odd_rows(odd, none, model):
    rows = {r.doc_id: r for r in pii.detect(odd, model).collect()}
    assert rows[15].n_email == 1 and rows[15].base_spans == "email:5:28" == rows[15].spans
    assert rows[0].spans == rows[1].spans == ""
    assert pii.detect(none, model).count() == pii.replace(none, model).count() == 0
    new = {r.doc_id: r.text for r in pii.replace(odd, model).collect()}
    assert new[15] == "mail [EMAIL] now" and new[0] is None and new[3] == {r.doc_id: r.text for r in odd.collect()}[3]
    assert pii.redacted("ab 12 cd", [("card", 3, 5), ("phone", 4, 6)]) == "ab [CARD]cd"


def test_spans_at_every_cut_are_found(model):
    found = "x bora at lune dot com y"
    hit = [s for s in pii.field_spans([found], model)[0] if s[0] == "email"]
    assert hit
    words = "la lune verte " * 60_000
    for text in (words, words.replace(" verte la", "\nverte la")):
        for shift in range(0, 60, 3):
            for at in (pii.CHUNK, pii.CHUNK + pii.MARGIN):
                cut = text.rfind(" ", 0, at - shift) + 1
                whole = text[:cut] + found + " " + text[cut:]
                kind, a, b = hit[0]
                assert (kind, cut + a, cut + b) in pii._field([whole], model)[0], (shift, at)


def test_parts_own_every_character_once():
    texts = ["", "a", "x" * 50_000, "a b " * 20_000, ("a b " * 300 + "\n") * 40, "word\n" * 9000 + "y z " * 9000 + "\n" + "q" * 30_000 + " end"]
    for text in texts:
        parts = list(pii.parts_of(text, 10_000))
        at = 0
        for start, end, first, last in parts:
            assert start <= first == at <= last <= end
            assert start == 0 or text[start - 1].isspace()
            assert end == len(text) or text[end - 1].isspace()
            at = last
        assert at == len(text)


def brute_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        score = sorted((-float((np.array(rows[q], np.float64) * np.array(v, np.float64)).sum()), i) for i, v in rows.items() if i != q)
        out[q] = [i for _, i in score[:k]]
    return out


@needs_tables
def test_neighbours_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in e.collect()}
    want = brute_neighbours(rows, [i for i in rows if i % 20 == 0], 20)
    got: dict = {}
    found = neighbours.search(e, F.col("vec_id") % 20 == 0, leaf=64).collect()
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        a, b = (np.array(rows[x], np.float64) for x in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(float((a * b).sum()), abs=1e-12)
    assert sum(len(set(want[q]) & set(got[q].values())) for q in want) >= 0.9 * 20 * len(want)
    assert all(sorted(v) == list(range(1, 21)) for v in got.values())


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [(k, [1.0, 2.0]) for k in range(100, 160)]
    rows = [(0, [1.0, 0.0]), (20, [0.0, 3.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]), (8, [-1.0, -1.0]), *same, same[0]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20, leaf=8, leaf_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    good = {k: v for k, v in rows if k is not None and v and len(v) == 2 and k not in (3, 4, 5, 6)}
    want = brute_neighbours(good, [0, 20, 100, 120, 140], 20)
    assert got[100] == want[100] and got[120] == want[120] and set(got) == set(want)
    empty = neighbours.search(df.filter("vec_id = 1"), F.lit(True))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.search(df.filter("vec_id = 0"), F.lit(True)).count() == 0


def vectors_of(kind, r, n=3000, d=12):
    if kind == "one":
        base = r.normal(size=d)
        return np.where(r.random((n, 1)) < 0.8, base, r.normal(size=(n, d)))
    sizes = np.full(30, 1 / 30) if kind == "clusters" else 1 / np.arange(1, 31) / (1 / np.arange(1, 31)).sum()
    centres = r.normal(size=(30, d)) * 4
    return centres[r.choice(30, n, p=sizes)] + r.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["clusters", "zipf", "one"])
def test_recall_of_each_query(spark, kind):
    r = np.random.default_rng(8)
    rows = {k: v.tolist() for k, v in enumerate(vectors_of(kind, r))}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>").repartition(4).withColumn("tree", F.lit(1)).withColumn("v", F.lit(2))
    want = brute_neighbours(rows, [k for k in rows if k % 20 == 0], 20)
    got: dict = {}
    for x in neighbours.search(df, F.col("vec_id") % 20 == 0, leaf=128, sample=600, leaf_rows=50, leaf_queries=20).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x.vec_id
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    share = [len(set(want[q]) & set(got[q].values())) / 20 for q in want]
    assert np.mean(share) >= 0.9 and np.mean(np.array(share) < 0.9) <= 0.1


def test_a_repeated_id_counts_by_its_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (20, [5.0, 1.0]), (20, [-5.0, 1.0]), (20, [5.0, 1.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in neighbours.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (1, 0.5), (0, 2): (2, -1.0), (0, 3): (20, -5.0), (20, 1): (2, 5.0), (20, 2): (1, -2.0), (20, 3): (0, -5.0)}


CALLS = "conv_id bigint, call_id string, tool string, arguments string, after array<string>, content string"
RESULTS = "conv_id bigint, call_id string, seq bigint, content string, tool string"
TOOLS = "tool string, param string, type string, required boolean, minimum double"


def linked(spark, calls, results, tools):
    rows = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(tools, TOOLS)).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


def test_tool_calls(spark):
    tools = [("add", "a", "integer", True, 0.0), ("add", "b", "number", False, None), ("say", "t", "string", True, None)]
    calls = [
        (1, "z", "add", '{"b": 1.5, "a": 3}', [], None), (1, "a", "say", '{"t":"x \\"y\\" \\n é"}', ["m", "gone"], None), (1, "m", "add", '{"a":-1}', ["z", "z"], None),
        (1, "m", "add", '{"a":-1}', ["z", "z"], None), (2, "p", "add", '{"a":"1","c":{"z":1,"b":[true,null]}}', ["q"], None), (2, "q", "say", "{}", ["p"], None),
        (2, "r", "none", "[1]", None, None), (2, "s", "add", "not json", ["r"], None), (None, "x", "add", "{}", None, None), (3, "x", None, None, None, None)]
    results = [(1, "z", 2, "late", None), (1, "z", 1, "first", None), (9, "z", 1, "lost", None), (1, "a", 1, None, None)]
    got = linked(spark, calls, results, tools)
    assert len(got) == 8
    assert [(got[1, c].position, got[1, c].level) for c in "zma"] == [(0, 0), (1, 1), (2, 2)]
    assert got[1, "z"].message == '{"arguments":{"a":3,"b":1.5},"call_id":"z","name":"add","result":"first"}' and got[1, "z"].valid
    assert json.loads(got[1, "a"].message) == {"arguments": {"t": 'x "y" \n é'}, "call_id": "a", "name": "say", "result": None} and got[1, "a"].answered
    assert got[1, "m"].problems == "a: too small" and not got[1, "m"].answered
    assert got[2, "p"].problems == "a: not integer; c: unknown; order: cycle" and got[2, "p"].level is None and got[2, "p"].position == 2
    assert '"c":{"b":[true,null],"z":1}' in got[2, "p"].message
    assert got[2, "q"].problems == "order: cycle; t: missing"
    assert got[2, "r"].problems == "tool: unknown" and got[2, "s"].problems == "arguments: not an object"
    assert got[2, "s"].message.startswith('{"arguments":"not json"') and got[3, "x"].tool == ""
    assert linked(spark, [], [], []) == {}


def test_shards_fill_the_table_in_turns():
    shards, slots = ["c", "a", "b"], 13
    table = sharding.fill(shards, slots)
    names = np.array(shards)[table]
    assert sorted(np.bincount(table).tolist()) == [4, 4, 5]
    import hashlib
    want: dict[int, str] = {}
    order = {}
    for n in sorted(shards):
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order[n] = [(offset + j * skip) % slots for j in range(slots)]
        assert sorted(order[n]) == list(range(slots))
    while len(want) < slots:
        for n in sorted(shards):
            if len(want) < slots:
                want[next(s for s in order[n] if s not in want)] = n
    assert [want[k] for k in range(slots)] == names.tolist()
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, slots)
    with pytest.raises(ValueError):
        sharding.fill(shards, 12)


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{k}" for k in range(20)]
    a, b = sharding.fill(shards), sharding.fill(shards[:-1])
    moved = ((a != b) & (a != 19)).mean()
    assert moved < 0.05


def test_placement(spark, odd, none):
    shards = ["x", "y", "z"]
    rows = sharding.place(odd, shards).collect()
    table = sharding.fill(shards)
    import hashlib
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    assert len(rows) == odd.count() and sharding.place(none, shards).count() == 0
    plan = sharding.place(odd, shards)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
