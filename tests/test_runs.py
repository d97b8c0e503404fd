"""Usage, forecast, retrieval, incremental, history and streams against literal rows and brute force."""

import datetime as dt
import hashlib
import math
import pathlib
import random
import re
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidex.operators import history as H
from evidex.operators import incremental as V
from evidex.operators import retrieval as X
from evidex.operators import usage as U
from evidex.session import ensure_checkpoint_dir, scratch
from evidex.sources import sinks
from evidex.sources.eventlog import EventLog
from evidex.streaming import live, stateful


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_costs(spark):
    usage = df(spark, "model string, requests long, prompt long, completion long, cache_read long, cache_write long",
               ("anthropic/big-4-5-20251001", 1, 1_000_000, 100_000, 1_000_000, 1_000_000), ("us.small", 2, 500_000, 0, 0, 0), ("mock", 1, 9, 9, 9, 9), ("mystery", 1, 5, 5, 0, 0))
    prices = df(spark, "model string, input double, output double", ("big-4-5", 3.0, 15.0), ("small", 1.0, 5.0))
    over = df(spark, "model string, input double, output double", ("small", 2.0, 2.0))
    c = U.cost_by_model(usage, prices, over)
    assert {r["model"]: (r["key"], r["usd"]) for r in c.collect()} == {
        "anthropic/big-4-5-20251001": ("big-4-5", 3.0 + 1.5 + 0.3 + 3.75), "us.small": ("small", 1.0), "mock": ("mock", None), "mystery": ("mystery", None)}
    r = U.cost_report(c).first()
    assert (r["total_usd"], r["priced"], r["n_unpriced"]) == (9.55, False, 1)
    assert U.cost_report(c.filter("model <> 'mystery'")).first()["priced"] is True


def test_cap_admits_the_call_in_flight(spark):
    calls = df(spark, "run string, seq int, usd double", ("a", 0, 4.0), ("a", 1, None), ("a", 2, 7.0), ("a", 3, 1.0), ("b", 0, 10.0), ("b", 1, 0.1))
    got = {(r["run"], r["seq"]): (float(r["spent_before"]), r["admitted"]) for r in U.cap_cutoff(calls, 10).collect()}
    assert got == {("a", 0): (0, True), ("a", 1): (4, True), ("a", 2): (4, True), ("a", 3): (11, False), ("b", 0): (0, True), ("b", 1): (10, False)}


RATES = {"cheap": (1.0, 5.0), "frontier": (5.0, 25.0)}


def totals(spark, n, t, layer="Service", done=0, **kw):
    c = spark.range(n).select(F.lit("g").alias("g"), F.lit(1800).cast("long").alias("n_chars"), F.lit(layer).alias("layer"), (F.col("id") < done).alias("done"))
    s = U.forecast_sizes(c, ["g"]).withColumn("n_targets", F.lit(max(0, t - done)).cast("long"))
    st = U.forecast_stages(s, ["g"], RATES, critic=kw.pop("critic", True))
    return U.forecast_totals(s, st, ["g"], RATES, **kw).first(), {r["stage"]: r for r in st.collect()}


def test_forecast(spark):
    f, stages = totals(spark, 20, 12)
    assert f["cost_high"] > f["cost_low"] > 0 and stages["comprehend"]["tier"] == "cheap" and stages["generate"]["tier"] == "frontier"
    assert stages["plan"]["calls"] == 6 and stages["comprehend"]["tokens_in"] == 20 * (1800 + 1400) // 4
    assert stages["generate"]["tokens_out_low"] == int(12 * 8000 * 0.3)
    part, _ = totals(spark, 100, 60, done=90)
    full, _ = totals(spark, 100, 60)
    assert part["cost_high"] < full["cost_high"] / 3 and part["review_high"] < full["review_high"] / 3
    assert totals(spark, 50, 30)[0]["review_high"] > totals(spark, 50, 30, layer="DAO")[0]["review_high"]
    slow, fast = totals(spark, 60, 40, concurrency=1)[0], totals(spark, 60, 40)[0]
    assert fast["minutes_high"] < slow["minutes_high"] and fast["cost_high"] == slow["cost_high"]
    off, st = totals(spark, 20, 12, critic=False)
    assert "critic" not in st and off["cost_high"] < f["cost_high"]
    assert totals(spark, 20, 12, cap=f["cost_low"])[0]["may_exceed"] and not totals(spark, 20, 12, cap=1000.0)[0]["will_exceed"]
    assert f["will_exceed"] is None


def test_call_log(spark):
    key = U.content_key(F.col("stage"), F.lit("p"), F.lit("m"), F.col("prompt"))
    log = df(spark, "seq int, stage string, prompt string, model string, prompt_chars int", (2, "plan_B", "x", "m2", 1), (0, "plan_B", "x", "m1", 1), (1, "gen", "x", "m1", 1)).withColumn("key", key)
    c = U.content_key_cache(log)
    assert {r["seq"]: r["cached"] for r in c.collect()} == {0: False, 1: False, 2: True}
    assert log.filter("seq = 0").first()["key"] == hashlib.sha256(b"plan_B|p:m|x").hexdigest()
    got = {r["stage"]: (r["calls"], r["cached"], r["models"], r["chars"]) for r in U.call_replay_summary(c).collect()}
    assert got == {"plan": (2, 1, ["m1", "m2"], 2), "gen": (1, 0, ["m1"], 1)}


def test_routing(spark):
    s = df(spark, "stage string", ("comprehend_A",), ("generate_B",), ("whatever",), ("critic",))
    on = {r["stage"]: (r["family"], r["model"]) for r in U.route_tier(s, {"cheap": "small"}, "base").collect()}
    assert on == {"comprehend_A": ("comprehend", "small"), "generate_B": ("generate", "base"), "whatever": ("generate", "base"), "critic": ("critic", "base")}
    assert {r["model"] for r in U.route_tier(s, {"cheap": "small"}, "base", enabled=False).collect()} == {"base"}


def test_chunks(spark):
    text = "intro\n# Title\nlead\n## One \n a\n# Renamed\nb\n## Empty\n\n## Two\nc"
    d = df(spark, "doc_id long, doc string, stem string, text string", (1, "n.md", "n", text), (2, "m.md", "m", "only body"))
    got = [(r["doc"], r["heading"], r["body"]) for r in X.chunk_by_heading(d).orderBy("chunk_id").collect()]
    assert got == [("n.md", "Title", "intro\nlead"), ("n.md", "Renamed", "a\nb"), ("n.md", "Two", "c"), ("m.md", "m", "only body")]


def test_tfidf_matches_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the", "and", "x"]
    chunks = [(i, "h", " ".join(rnd.choices(words, k=rnd.randrange(0, 25)))) for i in range(60)] + [(60, "h", "W1 w1-w2"), (61, "h", "W1 w1-w2")]
    queries = [(q, " ".join(rnd.choices(words, k=5))) for q in range(12)]
    tok = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1 and w not in X.R.SEARCH_STOP_WORDS]
    tf = {c: Counter(tok(h + " " + b)) for c, h, b in chunks}
    dfs = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in dfs.items()}
    norm = {c: math.sqrt(sum((n * idf[t]) ** 2 for t, n in x.items())) or 1.0 for c, x in tf.items()}
    want = {}
    for q, text in queries:
        w = {t: n * idf.get(t, 0.0) for t, n in Counter(tok(text)).items()}
        qn = math.sqrt(sum(v * v for v in w.values())) or 1.0
        s = [(-round(sum(v * tf[c][t] * idf.get(t, 0.0) for t, v in w.items()) / (qn * norm[c]), 9), c) for c in tf]
        want[q] = [c for v, c in sorted(s) if v < 0][:3]
    cdf = df(spark, "chunk_id long, heading string, body string", *chunks).withColumn("doc", F.lit("d.md"))
    hits = X.tfidf_topk(df(spark, "query_id long, text string", *queries), cdf)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == {q: c for q, c in want.items() if c}
    text = {r["query_id"]: r["text"] for r in X.grounding_text(hits, cdf, "Notes").collect()}
    q = next(iter(got))
    assert text[q].startswith("== Notes ==\n\n[d.md · h]\n" + dict((c, b) for c, _, b in chunks)[got[q][0]])


def test_jaccard_and_scorecard(spark):
    p = X.token_jaccard(df(spark, "a string, b string", ("foo bar baz", "bar baz qux"), ("", "a1"), ("same it", "same it")))
    assert [r["score"] for r in p.collect()] == [0.5, 0.0, 1.0] and X.jaccard_mean(p).first()["similarity"] == 0.5
    issues = df(spark, "file string, rule string, severity string", ("a", "x", "ERROR"), ("a", "y", "ERROR"), ("b", "unknown_field", "WARNING"))
    made = df(spark, "file string, target string", ("a", "A"), ("b", "B"), ("aTest", None))
    r = X.scorecard(issues, df(spark, "target string", ("A",), ("C",)), made).first()
    assert (r["files_total"], r["pass_rate"], r["schema_violations"], r["coverage"], r["missing"]) == (3, 0.667, 1, 0.5, 1)
    empty = X.scorecard(issues, df(spark, "target string", ("A",)).filter("false"), made).first()
    assert empty["coverage"] == 1.0


def test_fingerprints(spark):
    hashes = lambda x: df(spark, "class_name string, hash string", ("A", "1"), ("B", x), ("C", "3"))
    plan = df(spark, "target string, kind string", ("T", "Convert"), ("U", "Convert"))
    own = df(spark, "target string, class_name string", ("T", "A"), ("U", "C"))
    deps = df(spark, "target string, class_name string", ("T", "B"), ("T", "A"))
    fp = lambda h, recipe="r": {r["target"]: r["fingerprint"] for r in V.target_fingerprint(plan, own, deps, h, F.lit(recipe), ["kind"]).collect()}
    a, b, c = fp(hashes("2")), fp(hashes("9")), fp(hashes("2"), "other")
    assert a["T"] != b["T"] and a["U"] == b["U"] and a["T"] != c["T"] and a == fp(hashes("2"))
    new = df(spark, "target string, fingerprint string", ("same", "f"), ("changed", "g"), ("fresh", "h"), ("empty", "i"), ("recipe", "j"))
    state = df(spark, "target string, fingerprint string, result string, recipe string, version int", ("same", "f", "x", "r", 1), ("changed", "f", "x", "r", 1),
               ("empty", "i", None, "r", 1), ("recipe", "j", "x", "old", 1))
    d = {r["target"]: r["decision"] for r in V.reuse_or_rebuild(new, state, F.lit("r")).collect()}
    assert d == {"same": "reuse", "changed": "rebuild", "fresh": "rebuild", "empty": "rebuild", "recipe": "rebuild"}


def test_a_change_two_levels_down_forces_a_rebuild(spark):
    hashes = lambda x: df(spark, "class_name string, hash string", ("A", "1"), ("B", "2"), ("C", x), ("D", "4"))
    plan = df(spark, "target string, kind string", ("T", "Convert"), ("U", "Convert"))
    own = df(spark, "target string, class_name string", ("T", "A"), ("U", "D"))
    deps = df(spark, "target string, class_name string", ("T", "B"))
    edges = df(spark, "src string, dst string", ("A", "B"), ("B", "C"), ("C", "A"))
    every = V.transitive_deps(own, deps, edges)
    assert sorted(map(tuple, every.collect())) == [("T", "A"), ("T", "B"), ("T", "C")]
    fp = lambda x: V.target_fingerprint(plan, own, every, hashes(x), F.lit("r"), ["kind"])
    state = fp("3").select("target", "fingerprint", F.lit("code").alias("result"), F.lit("r").alias("recipe"), F.lit(1).alias("version"))
    decide = lambda x: {r["target"]: r["decision"] for r in V.reuse_or_rebuild(fp(x), state, F.lit("r")).collect()}
    assert decide("3") == {"T": "reuse", "U": "reuse"} and decide("9") == {"T": "rebuild", "U": "reuse"}


def test_fingerprints_shuffle_wide_rows_once(spark):
    """Own classes win over the same dependency, also for a target with many; one exchange carries the items."""
    plan = df(spark, "target string, kind string", ("T", "Convert"), ("U", "Convert"))
    own = spark.range(2000).selectExpr("if(id < 1500, 'T', 'U') target", "concat('C', id % 1000) class_name")
    hashes = spark.range(1000).selectExpr("concat('C', id) class_name", "md5(string(id)) hash")
    fp = lambda deps: V.target_fingerprint(plan, own, deps, hashes, F.lit("r"), ["kind"])
    none, same = own.limit(0), own.filter("target = 'T'")
    assert sorted(map(tuple, fp(none).collect())) == sorted(map(tuple, fp(same.unionByName(same)).collect()))
    more = df(spark, "target string, class_name string", ("T", "C1200"), ("U", "C3"))
    assert {r["target"] for r in fp(more).exceptAll(fp(none)).collect()} == {"T", "U"}
    text = fp(more)._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning(target" in line and "class_name" in line for line in text.splitlines())


def test_the_query_reuses_by_all_levels(spark):
    from types import SimpleNamespace

    from evidex.plans import runs

    def tables(name):
        return SimpleNamespace(
            lineitem=df(spark, "l_orderkey bigint, l_partkey bigint", (1, 345), (2, 78)), orders=df(spark, "o_orderkey bigint, o_orderpriority string, o_orderstatus string", (1, "x", "F"), (2, "x", "F")),
            part=df(spark, "p_partkey bigint, p_name string", (345, "a"), (34, "b"), (3, name), (78, "d"), (7, "e")))

    old, new = ({r["target"]: r["fingerprint"] for r in runs.fingerprints(tables(n)).collect()} for n in ("c", "changed"))
    assert old[1] != new[1] and old[2] == new[2]


def test_prefix_and_source_fingerprint(spark):
    d = df(spark, "domain string, pos int, changed boolean", ("a", 0, False), ("b", 1, True), ("c", 2, False), ("d", 3, False))
    assert {r["domain"]: r["reuse"] for r in V.prefix_invalidation(d).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert all(r["reuse"] for r in V.prefix_invalidation(d.withColumn("changed", F.lit(False))).collect())
    c = df(spark, "class_name string, source string", ("A", "x"), ("B", "y"))
    one = V.source_fingerprint(c).first()[0]
    assert one == V.source_fingerprint(c.orderBy(F.desc("class_name"))).first()[0] and len(one) == 16
    assert one != V.source_fingerprint(c.withColumn("source", F.lit("x"))).first()[0]


def test_snapshot_diffs(spark, tmp_path):
    s = "target string, target_kind string, recommendation string"
    a, b = df(spark, s, ("A", "Convert", ""), ("B", "Convert", "CPQ"), ("C", "Skip", "")), df(spark, s, ("A", "Skip", ""), ("B", "Convert", "CPQ"), ("D", "Convert", ""))
    assert {tuple(r) for r in V.snapshot_plan_diff(a, b).collect()} == {("A", "changed", "Convert", "Skip"), ("C", "removed", "Skip", None), ("D", "added", None, "Convert")}
    s = "target string, main_text string, test_text string, status string"
    x, y = df(spark, s, ("A", "1", "t", "ok"), ("B", "1", "t", "ok"), ("C", "1", "t", "ok"), ("E", "1", None, "ok")), df(
        spark, s, ("A", "2", "t", "ok"), ("B", "1", "t", "error"), ("D", "1", "t", "error"), ("E", "1", "", "ok"))
    assert {tuple(r)[:2] for r in V.snapshot_artifact_diff(x, y).collect()} == {("A", "regenerated"), ("B", "status"), ("C", "gone"), ("D", "new")}
    r = V.snapshot_summary(a, b, x, y).first()
    assert (r["plan_changed"], r["artifacts_changed"], r["convert_delta"], r["failed_delta"]) == (3, 4, 0, 2)
    ids = [sinks.write_snapshot({"plan": p}, str(tmp_path), 1_700_000_000_000, note="n") for p in (a, b)]
    assert ids[1] == ids[0] + "-1"
    got = spark.read.parquet(f"{tmp_path}/plan").groupBy("snapshot_id").count().collect()
    assert {r["snapshot_id"]: r["count"] for r in got} == {ids[0]: 3, ids[1]: 3}


T0 = dt.datetime(2024, 1, 1, 23, 59, 50)


def run_events(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", 0, at(0), "start", "p0"), ("a", 1, at(5), "x", "p1"), ("a", 2, at(40.126), "run_complete", "p2"), ("a", 3, at(41), "x", "p3"),
            ("b", 4, at(3), "start", "q"), ("b", 5, at(3), "run_complete", "r"), ("b", 6, at(9), "run_complete", "s")]
    return df(spark, "run string, event_id int, ts timestamp, type string, payload string", *rows)


def test_history(spark):
    e = run_events(spark)
    got = {r["event_id"]: (r["seq"], r["elapsed"]) for r in H.event_sequence(e).collect()}
    assert got == {0: (0, 0.0), 1: (1, 5.0), 2: (2, 40.13), 3: (3, 41.0), 4: (0, 0.0), 5: (1, 0.0), 6: (2, 6.0)}
    assert {r["run"]: (r["result"], r["event_count"]) for r in H.latest_result(e).collect()} == {"a": ("p2", 4), "b": ("s", 3)}
    assert {r["event_id"] for r in H.tail_events(e, 2).collect()} == {2, 3, 5, 6}
    gaps = [(r["run"], (r["end"] - r["start"]).total_seconds(), r["beats"]) for r in H.idle_gaps(e).collect()]
    assert gaps == [("a", 35.126, 3)]
    saves = df(spark, "run string, n int, state string", ("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only"))
    assert {r["run"]: r["state"] for r in H.upsert_latest(saves, "run", ["n"]).collect()} == {"a": "new", "b": "only"}


def test_run_tables(spark):
    runs = df(spark, "run string, status string, error string, finished long, owner string, started int, summary_status string, summary_error string",
              ("a", "running", None, None, "me", 1, "complete", ""), ("b", "queued", "boom", None, None, 2, "x", "mine"), ("c", "complete", None, 5, "you", 3, "x", None))
    m = {r["run"]: (r["status"], r["error"], r["finished"], r["changed"]) for r in H.mark_interrupted(runs, F.lit(9).cast("long")).collect()}
    assert m == {"a": ("interrupted", H.R.INTERRUPTED_ERROR, 9, True), "b": ("interrupted", "boom", 9, True), "c": ("complete", None, 5, False)}
    assert [(r["run"], r["status"], r["error"]) for r in H.history_page(runs, 2).collect()] == [("c", "complete", None), ("b", "queued", "mine")]
    assert [r["run"] for r in H.history_page(runs, 5, "me").collect()] == ["a"]
    assert {r["run"] for r in H.tenant_filter(runs, "me").collect()} == {"a", "b"} and H.tenant_filter(runs).count() == 3
    live_ = df(spark, "run string, v int", ("a", 1))
    both = H.live_and_history(live_, df(spark, "run string, v int", ("a", 0), ("z", 0)))
    assert {(r["run"], r["v"], r["part"]) for r in both.collect()} == {("a", 1, 0), ("z", 0, 1)}
    q = df(spark, "run string, at int, status string", ("x", 3, "queued"), ("y", 1, "queued"), ("z", 0, "running"))
    assert {r["run"]: r["position"] for r in H.queue_position(q, ["at", "run"]).collect()} == {"y": 1, "x": 2, "z": 0}


@pytest.fixture()
def event_files(spark, tmp_path):
    rnd = random.Random(11)
    rows = [("hot" if i % 3 == 0 else f"r{i % 4}", i, T0 + dt.timedelta(seconds=i * 4), "run_complete" if i > 295 else "x", f"p{i}", float(rnd.randrange(0, 50)) if i % 7 else None)
            for i in range(300)]
    schema = "run string, seq int, ts timestamp, type string, payload string, usd double"
    for n in (2, 0, 1):  # files arrive out of order
        df(spark, schema, *rows[n * 100:(n + 1) * 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, schema, str(tmp_path / "in")


def test_streams_equal_their_batch_twins(spark, event_files):
    rows, schema, folder = event_files
    struct = spark.read.parquet(folder).schema
    source = lambda: live.event_source(spark, folder, struct, files_per_trigger=1)
    out = scratch(spark, "test")
    live.live_event_stream(source(), f"{out}/log", f"{out}/ck1").awaitTermination()
    assert spark.read.parquet(f"{out}/log").count() == 300
    live.live_event_stream(source(), f"{out}/log", f"{out}/ck1").awaitTermination()
    assert spark.read.parquet(f"{out}/log").count() == 300, "a restart must not repeat events"
    live.spend_log(source(), f"{out}/spend", f"{out}/ck2").awaitTermination()
    meter = live.spend_meter(spark.read.parquet(f"{out}/spend"), 400)
    got = {(r["run"], r["seq"]): (float(r["spent_before"]), r["admitted"]) for r in meter.collect()}
    want = {(r["run"], r["seq"]): (float(r["spent_before"]), r["admitted"]) for r in U.cap_cutoff(
        df(spark, schema, *rows), 400).collect()}
    assert got == want
    latch = {r["run"]: r["refused_from"] for r in live.latched_at(meter).collect()}
    assert latch["hot"] == min(s for (r, s), v in want.items() if r == "hot" and not v[1])
    saves = source().select("run", "seq", "payload")
    live.upsert_sink(saves, f"{out}/up", f"{out}/ck3", "run", ["seq"]).awaitTermination()
    last = {r["run"]: r["payload"] for r in H.upsert_latest(spark.read.parquet(f"{out}/up"), "run", ["seq"]).collect()}
    assert last == {run: max((s, p) for r, s, _, _, p, _ in rows if r == run)[1] for run in last}


def test_run_ends_stream(spark, event_files):
    _, _, folder = event_files
    struct = spark.read.parquet(folder).schema
    q = (live.run_ends(live.event_source(spark, folder, struct)).writeStream.format("memory").queryName("ends")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["run"]: (r["events"], r["ended"]) for r in spark.table("ends").collect()}
    assert sum(n for n, _ in got.values()) == 300 and got["hot"] == (100, 1)


def numbered_calls(spark, folder, files, rnd):
    """Calls of six runs in files that hold them out of order; the run "hot" has a third of them."""
    rows = []
    for run, n in (("hot", 200), ("a", 90), ("b", 1), ("c", 150), ("d", 60), ("open", 99)):
        for seq in range(n):
            rows.append((run, seq, None if rnd.random() < 0.2 else rnd.randrange(0, 900) / 100, seq == n - 1 and run != "open", "x", f"{run}{seq}"))
    rnd.shuffle(rows)
    schema = "run string, seq int, usd double, ends boolean, type string, payload string"
    for k in range(files):
        df(spark, schema, *rows[k::files]).coalesce(1).write.mode("append").parquet(folder)
    return rows, spark.read.parquet(folder).schema


def test_live_spend_meter_latches_in_any_order_of_arrival(spark, tmp_path):
    rows, schema = numbered_calls(spark, f"{tmp_path}/in", 6, random.Random(7))
    calls = live.event_source(spark, f"{tmp_path}/in", schema, files_per_trigger=1)
    before = spark.conf.get(stateful.PROVIDER, None)
    stateful.live_spend_meter(calls, 300, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.conf.get(stateful.PROVIDER, None) == before
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    spent, want = Counter(), {}
    for run, seq, usd, *_ in sorted(rows):
        want[run, seq] = (round(spent[run] / 100, 2), spent[run] < 30_000)
        spent[run] += round((usd or 0) * 100)
    assert {(r["run"], r["seq"]): (float(r["spent_before"]), r["admitted"]) for r in got} == want and len(got) == len(rows)
    assert {r["run"] for r in got if not r["admitted"]} >= {"hot", "c"}
    # State of the ended runs is gone: only the open run still has a place.
    state = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "place").load()
    assert [r["key"]["run"] for r in state.select("key").collect()] == ["open"]
    late = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "early").load()
    assert late.count() == 0


class FakeState:
    """A value and a map of a processor, with the number of times they are asked."""

    def __init__(self):
        self.value, self.entries, self.asked = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def _ask(self, got=None):
        self.asked += 1
        return got

    def get(self):
        return self._ask(self.value)

    def exists(self):
        return self._ask(self.value is not None)

    def update(self, value):
        self.value = self._ask(value)

    def clear(self):
        self.value, self.entries = self._ask(), {}

    def getValue(self, key):
        return self._ask(self.entries.get(key))

    def containsKey(self, key):
        return self._ask(key in self.entries)

    def updateValue(self, key, value):
        self.entries[key] = self._ask(value)

    def removeKey(self, key):
        self.entries.pop(self._ask(key))


def test_waiting_rows_are_stored_by_block_not_one_by_one(monkeypatch):
    state, meter, rnd = FakeState(), stateful.SpendMeter(10**9), random.Random(11)
    meter.init(state)
    rows = [Row(seq=k, ends=k == 2499, micros=None if k % 7 == 0 else k) for k in range(2500)]
    deal = rows[1:]
    rnd.shuffle(deal)
    got = list(meter.handleInputRows(("r",), iter(deal[:1200]), None))
    got += list(meter.handleInputRows(("r",), iter(deal[1200:] + deal[:5]), None))
    assert not got and len(state.entries) == 3 and state.asked < 20, "three blocks wait, whatever the number of rows"
    got = list(meter.handleInputRows(("r",), iter(rows[:1]), None))
    assert [r.seq for r in got] == list(range(2500)) and state.value is None and not state.entries and state.asked < 35
    # Small frames and blocks, many batches: the same answer.
    monkeypatch.setattr(stateful, "FRAME", 7)
    monkeypatch.setattr(stateful, "BLOCK", 5)
    state.asked, deal, got = 0, rows[:300], []
    rnd.shuffle(deal)
    for k in range(0, 300, 20):
        got += meter.handleInputRows(("r",), iter(deal[k:k + 20] + deal[:3]), None)
    spent = [0]
    for r in rows[:300]:
        spent.append(spent[-1] + (r.micros or 0))
    assert [(r.seq, r.spent_before) for r in got] == list(enumerate(spent[:-1])) and not state.entries


def test_readers_with_different_starts_end_by_themselves(spark, tmp_path):
    folder, parts = f"{tmp_path}/in", []
    rows, schema = numbered_calls(spark, f"{tmp_path}/all", 1, random.Random(3))
    rows = [r for r in rows if r[0] != "open"]
    after = [("a", seq, None, False, "x", f"late{seq}") for seq in range(90, 95)]  # behind the end
    for k in range(4):
        parts.append(spark.createDataFrame(rows[k::4] + (after if k == 1 else []), schema).coalesce(1))
    runs = df(spark, "run string", *[(r,) for r in {r[0] for r in rows}])
    source = lambda files: lambda: live.event_source(spark, folder, schema, files_per_trigger=files)
    parts[0].write.parquet(folder)
    with ThreadPoolExecutor(2) as pool:
        early = pool.submit(stateful.follow, source(1), runs, f"{tmp_path}/early", f"{tmp_path}/ck1", 0.5, 240)
        time.sleep(3)
        assert not early.done()
        for p in parts[1:3]:
            p.write.mode("append").parquet(folder)
        late = pool.submit(stateful.follow, source(5), runs, f"{tmp_path}/late", f"{tmp_path}/ck2", 0.5, 240)
        parts[3].write.mode("append").parquet(folder)
        assert early.result() and late.result()
    read = lambda name: sorted((r["run"], r["seq"], r["payload"]) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert read("early") == read("late") == sorted((r[0], r[1], r[5]) for r in rows)
    assert stateful.follow(source(5), df(spark, "run string", ("never",)), f"{tmp_path}/none", f"{tmp_path}/ck3", 0.1, 0) is False


def test_beats_of_a_run_that_never_speaks_again(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    gone, slow, lively = [("gone", at(0)), ("gone", at(4))], [("slow", at(3)), ("slow", at(48))], [("lively", at(s)) for s in range(0, 400, 5)]
    batches = [gone + slow[:1] + lively[:8], slow[1:] + lively[8:20], lively[20:50], lively[50:]]
    folder, schema, sizes = f"{tmp_path}/in", "run string, ts timestamp", []
    for rows in batches:
        random.Random(len(rows)).shuffle(rows)
        df(spark, schema, *rows).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        stateful.live_beats(events, f"{tmp_path}/out", f"{tmp_path}/ck", beat=10, watermark="20 seconds", give_up=120).awaitTermination()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "said").load()
        sizes.append({r["key"]["run"] for r in state.select("key").collect()})
    said = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r["beats"] for r in sorted((r for r in said if r["run"] == "gone"), key=lambda r: r["beats"])][-1] == 12
    assert all(r["end"] is None and r["start"] == at(4) for r in said if r["run"] == "gone")
    assert len([r for r in said if r["run"] == "gone"]) > 1, "beats come while the run is silent"
    closed = [(r["run"], r["beats"], r["end"]) for r in said if r["end"] is not None]
    assert closed == [("slow", 4, at(48))]
    assert not [r for r in said if r["run"] == "lively"]
    assert "gone" in sizes[1] and sizes[-1] == {"lively"}


def test_event_log_stays_bounded_and_reads_whole_versions(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), keep=20, fan=3)
    schema = "run string, event_id bigint, ts timestamp, state string"
    want, held = {}, []
    with pytest.raises(ValueError):
        log.read()
    for save in range(14):
        rows = [(run, save * 10 + k, T0 + dt.timedelta(seconds=save * 10 + k), f"s{save}") for run in ("a", "b") for k in range(10)]
        if save:  # events of the save before are saved again
            rows += [(run, save * 10 - 1, T0 + dt.timedelta(seconds=save * 10 - 1), f"again{save}") for run in ("a", "b")]
        want.update({(r[0], r[1]): r for r in rows})
        before, files = log.versions(), log.folders() if save else []
        reader = log.read() if save else None
        log.append(df(spark, schema, *rows).coalesce(1))
        if reader is not None:  # merged meanwhile, its version is still whole
            assert reader.count() == min(save * 20, 40)
        log.vacuum(len(log.versions()) - len(before) + 1)
        held.append(sum(1 for _ in (tmp_path / "log" / "data").iterdir()))
        newest = sorted(want.values(), key=lambda r: (r[0], -r[1]))
        newest = [r for run in ("a", "b") for r in [x for x in newest if x[0] == run][:20]]
        assert sorted(map(tuple, log.read().select("run", "event_id", "ts", "state").collect())) == sorted(newest)
    assert max(held[6:]) <= 9 and max(len(log.folders()), 1) <= 6
    stored = spark.read.parquet(*[f"{tmp_path}/log/{n}" for _, n in log.folders()]).count()
    assert stored <= 40 * 3 + 2 * 22 * 3
    assert log._fs.createNewFile(log._place(f"claims/v{log.versions()[-1] + 1:012d}"))
    with pytest.raises(RuntimeError):
        log.append(df(spark, schema, ("a", 999, T0, "x")))
    log.recover()
    log.append(df(spark, schema, ("a", 999, T0, "x")))


def test_topk_scores_few_pairs_and_finds_ties(spark):
    rnd = random.Random(9)
    rare, common = [f"r{i}" for i in range(400)], [f"c{i}" for i in range(6)]
    chunks = [(i, "h", " ".join(rnd.choices(common, k=12) + rnd.choices(rare, k=3))) for i in range(1500)]
    chunks += [(2000 + i, "h", "r1 r2 c0") for i in range(60)]  # ties, in chunk order
    queries = [(q, " ".join(rnd.choices(rare, k=2) + common)) for q in range(25)] + [(90, "r1 r2 c0"), (91, "c0 c1"), (92, "nothing here"), (93, "")]
    cdf = df(spark, "chunk_id long, heading string, body string", *chunks).repartition(4)
    qdf = df(spark, "query_id long, text string", *queries)
    tok = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1 and w not in X.R.SEARCH_STOP_WORDS]
    tf = {c: Counter(tok(h + " " + b)) for c, h, b in chunks}
    dfs = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in dfs.items()}
    norm = {c: math.sqrt(sum((n * idf[t]) ** 2 for t, n in x.items())) for c, x in tf.items()}
    want, meeting = {}, 0
    for q, text in queries:
        w = {t: n * idf[t] for t, n in Counter(tok(text)).items() if t in idf}
        qn = math.sqrt(sum(x * x for x in w.values())) or 1.0
        score = {c: round(sum(v * tf[c][t] * idf[t] for t, v in w.items() if t in tf[c]) / (qn * norm[c]), 9) for c in tf}
        score = {c: s for c, s in score.items() if s > 0}
        meeting += len(score)
        if score:
            want[q] = sorted(score, key=lambda c: (-score[c], c))[:3]
    got: dict = {}
    for r in X.tfidf_topk(qdf, cdf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want
    impacts, blocks, table = X.impact_index(cdf, 3)
    scored = X.topk_candidates(X.query_weights(qdf, table), impacts, blocks, 3).count()
    assert scored * 10 < meeting, (scored, meeting)


def tfidf_by_hand(chunks, queries, k=3):
    """Best chunks with scores of each query, and how many pairs share a word; rows of one chunk count together."""
    tok = lambda s: [w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 1 and w not in X.R.SEARCH_STOP_WORDS]
    tf = {}
    for c, h, b in chunks:
        tf.setdefault(c, Counter()).update(tok(h + " " + b))
    dfs = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 1)) + 1 for t, n in dfs.items()}
    norm = {c: math.sqrt(sum((n * idf[t]) ** 2 for t, n in x.items())) for c, x in tf.items()}
    best, meeting = {}, 0
    for q, text in queries:
        w = {t: n * idf[t] for t, n in Counter(tok(text)).items() if t in idf}
        qn = math.sqrt(sum(x * x for x in w.values())) or 1.0
        score = {c: round(sum(v * x[t] * idf[t] for t, v in w.items() if t in x) / (qn * (norm[c] or 1.0)), 9) for c, x in tf.items()}
        score = {c: s for c, s in score.items() if s > 0}
        meeting += len(score)
        best[q] = [(c, score[c]) for c in sorted(score, key=lambda c: (-score[c], c))[:k]]
    return {q: b for q, b in best.items() if b}, meeting


def wordy(n, seed=3):
    """Chunks of words of all frequencies, and queries that meet most of them."""
    rnd = random.Random(seed)
    words, weight = [f"w{i}" for i in range(900)], [1 / (i + 3) for i in range(900)]
    chunks = [(i, "h", " ".join(rnd.choices(words, weight, k=rnd.randrange(20, 120)))) for i in range(n)]
    return chunks, [(q, " ".join(rnd.choices(words, weight, k=20))) for q in range(15)]


def best_of(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    return {q: [(c, pytest.approx(s, abs=2e-9)) for c, s in b] for q, b in got.items()}


def test_topk_scores_few_pairs_of_common_words(spark):
    chunks, queries = wordy(1500)
    cdf, qdf = df(spark, "chunk_id long, heading string, body string", *chunks).repartition(4), df(spark, "query_id long, text string", *queries)
    want, meeting = tfidf_by_hand(chunks, queries)
    assert best_of(X.tfidf_topk(qdf, cdf).collect()) == want
    impacts, blocks, table = X.impact_index(cdf, 3)
    scored = X.topk_candidates(X.query_weights(qdf, table), impacts, blocks, 3).count()
    assert scored * 10 < meeting, (scored, meeting)


def test_topk_stores_and_moves_less_than_the_texts(spark, tmp_path):
    """The tables it writes are smaller than the texts, and postings of a chunk are dealt once for candidates and scores."""
    chunks, queries = wordy(4000)
    path = f"{tmp_path}/chunks"
    df(spark, "chunk_id long, heading string, body string", *chunks).repartition(4).write.parquet(path)
    before = {f for f in pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*.parquet")}
    hits = X.tfidf_topk(df(spark, "query_id long, text string", *queries), spark.read.parquet(path))
    made = [f for f in pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("*.parquet") if f not in before]
    assert made and sum(f.stat().st_size for f in made) < sum(len(b) for _, _, b in chunks) * 0.75
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "- Exchange hashpartitioning" in x]
    assert len(dealt) == 2 and sum("REPARTITION_BY_COL" in x for x in dealt) == 1, plan
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("head", (0, 7, 100_000))
def test_topk_with_few_terms_sent_to_all_tasks(spark, monkeypatch, head):
    monkeypatch.setattr(X, "HEAD", head)
    chunks, queries = wordy(150)
    cdf, qdf = df(spark, "chunk_id long, heading string, body string", *chunks), df(spark, "query_id long, text string", *queries)
    assert best_of(X.tfidf_topk(qdf, cdf).collect()) == tfidf_by_hand(chunks, queries)[0]


def test_terms_of_rows_that_share_a_key(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, "aa, AA; the x aa"), (None, "dd"), (None, "dd ee"), (3, ""), (4, None), (5, "Ünü b2")]
    got = X.term_counts(df(spark, "k long, text string", *rows), "k", F.col("text")).collect()
    assert {(r["k"], r["term"]): r["tf"] for r in got} == {
        (1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (2, "aa"): 3, (None, "dd"): 2, (None, "ee"): 1, (5, "b2"): 1}
    assert len(got) == 7
    one = X.term_lists(df(spark, "k long, text string", *rows[2:3]), "k", F.col("text")).collect()
    assert [(r["k"], [tuple(t) for t in r["terms"]]) for r in one] == [(2, [("aa", 3)])]


def test_texts_stay_where_they_are_for_few_hits(spark, tmp_path):
    chunks, queries = wordy(1500)
    path = f"{tmp_path}/chunks"
    df(spark, "chunk_id long, heading string, body string", *chunks).withColumn("doc", F.lit("d.md")).write.parquet(path)
    cdf = spark.read.parquet(path)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # less than the texts
    try:
        blocks = X.grounding_text(X.tfidf_topk(df(spark, "query_id long, text string", *queries), cdf), cdf, "Notes")
        got = {r["query_id"]: r["text"] for r in blocks.collect()}
        plan = blocks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    body = dict((c, b) for c, _, b in chunks)
    assert got == {q: "\n\n".join(["== Notes ==", *[f"[d.md · h]\n{body[c]}" for c, _ in best]]) for q, best in tfidf_by_hand(chunks, queries)[0].items()}
    assert "SortMergeJoin" not in plan and "hashpartitioning(chunk_id" not in plan


def test_a_chunk_in_two_rows_counts_twice(spark):
    chunks, queries = wordy(200)
    cdf, qdf = df(spark, "chunk_id long, heading string, body string", *chunks, chunks[7]), df(spark, "query_id long, text string", (1, "w850 w851"), (2, " ".join(chunks[7][2].split()[:8])))
    want, _ = tfidf_by_hand([*chunks, chunks[7]], [(2, " ".join(chunks[7][2].split()[:8]))], 200)
    got = {r["chunk_id"]: r["score"] for r in X.tfidf_topk(qdf, cdf, 200).filter("query_id = 2").collect()}
    assert got == {c: pytest.approx(s * (2 if c == 7 else 1), abs=4e-9) for c, s in want[2]}
