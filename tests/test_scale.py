"""Skew-safe building blocks against brute force, with one key holding a third of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidex.operators import scale
from evidex.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else rnd.randrange(40), i, rnd.randrange(1000)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k int, i int, v int").repartition(5)


@pytest.mark.parametrize("chunk", [7, 400, scale.CHUNK])
def test_running_matches_brute_force(skewed, chunk):
    rows, df = skewed
    got = {r["i"]: (r["seq"], r["before"]) for r in scale.running(df, ["k"], [F.col("i")], value=F.col("v"), chunk=chunk).collect()}
    want, n, s = {}, defaultdict(int), defaultdict(int)
    for k, i, v in rows:
        want[i] = (n[k], s[k])
        n[k] += 1
        s[k] += v
    assert got == want


def test_running_backwards(skewed):
    rows, df = skewed
    got = {r["i"]: r["seq"] for r in scale.running(df, ["k"], [F.desc("i")], chunk=90).collect()}
    want, n = {}, defaultdict(int)
    for k, i, _ in reversed(rows):
        want[i] = n[k]
        n[k] += 1
    assert got == want


def test_running_with_null_keys_without_keys_and_of_nothing(spark):
    rows = [(None, 3, 1), ("a", 1, 5), (None, 1, None), ("a", 0, 2), (None, 2, 7)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(2)
    got = {(r["k"], r["i"]): (r["seq"], r["before"]) for r in scale.running(df, ["k"], [F.col("i")], value=F.col("v"), chunk=2).collect()}
    assert got == {(None, 1): (0, 0), (None, 2): (1, 0), (None, 3): (2, 7), ("a", 0): (0, 0), ("a", 1): (1, 2)}
    assert sorted(r["seq"] for r in scale.running(df, [], [F.col("i"), F.col("k")], chunk=2).collect()) == list(range(5))
    assert scale.running(df.limit(0), ["k"], [F.col("i")], value=F.col("v")).count() == 0


def test_a_run_with_most_rows_on_one_day_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(-1).alias("k"), "id")
    out = scale.running(df, ["k"], [F.col("id")], value=F.col("id"), chunk=500)
    windows = out.groupBy("k", F.floor(F.col("seq") / 500)).count().agg(F.max("count")).first()[0]
    assert windows <= 500
    hot = out.filter("k = -1").orderBy("seq").collect()
    assert [r["seq"] for r in hot] == list(range(18_000)) and hot[-1]["before"] == sum(r["id"] for r in hot[:-1])
    path = scale.settled(df.orderBy("k", "id"), "sorted")
    sizes = [r["count"] for r in path.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("after", [True, False])
def test_sorted_neighbour_equals_brute_force(spark, after):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab\u00e9z") for _ in range(rnd.randint(0, 5)))
    asked, held = [(k, word() if k % 9 else None) for k in range(300)], sorted({word() for _ in range(60)}, key=str.encode)
    df, other = spark.createDataFrame(asked, "i int, w string").repartition(3), spark.createDataFrame([(w, 1) for w in [*held, None]], "w string, x int")
    got = {r["i"]: r["found"] for r in scale.sorted_neighbour(df, other, "w", after, chunk=20).collect()}
    pick = lambda w: next((h for h in held if h.encode() >= w.encode()), None) if after else next((h for h in reversed(held) if h.encode() <= w.encode()), None)
    assert got == {i: None if w is None else pick(w) for i, w in asked}


def test_global_rank(skewed):
    rows, df = skewed
    got = {r["i"]: r["rank"] for r in scale.global_rank(df, [F.col("k"), F.desc("v"), F.col("i")]).collect()}
    want = {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], -r[2], r[1])), 1)}
    assert got == want


def test_rank_of_nothing(spark):
    assert scale.global_rank(spark.range(0), [F.col("id")]).count() == 0


def test_digest_is_a_set_identity(spark, skewed):
    rows, df = skewed
    item = F.concat_ws(":", F.col("i").cast("string"), F.col("v").cast("string"))
    one = {r["k"]: r["digest"] for r in scale.set_digest(df, ["k"], item).collect()}
    two = {r["k"]: r["digest"] for r in scale.set_digest(df.orderBy(F.desc("i")).coalesce(1), ["k"], item).collect()}
    assert one == two and len(set(one.values())) == len(one)
    changed = df.withColumn("v", F.when(F.col("i") == 30, F.col("v") + 1).otherwise(F.col("v")))
    three = {r["k"]: r["digest"] for r in scale.set_digest(changed, ["k"], item).collect()}
    assert {k for k in one if one[k] != three[k]} == {0}


def test_computed_replaces_and_keeps(spark):
    df = scale.computed(spark.createDataFrame([(1, 2)], "a int, b int"), b=F.col("a") + 10, c=F.col("b") * 2)
    assert df.first().asDict() == {"a": 1, "b": 11, "c": 4}


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_no_single_partition_window_on_data(spark, skewed):
    _, df = skewed
    plan = scale.running(df, ["k"], [F.col("i")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_split_join_equals_a_plain_join(spark, skewed):
    rows, df = skewed
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 45, 2)], "k int, s string")
    for how in ("left", "inner"):
        got = sorted((r["i"], r["s"] or "") for r in scale.split_join(df, small, "k", how).collect())
        want = sorted((r["i"], r["s"] or "") for r in df.join(small, "k", how).collect())
        assert got == want
    null = df.withColumn("k", F.when(F.col("i") % 2 == 0, F.col("k")))
    assert scale.split_join(null, small, "k").count() == len(rows)
    assert scale.hot_keys(df, "k").count() <= scale.HOT_SHARE


def test_small_keys_are_not_copied(spark):
    df = spark.range(4000).selectExpr("id div 2 as k", "id as v")  # each key has more than 1/10,000 of the rows
    assert scale.hot_keys(df, "k").isEmpty()
    hot = df.selectExpr("if(k < 1500, 7, k) as k", "v")
    assert [r["k"] for r in scale.hot_keys(hot, "k").collect()] == [7]
