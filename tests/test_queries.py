"""Every registered query against its SQL twin.

By default a sample of each family runs at the smallest scale; EVIDEX_ORACLE=all runs all.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import check

SF = os.environ.get("EVIDEX_SF", "/root/testdata/sf0.001")
SAMPLE = ("decode_text", "hazard_rank", "secret_scan", "class_table", "derive_schema", "load_plan", "spring_triggers",
          "transitive_closure", "merge_targets", "completeness_ledger", "rule_ledger", "triage", "cost_report", "cap_cutoff",
          "tfidf_topk", "target_fingerprint", "event_sequence", "idle_gaps", "live_spend_meter", "snapshot_sink")
NAMES = list(entry.queries()) if os.environ.get("EVIDEX_ORACLE") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, message, _, _ = check.compare(spark, con, name, SF)
    assert ok, message


def test_every_query_has_a_twin():
    from evidex.plans.registry import ORACLES, QUERIES
    assert set(ORACLES) == set(QUERIES)


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ("regex_scan", "hazard_scan", "class_table", "blast_rollup", "rule_ledger", "best_method",
                                  "cap_cutoff", "content_key_cache", "event_sequence", "target_fingerprint", "corpus_verdict"))
def test_plans_stay_in_the_jvm_without_pairwise_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["tenant_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    from evidex.operators.history import tenant_filter
    runs = spark.read.parquet(f"{SF}/orders.parquet").withColumnRenamed("o_custkey", "owner")
    assert "EqualTo(o_custkey,7)" in tenant_filter(runs, 7)._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_is_applied_before_the_shuffle(spark):
    plan = entry.queries()["tfidf_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sessions_hold_every_event(spark):
    """Also those of the last hour, which the stream's time alone leaves open."""
    n = entry.queries()["idle_sessions"](spark, SF).selectExpr("sum(n)").first()[0]
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()


def test_rules_that_share_a_short_id(spark, con, tmp_path):
    """Conversations 58818 and 106965, 94169 and 107435, 72735 and 220487 share an id; 7 says a text twice."""
    said = ("orders above limit receive discount from sales", "gold customers receive free shipping always",
            "returns need approval when value exceeds limit today", "every invoice carries number date total sender address")
    rows = [(c, t, "user" if t % 2 else "assistant", f"{said[t]} {said[c // 4 % 4]}")
            for c in (7, 58818, 106965, 94169, 107435, 72735, 220487) for t in sorted({0, c % 4, (c + 1) % 4})]
    rows.append((7, 9, "user", rows[0][3]))
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    mine = con.cursor()
    mine.execute(f"create or replace temp view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    ok, message, _, _ = check.compare(spark, mine, "alignment_rows", str(tmp_path))
    assert ok, message


def test_fingerprints_are_made_once_for_both_sides(spark):
    files = entry.queries()["reuse_or_rebuild"](spark, SF).inputFiles()
    assert files and all("/fingerprints-" in f for f in files)
