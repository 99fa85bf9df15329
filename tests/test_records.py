"""Records before a contest: what no caller reads is not computed, and tasks follow the input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from duelframe.operators import history as H
from duelframe.operators import track as T
from duelframe.plans import q_review as Q
from duelframe.plans import views as V

CONTESTS = """contest_id long, event_date date, bout_order long, entity_1_id long, entity_2_id long, winner_id long, result string, finish_group string,
  division string, has_stats boolean, is_prior boolean"""


def _contests(spark):
    days = ["2000-01-01", "2000-01-02", "2000-03-05", "2000-03-05", None, "2000-09-01"]
    rows = [(i, d, i, 1 + i % 2, 3, (None, 1 + i % 2, 3)[i % 3], ("nc", "win", "win")[i % 3], "ko_tko", None, False, False) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, CONTESTS.replace("event_date date", "event_date string")).withColumn("event_date", F.col("event_date").cast("date"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_alone_compute_no_runs(spark):
    """The state of a part was one struct, so that every count and the runs behind the streak were made and shuffled for two counts."""
    states = H.daily_states(H.appearances(_contests(spark)), with_rates=False)
    two = states.select("entity_id", "event_date", "cum_contests", "cum_wins")
    plan = _plan(two)
    assert "sign" not in plan and "ko_wins" not in plan and "SortAggregate" not in plan
    key = ["entity_id", "event_date"]
    got = [tuple(r) for r in two.orderBy(*key).collect()]
    assert got == [tuple(r) for r in states.orderBy(*key).select("entity_id", "event_date", "cum_contests", "cum_wins").collect()]
    assert [g[2:] for g in got if g[0] == 3] == [(1, 0), (2, 0), (3, 0), (5, 1), (6, 2)]       # the contest without a day comes first


@pytest.mark.parametrize("whole", [False, True])
def test_scan_over_the_parts_of_an_entity_follows_the_input(spark, monkeypatch, whole):
    """Parts met by entity in as many tasks as cores, whose memory grew with the input."""
    monkeypatch.setattr(H, "task_count", lambda df: 9)
    states = H.daily_states(H.appearances(_contests(spark)), with_rates=False)
    df = states if whole else states.select("entity_id", "event_date", "cum_contests")
    assert re.search(r"Exchange hashpartitioning\(entity_id#\d+L, 9\)", _plan(df))


def test_sides_of_a_contest_meet_in_one_sort(spark, tmp_path):
    """both sides' structs went through two aggregates that sort, after the rows had been sorted already."""
    lines = [(o, s, 1, float(q), f, "F") for o, s, q, f in [(1, 9, 2, "A"), (1, 7, 1, "R"), (1, 8, 5, "N"), (1, 7, 3, "A"), (2, 4, 1, "N"), (3, None, 1, "A"), (3, 5, 2, "R"), (None, 5, 1, "A"), (None, 6, 1, "A"), (4, 6, 1, "A"), (4, 6, 2, "N")]]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "1997-01-01", "F", "1-URGENT") for k in (1, 2, 3, 4)], "o_orderkey long, o_orderdate string, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    c = V.contests(spark, str(tmp_path), False)
    assert "SortAggregate" not in _plan(c)
    got = {r["contest_id"]: (r["entity_1_id"], r["entity_2_id"], r["winner_id"], r["finish_group"], r["duration_sec"]) for r in c.collect()}
    assert got == {1: (7, 8, 8, "submission", 180), 3: (None, 5, 5, "decision", 120)}
    both = {r["contest_id"]: (r["stats_1"]["attempted"], r["stats_2"]["attempted"]) for r in V.contests(spark, str(tmp_path), False, True).collect()}
    assert both == {1: (4.0, 5.0), 3: (1.0, 2.0)}


def test_predictions_are_stored_before_their_three_uses(spark, monkeypatch):
    """the joins behind the predictions ran once for each use in the matching."""
    c = _contests(spark)
    preds = c.select(F.col("contest_id").alias("pred_id"), "event_date", "entity_1_id", "entity_2_id")
    monkeypatch.setattr(V, "predictions", lambda s, d, stored: preds)
    seen = []
    real = T.match_predictions
    monkeypatch.setattr(T, "match_predictions", lambda p, c: seen.append(p.inputFiles()) or real(p, c))
    assert Q._matched(spark, "", c).count() == 6
    assert seen[0] and all("/predictions-" in f for f in seen[0])
