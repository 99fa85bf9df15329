"""Steps whose memory of a task must not grow with what one task reads."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from duelframe.operators import boosting as B
from duelframe.operators import history as H
from duelframe.operators import matchup as M
from duelframe.plans import views as V


def _lines(spark, folder, orders: int = 40):
    rows = [(o, 10 * o + n, 1 + (o + n) % 3, n, float(n + 1), "ARN"[n % 3], "FO"[n % 2]) for o in range(orders) for n in range(4)]
    rows += [(orders, 1, None, 1, 2.0, None, "F"), (orders, 2, None, 2, 3.0, "R", None), *rows[:3]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return rows


def test_sides_are_summed_after_the_rows_of_an_order_meet(spark, tmp_path):
    """Sums kept in the scan tasks grew with the rows that one of them read."""
    rows = _lines(spark, tmp_path)
    ranked = V.ranked_sides(spark, str(tmp_path))
    plan = ranked._jdf.queryExecution().sparkPlan().toString() + ranked._jdf.queryExecution().executedPlan().toString()
    executed = ranked._jdf.queryExecution().executedPlan().toString()
    below = executed[executed.index("Exchange"):]
    assert "HashAggregate" in plan and "Aggregate" not in below
    assert len(re.findall(r"Exchange hashpartitioning", executed)) == 1
    got = {(r["contest_id"], r["entity_id"]): (r["attempted"], r["landed"], r["td_attempted"], r["kd"], r["rf"]) for r in V.side(spark, str(tmp_path)).collect()}
    want = {}
    for o, _, s, _, q, flag, _ in rows:
        a, l, n, k, f = want.get((o, s), (0.0, 0.0, 0, 0, None))
        rank = {"A": 1, "N": 3, "R": 4, None: None}[flag]
        want[o, s] = (a + q, l + (0.0 if flag == "R" else q if flag else 0.0), n + 1, k + (flag == "A"), rank if f is None else f if rank is None else max(f, rank))
    assert got == want


def test_features_of_entities_spread_with_the_stored_probes(spark, monkeypatch):
    """The widest rows were left to a number of tasks that does not follow the input."""
    monkeypatch.setattr(M, "task_count", lambda df: 9, raising=False)
    day = F.lit("2000-01-02").cast("date").alias("event_date")
    a = spark.range(3).select(F.col("id").alias("entity_id"), F.lit("x").alias("division"), day)
    counts = [F.lit(1.0).alias(c) for c in (*H.STATE_COUNTS, "streak", *(f"{over}_{s}" for over in ("cum", "last") for s in H.SUMS))]
    bio = a.select("entity_id", F.lit(70.0).alias("height_in"), F.lit(71.0).alias("reach_in"), F.lit("Orthodox").alias("stance"), day.alias("dob"))
    probes = a.withColumn("event_date", F.date_add("event_date", 1))
    out = M.entity_features(a.select("entity_id", "event_date", *counts), a.select("entity_id", "division", "event_date"), bio, probes)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(entity_id#\d+L, 9\)", plan)
    assert [(r["entity_id"], r["layoff_days"], r["first_in_division"]) for r in out.orderBy("entity_id").collect()] == [(i, 1.0, 0.0) for i in range(3)]


def test_level_sums_make_no_copies_of_all_cells_per_measure():
    """gradients and Hessians were repeated for every column, and all cells cast anew for each sum."""
    rng, n, k, width = np.random.default_rng(1), 20_000, 60, 34
    codes, y, margin = rng.integers(0, width, (n, k)).astype(np.uint8), rng.integers(0, 2, n).astype(float), rng.normal(size=n)
    config, tree, mask = B.Config(row_share=1.0, column_share=1.0), B.Tree(), np.arange(width) < 17
    tree.add(np.array([0.0, 1.0, n]), config)
    nodes = list(tree.split(0, (1.0, 3, mask, np.array([0.0, 1.0, n]), np.array([0.0, 1.0, n])), config))
    growing = {("f", "c"): (config, tree, nodes, np.arange(k))}
    block = [(("f", codes, y, np.zeros(n, dtype=bool), np.arange(n)), {"c": margin})]
    tracemalloc.start()
    found = dict(B._sums(block, growing, 0, {"f": width}, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    p = B.sigmoid(margin)
    for node, side in zip(nodes, (mask[codes[:, 3]], ~mask[codes[:, 3]])):
        for x, v in enumerate((p - y, p * (1 - p), np.ones(n))):
            want = np.stack([np.bincount(codes[side, c], v[side], width) for c in range(k)])
            assert np.allclose(found["f", "c", node][x], want)
    assert peak < 2 * 8 * n * k
