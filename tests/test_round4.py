"""Work of round 4: trees of small folds in one task, sums of one sibling, what explanations carry."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe import session
from duelframe.functions import names as N
from duelframe.operators import boosting as B
from duelframe.operators import history as H
from duelframe.operators import matchup as M
from duelframe.operators import models as L
from duelframe.plans import source_views as S
from duelframe.plans import views as V
from tests.test_boosting import KIND, NUMERIC, table
from tests.test_models import COLS, rows


def _shape(models):
    return {k: ([t.feature for t in m.trees], [None if c is None else c.tolist() for t in m.trees for c in t.left_codes]) for k, m in models.items()}


def test_small_folds_grow_in_one_job(spark, monkeypatch):
    """one job a level and round; the trees are those of growth in step."""
    df = spark.createDataFrame(table(900, 3, 0.3), KIND).repartition(3)
    df = df.unionByName(df.withColumn("fold", F.lit("b")).filter("key < 500"))
    grid = {"s": B.Config(7, 20, 5, 0.3, patience=4), "t": B.Config(15, 10, 4, 0.1, patience=4)}
    jobs = []
    collected = B.RDD.collect
    monkeypatch.setattr(B.RDD, "collect", lambda rdd: jobs.append(1) or collected(rdd))
    alone = B.fit_boosted(df, NUMERIC, ["c"], {"a": grid, "b": grid})
    assert len(jobs) == 1 and all(len(m.trees) > 2 for m in alone.values())
    monkeypatch.setattr(B, "WHOLE", 0)
    jobs.clear()
    in_step = B.fit_boosted(df, NUMERIC, ["c"], {"a": grid, "b": grid})
    assert len(jobs) > 10 and _shape(in_step) == _shape(alone)
    for key, m in alone.items():
        for x in ("value", "gain", "rows"):
            assert np.allclose(sum((getattr(t, x) for t in m.trees), []), sum((getattr(t, x) for t in in_step[key].trees), []), rtol=1e-9, atol=1e-12)


def test_only_the_smaller_sibling_is_summed(monkeypatch):
    """all rows were summed at every level; the other child's sums are what is left of the parent's."""
    rng = np.random.default_rng(2)
    n, bins = 4000, B.Bins({f"x{i}": np.arange(6.0) for i in range(5)}, {})
    codes, y = np.asfortranarray(rng.integers(0, 7, (n, 5)).astype(np.uint8)), rng.integers(0, 2, n).astype(float)
    summed, of = [], B._node_sums
    monkeypatch.setattr(B, "_node_sums", lambda codes, columns, rows, g, h, width: summed.append(len(rows)) or of(codes, columns, rows, g, h, width))
    m = B._grown_alone(("f", codes, y, np.zeros(n, dtype=bool), np.arange(n)), B.Boosted(bins, B.Config(15, 20, 1, row_share=1.0, column_share=1.0), 0.0))
    tree = m.trees[0]
    splits = [i for i, f in enumerate(tree.feature) if f >= 0]
    smaller = [int(min(tree.rows[tree.left[i]], tree.rows[tree.right[i]])) for i in splits]
    assert len(splits) > 6 and summed[0] == n and 3 < len(summed) <= 1 + len(splits) and set(summed[1:]) <= set(smaller)
    whole, part = np.array([[1.0, 0.3], [0.5, 0.2], [3, 1]]), np.array([[0.25, 0.1 + 0.2], [0.25, 0.2], [1, 1]])
    assert B._rest(whole, part).tolist() == [[0.75, 0.0], [0.25, 0.0], [2, 0.0]]


def test_contributions_of_equal_cases_are_worked_out_once():
    rng = np.random.default_rng(3)
    n, bins = 3000, B.Bins({f"x{i}": np.arange(6.0) for i in range(5)}, {})
    codes, y = np.asfortranarray(rng.integers(0, 7, (n, 5)).astype(np.uint8)), rng.integers(0, 2, n).astype(float)
    m = B._grown_alone(("f", codes, y, np.zeros(n, dtype=bool), np.arange(n)), B.Boosted(bins, B.Config(15, 20, 3), 0.0))
    values, bias = m.contributions(codes)
    B.PATTERN, kept = 0, B.PATTERN
    try:
        each, other = m.contributions(codes)
    finally:
        B.PATTERN = kept
    assert np.array_equal(values, each) and bias == other


@pytest.mark.parametrize("feature, group", [("f1_age", "age"), ("diff_f1_x", "f1_x"), ("f2_stance", "stance"), ("stance_matchup", "stance"), ("is_title", "is_title"), ("f1_", ""), ("xf1_a", "xf1_a"), ("diff_ä_b", "ä_b")])
def test_driver_group_without_patterns(spark, feature, group):
    assert spark.range(1).select(L.driver_group(F.lit(feature))).first()[0] == group


def _shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(manager.getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(manager.getAllFiles().size()))


def test_compact_tables_leave_no_shuffle_files(spark):
    """Shuffle files behind a stored table stayed until the driver collected its garbage."""
    wide = spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    setting, before = spark.conf.get(session._CLEANUP, None), _shuffle_files(spark)
    out = session.cut_lineage(wide, "packed", compact=True)
    until = time.time() + 20
    while _shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before and spark.conf.get(session._CLEANUP, None) == setting
    assert {(r.k, r.n) for r in out.collect()} == {(k, 20) for k in range(100)} and all(f.endswith(".zstd.parquet") for f in out.inputFiles())


def test_columns_that_nobody_asks_for_are_left_out(spark):
    """both sides went through a generator, so that days and splits alone derived and shuffled all features."""
    days = V.features(spark, "/root/testdata/sf0.001").select("split", "event_date")
    plan = days._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "num_landed" not in plan and "run_sign" not in plan
    sides = spark.createDataFrame([(1, 7, 8, 7, (1.0,), (2.0,)), (2, None, 9, 9, None, (4.0,))], "contest_id int, entity_1_id long, entity_2_id long, winner_id long, side_1 struct<x: double>, side_2 struct<x: double>")
    got = {(r.contest_id, r.orientation): (r.entity_1_id, r.entity_2_id, r.side_1 and r.side_1.x, r.side_2 and r.side_2.x, r.target) for r in M.orientations(sides).collect()}
    assert got == {(1, 0): (7, 8, 1.0, 2.0, 1), (1, 1): (8, 7, 2.0, 1.0, 0), (2, 0): (None, 9, None, 4.0, 0), (2, 1): (9, None, 4.0, None, 1)}


def test_rates_are_made_before_states_are_shuffled(spark, monkeypatch):
    """states carried both sums of each rate through the shuffle."""
    met, of = [], M.spread
    monkeypatch.setattr(M, "spread", lambda df, keys, tasks: met.append(df) or of(df, keys, tasks))
    day = F.lit("2000-01-02").cast("date").alias("event_date")
    a = spark.range(2).select(F.col("id").alias("entity_id"), F.lit("x").alias("division"), day)
    sums = [F.lit(0.0 if c.startswith("den_td") else 6.0 if c.startswith("num_") else 4.0).alias(f"{over}_{c}") for over in ("cum", "last") for c in M.SUMS]
    states = a.select("entity_id", "event_date", F.lit(3).alias("cum_wins"), *[F.lit(5).alias(c) for c in H.STATE_COUNTS if c != "cum_wins"], F.lit(1).alias("streak"), *sums)
    bio = a.select("entity_id", F.lit(70.0).alias("height_in"), F.lit(71.0).alias("reach_in"), F.lit("Orthodox").alias("stance"), day.alias("dob"))
    out = M.entity_features(states, a, bio, a.withColumn("event_date", F.date_add("event_date", 1)))
    fields = met[0].schema["st"].dataType.names
    assert not any("_num_" in f or "_den_" in f for f in fields) and len(fields) == 2 + len(H.STATE_COUNTS) + 2 * len(H.RATES)
    for r in out.collect():
        assert (r.landed_p15, r.landed_acc, r.td_acc, r.landed_acc_l3, r.td_acc_l3) == (1350.0, 1.5, None, 1.5, None)


def test_grid_shares_what_does_not_depend_on_it(spark, monkeypatch):
    """The prepared rows were cached beside the blocks of the regression, and medians and scales fitted for each C."""
    kept, fitted, of = [], [], L.StandardScaler.fit
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: kept.append(1) or df)
    monkeypatch.setattr(L.StandardScaler, "fit", lambda self, data, *a: fitted.append(1) or of(self, data, *a))
    train, later = rows(spark, 120), rows(spark, 40, dt.date(2001, 6, 1), 4)
    m = L.tune_logistic(train, later, COLS, [0.1, 1.0])
    assert not kept and len(fitted) == 1 and m.C in (0.1, 1.0) and set(m.coefficients()) == set(COLS)


def test_plain_names_take_the_short_way(spark):
    """Names of ASCII letters need no folding; both ways give the same."""
    names = ["Conor  McGregor", "O'Neil-Smith Jr.", "a`b\"c'd", "  x_Y  ", "", "123 \t9", None, "José Aldo", "Jan Błachowicz", "Æsir Öz", "éa", "İlk", "ß", "Kk", "’t Hart", "\x7f\x00a"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    long = F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(N._folded(F.col("n")), "[.'’`\"]", ""), r"[^a-z0-9]+", " ")), F.lit(""))
    got = df.select("n", N.normalize_name(F.col("n")).alias("a"), long.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "conor mcgregor" and got[7].a == "jose aldo" and got[6].a == ""


def test_slates_are_named_once(spark, monkeypatch):
    """Results and rounds each numbered the slates and met the names again."""
    calls, of = [], S.named_contests
    monkeypatch.setattr(S, "named_contests", lambda *a, **k: calls.append(1) or of(*a, **k))
    src = S.sources(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and any("named" in f for f in src["rounds"].inputFiles()) and any("named" in f for f in src["results"].inputFiles())
