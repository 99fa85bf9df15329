import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import metrics as X
from duelframe.operators.matchup import contest_scores

S = "contest_id string, event_date date, target int, p double"


def scores(spark, rows):
    return spark.createDataFrame([(str(i), None, y, p) for i, (y, p) in enumerate(rows)], S).withColumn("g", F.lit("x"))


def test_wilson(spark):
    low, high = X.wilson_low_high(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(5, 10), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert r[0].l == pytest.approx(0.2366, abs=1e-4) and r[0].h == pytest.approx(0.7634, abs=1e-4) and r[1].l is None


def test_metrics_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(int(rng.random() < 0.6), rng.choice([0.5, 0.52, 0.6, 0.3, 0.9, round(rng.random(), 3)])) for _ in range(300)]
    df = scores(spark, rows)
    two = [(y, p) for y, p in rows] + [(1 - y, round(1 - p, 12)) for y, p in rows]
    pos, neg = [p for y, p in two if y], [p for y, p in two if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert X.roc_auc(df, ["g"]).first()["roc_auc"] == pytest.approx(auc)
    assert X.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    m = X.score_metrics(df, ["g"]).first()
    assert m.brier == pytest.approx(sum((p - y) ** 2 for y, p in rows) / 300)
    t = X.calibration_table(df, ["g"]).collect()
    assert len(t) == 7 and sum(r.n for r in t) == 300
    e = X.evaluate(df, ["g"]).first()
    gaps = [(r.n, abs(r.gap)) for r in t if r.n]
    assert e.ece == pytest.approx(sum(n * g for n, g in gaps) / 300) and e.mce == pytest.approx(max(g for _, g in gaps))


def test_decomposition_is_exact_for_constant_bins(spark):
    rows = [(1, 0.57)] * 6 + [(0, 0.57)] * 4 + [(1, 0.72)] * 9 + [(0, 0.72)] * 3
    b = X.brier_decomposition(scores(spark, rows), ["g"]).first()
    brier = sum((p - y) ** 2 for y, p in rows) / len(rows)
    assert b.reliability - b.resolution + b.uncertainty == pytest.approx(brier)


def test_empty_bins_and_order_invariance(spark):
    t = X.calibration_table(scores(spark, [(1, 0.9)]), ["g"]).collect()
    assert sum(r.n == 0 for r in t) == 6 and all(r.gap is None for r in t if r.n == 0)
    a, b = scores(spark, [(1, 0.7), (0, 0.4), (1, 0.6)]), scores(spark, [(0, 0.3), (1, 0.6), (0, 0.4)])
    for f in (X.roc_auc, X.brier_decomposition):
        assert [pytest.approx(v) for v in list(f(a, ["g"]).first())[1:]] == list(f(b, ["g"]).first())[1:]


def test_contest_scores_need_both_orientations(spark):
    rows = [("a", None, 0, 1, 0.6), ("a", None, 1, 0, 0.3), ("b", None, 0, 1, 0.6)]
    df = spark.createDataFrame(rows, "contest_id string, event_date date, orientation int, target int, p double")
    assert contest_scores(df.filter("contest_id = 'a'")).first()["p"] == pytest.approx(0.65)
    with pytest.raises(Exception, match="exactly one row per orientation"):
        contest_scores(df).collect()


def test_missingness(spark):
    df = spark.createDataFrame([(None if i < 40 else 1.0, 1 if i < 30 else 0) for i in range(100)], "x double, target int")
    r = X.missingness_report(df.withColumn("y", F.lit(1)), ["x", "y"]).collect()
    assert len(r) == 1 and r[0].missing_share == 0.4 and r[0].target_rate_missing == 0.75 and r[0].target_rate_present == 0.0
