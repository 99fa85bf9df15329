import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import models as L
from duelframe.operators.impute import FoldLeakError, PhysicalImputer, assert_fit_before
from duelframe.operators.matchup import contest_scores

COLS = ["diff_skill", "diff_height_in"]
SCHEMA = ("contest_id int, event_date date, orientation int, target int, division string, f1_n_wins double, f2_n_wins double, diff_skill double, "
          + ", ".join(f"f{s}_{p} double" for s in "12" for p in ("height_in", "reach_in", "age")) + ", " + ", ".join(f"diff_{p} double" for p in ("height_in", "reach_in", "age")))


def rows(spark, n=300, start=dt.date(2000, 1, 1), seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        won = rng.random() < 1 / (1 + math.exp(-2 * (a - b)))
        sides = [[(70.0 + rng.randrange(5)) if rng.random() < 0.8 else None, None if rng.random() < 0.3 else 70.0 + rng.randrange(6), 30.0 if rng.random() < 0.9 else None] for _ in "12"]
        for o, (x, y, s1, s2, t) in enumerate(((a, b, sides[0], sides[1], won), (b, a, sides[1], sides[0], not won))):
            d = [p - q if p is not None and q is not None else None for p, q in zip(s1, s2)]
            out.append((i, start + dt.timedelta(days=i), o, int(t), rng.choice(["L", "H"]) if o == 0 else out[-1][4], float(round(x * 3)), float(round(y * 3)), x - y, *s1, *s2, *d))
    return spark.createDataFrame(out, SCHEMA)


def test_imputer_uses_fit_rows_only(spark):
    train, test = rows(spark), rows(spark, 50, dt.date(2002, 1, 1), 2)
    imp = PhysicalImputer.fit(train)
    out = imp.transform(test).collect()
    raw = {(r.contest_id, r.orientation): r for r in test.collect()}
    medians = {r["_division"]: r for r in imp.medians.collect()}
    for r in out:
        q = raw[(r.contest_id, r.orientation)]
        assert r.f1_height_in == (q.f1_height_in if q.f1_height_in is not None else medians[q.division]["_of_height_in"])
        if q.f1_reach_in is None and q.f1_height_in is not None:
            assert r.f1_reach_in == pytest.approx(imp.intercept + imp.slope * q.f1_height_in)
        if q.f1_reach_in is None and q.f1_height_in is None:
            assert r.f1_reach_in == medians[q.division]["_of_reach_in"]
        assert r.diff_age == r.f1_age - r.f2_age
    shifted = test.withColumn("f1_height_in", F.col("f1_height_in") + 100)
    assert {r["_division"]: r for r in PhysicalImputer.fit(train).medians.collect()} == medians and shifted.count() == 100


def test_fold_guard(spark):
    train, later = rows(spark, 60), rows(spark, 20, dt.date(2001, 1, 1), 3)
    assert_fit_before(dt.date(2000, 12, 31), later)
    with pytest.raises(FoldLeakError):
        assert_fit_before(dt.date(2001, 1, 1), later)
    m = L.RuleModel().fit(train)
    with pytest.raises(FoldLeakError):
        L.evaluate_model(m, train)
    with pytest.raises(FoldLeakError):
        L.evaluate_model(L.RuleModel(), later)
    assert L.evaluate_model(m, later)["n_contests"] == 20


def test_logistic_explains_itself_and_is_symmetric(spark):
    train, later = rows(spark), rows(spark, 80, dt.date(2002, 1, 1), 2)
    m = L.tune_logistic(train, later, COLS, [0.1, 1.0])
    c = m.contributions(later)
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x["value"]) + F.col("bias")
    for r in c.select(total.alias("z"), "p").collect():
        assert r.z == pytest.approx(math.log(r.p / (1 - r.p)), abs=1e-9)
    assert L.evaluate_model(m, later)["roc_auc"] > 0.7 and m.coefficients()["diff_skill"] > 0
    ab = contest_scores(m.score(later)).collect()
    flipped = later.withColumns({"orientation": 1 - F.col("orientation")})
    ba = {r.contest_id: r.p for r in contest_scores(m.score(flipped)).collect()}
    assert all(r.p + ba[r.contest_id] == pytest.approx(1) for r in ab)
    groups = L.contribution_groups(c.filter("orientation = 0"), c.filter("orientation = 1"), "contest_id")
    z = {r.contest_id: r.z for r in groups.groupBy("contest_id").agg(F.sum("logodds").alias("z")).collect()}
    assert all((z[r.contest_id] > 0) == (r.p > 0.5) for r in ab)


def test_trees_unseen_level_and_choice(spark):
    train, valid = rows(spark, 120), rows(spark, 40, dt.date(2001, 6, 1), 4)
    t = L.TreeModel(numeric=["diff_skill", "diff_reach_in"], categorical=["division"], trees=3, depth=2).fit(train, valid)
    later = rows(spark, 30, dt.date(2002, 1, 1), 5).withColumn("division", F.lit("Unseen"))
    assert L.evaluate_model(t, later)["n_contests"] == 30
    shares = t.importances()
    assert abs(sum(shares.values()) - 1) < 1e-9 and L.flag_dominance(shares, 0.25)[0] == "diff_skill"
    assert L.choose([t, L.RuleModel().fit(train)], later) is not None
    assert L.refit(t, valid).fitted_until > t.fitted_until


def test_gates_and_walk_forward(spark):
    a, b = {"rows": 1}, {"rows": 2}
    assert L.promotion_gates(a, a, {"slices": [1], "fingerprint": a}) == []
    assert len(L.promotion_gates(a, b, {"slices": [1], "fingerprint": b})) == 2 and len(L.promotion_gates(a, None, None)) == 2
    r = rows(spark, 200)
    w = {x.cutoff: x for x in L.walk_forward_rule(r, [("2000-03-01", "2000-05-01"), ("2000-05-01", None)]).collect()}
    assert w["2000-03-01"].n_fit == 60 and w["2000-03-01"].n_contests == 61 and w["2000-05-01"].n_contests == 200 - 121
    out = L.walk_forward(r, [("2000-05-01", None)], lambda tr, va: [L.LogisticModel(COLS, 1.0).fit(tr)], inner_years=0)
    assert out[0]["model"] == "logistic" and out[0]["fitted_until"] == "2000-04-30"


def test_queries_tune_over_all_columns(spark, monkeypatch):
    """Each model query hands all its columns to the whole grid."""
    from duelframe.operators.matchup import ENTITY_FEATURES
    from duelframe.plans import q_models as Q
    from duelframe.plans.catalog import QUERIES

    class Stop(Exception):
        pass
    asked = {}

    def tune_logistic(train, valid, columns, grid=L.C_GRID):
        asked["logistic"] = (columns, grid)
        raise Stop

    def tune_trees(train, valid, **fixed):
        asked["trees"] = fixed
        raise Stop
    f = rows(spark, 40).withColumn("split", F.when(F.col("contest_id") < 20, "train").when(F.col("contest_id") < 30, "valid").otherwise("test"))
    monkeypatch.setattr(Q, "_stored_features", lambda *_: f)
    monkeypatch.setattr(L, "tune_logistic", tune_logistic)
    monkeypatch.setattr(L, "tune_trees", tune_trees)
    for name in ("logistic_fit_score", "linear_contributions", "gbt_fit_score"):
        with pytest.raises(Stop):
            QUERIES[name](spark, "")
    assert asked == {"logistic": ([f"diff_{c}" for c in ENTITY_FEATURES], L.C_GRID), "trees": {"trees": 3000}}


def test_early_stopping_waits_for_a_worse_tree(spark):
    train, valid = rows(spark, 120), rows(spark, 60, dt.date(2001, 6, 1), 4)
    grown = {tol: L.TreeModel(numeric=["diff_reach_in"], categorical=["division"], trees=6, depth=2, step=0.01, tolerance=tol).fit(train, valid).pipe.stages[-1].getNumTrees for tol in (0.0, 0.01)}
    assert grown[0.01] == 1 <= grown[0.0] and L.TreeModel().tolerance == 0.0


def test_all_raw_checks_are_counted(spark, monkeypatch):
    from duelframe.plans import q_ingest as Q
    from duelframe.plans.catalog import QUERIES

    tables = Q._typed_tables

    def planted(spark, d):
        t = tables(spark, d)
        one = t["contests"].agg(F.min("contest_id")).first()[0]
        t["contests"] = t["contests"].withColumn("result", F.when(F.col("contest_id") == one, "odd").otherwise(F.col("result")))
        return t
    monkeypatch.setattr(Q, "_typed_tables", planted)
    got = {r.check: r.violations for r in QUERIES["quality_checks_raw_all"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) > 15 and got["result not in win/draw/nc"] == 1 and got["events with no contests"] == 0
