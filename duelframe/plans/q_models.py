"""Queries: imputation, rule / logistic / tree models, explanations, walk-forward test and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import impute as P
from ..operators import matchup as M
from ..operators import merge as G
from ..operators import metrics as X
from ..operators import models as L
from ..operators.backtest import backtest
from ..operators.boosting import Config
from ..session import cut_lineage
from . import oracle as O
from . import views as V
from .oracle import r6 as q6, sql
from .registry import query
from .views import r6

CUTOFFS = [("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01"), ("2001-01-01", None)]
_MODEL_COLUMNS = [c for c in M.numeric_feature_columns() if c.startswith("diff_")]
#: The most trees of a model; early stopping picks the number.
_TREES = 3000
#: Trees of the models that are explained.
_EXPLAINED = 60

# Bio of both sides of every target contest, one row per orientation 0 row.
_PHYS = f"""phys AS (SELECT t.contest_id, t.event_date, coalesce(t.division, '?') AS division, {", ".join(
    f"e{s}.height_in AS f{s}_height_in, e{s}.reach_in AS f{s}_reach_in, date_diff('day', e{s}.dob, t.event_date) / 365.25::DOUBLE AS f{s}_age" for s in "12")}
  FROM target t LEFT JOIN entity e1 ON e1.entity_id = t.entity_1_id LEFT JOIN entity e2 ON e2.entity_id = t.entity_2_id),
  sides AS (SELECT division, f1_height_in AS height_in, f1_reach_in AS reach_in, f1_age AS age FROM phys UNION ALL SELECT division, f2_height_in, f2_reach_in, f2_age FROM phys)"""


def _physical_rows(spark, d):
    c, e = V.contests(spark, d, False).filter("is_target").select("contest_id", "event_date", "division", "entity_1_id", "entity_2_id"), V.entity(spark, d)
    for s in ("1", "2"):
        c = c.join(e.select(F.col("entity_id").alias(f"entity_{s}_id"), F.col("height_in").alias(f"f{s}_height_in"), F.col("reach_in").alias(f"f{s}_reach_in"), F.col("dob").alias(f"dob_{s}")), f"entity_{s}_id", "left")
    return c.withColumns({f"f{s}_age": M.age_years(F.col("event_date"), F.col(f"dob_{s}")) for s in ("1", "2")})


_MEASURES = " UNION ALL ".join(f"SELECT division, '{m}' AS measure, {m} AS v FROM sides" for m in P.PHYSICAL)


@query("group_median", sql(f"""WITH {_PHYS} SELECT division, measure, {q6('median(v)')} AS median FROM ({_MEASURES}) GROUP BY 1, 2 UNION ALL SELECT NULL, measure, {q6('median(v)')} FROM ({_MEASURES}) GROUP BY 2""", "target", "entity"))
def _(spark, d):
    return P.group_medians(P.stacked_sides(_physical_rows(spark, d))).withColumn("median", r6("median"))


@query("linear_fit", sql(f"WITH {_PHYS} SELECT {q6('regr_slope(reach_in, height_in)')} AS slope, {q6('regr_intercept(reach_in, height_in)')} AS intercept FROM sides", "target", "entity"))
def _(spark, d):
    return P.linear_fit(P.stacked_sides(_physical_rows(spark, d))).select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("impute_physical", sql(f"""WITH {_PHYS}, fit AS (SELECT regr_slope(reach_in, height_in) AS k, regr_intercept(reach_in, height_in) AS c FROM sides),
  dm AS (SELECT division, median(height_in) AS h, median(reach_in) AS r, median(age) AS a FROM sides GROUP BY 1)
  SELECT contest_id, {q6('coalesce(f1_height_in, h)')} AS f1_height_in, {q6('coalesce(f1_reach_in, c + k * f1_height_in, r)')} AS f1_reach_in, {q6('coalesce(f1_age, a)')} AS f1_age,
  {q6('coalesce(f1_reach_in, c + k * f1_height_in, r) - coalesce(f2_reach_in, c + k * f2_height_in, r)')} AS diff_reach_in, {q6('coalesce(f1_height_in, h) - coalesce(f2_height_in, h)')} AS diff_height_in
  FROM phys JOIN dm USING (division) CROSS JOIN fit""", "target", "entity"))
def _(spark, d):
    rows = _physical_rows(spark, d)
    out = P.PhysicalImputer.fit(rows).transform(rows)
    return out.select("contest_id", *[r6(c).alias(c) for c in ("f1_height_in", "f1_reach_in", "f1_age", "diff_reach_in", "diff_height_in")])


@query("missingness_report", sql("""WITH r AS (SELECT l.quality, c.c_acctbal, CASE WHEN l.doc_id % 7 <> 0 THEN 1 END AS a, CASE WHEN l.toxic = 0 THEN 1 END AS b FROM labels l LEFT JOIN customer c ON c.c_custkey = l.doc_id AND c.c_acctbal > 2000),
  u AS (SELECT 'acctbal' AS feature, c_acctbal IS NULL AS miss, quality FROM r UNION ALL SELECT 'a', a IS NULL, quality FROM r UNION ALL SELECT 'b', b IS NULL, quality FROM r)
  SELECT feature, """ + q6("avg(miss::INT)") + " AS missing_share, " + q6("avg(quality) FILTER (miss)") + " AS target_rate_missing, " + q6("avg(quality) FILTER (NOT miss)") + """ AS target_rate_present
  FROM u GROUP BY 1 HAVING avg(miss::INT) >= 0.01 AND count(*) FILTER (miss) >= 30"""))
def _(spark, d):
    c = V.table(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("acctbal"))
    rows = V.table(spark, d, "labels").join(c, "doc_id", "left").withColumns({"a": F.when(F.col("doc_id") % 7 != 0, 1), "b": F.when(F.col("toxic") == 0, 1)})
    rep = X.missingness_report(rows, ["acctbal", "a", "b"], target="quality")
    return rep.select("feature", *[r6(x).alias(x) for x in ("missing_share", "target_rate_missing", "target_rate_present")])


def _rule_rows(spark, d):
    """Both orientations of every target contest with earlier wins only."""
    r = V.records_before(spark, d)
    def row(o, a, b, who):
        return F.struct(F.lit(o).alias("orientation"), F.col(f"w{a}").alias("f1_n_wins"), F.col(f"w{b}").alias("f2_n_wins"), (F.col("winner_id") == F.col(f"entity_{who}_id")).cast("int").alias("target"))
    return r.select("contest_id", "event_date", F.explode(F.array(row(0, 1, 2, "1"), row(1, 2, 1, "2"))).alias("o")).select("contest_id", "event_date", "o.*").withColumn(
        "split", M.assign_split(F.col("event_date"), V.TRAIN_END, V.VALID_END))


@query("baseline_rule", sql(f"""SELECT {O.SPLIT} AS split, count(*) FILTER (w1 <> w2) AS decided, {q6('avg(((w1 > w2) = (winner_id = entity_1_id))::INT) FILTER (w1 <> w2)')} AS p_favourite, max(event_date) AS fitted_until
  FROM records GROUP BY 1""", "records"))
def _(spark, d):
    return L.baseline_rule(_rule_rows(spark, d), ["split"]).withColumn("p_favourite", r6("p_favourite"))


_SLICES = "(VALUES " + ", ".join(f"('{a}', DATE '{a}', {'DATE ' + repr(b) if b else 'NULL'})" for a, b in CUTOFFS) + ") s(cutoff, lo, hi)"


@query("walk_forward_slices", sql(f"""WITH fit AS (SELECT cutoff, count(*) AS n_fit, avg(((w1 > w2) = (winner_id = entity_1_id))::INT) FILTER (w1 <> w2) AS f, max(event_date) AS fitted_until FROM records JOIN {_SLICES} ON event_date < lo GROUP BY 1),
  t AS (SELECT s.cutoff, (winner_id = entity_1_id)::INT AS y, CASE WHEN w1 > w2 THEN f WHEN w1 < w2 THEN 1 - f ELSE 0.5 END AS p FROM records JOIN {_SLICES} ON event_date >= lo AND (hi IS NULL OR event_date < hi) JOIN fit ON fit.cutoff = s.cutoff)
  SELECT cutoff, any_value(n_fit) AS n_fit, any_value(fitted_until) AS fitted_until, count(*) AS n_contests, {q6('any_value(f)')} AS p_favourite, {q6('avg((p - y) ** 2)')} AS brier,
  {q6('avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END)')} AS log_loss FROM t JOIN fit USING (cutoff) GROUP BY 1""", "records"))
def _(spark, d):
    w = L.walk_forward_rule(_rule_rows(spark, d), CUTOFFS)
    return w.select("cutoff", "n_fit", "fitted_until", "n_contests", *[r6(c).alias(c) for c in ("p_favourite", "brier", "log_loss")])


@query("topk_by_magnitude", "SELECT c_custkey, c_acctbal - 4500 AS v FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 20")
def _(spark, d):
    return L.top_by_magnitude(V.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("v")), "v", 20)


@query("contribution_groups", """SELECT l_orderkey AS row_id, grp, round(sum(v), 6) + 0.0 AS logodds FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'age' WHEN 1 THEN 'stance' ELSE 'reach_in' END AS grp,
  CASE WHEN l_linestatus = 'F' THEN l_quantity / 100 * 0.5 ELSE l_quantity / 100 * -0.5 END AS v FROM lineitem) GROUP BY 1, 2""")
def _(spark, d):
    return L.contribution_groups(*_contrib(spark, d), "row_id").withColumn("logodds", r6("logodds"))


def _contrib(spark, d):
    """Contributions of both orientations: lines of an order, by line status."""
    li = V.table(spark, d, "lineitem")
    name = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_returnflag") == "A", "f1_age").otherwise("diff_age")).when(F.col("l_linenumber") % 3 == 1, "f1_stance").otherwise("f2_reach_in")
    rows = li.select(F.col("l_orderkey").alias("row_id"), "l_linestatus", F.array(F.struct(name.alias("feature"), (F.col("l_quantity") / 100).alias("value"))).alias("contrib"))
    return rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus <> 'F'")


@query("top_drivers", """WITH g AS (SELECT l_orderkey AS row_id, grp, round(sum(v), 6) AS logodds FROM (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'age' WHEN 1 THEN 'stance' ELSE 'reach_in' END AS grp,
  CASE WHEN l_linestatus = 'F' THEN l_quantity / 100 * 0.5 ELSE l_quantity / 100 * -0.5 END AS v FROM lineitem) GROUP BY 1, 2)
  SELECT row_id, CASE WHEN logodds > 0 THEN 1 ELSE 2 END AS side, grp, logodds, row_number() OVER (PARTITION BY row_id, logodds > 0 ORDER BY abs(logodds) DESC, grp)::INT AS rank FROM g WHERE abs(logodds) > 0.02
  QUALIFY row_number() OVER (PARTITION BY row_id, logodds > 0 ORDER BY abs(logodds) DESC, grp) <= 3""")
def _(spark, d):
    g = L.contribution_groups(*_contrib(spark, d), "row_id").withColumn("logodds", F.round("logodds", 6))
    return L.top_drivers(g, "row_id", k=3).select("row_id", "side", "grp", "logodds", "rank")


def _stored_features(spark, d, columns=None):
    """The feature table, or some of its columns, as a stored data set, as training jobs read it."""
    f = V.features(spark, d, store=True)
    return cut_lineage(f.select(*columns) if columns else f, "features", compact=True)


#: What a logistic model reads of a feature row, besides what names it.
_LOGISTIC_COLUMNS = ["contest_id", "event_date", "orientation", "target", "division", *[f"f{s}_{p}" for s in "12" for p in P.PHYSICAL], *_MODEL_COLUMNS]


def _fitted(spark, d):
    """Features, the logistic model tuned on the validation split, and the same fitted on all rows before the test split."""
    f = _stored_features(spark, d, [*_LOGISTIC_COLUMNS, "split"])
    m = L.tune_logistic(f.filter("split = 'train'"), f.filter("split = 'valid'"), _MODEL_COLUMNS)
    return f, m, L.refit(m, f.filter("split <> 'test'"))


def _guarded(m, rows):
    P.assert_fit_before(m.fitted_until, rows, m.name)
    return M.contest_scores(m.score(rows)).withColumn("p", F.round("p", 6))


@query("logistic_fit_score")
def _(spark, d):
    """Validation contests by the model of the training split, test contests by the one of both."""
    f, m, final = _fitted(spark, d)
    return _guarded(m, f.filter("split = 'valid'")).unionByName(_guarded(final, f.filter("split = 'test'")))


@query("linear_contributions", sql(f"""SELECT contest_id, o.orientation, {len(_MODEL_COLUMNS)} AS terms, true AS adds_up FROM target, (VALUES (0), (1)) o(orientation)
  WHERE event_date >= DATE '{V.VALID_END}'""", "target"))
def _(spark, d):
    """Whether each row's contributions and the bias add up to the logit of its probability."""
    f, _, m = _fitted(spark, d)
    c = m.contributions(f.filter("split = 'test'"))
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x["value"]) + F.col("bias")
    return c.select("contest_id", "orientation", F.size("contrib").alias("terms"), (F.abs(total - F.log(F.col("p") / (1 - F.col("p")))) < 1e-6).alias("adds_up"))


@query("gbt_fit_score")
def _(spark, d):
    f = _stored_features(spark, d)
    m = L.tune_trees(f.filter("split = 'train'"), f.filter("split = 'valid'"), trees=_TREES)
    return _guarded(L.refit(m, f.filter("split <> 'test'")), f.filter("split = 'test'"))


def _trees(spark, d):
    """Features, and a tree model of fixed size fitted on all rows before the test split."""
    f = _stored_features(spark, d)
    return f, L.BoostedModel(config=Config(trees=_EXPLAINED)).fit(f.filter("split <> 'test'"))


@query("tree_contributions", sql(f"""SELECT contest_id, o.orientation, {len(M.numeric_feature_columns()) + len(M.CATEGORICAL)} AS terms, true AS adds_up FROM target, (VALUES (0), (1)) o(orientation)
  WHERE event_date >= DATE '{V.VALID_END}'""", "target"))
def _(spark, d):
    """Whether each row's Shapley values and the bias add up to the logit of the probability that scoring gives."""
    f, m = _trees(spark, d)
    test = f.filter("split = 'test'")
    row = ["contest_id", "orientation"]
    c = m.contributions(test, row).drop("p").join(m.score(test, row), row)
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x["value"]) + F.col("bias")
    return c.select("contest_id", "orientation", F.size("contrib").alias("terms"), (F.abs(total - F.log(F.col("p") / (1 - F.col("p")))) < 1e-6).alias("adds_up"))


@query("key_factors")
def _(spark, d):
    """What the tree model's forecast of each test contest rests on: the strongest groups of features per side."""
    f, m = _trees(spark, d)
    c = m.contributions(f.filter("split = 'test'"), ["contest_id", "orientation"])
    drivers = L.top_drivers(L.contribution_groups(c.filter("orientation = 0"), c.filter("orientation = 1"), "contest_id"), "contest_id")
    names = f.filter("split = 'test' and orientation = 0").select("contest_id", *[F.concat(F.lit("E"), f"entity_{s}_id").alias(f"name_{s}") for s in "12"])
    return L.key_factor_text(drivers, names, "contest_id")


@query("walk_forward_models")
def _(spark, d):
    """Rule, logistic and tree model per cut-off: tuned on the year before it, fitted on everything before it, tested
    behind it; `chosen` has the lowest log loss of that year. `walk_forward_slices` is the rule alone."""
    w = backtest(_stored_features(spark, d), CUTOFFS, M.numeric_feature_columns(), M.CATEGORICAL, _MODEL_COLUMNS)
    return w.select("cutoff", "model", "params", "n_fit", "fitted_until", "n_contests", "chosen", *[r6(c).alias(c) for c in ("roc_auc", "brier", "log_loss", "ece", "accuracy")])


_SPLIT = f"CASE WHEN event_date < DATE '{V.TRAIN_END}' THEN 'train' WHEN event_date < DATE '{V.VALID_END}' THEN 'valid' ELSE 'test' END"


@query("fold_guard", sql(f"""SELECT {_SPLIT} AS split, min(event_date) AS first_day, count(*) * 2 AS rows, min(event_date) <= (SELECT max(event_date) FROM target WHERE event_date < DATE '{V.TRAIN_END}') AS refused
  FROM target GROUP BY 1""", "target"))
def _(spark, d):
    """What the guard says to an evaluation of each split by a model that was fitted on the training split."""
    f = cut_lineage(V.features(spark, d).select("split", "event_date"), "days", compact=True)
    until = P.fit_window(f.filter("split = 'train'"))
    verdicts = []
    for split in ("train", "valid", "test"):
        try:
            P.assert_fit_before(until, f.filter(F.col("split") == split), split)
            verdicts.append(F.when(F.col("split") == split, False))
        except P.FoldLeakError:
            verdicts.append(F.when(F.col("split") == split, True))
    return f.groupBy("split").agg(F.min("event_date").alias("first_day"), F.count(F.lit(1)).alias("rows")).withColumn("refused", F.coalesce(*verdicts))


@query("score_slate")
def _(spark, d):
    """The last 30 days as an upcoming slate: history is first reduced to the slate's entities."""
    c = V.stored_contests(spark, d)
    last = c.agg(F.max("event_date")).first()[0]
    day = F.col("event_date")
    slate = c.filter(day > F.date_sub(F.lit(last), 30)).select("contest_id", "event_date", "entity_1_id", "entity_2_id", "division", "is_title", "scheduled_rounds")
    ids = slate.select(F.explode(F.array("entity_1_id", "entity_2_id")).alias("entity_id")).distinct()
    past = H.appearances(c.filter(day <= F.date_sub(F.lit(last), 30))).join(ids, "entity_id", "left_semi")
    states = H.daily_states(past)
    feats = M.entity_features(states, H.division_days(past), V.entity(spark, d), M.side_probes(slate))
    rows = cut_lineage(M.matchup_columns(M.orientations(M.pair_features(slate, feats))), "slate", compact=True)
    train = cut_lineage(V.features(spark, d, store=True).filter(day <= F.date_sub(F.lit(last), 30)).select(*_LOGISTIC_COLUMNS), "train", compact=True)
    year = F.add_months(F.date_sub(F.lit(last), 30), -12)       # C is chosen on the last year before the slate
    m = L.refit(L.tune_logistic(train.filter(day < year), train.filter(day >= year), _MODEL_COLUMNS), train)
    P.assert_fit_before(m.fitted_until, rows, m.name)
    scored = m.score(rows.withColumn("target", F.lit(0)))
    return M.contest_scores(scored).select("contest_id", "event_date", F.round("p", 4).alias("p_1"), (F.round(1 - F.round("p", 4), 4)).alias("p_2"))


_GATES = {"same": "", "unchecked": "provenance: features were not checked", "changed_features": "provenance: features changed after the check; backtest: run on different features",
          "no_backtest": "backtest: not run"}


@query("promotion_report", sql("WITH n AS (SELECT count(*) * 2 AS rows FROM target) " + " UNION ALL ".join(
    f"SELECT '{case}' AS case_name, rows{' - 2' if case == 'changed_features' else ''} AS rows, '{reasons}' AS reasons FROM n" for case, reasons in _GATES.items()), "target"))
def _(spark, d):
    """The gates for a feature table as checked, never checked, short of one contest since the check, and never backtested."""
    f = _stored_features(spark, d)
    checked = G.fingerprint(f.repartition("contest_id")).first().asDict()
    gone = f.agg(F.max("contest_id")).first()[0]
    short = G.fingerprint(f.filter(F.col("contest_id") != gone)).first().asDict()
    backtest = {"slices": [r["cutoff"] for r in L.slices(f.select("event_date"), CUTOFFS).groupBy("cutoff").count().collect()], "fingerprint": checked}
    cases = {"same": (checked, checked, backtest), "unchecked": (checked, None, backtest), "changed_features": (short, checked, backtest), "no_backtest": (checked, checked, None)}
    rows = [(name, now["rows"], "; ".join(L.promotion_gates(now, *rest))) for name, (now, *rest) in cases.items()]
    return spark.createDataFrame(rows, "case_name string, rows long, reasons string")
