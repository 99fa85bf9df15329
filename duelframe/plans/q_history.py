"""Queries: appearances, running state, strict as-of, features, orientation, scores and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import matchup as M
from ..operators import metrics as X
from ..session import cut_lineage
from . import oracle as O
from . import views as V
from .oracle import r6 as q6, sql
from .registry import query
from .views import r6

_CUM = [c for c in H.COUNTS if c != "stat_contests"]


@query("appearances_union", sql("""SELECT contest_id, side, entity_id, opponent_id, event_date, division, outcome,
  wins, losses, draws, ncs, ko_wins, sub_wins, ko_losses, sub_losses FROM app""", "app"))
def _(spark, d):
    a = V.appearances(spark, d)
    outcome = F.when(F.col("wins") == 1, "win").when(F.col("losses") == 1, "loss").when(F.col("draws") == 1, "draw").otherwise("nc")
    return a.select("contest_id", "side", "entity_id", "opponent_id", "event_date", "division", outcome.alias("outcome"),
                    "wins", "losses", "draws", "ncs", "ko_wins", "sub_wins", "ko_losses", "sub_losses")


@query("division_history", sql("SELECT DISTINCT entity_id, division, event_date FROM app", "app"))
def _(spark, d):
    return H.division_days(V.appearances(spark, d))


@query("own_and_opponent_stats", sql("SELECT contest_id, side, entity_id, stat_contests, " + ", ".join(
    [*H.OWN_STATS, "opp_landed", "opp_attempted", "opp_missed", "opp_td_missed"]) +
    " FROM (SELECT *, opp_attempted - opp_landed AS opp_missed, opp_td_attempted - opp_td_landed AS opp_td_missed FROM app_stats0)", "app_stats0"))
def _(spark, d):
    return V.appearances(spark, d, with_stats=True).select(
        "contest_id", "side", "entity_id", "stat_contests", *H.OWN_STATS, "opp_landed", "opp_attempted", "opp_missed", "opp_td_missed")


@query("cumulative_record", sql("SELECT contest_id, entity_id, side, bout_order, " + ", ".join(f"cum_{c}" for c in _CUM) + " FROM running", "running"))
def _(spark, d):
    a = H.appearances(V.stored_contests(spark, d, with_order=True, with_stats=False))
    return H.running_record(a).select("contest_id", "entity_id", "side", "bout_order", *[f"cum_{c}" for c in _CUM])


@query("signed_streak", sql("SELECT contest_id, entity_id, event_date, streak FROM running", "running"))
def _(spark, d):
    return H.running_record(H.appearances(V.stored_contests(spark, d, with_order=True, with_stats=False))).select("contest_id", "entity_id", "event_date", "streak")


@query("daily_state", sql("SELECT entity_id, event_date, streak, " + ", ".join(f"cum_{c}" for c in _CUM) + " FROM state", "state"))
def _(spark, d):
    return V.states(spark, d).select("entity_id", "event_date", "streak", *[f"cum_{c}" for c in _CUM])


def _ratio(num: str, den: str, scale: int) -> str:
    return q6(f"CASE WHEN {den} > 0 THEN {num} / {den} END * {scale}")


@query("cumulative_rates", sql("SELECT entity_id, event_date, cum_stat_contests, " + ", ".join(
    f"{_ratio(f'cum_num_{r}', f'cum_den_{r}', s)} AS {r}" for r, (_, _, s) in H.RATES.items()) + " FROM state_stats", "state_stats"))
def _(spark, d):
    return V.states(spark, d, True).select("entity_id", "event_date", "cum_stat_contests", *[
        r6(M.guarded_ratio(F.col(f"cum_num_{r}"), F.col(f"cum_den_{r}")) * s).alias(r) for r, (_, _, s) in H.RATES.items()])


@query("last3_rates", sql("SELECT entity_id, event_date, " + ", ".join(
    f"{_ratio(f'last_num_{r}', f'last_den_{r}', s)} AS {r}_l3" for r, (_, _, s) in H.RATES.items()) + " FROM state_stats", "state_stats"))
def _(spark, d):
    return V.states(spark, d, True).select("entity_id", "event_date", *[
        r6(M.guarded_ratio(F.col(f"last_num_{r}"), F.col(f"last_den_{r}")) * s).alias(f"{r}_l3") for r, (_, _, s) in H.RATES.items()])


def _strict_states(spark, d):
    a = V.appearances(spark, d)
    states = H.daily_states(a, with_rates=False).select("entity_id", "event_date", "cum_contests", "cum_wins", "streak")
    pre = H.asof_strict(states, a, ["entity_id"])
    return a.select("contest_id", "side", "entity_id", "event_date").join(pre, ["entity_id", "event_date"])


_ASOF = "FROM app a ASOF LEFT JOIN state s ON s.entity_id = a.entity_id AND a.event_date > s.event_date"


@query("asof_strict_state", sql(f"""SELECT a.contest_id, a.side, a.entity_id, a.event_date, s.event_date AS hist_date,
  s.cum_contests, s.cum_wins, s.streak {_ASOF}""", "app", "state"))
def _(spark, d):
    return _strict_states(spark, d)


@query("layoff_days", sql(f"SELECT a.contest_id, a.side, date_diff('day', s.event_date, a.event_date)::BIGINT AS layoff_days {_ASOF}", "app", "state"))
def _(spark, d):
    return _strict_states(spark, d).select("contest_id", "side", F.date_diff("event_date", "hist_date").cast("long").alias("layoff_days"))


@query("smoothed_rates", sql("""SELECT entity_id, event_date, """ + q6("(cum_wins + 1)::DOUBLE / (cum_contests + 2)") + " AS win_rate, "
    + q6("CASE WHEN cum_wins > 0 THEN (cum_ko_wins + cum_sub_wins)::DOUBLE / cum_wins END") + " AS finish_rate FROM state", "state"))
def _(spark, d):
    return V.states(spark, d).select(
        "entity_id", "event_date", r6(M.smoothed_win_rate(F.col("cum_wins"), F.col("cum_contests"))).alias("win_rate"),
        r6(M.guarded_ratio(F.col("cum_ko_wins") + F.col("cum_sub_wins"), F.col("cum_wins"))).alias("finish_rate"))


@query("first_in_division", sql("""SELECT a.contest_id, a.side, max(h.event_date) AS div_hist_date, (max(h.event_date) IS NULL)::INT AS first_in_division
  FROM app a LEFT JOIN (SELECT DISTINCT entity_id, division, event_date FROM app) h
    ON h.entity_id = a.entity_id AND h.division = a.division AND h.event_date < a.event_date GROUP BY 1, 2""", "app"))
def _(spark, d):
    a = V.appearances(spark, d)
    days = H.division_days(a)
    pre = H.asof_strict(days, days, ["entity_id", "division"])
    return (a.select("contest_id", "side", "entity_id", "division", "event_date").join(pre, ["entity_id", "division", "event_date"])
            .select("contest_id", "side", F.col("hist_date").alias("div_hist_date"), F.col("hist_date").isNull().cast("int").alias("first_in_division")))


@query("bio_attach", sql("SELECT a.contest_id, a.side, e.height_in, " + q6("e.reach_in") + " AS reach_in, e.stance, "
    + q6("date_diff('day', e.dob, a.event_date) / 365.25::DOUBLE") + " AS age FROM app a LEFT JOIN entity e USING (entity_id)", "app", "entity"))
def _(spark, d):
    a = V.appearances(spark, d).select("contest_id", "side", "entity_id", "event_date")
    return a.join(V.entity(spark, d), "entity_id", "left").select(
        "contest_id", "side", "height_in", r6("reach_in").alias("reach_in"), "stance", r6(M.age_years(F.col("event_date"), F.col("dob"))).alias("age"))


@query("audit_sources", sql("""SELECT entity_id, event_date, coalesce(sum(n) OVER w, 0)::BIGINT AS n_sources, max(event_date) OVER w AS max_source_date,
  (sum(ids) OVER w)::BIGINT AS id_sum FROM (SELECT entity_id, event_date, count(*) AS n, sum(contest_id) AS ids FROM app GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY entity_id ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "app"))
def _(spark, d):
    return H.earlier_sources(V.appearances(spark, d)).drop("id_hash").withColumn("id_sum", F.col("id_sum").cast("long"))


@query("audit_source_chunks", sql(f"""SELECT entity_id, (place // {H.SOURCE_CHUNK})::BIGINT AS chunk, string_agg(contest_id, ',' ORDER BY place) AS ids
  FROM (SELECT entity_id, contest_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) - 1 AS place FROM app) GROUP BY ALL""", "app"))
def _(spark, d):
    """Every entity's contests in order; the list of any row is a prefix that `audit_sources.n_sources` measures."""
    return H.source_chunks(V.appearances(spark, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


# ------------------------------------------------------------------ full feature rows

def _side_sql(s: str) -> dict[str, str]:
    st, e = f"s{s}", f"e{s}"
    n, w = f"coalesce({st}.cum_contests, 0)", f"coalesce({st}.cum_wins, 0)"
    out = {
        "n_contests": n, "n_wins": w, "n_losses": f"coalesce({st}.cum_losses, 0)",
        "win_rate": f"({w} + 1)::DOUBLE / ({n} + 2)", "streak": f"coalesce({st}.streak, 0)",
        "layoff_days": f"date_diff('day', {st}.event_date, t.event_date)", "is_newcomer": f"({n} = 0)::INT",
        "finish_rate": f"CASE WHEN {w} > 0 THEN (coalesce({st}.cum_ko_wins, 0) + coalesce({st}.cum_sub_wins, 0))::DOUBLE / {w} END",
        "ko_losses": f"coalesce({st}.cum_ko_losses, 0)", "sub_losses": f"coalesce({st}.cum_sub_losses, 0)",
        "n_stat_contests": f"coalesce({st}.cum_stat_contests, 0)",
    }
    for r, (_, _, k) in H.RATES.items():
        out[r] = f"CASE WHEN {st}.cum_den_{r} > 0 THEN {st}.cum_num_{r} / {st}.cum_den_{r} END * {k}"
        out[f"{r}_l3"] = f"CASE WHEN {st}.last_den_{r} > 0 THEN {st}.last_num_{r} / {st}.last_den_{r} END * {k}"
    return out | {"height_in": f"{e}.height_in", "reach_in": f"{e}.reach_in",
                  "age": f"date_diff('day', {e}.dob, t.event_date) / 365.25::DOUBLE",
                  "first_in_division": f"(d{s}.event_date IS NULL)::INT"}


def _feature_sql() -> str:
    f1, f2 = _side_sql("1"), _side_sql("2")
    cols = ["t.contest_id", "t.event_date", "t.entity_1_id", "t.entity_2_id", "t.orientation", "t.target", "t.division", "t.split",
            f"{q6('t.is_title::INT')} AS is_title", f"{q6('t.scheduled_rounds')} AS scheduled_rounds",
            "e1.stance AS f1_stance", "e2.stance AS f2_stance",
            "lower(coalesce(e1.stance, 'unknown')) || '_vs_' || lower(coalesce(e2.stance, 'unknown')) AS stance_matchup",
            "greatest(s1.event_date, d1.event_date) AS f1_source_max_date", "greatest(s2.event_date, d2.event_date) AS f2_source_max_date"]
    for f in M.ENTITY_FEATURES:
        cols += [f"{q6(f1[f])} AS f1_{f}", f"{q6(f2[f])} AS f2_{f}", f"{q6(f'({f1[f]})::DOUBLE - ({f2[f]})::DOUBLE')} AS diff_{f}"]
    joins = " ".join(
        f"""ASOF LEFT JOIN state_stats s{s} ON s{s}.entity_id = t.entity_{s}_id AND t.event_date > s{s}.event_date
        ASOF LEFT JOIN dd d{s} ON d{s}.entity_id = t.entity_{s}_id AND d{s}.division = t.div AND t.event_date > d{s}.event_date
        LEFT JOIN entity e{s} ON e{s}.entity_id = t.entity_{s}_id""" for s in "12")
    return f"""WITH dd AS (SELECT DISTINCT entity_id, division, event_date FROM app_stats), t AS (
      SELECT *, coalesce(division, '__unknown__') AS div, {O.SPLIT} AS split, 0 AS orientation, (winner_id = entity_1_id)::INT AS target FROM target
      UNION ALL SELECT * REPLACE (entity_2_id AS entity_1_id, entity_1_id AS entity_2_id), coalesce(division, '__unknown__'), {O.SPLIT}, 1,
        (winner_id = entity_2_id)::INT FROM target)
    SELECT {', '.join(cols)} FROM t {joins}"""


@query("matchup_features", sql(_feature_sql(), "target", "state_stats", "app_stats", "entity"))
def _(spark, d):
    f = V.features(spark, d, store=True)
    return f.select(*[r6(c).alias(c) if c in M.numeric_feature_columns() else F.col(c) for c in f.columns])


@query("provenance_check", sql("""SELECT 'as built' AS features, 0::BIGINT AS violations, count(*) * 2 AS rows_checked FROM records
  UNION ALL SELECT 'moved', coalesce(sum((n1 > 0)::BIGINT + (n2 > 0)::BIGINT) FILTER (contest_id % 17 = 0), 0)::BIGINT, count(*) * 2 FROM records""", "records"))
def _(spark, d):
    """The feature table as built, and with every 17th contest moved back to the last day of its first side's history."""
    f = cut_lineage(V.features(spark, d).select("contest_id", "event_date", "f1_source_max_date", "f2_source_max_date"), "dated")     # four counts read it
    moved = f.withColumn("event_date", F.when(F.col("contest_id") % 17 == 0, F.col("f1_source_max_date")).otherwise(F.col("event_date")))
    def verdict(name, rows):
        bad = M.provenance_violations(rows).agg(F.count(F.lit(1)).alias("violations"))
        return bad.select(F.lit(name).alias("features"), "violations", F.lit(0).cast("long").alias("rows_checked")).unionByName(
            rows.agg(F.count(F.lit(1)).alias("rows_checked")).select(F.lit(name).alias("features"), F.lit(0).cast("long").alias("violations"), "rows_checked"))
    return verdict("as built", f).unionByName(verdict("moved", moved)).groupBy("features").agg(F.sum("violations").alias("violations"), F.sum("rows_checked").alias("rows_checked"))


@query("orientation_expand", sql("""SELECT contest_id, 0 AS orientation, entity_1_id, entity_2_id, (winner_id = entity_1_id)::INT AS target FROM target
  UNION ALL SELECT contest_id, 1, entity_2_id, entity_1_id, (winner_id = entity_2_id)::INT FROM target""", "target"))
def _(spark, d):
    c = V.contests(spark, d, False).filter("is_target").select("contest_id", "entity_1_id", "entity_2_id", "winner_id")
    return M.orientations(c).select("contest_id", "orientation", "entity_1_id", "entity_2_id", "target")


@query("time_split", sql(f"SELECT {O.SPLIT} AS split, count(*) AS n, min(event_date) AS first_day, max(event_date) AS last_day FROM target GROUP BY 1", "target"))
def _(spark, d):
    c = V.contests(spark, d, False).filter("is_target")
    return c.groupBy(M.assign_split(F.col("event_date"), V.TRAIN_END, V.VALID_END).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"))


@query("matchup_diff", sql(f"SELECT contest_id, (n1 - n2)::BIGINT AS diff_n_contests, (w1 - w2)::BIGINT AS diff_n_wins, {q6('a - b')} AS diff_win_rate FROM rated", "rated"))
def _(spark, d):
    r = V.records_before(spark, d)
    s1, s2 = M.smoothed_win_rate(F.col("w1"), F.col("n1")), M.smoothed_win_rate(F.col("w2"), F.col("n2"))
    return r.select("contest_id", (F.col("n1") - F.col("n2")).alias("diff_n_contests"), (F.col("w1") - F.col("w2")).alias("diff_n_wins"),
                    r6(s1 - s2).alias("diff_win_rate"))


@query("categorical_pair", sql("""SELECT lower(coalesce(a.stance, 'unknown')) || '_vs_' || lower(coalesce(b.stance, 'unknown')) AS stance_matchup,
  count(*) AS n FROM contest c LEFT JOIN entity a ON a.entity_id = c.entity_1_id LEFT JOIN entity b ON b.entity_id = c.entity_2_id GROUP BY 1""", "contest", "entity"))
def _(spark, d):
    c, e = V.contests(spark, d, False), V.entity(spark, d)
    for s in ("1", "2"):
        c = c.join(e.select(F.col("entity_id").alias(f"entity_{s}_id"), F.col("stance").alias(f"stance_{s}")), f"entity_{s}_id", "left")
    return c.groupBy(M.stance_pair(F.col("stance_1"), F.col("stance_2")).alias("stance_matchup")).agg(F.count(F.lit(1)).alias("n"))


@query("pair_sides", sql("""SELECT contest_id, max(wins) FILTER (side = 1) AS f1_wins, max(wins) FILTER (side = 2) AS f2_wins,
  max(division) FILTER (side = 1) AS f1_division, max(division) FILTER (side = 2) AS f2_division FROM app GROUP BY 1""", "app"))
def _(spark, d):
    return M.pair_sides(V.appearances(spark, d), "contest_id", ["wins", "division"])


@query("symmetric_probability", sql("SELECT contest_id, target, p FROM scores", "scores"))
def _(spark, d):
    return V.scores(spark, d).select("contest_id", "target", "p")


@query("contest_level_score", sql(f"SELECT split, count(*) AS n, sum(target)::BIGINT AS wins, {q6('avg(p)')} AS mean_p FROM scores GROUP BY 1", "scores"))
def _(spark, d):
    return V.scores(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("wins"), r6(F.avg("p")).alias("mean_p"))


# ------------------------------------------------------------------ metrics

_FOLD = """(SELECT *, greatest(least(p, 1.0 - 1e-6::DOUBLE), 1e-6::DOUBLE) AS pc FROM scores)"""
_BINS = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in zip(X.BINS[:-1], X.BINS[1:])) + ") e(lo, hi)"
_BINNED = f"""binned AS (SELECT s.split, lo, hi, count(*) AS n, avg(q) AS mq, sum(o) AS wins, avg(o) AS mo FROM
  (SELECT split, greatest(pc, 1.0 - pc) AS q, CASE WHEN pc >= 0.5 THEN target ELSE 1 - target END AS o FROM {_FOLD}) s
  JOIN {_BINS} ON q >= lo AND q < hi GROUP BY 1, 2, 3)"""
_Z = "1.96::DOUBLE"


def _wilson(k: str, n: str, sign: str) -> str:
    ph = f"({k}::DOUBLE / {n})"
    return f"""(({ph} + {_Z} * {_Z} / (2 * {n})) / (1 + {_Z} * {_Z} / {n}) {sign} {_Z} * sqrt({ph} * (1 - {ph}) / {n} + {_Z} * {_Z} / (4.0::DOUBLE * {n} * {n})) / (1 + {_Z} * {_Z} / {n}))"""


@query("calibration_table", sql(f"""WITH {_BINNED} SELECT g.split, e.lo AS bin_low, e.hi AS bin_high, coalesce(n, 0) AS n, {q6('mq')} AS mean_predicted,
  {q6('mo')} AS actual_win_rate, {q6(_wilson('wins', 'n', '-'))} AS lower_ci, {q6(_wilson('wins', 'n', '+'))} AS upper_ci, {q6('mo - mq')} AS gap
  FROM (SELECT DISTINCT split FROM scores) g CROSS JOIN {_BINS} LEFT JOIN binned b ON b.split = g.split AND b.lo = e.lo""", "scores"))
def _(spark, d):
    t = X.calibration_table(V.scores(spark, d), ["split"])
    return t.select("split", "bin_low", "bin_high", "n", *[r6(c).alias(c) for c in ("mean_predicted", "actual_win_rate", "lower_ci", "upper_ci", "gap")])


@query("calibration_errors", sql(f"WITH {_BINNED} SELECT split, {q6('sum(n * abs(mo - mq)) / sum(n)')} AS ece, {q6('max(abs(mo - mq))')} AS mce FROM binned GROUP BY 1", "scores"))
def _(spark, d):
    e = X.calibration_errors(X.calibration_table(V.scores(spark, d), ["split"]), ["split"])
    return e.select("split", r6("ece").alias("ece"), r6("mce").alias("mce"))


@query("brier_decomposition", sql(f"""WITH {_BINNED}, tot AS (SELECT split, sum(wins)::DOUBLE / sum(n) AS obar FROM binned GROUP BY 1)
  SELECT split, {q6('sum(n * (mq - mo) ** 2) / sum(n)')} AS reliability, {q6('sum(n * (mo - obar) ** 2) / sum(n)')} AS resolution,
  {q6('max(obar * (1 - obar))')} AS uncertainty FROM binned JOIN tot USING (split) GROUP BY 1""", "scores"))
def _(spark, d):
    b = X.brier_decomposition(V.scores(spark, d), ["split"])
    return b.select("split", *[r6(c).alias(c) for c in ("reliability", "resolution", "uncertainty")])


@query("score_metrics", sql(f"""SELECT split, count(*) AS n_contests, {q6('avg((pc - target) ** 2)')} AS brier,
  {q6('avg(-CASE WHEN target = 1 THEN ln(pc) ELSE ln(1.0 - pc) END)')} AS log_loss,
  {q6('avg(CASE WHEN pc <> 0.5 THEN ((pc > 0.5)::INT = target)::INT END)')} AS accuracy_decided FROM {_FOLD} GROUP BY 1""", "scores"))
def _(spark, d):
    s = V.scores(spark, d)
    m = X.score_metrics(s, ["split"])
    decided = X.score_metrics(s.filter("p <> 0.5"), ["split"]).select("split", F.col("accuracy").alias("accuracy_decided"))
    return m.join(decided, "split").select("split", "n_contests", *[r6(c).alias(c) for c in ("brier", "log_loss", "accuracy_decided")])


# CRC-32 of a number's digits, bit by bit
_STEPS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"


@query("tie_coin", sql(f"""SELECT contest_id, target, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(contest_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: {_STEPS}), 4294967295) % 2 AS coin, (p = 0.5) AS is_tie FROM scores""", "scores"))
def _(spark, d):
    return V.scores(spark, d).select("contest_id", X.tie_coin(F.col("contest_id")).alias("coin"), "target", (F.col("p") == 0.5).alias("is_tie"))


@query("roc_auc", sql(f"""WITH two AS (SELECT split, round(pc, 12) AS p, target AS y FROM {_FOLD} UNION ALL SELECT split, round(1.0 - round(pc, 12), 12), 1 - target FROM {_FOLD}),
  h AS (SELECT split, p, sum(y) AS pos, sum(1 - y) AS neg FROM two GROUP BY 1, 2),
  k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
  SELECT split, {q6('sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg))')} AS roc_auc FROM k GROUP BY 1""", "scores"))
def _(spark, d):
    return X.roc_auc(V.scores(spark, d), ["split"]).select("split", r6("roc_auc").alias("roc_auc"))


@query("fold_favourite", sql(f"""SELECT contest_id, round(greatest(pc, 1.0 - pc), 9) AS q, CASE WHEN pc >= 0.5 THEN target ELSE 1 - target END::DOUBLE AS favourite_won FROM {_FOLD}""", "scores"))
def _(spark, d):
    q, o = X.fold_favourite(F.col("p"), F.col("target"))
    return V.scores(spark, d).select("contest_id", F.round(q, 9).alias("q"), o.alias("favourite_won"))


@query("wilson_interval", sql(f"""SELECT entity_id, cum_wins AS k, cum_contests AS n, {q6(_wilson('cum_wins', 'cum_contests', '-'))} AS low,
  {q6(_wilson('cum_wins', 'cum_contests', '+'))} AS high FROM (SELECT entity_id, sum(wins)::BIGINT AS cum_wins, count(*) AS cum_contests FROM app GROUP BY 1)""", "app"))
def _(spark, d):
    g = V.appearances(spark, d).groupBy("entity_id").agg(F.sum("wins").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = X.wilson_low_high(F.col("k"), F.col("n"))
    return g.select("entity_id", "k", "n", r6(low).alias("low"), r6(high).alias("high"))
