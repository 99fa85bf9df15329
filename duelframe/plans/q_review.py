"""Queries: prediction matching, log, running metrics, review and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as R
from ..operators import track as T
from ..session import cut_lineage
from . import views as V
from .oracle import r6 as q6, sql
from .q_history import _wilson
from .registry import query
from .views import r6


def _matched(spark, d, stored=None):
    c = V.stored_contests(spark, d, with_stats=False) if stored is None else stored
    # matching reads the predictions three times: the records behind them are joined once
    return T.match_predictions(cut_lineage(V.predictions(spark, d, c), "predictions"), c)


def _log(spark, d):
    c = V.stored_contests(spark, d, with_stats=False)
    return T.log_rows(_matched(spark, d, c), c, "2024-01-01")


@query("prediction_result_match", sql("SELECT pred_id, contest_id, status FROM matched", "matched"))
def _(spark, d):
    return _matched(spark, d).select("pred_id", "contest_id", "status")


@query("match_status_counts", sql("SELECT status, count(*) AS n FROM matched GROUP BY 1", "matched"))
def _(spark, d):
    return T.status_counts(_matched(spark, d))


@query("late_prediction_filter", sql("SELECT count(*) FILTER (predicted_at > event_date::TIMESTAMP + INTERVAL 2 DAY) AS late, count(*) AS n FROM prediction", "prediction"))
def _(spark, d):
    return V.predictions(spark, d).agg(F.count_if(T.is_late(F.col("predicted_at"), F.col("event_date"))).alias("late"), F.count(F.lit(1)).alias("n"))


@query("latest_prediction", sql("SELECT contest_id, pred_id, predicted_at FROM latest", "latest"))
def _(spark, d):
    return T.latest_predictions(_matched(spark, d)).select("contest_id", "pred_id", "predicted_at")


@query("results_log", sql(f"SELECT contest_id, pick, actual_winner, CASE WHEN result = 'win' THEN actual_winner = pick END AS correct, {q6('confidence')} AS p_pick, prediction_file FROM logged", "logged"))
def _(spark, d):
    return _log(spark, d).select("contest_id", "pick", "actual_winner", "correct", r6("p_pick").alias("p_pick"), "prediction_file")


@query("prediction_projection", sql("SELECT pred_id, pick, p_1, round_even((1 - p_1) * 10000, 0) / 10000 AS p_2, round_even(greatest(p, 1 - p) * 10000, 0) / 10000 AS confidence FROM (SELECT *, round_even(p * 10000, 0) / 10000 AS p_1 FROM prediction)", "prediction"))
def _(spark, d):
    cols = T.prediction_columns(F.col("p"), F.col("name_1"), F.col("name_2"))
    return V.predictions(spark, d).select("pred_id", *[c.alias(n) for n, c in cols.items()])


@query("running_metrics", sql(f"""WITH s AS (SELECT event_date, confidence AS p, (actual_winner = pick)::INT AS y, result FROM logged),
  days AS (SELECT DISTINCT event_date FROM s WHERE result = 'win' ORDER BY 1 DESC LIMIT 5)
  SELECT 'overall' AS scope, count(*) FILTER (result = 'win') AS contests, {q6("avg(y) FILTER (result = 'win')")} AS accuracy, {q6("avg((p - y) ** 2) FILTER (result = 'win')")} AS brier,
    count(DISTINCT event_date) FILTER (result = 'win') AS events, count(*) FILTER (result <> 'win') AS excluded FROM s
  UNION ALL SELECT 'last_5', count(*), {q6('avg(y)')}, {q6('avg((p - y) ** 2)')}, count(DISTINCT event_date), NULL FROM s WHERE result = 'win' AND event_date IN (FROM days)""", "logged"))
def _(spark, d):
    return T.running_metrics(_log(spark, d)).select("scope", "contests", r6("accuracy").alias("accuracy"), r6("brier").alias("brier"), "events", "excluded")


@query("review_records", sql("""SELECT l.contest_id, l.newcomer_1 + l.newcomer_2 > 0 AS newcomer, c.division, c.finish_group, c.scheduled_rounds,
  CASE WHEN c.result = 'win' AND actual_winner <> pick THEN CASE WHEN confidence < 0.55 THEN 'coin flip' WHEN confidence < 0.65 THEN 'lean' ELSE 'clear favourite' END END AS surprise,
  CASE WHEN pick = name_1 THEN 'Win rate|Age' ELSE '' END AS pick_factors FROM logged l JOIN contest c USING (contest_id)""", "logged", "contest"))
def _(spark, d):
    c = V.stored_contests(spark, d, with_stats=False)
    m = cut_lineage(_matched(spark, d, c), "matched")
    log = T.log_rows(m, c, "2024-01-01")
    return R.review_records(log, c, m).select("contest_id", "newcomer", "division", "finish_group", "scheduled_rounds", "surprise", F.array_join("pick_factors", "|").alias("pick_factors"))


_SCORED = "(SELECT *, correct::INT AS y FROM graded WHERE correct IS NOT NULL)"


@query("surprise_band", sql("""SELECT CASE WHEN p_pick < 0.55 THEN 'coin flip' WHEN p_pick < 0.65 THEN 'lean' ELSE 'clear favourite' END AS surprise, count(*) AS n FROM graded WHERE NOT correct GROUP BY 1""", "graded"))
def _(spark, d):
    return V.graded(spark, d).filter("not correct").groupBy(R.surprise_band(F.col("p_pick")).alias("surprise")).agg(F.count(F.lit(1)).alias("n"))


@query("expected_vs_actual", sql(f"""SELECT division, count(*) AS contests, sum(y)::BIGINT AS hits, {q6('sum(p_pick)')} AS expected_hits, {q6('avg(p_pick)')} AS expected_accuracy, {q6('avg((p_pick - y) ** 2)')} AS brier,
  {q6('avg(-(y * ln(least(greatest(p_pick, 1e-9), 1.0)) + (1 - y) * ln(least(greatest(1 - p_pick, 1e-9), 1.0))))')} AS log_loss FROM {_SCORED} GROUP BY 1""", "graded"))
def _(spark, d):
    g = R.expected_vs_actual(V.graded(spark, d), ["division"])
    return g.select("division", "contests", "hits", *[r6(c).alias(c) for c in ("expected_hits", "expected_accuracy", "brier", "log_loss")])


@query("event_verdict", sql(f"""SELECT event_date, contests, hits, {q6('e')} AS expected_hits, CASE WHEN abs(hits - e) <= 1.5 * sqrt(v) THEN 'in line with' WHEN hits > e THEN 'better than' ELSE 'worse than' END AS verdict FROM
  (SELECT event_date, count(*) AS contests, sum(y)::BIGINT AS hits, sum(p_pick) AS e, sum(p_pick * (1 - p_pick)) AS v FROM {_SCORED} GROUP BY 1)""", "graded"))
def _(spark, d):
    return R.event_verdicts(V.graded(spark, d)).select("event_date", "contests", "hits", r6("expected_hits").alias("expected_hits"), "verdict")


@query("event_lessons_facts", sql("""SELECT event_date, count(*) FILTER (NOT correct AND finish_group = 'dq') AS dq_misses, count(*) FILTER (NOT correct AND finish_group <> 'dq' AND p_pick >= 0.65) AS upsets,
  count(*) FILTER (NOT correct AND finish_group <> 'dq' AND p_pick < 0.55) AS coin_flip_misses, count(*) FILTER (correct IS NOT NULL AND newcomer) AS newcomer_bouts, count(*) FILTER (correct AND newcomer) AS newcomer_hits,
  count(*) FILTER (correct IS NOT NULL AND late_change) AS late_bouts, count(*) FILTER (correct AND late_change) AS late_hits, count(*) FILTER (correct IS NOT NULL AND finish_group IN ('ko_tko', 'submission')) AS finishes,
  count(*) FILTER (correct AND finish_group IN ('ko_tko', 'submission')) AS finish_hits, count(*) FILTER (correct IS NOT NULL AND finish_group = 'decision') AS decisions,
  count(*) FILTER (correct AND finish_group = 'decision') AS decision_hits, count(*) FILTER (correct IS NULL) AS unscored FROM graded GROUP BY 1""", "graded"))
def _(spark, d):
    return R.event_facts(V.graded(spark, d))


@query("event_lessons_misses", sql(f"""SELECT event_date, kind, row_number() OVER (PARTITION BY event_date, kind ORDER BY p_pick DESC, contest_id)::INT AS place, contest_id, 'E' || CASE WHEN p >= 0.5 THEN entity_1_id ELSE entity_2_id END AS pick,
  'E' || winner_id AS actual_winner, {q6('p_pick')} AS p_pick, finish_group FROM (SELECT *, CASE WHEN finish_group = 'dq' THEN 'disqualification' WHEN p_pick >= 0.65 THEN 'upset' WHEN p_pick < 0.55 THEN 'coin flip' ELSE 'lean' END AS kind
  FROM graded WHERE NOT correct)""", "graded"))
def _(spark, d):
    return R.event_misses(V.graded(spark, d)).withColumn("p_pick", r6("p_pick"))


_LABELS = {
    "Pick confidence": "CASE WHEN p_pick < 0.55 THEN 'under 55%' WHEN p_pick < 0.65 THEN '55-65%' ELSE '65% and up' END",
    "Newcomer in the bout": "CASE WHEN newcomer THEN 'yes' ELSE 'no' END", "Late line-up change": "CASE WHEN late_change THEN 'yes' ELSE 'no' END",
    "How the contest ended": "CASE finish_group WHEN 'ko_tko' THEN 'KO/TKO' WHEN 'submission' THEN 'Submission' WHEN 'decision' THEN 'Decision' WHEN 'dq' THEN 'DQ' ELSE 'Unknown' END",
    "Scheduled rounds": "scheduled_rounds || ' rounds'", "Division": "CASE WHEN division LIKE 'Women%' THEN 'Women' ELSE 'Men' END"}
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS segment, {e} AS value, count(*) AS n, sum(y)::BIGINT AS k, avg(p_pick) AS e FROM {_SCORED} GROUP BY 2" for n, e in _LABELS.items())


@query("evidence_board", sql(f"""SELECT segment, value, n AS contests, k AS hits, {q6('e')} AS expected_accuracy, {q6('lo')} AS ci_low, {q6('hi')} AS ci_high,
  CASE WHEN n < 30 THEN 'collecting' WHEN e > hi THEN 'overconfident' WHEN e < lo THEN 'underconfident' ELSE 'consistent' END AS status
  FROM (SELECT *, {_wilson('k', 'n', '-')} AS lo, {_wilson('k', 'n', '+')} AS hi FROM ({_UNION}))""", "graded"))
def _(spark, d):
    b = R.evidence_board(V.graded(spark, d))
    return b.select("segment", "value", "contests", "hits", *[r6(c).alias(c) for c in ("expected_accuracy", "ci_low", "ci_high")], "status")


@query("event_review_nested", sql("SELECT event_id AS event_name, event_date, 0 AS part, count(correct) AS contests, string_agg(contest_id, ',' ORDER BY bout_no) AS bouts FROM graded GROUP BY 1, 2", "graded"))
def _(spark, d):
    b = V.graded(spark, d).withColumn("surprise", F.when(~F.col("correct"), R.surprise_band(F.col("p_pick"))))
    docs = R.event_documents(b)
    return docs.select("event_name", "event_date", "part", "contests", F.array_join(F.transform("bouts", lambda x: x["contest_id"].cast("string")), ",").alias("bouts"))


def _notes(g):
    """One note per third contest: by name, sometimes unknown names, short notice on every other."""
    key = F.col("contest_id")
    name = F.when(key % 21 == 0, "Nobody").when(key % 12 == 0, "").otherwise(F.concat(F.lit("e"), "entity_1_id"))
    return g.filter(key % 3 == 0).select(key.alias("note_id"), "event_date", name.alias("name"), F.when(key % 2 == 0, "Yes").otherwise("").alias("short_notice"),
                                         F.when(key % 5 == 0, "").otherwise("said").alias("note"))


_NOTES = """notes AS (SELECT contest_id AS note_id, event_date, CASE WHEN contest_id % 21 = 0 THEN 'Nobody' WHEN contest_id % 12 = 0 THEN '' ELSE 'E' || entity_1_id END AS name,
  contest_id % 2 = 0 AS short, CASE WHEN contest_id % 5 = 0 THEN '' ELSE 'said' END AS note FROM graded WHERE contest_id % 3 = 0),
  asked AS (SELECT * FROM notes WHERE note <> '' OR short),
  found AS (SELECT a.note_id, any_value(a.name) AS name, any_value(a.note) AS note, any_value(a.event_date) AS event_date, any_value(a.short) AS short, count(g.contest_id) AS hits, min(g.contest_id) AS contest_id
    FROM asked a LEFT JOIN graded g ON g.event_date = a.event_date AND a.name IN ('E' || g.entity_1_id, 'E' || g.entity_2_id) GROUP BY 1)"""


@query("note_attach", sql(f"""WITH {_NOTES} SELECT note_id, CASE WHEN name <> '' AND hits = 1 THEN contest_id END AS contest_id, NOT (name <> '' AND hits = 1) AS event_level, name <> '' AND hits <> 1 AS unmatched FROM found
  WHERE (name <> '') OR note <> ''""", "graded"))
def _(spark, d):
    g = V.graded(spark, d).select("contest_id", "event_date", "entity_1_id", "name_1", "name_2")
    attached, general = R.attach_notes(g, _notes(g))
    return attached.select("note_id", "contest_id", F.lit(False).alias("event_level"), F.lit(False).alias("unmatched")).unionByName(
        general.select("note_id", F.lit(None).cast("bigint").alias("contest_id"), F.lit(True).alias("event_level"), "unmatched"))


@query("late_change_flag", sql("""WITH came AS (SELECT DISTINCT event_date, 'E' || entity_1_id AS n FROM graded WHERE contest_id % 7 = 0)
  SELECT g.contest_id, (c1.n IS NOT NULL OR c2.n IS NOT NULL OR g.contest_id % 11 = 0 OR EXISTS (SELECT 1 FROM graded h WHERE h.contest_id % 11 = 0 AND h.event_date = g.event_date AND h.entity_1_id = g.entity_1_id AND h.entity_2_id = g.entity_2_id)) AS late_change
  FROM graded g LEFT JOIN came c1 ON c1.event_date = g.event_date AND c1.n = 'E' || g.entity_1_id LEFT JOIN came c2 ON c2.event_date = g.event_date AND c2.n = 'E' || g.entity_2_id""", "graded"))
def _(spark, d):
    g = V.graded(spark, d).select("contest_id", "event_date", "name_1", "name_2")
    key, none_r, none_a = F.col("contest_id"), "array<struct<`out`:string,`in`:string,opponent:string>>", "array<struct<a:string,b:string>>"
    changes = g.filter((key % 7 == 0) | (key % 11 == 0)).select(
        "event_date", F.lit("2024-01-01").alias("detected_at"),
        F.when(key % 7 == 0, F.array(F.struct(F.lit("X").alias("out"), F.lower("name_1").alias("in"), F.col("name_2").alias("opponent")))).otherwise(F.array().cast(none_r)).alias("replaced"),
        F.when(key % 11 == 0, F.array(F.struct(F.col("name_2").alias("a"), F.col("name_1").alias("b")))).otherwise(F.array().cast(none_a)).alias("added"))
    return R.late_change_flags(g, changes).select("contest_id", "late_change")
