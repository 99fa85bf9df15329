"""SQL twins of the views, written from the definitions for DuckDB."""

from __future__ import annotations

from ..operators.history import COUNTS, RATES, OPP_STATS, OWN_STATS
from .views import MIN_DATE, SLATE_BLOCK, TRAIN_END, VALID_END

_OUT = {
    "contests": "1", "wins": "(outcome = 'win')::INT", "losses": "(outcome = 'loss')::INT",
    "draws": "(outcome = 'draw')::INT", "ncs": "(outcome = 'nc')::INT",
    "ko_wins": "(outcome = 'win' AND finish_group = 'ko_tko')::INT",
    "sub_wins": "(outcome = 'win' AND finish_group = 'submission')::INT",
    "ko_losses": "(outcome = 'loss' AND finish_group = 'ko_tko')::INT",
    "sub_losses": "(outcome = 'loss' AND finish_group = 'submission')::INT",
}

VIEWS: dict[str, tuple[list[str], str]] = {}
VIEWS["side"] = ([], """SELECT l_orderkey AS contest_id, l_suppkey AS entity_id, sum(l_quantity) AS attempted,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS landed,
  count(*) FILTER (l_linestatus = 'F') AS td_landed, count(*) AS td_attempted,
  count(*) FILTER (l_returnflag = 'A') AS kd, count(*) FILTER (l_returnflag = 'N') AS sub_att,
  sum(l_linenumber)::BIGINT AS ctrl_sec, max(l_returnflag) AS rf FROM lineitem GROUP BY 1, 2""")
VIEWS["ranked"] = (["side"], """SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY entity_id) AS rn FROM side
  QUALIFY row_number() OVER (PARTITION BY contest_id ORDER BY entity_id) <= 2""")
VIEWS["contest0"] = (["ranked"], f"""SELECT a.contest_id, o_orderdate::DATE AS event_date, a.entity_id AS entity_1_id,
  b.entity_id AS entity_2_id,
  CASE WHEN o_orderstatus = 'P' AND a.contest_id % 10 = 0 THEN 'nc' WHEN a.attempted = b.attempted THEN 'draw' ELSE 'win' END AS result,
  CASE WHEN a.attempted > b.attempted THEN a.entity_id ELSE b.entity_id END AS larger_id,
  CASE WHEN a.attempted > b.attempted THEN a.rf ELSE b.rf END AS larger_rf,
  nullif(o_orderpriority, '4-NOT SPECIFIED') AS division, a.contest_id % 17 <> 0 AS has_stats,
  o_orderdate::DATE < DATE '{MIN_DATE}' AS is_prior, CASE WHEN a.contest_id % 20 = 0 THEN 5 ELSE 3 END AS scheduled_rounds,
  a.contest_id % 50 = 0 AS is_title, 60 * (a.td_attempted + b.td_attempted) AS duration_sec
  FROM ranked a JOIN ranked b ON a.contest_id = b.contest_id AND a.rn = 1 AND b.rn = 2
  JOIN orders ON o_orderkey = a.contest_id""")
VIEWS["contest"] = (["contest0"], f"""SELECT * EXCLUDE (larger_id, larger_rf),
  CASE WHEN result = 'win' THEN larger_id END AS winner_id,
  CASE larger_rf WHEN 'A' THEN 'ko_tko' WHEN 'N' THEN 'submission' ELSE 'decision' END AS finish_group,
  result = 'win' AND NOT is_prior AS is_target,
  row_number() OVER (PARTITION BY event_date ORDER BY contest_id)::INT AS bout_order FROM contest0""")
VIEWS["slated"] = (["contest"], f"""SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY contest_id)::INT AS bout_no FROM
  (SELECT *, strftime(event_date, '%Y%m%d') || '-' || (contest_id // {SLATE_BLOCK})::VARCHAR AS event_id FROM contest)""")
VIEWS["stats"] = (["ranked"], """SELECT r.* EXCLUDE (rn), sum(td_attempted) OVER (PARTITION BY contest_id)::BIGINT * 60 AS duration_sec,
  (sum(entity_id) OVER (PARTITION BY contest_id) - entity_id)::BIGINT AS opponent_id
  FROM ranked r WHERE contest_id % 17 <> 0 QUALIFY count(*) OVER (PARTITION BY contest_id) = 2""")
VIEWS["entity"] = ([], """SELECT s_suppkey AS entity_id, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 60.0::DOUBLE + s_nationkey END AS height_in,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 100 END AS reach_in,
  CASE s_nationkey % 3 WHEN 0 THEN 'Orthodox' WHEN 1 THEN 'Southpaw' END AS stance,
  DATE '1960-01-01' + (s_suppkey % 9000)::INT AS dob FROM supplier""")
VIEWS["app0"] = (["contest"], """SELECT *, 1 AS side, entity_1_id AS entity_id, entity_2_id AS opponent_id FROM contest
  UNION ALL SELECT *, 2, entity_2_id, entity_1_id FROM contest""")
VIEWS["app"] = (["app0"], "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _OUT.items()) + """,
  CASE outcome WHEN 'win' THEN 1 WHEN 'loss' THEN -1 WHEN 'draw' THEN 0 END AS sign
  FROM (SELECT * REPLACE (coalesce(division, '__unknown__') AS division),
    CASE WHEN result = 'win' AND winner_id = entity_id THEN 'win' WHEN result = 'win' THEN 'loss' WHEN result = 'draw' THEN 'draw' ELSE 'nc' END AS outcome FROM app0)""")
_used = "(NOT a.is_prior AND a.has_stats AND own.landed IS NOT NULL)"
VIEWS["app_stats0"] = (["app", "stats"], f"SELECT a.* EXCLUDE (duration_sec), {_used}::INT AS stat_contests, "
    + ", ".join(f"CASE WHEN {_used} THEN own.{c}::DOUBLE END AS {c}" for c in OWN_STATS) + ", "
    + ", ".join(f"CASE WHEN {_used} THEN opp.{c}::DOUBLE END AS opp_{c}" for c in OPP_STATS)
    + """ FROM app a LEFT JOIN stats own ON own.contest_id = a.contest_id AND own.entity_id = a.entity_id
  LEFT JOIN stats opp ON opp.contest_id = a.contest_id AND opp.entity_id = a.opponent_id""")
VIEWS["app_stats"] = (["app_stats0"], "SELECT *, "
    + ", ".join(f"CASE WHEN {n} IS NOT NULL AND {d} IS NOT NULL THEN {n} ELSE 0 END AS num_{r}, "
                f"CASE WHEN {n} IS NOT NULL AND {d} IS NOT NULL THEN {d} ELSE 0 END AS den_{r}" for r, (n, d, _) in RATES.items())
    + " FROM (SELECT *, opp_attempted - opp_landed AS opp_missed, opp_td_attempted - opp_td_landed AS opp_td_missed FROM app_stats0)")

_ORD = "ORDER BY event_date, bout_order DESC, contest_id"
_WIN = f"(PARTITION BY entity_id {_ORD} ROWS UNBOUNDED PRECEDING)"


def _streak(source: str) -> str:
    """Signed streak by runs over rows that are not no-contests."""
    return f"""SELECT s.*, coalesce(last_value(live_streak IGNORE NULLS) OVER w, 0)::INT AS streak FROM (
    SELECT r.*, CASE WHEN sign IS NOT NULL THEN sign * row_number() OVER (PARTITION BY entity_id, sign IS NULL, run {_ORD}) END AS live_streak FROM (
      SELECT q.*, sum(CASE WHEN sign IS NOT NULL AND (prev IS NULL OR prev <> sign) THEN 1 ELSE 0 END) OVER {_WIN} AS run FROM (
        SELECT *, CASE WHEN sign IS NOT NULL THEN lag(sign) OVER (PARTITION BY entity_id, sign IS NULL {_ORD}) END AS prev FROM {source}) q) r) s
    WINDOW w AS {_WIN}"""


_CUM = ["contests", "wins", "losses", "draws", "ncs", "ko_wins", "sub_wins", "ko_losses", "sub_losses"]
VIEWS["running"] = (["app"], "SELECT *, " + ", ".join(f"sum({c}) OVER {_WIN}::BIGINT AS cum_{c}" for c in _CUM)
                    + f" FROM ({_streak('app')})")
_STATW = f"(PARTITION BY entity_id, stat_contests {_ORD} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_SUMS = [f"{k}_{r}" for r in RATES for k in ("num", "den")]
VIEWS["running_stats"] = (["app_stats"], "SELECT *, " + ", ".join(
    f"last_value(l_{c} IGNORE NULLS) OVER {_WIN} AS last_{c}" for c in _SUMS) + " FROM (SELECT *, "
    + ", ".join(f"sum({c}) OVER {_WIN}::BIGINT AS cum_{c}" for c in COUNTS) + ", "
    + ", ".join(f"sum({c}) OVER {_WIN} AS cum_{c}, CASE WHEN stat_contests = 1 THEN sum({c}) OVER {_STATW} END AS l_{c}" for c in _SUMS)
    + f" FROM ({_streak('app_stats')}))")
_LAST = "QUALIFY row_number() OVER (PARTITION BY entity_id, event_date ORDER BY bout_order, contest_id DESC) = 1"
VIEWS["state"] = (["running"], f"SELECT * FROM running {_LAST}")
VIEWS["state_stats"] = (["running_stats"], f"SELECT * FROM running_stats {_LAST}")
VIEWS["target"] = (["contest"], "SELECT * FROM contest WHERE is_target")


def _before(side: str) -> str:
    return f"ASOF LEFT JOIN state s{side} ON s{side}.entity_id = t.entity_{side}_id AND t.event_date > s{side}.event_date"


VIEWS["records"] = (["target", "state"], f"""SELECT t.*, coalesce(s1.cum_contests, 0) AS n1, coalesce(s1.cum_wins, 0) AS w1,
  coalesce(s2.cum_contests, 0) AS n2, coalesce(s2.cum_wins, 0) AS w2 FROM target t {_before('1')} {_before('2')}""")
VIEWS["forecast"] = (["records"], """SELECT contest_id, event_date, division, 0 AS orientation, (a + 0.02::DOUBLE) / (a + b + 0.02::DOUBLE) AS p,
  (winner_id = entity_1_id)::INT AS target FROM rated
  UNION ALL SELECT contest_id, event_date, division, 1, (b + 0.02::DOUBLE) / (b + a + 0.02::DOUBLE), (winner_id = entity_2_id)::INT FROM rated""")
VIEWS["rated"] = (["records"], """SELECT *, (w1 + 1)::DOUBLE / (n1 + 2) AS a, (w2 + 1)::DOUBLE / (n2 + 2) AS b FROM records""")
VIEWS["forecast"] = (["rated"], VIEWS["forecast"][1])
_split = f"CASE WHEN event_date < DATE '{TRAIN_END}' THEN 'train' WHEN event_date < DATE '{VALID_END}' THEN 'valid' ELSE 'test' END"
VIEWS["scores"] = (["forecast"], f"""SELECT a.contest_id, a.event_date, a.target, round((a.p + 1.0 - b.p) / 2.0, 9) AS p,
  {_split.replace('event_date', 'a.event_date')} AS split
  FROM forecast a JOIN forecast b ON a.contest_id = b.contest_id AND a.orientation = 0 AND b.orientation = 1""")
VIEWS["records_all"] = (["slated", "state"], f"""SELECT t.*, coalesce(s1.cum_contests, 0) AS n1, coalesce(s1.cum_wins, 0) AS w1,
  coalesce(s2.cum_contests, 0) AS n2, coalesce(s2.cum_wins, 0) AS w2 FROM (SELECT * FROM slated WHERE NOT is_prior) t {_before('1')} {_before('2')}""")
VIEWS["priced"] = (["records_all"], """SELECT *, (a + 0.02::DOUBLE) / (a + b + 0.02::DOUBLE) AS p_raw FROM
  (SELECT *, (w1 + 1)::DOUBLE / (n1 + 2) AS a, (w2 + 1)::DOUBLE / (n2 + 2) AS b FROM records_all)""")
VIEWS["prediction"] = (["priced"], """SELECT *, CASE WHEN p >= 0.5 THEN name_1 ELSE name_2 END AS pick, greatest(p, 1 - p) AS confidence FROM (
  SELECT contest_id AS pred_id, event_date + (contest_id % 3 - 1)::INT AS event_date, event_id AS event_name,
    CASE WHEN contest_id % 23 <> 0 THEN CASE WHEN contest_id % 2 = 1 THEN entity_2_id ELSE entity_1_id END END AS entity_1_id,
    CASE WHEN contest_id % 46 <> 0 THEN CASE WHEN contest_id % 2 = 1 THEN entity_1_id ELSE entity_2_id END END AS entity_2_id,
    'E' || CASE WHEN contest_id % 2 = 1 THEN entity_2_id ELSE entity_1_id END AS name_1, 'E' || CASE WHEN contest_id % 2 = 1 THEN entity_1_id ELSE entity_2_id END AS name_2,
    round(CASE WHEN contest_id % 2 = 1 THEN 1 - p_raw ELSE p_raw END, 6) AS p,
    (event_date + CASE WHEN contest_id % 41 = 0 THEN 3 ELSE -(contest_id % 5) END::INT)::TIMESTAMP AS predicted_at, 'cards-' || year(event_date) || '.csv' AS prediction_file,
    CASE WHEN contest_id % 2 = 1 THEN n2 = 0 ELSE n1 = 0 END::INT AS newcomer_1, CASE WHEN contest_id % 2 = 1 THEN n1 = 0 ELSE n2 = 0 END::INT AS newcomer_2 FROM priced)""")
VIEWS["matched"] = (["prediction", "contest"], """SELECT q.*, CASE WHEN entity_1_id IS NULL AND entity_2_id IS NULL THEN 'unmatchable (no ids)' WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'pending' END AS status,
  CASE WHEN n = 1 THEN hit END AS contest_id FROM (
  SELECT p.*, count(c.contest_id) AS n, min(c.contest_id) AS hit FROM prediction p LEFT JOIN contest c
    ON c.event_date BETWEEN p.event_date - 1 AND p.event_date + 1
    AND (p.entity_1_id IS NOT NULL OR p.entity_2_id IS NOT NULL)
    AND (p.entity_1_id IS NULL OR p.entity_1_id IN (c.entity_1_id, c.entity_2_id)) AND (p.entity_2_id IS NULL OR p.entity_2_id IN (c.entity_1_id, c.entity_2_id))
  GROUP BY ALL) q""")
VIEWS["latest"] = (["matched"], """SELECT * FROM matched WHERE status = 'matched' AND predicted_at <= event_date::TIMESTAMP + INTERVAL 2 DAY
  QUALIFY row_number() OVER (PARTITION BY contest_id ORDER BY predicted_at DESC, pred_id DESC) = 1""")
VIEWS["logged"] = (["latest", "contest"], """SELECT l.*, c.result, CASE WHEN c.result <> 'win' THEN c.result WHEN c.winner_id = l.entity_1_id THEN name_1 WHEN c.winner_id = l.entity_2_id THEN name_2
  WHEN l.entity_1_id IS NOT NULL THEN name_2 ELSE name_1 END AS actual_winner FROM latest l JOIN contest c USING (contest_id)""")
VIEWS["graded"] = (["priced"], """SELECT *, CASE WHEN result = 'win' THEN (p >= 0.5) = (winner_id = entity_1_id) END AS correct, greatest(p, 1 - p) AS p_pick FROM (
  SELECT * REPLACE (CASE WHEN contest_id % 33 = 0 THEN 'dq' ELSE finish_group END AS finish_group, CASE WHEN contest_id % 4 = 0 THEN 'Women''s ' || division ELSE division END AS division),
  round(p_raw, 6) AS p, n1 = 0 OR n2 = 0 AS newcomer, contest_id % 9 = 0 AS late_change FROM priced)""")
SPLIT = _split


def sql(body: str, *views: str) -> str:
    """`body` with the CTEs of the views it needs, in dependency order."""
    order: list[str] = []

    def visit(v: str) -> None:
        for dep in VIEWS[v][0]:
            visit(dep)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    ctes = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v][1]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def r6(e: str) -> str:
    return f"round(({e})::DOUBLE, 6) + 0.0"
