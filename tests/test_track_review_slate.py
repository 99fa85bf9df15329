import datetime as dt

from pyspark.sql import functions as F

from duelframe.operators import review as R
from duelframe.operators import slate as L
from duelframe.operators import track as T
from duelframe.session import shared_path
from duelframe.streaming import incremental as S

D = dt.date


def contests(spark):
    rows = [("f1", D(2026, 9, 19), "a", "b", "b", "win"), ("f2", D(2026, 9, 19), "c", "d", None, "draw"), ("f3", D(2026, 9, 20), "e", "x", "x", "win"), ("f4", D(2026, 5, 1), "a", "b", "a", "win")]
    return spark.createDataFrame(rows, "contest_id string, event_date date, entity_1_id string, entity_2_id string, winner_id string, result string")


def preds(spark):
    at = lambda d, h=0: dt.datetime(2026, 9, d, h)
    rows = [(1, D(2026, 9, 20), "b", "a", "Bo", "Ann", "Bo", 0.6, at(18), "p1"), (2, D(2026, 9, 19), "c", "d", "Cy", "Dee", "Cy", 0.7, at(18), "p1"),
            (3, D(2026, 9, 19), "e", None, "Eve", "New", "Eve", 0.55, at(18), "p1"), (4, D(2026, 9, 19), "q", "r", "Q", "R", "Q", 0.55, at(18), "p1"),
            (5, D(2026, 9, 19), None, None, "Y", "Z", "Y", 0.55, at(18), "p1"), (6, D(2026, 9, 19), "a", "b", "Ann", "Bo", "Ann", 0.51, at(19), "p2"),
            (7, D(2026, 9, 19), "a", "b", "Ann", "Bo", "Ann", 0.51, at(25), "p3")]
    return spark.createDataFrame(rows, "pred_id int, event_date date, entity_1_id string, entity_2_id string, name_1 string, name_2 string, pick string, confidence double, predicted_at timestamp, prediction_file string").withColumns(
        {"event_name": F.lit("N"), "model_version": F.lit("m")})


def test_matching_and_log(spark):
    m = T.match_predictions(preds(spark), contests(spark))
    assert {r.pred_id: (r.contest_id, r.status) for r in m.collect()} == {
        1: ("f1", "matched"), 2: ("f2", "matched"), 3: ("f3", "matched"), 4: (None, "pending"), 5: (None, "unmatchable (no ids)"), 6: ("f1", "matched"), 7: ("f1", "matched")}
    log = {r.contest_id: r for r in T.log_rows(m, contests(spark), "now").collect()}
    assert (log["f1"].pick, log["f1"].actual_winner, log["f1"].correct, log["f1"].prediction_file) == ("Ann", "Bo", False, "p2")
    assert (log["f2"].actual_winner, log["f2"].correct) == ("draw", None) and (log["f3"].actual_winner, log["f3"].correct) == ("New", False)
    r = {x.scope: x for x in T.running_metrics(T.log_rows(m, contests(spark), "now")).collect()}
    assert r["overall"].contests == 2 and r["overall"].accuracy == 0.0 and r["overall"].excluded == 1 and r["last_5"].events == 1
    strict = {x.contest_id: x.prediction_file for x in T.log_rows(m, contests(spark), "now", grace_days=0).collect()}
    assert strict["f1"] == "p2"


def bouts(spark):
    rows = [(i, D(2026, 9, 19), f"A{i}", f"B{i}", "A" + str(i), 0.7, i % 3 != 0, "decision" if i % 2 else "dq", i == 0, False, None, 3, None) for i in range(40)]
    rows.append((99, D(2026, 9, 19), "José Q", "B99", "José Q", 0.6, None, None, False, False, None, 5, "Women's Flyweight"))
    return spark.createDataFrame(rows, "contest_id int, event_date date, name_1 string, name_2 string, pick string, p_pick double, correct boolean, finish_group string, newcomer boolean, late_change boolean, late_change_source string, scheduled_rounds int, division string")


def test_evidence_and_notes(spark):
    b = bouts(spark)
    board = {(r.segment, r.value): r for r in R.evidence_board(b).collect()}
    assert board[("Pick confidence", "65% and up")].contests == 40 and board[("Newcomer in the bout", "yes")].status == "collecting"
    assert board[("Pick confidence", "65% and up")].status == "consistent" and board[("Division", "Men")].hits == 26
    n = spark.createDataFrame([(1, D(2026, 9, 19), "jose q", "yes", ""), (2, D(2026, 9, 19), "Nobody", "", "hm"), (3, D(2026, 9, 19), "", "", "event note"), (4, D(2026, 9, 19), "A1", "no", ""), (5, D(2020, 1, 1), "A1", "", "x")],
                              "note_id int, event_date date, name string, short_notice string, note string")
    att, general = R.attach_notes(b, n)
    assert [(r.note_id, r.contest_id, r.short) for r in att.collect()] == [(1, 99, True)]
    assert {(r.note_id, r.unmatched) for r in general.collect()} == {(2, True), (3, False)}
    late = [r for r in R.apply_notes(b, att).collect() if r.late_change]
    assert [(r.contest_id, r.late_change_source) for r in late] == [(99, "viewer")]
    v = R.event_verdicts(b).first()
    assert v.hits == 26 and v.verdict == "in line with" and R.event_facts(b).first().dq_misses == 7


# Slates as "x-y" bouts in listed order, and the changes between them as (kind, name_1, name_2, out_name).
SLATES = {
    "same pairs, other order and sides": (["Ada-Bel", "Cid-Dot"], ["Dot-Cid", "Bel-Ada"], set()),
    "a bout more, a bout less": (["Ada-Bel", "Cid-Dot"], ["Ada-Bel", "Eli-Fay"], {("added", "Eli", "Fay", None), ("removed", "Cid", "Dot", None)}),
    "one side stands in": (["Ada-Bel"], ["Gus-Ada"], {("replaced", "Gus", "Ada", "Bel")}),
    "two stand in for each other's rivals": (["Ada-Bel", "Cid-Dot"], ["Ada-Dot", "Cid-Bel"], {("replaced", "Dot", "Ada", "Bel"), ("replaced", "Bel", "Cid", "Dot")}),
    "first listed takes the shared name": (["Ada-Bel", "Ada-Cid"], ["Ada-Dot"], {("replaced", "Dot", "Ada", "Bel"), ("removed", "Ada", "Cid", None)}),
    "one bout less, two with its side": (["Hal-Ivy"], ["Ivy-Joy", "Ivy-Kim"], {("replaced", "Joy", "Ivy", "Hal"), ("added", "Ivy", "Kim", None)}),
    "chain": (["Ada-Bel", "Bel-Cid"], ["Cid-Dot", "Ada-Eli"], {("replaced", "Eli", "Ada", "Bel"), ("replaced", "Dot", "Cid", "Bel")}),
    "all new": (["Ada-Bel"], ["Cid-Dot"], {("added", "Cid", "Dot", None), ("removed", "Ada", "Bel", None)}),
}


def test_slate_changes_batch_and_stream(spark):
    def rows(which):
        return [(e, i, *bout.split("-")) for e, versions in SLATES.items() for i, bout in enumerate(versions[which])]

    def found(df):
        got = {}
        for r in df.collect():
            got.setdefault(r.event_id, set()).add((r.kind, r.name_1, r.name_2, r.out_name))
        return got
    want = {e: v[2] for e, v in SLATES.items() if v[2]}
    schema = "event_id string, bout_order int, name_1 string, name_2 string"
    old = spark.createDataFrame([*rows(0), ("vanished", 0, "Ada", "Bel")], schema)
    new = spark.createDataFrame([*rows(1), ("came later", 0, "Ada", "Bel")], schema)
    assert found(L.slate_changes(old, new)) == want
    doc = lambda df, v: df.groupBy("event_id").agg(F.lit(v).alias("version"), F.collect_list(F.struct("bout_order", "name_1", "name_2")).alias("bouts"))
    # one batch with both versions; then a second batch with the newer, and a third with an older one, which changes nothing
    path, out, ck = shared_path(spark, "docs"), shared_path(spark, "out"), shared_path(spark, "ck")
    schema = doc(old, 1).schema

    def arrive(docs):
        docs.coalesce(1).write.mode("append").parquet(path)
        return found(S.run_to_table(S.slate_diff_stream(spark.readStream.schema(schema).parquet(path)), out, ck))
    assert arrive(doc(old, 1)) == {}
    assert arrive(doc(new, 3)) == want
    assert arrive(doc(old, 2)) == want


def test_slate_stream_in_any_order(spark):
    """New before old over two batches, and a version between two earlier ones, give what the batch diff gives."""
    schema = "event_id string, bout_order int, name_1 string, name_2 string"
    def table(which):
        return spark.createDataFrame([(e, i, *bout.split("-")) for e, versions in SLATES.items() for i, bout in enumerate(versions[which])], schema)
    def doc(df, v):
        return df.groupBy("event_id").agg(F.lit(v).alias("version"), F.collect_list(F.struct("bout_order", "name_1", "name_2")).alias("bouts"))
    cols = ["event_id", "kind", "name_1", "name_2", "out_name"]
    def listed(df):
        return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    old, new = table(0), table(1)
    versions = {1: doc(old, 1), 2: doc(new, 2), 3: doc(old, 3)}
    forth, back = listed(L.slate_changes(old, new)), listed(L.slate_changes(new, old))
    for order, want in (((2, 1), {2: forth}), ((3, 1, 2), {2: forth, 3: back}), ((1, 3, 2), {2: forth, 3: back})):
        path, out, ck = shared_path(spark, "docs"), shared_path(spark, "out"), shared_path(spark, "ck")
        for v in order:
            versions[v].coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(versions[1].schema).option("maxFilesPerTrigger", 1).parquet(path)
        got = S.settled_steps(S.run_to_table(S.slate_diff_stream(stream), out, ck), spark.read.parquet(path))
        for v in (1, 2, 3):
            assert listed(got.filter(F.col("version") == v)) == want.get(v, []), (order, v)


def test_late_changes(spark):
    b = spark.createDataFrame([(1, D(2026, 9, 19), "Ann", "Bo"), (2, D(2026, 9, 19), "Cy", "Dee"), (3, D(2026, 9, 20), "Ann", "Bo")], "contest_id int, event_date date, name_1 string, name_2 string")
    ch = spark.createDataFrame([(D(2026, 9, 19), "t2", [("X", "ann", "Bo")], []), (D(2026, 9, 19), "t1", [], [("Dee", "Cy")])],
                               "event_date date, detected_at string, replaced array<struct<`out`:string,`in`:string,opponent:string>>, added array<struct<a:string,b:string>>")
    got = {r.contest_id: (r.late_change, r.late_change_detected_at) for r in R.late_change_flags(b, ch).collect()}
    assert got == {1: (True, "t2"), 2: (True, "t1"), 3: (False, None)}
