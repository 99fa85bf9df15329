"""Work that must not grow faster than its input: elements of pages, tasks of shuffles, derivations of one table."""

import datetime as dt
import time

from pyspark.sql import functions as F

from duelframe.operators import history as H
from duelframe.operators import store as B
from duelframe.operators.running import TASK_BYTES, spread, task_count
from duelframe.plans import catalog, q_models, views as V
from duelframe.sources import pages


def test_element_of_many_tokens(spark):
    """Linear in the tokens: the opening tag is looked for once, not once a token."""
    inner = "<div><b>x</b></div>" * 4000
    html = f'<p>a</p><div class="hit">{inner}</div><i>rest</i>'
    df = spark.createDataFrame([(html,)], "h string").select(pages._element(F.col("h"), "hit"))
    begun = time.time()
    assert df.first()[0] == f'<div class="hit">{inner}</div>' and time.time() - begun < 60


def test_elements_of_bouts_are_cut_once(spark):
    """The filter on names stays above the cut, so the plan folds each of the three elements once."""
    page = ('<html><div id="main-card"><div class="bout"><div class="corner-red"><b>A</b></div><div class="corner-blue"><b>B</b></div><div class="bout-class">Lightweight Title Bout</div></div>'
            '<div class="bout"><div class="corner-red"></div><div class="corner-blue">D</div></div></div></html>')
    out = pages.event_bouts(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert [tuple(r) for r in out.collect()] == [(1, 1, "A", "B", "Lightweight", True, 5, "main")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 3


def test_tasks_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1 << 20).select("id", F.rand(1).alias("x")).coalesce(2).write.parquet(path)
    t = spark.read.parquet(path)
    n = task_count(t)
    assert 8 < n == -(-sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) // TASK_BYTES)
    assert spread(t, ["id"], n).rdd.getNumPartitions() == n and task_count(t.limit(0).unionAll(t)) == n
    assert task_count(spark.range(5).toDF("id")) == 0 and spread(spark.range(5), ["id"], 0).count() == 5
    a = t.select((F.col("id") % 500).alias("entity_id"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 900).cast("int")).alias("event_date"), F.col("id").alias("bout_order"), F.col("id").alias("contest_id"))
    assert H._segment_rows(a)[0].rdd.getNumPartitions() == n


def test_contests_are_derived_once(spark, monkeypatch):
    """History, targets and probes read one stored table; a second scan of the line items is a second derivation."""
    calls = []
    derive = V.contests
    monkeypatch.setattr(V, "contests", lambda *a, **k: calls.append(1) or derive(*a, **k))
    for name in ("baseline_rule", "smoothed_rates", "cumulative_record", "review_records", "event_lookup", "bout_sequence"):
        calls.clear()
        df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1 and not any("lineitem" in f for f in df.inputFiles()), name


def test_sides_are_hashed(spark):
    plan = V.side(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_finish_group_of_any_flag(spark, tmp_path):
    """The rank of the largest flag gives the same as the flag itself, also for unknown and missing flags."""
    flags = ["A", "N", "R", "AA", "M", "Z", "a", "", None]
    pairs = [(i, 2 * i, f, g) for i, (f, g) in enumerate((f, g) for f in flags for g in flags)]
    lines = [(k, 5, 1, 9.0, x, "F") for k, _, f, g in pairs for x in (f, g)] + [(k, 6, 2, 1.0, "R", "O") for k, *_ in pairs]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "O", "1-URGENT", dt.datetime(1999, 1, 1)) for k, *_ in pairs], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.contest_id: r.finish_group for r in V.contests(spark, str(tmp_path), False).collect()}
    top = {k: max((x for x in (f, g) if x is not None), default=None) for k, _, f, g in pairs}
    assert got == {k: {"A": "ko_tko", "N": "submission"}.get(t, "decision") for k, t in top.items()}


def test_fingerprint_shuffle_is_not_fixed(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("contest_id"), F.date_add(F.lit(dt.date(1999, 1, 1)), F.col("id").cast("int") * 5).alias("event_date"))
    seen, fingerprint = [], q_models.G.fingerprint
    monkeypatch.setattr(q_models, "_stored_features", lambda *_: rows)
    monkeypatch.setattr(q_models.G, "fingerprint", lambda df: seen.append(df) or fingerprint(df))
    got = {r.case_name: r.rows for r in catalog.QUERIES["promotion_report"](spark, "").collect()}
    assert got == {"same": 200, "unchecked": 200, "changed_features": 199, "no_backtest": 200}
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "Repartition 7" not in plan


def test_append_derives_new_rows_once(spark, tmp_path):
    """What is appended is sorted and looked up in the digest once, then read from a table."""
    kind, path = "k long, v string", str(tmp_path / "log")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        scans.add(1)
        yield from batches
    B.append(path, spark.createDataFrame([(i, "a") for i in range(50)], kind), ["k"], ["v"])
    new = spark.createDataFrame([(i, "b") for i in range(40, 90)], kind).coalesce(1).mapInArrow(counted, kind)
    assert B.append(path, new, ["k"], ["v"])["added"] == 40 and scans.value == 1


def test_ids_of_sources_are_parsed_once(spark):
    """The filter on a parsed id stays above the parsing; pushed below, it was computed again at every scan and join."""
    from duelframe.operators import ingest as I
    rows = [(1, "Slate a", "http://x.example/event-details/0a1-z", "May 5, 2000", ""), (2, "Slate b", "http://x.example/other/0a1", "May 5, 2000", "Hall"),
            (3, "Slate c", None, "May 5, 2000", None), (4, "Slate d", "http://x.example/event-details/fight-details/b/", "Jun. 1, 2001", "Hall"), (5, "Slate e", "event-details", "May 5, 2000", "")]
    e = I.build_events(spark.createDataFrame(rows, "row_no int, event string, url string, date string, location string"), "2001-06-30", "now")
    assert sorted((r.row_no, r.event_id, str(r.event_date), r.location) for r in e.collect()) == [(1, "0a1", "2000-05-05", None), (4, "b", "2001-06-01", "Hall")]
    assert e._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
