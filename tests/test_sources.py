"""File status, nested elements and lists of earlier contests."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from duelframe.operators import history as H
from duelframe.plans import views as V
from duelframe.plans.oracle import sql
from duelframe.sources import files, pages


def test_refused_files(spark, tmp_path):
    for name, data in {"good": b'a,b\n1,"x, y"\n2,z\n', "more": b"b,c,a\r\n1,2,3\r\n", "ragged": b"a,b\n1,2\n1,2,3\n", "latin": "a,b\n\xe9,1\n".encode("latin-1"), "empty": b"\n", "other": b"a,c\n1,2\n", "head": b"a,b\n"}.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    (tmp_path / "notes.txt").write_text("not a table")
    got = {r.file_name: (r.rows, r.reason) for r in files.file_status(spark, str(tmp_path), ["a", "b"]).collect()}
    assert got == {"good.csv": (2, None), "more.csv": (1, None), "ragged.csv": (2, "too many fields in line 3"), "latin.csv": (None, "not UTF-8"), "empty.csv": (0, "no header"),
                   "other.csv": (1, "no column b"), "head.csv": (0, None)}
    (tmp_path / "notes.txt").unlink()
    rows = files.read_accepted(spark, str(tmp_path), ["a", "b"]).select("file_name", "a").collect()
    assert {r.file_name for r in rows} <= {"good.csv", "more.csv"} and sum(r.file_name == "good.csv" for r in rows) == 2


@pytest.mark.parametrize("html, want", [
    ('<p>x</p><div class="a hit b"><div><div>in</div></div>out</div><div>next</div>', '<div class="a hit b"><div><div>in</div></div>out</div>'),
    ('<div class="hit"/><div>x</div>', '<div class="hit"/><div>x</div>'), ('<span class="hit">t<div></span>more', '<span class="hit">t<div></span>'),
    ('<div class="hit"><div>open', '<div class="hit"><div>open'), ('<div class="hits">x</div>', ""), ("", ""), ("plain text", ""), ('<li class="hit"><li/>x</li>y', '<li class="hit"><li/>x</li>'),
    ('<a class="hit">1</a><a class="hit">2</a>', '<a class="hit">1</a>')])
def test_first_element_of_a_class(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(pages._element(F.col("h"), "hit")).first()[0] == want


def test_element_of_null(spark):
    assert spark.createDataFrame([(None,)], "h string").select(pages._element(F.col("h"), "hit")).first()[0] in (None, "")


def test_lists_of_earlier_contests(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([1, 1, 1, 2, 3, None]), dt.date(2000, 1, draw.randint(1, 9))) for i in range(300)]
    a = spark.createDataFrame(rows, "contest_id long, entity_id long, event_date date")
    for size in (4, 1024):
        lists = H.expand_sources(H.earlier_sources(a).filter("entity_id is not null"), H.source_chunks(a, size), size)
        got = {(r.entity_id, r.event_date): r.ids for r in lists.collect()}
        assert got == {(e, d): [i for x, i in sorted((x, i) for i, f, x in rows if f == e and x < d)] for _, e, d in rows if e is not None}
        assert H.source_chunks(a, size).filter(F.size("ids") > size).count() == 0


def test_expanded_lists_equal_sql(spark):
    sf = "/root/testdata/sf0.001"
    a = V.appearances(spark, sf)
    got = {(r.entity_id, r.event_date): ",".join(map(str, r.ids)) for r in H.expand_sources(H.earlier_sources(a), H.source_chunks(a, 16), 16).collect()}
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql("""SELECT x.entity_id, x.event_date, coalesce(string_agg(y.contest_id, ',' ORDER BY y.event_date, y.contest_id), '') FROM (SELECT DISTINCT entity_id, event_date FROM app) x
      LEFT JOIN app y ON y.entity_id = x.entity_id AND y.event_date < x.event_date GROUP BY 1, 2""", "app")).fetchall()
    assert got == {(e, d): ids for e, d, ids in want} and len(got) > 1000
