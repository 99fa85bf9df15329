import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, cell

SF = "/root/testdata/sf0.001"
CHECKED = ["tie_coin", "dataset_fingerprint", "asof_strict_state", "signed_streak", "first_in_division", "calibration_table", "roc_auc", "evidence_board", "prediction_result_match", "note_attach", "group_median", "insert_only_merge"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 110


def test_entry(spark):
    assert entry(spark).count() == 21


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    pos = [[x[0] for x in cur.description].index(c) for c in cols]
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in pos) for r in cur.fetchall())
