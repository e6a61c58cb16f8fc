import os

import duckdb
import pytest

from convlake import rule_queries as rq
from convlake import session_queries as sq
from convlake import store_queries as tq

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("query", sq.QUERIES + rq.QUERIES + tq.QUERIES, ids=lambda f: f.__name__)
def test_against_sql(spark, query):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute((sq.SQL | rq.SQL | tq.SQL)[query.__name__])
    columns = [c[0] for c in want.description]
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda cols, rs: sorted((tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rs))
    mine, theirs = rows(got.columns, map(tuple, got.collect())), rows(columns, want.fetchall())
    assert mine == theirs and mine


def test_windows_of_unknown_state_are_no_gaps(spark, tmp_path):
    """Conversation 70: its only window that could be a gap doesn't say whether its artifacts were saved."""
    spark.sql("select 70L as conv_id, 0L as turn, 'user' as role, 'a b c' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(sq.SQL["session_accounting"])
    columns = [c[0] for c in want.description]
    (row,) = want.fetchall()
    assert row[columns.index("artifact_persistence_gaps")] == 0
    assert sq.session_accounting(spark, str(tmp_path)).select(*columns).collect() == [row]
