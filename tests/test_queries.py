"""Every registered core query against its SQL on whole small tables."""

from __future__ import annotations

import os

import pytest

from radweave import queries as core
from tests.comparing import database, ordered

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
NAMES = sorted(core.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, data, name):
    df = core.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    c = database(data).execute(sql)
    assert ordered(df.columns, rows) == ordered([d[0] for d in c.description], c.fetchall())


def test_entry_has_all(spark, data):
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["rec_id", "labels"]


def test_scanned_all_keeps_null_empty_and_blank_texts(spark, tmp_path):
    rows = [(1, "one"), (2, None), (3, ""), (4, " \n"), (5, "")]
    spark.createDataFrame(rows, "rec_id long, report_text string").coalesce(1).write.parquet(str(tmp_path / "out"))
    next((tmp_path / "out").glob("*.parquet")).rename(tmp_path / "annotated_reports.parquet")
    for name, n in (("scanned_all", 5), ("scanned_reports", 1)):
        df = core.queries()[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        c = database(tmp_path).execute(core.oracle_sql()[name])
        assert len(got) == n and ordered(df.columns, got) == ordered([d[0] for d in c.description], c.fetchall())
