"""Every registered query with SQL gives DuckDB's rows on the same tables."""

import pytest

from oracle_check import rows, tables
from snapgraph import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    res = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows(df.columns, df.collect()) == rows(res.columns, res.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_diff_matches_the_matcher(spark, sf_dir):
    from snapgraph.functions.difflines import stats

    docs = {r.doc_id: r.text for r in registry.table(spark, sf_dir, "documents").collect()}
    for r in registry.queries()["text_diff"](spark, sf_dir).collect():
        a = docs[r.doc_id]
        b = (a.split("\n", 1)[1] if "\n" in a else a) + "\nappended"
        assert (r.lines_added, r.lines_removed, r.lines_changed) == (stats(a, b) if a != b else (0, 0, 0))
