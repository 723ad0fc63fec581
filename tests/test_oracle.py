"""Every query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from marlstone.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(table):
    return sorted(repr([v if not isinstance(v, float) else round(v, 9) for v in (row[c] for c in sorted(table.column_names))]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = catalogue.queries()[name](spark, SF).toArrow(), duck.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert plain(ours) == plain(theirs)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        catalogue.register("rrf_fusion")(lambda spark, sf: None)
