"""Joins that shuffle, as they do on large tables, give the rows of the SQL."""

import duckdb
import pytest

from sylva import corpus
from sylva.plans import registry

from .test_queries import rows

UNIONS = ("diff_symbols", "diff_kind_changes", "diff_changed_files", "diff_files", "diff_imports", "diff_severity", "path_index", "resolve_c", "import_edges")


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", UNIONS)
def test_same_rows_as_sql_without_broadcasts(shuffled, sf, name):
    con = duckdb.connect()
    for t in corpus.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](shuffled, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs) and rows(ours) == rows(theirs)


def test_kind_changes_write_no_imports(spark, sf, monkeypatch):
    kept = []
    table = registry.Tree.table
    monkeypatch.setattr(registry.Tree, "table", lambda t, name, make=None: (kept.append(name), table(t, name, make))[1])
    assert registry.QUERIES["diff_kind_changes"](spark, sf).count() > 0 and sorted(kept) == ["tree_files", "tree_symbols"]
