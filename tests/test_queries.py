import duckdb
import pytest

from sylva import corpus
from sylva.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in corpus.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
