"""Imports linked a slice of the orders at a time are those of all orders."""

import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva import corpus, store
from sylva.operators import link
from sylva.plans import registry

from .test_queries import rows


@pytest.fixture
def sliced(monkeypatch):
    monkeypatch.setattr(corpus, "SLICE_ROWS", 1_500)


def test_slices_hold_each_row_once_and_an_order_whole(spark, sf, sliced):
    parts = [spark.sql(f"SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM {s}").withColumn("k", F.lit(k)) for k, s in enumerate(corpus.slices(spark, sf))]
    every = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert len(parts) > 2 and sum(p.count() for p in parts) == every.count()
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    assert together.groupBy("o").agg(F.count_distinct("k").alias("k")).filter("k > 1").isEmpty()


@pytest.mark.parametrize("name", ["import_edges", "file_order"])
def test_same_rows_as_sql_by_slices(spark, sf, sliced, name):
    con = duckdb.connect()
    for t in corpus.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert rows(ours) == rows(theirs)


def test_shapes_drop_no_candidate_that_binds(spark):
    files = spark.createDataFrame([(0, "a/b/x.py"), (1, "a/mod.rs"), (2, "x.c"), (3, "lib/deep/er/y.go")], "file_id long, rel string")
    index = link.import_index(files)
    imports = spark.createDataFrame([(0, "a/b/x.py", "python", "lib.deep.er.y"), (1, "a/mod.rs", "rust", "use crate::a::b::x::T;"), (2, "x.c", "c", '"a/b/x.h"'), (3, "lib/deep/er/y.go", "go", '"host/x"'), (0, "a/b/x.py", "python", "lib.deep")], "file_id long, rel string, lang string, raw string")
    of = link.shapes(index)
    assert sorted(of) == ["", "a/0", "a/1", "a/2", "lib/3", "x/0"]
    got = sorted(link.bind(imports, index, of).collect())
    assert got == sorted(link.resolve(imports, files).collect()) and [(r.file_id, r.dst) for r in got] == [(0, 3), (1, 0), (2, 0), (3, 2)]


def test_normalize_of_plain_and_odd_paths(spark):
    paths = ["", "a", "a/b.c", "a./b", ".", "..", "a/..", "/a", "a/", "a//b", "./a", "a/./b/../c", "..a/b", "a/b..", "a/...", "../a"]
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", link.normalize(F.col("p")).alias("n")).collect()}
    assert got == {"": "", "a": "a", "a/b.c": "a/b.c", "a./b": "a./b", ".": "", "..": None, "a/..": "", "/a": "a", "a/": "a", "a//b": "a/b", "./a": "a", "a/./b/../c": "a/c", "..a/b": "..a/b", "a/b..": "a/b..", "a/...": "a/...", "../a": None}


@pytest.mark.parametrize("name", ["out_degree", "pagerank_focus", "topk_symbols", "index_tiers"])
def test_names_by_slices_of_the_files_give_the_rows_of_the_sql(spark, sf, sliced, name):
    assert len(corpus.slices(spark, sf, "l_partkey", 3)) > 1
    con = duckdb.connect()
    for t in corpus.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert rows(ours) == rows(theirs)


def test_tables_of_the_slices_go_once_the_edges_stand(spark, sf, sliced):
    tree = registry.Tree(spark, sf)
    since = store.mark()
    n = tree.imports().count()
    tree.named()
    left = [path.rpartition("/")[2].rpartition("-")[0] for path in store._written[since:]]
    assert left == ["files", "import_edges", "symbols", "named"]
    stand = {p.name.rpartition("-")[0] for p in Path(store.shared_dir(spark).removeprefix("file://")).iterdir() if any(str(p) in path for path in store._written[since:])}
    assert stand == set(left) and tree.imports().count() == n > 0


def test_shuffle_files_go_as_a_table_stands(spark, monkeypatch):
    """Without a collection of the driver's heap."""
    monkeypatch.setattr(store, "RELEASE_S", float("inf"))
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in disk.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffles()
    table = store.materialize(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "step")
    end = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 1000
    assert spark.conf.get(store.CLEANUP, None) in (None, "false")
