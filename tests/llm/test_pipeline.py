from types import SimpleNamespace

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from sylva import store
from sylva.llm import entry, mixing


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], COLUMNS)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "a"), (1, long, "a"), (2, long, "b"), (3, long + " more", "a"), (5, "other text of five words here", "a"), (5, long.upper(), "a"), (None, long, "z"), (None, None, "a"), (7, "", "a"), (8, " ", "a"), (9, "p q", "a"), (9, "p q", "b")]
    got = corpus_pipeline.drop_copies(spark, frame(spark, rows), "").collect()
    assert sorted(repr((r.doc_id, r.text, r.source)) for r in got) == sorted(map(repr, [(None, long, "z"), (5, "other text of five words here", "a"), (None, None, "a"), (9, "p q", "a")]))


def test_line_dedup_and_leaks_by_brute_force(spark, sf, tmp_path):
    line = "a line that is long enough to be counted, as it is repeated"
    rows = [(k, f"{line}\nown words {k}", "s") for k in range(6)] + [(10, line, "s"), (11, None, "s"), (12, "", "s"), (None, line, "s"), (13, line, "s"), (13, line, "s")]
    kept = corpus_pipeline.drop_lines(spark, frame(spark, rows), "").collect()
    # the largest id keeps the line; documents that lose all their words go
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in kept) == sorted([(str(k), f"own words {k}", 11) for k in range(6)] + [("11", "", 0), ("12", "", 0), ("13", line, len(line)), ("13", line, len(line))])
    spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x Alpha, beta gamma y", "s"), (1, "x Alpha, beta gamma y", "s"), (2, "alpha beta", "s"), (None, None, "s"), (3, "", "s"), (3, "", "s")]
    kept = corpus_pipeline.drop_leaks(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("2", "alpha beta"), ("3", ""), ("3", ""), ("None", "")]


def test_toxic_rows_go_whatever_their_id(spark, tmp_path):
    vocab = ["bana", "celo", "diru", "fono", "gatu"]
    rows = [(k, " ".join(vocab[(k + j) % 5] for j in range(20)) + f" n{k}" + (" moronic scumbag" if k % 3 == 0 else ""), "s") for k in range(120)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    more = [(None, "celo diru moronic scumbag fono", "s"), (None, "celo diru", "s"), (500, None, "s"), (500, "", "s"), (7, "you moronc scumbagg", "s"), (8, "bana", "s"), (8, "bana", "s")]
    kept = corpus_pipeline.drop_toxic(spark, frame(spark, more), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == [("500", ""), ("500", ""), ("8", "bana"), ("8", "bana"), ("None", "celo diru")]


def test_stages_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        seen.append((name, out.count()))
        if name != "mixing":
            assert set(out.columns) == set(corpus_pipeline.COLUMNS) == set(docs.columns)
    assert all(n <= 200 for _, n in seen) and seen[1][1] >= 195
    assert 100 < corpus_pipeline.run(spark, sf).count() < 200


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert all(stage(spark, docs, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_mixing_keeps_documents_without_an_id(spark):
    rows = [(None, "a b c", "x"), (None, "d e f g", "x"), (1, "h i", "x"), (2, "", "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = sorted((r.doc_id or 0, r.size, r.taken // r.size) for r in mixing.mix(docs).filter("taken > 0").collect())
    got = sorted((r.doc_id or 0, len(r.text.split()), r.copies) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert got == mixed and any(i == 0 for i, _, _ in got)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    theirs = con.execute(entry.oracle_sql()[name]).df()
    ours = __spark_entry__.queries()[name](spark, sf).toPandas()
    rows = lambda f: sorted(map(repr, f[sorted(f)].astype(object).where(f[sorted(f)].notna(), None).values.tolist()))
    assert sorted(ours) == sorted(theirs) and rows(ours) == rows(theirs)


def test_stages_send_small_batches_to_python(spark, sf):
    """So that the Python workers and the buffers of an executor stay small beside its heap."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    corpus_pipeline.drop_lines(spark, docs, sf)
    sizes = spark.range(0, 5_000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 5_000 and max(r.n for r in sizes) <= store.BATCH_ROWS


def test_executors_collect_their_heaps(spark, monkeypatch):
    monkeypatch.setattr(store, "_shrunk", [-1e9])
    collected = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = collected()
    store.shrink(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://far", defaultParallelism=2), range=spark.range))
    assert collected() >= before + 2 and store._shrunk[0] > 0
