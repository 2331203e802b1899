import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sylva.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, size string, target int"


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = mixing.mix(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(3)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    targets = brute_targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    of = {i: s for i, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 2 * max(largest.values(), default=0) + 1


def test_sources(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_caps_and_nulls(spark):
    rows = [(k, "w " * (k % 7), "big") for k in range(300)] + [(1000 + k, "a b c", s) for k, s in enumerate(["a", "a", "é", "z", None, None])]
    rows += [(2000, None, "none"), (2001, "", "none"), (2002, " \t\n\x0b\x0c\r", "big"), (None, "x y", "big"), (2003, "q " * 100_000, "long")]
    check(spark, rows)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a", "", 1), (2, " ", None, "", 1)], SCHEMA)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_plan_has_no_python(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(9)) for k in range(500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, k long, range long").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = common.running_sums(frame, ["g"], ["k"], at="range").collect()
        whole = common.running_sums(frame, [], ["k"], at="range").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert sorted((r.k, r["at"]) for r in got) == sorted((k, sum(v for h, j, v in rows if h == g and j < k)) for g, k, _ in rows)
    assert sorted((r.k, r["at"]) for r in whole) == sorted((k, sum(v for _, j, v in rows if j < k)) for _, k, _ in rows)


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "a b c", "\t\x0b a\x0cb\r\n c ", "é" * 10, "x\u0085y z", None]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: words(t) for k, t in enumerate(texts)}
