import random
import time

import pytest
from pyspark.sql import functions as F

from sylva import store
from sylva.llm.common import components, lookup_join


def test_only_heavy_keys_are_broadcast(spark):
    def joined(big):
        small = store.materialize(big.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most")), "small")
        out = lookup_join(big, small, "k", "n", big.count())
        return out.count(), "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()

    even = spark.range(20_000).selectExpr("id % 5000 as k", "id as v")
    assert joined(even) == (20_000, False)
    assert joined(even.unionByName(spark.range(100).selectExpr("7L as k", "id as v"))) == (20_100, True)


def test_shuffles_of_finished_steps_leave_the_disk(spark, monkeypatch):
    monkeypatch.setattr(store, "RELEASE_S", -1.0)
    count = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    for k in range(3):
        store.materialize(spark.range(10_000).groupBy((F.col("id") % (1000 + k)).alias("k")).count(), "step")
    store.materialize(spark.range(1), "last")
    until = time.time() + 10
    while count() > 4 and time.time() < until:
        time.sleep(0.2)
    assert count() <= 4


def _reached(edges):
    out = {x: {x} for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and out[a] is not out[b]:
            out[a] |= out[b]
            for x in out[b]:
                out[x] = out[a]
    return {x: min(group) for x, group in out.items()}


@pytest.mark.parametrize("small", [10_000, 0])
def test_components_in_one_task_are_those_of_the_rounds(spark, small):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300) << 40, rng.randrange(-300, 300) << 40) for _ in range(250)] + [(7, 7), (1, 2), (2, 1), (1, 2)] + [(k, k + 1) for k in range(100, 130)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), small).collect()
    assert {r.node: r.component for r in got} == _reached(edges) and len(got) == len(_reached(edges))


def test_few_edges_take_few_jobs(spark):
    """Each round of joins is some jobs, whose plans the driver holds and whose code the executors hold."""
    chain = store.materialize(spark.range(40).selectExpr("id as a", "id + 1 as b"), "chain")
    spark.sparkContext.setJobGroup("few", "components")
    assert components(chain).filter("component <> 0").isEmpty()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 10
