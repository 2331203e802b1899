"""Benchmark analytics: coverage of answers, tokens of exploration, medians and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def answer_coverage(questions: DataFrame, maps: DataFrame) -> DataFrame:
    """``(id, map_id, covered)``: any or all of ``questions(id, match, expect)`` occur in ``maps(map_id, text)``.

    The maps are few, one a budget; the questions meet each.
    """
    hit = lambda e: F.col("text").contains(e)
    covered = F.when(F.col("match") == "any", F.exists("expect", hit)).otherwise(F.forall("expect", hit))
    return questions.join(F.broadcast(maps)).select("id", "map_id", covered.alias("covered"))


def exploration_tokens(log: DataFrame) -> DataFrame:
    """``(run_id, before_edit, total, capped)`` of ``log(run_id, seq, tokens, is_edit)``.

    ``before_edit`` sums up to and with the first edit; a run without one is capped. Runs without tokens are rejected.
    """
    before = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("is_edit").cast("int")).over(before), F.lit(0))
    rows = log.withColumn("past", seen)
    out = rows.groupBy("run_id").agg(F.sum(F.when(F.col("past") == 0, F.col("tokens")).otherwise(0)).alias("before_edit"), F.sum("tokens").alias("total"), (F.max(F.col("is_edit").cast("int")) == 0).alias("capped"))
    return out.filter("total > 0")


def lower_medians(runs: DataFrame, by: str, value: str, keep: Column) -> DataFrame:
    """``(by, n, median, low, high)`` over the kept rows: the median is element (n + 1) div 2 in order."""
    rows = runs.filter(keep).select(by, F.col(value).alias("v"))
    k = F.row_number().over(Window.partitionBy(by).orderBy("v"))
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumns({"k": k, "n": n}).groupBy(by, "n").agg(F.max(F.when(F.expr("k = (n + 1) div 2"), F.col("v"))).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))


def spread(low: Column, high: Column, median: Column) -> Column:
    """(high - low) * 100 / median as a whole number; runs above 15 are noisy."""
    return F.floor((high - low) * 100 / median).cast("bigint")


def accuracy(correct: Column) -> Column:
    return F.round(F.avg(correct.cast("double")), 3)
