"""Watching a table of file contents: each batch parses what changed and merges it into the parsed table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.tables import parse

INPUT = "rel string, lang string, content string, seen timestamp"


def latest(rows: DataFrame) -> DataFrame:
    """The last content of each path in a batch."""
    return rows.groupBy("rel").agg(F.max_by(F.struct("lang", "content"), "seen").alias("r")).select("rel", "r.*")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """A query that keeps ``out/<version>`` up to date with the Parquet files that arrive in ``folder``; null content removes a path.

    Every batch writes a whole new version from the last one, named by the batch, so that a
    batch that runs twice after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch)
        parsed = parse(new.withColumn("deleted", F.lit(False)))
        keep = None
        if number > 0:
            keep = spark.read.parquet(f"{out}/{number - 1}").join(new.select("rel"), "rel", "left_anti")
        rows = parsed if keep is None else keep.unionByName(parsed)
        rows.write.mode("overwrite").parquet(f"{out}/{number}")

    stream = spark.readStream.schema(INPUT).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"watch-{uuid.uuid4().hex[:8]}").start()
