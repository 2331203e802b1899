"""Parsed files kept as Parquet, by path and content hash."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.tables import PARSED, parse

VERSION = 1
SCHEMA = f"rel string, content_hash string, {PARSED}"
FOLDER = ".sylva-cache"


class Cache:
    """Under ``root``; anything wrong with it makes it cold. Saving keeps only the files of this run."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True) -> None:
        self.spark, self.folder, self.enabled = spark, os.path.join(root, FOLDER), enabled

    @property
    def path(self) -> str:
        return os.path.join(self.folder, f"v{VERSION}")

    def read(self) -> DataFrame:
        if self.enabled and os.path.isdir(self.path):
            try:
                rows = self.spark.read.schema(SCHEMA).parquet("file://" + os.path.abspath(self.path))
                rows.limit(1).collect()
                return rows
            except Exception:  # a damaged cache is a cold one
                pass
        return self.spark.createDataFrame([], SCHEMA)

    def parse(self, files: DataFrame) -> DataFrame:
        """``parse`` of the files whose path and content aren't known; the others come from the table."""
        if not self.enabled:
            return parse(files)
        hashed = files.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
        known = self.read().withColumnRenamed("lines", "own_lines")
        kept = [c for c in hashed.columns if c != "content"]
        hits = hashed.drop("content").join(known, ["rel", "content_hash"]).withColumnRenamed("own_lines", "lines")
        misses = parse(hashed.join(known.select("rel", "content_hash"), ["rel", "content_hash"], "left_anti"))
        columns = [*kept, "symbols", "imports", "refs", "lines"]
        return hits.select(*columns).unionByName(misses.select(*columns))

    def save(self, parsed: DataFrame) -> None:
        """Written beside and renamed, so that a reader never sees half of it."""
        if not self.enabled:
            return
        try:
            os.makedirs(self.folder, exist_ok=True)
            with open(os.path.join(self.folder, ".gitignore"), "w") as f:
                f.write("*\n")
            fresh, old = (os.path.join(self.folder, f"{k}-{uuid.uuid4().hex}") for k in ("new", "old"))
            parsed.select("rel", "content_hash", "symbols", "imports", "refs", "lines").write.parquet("file://" + os.path.abspath(fresh))
            if os.path.isdir(self.path):
                os.rename(self.path, old)
            os.rename(fresh, self.path)
            shutil.rmtree(old, ignore_errors=True)
        except OSError:
            pass

    def info(self) -> dict:
        files = [os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in names]
        return {"path": self.folder, "version": VERSION, "exists": os.path.isdir(self.path), "bytes": sum(map(os.path.getsize, files)), "entries": self.read().count(), "self_ignored": os.path.isfile(os.path.join(self.folder, ".gitignore"))}

    def clean(self) -> bool:
        there = os.path.isdir(self.folder)
        shutil.rmtree(self.folder, ignore_errors=True)
        return there
