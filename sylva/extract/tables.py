"""Extraction as a table function: files to symbols, imports and call names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scanner import extract

PARSED = "symbols array<struct<line:int,name:string,kind:string,signature:string,visibility:string>>, imports array<string>, refs array<string>, lines int"
_SYMBOL = pa.struct([("line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("visibility", pa.string())])


def parse(files: DataFrame) -> DataFrame:
    """``files`` with ``PARSED`` instead of ``content``; rows of null content are left out, as they can't be read.

    Only what the scanner needs goes to Python; source text ends here.
    """
    kept = [c for c in files.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, langs = (batch.column(batch.schema.get_field_index(c)) for c in ("content", "lang"))
            found = [extract(t.as_py(), lang.as_py()) for t, lang in zip(content, langs)]
            symbols = pa.array([[dict(zip(("line", "name", "kind", "signature", "visibility"), s)) for s in f.symbols] for f in found], pa.list_(_SYMBOL))
            extra = [symbols, pa.array([f.imports for f in found], pa.list_(pa.string())), pa.array([f.refs for f in found], pa.list_(pa.string())), pa.array([f.lines for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *extra], [*kept, "symbols", "imports", "refs", "lines"])

    return files.filter("content is not null").mapInArrow(run, f"{schema}, {PARSED}")


def symbols(parsed: DataFrame) -> DataFrame:
    """``(file_id, rel, lang, sym_id, name, kind, signature, line, visibility)``; ``sym_id`` in source order."""
    rows = parsed.select("file_id", "rel", "lang", F.explode("symbols").alias("s")).select("file_id", "rel", "lang", "s.*")
    return rows.withColumn("sym_id", F.row_number().over(Window.partitionBy("file_id").orderBy("line", "name")) - 1)


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", "rel", "lang", F.explode("imports").alias("raw"))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode("refs").alias("name"))
