"""Point lookups: where a symbol is, what an anchor names, what a file touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import anchors


def find_symbol(symbols: DataFrame, name: str, langs: list[str] | None = None, no_private: bool = False) -> DataFrame:
    """Exact name, by path and line."""
    hits = anchors(symbols).filter(F.col("name") == name)
    if langs:
        hits = hits.filter(F.col("lang").isin(list(langs)))
    if no_private:
        hits = hits.filter("visibility = 'public'")
    return hits.select("rel", "name", "kind", "signature", "line", "visibility", "anchor").orderBy("rel", "line")


def parse_anchors(rows: DataFrame, col: str = "anchor") -> DataFrame:
    """``rows`` with ``path``, ``name`` and ``line``: split at the first ``#``, a trailing ``@digits`` pins a line; null if a side is empty."""
    path = F.regexp_extract(col, r"^(?s)([^#]+)#(.+)$", 1)
    rest = F.regexp_extract(col, r"^(?s)([^#]+)#(.+)$", 2)
    pinned = rest.rlike(r"(?s)^.+@[0-9]+$")
    name = F.when(pinned, F.regexp_replace(rest, r"@[0-9]+$", "")).otherwise(rest)
    line = F.when(pinned, F.regexp_extract(rest, r"@([0-9]+)$", 1).cast("int"))
    ok = path != ""
    return rows.withColumns({"path": F.when(ok, path), "name": F.when(ok, name), "line": F.when(ok, line)})


def expand_symbol(symbols: DataFrame, edges: DataFrame, files: DataFrame, rel: str, name: str, line: int | None = None) -> DataFrame:
    """The first such symbol in source order, with the files its file imports and those that import it; no row if stale."""
    found = symbols.filter((F.col("rel") == rel) & (F.col("name") == name))
    if line is not None:
        found = found.filter(F.col("line") == line)
    found = found.orderBy("sym_id").limit(1)
    names = files.select(F.col("file_id").alias("id"), F.col("rel").alias("other"))
    out = edges.join(found.select(F.col("file_id").alias("src")), "src", "left_semi").join(names, F.col("dst") == F.col("id")).agg(F.array_sort(F.collect_set("other")).alias("imports"))
    into = edges.join(found.select(F.col("file_id").alias("dst")), "dst", "left_semi").join(names, F.col("src") == F.col("id")).agg(F.array_sort(F.collect_set("other")).alias("used_by"))
    return found.select("rel", "name", "kind", "signature", "line", "visibility").join(F.broadcast(out)).join(F.broadcast(into))
