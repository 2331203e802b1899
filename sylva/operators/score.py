"""File scores, order, neighbours, top symbols, index tiers and the footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..langs import TYPE_KINDS

TOP_SYMBOLS, TOP_TYPES, TOP_FUNCS, USED_BY, FOOTER_GROUPS = 8, 8, 2, 8, 16
DIGITS = 10


def file_scores(ranks: DataFrame) -> DataFrame:
    """``(file_id, score)``: a file's own rank and what its symbols have above the mean of all nodes."""
    base = ranks.agg((1 / F.count("*")).alias("mean"))
    above = F.expr("if(sym_id is null, score, greatest(score - mean, 0))")
    return ranks.join(F.broadcast(base)).groupBy("file_id").agg(F.round(F.sum(above), DIGITS).alias("score"))


def file_order(files: DataFrame, scores: DataFrame, in_degrees: DataFrame) -> DataFrame:
    """Files with ``pos`` from 1, by score, then path. The sort is global, as its result is."""
    rows = files.select("file_id", "rel", "lang").join(scores, "file_id").join(in_degrees, "file_id", "left")
    return rows.select("file_id", "rel", "lang", "score", F.coalesce("imported_by", F.lit(0)).alias("imported_by"), F.row_number().over(Window.orderBy(F.desc("score"), "rel")).alias("pos"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("imported_by"))


def resolved_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, imports)``: sorted paths of the imported files."""
    to = files.select(F.col("file_id").alias("dst"), "rel")
    return edges.join(to, "dst").groupBy(F.col("src").alias("file_id")).agg(F.array_sort(F.collect_set("rel")).alias("imports"))


def used_by(edges: DataFrame, files: DataFrame, most: int | None = USED_BY) -> DataFrame:
    """``(file_id, used_by)``: the first ``most`` importers in path order.

    A popular file may have any number of importers, so they are cut by a rank, not after collecting.
    """
    rows = edges.join(files.select(F.col("file_id").alias("src"), "rel"), "src").select(F.col("dst").alias("file_id"), "rel")
    if most is not None:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("rel"))).filter(F.col("k") <= most)
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_set("rel")).alias("used_by"))


def symbol_scores(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    return symbols.join(ranks.filter("sym_id is not null").select("file_id", "sym_id", F.round("score", DIGITS).alias("score")), ["file_id", "sym_id"])


def top_symbols(scored: DataFrame, most: int = TOP_SYMBOLS, public_only: bool = True) -> DataFrame:
    """The ``most`` best symbols of each file, ties in source order, with ``omitted``, the number left out."""
    rows = scored.filter("visibility = 'public'") if public_only else scored
    by = Window.partitionBy("file_id")
    rows = rows.withColumn("k", F.row_number().over(by.orderBy(F.desc("score"), "sym_id"))).withColumn("omitted", F.greatest(F.count("*").over(by) - most, F.lit(0)))
    return rows.filter(F.col("k") <= most).drop("k")


def anchor(rel: Column, name: Column, line: Column, twice: Column) -> Column:
    return F.concat(rel, F.lit("#"), name, F.when(twice, F.concat(F.lit("@"), line.cast("string"))).otherwise(""))


def anchors(symbols: DataFrame) -> DataFrame:
    """``symbols`` with ``anchor``: path#name, and the line where the name repeats in its file."""
    twice = F.count("*").over(Window.partitionBy("file_id", "name")) > 1
    return symbols.withColumn("anchor", anchor(F.col("rel"), F.col("name"), F.col("line"), twice))


def index_tiers(scored: DataFrame, order: DataFrame, shown: DataFrame | None = None, types: int = TOP_TYPES, funcs: int = TOP_FUNCS) -> DataFrame:
    """Candidates of the symbol index: public, not shown by name already; the best ``types`` and ``funcs`` of a file.

    ``ord``: types of all files by file position, then functions and constants.
    """
    rows = scored.filter("visibility = 'public'").withColumn("tier", F.when(F.col("kind").isin(*TYPE_KINDS), 0).when(F.col("kind").isin("function", "constant"), 1)).filter("tier is not null")
    if shown is not None:
        rows = rows.join(shown.select("file_id", "name").distinct(), ["file_id", "name"], "left_anti")
    k = F.row_number().over(Window.partitionBy("file_id", "tier").orderBy(F.desc("score"), "sym_id"))
    rows = rows.withColumn("k", k).filter(F.expr(f"k <= if(tier = 0, {types}, {funcs})")).drop("k")
    return rows.join(order.select("file_id", "pos"), "file_id").withColumn("ord", F.row_number().over(Window.orderBy("tier", "pos", "sym_id")))


def symbol_index(symbols: DataFrame, ranks: DataFrame, files: DataFrame, no_private: bool = False) -> DataFrame:
    """All types, then all functions and constants, by the raw rank of the file: ``(ord, name, kind, rel, line, anchor)``."""
    raw = ranks.filter("sym_id is null").select("file_id", F.round("score", DIGITS).alias("file_score"))
    rows = anchors(symbols).withColumn("tier", F.when(F.col("kind").isin(*TYPE_KINDS), 0).when(F.col("kind").isin("function", "constant"), 1)).filter("tier is not null")
    if no_private:
        rows = rows.filter("visibility = 'public'")
    order = Window.orderBy("tier", F.desc("file_score"), "rel", "sym_id")
    return rows.join(raw, "file_id").select(F.row_number().over(order).alias("ord"), "name", "kind", "rel", "line", "anchor")


def explain(files: DataFrame, ranks: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Why a file ranks where it does: position by raw rank, importers, imports, whether it is in focus."""
    raw = ranks.filter("sym_id is null").select("file_id", F.round("score", DIGITS).alias("score"))
    rows = files.select("file_id", "rel").join(raw, "file_id").join(in_degree(edges), "file_id", "left").join(edges.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("imports")), "file_id", "left")
    rows = rows.join(seeds.select("file_id").distinct().withColumn("focus", F.lit(True)), "file_id", "left") if seeds is not None else rows.withColumn("focus", F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("rel", "score", zero("imported_by"), zero("imports"), F.coalesce("focus", F.lit(False)).alias("focus"), F.row_number().over(Window.orderBy(F.desc("score"), "rel")).alias("pos"))


def focus_seeds(files: DataFrame, targets: list[str], lenient: bool = False) -> DataFrame:
    """Files that a target names: its path, a directory above it, and if ``lenient`` the path without extension."""
    rel, hit = F.col("rel"), F.lit(False)
    for t in targets:
        t = t.strip().removeprefix("./").rstrip("/")
        hit = hit | (rel == t) | rel.startswith(t + "/") | F.lit(t in ("", "."))
        if lenient:
            hit = hit | (F.regexp_replace(rel, r"\.[^./]*$", "") == t)
    return files.filter(hit).select("file_id")


def footer_groups(rels: DataFrame, most: int = FOOTER_GROUPS) -> DataFrame:
    """``(dir, n)`` of the files not shown, by their first directories: the finest depth of at most ``most`` groups, counted up from 1.

    Depth 1 always holds; the scan of depths ends at the first with too many groups.
    """
    dirs = rels.select(F.expr("slice(split(rel, '/', -1), 1, size(split(rel, '/', -1)) - 1)").alias("d"))
    # a path shorter than the depth stays in its own directory
    counted = dirs.groupBy("d").agg(F.count("*").alias("n"))
    depth = counted.agg(F.greatest(F.max(F.size("d")), F.lit(1)).alias("depth"))
    every = counted.join(F.broadcast(depth)).withColumn("k", F.expr("explode(sequence(1, depth))"))
    every = every.withColumn("dir", F.expr("if(size(d) = 0, '.', array_join(slice(d, 1, k), '/'))")).groupBy("k", "dir").agg(F.sum("n").alias("n"))
    sizes = every.groupBy("k").agg(F.count("*").alias("groups"))
    first_over = sizes.filter((F.col("groups") > most) & (F.col("k") > 1)).agg(F.min("k").alias("over"))
    best = sizes.join(F.broadcast(first_over)).filter("over is null or k < over").agg(F.max("k").alias("k"))
    return every.join(F.broadcast(best), "k").select("dir", "n")


def prefix_fit(costs: DataFrame, budget: int) -> DataFrame:
    """Rows of ``costs(ord, cost)`` whose running cost stays within ``budget``, with ``total``."""
    total = F.sum("cost").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("total", total).filter(F.col("total") <= budget)
