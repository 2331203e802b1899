"""Structural diff of two trees: set operations and outer joins over symbols and imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(symbols: DataFrame, no_private: bool) -> DataFrame:
    return symbols.filter("visibility = 'public'") if no_private else symbols


def file_summaries(files: DataFrame, symbols: DataFrame, no_private: bool = False) -> DataFrame:
    """``(tree, rel, lang, symbols, public)``; without private symbols, files that have none left go."""
    n = symbols.groupBy("tree", "rel").agg(F.count("*").alias("symbols"), F.count_if(F.col("visibility") == "public").alias("public"))
    out = files.join(n, ["tree", "rel"], "left").fillna(0, ["symbols", "public"])
    return out.filter("symbols > 0") if no_private else out


def added_and_removed(files: DataFrame) -> DataFrame:
    """``(op, rel, lang)`` of paths in one tree only: one aggregate instead of two anti-joins."""
    sides = files.groupBy("rel").agg(F.max((F.col("tree") == "old")).alias("old"), F.max((F.col("tree") == "new")).alias("new"), F.max("lang").alias("lang"))
    return sides.filter("old <> new").select(F.when(F.col("new"), "added").otherwise("removed").alias("op"), "rel", "lang")


def moves(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(old_rel, new_rel, symbols)``: a removed and an added file of the same symbols, both alone in having them."""
    single = added_and_removed(files).select("rel", "op")
    tree = F.when(F.col("op") == "added", "new").otherwise("old")
    listed = symbols.join(single.withColumn("tree", tree), ["tree", "rel"])
    prints = listed.groupBy("op", "rel").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\0", "kind", "name", "signature"))), "\n"), 256).alias("print"), F.count("*").alias("symbols"))
    alone = prints.withColumn("k", F.count("*").over(Window.partitionBy("op", "print"))).filter("k = 1")
    old, new = alone.filter("op = 'removed'"), alone.filter("op = 'added'")
    return old.select("print", F.col("rel").alias("old_rel"), "symbols").join(new.select("print", F.col("rel").alias("new_rel")), "print").select("old_rel", "new_rel", "symbols")


def severity(op: Column, public: Column) -> Column:
    return F.when(~public, "internal").when(op.isin("removed", "changed"), "breaking").otherwise("notable")


def file_changes(files: DataFrame, symbols: DataFrame, no_private: bool = False) -> DataFrame:
    """``(op, rel, new_rel, lang, symbols, severity)`` of added, removed and moved files."""
    seen = visible(symbols, no_private)
    moved = moves(files, seen).withColumnRenamed("symbols", "n")
    gone = moved.select(F.col("old_rel").alias("rel")).unionByName(moved.select(F.col("new_rel").alias("rel")))
    tree = F.when(F.col("op") == "added", "new").otherwise("old")
    plain = added_and_removed(files).join(gone, "rel", "left_anti").withColumn("tree", tree).join(file_summaries(files, seen, no_private).drop("lang"), ["tree", "rel"])
    plain = plain.select("op", "rel", F.lit(None).cast("string").alias("new_rel"), "lang", "symbols", severity(F.col("op"), F.col("public") > 0).alias("severity"))
    langs = files.filter("tree = 'new'").select(F.col("rel").alias("new_rel"), "lang")
    went = moved.join(langs, "new_rel").select(F.lit("moved").alias("op"), F.col("old_rel").alias("rel"), "new_rel", "lang", F.col("n").alias("symbols"), F.lit("informational").alias("severity"))
    return plain.unionByName(went)


def _common(files: DataFrame) -> DataFrame:
    return files.groupBy("rel").agg(F.count_distinct("tree").alias("k")).filter("k = 2").select("rel")


def symbol_changes(files: DataFrame, symbols: DataFrame, no_private: bool = False) -> DataFrame:
    """``(rel, op, kind, new_kind, name, old_sig, new_sig, severity)`` in the files of both trees.

    Signatures of a kind and name are compared as sorted lists: one on both sides is a change, else
    those that the other side lacks are added or removed. A name added once and removed once under another kind is one change of kind.
    """
    both = visible(symbols, no_private).join(_common(files), "rel", "left_semi")
    side = lambda t: F.array_sort(F.collect_list(F.when(F.col("tree") == t, F.col("signature"))))
    seen = lambda t: F.max((F.col("tree") == t) & (F.col("visibility") == "public"))
    b = both.groupBy("rel", "kind", "name").agg(side("old").alias("olds"), side("new").alias("news"), seen("old").alias("old_public"), seen("new").alias("new_public")).filter("olds <> news")
    # one stream of changes, without a union: over a union of branches dealt out alike Spark 4.1 leaves out the exchange that a window needs
    row = "named_struct('op', '{0}', 's', {1}, 'old_sig', {2}, 'new_sig', {3}, 'public', {4})".format
    one = f"array({row('changed', 'news[0]', 'olds[0]', 'news[0]', 'new_public')})"
    added = f"transform(filter(news, x -> not array_contains(olds, x)), x -> {row('added', 'x', 'cast(null as string)', 'x', 'new_public')})"
    removed = f"transform(filter(olds, x -> not array_contains(news, x)), x -> {row('removed', 'x', 'x', 'cast(null as string)', 'old_public')})"
    each = b.select("rel", "kind", "name", F.expr(f"inline(if(size(olds) = 1 and size(news) = 1, {one}, concat({added}, {removed})))"))
    by = Window.partitionBy("rel", "name")
    n = lambda op: F.count_if(F.col("op") == op).over(by)
    pick = lambda op, c: F.max(F.when(F.col("op") == op, F.col(c))).over(by)
    lone = (n("added") == 1) & (n("removed") == 1) & (pick("added", "kind") != pick("removed", "kind")) & (F.col("op") != "changed")
    each = each.withColumns({"paired": F.coalesce(lone, F.lit(False)), "was": pick("removed", "kind"), "was_sig": pick("removed", "s")}).filter("not (paired and op = 'removed')")
    pair = lambda then, other: F.when(F.col("paired"), then).otherwise(other)
    return each.select(
        "rel", pair(F.lit("kind"), F.col("op")).alias("op"), pair(F.col("was"), F.col("kind")).alias("kind"), F.when(F.col("paired"), F.col("kind")).alias("new_kind"), "name",
        pair(F.col("was_sig"), F.col("old_sig")).alias("old_sig"), "new_sig", severity(F.col("op"), F.col("public")).alias("severity"),
    )


def import_changes(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``(rel, op, raw)``: import texts that one side of a file in both trees has."""
    sides = imports.join(_common(files), "rel", "left_semi").groupBy("rel", "raw").agg(F.max(F.col("tree") == "old").alias("old"), F.max(F.col("tree") == "new").alias("new"))
    return sides.filter("old <> new").select("rel", F.when(F.col("new"), "added").otherwise("removed").alias("op"), "raw")


@dataclass
class Diff:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame

    def changed_files(self) -> DataFrame:
        """A join and no union, over which the exchange of ``distinct`` would be left out (see ``symbol_changes``)."""
        return self.symbols.select("rel").distinct().join(self.imports.select("rel").distinct(), "rel", "full")

    def severities(self) -> DataFrame:
        """``(severity, n)`` over every change; each import is informational."""
        every = self.files.select("severity").unionByName(self.symbols.select("severity")).unionByName(self.imports.select(F.lit("informational").alias("severity")))
        return every.groupBy("severity").agg(F.count("*").alias("n"))

    def breaking(self) -> bool:
        return not self.files.select("severity").unionByName(self.symbols.select("severity")).filter("severity = 'breaking'").isEmpty()

    def is_empty(self) -> bool:
        return self.files.isEmpty() and self.symbols.isEmpty() and self.imports.isEmpty()


def diff(files: DataFrame, symbols: DataFrame, imports: DataFrame, no_private: bool = False) -> Diff:
    """Of ``files(tree, rel, lang)``, ``symbols(tree, rel, ...)`` and ``imports(tree, rel, raw)`` with tree ``old`` or ``new``."""
    return Diff(file_changes(files, symbols, no_private), symbol_changes(files, symbols, no_private), import_changes(files, imports))
