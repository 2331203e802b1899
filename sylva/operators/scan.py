"""Discovery: which paths of a tree are mapped, and what a census of them says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..langs import EXTENSIONS, LANGUAGES, TEST_SEGMENTS, UNSUPPORTED_NAMES, VENDORED
from ..store import materialize


def segments(rel: Column) -> Column:
    return F.split(rel, "/", -1)


def extension(rel: Column) -> Column:
    """After the last dot of the name; null without one or if nothing precedes it."""
    name = F.element_at(segments(rel), -1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1))


def language(ext: Column) -> Column:
    """Null for an extension that isn't mapped; case matters."""
    pairs = [x for e, lang in EXTENSIONS.items() for x in (F.lit(e), F.lit(lang))]
    return F.create_map(*pairs)[ext]


def hidden(rel: Column) -> Column:
    return rel.rlike(r"(^|/)\.")


def vendored(rel: Column) -> Column:
    """Some directory of the path is never entered."""
    return rel.rlike(f"(^|/)({'|'.join(map(re.escape, VENDORED))})/")


def discover(paths: DataFrame, ignore: list[tuple[str, bool, bool]] = (), langs: list[str] | None = None) -> DataFrame:
    """``paths(rel, ...)`` that are mapped, with ``lang``: neither hidden, vendored nor ignored, of a known extension."""
    out = paths.filter(~hidden(F.col("rel")) & ~vendored(F.col("rel"))).withColumn("lang", language(extension(F.col("rel")))).filter("lang is not null")
    if ignore:
        out = out.filter(~ignored(F.col("rel"), ignore))
    return out.filter(F.col("lang").isin(list(langs))) if langs else out


def number(files: DataFrame) -> DataFrame:
    """Adds ``file_id``, 0 up in path order.

    A window without partitions would pass all rows through one task, so the rows are range-sorted and written
    out once, each with its range and its place there; the ranges, a row each, are then counted and offset. What a range holds is thus
    decided once: to sort again for the counts could cut the ranges elsewhere. Repeated paths are numbered in any order.
    """
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in the lower 33
    placed = materialize(files.repartitionByRange("rel").sortWithinPartitions("rel").withColumn("_place", place), "numbered")
    split = placed.select(F.shiftright("_place", 33).alias("_range"))
    counts = split.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r._range, total))
        total += r.n
    table = F.broadcast(files.sparkSession.createDataFrame(starts, "_range long, _start long"))
    own = placed.withColumn("_range", F.shiftright("_place", 33)).join(table, "_range")
    return own.withColumn("file_id", F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_range", "_start", "_place")


def parse_ignore(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of ignore files to ``(pattern, dir_only, anchored)``; blank lines, comments and negations go."""
    t = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    out = lines.select(t.alias("t")).filter("t <> '' and not startswith(t, '#') and not startswith(t, '!')")
    out = out.select(F.regexp_replace("t", "/+$", "").alias("p"), F.expr("endswith(t, '/')").alias("dir_only"))
    return out.filter("p <> ''").select(F.regexp_replace("p", "^/+", "").alias("pattern"), "dir_only", F.expr("contains(p, '/')").alias("anchored")).filter("pattern <> ''")


def ignore_pattern(pattern: str, dir_only: bool, anchored: bool) -> str:
    """A regular expression over the whole path.

    A rule that fits some ancestor directory, or the file itself unless it is
    for directories only. Anchored rules fit a leading run of segments, others any segment; ``*`` stays within one.
    """
    glob = "/".join("".join("[^/]*" if c == "*" else re.escape(c) for c in part) for part in pattern.split("/"))
    return f"{'^' if anchored else '(^|/)'}{glob}{'/' if dir_only else '(/|$)'}"


def ignored(rel: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """The rules come from the root ignore files, so they are few: one expression, no join."""
    out = F.lit(False)
    for rule in rules:
        out = out | rel.rlike(ignore_pattern(*rule))
    return out


def line_count(content: Column) -> Column:
    """Lines split at newlines, without an empty last one."""
    return F.when(content == "", 0).otherwise(F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + F.when(F.endswith(content, F.lit("\n")), 0).otherwise(1)).cast("bigint")


def valid_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Binary contents as text; rows that aren't UTF-8 get null and count as skipped."""
    return files.withColumn(content, F.expr(f"if(is_valid_utf8({content}), cast({content} as string), null)"))


def extension_census(paths: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` lower-cased extensions outside hidden and vendored directories: ``(ext, n, name, pos)``.

    ``name``: the language, if it is a known one that isn't mapped.
    """
    names = F.create_map(*[F.lit(x) for pair in UNSUPPORTED_NAMES.items() for x in pair])
    counted = paths.filter(~hidden(F.col("rel")) & ~vendored(F.col("rel"))).select(F.lower(extension(F.col("rel"))).alias("ext")).filter("ext is not null").groupBy("ext").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "ext").limit(top)
    return best.select("ext", "n", names[F.col("ext")].alias("name"), F.row_number().over(Window.orderBy(F.desc("n"), "ext")).alias("pos"))


def language_census(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n"))


def test_path(rel: Column) -> Column:
    """A test by a segment, by ``conftest.py``, ``test_*``, ``.test.``, ``.spec.`` or a stem that ends in ``_test``."""
    name = F.regexp_extract(rel, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return rel.rlike(rf"(^|[/\\])({'|'.join(TEST_SEGMENTS)})([/\\]|$)") | (name == "conftest.py") | name.startswith("test_") | name.contains(".test.") | name.contains(".spec.") | stem.endswith("_test")


def constant_name(name: Column) -> Column:
    return name.rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")


def visibility(lang: Column, name: Column, signature: Column) -> Column:
    """Public or private by each language's rule."""
    before = F.split_part(signature, name, F.lit(1))
    word = lambda w: before.rlike(rf"(^|[^A-Za-z0-9_])({w})($|[^A-Za-z0-9_])")
    private = (
        F.when(lang == "python", name.startswith("_"))
        .when(lang == "rust", ~signature.startswith("pub"))
        .when(lang.isin("typescript", "java"), word("private|protected"))
        .when(lang == "go", ~name.rlike(r"^\p{Lu}"))
        .when(lang.isin("c", "cpp"), word("static"))
    )
    return F.when(F.coalesce(private, F.lit(False)), "private").otherwise("public")


def dedup_symbols(found: DataFrame) -> DataFrame:
    """Of ``found(file_id, line, name, kind, pattern)`` one row a line and name: a method before others, then the first pattern."""
    best = F.min_by("found", F.expr("struct(if(found.kind = 'method', 0, 1), found.pattern)"))
    rows = found.select("file_id", "line", "name", F.struct(*found.columns).alias("found"))
    return rows.groupBy("file_id", "line", "name").agg(best.alias("best")).select("best.*")


assert set(EXTENSIONS.values()) == set(LANGUAGES)
