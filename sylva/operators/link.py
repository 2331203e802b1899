"""Linking: imports and call names resolved to files and symbols.

An import is turned into candidate keys by the importer's language, each with a
priority; all keys meet the path and basename indexes in one equi-join and the best
candidate wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..langs import PACKAGE_STEMS

PATH, BASE = "path", "base"
#: The most shapes of keys that candidates are held against.
MOST_SHAPES = 1_000


def strip_extension(rel: Column) -> Column:
    return F.regexp_replace(rel, r"\.[^./]*$", "")


def basename(stem: Column) -> Column:
    return F.element_at(F.split(stem, "/", -1), -1)


def normalize(path: Column) -> Column:
    """Collapses empty segments, ``.`` and ``..``; null if ``..`` leaves the root."""

    def step(out: Column, part: Column) -> Column:
        up = F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    empty = F.expr("cast(array() as array<string>)")
    # a path without such segments stays as it is, and they are seldom
    odd = path.contains("./") | path.contains("//") | path.startswith("/") | path.endswith("/") | path.endswith(".")
    return F.when(odd, F.array_join(F.aggregate(F.split(path, "/", -1), empty, step), "/")).otherwise(path)


def path_index(files: DataFrame) -> DataFrame:
    """``(key, file_id)``: extension-less paths, and the directory of a package entry file; the smallest id wins."""
    stems = files.select("file_id", strip_extension(F.col("rel")).alias("key"))
    entries = stems.filter(basename(F.col("key")).isin(*PACKAGE_STEMS) & F.col("key").contains("/")).select("file_id", F.regexp_replace("key", "/[^/]*$", "").alias("key"))
    return stems.unionByName(entries).groupBy("key").agg(F.min("file_id").alias("file_id"))


def unique_basenames(files: DataFrame) -> DataFrame:
    """``(key, file_id)`` of basenames, package entries apart, that one file only has."""
    names = files.select("file_id", basename(strip_extension(F.col("rel"))).alias("key")).filter(~F.col("key").isin(*PACKAGE_STEMS))
    return names.groupBy("key").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).filter("n = 1").drop("n")


def include_spec(raw: Column) -> Column:
    """The path of a C include, without quotes; null for ``<...>``."""
    bare = F.trim(F.regexp_replace(raw, r"^\s*#\s*include\s*", ""))
    return F.when(~bare.startswith("<"), F.regexp_replace(bare, "[\"']", ""))


def java_spec(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\s*import\s+(static\s+)?", ""), r"\s*;\s*$", ""))


def candidates(imports: DataFrame) -> DataFrame:
    """``(file_id, raw, priority, kind, key)`` of ``imports(file_id, rel, lang, raw)``; the lowest priority that exists wins."""
    raw, lang, rel = F.col("raw"), F.col("lang"), F.col("rel")
    of_c = lang.isin("c", "cpp")
    used = F.when(raw.contains("use "), F.regexp_replace(raw, r"^.*?use\s", "")).otherwise(raw)
    used = F.regexp_replace(F.regexp_replace(used, r"[{*;].*$", ""), r"\s+as\s.*$", "")
    crumbs = F.filter(F.split(F.trim(used), "::", -1), lambda s: ~F.trim(s).isin("", "crate", "self", "super"))
    # what several expressions stand on is a column of its own, and so worked out once a row and not for each of them and each segment
    imports = imports.select(
        "file_id",
        "raw",
        "lang",
        F.when(lang.isin("typescript", "c", "cpp"), F.when(rel.contains("/"), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("")).alias("folder"),
        F.when(lang.isin("typescript", "go"), F.trim(F.regexp_replace(F.trim(raw), r"^[\"'`]+|[\"'`]+$", ""))).alias("bare"),
        F.when(of_c, strip_extension(include_spec(raw))).alias("spec"),
        F.when(lang == "rust", F.transform(crumbs, lambda s: F.trim(s))).alias("crumbs"),
    )
    bare, spec, crumbs = F.col("bare"), F.col("spec"), F.col("crumbs")
    beside = F.when((lang == "typescript") & bare.startswith("."), F.concat_ws("/", "folder", bare)).when(of_c, F.concat_ws("/", "folder", spec))
    imports = imports.withColumn("beside", beside).withColumn("parts", F.when(lang == "go", F.filter(F.split(bare, "/", -1), lambda s: s != "")))
    imports = imports.withColumn("local", normalize(F.col("beside")))
    local, parts = F.col("local"), F.col("parts")
    dotted = F.replace(F.when(lang == "java", java_spec(raw)).otherwise(F.trim(raw)), F.lit("."), F.lit("/"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(crumbs)), lambda n: F.struct((F.size(crumbs) - n).alias("p"), F.lit(PATH).alias("kind"), F.array_join(F.slice(crumbs, 1, n), "/").alias("key")))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct((F.size(parts) - n).alias("p"), F.lit(PATH).alias("kind"), F.array_join(F.slice(parts, -n, n), "/").alias("key")))
    one = lambda p, kind, key: F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), key.alias("key"))
    found = (
        F.when(lang.isin("python", "java"), F.array(one(0, PATH, dotted)))
        .when(lang == "typescript", F.array(one(0, PATH, local), one(1, PATH, F.concat(local, F.lit("/index")))))
        .when((lang == "rust") & (F.size(crumbs) > 0), F.concat(prefixes, F.array(one(9999, BASE, F.get(crumbs, F.lit(0))))))
        .when((lang == "go") & (F.size(parts) > 0), F.concat(suffixes, F.array(one(9999, BASE, F.element_at(parts, -1)))))
        .when(of_c, F.array(one(0, PATH, local), one(1, PATH, normalize(spec)), one(2, BASE, basename(spec))))
    )
    rows = imports.select("file_id", "raw", F.explode(found.cast("array<struct<priority:int,kind:string,key:string>>")).alias("c"))
    return rows.select("file_id", "raw", "c.*").filter("key is not null and key <> ''")


def import_index(files: DataFrame) -> DataFrame:
    """``(key, dst, kind)``: all that a candidate may bind to."""
    return path_index(files).withColumn("kind", F.lit(PATH)).unionByName(unique_basenames(files).withColumn("kind", F.lit(BASE))).withColumnRenamed("file_id", "dst")


def shape(kind: Column, key: Column) -> Column:
    """First segment and depth of a path; basenames have one shape."""
    return F.when(kind == BASE, "").otherwise(F.concat_ws("/", F.substring_index(key, "/", 1), (F.length(key) - F.length(F.replace(key, F.lit("/")))).cast("string")))


def shapes(index: DataFrame) -> list[str] | None:
    """The shapes of an index's keys; none if there are too many to be worth it."""
    rows = index.select(shape(F.col("kind"), F.col("key")).alias("s")).distinct().limit(MOST_SHAPES + 1).collect()
    return [r.s for r in rows] if len(rows) <= MOST_SHAPES else None


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, raw, dst)`` of the imports that bind to a file."""
    return bind(imports, import_index(files))


def bind(imports: DataFrame, index: DataFrame, of: list[str] | None = None) -> DataFrame:
    """``resolve`` by an ``import_index``; ``of``: its ``shapes``, so that a candidate of another shape, which no key can be, isn't shuffled."""
    rows = candidates(imports)
    if of is not None:
        rows = rows.filter(shape(F.col("kind"), F.col("key")).isin(*of))
    return rows.join(index, ["kind", "key"]).groupBy("file_id", "raw").agg(F.min_by("dst", "priority").alias("dst"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` between different files."""
    return resolved.filter("file_id <> dst").select(F.col("file_id").alias("src"), "dst").distinct()


def reference_edges(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct ``(src, dst_file, dst_sym)``: call names and every definition of that name in another file.

    Names are skewed; the join is a plain equi-join with a residual, which adaptive execution splits. Call names are made distinct before
    it, so its rows are, as symbols have one name each: the many rows are not shuffled.
    """
    right = symbols.select("name", F.col("file_id").alias("dst_file"), F.col("sym_id").alias("dst_sym"))
    calls = refs.select("file_id", "name").distinct()
    return calls.join(right, "name").filter("file_id <> dst_file").select(F.col("file_id").alias("src"), "dst_file", "dst_sym")
