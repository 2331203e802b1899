"""Relations of a source tree derived from the star-schema tables.

The recipes are SQL that Spark and DuckDB read alike, so that queries
over them can be compared. No table holds source files: paths come from ``part``,
imports and references from the order of ``lineitem``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(("py", "ts", "rs", "go", "java", "c", "cpp"))) + " ELSE 'rb' END"
_SIX = " UNION ALL ".join(f"SELECT {k} AS j" for k in range(7))
_KIND = "CASE (pk + j) % 9 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(("function", "method", "class", "interface", "enum", "type", "constant", "field"))) + " ELSE 'module' END"

RECIPES = {
    # every path of the tree, unsupported, hidden and vendored ones included
    "paths": f"""
SELECT p_partkey AS pk, p_size, p_name, {_EXT} AS ext,
  concat(CASE WHEN p_partkey % 23 = 5 THEN 'tests/' WHEN p_partkey % 29 = 7 THEN 'node_modules/' WHEN p_partkey % 31 = 9 THEN '.cache/' WHEN p_partkey % 37 = 11 THEN 'docs/gen/' ELSE '' END,
    'src/', lower(replace(p_brand, '#', '')), '/', lower(p_type), '/',
    CASE WHEN p_partkey % 19 = 4 THEN concat('pkg_', p_partkey, '/', CASE p_partkey % 8 WHEN 0 THEN '__init__' WHEN 2 THEN 'mod' ELSE 'index' END)
         WHEN p_partkey % 41 = 3 THEN concat('test_', p_partkey) WHEN p_partkey % 43 = 2 THEN concat('.dot_', p_partkey) WHEN p_partkey % 47 = 1 THEN concat('part_', p_partkey, '.spec') ELSE concat('part_', p_partkey) END,
    '.', {_EXT}) AS rel,
  concat(repeat(concat(p_name, chr(10)), CAST(p_size % 7 AS INTEGER)), CASE WHEN p_partkey % 3 = 0 THEN 'tail' ELSE '' END) AS content
FROM part""",
    # what discovery should leave, with ids in path order
    "files": """
SELECT pk, CAST(row_number() OVER (ORDER BY rel) - 1 AS BIGINT) AS file_id, rel, p_size, content,
  CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' ELSE ext END AS lang
FROM paths WHERE ext <> 'rb' AND rel NOT LIKE '.cache/%' AND rel NOT LIKE 'node_modules/%' AND rel NOT LIKE '%/.dot_%'""",
    "symbols": f"""
SELECT file_id, rel, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line, name) - 1 AS INTEGER) AS sym_id, name, kind,
  concat(CASE WHEN visibility = 'private' THEN 'static ' ELSE 'pub ' END, kind, ' ', name, '(a: int, b: str) {{') AS signature, line, visibility
FROM (
  SELECT file_id, rel, concat('sym_', (pk * 7 + (j % 5) * 13) % 5003) AS name, {_KIND} AS kind, CAST(3 + 4 * j AS INTEGER) AS line,
    CASE WHEN (pk + 2 * j) % 5 = 0 THEN 'private' ELSE 'public' END AS visibility
  FROM files CROSS JOIN ({_SIX}) r WHERE j < p_size % 7) s""",
    "adjacent": """
SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) a
WHERE dst IS NOT NULL""",
    # import text in the importer's style, of a file that may not be mapped
    "imports": """
SELECT DISTINCT f.file_id, f.rel, f.lang, CASE
    WHEN (a.src + a.dst) % 11 = 0 THEN 'no.such.module'
    WHEN f.lang IN ('python', 'java') THEN replace(t.stem, '/', '.')
    WHEN f.lang = 'typescript' THEN concat('"./', repeat('../', CAST(length(f.rel) - length(replace(f.rel, '/', '')) AS INTEGER)), t.stem, '"')
    WHEN f.lang = 'rust' AND (a.src + a.dst) % 3 = 0 THEN concat('use ', t.base, '::Item;')
    WHEN f.lang = 'rust' THEN concat('use crate::', replace(t.stem, '/', '::'), '::{Item, Other};')
    WHEN f.lang = 'go' AND (a.src + a.dst) % 3 = 0 THEN concat('"elsewhere/', t.base, '"')
    WHEN f.lang = 'go' THEN concat('"example.com/repo/', t.stem, '"')
    WHEN (a.src + a.dst) % 3 = 0 THEN concat('"', t.base, '.h"')
    ELSE concat('"', t.rel, '"') END AS raw
FROM adjacent a JOIN files f ON f.pk = a.src JOIN (
  SELECT pk, rel, substr(rel, 1, length(rel) - length(ext) - 1) AS stem, CASE WHEN pk % 19 = 4 THEN 'index' ELSE concat('part_', pk) END AS base FROM paths) t ON t.pk = a.dst""",
    "refs": """
SELECT DISTINCT f.file_id, concat('sym_', (l_partkey * 11 + l_suppkey) % 5003) AS name FROM lineitem l JOIN files f ON f.pk = l.l_partkey""",
    # two trees: files and symbols that go, come, move, change their signature or kind
    "tree_files": """
SELECT 'old' AS tree, rel, lang FROM files WHERE pk % 13 <> 1
UNION ALL
SELECT 'new' AS tree, CASE WHEN pk % 17 = 2 THEN concat('moved/', rel) ELSE rel END AS rel, lang FROM files WHERE pk % 13 <> 2""",
    "tree_symbols": """
SELECT 'old' AS tree, f.rel, s.name, s.kind, s.signature, s.line, s.visibility FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE f.pk % 13 <> 1
UNION ALL
SELECT 'new' AS tree, CASE WHEN f.pk % 17 = 2 THEN concat('moved/', f.rel) ELSE f.rel END AS rel,
  CASE WHEN f.pk % 17 <> 2 AND (s.line + f.pk) % 19 = 0 THEN concat(s.name, '_x') ELSE s.name END AS name,
  CASE WHEN f.pk % 17 <> 2 AND (s.line + f.pk) % 11 = 0 THEN 'class' ELSE s.kind END AS kind,
  CASE WHEN f.pk % 17 <> 2 AND (s.line + f.pk) % 7 = 0 THEN concat(s.signature, ' // v2') ELSE s.signature END AS signature,
  s.line, s.visibility
FROM symbols s JOIN files f ON f.file_id = s.file_id WHERE f.pk % 13 <> 2 AND (f.pk % 17 = 2 OR (s.line + f.pk) % 23 <> 0)""",
    "tree_imports": """
SELECT 'old' AS tree, i.rel, i.raw FROM imports i JOIN files f ON f.file_id = i.file_id WHERE f.pk % 13 <> 1
UNION ALL
SELECT 'new' AS tree, CASE WHEN f.pk % 17 = 2 THEN concat('moved/', i.rel) ELSE i.rel END AS rel, CASE WHEN f.pk % 5 = 0 THEN concat(i.raw, ' ') ELSE i.raw END AS raw
FROM imports i JOIN files f ON f.file_id = i.file_id WHERE f.pk % 13 <> 2""",
}

TABLES = ("part", "lineitem", "events", "conversations", "documents", "pages", "customer", "orders")
#: About the rows of ``lineitem`` in a slice, and the most slices: each meets all files anew.
SLICE_ROWS, MOST_SLICES = 4_000_000, 16


def relation(spark: SparkSession, sf_dir: str, name: str, given: dict[str, str] | None = None) -> DataFrame:
    """One of ``RECIPES`` or a table, as a lazy DataFrame; ``given``: what Spark reads in place of a recipe or table, a source of a FROM clause each."""
    return spark.sql(located(with_recipes(f"SELECT * FROM {name}", given=given), sf_dir, given))


def located(text: str, sf_dir: str, given: dict[str, str] | None = None) -> str:
    """``text`` with the tables' names replaced by their Parquet paths, for Spark."""
    source = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | (given or {})
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(source)})\b(?! AS)", lambda m: f"{m[1]} {source[m[2]]}", text)


def slices(spark: SparkSession, sf_dir: str, key: str = "l_orderkey", size: int = 1) -> list[str]:
    """Sources of a FROM clause that together hold each row of ``lineitem`` once, a ``key`` in one of them; ``size``: times ``SLICE_ROWS``."""
    table = f"parquet.`{sf_dir}/lineitem.parquet`"
    n = min(MOST_SLICES, 1 + spark.sql(f"SELECT count(*) FROM {table}").first()[0] // (size * SLICE_ROWS))
    return [f"(SELECT * FROM {table} WHERE pmod(xxhash64({key}), {n}) = {k})" for k in range(n)] if n > 1 else [table]


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b(FROM|JOIN) {name}\b", text) is not None


def with_recipes(body: str, extra: dict[str, str] | None = None, materialized: bool = False, given: dict[str, str] | None = None) -> str:
    """``body`` after the common table expressions it needs, but for ``given``, in one SQL text; ``materialized``: each worked out once (not known to Spark)."""
    known = {n: text for n, text in (RECIPES | (extra or {})).items() if n not in (given or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for n in known:
            if n not in order and _mentions(text, n):
                if n not in doing:
                    doing.append(n)
                    need(known[n])
                    order.append(n)

    doing: list[str] = []
    need(body)
    return ("WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' * materialized}({known[n]})" for n in order) + "\n" if order else "") + body
