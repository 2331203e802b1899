"""Registered queries over the derived tree and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import budget, corpus
from ..extract import tables
from ..functions import text
from ..langs import KINDS, PRESETS, VENDORED
from ..operators import diff, link, lookup, metrics, rank, scan, score
from ..render import markdown
from ..store import mark, materialize, sweep, write, write_parts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

IGNORE = [("gen", True, False), ("src/brand1*/promo", True, True), ("*_7*.go", False, False), ("/src/brand23".lstrip("/"), False, True)]
FOCUS_DIR = "src/brand1"
_SYM = "coalesce(sym_id, -1) as sym_id"


class Tree:
    """The derived relations of one data folder, and what is linked and ranked from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.kept, self.paths, self.given = spark, sf_dir, {}, {}, {}

    def get(self, name: str, **given: str) -> DataFrame:
        """A relation or table, from the files as they were written out if they were; ``given``: see ``corpus.relation``."""
        return corpus.relation(self.spark, self.sf_dir, name, self.given | given)

    def table(self, name: str, make=None) -> DataFrame:
        """A relation that a query reads more than once, written out once; ``make`` gives it whole or in parts."""
        if name not in self.kept:
            made = make() if make else self.get(name)
            self.kept[name], self.paths[name] = write(made, name) if isinstance(made, DataFrame) else write_parts(made, name)
            if name == "files":
                self.given[name] = f"parquet.`{self.paths[name]}`"
        return self.kept[name]

    def imports(self) -> DataFrame:
        if "import_edges" not in self.kept:
            self.table("files")
            since = mark()
            self.table("import_edges", self._import_edges)
            sweep(self.spark, since, self.paths["import_edges"])
        return self.kept["import_edges"]

    def _import_edges(self) -> DataFrame:
        """Linked a slice of the orders at a time, so that the shuffles of one slice are gone when the next one's come."""
        index = materialize(link.import_index(self.table("files")), "import-index")
        of = link.shapes(index)
        edges = [link.import_edges(link.bind(self.get("imports", lineitem=part), index, of)) for part in corpus.slices(self.spark, self.sf_dir)]
        return edges[0] if len(edges) == 1 else write_parts(edges, "import-edges")[0].distinct()

    def references(self) -> DataFrame:
        return link.reference_edges(self.get("refs"), self.table("symbols"))

    def named(self) -> DataFrame:
        if "named" not in self.kept:
            self.table("files"), self.table("symbols")
            since = mark()
            self.table("named", self._named)
            sweep(self.spark, since, self.paths["named"])
        return self.kept["named"]

    def _named(self) -> list[DataFrame]:
        """By slices of the files, each of which has its call names in one."""
        parts = corpus.slices(self.spark, self.sf_dir, "l_partkey", 3)
        if len(parts) == 1:
            return [rank.named_references(self.get("refs"), self.table("symbols"))]
        own = materialize(rank.definitions(self.table("symbols")), "definitions")
        every = materialize(rank.defined_names(own), "defined-names")
        return [rank.named_among(self.get("refs", lineitem=part), own, every) for part in parts]

    def ranks(self, focus: bool = False) -> DataFrame:
        files, symbols = self.table("files"), self.table("symbols")
        seeds = score.focus_seeds(files, [FOCUS_DIR]) if focus else None
        points = rank.teleport(rank.nodes(files, symbols), seeds)
        return self.table(f"ranks-{focus}", lambda: rank.pagerank_by_name(points, self.imports(), self.named(), symbols))

    def order(self) -> DataFrame:
        return score.file_order(self.table("files"), score.file_scores(self.ranks()), score.in_degree(self.imports()))

    def scored(self) -> DataFrame:
        return score.symbol_scores(self.table("symbols"), self.ranks())


def query(name: str, oracle: str | None = None):
    """Registers a query, and the SQL that gives the same rows if there is any."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tree(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = corpus.with_recipes(oracle, EXTRA, materialized=True)
        return f

    return add


# -- the oracles' own relations, written for DuckDB apart from the operators ------------------------

_TEST = """(regexp_matches(rel, '(^|/)(test|tests|testing|__tests__|spec|specs)(/|$)') OR split_part(rel, '/', -1) = 'conftest.py' OR starts_with(split_part(rel, '/', -1), 'test_')
 OR contains(split_part(rel, '/', -1), '.test.') OR contains(split_part(rel, '/', -1), '.spec.') OR regexp_matches(split_part(rel, '/', -1), '_test(\\.[^.]*)?$'))"""
_FOLDER = "CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') || '/' ELSE '' END"
_ROUNDS = 20

EXTRA = {
    "stems": "SELECT file_id, regexp_replace(rel, '\\.[^./]*$', '') AS key FROM files",
    "path_index": "SELECT key, min(file_id) AS file_id FROM (SELECT file_id, key FROM stems UNION ALL SELECT file_id, regexp_replace(key, '/[^/]*$', '') AS key FROM stems WHERE split_part(key, '/', -1) IN ('__init__', 'mod', 'index')) GROUP BY key",
    "bases": "SELECT split_part(key, '/', -1) AS key, min(file_id) AS file_id FROM stems WHERE split_part(key, '/', -1) NOT IN ('__init__', 'mod', 'index') GROUP BY 1 HAVING count(*) = 1",
    "crumbs": "SELECT file_id, raw, list_filter(string_split(regexp_replace(regexp_replace(raw, '^use ', ''), '[{;].*$', ''), '::'), lambda x: x NOT IN ('', 'crate')) AS c FROM imports WHERE lang = 'rust'",
    "parts": "SELECT file_id, raw, string_split(replace(raw, '\"', ''), '/') AS c FROM imports WHERE lang = 'go'",
    "includes": f"SELECT file_id, raw, regexp_replace(replace(raw, '\"', ''), '\\.[^./]*$', '') AS spec, {_FOLDER} AS folder FROM imports WHERE lang IN ('c', 'cpp')",
    "keys": """
SELECT file_id, raw, 0 AS priority, 'path' AS kind, replace(raw, '.', '/') AS key FROM imports WHERE lang IN ('python', 'java')
UNION ALL SELECT file_id, raw, k, 'path', regexp_replace(raw, '^"\\./(\\.\\./)*|"$', '', 'g') || CASE k WHEN 0 THEN '' ELSE '/index' END FROM imports, (VALUES (0), (1)) v(k) WHERE lang = 'typescript' AND starts_with(raw, '"./')
UNION ALL SELECT file_id, raw, len(c) - n, 'path', array_to_string(c[1:n], '/') FROM (SELECT *, unnest(range(1, len(c) + 1)) AS n FROM crumbs)
UNION ALL SELECT file_id, raw, 9999, 'base', c[1] FROM crumbs
UNION ALL SELECT file_id, raw, len(c) - n, 'path', array_to_string(c[len(c) - n + 1:], '/') FROM (SELECT *, unnest(range(1, len(c) + 1)) AS n FROM parts)
UNION ALL SELECT file_id, raw, 9999, 'base', c[-1] FROM parts
UNION ALL SELECT file_id, raw, 0, 'path', folder || spec FROM includes
UNION ALL SELECT file_id, raw, 1, 'path', spec FROM includes
UNION ALL SELECT file_id, raw, 2, 'base', split_part(spec, '/', -1) FROM includes""",
    "resolved": "SELECT k.file_id, k.raw, arg_min(i.file_id, priority) AS dst FROM keys k JOIN (SELECT 'path' AS kind, * FROM path_index UNION ALL SELECT 'base', * FROM bases) i ON i.kind = k.kind AND i.key = k.key GROUP BY k.file_id, k.raw",
    "import_edges": "SELECT DISTINCT file_id AS src, dst FROM resolved WHERE file_id <> dst",
    "ref_edges": "SELECT DISTINCT r.file_id AS src, s.file_id AS dst_file, s.sym_id AS dst_sym FROM refs r JOIN symbols s ON s.name = r.name WHERE s.file_id <> r.file_id",
    "weighted": f"SELECT file_id * 4294967296 AS node, file_id, NULL::INTEGER AS sym_id, rel, CASE WHEN {_TEST} THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM files UNION ALL SELECT file_id * 4294967296 + sym_id + 1, file_id, sym_id, rel, CASE WHEN {_TEST} THEN 0.25 ELSE 1.0 END::DOUBLE FROM symbols",
    "links": "SELECT DISTINCT src, dst FROM (SELECT src * 4294967296 AS src, dst * 4294967296 AS dst FROM import_edges UNION ALL SELECT src * 4294967296, dst_file * 4294967296 + dst_sym + 1 FROM ref_edges)",
    "outs": "SELECT src, count(*) AS n FROM links GROUP BY src",
    "points": "SELECT node, file_id, sym_id, w / sum(w) OVER () AS p FROM weighted",
    "focused": f"SELECT node, file_id, sym_id, (sym_id IS NULL AND starts_with(rel, '{FOCUS_DIR}/'))::INTEGER / sum((sym_id IS NULL AND starts_with(rel, '{FOCUS_DIR}/'))::INTEGER) OVER () AS p FROM weighted",
}
for _start, _name in (("points", "r"), ("focused", "f")):
    EXTRA[f"{_name}0"] = f"SELECT node, p, p AS score FROM {_start}"
    for _k in range(_ROUNDS):
        EXTRA[f"{_name}{_k + 1}"] = (
            f"SELECT a.node, a.p, 0.15 * a.p + 0.85 * (coalesce(g.got, 0) + d.lost * a.p) AS score FROM {_name}{_k} a "
            f"LEFT JOIN (SELECT l.dst, sum(b.score / o.n) AS got FROM links l JOIN {_name}{_k} b ON b.node = l.src JOIN outs o ON o.src = l.src GROUP BY l.dst) g ON g.dst = a.node "
            f"CROSS JOIN (SELECT coalesce(sum(c.score), 0) AS lost FROM {_name}{_k} c WHERE c.node NOT IN (SELECT src FROM outs)) d"
        )
    EXTRA[f"{_start}_ranks"] = f"SELECT p.file_id, p.sym_id, x.score FROM {_start} p JOIN {_name}{_ROUNDS} x ON x.node = p.node"
EXTRA |= {
    "ranks": "SELECT file_id, sym_id, score FROM points_ranks",
    "scores": "SELECT file_id, round(sum(CASE WHEN sym_id IS NULL THEN score ELSE greatest(score - m, 0) END), 10) AS score FROM (SELECT *, 1.0 / count(*) OVER () AS m FROM ranks) GROUP BY file_id",
    "degrees": "SELECT dst AS file_id, count(*) AS imported_by FROM import_edges GROUP BY dst",
    "ordered": "SELECT f.file_id, rel, lang, score, coalesce(imported_by, 0) AS imported_by, row_number() OVER (ORDER BY score DESC, rel) AS pos FROM files f JOIN scores s ON s.file_id = f.file_id LEFT JOIN degrees d ON d.file_id = f.file_id",
    "scored": "SELECT s.*, round(r.score, 10) AS score FROM symbols s JOIN ranks r ON r.file_id = s.file_id AND r.sym_id = s.sym_id",
    "named": "SELECT *, rel || '#' || name || CASE WHEN count(*) OVER (PARTITION BY file_id, name) > 1 THEN '@' || line ELSE '' END AS anchor FROM symbols",
    "tiers": "SELECT *, CASE WHEN kind IN ('class', 'interface', 'enum', 'type') THEN 0 WHEN kind IN ('function', 'constant') THEN 1 END AS tier FROM scored WHERE visibility = 'public'",
    "sides": "SELECT rel, bool_or(tree = 'old') AS o, bool_or(tree = 'new') AS n, max(lang) AS lang FROM tree_files GROUP BY rel",
    "shared": "SELECT rel FROM sides WHERE o AND n",
    "prints": "SELECT s.rel, CASE WHEN d.n THEN 'added' ELSE 'removed' END AS op, string_agg(kind || '|' || name || '|' || signature, chr(10) ORDER BY kind || '|' || name || '|' || signature) AS p, count(*) AS symbols FROM tree_symbols s JOIN sides d ON d.rel = s.rel AND d.o <> d.n GROUP BY s.rel, d.n",
    "moved": "SELECT a.rel AS old_rel, b.rel AS new_rel, a.symbols FROM (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY op, p) AS k FROM prints) WHERE k = 1 AND op = 'removed') a JOIN (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY op, p) AS k FROM prints) WHERE k = 1 AND op = 'added') b ON a.p = b.p",
    "d_files": """
SELECT CASE WHEN n THEN 'added' ELSE 'removed' END AS op, d.rel, NULL::VARCHAR AS new_rel, lang, count(s.name) AS symbols,
  CASE WHEN count(*) FILTER (WHERE s.visibility = 'public') = 0 THEN 'internal' WHEN n THEN 'notable' ELSE 'breaking' END AS severity
FROM sides d LEFT JOIN tree_symbols s ON s.rel = d.rel AND s.tree = CASE WHEN n THEN 'new' ELSE 'old' END
WHERE o <> n AND d.rel NOT IN (SELECT old_rel FROM moved) AND d.rel NOT IN (SELECT new_rel FROM moved) GROUP BY d.rel, n, lang
UNION ALL SELECT 'moved', old_rel, new_rel, lang, symbols, 'informational' FROM moved JOIN sides ON rel = new_rel""",
    "buckets": """
SELECT rel, kind, name, list_sort(list(signature) FILTER (WHERE tree = 'old')) AS olds, list_sort(list(signature) FILTER (WHERE tree = 'new')) AS news,
  bool_or(visibility = 'public') FILTER (WHERE tree = 'old') AS op, bool_or(visibility = 'public') FILTER (WHERE tree = 'new') AS np
FROM tree_symbols WHERE rel IN (SELECT rel FROM shared) GROUP BY rel, kind, name""",
    "singles": """
SELECT rel, 'added' AS op, kind, name, x AS sig, np AS pub FROM (SELECT *, unnest(list_filter(news, lambda y: NOT list_contains(coalesce(olds, []), y))) AS x FROM buckets WHERE NOT coalesce(len(olds) = 1 AND len(news) = 1, false))
UNION ALL
SELECT rel, 'removed', kind, name, x, op FROM (SELECT *, unnest(list_filter(olds, lambda y: NOT list_contains(coalesce(news, []), y))) AS x FROM buckets WHERE NOT coalesce(len(olds) = 1 AND len(news) = 1, false))""",
    "pairs": """
SELECT a.rel, a.name, r.kind AS was, a.kind AS now, r.sig AS was_sig, a.sig, a.pub FROM (SELECT *, count(*) OVER (PARTITION BY rel, name, op) AS k FROM singles) a
JOIN (SELECT *, count(*) OVER (PARTITION BY rel, name, op) AS k FROM singles) r ON a.rel = r.rel AND a.name = r.name AND a.op = 'added' AND r.op = 'removed' AND a.k = 1 AND r.k = 1 AND a.kind <> r.kind""",
    "d_symbols": """
SELECT rel, 'changed' AS op, kind, NULL::VARCHAR AS new_kind, name, olds[1] AS old_sig, news[1] AS new_sig, CASE WHEN np THEN 'breaking' ELSE 'internal' END AS severity FROM buckets WHERE len(olds) = 1 AND len(news) = 1 AND olds[1] <> news[1]
UNION ALL
SELECT s.rel, op, s.kind, NULL, s.name, CASE op WHEN 'removed' THEN s.sig END, CASE op WHEN 'added' THEN s.sig END, CASE WHEN NOT s.pub THEN 'internal' WHEN op = 'removed' THEN 'breaking' ELSE 'notable' END
FROM singles s LEFT JOIN pairs p ON p.rel = s.rel AND p.name = s.name WHERE p.rel IS NULL
UNION ALL SELECT rel, 'kind', was, now, name, was_sig, sig, CASE WHEN pub THEN 'notable' ELSE 'internal' END FROM pairs""",
    "d_imports": "SELECT rel, CASE WHEN bool_or(tree = 'new') THEN 'added' ELSE 'removed' END AS op, raw FROM tree_imports WHERE rel IN (SELECT rel FROM shared) GROUP BY rel, raw HAVING count(DISTINCT tree) = 1",
    "usage": "SELECT user_id AS run_id, event_id AS seq, CAST(floor(value * 100) AS BIGINT) AS tokens, event_type = 'purchase' AS is_edit FROM events",
}

# -- scans ------------------------------------------------------------------------------------------

_KNOWN = "regexp_matches(rel, '\\.(py|ts|rs|go|java|c|cpp)$') AND NOT regexp_matches(rel, '(^|/)\\.') AND NOT regexp_matches(rel, '(^|/)(" + "|".join(VENDORED) + ")/')"
_LANG = "CASE split_part(rel, '.', -1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' ELSE split_part(rel, '.', -1) END"


@query("discover_filter", f"SELECT rel, {_LANG} AS lang FROM paths WHERE {_KNOWN}")
def _(t):
    return scan.discover(t.get("paths").select("rel"))


@query("file_numbers", "SELECT rel, file_id FROM files")
def _(t):
    return scan.number(scan.discover(t.get("paths").select("rel"))).select("rel", "file_id")


@query("file_numbers_wide", "SELECT rel, file_id, length(content) * 40 AS n FROM files")
def _(t):
    """With a wide column, which sorting and counting apart would cut into other ranges."""
    rows = scan.discover(t.get("paths").select("rel", F.repeat("content", 40).alias("content")))
    return scan.number(rows).select("rel", "file_id", F.length("content").cast("bigint").alias("n"))


@query("ignore_match", f"SELECT rel, {_LANG} AS lang FROM paths WHERE {_KNOWN} AND NOT regexp_matches(rel, '(^|/)gen/') AND NOT regexp_matches(rel, '^src/brand1[^/]*/promo/') AND NOT regexp_matches(rel, '(^|/)[^/]*_7[^/]*\\.go(/|$)') AND NOT regexp_matches(rel, '^src/brand23(/|$)')")
def _(t):
    return scan.discover(t.get("paths").select("rel"), IGNORE)


@query("language_filter", f"SELECT rel, {_LANG} AS lang FROM paths WHERE {_KNOWN} AND split_part(rel, '.', -1) IN ('py', 'go')")
def _(t):
    return scan.discover(t.get("paths").select("rel"), langs=["python", "go"])


@query("ext_census", "SELECT ext, n, CASE ext WHEN 'rb' THEN 'Ruby' END AS name, pos FROM (SELECT ext, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ext) AS pos FROM paths WHERE rel NOT LIKE '.cache/%' AND rel NOT LIKE 'node_modules/%' AND rel NOT LIKE '%/.dot_%' GROUP BY ext) WHERE pos <= 5")
def _(t):
    return scan.extension_census(t.get("paths").select("rel"))


@query("lang_census", "SELECT lang, count(*) AS n FROM files GROUP BY lang")
def _(t):
    return scan.language_census(t.get("files"))


@query("line_counts", "SELECT rel, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END::BIGINT AS lines FROM files")
def _(t):
    return t.get("files").select("rel", scan.line_count(F.col("content")).alias("lines"))


@query("text_gate", "SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN -1 WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END::BIGINT AS lines FROM documents")
def _(t):
    """Every seventh text gets a byte that isn't UTF-8, so that it must not be read: -1."""
    content = F.expr("if(doc_id % 7 = 3, concat(cast(text as binary), X'FF'), cast(text as binary))")
    return scan.valid_text(t.get("documents").select("doc_id", content.alias("content"))).select("doc_id", F.coalesce(scan.line_count(F.col("content")), F.lit(-1)).cast("bigint").alias("lines"))


_CASED = "CASE WHEN sym_id % 3 = 0 THEN name WHEN sym_id % 3 = 1 THEN upper(name) ELSE concat('_', line) END"


@query("const_filter", f"SELECT file_id, sym_id, name FROM (SELECT file_id, sym_id, {_CASED} AS name FROM symbols) WHERE regexp_full_match(name, '[A-Z0-9_]*[A-Z][A-Z0-9_]*')")
def _(t):
    """Names in small letters, in capitals, and without a letter."""
    return t.get("symbols").select("file_id", "sym_id", F.expr(_CASED).alias("name")).filter(scan.constant_name(F.col("name")))


@query(
    "visibility",
    """SELECT s.file_id, s.sym_id, CASE WHEN lang = 'rust' AND NOT starts_with(signature, 'pub') THEN 'private' WHEN lang = 'go' THEN 'private'
 WHEN lang IN ('c', 'cpp') AND regexp_matches(split_part(signature, name, 1), '(^|\\W)static(\\W|$)') THEN 'private' ELSE 'public' END AS visibility
FROM (SELECT file_id, sym_id, name, signature FROM symbols) s JOIN files f ON f.file_id = s.file_id""",
)
def _(t):
    rows = t.get("symbols").select("file_id", "sym_id", "name", "signature").join(t.get("files").select("file_id", "lang"), "file_id")
    return rows.select("file_id", "sym_id", scan.visibility(F.col("lang"), F.col("name"), F.col("signature")).alias("visibility"))


@query(
    "symbol_dedup",
    """SELECT file_id, line, name, kind, pattern FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line, name ORDER BY kind <> 'method', pattern) AS k
FROM (SELECT file_id, line // 12 AS line, name, kind, sym_id AS pattern FROM symbols)) WHERE k = 1""",
)
def _(t):
    found = t.get("symbols").select("file_id", F.expr("cast(line div 12 as int)").alias("line"), "name", "kind", F.col("sym_id").alias("pattern"))
    return scan.dedup_symbols(found)


# -- links ------------------------------------------------------------------------------------------


@query("path_index", "SELECT key, file_id FROM path_index")
def _(t):
    return link.path_index(t.get("files"))


@query("basename_unique", "SELECT key, file_id FROM bases")
def _(t):
    return link.unique_basenames(t.get("files"))


@query("normalize_path", "SELECT rel, regexp_replace(rel, '^[^/]*/', '') AS up, NULL::VARCHAR AS below FROM files")
def _(t):
    first = F.substring_index("rel", "/", 1)
    up = link.normalize(F.concat(first, F.lit("/./x/..//../"), F.regexp_replace("rel", "^[^/]*/", "")))
    return t.get("files").select("rel", up.alias("up"), link.normalize(F.concat(F.lit("a/../../"), F.col("rel"))).alias("below"))


def _resolver(langs: tuple[str, ...]):
    def run(t):
        return link.resolve(t.get("imports").filter(F.col("lang").isin(*langs)), t.get("files"))

    return run


for _own in (("python",), ("typescript",), ("rust",), ("go",), ("java",), ("c", "cpp")):
    query(f"resolve_{_own[0]}", f"SELECT r.file_id, r.raw, r.dst FROM resolved r JOIN files f ON f.file_id = r.file_id AND f.lang IN ({', '.join(map(repr, _own))})")(_resolver(_own))


@query("import_edges", "SELECT src, dst FROM import_edges")
def _(t):
    return t.imports()


@query("ref_edges", "SELECT src, dst_file, dst_sym FROM ref_edges")
def _(t):
    return t.references()


# -- ranks ------------------------------------------------------------------------------------------


@query("out_degree", "SELECT src, n FROM outs")
def _(t):
    return rank.out_degrees(t.imports(), t.named()).select(F.expr("file_id * 4294967296L").alias("src"), "n")


@query("test_weight", "SELECT file_id, w FROM weighted WHERE sym_id IS NULL")
def _(t):
    return t.get("files").select("file_id", rank.weight(F.col("rel")).alias("w"))


@query("teleport", "SELECT file_id, coalesce(sym_id, -1) AS sym_id, round(p, 10) AS p FROM points")
def _(t):
    return rank.teleport(rank.nodes(t.get("files"), t.get("symbols"))).selectExpr("file_id", _SYM, "round(p, 10) as p")


@query("pagerank_20", "SELECT file_id, coalesce(sym_id, -1) AS sym_id, round(score, 10) AS score FROM ranks")
def _(t):
    return t.ranks().selectExpr("file_id", _SYM, "round(score, 10) as score")


@query("pagerank_focus", "SELECT file_id, coalesce(sym_id, -1) AS sym_id, round(score, 10) AS score FROM focused_ranks")
def _(t):
    return t.ranks(focus=True).selectExpr("file_id", _SYM, "round(score, 10) as score")


# -- scores -----------------------------------------------------------------------------------------


@query("file_scores", "SELECT file_id, score FROM scores")
def _(t):
    return score.file_scores(t.ranks())


@query("file_order", "SELECT file_id, rel, lang, score, imported_by, pos FROM ordered")
def _(t):
    return t.order()


@query("in_degree", "SELECT file_id, imported_by FROM degrees")
def _(t):
    return score.in_degree(t.imports())


@query("resolved_imports", "SELECT src AS file_id, string_agg(rel, ',' ORDER BY rel) AS imports FROM import_edges e JOIN files f ON f.file_id = e.dst GROUP BY src")
def _(t):
    return score.resolved_imports(t.imports(), t.get("files")).withColumn("imports", F.array_join("imports", ","))


@query("used_by_top8", "SELECT file_id, string_agg(rel, ',' ORDER BY rel) AS used_by FROM (SELECT e.dst AS file_id, f.rel, row_number() OVER (PARTITION BY e.dst ORDER BY f.rel) AS k FROM import_edges e JOIN files f ON f.file_id = e.src) WHERE k <= 8 GROUP BY file_id")
def _(t):
    return score.used_by(t.imports(), t.get("files")).withColumn("used_by", F.array_join("used_by", ","))


@query("topk_symbols", "SELECT file_id, sym_id, name, omitted FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, sym_id) AS k, greatest(count(*) OVER (PARTITION BY file_id) - 2, 0) AS omitted FROM scored WHERE visibility = 'public') WHERE k <= 2")
def _(t):
    return score.top_symbols(t.scored(), 2).select("file_id", "sym_id", "name", "omitted")


@query("anchors", "SELECT file_id, sym_id, anchor FROM named")
def _(t):
    return score.anchors(t.get("symbols")).select("file_id", "sym_id", "anchor")


@query(
    "index_tiers",
    """SELECT file_id, sym_id, name, kind, ord FROM (SELECT t.file_id, t.sym_id, t.name, t.kind, row_number() OVER (ORDER BY tier, o.pos, sym_id) AS ord
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, tier ORDER BY score DESC, sym_id) AS k FROM tiers WHERE tier IS NOT NULL) t JOIN ordered o ON o.file_id = t.file_id WHERE k <= CASE tier WHEN 0 THEN 8 ELSE 2 END)""",
)
def _(t):
    return score.index_tiers(t.scored(), t.order()).select("file_id", "sym_id", "name", "kind", "ord")


@query(
    "symbol_index",
    """SELECT row_number() OVER (ORDER BY tier, rs DESC, rel, sym_id) AS ord, name, kind, rel, line, anchor FROM (
SELECT n.*, round(r.score, 10) AS rs, CASE WHEN kind IN ('class', 'interface', 'enum', 'type') THEN 0 WHEN kind IN ('function', 'constant') THEN 1 END AS tier FROM named n JOIN ranks r ON r.file_id = n.file_id AND r.sym_id IS NULL) WHERE tier IS NOT NULL""",
)
def _(t):
    return score.symbol_index(t.get("symbols"), t.ranks(), t.get("files"))


@query(
    "explain",
    f"""SELECT f.rel, round(r.score, 10) AS score, coalesce(d.imported_by, 0) AS imported_by, coalesce(i.n, 0) AS imports, starts_with(f.rel, '{FOCUS_DIR}/') AS focus, row_number() OVER (ORDER BY round(r.score, 10) DESC, f.rel) AS pos
FROM files f JOIN focused_ranks r ON r.file_id = f.file_id AND r.sym_id IS NULL LEFT JOIN degrees d ON d.file_id = f.file_id LEFT JOIN (SELECT src, count(*) AS n FROM import_edges GROUP BY src) i ON i.src = f.file_id""",
)
def _(t):
    return score.explain(t.get("files"), t.ranks(focus=True), t.imports(), score.focus_seeds(t.get("files"), [FOCUS_DIR]))


@query("focus_seeds", "SELECT file_id FROM files WHERE starts_with(rel, 'src/brand2/') OR starts_with(rel, 'tests/')")
def _(t):
    return score.focus_seeds(t.get("files"), ["./src/brand2/", "tests", "no/such"])


@query(
    "footer_groups",
    """SELECT dir, n FROM (
SELECT k, CASE WHEN contains(rel, '/') THEN array_to_string(string_split(rel, '/')[1:least(k, len(string_split(rel, '/')) - 1)], '/') ELSE '.' END AS dir, count(*) AS n FROM files, (SELECT unnest(range(1, 7)) AS k) GROUP BY 1, 2)
WHERE k = (SELECT max(k) FROM (SELECT k, bool_and(c <= 16 OR k = 1) OVER (ORDER BY k) AS ok FROM (
  SELECT k, count(DISTINCT CASE WHEN contains(rel, '/') THEN array_to_string(string_split(rel, '/')[1:least(k, len(string_split(rel, '/')) - 1)], '/') ELSE '.' END) AS c FROM files, (SELECT unnest(range(1, 7)) AS k) GROUP BY k)) WHERE ok)""",
)
def _(t):
    return score.footer_groups(t.get("files").select("rel"))


@query("prefix_fit", "SELECT ord, cost, total FROM (SELECT pos AS ord, length(rel) AS cost, CAST(sum(length(rel)) OVER (ORDER BY pos) AS BIGINT) AS total FROM ordered) WHERE total <= 5000")
def _(t):
    return score.prefix_fit(t.order().select(F.col("pos").alias("ord"), F.length("rel").alias("cost")), 5000)


# -- lookups ----------------------------------------------------------------------------------------


@query("find_symbol", "SELECT rel, name, kind, signature, line, visibility, anchor FROM named WHERE name = 'sym_7'")
def _(t):
    return lookup.find_symbol(t.get("symbols"), "sym_7")


@query("expand_symbol", """SELECT n.rel, n.name, n.kind, n.signature, n.line, n.visibility,
 coalesce((SELECT string_agg(f.rel, ',' ORDER BY f.rel) FROM import_edges e JOIN files f ON f.file_id = e.dst WHERE e.src = n.file_id), '') AS imports,
 coalesce((SELECT string_agg(f.rel, ',' ORDER BY f.rel) FROM import_edges e JOIN files f ON f.file_id = e.src WHERE e.dst = n.file_id), '') AS used_by
FROM named n WHERE n.sym_id = 0 AND n.file_id = (SELECT min(file_id) FROM symbols WHERE rel LIKE '%part_10.%' OR rel LIKE '%part_11.%')""")
def _(t):
    first = t.get("symbols").filter("rel like '%part_10.%' or rel like '%part_11.%'").orderBy("file_id", "sym_id").select("rel", "name").first()
    files, symbols = t.get("files"), t.get("symbols")
    rel, name = (first.rel, first.name) if first else ("", "")
    out = lookup.expand_symbol(symbols, t.imports(), files, rel, name)
    return out.withColumns({c: F.array_join(c, ",") for c in ("imports", "used_by")})


@query("parse_anchor", "SELECT anchor, rel AS path, name, CASE WHEN contains(anchor, '@') THEN line ELSE 0 END AS line FROM named")
def _(t):
    return lookup.parse_anchors(score.anchors(t.get("symbols")).select("anchor")).fillna(0, ["line"])


# -- diff -------------------------------------------------------------------------------------------


def _diff(t, imports: bool = True) -> diff.Diff:
    """Without ``imports``, a query that asks for none doesn't write them out."""
    return diff.diff(t.table("tree_files"), t.table("tree_symbols"), t.table("tree_imports") if imports else t.get("tree_imports"))


@query("diff_files", "SELECT op, rel, new_rel, lang, symbols, severity FROM d_files")
def _(t):
    return _diff(t).files


@query("diff_summaries", "SELECT f.tree, f.rel, f.lang, count(s.name) AS symbols, count(*) FILTER (WHERE s.visibility = 'public') AS public FROM tree_files f LEFT JOIN tree_symbols s ON s.tree = f.tree AND s.rel = f.rel GROUP BY f.tree, f.rel, f.lang")
def _(t):
    return diff.file_summaries(t.get("tree_files"), t.get("tree_symbols"))


@query("diff_symbols", "SELECT rel, op, kind, new_kind, name, old_sig, new_sig, severity FROM d_symbols")
def _(t):
    return _diff(t).symbols


@query("diff_kind_changes", "SELECT rel, was AS kind, now AS new_kind, name FROM pairs")
def _(t):
    return _diff(t, imports=False).symbols.filter("op = 'kind'").select("rel", "kind", "new_kind", "name")


@query("diff_imports", "SELECT rel, op, raw FROM d_imports")
def _(t):
    return _diff(t).imports


@query("diff_changed_files", "SELECT rel FROM d_symbols UNION SELECT rel FROM d_imports")
def _(t):
    return _diff(t).changed_files()


@query("diff_moves", "SELECT old_rel, new_rel, symbols FROM moved")
def _(t):
    return diff.moves(t.get("tree_files"), t.get("tree_symbols"))


@query("diff_severity", "SELECT severity, count(*) AS n FROM (SELECT severity FROM d_files UNION ALL SELECT severity FROM d_symbols UNION ALL SELECT 'informational' FROM d_imports) GROUP BY severity")
def _(t):
    return _diff(t).severities()


@query("breaking_gate", "SELECT count(*) > 0 AS breaking FROM (SELECT severity FROM d_files UNION ALL SELECT severity FROM d_symbols) WHERE severity = 'breaking'")
def _(t):
    return t.spark.createDataFrame([(_diff(t).breaking(),)], "breaking boolean")


@query("diff_with_itself", "SELECT rel, op FROM d_imports WHERE false")
def _(t):
    old = [t.get(n).filter("tree = 'old'") for n in ("tree_files", "tree_symbols", "tree_imports")]
    own = diff.diff(*(d.unionByName(d.withColumn("tree", F.lit("new"))) for d in old))
    return own.files.select("rel", "op").unionByName(own.symbols.select("rel", "op")).unionByName(own.imports.select("rel", "op"))


# -- scalar functions -------------------------------------------------------------------------------


@query("tidy_sig", "SELECT file_id, sym_id, rtrim(rtrim(rtrim(signature), '{:;')) AS sig FROM symbols")
def _(t):
    return t.get("symbols").select("file_id", "sym_id", text.tidy_column(F.col("signature")).alias("sig"))


#: Whole pages, and the odd characters after them.
_ODD = "concat(html, chr(9), chr(10), chr(13), chr(1), chr(92), chr(34))"


@query("json_escape", f"SELECT page_id, replace(replace(replace(replace(replace(replace({_ODD}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'), chr(1), chr(92) || 'u0001') AS s FROM pages")
def _(t):
    return t.get("pages").select("page_id", text.json_escape_column(F.expr(_ODD)).alias("s"))


@query("xml_escape", f"""SELECT page_id, replace(replace(replace(e, '"', '&quot;'), chr(9), '&#9;'), chr(10), '&#10;').replace(chr(13), '&#13;') AS attribute, e AS content
FROM (SELECT page_id, replace(replace(replace(replace({_ODD}, chr(1), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM pages)""")
def _(t):
    odd = F.expr(_ODD)
    return t.get("pages").select("page_id", text.xml_escape_column(odd, True).alias("attribute"), text.xml_escape_column(odd, False).alias("content"))


@query("word_counts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM documents")
def _(t):
    return t.get("documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


# -- metrics ----------------------------------------------------------------------------------------


def _questions(t) -> DataFrame:
    return t.get("conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), F.expr("if(conv_id % 2 = 0, 'any', 'all')").alias("match"), F.expr("array(substr(text, 1, 4), substr(text, 5, 5))").alias("expect"))


@query("explore_tokens", """SELECT run_id, CAST(sum(tokens) FILTER (WHERE seq <= coalesce(first_edit, 9223372036854775807)) AS BIGINT) AS before_edit, CAST(sum(tokens) AS BIGINT) AS total, min(first_edit) IS NULL AS capped
FROM (SELECT *, min(seq) FILTER (WHERE is_edit) OVER (PARTITION BY run_id) AS first_edit FROM usage) GROUP BY run_id HAVING sum(tokens) > 0""")
def _(t):
    return metrics.exploration_tokens(_usage(t))


def _usage(t) -> DataFrame:
    return t.get("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr("cast(floor(value * 100) as bigint)").alias("tokens"), (F.col("event_type") == "purchase").alias("is_edit"))


@query("lower_median", "SELECT run_id, count(*) AS n, list_sort(list(tokens))[(count(*) + 1) // 2] AS median, min(tokens) AS low, max(tokens) AS high FROM usage WHERE NOT is_edit GROUP BY run_id")
def _(t):
    return metrics.lower_medians(_usage(t), "run_id", "tokens", ~F.col("is_edit"))


@query("spread", "SELECT run_id, CAST(floor((max(tokens) - min(tokens)) * 100 / list_sort(list(tokens))[(count(*) + 1) // 2]) AS BIGINT) AS spread FROM usage WHERE NOT is_edit AND tokens > 0 GROUP BY run_id")
def _(t):
    rows = metrics.lower_medians(_usage(t), "run_id", "tokens", (~F.col("is_edit")) & (F.col("tokens") > 0))
    return rows.select("run_id", metrics.spread(F.col("low"), F.col("high"), F.col("median")).alias("spread"))


@query("arm_accuracy", "SELECT event_type AS arm, round(avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END), 3) AS accuracy FROM events GROUP BY event_type")
def _(t):
    return t.get("events").groupBy(F.col("event_type").alias("arm")).agg(metrics.accuracy(F.col("value") > 5).alias("accuracy"))


# -- without SQL ------------------------------------------------------------------------------------


@query("strip_params", "SELECT file_id, sym_id, replace(rtrim(rtrim(rtrim(signature), '{:;')), '(a: int, b: str)', '(int, str)') AS sig FROM symbols")
def _(t):
    return t.get("symbols").select("file_id", "sym_id", text.strip_params_column(text.tidy_column(F.col("signature"))).alias("sig"))


@query("ladder_pack")
def _(t):
    packed = budget.pack_tables(t.get("files"), t.get("symbols"), t.order(), t.scored(), t.imports(), budget.Options(budget=4096, repo="derived"))
    return t.spark.createDataFrame([(f.rel, f.rank, f.one_line, f.omitted, len(f.symbols)) for f in packed.files] or [], "rel string, pos int, one_line boolean, omitted int, symbols int")


@query("answer_coverage")
def _(t):
    """Over all rendered maps of the tree, one a preset of the budget."""
    order, scored = t.table("order", t.order), t.table("scored", t.scored)
    pack = lambda n: budget.pack_tables(t.table("files"), t.table("symbols"), order, scored, t.imports(), budget.Options(budget=n, repo="derived"))
    maps = [(name, markdown.render(pack(n))) for name, n in PRESETS.items()]
    return metrics.answer_coverage(_questions(t), t.spark.createDataFrame(maps, "map_id string, text string"))


def _forms() -> list[tuple[str, ...]]:
    """(lang, kind, kind found, line before, line, line after, visibility, kind of the line before, its visibility); ``$`` is the name, ``^`` the name in capitals.

    A kind that a language lacks is written as the nearest one it has.
    """
    out = []
    for lang, holder, end, private, own in (
        ("python", "class Holder:", "", False, {"function": "def $(a): pass", "method": "    def $(a): pass", "class": "class $: pass", "constant": "^ = 1", "field": "    $: int = 0"}),
        ("typescript", "class Holder {", "}", False, {"function": "function $(a) {}", "method": "    $(a) {}", "class": "class $ {}", "interface": "interface $ {}", "enum": "enum $ {}", "type": "type $ = string;", "constant": "export const ^ = 1;", "field": "    $: number;"}),
        ("rust", "struct Holder {", "}", True, {"function": "fn $(a: u32) {}", "method": "    fn $(a: u32) {}", "class": "struct $ {}", "interface": "trait $ {}", "enum": "enum $ {}", "type": "type $ = u32;", "constant": "const ^: u32 = 1;", "field": "    $: u32,", "module": "mod $ {}"}),
        ("go", "type Holder struct {", "}", True, {"function": "func $(a int) {}", "method": "func (h Holder) $(a int) {}", "class": "type $ struct {}", "interface": "type $ interface {}", "constant": "const ^ = 1", "field": "    $ int"}),
        ("java", "class Holder {", "}", False, {"method": "    int $(int a) { return a; }", "class": "class $ {}", "interface": "interface $ {}", "enum": "enum $ {}", "field": "    int $ = 0;"}),
        ("c", "struct Holder {", "};", False, {"function": "int $(int a) {}", "class": "struct $ {};", "enum": "enum $ { ^ };", "type": "typedef int $;", "field": "    int $;"}),
        ("cpp", "struct Holder {", "};", False, {"function": "int $(int a) {}", "method": "    int $(int a) {}", "class": "class $ {};", "enum": "enum $ { ^ };", "type": "using $ = int;", "field": "    int $ = 0;", "module": "namespace $ {}"}),
    ):
        near = {"function": "method", "method": "function", "constant": "field"}
        for kind in KINDS:
            found = kind if kind in own else near.get(kind, "class")
            line, before, after, held = own[found], "", "", ""
            if line.startswith(" "):
                before, after, held = holder, end, "class"
            if lang == "rust" and found == "method":
                before, held = "impl Holder {", ""
            # in Go capitals are public
            out.append((lang, kind, found, before, line, after, "private" if private and (lang, found) != ("go", "constant") else "public", held, "private" if lang == "rust" else "public"))
    return out


_FORM = ("lang", "kind", "found", "opens", "form", "closes", "seen", "held", "held_seen")
_LINE = "replace(replace(form, '$', name), '^', upper(name))"
_FORMED = f"SELECT s.*, {', '.join('m.' + c for c in _FORM if c not in ('kind', 'lang'))} FROM (SELECT file_id, name, kind, line FROM symbols) s JOIN files f ON f.file_id = s.file_id JOIN (VALUES {', '.join(map(repr, _forms()))}) m({', '.join(_FORM)}) ON m.lang = f.lang AND m.kind = s.kind"


@query(
    "extract_symbols",
    f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line, name) - 1 AS INTEGER) AS sym_id, name, kind, line, signature, visibility
FROM (SELECT file_id, CASE WHEN starts_with(replace(form, 'export ', ''), '^') OR contains(form, 'const ^') THEN upper(name) ELSE name END AS name, found AS kind, line, trim({_LINE}) AS signature, seen AS visibility FROM ({_FORMED})
UNION ALL SELECT file_id, 'Holder', held, line - 1, opens, held_seen FROM ({_FORMED}) WHERE held <> '')""",
)
def _(t):
    """All languages, each symbol in the form of its kind."""
    forms = F.broadcast(t.spark.createDataFrame(_forms(), ", ".join(f"{c} string" for c in _FORM)))
    rows = t.get("symbols").select("file_id", "rel", "name", "kind", "line").join(t.get("files").select("file_id", "lang"), "file_id").join(forms, ["lang", "kind"])
    rows = rows.withColumn("t", F.expr(f"concat_ws('\\n', opens, {_LINE}, closes)"))
    source = F.concat(F.lit("\n"), F.expr("array_join(transform(array_sort(collect_list(struct(line, t))), x -> x.t), '\\n\\n')"))
    files = rows.groupBy("file_id", "rel", "lang").agg(source.alias("content"))
    return tables.symbols(tables.parse(files)).select("file_id", "sym_id", "name", "kind", "line", "signature", "visibility")
