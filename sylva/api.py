"""What a program calls: maps, lookups, the index, explanations and diffs of source trees."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import budget as packing
from .extract import tables
from .langs import TOKEN_DEFAULT
from .operators import diff as diffs
from .operators import link, lookup, rank, score
from .render import markdown, structured
from .sources import tree
from .sources.cache import Cache
from .store import materialize


@dataclass
class MapOptions:
    budget: int = TOKEN_DEFAULT
    no_private: bool = False
    langs: list[str] | None = None
    focus: list[str] = field(default_factory=list)
    cache: bool = False
    counter: Callable[[str], int] = packing.words


class Parsed:
    """A tree read and scanned once; links and ranks are worked out when asked for."""

    def __init__(self, spark: SparkSession, root: str, opts: MapOptions) -> None:
        self.spark, self.root, self.opts = spark, root, opts
        files = tree.discover(spark, root, None)  # stands on a written table
        if files.isEmpty():
            raise tree.NoSupportedFiles(tree.empty_hint(spark, root))
        if opts.langs:
            files = files.filter(F.col("lang").isin(list(opts.langs)))
            if files.isEmpty():
                raise tree.NoMatchingLanguage(f"no files of {', '.join(opts.langs)}")
            files = files.drop("file_id").transform(tree.scan.number)
        cache = Cache(spark, root, opts.cache)
        self.parsed = materialize(cache.parse(files), "parsed")
        cache.save(self.parsed)
        self.skipped = files.filter("content is null").count()
        # numbers without gaps, in path order, over the files that could be read
        self.files = self.parsed.select("tree", "file_id", "rel", "lang", "lines")
        self.symbols, self.imports, self.refs = tables.symbols(self.parsed), tables.imports(self.parsed), tables.references(self.parsed)

    def edges(self) -> DataFrame:
        if not hasattr(self, "_edges"):
            self._edges = materialize(link.import_edges(link.resolve(self.imports, self.files)), "import-edges")
        return self._edges

    def ranks(self) -> DataFrame:
        if not hasattr(self, "_ranks"):
            seeds = score.focus_seeds(self.files, self.opts.focus, lenient=True) if self.opts.focus else None
            points = rank.teleport(rank.nodes(self.files, self.symbols), seeds)
            self._ranks = materialize(rank.pagerank(points, rank.edges(self.edges(), link.reference_edges(self.refs, self.symbols))), "ranks")
        return self._ranks

    def order(self) -> DataFrame:
        return score.file_order(self.files, score.file_scores(self.ranks()), score.in_degree(self.edges()))

    def name(self) -> str:
        return os.path.basename(os.path.abspath(self.root)) or "."


def build_map(spark: SparkSession, root: str, opts: MapOptions | None = None) -> packing.Map:
    opts = opts or MapOptions()
    p = Parsed(spark, root, opts)
    own = packing.Options(opts.budget, opts.no_private, p.name(), opts.counter)
    scored = score.symbol_scores(p.symbols, p.ranks())
    return packing.pack_tables(p.files, p.symbols, materialize(p.order(), "order"), materialize(scored, "scored"), p.edges(), own, p.skipped)


def render_map(m: packing.Map, form: str = "md") -> str:
    return {"md": markdown.render, "json": structured.map_json, "xml": structured.map_xml}[form](m)


def find_symbol(spark: SparkSession, root: str, name: str, opts: MapOptions | None = None) -> list:
    opts = opts or MapOptions()
    return lookup.find_symbol(Parsed(spark, root, opts).symbols, name, no_private=opts.no_private).collect()


def build_symbol_index(spark: SparkSession, root: str, opts: MapOptions | None = None) -> dict:
    """Types of all files, then functions and constants, as many as the budget holds; the focus plays no part."""
    opts = opts or MapOptions()
    p = Parsed(spark, root, MapOptions(**{**opts.__dict__, "focus": []}))
    total, loc = p.files.agg(F.count("*"), F.coalesce(F.sum("lines"), F.lit(0))).first()
    rows = score.symbol_index(p.symbols, p.ranks(), p.files, opts.no_private).orderBy("ord").limit(opts.budget).collect()
    entries = [(r.kind, r.anchor) for r in rows]
    header = lambda n: markdown.index_header(p.name(), int(loc), total, opts.budget, n)
    n, cost = packing.fit_index(entries, header, packing.Options(opts.budget, counter=opts.counter))
    return {"entries": [r.asDict() for r in rows[:n]], "rendered": cost, "loc": int(loc), "files": total, "text": markdown.render_index(entries[:n], header(cost), p.skipped)}


def expand_symbol(spark: SparkSession, root: str, rel: str, name: str, line: int | None = None, opts: MapOptions | None = None):
    """None if there is no such symbol any more."""
    opts = opts or MapOptions()
    p = Parsed(spark, root, opts)
    symbols = p.symbols.filter("visibility = 'public'") if opts.no_private else p.symbols
    return lookup.expand_symbol(symbols, p.edges(), p.files, rel, name, line).first()


def explain(spark: SparkSession, root: str, rel: str, opts: MapOptions | None = None):
    p = Parsed(spark, root, opts or MapOptions())
    seeds = score.focus_seeds(p.files, p.opts.focus, lenient=True) if p.opts.focus else None
    return score.explain(p.files, p.ranks(), p.edges(), seeds).filter(F.col("rel") == rel).first()


@dataclass
class DiffResult:
    moved: list
    added: list
    removed: list
    changed: list[tuple[str, dict]]
    severities: dict[str, int]
    skips: dict[str, tuple[int, int]]

    @property
    def empty(self) -> bool:
        return not (self.moved or self.added or self.removed or self.changed)

    @property
    def breaking(self) -> bool:
        return self.severities["breaking"] > 0

    def render(self, form: str, old: str, new: str) -> str:
        return {"md": markdown.render_diff, "json": structured.diff_json, "xml": structured.diff_xml}[form](self, old, new, self.skips)


def diff(spark: SparkSession, old: str, new: str, no_private: bool = False, langs: list[str] | None = None) -> DiffResult:
    """Of two directories; what is returned is as long as the report of it."""
    sides, skips = [], {}
    for name, root in (("old", old), ("new", new)):
        files = tree.discover(spark, root, langs, name)
        sides.append(tables.parse(files))
        skips[name] = (files.filter("content is null").count(), 0)
    parsed = materialize(sides[0].unionByName(sides[1]), "both")
    rows = parsed.select("tree", "rel", F.explode("symbols").alias("s")).select("tree", "rel", "s.*")
    d = diffs.diff(parsed.select("tree", "rel", "lang"), rows, parsed.select("tree", "rel", F.explode("imports").alias("raw")), no_private)
    files = d.files.orderBy("rel").collect()
    changed: dict[str, dict] = {}
    blank = lambda: {"changed": [], "kind": [], "added": [], "removed": [], "added_imports": [], "removed_imports": []}
    for r in d.symbols.orderBy("rel", "kind", "name", "old_sig", "new_sig").collect():
        changed.setdefault(r.rel, blank())[r.op].append(r)
    for r in d.imports.orderBy("rel", "raw").collect():
        changed.setdefault(r.rel, blank())[f"{r.op}_imports"].append(r.raw)
    counts = dict.fromkeys(("breaking", "notable", "informational", "internal"), 0)
    for s in [*(f.severity for f in files), *(x.severity for c in changed.values() for k in ("changed", "kind", "added", "removed") for x in c[k]), *("informational" for c in changed.values() for k in ("added_imports", "removed_imports") for _ in c[k])]:
        counts[s] += 1
    pick = lambda op: [SimpleNamespace(**f.asDict()) for f in files if f.op == op]
    return DiffResult(sorted(pick("moved"), key=lambda f: f.new_rel), pick("added"), pick("removed"), sorted(changed.items()), counts, skips)
