"""Packing: as much of the ranked structure as a token budget holds.

Costs and candidates are cut down by Spark; the fold itself runs on the driver,
over at most as many files and index entries as the budget has tokens, since each takes one
token at least. The footer is kept as counts by directory and depth.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import strip_params, tidy
from .langs import DETAILS, TOKEN_DEFAULT
from .operators import score
from .render import markdown

RESERVE = 0.40
#: Directories at the root that a footer can be made of; beyond, packing is an error.
ROOT_DIRS = 1 << 20


@dataclass(frozen=True)
class Symbol:
    kind: str
    name: str
    signature: str
    line: int
    visibility: str


@dataclass(frozen=True)
class File:
    rel: str
    lang: str
    rank: int
    score: float
    imported_by: int
    imports: tuple[str, ...]
    used_by: tuple[str, ...]
    symbols: tuple[Symbol, ...]
    one_line: bool = False
    omitted: int = 0


@dataclass(frozen=True)
class Indexed:
    name: str
    kind: str
    rel: str
    anchor: str
    line: int


@dataclass(frozen=True)
class Map:
    repo: str
    target: int
    loc: int
    total_files: int
    detail: str = "full"
    rendered: int = 0
    no_private: bool = False
    files: tuple[File, ...] = ()
    collapsed: tuple[tuple[str, int], ...] = ()
    index: tuple[Indexed, ...] = ()
    skipped: int = 0
    unwired: int = 0


def words(text: str) -> int:
    """The default token count."""
    return len(re.findall(r"\S+", text))


def vocabulary_counter(path: str) -> Callable[[str], int]:
    """Exact counts by a public byte-pair vocabulary file (token and rank a line, base64), if it is at ``path``."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
    pattern = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
    coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


@dataclass(frozen=True)
class Options:
    budget: int = TOKEN_DEFAULT
    no_private: bool = False
    repo: str = "."
    counter: Callable[[str], int] = field(default=words)


class Footer:
    """Directories of the files not shown: counts by depth, from which shown files are taken."""

    def __init__(self, levels: dict[int, Counter], deepest: int) -> None:
        self.levels, self.deepest = levels, deepest

    @staticmethod
    def directory(rel: str, depth: int) -> str:
        parts = rel.split("/")[:-1]
        return "/".join(parts[:depth]) if parts else "."

    def without(self, shown: list[str]) -> tuple[tuple[str, int], ...]:
        best: tuple[tuple[str, int], ...] = ()
        for depth in range(1, self.deepest + 1):
            if depth not in self.levels:
                break
            left = Counter(self.levels[depth])
            left.subtract(self.directory(rel, depth) for rel in shown)
            groups = tuple(sorted((d, n) for d, n in left.items() if n > 0))
            if depth > 1 and len(groups) > score.FOOTER_GROUPS:
                break
            best = groups
        return best


def _footer(files: DataFrame, most: int) -> Footer:
    """Counts of depths that can come down to few enough groups when ``most`` files are shown."""
    dirs = files.select(F.expr("slice(split(rel, '/', -1), 1, size(split(rel, '/', -1)) - 1)").alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    deepest = dirs.agg(F.max(F.size("d"))).first()[0] or 1
    levels: dict[int, Counter] = {}
    for depth in range(1, deepest + 1):
        name = F.expr(f"if(size(d) = 0, '.', array_join(slice(d, 1, {depth}), '/'))")
        rows = dirs.groupBy(name.alias("dir")).agg(F.sum("n").alias("n")).limit(score.FOOTER_GROUPS + most + 2 if depth > 1 else ROOT_DIRS + 1).collect()
        if len(rows) > ROOT_DIRS:
            raise ValueError(f"more than {ROOT_DIRS} directories at the root")
        if depth > 1 and len(rows) > score.FOOTER_GROUPS + most + 1:
            break
        levels[depth] = Counter({r.dir: r.n for r in rows})
    return Footer(levels, deepest)


def pack_tables(files: DataFrame, symbols: DataFrame, order: DataFrame, scored: DataFrame, edges: DataFrame, opts: Options, skipped: int = 0) -> Map:
    """The map of ``files(file_id, rel, lang, content or lines)`` with what ``operators.score`` derives from them."""
    from .operators.scan import line_count

    lines = F.col("lines") if "lines" in files.columns else line_count(F.col("content"))
    total, loc = files.agg(F.count("*"), F.coalesce(F.sum(lines), F.lit(0))).first()
    base = Map(opts.repo, opts.budget, int(loc), total, no_private=opts.no_private, skipped=skipped)
    most = opts.budget + 1
    counts = symbols.groupBy("file_id").agg(F.count("*").alias("all"), F.count_if(F.col("visibility") == "public").alias("public"))
    importing = edges.select(F.col("src").alias("file_id")).distinct().withColumn("imports_any", F.lit(True))
    rows = order.join(counts, "file_id", "left").join(importing, "file_id", "left")
    first = lambda c: rows.filter((F.coalesce(c, F.lit(0)) > 0) | F.col("imports_any")).orderBy("pos").limit(most)
    chosen = first("all").unionByName(first("public")).dropDuplicates(["file_id"])
    ids = chosen.select("file_id")
    imports = {r.file_id: tuple(r.imports) for r in score.resolved_imports(edges.join(ids.withColumnRenamed("file_id", "src"), "src", "left_semi"), files).collect()}
    users = {r.file_id: tuple(r.used_by) for r in score.used_by(edges.join(ids.withColumnRenamed("file_id", "dst"), "dst", "left_semi"), files).collect()}
    own: dict[int, list] = {}
    for r in scored.join(ids, "file_id", "left_semi").select("file_id", "sym_id", "kind", "name", "signature", "line", "visibility", "score").collect():
        own.setdefault(r.file_id, []).append(r)
    ranked = sorted(chosen.collect(), key=lambda r: r.pos)
    footer = _footer(files, most)

    def build(r, detail: str, top: int | None = None) -> File:
        seen = sorted((s for s in own.get(r.file_id, ()) if detail == DETAILS[0] or s.visibility == "public"), key=lambda s: s.sym_id)
        omitted = 0
        if top is not None and len(seen) > top:
            omitted = len(seen) - top
            seen = sorted(sorted(seen, key=lambda s: (-s.score, s.sym_id))[:top], key=lambda s: s.sym_id)
        sig = lambda s: tidy(strip_params(s.signature) if detail == DETAILS[2] else s.signature)
        return File(r.rel, r.lang, r.pos, r.score, r.imported_by, imports.get(r.file_id, ()), users.get(r.file_id, ()), tuple(Symbol(s.kind, s.name, sig(s), s.line, s.visibility) for s in seen), omitted=omitted)

    def measure(m: Map) -> int:
        return opts.counter(markdown.render(m))

    def complete(m: Map) -> Map:
        return replace(m, rendered=measure(m))

    for detail in DETAILS[1:] if opts.no_private else DETAILS:
        shown = [f for f in (build(r, detail) for r in ranked) if f.symbols or f.imports]
        if len(shown) <= opts.budget:
            m = complete(replace(base, detail=detail, files=tuple(shown), collapsed=footer.without([f.rel for f in shown])))
            if m.rendered <= opts.budget:
                return m

    detail, ceiling, placed = DETAILS[2], opts.budget - int(opts.budget * RESERVE), []
    base = replace(base, detail=detail)
    for r in ranked:
        whole = build(r, detail)
        if not whole.symbols and not whole.imports:
            continue
        part = build(r, detail, score.TOP_SYMBOLS)
        for form in (whole, *([part] if part.omitted else []), replace(whole, one_line=True)):
            trial = [*placed, form]
            if measure(replace(base, files=tuple(trial), collapsed=footer.without([f.rel for f in trial]))) <= ceiling:
                placed = trial
                break
        else:
            break
    base = replace(base, files=tuple(placed), collapsed=footer.without([f.rel for f in placed]))
    at = {r.rel: r.file_id for r in ranked}
    names = [(at[f.rel], s.name) for f in placed if not f.one_line for s in f.symbols]
    shown_names = files.sparkSession.createDataFrame(names, "file_id long, name string") if names else None
    tiers = score.index_tiers(score.anchors(scored.drop("anchor")), order, shown_names).orderBy("ord").limit(opts.budget)
    entries = [Indexed(r.name, r.kind, r.rel, r.anchor, r.line) for r in tiers.collect()]
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if measure(replace(base, index=tuple(entries[:mid]))) <= opts.budget else (lo, mid - 1)
    return complete(replace(base, index=tuple(entries[:lo])))


def fit_index(entries: list[tuple[str, str]], header: Callable[[int], str], opts: Options) -> tuple[int, int]:
    """Longest prefix of ``(kind, anchor)`` lines that fits under a header, and its cost."""
    cost = lambda n: opts.counter(header(0) + "".join(f"{k} {a}\n" for k, a in entries[:n]))
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if cost(mid) <= opts.budget else (lo, mid - 1)
    return lo, cost(lo)
