"""Maps, index and diff as Markdown. The words and signs of the layout are fixed values."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from ..budget import File, Map

# Notes on the level of detail, by whether private symbols were left out on request.
NOTES = {
    ("full", False): "", ("full", True): "",
    ("public-only", True): " | public API only (--no-private)",
    ("public-only", False): " | private symbols omitted to fit budget — raise --budget for full detail",
    ("public-only-params-elided", True): " | public API only, parameter names omitted to fit budget — raise --budget",
    ("public-only-params-elided", False): " | private symbols + parameter names omitted to fit budget — raise --budget",
}
INDEX_NOTE = "symbol index (PARTIAL — more symbols by file, not exhaustive; if the symbol you need isn't listed here, grep the source instead of guessing. Anchor = `path#name`; expand it for the full signature):"
PREAMBLE = "> agent note: use this map as a navigation index before opening files.\n> It contains signatures, types, imports, and reverse dependencies only; inspect source before editing implementation.\n\n"


def file_block(f: File) -> str:
    if f.one_line:
        return f"\n## {f.rel} (#{f.rank}, {len(f.symbols)} symbol(s) — collapsed to fit)\n"
    by = f" — imported by {f.imported_by} file(s)" if f.imported_by else ""
    lines = [f"## {f.rel} (#{f.rank}{by})"]
    lines += [("    " if s.kind in ("method", "field") else "") + s.signature for s in f.symbols]
    if f.omitted:
        lines.append(f"… ({f.omitted} more symbol(s))")
    if f.imports:
        lines.append("imports: " + ", ".join(f.imports))
    if f.used_by:
        lines.append("used by: " + ", ".join(f.used_by))
    return "\n" + "\n".join(lines) + "\n"


def _skips(skipped: int, unwired: int) -> str:
    return f"\n[{skipped} unparseable file(s) skipped; {unwired} file(s) in languages not yet wired]\n" if skipped or unwired else ""


def render(m: Map) -> str:
    out = [f"# map: {m.repo} ({m.loc} LOC, {m.total_files} files) | budget {m.target} | rendered {m.rendered} tok{NOTES[m.detail, m.no_private]}\n"]
    out += map(file_block, m.files)
    if m.index:
        out.append(f"\n---\n{INDEX_NOTE}\n")
        last, names = None, []
        for e in (*m.index, None):
            if e is None or e.rel != last:
                if names:
                    out.append(f"{last}: {', '.join(names)}\n")
                last, names = e and e.rel, []
            if e is not None:
                names.append(e.anchor.removeprefix(e.rel + "#"))
    if m.collapsed:
        out.append(f"\n[{sum(n for _, n in m.collapsed)} low-rank file(s) collapsed: {', '.join(f'{d}/* ({n})' for d, n in m.collapsed)}]\n")
    return "".join(out) + _skips(m.skipped, m.unwired)


def index_header(repo: str, loc: int, files: int, budget: int, rendered: int) -> str:
    return f"# map symbol index: {repo} ({loc} LOC, {files} files) | budget {budget} | rendered {rendered} tok\n"


def render_index(entries: list[tuple[str, str]], header: str, skipped: int = 0, unwired: int = 0) -> str:
    return header + "".join(f"{kind} {anchor}\n" for kind, anchor in entries) + _skips(skipped, unwired)


def naive(repo: str, files: list[tuple[str, list[tuple[str, str]], list[str]]]) -> str:
    """Every file ``(rel, [(kind, signature)], imports)``, unranked and without a budget."""
    out = [f"# map: {repo}\n"]
    for rel, symbols, imports in files:
        out.append(f"\n## {rel}\n" + "".join(("    " if k in ("method", "field") else "") + s + "\n" for k, s in symbols) + (f"imports: {', '.join(imports)}\n" if imports else ""))
    return "".join(out)


def render_diff(d, old: str, new: str, skips: dict[str, tuple[int, int]]) -> str:
    out = [f"# map diff: {old} → {new}\n"]
    foot = "".join(f"\n[{side}: {skips[side][0]} unparseable file(s) skipped; {skips[side][1]} file(s) in languages not yet wired]\n" for side in ("old", "new") if any(skips.get(side, (0, 0))))
    if d.empty:
        return "".join(out) + "\nNo structural changes.\n" + foot
    n = d.severities
    out.append(f"\nseverity: {n['breaking']} breaking, {n['notable']} notable, {n['informational']} informational, {n['internal']} internal (heuristic, not a type-checker)\n")
    if d.moved:
        out.append("\n## Moved files\n" + "".join(f"→ {f.rel} → {f.new_rel} ({f.lang}, {f.symbols} symbol(s))\n" for f in d.moved))
    for title, sign, files in (("Added", "+", d.added), ("Removed", "-", d.removed)):
        if files:
            out.append(f"\n## {title} files\n" + "".join(f"{sign} {f.rel} ({f.lang}, {f.symbols} symbol(s))\n" for f in files))
    if d.changed:
        out.append("\n## Changed files\n")
    for rel, c in d.changed:
        out.append(f"\n### {rel}\n")
        out += [f"~ {s.kind} {s.name}: {s.old_sig} → {s.new_sig}\n" for s in c["changed"]]
        out += [f"± {s.name}: {s.kind} {s.old_sig} → {s.new_kind} {s.new_sig}\n" for s in c["kind"]]
        out += [f"+ {s.new_sig}\n" for s in c["added"]] + [f"- {s.old_sig}\n" for s in c["removed"]]
        for sign, key in (("+", "added_imports"), ("-", "removed_imports")):
            if c[key]:
                out.append(f"imports {sign}: {', '.join(c[key])}\n")
    return "".join(out) + foot
