"""Maps and diffs as JSON and XML; keys, elements and their order are fixed values."""

from __future__ import annotations

from typing import TYPE_CHECKING

from ..functions.text import json_string as js
from ..functions.text import xml_escape

if TYPE_CHECKING:
    from ..budget import File, Map

VERSION = 1


def _flag(v: bool) -> str:
    return "true" if v else "false"


def _pairs(**values: str | int) -> str:
    return "{" + ", ".join(f'"{k}": {v}' for k, v in values.items()) + "}"


def _strings(items) -> str:
    return "[" + ", ".join(map(js, items)) + "]"


def _rows(rows: list[str]) -> str:
    return "[\n    " + ",\n    ".join(rows) + "\n  ]" if rows else "[]"


def _file_json(f: File) -> str:
    symbols = ", ".join(_pairs(kind=js(s.kind), name=js(s.name), sig=js(s.signature), line=s.line, visibility=js(s.visibility)) for s in f.symbols)
    return _pairs(path=js(f.rel), lang=js(f.lang), rank=f.rank, score=f"{f.score:.6f}", imported_by=f.imported_by, one_line=_flag(f.one_line), omitted=f.omitted, symbols=f"[{symbols}]", imports=_strings(f.imports), used_by=_strings(f.used_by))


def map_json(m: Map) -> str:
    fields = {
        "version": VERSION,
        "repo": _pairs(name=js(m.repo), loc=m.loc, files=m.total_files),
        "budget": _pairs(target=m.target, rendered=m.rendered, detail=js(m.detail)),
        "files": _rows([_file_json(f) for f in m.files]),
        "collapsed": _rows([_pairs(dir=js(d), count=n) for d, n in m.collapsed]),
        "symbol_index": _rows([_pairs(name=js(e.name), kind=js(e.kind), path=js(e.rel), anchor=js(e.anchor), line=e.line) for e in m.index]),
    }
    return "{\n" + "".join(f'  "{k}": {v},\n' for k, v in fields.items()) + f'  "skipped_files": {m.skipped}, "unwired_files": {m.unwired}\n}}\n'


class Xml:
    """Lines of elements, two spaces a level."""

    def __init__(self) -> None:
        self.lines, self.depth = ['<?xml version="1.0" encoding="UTF-8"?>'], 0

    @staticmethod
    def start(name: str, attributes: dict) -> str:
        return name + "".join(f' {k}="{xml_escape(str(v), True)}"' for k, v in attributes.items())

    def leaf(self, name: str, attributes: dict | None = None, content: str | None = None) -> None:
        head = self.start(name, attributes or {})
        self.lines.append("  " * self.depth + (f"<{head}/>" if content is None else f"<{head}>{xml_escape(content)}</{name}>"))

    def group(self, name: str, items, each, attributes: dict | None = None, always: bool = False) -> None:
        items = list(items)
        if not items and not always:
            return self.leaf(name, attributes)
        self.lines.append("  " * self.depth + f"<{self.start(name, attributes or {})}>")
        self.depth += 1
        for x in items:
            each(x)
        self.depth -= 1
        self.lines.append("  " * self.depth + f"</{name}>")

    def text(self) -> str:
        return "\n".join(self.lines) + "\n"


def map_xml(m: Map) -> str:
    x = Xml()

    def file(f: File) -> None:
        parts = [
            lambda: x.group("symbols", f.symbols, lambda s: x.leaf("symbol", {"kind": s.kind, "name": s.name, "line": s.line, "visibility": s.visibility}, s.signature)),
            lambda: x.group("imports", f.imports, lambda i: x.leaf("import", content=i)),
            lambda: x.group("used_by", f.used_by, lambda u: x.leaf("ref", content=u)),
        ]
        x.group("file", parts, lambda p: p(), {"path": f.rel, "lang": f.lang, "rank": f.rank, "score": f"{f.score:.6f}", "imported_by": f.imported_by, "one_line": _flag(f.one_line), "omitted": f.omitted})

    parts = [
        lambda: x.leaf("repo", {"name": m.repo, "loc": m.loc, "files": m.total_files}),
        lambda: x.leaf("budget", {"target": m.target, "rendered": m.rendered, "detail": m.detail}),
        lambda: x.group("files", m.files, file),
        lambda: x.group("collapsed", m.collapsed, lambda c: x.leaf("dir", {"dir": c[0], "count": c[1]})),
        lambda: x.group("symbol_index", m.index, lambda e: x.leaf("symbol", {"name": e.name, "kind": e.kind, "path": e.rel, "anchor": e.anchor, "line": e.line})),
        lambda: x.leaf("skipped_files", content=str(m.skipped)),
        lambda: x.leaf("unwired_files", content=str(m.unwired)),
    ]
    x.group("map", parts, lambda p: p(), {"version": VERSION})
    return x.text()


def diff_json(d, old: str, new: str, skips: dict[str, tuple[int, int]]) -> str:
    listed = lambda rows: "[" + ", ".join(rows) + "]"
    summary = lambda f: _pairs(path=js(f.rel), lang=js(f.lang), symbols=f.symbols, severity=js(f.severity))
    line = lambda s, sig: _pairs(kind=js(s.kind), name=js(s.name), sig=js(sig), severity=js(s.severity))

    def changed(rel: str, c: dict) -> str:
        return _pairs(
            path=js(rel),
            changed=listed(_pairs(kind=js(s.kind), name=js(s.name), old_sig=js(s.old_sig), new_sig=js(s.new_sig), severity=js(s.severity)) for s in c["changed"]),
            kind_changed=listed(_pairs(name=js(s.name), old_kind=js(s.kind), new_kind=js(s.new_kind), old_sig=js(s.old_sig), new_sig=js(s.new_sig), severity=js(s.severity)) for s in c["kind"]),
            added=listed(line(s, s.new_sig) for s in c["added"]),
            removed=listed(line(s, s.old_sig) for s in c["removed"]),
            added_imports=_strings(c["added_imports"]),
            removed_imports=_strings(c["removed_imports"]),
        )

    stats = lambda side: _pairs(skipped_files=skips.get(side, (0, 0))[0], unwired_files=skips.get(side, (0, 0))[1])
    fields = {
        "version": VERSION,
        "old": js(old),
        "new": js(new),
        "moved_files": listed(_pairs(old=js(f.rel), new=js(f.new_rel), lang=js(f.lang), symbols=f.symbols) for f in d.moved),
        "added_files": listed(map(summary, d.added)),
        "removed_files": listed(map(summary, d.removed)),
        "changed_files": listed(changed(*c) for c in d.changed),
        "skipped": _pairs(old=stats("old"), new=stats("new")),
    }
    return "{\n" + ",\n".join(f'  "{k}": {v}' for k, v in fields.items()) + "\n}\n"


def diff_xml(d, old: str, new: str, skips: dict[str, tuple[int, int]]) -> str:
    x = Xml()
    summary = lambda f: x.leaf("file", {"path": f.rel, "lang": f.lang, "symbols": f.symbols, "severity": f.severity})

    def changed(item) -> None:
        rel, c = item
        parts = [lambda s=s: x.leaf("changed", {"kind": s.kind, "name": s.name, "old-sig": s.old_sig, "new-sig": s.new_sig, "severity": s.severity}) for s in c["changed"]]
        parts += [lambda s=s: x.leaf("kind-changed", {"name": s.name, "old-kind": s.kind, "new-kind": s.new_kind, "old-sig": s.old_sig, "new-sig": s.new_sig, "severity": s.severity}) for s in c["kind"]]
        parts += [lambda s=s: x.leaf("added", {"kind": s.kind, "name": s.name, "sig": s.new_sig, "severity": s.severity}) for s in c["added"]]
        parts += [lambda s=s: x.leaf("removed", {"kind": s.kind, "name": s.name, "sig": s.old_sig, "severity": s.severity}) for s in c["removed"]]
        parts += [lambda k=k: x.group(k.replace("_", "-"), c[k], lambda i: x.leaf("import", content=i)) for k in ("added_imports", "removed_imports")]
        x.group("file", parts, lambda p: p(), {"path": rel})

    side = lambda s: x.leaf(s, {"skipped-files": skips.get(s, (0, 0))[0], "unwired-files": skips.get(s, (0, 0))[1]})
    parts = [
        lambda: x.group("moved-files", d.moved, lambda f: x.leaf("file", {"old": f.rel, "new": f.new_rel, "lang": f.lang, "symbols": f.symbols})),
        lambda: x.group("added-files", d.added, summary),
        lambda: x.group("removed-files", d.removed, summary),
        lambda: x.group("changed-files", d.changed, changed),
        lambda: x.group("skipped", ("old", "new"), side),
    ]
    x.group("map-diff", parts, lambda p: p(), {"version": VERSION, "old": old, "new": new})
    return x.text()
