"""Declarations, imports and call names of one file, without a grammar.

The scanner masks strings and comments, follows braces (or indentation)
to know what a place is inside of, and applies the language's rules wherever a declaration may start: at a line's first character,
behind a brace, a semicolon, an access label, or a comma between fields. Python that parses is
read by the ``ast`` module. Damaged input never raises: what can't be told is left out.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

from ..langs import EXTENSIONS
from .mask import mask
from .rules import CALL, NEW, NOT_CALLS, NOT_NAMES, RULES


@dataclass
class Found:
    """What a file declares: (line, name, kind, signature, visibility), sorted; import texts and call names as sorted sets."""

    symbols: list[tuple[int, str, str, str, str]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    lines: int = 0


def language_of(rel: str) -> str | None:
    name = rel.rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[1]) if "." in name[1:] else None


def count_lines(text: str) -> int:
    return text.count("\n") + (not text.endswith("\n")) if text else 0


def visibility(lang: str, name: str, signature: str) -> str:
    before = signature.split(name, 1)[0]
    word = lambda w: re.search(rf"(?<!\w)(?:{w})(?!\w)", before) is not None
    private = {
        "python": lambda: name.startswith("_"),
        "rust": lambda: not signature.startswith("pub"),
        "typescript": lambda: word("private|protected"),
        "java": lambda: word("private|protected"),
        "go": lambda: not name[:1].isupper(),
        "c": lambda: word("static"),
        "cpp": lambda: word("static"),
    }[lang]()
    return "private" if private else "public"


def extract(text: str, lang: str) -> Found:
    out = Found(lines=count_lines(text))
    raw = text.split("\n")
    if lang == "python":
        found, imports, refs = _python(text)
    else:
        found, imports, refs = _braces(text, lang)
    best: dict[tuple[int, str], tuple] = {}
    for order, (line, name, kind, private) in enumerate(found):
        sig = raw[line - 1].strip() if line <= len(raw) else ""
        row = (kind != "method", order, (line, name, kind, sig, "private" if private else visibility(lang, name, sig)))
        best[line, name] = min(row, best.get((line, name), row))
    out.symbols = sorted(r[2] for r in best.values())
    out.imports, out.refs = sorted({i.strip() for i in imports if i.strip()}), sorted(refs)
    return out


_CONSTANT = re.compile(r"[A-Z0-9_]*[A-Z][A-Z0-9_]*$")


def _python(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(text)
    found, imports, refs = [], set(), set()
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    lines = text.split("\n")

    def name_line(node) -> int:
        return next((k for k in range(node.lineno, min(node.lineno + 3, len(lines) + 1)) if re.search(rf"\b{re.escape(node.name)}\b", lines[k - 1])), node.lineno)

    stack = [(node, "module") for node in reversed(tree.body)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, functions):
            found.append((name_line(node), node.name, "method" if inside == "class" else "function", False))
        elif isinstance(node, ast.ClassDef):
            found.append((name_line(node), node.name, "class", False))
        elif isinstance(node, ast.Assign) and inside == "module":
            found += [(t.lineno, t.id, "constant", False) for t in node.targets if isinstance(t, ast.Name) and _CONSTANT.match(t.id)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            if inside == "class":
                found.append((node.lineno, node.target.id, "field", False))
            elif inside == "module" and _CONSTANT.match(node.target.id):
                found.append((node.lineno, node.target.id, "constant", False))
        elif isinstance(node, ast.Import):
            imports |= {a.name for a in node.names if not a.asname}
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module:
            imports.add(node.module)
        elif isinstance(node, ast.Call):
            f = node.func
            refs |= {f.id} if isinstance(f, ast.Name) else {f.attr} if isinstance(f, ast.Attribute) else set()
        within = "class" if isinstance(node, ast.ClassDef) else inside if isinstance(node, (ast.If, ast.Try, ast.With)) else "body" if isinstance(node, functions) or inside != "module" else "other"
        body = set(map(id, getattr(node, "body", []) if isinstance(getattr(node, "body", []), list) else [])) | set(map(id, getattr(node, "orelse", []) if isinstance(getattr(node, "orelse", []), list) else []))
        stack += [(c, within if id(c) in body else "other") for c in reversed(list(ast.iter_child_nodes(node)))]
    return found, imports, refs


def _python_lines(text: str):
    """For Python that doesn't parse: indentation and lines."""
    clean = mask(text, "python").split("\n")
    found, imports, refs, scopes = [], set(), set(), []
    for k, line in enumerate(clean, 1):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while scopes and indent <= scopes[-1][0]:
            scopes.pop()
        inside = scopes[-1][1] if scopes else "module"
        if m := re.match(r"\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", line):
            found.append((k, m[1], "method" if inside == "class" else "function", False))
            scopes.append((indent, "body"))
        elif m := re.match(r"\s*class\s+([A-Za-z_]\w*)", line):
            found.append((k, m[1], "class", False))
            scopes.append((indent, "class"))
        elif (m := re.match(r"([A-Z0-9_]*[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", line)) and inside == "module":
            found.append((k, m[1], "constant", False))
        elif (m := re.match(r"\s*([A-Za-z_]\w*)\s*:(?!=)", line)) and inside == "class":
            found.append((k, m[1], "field", False))
        elif m := re.match(r"\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)\s*$", line):
            imports |= set(re.split(r"\s*,\s*", m[1]))
        elif m := re.match(r"\s*from\s+([A-Za-z_][\w.]*)\s+import\b", line):
            imports.add(m[1])
        refs |= _calls(line)
    return found, imports, refs


def _calls(line: str) -> set[str]:
    return {m["n"] for m in CALL.finditer(line) if not m["before"] and m["n"] not in NOT_CALLS}


_IMPORTS = {
    "typescript": re.compile(r"^[ \t]*import\b[^;\"']*?(\"[^\"\n]*\"|'[^'\n]*')", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(use[ \t]+[^;]*;)", re.M),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;", re.M),
    "c": re.compile(r"^[ \t]*#[ \t]*include[ \t]*(\"[^\"\n]*\")", re.M),
}
_IMPORTS["cpp"] = _IMPORTS["c"]
_GO_BLOCK = re.compile(r"^import\s*\(([^)]*)\)|^import\s+((?:[\w.]+\s+)?\"[^\"\n]*\")", re.M)


def _imports(text: str, clean: str, lang: str) -> list[tuple[int, str]]:
    """(offset, text); a directive counts where the masked text still has its keyword, so not in comments or strings."""
    out = []
    if lang == "go":
        for m in _GO_BLOCK.finditer(text):
            if clean[m.start() : m.start() + 6] == "import":
                out += [(m.start(), x.strip()) for x in (m[1].split("\n") if m[1] is not None else [m[2]]) if '"' in x.split("//")[0]]
        return out
    for m in _IMPORTS[lang].finditer(text):
        lead = len(m[0]) - len(m[0].lstrip())
        if clean[m.start() + lead : m.start() + lead + 3].strip():
            out.append((m.start(), m[1].strip("\"'") if lang in ("c", "cpp") else re.sub(r"\s+", " ", m[1])))
    return out


_SCOPES = {"class": "class", "interface": "interface", "enum": "enum", "module": "top", "method": "body", "function": "body", "constant": "body", "type": "body", "field": "body"}


def _scope(lang: str, kind: str, line: str) -> str:
    if lang == "rust":
        return {"class": "struct", "interface": "type", "module": "top"}.get(kind, "body")
    if lang in ("go", "c") and kind == "class":
        return "struct"
    return _SCOPES.get(kind, "body")


#: Scopes in which a comma ends a declaration.
_COMMA = {"rust": {"struct"}, "typescript": {"interface"}}
_LABEL = re.compile(r"(public|private|protected)\s*:(?!:)")
_ID = re.compile(r"[\s*&]*([A-Za-z_$][\w$]*)")
_TYPE_ONLY = re.compile(r"[\w\s*&:<>,]+")


def _also(lang: str, rest: str, end: int) -> list[str]:
    """Further names of one field declaration, whose first ends at ``end``."""
    if lang == "go":
        m = re.match(r"\s*\w+((?:\s*,\s*\w+)+)\s", rest)
        return re.findall(r"\w+", m[1]) if m else []
    if lang not in ("c", "cpp", "java"):
        return []
    names, depth = [], 0
    for i in range(end, len(rest)):
        c = rest[i]
        depth += (c in "([{<") - (c in ")]}>")
        if c == ";" and depth <= 0:
            break
        if c == "," and depth <= 0 and (m := _ID.match(rest, i + 1)):
            names.append(m[1])
    return names


class _Scan:
    """State of one file: scopes are [what, depth of braces, access]; what "hidden" is a test module."""

    def __init__(self, lang: str) -> None:
        self.lang, self.found, self.refs, self.hidden_lines = lang, [], set(), set()
        self.scopes: list[list] = [["top", 0, ""]]
        self.pending, self.test_next, self.depth, self.parens, self.lead = None, False, 0, 0, ""

    def hidden(self) -> bool:
        return any(s[0] == "hidden" for s in self.scopes)

    def declare(self, number: int, rest: str, names: set[str]) -> None:
        """The first rule that fits what starts here."""
        lang, scope, stripped = self.lang, self.scopes[-1], rest.strip()
        what = scope[0]
        aliases = {"class": {"class", "type"}, "interface": {"interface", "type"}}.get(what, {what})
        lead, self.lead = self.lead, ""
        for pattern, kind, where in RULES[lang]:
            if not aliases & set(where) or not (m := pattern.match(lead + rest)):
                continue
            name = m["n"]
            if name in NOT_NAMES or name == "new" and lang in NEW or kind == "field" and name in ("return", "case", "default", "public", "private", "protected"):
                continue
            if lang == "cpp" and kind == "field" and "(" in re.split("[=;,]", rest)[0]:
                continue
            test = lang == "rust" and kind == "module" and (self.test_next or name == "tests")
            if kind == "module" and lang == "rust" and stripped.endswith(";"):
                test = test and self.test_next
            if not self.hidden() and not test:
                private = lang == "cpp" and what == "class" and kind in ("method", "field") and scope[2] in ("private", "protected")
                own = [name, *(_also(lang, lead + rest, m.end("n")) if kind == "field" else [])]
                self.found += [(number, x, kind, private) for x in own]
                names.update(own)
            self.pending = ("hidden" if test else _scope(lang, kind, rest), "public" if re.match(r"\s*(?:template\s*<.*>\s*)?(?:struct|union)\b", rest) else "private")
            return
        if lang == "rust" and re.match(r"(?:unsafe\s+)?impl\b", rest):
            self.pending = ("impl", "")
        elif lang == "go" and (m := re.match(r"(type|const|var)\s*\($", stripped)):
            self.scopes.append([f"{m[1]}list", -1, ""])
        elif lang == "go" and what.endswith("list") and stripped == ")":
            self.scopes.pop()
        elif lang == "cpp" and re.match(r"(?:extern\s+\"\s*\"|(?:inline\s+)?namespace)\s*\{?", rest):
            self.pending = ("top", "")
        elif lang in ("c", "cpp") and what == "top" and _TYPE_ONLY.fullmatch(stripped):
            self.lead = f"{lead}{stripped} "  # a type whose name stands on the next line

    def line(self, number: int, line: str) -> None:
        lang, stripped, names = self.lang, line.strip(), set()
        if lang == "rust" and re.match(r"#\[cfg\(\s*test\s*\)\]", stripped):
            self.test_next = True
        hidden, fresh, i = self.hidden(), True, 0
        while i < len(line):
            c = line[i]
            if fresh and self.parens == 0 and not c.isspace():
                if lang == "cpp" and self.scopes[-1][0] == "class" and (m := _LABEL.match(line, i)):
                    self.scopes[-1][2] = m[1]
                    i = m.end()
                    continue
                fresh = False
                self.declare(number, line[i:], names)
                hidden = hidden or bool(self.pending) and self.pending[0] == "hidden"
            fresh = self.mark(c) or fresh
            i += 1
        if lang == "go" and self.scopes[-1][0].endswith("list"):
            self.parens = 0
        if hidden:
            self.hidden_lines.add(number)
        else:
            attribute = lang == "rust" and stripped.startswith("#")
            self.refs |= {n for n in _calls(line) if n not in names and not attribute and not (n == "new" and lang in NEW)}
        if stripped and not stripped.startswith(("#", "@")) and not (lang == "rust" and stripped.startswith("//")):
            self.test_next = self.test_next and not re.search(r"\w", stripped)

    def mark(self, c: str) -> bool:
        """Follows brackets; whether a declaration may start behind this character."""
        scopes = self.scopes
        if c == "{":
            self.depth += 1
            what, access = self.pending or ("body", "")
            scopes.append([what, self.depth, access])
            self.pending = None
        elif c == "}":
            while len(scopes) > 1 and scopes[-1][1] == -1:
                scopes.pop()
            if len(scopes) > 1 and scopes[-1][1] == self.depth:
                scopes.pop()
            self.depth = max(0, self.depth - 1)
            self.parens = 0 if len(scopes) == 1 else self.parens
        elif c == "(":
            self.parens += 1
        elif c == ")":
            self.parens = max(0, self.parens - 1)
        elif c == ";" and self.parens == 0:
            self.pending = None
        elif not (c == "," and scopes[-1][0] in _COMMA.get(self.lang, ())):
            return False
        return c in "{};,"


def _braces(text: str, lang: str):
    clean = mask(text, lang)
    if lang in ("c", "cpp"):
        clean = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), clean, flags=re.M)
    scan = _Scan(lang)
    for k, line in enumerate(clean.split("\n"), 1):
        scan.line(k, line)
    found, refs, hidden_lines = scan.found, scan.refs, scan.hidden_lines
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    imports = {x for at, x in _imports(text, clean if lang not in ("c", "cpp") else mask(text, lang), lang) if bisect.bisect_right(starts, at) not in hidden_lines}
    return found, imports, refs
