"""Declarations and imports of each language, as patterns over the rest of a masked line from where a declaration may start.

A rule is (pattern, kind, where): the group ``n`` is the name. ``where`` lists the scopes in which
the rule holds: ``top`` (file or namespace), ``type`` (class, interface, trait body), ``impl``.
"""

from __future__ import annotations

import re

ID = r"[A-Za-z_$][\w$]*"
_ANY = ("top", "type", "impl", "body")
_OUT = ("top", "type")


def _rules(*rows: tuple[str, str, tuple[str, ...]]) -> list[tuple[re.Pattern, str, tuple[str, ...]]]:
    return [(re.compile(p.replace("ID", ID)), kind, where) for p, kind, where in rows]


_TS_LEAD = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_TS_MEMBER = r"^\s*(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*"
_RS_PUB = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?"
_RS_FN = _RS_PUB + r"(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?P<n>ID)"
_J_MOD = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|sealed)\s+)*"
_C_TYPE = r"(?:(?:const|unsigned|signed|struct|enum|union|static|inline|extern|virtual|explicit|constexpr|friend|volatile|register|typename|mutable|long|short)\s+)*"
_C_NAMED = r"[A-Za-z_][\w:]*(?:<[^;(){}]*>)?(?:\s*[*&]+\s*|\s+)(?:const\s+)?"
_C_FUNC = rf"^\s*{_C_TYPE}(?:{_C_NAMED})?[*&\s]*(?P<n>~?[A-Za-z_]\w*)\s*\("
_C_NOT = r"(?!\s*(?:return|else|if|for|while|switch|case|do|goto|new|delete|throw|sizeof|using|typedef|operator|namespace|template\s*<[^>]*>\s*$)\b)"

RULES = {
    "typescript": _rules(
        (_TS_LEAD + r"(?:async\s+)?function\s*\*?\s*(?P<n>ID)", "function", ("top", "body")),
        (_TS_LEAD + r"(?:const|let|var)\s+(?P<n>ID)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)?\s*(?::[^=]+)?(?:=>|$)|ID\s*=>|function\b)", "function", ("top", "body")),
        (_TS_LEAD + r"(?:abstract\s+)?class\s+(?P<n>ID)", "class", _ANY),
        (_TS_LEAD + r"interface\s+(?P<n>ID)", "interface", _ANY),
        (_TS_LEAD + r"(?:const\s+)?enum\s+(?P<n>ID)", "enum", _ANY),
        (_TS_LEAD + r"type\s+(?P<n>ID)\s*(?:<[^=]*>)?\s*=", "type", _ANY),
        (r"^\s*export\s+const\s+(?P<n>[A-Z0-9_]*[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=", "constant", ("top",)),
        (_TS_MEMBER + r"\*?(?P<n>#?ID)\s*(?:<[^(]*>)?\(", "method", ("class",)),
        (_TS_MEMBER + r"(?P<n>#?ID)\s*[?!]?\s*(?::|=(?!>)|;|$)", "field", ("class",)),
        (r"^\s*(?:readonly\s+)?(?P<n>ID)\s*\??\s*:", "field", ("interface",)),
    ),
    "rust": _rules(
        (_RS_FN, "method", ("impl", "type")),
        (_RS_FN, "function", ("top", "body")),
        (_RS_PUB + r"struct\s+(?P<n>ID)", "class", _ANY),
        (_RS_PUB + r"enum\s+(?P<n>ID)", "enum", _ANY),
        (_RS_PUB + r"(?:unsafe\s+)?trait\s+(?P<n>ID)", "interface", _ANY),
        (_RS_PUB + r"type\s+(?P<n>ID)", "type", _ANY),
        (_RS_PUB + r"(?:const|static)\s+(?:mut\s+)?(?P<n>ID)\s*:", "constant", _ANY),
        (_RS_PUB + r"mod\s+(?P<n>ID)", "module", _ANY),
        (r"^\s*macro_rules!\s*(?P<n>ID)", "function", _ANY),
        (_RS_PUB + r"(?P<n>ID)\s*:(?!:)", "field", ("struct",)),
    ),
    "go": _rules(
        (r"^func\s+\([^)]*\)\s*(?P<n>ID)", "method", ("top",)),
        (r"^func\s+(?P<n>ID)", "function", ("top",)),
        (r"^\s*(?:type\s+)?(?P<n>ID)\s*(?:\[[^\]]*\])?\s+struct\b", "class", ("top", "typelist")),
        (r"^\s*(?:type\s+)?(?P<n>ID)\s*(?:\[[^\]]*\])?\s+interface\b", "interface", ("top", "typelist")),
        (r"^\s*const\s+(?P<n>ID)", "constant", ("top", "body")),
        (r"^\s*(?P<n>ID)(?:\s*=|\s+\w+\s*=|\s*$)", "constant", ("constlist",)),
        (r"^\s*(?P<n>ID)(?:\s*,\s*ID)*\s+[\w*\[\].<]", "field", ("struct",)),
    ),
    "java": _rules(
        (_J_MOD + r"class\s+(?P<n>ID)", "class", _ANY),
        (_J_MOD + r"@?interface\s+(?P<n>ID)", "interface", _ANY),
        (_J_MOD + r"enum\s+(?P<n>ID)", "enum", _ANY),
        (_J_MOD + r"(?:<[^>]+>\s*)?(?!(?:return|new|else|throw)\b)[A-Za-z_][\w.]*(?:<[^;(){}]*>)?(?:\[\])*\s+(?P<n>ID)\s*\(", "method", ("class", "interface")),
        (_J_MOD + r"(?P<n>[A-Z]\w*)\s*\([^;]*$", "method", ("class",)),
        (_J_MOD + r"(?!(?:return|package|import|throw|new|else)\b)[A-Za-z_][\w.]*(?:<[^;(){}]*>)?(?:\[\])*\s+(?P<n>ID)\s*(?:=|;|,)", "field", ("class",)),
    ),
    "c": _rules(
        (r"^\s*(?:static\s+|typedef\s+)*(?:struct|union)\s+(?P<n>ID)\s*(?:\{|$)", "class", _ANY),
        (r"^\s*(?:static\s+|typedef\s+)*enum\s+(?P<n>ID)\s*(?:\{|$)", "enum", _ANY),
        (r"^\s*typedef\b[^(]*?\b(?P<n>ID)\s*(?:\[[^\]]*\]\s*)*;", "type", ("top",)),
        (r"^\s*typedef\b.*?\(\s*\*\s*(?P<n>ID)\s*\)", "type", ("top",)),
        (rf"^{_C_NOT}\s*{_C_TYPE}(?:[A-Za-z_]\w*(?:\s+|\s*\*+\s*))+(?P<n>ID)\s*\(", "function", ("top",)),
        (rf"^{_C_NOT}\s*{_C_TYPE}[A-Za-z_]\w*[\s*]+(?P<n>ID)\s*(?:\[[^\]]*\]\s*)*(?::\s*\d+\s*)?(?:;|,)", "field", ("struct",)),
    ),
    "cpp": _rules(
        (r"^\s*(?:inline\s+)?namespace\s+(?P<n>ID)", "module", ("top",)),
        (r"^\s*(?:template\s*<[^{}]*>\s*)?(?:class|struct|union)\s+(?:alignas\([^)]*\)\s*)?(?P<n>ID)(?=\s*(?:final\s*)?(?::(?!:)[^;]*)?(?:\{|$))", "class", _ANY),
        (r"^\s*enum\s+(?:class\s+|struct\s+)?(?P<n>ID)(?=\s*(?::[^;{]*)?(?:\{|$))", "enum", _ANY),
        (r"^\s*using\s+(?P<n>ID)\s*=", "type", _ANY),
        (r"^\s*typedef\b[^(]*?\b(?P<n>ID)\s*;", "type", ("top", "class")),
        (rf"^{_C_NOT}\s*(?:template\s*<[^{{}}]*>\s*)?(?P<full>{_C_TYPE}(?:{_C_NAMED})[*&\s]*(?:ID::)*(?P<n>~?ID)\s*\()", "function", ("top",)),
        (rf"^{_C_NOT}{_C_FUNC[1:]}", "method", ("class",)),
        (rf"^{_C_NOT}\s*{_C_TYPE}{_C_NAMED}[*&\s]*(?P<n>ID)\s*(?:\[[^\]]*\]\s*)*(?::\s*\d+\s*)?(?:\{{[^}}]*\}}\s*)?(?:=(?!=)|;|,)", "field", ("class",)),
    ),
}

#: Words before a parenthesis that aren't calls.
NOT_CALLS = frozenset("if for while switch return catch sizeof and or not in is lambda def class assert await async yield del elif else except with func fn function typeof instanceof match loop unsafe where impl struct enum trait interface super this static_assert alignas decltype defined import case do throw".split())
#: Words that no rule takes for a name.
NOT_NAMES = frozenset("if for while switch return catch else do case throw sizeof".split())
#: ``new(...)`` is a call in some languages only.
NEW = frozenset({"typescript", "java", "cpp", "c"})
CALL = re.compile(r"(?P<before>\bnew\s+|\bfn\s+|\bfunc\s+|\bfunction\s+|\bdef\s+|\bclass\s+)?(?<![\w$])(?P<n>[A-Za-z_$][\w$]*+)\s*+(?:::<[^()>]*+>)?\(")
