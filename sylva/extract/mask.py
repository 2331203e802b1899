"""Comments and strings out of the way: the text with them blanked, same length and lines."""

from __future__ import annotations

import re

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_CHAR = r"'(?:\\.|[^'\\\n])*'?"
_BLOCK = r"/\*.*?(?:\*/|\Z)"
_LINE = r"//[^\n]*"

_PATTERNS = {
    "python": r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|' + _STRING + "|" + _CHAR + ")",
    "rust": rf"{_LINE}|{_BLOCK}|b?r(#*)\".*?(?:\"\1|\Z)|b?{_STRING}|b?'(?:\\.[^'\n]*|[^'\\\n])'",
    "go": rf"{_LINE}|{_BLOCK}|`[^`]*(?:`|\Z)|{_STRING}|{_CHAR}",
    "typescript": rf"{_LINE}|{_BLOCK}|`(?:\\.|[^`\\])*(?:`|\Z)|{_STRING}|{_CHAR}",
}
_PATTERNS |= dict.fromkeys(("java", "c", "cpp"), rf"{_LINE}|{_BLOCK}|{_STRING}|{_CHAR}")
_COMPILED = {k: re.compile(v, re.DOTALL) for k, v in _PATTERNS.items()}
_NOT_LINE_END = re.compile(r"[^\n]")


def mask(text: str, lang: str) -> str:
    """Quotes stay, so that what was a string can still be told; the rest of it is spaces."""

    def blank(m: re.Match) -> str:
        found = m[0]
        body = _NOT_LINE_END.sub(" ", found)
        first = re.match(r"[A-Za-z]*#*[\"'`]", found)
        return found[0] + body[1:-1] + found[-1] if first and len(found) > 1 and found[0] in "\"'`" else body

    return _COMPILED[lang].sub(blank, text)
