"""A Markdown map with terminal colours; display only.

What a line is follows from how ``markdown`` writes it; the words before a name that are coloured are those that the extraction rules look for.
"""

from __future__ import annotations

import re

from ..extract.rules import RULES
from . import markdown

#: Terminal codes by what is painted.
HEAD, PATH, WORD, FAINT = "1;36", "1;34", "35", "2"
WORDS = sorted({w for rules in RULES.values() for pattern, *_ in rules for w in re.findall(r"(?<![\w\\<])[a-z]{2,}(?![\w>])", pattern.pattern)} | {"def", "async"})
_LINES = (
    # a file, with or without its place in brackets
    (re.compile(r"(?P<faint>## )(?P<path>.+?)(?P<after> \(#.*)?"), {"faint": FAINT, "path": PATH, "after": FAINT}),
    (re.compile(r"(?P<head># map.*)"), {"head": HEAD}),
    (re.compile(r"(?P<faint>---|symbol index \(.*|(?:imports|used by): .*|… \(.*|\[.*\])"), {"faint": FAINT}),
    (re.compile(rf"(?P<indent>\s*)(?P<word>(?:(?:{'|'.join(WORDS)})\b ?)+)(?P<rest>.*)"), {"word": WORD}),
)
_ENTRY = re.compile(r"(?P<path>[^:]+)(?P<names>: .*)")


def _paint(m: re.Match, codes: dict[str, str]) -> str:
    """The groups of a match one after the other, in their colours; spaces at the end of one stay plain."""
    out = []
    for name, part in m.groupdict(default="").items():
        bare = part.rstrip()
        out.append(f"\x1b[{codes[name]}m{bare}\x1b[0m{part[len(bare) :]}" if name in codes and bare else part)
    return "".join(out)


def colorize(text: str) -> str:
    shown, _, index = text.partition(f"\n{markdown.INDEX_NOTE}\n")
    lines = []
    for line in shown.split("\n"):
        found = next(((m, codes) for pattern, codes in _LINES if (m := pattern.fullmatch(line))), None)
        lines.append(_paint(*found) if found else line)
    if not index:
        return "\n".join(lines)
    lines.append(f"\x1b[{FAINT}m{markdown.INDEX_NOTE}\x1b[0m")
    for line in index.split("\n"):
        m = _ENTRY.fullmatch(line) if not line.startswith("[") else None
        lines.append(_paint(m, {"path": PATH, "names": FAINT}) if m else line)
    return "\n".join(lines)
