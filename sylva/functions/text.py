"""Scalar functions of the renderers, as columns and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy_column(sig: Column) -> Column:
    """A signature without what opens its body: trailing spaces, then braces, colons and semicolons, then spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(sig, r"\s+$", ""), "[{:;]+$", ""), r"\s+$", "")


def tidy(sig: str) -> str:
    return sig.rstrip().rstrip("{:;").rstrip()


def json_escape_column(s: Column) -> Column:
    """As inside a JSON string: quotes, backslashes, newlines, returns and tabs by name, other controls by number."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(e))
    for k in range(32):
        if chr(k) not in "\n\r\t":
            out = F.replace(out, F.lit(chr(k)), F.lit(f"\\u{k:04x}"))
    return out


def json_string(s: str) -> str:
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return '"' + "".join(named.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


_ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def xml_escape_column(s: Column, attribute: bool) -> Column:
    """Without what XML 1.0 forbids; in attributes quotes, tabs and line ends are references too."""
    out = F.regexp_replace(s, _ILLEGAL, "")
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if attribute:
        pairs += [('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")]
    for c, e in pairs:
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def xml_escape(s: str, attribute: bool = False) -> str:
    s = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]", "", s)
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    if attribute:
        s = s.replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")
    return s


#: What a list of parameters is made of: paths, marks, and all between them.
_PART = r"::|[()\[\]{}<>,:]|[^()\[\]{}<>,:]+"


def strip_params(sig: str) -> str:
    """The first balanced parentheses with types only, where ``name: type`` tells them; else as it is.

    One pass over the parts: a comma on the outer level ends a parameter, its first colon there starts the type.
    """
    head, opened, rest = sig.partition("(")
    shown: list[str] = []
    whole, kind, round_ones, nested = "", None, 1, 0
    for m in re.finditer(_PART, rest if opened else ""):
        part = m[0]
        round_ones += {"(": 1, ")": -1}.get(part, 0)
        ends = not round_ones
        if ends or part == "," and not nested:
            shown.append((kind or "").strip() or whole.strip())
            whole, kind = "", None
            if ends:
                return sig if shown == [""] else f"{head}({', '.join(shown)}{rest[m.start() :]}"
            continue
        whole += part
        if kind is not None:
            kind += part
        elif part == ":" and not nested:
            kind = ""
        nested = max(0, nested + (part in "([{<") - (part in ")]}>"))
    return sig


def strip_params_column(sigs: Column) -> Column:
    """``strip_params`` as a fold over the parts of a signature, in the engine's own expressions."""
    text = lambda v: F.lit(v).cast("string")
    start = F.struct(F.lit(1).alias("round_ones"), F.lit(0).alias("nested"), F.array().cast("array<string>").alias("shown"), text("").alias("whole"), text(None).alias("kind"), text("").alias("after"))
    blank = r"^\s+|\s+$"
    trimmed = lambda c: F.regexp_replace(c, blank, "")

    def step(s: Column, part: Column) -> Column:
        round_ones = s["round_ones"] + F.when(part == "(", 1).when(part == ")", -1).otherwise(0)
        ended = F.concat(s["shown"], F.array(F.coalesce(F.nullif(trimmed(s["kind"]), F.lit("")), trimmed(s["whole"]))))
        state = lambda r, n, shown, whole, kind, after: F.struct(r.alias("round_ones"), n.alias("nested"), shown.alias("shown"), whole.alias("whole"), kind.alias("kind"), after.alias("after"))
        colon = (part == ":") & (s["nested"] == 0)
        kind = F.when(s["kind"].isNotNull(), F.concat(s["kind"], part)).when(colon, text("")).otherwise(text(None))
        nested = F.greatest(F.lit(0), s["nested"] + F.when(part.isin(*"([{<"), 1).when(part.isin(*")]}>"), -1).otherwise(0))
        return (
            F.when(s["round_ones"] == 0, state(s["round_ones"], s["nested"], s["shown"], s["whole"], s["kind"], F.concat(s["after"], part)))
            .when(round_ones == 0, state(round_ones, s["nested"], ended, text(""), text(None), part))
            .when((part == ",") & (s["nested"] == 0), state(round_ones, s["nested"], ended, text(""), text(None), s["after"]))
            .otherwise(state(round_ones, nested, s["shown"], F.concat(s["whole"], part), kind, s["after"]))
        )

    opened = F.instr(sigs, "(")
    rest = F.when(opened > 0, F.substr(sigs, opened + 1)).otherwise("")
    parts = F.regexp_extract_all(rest, F.lit(_PART), F.lit(0))

    def finish(s: Column) -> Column:
        plain = (s["round_ones"] != 0) | ((F.size(s["shown"]) == 1) & (s["shown"][0] == ""))
        return F.when(plain, sigs).otherwise(F.concat(F.substr(sigs, F.lit(1), opened), F.array_join(s["shown"], ", "), s["after"]))

    return F.aggregate(parts, start, step, finish)


def word_count(s: Column) -> Column:
    """The default token count: maximal runs of characters that aren't white space."""
    return F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0))).cast("bigint")
