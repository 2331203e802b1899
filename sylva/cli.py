"""Command line: map (by default), diff, explain, doctor, cache, serve, and a shell completion."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time

from . import api, budget
from .langs import EXTENSIONS, LANGUAGES, PRESETS
from .render import markdown
from .render.color import colorize
from .sources import tree
from .sources.cache import Cache

OK, FAILED, USAGE = 0, 1, 2
COMMANDS = ("map", "diff", "explain", "doctor", "cache", "serve", "completions")


class Usage(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sylva", description=__doc__)
    subs = p.add_subparsers(dest="command", required=True)

    def add(name: str, **roots: str):
        s = subs.add_parser(name)
        for r, default in roots.items():
            s.add_argument(r, nargs="?", default=default)
        return s

    m = add("map", root=".")
    m.add_argument("--budget", type=int)
    m.add_argument("--preset", choices=PRESETS)
    m.add_argument("--for-agent", action="store_true")
    m.add_argument("--focus", action="append", default=[])
    m.add_argument("--no-cache", action="store_true")
    m.add_argument("--check")
    m.add_argument("--timings", action="store_true")
    m.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    m.add_argument("--vocabulary", help="file of a byte-pair vocabulary; words are counted without")
    d = add("diff")
    d.add_argument("old")
    d.add_argument("new", nargs="?")
    d.add_argument("--exit-code", action="store_true")
    for s in (m, d):
        s.add_argument("--format", choices=("md", "json", "xml"), default="md")
        s.add_argument("--output")
        s.add_argument("--lang", action="append", default=[])
        s.add_argument("--no-private", action="store_true")
    e = add("explain")
    e.add_argument("file")
    e.add_argument("root", nargs="?", default=".")
    e.add_argument("--focus", action="append", default=[])
    add("doctor", root=".")
    c = add("cache")
    c.add_argument("action", choices=("info", "clean"))
    c.add_argument("root", nargs="?", default=".")
    c.add_argument("--force", action="store_true")
    add("serve", root=".")
    add("completions")
    return p


def split_list(values: list[str]) -> list[str]:
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def languages(values: list[str]) -> list[str] | None:
    out = split_list(values)
    aliases = {"javascript": "typescript", "c++": "cpp"} | EXTENSIONS
    out = [aliases.get(x.lower(), x.lower()) for x in out]
    if unknown := [x for x in out if x not in LANGUAGES]:
        raise Usage(f"unknown language {unknown[0]}; known: {', '.join(LANGUAGES)}")
    return out or None


def focus_targets(root: str, values: list[str]) -> list[str]:
    """Paths under ``root``. None of them on disk is a misuse; some missing is a warning."""
    wanted, found, missing = split_list(values), [], []
    for v in wanted:
        full = os.path.realpath(v if os.path.isabs(v) else os.path.join(root, v))
        if os.path.exists(full) and (full + "/").startswith(os.path.realpath(root) + "/"):
            found.append(os.path.relpath(full, os.path.realpath(root)))
        else:
            missing.append(v)
    if missing and not found:
        raise Usage(f"no such focus path: {', '.join(missing)}")
    if missing:
        print(f"warning: no such focus path: {', '.join(missing)}", file=sys.stderr)
    return found


def write_atomically(path: str, text: str) -> None:
    """A new file beside, synced and renamed over; the target is never half written."""
    folder = os.path.dirname(os.path.abspath(path))
    if os.path.isdir(path) or not os.path.isdir(folder):
        raise Usage(f"cannot write {path}: {'it is a directory' if os.path.isdir(path) else 'no such directory'}")
    fd, beside = tempfile.mkstemp(dir=folder, prefix=".sylva-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(beside, 0o644)
        os.replace(beside, path)
    except OSError:
        if os.path.exists(beside):
            os.unlink(beside)
        raise


def check_stale(path: str, text: str) -> int:
    """0: the file holds ``text``; 1: it is stale; 2: it can't be read."""
    try:
        with open(path, "rb") as f:
            return OK if f.read() == text.encode() else FAILED
    except OSError:
        return USAGE


def run_map(spark, a) -> int:
    if a.budget is not None and (a.preset or a.budget <= 0):
        raise Usage("a budget is a positive number, and excludes a preset")
    if a.for_agent and a.format != "md":
        raise Usage("--for-agent is for Markdown")
    if a.check and a.output:
        raise Usage("--check excludes --output")
    if not os.path.isdir(a.root):
        raise Usage(f"no such directory: {a.root}")
    began = time.perf_counter()
    opts = api.MapOptions(a.budget or PRESETS[a.preset or "default"], a.no_private, languages(a.lang), focus_targets(a.root, a.focus), not a.no_cache, budget.vocabulary_counter(a.vocabulary) if a.vocabulary else budget.words)
    packed = api.build_map(spark, a.root, opts)
    built = time.perf_counter()
    text = (markdown.PREAMBLE if a.for_agent else "") + api.render_map(packed, a.format)
    if a.timings:
        print(f"build {1000 * (built - began):.0f} ms {packed.total_files} files\nrender {1000 * (time.perf_counter() - built):.0f} ms", file=sys.stderr)
    if a.check:
        return check_stale(a.check, text)
    if a.output:
        write_atomically(a.output, text)
    else:
        shown = a.format == "md" and (a.color == "always" or a.color == "auto" and sys.stdout.isatty())
        sys.stdout.write(colorize(text) if shown else text)
    return OK


def run_diff(spark, a) -> int:
    with tree.Revision(a.old) as old, tree.Revision(a.new or ".") as new:
        d = api.diff(spark, old, new, a.no_private, languages(a.lang))
    text = d.render(a.format, a.old, a.new or "(working tree)")
    write_atomically(a.output, text) if a.output else sys.stdout.write(text)
    return FAILED if a.exit_code and d.breaking else OK


def run_explain(spark, a) -> int:
    r = api.explain(spark, a.root, a.file, api.MapOptions(focus=focus_targets(a.root, a.focus)))
    if r is None:
        raise Usage(f"{a.file} isn't mapped")
    print(f"{r.rel}: #{r.pos}, score {r.score:.6f}, imported by {r.imported_by} file(s), imports {r.imports} file(s){', in focus' if r.focus else ''}")
    return OK


def run_doctor(spark, a) -> int:
    files = tree.discover(spark, a.root)
    for r in tree.scan.language_census(files).orderBy("lang").collect():
        print(f"{r.lang}: {r.n} file(s)")
    print(f"root: {os.path.abspath(a.root)}\nspark: {spark.version}\ncache: {Cache(spark, a.root).info()}")
    return OK


def run_cache(spark, a) -> int:
    cache = Cache(spark, a.root)
    if a.action == "info":
        print("\n".join(f"{k}: {v}" for k, v in cache.info().items()))
    elif not a.force:
        raise Usage("cleaning needs --force")
    else:
        print("removed" if cache.clean() else "there was none")
    return OK


def run_serve(spark, a) -> int:
    from .server import serve

    serve(spark, a.root, sys.stdin, sys.stdout)
    return OK


def run_completions(spark, a) -> int:
    print(f"complete -W \"{' '.join(COMMANDS)}\" sylva")
    return OK


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in (*COMMANDS, "-h", "--help"):
        argv.insert(0, "map")
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if spark is None and a.command != "completions":
            from .session import local_session

            spark = local_session("*")
        return globals()[f"run_{a.command}"](spark, a)
    except (Usage, tree.NoSupportedFiles, tree.NoMatchingLanguage, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE if isinstance(e, Usage) else FAILED
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
