"""Source trees as tables: a directory, or a revision of a repository."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..langs import EXTENSIONS
from ..operators import scan

IGNORE_FILES = (".gitignore", ".mapignore")


class NoSupportedFiles(ValueError):
    """The tree holds no file of a known language; the message says what it holds."""


class NoMatchingLanguage(ValueError):
    """No file is left after the language filter."""


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, bool, bool]]:
    """Rules of the ignore files at the root; they are few."""
    lines = []
    for name in IGNORE_FILES:
        if os.path.isfile(path := os.path.join(root, name)):
            with open(path, encoding="utf-8", errors="replace") as f:
                lines += [(x,) for x in f.read().split("\n")]
    if not lines:
        return []
    return [tuple(r) for r in scan.parse_ignore(spark.createDataFrame(lines, "value string")).collect()]


def walk(spark: SparkSession, root: str, tree: str = ".") -> DataFrame:
    """``(tree, rel, content binary)`` of every regular file under ``root``; links aren't followed, hidden and vendored directories not entered.

    A local root is listed on the driver, where whole directories can be left out before
    their files are touched; executors read the contents. Other roots are listed by Spark.
    """
    if "://" in root:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        return rows.select(F.lit(tree).alias("tree"), F.expr(f"substring(path, instr(path, {_quoted(root.rstrip('/') + '/')}) + {len(root.rstrip('/')) + 1})").alias("rel"), "content")
    root = os.path.abspath(root)  # the workers' folder is another
    rels = list_files(root)
    paths = spark.createDataFrame([(r,) for r in rels], "rel string").repartition(max(1, min(len(rels) // 64 + 1, 4096)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            contents = []
            for rel in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["rel", "content"])

    return paths.mapInArrow(read, "rel string, content binary").select(F.lit(tree).alias("tree"), "rel", "content")


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_files(root: str) -> list[str]:
    """Paths of regular files, ``/``-separated, sorted; unreadable directories are skipped."""
    from ..langs import VENDORED

    out, stack = [], [""]
    while stack:
        folder = stack.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            continue
        for e in entries:
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith(".") or e.is_symlink():
                continue
            if e.is_dir():
                if e.name not in VENDORED:
                    stack.append(rel)
            elif e.is_file():
                out.append(rel)
    return sorted(out)


def discover(spark: SparkSession, root: str, langs: list[str] | None = None, tree: str = ".") -> DataFrame:
    """``(tree, file_id, rel, lang, content string)``: mapped files in path order; content that isn't UTF-8 is null."""
    rules = ignore_rules(spark, root)
    found = scan.valid_text(scan.discover(walk(spark, root, tree), rules, langs))
    return scan.number(found)


def empty_hint(spark: SparkSession, root: str) -> str:
    """What an unmapped tree holds."""
    rows = scan.extension_census(spark.createDataFrame([(r,) for r in list_files(root)], "rel string")).orderBy("pos").collect()
    seen = ", ".join(f".{r.ext} ({r.n}{', ' + r['name'] if r['name'] else ''})" for r in rows) or "no files with an extension"
    return f"no supported source files; found {seen}; supported: {', '.join(EXTENSIONS)}"


class Revision:
    """A directory as it is, or a revision of the repository around ``repo``, checked out for the time of a ``with`` block."""

    def __init__(self, spec: str, repo: str = ".") -> None:
        self.spec, self.repo, self.path, self.made = spec, repo, "", False

    def _git(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", self.repo, *args], capture_output=True, text=True)
        if done.returncode:
            raise ValueError(f"{self.spec} is neither a directory nor a revision: {done.stderr.strip()}")
        return done.stdout.strip()

    def __enter__(self) -> str:
        if os.path.isdir(self.spec):
            self.path = self.spec
        else:
            commit = self._git("rev-parse", "--verify", "--end-of-options", f"{self.spec}^{{commit}}")
            self.path = os.path.join(tempfile.mkdtemp(prefix="sylva-rev-"), "tree")
            self._git("worktree", "add", "--detach", self.path, commit)
            self.made = True
        return self.path

    def __exit__(self, *_: object) -> None:
        if self.made:
            self._git("worktree", "remove", "--force", self.path)
            os.rmdir(os.path.dirname(self.path))
