import json
import xml.sax.saxutils

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sylva.functions import text
from sylva.operators import link, scan

# tidy and strip: what must come out
SIGNATURES = {
    "def f(a: int, b: str = 'x') -> int:": "def f(int, str = 'x') -> int",
    "fn g<T>(x: &mut Vec<(u8, u8)>, y: a::B) {": "fn g<T>(&mut Vec<(u8, u8)>, a::B)",
    "int add(int a, int b) {": "int add(int a, int b)",
    "void none();": "void none()",
    "class Point {": "class Point",
    "def open(a, b": "def open(a, b",
    "run(f: (x: number) => void, n?: string): void {": "run((x: number) => void, string): void",
}


def test_signatures(spark):
    for sig, want in SIGNATURES.items():
        assert text.strip_params(text.tidy(sig)) == want
    got = spark.createDataFrame([(s,) for s in SIGNATURES], "s string").select("s", text.strip_params_column(text.tidy_column(F.col("s"))).alias("t")).collect()
    assert {r.s: r.t for r in got} == SIGNATURES


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_escapes(s):
    assert json.loads(text.json_string(s)) == s
    inner = text.xml_escape(s)
    assert xml.sax.saxutils.unescape(inner) == "".join(c for c in s if c in "\t\n\r" or " " <= c <= "퟿" or "" <= c <= "�" or c > "￿")
    assert not set('\t\n\r"') & set(text.xml_escape(s, True))


@settings(max_examples=200, deadline=None)
@given(st.text("(),:[]<> ab", max_size=30))
def test_strip_never_raises(s):
    assert isinstance(text.strip_params(s), str)


def test_strip_alike_as_column(spark):
    import random

    rng = random.Random(2)
    sigs = ["".join(rng.choice(["(", ")", "<", ">", "[", "]", ",", ":", "::", " ", "a", "T", "->", "f("]) for _ in range(rng.randrange(25))) for _ in range(600)] + ["", "()", "f( )", "f(a: )"]
    got = spark.createDataFrame([(s,) for s in sigs], "s string").select("s", text.strip_params_column(F.col("s")).alias("t"))
    assert all(r.t == text.strip_params(r.s) for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.createDataFrame([(None,)], "s string").select(text.strip_params_column(F.col("s")).alias("t")).first().t is None


def test_colours_paint_and_change_no_word():
    import re

    from sylva.render import color, markdown

    text_in = f"# map: x (3 LOC)\n\n## a/b.py (#1 — imported by 2 file(s))\ndef f(x)\n    pub fn g(int)\nimports: c.py\n… (2 more symbol(s))\n\n---\n{markdown.INDEX_NOTE}\na/b.py: f, g@3\n\n[2 low-rank file(s) collapsed: x/* (2)]\n"
    out = color.colorize(text_in)
    assert re.sub("\x1b\\[[0-9;]*m", "", out) == text_in
    assert "\x1b[35mdef\x1b[0m f(x)" in out and "\x1b[35mpub fn\x1b[0m g(int)" in out and "\x1b[1;34ma/b.py\x1b[0m" in out
    assert {"fn", "trait", "def", "class", "func", "pub"} <= set(color.WORDS)


def test_paths(spark):
    rows = {"a/./b": "a/b", "a//b/..": "a", "..": None, "a/../..": None, "./x": "x", "": "", "a/b/../../c": "c"}
    got = spark.createDataFrame([(k,) for k in rows], "p string").select("p", link.normalize(F.col("p")).alias("n"), link.strip_extension(F.col("p")).alias("s")).collect()
    assert {r.p: r.n for r in got} == rows
    names = spark.createDataFrame([("a.d.ts",), ("a.b/c",), ("x",)], "p string").select(link.strip_extension(F.col("p")).alias("s")).collect()
    assert [r.s for r in names] == ["a.d", "a.b/c", "x"]


def test_test_paths(spark):
    yes = ["tests/a.py", "x/spec/b.ts", "conftest.py", "a/test_b.py", "a/b.test.ts", "b.spec.js", "c/d_test.go", "__tests__/x.js"]
    no = ["src/testing_tools.py", "contest.py", "latest/a.py", "a/b_tests.go", "attest.rs"]
    got = spark.createDataFrame([(x,) for x in yes + no], "rel string").filter(scan.test_path(F.col("rel"))).collect()
    assert [r.rel for r in got] == yes


def test_ignore_rules(spark):
    lines = ["# no", "", "!kept", "gen/", "*.min.js", "/top", "a/b*/c", "dir/x/"]
    rules = [tuple(r) for r in scan.parse_ignore(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert rules == [("gen", True, False), ("*.min.js", False, False), ("top", False, True), ("a/b*/c", False, True), ("dir/x", True, True)]
    hit = ["gen/a.py", "x/gen/b.py", "a.min.js", "q/z.min.js", "top", "top/x", "a/bb/c", "a/b/c/d.py", "dir/x/y.py"]
    miss = ["gen", "x/gen", "amin.js", "x/top", "a/b/d/c", "z/a/b/c", "dir/x", "gen2/a"]
    got = spark.createDataFrame([(x,) for x in hit + miss], "rel string").filter(scan.ignored(F.col("rel"), rules)).collect()
    assert [r.rel for r in got] == hit


def test_visibility(spark):
    rows = [
        ("python", "_x", "def _x():", "private"), ("python", "x", "def x():", "public"), ("rust", "f", "fn f()", "private"), ("rust", "f", "pub(crate) fn f()", "public"), ("go", "Éa", "func Éa()", "public"), ("go", "a", "func a()", "private"),
        ("java", "f", "private int f;", "private"), ("java", "f", "int f = priv(private)", "public"), ("typescript", "privateKey", "privateKey: string", "public"), ("c", "f", "static int f()", "private"), ("cpp", "f", "nonstatic f()", "public"),
    ]
    from sylva.extract.scanner import visibility

    got = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "lang string, name string, sig string, want string, k int").withColumn("got", scan.visibility(F.col("lang"), F.col("name"), F.col("sig"))).orderBy("k").collect()
    assert [r.got for r in got] == [r[3] for r in rows] == [visibility(*r[:3]) for r in rows]
