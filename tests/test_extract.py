import pytest

from sylva.extract.mask import mask
from sylva.extract.scanner import extract, language_of

SAMPLES = {
    "python": (
        'import os\nimport a.b as c\nfrom typing import Any\nfrom . import x\n"""\ndef not_one(): pass\n"""\nLIMIT = 3\nlower = 4\n\n@deco\ndef outer(a, b=1):\n    def inner(): return call(a)\n    return obj.run(a)\n\nclass Box(Base):\n    size: int = 0\n    _hid: str\n    plain = 3\n\n    @property\n    def get(self): ...\n    async def _go(self): ...\n',
        [("LIMIT", "constant", 8), ("outer", "function", 12), ("inner", "function", 13), ("Box", "class", 16), ("size", "field", 17), ("_hid", "field", 18), ("get", "method", 22), ("_go", "method", 23)],
        ["os", "typing"], ["call", "run"], {"_hid", "_go"},
    ),
    "typescript": (
        "import { a } from './x';\nimport 'side';\n// function no() {}\nexport const MAX_N = 1;\nexport const low = 2;\nexport default class Shape<T> extends Base {\n  private area = 0;\n  name?: string;\n  constructor(w: number) { super(w); }\n  async draw<T>(c: T): Promise<void> {\n    if (c) { this.fill(c); }\n  }\n  protected hide() {}\n}\ninterface Opt {\n  depth: number;\n}\ntype Id = string | 'function f() {';\nenum Mode { A, B }\nconst go = async (x) => run(new Shape(x));\n",
        [("MAX_N", "constant", 4), ("Shape", "class", 6), ("area", "field", 7), ("name", "field", 8), ("constructor", "method", 9), ("draw", "method", 10), ("hide", "method", 13), ("Opt", "interface", 15), ("depth", "field", 16), ("Id", "type", 18), ("Mode", "enum", 19), ("go", "function", 20)],
        ["'./x'", "'side'"], ["fill", "run"], {"area", "hide"},
    ),
    "rust": (
        "use std::fs;\npub(crate) use a::{b,\n    c};\n#[cfg(test)]\n// why\nmod checks {\n    use gone::x;\n    fn hidden() { lost(); }\n}\nmod tests { fn also() {} }\npub const N: u8 = 1;\nstatic mut G: u8 = 2;\npub struct P<T> {\n    pub x: T,\n    y: u8,\n}\npub trait Go {\n    fn must(&self);\n    fn can(&self) { help::<u8>(1); }\n}\nimpl<T> P<T> {\n    pub fn new(x: T) -> Self { Vec::with_capacity(3) }\n    async unsafe fn raw(&self) {}\n}\nenum E { A(u8), B }\ntype T1 = u8;\nmacro_rules! m { () => {} }\nfn free() { let s = \"fn not() {\"; it.map(f) }\n",
        [("N", "constant", 11), ("G", "constant", 12), ("P", "class", 13), ("x", "field", 14), ("y", "field", 15), ("Go", "interface", 17), ("must", "method", 18), ("can", "method", 19), ("new", "method", 22), ("raw", "method", 23), ("E", "enum", 25), ("T1", "type", 26), ("m", "function", 27), ("free", "function", 28)],
        ["use a::{b, c};", "use std::fs;"], None, None,
    ),
    "go": (
        'package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\nimport "one"\nconst (\n\tA = 1\n\tb\n)\nconst C = 2\ntype S struct {\n\tName string\n\tin int\n}\ntype I interface { Do() }\nfunc (s *S) M() { fmt.Println(helper(1)) }\nfunc helper(x int) int { return x }\n',
        [("A", "constant", 8), ("b", "constant", 9), ("C", "constant", 11), ("S", "class", 12), ("Name", "field", 13), ("in", "field", 14), ("I", "interface", 16), ("M", "method", 17), ("helper", "function", 18)],
        ['"fmt"', '"one"', 'x "a/b"'], None, {"b", "in", "helper"},
    ),
    "java": (
        "import java.util.List;\nimport static a.B.c;\n/* class No {} */\npublic class K<T> {\n  private int n;\n  static final String S = \"x(\";\n  public K(int n) { this.n = n; }\n  protected List<String> all(int a) { return make(new K(a)); }\n  interface Inner {\n    void go();\n  }\n}\nenum Z { A, B }\n",
        [("K", "class", 4), ("n", "field", 5), ("S", "field", 6), ("K", "method", 7), ("all", "method", 8), ("Inner", "interface", 9), ("go", "method", 10), ("Z", "enum", 13)],
        ["a.B.c", "java.util.List"], ["make"], {"n", "all"},
    ),
    "c": (
        '#include "a/b.h"\n#include <stdio.h>\n#define F(x) g(x)\nstruct node {\n  int v;\n  struct node *next;\n};\nstruct fwd;\ntypedef unsigned long ulong_t;\nenum color { RED };\nint decl(int a);\nstatic char *own(const char *s) { return dup(s); }\nint main(void)\n{\n  return own("int no(void) {");\n}\n',
        [("node", "class", 4), ("v", "field", 5), ("next", "field", 6), ("ulong_t", "type", 9), ("color", "enum", 10), ("decl", "function", 11), ("own", "function", 12), ("main", "function", 13)],
        ["a/b.h"], ["dup", "own"], {"own"},
    ),
    "cpp": (
        '#include "x.hpp"\nnamespace n {\nclass W : public B {\n  int id;\npublic:\n  W();\n  ~W();\n  virtual int size() const { return count(id); }\nprotected:\n  void mine(int);\n};\nstruct Q { int a; };\nenum class M { A };\nusing Id = int;\ntypedef int Old;\n}\nint W::size() const { return 1; }\nstatic int local(int x) { return x; }\n',
        [("n", "module", 2), ("W", "class", 3), ("id", "field", 4), ("W", "method", 6), ("~W", "method", 7), ("size", "method", 8), ("mine", "method", 10), ("Q", "class", 12), ("a", "field", 12), ("M", "enum", 13), ("Id", "type", 14), ("Old", "type", 15), ("size", "function", 17), ("local", "function", 18)],
        ["x.hpp"], None, {"id", "mine", "local"},
    ),
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_declarations(lang):
    text, symbols, imports, refs, private = SAMPLES[lang]
    got = extract(text, lang)
    assert [(n, k, line) for line, n, k, _, _ in got.symbols] == symbols
    assert got.imports == imports
    assert refs is None or got.refs == refs
    assert private is None or {n for _, n, _, _, v in got.symbols if v == "private"} == private
    assert all(sig == text.split("\n")[line - 1].strip() for line, _, _, sig, _ in got.symbols)


def test_rust_tests_vanish():
    got = extract(SAMPLES["rust"][0], "rust")
    assert not {"lost", "hidden"} & ({n for _, n, *_ in got.symbols} | set(got.refs))
    assert {"with_capacity", "help", "map"} <= set(got.refs)


FRAGMENTS = ["", "\0\1\2", "(" * 5000, "x" * 100_000, "\n" * 50_000, '"unclosed', "/* open", "def f(:\n class", "class {", "}}}}", "fn fn fn", "é" * 99, "'''", "`", "#include", "import (", "use ;", "@", "struct {", "\\\n" * 50]


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_never_raises(lang):
    text = SAMPLES[lang][0]
    for t in [*FRAGMENTS, *(text[:k] for k in range(0, len(text), 7)), *(text[k:] for k in range(0, len(text), 31))]:
        got = extract(t, lang)
        assert got.lines >= 0 and len({(line, n) for line, n, *_ in got.symbols}) == len(got.symbols)
        assert len(mask(t, lang)) == len(t)


def test_languages():
    assert [language_of(x) for x in ("a/b.py", "x.d.ts", "A.PY", ".py", "noext", "a.hpp", "a.h")] == ["python", "typescript", None, None, None, "cpp", "c"]


def test_line_numbers():
    assert [extract(t, "go").lines for t in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]


ONE_LINE = {
    "cpp": [
        ("class A { public: int x, y; void g(); private: int z; };", [("A", "class", "public"), ("g", "method", "public"), ("x", "field", "public"), ("y", "field", "public"), ("z", "field", "private")]),
        ("struct S { int a = f(1, 2), b; ~S(); };", [("S", "class", "public"), ("a", "field", "public"), ("b", "field", "public"), ("~S", "method", "public")]),
        ("namespace n { int f(int a) { return g(a); } int h(); }", [("f", "function", "public"), ("h", "function", "public"), ("n", "module", "public")]),
        ("static int\nlong_one(int a,\n         int b)\n{\n  return 1;\n}", [("long_one", "function", "public")]),
    ],
    "c": [
        ("struct p { int x, *y; char s[4]; }; int f(void); int g(void) { return f(); }", [("f", "function", "public"), ("g", "function", "public"), ("p", "class", "public"), ("s", "field", "public"), ("x", "field", "public"), ("y", "field", "public")]),
        ("for (int i = 0; i < 3; i++) { int j; }", []),
    ],
    "typescript": [
        ("class B { a = 1; private c: string; b() { return d(); } e(x: number) {} }", [("B", "class", "public"), ("a", "field", "public"), ("b", "method", "public"), ("c", "field", "private"), ("e", "method", "public")]),
        ("interface I { a: string, b?: Map<string, number>; c: () => void }", [("I", "interface", "public"), ("a", "field", "public"), ("b", "field", "public"), ("c", "field", "public")]),
    ],
    "rust": [
        ("struct S { pub a: u32, b: HashMap<String, u8> }", [("S", "class", "private"), ("a", "field", "private"), ("b", "field", "private")]),
        ("impl S { pub fn a(&self) {} fn b() { c(); } }", [("a", "method", "private"), ("b", "method", "private")]),
        ("pub const A: u8 = 1; const B: u8 = 2;", [("A", "constant", "public"), ("B", "constant", "public")]),
        ("mod tests { fn no() {} } fn yes() {}", [("yes", "function", "private")]),
    ],
    "go": [("type T struct { a, b int; C string }", [("C", "field", "public"), ("T", "class", "public"), ("a", "field", "private"), ("b", "field", "private")])],
    "java": [("class K { int a = 1, b; private String s; void m() { n(); } }", [("K", "class", "public"), ("a", "field", "public"), ("b", "field", "public"), ("m", "method", "public"), ("s", "field", "private")])],
}


@pytest.mark.parametrize("lang", sorted(ONE_LINE))
def test_several_declarations_a_line(lang):
    for text, expected in ONE_LINE[lang]:
        got = sorted({(n, k) for _, n, k, _, _ in extract(text, lang).symbols})
        assert got == sorted({(n, k) for n, k, _ in expected}), text
    if lang == "cpp":
        assert {(n, v) for _, n, k, _, v in extract(ONE_LINE["cpp"][0][0], "cpp").symbols if k in ("field", "method")} == {("x", "public"), ("y", "public"), ("g", "public"), ("z", "private")}
