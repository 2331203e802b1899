import io
import json
import os
import subprocess
import xml.dom.minidom

import pytest

from sylva import api, budget, cli
from sylva.server import Server, parse_anchor, serve
from sylva.sources.cache import Cache
from sylva.sources.tree import NoSupportedFiles, Revision, list_files
from sylva.streaming import refresh

FILES = {
    "app/main.py": "import app.util\nfrom app import util\n\n\ndef main(argv: list) -> int:\n    return util.parse(argv)\n",
    "app/util.py": "LIMIT = 3\n\n\ndef parse(argv: list) -> int:\n    return _own(argv)\n\n\ndef _own(x):\n    return x\n\n\nclass Box:\n    size: int = 0\n",
    "lib/point.rs": "use crate::lib::line;\npub struct Point {\n    pub x: u8,\n}\nimpl Point {\n    pub fn new(x: u8) -> Self { parse(x) }\n}\n",
    "lib/line.rs": "pub fn draw() {}\n",
    "tests/test_util.py": "import app.util\n\n\ndef test_parse():\n    app.util.parse([])\n",
    "node_modules/x.js": "function no() {}\n",
    ".hidden/y.py": "def no(): pass\n",
    "gen/z.py": "def no(): pass\n",
    "README.md": "# no\n",
    ".gitignore": "gen/\n",
}


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "repo"
    for rel, content in FILES.items():
        (at / rel).parent.mkdir(parents=True, exist_ok=True)
        (at / rel).write_text(content)
    (at / "app/bad.py").write_bytes(b"\xff\xfe\x00def")
    os.symlink(at / "app/util.py", at / "app/linked.py")
    return str(at)


def test_walk(root):
    assert list_files(root) == ["README.md", "app/bad.py", "app/main.py", "app/util.py", "gen/z.py", "lib/line.rs", "lib/point.rs", "tests/test_util.py"]


def test_map(spark, root):
    m = api.build_map(spark, root)
    assert [f.rel for f in m.files][0] == "app/util.py" and m.detail == "full" and m.skipped == 1 and m.total_files == 5
    assert len(m.files) + sum(n for _, n in m.collapsed) == m.total_files
    text = api.render_map(m)
    assert text == api.render_map(api.build_map(spark, root)) and budget.words(text) <= m.target
    assert "## app/util.py (#1 — imported by 2 file(s))" in text and "used by: app/main.py, tests/test_util.py" in text and "def parse(argv: list) -> int\n" in text
    assert json.loads(api.render_map(m, "json"))["repo"] == {"name": "repo", "loc": m.loc, "files": 5}
    assert xml.dom.minidom.parseString(api.render_map(m, "xml")).documentElement.tagName == "map"
    public = api.build_map(spark, root, api.MapOptions(no_private=True))
    assert public.detail == "public-only" and "_own" not in api.render_map(public)


@pytest.mark.parametrize("size", [40, 60, 90, 120, 200])
def test_ladder(spark, root, size):
    m = api.build_map(spark, root, api.MapOptions(budget=size))
    assert len(m.files) + sum(n for _, n in m.collapsed) == m.total_files
    assert m.rendered <= max(size, 60) and [f.rank for f in m.files] == sorted(f.rank for f in m.files)
    for form in ("md", "json", "xml"):
        assert api.render_map(m, form)


def test_large_file_stays_within_budget(spark, tmp_path):
    (tmp_path / "big.py").write_text("".join(f"def f{k}(a: int): pass\n" for k in range(4000)))
    (tmp_path / "use.py").write_text("import big\n\n\ndef go():\n    f7(f9(1))\n")
    m = api.build_map(spark, str(tmp_path))
    assert m.rendered <= 2048 * 1.1 and {f.rel for f in m.files} == {"big.py", "use.py"}
    assert {"f7", "f9"} <= {s.name for f in m.files if f.rel == "big.py" for s in f.symbols}


def test_lookups(spark, root):
    hits = api.find_symbol(spark, root, "parse")
    assert [(h.rel, h.line, h.anchor) for h in hits] == [("app/util.py", 4, "app/util.py#parse")]
    assert api.find_symbol(spark, root, "_own", api.MapOptions(no_private=True)) == []
    found = api.expand_symbol(spark, root, "app/util.py", "parse")
    assert found.signature == "def parse(argv: list) -> int:" and found.used_by == ["app/main.py", "tests/test_util.py"] and found.imports == []
    assert api.expand_symbol(spark, root, "app/util.py", "gone") is None and api.expand_symbol(spark, root, "app/util.py", "parse", 9) is None
    index = api.build_symbol_index(spark, root)
    kinds = [e["kind"] for e in index["entries"]]
    assert set(kinds[:2]) == {"class"} and index["rendered"] <= 2048 and "function app/util.py#parse" in index["text"]
    row = api.explain(spark, root, "app/util.py", api.MapOptions(focus=["app"]))
    assert row.imported_by == 2 and row.focus


def test_anchors():
    assert parse_anchor("a#b") == ("a", "b", None) and parse_anchor("a#b@12") == ("a", "b", 12) and parse_anchor("a#b#c@x") == ("a", "b#c@x", None)
    assert parse_anchor("#b") is None and parse_anchor("a#") is None and parse_anchor("a") is None


def test_errors(spark, tmp_path, root):
    (tmp_path / "x.rb").write_text("x")
    with pytest.raises(NoSupportedFiles, match="Ruby"):
        api.build_map(spark, _only(tmp_path, "x.rb"))
    with pytest.raises(ValueError, match="no files of go"):
        api.build_map(spark, root, api.MapOptions(langs=["go"]))


def _only(tmp_path, name):
    at = tmp_path / "only"
    at.mkdir()
    os.rename(tmp_path / name, at / name)
    return str(at)


def test_cache(spark, root):
    opts = api.MapOptions(cache=True)
    cold = api.render_map(api.build_map(spark, root, opts))
    assert api.render_map(api.build_map(spark, root, opts)) == cold
    cache = Cache(spark, root)
    assert cache.info()["entries"] == 5 and cache.info()["self_ignored"]
    os.unlink(f"{root}/lib/line.rs")
    with open(f"{root}/lib/point.rs", "a") as f:
        f.write("pub fn late() {}\n")
    assert "late" in api.render_map(api.build_map(spark, root, opts)) and cache.info()["entries"] == 4
    for d, _, names in os.walk(cache.path):
        for n in names:
            with open(os.path.join(d, n), "wb") as f:
                f.write(b"junk")
    assert "late" in api.render_map(api.build_map(spark, root, opts))
    assert cache.clean() and not cache.clean()


def test_diff(spark, root, tmp_path):
    import shutil

    new = str(tmp_path / "new")
    shutil.copytree(root, new, symlinks=True)
    assert api.diff(spark, root, new).empty
    os.rename(f"{new}/lib/line.rs", f"{new}/lib/moved.rs")
    os.unlink(f"{new}/tests/test_util.py")
    with open(f"{new}/app/util.py", "w") as f:
        f.write("import os\nLIMIT = 3\ndef parse(argv: list, more: int) -> int:\n    return 1\nclass Box:\n    size: int = 0\nclass _own:\n    pass\n")
    with open(f"{new}/app/added.py", "w") as f:
        f.write("class New:\n    def run(self): ...\n")
    d = api.diff(spark, root, new)
    assert [(f.rel, f.new_rel) for f in d.moved] == [("lib/line.rs", "lib/moved.rs")]
    assert [f.rel for f in d.added] == ["app/added.py"] and [f.rel for f in d.removed] == ["tests/test_util.py"]
    assert [r for r, _ in d.changed] == ["app/util.py"] and d.breaking
    text = d.render("md", "a", "b")
    assert "~ function parse: def parse(argv: list) -> int: → def parse(argv: list, more: int) -> int:" in text and "± _own: function def _own(x): → class class _own:" in text and "imports +: os" in text
    assert json.loads(d.render("json", "a", "b"))["moved_files"][0]["new"] == "lib/moved.rs"
    xml.dom.minidom.parseString(d.render("xml", "a", "b"))


def test_revisions(spark, root, capsys):
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    with open(f"{root}/app/util.py", "a") as f:
        f.write("def extra(): pass\n")
    with Revision("HEAD", root) as at:
        assert os.path.exists(f"{at}/app/util.py")
    assert not os.path.exists(at)
    with pytest.raises(ValueError):
        Revision("no-such", root).__enter__()
    here = os.getcwd()
    os.chdir(root)
    try:
        assert cli.main(["diff", "HEAD"], spark) == 0
        assert "+ def extra(): pass" in capsys.readouterr().out
    finally:
        os.chdir(here)


def test_command_line(spark, root, tmp_path, capsys):
    out = str(tmp_path / "map.md")
    assert cli.main([root, "--no-cache", "--output", out], spark) == 0
    assert cli.main([root, "--no-cache", "--check", out], spark) == 0
    with open(out, "a") as f:
        f.write("x")
    assert cli.main([root, "--no-cache", "--check", out], spark) == 1 and cli.main([root, "--no-cache", "--check", out + "no"], spark) == 2
    assert cli.main([root, "--no-cache", "--for-agent", "--preset", "small", "--color", "always"], spark) == 0
    shown = capsys.readouterr().out
    assert "agent note" in shown and "\x1b[" in shown
    for bad in (["--budget", "0"], ["--budget", "9", "--preset", "small"], ["--for-agent", "--format", "json"], ["--lang", "cobol"], ["--focus", "nowhere"], ["--output", str(tmp_path)]):
        assert cli.main([root, "--no-cache", *bad], spark) == 2
    assert cli.main(["map", "/no/such/dir"], spark) == 2
    assert cli.main(["explain", "app/util.py", root], spark) == 0 and cli.main(["explain", "nope.py", root], spark) == 2
    assert cli.main(["doctor", root], spark) == 0 and cli.main(["cache", "info", root], spark) == 0 and cli.main(["cache", "clean", root], spark) == 2
    assert "python: 4 file(s)" in capsys.readouterr().out


def test_server(spark, root):
    ask = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "ping"},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_symbol", "arguments": {"name": "parse", "lang": "python,rust"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "get_map", "arguments": {"path": "../.."}}},
        {"jsonrpc": "2.0", "id": 6, "method": "no"}, {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "expand_symbol", "arguments": {"anchor": "app/util.py#parse"}}},
    ]
    out = io.StringIO()
    serve(spark, root, io.StringIO("\n\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in got] == [1, 2, 3, 4, 5, 6, 7, None]
    assert json.loads(got[3]["result"]["content"][0]["text"])[0]["rel"] == "app/util.py" and got[4]["result"]["isError"]
    assert got[5]["error"]["code"] == -32601 and got[7]["error"]["code"] == -32700
    assert json.loads(got[6]["result"]["content"][0]["text"])["used_by"] == ["app/main.py", "tests/test_util.py"]
    server = Server(spark, root)
    assert "# map:" in server.call("get_map", {"budget": 500, "focus": ["app/util.py"]}) and json.loads(server.call("get_symbol_index", {}))["entries"]


def test_server_survives_bad_requests(root):
    out = io.StringIO()
    call = lambda number, **params: {"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": params}
    ask = [
        {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": [1]}, [], 5, {"id": 2}, call(3, name="get_map", arguments=[1]), call(4, name="get_map", arguments={"path": 5}), call(5, name="nothing"), call(6),
        call(7, name="get_symbol", arguments={"path": ".", "lang": 3}), call(8, name="get_symbol", arguments={"path": "."}), call(9, name="get_map", arguments={"path": ".", "budget": "x"}), call(10, name="expand_symbol", arguments={"anchor": 3}),
        call(11, name="get_symbol", arguments={"path": ".", "name": "f"}), {"jsonrpc": "2.0", "id": 12, "method": "ping"},
    ]
    serve(None, root, io.StringIO("\n".join(map(json.dumps, ask)) + "\n{\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in got] == [1, None, None, None, 3, 4, 5, 6, 7, 8, 9, 10, None, 12, None]
    assert [a["error"]["code"] for a in got if "error" in a] == [-32602, -32600, -32600, -32600, -32603, -32700]
    assert all(a["result"]["isError"] for a in got[4:12])


def test_tool_schemas():
    from sylva.server import TOOLS

    for t in TOOLS:
        own = t["inputSchema"]
        assert "path" in own["required"] and {"no_private", "lang"} <= set(own["properties"]) and set(own["required"]) <= set(own["properties"])
        assert all("description" in p for p in own["properties"].values())


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from sylva import store

    conf = SimpleNamespace(get=lambda key, default: default, set=lambda *a: None)
    with pytest.raises(RuntimeError):
        store.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert store.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"


def test_watch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame([(*x, None) for x in r], "rel string, lang string, content string, seen string").selectExpr("rel", "lang", "content", "current_timestamp() as seen").write.mode("append").parquet(src)
    rows(("a.py", "python", "def one(): pass"), ("b.py", "python", "def two(): pass"))
    refresh.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    rows(("a.py", "python", "def three(): pass"), ("b.py", "python", None))
    refresh.watch(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{out}/1").collect()
    assert [(r.rel, [s.name for s in r.symbols]) for r in got] == [("a.py", ["three"])]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_no_wide_row_is_lost_in_numbering(spark, adaptive):
    import random

    from sylva.operators import scan

    random.seed(3)
    rows = [(f"d{k % 7}/f{k:04}.py", random.randbytes(16_000).hex()) for k in range(1000)]
    random.shuffle(rows)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, adaptive)
    try:
        frame = spark.createDataFrame(rows, "rel string, content string").repartition(6)
        got = scan.number(frame).selectExpr("rel", "file_id", "length(content) as n").collect()
    finally:
        spark.conf.set(key, before)
    assert [(r.rel, r.file_id) for r in sorted(got, key=lambda r: r.file_id)] == [(rel, k) for k, rel in enumerate(sorted(r for r, _ in rows))]
    assert {r.n for r in got} == {32_000}


def test_every_file_of_a_larger_tree_is_mapped(spark, tmp_path):
    import random

    random.seed(4)
    for k in range(256):
        at = tmp_path / "big" / f"p{k % 9}" / f"m{k}.py"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"def name_{k}(x):\n    return x\n\n\nTEXT = '{random.randbytes(16_000).hex()}'\n")
    m = api.build_map(spark, str(tmp_path / "big"))
    assert (m.total_files, m.skipped) == (256, 0)
    assert len(api.find_symbol(spark, str(tmp_path / "big"), "name_255")) == 1


def test_numbering_nothing(spark):
    from sylva.operators import scan

    assert scan.number(spark.createDataFrame([], "rel string, content string")).collect() == []
