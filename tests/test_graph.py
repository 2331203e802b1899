import numpy as np
import pytest

from sylva import budget
from sylva.operators import link, rank, score


def brute(n, arcs, p, rounds=20):
    v = np.array(p)
    for _ in range(rounds):
        new = np.zeros(n)
        out = np.bincount([a for a, _ in arcs], minlength=n) if arcs else np.zeros(n)
        for a, b in arcs:
            new[b] += v[a] / out[a]
        new = 0.15 * np.array(p) + 0.85 * (new + v[out == 0].sum() * np.array(p))
        if np.abs(new - v).sum() < 1e-9:
            return new
        v = new
    return v


@pytest.mark.parametrize("small", [1000, -1])
def test_pagerank(spark, small):
    rng = np.random.default_rng(1)
    n, arcs = 12, sorted({(int(a), int(b)) for a, b in rng.integers(0, 9, (25, 2)) if a != b})
    w = rng.random(n)
    points = spark.createDataFrame([(k, None, float(w[k] / w.sum())) for k in range(n)], "file_id long, sym_id int, p double")
    links = spark.createDataFrame([(a << 32, b << 32) for a, b in arcs], "src long, dst long")
    got = {r.file_id: r.score for r in rank.pagerank(points, links, small=small).collect()}
    assert np.allclose([got[k] for k in range(n)], brute(n, arcs, w / w.sum()), atol=1e-8) and abs(sum(got.values()) - 1) < 1e-9


@pytest.mark.parametrize("small", [1000, -1])
def test_graphs_without_edges_or_nodes(spark, small):
    points = spark.createDataFrame([(0, None, 0.5), (1, None, 0.5)], "file_id long, sym_id int, p double")
    links = spark.createDataFrame([], "src long, dst long")
    assert [round(r.score, 9) for r in rank.pagerank(points, links, small=small).collect()] == [0.5, 0.5]
    assert rank.pagerank(points.limit(0), links, small=small).collect() == []


def test_teleport(spark):
    nodes = spark.createDataFrame([(0, None, 1.0), (0, 0, 1.0), (1, None, 0.25)], "file_id long, sym_id int, w double")
    p = lambda seeds=None: {(r.file_id, r.sym_id): round(r.p, 6) for r in rank.teleport(nodes, seeds).collect()}
    assert p() == {(0, None): 0.444444, (0, 0): 0.444444, (1, None): 0.111111}
    assert p(spark.createDataFrame([(1,), (9,)], "file_id long")) == {(0, None): 0, (0, 0): 0, (1, None): 1}
    assert p(spark.createDataFrame([(9,)], "file_id long")) == p()


def test_footer(spark):
    rels = [f"d{k % 20}/e{k}/f.py" for k in range(60)] + ["root.py"]
    got = {r.dir: r.n for r in score.footer_groups(spark.createDataFrame([(r,) for r in rels], "rel string")).collect()}
    assert got == {f"d{k}": 3 for k in range(20)} | {".": 1}
    few = {r.dir: r.n for r in score.footer_groups(spark.createDataFrame([("a/b/c.py",), ("a/x/d.py",), ("e.py",)], "rel string")).collect()}
    assert few == {"a/b": 1, "a/x": 1, ".": 1}


def test_footer_of_the_rest():
    from collections import Counter

    footer = budget.Footer({1: Counter({"a": 2, ".": 1}), 2: Counter({"a/b": 1, "a/c": 1, ".": 1})}, 2)
    assert footer.without([]) == ((".", 1), ("a/b", 1), ("a/c", 1)) and footer.without(["a/b/x.py", "r.py"]) == (("a/c", 1),)


def called(spark):
    """Files 0 to 4 with symbols, imports and calls; file 1 calls a name that it defines itself, file 4 has nothing."""
    symbols = spark.createDataFrame([(0, 0, "f"), (0, 1, "g"), (1, 0, "f"), (1, 1, "f"), (2, 0, "h")], "file_id long, sym_id int, name string")
    refs = spark.createDataFrame([(0, "f"), (0, "f"), (1, "f"), (1, "h"), (2, "g"), (3, "f"), (3, "none")], "file_id long, name string")
    imports = spark.createDataFrame([(0, 1), (2, 1), (3, 0), (1, 2)], "src long, dst long")
    files = spark.createDataFrame([(k, f"{'tests/' * (k == 3)}{k}.py") for k in range(5)], "file_id long, rel string")
    return files, symbols, refs, imports


@pytest.mark.parametrize("small", [1000, -1])
def test_ranks_by_name_are_those_of_all_edges(spark, small):
    files, symbols, refs, imports = called(spark)
    points = rank.teleport(rank.nodes(files, symbols))
    links = rank.edges(imports, link.reference_edges(refs, symbols))
    named = rank.named_references(refs, symbols)
    want = {(r.file_id, r.sym_id): r.score for r in rank.pagerank(points, links, stop=0.0).collect()}
    got = {(r.file_id, r.sym_id): r.score for r in rank.pagerank_by_name(points, imports, named, symbols, small=small).collect()}
    assert len(got) == 10 and got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-14)
    assert {(r.file_id << 32, r.n) for r in rank.out_degrees(imports, named).collect()} == {tuple(r) for r in rank.out_degree(links).collect()}
    none = imports.limit(0)
    want = {(r.file_id, r.sym_id): r.score for r in rank.pagerank(points, rank.edges(none, link.reference_edges(refs, symbols)), stop=0.0).collect()}
    got = {(r.file_id, r.sym_id): r.score for r in rank.pagerank_by_name(points, none, named, symbols, small=small).collect()}
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-14)
    assert rank.pagerank_by_name(points.limit(0), none, named.limit(0), symbols.limit(0), small=small).collect() == []


def test_edges_of_calls_are_neither_listed_for_ranks_nor_shuffled(spark, monkeypatch):
    """A thousand callers of a thousand definitions: a million edges, of which no query but their list makes rows."""
    n = 1000
    symbols = spark.range(n).selectExpr("id as file_id", "0 as sym_id", "'f' as name")
    refs = spark.range(n).selectExpr("id as file_id", "'f' as name")
    listed = link.reference_edges(refs, symbols)
    assert listed.count() == n * (n - 1)
    last = listed._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert "Aggregate" not in last
    monkeypatch.setattr(link, "reference_edges", lambda *_: pytest.fail("edges listed"))
    degrees = rank.out_degrees(spark.createDataFrame([], "src long, dst long"), rank.named_references(refs, symbols))
    assert {r.n for r in degrees.collect()} == {n - 1} and degrees.count() == n
