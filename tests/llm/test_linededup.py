import random
from collections import defaultdict

import numpy as np
import pytest

from sylva.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: x.strip(SPACE).translate(LOW)
    held = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= 40:
                held[x].append((-(1 << 63) if i is None else i, k))
    out = []
    for k, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        stay = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)])[0] == own]
        out.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out)


def cases():
    rng = random.Random(6)
    common = [c * 39 + d for c in "abcé" for d in ("", "x", "Xy")] + ["ß" * 13 + " " + "日" * 26, "日" * 39, "Q" * 40]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", " ", "\t"]) + (x := rng.choice(common)) + rng.choice(["", " \r", "\x0c"]) if rng.random() < 0.6 else f"line {i} {k} " + "z" * rng.randrange(60) for k in range(rng.randrange(8))]
        rows.append((i, "\n".join(lines)))
    return rows + [(70, None), (71, ""), (72, "\n\n"), (None, common[1] + "\nq"), (5, common[1]), (73, (common[2] + "\n") * 3000), (59, rows[59][1])]


@pytest.mark.parametrize("probes, shard", [(linededup.PART_PROBES, linededup.SHARD_KEYS), (linededup.PART_PROBES, 2), (1, 2), (5, 100)])
def test_against_brute_force(spark, monkeypatch, probes, shard):
    """Small shards, and shards split for nearly every probe, give the same rows; columns named as the helpers are kept."""
    monkeypatch.setattr(linededup, "HEAVY_SHARE", 0.0)
    rows = cases()
    frame = spark.createDataFrame([(i, t, "clash", 2, "s", 7, 8, "9") for i, t in rows], "doc_id long, text string, n_lines string, a int, h string, row_h int, lost_id int, `drop` string")
    out = linededup.dedup(frame, part_probes=probes, shard_keys=shard)
    assert out.columns == ["doc_id", "text", "a", "h", "row_h", "lost_id", "drop", "n_lines", "n_dropped"]
    got = out.collect()
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got) == brute(rows)
    assert {tuple(r)[2:7] for r in got} == {(2, "s", 7, 8, "9")}


def test_the_count_array_decides(spark):
    """Lines under the threshold are in the tables too."""
    line = "x" * 45
    frame = spark.createDataFrame([(k, line + ("" if k < 4 else "y")) for k in range(9)], "doc_id long, text string")
    assert {r.n for r in linededup.line_counts(frame).collect()} == {4, 5}
    assert {r.doc_id: r.n_dropped for r in linededup.dedup(frame).collect()} == {k: int(3 < k < 8) for k in range(9)}


def test_empty_table(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    b[: n // 2] = b[0] if n else 0
    counts, last = np.arange(n) + 5, np.arange(n) * 3
    table = linededup.Table.load(linededup.Table.build(a, b, counts, last).dump())
    got = table.probe(a, b)
    assert (got[0] == counts).all() and (got[1] == last).all() and len(table.prints) == n
    assert (table.probe(*(rng.integers(0, 1 << 64, 1000, np.uint64) for _ in range(2)))[0] == 0).all()
