import hashlib
import random
import re
import zlib

import pytest

from sylva.llm import common, decontam


def tokens(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    out = []
    for i, t in docs:
        ws, hit, items = tokens(t), set(), set()
        for k, b in bench:
            bw = tokens(b)
            m = min(10, len(bw))
            if k is None or not m:
                continue
            wins = {tuple(bw[a : a + m]) for a in range(len(bw) - m + 1)}
            for a in range(len(ws) - m + 1):
                if tuple(ws[a : a + m]) in wins:
                    hit |= set(range(a, a + m))
                    items.add(str(k))
        out.append((i, len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    text = lambda n, v: " ".join(rng.choice("abcdefgh"[:v]) for _ in range(n))
    bench = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 30]), rng.choice([2, 4, 8]))) for k in range(25)]
    bench += [(100, None), (101, ""), (102, "..."), (None, "a b"), (103, bench[3][1]), (104, "Ünïq  wörd-x")]
    docs = [(k, text(rng.randrange(0, 120), rng.choice([2, 5, 8]))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "--"), (503, "ÜNÏQ wörd X ünïq"), (503, "ÜNÏQ wörd X ünïq"), (504, "Ünïq WÖRD x"), (None, "a b"), (505, "zz " * 60_000 + bench[5][1])]
    return docs, bench


@pytest.mark.parametrize("slots, bits, together", [(decontam.SLOTS, decontam.BITS, common.TOGETHER), (16, 128, 2)])
def test_against_brute_force(spark, monkeypatch, slots, bits, together):
    """Tables so small that nearly all positions pass, and buckets that are split, give the same rows."""
    if slots == 16:
        monkeypatch.setattr(decontam, "PAGE", 16)
    monkeypatch.setattr(decontam, "SLOTS", slots)
    monkeypatch.setattr(decontam, "BITS", bits)
    monkeypatch.setattr(common, "TOGETHER", together)
    docs, bench = cases()
    frame = spark.createDataFrame([(*d, "clash", 1, "x") for d in docs], "doc_id long, text string, hits string, key int, bad_key string")
    items = spark.createDataFrame([(*b, 3) for b in bench], "item_id long, text string, m int")
    got = decontam.contamination(frame, items).drop("hits").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, bench)
    out = decontam.drop_contaminated(frame, items)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in brute(docs, bench) if not r[-1])


def test_shifts_skip_words():
    window = [f"w{k}".encode() for k in range(10)]
    own = decontam.Searcher(10, 1 << 16, 1 << 20)
    own.add(window)
    slot = lambda k: own.shift[zlib.crc32(b" ".join(window[k - 1 : k + 1])) & 0xFFFF]
    assert [slot(k) for k in (9, 8, 1)] == [0, 1, 8] and sorted(set(own.shift)) == list(range(10))
    (own,) = decontam.loaded({10: (bytes(own.shift), bytes(own.bits))})
    assert list(own.search([b"x"] * 1000)) == []
    assert list(own.search([b"w0", *window, *window])) == [(1, b" ".join(window)), (11, b" ".join(window))]


def test_tables_are_put_together_by_pages(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PAGE", 64)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([4, 30])))) for k in range(40)]
    known = decontam.windows(spark.createDataFrame(rows, "item_id long, text string").repartition(5))
    got = decontam.searchers(known)
    for m, (shift, bits) in got.items():
        whole = decontam.Searcher(m, len(shift), 8 * len(bits))
        for r in known.filter(f"m = {m}").collect():
            whole.add(bytes(r.win).split(b" "))
        assert bytes(whole.shift) == shift and bytes(whole.bits) == bits
    assert sorted(got) == [4, 10]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(docs, none).collect()] == [False]
    assert decontam.contamination(docs.limit(0), none).collect() == []
