import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import entry, quality


def test_density_difference_is_that_of_two_normals():
    rng = np.random.default_rng(1)
    n, d = 400, quality.SIZE
    x = {k: rng.normal(k, 1 + k, (n, d)) for k in (0, 1)}
    model = quality.fit({k: (float(n), v.sum(0), v.T @ v) for k, v in x.items()})
    pooled = sum(np.cov(v.T, bias=True) for v in x.values()) / 2
    probe, logs = rng.normal(0.5, 2, (50, d)), []
    for k, v in x.items():
        own = 0.9 * np.cov(v.T, bias=True) + 0.1 * pooled
        own = 0.9 * own + 0.1 * np.diag(np.diag(own)) + np.diag(np.diag(pooled)) * quality.RIDGE
        z = probe - v.mean(0)
        logs.append(-0.5 * (z @ np.linalg.inv(own) * z).sum(1) - 0.5 * np.linalg.slogdet(own)[1])
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30))), atol=1e-6)


def test_statistics_of_odd_texts():
    for t in (None, b"", b"\n\n", b" ", b"x" * 300_000, "é\n".encode() * 7):
        row = quality.statistics(t)
        assert len(row) == quality.SIZE and np.isfinite(row).all()


def test_commonest_word_is_counted_over_the_whole_text():
    at = quality.FEATURES.index("top_word")
    periodic = [b"a" if i % 2 == 0 else b"w%d" % i for i in range(4096)]
    block = [b"w%d" % i for i in range(20_000)]
    block[10_001:10_039] = [b"a"] * 38
    for words in (periodic, block):
        share = words.count(b"a") / len(words)
        assert np.isclose(quality.statistics(b" ".join(words))[at], np.arcsin(np.sqrt(share)))


def plain_statistics(text):
    """The features by their names, counted one by one."""
    text = text or b""
    n = max(1, len(text))
    root = lambda share: np.arcsin(np.sqrt(min(1, max(0, share))))
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    m, k = max(1, len(words)), max(1, len(lines))
    out = [root(sum(c in chars for c in text) / n) for chars in quality.CLASSES.values()] + [root(sum(c > 127 for c in text) / n)]
    out += [np.log1p(len(words)), np.log1p(n / m), root(sum(len(w) > 12 for w in words) / m), root(len(set(words)) / m), root(max([words.count(w) for w in set(words)], default=0) / m)]
    out += [root(sum(a == b for a, b in zip(words, words[1:])) / m), np.log1p(len(lines)), root(1 - len(set(lines)) / k), root(sum(x[-1:] in (b".", b"!", b"?") for x in lines) / k)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.binary(max_size=120), st.text("aB. \n!é1|", max_size=200).map(str.encode)))
def test_statistics_by_brute_force(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text))


def test_scores_by_brute_force(spark):
    """From texts and labels to scores by plain sums; repeated labels count once, rows of one id with each of its labels."""
    rng = np.random.default_rng(6)
    rows = [(k % 90, " ".join(rng.choice(["Ab", "c.", "dd", "1", "!"], rng.integers(1, 30)))) for k in range(100)]
    labels = [(k, int(k % 3 == 0)) for k in range(80)] + [(k, int(k % 3 == 0)) for k in range(10)] + [(5, 1), (None, 1), (6, 9)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    x = np.array([plain_statistics(t.encode()) for _, t in rows])
    marks = {(i, y) for i, y in labels if i is not None and y in (0, 1)}
    own = {y: np.array([x[k] for k, (i, _) in enumerate(rows) if (i, y) in marks]) for y in (0, 1)}
    spread = {y: np.cov(v.T, bias=True) for y, v in own.items()}
    total = sum(map(len, own.values()))
    pooled = sum(len(own[y]) * spread[y] for y in own) / total
    logs = []
    for y, v in own.items():
        c = (1 - quality.POOLED) * spread[y] + quality.POOLED * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + np.diag(np.maximum(np.diag(pooled), 1e-4)) * quality.RIDGE
        z = x - v.mean(0)
        logs.append(np.log((len(v) + 0.5) / (total + 1)) - 0.5 * (z @ np.linalg.inv(c) * z).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    expected = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
    assert np.allclose(sorted(r.score for r in got), sorted(expected), atol=1e-6) and len(got) == len(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one two. three", 5), (3, "one two. three", 5), (None, "a", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = quality.score(docs, some).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), labels).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.op6_quality(spark, sf).join(entry.table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.98
