"""Quality: regularised quadratic discriminant over transformed document statistics.

Class means and covariances are sums over all labelled rows, taken on the
executors. Each covariance is shrunk towards its diagonal and towards the
pooled one; the inverse Cholesky factors are computed once and kept in the
model. The score is the logistic of the difference of the two log densities
(Mahalanobis distances and log determinants) plus the log prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Weight of the pooled covariance, of the diagonal, and the ridge in units of the pooled variance.
POOLED, DIAGONAL, RIDGE = 0.1, 0.1, 0.02
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "mark": b"!", "pipe": b"|", "sign": b"#$%&*@^~_+=<>\\/", "bracket": b"()[]{}\"'`", "space": b" \t\r\x0b\x0c", "line": b"\n"}
_TABLE = np.zeros((256, len(CLASSES) + 1))
for _k, _chars in enumerate(CLASSES.values()):
    _TABLE[list(_chars), _k] = 1
_TABLE[128:, -1] = 1
FEATURES = (*CLASSES, "high", "words", "word_length", "long_words", "distinct", "top_word", "repeats", "lines", "line_repeats", "stopped_lines")
SIZE = len(FEATURES)


def statistics(text: bytes | None) -> list[float]:
    """``FEATURES`` of a whole text: arcsine roots of shares, logarithms of counts."""
    text = text or b""
    n = max(1, len(text))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    k = max(1, len(lines))
    stopped = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    long = sum(len(w) > 12 for w in words)
    share = [*shares, long / m, len(seen) / m, max(seen.values(), default=0) / m, repeats / m, 1 - len(set(lines)) / k, stopped / k]
    a = np.arcsin(np.sqrt(np.clip(share, 0, 1)))
    c = len(CLASSES) + 1
    return [*a[:c].tolist(), float(np.log1p(len(words))), float(np.log1p(n / m)), float(a[c]), float(a[c + 1]), float(a[c + 2]), float(a[c + 3]), float(np.log1p(len(lines))), float(a[c + 4]), float(a[c + 5])]


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, log density at the mean, with the prior."""

    means: np.ndarray
    whiten: np.ndarray
    peaks: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [self.peaks[k] - 0.5 * (((x - self.means[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer sum of ``rows(x, y)`` by class; the driver gets ``SIZE`` squared numbers a class at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    z = np.hstack([np.ones((int((y == k).sum()), 1)), x[y == k]])
                    total[k] = total.get(k, 0) + z.T @ z
        for k, z in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * z.size, pa.int32()), pa.array(range(z.size), pa.int32()), pa.array(z.ravel())], ["y", "i", "v"])

    sums = rows.select("x", "y").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        z = np.zeros((SIZE + 1) ** 2)
        for r in sums:
            if r.y == k:
                z[r.i] = r.v
        z = z.reshape(SIZE + 1, SIZE + 1)
        out[k] = (z[0, 0], z[0, 1:], z[1:, 1:])
    return out


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """Without rows of a class its moments are those of the other, so that the prior alone speaks."""
    n = [sums[k][0] for k in (0, 1)]
    mean, spread = [], []
    for k in (0, 1):
        c, s, o = sums[k] if n[k] else sums[1 - k]
        m = s / max(c, 1)
        mean.append(m)
        spread.append(o / max(c, 1) - np.outer(m, m))
    total = max(sum(n), 1)
    pooled = sum(n[k] * spread[k] for k in (0, 1)) / total if sum(n) else np.eye(SIZE)
    ridge = np.diag(np.maximum(np.diag(pooled), 1e-4)) * RIDGE
    whiten, peaks = [], []
    for k in (0, 1):
        own = (1 - POOLED) * spread[k] + POOLED * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + ridge
        root = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(root))
        peaks.append(np.log((n[k] + 0.5) / (total + 1)) - np.log(np.diag(root)).sum())
    return Discriminant(np.array(mean), np.array(whiten), np.array(peaks))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs``; ``labels(doc_id, quality)`` holds the rows to learn from.

    Null texts count as empty ones and get a score too, and so do rows without an id; rows that repeat an id each get a row. All texts of an id are learnt from with all
    labels of it, a repeated label once; labels other than 0 and 1 are left out. Without labels every score is a half. Other columns are not read; an empty
    table gives no rows.
    """
    table = materialize(features(docs), "quality")
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").distinct()
    model = fit(moments(table.join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id bigint, score double")
