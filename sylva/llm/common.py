"""What the operators share: shared-folder tables, skew-proof lookups, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, shared_dir

__all__ = ["components", "fresh", "lookup_join", "materialize", "running_sums", "shared_dir", "spread_join"]

#: A key with more than this share of the rows is a heavy hitter; there are at most 1 / share of them.
HEAVY_SHARE = 0.001
#: Rows of one key that ``spread_join`` lets meet in one place.
TOGETHER = 4096
#: Edges, some 150 bytes each, that one task may link; more are linked in rounds of joins.
SMALL_EDGES = 500_000


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each behind as many underscores as keep it apart from ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lookup_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, written: bool = True) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row a key; ``weight``: the key's rows in ``big``; ``total``: all rows).

    Keys above ``HEAVY_SHARE`` of the rows are broadcast: by pigeonhole at most
    ``1 / HEAVY_SHARE`` rows at any input size; ``small`` has narrow rows, so their bytes are bounded too. The others shuffle, none with more than that share.
    Where no key of a ``written`` table is heavy, nothing is broadcast: each broadcast is built and held by the driver.
    """
    bound = total * HEAVY_SHARE
    heavy, light = small.filter(F.col(weight) > bound), small.filter(F.col(weight) <= bound)
    if written and total > TOGETHER and heavy.isEmpty():
        return big.join(small, key)
    heavy_part = big.join(F.broadcast(heavy), key)
    light_part = big.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return heavy_part.unionByName(light_part)


def spread_join(big: DataFrame, wide: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``wide`` (one row a key, of any width; ``weight``: the key's rows in ``big``; ``total``: all rows), without ``weight``.

    A key of many rows is split: its row of ``wide`` goes to a place for each ``TOGETHER`` of them, and nothing wide is broadcast.
    """
    parts = F.ceil(F.col(weight) / TOGETHER).cast("int")
    counted = wide.select(key, weight).withColumn("_parts", parts)
    salted = lookup_join(big, counted, key, weight, total, written=False).withColumn("_salt", F.expr(f"cast(pmod(xxhash64({', '.join(big.columns)}), _parts) as int)")).drop("_parts", weight)
    copies = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(weight)
    return salted.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def running_sums(rows: DataFrame, by: list[str], order: list[str], **sums: str) -> DataFrame:
    """``rows`` with a column for each of ``sums``: the sum of that column over the rows of the same ``by`` that come before in ``order``.

    The rows are range-sorted by ``by`` and ``order`` and written once with their range. Sums run within a range, and the totals of the ranges before,
    a row for each group and range, are added: neither a large group nor the whole passes through one task. Rows alike in ``by``
    and ``order`` come in any order. Nulls in ``by`` are a group.
    """
    part, of, *keys = fresh([*rows.columns, *sums], "range", "range_of", *(f"key_{c}" for c in by))
    bases = fresh([*rows.columns, *sums, part, of, *keys], *(f"base_{c}" for c in sums))
    placed = materialize(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*by, part).agg(*(F.sum(c).alias(b) for b, c in zip(bases, sums.values())))
    past = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(part).alias(of), *(F.coalesce(F.sum(b).over(past), F.lit(0)).alias(b) for b in bases))
    totals = materialize(totals, "range-totals")
    within = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    same = F.col(part) == F.col(of)
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    out = own.join(totals, same)
    return out.withColumns({name: F.col(name) + F.col(b) for name, b in zip(sums, bases)}).select(*rows.columns, *sums)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a``-``b`` and the least node that each reaches, by union-find."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return nodes, nodes[[root(x) for x in up]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked(*map(np.concatenate, zip(*parts)))], ["node", "component"])

    return edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, the component's least node; isolated nodes are absent.

    Up to ``small`` distinct edges are linked in one task: a round of joins over so few costs the driver and the executors
    more in plans and generated code than in rows. More take alternating large-star and small-star rounds; each round is written to the
    shared folder, so that lineage stays short and nothing gathers on the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = materialize(e, "edges")
    if e.count() <= small:
        return materialize(_in_one_task(e), "linked")
    seen = None
    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38, 0))"))).first()
        if (n, mark) == seen or not n:
            break
        seen = (n, mark)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        least = materialize(least, "least")
        large = lookup_join(both, least, "a", "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(large.filter("a <> b").distinct(), "edges")
        n = e.count()
        least = materialize(e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = lookup_join(e, least, "a", "n", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = materialize(small.filter("a <> b").distinct(), "edges")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
