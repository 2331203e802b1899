"""Personalised PageRank over the file and symbol graph.

Nodes are keyed ``(file_id, sym_id)``, a null ``sym_id`` being the file; symbols
have no edges out. The loop is DataFrame joins and aggregates; after each round the
ranks go through the shared folder, so that none is worked out twice. A graph of up to ``SMALL_EDGES`` edges is
ranked in one task by the same steps over arrays.

Where calls are bound by name alone, ``pagerank_by_name`` lists no edge between a
call and a definition: there are as many as the product of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import materialize, remove, write
from .scan import test_path

DAMPING, ROUNDS, STOP, TEST_WEIGHT = 0.85, 20, 1e-9, 0.25
SMALL_EDGES = 2_000_000
#: Imports between files, 24 bytes each at the most, that one task may hold.
FILE_EDGES = 20_000_000


def node_key(file_id: str = "file_id", sym_id: str = "sym_id") -> Column:
    """One number a node: files have symbol -1."""
    return F.expr(f"cast({file_id} as bigint) * 4294967296L + coalesce({sym_id}, -1) + 1")


def weight(rel: Column) -> Column:
    return F.when(test_path(rel), F.lit(TEST_WEIGHT)).otherwise(F.lit(1.0))


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(file_id, sym_id, w)``: files, then symbols, weighted by their file's path."""
    own = files.select("file_id", F.lit(None).cast("int").alias("sym_id"), weight(F.col("rel")).alias("w"))
    return own.unionByName(symbols.join(own.select("file_id", "w"), "file_id").select("file_id", F.col("sym_id").cast("int").alias("sym_id"), "w"))


def edges(imports: DataFrame, references: DataFrame) -> DataFrame:
    """``(src, dst)`` as node keys."""
    a = imports.select(F.expr("src * 4294967296L").alias("src"), F.expr("dst * 4294967296L").alias("dst"))
    b = references.select(F.expr("src * 4294967296L").alias("src"), node_key("dst_file", "dst_sym").alias("dst"))
    return a.unionByName(b)


def out_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.count("*").alias("n"))


def teleport(points: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``points(file_id, sym_id, w)`` with ``p``: uniform over the files of ``seeds(file_id)`` that exist, else by weight, else uniform."""
    totals = points.agg(F.count("*").alias("total_n"), F.sum("w").alias("total_w"))
    if seeds is not None:
        chosen = seeds.select("file_id").distinct().withColumn("seed", F.lit(1))
        points = points.join(chosen, "file_id", "left").withColumn("seed", F.expr("if(sym_id is null, coalesce(seed, 0), 0)"))
        total = points.agg(F.sum("seed").alias("total_s"))
        points = points.join(F.broadcast(total))
        p = F.expr("if(total_s > 0, seed / total_s, if(total_w > 0, w / total_w, 1 / total_n))")
    else:
        p = F.expr("if(total_w > 0, w / total_w, 1 / total_n)")
    return points.join(F.broadcast(totals)).withColumn("p", p).select("file_id", "sym_id", "w", "p")


def pagerank(points: DataFrame, links: DataFrame, rounds: int = ROUNDS, small: int = SMALL_EDGES, stop: float = STOP) -> DataFrame:
    """``(file_id, sym_id, score)`` of ``points(file_id, sym_id, p)`` and ``links(src, dst)`` by node key; rounds end once ranks move by less than ``stop``."""
    points = materialize(points.select("file_id", "sym_id", "p", node_key().alias("node")), "points")
    links = materialize(links.distinct(), "links")
    if links.count() <= small and points.count() <= small:
        return _in_one_task(points, links, rounds, stop)
    degree = materialize(links.join(out_degree(links), "src").withColumn("share", 1 / F.col("n")).select("src", "dst", "share"), "shares")
    dangling = materialize(points.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node"), "dangling")
    ranks = points.select("node", "p", F.col("p").alias("score"))
    for _ in range(rounds):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        given = degree.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("score")).alias("got"))
        new = ranks.join(given, "node", "left").select("node", "p", F.col("score").alias("old"), ((1 - DAMPING) * F.col("p") + DAMPING * (F.coalesce("got", F.lit(0.0)) + lost * F.col("p"))).alias("score"))
        new = materialize(new, "ranks")
        ranks = new.drop("old")
        if (new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0) < stop:
            break
    return ranks.select("node", "score").join(points, "node").select("file_id", "sym_id", "score")


def _in_one_task(points: DataFrame, links: DataFrame, rounds: int, stop: float) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(parts), ignore_index=True)
        own = every[every.is_node].sort_values("a", ignore_index=True)
        if not len(own):
            return
        arcs = every[~every.is_node].sort_values(["a", "b"], ignore_index=True)
        ids = own.a.to_numpy()
        src, dst = np.searchsorted(ids, arcs.a.to_numpy()), np.searchsorted(ids, arcs.b.to_numpy())
        degree = np.bincount(src, minlength=len(ids))
        p = own.p.to_numpy()
        v = p.copy()
        for _ in range(rounds):
            got = np.bincount(dst, weights=v[src] / degree[src], minlength=len(ids)) if len(src) else np.zeros(len(ids))
            new = (1 - DAMPING) * p + DAMPING * (got + v[degree == 0].sum() * p)
            moved, v = np.abs(new - v).sum(), new
            if moved < stop:
                break
        yield pd.DataFrame({"node": ids, "score": v})

    both = points.select(F.lit(True).alias("is_node"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "p").unionByName(links.select(F.lit(False).alias("is_node"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0.0).alias("p")))
    ranks = both.coalesce(1).mapInPandas(run, "node long, score double")
    return ranks.join(points, "node").select("file_id", "sym_id", "score")


def named_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(file_id, name, n, own)``: a file's call names that have definitions, their number, and how many of them are in the file itself.

    Stands for the ``n - own`` edges of ``link.reference_edges`` of that file and name.
    """
    own = definitions(symbols)
    return named_among(refs, own, defined_names(own))


def definitions(symbols: DataFrame) -> DataFrame:
    """``(file_id, name, own)``: how many symbols of a name a file has."""
    return symbols.groupBy("file_id", "name").agg(F.count("*").alias("own"))


def defined_names(own: DataFrame) -> DataFrame:
    """``(name, n)`` of ``definitions``: how many symbols have the name."""
    return own.groupBy("name").agg(F.sum("own").alias("n"))


def named_among(refs: DataFrame, own: DataFrame, every: DataFrame) -> DataFrame:
    """``named_references`` by ``definitions`` and ``defined_names``; ``refs`` may be those of some files, each with all of its call names."""
    calls = refs.select("file_id", "name").distinct().join(own, ["file_id", "name"], "left")
    return calls.join(every, "name").select("file_id", "name", "n", F.coalesce("own", F.lit(0)).alias("own"))


def out_degrees(imports: DataFrame, named: DataFrame) -> DataFrame:
    """``(file_id, n)``: the edges out of a file by ``imports(src, dst)`` and ``named_references``."""
    to_files = imports.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("a"))
    to_symbols = named.groupBy("file_id").agg(F.sum(F.expr("n - own")).alias("b")).filter("b > 0")
    return to_files.join(to_symbols, "file_id", "full").select("file_id", F.expr("coalesce(a, 0) + coalesce(b, 0)").alias("n"))


def pagerank_by_name(points: DataFrame, imports: DataFrame, named: DataFrame, symbols: DataFrame, rounds: int = ROUNDS, small: int = FILE_EDGES) -> DataFrame:
    """``pagerank`` of all ``rounds`` over ``imports(src, dst)`` and the edges that ``named`` (see ``named_references``) stands for.

    Symbols have no edges out, so the rounds need the files' ranks only, and what all symbols hold is the rest of the whole. A symbol's
    rank comes from the last round: what the files that call its name give it, less what its own file would.
    """
    points = materialize(points.select("file_id", "sym_id", "p"), "points")
    whole = points.agg(F.sum("p")).first()[0] or 0.0
    nodes = points.filter("sym_id is null").join(out_degrees(imports, named), "file_id", "left").select("file_id", "p", F.coalesce("n", F.lit(0)).alias("n"))
    nodes = materialize(nodes, "file-points")
    few = imports.count() <= small and nodes.count() <= small
    ranks = materialize(_files_in_one_task(nodes, imports, whole, rounds), "file-ranks") if few else _files_by_joins(nodes, imports, whole, rounds)
    share = ranks.filter("n > 0").select("file_id", F.expr("old / n").alias("share"))
    given = named.filter("n > own").join(share, "file_id")
    to_name = materialize(given.groupBy("name").agg(F.sum("share").alias("given")), "given")
    from_own = given.filter("own > 0").select("file_id", "name", "share")
    got = symbols.select("file_id", F.col("sym_id").cast("int").alias("sym_id"), "name").join(to_name, "name", "left").join(from_own, ["file_id", "name"], "left")
    got = got.select("file_id", "sym_id", F.expr("greatest(coalesce(given, 0D) - coalesce(share, 0D), 0D)").alias("got"))
    lost = ranks.agg(F.max("lost").alias("lost"))
    score = F.expr(f"{1 - DAMPING} * p + {DAMPING} * (got + lost * p)")
    own = points.filter("sym_id is not null").join(got, ["file_id", "sym_id"]).join(F.broadcast(lost)).select("file_id", "sym_id", score.alias("score"))
    return ranks.select("file_id", F.lit(None).cast("int").alias("sym_id"), "score").unionByName(own)


def _files_by_joins(nodes: DataFrame, imports: DataFrame, whole: float, rounds: int) -> DataFrame:
    """``(file_id, n, old, score, lost)``: ranks before and after the last round, and what nodes without edges out held before it."""
    ranks, total, before = nodes.withColumn("score", F.col("p")), whole, None
    for _ in range(rounds):
        kept = ranks.filter("n > 0").agg(F.sum("score")).first()[0] or 0.0
        lost = total - kept
        got = imports.join(ranks.filter("n > 0").select(F.col("file_id").alias("src"), F.expr("score / n").alias("share")), "src").groupBy(F.col("dst").alias("file_id")).agg(F.sum("share").alias("got"))
        new = (1 - DAMPING) * F.col("p") + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("p"))
        ranks, path = write(ranks.join(got, "file_id", "left").select("file_id", "p", "n", F.col("score").alias("old"), new.alias("score"), F.lit(lost).alias("lost")), "file-ranks")
        total = (1 - DAMPING) * whole + DAMPING * (kept + lost * whole)
        if before:
            remove(ranks.sparkSession, before)
        before = path
    return ranks


def _files_in_one_task(nodes: DataFrame, imports: DataFrame, whole: float, rounds: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, arcs = [], []
        for part in parts:
            own = part.is_node.to_numpy()
            files.append(part[own])
            arcs.append((part.a.to_numpy()[~own], part.b.to_numpy()[~own]))
        every = pd.concat(files, ignore_index=True).sort_values("a", ignore_index=True) if files else pd.DataFrame()
        if not len(every):
            return
        ids, n, p = every.a.to_numpy(), every.b.to_numpy(), every.p.to_numpy()
        key = np.concatenate([np.searchsorted(ids, b) * len(ids) + np.searchsorted(ids, a) for a, b in arcs])
        arcs.clear()
        key.sort()  # by target, then source: sums in one order
        dst, src = key // len(ids), (key % len(ids)).astype(np.int32)
        del key
        at = np.flatnonzero(np.diff(dst, prepend=-1))
        dst = dst[at]
        v, total = p.copy(), whole
        for _ in range(rounds):
            kept = v[n > 0].sum()
            lost, got = total - kept, np.zeros(len(ids))
            if len(at):
                got[dst] = np.add.reduceat((v / np.maximum(n, 1))[src], at)
            old, v = v, (1 - DAMPING) * p + DAMPING * (got + lost * p)
            total = (1 - DAMPING) * whole + DAMPING * (kept + lost * whole)
        yield pd.DataFrame({"file_id": ids, "n": n, "old": old, "score": v, "lost": lost})

    no = F.lit(0.0).alias("p")
    both = nodes.select(F.lit(True).alias("is_node"), F.col("file_id").alias("a"), F.col("n").alias("b"), "p").unionByName(imports.select(F.lit(False).alias("is_node"), F.col("src").alias("a"), F.col("dst").alias("b"), no))
    return both.coalesce(1).mapInPandas(run, "file_id long, n long, old double, score double, lost double")
