"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words. For the windows of one length, the shift table says for
a block of two words how far the search may move on: most positions are never looked at. It is indexed by a hash of the
block, so that its size is bounded whatever the benchmark holds; where blocks share a slot, the least shift stands. At shift 0 a
second table of bits by the window's hash lets pass what may be a window. What passes goes to the bucket of
its hash, a shuffle, where the windows' words themselves are compared.

The tables are put together on the executors, page by page, and sent out once; the windows themselves stay a distributed table, and the
corpus is searched in one pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, spread_join

WINDOW = 10
#: Slots of a shift table and bits of a window table, at most; a byte a slot. Beyond some millions of windows more positions pass, none is lost.
SLOTS, BITS = 1 << 23, 1 << 26
PAGE = 1 << 14
#: ``A``-``Z`` become lower case; other bytes under 0x80 that aren't letters or digits become spaces.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO).split() if text else []


def _power(least: int, low: int, most: int) -> int:
    return min(most, max(low, 1 << (least - 1).bit_length()))


class Searcher:
    """Shift table and window bits of the windows of ``m`` words."""

    def __init__(self, m: int, slots: int, bits: int) -> None:
        self.m, self.block = m, min(2, m)
        self.shift: bytes | np.ndarray = np.full(slots, m - self.block + 1, np.uint8)
        self.bits: bytes | np.ndarray = np.zeros(bits // 8, np.uint8)

    def add(self, window: list[bytes]) -> None:
        mask = len(self.shift) - 1
        for j in range(self.block - 1, self.m):
            at = zlib.crc32(b" ".join(window[j - self.block + 1 : j + 1])) & mask
            self.shift[at] = min(self.shift[at], self.m - 1 - j)
        h = xxhash.xxh64_intdigest(b" ".join(window)) & (8 * len(self.bits) - 1)
        self.bits[h >> 3] |= 1 << (h & 7)

    def search(self, ws: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """Start and words, space-joined, of whatever may be a window."""
        m, shift, bits, crc, join = self.m, self.shift, self.bits, zlib.crc32, b" ".join
        mask, last, two, n, i = len(shift) - 1, 8 * len(bits) - 1, self.block == 2, len(ws), m - 1
        while i < n:
            s = shift[crc(ws[i - 1] + b" " + ws[i] if two else ws[i]) & mask]
            if s:
                i += s
                continue
            window = join(ws[i - m + 1 : i + 1])
            h = xxhash.xxh64_intdigest(window) & last
            if bits[h >> 3] >> (h & 7) & 1:
                yield i - m + 1, window
            i += 1


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``(m, win, item_id)`` of ``benchmark(item_id, text)``: ``size`` words in a row, or all where there are fewer. Items without an id or words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = words(text.as_py())
                m = min(size, len(ws))
                found = sorted({b" ".join(ws[at : at + m]) for at in range(len(ws) - m + 1)}) if m else []
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array([i] * len(found), pa.string())], ["m", "win", "item_id"])

    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id is not null and text is not null")
    return own.mapInArrow(run, "m int, win binary, item_id string").distinct()


def searchers(found: DataFrame) -> dict[int, tuple[bytes, bytes]]:
    """Shift table and window bits by length, of ``found(m, win, ...)``: put together by pages, at most ``SLOTS + BITS / 8`` bytes a length."""
    sizes = {r.m: (_power(8 * r.n * r.m, PAGE, SLOTS), _power(16 * r.n, 8 * PAGE, BITS)) for r in found.groupBy("m").agg(F.count("*").alias("n")).collect()}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Searcher] = {}
        for batch in batches:
            for m, win in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if m not in own:
                    own[m] = Searcher(m, *sizes[m])
                own[m].add(win.split(b" "))
        rows = []
        for m, s in own.items():
            empty = Searcher(m, *sizes[m])
            for kind, table, start in ((0, s.shift, empty.shift), (1, s.bits, empty.bits)):
                for at in range(0, len(table), PAGE):
                    if (table[at : at + PAGE] != start[at : at + PAGE]).any():
                        rows.append((m, kind, at, table[at : at + PAGE].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["m", "kind", "at", "page"])

    def merge_pages(part: pa.Table) -> pa.Table:
        pages = np.stack([np.frombuffer(p, np.uint8) for p in part.column("page").to_pylist()])
        page = pages.min(axis=0) if part.column("kind")[0].as_py() == 0 else np.bitwise_or.reduce(pages, axis=0)
        return pa.table({"m": part.column("m")[:1], "kind": part.column("kind")[:1], "at": part.column("at")[:1], "page": pa.array([page.tobytes()], pa.binary())})

    schema = "m int, kind int, at int, page binary"
    made = {m: Searcher(m, *n) for m, n in sizes.items()}
    for r in found.select("m", "win").distinct().mapInArrow(fill, schema).groupBy("m", "kind", "at").applyInArrow(merge_pages, schema).collect():
        table = made[r.m].bits if r.kind else made[r.m].shift
        table[r["at"] : r["at"] + len(r.page)] = np.frombuffer(r.page, np.uint8)
    return {m: (bytes(s.shift), bytes(s.bits)) for m, s in made.items()}


def loaded(tables: dict[int, tuple[bytes, bytes]]) -> list[Searcher]:
    out = []
    for m, (shift, bits) in sorted(tables.items()):
        s = Searcher(m, 1, 8)
        s.shift, s.bits = shift, bits
        out.append(s)
    return out


def candidates(ws: list[bytes], own: list[Searcher]) -> list[dict]:
    """What may be a window: length, words, and all places of it."""
    found: dict[bytes, dict] = {}
    for s in own:
        for at, win in s.search(ws):
            found.setdefault(win, {"m": s.m, "win": win, "places": []})["places"].append(at)
    return list(found.values())


_CANDIDATES = pa.list_(pa.struct([("m", pa.int32()), ("win", pa.binary()), ("places", pa.list_(pa.int32()))]))
_CANDIDATES_SQL = "array<struct<m:int,win:binary,places:array<int>>>"


def merge(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _confirmed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Of ``found(key, cands)`` the candidates whose words are a window of ``known(m, win, item_id)``: ``(key, m, win, places, items)``."""
    rows = materialize(found.select("key", F.explode("cands").alias("c")).select("key", "c.*"), "candidates")
    # each distinct candidate meets the windows once, however many documents have it
    once = rows.groupBy("win").agg(F.count("*").alias("n"))
    items = known.join(once.select("win"), "win", "left_semi").groupBy("win").agg(F.collect_set("item_id").alias("items"))
    wide = materialize(items.join(once, "win"), "windows-found")
    return spread_join(rows, wide, "win", "n", rows.count())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits)`` for every row of ``docs``; ``benchmark(item_id, text)``.

    ``hits``: ranges of hit words. Null texts have no words; items without an id or words never occur. Items that
    share a window all count; rows of ``benchmark`` that repeat an id are one item with the windows of each. Rows repeated in full get a row each, rows without an id
    too; without items nothing is hit; an empty table gives no rows. Other columns are not read.
    """
    known = materialize(windows(benchmark), "windows")
    tables = docs.sparkSession.sparkContext.broadcast(searchers(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(tables.value)
        for batch in batches:
            split = [words(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, split)), pa.int64()), pa.array([candidates(ws, own) for ws in split], _CANDIDATES)], ["doc_id", "n_words", "cands"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = own.mapInArrow(run, f"doc_id bigint, n_words bigint, cands {_CANDIDATES_SQL}")
    found = materialize(found.withColumn("key", F.monotonically_increasing_id()), "searched")
    hit = _confirmed(found.filter("size(cands) > 0").select("key", "cands"), known)
    hit = hit.groupBy("key").agg(F.collect_list(F.struct("m", "places")).alias("found"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = found.drop("cands").join(materialize(hit, "hit"), "key", "left").select("doc_id", "n_words", "found", "items")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, n, found, items in zip(*(c.to_pylist() for c in batch.columns)):
                ranges = merge([(at, at + f["m"]) for f in found or () for at in f["places"]])
                ids = sorted(items or ())
                hits = sum(ranges[1::2]) - sum(ranges[::2])
                out.append((i, n, hits, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hits > 0, ranges))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"])

    return rows.mapInArrow(digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, hits array<int>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs(text, ...)`` without a window of the benchmark, all columns; null texts stay, repeated rows have one fate.

    A row is known by the hash and length of its text, on which alone its fate depends.
    """
    known = materialize(windows(benchmark), "windows")
    tables = docs.sparkSession.sparkContext.broadcast(searchers(known))
    sign = F.struct(F.xxhash64("text"), F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(tables.value)
        for batch in batches:
            every = [candidates(words(t.as_py()), own) for t in batch.column(1)]
            at = [k for k, c in enumerate(every) if c]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([every[k] for k in at], _CANDIDATES)], ["key", "cands"])

    keys = docs.select(F.to_json(sign).alias("key"), F.col("text").cast("binary").alias("text"))
    bad = _confirmed(keys.mapInArrow(run, f"key string, cands {_CANDIDATES_SQL}"), known)
    (name,) = fresh(docs.columns, "bad_key")
    bad = materialize(bad.select(F.col("key").alias(name)).distinct(), "contaminated")
    return docs.join(bad, F.to_json(sign) == F.col(name), "left_anti")
