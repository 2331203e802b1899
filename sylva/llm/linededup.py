"""Line dedup by probing sharded minimal perfect hash tables.

A line's key is hashed to 128 bits. Counts and the largest holder of each
distinct hash are summed by Spark; all distinct hashes are dealt
into shards by their first bits, and every shard is built on an executor:
a minimal perfect hash (levels of bit arrays; a key sits at the first level where it has
a bit for itself, its number is the rank of that bit) that indexes arrays of
fingerprints, counts and largest holders. A document's lines probe the arrays: each line sends its hash to its shard, where
the table comes first in the order and the probes stream past it; only the lines that go come back. No lines are joined, and no table
leaves its shard, so that neither tables nor passes over the corpus grow in any one place. A shard that a common line makes
hot is split, and its table is copied to every part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_SHARE, fresh, materialize

LEAST_LENGTH, LEAST_DOCS = 40, 5
#: Keys in a shard, about (some 21 bytes a key), and the least number of probes that splits one.
SHARD_KEYS, PART_PROBES = 1 << 17, 1 << 19
LOWEST = -(1 << 63)


def line_key(line: bytes, least: int = LEAST_LENGTH) -> bytes | None:
    """The key's hash, None if it is shorter than ``least`` code points."""
    key = line.strip().lower()
    n = len(key)
    if n < least or (n < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position at a level; depends on all 128 bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * level & (1 << 64) - 1)
    x ^= (b + np.uint64(level * 0xD1342543DE82EF95 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) % np.uint64(size)


class Table:
    """Minimal perfect hash of distinct keys ``(a, b)`` and what it indexes."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.levels, self.ranks, self.prints, self.counts, self.last = levels, ranks, prints, counts, last

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, last: np.ndarray) -> Table:
        levels, ranks, number = [], [], np.zeros(len(a), np.int64)
        left, base = np.arange(len(a)), 0
        while len(left):
            size = 64 * max(1, len(left) // 32)
            at = _place(a[left], b[left], len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            rank = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            levels.append(words)
            ranks.append(rank)
            number[left[alone]] = cls._number(words, rank, at[alone])
            base += int(alone.sum())
            left = left[~alone]
        order = np.argsort(number)
        return cls(levels, ranks, b[order], counts[order], last[order])

    @staticmethod
    def _number(words: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> np.uint64(6)
        below = (np.uint64(1) << (at & np.uint64(63))) - np.uint64(1)
        return rank[word] + np.bitwise_count(words[word] & below)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0: not there) and largest holder of each key."""
        number, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (words, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _place(a[left], b[left], level, 64 * len(words))
            there = (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            number[left[there]] = self._number(words, rank, at[there])
            left = left[~there]
            if not len(left):
                break
        hit = np.flatnonzero(number >= 0)
        hit = hit[self.prints[number[hit]] == b[hit]]
        counts, last = np.zeros(len(a), np.int64), np.full(len(a), LOWEST, np.int64)
        counts[hit], last[hit] = self.counts[number[hit]], self.last[number[hit]]
        return counts, last

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.levels, *self.ranks, p=self.prints, c=self.counts, l=self.last)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Table:
        with np.load(io.BytesIO(data)) as z:
            parts = [z[f"arr_{k}"] for k in range(len(z.files) - 3)]
            half = len(parts) // 2
            return cls(parts[:half], parts[half:], z["p"], z["c"], z["l"])


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def line_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``(a, b, n, last)``: hash of each distinct key, documents that hold it, the largest of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                i = LOWEST if i is None else i
                for k in {line_key(x, least) for x in (text.as_py() or b"").split(b"\n")}:
                    if k is not None:
                        if (own := seen.get(k)) is None:
                            seen[k] = [1, i]
                        else:
                            own[0] += 1
                            own[1] = max(own[1], i)
            a, b = _halves(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([x for x, _ in seen.values()], pa.int64()), pa.array([x for _, x in seen.values()], pa.int64())], ["a", "b", "n", "last"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "a bigint, b bigint, n bigint, last bigint").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def shard_of(a: np.ndarray, bits: int) -> np.ndarray:
    return (a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)


def tables(lines: DataFrame, bits: int) -> DataFrame:
    """``(shard, data)``: a table of ``lines(a, b, n, last)`` for each value of the first ``bits`` bits."""

    def build(part: pa.Table) -> pa.Table:
        a, b = (part.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        table = Table.build(a, b, part.column("n").to_numpy(), part.column("last").to_numpy())
        return pa.table({"shard": pa.array([part.column("shard")[0].as_py()], pa.int64()), "data": pa.array([table.dump()], pa.binary())})

    return lines.withColumn("shard", _shard(bits)).groupBy("shard").applyInArrow(build, "shard bigint, data binary")


def _shard(bits: int):
    return F.expr(f"shiftrightunsigned(a, {64 - bits})") if bits else F.lit(0).cast("bigint")


_PROBE = "shard bigint, salt int, kind int, data binary, a bigint, b bigint, id bigint, h bigint, line int"


def repeated(docs: DataFrame, least: int = LEAST_LENGTH, copies: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, part_probes: int = PART_PROBES) -> DataFrame:
    """``(id, h, drop)`` of ``docs(id, h, text binary)``, for those that lose lines: the numbers of the lines that go."""
    lines = materialize(line_counts(docs.selectExpr("id as doc_id", "text"), least), "lines")
    n, total = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (n // shard_keys).bit_length())
    built = materialize(tables(lines, bits), "line-tables")
    # a shard of more than its share: by pigeonhole few, whatever the size of the corpus
    bound = max(part_probes, int(total * HEAVY_SHARE))
    hot = lines.groupBy(_shard(bits).alias("shard")).agg(F.sum("n").alias("n")).filter(F.col("n") > bound)
    parts = {r.shard: -(-r.n // bound) for r in hot.collect()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, where, ids, hashes = [], [], [], []
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for j, x in enumerate((text.as_py() or b"").split(b"\n")):
                    if len(x) >= least and (key := line_key(x, least)) is not None:
                        keys.append(key)
                        where.append(j)
                        ids.append(i)
                        hashes.append(h)
            a, b = _halves(keys)
            shard = shard_of(a, bits)
            h = np.array(hashes, np.int64)
            salt = np.zeros(len(a), np.int64)
            for s, k in parts.items():
                at = shard == s
                salt[at] = h[at] % k
            m = len(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(salt.astype(np.int32)), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.binary()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids, pa.int64()), pa.array(h), pa.array(where, pa.int32())],
                ["shard", "salt", "kind", "data", "a", "b", "id", "h", "line"],
            )

    of = F.create_map(*(F.lit(x).cast("bigint") for pair in parts.items() for x in pair))[F.col("shard")] if parts else F.lit(1)
    null = lambda t, c: F.lit(None).cast(t).alias(c)
    copied = built.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.coalesce(of, F.lit(1)) - 1).cast("int"))))
    copied = copied.select("shard", "salt", F.lit(0).alias("kind"), "data", null("bigint", "a"), null("bigint", "b"), null("bigint", "id"), null("bigint", "h"), null("int", "line"))
    met = docs.select("id", "h", "text").mapInArrow(ask, _PROBE).unionByName(copied).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            starts = np.flatnonzero(kind == 0)
            for first, last in zip([0, *starts], [*starts, batch.num_rows]):
                if first < last and kind[first] == 0:
                    table = Table.load(batch.column(3)[int(first)].as_py())
                    first += 1
                if first >= last:
                    continue
                part = batch.slice(int(first), int(last - first))
                a, b, own = (part.column(k).to_numpy() for k in (4, 5, 6))
                counts, largest = table.probe(a.view(np.uint64), b.view(np.uint64))
                gone = pa.array(np.flatnonzero((counts >= copies) & (largest != own)))
                yield pa.RecordBatch.from_arrays([part.column(k).take(gone) for k in (6, 7, 8)], ["id", "h", "line"])

    found = met.mapInArrow(probe, "id bigint, h bigint, line int")
    return found.groupBy("id", "h").agg(F.collect_set("line").alias("drop"))


def dedup(docs: DataFrame, least: int = LEAST_LENGTH, copies: int = LEAST_DOCS, shard_keys: int = SHARD_KEYS, part_probes: int = PART_PROBES) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the lines that stay as ``text``, and ``n_lines``, ``n_dropped``.

    Keys of at least ``least`` code points in at least ``copies`` rows lose all lines but those of the rows with the
    largest doc_id that holds them (a null doc_id is the smallest). Each row is a document: rows that repeat an id count each, and if it is the largest
    all of them keep the line. Null or empty texts are one empty line. Columns of ``docs`` named
    ``n_lines`` or ``n_dropped`` are replaced; the others stay as they are. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own_id, own_h, own_drop, lost_id, lost_h = fresh([*kept, "n_lines", "n_dropped"], "row_id", "row_h", "row_drop", "lost_id", "lost_h")
    keyed = docs.select(*kept).withColumns({own_id: F.expr(f"coalesce(cast(doc_id as bigint), {LOWEST + 1}L - 1L)"), own_h: F.xxhash64("text"), "text": F.col("text").cast("binary")})
    lost = materialize(repeated(keyed.select(F.col(own_id).alias("id"), F.col(own_h).alias("h"), "text"), least, copies, shard_keys, part_probes), "line-drops")
    lost = lost.select(F.col("id").alias(lost_id), F.col("h").alias(lost_h), F.col("drop").alias(own_drop))
    joined = keyed.join(lost, (F.col(own_id) == F.col(lost_id)) & (F.col(own_h) == F.col(lost_h)), "left").select(*kept, own_drop)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            for t, drop in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index(own_drop)).to_pylist()):
                t = t or b""
                counts.append(t.count(b"\n") + 1)
                dropped.append(len(drop or ()))
                if drop:
                    gone = set(drop)
                    t = b"\n".join([x for j, x in enumerate(t.split(b"\n")) if j not in gone])
                texts.append(t)
            columns = [pa.array(texts, pa.binary()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*kept, "n_lines", "n_dropped"])

    schema = ", ".join([*(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema if f.name in kept), "n_lines bigint, n_dropped bigint"])
    out = joined.mapInArrow(finish, schema)
    return out.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in kept), "n_lines", "n_dropped")
