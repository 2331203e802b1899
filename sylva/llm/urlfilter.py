"""URL filters as a sort-merge range join.

A host becomes its labels in reverse, each followed by a dot, so that a rule's
host and all its subdomains are one interval of keys. Urls and rules meet sorted
by key; the sweep keeps a stack of the rules whose interval holds the present
key (the intervals nest), each with its path prefixes. Ranges are cut at sampled
keys of urls, path and id included, so that a hot host spreads over many
ranges; the sample moves only the cuts. A rule goes to every range that its
interval meets, and no table is broadcast.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys sampled for the cuts, for each range.
SAMPLE = 64
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str) -> dict[str, str]:
    """SQL of host and path of a column ``url``: null or without ``://``, both are empty."""
    rest = f"substring({url}, instr({url}, '://') + 3)"
    known = f"coalesce(instr({url}, '://') > 0, false)"
    return {
        "host": f"if({known}, translate(regexp_extract({rest}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '')",
        "path": f"if({known}, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')",
    }


def host_key(host: str) -> str:
    """SQL of the canonical key: ``a.example.org`` gives ``org.example.a.``."""
    return f"concat(array_join(reverse(split({host}, '[.]', -1)), '.'), '.')"


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``urls``; ``rules(host, path, verdict)``.

    Of the rules that fit, the one with the longest host and path together
    wins, then the longer host; where the same rule is both, ``block`` wins. A url that none fits has
    a null rule and ``default``. Null urls have an empty host and path, which a
    rule of a nonempty host doesn't fit; rules with a null part are left out. Repeated ids are judged each.
    """
    spark = urls.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = urls.select(F.col(id_col).cast("bigint").alias("id"), *(F.expr(e).alias(c) for c, e in split_url(f"`{url_col}`").items()))
    own = own.withColumn("key", F.expr(host_key("host"))).withColumn("spread", F.expr("hex(xxhash64(id))"))
    total = own.count()
    taken = own.select("key", "path", "spread").sample(min(1.0, SAMPLE * parts / max(1, total)), seed=5).collect()
    keys = sorted((r.key, r.path, r.spread) for r in taken)
    cuts = sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, k) for k in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "path", "spread")))]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(3), pa.array([1] * n, pa.int32()), *(batch.column(k) for k in (0, 1, 2)), pa.nulls(n, pa.string())], ["part", "key", "kind", "id", "host", "path", "verdict"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict, key in zip(*(c.to_pylist() for c in batch.columns)):
                first, last = bisect_right(cuts, (key, "", "")), bisect_right(cuts, (key[:-1] + "/", "", ""))
                rows += [(at, key, 0, None, host, path, verdict) for at in range(first, last + 1)]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "key", "kind", "id", "host", "path", "verdict"])

    schema = "part int, key string, kind int, id bigint, host string, path string, verdict string"
    lines = rules.select("host", "path", "verdict").dropna().withColumn("key", F.expr(host_key("host"))).mapInArrow(place_rules, schema)
    merged = own.select("id", "host", "path", "key", "spread").mapInArrow(place_urls, schema).unionByName(lines)
    merged = merged.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str], list[int]]] = []
        present = None
        for batch in batches:
            rows = []
            for part, key, kind, i, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if part != present:
                    stack, present = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, lengths = stack[-1]
                    if paths.get(path) != "block":
                        paths[path] = verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, rule_host, paths, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and (v := paths.get(path[:n])) is not None:
                            best = max(best or (-1,), (len(rule_host) + n, len(rule_host), rule_host + path[:n], v))
                            break
                rows.append((i, host, path, best[2] if best else None, best[3] if best else default))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [id_col, "host", "path", "rule", "verdict"])

    return merged.mapInArrow(sweep, f"`{id_col}` bigint, host string, path string, rule string, verdict string")
