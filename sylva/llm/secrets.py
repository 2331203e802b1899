"""Secret scans: spans by pattern, weak candidates by the parts around them.

Strong spans (``assign``, ``access``, ``hex``) stand for themselves. Weak ones
(a short assigned value, a short access identifier, a short hex run, a user
name, an endpoint) are reported only if complementary parts co-occur: an
identifier or endpoint needs a secret whose span lies within ``SCOPE`` code points of its own, a
weak secret needs such an identifier or endpoint. Whether there is one is an
interval join, done as a sweep: spans enter at their start, every span asks ``SCOPE`` after its end, and the largest end that
has entered by then tells whether some span reaches back to ``SCOPE`` before its start. No pairs are listed. The
sweep is cut into stretches of ``STRETCH`` code points, with the largest end of those before carried in, so that a long text spreads over tasks.
Positions come from the lengths of the matches and of the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCOPE, STRETCH = 200, 1 << 16
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, cheap test of whether it can match at all, least length of the value, least length to be strong (None: always weak), part.
#: ``[A-Z0-9]+`` and ``[0-9a-f]+`` take whole runs, so a least length in the pattern finds the same spans.
KINDS = (
    ("assign", ASSIGN, ASSIGN, 4, 8, "secret"),
    ("access", "AKIA[A-Z0-9]{4,}", "AKIA[A-Z0-9]{4}", 8, 16, "id"),
    ("hex", "[0-9a-f]{16,}", "[0-9a-f]{16}", 16, 32, "secret"),
    ("ident", r"""(?i:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", r"(?i:user|login|client_?id|account_?id)", 3, None, "id"),
    ("endpoint", r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][A-Za-z0-9._~:/@%-]*", "://", 8, None, "endpoint"),
)


def _found(text: Column, number: int) -> Column:
    """Of one kind: an array of (kind, number of the match, gap before it, its length, length of its value), null without a match."""
    _, pattern, test, *_ = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern is ASSIGN else whole
    parts = F.arrays_zip(whole.alias("m"), F.split(text, pattern, -1).alias("g"), value.alias("v"))
    spans = F.transform(parts, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("at"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["v"]).alias("v")))
    return F.when(text.rlike(test), F.filter(spans, lambda x: x["n"].isNotNull()))


def _linked(spans: DataFrame) -> DataFrame:
    """``spans(doc_id, h, part, start, end, ...)`` with ``linked``: a span of the complementary part lies within ``SCOPE``."""
    own = spans.withColumns({"secret_end": F.when(F.col("part") == "secret", F.col("end")), "other_end": F.when(F.col("part") != "secret", F.col("end"))})
    enters = own.withColumns({"pos": F.col("start"), "asks": F.lit(0)})
    asks = own.withColumns({"pos": F.col("end") + SCOPE, "asks": F.lit(1), "secret_end": F.lit(None).cast("long"), "other_end": F.lit(None).cast("long")})
    stretch = F.expr(f"pos div {STRETCH}")
    events = enters.unionByName(asks).withColumn("stretch", stretch)
    ends = ("secret_end", "other_end")
    upto = Window.partitionBy("doc_id", "h", "stretch").orderBy("pos", "asks").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumns({f"{c}_here": F.max(c).over(upto) for c in ends}).filter("asks = 1")
    # a row a stretch: what the stretches before it have
    past = Window.partitionBy("doc_id", "h").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = events.groupBy("doc_id", "h", "stretch").agg(*(F.max(c).alias(c) for c in ends))
    carried = carried.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), F.col("stretch").alias("of"), *(F.max(c).over(past).alias(f"{c}_before") for c in ends))
    met = swept.join(carried.filter(" or ".join(f"{c}_before is not null" for c in ends)), F.expr("doc_id <=> d and h = k and stretch = of"), "left")
    reach = lambda c: F.coalesce(F.greatest(f"{c}_here", f"{c}_before") >= F.col("start") - SCOPE, F.lit(False))
    return met.withColumn("linked", F.when(F.col("part") == "secret", reach("other_end")).otherwise(reach("secret_end"))).select(*spans.columns, "linked")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``, whole texts.

    Spans are ``kind:start:end`` (code points, end exclusive) by start, then kind, comma-joined; weak ones
    are named ``weak_assign`` and so on. Null texts count as empty; documents without spans have zeros and the hash of an empty
    string. Rows repeated in full each get the same row, rows without an id too; an empty table gives none. Other columns of ``docs``, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.filter(F.flatten(F.filter(F.array(*(_found(text, k) for k in range(len(KINDS)))), lambda x: x.isNotNull())), lambda x: x.isNotNull())
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), found.alias("found"))
    own = materialize(own, "secrets")
    with_any, without = own.filter("size(found) > 0"), own.filter("size(found) = 0")
    # rows repeated in full are scanned once
    once = with_any.groupBy("doc_id", "h").agg(F.first("found").alias("found"), F.count("*").alias("times"))
    rows = once.select("doc_id", "h", "times", F.explode("found").alias("f")).select("doc_id", "h", "times", "f.*")
    running = Window.partitionBy("doc_id", "h", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(running)).withColumn("start", F.col("end") - F.col("n"))
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in KINDS)), F.col("kind") + 1)
    spans = spans.filter(F.col("v") >= pick(3)).withColumn("strong", F.coalesce(F.col("v") >= pick(4), F.lit(False))).withColumn("part", pick(5)).withColumn("name", pick(0))
    spans = _linked(spans)
    spans = spans.withColumn("label", F.when(F.col("strong") | F.col("name").isin("ident", "endpoint"), F.col("name")).otherwise(F.concat(F.lit("weak_"), F.col("name"))))
    spans = spans.filter("strong or linked").withColumn("line", F.concat_ws(":", "label", "start", "end"))
    counts = [F.sum(F.expr(f"cast(strong and name = '{k}' as bigint)")).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    joined = lambda test: F.expr(f"array_join(transform(array_sort(collect_list(if({test}, struct(start, not strong as weak, kind, line), null))), x -> x.line), ',')")
    per = spans.groupBy("doc_id", "h", "times").agg(*counts, joined("strong").alias("base"), joined("true").alias("spans"))
    # a document whose weak candidates all went is still a document
    per = once.select("doc_id", "h", "times").join(per.drop("times").withColumnsRenamed({"doc_id": "d", "h": "k"}), F.expr("doc_id <=> d and h = k"), "left")
    per = per.withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    number = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("bigint").alias(f"n_{k}")
    some = per.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    none = without.select("doc_id", *(F.lit(0).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return some.unionByName(none)
