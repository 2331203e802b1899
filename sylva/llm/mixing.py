"""Mixing sources to target weights by weighted fair queueing.

Every source plays its documents in a shuffled order, up to ``EPOCHS`` times over.
The virtual finish time of a copy is the tokens its source has played by then
over the source's target. All copies are range-sorted by that time and truncated at the
total budget. Running sums are taken in two levels, over ranges and within the
range: neither a source nor the whole ever passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_sums

EPOCHS, SEED = 3, 17


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, rank, target)`` of ``sources(source, source_size)``.

    Sources by code point, null last, weigh 1, 2, 3 and so on again; targets share the
    total by weight, none above ``epochs`` times its source, the excess reshared: the level is the one at which
    capped and uncapped targets sum to the total. ``sources`` has a row a source; only such rows meet in one task.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", ((F.col("rank") - 1) % 3 + 1).cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.expr("cast(cap as double) / w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    filled = ranked.withColumn("total", F.sum("source_size").over(all_rows))
    filled = filled.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("rest", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    # the first source, by cap a weight, that isn't capped sets the level
    filled = filled.withColumn("open", F.expr("cap * rest >= left * w"))
    level = filled.withColumn("l", F.min(F.expr("if(open, struct(cast(cap as double) / w as c, rank, left, rest), null)")).over(all_rows))
    return level.select("source", "source_size", "rank", F.expr("if(l is null or cap * l.rest <= l.left * w, cast(cap as double), cast(l.left * w as double) / l.rest)").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` is the size times the copies that fall within the budget, 0 to ``EPOCHS``: the copies up to the last, by finish time, whose words and those of all
    before it stay within it. The shuffle is by an MD5 of id and text. Null texts have
    size 0 and take nothing; rows without an id take part. Rows that repeat doc_id, source and text can't be told apart and take turns in any order, which gives the same rows.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shuffled = F.expr(f"substr(md5(concat_ws('|', cast(`{id_col}` as string), md5(`{text_col}`), '{SEED}')), 1, 16)")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), shuffled.alias("at"))
    own = materialize(own, "mix-sizes")
    sums = materialize(targets(own.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    total = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    played = running_sums(own, ["source"], ["at", "doc_id", "size"], before="size")
    keyed = sums.withColumnRenamed("source", "of")
    placed = played.join(keyed, F.expr("source <=> of")).select("doc_id", "size", "source_size", "target", "rank", "at", (F.col("before") + F.col("size")).alias("played"))
    placed = materialize(placed, "mix-placed")
    key = lambda epoch: f"struct((played + {epoch} * source_size) / target as time, rank, at, doc_id, {epoch} as epoch)"
    copies = placed.filter("size > 0 and target > 0").withColumn("k", F.explode(F.expr(f"array({', '.join(map(key, range(EPOCHS)))})"))).select("size", "k.*")
    queue = running_sums(copies, [], ["time", "rank", "at", "doc_id", "epoch"], spent="size")
    # the queue is cut at one place: a document's copies up to there are taken
    end = queue.filter(F.col("spent") + F.col("size") <= total).agg(F.max(F.struct("time", "rank", "at", "doc_id", "epoch")).alias("end"))
    end = end.select("end.*").withColumnsRenamed({c: f"end_{c}" for c in ("time", "rank", "at", "doc_id", "epoch")})
    end = spark.createDataFrame(end.collect(), end.schema)  # one row
    last = "struct(end_time as time, end_rank as rank, end_at as at, end_doc_id as doc_id, end_epoch as epoch)"
    taken = " + ".join(f"if({key(e)} <= {last}, 1, 0)" for e in range(EPOCHS))
    out = placed.join(F.broadcast(end))
    return out.select("doc_id", "size", "source_size", "target", F.expr(f"cast(if(size > 0 and target > 0 and end_time is not null, size * ({taken}), 0) as bigint)").alias("taken"))
