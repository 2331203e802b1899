"""Chat formatting: every participant in turn as the assistant.

For each conversation and each of its speakers the dialogue is rendered with
that speaker as assistant and the others as named users, with the spans of the
assistant's text as the loss mask. A dialogue of up to ``WHOLE`` messages is one row; a longer one goes on
in further rows, whose positions continue, so that their texts one after the other are the dialogue and no task
collects more than ``WHOLE`` messages. Positions are running sums over ranges: a conversation of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_sums

WHOLE = 1024
ASSISTANT = "<|assistant|>\n"


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str | None = "system", whole: int = WHOLE) -> DataFrame:
    """``(conv_id, assistant, part, start, n_messages, n_masked, rendered, mask)``.

    A message is ``<|assistant|>``, ``<|system|>`` or ``<|user:name|>``, a newline, the text, a newline; by turn (null ones last), speaker, MD5 of the text, repeats
    included. ``part`` counts the rows of a dialogue from 0, ``start`` is the code point at which ``rendered`` begins in it. ``mask`` lists start-end (code points
    of the whole dialogue, end exclusive) of the assistant's texts, comma-joined.
    The speaker ``system`` takes no perspective. A null speaker is ``unknown``; a null text is empty; messages without a conversation are one.
    Other columns are not read. An empty table gives no rows.
    """
    own = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("late", F.col("turn").isNull())
    # messages alike in all are one row with a number, so that no place in the order is crowded
    once = own.groupBy("conv_id", "late", "turn", "name", "text").agg(F.count("*").alias("n"))
    known = F.when(F.col("name") == system, F.lit("<|system|>\n")) if system is not None else F.when(F.lit(False), "")
    once = once.withColumns({"digest": F.md5("text"), "head": known.otherwise(F.concat(F.lit("<|user:"), "name", F.lit("|>\n")))})
    once = once.withColumn("unit", F.expr("cast(char_length(head) + char_length(text) + 1 as bigint)")).withColumn("units", F.expr("unit * n"))
    placed = running_sums(once, ["conv_id"], ["late", "turn", "name", "digest"], first="n", at="units")
    rows = placed.withColumn("part", F.explode(F.expr(f"sequence(first div {whole}, (first + n - 1) div {whole})")))
    rows = rows.withColumn("skip", F.expr(f"greatest(0L, part * {whole} - first)")).withColumn("m", F.expr(f"least(n, (part + 1) * {whole} - first) - skip"))
    rows = rows.withColumns({"at": F.expr("at + skip * unit"), "first": F.expr("first + skip")})
    earlier = Window.partitionBy("conv_id", "part", "name").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    rows = materialize(rows.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0))).select("conv_id", "part", "first", "name", "text", "head", "m", "at", "unit", "earlier"), "chat-rows")
    # what each speaker has said before each part: a row a part and speaker
    counts = rows.groupBy("conv_id", "part", "name").agg(F.sum("m").alias("said"))
    speakers = counts.select(F.col("conv_id").alias("c"), F.col("name").alias("assistant")).distinct()
    if system is not None:
        speakers = speakers.filter(F.col("assistant") != system)
    grid = counts.select("conv_id", "part").distinct().join(speakers, F.expr("conv_id <=> c")).drop("c")
    said = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("name").alias("a"), "said")
    grid = grid.join(said, F.expr("conv_id <=> c and part = p and assistant = a"), "left")
    past = Window.partitionBy("conv_id", "assistant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("conv_id", "part", "assistant", F.coalesce(F.sum("said").over(past), F.lit(0)).alias("before"))
    views = grid.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.collect_list(F.struct("assistant", "before")).alias("views"))
    pieces = rows.groupBy("conv_id", "part").agg(F.expr("array_sort(collect_list(struct(first, name, text, head, m, at, unit, earlier))) as x"), F.min("at").alias("at"))
    pieces = pieces.withColumn("x", F.expr("flatten(transform(x, y -> transform(sequence(0L, y.m - 1), j -> struct(y.name, y.text, y.head, y.at + j * y.unit as at, y.earlier + j as earlier))))"))
    seen = pieces.join(views, F.expr("conv_id <=> c and part = p")).select("conv_id", "part", "at", "x", F.explode("views").alias("v")).select("conv_id", "part", "at", "x", "v.*")
    # the assistant's own heads are longer or shorter than those that ``at`` counts
    more = f"({len(ASSISTANT)} - char_length(concat('<|user:', assistant, '|>\n')))"
    seen = seen.withColumn("more", F.expr(f"cast({more} as bigint)")).withColumn("own", F.expr("filter(x, y -> y.name = assistant)"))
    begin = f"y.at + (before + y.earlier) * more + {len(ASSISTANT)}"
    return seen.select(
        "conv_id", "assistant", "part",
        F.expr("at + before * more").alias("start"),
        F.expr("cast(size(x) as bigint)").alias("n_messages"),
        F.expr("cast(size(own) as bigint)").alias("n_masked"),
        F.expr(f"array_join(transform(x, y -> concat(if(y.name = assistant, '{ASSISTANT.strip()}\n', y.head), y.text, '\n')), '')").alias("rendered"),
        F.expr(f"array_join(transform(own, y -> concat({begin}, '-', {begin} + char_length(y.text))), ',')").alias("mask"),
    )
