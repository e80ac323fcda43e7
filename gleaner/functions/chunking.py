"""Sentence chunks of at most a given length, taken verbatim from a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import strip

#: Characters of a chunk, at most and at least, and of its context.
MOST, LEAST, CONTEXT = 600, 12, 800

#: Sentences that a fold packs before it appends them to a text's chunks.
BLOCK = 256

#: Fixed value: a chunk that starts so refers to what was said before.
ANAPHORIC = r"(?iU)^(?:that|this|it|they|the\s+same|those)\b"


def chunks(text: Column, most: int = MOST) -> Column:
    """Sentences packed greedily into chunks of at most ``most`` characters.

    Sentences end at white space after ``. ! ? ' " ) ]``; a longer one is cut at its
    last space or newline that fits, else hard.  White space between two packed
    sentences stays as it was.
    """
    body = strip(text)
    marked = F.regexp_replace(body, r"(?U)(?<=[.!?'\"\)\]])\s+", "\u0001$0\u0002")
    pairs = F.transform(
        F.split(marked, "\u0001"),
        lambda p: F.when(
            F.contains(p, F.lit("\u0002")),
            F.struct(F.substring_index(p, "\u0002", 1).alias("gap"), F.substring_index(p, "\u0002", -1).alias("s")),
        ).otherwise(F.struct(F.lit("").alias("gap"), p.alias("s"))),
    )
    cut = rf"(?U)([\s\S]{{1,{most}}}\z|[\s\S]{{1,{most - 1}}}(?=[ \n])|[\s\S]{{{most}}})\s*"

    def pieces(pair: Column) -> Column:
        long_ = F.transform(
            F.regexp_extract_all(pair["s"], F.lit(cut), F.lit(1)),
            lambda x, i: F.struct(
                F.when(i == 0, pair["gap"]).otherwise(F.lit("")).alias("gap"),
                F.regexp_replace(x, r"(?U)\s+$", "").alias("s"),
                (i > 0).alias("apart"),
            ),
        )
        whole = F.array(F.struct(pair["gap"].alias("gap"), pair["s"].alias("s"), F.lit(False).alias("apart")))
        return F.when(F.length(pair["s"]) > most, long_).otherwise(whole)

    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def pack(acc, x):
        fits = ~x["apart"] & acc["open"].isNotNull() & (F.length(acc["open"]) + F.length(x["gap"]) + F.length(x["s"]) <= most)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], x["gap"], x["s"]).alias("open"))).otherwise(
            F.struct(
                F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
                x["s"].alias("open"),
            )
        )

    def block(all_, acc, i):
        # a list that grows inside a fold is copied at each step, so it grows by blocks
        inner = F.aggregate(F.slice(all_, i * BLOCK + 1, BLOCK), F.struct(F.array().cast("array<string>").alias("done"), acc["open"].alias("open")), pack)
        return F.struct(F.concat(acc["done"], inner["done"]).alias("done"), inner["open"].alias("open"))

    def fold(all_):
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        return F.aggregate(
            blocks,
            state,
            lambda acc, i: block(all_, acc, i),
            lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))),
        )

    # in an array of one, so that the lambda computes the pieces once
    packed = F.transform(F.array(F.flatten(F.transform(pairs, pieces))), fold)[0]
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(packed)


def keeps(chunk: Column) -> Column:
    """Long enough, and not starting with a reference back."""
    return (F.length(chunk) >= LEAST) & ~chunk.rlike(ANAPHORIC)


def cut_context(text: Column, most: int = CONTEXT) -> Column:
    """At most ``most`` characters, cut at the last space or newline that fits."""
    head = F.substring(text, 1, most)
    at_gap = F.regexp_extract(head, r"(?s)^(.+)[ \n]", 1)
    cut = F.when(at_gap == "", head).otherwise(at_gap)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))
