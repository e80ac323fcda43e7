"""A bitmap of fixed size over 64-bit hashes, built by Spark, for use in map tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.kernels import give_back

#: The bitmap has 2**BITS bits (2 MB), whatever the input: it may be broadcast.
BITS = 24


def _words(key: Column, df: DataFrame) -> DataFrame:
    """(word, bits): the words of the bitmap that have a bit set, at most 2**(BITS - 6)."""
    place = F.shiftrightunsigned(key, 64 - BITS)
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    return (
        df.select(place.alias("_place"))
        .where(F.col("_place").isNotNull())
        .select(F.shiftrightunsigned("_place", 6).alias("word"), bit.alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def split_by_map(df: DataFrame, key: Column, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in ``marked``, all other rows), by the bitmap.

    ``marked`` has one column of well-mixed longs.  The map's words are joined by
    broadcast (4 MB at most), so the first frame's rows, texts and all, are not shuffled
    for a join that couldn't touch them; a full map only makes the second frame larger.
    """
    words = _words(F.col(marked.columns[0]), marked)
    # the input's columns travel as one, so that none of their names can clash
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    placed = df.select(row, F.shiftrightunsigned(key, 64 - BITS).alias("place"))
    seen = placed.join(F.broadcast(words), F.shiftrightunsigned("place", 6) == F.col("word"), "left")
    hit = F.coalesce(F.expr("shiftrightunsigned(bits, cast(place & 63 as int)) & 1") == 1, F.lit(False))
    return tuple(seen.where(c).select("row.*") for c in (~hit, hit))


def hash_bitmap(df: DataFrame, key: Column):
    """Broadcast bitmap with the bit of every key set.

    ``key`` must be a well-mixed long.  Its top bits name the bit, so at most
    2**(BITS - 6) words come to the driver.  A set bit may belong to another key:
    use it to leave out what cannot matter, never as proof.
    """
    words = _words(key, df).toPandas()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    del words
    give_back()
    return df.sparkSession.sparkContext.broadcast(table)


def in_bitmap(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (int64 or uint64) have their bit set."""
    place = keys.astype(np.uint64, copy=False) >> np.uint64(64 - BITS)
    return ((table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)) == 1
