"""Exact deduplication by recipes of content-defined chunks.

1. A map cuts every normalised text (white space deleted) at content-defined
   places and writes its recipe: the ordered 64-bit hashes of its chunks, with the
   text's SHA-256 and length.  Recipes are about 1/200 of the text.
2. Recipes that occur once belong to unique texts.  Only the chunks of the others
   are moved, once for each task and chunk, and grouped by hash and bytes: a hash
   that has one content is a verified identifier.  Texts with a hash of several
   contents (a collision) are told apart by their SHA-256 instead.
3. Texts are equal when their ordered lists of identifiers are.  Groups are built by
   a partial aggregate, so a group of copies with a third of all rows costs one row
   a task, and the join back is between a row for each document and one for each
   group.

Of equal texts the row with the most code points in the original text stays, then
the smallest doc_id; of rows that repeat even that, one.

Defined edge cases: a null text counts as empty, and all empty texts are equal; a
null doc_id comes after all others; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, mix, slices, text_bytes
from gleaner.llm.session import prepare, written
from gleaner.llm.sketch import hash_bitmap, in_bitmap, split_by_map

#: Deleted before comparison.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Bytes of a chunk: least, about the mean beyond that, most.
LEAST, MEAN_BITS, MOST = 512, 11, 8192
_WINDOW = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)

_RECIPES = "doc_id bigint, n_chars bigint, text_sha256 string, shape bigint, recipe array<bigint>"


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last 32 bytes allows a cut."""
    h = _GEAR[data]
    width = 1
    while width < _WINDOW:  # doubling: h covers ``width`` bytes
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_bounds(places: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk bounds of the text at [start, end), its ends included."""
    bounds, at = [start], start
    own = places[np.searchsorted(places, start + LEAST) : np.searchsorted(places, end)].tolist()
    for place in own:
        while place - at > MOST:
            at += MOST
            bounds.append(at)
        if place - at >= LEAST:
            bounds.append(place)
            at = place
    while end - at > MOST:
        at += MOST
        bounds.append(at)
    if end > at or len(bounds) == 1:
        bounds.append(end)
    return bounds


def _chunked(column: pa.Array):
    """(normalised bytes, chunk bounds in them, code points of the original) of each text."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        chars = np.diff(chars[offsets[a : b + 1] - offsets[a]])
        plain = [data[x:y].tobytes().translate(None, WHITE) for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
        joined = b"".join(plain)
        places = cut_places(np.frombuffer(joined, np.uint8))
        at = 0
        for text, n in zip(plain, chars.tolist()):
            bounds = [p - at for p in chunk_bounds(places, at, at + len(text))]
            yield text, bounds, n
            at += len(text)


def _recipe(text: bytes, bounds: list[int]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(bounds, bounds[1:])], np.uint64)


def _shape(recipe: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(recipe.tobytes())


def recipes(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, text_sha256, shape (hash of the recipe) and recipe of each row."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n_chars, sha, shape, lists = [], [], [], []
            for body, bounds, n in _chunked(batch.column(1)):
                recipe = _recipe(body, bounds)
                n_chars.append(n)
                sha.append(hashlib.sha256(body).hexdigest())
                shape.append(_shape(recipe))
                lists.append(recipe.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            columns = [
                batch.column(0),
                pa.array(n_chars, pa.int64()),
                pa.array(sha),
                pa.array(np.array(shape, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "text_sha256", "shape", "recipe"])

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(frugal(run), _RECIPES)


def chunks_of_shapes(df: DataFrame, shapes, text: str = "text") -> DataFrame:
    """(hash, bytes) of chunks of texts whose shape is in the bitmap, once for each batch."""

    def run(batches):
        for batch in batches:
            found: dict[tuple[int, bytes], None] = {}
            for body, bounds, _ in _chunked(batch.column(0)):
                recipe = _recipe(body, bounds)
                if in_bitmap(shapes.value, np.array([_shape(recipe)], np.uint64))[0]:
                    for h, i, j in zip(recipe.view(np.int64).tolist(), bounds, bounds[1:]):
                        found[h, body[i:j]] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())],
                ["hash", "bytes"],
            )

    return df.select(text).mapInArrow(frugal(run), "hash bigint, bytes binary")


def equal_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    return _verdicts(df, text, key).drop("n_chars", "repeats")


def _verdicts(df: DataFrame, text: str, key: str) -> DataFrame:
    prepare(df.sparkSession)
    made = written(recipes(df, text, key))
    repeated = made.groupBy("shape").agg(F.count("*").alias("n")).where("n > 1").select("shape")
    contents = chunks_of_shapes(df, hash_bitmap(repeated, F.col("shape")), text).distinct()
    collided = contents.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    # shapes that use a collided hash; as a rule there are none and AQE drops the join
    unsure = made.select("shape", F.explode("recipe").alias("hash")).join(collided, "hash", "left_semi").select("shape").distinct()
    rows = made.join(unsure.withColumn("unsure", F.lit(True)), "shape", "left")
    rows = rows.withColumn("apart", F.when(F.col("unsure"), F.col("text_sha256")).otherwise("")).drop("unsure")
    last = F.coalesce(-F.col("doc_id"), F.lit(-(2**63)))
    groups = (
        rows.groupBy("shape", "recipe", "apart")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", last.alias("last"), "doc_id")).alias("best"))
        .where("group_size > 1")
        .select("shape", "recipe", "apart", "group_size", F.col("best.n_chars").alias("best_chars"), F.col("best.doc_id").alias("best_id"))
    )
    out = rows.join(groups, ["shape", "recipe", "apart"], "left")
    alone = F.col("group_size").isNull()
    is_best = alone | (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars")))
    # rows that repeat a kept row's doc_id and text: one of them stays
    same = Window.partitionBy("doc_id", "shape", "n_chars", "apart")
    numbered = out.withColumns({"_first": F.row_number().over(same.orderBy("text_sha256")) == 1, "repeats": F.count("*").over(same)})
    return numbered.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (is_best & F.col("_first")).alias("kept"),
        "text_sha256",
        "n_chars",
        "repeats",
    )


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows whose doc_id no dropped or repeated row has stay without being moved.
    """
    verdicts = written(_verdicts(df, text, key))
    place = lambda c: F.xxhash64(c.cast("bigint"))
    doubtful = verdicts.where("NOT kept OR repeats > 1").select(place(F.col("doc_id")).alias("place"))
    sure, df = split_by_map(df, place(F.col(key)), doubtful)
    kept = verdicts.where("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_chars"), "repeats"
    )
    kept = split_by_map(kept, place(F.col("_id")), doubtful)[1]
    value = F.coalesce(F.col(text), F.lit(""))
    plain = value
    for white in WHITE.decode():
        plain = F.replace(plain, F.lit(white), F.lit(""))
    # the input's columns travel as one, so that none of their names can clash
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    rows = df.select(
        row, F.col(key).cast("bigint").alias("id"), F.sha2(plain.cast("binary"), 256).alias("sha"), F.length(value).cast("bigint").alias("chars"), F.xxhash64(text).alias("h")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("chars") == F.col("_chars"))
    joined = rows.join(kept, same)
    # rows that repeat a kept row: one of each stays
    one = Window.partitionBy("_id", "_sha").orderBy("h")
    again = joined.where("repeats > 1").withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return sure.unionByName(joined.where("repeats = 1").select("row.*")).unionByName(again.select("row.*"))
