"""Token ids in files of Simple-8b words.

Coding.  A 64-bit word has a selector in its top four bits and 60 bits of payload:
selector ``s`` packs ``COUNTS[s]`` ids of ``BITS[s]`` bits each, the first id in
the lowest bits.  The encoder takes, at each place, the selector that packs most.
An id of ``ESCAPE`` or more is written as ``ESCAPE`` and kept whole in a list of
escapes beside the words.  Packing starts anew every ``BLOCK`` ids, and a table has
the word and escape offsets of every block, so a reader can decode any block, or
all of them at once with numpy.

File format.  Parquet files in the shared folder, a row for each run of documents:
shard and seq (their order is the order of doc_id), the doc_ids and id counts of
its documents, and one binary payload: four uint32 (ids, words, escapes, blocks),
then block offsets (two uint32 a block), words (uint64) and escapes (uint32), all
little-endian.  Spark's committer writes the files, so a lost executor's task is
simply written again.

Order.  Shard bounds are quantiles of doc_id (an evenly split, bounded list, read
from that column alone), so no hot source or group of copies can fill one shard;
each shard is one partition, sorted by doc_id.

Added tokens of the tokenizer file (such as an end-of-text mark) that a text spells out
get their own id, as the library gives it; texts with one are encoded in one piece.

Defined edge cases: a null text is empty and has only the end id; a null doc_id
sorts first; rows of one doc_id are ordered by the hash of their text; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.kernels import slices, text_bytes
from gleaner.llm.pieces import PieceCache
from gleaner.llm.session import prepare, shared_folder, shuffle_partitions

COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3)
BITS = tuple(60 // c for c in COUNTS)
ESCAPE = (1 << BITS[-1]) - 1
BLOCK = 4096
#: Pieces that the library encodes as one text.
PIECES = 2000

STORE_SCHEMA = "shard int, seq int, doc_ids array<bigint>, sizes array<int>, payload binary"


def pack(ids: np.ndarray) -> bytes:
    """One payload of all ids (unsigned 32-bit)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    escapes = ids[ids >= ESCAPE]
    values = np.minimum(ids, ESCAPE).astype(np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK + COUNTS[0], np.uint64)
    padded[: len(values)] = values
    # the least selector whose bits hold each id, then the largest over a growing window
    need = np.searchsorted(np.array([1 << b for b in BITS], np.uint64), padded, side="right").astype(np.uint8)
    best = np.full(len(padded), len(COUNTS) - 1, np.uint8)
    widest, width = need.copy(), 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while width < COUNTS[s]:
            np.maximum(widest[:-width], need[width:], out=widest[:-width])
            width += 1
        best[: len(padded) - width][widest[: len(padded) - width] <= s] = s
    step = np.array(COUNTS, np.int64)[best]
    # all blocks are walked at once: each round takes the next word of every block not yet at its end
    at, end = np.arange(n_blocks) * BLOCK, np.minimum((np.arange(n_blocks) + 1) * BLOCK, len(ids))
    begins = np.zeros(len(ids), bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        inside = at < end
        if not inside.all():
            at, end = at[inside], end[inside]
    at = np.flatnonzero(begins)
    first_word = np.searchsorted(at, np.arange(n_blocks) * BLOCK).astype(np.uint32)
    # a word that reaches over its block's end may only pack what is inside it
    inside = np.minimum((at // BLOCK + 1) * BLOCK, len(ids)) - at
    select = best[at].astype(np.int64)
    words = np.zeros(len(at), np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS)):
        rows = np.flatnonzero(select == s)
        if len(rows):
            cols = np.arange(count)
            part = np.where(cols[None, :] < inside[rows][:, None], padded[at[rows][:, None] + cols], np.uint64(0))
            words[rows] = np.bitwise_or.reduce(part << (cols * bits).astype(np.uint64), axis=1)
    words |= select.astype(np.uint64) << np.uint64(60)
    escaped = np.concatenate([[0], np.cumsum(ids >= ESCAPE)])
    first_escape = escaped[np.arange(n_blocks) * BLOCK].astype(np.uint32)
    table = np.stack([first_word, first_escape], axis=1).astype("<u4")
    head = struct.pack("<4I", len(ids), len(words), len(escapes), n_blocks)
    return head + table.tobytes() + words.astype("<u8").tobytes() + escapes.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """All ids of a payload; words of one selector are decoded together."""
    n, n_words, n_escapes, n_blocks = struct.unpack_from("<4I", payload)
    table = np.frombuffer(payload, "<u4", 2 * n_blocks, 16).reshape(-1, 2)
    words = np.frombuffer(payload, "<u8", n_words, 16 + 8 * n_blocks)
    escapes = np.frombuffer(payload, "<u4", n_escapes, 16 + 8 * n_blocks + 8 * n_words)
    out = np.zeros(n + COUNTS[0], np.uint32)
    if not n:
        return out[:0]
    select = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS, np.int64)[select]
    block = np.repeat(np.arange(n_blocks), np.diff(np.append(table[:, 0].astype(np.int64), n_words)))
    before = np.cumsum(count) - count
    at = block * BLOCK + before - before[table[:, 0].astype(np.int64)][block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s, (size, bits) in enumerate(zip(COUNTS, BITS)):
        rows = np.flatnonzero(select == s)
        if len(rows):
            cols = np.arange(size)
            part = (words[rows][:, None] >> (cols * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            to = at[rows][:, None] + cols
            keep = to < stop[rows][:, None]
            out[to[keep]] = part[keep]
    out = out[:n]
    if n_escapes:
        out[out == ESCAPE] = escapes
    return out


class LibraryEncoder:
    """The tokenizers library behind a cache of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)  # a byte-level token has a character for each byte
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = PieceCache(self._pieces, self._whole, whole_if=added)

    def _pieces(self, pieces: list[str]):
        """Ids and id counts of pieces, encoded many at a time as one text.

        No token reaches over a piece's end, and tokens stand for whole bytes, so the ends are
        found by counting bytes.  A piece that doesn't start with white space gets a newline
        before it, which is a token of its own and is taken out again.
        """
        bare = np.array([p[0] not in " \n" for p in pieces], bool)
        sizes = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)) + bare
        texts, groups = [], range(0, len(pieces), PIECES)
        for i in groups:
            texts.append("".join(["\n" + p if b else p for p, b in zip(pieces[i : i + PIECES], bare[i : i + PIECES].tolist())]))
        ids, lens = [], []
        for i, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            stop, until = np.cumsum(sizes[i : i + PIECES]), np.cumsum(self.bytes[own])
            ends = np.searchsorted(until, stop) + 1
            if len(until) < ends[-1] or (until[ends - 1] != stop).any():
                raise ValueError("the tokenizer is not a byte-level one that splits at white space")
            counts, first = np.diff(ends, prepend=0), bare[i : i + PIECES]
            ids.append(np.delete(own, (ends - counts)[first]))
            lens.append(counts - first)
        return np.concatenate(ids), np.concatenate(lens)

    def _whole(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        return self.cache.ids(data, offsets)


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return LibraryEncoder(path)


def write_store(df: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Encode all texts and write their ids in the order of ``key``."""
    spark = df.sparkSession
    n = max(1, shuffle_partitions(spark))
    cuts = df.agg(F.percentile_approx(key, [(i + 1) / n for i in range(n - 1)] or [0.5], 10 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    shard = F.lit(0)
    if cuts:
        # the number of bounds at or below the key, by binary search over a literal
        shard = F.when(F.col(key).isNotNull(), F.expr(_bucket(key, cuts, 0, len(cuts)))).otherwise(0)
    rows = (
        df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), shard.cast("int").alias("shard"))
        .repartitionById(n, F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
    )

    def run(batches):
        own, seq = encoder(tokenizer), 0
        for batch in batches:
            docs, shards = batch.column(0), np.asarray(batch.column(2))
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                flat, sizes = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id)
                sizes = sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cut = [0, *(np.flatnonzero(np.diff(shards[a:b])) + 1).tolist(), b - a]
                for i, j in zip(cut, cut[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(shards[a + i])], pa.int32()),
                            pa.array([seq], pa.int32()),
                            pa.array([docs.slice(a + i, j - i).to_pylist()], pa.list_(pa.int64())),
                            pa.array([sizes[i:j].tolist()], pa.list_(pa.int32())),
                            pa.array([pack(flat[ends[i] : ends[j]])], pa.binary()),
                        ],
                        ["shard", "seq", "doc_ids", "sizes", "payload"],
                    )
                    seq += 1

    rows.mapInArrow(run, STORE_SCHEMA).write.parquet(path)


def _bucket(key: str, cuts: list, low: int, high: int) -> str:
    """Nested IFs that find the number of cuts at or below the key."""
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"if(`{key}` < {cuts[mid]}, {_bucket(key, cuts, low, mid)}, {_bucket(key, cuts, mid + 1, high)})"


def read_store(spark, path: str, tokens: bool = False) -> DataFrame:
    """A row for each document of a store, decoded from its files.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with
    ``tokens``, the ids.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    schema = "doc_id bigint, shard int, seq int, inside bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", token_ids array<bigint>" if tokens else ""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = unpack(row["payload"])
                sizes = np.array(row["sizes"], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n = len(sizes)
                out = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.full(n, row["shard"], np.int32)),
                    pa.array(np.full(n, row["seq"], np.int32)),
                    pa.array(ends[:-1]),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "shard", "seq", "inside", "n_tokens", "ids_crc32"]
                if tokens:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(out, names)

    docs = store.mapInArrow(run, schema)
    # where each run starts: sums over the small run headers, first within a shard,
    # then over shards, of which there are as many as shuffle partitions
    runs = store.select("shard", "seq", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    shards = runs.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))
    out = docs.join(runs, ["shard", "seq"]).join(shards, "shard")
    start = (F.col("shard_start") + F.col("run_start") + F.col("inside")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32", *(["token_ids"] if tokens else []))


def store_round_trip(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a store of ``df`` in the shared folder and read it back."""
    spark = prepare(df.sparkSession)
    path = shared_folder(spark)
    write_store(df, tokenizer, end_id, path)
    return read_store(spark, path)
