"""Byte-level BPE by length-bucketed padded numpy matrices.

All distinct pretokens of a batch are encoded together.  They are put into buckets
by byte length; a bucket is a matrix of symbols, one pretoken a row, padded with -1.
Each round looks up the rank of every adjacent pair in a hash table (open
addressing, vectorised), and every row merges its leftmost pair of least rank.
Merged cells are compacted away, and rows without a mergeable pair leave the
matrix.  Merging the least-ranked pair first is what the reference encoders do, so
ids are equal to theirs.

Defined edge cases: null and empty texts have no ids; ids decode to the text's
UTF-8 bytes exactly; a pretoken of more than ``LONG`` bytes (a text without white
space) is merged by the same rule from a heap of its pairs instead of in a matrix,
where each merge would cost a pass over the whole row: n log n steps for n bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, gather, slices, text_bytes
from gleaner.llm.pieces import PieceCache

#: Cells of a padded matrix; a bucket with more is cut by rows.
MATRIX_CELLS = 1 << 20
#: Bytes of a pretoken from which on a heap is used.
LONG = 256


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Ranks of mergeable pairs of token ids, by hashed lookup of whole arrays."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens) if t}
        left, right, merged = [], [], []
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.mask = np.uint64((1 << max(4, int(len(keys) * 4).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, ~np.uint64(0))
        self.ranks = np.full(int(self.mask) + 1, NONE, np.int32)
        values, slots, todo = np.array(merged, np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == ~np.uint64(0)]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)) & self.mask

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge; ids below 0 never do."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slot(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((at != keys) & (at != ~np.uint64(0)))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (at != ~np.uint64(0))]
        out[(left < 0) | (right < 0)] = NONE
        return out


NONE = np.int32(2**31 - 1)


def merge_matrix(matrix: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Final ids of each row of a padded matrix: a flat array and row lengths."""
    n, width = matrix.shape
    done = np.full((n, width), -1, np.int32)
    rows = np.arange(n)
    ranks = table.lookup(matrix[:, :-1].ravel(), matrix[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        at = ranks.argmin(axis=1)  # leftmost of the least
        own = np.arange(len(rows))
        best = ranks[own, at]
        over = best == NONE
        if over.any():
            done[rows[over], : matrix.shape[1]] = matrix[over]
            keep = ~over
            rows, matrix, ranks, at, best = rows[keep], matrix[keep], ranks[keep], at[keep], best[keep]
            own = np.arange(len(rows))
            if not len(rows):
                break
        width = matrix.shape[1]
        matrix[own, at] = best
        # compaction: every cell right of the merged pair moves one to the left
        cols = np.arange(width - 1)
        matrix = np.take_along_axis(matrix, cols + (cols[None, :] > at[:, None]), axis=1)
        if width == 2:
            done[rows, :1] = matrix
            break
        cols = np.arange(width - 2)
        ranks = np.take_along_axis(ranks, cols + (cols[None, :] >= at[:, None]), axis=1)
        # only the pairs around the merged cell are new
        left = np.maximum(at - 1, 0)
        fresh = table.lookup(matrix[own, left], matrix[own, left + 1])
        has = at > 0
        ranks[own[has], left[has]] = fresh[has]
        right = np.minimum(at, width - 3)
        fresh = table.lookup(matrix[own, right], matrix[own, right + 1])
        has = at <= width - 3
        ranks[own[has], right[has]] = fresh[has]
    kept = done >= 0
    return done[kept], kept.sum(axis=1)


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Final ids of one long pretoken: the leftmost pair of least rank first, from a heap.

    Symbols form a linked list; a heap entry is stale once a symbol it was made for has changed.
    """
    ids = ids.astype(np.int32)
    ranks = table.lookup(ids[:-1], ids[1:])
    at = np.flatnonzero(ranks != NONE)
    heap = list(zip(ranks[at].tolist(), at.tolist(), ids[at].tolist(), ids[at + 1].tolist()))
    heapq.heapify(heap)
    symbol = ids.tolist()
    end = len(symbol)
    after, before = list(range(1, end + 1)), list(range(-1, end - 1))
    known: dict[tuple[int, int], int] = {}

    def offer(i: int, j: int) -> None:
        pair = symbol[i], symbol[j]
        rank = known.get(pair)
        if rank is None:
            rank = known[pair] = int(table.lookup(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
        if rank != NONE:
            heapq.heappush(heap, (rank, i, *pair))

    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= end or symbol[j] != right:
            continue
        symbol[i], symbol[j] = rank, -1
        after[i] = after[j]
        if after[j] < end:
            before[after[j]] = i
            offer(i, after[j])
        if before[i] >= 0:
            offer(before[i], i)
    return np.array([s for s in symbol if s >= 0], np.int32)


def encode_pretokens(pretokens: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pretokens in order, flat, and their lengths."""
    lens = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
    data = table.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
    starts = np.cumsum(lens) - lens
    order = np.argsort(lens, kind="stable")
    counts = np.zeros(len(pretokens), np.int64)
    flats: list[np.ndarray] = []
    i = 0
    while i < len(order):
        shortest = lens[order[i]]
        # a bucket holds lengths up to a quarter more than its shortest
        most = shortest + max(1, shortest // 4)
        j = int(np.searchsorted(lens[order], most if shortest > LONG else min(most, LONG), side="right"))
        width = int(lens[order[j - 1]])
        j = min(j, i + max(1, MATRIX_CELLS // max(1, width)))
        width = int(lens[order[j - 1]])
        rows = order[i:j]
        if width <= 1:
            flat, n = gather(data, starts[rows], lens[rows]), lens[rows]
        elif shortest > LONG:
            each = [merge_long(data[starts[r] : starts[r] + lens[r]], table) for r in rows.tolist()]
            flat, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        else:
            cols = np.arange(width)
            inside = cols[None, :] < lens[rows][:, None]
            matrix = np.where(inside, data[np.where(inside, starts[rows][:, None] + cols[None, :], 0)], np.int32(-1))
            flat, n = merge_matrix(matrix, table)
        flats.append(flat)
        counts[rows] = n
        i = j
    joined = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    # joined is in the order of length; put it back
    in_order = counts[order]
    begin = np.zeros(len(order), np.int64)
    begin[order] = np.cumsum(in_order) - in_order
    return gather(joined, begin, counts).astype(np.uint32), counts


class MatrixEncoder:
    """Encoder and decoder of one rank file and one pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.tokens = read_ranks(ranks_path)
        self.table = PairTable(self.tokens)
        self.pattern = regex.compile(pattern)
        lens = np.array([len(t) for t in self.tokens], np.int64)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.token_len, self.token_at = lens, np.cumsum(lens) - lens
        self.cache = PieceCache(self._pieces, self._whole)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pattern.findall(p) for p in pieces]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for f in found for w in f))}
        ids, lens = encode_pretokens([w.encode("utf-8", "replace") for w in distinct], self.table)
        use = np.fromiter((distinct[w] for f in found for w in f), np.int64)
        flat = gather(ids, (np.cumsum(lens) - lens)[use], lens[use])
        per = np.array([len(f) for f in found], np.int64)
        ends = np.concatenate([[0], np.cumsum(lens[use])])
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(per)])])

    def _whole(self, text: str) -> np.ndarray:
        return self._pieces([text])[0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and offsets), flat, and each text's count."""
        return self.cache.ids(data, offsets)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids]).tobytes()


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> MatrixEncoder:
    """One encoder a Python worker."""
    return MatrixEncoder(ranks_path, pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``df`` with token ids, their count and hashes of ids and of the decoded bytes.

    Adds ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256`` string, and with
    ``ids`` the array ``token_ids``.  Each text is decoded again from its ids.  Input
    columns of these names are replaced.
    """
    added = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    added += [("token_ids", "array<int>")] if ids else []
    kept = df.drop(*[n for n, _ in added])
    schema = ", ".join(f"`{n}` {t}" for n, t in [(f.name, f.dataType.simpleString()) for f in kept.schema] + added)
    names, place = [*kept.columns, *[n for n, _ in added]], kept.columns.index(text)

    def run(batches):
        own = encoder(ranks_path, pattern)
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for a, b in slices(offsets):
                flat, sizes = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                each = [flat[ends[i] : ends[i + 1]] for i in range(b - a)]
                new = [
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(e.astype("<u4").tobytes()).hexdigest() for e in each]),
                    pa.array([hashlib.sha256(own.decode(e)).hexdigest() for e in each]),
                ]
                if ids:
                    new.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names)

    return kept.mapInArrow(frugal(run), schema)


def round_trips(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows of encode_texts() whose decoded bytes are the text's."""
    return df.where(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256) == F.col("decoded_sha256"))
