"""Alignment of two tokenizers' tokens by byte offsets: a byte-level BPE (A) and a sentencepiece model (B).

Both tokenize a space and the text.  The places where tokens end are two sorted lists
of byte offsets.  The shorter list drives: each of its offsets gallops through the longer
one (steps of 1, 2, 4, ... from a hint, then binary search inside the last step).  Offsets
found are common ends, which cut both token lists into groups; differences of neighbouring
ranks say which tokens of the longer list a token overlaps.

Texts are cut into pieces before white space that follows other characters, where no token
of either kind reaches across (the model's vocabulary is checked for it), and every
distinct piece is tokenized and aligned once for each block of texts a worker remembers.
Pieces are told apart by their bytes.

How many documents hold a pair of ids linked is counted over the corpus:

1. a map writes a row for each slice of documents (``SLICE`` bytes of text, or one text):
   its distinct pairs with the number of its documents that hold them, and its documents'
   pairs as packed numbers of that list;
2. pairs are summed over slices; the largest count of each A id has at most a row
   for each entry of A's vocabulary and is broadcast;
3. each slice gets the sums of its own pairs, and its documents' digests are made.

So what is shuffled are a slice's distinct pairs, not those of each document; a pair that
every slice has is spread over ``SALTS`` keys.

Defined edge cases: null and empty texts, and texts whose joined token bytes of either
tokenizer differ from space + text (one with U+2581), have no tokens: zeros and empty
groups; rows that repeat, with or without a doc_id, count as documents of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.kernels import frugal, gather, give_back, slices, text_bytes
from gleaner.llm.session import Tables, prepare, written

#: Bytes of text that a slice ends at.
SLICE = 16 << 20
#: Bytes of text that are aligned at once.
BLOCK = 1 << 21
#: Pieces, and bytes of pieces, that a worker remembers between blocks.
PIECES, PIECE_BYTES = 300_000, 16 << 20
#: Pieces that are tokenized as one text.
JOINED = 64
#: Keys over which a pair's slices are spread when they ask for its sum.
SALTS = 8

_GAP = np.zeros(256, bool)
_GAP[[0x0A, 0x20]] = True
_WHITE = _GAP.copy()
_WHITE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text."""
    return np.insert(data, offsets[:-1], np.uint8(0x20)), offsets + np.arange(len(offsets))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pieces: of each text, and of each space or newline after a character that isn't white."""
    white = _WHITE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        n = len(data)
        a, b, c = data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        white[lead[two] + 1] = True
        white[lead[three] + 2] = True
    cut = _GAP[data]
    cut[1:] &= ~white[:-1]
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut)


def gallop(values: np.ndarray, target: np.ndarray, hint: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many entries of ``target[low:high]`` are less than each value, plus ``low``.

    ``low < high``; the search starts at ``hint`` and goes up or down in doubling steps
    until the value is bracketed, then halves the bracket.
    """
    at = np.clip(hint, low, high - 1)
    up = target[at] < values
    lo, hi = np.where(up, at + 1, low), np.where(up, high, at)
    open_, step = np.arange(len(values)), 1
    while len(open_):
        rising, v = up[open_], values[open_]
        probe = np.where(rising, np.minimum(at[open_] + step, high[open_] - 1), np.maximum(at[open_] - step, low[open_]))
        less = target[probe] < v
        lo[open_] = np.where(less, np.maximum(lo[open_], probe + 1), lo[open_])
        hi[open_] = np.where(less, hi[open_], np.minimum(hi[open_], probe))
        # a lane goes on while it has not passed the value and not reached its end
        more = (less == rising) & (lo[open_] < hi[open_])
        open_, step = open_[more], 2 * step
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = target[mid] < values[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def overlaps(drive: np.ndarray, other: np.ndarray, d_first: np.ndarray, d_n: np.ndarray, o_first: np.ndarray, o_n: np.ndarray):
    """Overlap ranges and common ends of pieces whose driving list is the shorter one.

    ``drive`` and ``other`` are ends of tokens as offsets into all pieces together; the
    four arrays give each piece's first entry and number of entries in either.  Returns
    (numbers of driving entries, first and last overlapped entry of ``other`` for each,
    whether the entry's end is common).
    """
    piece = np.repeat(np.arange(len(d_n)), d_n)
    own = np.arange(len(piece)) - np.repeat(np.cumsum(d_n) - d_n, d_n)
    i = d_first[piece] + own
    low = o_first[piece]
    last = gallop(drive[i], other, low + own, low, low + o_n[piece])
    common = other[last] == drive[i]
    first = np.empty_like(last)
    first[1:] = (last + common)[:-1]
    head = own == 0
    first[head] = low[head]
    return i, first, last, common


class Aligner:
    """Both tokenizers, and what a worker remembers of pieces."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self._table(self._a_tokens())
        self.b_bytes = self._table(self._b_tokens())
        self.width = max(len(self.a_bytes[2]), len(self.b_bytes[2]))
        self.spelling = self._table([b"%d%s" % (i, end) for end in (b",", b"|", b";", b"") for i in range(self.width)])
        self._forget()

    def _a_tokens(self) -> list[bytes]:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        tokens = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            tokens[i] = bytes(byte[c] for c in token)
        return tokens

    def _b_tokens(self) -> list[bytes]:
        tokens = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁") or "\n" in piece[1:]:
                raise ValueError("the model has pieces over a space, so texts can't be cut there")
            tokens.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        return tokens

    @staticmethod
    def _table(tokens: list[bytes]):
        lens = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.groups: list[bytes] = []
        self.size, self.ids = 0, []
        self.n = {name: np.zeros(0, np.int64) for name in ("a", "b", "groups", "links")}
        self.sound = np.zeros(0, bool)
        self.links, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _alone_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone_b(self, texts: list[str]) -> list[list[int]]:
        """B puts a space before what it is given; a piece that has none loses that space's token again."""
        bare = [not t.startswith(" ") for t in texts]
        ids = self.b.encode([t if x else t[1:] for t, x in zip(texts, bare)], num_threads=1)
        one = self.b.piece_to_id("▁")
        return [own[1:] if x else own or [one] for own, x in zip(ids, bare)]

    def _encode(self, texts: list[str], size: np.ndarray, joined, alone, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, flat, and how many each has.

        Pieces that end without white space are given many as one text, and their ends found by
        counting bytes; where these don't come out even (a text with U+2581) each is given alone.
        """
        flatten = lambda ids: np.fromiter((i for own in ids for i in own), np.int64, sum(map(len, ids)))
        single = np.fromiter((t[-1].isspace() for t in texts), bool, len(texts))
        counts, starts, parts, used = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        plain = np.flatnonzero(~single)
        if len(plain):
            groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
            ids = joined([" ." + "".join([texts[k] for k in g.tolist()]) for g in groups])
            flat = flatten(ids)
            until = np.cumsum(lens[flat])
            ends = np.cumsum(np.concatenate([np.concatenate([[2], size[g]]) for g in groups]))
            own = np.repeat(np.arange(len(groups)), [len(g) + 1 for g in groups])
            at = np.searchsorted(until, ends)
            even = (at < len(until)) & (until[np.minimum(at, max(0, len(until) - 1))] == ends)
            # tokens and bytes of a group must both end where its last piece does
            bounds = np.cumsum([len(x) for x in ids])
            last = np.cumsum([len(g) + 1 for g in groups]) - 1
            good = (np.bincount(own, ~even, len(groups)) == 0) & (at[last] + 1 == bounds)
            if not good.all():
                # ends after an uneven group are shifted, so all of these pieces go alone
                single[plain] = True
            else:
                heads = np.ones(len(ends), bool)
                heads[last] = False
                first = at[heads] + 1
                counts[plain] = np.diff(at)[heads[:-1]]
                starts[plain] = first
                parts.append(flat)
                used = len(flat)
        rest = np.flatnonzero(single)
        if len(rest):
            ids = alone([texts[k] for k in rest.tolist()])
            counts[rest] = [len(x) for x in ids]
            starts[rest] = used + np.cumsum(counts[rest]) - counts[rest]
            parts.append(flatten(ids))
        return gather(np.concatenate(parts), starts, counts), counts

    def _learn(self, pieces: list[bytes]) -> None:
        """Tokenize and align new pieces."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        texts = [p.decode("utf-8", "replace") for p in pieces]
        # a piece with U+2581 is never sound
        marked = np.fromiter(("▁" in t for t in texts), bool, len(texts))
        texts = [" " if m else t for t, m in zip(texts, marked.tolist())] if marked.any() else texts
        flat_a, n_a = self._encode(texts, size, self._alone_a, self._alone_a, self.a_bytes[2])
        flat_b, n_b = self._encode(texts, size, lambda x: self.b.encode([t[1:] for t in x], num_threads=1), self._alone_b, self.b_bytes[2])
        body = np.frombuffer(b"".join(pieces), np.uint8)
        sound = self._sound(body, size, flat_a, n_a, self.a_bytes) & self._sound(body, size, flat_b, n_b, self.b_bytes) & ~marked
        sound &= (n_a > 0) & (n_b > 0)
        # ends as offsets into all sound pieces together, so that one sorted list serves all
        keep_a, keep_b = np.repeat(sound, n_a), np.repeat(sound, n_b)
        flat_a, flat_b, n_a, n_b = flat_a[keep_a], flat_b[keep_b], n_a * sound, n_b * sound
        end_a, end_b = np.cumsum(self.a_bytes[2][flat_a]), np.cumsum(self.b_bytes[2][flat_b])
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        left, right, cut_a, cut_b = [], [], [], []
        for chosen, swap in ((sound & (n_a <= n_b), False), (sound & (n_a > n_b), True)):
            p = np.flatnonzero(chosen)
            lists = (end_a, end_b, first_a[p], n_a[p], first_b[p], n_b[p])
            i, first, last, common = overlaps(*(lists if not swap else (end_b, end_a, *lists[4:], *lists[2:4])))
            spread = last - first + 1
            driver = np.repeat(i, spread)
            driven = np.repeat(first - (np.cumsum(spread) - spread), spread) + np.arange(int(spread.sum()))
            left.append(driven if swap else driver), right.append(driver if swap else driven)
            cut_a.append(last[common] if swap else i[common]), cut_b.append(i[common] if swap else last[common])
        left, right = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        cut_a, cut_b = np.sort(np.concatenate(cut_a)), np.sort(np.concatenate(cut_b))
        n_links = np.diff(np.searchsorted(left, np.append(first_a, len(flat_a))))
        n_groups = np.diff(np.searchsorted(cut_a, np.append(first_a, len(flat_a))))
        base = len(self.groups)
        for k, piece in enumerate(pieces):
            self.rows[piece] = base + k
            self.size += len(piece)
        self.groups += self._spelled(flat_a, flat_b, cut_a, cut_b, n_groups)
        for name, n in (("a", n_a), ("b", n_b), ("groups", n_groups), ("links", n_links)):
            self.n[name] = np.concatenate([self.n[name], n])
        self.sound = np.concatenate([self.sound, sound])
        self.at = np.concatenate([self.at, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, (flat_a[left] << 32) | flat_b[right]])

    @staticmethod
    def _sound(body: np.ndarray, size: np.ndarray, flat: np.ndarray, n: np.ndarray, table) -> np.ndarray:
        """Which pieces' token bytes are the piece's."""
        raw, at, lens = table
        ends = np.concatenate([[0], np.cumsum(lens[flat])])[np.concatenate([[0], np.cumsum(n)])]
        out = np.diff(ends) == size
        mine = flat[np.repeat(out, n)]
        differs = gather(raw, at[mine], lens[mine]) != body[np.repeat(out, size)]
        wrong = np.concatenate([[0], np.cumsum(differs)])[np.concatenate([[0], np.cumsum(size[out])])]
        out[out] = np.diff(wrong) == 0
        return out

    def _spelled(self, flat_a, flat_b, cut_a, cut_b, n_groups) -> list[bytes]:
        """Each piece's groups as text, empty for pieces without tokens."""
        groups = len(cut_a)
        # every id is written with what follows it: a comma, a bar after a group's A ids, a
        # semicolon after its B ids, and nothing at the end of a piece
        after_a, after_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        after_a[cut_a], after_b[cut_b] = 1, 2
        after_b[cut_b[(np.cumsum(n_groups) - 1)[n_groups > 0]]] = 3
        of_a = np.repeat(np.arange(groups), np.diff(np.concatenate([[-1], cut_a])))
        of_b = np.repeat(np.arange(groups), np.diff(np.concatenate([[-1], cut_b])))
        entry = np.concatenate([after_a * self.width + flat_a, after_b * self.width + flat_b])
        side = np.concatenate([2 * of_a, 2 * of_b + 1])
        entry = entry[np.argsort(side, kind="stable")]
        raw, at, lens = self.spelling
        text = gather(raw, at[entry], lens[entry]).tobytes()
        tokens = np.bincount(of_a, minlength=groups) + np.bincount(of_b, minlength=groups)
        until = np.concatenate([[0], np.cumsum(lens[entry])])[np.concatenate([[0], np.cumsum(tokens)])]
        ends = until[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        return [text[x:y] for x, y in zip(ends, ends[1:])]

    def pieces_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of every piece of all texts, and each text's first piece (one more at the end)."""
        if len(self.rows) > PIECES or self.size > PIECE_BYTES:
            self._forget()
        data, offsets = spaced(data, offsets)
        starts = piece_starts(data, offsets)
        ends = np.append(starts, len(data)).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.rows]
        if new:
            self._learn(new)
        place = np.fromiter((self.rows[p] for p in distinct), np.int64, len(distinct))
        return place[coded.indices.to_numpy()], np.searchsorted(starts, offsets)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a Python worker."""
    return Aligner(a_path, b_path)


class _Slice:
    """Documents of one slice: totals, group digests and distinct pairs of each."""

    def __init__(self):
        self.bytes, self.docs, self.totals, self.digests, self.held, self.pairs, self.times = 0, [], [], [], [], [], []

    def add(self, own: Aligner, docs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        rows, first = own.pieces_of(data, offsets)
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        bad = np.bincount(doc, ~own.sound[rows], n) > 0
        bad |= np.diff(offsets) == 0
        totals = np.stack([np.bincount(doc, own.n[k][rows], n).astype(np.int64) for k in ("a", "b", "groups", "links")])
        totals[:, bad] = 0
        spelled = own.groups
        for i in range(n):
            self.digests.append(b"" if bad[i] else hashlib.sha256(b";".join([spelled[r] for r in rows[first[i] : first[i + 1]].tolist()])).digest())
        good = ~bad[doc]
        # distinct pieces of each document, then distinct pairs, with their numbers
        width = len(own.groups)
        keys, times = np.unique(doc[good] * width + rows[good], return_counts=True)
        doc, piece = np.divmod(keys, max(1, width))
        links = own.n["links"][piece]
        doc, times = np.repeat(doc, links), np.repeat(times, links)
        pairs, place = np.unique(gather(own.links, own.at[piece], links), return_inverse=True)
        keys, place = np.unique(doc * max(1, len(pairs)) + place, return_inverse=True)
        doc, pair = np.divmod(keys, max(1, len(pairs)))
        self.docs.append(docs)
        self.totals.append(totals)
        self.held.append(np.bincount(doc, minlength=n))
        self.pairs.append(pairs[pair])
        self.times.append(np.bincount(place, times, len(keys)).astype(np.int64))
        self.bytes += int(offsets[-1])

    def row(self, number: int) -> pa.RecordBatch:
        docs = pa.concat_arrays(self.docs)
        pairs, place = np.unique(np.concatenate(self.pairs), return_inverse=True)
        body = b"".join(
            [
                np.concatenate(self.totals, axis=1).astype("<i8").tobytes(),
                np.array([bool(d) for d in self.digests], np.uint8).tobytes(),
                b"".join(d or bytes(32) for d in self.digests),
                np.concatenate(self.held).astype("<i4").tobytes(),
                np.concatenate(self.times).astype("<i4").tobytes(),
                place.astype("<i4").tobytes(),
            ]
        )
        ids = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [
            pa.array([number], pa.int64()),
            ids(docs),
            ids(pa.array(pairs, pa.int64())),
            ids(pa.array(np.bincount(place, minlength=len(pairs)).astype(np.int32))),
            pa.array([zlib.compress(body, 1)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["slice", "docs", "pairs", "held", "body"])


_SLICES = "slice bigint, docs array<bigint>, pairs array<bigint>, held array<int>, body binary"
_DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _digests(slice_: pa.Table, sums: pa.Table) -> pa.Table:
    """Digests of one slice's documents from the corpus-wide counts of its pairs."""
    docs = slice_.column("docs").chunk(0)[0].values
    n = len(docs)
    body = memoryview(zlib.decompress(slice_.column("body")[0].as_py()))
    totals = np.frombuffer(body, "<i8", 4 * n).reshape(4, n)
    at = 32 * n
    has = np.frombuffer(body, np.uint8, n, at)
    digests = bytes(body[at + n : at + 33 * n])
    held = np.frombuffer(body, "<i4", n, at + 33 * n).astype(np.int64)
    total = int(held.sum())
    times = np.frombuffer(body, "<i4", total, at + 37 * n).astype(np.int64)
    place = np.frombuffer(body, "<i4", total, at + 37 * n + 4 * total)
    count, best = np.zeros(sums.num_rows, np.int64), np.zeros(sums.num_rows, bool)
    pos = sums.column("pos").to_numpy()
    count[pos], best[pos] = sums.column("count").to_numpy(), sums.column("best").to_numpy()
    running = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(held)])])
    out = [docs, *[pa.array(t) for t in totals], pa.array(running(times * best[place])), pa.array(running(times * count[place]))]
    out.append(pa.array([digests[32 * i : 32 * i + 32].hex() if h else "" for i, h in enumerate(has.tolist())]))
    return pa.table(out, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def slice_table(df: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each slice of documents, see the module's text."""

    def run(batches):
        own, part, number, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0, _Slice()
        for batch in batches:
            docs = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, BLOCK):
                block.add(own, docs.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if block.bytes >= SLICE:
                    yield block.row(part + number)
                    number, block = number + 1, _Slice()
        if block.docs:
            yield block.row(part + number)

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(frugal(run), _SLICES)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair (A id * 2**32 + B id), count (documents that hold it linked), best (no pair of its A id has more)."""
    held = parts.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.pairs", "p.held")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("count"))
    counts = counts.withColumn("a", F.shiftrightunsigned("pair", 32))
    # a row for each id of A at most
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digests(df: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, what the corpus says of its links, hash of its groups."""
    tables = Tables(prepare(df.sparkSession))
    parts = tables.written(slice_table(df, a_path, b_path, text, key))
    counts = tables.written(pair_counts(parts))
    own = parts.select(F.col("slice").alias("of"), F.posexplode("pairs").alias("pos", "pair")).withColumn("salt", F.pmod(F.xxhash64("of"), F.lit(SALTS)).cast("int"))
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = own.join(spread, ["pair", "salt"]).select("of", "pos", "count", "best")

    def digest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _digests(left, right)
        give_back()
        return out

    found = written(parts.groupBy("slice").cogroup(sums.groupBy("of")).applyInArrow(digest, _DIGEST))
    tables.drop()
    return found


def align_texts(df: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The alignment itself: doc_id, a_ids, b_ids, and groups as (a_end, b_end) pairs.

    Group g has the A ids up to (not with) ``a_ends[g]`` and the B ids up to ``b_ends[g]``,
    from where group g - 1 ended.
    """
    schema = "doc_id bigint, a_ids array<bigint>, b_ids array<bigint>, a_ends array<bigint>, b_ends array<bigint>"

    def lists(each: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each])))

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                rows, first = own.pieces_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids_a, ids_b, ends_a, ends_b = [], [], [], []
                for i in range(b - a):
                    mine = rows[first[i] : first[i + 1]]
                    groups = []
                    if offsets[a + i] < offsets[a + i + 1] and own.sound[mine].all():
                        groups = [g.split("|") for g in b";".join([own.groups[r] for r in mine.tolist()]).decode().split(";")]
                    left, right = ([[int(x) for x in g[side].split(",")] for g in groups] for side in (0, 1))
                    for side, ids, ends in ((left, ids_a, ends_a), (right, ids_b, ends_b)):
                        ids.append(np.array([x for g in side for x in g], np.int64))
                        ends.append(np.cumsum([len(g) for g in side]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(lists, (ids_a, ids_b, ends_a, ends_b))],
                    ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"],
                )

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(frugal(run), schema)
