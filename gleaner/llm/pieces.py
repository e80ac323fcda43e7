"""Cut texts into pieces that byte-level BPE never merges across, and look them up.

The usual byte-level BPE pattern starts a new match at every change from a
non-space to a white-space character.  So a text may be cut there, each piece be
tokenized once, and the ids of a text be gathered by piece.  Only plain spaces and
newlines are cut at; texts with other or repeated white space are given to
``whole`` in one, which costs more and is just as right.  So are texts that have one of
the byte strings ``whole_if``, which a tokenizer may look for before its pattern.

Pieces are known by a 64-bit hash of their bytes (kernels.span_hash).
"""

from __future__ import annotations

import numpy as np

from gleaner.llm.kernels import HashTable, gather, prefix_hash, span_hash

#: Pieces that one Python worker remembers.
CAPACITY = 450_000

_GAP = np.zeros(256, bool)
_GAP[[0x0A, 0x20]] = True
#: Other white space: control characters, and the first two bytes of longer ones.
_CONTROL = np.zeros(256, bool)
_CONTROL[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of texts that may have white space which the fast cut doesn't handle."""
    n = len(data)
    gap = _GAP[data]
    last = np.zeros(n + 1, bool)
    last[offsets] = True  # at n + 1 stands the end of the last text
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    bad = (gap & (after | last[1:])) | _CONTROL[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        white = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        white |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        white |= (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        bad[lead] |= white
    return np.unique(np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1)


class PieceCache:
    """Ids of texts, by way of remembered pieces.

    ``encode(pieces)`` returns ``(ids, lengths)`` of a list of distinct pieces;
    ``whole(text)`` returns the ids of one text of any shape.  At ``capacity`` the
    half that most slices used is kept.
    """

    def __init__(self, encode, whole, capacity: int = CAPACITY, whole_if: list[bytes] = ()):
        self.encode, self.whole, self.capacity, self.whole_if = encode, whole, capacity, whole_if
        self.table = HashTable()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        size = 1 << 16
        self.keys, self.at = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.len, self.hits = np.zeros(size, np.int32), np.zeros(size, np.int32)

    def _spelled_out(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw, found = data.tobytes(), []
        for mark in self.whole_if:
            at = raw.find(mark)
            while at >= 0:
                found.append(at)
                at = raw.find(mark, at + 1)
        return np.unique(np.searchsorted(offsets, np.array(found, np.int64), side="right") - 1)

    def _forget(self) -> None:
        n = self.table.n
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[: self.capacity // 2])
        keys, lens, hits = self.keys[keep], self.len[keep], self.hits[keep] // 2
        ids = gather(self.flat, self.at[keep], lens)
        self.table, self.used = HashTable(), 0
        self._add(keys, ids, lens)
        self.hits[: len(keep)] = hits

    def _add(self, keys: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = self.table.n, len(keys)
        while n + k > len(self.at):
            self.keys, self.at, self.len, self.hits = (np.resize(x, 2 * len(x)) for x in (self.keys, self.at, self.len, self.hits))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.keys[n : n + k], self.len[n : n + k], self.hits[n : n + k] = keys, lens, 0
        self.at[n : n + k] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.table.add(keys)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        odd = odd_texts(data, offsets)
        if self.whole_if:
            odd = np.union1d(odd, self._spelled_out(data, offsets))
        cut = _GAP[data]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        for i in odd.tolist():
            cut[offsets[i] + 1 : offsets[i + 1]] = False
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, offsets)
        ends = np.append(starts[1:], len(data))
        plain = np.ones(n, bool)
        plain[odd] = False
        use = np.repeat(plain, np.diff(first))
        keys = span_hash(prefix_hash(data), starts, ends)
        rows = self.table.find(keys)
        rows[~use] = 0
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            if self.table.n and self.table.n + len(distinct) > self.capacity:
                self._forget()
                rows = self.table.find(keys)
                rows[~use] = 0
                new = np.flatnonzero(rows < 0)
                distinct, at = np.unique(keys[new], return_index=True)
            if len(distinct):
                raw = data.tobytes()
                pick = new[at]
                spans = zip(starts[pick].tolist(), ends[pick].tolist())
                ids, lens = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in spans])
                self._add(distinct, ids, lens)
                rows[new] = self.table.find(keys[new])
        seen = np.unique(rows[use])
        self.hits[seen] += 1
        lens = np.where(use, self.len[rows], 0)
        flat = gather(self.flat, self.at[rows], lens)
        bounds = np.concatenate([[0], np.cumsum(lens)])[first]
        if not len(odd):
            return flat, np.diff(bounds)
        pieces = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        for i in odd.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            pieces[i] = np.asarray(self.whole(text), np.uint32)
        return np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, n)
