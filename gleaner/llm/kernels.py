"""numpy kernels over the UTF-8 bytes of many texts at once.

Texts come as one byte array and offsets, as Arrow holds them.  Words are hashed by
a polynomial over table values of their bytes modulo 2**64, from one running sum
over all bytes, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = max(n, 2 * SLICE_BYTES)
        _power = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE, np.uint64)]))
        inverse = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inverse, np.uint64)]))
    return _power, _inverse


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running sums from which span_hash() takes the hash of any span."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes anywhere."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(_STEP))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        return text_bytes(column.cast(pa.string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Bytes of text that the kernels work on at once; one longer text is one slice.
SLICE_BYTES = 1 << 19


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last + 1) of runs of texts with at most ``limit`` bytes, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def lower_table() -> np.ndarray:
    """Byte hash table under which A-Z equal a-z."""
    return _BYTE[_LOWER]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _WHITE):
    """(starts, ends) of all words, and the first word's number for each text.

    A word is a run of non-separator bytes inside one text.
    """
    n = len(data)
    text = ~separator[data]
    begin, stop = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begin[:n], stop[1:] = text, text
    if n:
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begin[1:n] &= ~text[:-1] | edge[1:n]
        stop[1:n] &= ~text[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _WHITE):
    """Hashes of all words with A-Z lower-cased, and each text's first word number."""
    starts, ends, first = words(data, offsets, separator)
    return span_hash(prefix_hash(data, lower_table()), starts, ends), first


class HashTable:
    """uint64 keys to row numbers in the order of insertion; grows as needed."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.mask = _U((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is new."""
        slots = (keys & self.mask).astype(np.int64)
        out = self.rows[slots]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slots] != keys))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & int(self.mask)
            rows = self.rows[slots]
            out[open_] = rows
            more = (rows >= 0) & (self.keys[slots] != keys[open_])
            open_, slots = open_[more], slots[more]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Add distinct new keys; they get the next rows."""
        if 2 * (self.n + len(keys)) > len(self.rows):
            old = self.rows >= 0
            have, rows = self.keys[old], self.rows[old]
            self._make(int(2 * (self.n + len(keys))).bit_length())
            self._put(have, rows)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slots = (keys & self.mask).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.rows[slots[todo]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.rows[slots[put]] = keys[put], rows[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            todo = todo[left[todo]]
            slots[todo] = (slots[todo] + 1) & int(self.mask)


def give_back() -> None:
    """Return freed memory to the system; a Python worker is reused and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def frugal(run):
    """A mapInArrow function that gives back its memory at the end of each partition."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` of all starts and lengths, joined."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return flat[shift + np.arange(total)]
