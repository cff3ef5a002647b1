"""Words of many texts as flat numpy arrays, shared by the Arrow kernels.

A batch of texts becomes one array of 64-bit word hashes plus the offset of
each text, so that shingling, counting and scanning are array operations over
the whole batch and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel handles at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes hashed per step, small enough for the arrays to stay in a core's cache.
_STEP = 1 << 17

#: Space, tab, LF, VT, FF and CR: one byte each in UTF-8 and part of no other character.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: two rounds of xor-shift and odd multiplication."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _of_place(n: int) -> np.ndarray:
    return mix(np.arange(1001, 1001 + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PLACES = _of_place(4096)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``limit`` bytes of ``column`` (or one row).

    ``column`` holds texts, or lists, whose items count as eight bytes.
    """
    for batch in batches:
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 8) if pa.types.is_list(values.type) else pc.binary_length(values)
        lengths = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, without decoding; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def find_words(blob: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no separators."""
    apart = np.ones(len(blob) + 2, bool)
    apart[1:-1] = separators[blob]
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    return edges[::2], edges[1::2]


def hash_words(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: a sum of byte terms weighted by place."""
    global _PLACES
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    if len(sizes) and sizes.max() > len(_PLACES):
        _PLACES = _of_place(2 * int(sizes.max()))
    done = 0
    total = np.concatenate(([0], np.cumsum(sizes)))
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(total, total[done] + _STEP, side="right")) - 1)
        size = sizes[done:upto]
        first = total[done:upto] - total[done]
        place = np.arange(int(total[upto] - total[done])) - np.repeat(first, size)
        data = blob[np.repeat(starts[done:upto], size) + place]
        terms = _OF_BYTE[_LOWER[data] if lower else data] * _PLACES[place]
        out[done:upto] = np.add.reduceat(terms, first) if len(terms) else 0
        done = upto
    return mix(out ^ sizes.astype(np.uint64))


def flat_words(texts: Sequence[bytes], separators: np.ndarray = BLANKS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and ``len(texts) + 1`` offsets.

    ``lower`` treats A-Z as a-z.
    """
    blob = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = find_words(blob, separators)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hash_words(blob, starts, ends, lower), np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words, repeats kept.

    A text with fewer words gives one shingle of all its words; one without
    words gives none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    n = len(words)
    value = np.full(n, np.uint64(width))
    ends = np.repeat(offsets[1:], lengths)
    for k in range(width):
        here = np.arange(k, n + k)
        inside = here < ends
        step = mix(value * np.uint64(0xA24BAED4963EE407) + words[np.minimum(here, max(n - 1, 0))])
        value = np.where(inside, step, value)
    owner = np.repeat(offsets[:-1], counts)
    return value[owner + np.arange(int(out_offsets[-1])) - np.repeat(out_offsets[:-1], counts)], out_offsets


class UnitCache:
    """Token ids of byte strings, each distinct one encoded once.

    Strings are told apart by their bytes. ``encode`` takes distinct strings
    and gives their ids end to end and the number of each. What is remembered
    is bounded; forgetting costs time only.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most_units: int = 400_000) -> None:
        self.encode, self.most_units, self.most_tokens = encode, most_units, 10 * most_units
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.ids, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings laid end to end: the cache row of each distinct one, and which of these each is."""
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        told = strings.dictionary_encode()
        units, rows = told.dictionary.to_pylist(), self.rows
        if len(rows) > self.most_units or len(self.ids) > self.most_tokens:
            self._forget()
            rows = self.rows
        fresh = [u for u in units if u not in rows]
        if fresh:
            ids, count = self.encode(fresh)
            rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(count) - count))
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, count))
        return np.fromiter(map(rows.__getitem__, units), np.int64, len(units)), told.indices.to_numpy()

    def tokens(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given rows end to end, and the number of each."""
        size = self.sizes[row]
        return self.ids[np.repeat(self.starts[row] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size
