"""Texts cut at white space into chunks that tokenizers handle alone, each distinct chunk once.

Natural text repeats its words. A block of texts is cut into chunks, the distinct ones are found in C++ by Arrow's
dictionary encoding, and only chunks that the worker has not met are tokenized. Ids of texts are then gathered by
numpy. A worker remembers short chunks only, and CACHE_BYTES of them: a full cache keeps what it met in several blocks.
Long chunks, such as a text without ASCII spaces, are tokenized each time they come.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Bytes of the longest chunk that is remembered.
LONG = 64
#: Bytes that a worker remembers before it starts anew, and what a chunk takes beside its own bytes.
CACHE_BYTES, ENTRY = 48 << 20, 120


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of chunks: the texts' starts, and each space or newline after a byte that surely ends no white space.

    A character of two bytes ends white space only if its first byte is C2 (U+0085, U+00A0); of longer characters
    some are white space, so nothing is cut after them.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    gap = (data == 32) | (data == 10)
    solid = (data > 32) & (data < 127)
    solid[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    first = np.zeros(len(data), bool)
    first[1:] = gap[1:] & solid[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def whole(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of texts that hold anything: each text is one chunk."""
    return np.unique(off[:-1][off[:-1] < len(data)]) if len(data) else np.zeros(0, np.int64)


def picked(flat: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ids of these rows in order; flat: ids of all rows, lens: ids a row."""
    size = lens[rows]
    at = (np.cumsum(lens) - lens)[rows] - (np.cumsum(size) - size)
    return flat[np.repeat(at, size) + np.arange(int(size.sum()))]


class Chunks:
    """encode: distinct chunks (bytes) -> their ids, a list of lists or (ids in order, ids a chunk). cut: starts of the chunks of a block."""

    def __init__(self, encode: Callable, cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = cuts):
        self.encode, self.cut = encode, cut
        self._keep([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _keep(self, chunks: list[bytes], flat: np.ndarray, lens: np.ndarray) -> None:
        self.rank: dict[bytes, int] = dict(zip(chunks, range(len(chunks)), strict=True))
        self.flat, self.lens = flat, lens  # ids of the chunks, in the order of rank
        self.met = np.zeros(len(chunks), np.int32)  # blocks that held the chunk
        self.size = sum(map(len, chunks)) + ENTRY * len(chunks) + flat.nbytes

    def _shrink(self) -> None:
        """Chunks met in one block only go; all go, if the others take over half of the room."""
        rows = np.flatnonzero(self.met > 1)
        mark = (self.met > 1).tolist()
        self._keep([c for c, m in zip(self.rank, mark, strict=True) if m], picked(self.flat, self.lens, rows), self.lens[rows])
        if 2 * self.size > CACHE_BYTES:
            self._keep([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, ids per text)."""
        start = self.cut(data, off)
        n = len(off) - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        bounds = np.append(start, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.size > CACHE_BYTES:
            self._shrink()
        row = np.fromiter(map(self.rank.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.met[row[row >= 0]] += 1
        missing = np.flatnonzero(row < 0)
        long = np.fromiter(map(len, map(distinct.__getitem__, missing.tolist())), np.int64, len(missing)) > LONG
        if len(short := missing[~long]):
            new = [distinct[i] for i in short.tolist()]
            flat, lens = self._encoded(new)
            row[short] = base = len(self.rank) + np.arange(len(new))
            self.rank.update(zip(new, base.tolist(), strict=True))
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
            self.met = np.append(self.met, np.ones(len(new), np.int32))
            self.size += sum(map(len, new)) + ENTRY * len(new) + flat.nbytes
        flat, lens = self.flat, self.lens
        if len(far := missing[long]):
            more, size = self._encoded([distinct[i] for i in far.tolist()])
            row[far] = len(lens) + np.arange(len(far))
            flat, lens = np.concatenate([flat, more]), np.concatenate([lens, size])
        row = row[coded.indices.to_numpy()]
        per_chunk = np.concatenate([[0], np.cumsum(lens[row])])
        edge = per_chunk[np.searchsorted(start, off)]
        return picked(flat, lens, row), np.diff(edge)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, ids per chunk)."""
        got = self.encode(chunks)
        if isinstance(got, tuple):
            return got
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens
