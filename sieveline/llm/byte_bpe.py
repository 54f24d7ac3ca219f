"""Byte-level BPE on length-bucketed padded matrices, and its inverse.

A text is split by the vocabulary's pattern; each match is encoded alone: while a neighbouring pair of its parts
joins to a known token, the leftmost pair of minimum rank is joined. Distinct matches are bucketed by length into
matrices of part ids, a row for each. Every round joins one pair in every row that still has one: ranks stand beside
the parts, argmin finds the leftmost minimum, the tail moves left by one (compaction), and only the two pairs next to
the join are looked up again, in an open-addressing hash table of pairs. Rows that are done leave the matrix.

Matches are found once for each distinct chunk of text (spans.Chunks), so repeated words cost a dictionary code.

Chunks end before a space or newline that follows a letter, digit or sign. A pattern that matches across such places
is found out by probes, and its texts are then split by the pattern alone.

Nulls and edges: a null or empty text has no ids and decodes to no bytes. Every byte is a token of the vocabulary, so
any text can be encoded, and decode(encode(text)) is the text's UTF-8. Repeated rows are encoded alike, an empty table
gives no rows. A very long text is one row of one task; its longest match is one row of a matrix, and takes 16 bytes of
memory a byte. Extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import TOKEN_BLOCK_BYTES, blocks, with_columns
from .spans import Chunks, cuts, whole

NONE = np.int64(1 << 40)
#: Cells of a matrix at most; longer buckets are worked off in slices.
CELLS = 1 << 21


class Pairs:
    """(left id, right id) -> id of the joined token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(10, int(2 * len(left)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int64)
        key = (left.astype(np.int64) << 32) | right
        slot, todo = self._home(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = key[free]  # of several, the last one written stays
            won = self.key[slot[todo]] == key[todo]
            self.value[slot[todo[won]]] = joined[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair joins to no token, or one side is padding (-1)."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(len(key), NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._home(key[todo])
        while len(todo):
            at = self.key[slot]
            hit = at == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (at >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out


def cuts_are_safe(find) -> bool:
    """Whether no match of the pattern goes on from a solid character into the space or newline after it."""
    ends = [*map(chr, range(33, 127)), "é", "ж"]
    starts = [g + x for g in (" ", "\n", "  ", " \n", "\n\n", "\n ") for x in ("", "a", "1", ".", "é", "'s")]
    return all(find(f"{x}{e}{s}") == find(f"{x}{e}") + find(s) for x in ("", "a", "7") for e in ends for s in starts)


class Codec:
    """ranks: token bytes -> id, every single byte among them. pattern: of the `regex` module."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        rows = [(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = Pairs(*(np.array(c, np.int64) for c in zip(*rows, strict=True))) if rows else Pairs(*(np.zeros(0, np.int64) for _ in range(3)))
        size = max(ranks.values()) + 1
        words = [b""] * size
        for t, k in ranks.items():
            words[k] = t
        self.words = pa.array(words, pa.large_binary())
        self.digits = pa.array([f"{k} ".encode() for k in range(size)], pa.large_binary())
        self.chunks = Chunks(self._chunks, cuts if cuts_are_safe(self.find) else whole)

    @classmethod
    def open(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _chunks(self, chunks: list[bytes]) -> list[list[int]]:
        found = [[m.encode() for m in self.find(c.decode("utf-8", "replace"))] for c in chunks]
        distinct = list(dict.fromkeys(m for ms in found for m in ms))
        known = dict(zip(distinct, self.encode(distinct), strict=True))
        return [[i for m in ms for i in known[m]] for ms in found]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, without splitting by the pattern."""
        out: list[list[int]] = [[] for _ in pieces]
        bucket: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (k := self.ranks.get(p)) is not None:
                out[i] = [k]
            elif p:
                bucket.setdefault((len(p) - 1).bit_length(), []).append(i)
        for width, rows in bucket.items():
            step = max(1, CELLS >> width)
            for j in range(0, len(rows), step):
                self._merge([pieces[i] for i in rows[j : j + step]], rows[j : j + step], out)
        return out

    def _merge(self, pieces: list[bytes], rows: list[int], out: list[list[int]]) -> None:
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        m = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        rank = np.full((len(pieces), width), NONE)  # rank[:, i]: of parts i and i + 1
        if width > 1:
            rank[:, :-1] = self.pairs.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(pieces), -1)
        row = np.array(rows)
        while len(m):
            at = rank.argmin(1)
            own = np.arange(len(m))
            best = rank[own, at]
            done = best >= NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[row[i]] = m[i, : size[i]].tolist()
                go = ~done
                m, rank, size, row, at, best = m[go], rank[go], size[go], row[go], at[go], best[go]
                if not len(m):
                    return
                width = int(size.max())
                m, rank, own = m[:, :width], rank[:, :width], np.arange(len(m))
            m[own, at] = best
            tail = np.arange(m.shape[1])[None, :-1] > at[:, None]
            m[:, :-1] = np.where(tail, m[:, 1:], m[:, :-1])
            rank[:, :-1] = np.where(tail[:, :], rank[:, 1:], rank[:, :-1])
            m[:, -1], rank[:, -1] = -1, NONE
            size -= 1
            nxt = np.minimum(at + 1, m.shape[1] - 1)
            rank[own, at] = self.pairs.get(m[own, at], np.where(at + 1 < m.shape[1], m[own, nxt], -1))
            prev = np.maximum(at - 1, 0)
            rank[own, prev] = np.where(at > 0, self.pairs.get(m[own, prev], m[own, at]), rank[own, prev])

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text)."""
        return self.chunks.ids(data, off)

    def _joined(self, table: pa.Array, ids: np.ndarray, n: np.ndarray) -> tuple[memoryview, np.ndarray]:
        got = pc.take(table, pa.array(ids.astype(np.int64)))
        off = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        return memoryview(got.buffers()[2] or b""), off[np.concatenate([[0], np.cumsum(n)])]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[memoryview]:
        """The bytes of each text; ids and n as from texts()."""
        data, at = self._joined(self.words, ids, n)
        return [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decimal(self, ids: np.ndarray, n: np.ndarray) -> list[memoryview]:
        """Each text's ids as decimals joined by a space."""
        data, at = self._joined(self.digits, ids, n)
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_open: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, which every executor has at path."""
    if (path, pattern) not in _open:
        _open[path, pattern] = Codec.open(path, pattern)
    return _open[path, pattern]


def _mapped(docs: DataFrame, path: str, pattern: str, column: str, fields: list[T.StructField], make) -> DataFrame:
    names = [c for c in docs.columns if c not in {f.name for f in fields}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        own = codec(path, pattern)
        for b, data, off in blocks(batches, "last", TOKEN_BLOCK_BYTES):
            yield [*b.columns[:-1], *make(own, data, off)]

    return with_columns(docs, names, column, run, fields)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of the text, array<int>."""

    def make(own: Codec, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        flat, n = own.texts(data, off)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.astype(np.int32)))]

    return _mapped(docs, path, pattern, text, [T.StructField(ids, T.ArrayType(T.IntegerType(), True))], make)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; ids and decoded bytes stay in the worker."""

    def make(own: Codec, data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        flat, n = own.texts(data, off)
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        return [pa.array(n.astype(np.int64)), sha(own.decimal(flat, n)), sha(own.decode(flat, n))]

    return _mapped(docs, path, pattern, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make)
