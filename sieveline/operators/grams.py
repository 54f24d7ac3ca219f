"""Trigrams of whole texts in Arrow batches: rows, lists, sums and stored blocks, made with numpy.

A text's windows are sorted where the text is: a list of positions never spans files, so lists, differences and sums need
no shuffle of single places. Rows of one file_idx are one file: where a corpus repeats a file_idx, its texts (not their
trigrams) are moved together first, and their positions are merged.

Texts are taken BLOCK bytes at a time, or one file's; numpy holds about a hundred bytes a code point of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams

BLOCK = 1 << 19
#: Distinct trigrams that a task sums up before it passes them on.
HELD = 1 << 20
RUNE = np.uint64(ngrams.RUNE_BITS)
MASK = np.uint64(ngrams.RUNE_MASK)


# ---------------------------------------------------------------- texts

def _large(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, code points) of a string array; null counts as empty, what is invalid is replaced."""
    texts = texts.fill_null("").cast(pa.large_string(), safe=False) if texts.null_count else texts.cast(pa.large_string(), safe=False)
    raw = texts.buffers()
    off = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8)[off[0] : off[-1]] if len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:
        good = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        data, off = np.frombuffer(b"".join(good), np.uint8), np.concatenate([[0], np.cumsum([len(g) for g in good])]).astype(np.int64)
        text = data.tobytes().decode()
    return data, off, np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Block:
    """The windows of some rows. keys: their columns but the text.

    window i starts at code point at[i] of the block; row[i] is its row, file[i] the number of its file, pos[i] its place.
    Windows are in order of files, and of places inside each. whole: neighbours with one file_idx are one file.
    """

    def __init__(self, batch: pa.RecordBatch, whole: bool):
        self.keys = batch.columns[:-1]
        self.names = batch.schema.names[:-1]
        self.data, off, self.runes = _large(batch.column(batch.num_columns - 1))
        lead = (self.data & 0xC0) != 0x80
        self.start = np.append(np.flatnonzero(lead), len(self.data))  # of each code point, in bytes
        bound = np.searchsorted(self.start, off)  # code points before each row
        n = np.diff(bound)
        windows = np.maximum(n - (ngrams.SIZE - 1), 0)
        self.row = np.repeat(np.arange(len(n)), windows)
        before = np.concatenate([[0], np.cumsum(windows)])
        self.pos = np.arange(before[-1]) - before[self.row]
        self.at = self.pos + bound[self.row]
        self.byte_offset = self.start[self.at] - off[self.row]
        ids = self.keys[-1]  # file_idx is the last key
        new = np.append(True, [not ids[i].equals(ids[i - 1]) for i in range(1, len(ids))]) if whole and _repeats(ids) else np.ones(len(n), bool)
        self.file = (np.cumsum(new) - 1)[self.row]
        if not new.all():  # places of rows that are one file are merged
            order = np.lexsort((self.pos, self.file))
            self.row, self.pos, self.at, self.byte_offset, self.file = (x[order] for x in (self.row, self.pos, self.at, self.byte_offset, self.file))

    def __len__(self) -> int:
        return len(self.at)

    def dense(self) -> tuple[np.ndarray, int]:
        """(a number for each window that orders trigrams as their code points do, its bits)."""
        seen = np.zeros(int(self.runes.max()) + 1 if len(self.runes) else 1, bool)
        seen[self.runes] = True
        small = (np.cumsum(seen) - 1)[self.runes].astype(np.uint64)
        bits = max(1, int(seen.sum() - 1).bit_length())
        b = np.uint64(bits)
        return small[self.at] << b << b | small[self.at + 1] << b | small[self.at + 2], 3 * bits

    def codes(self, windows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The encoded trigrams of windows."""
        at = self.at[windows]
        a, b, c = (self.runes[at + k].astype(np.uint64) for k in range(3))
        return a << RUNE << RUNE | b << RUNE | c

    def by(self, *major: tuple[np.ndarray, int]) -> np.ndarray:
        """The windows in order of the (numbers, bits) given, first one first; equal ones stay in order."""
        own = max(1, int(len(self)).bit_length())
        if own + sum(bits for _, bits in major) > 64:
            return np.lexsort([x for x, _ in reversed(major)])
        key = np.zeros(len(self), np.uint64)
        for x, bits in major:
            key = key << np.uint64(bits) | x.astype(np.uint64)
        key = np.sort(key << np.uint64(own) | np.arange(len(self), dtype=np.uint64))
        return (key & np.uint64((1 << own) - 1)).astype(np.int64)

    def texts(self, windows: slice) -> pa.Array:
        """Trigrams of windows."""
        lo, hi = self.start[self.at[windows]], self.start[self.at[windows] + 3]
        size = hi - lo
        off = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(off[-1]) + np.repeat(lo - off[:-1], size)
        return pa.StringArray.from_buffers(len(lo), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(self.data[where]))

    def columns(self, row: np.ndarray) -> list[pa.Array]:
        """The keys of rows."""
        at = pa.array(row)
        return [k.take(at) for k in self.keys]


def _repeats(ids: pa.Array) -> bool:
    """Whether neighbours among ids are equal."""
    if len(ids) < 2:
        return False
    if ids.null_count:
        return True
    x = ids.to_numpy(zero_copy_only=False)
    return bool((x[1:] == x[:-1]).any())


def texts_of(codes: np.ndarray) -> pa.Array:
    """Strings of encoded trigrams that come from texts."""
    runes = np.stack([codes >> RUNE >> RUNE, codes >> RUNE & MASK, codes & MASK], 1).astype("<u4")
    s = runes.tobytes().decode("utf-32-le")
    return pa.array([s[i : i + 3] for i in range(0, len(s), 3)], pa.string())


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = False
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _blocks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[Block]:
    """Rows of BLOCK bytes of text or more; whole: of whole files, if equal file_idx follow each other."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        sizes = np.diff(_offsets(b.column(b.num_columns - 1)))
        ids = b.column(b.num_columns - 2).to_pylist()
        at = 0
        for i, (n, key) in enumerate(zip(sizes.tolist(), ids, strict=True)):
            if size >= BLOCK and not (whole and key == last):
                held.append(b.slice(at, i - at))
                yield _joined(held, whole)
                held, size, at = [], 0, i
            size, last = size + n, key
        held.append(b.slice(at))
    if size:
        yield _joined(held, whole)


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def _joined(parts: list[pa.RecordBatch], whole: bool) -> Block:
    parts = [p for p in parts if p.num_rows]
    return Block(parts[0] if len(parts) == 1 else pa.concat_batches(parts), whole)


def mapped(docs: DataFrame, make: Callable[[Block], Iterator[list[pa.Array]]], schema: str, ends: Callable | None = None, whole: bool = True) -> DataFrame:
    """docs (keys, file_idx, text) as rows of what make gives for each block, and ends() for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        state: dict = {}
        for block in _blocks(batches, whole):
            for columns in make(block, state) if ends else make(block):
                yield pa.RecordBatch.from_arrays(columns, names)
        for columns in ends(state) if ends else ():
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def together(docs: DataFrame, key: str = "file_idx") -> DataFrame:
    """docs, with rows of one file_idx next to each other if there are any."""
    if docs.groupBy(key).count().filter("count > 1").isEmpty():
        return docs
    return docs.repartition(key).sortWithinPartitions(key)


# ---------------------------------------------------------------- rows, lists, sums

def _kinds(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)


def rows(docs: DataFrame) -> DataFrame:
    """(keys, file_idx, tri, pos, byte_offset): every window of the texts of docs (keys, file_idx, text)."""

    def make(b: Block) -> Iterator[list[pa.Array]]:
        for i in range(0, len(b), BLOCK):
            part = slice(i, i + BLOCK)
            yield [*b.columns(b.row[part]), b.texts(part), pa.array(b.pos[part]), pa.array(b.byte_offset[part])]

    return mapped(docs, make, f"{_kinds(docs, docs.columns[:-1])}, tri string, pos bigint, byte_offset bigint", whole=False)


def chosen(docs: DataFrame, only: list[str]) -> DataFrame:
    """(keys, file_idx, tri, pos): the windows that are among `only`."""
    wanted = np.unique(np.array([ngrams.encode(t) for t in only], np.uint64))
    one = [np.unique((wanted >> np.uint64(k * ngrams.RUNE_BITS) & MASK).astype(np.int64)) for k in (2, 1, 0)]

    def make(b: Block) -> Iterator[list[pa.Array]]:
        if not len(b):
            return
        ok = np.ones(len(b), bool)
        for k, few in enumerate(one):
            may = np.zeros(int(b.runes.max()) + 1, bool)
            may[few[few < len(may)]] = True
            ok &= may[b.runes[b.at + k]]
        at = np.flatnonzero(ok)
        codes = b.codes(at)
        hit = np.isin(codes, wanted)
        at, codes = at[hit], codes[hit]
        kinds, which = np.unique(codes, return_inverse=True)
        yield [*b.columns(b.row[at]), texts_of(kinds).take(pa.array(which)), pa.array(b.pos[at])]

    return mapped(docs, make, f"{_kinds(docs, docs.columns[:-1])}, tri string, pos bigint", whole=False)


def _sorted(b: Block) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Windows by (file, trigram, place): (windows, where lists start, their trigrams, places, differences inside lists)."""
    dense, bits = b.dense()
    order = b.by((b.file, max(1, int(b.file[-1]).bit_length()) if len(b) else 1), (dense, bits))
    tri, file, pos = dense[order], b.file[order], b.pos[order]
    start = _firsts(file, tri)
    kinds, which = np.unique(tri[start], return_inverse=True)
    sample = np.zeros(len(kinds), np.int64)
    sample[which] = order[start]
    names = texts_of(b.codes(sample)).take(pa.array(which))
    return order, start, names, pos, _differences(pos, start)


def _differences(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of lists that start at `start`, their first values and the steps between neighbours."""
    out = np.diff(values, prepend=0)
    out[start] = values[start]
    return out


def _lists(values: pa.Array, start: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(start, len(values)), pa.int32()), values)


def lists(docs: DataFrame) -> DataFrame:
    """(file_idx, tri, positions): a trigram's ascending places in one file."""

    def make(b: Block) -> Iterator[list[pa.Array]]:
        order, start, names, pos, _ = _sorted(b)
        yield [b.keys[-1].take(pa.array(b.row[order[start]])), names, _lists(pa.array(pos), start)]

    return mapped(together(docs).select("file_idx", "text"), make, f"{_kinds(docs, ['file_idx'])}, tri string, positions array<bigint>")


def joined_lists(docs: DataFrame, stored_form: bool = False) -> DataFrame:
    """(file_idx, tri, n, positions): lists() with their number of places, parted by commas.

    stored_form: places are read back from delta varints, as an index stores them.
    """

    def make(b: Block) -> Iterator[list[pa.Array]]:
        order, start, names, pos, delta = _sorted(b)
        n = np.diff(np.append(start, len(pos)))
        if stored_form:
            pos = _sums(decoded(encoded(delta, start)).view(np.int64), start, n)
        yield [b.keys[-1].take(pa.array(b.row[order[start]])), names, pa.array(n), pc.binary_join(_lists(pa.array(pos).cast(pa.string()), start), ",")]

    return mapped(together(docs).select("file_idx", "text"), make, f"{_kinds(docs, ['file_idx'])}, tri string, n bigint, positions string")


def steps(docs: DataFrame) -> DataFrame:
    """(file_idx, tri, pos, delta): every window, with the distance from the same trigram before it in the file, or pos."""

    def make(b: Block) -> Iterator[list[pa.Array]]:
        order, start, names, pos, delta = _sorted(b)
        which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pos))))
        for i in range(0, len(pos), BLOCK):
            part = slice(i, i + BLOCK)
            yield [b.keys[-1].take(pa.array(b.row[order[part]])), names.take(pa.array(which[part])), pa.array(pos[part]), pa.array(delta[part])]

    return mapped(together(docs).select("file_idx", "text"), make, f"{_kinds(docs, ['file_idx'])}, tri string, pos bigint, delta bigint")


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of non-negative numbers as LEB128 varints."""
    size = np.ones(len(values), np.int64)
    top = int(values.max()) if len(values) else 0
    for k in range(1, 10):
        if top >> 7 * k == 0:
            break
        size += values.astype(np.uint64) >= np.uint64(1 << 7 * k)
    return size


def _summed(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    at = _firsts(codes)
    return codes[at], np.add.reduceat(sums[:, order], at, axis=1) if len(at) else sums[:, :0]


def totals(docs: DataFrame, lists_too: bool = True) -> DataFrame:
    """(tri, freq, docs, bytes): a trigram's windows, its files, and the bytes of its lists as delta varints.

    Tasks sum up first, so a row a distinct trigram and task is moved. Without lists_too, docs and bytes are 0.
    """

    def make(b: Block, state: dict) -> Iterator[list[pa.Array]]:
        if not len(b):
            return
        dense = b.dense()
        order = b.by(dense)  # by (trigram, file, place), for windows are in order of files
        tri = dense[0][order]
        at = _firsts(tri)
        sums = np.zeros((3, len(at)), np.int64)
        sums[0] = np.diff(np.append(at, len(tri)))
        if lists_too:
            lists_at = _firsts(tri, b.file[order])
            sums[1] = np.diff(np.append(np.searchsorted(lists_at, at), len(lists_at)))
            sums[2] = np.add.reduceat(varint_sizes(_differences(b.pos[order], lists_at)), at)
        found = b.codes(order[at]), sums
        state.setdefault("held", []).append(found)
        if sum(len(x) for x, _ in state["held"]) > HELD:
            codes, sums = _merged(state)
            if len(codes) > HELD // 2:
                yield _total_rows(codes, sums)
            else:
                state["held"] = [(codes, sums)]

    def ends(state: dict) -> Iterator[list[pa.Array]]:
        if state.get("held"):
            yield _total_rows(*_merged(state))

    docs = (together(docs) if lists_too else docs).select("file_idx", "text")
    found = mapped(docs, make, "tri string, freq bigint, docs bigint, bytes bigint", ends, lists_too)
    return found.groupBy("tri").agg(*[F.sum(c).alias(c) for c in ("freq", "docs", "bytes")])


def _merged(state: dict) -> tuple[np.ndarray, np.ndarray]:
    held = state.pop("held")
    return _summed(np.concatenate([x for x, _ in held]), np.concatenate([s for _, s in held], axis=1))


def _total_rows(codes: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
    return [texts_of(codes), *(pa.array(s, pa.int64()) for s in sums)]


def distinct(docs: DataFrame) -> DataFrame:
    """(tri) of the texts, each once."""
    return totals(docs, False).select("tri")


# ---------------------------------------------------------------- stored blocks

#: A row: some files' lists of one trigram. files: the first file's number is first_file, the others' steps are zigzag varints.
#: counts: places in each file, varints. positions: each file's delta varints. shifts: the same of byte offset - position,
#: which are differences too; null if all are 0.
STORED = "tri string, first_file bigint, files binary, counts binary, positions binary, shifts binary, freq bigint, docs bigint"


def encoded(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """LEB128 varints of non-negative numbers, a binary for each run that starts at a cut."""
    sizes = varint_sizes(values)
    end = np.cumsum(sizes)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at, left = end - sizes, values.astype(np.uint64)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        more = sizes > k + 1
        out[at] = (left & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, left = at[more] + 1, left[more] >> np.uint64(7)
        sizes = sizes[more]
    off = np.append(np.concatenate([[0], end])[cuts], len(out)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(off), pa.py_buffer(out)])


def decoded(blobs: pa.Array) -> np.ndarray:
    """The numbers of all blobs, one after the other."""
    raw = blobs.cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        here = size > k
        out[here] |= (data[first[here] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def stored(docs: DataFrame) -> DataFrame:
    """docs (shard, file_idx, text), rows of one shard and of one file_idx next to each other, as (shard, STORED)."""

    def make(b: Block) -> Iterator[list[pa.Array]]:
        if not len(b):
            return
        shard = b.keys[0].to_numpy(zero_copy_only=False)
        ids = b.keys[-1]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(np.append(False, (shard[1:] != shard[:-1]) | (known[1:] != known[:-1])))  # rows that one stored row may hold
        dense, bits = b.dense()
        order = b.by((group[b.row], max(1, int(group[-1]).bit_length())), (dense, bits))
        tri, file, row, pos, shift = dense[order], b.file[order], b.row[order], b.pos[order], (b.byte_offset - b.pos)[order]
        part = group[row]
        cut, at = _firsts(part, tri), _firsts(part, tri, file)
        inside = np.searchsorted(at, cut)  # the list that each stored row starts with
        number = numbers[row[at]]
        gap = np.diff(number, prepend=0)
        gap[inside] = 0
        zigzag = (gap << 1) ^ (gap >> 63)
        first = pa.array(number[inside], pa.int64(), mask=~known[row[cut]])
        shifts = encoded(_differences(shift, at), cut)
        plain = np.maximum.reduceat(shift, cut) == 0
        shifts = pc.if_else(pa.array(plain), pa.scalar(None, pa.binary()), shifts)
        yield [
            pa.array(shard[row[cut]], pa.int64()), texts_of(b.codes(order[cut])), first, encoded(zigzag.view(np.uint64), inside), encoded(np.diff(np.append(at, len(tri))), inside),
            encoded(_differences(pos, at), cut), shifts, pa.array(np.diff(np.append(cut, len(tri))), pa.int64()), pa.array(np.diff(np.append(inside, len(at))), pa.int64()),
        ]

    return mapped(docs.select("shard", "file_idx", "text"), make, f"shard bigint, {STORED}")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows with other columns in front -> those columns, file_idx, tri, pos, byte_offset."""
    for whole in batches:
        at = 0
        freq = np.cumsum(whole.column(whole.num_columns - 2).to_numpy(zero_copy_only=False))
        while at < whole.num_rows:  # some rows at a time, of about as many places
            end = max(at + 1, int(np.searchsorted(freq, (freq[at - 1] if at else 0) + BLOCK, "right")))
            b = whole.slice(at, end - at)
            at = end
            tri, first, files, counts, positions, shifts, n, docs = b.columns[-8:]
            n, docs = (x.to_numpy(zero_copy_only=False) for x in (n, docs))
            list_at = np.concatenate([[0], np.cumsum(docs)])[:-1]
            z = decoded(files)
            gap = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
            total = np.cumsum(gap)
            number = total - np.repeat(total[list_at], docs) + np.repeat(first.fill_null(0).to_numpy(zero_copy_only=False), docs)
            many = decoded(counts).view(np.int64)
            start = np.concatenate([[0], np.cumsum(many)])[:-1]
            pos = _sums(decoded(positions).view(np.int64), start, many)
            shift = np.zeros(len(pos), np.int64)
            has = shifts.is_valid().to_numpy(zero_copy_only=False)
            lists_with = np.repeat(has, docs)
            here = np.repeat(lists_with, many)
            some = many[lists_with]
            shift[here] = _sums(decoded(shifts.drop_null()).view(np.int64), np.concatenate([[0], np.cumsum(some)])[:-1], some)
            known = np.repeat(first.is_valid().to_numpy(zero_copy_only=False), n)
            row = pa.array(np.repeat(np.arange(b.num_rows), n))
            out = [*(c.take(row) for c in b.columns[:-8]), pa.array(np.repeat(number, many), pa.int64(), mask=~known), tri.take(row), pa.array(pos), pa.array(pos + shift)]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-8], "file_idx", "tri", "pos", "byte_offset"])


def _sums(steps_: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each start."""
    total = np.cumsum(steps_)
    return total - np.repeat(total[start] - steps_[start], many)


def places(blocks: DataFrame, *front: str) -> DataFrame:
    """(front, file_idx, tri, pos, byte_offset) of stored rows."""
    names = [f.split(" ")[0] for f in STORED.split(", ")]
    kinds = "".join(f"{x}, " for x in [_kinds(blocks, list(front))] if x)
    return blocks.select(*front, *names).mapInArrow(_places, f"{kinds}file_idx bigint, tri string, pos bigint, byte_offset bigint")
