"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersections.

Texts are lower-cased (A-Z), cut into words, and become the set of their distinct `width`-word shingles, 64-bit
hashes; a shorter text is one shingle, a text without words the empty set, linked with nothing. Two documents link
when 100 * |A & B| >= percent * |A | B|. The join is exact, up to 64-bit collisions.

1. One scan gives each document its set's size and 128-bit digest, and a sketch of how many documents hold each
   shingle: 16 counters a document, but 2 ** 22 to 2 ** 24 (16 MB of levels are broadcast). Tasks write theirs packed.
2. Prefix rule: under one order of all shingles, two sets that link share a shingle among their first
   n - ceil(p * n) + 1. The order puts shingles that the sketch calls frequent last, so what a third of the corpus
   shares is rarely in a prefix. The sketch steers only the order; any order is exact. Equal sets within one task
   send one prefix.
3. In a prefix shingle's group the document with the smallest hash is the pivot. A document that shares a good part
   of its prefix with a pivot is verified against the pivot it shares most with, and components are joined: a group
   of near copies costs a comparison each, never all its pairs.
4. What still lies in different components and shares a prefix shingle goes to tiles; of shingles with the same
   documents one stays. Shingles whose every document lies in its pivot's component are left out through bitmaps of
   hashed ids, so that their rows never move. A few rows are one tile; more are dealt to (shingle, size band, block,
   block), with rows of that band and the next. A band is a factor of 1 / p wide, so tiles hold all pairs that sizes
   allow. In a tile,
   |A & B| <= (|A| + |B| - popcount(bitmap A ^ bitmap B)) / 2; pairs that this bound leaves are verified by
   intersecting the sorted arrays. Tiles with many pairs give each row's best one first, whose links join most of
   what is linked; a second pass takes every pair of these tiles that is still apart.

Each link that is not inside a component after step 3 is found in step 4, so the components are those of all links.

Nulls and edges: null, empty and word-less texts have n_shingles 0 and are their own component. Rows that share a
doc_id are one node; each row reports its own n_shingles. A null doc_id has a null component. Extra columns of the
input take no part. A very long text is one set like any other: about 100 bytes of memory a word while it is read, and
a bitmap of MAX_BITS at most. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Scratch, blocks, frugal, split_by_ids, splitmix, word_hashes
from .graph import components

#: Counters of the sketch for each document, and the bounds of their number, a power of two.
CELLS_A_DOC, MIN_SKETCH, MAX_SKETCH = 16, 1 << 22, 1 << 24
CHUNK = 1 << 16
#: A tile holds about this many rows of each side.
TILE = 1024
MAX_BITS = 1 << 17
#: A unit of verification holds about twice as many texts.
UNIT = 256
#: Tiles with more pairs a row than this give the best first.
MANY = 2
#: Step 3 takes pairs that share a STAR-th of a prefix or more.
STAR = 5


# ---------------------------------------------------------------- sets

def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    h, n = word_hashes(data, off, lower=True)
    end = np.cumsum(n)
    m = max(0, len(h) - width + 1)
    x = np.zeros(m, np.uint64)
    for c, k in zip(splitmix(np.arange(width, dtype=np.uint64)) | np.uint64(1), range(width), strict=True):
        x += h[k : k + m] * c
    x = splitmix(x)
    out = []
    for i, e in zip(n.tolist(), end.tolist(), strict=True):
        if i >= width:
            s = np.sort(x[e - i : e - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif i:
            s = np.uint64(i)
            for w in h[e - i : e]:
                s = splitmix(np.array([s]))[0] ^ w
            out.append(splitmix(np.array([s])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = splitmix(s).sum(dtype=np.uint64), splitmix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _packed(part: np.ndarray) -> bytes:
    """Counters in the fewest bytes each that hold them all, deflated; most of a task's are 0 or 1."""
    size = next(k for k in (1, 2, 4) if int(part.max()) < 1 << (8 * k))
    return bytes([size]) + zlib.compress(part.astype(f"<u{size}").tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), f"<u{blob[0]}").astype(np.uint32)


def _scan(width: int, cells: int):
    """Rows of documents (kind -1: doc_id, n, digest), then each task's sketch (kind: chunk number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, np.uint32)
        for b, data, off in blocks(batches, "text"):
            sets = shingle_sets(data, off, width)
            at, times = np.unique((np.concatenate(sets) & np.uint64(cells - 1)).astype(np.int64), return_counts=True)
            sketch[at] += times.astype(np.uint32)
            dig = [_digest(s) for s in sets]
            yield _rows(np.full(len(sets), -1), b.column(0), [len(s) for s in sets], [d[0] for d in dig], [d[1] for d in dig], [None] * len(sets))
        for k in range(cells // CHUNK):
            part = sketch[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield _rows([k], [None], [0], [0], [0], [_packed(part)])

    def _rows(kind, ids, n, d1, d2, blob):
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(blob, pa.binary())], ["kind", "doc_id", "n", "d1", "d2", "blob"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            part = _unpacked(blob.as_py())
            # counters stay below 2 ** 32: what is added stops there
            total[k] = total[k] + np.minimum(part, ~total[k]) if k in total else part
    sums = [int(x.sum(dtype=np.uint64)) for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary()), pa.array(sums, pa.int64())], ["kind", "blob", "total"])


def _graded(base: float):
    """Rows (chunk, summed counters) -> (chunk, their levels, a byte each, deflated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for blob in b.column(1):
                count = _unpacked(blob.as_py()).astype(np.float64)
                level = np.where(count > base, 1 + np.log2(np.maximum(count / base, 1)), 0).astype(np.uint8)
                found.append(zlib.compress(level.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["kind", "blob"])

    return run


def _levels(scan: DataFrame, cells: int) -> np.ndarray:
    """0 for shingles as rare as most, more by 1 for each doubling beyond them; a byte a counter.

    Counters stay on executors, which sum and grade them; the driver holds the levels, cells bytes, and a chunk beside them.
    """
    summed = scan.filter("kind >= 0").select("kind", "blob").repartition(F.col("kind")).mapInArrow(frugal(_sum_chunks), "kind int, blob binary, total long")
    summed = Scratch(scan.sparkSession, "jaccard-sketch").save(summed, "summed")
    mean = (summed.agg(F.sum("total")).first()[0] or 0) / cells
    base = max(8.0, mean + 6 * mean**0.5)  # beyond what chance puts in a counter
    out = np.zeros(cells, np.uint8)
    for r in summed.select("kind", "blob").mapInArrow(frugal(_graded(base)), "kind int, blob binary").collect():  # cells bytes at most
        out[r["kind"] * CHUNK : (r["kind"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["blob"]), np.uint8)
    return out


def _prefixes(levels: np.ndarray, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # as many as a task has texts
        for b, data, off in blocks(batches, "text"):
            keys, ids, sizes = [], [], []
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(data, off, width), strict=True):
                if not len(s) or i is None or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                p = len(s) - _least_overlap(len(s), percent) + 1
                lv = levels[(s & np.uint64(len(levels) - 1)).astype(np.int64)]
                keys.append((s[np.argsort(lv, kind="stable")[:p]] if lv.any() else s[:p]) >> np.uint64(16))  # 48 bits: keys that meet by chance are verified like others
                ids.append(i)
                sizes.append(len(s))
            if keys:
                n = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int32), n))], ["key", "doc", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, hash of doc) -> rows of keys with two rows or more, each with the key's first as pivot.

    After a key's rows comes one with n = -1 and the 128-bit digest of its documents as doc and pivot.
    """
    held: list[np.ndarray] | None = None  # the last row, whose key may go on
    key0, pivot = None, (0, 0)
    open_: list[int] | None = None  # key, digest so far, rows so far

    def closed(k: np.ndarray, d: np.ndarray, end: bool) -> pa.RecordBatch:
        """The digests of keys that end with these rows; the last key stays open but at the end."""
        nonlocal open_
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        u = d.view(np.uint64)
        sums = [np.add.reduceat(x, start) if len(k) else x for x in (splitmix(u), splitmix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        found = [list(x) for x in zip(k[start].tolist(), *(x.view(np.int64).tolist() for x in sums), np.diff(start, append=len(k)).tolist(), strict=True)]
        if open_ is not None:
            if found and found[0][0] == open_[0]:
                found[0] = [open_[0], _wrapped(open_[1] + found[0][1]), _wrapped(open_[2] + found[0][2]), open_[3] + found[0][3]]
            else:
                found.insert(0, open_)
        open_ = None if end or not found else found.pop()
        x, y, z = (np.array([f[i] for f in found if f[3] > 1], np.int64) for i in range(3))
        none = np.full(len(x), -1, np.int32)
        return _run_rows(x, y, none, z, none)

    for b in batches:
        k, d, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            k, d, n = (np.append(h, x) for h, x in zip(held, (k, d, n), strict=True))
        if not len(k):
            continue
        new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))  # rows of one id may repeat a shingle
        k, d, n = k[new], d[new], n[new]
        held = [k[-1:], d[-1:], n[-1:]]
        if len(k) == 1:
            continue
        first = np.append(key0 is None or k[0] != key0, k[1:] != k[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(k)), -1))  # -1: the key began in an earlier batch
        pd, pn = np.where(start < 0, pivot[0], d[start]), np.where(start < 0, pivot[1], n[start])
        multi = ~first[:-1] | ~first[1:]  # all but the last row, which waits
        at = np.flatnonzero(multi)
        yield _run_rows(k[at], d[at], n[at], pd[at], pn[at])
        yield closed(k[at], d[at], False)
        key0, pivot = (None if first[-1] else k[-1]), (int(pd[-1]), int(pn[-1]))
    if held is not None and key0 is not None and held[0][0] == key0:
        yield _run_rows(*held, np.array([pivot[0]]), np.array([pivot[1]]))
        yield closed(held[0], held[1], True)
    else:
        yield closed(np.zeros(0, np.int64), np.zeros(0, np.int64), True)


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _run_rows(k, d, n, pd, pn) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((k, d, n, pd, pn), kinds, strict=True)], ["key", "doc", "n", "pivot", "pivot_n"])


# ---------------------------------------------------------------- verification

def _as_bitmaps(width: int, percent: int, fine: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in blocks(batches, "text"):
            maps = [bitmap(s, percent, fine).tobytes() for s in shingle_sets(data, off, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.binary())], ["id", "bits"])

    return run


def bitmap(s: np.ndarray, percent: int = 75, fine: bool = False) -> np.ndarray:
    """uint64 words: bit i is the parity of the shingles whose hash mod width is i. What two sets share cancels in their
    bitmaps' xor, so each bit of it needs a shingle of its own that only one of them has.

    Half the bits of the xor of two unlike sets are set. Sets of n that link have 2 * n * (1 - p) / (1 + p) shingles of
    their own at most, so the width, a power of two, is three times that or more; fine: 14 times, so that chance hides
    few differences.
    """
    least = (28 if fine else 6) * len(s) * (100 - percent) // (100 + percent)
    width = min(MAX_BITS, max(1024 if fine else 256, 1 << max(0, least - 1).bit_length()))
    odd = np.bincount((splitmix(s) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return 0
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [None if not x.is_valid else zlib.compress(x.as_buffer(), 1) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, with the last column as it was before _deflated(); BLOCK_BYTES of text, or one row."""
    for b in batches:
        rows, size, at = [], 0, 0
        for i, x in enumerate(b.column(b.num_columns - 1)):
            rows.append(zlib.decompress(x.as_buffer()) if x.is_valid else None)
            size += len(rows[-1] or b"")
            if size >= BLOCK_BYTES or i == b.num_rows - 1:
                part = b.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.binary())], [*b.schema.names[:-1], "text"])
                rows, size, at = [], 0, i + 1


def _links(width: int, percent: int):
    """Rows sorted by (unit, role): a unit's texts (role 0), then its pairs (role 1) -> the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sets = None, {}
        for batch in _inflated(batches):
            role = batch.column(3).to_numpy(zero_copy_only=False)
            out: list[tuple[int, int]] = []
            at = 0
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids_a, ids_b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for b, data, off in blocks(iter([batch]), "text"):
                own = shingle_sets(data, off, width)  # pairs have no text and give empty sets
                for i in range(at, at + b.num_rows):
                    if names[i] != unit:
                        unit, sets = names[i], {}
                    if role[i] == 0:
                        sets.setdefault(ids_a[i], []).append(own[i - at])
                        continue
                    for p in sets.get(ids_a[i], ()):
                        for q in sets.get(ids_b[i], ()):
                            both = overlap(p, q)
                            if both and 100 * both >= percent * (len(p) + len(q) - both):
                                out.append((ids_a[i], ids_b[i]))
                at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of the pairs (a, b), those that link. pairs: stored.

    Pairs that hang together are a family, cut into units of about UNIT by UNIT documents. A text goes to each unit in
    which it has a pair, not to each pair; texts of ids without a pair stay where they are.
    """
    family = components(pairs, scratch, f"{name}-family")
    size = family.groupBy("label").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("g"))
    family = family.join(size, "label").select(F.col("id").alias("i"), "label", "g")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    placed = scratch.save(pairs.join(family, F.col("a") == F.col("i")).select("label", block("a").alias("x"), block("b").alias("y"), "a", "b"), f"{name}-units")
    wanted = placed.select("label", "x", "y", F.explode(F.array("a", "b")).alias("i")).distinct()
    touched, _ = split_by_ids(docs, "doc_id", placed.select(F.explode(F.array("a", "b")).alias("i")).distinct())
    packed = touched.select("doc_id", "text").mapInArrow(frugal(_deflated), "doc_id long, packed binary")  # texts move twice
    texts = packed.join(wanted, F.col("doc_id") == F.col("i")).select("label", "x", "y", F.lit(0).alias("role"), F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), "packed")
    rows = texts.unionByName(placed.select("label", "x", "y", F.lit(1).alias("role"), "a", "b", F.lit(None).cast("binary").alias("packed")))
    dealt = rows.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y", "role")
    return scratch.save(dealt.mapInArrow(frugal(_links(width, percent)), "a long, b long").distinct(), f"{name}-links")


# ---------------------------------------------------------------- tiles

def _tile(percent: int, best: bool):
    """Rows sorted by tile -> pairs (a, b) of different components that the bitmaps' bound leaves.

    best: a tile with many pairs gives only each left row's best one, and a row with its key, to be taken up again.
    """

    def pairs(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # sizes that may link differ by 1 / p at most, and rounding up to a power of two doubles that at most
        apart = 2 * 100 / percent
        left: dict[int, list[tuple]] = {}
        right: dict[int, list[tuple]] = {}
        for r in rows:
            (left if r[0] == 0 else right).setdefault(len(r[4]) // 8, []).append(r)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for w, x in left.items():
            for v, y in (right or left).items():
                if max(v, w) > apart * min(v, w):
                    continue
                if right:
                    out += compare(x, y, min(v, w), True)
                elif v >= w:
                    out += compare(x, y, w, v == w)
        return out

    def compare(left: list[tuple], right: list[tuple], words: int, ordered: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ordered: a pair is met from both sides, but for rows of the next band."""
        fit = lambda rs: np.stack([_fold(np.frombuffer(r[4], np.uint64), words) for r in rs])
        x, y = fit(left), fit(right)
        cols = lambda rs: np.array([r[:4] for r in rs], np.int64).T
        (_, ld, ln, lc), (role, rd, rn, rc) = cols(left), cols(right)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, (1 << 21) // (len(right) * words))
        for i in range(0, len(left), step):
            j = slice(i, i + step)
            both = ln[j, None] + rn[None, :]
            ok = (100 + percent) * np.minimum(ln[j, None], rn[None, :]) >= percent * both
            ok &= lc[j, None] != rc[None, :]
            if ordered:
                ok &= (role == 2)[None, :] | (ld[j, None] < rd[None, :])
            p, q = np.nonzero(ok)
            if not len(p):
                continue
            apart = np.bitwise_count(x[i + p] ^ y[q]).sum(1, dtype=np.int64) if len(p) * 4 < ok.size else np.bitwise_count(x[j, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)[p, q]
            total = both[p, q]
            fits = (100 + percent) * ((total - apart) // 2) >= percent * total
            p, q, share = p[fits], q[fits], ((total - apart) / total)[fits]
            out.append((ld[i + p], rd[q], share))
        return out

    def chosen(key: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, int | None]:
        found = pairs(rows)
        a, b, share = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.int64, np.int64, float)))
        if not best or len(a) <= MANY * len(rows):
            return a, b, None
        order = np.lexsort((-share, a))
        top = order[np.append(True, a[order][1:] != a[order][:-1])]
        return a[top], b[top], key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for b in batches:
            found = []
            for r in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if r[:4] != tile:
                    if len(rows) > 1:
                        found.append(chosen(tile[0], rows))
                    tile, rows = r[:4], []
                rows.append(r[4:])
            yield _pairs(found)
        if len(rows) > 1:
            yield _pairs([chosen(tile[0], rows)])

    def _pairs(found: list[tuple[np.ndarray, np.ndarray, int | None]]) -> pa.RecordBatch:
        a = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
        b = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        low, high = np.minimum(a, b), np.maximum(a, b)
        if len(a):
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            low, high = low[new], high[new]
        cut = [f[2] for f in found if f[2] is not None]
        none = [None] * len(cut)
        return pa.RecordBatch.from_arrays([pa.array([*low.tolist(), *none], pa.int64()), pa.array([*high.tolist(), *none], pa.int64()), pa.array([None] * len(low) + cut, pa.int64())], ["a", "b", "key"])

    return run


def _mixed(rows: DataFrame, among: DataFrame) -> DataFrame:
    """Of rows (key, doc, n, comp), those of keys among (key) with two components or more, with g, their key's number of blocks."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo < hi").join(among, "key", "left_semi")
    return rows.join(keys.select("key", F.ceil(F.col("c") / TILE).cast("int").alias("g")), "key")


def _tiled(rows: DataFrame, bits: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, key): pairs of different components that share a key and may link; where best cut a tile short, its key.

    rows: from _mixed(); bits: (id, bits).
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / min(percent, 99))) + 1e-9).cast("int")
    side = lambda b, x, y, role: F.struct(b.alias("band"), x.alias("x"), y.alias("y"), F.lit(role).alias("role"))
    salt = F.pmod(F.xxhash64("doc"), F.col("g")).cast("int")
    every = F.sequence(F.lit(0), F.col("g") - 1)
    zero = F.lit(0)
    one = F.array(side(zero, zero, zero, 0))  # a key of few rows is one tile
    many = F.concat(
        F.transform(every, lambda y: side(F.col("_b"), F.col("_s"), y, 0)),
        F.transform(every, lambda x: side(F.col("_b"), x, F.col("_s"), 1)),
        F.transform(every, lambda x: side(F.col("_b") - 1, x, F.col("_s"), 2)),
    )
    placed = rows.withColumn("_b", band).withColumn("_s", salt).select("key", "doc", "n", "comp", F.explode(F.when(F.col("g") == 1, one).otherwise(many)).alias("t"))
    placed = placed.join(bits, placed.doc == bits.id).select("key", "t.band", "t.x", "t.y", "t.role", "doc", "n", "comp", "bits")
    dealt = placed.repartition("key", "band", "x", "y").sortWithinPartitions("key", "band", "x", "y", "role")
    return dealt.mapInArrow(frugal(_tile(percent, best)), "a long, b long, key long").distinct()


# ---------------------------------------------------------------- the join

def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs. percent: 1 to 100."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent} is not from 1 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    kind = docs.schema[doc_id].dataType
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cells = min(MAX_SKETCH, max(MIN_SKETCH, 1 << (CELLS_A_DOC * docs.count()).bit_length()))
    scan = scratch.save(docs.mapInArrow(frugal(_scan(width, cells)), "kind int, doc_id long, n long, d1 long, d2 long, blob binary"), "scan")
    rows = scan.filter("kind = -1").select("doc_id", "n", "d1", "d2")
    same = rows.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
    copies = scratch.save(rows.filter("doc_id is not null").join(same.filter("c > 1").drop("c"), ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "copies")

    keys = docs.mapInArrow(frugal(_prefixes(_levels(scan, cells), width, percent)), "key long, doc long, n int")
    dealt = keys.repartition("key").sortWithinPartitions("key", F.xxhash64("doc"), "doc")
    runs = scratch.save(dealt.mapInArrow(frugal(_runs), "key long, doc long, n int, pivot long, pivot_n int"), "runs")

    digests = runs.filter("n = -1").select("key", F.col("doc").alias("s0"), F.col("pivot").alias("s1"))
    runs = runs.filter("n >= 0")
    pairs = scratch.save(runs.filter("doc <> pivot").groupBy("doc", "pivot").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("pivot_n").alias("pivot_n")), "pairs")
    several = rows.filter("n > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("a"))  # an id with other texts too stands for itself
    first_of = scratch.save(copies.filter("a <> b").join(several, "a", "left_anti"), "first-of")

    # pairs that share a good part of their prefixes; the tiles, with their bitmaps, look at all others
    sizes = percent * F.greatest("n", "pivot_n") <= 100 * F.least("n", "pivot_n")
    shared = pairs.filter(sizes & (F.col("c") * 100 * STAR >= F.col("n") * (100 - percent)))
    for end in ("doc", "pivot"):  # of copies, the first is verified for all
        shared = shared.join(first_of.select(F.col("a").alias(end), F.col("b").alias("_first")), end, "left").withColumn(end, F.coalesce("_first", end)).drop("_first")
    shared = shared.filter("doc <> pivot")
    most = shared.groupBy("doc").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot"))
    near = _verified(docs, scratch.save(most.select(F.col("pivot").alias("a"), F.col("doc").alias("b")), "star"), width, percent, scratch, "star")
    labels = components(near.unionByName(copies), scratch, "near")

    def tagged(rows: DataFrame) -> DataFrame:
        known = labels.select(F.col("id").alias("i"), F.col("label").alias("l"))
        return rows.join(known, F.col("doc") == F.col("i"), "left").select(*rows.columns, F.coalesce("l", "doc").alias("comp"))

    # a key is mixed if one of its documents lies apart from its pivot; bitmaps find such keys' rows where they are, and
    # rows that they let through for nothing fall to _mixed()
    ends = pairs.select("doc", "pivot").join(labels.select(F.col("id").alias("doc"), F.col("label").alias("l1")), "doc", "left").join(labels.select(F.col("id").alias("pivot"), F.col("label").alias("l2")), "pivot", "left")
    pair = F.xxhash64("doc", "pivot")
    apart = scratch.save(ends.filter(F.coalesce("l1", "doc") != F.coalesce("l2", "pivot")).select(pair.alias("pair")), "apart")
    keys = scratch.save(split_by_ids(runs.select("key", pair.alias("pair")), "pair", apart)[0].select("key").distinct(), "keys-apart")
    keys = scratch.save(split_by_ids(digests, "key", keys)[0].groupBy("s0", "s1").agg(F.min("key").alias("key")).select("key"), "keys")  # of keys with the same documents, one
    mixed = scratch.save(_mixed(tagged(split_by_ids(runs.select("key", "doc", "n"), "key", keys)[0]), keys), "mixed")
    for best in (True, False):  # from tiles with many pairs the best first: what they join leaves the second pass, where bits are fine
        touched, _ = split_by_ids(docs, "doc_id", mixed.select("doc").distinct())
        bits = scratch.save(touched.select("doc_id", "text").mapInArrow(frugal(_as_bitmaps(width, percent, not best)), "id long, bits binary"), f"bits-{best}")
        found = scratch.save(_tiled(mixed, bits, percent, best), f"tiles-{best}")
        more = _verified(docs, found.filter("key is null").select("a", "b"), width, percent, scratch, f"tile-{best}")
        chain = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
        labels = components(more.unionByName(chain), scratch, f"all-{best}")
        short = found.filter("key is not null").select("key").distinct()
        if not best or short.isEmpty():
            break
        mixed = scratch.save(_mixed(tagged(mixed.join(short, "key").select("key", "doc", "n")), short), "mixed-2")
    first_r = labels.select(F.col("id").alias("i"), F.col("label").alias("l")).hint("merge")  # as many as linked documents: too many to broadcast
    out = rows.join(first_r, F.col("doc_id") == F.col("i"), "left").select(F.col("doc_id").cast(kind).alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("l", "doc_id").cast(kind).alias("component_id"))
    return out
