"""Packing by cutting-stock column generation.

Every text becomes its token ids and one end id. Texts are cut into full pieces of `length` ids and a rest; full
pieces are sequences of their own, so what is packed are the rests. Their lengths, rounded up to classes of `grain`
ids, form a histogram of length / grain counts, however large the corpus is. On it a linear program chooses how
often each pattern (a multiset of classes that fits) is used: the master program keeps a basis of patterns, and an
unbounded-knapsack dynamic program prices new ones with the master's duals until none gains. Uses are rounded down;
what the rounding leaves is packed by largest class first, again on the histogram. The documents of a class are
ranked by numbers counted per (class, salt), so a class with a third of all rests is ranked in parallel, and the
rank tells pattern, sequence and slot by a search in the plan, which is as small as the histogram.

A sequence's ids then take offsets without gaps. Sequences are padded to `length`, but one whose length is a power
of two needs no padding.

Nulls and edges: a null or empty text is the end id alone. Rows that share a doc_id are packed each; their pieces
repeat. A null doc_id is packed too. An empty table has no pieces. Extra columns take no part. A very long text is
tokenized whole in one task and gives as many pieces as it needs. Strings of special tokens in a text are these tokens.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKEN_BLOCK_BYTES, Scratch, blocks, frugal
from .word_bpe import reader

LENGTH, GRAIN = 4096, 8


# ---------------------------------------------------------------- the plan, on the histogram

def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..capacity (class c has size c): (value, count of each class)."""
    best = np.zeros(capacity + 1)
    item = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = duals[:c] + best[c - 1 :: -1][:c]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], item[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    count, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if item[c]:
            count[item[c] - 1] += 1
            c -= item[c]
        else:
            c -= 1
    return float(best[capacity]), count


def _inverted(basis: np.ndarray) -> np.ndarray:
    """By elimination with row exchanges, free of library threads that wait for each other."""
    n = len(basis)
    w = np.hstack([basis, np.eye(n)])
    for c in range(n):
        r = c + int(np.argmax(np.abs(w[c:, c])))
        if r != c:
            w[[c, r]] = w[[r, c]]
        w[c] /= w[c, c]
        f = w[:, c].copy()
        f[c] = 0
        w -= f[:, None] * w[c]
    return w[:, n:]


def solve(demand: np.ndarray, rounds: int = 4000, gap: float = 3e-4) -> list[tuple[np.ndarray, float]]:
    """[(pattern, uses)] of the linear program: fewest bins of len(demand) units for demand[c - 1] items of size c."""
    cap = len(demand)
    active = np.flatnonzero(demand > 0)
    if not len(active):
        return []
    m = len(active)
    per_bin = cap // (active + 1)
    basis = np.diag(per_bin.astype(float))  # columns: patterns of one class
    inverse = np.diag(1.0 / per_bin)
    x = demand[active] / per_bin
    for k in range(rounds):
        y = inverse.sum(0)  # all costs are 1
        duals = np.full(cap, -1.0)
        duals[active] = y
        value, pattern = price(duals, cap)
        if value <= 1 + gap:  # the bound of Farley: at most a share gap above the optimum
            break
        col = pattern[active].astype(float)
        step = np.einsum("ij,j->i", inverse, col)  # small, and free of threads that wait for each other
        ok = step > 1e-10
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = col
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
        if k % 200 == 199 and np.abs(np.einsum("ij,i->j", basis, inverse.sum(0)) - 1).max() > 1e-9:  # rounding errors show
            inverse = _inverted(basis)
    found = []
    for j in np.flatnonzero(x > 1e-9):
        full = np.zeros(cap, np.int64)
        full[active] = np.rint(basis[:, j]).astype(np.int64)
        found.append((full, float(x[j])))
    return found


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """[(pattern, uses)] that hold every item of the histogram once, uses whole."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    fractional = solve(demand)
    for pattern, uses in sorted(fractional, key=lambda p: -p[1]):
        whole = int(min(int(uses + 1e-9), *(left[pattern > 0] // pattern[pattern > 0])))
        if whole:
            out.append((pattern, whole))
            left -= whole * pattern
    for pattern, _ in sorted(fractional, key=lambda p: -(p[1] % 1)):
        if (left >= pattern).all():
            out.append((pattern, 1))
            left -= pattern
    cap = len(left)
    while left.any():  # what rounding left: the largest class that fits, as often as it fits
        pattern, room = np.zeros(cap, np.int64), cap
        while room and (fit := np.flatnonzero(left[:room] > pattern[:room])).size:
            c = int(fit[-1])
            k = min(int(left[c] - pattern[c]), room // (c + 1))
            pattern[c] += k
            room -= k * (c + 1)
        uses = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, uses))
        left -= uses * pattern
    return out


class Slots:
    """Rank within a class -> (sequence, slot). Each pattern's classes take slots in descending order of size."""

    def __init__(self, plan_: list[tuple[np.ndarray, int]]):
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        at: dict[int, int] = {}
        sequence = 0
        for pattern, uses in plan_:
            slot = 0
            for c in np.flatnonzero(pattern)[::-1].tolist():
                k = int(pattern[c])
                by.setdefault(c + 1, []).append((at.get(c + 1, 0), sequence, k, slot))
                at[c + 1] = at.get(c + 1, 0) + uses * k
                slot += k
            sequence += uses
        self.table = {c: np.array(rows, np.int64) for c, rows in by.items()}
        self.sequences = sequence

    def place(self, classes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for c in np.unique(classes).tolist():
            here = classes == c
            t = self.table[c]
            row = t[np.searchsorted(t[:, 0], rank[here], "right") - 1]
            k = rank[here] - row[:, 0]
            sequence[here] = row[:, 1] + k // row[:, 2]
            slot[here] = row[:, 3] + k % row[:, 2]
        return sequence, slot


# ---------------------------------------------------------------- the corpus

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """A row for each full piece and each rest of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        read = reader(path)
        for b, data, off in blocks(batches, "_text", TOKEN_BLOCK_BYTES):
            ids, n = read.ids(data, off)
            out: list[tuple] = []
            e = 0
            for key, k in zip(b.column(0).to_pylist(), n.tolist(), strict=True):
                mine = np.append(ids[e : e + k], np.uint32(end_id)).astype("<u4")
                e += k
                out += [(key, s, len(mine[s : s + length]), zlib.crc32(mine[s : s + length]), k + 1) for s in range(0, k + 1, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(frugal(run), PIECE)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece. path: a tokenizers file."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, path, doc_id, text, end_id, length), "pieces")
    salts = int(min(1024, max(64, cut.count() // 50_000)))
    size = F.ceil(F.col("length") / grain).cast("int")
    cut = cut.withColumn("class", size).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = cut.groupBy("class", "salt").count()
    tally = counts.collect()  # (length / grain) * salts rows at most
    cap = length // grain
    demand = np.zeros(cap, np.int64)
    first: dict[tuple[int, int], int] = {}
    for r in sorted(tally):
        first[r["class"], r["salt"]] = int(demand[r["class"] - 1])
        demand[r["class"] - 1] += r["count"]
    full = int(demand[cap - 1])
    rest = demand.copy()
    rest[cap - 1] = 0
    slots = Slots([*plan(rest), *([((np.arange(cap) == cap - 1).astype(np.int64), full)] if full else [])])
    base = np.zeros((cap + 1, salts), np.int64)
    for (c, s), n in first.items():
        base[c, s] = n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {k: b.column(i) for i, k in enumerate(b.schema.names)}
            c, s, k = (col[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("class", "salt", "k"))
            sequence, slot = slots.place(c, base[c, s] + k - 1)
            yield pa.RecordBatch.from_arrays([*(col[x] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    ranked = cut.withColumn("k", F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")))
    placed = ranked.mapInArrow(frugal(place), f"{PIECE}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # length / 1 rows at most
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")
