"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased runs of ASCII letters and non-ASCII bytes, hashed to 2 ** 20 cells; each
counts once. The logit is w0 + sum w_i + sum over pairs <v_i, v_j>, so an insult next to a mention of a group can
weigh more than both weights added. The machine is fitted by Adagrad on a bounded sample of labelled rows:
`per_class` rows of each label at most, those with the smallest hash of doc_id. Its terms are all cells that `min_docs`
of these texts hold and whose chi-square against the label is `min_chi` at least; they are counted in Spark, and only
their places in each text reach the driver. Everything else reads every whole text.
Where a label has more rows than the sample, w0 is moved by the log of the two sampling fractions' ratio, so scores
mean the share of toxic rows among all labelled rows, not among the sampled ones.

Nulls and edges: a null or empty text has no terms and scores sigmoid(w0). Labels that are null, or whose document
is missing, take no part. Repeated rows score alike; of rows that share an id, one text is learned from. Without labels
of both kinds every score is 0. An empty table gives no rows. A very long text is read whole, in one task. The input's
columns are kept; score and predicted replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, frugal, held_out, quoted, with_columns, word_hashes

CELLS = 1 << 20
THRESHOLD = 0.7

_PARTS = np.ones(256, bool)
_PARTS[65:91] = _PARTS[97:123] = _PARTS[128:] = False


def term_cells(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of every term in order, terms per document)."""
    h, n = word_hashes(data, off, lower=True, space=_PARTS)
    return (h & np.uint64(CELLS - 1)).astype(np.int64), n


@dataclass
class Machine:
    """slot: cell -> row of w and v, or -1."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, cells: np.ndarray, n: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(n)), n)
        s = self.slot[cells]
        doc, s = doc[s >= 0], s[s >= 0].astype(np.int64)
        pair = np.unique(doc * len(self.w) + s) if len(s) else np.zeros(0, np.int64)  # each term once
        doc, s = pair // max(1, len(self.w)), pair % max(1, len(self.w))
        return _sigmoid(_logits(self, doc, s, len(n))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(doc, x[:, f], n) for f in range(x.shape[1])], 1)


def _logits(m: Machine, doc: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    vs = m.v[s]
    total = _sums(doc, vs, n)
    pairs = 0.5 * ((total**2).sum(1) - np.bincount(doc, (vs**2).sum(1), n))
    return m.w0 + np.bincount(doc, m.w[s], n) + pairs, total


def fit(texts: list[np.ndarray], y: np.ndarray, cells: np.ndarray, factors: int = 8, epochs: int = 40, batch: int = 256, rate: float = 0.4, decay: float = 2e-4, seed: int = 7) -> Machine:
    """texts: for each text the places in cells of its terms, each once. y: 0 or 1. cells: ascending."""
    n = len(texts)
    flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    lens = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), lens)
    p = y.mean()
    slot = np.full(CELLS, -1, np.int32)
    slot[cells] = np.arange(len(cells))
    rng = np.random.default_rng(seed)
    batch = max(16, min(batch, n // 16))  # small samples get as many steps
    d = max(1, len(cells))
    m = Machine(slot, float(np.log(p / (1 - p))), np.zeros(d), rng.normal(0, 0.02, (d, factors)))
    gw, gv, g0 = np.full(d, 1e-6), np.full((d, factors), 1e-6), 1e-6
    start = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            size = start[rows + 1] - start[rows]
            at = np.repeat(start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            s, r = flat[at], np.repeat(np.arange(len(rows)), size)
            logit, total = _logits(m, r, s, len(rows))
            g = (_sigmoid(logit) - y[rows]) / len(rows)
            dw = np.bincount(s, g[r], d) + decay * m.w / max(1, n / batch)
            dv = _sums(s, g[r][:, None] * (total[r] - m.v[s]), d) + decay * m.v / max(1, n / batch)
            g0 += g.sum() ** 2
            gw += dw**2
            gv += dv**2
            m.w0 -= rate * g.sum() / g0**0.5
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.3 * rate * dv / np.sqrt(gv)
    return m


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 8000, min_docs: int = 5, min_chi: float = 10.8, **kw) -> Machine | None:
    """A machine from labelled rows that are not held out; None without both kinds. labels: (doc_id, toxic)."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = [r for k in (0, 1) for r in known.filter(F.col(label) == k).select(doc_id, label).orderBy(F.xxhash64(doc_id), doc_id).limit(per_class).collect()]
    marks = {r[0]: int(r[1]) for r in chosen}
    total = {int(r[0]): r[1] for r in known.groupBy(label).count().collect()}  # one row a label
    if len(set(marks.values())) < 2:
        return None
    kind = docs.schema[doc_id].dataType
    ids = docs.sparkSession.createDataFrame(list(marks.items()), T.StructType([T.StructField("i", kind), T.StructField("y", T.IntegerType())]))
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("t")).join(F.broadcast(ids), F.col("id") == F.col("i")).select("id", "y", "t")  # 2 * per_class ids at most

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in blocks(batches, "t"):
            c, n = term_cells(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(x).astype(np.int32) for x in np.split(c, np.cumsum(n)[:-1])], pa.list_(pa.int32()))], ["id", "y", "cells"])

    held = rows.mapInArrow(frugal(distinct), T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    held = Scratch(docs.sparkSession, "toxicity").save(held.groupBy("id").agg(F.min(F.struct("cells", "y")).alias("m")).select("id", "m.y", "m.cells"), "terms")
    count = {r[0]: r[1] for r in held.groupBy("y").count().collect()}
    if len(count) < 2:
        return None
    p = count[1] / sum(count.values())
    terms = held.select(F.explode("cells").alias("cell"), "y").groupBy("cell").agg(F.count("*").alias("t"), F.sum("y").alias("a"))
    chi = (F.col("a") - F.col("t") * p) ** 2 / (F.col("t") * (p * (1 - p)))
    cells = np.array(sorted(r[0] for r in terms.filter((F.col("t") >= min_docs) & (chi >= min_chi)).select("cell").collect()), np.int64)  # CELLS at most

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x in b.column(2):
                c = x.values.to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(cells, c), max(0, len(cells) - 1))
                found.append(at[cells[at] == c].astype(np.int32).tobytes() if len(cells) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "y", "at"])

    got = held.mapInArrow(frugal(places), T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()), T.StructField("at", T.BinaryType())])).collect()
    got = sorted(got, key=lambda r: (str(r[0]), bytes(r[2])))  # the same fit however the rows arrive
    machine = fit([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got]), cells, **kw)
    drawn = {k: min(m, per_class) for k, m in total.items()}
    machine.w0 += float(np.log(total[1] / drawn[1]) - np.log(total[0] / drawn[0]))
    return machine


def score(docs: DataFrame, machine: Machine | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b, data, off in blocks(batches, "last"):
            s = machine.scores(*term_cells(data, off)) if machine else np.zeros(b.num_rows)
            yield [*b.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_columns(docs, names, text, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
