"""Exact top-k by inner product with a pivot-distance index.

Maximum inner product becomes nearest neighbours: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0)
have |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. Every vector is keyed by its nearest pivot and its distance to it; the
vectors of a pivot, sorted by distance, are cut into annuli, and large annuli into blocks of about `rows` vectors. For
an annulus at distances [lo, hi] of pivot p the triangle inequality bounds |q' - x'| below by d(q', p) - hi and
lo - d(q', p), so <q, x> from above. A query first searches the `first` annuli with the best bounds, which gives it
a k-th score; then every other annulus whose bound reaches that score; the rest cannot hold a result. Pivots are a
sample of `pivots` vectors; any sample gives the same results. How much is pruned is a matter of the data: where all
vectors are nearly at right angles, no bound excludes anything, and every query meets every block.

Blocks are matrices of bounded size: a task holds one block and streams the queries that need it, `queries` of them at
most, so neither many queries nor thousands of equal vectors meet in one task. Nothing but pivots and the largest norm
reaches the driver.

Scores are exact integers: sums of doubles where they stay below 2 ** 53, and of Python's integers beyond; a score that a
long cannot hold becomes the nearest long.

Nulls and edges: vectors that are null or hold a null, NaN or infinite component take no part, nor do null ids. An empty
table gives no rows. A very long vector is a row of a matrix of its own length.
Vectors are compared with those of their own length only. Rows that repeat an id are candidates each, but never for
a query of that id; a repeated query is answered once. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal

#: Bounds are widened by this share, more than floating-point sums can err.
SLACK = 1e-9


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, dim, v, norm2) of the vectors that take part; v: the components floor(scale * x), as float64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(np.floor(scale * x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in out], pa.int32()), pa.array([x.tobytes() for x in out], pa.binary()), pa.array([float(x @ x) for x in out], pa.float64())], ["id", "dim", "v", "norm2"])

    return vectors.select(F.col(vec_id).cast("long"), F.col(embedding)).mapInArrow(frugal(run), "id long, dim int, v binary, norm2 double")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float64).reshape(len(column), dim)


class Pivots:
    """Per dimension: pivots in the lifted space and the largest squared norm."""

    def __init__(self, rows: list[tuple[int, bytes, float]], top: dict[int, float]):
        self.top = top
        self.at: dict[int, np.ndarray] = {}
        for dim in top:
            mine = [r for r in rows if r[0] == dim]
            x = np.stack([np.frombuffer(r[1], np.float64) for r in mine]).reshape(len(mine), dim)
            self.at[dim] = np.column_stack([x, np.sqrt([max(0.0, top[dim] - r[2]) for r in mine])])

    def distances(self, dim: int, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        p = self.at[dim]
        y = np.column_stack([x, lift])
        return np.sqrt(np.maximum((y**2).sum(1)[:, None] + (p**2).sum(1) - 2 * y @ p.T, 0))


def _keyed(pivots: Pivots, width: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                x = _matrix(part.column(2), dim)
                d = pivots.distances(dim, x, np.sqrt(np.maximum(pivots.top[dim] - part.column(3).to_numpy().astype(np.float64), 0)))
                near = d.argmin(1)
                own = d[np.arange(len(d)), near]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(near.astype(np.int32)), pa.array(own), pa.array((own / width[dim]).astype(np.int32))], ["id", "dim", "v", "pivot", "dist", "ring"])

    return run


def _reach(pivots: Pivots):
    """Queries -> a row for each pivot with the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                d = pivots.distances(dim, _matrix(part.column(2), dim), np.zeros(part.num_rows))
                n = d.shape[1]
                at = pa.array(np.repeat(np.arange(len(d)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(3).take(at), pa.array(np.tile(np.arange(n, dtype=np.int32), len(d))), pa.array(d.ravel())], ["q", "dim", "q2", "pivot", "dq"])

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact, at the bounds of a long beyond them; int64."""
    if not q.size or not x.size or float((q**2).sum(1).max()) ** 0.5 * float((x**2).sum(1).max()) ** 0.5 < 2**52:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, s)) for s in row] for row in whole(q) @ whole(x).T], np.int64)


def _search(k: int, chunk: int = 256):
    """Rows sorted by (block, copy, role): a block's vectors, then its queries -> the block's k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, parts, x = None, [], [], None
        for b in batches:
            name = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            role = b.column(2).to_numpy(zero_copy_only=False)
            edge = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1] or role[i] != role[i - 1]), len(name)]
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if s == e:
                    continue
                part = b.slice(s, e - s)
                if name[s] != block:
                    block, ids, parts, x = name[s], [], [], None
                if role[s] == 0:
                    ids.append(part.column(3).to_numpy())
                    parts.append(_matrix(part.column(5), part.column(4)[0].as_py()))
                    continue
                if not ids:
                    continue
                if x is None:
                    own = np.concatenate(ids)
                    order = np.argsort(own, kind="stable")
                    own, x = own[order], np.concatenate(parts)[order]
                for i in range(0, part.num_rows, chunk):
                    q = part.slice(i, chunk)
                    qid = q.column(3).to_numpy()
                    score = _scores(_matrix(q.column(5), x.shape[1]), x)
                    self_ = qid[:, None] == own[None, :]
                    best = np.lexsort((np.broadcast_to(own, score.shape), ~score, self_), axis=1)[:, :k]  # ~ turns the order; ties: smaller ids first
                    value = np.take_along_axis(score, best, 1)
                    keep = ~np.take_along_axis(self_, best, 1).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best.shape[1])[keep]), pa.array(own[best].ravel()[keep]), pa.array(value.ravel()[keep])], ["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, pivots: int = 32, rows: int = 2048, rings: int = 16, first: int = 2, queries: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product with each row for which is_query holds.

    is_query: a column over vec_id.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    base = scratch.save(quantised(vectors, vec_id, embedding, scale), "vectors")
    top = {r["dim"]: r["m"] for r in base.groupBy("dim").agg(F.max("norm2").alias("m")).collect()}
    if not top:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = base.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id", "v")))).filter(F.col("n") <= pivots).select("dim", "v", "norm2").collect()
    model = Pivots([(r[0], bytes(r[1]), r[2]) for r in sample], top)
    width = {dim: max(1e-9, 2 * top[dim] ** 0.5 / rings) for dim in top}
    keyed = base.mapInArrow(frugal(_keyed(model, width)), "id long, dim int, v binary, pivot int, dist double, ring int")
    keyed = scratch.save(keyed, "keyed")
    annuli = keyed.groupBy("dim", "pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("c")).withColumn("parts", F.ceil(F.col("c") / rows).cast("int"))
    annuli = scratch.save(annuli, "annuli")
    block = lambda part: F.concat_ws("/", "dim", "pivot", "ring", part)
    stored = keyed.join(annuli.select("dim", "pivot", "ring", "parts"), ["dim", "pivot", "ring"]).select(block(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), F.lit(0).alias("role"), "id", "dim", "v")
    stored = scratch.save(stored, "stored")
    most = queries
    named = base.withColumnRenamed("id", vec_id).filter(is_query).withColumnRenamed(vec_id, "id")
    queries = scratch.save(named.dropDuplicates(["id"]), "queries")
    tops = F.create_map(*[F.lit(x) for d, m in top.items() for x in (d, float(m))])
    far = F.greatest(F.lit(0.0), F.col("dq") - F.col("hi"), F.col("lo") - F.col("dq")) * (1 - SLACK)
    bound = ((F.col("q2") + tops[F.col("dim")] - far * far) / 2) * (1 + SLACK) + 1e-3
    reach = queries.mapInArrow(frugal(_reach(model)), "q long, dim int, q2 double, pivot int, dq double")
    needs = reach.join(annuli, ["dim", "pivot"]).select("q", "dim", "pivot", "ring", "parts", bound.alias("bound"))
    needs = needs.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "pivot", "ring")))
    needs = scratch.save(needs, "needs")

    def look(wanted: DataFrame) -> DataFrame:
        # a block that many queries need is copied, and each copy gets about `most` of them
        times = wanted.groupBy("dim", "pivot", "ring").agg(F.ceil(F.count("*") / most).cast("int").alias("copies"))
        asked = wanted.join(times, ["dim", "pivot", "ring"]).join(queries.select(F.col("id").alias("q"), "v"), "q")
        copy = F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")
        asked = asked.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block)).alias("block"), copy.alias("copy"), F.lit(1).alias("role"), F.col("q").alias("id"), "dim", "v")
        spread = annuli.join(times, ["dim", "pivot", "ring"]).select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), block)).alias("block"), "copies")
        copied = stored.join(spread, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "role", "id", "dim", "v")
        dealt = copied.unionByName(asked).repartition("block", "copy").sortWithinPartitions("block", "copy", "role")
        return dealt.mapInArrow(frugal(_search(k)), "query_id long, vec_id long, score long")

    near = scratch.save(_best(look(needs.filter(F.col("turn") <= first)), k), "first")
    least = near.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = needs.filter(F.col("turn") > first).join(least, F.col("q") == F.col("query_id"), "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    found = near.select("query_id", "vec_id", "score").unionByName(look(rest.select("q", "dim", "pivot", "ring", "parts")))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
