"""What the llm operators share: scratch tables in the cluster's shared folder, and vectorised words.

Words are runs of bytes other than space and \\t \\n \\x0b \\x0c \\r; a document's words never join those of
the next. All hashes are 64-bit, fixed by the splitmix64 rule below, and the same on every machine.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python slices of an Arrow batch hold about this many bytes of text, whatever the batch holds; numpy needs about 40 a byte.
BLOCK_BYTES = 1 << 20
#: The same for tokenizers, which look at each distinct chunk of a slice once.
TOKEN_BLOCK_BYTES = 2 << 20
#: Bytes of input after which a task gives free memory back.
RELEASE_BYTES = 8 << 20
#: Spark's limit of an Arrow batch while a table is written: both sides hold a batch or two whole.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Stored tables above this size in Parquet are not broadcast while a table is written: Spark's own limit, 10 MB, is a
#: million ids and more, tens of MB for the driver in each join, and a plan has several.
JOIN_KEY, JOIN_BYTES = "spark.sql.autoBroadcastJoinThreshold", 1 << 20

#: The six ASCII white-space characters, as a Spark character list and as a Java pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, one of our own if all runs in one process, else an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        root = tempfile.mkdtemp(prefix="sieveline-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, outlive executors and are read in any order."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/sieveline/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        held = int(self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
        put = {BATCH_KEY: str(BATCH_BYTES), JOIN_KEY: str(min(held, JOIN_BYTES))}
        before = {k: self.spark.conf.get(k, None) for k in put}
        for k, v in put.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many _ in front as it needs to differ from all columns, which Spark compares without case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def release() -> None:
    """Gives free memory back to the system: Arrow's pool and, where the C library can, the heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def frugal(run: Callable) -> Callable:
    """run, for mapInArrow: releases memory as it goes and when it ends, for workers live on beside the next stages."""

    def metered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = 0
        for b in batches:
            taken += b.nbytes
            yield b
            if taken >= RELEASE_BYTES:
                taken = 0
                release()

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(metered(batches))
        finally:
            release()

    return all_of


def with_columns(docs: DataFrame, held: list[str], column: str, run: Callable, fields: list[T.StructField]) -> DataFrame:
    """docs.mapInArrow(run) of the columns `held` and fields, whatever their names are.

    run() gets batches of `held` and, as the last one, `column`, and yields their columns but the last, then the fields'.
    """
    plain = [f"c{i}" for i in range(len(held))]
    own = docs.select(*[quoted(c).alias(p) for c, p in zip(held, plain, strict=True)], quoted(column).alias("last"))
    kinds = [T.StructField(p, docs.schema[c].dataType) for c, p in zip(held, plain, strict=True)]
    more = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]
    names = [*plain, *(f.name for f in more)]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names)

    return own.mapInArrow(frugal(renamed), T.StructType([*kinds, *more])).toDF(*held, *(f.name for f in fields))


def fence(x: Column) -> Column:
    """x, in a projection that filters are not pushed through: they would inline, and so repeat, all steps below it."""
    return F.when(F.spark_partition_id() >= 0, x)


def held_out(doc_id: Column) -> Column:
    """The rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def split_by_ids(docs: DataFrame, doc_id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id is not), without moving a row of docs.

    ids: one column. A bitmap of hashed ids is broadcast: 8 bits an id, 2 ** 27 bits (16 MB) at most. Beyond 1.7e7 ids
    "may be" becomes true of ever more rows, from 1e8 of nearly all: the result holds, for a later join drops
    them, but that join then moves the whole table.
    """
    (id_name,) = ids.columns
    bits = 1 << min(27, max(20, (8 * ids.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bucket, bitset = unused(docs.columns, "_bucket", "_bits")
    maps = ids.filter(F.col(id_name).isNotNull()).groupBy((spot(F.col(id_name)) / 32768).cast("int").alias(bucket)).agg(F.bitmap_construct_agg(spot(F.col(id_name)) % 32768).alias(bitset))
    at = spot(quoted(doc_id))
    byte = F.conv(F.hex(F.substring(F.col(bitset), (at % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)) != 0, F.lit(False))
    flagged = docs.join(F.broadcast(maps), (at / 32768).cast("int") == F.col(bucket), "left")
    cols = [quoted(c) for c in docs.columns]
    return flagged.filter(hit).select(*cols), flagged.filter(~hit).select(*cols)


# ---------------------------------------------------------------- hashing

def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on a uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _lut(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return splitmix(code + np.uint64(1 << 20))


BYTE_HASH = {False: _lut(False), True: _lut(True)}
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACE = splitmix(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)


def _place(n: int) -> np.ndarray:
    """Odd multipliers for the first n places of a word; longer words make the table longer."""
    global _PLACE
    if n > len(_PLACE):
        _PLACE = splitmix(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64)) | np.uint64(1)
    return _PLACE


# ---------------------------------------------------------------- blocks of texts

def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    raw = texts.buffers()
    off = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `size` bytes of text (one row at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = buffers(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words per document). space: which bytes part words."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    kept = data[inside]
    at = np.cumsum(inside)[starts] - 1  # where each word starts among the kept bytes
    length = np.diff(at, append=len(kept))
    place = np.arange(len(kept)) - np.repeat(at, length)
    h = np.add.reduceat(BYTE_HASH[lower][kept] * _place(int(length.max()))[place], at)
    h = splitmix(h + length.astype(np.uint64))
    return h, np.diff(np.searchsorted(starts, off))
