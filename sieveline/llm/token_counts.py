"""Token counts by a separator scan over flat token files.

A token file is nothing but ids of a fixed width, one document after the other, each ended by the end id; there is no
index. Files are cut into blocks of equal size, whatever lies in them. A task reads its block, finds all end ids in
one vectorised comparison and reports how many it saw, the ids before the first and after the last, and the lengths
between. A document that crosses blocks is stitched by a prefix scan over the blocks' summaries, in two levels, so that
one file of any size is no single task: the running count of ends numbers the documents, and what blocks without an end
carry is added to the next end.

write() makes such files from a table: each task writes one file under a name of its own in the shared folder and
reports it only when it is complete, so a task that is run again, or twice at once, leaves files that nobody reads.

Nulls and edges: a null or empty text has no ids but its end id, and counts 0. Ids after a file's last end are an
unended document, counted as one with `ended` false. An empty file has no documents. A file whose size is no multiple
of the width is an error. Repeated rows are documents of their own. An empty table writes no files and gives no rows. A
very long text is tokenized whole in one task, and read back block by block.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKEN_BLOCK_BYTES, Scratch, blocks, frugal
from .word_bpe import reader

#: The end id of word_bpe_49k, which no text contains.
END = 49407
#: Bytes in a block, and blocks in a group of the prefix scan.
BLOCK, GROUP = 4 << 20, 1024


def _store(uri: str):
    """(file system, path) of a uri; a plain path is a shared mount."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END, width: int = 2) -> DataFrame:
    """Writes token files of `width`-byte ids and returns (file, bytes, document, doc_id): document is the place in the file, from 0."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        read = reader(tokenizer, plain=True)  # no text may hold the end id
        name, store, path, out, size, count = f"{folder}/{uuid.uuid4().hex}.ids", None, None, None, 0, 0
        done: list[pa.RecordBatch] = []
        for b, data, off in blocks(batches, "_text", TOKEN_BLOCK_BYTES):
            if out is None:
                store, path = _store(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path)
            ids, n = read.ids(data, off)
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError(f"an id needs more than {width} bytes")
            if (ids == end_id).any():
                raise ValueError("a text holds the end id")
            flat = np.full(len(ids) + len(n), end_id, kind)
            at = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
            flat[at] = ids
            out.write(flat.tobytes())
            size += flat.nbytes
            done.append(pa.RecordBatch.from_arrays([pa.array(np.arange(count, count + len(n))), b.column(0)], ["document", "doc_id"]))
            count += len(n)
        if out is None:
            return
        out.close()
        for d in done:  # 16 bytes a document
            yield pa.RecordBatch.from_arrays([pa.array([name] * d.num_rows), pa.array([size] * d.num_rows, pa.int64()), d.column(0), d.column(1)], ["file", "bytes", "document", "doc_id"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(frugal(run), "file string, bytes long, document long, doc_id long")


def scan(files: DataFrame, end_id: int = END, width: int = 2, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(file, document, n_tokens, ended) of the token files in files (file, bytes), the end id not counted."""
    block = block // width * width
    kind = {2: "<u2", 4: "<u4"}[width]
    spans = files.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / block) - 1, F.lit(0)))).alias("k"))
    spans = spans.filter("bytes > 0").repartition(F.col("file"), F.col("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no multiple of {width}")
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(min(block, size - k * block), k * block), kind)
                ends = np.flatnonzero(ids == end_id)
                inner = np.diff(ends) - 1
                head, tail = (int(ends[0]), len(ids) - int(ends[-1]) - 1) if len(ends) else (len(ids), 0)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))], ["file", "k", "ends", "head", "tail", "inner"])

    seen = spans.mapInArrow(frugal(run), "file string, k long, ends long, head long, tail long, inner array<long>")
    seen = Scratch(files.sparkSession, "separator-scan").save(seen, "blocks")
    at = offsets(seen.select("file", "k", "ends", "head", "tail"), group)
    last = F.col("k") == F.col("_last")
    joined = seen.join(at.join(files.select("file", (F.ceil(F.col("bytes") / block) - 1).alias("_last")).distinct(), "file").hint("merge"), ["file", "k"])
    closed = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    whole = joined.select("file", "base", F.posexplode(closed).alias("i", "n_tokens")).select("file", (F.col("base") + F.col("i")).alias("document"), "n_tokens", F.lit(True).alias("ended"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    rest = joined.filter(last & (left > 0)).select("file", (F.col("base") + F.col("ends")).alias("document"), left.alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def offsets(blocks_: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, k, base, carry): ends before a block of its file, and ids since the last of them.

    A prefix scan in two levels: windows hold `group` blocks, or a file's groups. A block passes on its tail, or all its
    ids if it has no end. carry is what all blocks before passed on, less what those before the last one with an end did;
    the running sums never fall, so the latter is a running maximum.
    """
    x = blocks_.select("file", "k", (F.col("k") / group).cast("long").alias("g"), "ends", F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("head")).alias("x"))
    within = Window.partitionBy("file", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, f, w: F.coalesce(f(c).over(w), F.lit(0)).cast("long")
    x = x.withColumn("base", before("ends", F.sum, within)).withColumn("p", before("x", F.sum, within))
    # within a group: the running maximum of p at ends, or none
    x = x.withColumn("r", F.max(F.when(F.col("ends") > 0, F.col("p"))).over(within))
    sums = x.groupBy("file", "g").agg(F.sum("ends").alias("e"), F.sum("x").alias("s"), F.max(F.when(F.col("ends") > 0, F.col("p"))).alias("m"))
    sums = sums.withColumn("e0", before("e", F.sum, across)).withColumn("s0", before("s", F.sum, across))
    sums = sums.withColumn("r0", F.max(F.col("s0") + F.col("m")).over(across))
    at = x.join(sums.select("file", "g", "e0", "s0", "r0"), ["file", "g"])
    carry = F.col("s0") + F.col("p") - F.coalesce(F.col("s0") + F.col("r"), F.col("r0"), F.lit(0))
    return at.select("file", "k", (F.col("e0") + F.col("base")).alias("base"), carry.cast("long").alias("carry"))


def counts(spark: SparkSession, docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(doc_id, n_tokens) by writing docs to token files in the shared folder and scanning these."""
    scratch = Scratch(spark, "token-files")
    manifest = scratch.save(write(docs, tokenizer, f"{scratch.dir}/ids", doc_id, text), "manifest")
    found = scan(manifest.select("file", "bytes").distinct(), **kw)
    return manifest.hint("merge").join(found, ["file", "document"]).select("doc_id", "n_tokens")  # files look small: never broadcast
