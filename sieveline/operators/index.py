"""The positional trigram index: tables, layout on disk, and handles.

An index is a folder of Parquet tables, each partitioned by shard: postings (rows of grams.STORED, a trigram's lists in a
block of files as delta varints, sorted by trigram inside each file, so that row-group statistics prune), tri_stats,
files, contents, metadata and one table for each extension. Readers take the tables they know and ignore others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ngrams, text as tx
from ..sources import corpus as source
from . import grams

VERSION = 2
#: File numbers in a block of running sums.
BLOCK = 4096
TABLES = ("postings", "tri_stats", "files", "contents", "metadata")
Extension = Callable[[DataFrame], DataFrame]


class InvalidIndex(ValueError):
    """The folder lacks a table, or another version wrote it."""


# ---------------------------------------------------------------- tables from a corpus

def readable(corpus: DataFrame) -> Column:
    """The text; of files that are not UTF-8, the bytes with what is invalid replaced."""
    return F.coalesce(F.col("text"), tx.lossy_text(F.col("content"))) if "content" in corpus.columns else F.col("text")


def _bytes(corpus: DataFrame) -> Column:
    return F.octet_length(F.coalesce(F.col("content"), F.col("text").cast("binary")) if "content" in corpus.columns else F.col("text")).cast("bigint")


def _keys(corpus: DataFrame) -> list[str]:
    return [c for c in ("shard", "file_idx") if c in corpus.columns]


def _long(corpus: DataFrame) -> DataFrame:
    """([shard,] file_idx, text) of the texts that have a trigram."""
    text = readable(corpus)
    return corpus.filter(F.length(text) >= ngrams.SIZE).select(*_keys(corpus), text.alias("text"))


def postings(corpus: DataFrame) -> DataFrame:
    """([shard,] file_idx, tri, pos, byte_offset): every window of three code points; pos counts code points from 0."""
    return grams.rows(_long(corpus))


def positions(corpus: DataFrame, only: list[str]) -> DataFrame:
    """([shard,] file_idx, tri, pos) of these trigrams. Texts without any are left out at the scan."""
    docs = _long(corpus)
    return grams.chosen(docs.filter(reduce(lambda a, b: a | b, [F.contains("text", F.lit(t)) for t in only])), only)


def trigrams(corpus: DataFrame) -> DataFrame:
    """(tri) of all texts, each once."""
    return grams.distinct(_long(corpus))


def tri_stats(corpus: DataFrame) -> DataFrame:
    """(tri, freq, docs): a trigram's places and files."""
    return grams.totals(_long(corpus)).select("tri", "freq", "docs")


def posting_bytes(corpus: DataFrame) -> DataFrame:
    """(tri, bytes): each trigram's positions per file as delta varints."""
    return grams.totals(_long(corpus)).select("tri", "bytes")


def posting_lists(corpus: DataFrame) -> DataFrame:
    """(file_idx, tri, positions): ascending positions of a trigram in one file; lists never span files."""
    return grams.lists(_long(corpus))


def joined_lists(corpus: DataFrame, stored_form: bool = False) -> DataFrame:
    """(file_idx, tri, n, positions): posting_lists with positions as text, parted by commas; stored_form: read back from delta varints."""
    return grams.joined_lists(_long(corpus), stored_form)


def posting_deltas(corpus: DataFrame) -> DataFrame:
    """(file_idx, tri, pos, delta): every position and its distance from the one before it in its list."""
    return grams.steps(_long(corpus))


def files(corpus: DataFrame, shard: str | None = None) -> DataFrame:
    """(file_idx, path, content_offset, content_length, newlines, start_rune, end_rune): offsets run inside a shard."""
    keys = [shard] if shard else []
    lines = tx.newline_offsets(F.col("text"))
    if "content" in corpus.columns:
        lines = F.when(F.col("text").isNotNull(), lines).otherwise(tx.newline_offsets(tx.one_per_byte(F.col("content")), F.length))
    meta = corpus.select(*keys, "file_idx", "path", _bytes(corpus).alias("content_length"), F.length(readable(corpus)).cast("bigint").alias("r"), lines.alias("newlines"))
    # running sums in two levels: inside blocks of files, and over the blocks' totals, so that no task holds all files
    meta = meta.withColumn("_b", F.floor(F.col("file_idx") / BLOCK))
    inside = Window.partitionBy(*keys, "_b").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint")
    totals = meta.groupBy(*keys, "_b").agg(F.sum("content_length").alias("_c"), F.sum("r").alias("_r"))
    totals = totals.select(*keys, "_b", before("_c", over).alias("_c0"), before("_r", over).alias("_r0"))
    rows = meta.withColumn("_c", before("content_length", inside)).withColumn("_r", before("r", inside)).join(totals, [*keys, "_b"])
    return rows.select(
        *keys, "file_idx", "path", (F.col("_c0") + F.col("_c")).alias("content_offset"), "content_length", "newlines", (F.col("_r0") + F.col("_r")).alias("start_rune"), (F.col("_r0") + F.col("_r") + F.col("r")).alias("end_rune"),
    )


def metadata(corpus: DataFrame, shard: str | None = None) -> DataFrame:
    """(version, file_count, total_bytes, total_runes, plain_ascii), a row a shard."""
    return corpus.groupBy(*([shard] if shard else [])).agg(
        F.lit(VERSION).cast("bigint").alias("version"), F.count("*").alias("file_count"), F.coalesce(F.sum(_bytes(corpus)), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.sum(F.length(readable(corpus))), F.lit(0)).cast("bigint").alias("total_runes"), F.coalesce(F.bool_and(tx.is_ascii(F.col("text")) & F.col("text").isNotNull()), F.lit(True)).alias("plain_ascii"),
    )


def bucket_directory(stats: DataFrame, bucket_size: int = 1024) -> DataFrame:
    """(bucket, first_tri, entries): the leaves that sorted insertion into a B+-tree of this (even) bucket size leaves."""
    half = bucket_size // 2
    n = stats.count()
    last = max(0, -(-(n - bucket_size) // half))
    rn = F.row_number().over(Window.orderBy("tri"))
    placed = stats.select("tri", F.least(F.floor((rn - 1) / half), F.lit(last)).cast("bigint").alias("bucket"))
    return placed.groupBy("bucket").agg(F.min("tri").alias("first_tri"), F.count("*").alias("entries"))


# ---------------------------------------------------------------- building and opening

@dataclass
class IndexBuilder:
    options: source.BuilderOptions = field(default_factory=source.BuilderOptions)
    extensions: dict[str, Extension] = field(default_factory=dict)

    def add_extension(self, tag: str, make: Extension) -> None:
        if tag in TABLES:
            raise ValueError(f"{tag} is a table of the index")
        self.extensions[tag] = make

    def build(self, corpus: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
        """Writes the index of the admitted documents; returns (skip_reason, files, bytes). corpus has content or text."""
        raw = "content" if "content" in corpus.columns else "text"
        judged = source.admitted(corpus, self.options, raw)
        # a skipped file takes no room, but one that is larger than a shard still starts a new one
        judged = source.assign_shards(judged, self.options.shard_max, raw, F.col("skip_reason") != "None")
        kept = judged.filter((F.col("skip_reason") == "None") & F.col(raw).isNotNull())
        if "text" not in kept.columns:
            kept = source.with_text(kept)
        rest = F.when(F.col("text").isNull(), F.col("content")) if "content" in kept.columns else F.lit(None)
        kept = kept.select("shard", "file_idx", "path", "text", rest.cast("binary").alias("content"))
        # a shard's texts are moved to one task, in order; all else follows from its file without another shuffle
        dealt = kept.repartition(*([partitions] if partitions else []), "shard").sortWithinPartitions("shard", "file_idx")
        dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/contents")
        kept = corpus.sparkSession.read.schema(kept.schema).parquet(f"{folder}/contents")
        tables = {"files": files(kept, "shard")} | {tag: make(kept) for tag, make in self.extensions.items()}
        rows = grams.stored(_long(kept)).sortWithinPartitions("shard", "tri", "first_file")
        rows.write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings")
        stored = corpus.sparkSession.read.schema(rows.schema).parquet(f"{folder}/postings")
        tables["tri_stats"] = stored.groupBy("tri").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs")).sort("tri")
        tables["metadata"] = metadata(kept, "shard").withColumn("created_at", F.current_timestamp())  # last: an index without it is none
        for tag, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy("shard") if "shard" in df.columns else writer).parquet(f"{folder}/{tag}")
        return source.index_summary(judged, raw)


class Index:
    """An open index; several folders are one index whose file numbers go on from one to the next."""

    def __init__(self, spark: SparkSession, folders: list[str]):
        self.spark, self.folders = spark, list(folders)
        for f in self.folders:
            for tag in TABLES:
                if not self._exists(f"{f}/{tag}"):
                    raise InvalidIndex(f"{f} has no table {tag}")
        if self.folders:
            versions = {r[0] for r in self._read("metadata").select("version").distinct().collect()}
            if versions - {VERSION}:
                raise InvalidIndex(f"versions {sorted(versions)}, not {VERSION}")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, tag: str) -> DataFrame:
        out = None
        for k, f in enumerate(self.folders):
            part = self.spark.read.parquet(f"{f}/{tag}").withColumn("part", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    def offsets(self) -> list[int]:
        """File numbers of each folder start here: cumulative file counts."""
        out, at = [], 0
        for k in range(len(self.folders)):
            out.append(at)
            at += self._read("metadata").filter(F.col("part") == k).agg(F.sum("file_count")).first()[0] or 0
        return out

    def table(self, tag: str) -> DataFrame:
        """A table with global file_idx; folders other than the first are renumbered densely by file_idx."""
        if not self.folders:
            return self.spark.createDataFrame([], "file_idx bigint, path string, text string, content binary, tri string, pos bigint, byte_offset bigint, freq bigint, docs bigint, file_count bigint, total_bytes bigint, part int")
        if tag == "postings":
            return self.postings()
        return self._numbered(self._read(tag))

    def postings(self, only: list[str] | None = None) -> DataFrame:
        """(file_idx, tri, pos, byte_offset, shard, part) of all trigrams, or of these."""
        if not self.folders:
            return self.table("files").select("file_idx", "tri", "pos", "byte_offset")
        t = self._read("postings")
        return self._numbered(grams.places(t if only is None else t.filter(F.col("tri").isin(only)), "shard", "part"))

    def _numbered(self, t: DataFrame) -> DataFrame:
        if "file_idx" not in t.columns or len(self.folders) == 1:
            return t
        start = F.lit(0)
        for k, base in enumerate(self.offsets()):
            start = F.when(F.col("part") == k, base).otherwise(start)
        order = self._read("files").select("part", F.col("file_idx").alias("_old")).withColumn("_new", F.row_number().over(Window.partitionBy("part").orderBy("_old")) - 1)
        t = t.withColumnRenamed("file_idx", "_local").withColumnRenamed("part", "_part")
        joined = t.join(order, (F.col("_part") == F.col("part")) & (F.col("_local") == F.col("_old")))
        return joined.withColumn("file_idx", (F.col("_new") + start).cast("bigint")).drop("_new", "_old", "_local", "_part")

    @property
    def corpus(self) -> DataFrame:
        """(file_idx, path, text, content); content of files that are not UTF-8, whose text is null."""
        return self.table("contents").select("file_idx", "path", "text", "content")

    def file_count(self) -> int:
        return (self._read("metadata").agg(F.sum("file_count")).first()[0] or 0) if self.folders else 0

    def content(self, file_idx: int) -> str | bytes | None:
        row = self.corpus.filter(F.col("file_idx") == file_idx).first()
        return (bytes(row["content"]) if row["text"] is None else row["text"]) if row else None

    def counters(self) -> DataFrame:
        """One row: ngram_count, posting_count, posting_bytes (delta varints)."""
        return self._read("postings").agg(
            F.count_distinct("tri").alias("ngram_count"), F.coalesce(F.sum("freq"), F.lit(0)).alias("posting_count"),
            F.coalesce(F.sum(F.octet_length("positions")), F.lit(0)).cast("bigint").alias("posting_bytes"),
        )

    def file_entry(self, file_idx: int):
        return self.table("files").filter(F.col("file_idx") == file_idx).first()

    def __repr__(self) -> str:
        return f"Index({', '.join(self.folders)})"
