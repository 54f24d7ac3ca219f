"""Corpora: tables and directories as (file_idx, path, content / text), admissibility, shard assignment."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import globs, ngrams, text as tx


#: A conversation has fewer turns than this.
TURNS = 1 << 20


@dataclass(frozen=True)
class BuilderOptions:
    """Limits of an index. Sizes are bytes."""

    shard_max: int = 100 << 20
    file_max: int = 2 << 20
    trigram_max: int = 20_000
    bucket_size: int = 1024
    branching: int = 50


class DocumentTooLarge(ValueError):
    """One admitted document alone is larger than a shard."""


def load(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """documents, pages or conversations as (file_idx, path, text)."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents":
        return t.select(F.col("doc_id").alias("file_idx"), F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"), "text")
    if name == "pages":
        return t.select(F.col("page_id").alias("file_idx"), F.col("url").alias("path"), F.col("html").alias("text"))
    if name == "conversations":
        turn = F.when(F.col("turn").between(0, TURNS - 1), F.col("turn")).otherwise(F.raise_error(F.lit(f"a turn is not from 0 to {TURNS - 1}")).cast("bigint"))
        return t.select((F.col("conv_id") * TURNS + turn).alias("file_idx"), F.concat_ws("/", "conv_id", "turn", "role").alias("path"), "text")
    raise ValueError(f"no corpus in {name}")


def from_rows(spark: SparkSession, files: list[tuple[str, bytes | str]]) -> DataFrame:
    """In-memory documents, numbered in the order given."""
    rows = [(i, p, c.encode() if isinstance(c, str) else bytes(c)) for i, (p, c) in enumerate(files)]
    return with_text(spark.createDataFrame(rows, "file_idx bigint, path string, content binary"))


def with_text(corpus: DataFrame) -> DataFrame:
    """corpus with text: the content where it is valid UTF-8, else null; such files are searched by their bytes."""
    as_text = F.col("content").cast("string")
    return corpus.withColumn("text", F.when(F.is_valid_utf8(as_text), as_text))


def numbered(corpus: DataFrame) -> DataFrame:
    """(path, content) with file_idx by path. Only paths are sorted; contents join back."""
    order = corpus.select("path").withColumn("file_idx", (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint"))
    return corpus.join(order, "path").select("file_idx", "path", "content")


# ---------------------------------------------------------------- directories

class _Slice(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class _Reader(DataSourceReader):
    def __init__(self, root: str, batch: int):
        self.root, self.batch = root, batch

    def partitions(self) -> list[_Slice]:
        found = []
        for folder, folders, names in os.walk(self.root):  # the root's own name is never judged
            folders[:] = sorted(d for d in folders if _shown(d))
            found += [os.path.relpath(os.path.join(folder, n), self.root) for n in names if _shown(n) and os.path.isfile(os.path.join(folder, n))]
        found.sort()
        return [_Slice(found[i : i + self.batch]) for i in range(0, len(found), self.batch)] or [_Slice([])]

    def read(self, part: _Slice) -> Iterator[tuple[str, bytes]]:
        for name in part.names:
            with open(os.path.join(self.root, name), "rb") as f:
                yield name.replace(os.sep, "/"), f.read()


def _shown(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return not name.startswith(".")


class DirectorySource(DataSource):
    """Every regular file below a folder that all executors mount; names with a leading dot are pruned."""

    @classmethod
    def name(cls) -> str:
        return "sieveline_directory"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("batch", "64")))


def from_directory(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(file_idx, path, content, text) of a folder; file_idx follows the path, whatever the file system's order."""
    spark.dataSource.register(DirectorySource)
    files = spark.read.format("sieveline_directory").option("path", root).load()
    return with_text(numbered(files.filter(globs.admitted(F.col("path"), include, exclude))))


# ---------------------------------------------------------------- admissibility and shards

def skip_reason(content: Column, options: BuilderOptions = BuilderOptions()) -> Column:
    """None, TooSmall, TooLarge, Binary or TooManyTrigrams, in this order of tests. content: binary or string."""
    raw = content.cast("binary")
    n = F.octet_length(raw)
    distinct = F.size(F.array_distinct(ngrams.trigram_texts(tx.lossy_text(raw))))
    return (
        F.when(n == 0, "None").when(n < 3, "TooSmall").when(n > options.file_max, "TooLarge")
        .when(F.position(F.lit(b"\0"), raw) > 0, "Binary")
        .when(n - 2 > options.trigram_max, F.when(distinct > options.trigram_max, "TooManyTrigrams").otherwise("None"))
        .otherwise("None")
    )


def admitted(corpus: DataFrame, options: BuilderOptions = BuilderOptions(), content: str = "content") -> DataFrame:
    """The corpus with skip_reason."""
    return corpus.withColumn("skip_reason", skip_reason(F.col(content), options))


def index_summary(judged: DataFrame, content: str = "content") -> DataFrame:
    """(skip_reason, files, bytes)."""
    return judged.groupBy("skip_reason").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("bigint").alias("bytes"))


def _next_starts(sizes: np.ndarray, closes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, for each file where the next shard starts if one starts at it; their number where none does).

    closes: a file after which a new shard starts, whatever room is left.
    """
    p = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(p, p[:-1] + limit, "right") - 1
    closing = np.flatnonzero(closes)
    end = np.append(closing + 1, len(sizes))[np.searchsorted(closing, np.arange(len(sizes)))]
    return p, np.minimum(full, end)


#: Bytes in use that stand for a shard that takes no more.
CLOSED = 1 << 62


def _entry(p: np.ndarray, closes: np.ndarray, limit: int, used: int) -> int:
    """Where the first shard starts in a run of files after a shard with `used` bytes."""
    if used >= CLOSED:
        return 0
    closing = np.flatnonzero(closes)
    return min(int(np.searchsorted(p, limit - used, "right")) - 1, int(closing[0]) + 1 if len(closing) else len(p) - 1)


def shard_starts(sizes: DataFrame, limit: int, run: int = 1 << 18) -> list[int]:
    """The first file_idx of each shard of the greedy fill: a file that would overflow a shard that has bytes starts the next.

    sizes: (file_idx, n, skipped). A skipped file takes no room; one larger than a shard closes the open shard. The fill is
    sequential, so runs of files (equal ranges of file_idx, about `run` files each if they are numbered densely) are
    worked off in parallel for every place at which their first shard may start; the driver then follows the runs in order,
    one look into each one's table, and holds one table at a time. What it keeps is a number per shard.
    """
    big = F.when(~F.col("skipped") & (F.col("n") > limit), F.col("file_idx"))
    lo, hi, count, bad = sizes.agg(F.min("file_idx"), F.max("file_idx"), F.count("*"), F.min(big)).first()
    if bad is not None:
        raise DocumentTooLarge(f"file {bad} is larger than a shard of {limit} bytes")
    if not count:
        return []
    width = (hi - lo) // max(1, -(-count // run)) + 1
    dealt = sizes.select("file_idx", F.when(F.col("skipped"), 0).otherwise(F.col("n")).cast("bigint").alias("n"), (F.col("skipped") & (F.col("n") > limit)).alias("closes"), F.floor((F.col("file_idx") - lo) / width).cast("bigint").alias("run"))

    def table(rows):
        import pandas as pd

        rows = rows.sort_values("file_idx")
        n, closes = rows["n"].to_numpy(), rows["closes"].to_numpy(bool)
        p, nxt = _next_starts(n, closes, limit)
        m = len(n)
        out = np.empty(m + 1, np.int64)  # bytes in use at the end, if a shard starts at each file
        for i in range(m - 1, -1, -1):
            out[i] = out[nxt[i]] if nxt[i] < m else CLOSED if closes[-1] else p[m] - p[i]
        out[m] = -1
        last = _entry(p, closes, limit, 0)  # a fuller shard ends sooner
        return pd.DataFrame({"run": [rows["run"].iloc[0]], "total": [p[m]], "ends": [bool(closes[-1])], "room": [p[1 : last + 1].tobytes()], "out": [out[: last + 1].tobytes()]})

    tables = dealt.groupBy("run").applyInPandas(table, "run bigint, total bigint, ends boolean, room binary, out binary").orderBy("run")
    used, before = CLOSED, []
    for r in tables.toLocalIterator():
        before.append((r["run"], used))
        room, out = np.frombuffer(r["room"], np.int64), np.frombuffer(r["out"], np.int64)
        first = 0 if used >= CLOSED else int(np.searchsorted(room, limit - used, "right"))
        used = int(out[first]) if out[first] >= 0 else CLOSED if r["ends"] else used + r["total"]

    def starts(rows):
        import pandas as pd

        rows = rows.sort_values("file_idx")
        ids, closes = rows["file_idx"].to_numpy(), rows["closes"].to_numpy(bool)
        p, nxt = _next_starts(rows["n"].to_numpy(), closes, limit)
        at, found = _entry(p, closes, limit, int(rows["used"].iloc[0])), []
        while at < len(ids):
            found.append(ids[at])
            at = int(nxt[at])
        return pd.DataFrame({"start": np.array(found, np.int64)})

    known = sizes.sparkSession.createDataFrame(before, "run bigint, used bigint")  # a row for each run
    found = dealt.join(F.broadcast(known), "run").groupBy("run").applyInPandas(starts, "start bigint").collect()
    return sorted(r[0] for r in found)


def assign_shards(corpus: DataFrame, limit: int, content: str = "content", skipped: Column | None = None) -> DataFrame:
    """The corpus with shard, by greedy fill in order of file_idx. skipped: files that take no room.

    Tasks find a file's shard by a search among the shards' starts, one number per `limit` bytes of corpus.
    """
    sizes = corpus.select("file_idx", F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint").alias("n"), (F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(False))).alias("skipped"))
    starts = np.array(shard_starts(sizes, limit), np.int64)
    if len(starts) <= 64:
        at = F.lit(0)
        for k, first in enumerate(starts[1:].tolist(), 1):
            at = F.when(F.col("file_idx") >= first, k).otherwise(at)
        return corpus.withColumn("shard", at.cast("bigint"))

    @F.pandas_udf("bigint")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, ids.to_numpy(), "right") - 1)

    return corpus.withColumn("shard", shard_of("file_idx"))


def shard_name(base: str, shard: int, count: int) -> str:
    """A single shard keeps the plain name; others get .00000, .00001 ..."""
    return base if count <= 1 else f"{base}.{shard:05d}"
