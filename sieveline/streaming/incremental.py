"""An extension: documents that arrive as a stream are matched or indexed as they come.

matches_stream() is stateless, so it runs on a streaming DataFrame as it does on a table. index_stream() appends each
micro-batch as an index of its own below a folder (the batch's number), written in overwrite mode, so a batch that is run
again replaces what it wrote. opened() opens them all as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import index as ix, search as se
from ..plans.query import Query
from ..sources import corpus as source


def matches_stream(corpus: DataFrame, query: Query) -> DataFrame:
    """MATCH rows of a streaming corpus (file_idx, path, text); max_matches must be 0, for a stream has no first N."""
    if query.options.max_matches:
        raise ValueError("a stream has no first matches; set max_matches to 0")
    return se.matches(corpus, query)


def index_stream(corpus: DataFrame, folder: str, checkpoint: str, options: source.BuilderOptions = source.BuilderOptions(), **trigger):
    """Starts a query that keeps `folder`/N, an index, for each batch that holds anything; returns its handle."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ix.IndexBuilder(options).build(batch, f"{folder}/{number}")

    writer = corpus.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def opened(spark: SparkSession, folder: str) -> ix.Index:
    """The batches' indexes that are complete, in order, as one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(at)]
    done = [n for n in names if n.isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/metadata/_SUCCESS"))]
    return ix.Index(spark, [f"{folder}/{n}" for n in sorted(done, key=int)])
