"""Rendering of results as text lines, the way grep does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.query import Query
from .search import MATCH, _limited, with_hits


def match_lines(corpus: DataFrame, query: Query) -> DataFrame:
    """(file_idx, byte_offset, rendered): path:line:text of every match.

    A file of one line shows line 0 and that line; one that is not UTF-8 shows <binary> for its lines.
    """
    docs = with_hits(corpus, query).withColumn("_l", tx.fence(tx.lines(F.col("text"))))
    rows = docs.select("file_idx", "path", F.inline(F.transform("hits", lambda h: F.struct(h["byte_offset"].alias("byte_offset"), h["line_number"].alias("n"), F.when(F.col("text").isNull(), F.lit("<binary>")).otherwise(F.get("_l", (F.coalesce(h["line_number"], F.lit(1)) - 1).cast("int"))).alias("t")))))
    rows = _limited(rows, query.options.max_matches)
    return rows.select("file_idx", "byte_offset", F.concat_ws(":", "path", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("t", F.lit(""))).alias("rendered"))


def context_lines(corpus: DataFrame, query: Query) -> DataFrame:
    """(file_idx, line, part, rendered) in print order by (file_idx, line, part).

    path:N:text for hits, path-N-text for context, each line once a file, `--` (part 0) before a line that does not
    follow the one before it in the same file. A hit on a line that earlier context has printed stays context.
    """
    n = query.options.context_lines
    docs = with_hits(corpus, query).withColumn("_l", tx.fence(tx.lines(F.col("text"))))
    hits = F.array_distinct(F.transform("hits", lambda h: F.coalesce(h["line_number"], F.lit(1)).cast("int")))
    docs = docs.select("file_idx", "path", "_l", F.filter(hits, lambda x: x <= F.size("_l")).alias("_h")).filter(F.size("_h") > 0)
    # in order of lines: a hit prints unless an earlier printed hit's trailing context holds its line
    first = F.struct(F.array().cast("array<int>").alias("a"), F.lit(-1 << 30).alias("last"))
    marked = F.aggregate(F.array_sort("_h"), first, lambda s, h: F.struct(F.when(h > s["last"], F.concat(s["a"], F.array(h))).otherwise(s["a"]).alias("a"), F.greatest(s["last"], h + n).alias("last")), lambda s: s["a"])
    spread = F.flatten(F.transform("_h", lambda h: F.sequence(F.greatest(h - n, F.lit(1)), F.least(h + n, F.size("_l")))))
    rows = docs.select("file_idx", "path", "_l", marked.alias("_m"), F.explode(F.array_distinct(spread)).alias("line"))
    rows = rows.select("file_idx", "path", "line", F.array_contains("_m", F.col("line")).alias("hit"), F.get("_l", F.col("line") - 1).alias("t"))
    gap = F.col("line") - F.lag("line").over(Window.partitionBy("file_idx").orderBy("line")) > 1
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(False)))
    sep = F.when(F.col("hit"), ":").otherwise("-")
    shown = F.struct(F.lit(1).alias("part"), F.concat("path", sep, F.col("line").cast("string"), sep, "t").alias("rendered"))
    dashes = F.struct(F.lit(0).alias("part"), F.lit("--").alias("rendered"))
    return rows.select("file_idx", F.col("line").cast("bigint").alias("line"), F.inline(F.when(F.col("gap"), F.array(dashes, shown)).otherwise(F.array(shown))))


__all__ = ["MATCH", "context_lines", "match_lines"]
