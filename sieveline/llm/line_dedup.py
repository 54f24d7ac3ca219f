"""Line dedup by overlapping three-line windows (DataFrame functions only).

A text is split at \\n. Every three consecutive lines that hold a word form a window (blank lines between them
are passed over), compared by its three lines, each trimmed of white space, through a 128-bit hash. Of equal
windows in the whole corpus, the one with the smallest (doc_id, window) is the first; every later one covers
its lines. The union of all covered lines is removed, but for the lines of first windows that repeat: they are what
is kept of the repeated passage, even where a later window overlaps them. A document with fewer than three lines that
hold a word has no window and keeps all its lines.

The hot case: a passage in a third of all documents is one window hash. It is never grouped into a list: the
first place is a min() that is combined before the shuffle, and it is joined back by hash, where skewed
partitions split. Rows travel as (hash, doc_id, window), never with texts; only documents that lose lines meet
their positions again, in an array as long as their own windows.

Nulls and edges: a null text stays null, an empty one empty. Rows that share a doc_id are told apart by their
text: the later rows of one doc_id with equal text are all treated alike, as first, so a repeated row keeps its
text in every copy. Documents without a doc_id take no part and are unchanged. Blank lines between two removed
lines go with them; other blank lines stay. Extra columns pass through. An empty table gives no rows. A very long text is
one row: its windows are exploded in the task that reads it, and meet again as numbers in one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, fence, quoted, split_by_ids, unused

#: Lines in a window.
WINDOW = 3


def _full(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES)) != ""


def has_word(text: Column) -> Column:
    """Whether the text holds anything but white space; false for null."""
    return F.coalesce(_full(text), F.lit(False))


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc_id, tie, at): hash of each window, its document and the number of its first full line."""
    lines = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("t")).filter(F.col("doc_id").isNotNull() & F.contains(F.col("t"), F.lit("\n"))).select(
        "doc_id",
        F.transform(F.filter(F.split(F.col("t"), "\n", -1), _full), lambda x: F.btrim(x, F.lit(SPACES))).alias("l"),
        F.xxhash64(F.col("t")).alias("tie"),
    ).filter(F.size("l") >= WINDOW)
    key = lambda x, i: F.unhex(F.md5(F.concat_ws("\n", *[F.get("l", i + k) for k in range(WINDOW)]).cast("binary")))
    exploded = lines.select("doc_id", "tie", F.posexplode(F.transform(F.slice("l", F.lit(1), F.size("l") - (WINDOW - 1)), key)).alias("at", "h"))
    half = lambda k: F.conv(F.hex(F.substring("h", k, 8)), 16, -10).cast("long")
    return exploded.select(half(1).alias("hi"), half(9).alias("lo"), "doc_id", "tie", "at")


def repeats(found: DataFrame) -> DataFrame:
    """(doc_id, tie, at, first) of the windows that occur twice or more; first: whether no other comes before. found: from windows()."""
    place = F.struct("doc_id", "at", "tie")
    firsts = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("hi", "lo", "first")
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.at") == F.col("at")) & (F.col("first.tie") == F.col("tie"))
    return found.join(firsts, ["hi", "lo"]).select("doc_id", "tie", "at", same.alias("first"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """docs with repeated lines gone from the text; removed: name for the number of lines lost (long)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    found = scratch.save(windows(docs, doc_id, text), "windows")
    some = lambda first: F.sort_array(F.collect_set(F.when(F.col("first") == first, F.col("at"))))
    id_, tie, at, keep = unused(docs.columns, "_id", "_tie", "_at", "_keep")
    hits = repeats(found).groupBy(F.col("doc_id").alias(id_), F.col("tie").alias(tie)).agg(some(False).alias(at), some(True).alias(keep)).filter(F.size(at) > 0)
    hits = scratch.save(hits, "hits")
    touched, rest = split_by_ids(docs, doc_id, hits.select(id_))  # most texts never move
    joined = touched.join(hits, (quoted(doc_id) == F.col(id_)) & (F.xxhash64(quoted(text)) == F.col(tie)), "left").drop(id_, tie)
    return strip(joined, text, at, keep, removed).unionByName(rest.withColumn(removed, F.lit(0).cast("long")) if removed else rest)


def strip(joined: DataFrame, text: str, at: str, keep: str, removed: str | None) -> DataFrame:
    """Removes the lines that the windows in `at` cover and those in `keep` don't; both are ascending arrays or null."""
    names = [c for c in joined.columns if c not in (at, keep)]
    own = [quoted(c) for c in names]
    lines_, full, gone, spans, gaps = unused(joined.columns, "_lines", "_full", "_gone", "_spans", "_gaps")
    col = F.col
    cover = lambda c: F.flatten(F.transform(c, lambda a: F.sequence(a, a + (WINDOW - 1))))
    out = F.array_sort(F.array_except(cover(col(at)), F.coalesce(cover(col(keep)), F.array().cast("array<int>"))))
    step = joined.select(*own, out.alias(gone), F.when(col(at).isNotNull(), F.split(quoted(text), "\n", -1)).alias(lines_))
    # where the full lines are; gone counts full lines only
    full_at = F.filter(F.transform(lines_, lambda x, i: F.when(_full(x), i)), lambda i: i.isNotNull())
    step = step.select(*own, gone, lines_, full_at.alias(full))
    # removed lines as spans of the split text, with the blank lines up to the next one if it is removed too
    joined_up = lambda g, k: F.coalesce(F.get(col(gone), k + 1) == g + 1, F.lit(False))
    spans_ = F.transform(gone, lambda g, k: F.struct(F.get(full, g).alias("b"), F.when(joined_up(g, k), F.get(full, g + 1) - 1).otherwise(F.get(full, g)).alias("e")))
    step = step.select(*own, lines_, spans_.alias(spans))
    # what stays: gaps before, between and after the spans
    size = F.size(spans)
    gaps_ = F.transform(
        F.sequence(F.lit(0), size),
        lambda k: F.struct(
            F.coalesce(F.get(spans, k - 1)["e"] + 1, F.lit(0)).alias("b"),
            F.coalesce(F.get(spans, k)["b"], F.size(lines_)).alias("e"),
        ),
    )
    step = step.select(*own, lines_, F.when(size > 0, F.filter(gaps_, lambda g: g["e"] > g["b"])).alias(gaps))
    rest = F.flatten(F.transform(gaps, lambda g: F.slice(lines_, g["b"] + 1, g["e"] - g["b"])))
    new = F.when(col(gaps).isNull(), quoted(text)).otherwise(F.array_join(rest, "\n"))
    lost = F.when(col(gaps).isNull(), F.lit(0)).otherwise(
        F.size(lines_) - F.aggregate(gaps, F.lit(0), lambda a, g: a + g["e"] - g["b"])
    )
    extra = [lost.cast("long").alias(removed)] if removed else []
    return step.select(*[fence(new).alias(c) if c == text else quoted(c) for c in names if c != removed], *extra)
