"""Search through postings: selective trigrams, distance join, candidate files, verification, statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, text as tx
from ..plans import folding, regex as rx
from ..plans.query import Query
from .search import matches as scan_matches


def pattern_trigrams(pattern: str) -> list[tuple[int, str]]:
    return [(i, pattern[i : i + 3]) for i in range(len(pattern) - 2)]


def selective_pair(freqs: list[tuple[int, int]]) -> tuple[int, int]:
    """The two trigrams (index, freq) with the smallest frequency, in order of index; the earlier wins ties. One: twice."""
    best = sorted(sorted(freqs), key=lambda x: x[1])[:2]
    return tuple(sorted((best[0][0], best[-1][0])))  # type: ignore[return-value]


def distance_join(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(file_idx, pos) of a with a row of b `distance` further on in the same file."""
    right = b.select(F.col("file_idx").alias("_f"), (F.col("pos") - distance).alias("_p"))
    return a.select("file_idx", "pos").join(right, (F.col("file_idx") == F.col("_f")) & (F.col("pos") == F.col("_p"))).select("file_idx", "pos")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_idx, pos) of either, each once."""
    return a.select("file_idx", "pos").unionByName(b.select("file_idx", "pos")).distinct()


def frequencies(stats: DataFrame, pattern: str, case_sensitive: bool = True) -> list[tuple[int, int]]:
    """(index, frequency) of each of the pattern's trigrams; case variants are added up."""
    wanted = {i: [t] if case_sensitive else folding.posting_variants(t) for i, t in pattern_trigrams(pattern)}
    every = sorted({t for ts in wanted.values() for t in ts})
    found = {r["tri"]: r["freq"] for r in stats.filter(F.col("tri").isin(every)).select("tri", "freq").collect()}  # as many as the pattern has
    return [(i, sum(found.get(t, 0) for t in ts)) for i, ts in wanted.items()]


#: (file_idx, pos) rows of some trigrams.
Rows = Callable[[list[str]], DataFrame]


def candidates(rows: Rows, stats: DataFrame, pattern: str, case_sensitive: bool = True) -> DataFrame | None:
    """(file_idx, pos) where the pattern may start, from its two rarest trigrams; None below three code points."""
    freqs = frequencies(stats, pattern, case_sensitive)
    if not freqs:
        return None
    if any(n == 0 for _, n in freqs):
        return rows([]).select("file_idx", "pos").limit(0)
    i, j = selective_pair(freqs)
    at = lambda k: rows([pattern[k : k + 3]] if case_sensitive else folding.posting_variants(pattern[k : k + 3]))
    found = at(i).select("file_idx", "pos") if i == j else distance_join(at(i), at(j), j - i)
    return found.select("file_idx", (F.col("pos") - i).alias("pos")).filter("pos >= 0")


def files_with(rows: Rows, stats: DataFrame, literal: str, case_sensitive: bool = True) -> DataFrame | None:
    """(file_idx) of the files that hold the literal's rarest trigram: at least all that hold the literal."""
    freqs = frequencies(stats, literal, case_sensitive)
    if not freqs:
        return None
    i, n = min(freqs, key=lambda x: (x[1], x[0]))
    tri = literal[i : i + 3]
    return rows([tri] if case_sensitive else folding.posting_variants(tri)).select("file_idx").distinct()


def candidate_files(rows: Rows, stats: DataFrame, need, case_sensitive: bool = True) -> DataFrame | None:
    """(file_idx) that may satisfy the filter; None: all of them."""
    if isinstance(need, rx.Contains):
        return files_with(rows, stats, need.text, case_sensitive)
    if isinstance(need, (rx.AllOf, rx.AnyOf)):
        parts = [candidate_files(rows, stats, p, case_sensitive) for p in need.parts]
        if isinstance(need, rx.AnyOf):
            return None if any(p is None for p in parts) else reduce(lambda a, b: a.unionByName(b), parts).distinct()
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.intersect(b), parts) if parts else None
    return None


def narrowed(index, query: Query) -> DataFrame:
    """The index's corpus without the files that its postings rule out; each text that is left is read once."""
    o = query.options
    corpus, rows, stats = index.corpus, index.postings, index.table("tri_stats")
    stats = stats.groupBy("tri").agg(F.sum("freq").alias("freq"))
    literal = rx.plain_text(query.pattern) if query.is_regex else query.pattern
    if o.file_pattern is not None:
        corpus = corpus.filter(globs.matches(F.col("path"), [o.file_pattern]))
    if literal is not None:
        found = candidates(rows, stats, literal, o.case_sensitive)
        allowed = None if found is None else found.select("file_idx").distinct()
    else:
        allowed = candidate_files(rows, stats, rx.required(rx.parse(query.pattern, o.case_sensitive)), o.case_sensitive)
    return corpus if allowed is None else corpus.join(allowed, "file_idx", "left_semi")


def search(index, query: Query) -> DataFrame:
    """MATCH rows by way of the index's postings; the same rows as a scan."""
    return scan_matches(narrowed(index, query), query)


def search_stats(index, query: Query) -> DataFrame:
    """One row: ngram_lookups, candidates_checked, matches_found, bytes_loaded, used_trigram_filtering.

    Lookups stop at the first absent trigram of a case-sensitive literal; bytes are those of the two lists as
    delta varints.
    """
    spark = index.spark
    rows, stats = index.postings, index.table("tri_stats")
    literal = rx.plain_text(query.pattern) if query.is_regex else query.pattern
    total = search(index, query).agg(F.count("*").alias("n"))
    lookups, used, checked, loaded = 0, False, F.lit(0), F.lit(0)
    if literal is not None and len(literal) >= 3:
        freqs = frequencies(stats, literal, query.options.case_sensitive)
        for i, n in freqs:
            lookups += 1 if query.options.case_sensitive else len(folding.posting_variants(literal[i : i + 3]))
            if n == 0:
                break
        used = all(n for _, n in freqs)
        if used:
            found = candidates(rows, stats, literal, query.options.case_sensitive).distinct().agg(F.count("*").alias("c"))
            i, j = selective_pair(freqs)
            tris = {literal[i : i + 3], literal[j : j + 3]}
            lists = rows(sorted(tris if query.options.case_sensitive else {v for t in tris for v in folding.posting_variants(t)}))
            size = posting_bytes(lists).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
            total = total.crossJoin(found).crossJoin(size)  # one row each
            checked, loaded = F.col("c"), F.col("b")
    return total.select(F.lit(lookups).cast("bigint").alias("ngram_lookups"), checked.cast("bigint").alias("candidates_checked"), F.col("n").alias("matches_found"), loaded.cast("bigint").alias("bytes_loaded"), F.lit(used).alias("used_trigram_filtering")) if spark else total


def posting_bytes(rows: DataFrame) -> DataFrame:
    """(tri, bytes): each trigram's positions per file as delta varints."""
    from pyspark.sql import Window

    w = Window.partitionBy("tri", "file_idx").orderBy("pos")
    delta = F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))
    return rows.select("tri", tx.varint_size(delta).alias("v")).groupBy("tri").agg(F.sum("v").alias("bytes"))


__all__ = ["candidate_files", "candidates", "distance_join", "files_with", "frequencies", "merge", "narrowed", "posting_bytes", "search", "search_stats", "selective_pair"]
