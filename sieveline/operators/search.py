"""Literal and regular-expression search over a corpus DataFrame.

A search is a projection: predicates (path glob, required literals, the pattern itself) come first and cheapest first,
then each text yields an array of hits computed from split() and regexp_extract_all(), then inline() makes rows. There is
no shuffle but the one that an ordered limit needs, and nothing leaves the JVM, except for patterns that may match
nothing: these go through Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, text as tx
from ..plans import regex as rx
from ..plans.folding import same_lower
from ..plans.query import Query, SearchOptions

HIT = "struct<byte_offset:bigint,byte_length:bigint,line_number:bigint>"
MATCH = ["file_idx", "byte_offset", "byte_length", "line_number"]


@dataclass
class SearchResult:
    """matches: MATCH columns. contexts: the same with line_text, before, after; None unless asked for."""

    matches: DataFrame
    contexts: DataFrame | None


def quoted(literal: str) -> str:
    """The literal for java.util.regex; an \\E inside is spelled out."""
    return r"\E\\E\Q".join(f"\\Q{part}" if i == 0 else part for i, part in enumerate(literal.split(r"\E"))) + r"\E" if r"\E" in literal else rf"\Q{literal}\E"


def either_case(literal: str) -> str:
    """A Java pattern for texts of equal lower case, character by character."""
    return "".join("[" + "".join(f"\\x{{{ord(x):x}}}" for x in same_lower(c)) + "]" for c in literal)


def filter_column(text: Column, need, ignore_case: bool = False) -> Column | None:
    """A predicate that every match implies, or None. need: from plans.regex.required()."""
    if isinstance(need, rx.Contains):
        if not ignore_case:
            return F.contains(text, F.lit(need.text))
        # lower() of the whole text is only safe for ASCII letters whose variants all lower to them
        runs = [r for r in "".join(c if c.isascii() and c not in "sSkKiI" else "\0" for c in need.text).split("\0") if len(r) >= rx.MIN_LITERAL]
        return F.contains(F.lower(text), F.lit(max(runs, key=len).lower())) if runs else None
    if isinstance(need, (rx.AllOf, rx.AnyOf)):
        parts = [filter_column(text, p, ignore_case) for p in need.parts]
        if isinstance(need, rx.AnyOf):
            if any(p is None for p in parts):
                return None
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            return out
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else out & p
        return out
    return None


def _hit_rows(starts: Column, lengths: Column, above: Column, many: Column) -> Column:
    rows = F.arrays_zip(starts.alias("o"), lengths.alias("n"), above.alias("l"))
    return F.transform(rows, lambda x: F.struct(x["o"].alias("byte_offset"), x["n"].alias("byte_length"), F.when(many, x["l"] + 1).alias("line_number")))


def _at_hits(text: Column, pieces: Column, drop: Column, lengths: Column, measure=F.octet_length) -> Column:
    """array<HIT> for the starts of pieces, without the first `drop` of them (0 or 1)."""
    starts = tx.running_starts(F.transform(pieces, lambda p: measure(p).cast("bigint")))
    above = tx.running_starts(F.transform(pieces, tx.newlines))
    cut = lambda a: F.slice(a, drop + 1, F.size(pieces) - drop)
    return _hit_rows(cut(starts), lengths, cut(above), F.contains(text, F.lit("\n")))


def literal_hits(text: Column, literal: str, case_sensitive: bool) -> Column:
    """array<HIT> of all places, overlapping ones too."""
    if case_sensitive:
        drop = F.when(F.startswith(text, F.lit(literal)), 0).otherwise(1)
        size = F.lit(len(literal.encode())).cast("bigint")
        return tx.bound(F.split(text, f"(?={quoted(literal)})", -1), lambda p: _at_hits(text, p, drop, F.array_repeat(size, F.size(p) - drop)))
    pattern = either_case(literal)
    both = F.struct(F.split(text, f"(?={pattern})", -1).alias("p"), F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)).alias("s"))
    return tx.bound(both, lambda v: _at_hits(text, v["p"], F.size(v["p"]) - F.size(v["s"]), F.transform(v["s"], lambda s: F.octet_length(s).cast("bigint"))))


def byte_pattern(literal: str, case_sensitive: bool) -> str:
    """A Java pattern for the literal's UTF-8 bytes in one_per_byte(); ignoring case, that of A-Z only."""
    return "".join(f"[{x.lower()}{x.upper()}]" if not case_sensitive and x.isascii() and x.isalpha() else f"\\x{{{ord(x):x}}}" for x in literal.encode().decode("latin-1"))


def byte_hits(content: Column, literal: str, case_sensitive: bool) -> Column:
    """array<HIT> of all places in bytes that are no UTF-8."""
    java, size = byte_pattern(literal, case_sensitive), F.lit(len(literal.encode())).cast("bigint")

    def at(t: Column) -> Column:
        drop = F.when(t.rlike(f"^(?:{java})"), 0).otherwise(1)
        return tx.bound(F.split(t, f"(?={java})", -1), lambda p: _at_hits(t, p, drop, F.array_repeat(size, F.size(p) - drop), F.length))

    return tx.bound(tx.one_per_byte(content), at)


def regex_hits(text: Column, java: str) -> Column:
    """array<HIT> of the leftmost matches that don't overlap; the pattern never matches nothing."""
    both = F.struct(F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("m"), F.split(text, java, -1).alias("g"))
    # a gap before each match: a match starts where its gap and all pairs before it end
    bytes_ = lambda x: F.octet_length(x).cast("bigint")

    def rows(v: Column) -> Column:
        gaps = F.slice(v["g"], F.lit(1), F.size(v["m"]))
        starts = F.zip_with(tx.running_starts(F.zip_with(gaps, v["m"], lambda g, m: bytes_(g) + bytes_(m))), gaps, lambda s, g: s + bytes_(g))
        above = F.zip_with(tx.running_starts(F.zip_with(gaps, v["m"], lambda g, m: tx.newlines(g) + tx.newlines(m))), gaps, lambda s, g: s + tx.newlines(g))
        return _hit_rows(starts, F.transform(v["m"], bytes_), above, F.contains(text, F.lit("\n")))

    return tx.bound(both, rows)


def _arrow_hits(pattern: str):
    """For patterns that may match nothing: an empty match does not stand at the end of the match before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern, regex.V0).finditer
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1).to_pylist():
                hits, end, at, byte, line = [], -1, 0, 0, 1
                for m in find(t):
                    if m.start() == m.end() == end:
                        continue
                    gap = t[at : m.start()]
                    byte, line, at = byte + len(gap.encode()), line + gap.count("\n"), m.start()
                    hits.append({"byte_offset": byte, "byte_length": len(m[0].encode()), "line_number": line if "\n" in t else None})
                    end = m.end()
                rows.append(hits)
            kind = pa.list_(pa.struct([("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("line_number", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "hits"])

    return run


def with_hits(corpus: DataFrame, query: Query, prefilter: bool = True) -> DataFrame:
    """(file_idx, path, text, hits) of the documents with a hit. Without a text, literals are looked for in the content's bytes."""
    o: SearchOptions = query.options
    text, raw = F.col("text"), F.col("content")
    literal = query.pattern if not query.is_regex else rx.plain_text(query.pattern)
    if literal is not None and "content" in corpus.columns:
        docs = corpus.select("file_idx", "path", "text", "content").filter(text.isNotNull() | raw.isNotNull())
    else:
        docs = corpus.select("file_idx", "path", "text").filter(text.isNotNull())
    if o.file_pattern is not None:
        docs = docs.filter(globs.matches(F.col("path"), [o.file_pattern]))
    tree = rx.parse(query.pattern, o.case_sensitive) if query.is_regex else None
    if literal is not None and "content" in docs.columns:
        in_bytes = text.isNull() & tx.one_per_byte(raw).rlike(byte_pattern(literal, o.case_sensitive))
        in_text = F.contains(text, F.lit(literal)) if o.case_sensitive else text.rlike(either_case(literal))
        hits = F.when(text.isNotNull(), literal_hits(text, literal, o.case_sensitive)).otherwise(byte_hits(raw, literal, o.case_sensitive))
        return docs.filter(F.coalesce(in_text, F.lit(False)) | in_bytes).select("file_idx", "path", "text", tx.fence(hits).alias("hits"))
    if literal is not None:
        if o.case_sensitive:
            docs = docs.filter(F.contains(text, F.lit(literal)))
        else:
            quick = filter_column(text, rx.Contains(literal), True) if prefilter else None
            docs = docs.filter(quick) if quick is not None else docs
            docs = docs.filter(text.rlike(either_case(literal)))
        return docs.withColumn("hits", tx.fence(literal_hits(text, literal, o.case_sensitive)))
    quick = filter_column(text, rx.required(tree), not o.case_sensitive) if prefilter else None
    docs = docs.filter(quick) if quick is not None else docs
    if rx.may_be_empty(tree):
        return docs.mapInArrow(_arrow_hits(rx.python(tree)), f"{docs.schema.simpleString()[7:-1]}, hits array<{HIT}>").filter(F.size("hits") > 0)
    java = rx.java(tree)
    return docs.filter(text.rlike(java)).withColumn("hits", tx.fence(regex_hits(text, java)))


def _limited(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("file_idx", "byte_offset").limit(n) if n else rows


def matches(corpus: DataFrame, query: Query, prefilter: bool = True) -> DataFrame:
    """MATCH rows. With max_matches the first so many by (file_idx, byte_offset); the limit is the last step."""
    hits = with_hits(corpus, query, prefilter).select("file_idx", F.inline("hits"))
    return _limited(hits, query.options.max_matches)


def contexts(corpus: DataFrame, query: Query) -> DataFrame:
    """MATCH rows with path, line_text, before and after. Lines are cut once a document, not once a hit."""
    n = query.options.context_lines
    docs = with_hits(corpus, query).withColumn("_l", tx.fence(tx.lines(F.col("text"))))
    lines = F.col("_l")

    def around(h: Column) -> Column:
        at = F.coalesce(h["line_number"], F.lit(1)).cast("int")
        before = F.slice(lines, F.greatest(at - n, F.lit(1)), F.least(at - 1, F.lit(n)))
        after = F.slice(lines, at + 1, F.lit(n))
        inside = at <= F.size(lines)
        return F.struct(h["byte_offset"].alias("byte_offset"), h["byte_length"].alias("byte_length"), h["line_number"].alias("line_number"), F.get(lines, at - 1).alias("line_text"), F.when(inside, before).alias("before"), F.when(inside, after).alias("after"))

    rows = docs.select("file_idx", "path", F.inline(F.transform("hits", around)))
    return _limited(rows, query.options.max_matches)


def search(corpus: DataFrame, query: Query) -> SearchResult:
    return SearchResult(matches(corpus, query), contexts(corpus, query) if query.options.context_lines else None)


def search_literal(corpus: DataFrame, pattern: str, case_sensitive: bool = True, max_matches: int = 0) -> DataFrame:
    return matches(corpus, Query(pattern, False, SearchOptions(case_sensitive, max_matches)))


def search_regex(corpus: DataFrame, pattern: str, case_sensitive: bool = True, max_matches: int = 0) -> DataFrame:
    return matches(corpus, Query(pattern, True, SearchOptions(case_sensitive, max_matches)))
