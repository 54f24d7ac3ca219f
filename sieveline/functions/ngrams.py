"""Trigrams of code points: split, encode, decode, case variants. An encoded trigram is (a << 42) | (b << 21) | c."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE = 3
RUNE_BITS = 21
RUNE_MASK = (1 << RUNE_BITS) - 1


def encode(text: str) -> int:
    a, b, c = map(ord, text)
    return a << 2 * RUNE_BITS | b << RUNE_BITS | c


def decode(ngram: int) -> str:
    """Code points beyond Unicode, and surrogates, become U+FFFD."""
    return "".join(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "�" for c in (ngram >> k * RUNE_BITS & RUNE_MASK for k in (2, 1, 0)))


def runes(text: Column) -> Column:
    """The text's code points, array<string>."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "", -1))


def trigrams(text: Column) -> Column:
    """array<struct<tri, idx, byte_offset>>: the windows of three code points, in order; empty below three."""
    from .text import bound, running_starts

    # both offsets run along one array of code points; no substring() per place
    arrays = bound(runes(text), lambda c: F.struct(c.alias("c"), running_starts(F.transform(c, lambda x: F.octet_length(x).cast("long"))).alias("o")))
    made = bound(arrays, lambda v: F.transform(
        F.slice(v["c"], F.lit(1), F.size(v["c"]) - (SIZE - 1)),
        lambda a, i: F.struct(F.concat(a, F.get(v["c"], i + 1), F.get(v["c"], i + 2)).alias("tri"), i.cast("long").alias("idx"), F.get(v["o"], i).alias("byte_offset")),
    ))
    return F.when(F.length(text) >= SIZE, made).otherwise(F.array().cast("array<struct<tri:string,idx:bigint,byte_offset:bigint>>"))


def trigram_texts(text: Column) -> Column:
    """The windows alone, array<string>."""
    from .text import bound

    made = bound(runes(text), lambda c: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - (SIZE - 1), F.lit(0))), lambda a, i: F.concat(a, F.get(c, i + 1), F.get(c, i + 2))))
    return F.when(F.length(text) >= SIZE, made).otherwise(F.array().cast("array<string>"))


def encoded(tri: Column) -> Column:
    """bigint of a three-character string."""
    rune = lambda i: F.ascii(F.substring(tri, i, 1)).cast("long")
    return F.shiftleft(rune(1), 2 * RUNE_BITS).bitwiseOR(F.shiftleft(rune(2), RUNE_BITS)).bitwiseOR(rune(3))


def decoded(ngram: Column) -> Column:
    """The three characters of a bigint; what is no character becomes U+FFFD."""
    part = lambda k: F.shiftrightunsigned(ngram, k * RUNE_BITS).bitwiseAND(F.lit(RUNE_MASK))
    return F.concat(*[_char(part(k)) for k in (2, 1, 0)])


def _char(code: Column) -> Column:
    bad = (code >= 0x110000) | code.between(0xD800, 0xDFFF)
    safe = F.when(bad, F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def rune_variants(rune: Column) -> Column:
    """A character, then the characters of its lower and upper case that differ from it."""
    return F.array_distinct(F.concat(F.array(rune), F.split(F.lower(rune), "", -1), F.split(F.upper(rune), "", -1)))


def trigram_variants(tri: Column) -> Column:
    """All combinations of the variants of three characters, without repeats, the trigram itself first."""
    v = lambda i: rune_variants(F.substring(tri, i, 1))
    pairs = F.flatten(F.transform(v(1), lambda a: F.transform(v(2), lambda b: F.concat(a, b))))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda ab: F.transform(v(3), lambda c: F.concat(ab, c)))))
