"""Column functions over texts: offsets, lines, code points, varint sizes. All built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements per chunk of a running sum, at its lower and its upper level.
CHUNK, UPPER = 32, 512


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: x becomes a lambda's variable, where plain nesting would repeat it at each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def fence(x: Column) -> Column:
    """x, in a projection that filters are not pushed through; they would compute x a second time."""
    return F.when(F.spark_partition_id() >= 0, x)


def running_starts(sizes: Column) -> Column:
    """array<bigint>: for each element the sum of those before it.

    Beyond CHUNK elements, sums run inside chunks on top of the chunks' own sums, and these in chunks of UPPER, so a
    text with h hits costs h * CHUNK copies and a few more, not h * h.
    """
    zero = F.lit(0).cast("long")
    total = lambda c: F.aggregate(c, zero, lambda a, x: a + x)

    def chunked(s: Column, size: int, upper) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / size).cast("int") - 1), lambda k: F.slice(s, k * size + 1, F.lit(size)))
        return bound(parts, lambda c: F.flatten(F.zip_with(c, upper(F.transform(c, total)), _starts)))

    def upper(s: Column) -> Column:
        return bound(s, lambda v: F.when(F.size(v) <= UPPER, _starts(v, zero)).otherwise(chunked(v, UPPER, lambda w: _starts(w, zero))))

    return bound(sizes, lambda s: F.when(F.size(s) <= CHUNK, _starts(s, zero)).otherwise(chunked(s, CHUNK, upper)))


def _starts(sizes: Column, base: Column) -> Column:
    zero = F.struct(F.array().cast("array<bigint>").alias("a"), base.cast("long").alias("s"))
    return F.aggregate(sizes, zero, lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).cast("long").alias("s")), lambda acc: acc["a"])


def newlines(text: Column) -> Column:
    """How many \\n a text holds, bigint."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def newline_offsets(text: Column, measure: Callable[[Column], Column] = F.octet_length) -> Column:
    """Offsets of every line feed, array<bigint>; in bytes, or as measure counts."""
    sizes = F.transform(F.split(text, "\n", -1), lambda p: measure(p).cast("long") + 1)
    return bound(running_starts(sizes), lambda o: F.transform(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda x: x - 1))


def line_number(text: Column, prefix: Column) -> Column:
    """1-based line of the place after prefix; null where the text has no \\n. A hit on a \\n lies on the line it ends."""
    return F.when(F.contains(text, F.lit("\n")), newlines(prefix) + 1)


def lines(text: Column) -> Column:
    """The text's lines: cut at \\n, one \\r before it goes, no empty last line."""
    return bound(F.split(text, r"\r?\n", -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def rune_to_byte(text: Column, rune: Column) -> Column:
    """Byte offset of code point `rune` (0-based, one past the end allowed), else null."""
    return F.when((rune >= 0) & (rune <= F.length(text)), F.octet_length(F.left(text, rune)).cast("long"))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def find_bytes(content: Column, needle: Column) -> Column:
    """0-based byte offset of the first occurrence, or null. Both binary or both string in one-byte characters."""
    return F.nullif(F.position(needle, content), F.lit(0)).cast("long") - 1


def lossy_text(content: Column) -> Column:
    """Bytes as text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def one_per_byte(content: Column) -> Column:
    """Bytes as a text of as many characters, U+0000 to U+00FF."""
    return F.decode(content, "ISO-8859-1")


def varint_size(value: Column) -> Column:
    """Bytes of a non-negative number as a LEB128 varint, bigint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def varint_encode(value: Column) -> Column:
    """LEB128 bytes, as upper-case hex."""
    groups = F.sequence(F.lit(0), varint_size(value).cast("int") - 1)
    part = lambda i: F.call_function("shiftrightunsigned", value, (i * 7).cast("int")).bitwiseAND(F.lit(127))
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(part(i) + F.when(i < varint_size(value) - 1, 128).otherwise(0)), 2, "0")), "")


def varint_decode(encoded: Column) -> Column:
    """The number of an upper-case hex LEB128; null if it is cut off, has bytes left or is longer than ten bytes."""
    count = (F.length(encoded) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(encoded, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    at = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
    whole = F.forall(at, lambda i: (byte(i) >= 128) == (i < count - 1))
    value = F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(F.lit(127)), (i * 7).cast("int"))))
    return F.when((count >= 1) & (count <= 10) & (F.length(encoded) % 2 == 0) & whole, value)


def deltas(sorted_values: Column) -> Column:
    """array<bigint> of ascending values -> first value, then differences (never below 0)."""
    return F.transform(sorted_values, lambda x, i: F.greatest(F.lit(0), x - F.coalesce(F.get(sorted_values, i - 1), F.lit(0))).cast("long"))


def undeltas(differences: Column) -> Column:
    """The inverse of deltas()."""
    return F.zip_with(running_starts(differences), differences, lambda s, d: s + d)
