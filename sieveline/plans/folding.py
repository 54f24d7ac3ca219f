"""Simple case variants of characters."""

from __future__ import annotations

from functools import cache


@cache
def _by_lower() -> dict[str, tuple[str, ...]]:
    found: dict[str, list[str]] = {}
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000:
            low = c.lower()
            if low != c or c.upper() != c:
                found.setdefault(low, []).append(c)
    return {k: tuple(v) for k, v in found.items()}


def same_lower(c: str) -> tuple[str, ...]:
    """All characters with the lower case of c, c among them."""
    return _by_lower().get(c.lower(), (c,))


def variants(c: str) -> list[str]:
    """c, then the characters of its lower and upper case that differ."""
    return list(dict.fromkeys([c, *c.lower(), *c.upper()]))


def trigram_variants(tri: str) -> list[str]:
    """All combinations of the variants of three characters, tri first."""
    a, b, c = (variants(x) for x in tri)
    return list(dict.fromkeys(x + y + z for x in a for y in b for z in c))


@cache
def _by_any_case() -> dict[str, tuple[str, ...]]:
    found: dict[str, list[str]] = {}
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or c.upper() != c or c.casefold() != c):
            for key in {c.lower(), c.upper(), c.casefold(), c.lower()[0]}:
                found.setdefault(key, []).append(c)
    return {k: tuple(v) for k, v in found.items()}


def alike(c: str) -> tuple[str, ...]:
    """c and all characters that any rule of case may take for it: at least those that a search ignoring case does."""
    keys = (c.lower(), c.upper(), c.casefold(), c.lower()[0])
    return tuple(dict.fromkeys([c, *same_lower(c), *(x for k in keys for x in (k, *_by_any_case().get(k, ())) if len(x) == 1)]))


def posting_variants(tri: str) -> list[str]:
    """All trigrams whose postings may hold tri, ignoring case; tri first."""
    a, b, c = (alike(x) for x in tri)
    return list(dict.fromkeys(x + y + z for x in a for y in b for z in c))
