"""Search against the expected hits of small texts, and against plain Python."""

from __future__ import annotations

import random

import pytest

from sieveline.operators import results, search as se
from sieveline.plans.query import InvalidPattern, Query, SearchOptions, UnsupportedRegex
from sieveline.sources import corpus as source

KANA = "さくらんぼ"


def run(spark, files, pattern, is_regex=False, **options):
    c = source.from_rows(spark, [(f"f{i}", t) if isinstance(t, str) else t for i, t in enumerate(files)])
    rows = se.matches(c, Query(pattern, is_regex, SearchOptions(**options))).collect()
    return sorted((r.file_idx, r.byte_offset, r.byte_length) for r in rows)


def ci(spark, files, pattern, is_regex=False):
    return run(spark, files, pattern, is_regex, case_sensitive=False)


LITERAL = [
    (["over the weir"], "weir", [(0, 9, 4)]),
    (["tic tac tic"], "tic", [(0, 0, 3), (0, 8, 3)]),
    (["salt and pepper", "more salt"], "salt", [(0, 0, 4), (1, 5, 4)]),
    (["salt"], "malt", []),
    (['let y = sum("q");'], 'sum("', [(0, 8, 5)]),
    (["mu, mu"], "mu", [(0, 0, 2), (0, 4, 2)]),
    (["end of sto", "ry here"], "story", []),
    (["tin", "tin"], "tin", [(0, 0, 3), (1, 0, 3)]),
    (["mmmm"], "mmm", [(0, 0, 3), (0, 1, 3)]),
    ([KANA, "plum"], "らん", [(0, 6, 6)]),
    (["un œuf brouillé"], "œuf b", [(0, 3, 6)]),
    ([r"q\Er \E"], r"\E", [(0, 1, 2), (0, 5, 2)]),
    (["1+1 111"], "1+1", [(0, 0, 3)]),
    (["", "z"], "z", [(1, 0, 1)]),
]


@pytest.mark.parametrize(("files", "pattern", "want"), LITERAL)
def test_literal(spark, files, pattern, want):
    assert run(spark, files, pattern) == want


CASE = [
    (["Moss MOSS mOsS peat"], "moss", [0, 5, 10]),
    (["Moss"], "peat", []),
    (["No nO NO on"], "no", [0, 3, 6]),
    (["Der ÄRGER, der ärger"], "Ärger", [4, 16]),
    (["Ж ж"], "ж", [0, 3]),
    (["mMmM"], "mmm", [0, 1]),
]


@pytest.mark.parametrize(("files", "pattern", "want"), CASE)
def test_either_case(spark, files, pattern, want):
    assert [x[1] for x in ci(spark, files, pattern)] == want


REGEX = [
    (["peat moss"], "moss|peat", [(0, 0, 4), (0, 5, 4)]),
    (["peat moss"], "p.*m", [(0, 0, 6)]),
    (["peat moss"], "[lm]oss", [(0, 5, 4)]),
    (["peat moss"], "zz+", []),
    (["rye oats", "wheat", "rye wheat"], "rye|wheat", [(0, 0, 3), (1, 0, 5), (2, 0, 3), (2, 4, 5)]),
    (["on 7 of 365 days"], r"\d+", [(0, 3, 1), (0, 8, 3)]),
    (["buzzzz fizz buz"], "z{2,}", [(0, 2, 4), (0, 9, 2)]),
    (["rye bread\nrye whisky"], "^rye", [(0, 0, 3)]),
    (["rye bread\nrye whisky"], "(?m)^rye", [(0, 0, 3), (0, 10, 3)]),
    (["lampshade"], "amp.*de", [(0, 1, 8)]),
    (["shadelamp"], "amp.*de", []),
    (["TRALALA"], "[ty][rl][ax]", []),
    (["qinnq", "qtavernaq"], "q(inn|taverna)q", [(0, 0, 5), (1, 0, 9)]),
    (["mmmm"], "mmm", [(0, 0, 3), (0, 1, 3)]),
    (["a line"], ".*", [(0, 0, 6)]),
    (["u\rv"], "u.v", [(0, 0, 3)]),
    (["stop\n"], "stop$", []),
    (["٣ x"], r"\d", [(0, 0, 2)]),
    (["né e"], r"\bn\w+", [(0, 0, 3)]),
    (["uv"], "x*", [(0, 0, 0), (0, 1, 0), (0, 2, 0)]),
]


@pytest.mark.parametrize(("files", "pattern", "want"), REGEX)
def test_regex(spark, files, pattern, want):
    assert run(spark, files, pattern, True) == want


def test_regex_either_case(spark):
    assert len(ci(spark, ["def BakeBread():\ndef bakeBREAD():"], "def .*Bread", True)) == 2
    assert len(ci(spark, ["Peat moss PEAT"], "peat", True)) == 2
    assert ci(spark, ["ı İ i I"], "i", True) == [(0, 6, 1), (0, 8, 1)]


@pytest.mark.parametrize("pattern", ["[invalid", "(a", "a)", "*a", "a{3,1}", "(?P<a-b>x)"])
def test_bad_regex(spark, pattern):
    with pytest.raises(InvalidPattern):
        run(spark, ["hello"], pattern, True)


@pytest.mark.parametrize("pattern", ["(?=a)b", "(?<!a)b", r"(a)\1", "a++", "(?>a)", r"[a&&b]"])
def test_unsupported_regex(spark, pattern):
    with pytest.raises(UnsupportedRegex):
        run(spark, ["hello"], pattern, True)


def test_empty_pattern():
    with pytest.raises(ValueError):
        Query("")


def test_limits_and_paths(spark):
    assert run(spark, ["tic tic tic", "tic tic tic"], "tic", max_matches=2) == [(0, 0, 3), (0, 4, 3)]
    assert run(spark, ["har arp hap"] * 20 + ["harp"], "harp", max_matches=1) == [(20, 0, 4)]
    files = [("code/one.py", "def bake(): pass"), ("code/two.py", "bake()"), ("NOTES", "how to bake")]
    for is_regex in (False, True):
        assert [x[0] for x in run(spark, files, "bake", is_regex, file_pattern="*.py")] == [0, 1]
    assert run(spark, [], "bake") == []
    assert len(run(spark, ["oats_and_rye\n" * 100], "oats_and_rye")) == 100


def test_lines(spark):
    c = source.from_rows(spark, [("a", "rye\noats rye\nbarley"), ("b", "just oats")])
    rows = {(r.file_idx, r.byte_offset, r.line_number) for r in se.search_literal(c, "oats").collect()}
    assert rows == {(0, 4, 2), (1, 5, None)}
    assert [r.line_number for r in se.search_literal(c, "\n").orderBy("byte_offset").collect()] == [1, 2]


CONTEXT = [
    ("one\ntwo\nthree owls\nfour\nfive", "owl", 1, "three owls", ["two"], ["four"]),
    ("an owl\ntwo\nthree", "owl", 2, "an owl", [], ["two", "three"]),
    ("one\ntwo\nan owl", "owl", 2, "an owl", ["one", "two"], []),
    ("one\r\nowl\r\nthree\r\n", "owl", 5, "owl", ["one"], ["three"]),
]


@pytest.mark.parametrize(("text", "pattern", "n", "line", "before", "after"), CONTEXT)
def test_context(spark, text, pattern, n, line, before, after):
    c = source.from_rows(spark, [("a", text)])
    (r,) = se.search(c, Query(pattern, options=SearchOptions(context_lines=n))).contexts.collect()
    assert (r.line_text, r.before, r.after) == (line, before, after)
    assert se.search(c, Query(pattern)).contexts is None


def test_rendering(spark):
    c = source.from_rows(spark, [("a.txt", "x1\nhit\nx2\nx3\nx4\nhit\nhit\nx5"), ("b.txt", "hit")])
    q = Query("hit", options=SearchOptions(context_lines=1))
    assert sorted(r.rendered for r in results.match_lines(c, Query("hit")).collect()) == ["a.txt:2:hit", "a.txt:6:hit", "a.txt:7:hit", "b.txt:0:hit"]
    got = [r.rendered for r in results.context_lines(c, q).orderBy("file_idx", "line", "part").collect()]
    assert got == ["a.txt-1-x1", "a.txt:2:hit", "a.txt-3-x2", "--", "a.txt-5-x4", "a.txt:6:hit", "a.txt-7-hit", "a.txt-8-x5", "b.txt:1:hit"]


def test_invalid_utf8(spark):
    """Literals are found in any bytes, regular expressions in text only."""
    c = source.from_rows(spark, [("a", b"\xff rye\nRYE \xfe\nrye"), ("b", b"rye"), ("c", b"\xe9")])
    assert sorted(map(tuple, se.search_literal(c, "rye").collect())) == [(0, 2, 3, 1), (0, 12, 3, 3), (1, 0, 3, None)]
    assert [r.byte_offset for r in se.search_literal(c, "rye", case_sensitive=False).filter("file_idx = 0").orderBy("byte_offset").collect()] == [2, 6, 12]
    assert [r.file_idx for r in se.search_regex(c, "ry.").collect()] == [1]
    assert sorted(r.rendered for r in results.match_lines(c, Query("rye")).collect()) == ["a:1:<binary>", "a:3:<binary>", "b:0:rye"]


def test_against_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAé\n x") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for pattern in ("a", "ab", "aba", "é", "\n", " x"):
        want = [(i, len(t[:k].encode()), len(pattern.encode())) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(pattern, k)]
        assert run(spark, texts, pattern) == want
        low = [(i, len(t[:k].encode()), len(t[k : k + len(pattern)].encode())) for i, t in enumerate(texts) for k in range(len(t)) if t[k : k + len(pattern)].lower() == pattern]
        assert ci(spark, texts, pattern) == low


def test_prefilter_loses_nothing(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["inn", "taverna", "Inn", "tavern", "qinnq", "ſoon", "soon"]) for _ in range(6)) for _ in range(40)]
    c = source.from_rows(spark, [(str(i), t) for i, t in enumerate(texts)])
    for pattern in ("q(inn|taverna)q", "inn.*taverna", "(inn|taverna) qinn", "soon"):
        for cs in (True, False):
            q = Query(pattern, True, SearchOptions(case_sensitive=cs))
            assert sorted(se.matches(c, q).collect()) == sorted(se.matches(c, q, prefilter=False).collect())


def test_hits_beyond_one_chunk(spark):
    text = "ab\n" * 2000
    got = se.search_literal(source.from_rows(spark, [("a", text)]), "ab").orderBy("byte_offset").collect()
    assert [(r.byte_offset, r.line_number) for r in got] == [(3 * i, i + 1) for i in range(2000)]
