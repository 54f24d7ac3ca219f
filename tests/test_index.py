"""Trigrams, varints, postings, admissibility, shards, stored indexes, directories."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import globs, ngrams, text as tx
from sieveline.operators import index as ix, postings as px, results, search as se
from sieveline.plans import folding, regex as rx
from sieveline.plans.query import Query, SearchOptions
from sieveline.sources import corpus as source


def column(spark, values, kind, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_trigrams(spark):
    got = column(spark, ["", "a", "ab", "abcde", "日本語文", "aあb", "😀🎉🚀"], "string", ngrams.trigrams)
    assert [[(t.tri, t.idx, t.byte_offset) for t in g] for g in got] == [
        [], [], [], [("abc", 0, 0), ("bcd", 1, 1), ("cde", 2, 2)], [("日本語", 0, 0), ("本語文", 1, 3)], [("aあb", 0, 0)], [("😀🎉🚀", 0, 0)],
    ]
    assert column(spark, ["ab", "abcd"], "string", ngrams.trigram_texts) == [[], ["abc", "bcd"]]


def test_encoding(spark):
    tris = ["abc", "日本語", "😀🎉🚀"]
    codes = column(spark, tris, "string", ngrams.encoded)
    assert codes == [ngrams.encode(t) for t in tris] and codes[0] == 97 << 42 | 98 << 21 | 99
    assert column(spark, codes, "bigint", ngrams.decoded) == tris == [ngrams.decode(c) for c in codes]
    bad = 0xD800 << 42 | 0x1FFFFF << 21 | 97
    assert column(spark, [bad], "bigint", ngrams.decoded) == ["��a"] == [ngrams.decode(bad)]


def test_variants(spark):
    got = column(spark, ["abc", "a1b", "123", "αβγ"], "string", ngrams.trigram_variants)
    assert [len(g) for g in got] == [8, 4, 1, 8] and "ΑΒΓ" in got[3] and got[0][0] == "abc"
    assert sorted(got[0]) == sorted(folding.trigram_variants("abc"))
    assert column(spark, ["ß"], "string", ngrams.rune_variants) == [["ß", "S"]]


def test_varints(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**35, 2**63 - 1]
    coded = column(spark, values, "bigint", tx.varint_encode)
    assert coded[2] == "7F" and coded[4] == "AC02"
    assert column(spark, coded, "string", tx.varint_decode) == values
    assert column(spark, values, "bigint", tx.varint_size) == [len(c) // 2 for c in coded]
    assert column(spark, ["80", "", "7F01", "80" * 11], "string", tx.varint_decode) == [None] * 4


def test_deltas(spark):
    lists = [[], [42], list(range(100)), [10, 100, 1000, 10000, 100000], list(range(0, 6000, 5))]
    coded = column(spark, lists, "array<bigint>", tx.deltas)
    assert coded[3] == [10, 90, 900, 9000, 90000]
    assert column(spark, coded, "array<bigint>", tx.undeltas) == lists


def test_text_functions(spark):
    assert column(spark, ["a\nb\n", "", "\n\n", "x"], "string", tx.newline_offsets) == [[1, 3], [], [0, 1], []]
    assert column(spark, ["a\r\nb\n", "a\rb", "a\n\n"], "string", tx.lines) == [["a", "b"], ["a\rb"], ["a", ""]]
    assert column(spark, ["éab"], "string", lambda c: F.array(*[tx.rune_to_byte(c, F.lit(i)) for i in (0, 1, 3, 4)])) == [[0, 2, 4, None]]
    assert column(spark, [b"xxab", b"x"], "binary", lambda c: tx.find_bytes(c, F.lit(b"ab"))) == [2, None]
    assert column(spark, [b"a\xffb"], "binary", tx.lossy_text) == ["a�b"]


def test_globs(spark):
    paths = ["src/main.rs", "lib.rs", "a/b/c.txt", "a/c.txt", "x-y", "x]y"]
    hits = lambda g: [p for p, ok in zip(paths, column(spark, paths, "string", lambda c: globs.matches(c, [g])), strict=True) if ok]
    assert hits("*.rs") == ["src/main.rs", "lib.rs"]
    assert hits("a/**/c.txt") == ["a/b/c.txt", "a/c.txt"]
    assert hits("x[!a-z]y") == ["x-y", "x]y"] and hits("x[]]y") == ["x]y"] and hits("?ib.rs") == ["lib.rs"]
    for bad in ("a**", "[a", "***"):
        with pytest.raises(globs.InvalidGlob):
            globs.to_regex(bad)
    ok = column(spark, paths, "string", lambda c: globs.admitted(c, ["*.rs", "a*"], ["*/b/*"]))
    assert ok == [True, True, False, True, False, False]


def test_admission(spark):
    o = source.BuilderOptions(file_max=100, trigram_max=5)
    cases = [(b"", "None"), (b"ab", "TooSmall"), (b"x" * 101, "TooLarge"), (b"hello\0world", "Binary"), (b"abcdefghij", "TooManyTrigrams"), (b"abababababab", "None"), (b"abc", "None")]
    assert column(spark, [c for c, _ in cases], "binary", lambda c: source.skip_reason(c, o)) == [r for _, r in cases]


def greedy(files, limit):
    """files: (file_idx, bytes, skipped) in order -> shard of each."""
    out, shard, used, closed = [], 0, 0, False
    for k, (_, n, skipped) in enumerate(files):
        n_ = 0 if skipped else n
        if k and (closed or used and used + n_ > limit):
            shard, used = shard + 1, 0
        out.append(shard)
        used, closed = used + n_, skipped and n > limit
    return out


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_shards(spark, run, monkeypatch):
    rng = random.Random(run)
    starts = source.shard_starts
    monkeypatch.setattr(source, "shard_starts", lambda sizes, limit: starts(sizes, limit, run))
    fixed = [(0, 60, False), (1, 30, False), (2, 20, False), (3, 100, False), (4, 1, False), (5, 0, False), (6, 300, True), (7, 5, False), (9, 400, True)]
    for files, limit in ((fixed, 100), ([(7 + 2 * i, rng.choice([0, 1, 5, 9, 20]), rng.random() < 0.2) for i in range(150)], 20), ([(i, rng.choice([3, 50]), rng.random() < 0.2) for i in range(90) if rng.random() < 0.7], 10)):
        files = [(i, n, s or n > limit) for i, n, s in files]
        frame = spark.createDataFrame([(i, "x" * n, s) for i, n, s in files], "file_idx bigint, text string, s boolean")
        got = {r.file_idx: r.shard for r in source.assign_shards(frame, limit, "text", F.col("s")).collect()}
        assert [got[i] for i, _, _ in files] == greedy(files, limit)
    assert source.assign_shards(frame.limit(0), 10, "text").count() == 0
    with pytest.raises(source.DocumentTooLarge):
        source.assign_shards(frame, 2, "text")


def test_shard_names():
    assert source.shard_name("idx", 0, 1) == "idx" and source.shard_name("idx", 3, 5) == "idx.00003"


def test_selection():
    assert px.selective_pair([(0, 100), (1, 5), (2, 10), (3, 50)]) == (1, 2)
    assert px.selective_pair([(0, 5), (1, 5), (2, 5)]) == (0, 1)
    assert px.selective_pair([(0, 7)]) == (0, 0)


def test_joins(spark):
    at = lambda *p: spark.createDataFrame([(0, x) for x in p], "file_idx bigint, pos bigint")
    assert sorted(r.pos for r in px.distance_join(at(0, 10, 20, 30), at(5, 15, 25, 35), 5).collect()) == [0, 10, 20, 30]
    assert px.distance_join(at(0, 10, 20), at(3, 13, 23), 5).count() == 0
    assert sorted(r.pos for r in px.merge(at(5, 15, 25), at(10, 15, 30)).collect()) == [5, 10, 15, 25, 30]


FILTERS = [
    ("sluice", rx.Contains("sluice")),
    ("dam.*weir", rx.AllOf((rx.Contains("dam"), rx.Contains("weir")))),
    ("dam|weir", rx.AnyOf((rx.Contains("dam"), rx.Contains("weir")))),
    ("brook|river|stream", rx.AnyOf(tuple(map(rx.Contains, ("brook", "river", "stream"))))),
    ("d.*w", rx.ANYTHING), ("[k-m]+", rx.ANYTHING), (".*", rx.ANYTHING), ("dam?", rx.ANYTHING), ("(ebb)*", rx.ANYTHING), ("(ebb)+", rx.Contains("ebb")),
    ("|".join(f"word{i}" for i in range(17)), rx.ANYTHING), ("dam|w", rx.ANYTHING),
]


@pytest.mark.parametrize(("pattern", "want"), FILTERS)
def test_required_literals(pattern, want):
    assert rx.required(rx.parse(pattern)) == want


def test_lowered():
    assert rx.lowered(rx.AllOf((rx.Contains("Foo"), rx.Contains("BAR")))) == rx.AllOf((rx.Contains("foo"), rx.Contains("bar")))
    assert rx.lowered(rx.ANYTHING) is rx.ANYTHING


def test_index_of_any_bytes(spark, tmp_path):
    """Files that are no UTF-8 are indexed and found by literals; no case of a letter is lost to the postings."""
    files = [("a.txt", b"caf\xe9 Kelvin bytes\nand Kelvin"), ("b.txt", "\u212aelvin scale"), ("c.txt", b"\xff\xfe\xfd"), ("d.txt", "kelvin \u017faddle saddle"), ("e.txt", b"\xc3\xa9t\xc3\xa9 \xe9")]
    done = ix.IndexBuilder().build(source.from_rows(spark, files), str(tmp_path / "i"))
    assert {r.skip_reason: r.files for r in done.collect()} == {"None": 5}
    index = ix.Index(spark, [str(tmp_path / "i")])
    assert index.file_count() == 5 and index.content(0) == files[0][1] and index.file_entry(0).newlines == [17] and index.file_entry(0).content_length == 28
    hits = lambda p, r=False, cs=True: sorted((r.file_idx, r.byte_offset, r.byte_length, r.line_number) for r in px.search(index, Query(p, r, SearchOptions(case_sensitive=cs))).collect())
    scan = lambda p, r=False, cs=True: sorted((r.file_idx, r.byte_offset, r.byte_length, r.line_number) for r in se.matches(source.from_rows(spark, files), Query(p, r, SearchOptions(case_sensitive=cs))).collect())
    for p in ("Kelvin", "kelvin", "bytes", "saddle", "été", "fd", "\ufffd\ufffd\ufffd", "alpha"):
        for cs in (True, False):
            assert hits(p, False, cs) == scan(p, False, cs), (p, cs)
    for p in ("kel[a-z]+", "sad+le", "(kelvin|scale) s"):
        for cs in (True, False):
            assert hits(p, True, cs) == scan(p, True, cs), (p, cs)
    assert hits("Kelvin") == [(0, 5, 6, 1), (0, 22, 6, 2)] and hits("été") == [(4, 0, 5, None)]
    assert [x[0] for x in hits("kelvin", cs=False)] == [0, 0, 1, 3] and hits("kelvin", True, False) == hits("kelvin", cs=False)
    lines = [r.rendered for r in results.match_lines(px.narrowed(index, Query("Kelvin")), Query("Kelvin")).orderBy("byte_offset").collect()]
    assert lines == ["a.txt:1:<binary>", "a.txt:2:<binary>"]
    c = index.counters().first()
    assert c.posting_count == sum(max(0, len(b.decode("utf-8", "replace") if isinstance(b, bytes) else b) - 2) for _, b in files) and c.ngram_count <= c.posting_count <= c.posting_bytes


def test_long_conversations(spark, tmp_path):
    spark.createDataFrame([(1, 1000, "u", "ebb"), (2, 0, "u", "ebb")], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert source.load(spark, str(tmp_path), "conversations").select("file_idx").distinct().count() == 2


FILES = [("a.rs", "fn main() { println!(\"hello\"); }\nlet x = 1;\n"), ("b.rs", "hello there hello"), ("c.txt", "There are no theres, said the reader\nhello"), ("d.bin", b"\0\1\2\3"), ("e.txt", "é néédlé hello É"), ("f.txt", "x")]
QUERIES = [("hello", False), ("there", False), ("he", False), ("néédlé", False), ("zzz", False), (r"println!\(.*\)", True), ("the(re|m)", True), ("[a-z]+o", True), ("hello", True)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "one")
    builder = ix.IndexBuilder(source.BuilderOptions(shard_max=60))
    builder.add_extension("sizes", lambda c: c.select("file_idx", F.length("text").alias("n")))
    builder.build(source.from_rows(spark, FILES), folder)
    return folder


def test_index_equals_scan(spark, stored):
    index = ix.Index(spark, [stored])
    corpus = source.from_rows(spark, [f for f in FILES if f[0] not in ("d.bin", "f.txt")])
    names = {r.path: r.file_idx for r in index.corpus.collect()}
    assert len(names) == 4 and index.file_count() == 4
    for pattern, is_regex in QUERIES:
        for cs in (True, False):
            for n in (0, 2):
                q = Query(pattern, is_regex, SearchOptions(case_sensitive=cs, max_matches=n))
                got = sorted((r.file_idx, r.byte_offset, r.byte_length, r.line_number) for r in px.search(index, q).collect())
                want = sorted((r.file_idx, r.byte_offset, r.byte_length, r.line_number) for r in se.matches(index.corpus, q).collect())
                assert got == want, (pattern, cs, n)
    assert corpus.count() == 4


def test_index_tables(spark, stored):
    index = ix.Index(spark, [stored])
    assert index.table("metadata").count() > 1  # shards
    assert index.content(1) == "hello there hello" and index.content(99) is None
    assert index.file_entry(0).newlines == [32, 43]
    assert index.table("sizes").count() == 4
    with pytest.raises(ix.InvalidIndex):
        ix.Index(spark, [stored + "/missing"])
    with pytest.raises(ValueError):
        ix.IndexBuilder().add_extension("files", lambda c: c)


def test_stats(spark, stored):
    index = ix.Index(spark, [stored])
    s = px.search_stats(index, Query("hello")).first()
    assert (s.ngram_lookups, s.matches_found, s.used_trigram_filtering) == (3, 5, True) and s.candidates_checked == 5 and s.bytes_loaded > 0
    s = px.search_stats(index, Query("zzzzzzz")).first()
    assert (s.ngram_lookups, s.matches_found, s.used_trigram_filtering, s.bytes_loaded) == (1, 0, False, 0)
    assert not px.search_stats(index, Query("he")).first().used_trigram_filtering


def test_many_folders(spark, tmp_path):
    for k, texts in enumerate((["hello world", "goodbye world"], ["new world order", "nothing here"])):
        ix.IndexBuilder().build(source.from_rows(spark, [(f"{k}{i}", t) for i, t in enumerate(texts)]), str(tmp_path / str(k)))
    index = ix.Index(spark, [str(tmp_path / "0"), str(tmp_path / "1")])
    assert index.file_count() == 4
    got = px.search(index, Query("world"))
    assert sorted((r.file_idx, r.byte_offset) for r in got.collect()) == [(0, 6), (1, 8), (2, 4)]
    assert index.content(3) == "nothing here"
    none = ix.Index(spark, [])
    assert none.file_count() == 0 and px.search(none, Query("anything")).count() == 0


def test_directory(spark, tmp_path):
    for name, data in {"b.rs": b"fn b", "_b.rs": b"fn _b", "sub/a.rs": b"fn a", ".hidden/x.rs": b"no", ".dot": b"no", "z.md": b"# z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = source.from_directory(spark, str(tmp_path)).orderBy("file_idx").collect()
    assert [r.path for r in rows] == ["_b.rs", "b.rs", "sub/a.rs", "z.md"] and [r.file_idx for r in rows] == [0, 1, 2, 3]
    assert [r.path for r in source.from_directory(spark, str(tmp_path), ["*.rs"], ["sub/*"]).orderBy("path").collect()] == ["_b.rs", "b.rs"]


def test_buckets(spark):
    for n, size, want in ((3, 4, [3]), (5, 4, [2, 3]), (10, 4, [2, 2, 2, 4]), (20, 8, [4, 4, 4, 8])):
        stats = spark.createDataFrame([(f"{i:03d}",) for i in range(n)], "tri string")
        assert [r.entries for r in ix.bucket_directory(stats, size).orderBy("bucket").collect()] == want
